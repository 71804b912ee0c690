"""DuckDB oracle SQL for the registered queries (same output column names)."""

from __future__ import annotations

from flowscore.plans.oracle_base import (
    BINARY_METRICS_CTE, COUNTS_SELECT, FLOW_COLS, LONG_CTE, SCORED_CTES, THREE_METRICS_COLS,
    l3_text, rank, with_ctes,
)

ORACLE: dict[str, str] = {}

ORACLE["score_all_modes"] = with_ctes(SCORED_CTES, body=f"""
SELECT {FLOW_COLS},
  b_ham AS pred_binary_HAM, {l3_text('l3_ham')} AS pred_3label_HAM, 'HAM' AS mode_HAM,
  b_fdm AS pred_binary_FDM, {l3_text('l3_fdm')} AS pred_3label_FDM, 'FDM' AS mode_FDM,
  b_dfdm AS pred_binary_DFDM, {l3_text('l3_dfdm')} AS pred_3label_DFDM, 'DFDM' AS mode_DFDM
FROM scored""")

_COUNTS_BY_MODE = f"counts AS (SELECT mode, {COUNTS_SELECT} FROM long GROUP BY mode)"

ORACLE["mode_comparison"] = with_ctes(SCORED_CTES, LONG_CTE, _COUNTS_BY_MODE, BINARY_METRICS_CTE, body=f"""
SELECT mode, {rank(('HAM', 'FDM', 'DFDM'))} AS position,
  round_even(CASE WHEN n <> 0 THEN CAST(n_pred_malicious AS DOUBLE) / CAST(n AS DOUBLE) ELSE 0.0 END * 100.0, 2)
    AS malicious_pct,
  round_even(accuracy, 6) AS accuracy, round_even(precision, 6) AS precision,
  round_even(sensitivity, 6) AS sensitivity, round_even(f1, 6) AS f1,
  CASE WHEN mode <> 'DFDM' THEN round_even(confident_accuracy, 6) END AS conf_acc,
  CASE WHEN mode <> 'DFDM' THEN round_even(warning_rate * 100.0, 3) END AS warn_rate_pct,
  CASE WHEN mode <> 'DFDM' THEN attacks_let_through END AS attacks_missed
FROM (SELECT *, {THREE_METRICS_COLS} FROM bm2) t
ORDER BY position""")

# ------------------------------------------------------------------ 2.2 prep
from flowscore.plans.oracle_base import FEATURES, FLOWS_SQL, clean  # noqa: E402

_F = f"flows AS ({FLOWS_SQL})"
_Y = "CASE WHEN label IS NOT DISTINCT FROM 'Benign' THEN 0 ELSE 1 END"


def _noinf(c: str) -> str:
    return f"CASE WHEN isinf(CAST({c} AS DOUBLE)) THEN NULL ELSE {c} END"


ORACLE["trim_columns"] = with_ctes(_F, body=f"SELECT {FLOW_COLS} FROM flows")
ORACLE["binarize_label"] = with_ctes(_F, body=f"SELECT flow_id, label, {_Y} AS y FROM flows")
ORACLE["numeric_label"] = "SELECT doc_id, CAST(toxic AS INTEGER) AS y FROM labels"
ORACLE["label_counts"] = with_ctes(_F, body=f"""
SELECT CAST(count_if({_Y} = 0) AS BIGINT) AS benign, CAST(count_if({_Y} = 1) AS BIGINT) AS malicious FROM flows""")
ORACLE["score_unlabeled"] = with_ctes(SCORED_CTES, body=f"""
SELECT {FLOW_COLS.replace(' label,', '')},
  b_ham AS pred_binary_HAM, {l3_text('l3_ham')} AS pred_3label_HAM, 'HAM' AS mode_HAM,
  b_fdm AS pred_binary_FDM, {l3_text('l3_fdm')} AS pred_3label_FDM, 'FDM' AS mode_FDM,
  b_dfdm AS pred_binary_DFDM, {l3_text('l3_dfdm')} AS pred_3label_DFDM, 'DFDM' AS mode_DFDM
FROM scored""")
ORACLE["clean_inf"] = with_ctes(_F, body="SELECT flow_id, " + ", ".join(
    f"{_noinf(c)} AS {c}" for c in FEATURES) + " FROM flows")
ORACLE["required_columns"] = with_ctes(_F, body=" UNION ALL ".join(
    f"""SELECT '{c}' AS feature, TRUE AS present,
       CAST(count_if(CAST({c} AS DOUBLE) IS NULL) AS BIGINT) AS n_null,
       CAST(count_if(isnan(CAST({c} AS DOUBLE))) AS BIGINT) AS n_nan,
       CAST(count_if(isinf(CAST({c} AS DOUBLE))) AS BIGINT) AS n_inf FROM flows""" for c in FEATURES))
_ENC = """
enc AS (
  SELECT col AS "column", cls AS class, CAST(dense_rank() OVER (PARTITION BY col ORDER BY cls) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT 'protocol' AS col, protocol AS cls FROM flows WHERE protocol IS NOT NULL
        UNION SELECT DISTINCT 'label', label FROM flows WHERE label IS NOT NULL) d)
"""
ORACLE["encoder_fit"] = with_ctes(_F, _ENC, body='SELECT "column", class, code FROM enc')
ORACLE["encode_categorical"] = with_ctes(_F, _ENC, body="""
SELECT f.flow_id, COALESCE(ep.code, 0) AS protocol_code, COALESCE(el.code, 0) AS label_code
FROM flows f
LEFT JOIN (SELECT class, code FROM enc WHERE "column" = 'protocol') ep ON COALESCE(f.protocol, 'nan') = ep.class
LEFT JOIN (SELECT class, code FROM enc WHERE "column" = 'label') el ON COALESCE(f.label, 'nan') = el.class""")
ORACLE["project_features"] = with_ctes(_F, body="SELECT flow_id, " + ", ".join(
    f"CAST({_noinf(c)} AS DOUBLE) AS {c}" for c in FEATURES) + " FROM flows")
ORACLE["fill_missing"] = with_ctes(_F, body="SELECT flow_id, " + ", ".join(
    f"{clean(c)} AS {c}" for c in FEATURES) + " FROM flows")
_FILLED = "filled AS (SELECT flow_id, label, " + ", ".join(f"{clean(c)} AS {c}" for c in FEATURES) + " FROM flows)"
_SCALER = "sc AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS s_{c}"
    for c in FEATURES) + " FROM filled)"
ORACLE["scaler_fit"] = with_ctes(_F, _FILLED, _SCALER, body=" UNION ALL ".join(
    f"SELECT '{c}' AS feature, round_even(m_{c}, 6) AS mean, round_even(s_{c}, 6) AS scale FROM sc"
    for c in FEATURES))
ORACLE["standard_scale"] = with_ctes(_F, _FILLED, _SCALER, body="SELECT flow_id, " + ", ".join(
    f"round_even(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in FEATURES) + " FROM filled, sc")
ORACLE["preprocess"] = with_ctes(_F, _FILLED, _SCALER, body=f"SELECT flow_id, {_Y} AS y, " + ", ".join(
    f"round_even(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in FEATURES) + " FROM filled, sc")
ORACLE["prediction_output"] = with_ctes(SCORED_CTES, body=f"""
SELECT {FLOW_COLS}, b_fdm AS pred_binary, {l3_text('l3_fdm')} AS pred_3label, 'FDM' AS mode FROM scored""")
_FDM_F = ("flow_iat_mean", "fwd_packet_length_max", "init_bwd_win_bytes", "init_fwd_win_bytes")
ORACLE["feature_subsets"] = with_ctes(_F, body="SELECT flow_id, " + ", ".join(
    [f"{clean(c)} AS fdm_{c}" for c in _FDM_F] + [f"{clean(c)} AS ham_{c}" for c in FEATURES]) + " FROM flows")
ORACLE["single_row_source"] = with_ctes(_F, body="SELECT " + ", ".join(FEATURES) + " FROM flows")

# ------------------------------------------------------------------ 2.3 routing
_JOBS = """
jobs AS (
  SELECT o_orderkey AS job_id,
    CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'done' ELSE 'pending' END AS status,
    CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1000 WHEN 3 THEN 5000 ELSE 777 END AS flow_rate,
    CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'label' WHEN 2 THEN 'protocol' ELSE 'attack' END AS label_col,
    CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 4 = 2 THEN '6' ELSE 'Benign' END AS benign_label,
    concat('flows_', CAST(o_orderkey AS VARCHAR),
           CASE o_orderkey % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.CSV' ELSE '.txt' END) AS input_filename,
    o_orderdate AS created_at
  FROM orders)
"""


def _mode(rate: str, high, extreme) -> str:
    return (f"CASE WHEN {rate} IS NULL THEN NULL WHEN {rate} >= {extreme} THEN 'DFDM' "
            f"WHEN {rate} >= {high} THEN 'FDM' ELSE 'HAM' END")


ORACLE["flow_to_mode"] = with_ctes(_JOBS, body=f"SELECT job_id, flow_rate, {_mode('flow_rate', 1000, 5000)} AS mode FROM jobs")
_HOURLY = "hourly AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS rate FROM events GROUP BY 1)"
ORACLE["select_mode"] = with_ctes(_HOURLY, body=f"SELECT window_start, rate, {_mode('rate', 10, 20)} AS mode FROM hourly")
ORACLE["windowed_rate_mode"] = with_ctes(_HOURLY, body=f"""
SELECT e.event_id, h.window_start, h.rate, {_mode('h.rate', 10, 20)} AS mode
FROM events e JOIN hourly h ON date_trunc('hour', e.ts) = h.window_start""")
ORACLE["all_modes_long"] = with_ctes(SCORED_CTES, LONG_CTE, body=f"""
SELECT flow_id, mode, b AS pred_binary, {l3_text('l3')} AS pred_3label FROM long""")
ORACLE["routed_predict"] = with_ctes(SCORED_CTES, body=f"""
, daily AS (SELECT date_trunc('day', seen_at) AS d, count(*) AS rate FROM flows GROUP BY 1),
r AS (SELECT s.*, daily.rate, {_mode('daily.rate', 20, 30)} AS mode FROM scored s JOIN daily ON date_trunc('day', s.seen_at) = daily.d)
SELECT flow_id, rate AS flow_rate, mode,
  CASE mode WHEN 'HAM' THEN b_ham WHEN 'FDM' THEN b_fdm ELSE b_dfdm END AS pred_binary,
  {l3_text("CASE mode WHEN 'HAM' THEN l3_ham WHEN 'FDM' THEN l3_fdm ELSE l3_dfdm END")} AS pred_3label
FROM r""").replace("\n\n, daily", ", daily")

# ------------------------------------------------------------------ 2.4 voting
ORACLE["member_votes"] = with_ctes(SCORED_CTES, body="""
SELECT flow_id, v1 AS vote_m1, v2 AS vote_m2, v3 AS vote_m3, v4 AS vote_m4, v5 AS vote_m5 FROM scored""")
ORACLE["weighted_vote"] = with_ctes(SCORED_CTES, body="SELECT flow_id, vd_fdm, vd_ham FROM scored")
ORACLE["hard_vote"] = with_ctes(SCORED_CTES, body="SELECT flow_id, hv_fdm, hv_ham FROM scored")
ORACLE["vote_threshold"] = with_ctes(SCORED_CTES, body="""
SELECT flow_id, vd_ham, CAST(2.75 AS DOUBLE) AS max_vote_index, b_ham AS pred_binary FROM scored""")
ORACLE["fdm_binary"] = with_ctes(SCORED_CTES, body="SELECT flow_id, b_fdm AS pred_binary FROM scored")
ORACLE["ham_binary"] = with_ctes(SCORED_CTES, body="SELECT flow_id, b_ham AS pred_binary FROM scored")
ORACLE["dfdm_binary"] = with_ctes(SCORED_CTES, body="SELECT flow_id, b_dfdm AS pred_binary FROM scored")
_EE = """
ee AS (SELECT flow_id, CASE WHEN v1 = 1 THEN 1 WHEN v2 = 1 THEN 2 WHEN v3 = 1 THEN 3 WHEN v4 = 1 THEN 4 END AS stage
       FROM scored)
"""
ORACLE["dfdm_early_exit"] = with_ctes(SCORED_CTES, _EE, body="""
SELECT flow_id, CASE WHEN stage IS NULL THEN 0 ELSE 1 END AS pred_binary, 'm' || CAST(stage AS VARCHAR) AS exit_member
FROM ee""")
ORACLE["dfdm_early_exit_fitted"] = with_ctes(SCORED_CTES, """
fe AS (SELECT flow_id, CASE WHEN x_fwd_packet_length_max > 45 THEN 'high'
  WHEN (CASE WHEN x_fwd_packet_length_max > 29 THEN 0.9 ELSE 0.05 END
        + CASE WHEN x_flow_iat_mean > 0.045 THEN 0.7 ELSE 0.1 END) / 2 > 0.5 THEN 'forest'
  WHEN x_avg_packet_size > 2000 THEN 'size' END AS exit_member FROM scored)""", body="""
SELECT flow_id, CASE WHEN exit_member IS NULL THEN 0 ELSE 1 END AS pred_binary, exit_member FROM fe""")
ORACLE["cascade_survivors"] = with_ctes(SCORED_CTES, _EE, """
c AS (SELECT count(*) AS n, count_if(stage = 1) AS f1, count_if(stage = 2) AS f2, count_if(stage = 3) AS f3,
             count_if(stage = 4) AS f4 FROM ee)""", body="""
SELECT 1 AS stage, 'm1' AS member, CAST(n AS BIGINT) AS evaluated, CAST(f1 AS BIGINT) AS flagged FROM c
UNION ALL SELECT 2, 'm2', CAST(n - f1 AS BIGINT), CAST(f2 AS BIGINT) FROM c
UNION ALL SELECT 3, 'm3', CAST(n - f1 - f2 AS BIGINT), CAST(f3 AS BIGINT) FROM c
UNION ALL SELECT 4, 'm4', CAST(n - f1 - f2 - f3 AS BIGINT), CAST(f4 AS BIGINT) FROM c""")
ORACLE["three_label"] = with_ctes(SCORED_CTES, body="""
SELECT flow_id, mean_fdm AS mean_p_fdm, std_fdm AS std_p_fdm, l3_fdm AS label3_fdm,
  mean_ham AS mean_p_ham, std_ham AS std_p_ham, l3_ham AS label3_ham FROM scored""")
for _m in ("fdm", "ham", "dfdm"):
    ORACLE[f"{_m}_three_label"] = with_ctes(SCORED_CTES, body=f"SELECT flow_id, {l3_text('l3_' + _m)} AS pred_3label FROM scored")
ORACLE["predict_one_mode"] = with_ctes(SCORED_CTES, body=f"""
SELECT flow_id, b_ham AS pred_binary, {l3_text('l3_ham')} AS pred_3label, 'HAM' AS mode FROM scored""")
ORACLE["chunked_score"] = with_ctes(SCORED_CTES, body=f"""
SELECT {FLOW_COLS}, b_dfdm AS pred_binary, {l3_text('l3_dfdm')} AS pred_3label, 'DFDM' AS mode FROM scored""")
ORACLE["union_chunks"] = ORACLE["score_all_modes"]
ORACLE["single_row_verdict"] = with_ctes(SCORED_CTES, LONG_CTE, body=f"""
SELECT flow_id, mode, CASE b WHEN 0 THEN 'Benign' WHEN 1 THEN 'Malicious' END AS binary_text,
  CASE WHEN mode <> 'DFDM' THEN {l3_text('l3')} END AS label3_text,
  CASE WHEN b = y THEN 'correct' ELSE 'wrong' END AS correct
FROM long""")

# ------------------------------------------------------------------ 2.6 metrics
ORACLE["member_accuracies"] = with_ctes(SCORED_CTES, """
a AS (SELECT count(*) AS n, count_if(v1 = y) AS k1, count_if(v2 = y) AS k2, count_if(v3 = y) AS k3,
             count_if(v4 = y) AS k4, count_if(v5 = y) AS k5 FROM scored)""", body=" UNION ALL ".join(
    f"SELECT '{g}' AS mode, 'm{i}' AS member, "
    f"CASE WHEN n > 0 THEN CAST(k{i} AS DOUBLE) / CAST(n AS DOUBLE) ELSE 0.0 END AS accuracy FROM a"
    for g, ms in (("FDM/DFDM", (1, 2, 3, 4)), ("HAM", (1, 2, 3, 4, 5))) for i in ms))

ORACLE["confusion_counts"] = with_ctes(SCORED_CTES, LONG_CTE, _COUNTS_BY_MODE,
                                       body="SELECT mode, tp, tn, fp, fn FROM counts")
ORACLE["binary_metrics"] = with_ctes(SCORED_CTES, LONG_CTE, _COUNTS_BY_MODE, BINARY_METRICS_CTE, body="""
SELECT mode, tp + tn + fp + fn AS total, accuracy, precision, sensitivity, f1 FROM bm2""")
_COUNTS_2 = f"counts AS (SELECT mode, {COUNTS_SELECT} FROM long WHERE mode <> 'DFDM' GROUP BY mode)"
_TL = f"tl AS (SELECT *, {THREE_METRICS_COLS} FROM counts)"
ORACLE["confident_accuracy"] = with_ctes(SCORED_CTES, LONG_CTE, _COUNTS_2, _TL,
                                         body="SELECT mode, n_confident, confident_accuracy FROM tl")
ORACLE["three_label_metrics"] = with_ctes(SCORED_CTES, LONG_CTE, _COUNTS_2, _TL, body="""
SELECT mode, confident_accuracy, warning_rate, benign_precision, benign_recall, malicious_precision,
  malicious_recall, attacks_let_through FROM tl""")
ORACLE["attacks_let_through"] = with_ctes(SCORED_CTES, LONG_CTE, _COUNTS_2, _TL,
                                          body="SELECT mode, attacks_let_through FROM tl")
ORACLE["warning_breakdown"] = with_ctes(SCORED_CTES, LONG_CTE, _COUNTS_2, body="""
SELECT mode, n_benign, n_warning, n_malicious, warn_actually_benign, warn_actually_malicious FROM counts""")
ORACLE["mode_summary"] = with_ctes(SCORED_CTES, LONG_CTE, _COUNTS_BY_MODE, body=f"""
SELECT mode, {rank(('HAM', 'FDM', 'DFDM'))} AS position, n, n_pred_malicious AS n_malicious_binary,
  n - n_pred_malicious AS n_benign_binary,
  round_even(CASE WHEN n <> 0 THEN CAST(n_pred_malicious AS DOUBLE) / CAST(n AS DOUBLE) ELSE 0.0 END * 100.0, 2) AS attack_pct,
  CASE WHEN mode <> 'DFDM' THEN n_benign END AS n_benign_3l,
  CASE WHEN mode <> 'DFDM' THEN n_warning END AS n_warning_3l,
  CASE WHEN mode <> 'DFDM' THEN n_malicious END AS n_malicious_3l,
  CASE WHEN mode <> 'DFDM' THEN round_even(CASE WHEN n <> 0 THEN CAST(n_warning AS DOUBLE) / CAST(n AS DOUBLE)
       ELSE 0.0 END * 100.0, 2) END AS warn_rate_pct
FROM counts ORDER BY position""")
ORACLE["evaluate_all_modes"] = with_ctes(SCORED_CTES, LONG_CTE, _COUNTS_BY_MODE, BINARY_METRICS_CTE, body=f"""
SELECT mode, {rank(('FDM', 'DFDM', 'HAM'))} AS position, accuracy, precision, sensitivity, f1, tp, tn, fp, fn
FROM bm2 ORDER BY position""")
ORACLE["metrics_by_label"] = with_ctes(SCORED_CTES, LONG_CTE, body=f"""
SELECT label, mode, {COUNTS_SELECT.split(',')[0]}, CAST(count_if(y = 1 AND b = 1) AS BIGINT) AS tp,
  CAST(count_if(y = 0 AND b = 0) AS BIGINT) AS tn, CAST(count_if(y = 0 AND b = 1) AS BIGINT) AS fp,
  CAST(count_if(y = 1 AND b = 0) AS BIGINT) AS fn, CAST(count_if(l3 = 1) AS BIGINT) AS n_warning
FROM long GROUP BY label, mode""")
ORACLE["metrics_rollup"] = with_ctes(SCORED_CTES, LONG_CTE, body="""
SELECT protocol, label, CAST(GROUPING(protocol, label) AS INTEGER) AS grouping_level, mode,
  CAST(count(*) AS BIGINT) AS n, CAST(count_if(y = 1 AND b = 1) AS BIGINT) AS tp,
  CAST(count_if(y = 0 AND b = 0) AS BIGINT) AS tn, CAST(count_if(y = 0 AND b = 1) AS BIGINT) AS fp,
  CAST(count_if(y = 1 AND b = 0) AS BIGINT) AS fn
FROM long GROUP BY mode, ROLLUP (protocol, label)""")

# ------------------------------------------------------------------ 2.7 telemetry
_SAMPLES = """
samples AS (SELECT event_type AS stage, ts, value AS mem_mb, CAST(user_id % 100 AS DOUBLE) AS cpu_pct,
                   CAST(event_id % 16 + 1 AS INTEGER) AS threads FROM events)
"""
_ROLLUP = """
rollup_t AS (
  SELECT stage, CAST(epoch_us(max(ts)) - epoch_us(min(ts)) AS DOUBLE) / 1e6 AS elapsed_sec,
    arg_min(mem_mb, ts) AS start_mem_mb, arg_max(mem_mb, ts) AS end_mem_mb,
    max(mem_mb) AS peak_mem_mb, min(mem_mb) AS min_mem_mb,
    COALESCE(avg(cpu_pct), 0.0) AS avg_cpu_pct, COALESCE(max(cpu_pct), 0.0) AS max_cpu_pct,
    avg(CAST(threads AS DOUBLE)) AS avg_threads, max(threads) AS max_threads,
    CAST(count(*) AS BIGINT) AS n_poll_samples,
    arg_max(mem_mb, ts) - arg_min(mem_mb, ts) AS mem_delta_mb,
    max(mem_mb) - arg_min(mem_mb, ts) AS peak_increase_mb
  FROM samples GROUP BY stage)
"""
ORACLE["stage_rollup"] = with_ctes(_SAMPLES, _ROLLUP, body="SELECT * FROM rollup_t")
ORACLE["stage_summary"] = with_ctes(_SAMPLES, _ROLLUP, body="""
SELECT stage, round_even(elapsed_sec, 3) AS time_s, round_even(mem_delta_mb, 2) AS mem_delta_mb,
  round_even(peak_increase_mb, 2) AS peak_delta_mb, round_even(peak_mem_mb, 2) AS peak_mem_mb,
  round_even(avg_cpu_pct, 1) AS avg_cpu_pct, round_even(max_cpu_pct, 1) AS max_cpu_pct, max_threads,
  n_poll_samples AS poll_samples
FROM rollup_t WHERE NOT starts_with(stage, 'sign') AND elapsed_sec IS NOT NULL""")
_TIMING = """
timing AS (
  SELECT path, mean_sec, std_sec, mean_sec / CAST(n_samples AS DOUBLE) * 1e6 AS per_sample_us,
    std_sec / CAST(n_samples AS DOUBLE) * 1e6 AS per_sample_std_us, mean_sec * 1000.0 AS total_ms,
    CASE WHEN mean_sec > 0 THEN CAST(n_samples AS DOUBLE) / mean_sec ELSE 0.0 END AS throughput_sps,
    n_samples, n_repeats
  FROM (SELECT event_type AS path, avg(value) AS mean_sec, stddev_pop(value) AS std_sec,
               CAST(1000 AS BIGINT) AS n_samples, CAST(count(*) AS BIGINT) AS n_repeats
        FROM events GROUP BY event_type) t)
"""
ORACLE["path_timing"] = with_ctes(_TIMING, body="""
SELECT path, round_even(mean_sec, 6) AS mean_sec, round_even(std_sec, 6) AS std_sec,
  round_even(per_sample_us, 6) AS per_sample_us, round_even(per_sample_std_us, 6) AS per_sample_std_us,
  round_even(total_ms, 6) AS total_ms, round_even(throughput_sps, 6) AS throughput_sps, n_samples, n_repeats
FROM timing""")
ORACLE["path_delta"] = with_ctes(_TIMING, """
pairs AS (SELECT * FROM (VALUES ('binary', 'click', 'view'), ('3-label', 'error', 'purchase'))
          AS p(tag, first_path, second_path))""", body="""
SELECT p.tag, p.first_path, p.second_path, round_even(a.per_sample_us, 6) AS first_us,
  round_even(b.per_sample_us, 6) AS second_us, round_even(b.per_sample_us - a.per_sample_us, 6) AS delta_us,
  round_even((b.per_sample_us / a.per_sample_us - 1.0) * 100.0, 6) AS delta_pct
FROM pairs p JOIN timing a ON a.path = p.first_path JOIN timing b ON b.path = p.second_path""")
ORACLE["efficiency_table"] = with_ctes(_SAMPLES, _ROLLUP, _TIMING, body="""
SELECT t.path,
  round_even(t.throughput_sps / greatest(abs(r.mem_delta_mb), 0.1), 1) AS samples_per_sec_per_mb,
  round_even(t.throughput_sps / greatest(r.avg_cpu_pct, 0.1), 0) AS samples_per_sec_per_cpu_pct,
  round_even(t.per_sample_us * greatest(abs(r.mem_delta_mb), 0.1), 4) AS us_x_peak_mb
FROM timing t JOIN rollup_t r ON r.stage = t.path""")

# ------------------------------------------------------------------ 2.9 jobs
_VALID = """
valid AS (
  SELECT *, CASE WHEN NOT (flow_rate IS NULL OR flow_rate IN (0, 1000, 5000))
                   THEN 'flow_rate must be one of [0, 1000, 5000] or omitted for all modes'
                 WHEN NOT ends_with(lower(input_filename), '.csv') THEN 'file must be a .csv' END AS reject_reason
  FROM jobs),
manifest AS (
  SELECT job_id, status, flow_rate, NULLIF(label_col, '') AS label_col,
    COALESCE(NULLIF(benign_label, ''), 'Benign') AS benign_label, input_filename, created_at
  FROM valid WHERE reject_reason IS NULL)
"""
ORACLE["job_validate"] = with_ctes(_JOBS, _VALID, body="""
SELECT job_id, reject_reason IS NULL AS accepted, reject_reason FROM valid""")
ORACLE["job_defaults"] = with_ctes(_JOBS, _VALID, body="""
SELECT job_id, 'pending' AS status, flow_rate, label_col, benign_label, input_filename FROM manifest""")
ORACLE["job_score"] = with_ctes(SCORED_CTES, _JOBS, _VALID, body=f"""
, jm AS (
  SELECT m.job_id, s.flow_id, s.label, s.protocol, m.label_col, m.benign_label, md.mode,
    s.b_ham, s.b_fdm, s.b_dfdm, s.l3_ham, s.l3_fdm, s.l3_dfdm
  FROM scored s JOIN manifest m ON s.order_key = m.job_id
  JOIN (SELECT 'HAM' AS mode UNION ALL SELECT 'FDM' UNION ALL SELECT 'DFDM') md
    ON md.mode = COALESCE({_mode('m.flow_rate', 1000, 5000)}, md.mode))
SELECT job_id, flow_id, mode,
  CASE mode WHEN 'HAM' THEN b_ham WHEN 'FDM' THEN b_fdm ELSE b_dfdm END AS pred_binary,
  {l3_text("CASE mode WHEN 'HAM' THEN l3_ham WHEN 'FDM' THEN l3_fdm ELSE l3_dfdm END")} AS pred_3label,
  CASE WHEN label_col IS NULL OR label_col = 'attack' THEN NULL
    WHEN CASE label_col WHEN 'label' THEN label ELSE protocol END IS NOT DISTINCT FROM benign_label THEN 0 ELSE 1 END AS y
FROM jm""").replace("\n\n, jm", ", jm")
ORACLE["job_status_codes"] = with_ctes(_JOBS, _VALID, body="""
SELECT e.event_id AS request_id, m.status,
  CASE WHEN m.status IS NULL THEN 404 WHEN m.status IN ('pending', 'running') THEN 202
       WHEN m.status = 'failed' THEN 500 ELSE 200 END AS code
FROM events e LEFT JOIN manifest m ON m.job_id = e.event_id""")
ORACLE["job_latest_status"] = with_ctes(_JOBS.replace(
    "o_orderdate AS created_at", "o_orderdate AS created_at, concat('Traceback: ', repeat(o_orderpriority, 200)) AS error_text"),
    _VALID.replace("input_filename, created_at", "input_filename, created_at, error_text"), """
log AS (
  SELECT job_id, 'pending' AS event_status, created_at AS ts, CAST(NULL AS VARCHAR) AS error_message FROM manifest
  UNION ALL SELECT job_id, 'running', created_at + INTERVAL 1 HOUR, NULL FROM manifest WHERE status IN ('done', 'failed')
  UNION ALL SELECT job_id, status, created_at + INTERVAL 2 HOUR,
    CASE WHEN status = 'failed' THEN right(error_text, 2000) END FROM manifest WHERE status IN ('done', 'failed'))""",
    body="""
SELECT job_id, arg_max(event_status, ts) AS status, max(ts) AS updated_at, arg_max(error_message, ts) AS error_message,
  CAST(count(*) AS BIGINT) AS n_events
FROM log GROUP BY job_id""")
ORACLE["job_rollup"] = with_ctes(_JOBS, _VALID, body="""
SELECT status, flow_rate, CAST(count(*) AS BIGINT) AS n_jobs FROM manifest GROUP BY status, flow_rate""")

# ------------------------------------------------------------------ 2.8 batch forms


def _batches(key: str | None, gap_us: int | None, n: int | None) -> str:
    part = f"PARTITION BY {key} " if key else ""
    pk = f"{key}, " if key else ""
    w = f"({part}ORDER BY t, event_id)"
    gap = "0" if gap_us is None else f"CASE WHEN t - lag(t) OVER {w} >= {gap_us} THEN 1 ELSE 0 END"
    chunk = f"(pos_in_burst - 1) // {n}" if n else "0"
    inb = f"((pos_in_burst - 1) % {n}) + 1" if n else "pos_in_burst"
    return f"""
ord AS (SELECT event_id, user_id, event_type, value,
               CASE WHEN event_id % 3 = 0 THEN -1 WHEN event_id % 7 <> 0 THEN user_id END AS owner, CASE WHEN event_id % 7 <> 0 THEN CAST(ts AS DATE) END AS day,
               ts, epoch_us(ts) AS t FROM events),
g AS (SELECT *, row_number() OVER {w} AS arrival_pos,
             CASE WHEN lag(t) OVER {w} IS NULL THEN 1 ELSE {gap} END AS flag FROM ord),
b AS (SELECT *, CAST(sum(flag) OVER ({part}ORDER BY t, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
                     AS BIGINT) AS burst FROM g),
c AS (SELECT *, row_number() OVER (PARTITION BY {pk}burst ORDER BY t, event_id) AS pos_in_burst FROM b),
nb AS (SELECT *, dense_rank() OVER ({part}ORDER BY burst, {chunk}) AS batch_num,
              CAST({inb} AS BIGINT) AS pos_in_batch FROM c)
"""


ORACLE["count_batches"] = with_ctes(_batches(None, None, 5), body="""
SELECT event_id, arrival_pos, batch_num, pos_in_batch FROM nb""")
ORACLE["idle_batches"] = with_ctes(_batches(None, 300_000_000, None), body="""
SELECT event_id, burst, pos_in_burst FROM nb""")
ORACLE["micro_batches"] = with_ctes(_batches(None, 300_000_000, 5), body="""
SELECT event_id, burst, batch_num, pos_in_batch FROM nb""")
ORACLE["micro_batches_by_user"] = with_ctes(_batches("user_id", 6 * 3600 * 1_000_000, 5), body="""
SELECT user_id, event_id, burst, batch_num, pos_in_batch FROM nb""")
ORACLE["micro_batches_by_type"] = with_ctes(_batches("event_type", 300_000_000, 5), body="""
SELECT event_type, event_id, burst, batch_num, pos_in_batch FROM nb""")
ORACLE["micro_batches_by_day"] = with_ctes(_batches("day", 300_000_000, 5), body="""
SELECT CAST(day AS VARCHAR) AS day, event_id, burst, batch_num, pos_in_batch FROM nb""")
ORACLE["batch_progress"] = with_ctes(_batches(None, 300_000_000, 5), body="""
SELECT batch_num, CAST(count(*) AS BIGINT) AS n_rows, max(arrival_pos) AS rows_seen FROM nb GROUP BY batch_num""")
ORACLE["leftover_rows"] = with_ctes(_batches("user_id", 6 * 3600 * 1_000_000, 5), """
sizes AS (SELECT user_id, batch_num, count(*) AS n_rows FROM nb GROUP BY user_id, batch_num),
lastb AS (SELECT user_id, max(batch_num) AS batch_num FROM nb GROUP BY user_id)""", body="""
SELECT nb.user_id, nb.event_id, nb.batch_num FROM nb
JOIN lastb l ON l.user_id = nb.user_id AND l.batch_num = nb.batch_num
JOIN sizes s ON s.user_id = nb.user_id AND s.batch_num = nb.batch_num
WHERE s.n_rows < 5""")
ORACLE["tail_new_rows"] = with_ctes(_F, body="""
SELECT flow_id, arrival_pos FROM (
  SELECT flow_id, row_number() OVER (ORDER BY seen_at, flow_id) AS arrival_pos FROM flows) t
WHERE arrival_pos > 1000""")

# ------------------------------------------------------------------ 2.1 sources/sinks
ORACLE["scan_flows"] = with_ctes(_F, body=f"SELECT {FLOW_COLS} FROM flows")
ORACLE["sink_roundtrip"] = ORACLE["score_all_modes"]
ORACLE["archive_by_batch"] = with_ctes(SCORED_CTES, body=f"""
SELECT flow_id, CAST((row_number() OVER (ORDER BY seen_at, flow_id) - 1) // 4096 + 1 AS BIGINT) AS batch_num,
  b_ham AS pred_binary_HAM, {l3_text('l3_ham')} AS pred_3label_HAM, 'HAM' AS mode_HAM,
  b_fdm AS pred_binary_FDM, {l3_text('l3_fdm')} AS pred_3label_FDM, 'FDM' AS mode_FDM,
  b_dfdm AS pred_binary_DFDM, {l3_text('l3_dfdm')} AS pred_3label_DFDM, 'DFDM' AS mode_DFDM
FROM scored""")

# ------------------------------------------------------------------ 2.8 streams
ORACLE["stream_score"] = ORACLE["score_all_modes"]
ORACLE["stream_mode_counts"] = with_ctes(SCORED_CTES, LONG_CTE, body=f"""
SELECT mode, {l3_text('l3')} AS pred_3label, CAST(count(*) AS BIGINT) AS n FROM long GROUP BY mode, l3""")
ORACLE["stream_rate_mode"] = with_ctes(_HOURLY, body=f"SELECT window_start, rate, {_mode('rate', 10, 20)} AS mode FROM hourly")
ORACLE["stream_micro_batches"] = ORACLE["micro_batches"]

# ------------------------------------------------------------------ 2.5 / 2.13 fits
ORACLE["class_weights"] = with_ctes(SCORED_CTES, body="""
SELECT y, CAST(count(*) AS BIGINT) AS n_class,
  CAST(sum(count(*)) OVER () AS DOUBLE) / (2.0 * CAST(count(*) AS DOUBLE)) AS weight
FROM scored GROUP BY y""")
ORACLE["threshold_sweep"] = with_ctes(SCORED_CTES, """
g AS (SELECT vd_ham AS threshold, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM scored GROUP BY vd_ham),
s AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g)""", body="""
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(P - tp AS BIGINT) AS fn,
  CAST(N - fp AS BIGINT) AS tn, CAST(tp + N - fp AS DOUBLE) / CAST(P + N AS DOUBLE) AS accuracy FROM s""")

ORACLE["bundle_summary"] = with_ctes(SCORED_CTES, """
a AS (SELECT count(*) AS n, count_if(v1 = y) AS k1, count_if(v2 = y) AS k2, count_if(v3 = y) AS k3,
             count_if(v4 = y) AS k4, count_if(v5 = y) AS k5 FROM scored),
w AS (SELECT CAST(k1 AS DOUBLE) / n AS w1, CAST(k2 AS DOUBLE) / n AS w2, CAST(k3 AS DOUBLE) / n AS w3,
             CAST(k4 AS DOUBLE) / n AS w4, CAST(k5 AS DOUBLE) / n AS w5 FROM a),
t AS (SELECT *, (w1 + w2 + w3 + w4) / 2.0 AS t_fdm, (w1 + w2 + w3 + w4 + w5) / 2.0 AS t_ham FROM w)""",
    body=" UNION ALL ".join(
        f"SELECT '{v}' AS voter, 'm{i}' AS member, round_even(w{i}, 9) AS weight, round_even(t_{v.lower()}, 9) "
        f"AS max_vote_index, CAST(0.3 AS DOUBLE) AS disagreement_threshold, {nf} AS n_features FROM t"
        for v, ms, nf in (("FDM", (1, 2, 3, 4), 4), ("HAM", (1, 2, 3, 4, 5), 6)) for i in ms))

ORACLE["disagreement_sweep"] = with_ctes(SCORED_CTES, """
g AS (SELECT round_even(std_fdm, 2) AS threshold, count(*) AS n,
             count_if(CASE WHEN mean_fdm >= 0.5 THEN 1 ELSE 0 END = y) AS ok FROM scored GROUP BY 1),
s AS (SELECT threshold,
        COALESCE(sum(n) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS conf_n,
        COALESCE(sum(ok) OVER (ORDER BY threshold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS conf_ok,
        sum(n) OVER () AS total FROM g),
m AS (SELECT threshold, conf_n,
        CAST(total - conf_n AS DOUBLE) / CAST(total AS DOUBLE) AS warn,
        CASE WHEN conf_n > 0 THEN CAST(conf_ok AS DOUBLE) / CAST(conf_n AS DOUBLE) ELSE 0.0 END AS acc FROM s)""",
    body="""
SELECT threshold, CAST(conf_n AS BIGINT) AS n_confident, round_even(warn, 9) AS warning_rate,
  round_even(acc, 9) AS confident_accuracy, round_even(acc - 0.05 * warn, 9) AS score FROM m""")


def _mi_sql() -> str:
    parts = []
    for f in FEATURES:
        parts.append(f"""SELECT '{f}' AS feature, y,
  CASE WHEN mx_{f} > mn_{f} THEN least(CAST(floor((x_{f} - mn_{f}) / (mx_{f} - mn_{f}) * 10.0) AS BIGINT), 9)
       ELSE 0 END AS bin FROM xs, mm""")
    mm = "mm AS (SELECT " + ", ".join(f"min(x_{f}) AS mn_{f}, max(x_{f}) AS mx_{f}" for f in FEATURES) + " FROM xs)"
    return with_ctes(SCORED_CTES.split("ps AS (")[0].rstrip().rstrip(","), mm,
                     "long_b AS (" + " UNION ALL ".join(parts) + ")", """
c AS (SELECT feature, bin, y, CAST(count(*) AS DOUBLE) AS n FROM long_b GROUP BY feature, bin, y),
c2 AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS total, sum(n) OVER (PARTITION BY feature, bin) AS nb,
              sum(n) OVER (PARTITION BY feature, y) AS ny FROM c)""", body="""
SELECT feature, round_even(sum(n / total * ln(n * total / (nb * ny))), 6) AS mutual_information
FROM c2 GROUP BY feature""")


ORACLE["mutual_information"] = _mi_sql()
ORACLE["stream_micro_batches_by_user"] = ORACLE["micro_batches_by_user"]
ORACLE["stream_micro_batches_hot_key"] = with_ctes(_batches("owner", 6 * 3600 * 1_000_000, 5), body="""
SELECT owner, event_id, burst, batch_num, pos_in_batch FROM nb""")
ORACLE["stream_open_batches"] = with_ctes(_batches("user_id", 6 * 3600 * 1_000_000, 5), body="""
SELECT user_id, event_id, value, batch_num, pos_in_batch, arrival_pos AS rows_seen,
  CASE WHEN count(*) OVER (PARTITION BY user_id, batch_num) = 5 THEN 'count'
       WHEN batch_num = max(batch_num) OVER (PARTITION BY user_id) THEN 'stop' ELSE 'idle' END AS reason FROM nb""")

ORACLE["disagreement_sweep_exact"] = with_ctes(SCORED_CTES, """
g AS (SELECT std_ham AS threshold, count(*) AS n, count_if(CASE WHEN mean_ham >= 0.5 THEN 1 ELSE 0 END = y) AS ok FROM scored GROUP BY 1),
t AS (SELECT g.threshold, CAST(count_if(s.std_ham < g.threshold) AS BIGINT) AS conf_n,
        count_if(s.std_ham < g.threshold AND CASE WHEN s.mean_ham >= 0.5 THEN 1 ELSE 0 END = s.y) AS conf_ok, count(*) AS total
      FROM g CROSS JOIN scored s GROUP BY 1),
m AS (SELECT threshold, conf_n, CAST(total - conf_n AS DOUBLE) / CAST(total AS DOUBLE) AS warn,
        CASE WHEN conf_n > 0 THEN CAST(conf_ok AS DOUBLE) / CAST(conf_n AS DOUBLE) ELSE 0.0 END AS acc FROM t)""", body="""
SELECT threshold, conf_n AS n_confident, round_even(warn, 9) AS warning_rate, round_even(acc, 9) AS confident_accuracy,
  round_even(acc - 0.05 * warn, 9) AS score FROM m""")
ORACLE["threshold_sweep_continuous"] = with_ctes(SCORED_CTES.replace("vd_ham >= 2.75", "vd_ham >= 2.75"), """
g AS (SELECT x_fwd_packets_length_total AS threshold, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM xs GROUP BY 1),
s AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
             sum(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp,
             sum(pos) OVER () AS P, sum(neg) OVER () AS N FROM g)""", body="""
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(P - tp AS BIGINT) AS fn,
  CAST(N - fp AS BIGINT) AS tn, CAST(tp + N - fp AS DOUBLE) / CAST(P + N AS DOUBLE) AS accuracy FROM s""")
ORACLE["encode_large_vocabulary"] = with_ctes(SCORED_CTES, """
o AS (SELECT *, concat('host-', split_part(flow_id, '-', 1)) AS origin FROM scored),
d AS (SELECT origin, CAST(row_number() OVER (ORDER BY origin) - 1 AS INT) AS code FROM (SELECT DISTINCT origin FROM o) t)""", body="""
SELECT o.flow_id, d.code, CASE WHEN v1 + v2 + 1.5 * v3 + v4 + CASE WHEN d.code % 2 = 0 THEN 1 ELSE 0 END >= 2.75 THEN 1 ELSE 0 END AS pred_binary
FROM o JOIN d ON o.origin = d.origin""")
ORACLE["windowed_rate_mode_hot"] = f"""
WITH e AS (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 10 = 0 THEN ts
                                 ELSE TIMESTAMP '2024-01-05 12:00:00' END AS ts FROM events),
h AS (SELECT date_trunc('hour', ts) AS window_start, count(*) AS rate FROM e WHERE ts IS NOT NULL GROUP BY 1)
SELECT e.event_id, h.window_start, h.rate, {_mode('h.rate', 10, 200)} AS mode FROM e LEFT JOIN h ON date_trunc('hour', e.ts) = h.window_start"""
ORACLE["chunked_score_metrics"] = "SELECT * FROM (" + ORACLE["mode_comparison"] + ") c WHERE mode = 'FDM'"


def _given_forest_sql() -> str:
    from flowscore.plans.catalog import GIVEN_FOREST

    def node(i: int) -> str:
        f, t, left, right, value = GIVEN_FOREST[i]
        return repr(value) if f is None else f"CASE WHEN x_{f} > {t!r} THEN {node(right)} ELSE {node(left)} END"
    return "SELECT flow_id, round_even((" + " + ".join(f"CAST({node(t)} AS DOUBLE)" for t in range(3)) + ") / 3.0, 9) AS p1 FROM xs"


ORACLE["forest_scores"] = with_ctes(SCORED_CTES, body=_given_forest_sql())
_STUMPS = """
cells AS (SELECT x_flow_iat_mean AS a, x_fwd_packet_length_max AS b, y, CAST(count(*) AS DOUBLE) AS n FROM xs GROUP BY ALL),
cuts AS (SELECT 1 AS fi, 'flow_iat_mean' AS feature, a AS cut FROM cells WHERE a > (SELECT min(a) FROM cells) GROUP BY a
         UNION ALL SELECT 2, 'fwd_packet_length_max', b FROM cells WHERE b > (SELECT min(b) FROM cells) GROUP BY b),
tries AS (SELECT fi, feature, cut, pol FROM cuts CROSS JOIN (SELECT unnest([1, -1]) AS pol) p)"""


def _round(k: int, weights: str) -> str:
    """One boosting round over the cells of ``weights``: the best stump, and the cells with their next weights."""
    hit = "CASE WHEN CASE t.fi WHEN 1 THEN c.a ELSE c.b END >= t.cut THEN (t.pol + 1) // 2 ELSE (1 - t.pol) // 2 END"
    return f"""
e{k} AS (SELECT t.fi, t.feature, t.cut, t.pol, sum(CASE WHEN {hit} <> c.y THEN c.n ELSE 0.0 END) / sum(c.n) AS err
         FROM tries t CROSS JOIN {weights} c GROUP BY ALL),
s{k} AS (SELECT *, ln((1.0 - err) / err) AS alpha FROM e{k} ORDER BY round(err, 12), fi, cut, pol DESC LIMIT 1),
w{k} AS (SELECT c.a, c.b, c.y, c.n * CASE WHEN {hit} <> c.y THEN exp(t.alpha) ELSE 1.0 END AS n FROM {weights} c CROSS JOIN s{k} t)"""


ORACLE["adaboost_stumps"] = with_ctes(SCORED_CTES, _STUMPS, _round(1, "cells"), _round(2, "w1"), body=" UNION ALL ".join(
    f"SELECT CAST({k} AS INT) AS round, feature, cut AS threshold, CAST(pol AS INT) AS polarity, round_even(alpha, 6) AS alpha FROM s{k}" for k in (1, 2)))
# isotonic regression by its min-max form: the value at a score is the largest, over starts at or before it, of the
# smallest mean from there to any end at or after it
ORACLE["isotonic_calibration"] = with_ctes(SCORED_CTES, """
g AS (SELECT mean_ham AS score, count(*) AS n, sum(y) AS ones, row_number() OVER (ORDER BY mean_ham) AS r FROM scored GROUP BY mean_ham),
c AS (SELECT *, sum(n) OVER (ORDER BY r) AS cn, sum(ones) OVER (ORDER BY r) AS cy FROM g),
m AS (SELECT a.r AS lo, b.r AS hi, CAST(b.cy - a.cy + a.ones AS DOUBLE) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS mean FROM c a JOIN c b ON a.r <= b.r),
f AS (SELECT c.r, c.score, s.lo, min(m.mean) AS least FROM c JOIN (SELECT DISTINCT lo FROM m) s ON s.lo <= c.r JOIN m ON m.lo = s.lo AND m.hi >= c.r
      GROUP BY ALL),
v AS (SELECT r, score, round_even(max(least), 9) AS value FROM f GROUP BY ALL)""", body="""
SELECT min(score) AS lo, max(score) AS hi, value FROM v GROUP BY value""")
ORACLE["feature_correlation"] = with_ctes(SCORED_CTES, body=" UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, round_even(corr(x_{a}, x_{b}), 6) AS correlation FROM xs"
    for i, a in enumerate(FEATURES) for b in FEATURES[i:]))
_FLOWS_BUILT = """
q AS (SELECT event_id, ts, epoch_us(ts) AS t, CAST(floor(value * 10) AS BIGINT) AS length,
    CASE WHEN event_id % 3 = 0 THEN '10.9.9.9' ELSE concat('10.0.0.', CAST(user_id % 200 AS VARCHAR)) END AS client,
    concat('192.168.0.', CAST(length(event_type) AS VARCHAR)) AS server,
    CASE WHEN event_id % 3 = 0 THEN 40000 ELSE 40000 + user_id END AS cport,
    CASE WHEN event_id % 2 = 0 THEN 6 ELSE 17 END AS protocol, event_id % 5 IN (0, 3) AS back FROM events),
k AS (SELECT *, CASE WHEN t - lag(t) OVER w >= 21600000000 OR lag(t) OVER w IS NULL THEN 1 ELSE 0 END AS cut
      FROM q WINDOW w AS (PARTITION BY client, server, cport, protocol ORDER BY t, event_id)),
b AS (SELECT *, sum(cut) OVER (PARTITION BY client, server, cport, protocol ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM k),
d AS (SELECT *, first_value(back) OVER (PARTITION BY client, server, cport, protocol, burst ORDER BY t, event_id) AS turned FROM b),
f AS (SELECT client, server, cport, protocol, burst, turned, min(t) / 1e6 AS start_time, max(t) / 1e6 AS end_time, count(*) AS packet_count,
        count_if(back = turned) AS fwd_packet_count, CAST(sum(length) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS avg_packet_size,
        CAST(max(CASE WHEN back = turned THEN length END) AS DOUBLE) AS fwd_packet_length_max,
        CAST(sum(CASE WHEN back = turned THEN length END) AS DOUBLE) AS fwd_packets_length_total FROM d GROUP BY ALL),
built AS (SELECT CASE WHEN turned THEN concat_ws('-', server, client, '443', CAST(cport AS VARCHAR), CAST(protocol AS VARCHAR))
                      ELSE concat_ws('-', client, server, CAST(cport AS VARCHAR), '443', CAST(protocol AS VARCHAR)) END AS flow_id,
            *, end_time - start_time AS duration,
            CASE WHEN packet_count > 1 THEN (end_time - start_time) / CAST(packet_count - 1 AS DOUBLE) ELSE 0.0 END AS flow_iat_mean FROM f)"""
ORACLE["flow_build"] = with_ctes(_FLOWS_BUILT, body="""
SELECT flow_id, start_time, end_time, round_even(duration, 3) AS duration, packet_count, CAST(fwd_packet_count AS BIGINT) AS fwd_packet_count,
  round_even(avg_packet_size, 6) AS avg_packet_size, round_even(flow_iat_mean, 3) AS flow_iat_mean, fwd_packet_length_max, fwd_packets_length_total
FROM built""")
ORACLE["flow_consistency"] = with_ctes(_FLOWS_BUILT, body="""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count_if(protocol = 17) AS BIGINT) AS bad_flow_id,
  CAST(count_if(packet_count % 4 = 3) AS BIGINT) AS bad_duration, CAST(count_if(packet_count > 1 AND packet_count % 4 = 3) AS BIGINT) AS bad_iat,
  CAST(count_if(packet_count < 2) AS BIGINT) AS iat_not_applicable FROM built""")
ORACLE["job_output"] = with_ctes(SCORED_CTES, body=f"""
SELECT flow_id, label, protocol, CAST(order_key % 40 AS BIGINT) AS job_id, b_ham AS pred_binary, {l3_text('l3_ham')} AS pred_3label, 'HAM' AS mode
FROM scored""")
ORACLE["csv_line_breaks"] = """
SELECT doc_id, lang, CAST(length(concat(' "', text, chr(10), ' ')) AS BIGINT) AS n_chars, md5(concat(' "', text, chr(10), ' ')) AS digest
FROM documents"""
ORACLE["archive_batch_index"] = """
SELECT CAST(l_orderkey AS BIGINT) AS batch, CAST(l_orderkey // 10000 AS BIGINT) AS bucket, count(*) AS n_rows,
  CAST(CASE WHEN l_orderkey % 2 = 1 OR l_orderkey % 10 = 0 THEN 1 ELSE 0 END AS BIGINT) AS commit FROM lineitem GROUP BY l_orderkey"""
ORACLE["archive_rows"] = with_ctes(_F, body="""
SELECT CASE WHEN l_orderkey % 3 = 0 THEN concat(flow_id, '*') ELSE flow_id END AS flow_id, l_orderkey AS batch_num
FROM (SELECT flow_id, CAST(split_part(flow_id, '-', 1) AS BIGINT) AS l_orderkey FROM flows) t WHERE l_orderkey BETWEEN 50 AND 12345""")
ORACLE["train_test_split"] = with_ctes(_F, body="""
SELECT flow_id, CASE WHEN CAST('0x' || substr(md5('42|' || flow_id), 1, 8) AS BIGINT) % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM flows""")
# every coalition of the five members as a bit mask; a member's value is its mean gain over all orders of joining
ORACLE["shapley_weights"] = with_ctes(SCORED_CTES, """
pat AS (SELECT v1, v2, v3, v4, v5, y, count(*) AS n FROM scored GROUP BY ALL),
masks AS (SELECT m, bit_count(m) AS k FROM (SELECT unnest(range(32)) AS m) r),
val AS (SELECT m, k, CASE WHEN k = 0 THEN 0.0 ELSE CAST(sum(CASE WHEN CASE WHEN 2 * ((m & 1) * v1 + ((m >> 1) & 1) * v2 + ((m >> 2) & 1) * v3
            + ((m >> 3) & 1) * v4 + ((m >> 4) & 1) * v5) >= k THEN 1 ELSE 0 END = y THEN n ELSE 0 END) AS DOUBLE) / CAST(sum(n) AS DOUBLE) END AS acc
        FROM masks CROSS JOIN pat GROUP BY m, k),
fact AS (SELECT unnest([0, 1, 2, 3, 4]) AS k, unnest([24.0, 6.0, 4.0, 6.0, 24.0]) / 120.0 AS w),
phi AS (SELECT i, sum(f.w * (b.acc - a.acc)) AS shapley FROM (SELECT unnest(range(5)) AS i) r JOIN val a ON (a.m >> i) & 1 = 0
        JOIN val b ON b.m = a.m + (1 << i) JOIN fact f ON f.k = a.k GROUP BY i)""", body="""
SELECT 'm' || CAST(i + 1 AS VARCHAR) AS member, round_even(shapley, 9) AS shapley,
  round_even(shapley * 5.0 / sum(shapley) OVER (), 9) AS weight FROM phi""")
