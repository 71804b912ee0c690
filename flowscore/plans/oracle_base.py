"""Shared SQL for the oracle: the flow fixture, the cleaning chain and the
fixture ensemble, written independently of the Spark code (plain SQL that
DuckDB runs over the driver's tables)."""

FLOWS_SQL = """
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR),
                      CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR)) AS flow_id,
  CASE l_linestatus WHEN 'F' THEN '6' ELSE '17' END AS protocol,
  CASE WHEN l_orderkey % 17 = 0 THEN NULL
       WHEN l_orderkey % 19 = 0 THEN CAST('Infinity' AS DOUBLE)
       WHEN l_orderkey % 23 = 0 THEN CAST('NaN' AS DOUBLE)
       ELSE l_extendedprice / l_quantity END AS avg_packet_size,
  l_discount AS flow_iat_mean, l_quantity AS fwd_packet_length_max,
  l_extendedprice AS fwd_packets_length_total,
  CASE WHEN l_linestatus = 'F' THEN l_partkey ELSE -1 END AS init_fwd_win_bytes,
  CASE WHEN l_linestatus = 'F' THEN l_suppkey ELSE -1 END AS init_bwd_win_bytes,
  CASE WHEN l_orderkey % 101 = 0 THEN NULL
       WHEN l_quantity >= 30 AND l_discount >= 0.05 THEN concat('DrDoS_', l_returnflag)
       ELSE 'Benign' END AS label,
  l_shipdate AS seen_at,
  l_orderkey AS order_key
FROM lineitem
"""

FLOW_COLS = ("flow_id, protocol, avg_packet_size, flow_iat_mean, fwd_packet_length_max, "
             "fwd_packets_length_total, init_fwd_win_bytes, init_bwd_win_bytes, label, seen_at")

FEATURES = ("avg_packet_size", "flow_iat_mean", "fwd_packet_length_max", "fwd_packets_length_total",
            "init_bwd_win_bytes", "init_fwd_win_bytes")


def clean(col: str) -> str:
    return (f"CASE WHEN {col} IS NULL OR isnan(CAST({col} AS DOUBLE)) OR isinf(CAST({col} AS DOUBLE)) "
            f"THEN CAST(0.0 AS DOUBLE) ELSE CAST({col} AS DOUBLE) END")


# Cleaned features x_<name>, y, member probabilities p1..p5, votes v1..v5,
# FDM/HAM vote data, means, stds, and verdicts b_*/l3_* per mode.
SCORED_CTES = f"""
flows AS ({FLOWS_SQL}),
xs AS (
  SELECT *, {", ".join(f"{clean(f)} AS x_{f}" for f in FEATURES)},
    CASE WHEN label IS NOT DISTINCT FROM 'Benign' THEN 0 ELSE 1 END AS y
  FROM flows),
ps AS (
  SELECT *,
    CAST(CASE WHEN x_fwd_packet_length_max > 29 THEN 0.85 ELSE 0.1 END AS DOUBLE) AS p1,
    CAST(CASE WHEN x_flow_iat_mean >= 0.05 THEN 0.75 ELSE 0.2 END AS DOUBLE) AS p2,
    CAST(CASE WHEN x_fwd_packet_length_max >= 30 AND x_flow_iat_mean >= 0.04 THEN 0.95 ELSE 0.05 END AS DOUBLE) AS p3,
    CAST(CASE WHEN x_fwd_packet_length_max >= 20 AND x_flow_iat_mean >= 0.03 THEN 0.7 ELSE 0.15 END AS DOUBLE) AS p4,
    CAST(CASE WHEN x_avg_packet_size > 2000 THEN 0.6 ELSE 0.3 END AS DOUBLE) AS p5
  FROM xs),
vs AS (
  SELECT *,
    CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END AS v1, CASE WHEN p2 > 0.5 THEN 1 ELSE 0 END AS v2,
    CASE WHEN p3 > 0.5 THEN 1 ELSE 0 END AS v3, CASE WHEN p4 > 0.5 THEN 1 ELSE 0 END AS v4,
    CASE WHEN p5 > 0.5 THEN 1 ELSE 0 END AS v5
  FROM ps),
ms AS (
  SELECT *,
    CAST(v1 AS DOUBLE) * 1.0 + CAST(v2 AS DOUBLE) * 1.0 + CAST(v3 AS DOUBLE) * 1.5 + CAST(v4 AS DOUBLE) * 1.0 AS vd_fdm,
    CAST(v1 AS DOUBLE) * 1.0 + CAST(v2 AS DOUBLE) * 1.0 + CAST(v3 AS DOUBLE) * 1.5 + CAST(v4 AS DOUBLE) * 1.0
      + CAST(v5 AS DOUBLE) * 1.0 AS vd_ham,
    CAST(v1 + v2 + v3 + v4 AS DOUBLE) AS hv_fdm,
    CAST(v1 + v2 + v3 + v4 + v5 AS DOUBLE) AS hv_ham,
    (p1 + p2 + p3 + p4) / 4.0 AS mean_fdm,
    (p1 + p2 + p3 + p4 + p5) / 5.0 AS mean_ham
  FROM vs),
ss AS (
  SELECT *,
    sqrt(((p1 - mean_fdm) * (p1 - mean_fdm) + (p2 - mean_fdm) * (p2 - mean_fdm)
        + (p3 - mean_fdm) * (p3 - mean_fdm) + (p4 - mean_fdm) * (p4 - mean_fdm)) / 4.0) AS std_fdm,
    sqrt(((p1 - mean_ham) * (p1 - mean_ham) + (p2 - mean_ham) * (p2 - mean_ham)
        + (p3 - mean_ham) * (p3 - mean_ham) + (p4 - mean_ham) * (p4 - mean_ham)
        + (p5 - mean_ham) * (p5 - mean_ham)) / 5.0) AS std_ham
  FROM ms),
scored AS (
  SELECT *,
    CASE WHEN vd_ham >= 2.75 THEN 1 ELSE 0 END AS b_ham,
    CASE WHEN vd_fdm >= 2.25 THEN 1 ELSE 0 END AS b_fdm,
    CASE WHEN v1 = 1 OR v2 = 1 OR v3 = 1 OR v4 = 1 THEN 1 ELSE 0 END AS b_dfdm,
    CASE WHEN std_ham >= 0.3 THEN 1 WHEN mean_ham >= 0.5 THEN 2 ELSE 0 END AS l3_ham,
    CASE WHEN std_fdm >= 0.3 THEN 1 WHEN mean_fdm >= 0.5 THEN 2 ELSE 0 END AS l3_fdm,
    CASE WHEN v1 = 1 OR v2 = 1 OR v3 = 1 OR v4 = 1 THEN 2 ELSE 0 END AS l3_dfdm
  FROM ss)
"""


def l3_text(col: str) -> str:
    return f"CASE {col} WHEN 0 THEN 'Benign' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Malicious' END"


# Long form: one row per (flow, mode) with b, l3, y.
LONG_CTE = """
long AS (
  SELECT flow_id, label, protocol, y, 'HAM' AS mode, b_ham AS b, l3_ham AS l3 FROM scored
  UNION ALL SELECT flow_id, label, protocol, y, 'FDM', b_fdm, l3_fdm FROM scored
  UNION ALL SELECT flow_id, label, protocol, y, 'DFDM', b_dfdm, l3_dfdm FROM scored)
"""

COUNTS_SELECT = """
    CAST(count(*) AS BIGINT) AS n,
    CAST(count_if(y = 1 AND b = 1) AS BIGINT) AS tp,
    CAST(count_if(y = 0 AND b = 0) AS BIGINT) AS tn,
    CAST(count_if(y = 0 AND b = 1) AS BIGINT) AS fp,
    CAST(count_if(y = 1 AND b = 0) AS BIGINT) AS fn,
    CAST(count_if(b = 1) AS BIGINT) AS n_pred_malicious,
    CAST(count_if(y = 0) AS BIGINT) AS n_y0,
    CAST(count_if(y = 1) AS BIGINT) AS n_y1,
    CAST(count_if(l3 = 0) AS BIGINT) AS n_benign,
    CAST(count_if(l3 = 1) AS BIGINT) AS n_warning,
    CAST(count_if(l3 = 2) AS BIGINT) AS n_malicious,
    CAST(count_if(y = 0 AND l3 = 0) AS BIGINT) AS ben_tp,
    CAST(count_if(y = 1 AND l3 = 0) AS BIGINT) AS ben_fp,
    CAST(count_if(y = 1 AND l3 = 2) AS BIGINT) AS mal_tp,
    CAST(count_if(y = 0 AND l3 = 1) AS BIGINT) AS warn_actually_benign,
    CAST(count_if(y = 1 AND l3 = 1) AS BIGINT) AS warn_actually_malicious,
    CAST(count_if(l3 <> 1) AS BIGINT) AS n_confident,
    CAST(count_if(l3 <> 1 AND y = CASE WHEN l3 = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_confident_correct
"""


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"


BINARY_METRICS_CTE = f"""
bm AS (
  SELECT *, {ratio('tp + tn', 'tp + tn + fp + fn')} AS accuracy,
    {ratio('tp', 'tp + fp')} AS precision, {ratio('tp', 'tp + fn')} AS sensitivity
  FROM counts),
bm2 AS (
  SELECT *, CASE WHEN precision + sensitivity <> 0 THEN 2.0 * precision * sensitivity / (precision + sensitivity)
                 ELSE CAST(0.0 AS DOUBLE) END AS f1
  FROM bm)
"""

THREE_METRICS_COLS = f"""
    {ratio('n_confident_correct', 'n_confident')} AS confident_accuracy,
    {ratio('n_warning', 'n')} AS warning_rate,
    CAST(ben_tp AS DOUBLE) / CAST(greatest(n_benign, 1) AS DOUBLE) AS benign_precision,
    CAST(ben_tp AS DOUBLE) / CAST(greatest(n_y0, 1) AS DOUBLE) AS benign_recall,
    CAST(mal_tp AS DOUBLE) / CAST(greatest(n_malicious, 1) AS DOUBLE) AS malicious_precision,
    CAST(mal_tp AS DOUBLE) / CAST(greatest(n_y1, 1) AS DOUBLE) AS malicious_recall,
    ben_fp AS attacks_let_through
"""


def rank(order) -> str:
    return "CASE mode " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(order)) + " END"


def with_ctes(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(c.strip().rstrip(",") for c in ctes) + "\n" + body
