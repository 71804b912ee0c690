"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each reads the driver's tables (or data Spark derives from them) over the
whole table. Oracle SQL for the same names lives in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscore.operators import metrics as MET
from flowscore.operators import scoring as S
from flowscore.sources import fixtures as FX
from flowscore.sources.bundle import fixture_bundle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def _bundle():
    return fixture_bundle()


def _verdicts(spark, sf_dir, **kw):
    return S.verdicts(FX.flows(spark, sf_dir), _bundle(), **kw)


@register("score_all_modes")
def score_all_modes(spark, sf_dir):
    return S.score_table(FX.flows(spark, sf_dir), _bundle(), flow_rate=None)


@register("mode_comparison")
def mode_comparison(spark, sf_dir):
    return MET.mode_comparison(_verdicts(spark, sf_dir))


# ------------------------------------------------------------------ 2.2 prep
from flowscore.functions import cleaning as C  # noqa: E402
from flowscore.functions import voting as V  # noqa: E402
from flowscore.operators import fitting as FIT  # noqa: E402
from flowscore.operators import prep as P  # noqa: E402

FEATURES = FX.FLOW_FEATURES


@register("trim_columns")
def trim_columns(spark, sf_dir):
    f = FX.flows(spark, sf_dir)
    padded = f.toDF(*[f"  {c} " if i % 2 == 0 else f"{c}\t" for i, c in enumerate(f.columns)])
    return P.trim_columns(padded)


@register("binarize_label")
def binarize_label(spark, sf_dir):
    f = FX.flows(spark, sf_dir)
    return f.select("flow_id", "label", C.binarize_label("label", "Benign").alias("y"))


@register("numeric_label")
def numeric_label(spark, sf_dir):
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return lab.select("doc_id", C.numeric_label("toxic").alias("y"))


@register("label_counts")
def label_counts(spark, sf_dir):
    f = FX.flows(spark, sf_dir)
    y = C.binarize_label("label", "Benign")
    return f.agg(F.count_if(y == 0).alias("benign"), F.count_if(y == 1).alias("malicious"))


@register("score_unlabeled")
def score_unlabeled(spark, sf_dir):
    return S.score_table(FX.flows(spark, sf_dir).drop("label"), _bundle(), flow_rate=None)


@register("clean_inf")
def clean_inf(spark, sf_dir):
    f = FX.flows(spark, sf_dir)
    return f.select("flow_id", *[C.clean_inf(c).alias(c) for c in FEATURES])


@register("required_columns")
def required_columns(spark, sf_dir):
    return P.required_report(FX.flows(spark, sf_dir), _bundle().all_features)


@register("encoder_fit")
def encoder_fit(spark, sf_dir):
    return FIT.encoder_table(FX.flows(spark, sf_dir), ["protocol", "label"])


@register("encode_categorical")
def encode_categorical(spark, sf_dir):
    f = FX.flows(spark, sf_dir)
    enc = FIT.fit_encoders(f, ["protocol", "label"])
    return f.select("flow_id", C.encode_categorical("protocol", enc["protocol"]).alias("protocol_code"),
                    C.encode_categorical("label", enc["label"]).alias("label_code"))


@register("project_features")
def project_features(spark, sf_dir):
    f = FX.flows(spark, sf_dir)
    return f.select("flow_id", *[C.to_feature(C.clean_inf(c)).alias(c) for c in FEATURES])


@register("fill_missing")
def fill_missing(spark, sf_dir):
    f = FX.flows(spark, sf_dir)
    return f.select("flow_id", *[C.fill_missing(C.to_feature(C.clean_inf(c))).alias(c) for c in FEATURES])


@register("encode_large_vocabulary")
def encode_large_vocabulary(spark, sf_dir):
    """A categorical feature with about a class per order, encoded by its stored dictionary, through whole-table scoring."""
    from flowscore.sources.bundle import Member, Voter
    f = FX.flows(spark, sf_dir).withColumn("origin", F.concat(F.lit("host-"), F.split_part("flow_id", F.lit("-"), F.lit(1))))
    b = _bundle()
    ham = Voter("HAM", b.ham.members, (*b.ham.features, "origin"), b.ham.weights, b.ham.max_vote_index, b.ham.disagreement_threshold)
    members = (*b.members[:4], Member("m5", expr="CASE WHEN origin % 2 = 0 THEN 0.6 ELSE 0.3 END"))
    known = FIT.fit_encoders(f, ["origin"])["origin"]
    scored = S.score_table(f, b.with_(members=members, ham=ham, encoders={"origin": known}), flow_rate=0)
    classes = spark.read.parquet(known) if isinstance(known, str) else spark.createDataFrame(
        [(c, i) for i, c in enumerate(known)], "value string, code int")
    return P.encode_with_table(scored, "origin", classes, "code").select("flow_id", "code", "pred_binary")


def _filled(spark, sf_dir):
    return fill_missing(spark, sf_dir)


@register("scaler_fit")
def scaler_fit(spark, sf_dir):
    t = FIT.scaler_table(_filled(spark, sf_dir), FEATURES)
    return t.select("feature", F.bround("mean", 6).alias("mean"), F.bround("scale", 6).alias("scale"))


def _scaled_bundle(spark, sf_dir):
    return _bundle().with_(scaler=FIT.fit_scaler(_filled(spark, sf_dir), FEATURES))


@register("standard_scale")
def standard_scale(spark, sf_dir):
    b = _scaled_bundle(spark, sf_dir)
    filled = _filled(spark, sf_dir)
    return filled.select("flow_id", *[F.bround(C.standard_scale(c, *b.scaler[c]), 6).alias(c) for c in FEATURES])


@register("preprocess")
def preprocess(spark, sf_dir):
    b = _scaled_bundle(spark, sf_dir)
    x = P.preprocess(FX.flows(spark, sf_dir), b, keep=["flow_id"])
    return x.select("flow_id", "y", *[F.bround(c, 6).alias(c) for c in FEATURES])


@register("prediction_output")
def prediction_output(spark, sf_dir):
    return S.score_table(FX.flows(spark, sf_dir), _bundle(), flow_rate=1000)


@register("feature_subsets")
def feature_subsets(spark, sf_dir):
    b = _bundle()
    x = P.preprocess(FX.flows(spark, sf_dir), b, keep=["flow_id"])
    return x.select("flow_id", *[F.col(c).alias(f"fdm_{c}") for c in b.fdm.features],
                    *[F.col(c).alias(f"ham_{c}") for c in b.ham.features])


@register("single_row_source")
def single_row_source(spark, sf_dir):
    """Every row through the literal-row path: required check, only the
    features kept, in sorted order."""
    b = _bundle()
    f = FX.flows(spark, sf_dir)
    P.check_required(f.columns, b.all_features)
    return f.select(*b.all_features)


# ------------------------------------------------------------ 2.3 routing
from flowscore.functions.routing import flow_to_mode as _f2m, select_mode as _sel  # noqa: E402


@register("flow_to_mode")
def flow_to_mode(spark, sf_dir):
    j = FX.job_requests(spark, sf_dir)
    return j.select("job_id", "flow_rate", _f2m("flow_rate").alias("mode"))


def _hourly(spark, sf_dir):
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ev.groupBy(F.window("ts", "1 hour").start.alias("window_start")).agg(F.count(F.lit(1)).alias("rate"))


@register("select_mode")
def select_mode(spark, sf_dir):
    h = _hourly(spark, sf_dir)
    return h.select("window_start", "rate", _sel("rate", 10, 20).alias("mode"))


@register("windowed_rate_mode")
def windowed_rate_mode(spark, sf_dir):
    """Measured rate -> mode: events per hour, joined back to every event.
    The hourly table is small; AQE broadcasts it once its runtime size is
    known to be under the threshold and otherwise keeps a shuffle join."""
    from flowscore.operators.routing import rate_mode
    ev = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rate_mode(ev, "ts", "1 hour", 10, 20).select("event_id", "window_start", "rate", "mode")


@register("windowed_rate_mode_hot")
def windowed_rate_mode_hot(spark, sf_dir):
    """Most events fall into one window, every eleventh has no time; its rate selects their mode."""
    from flowscore.operators.routing import rate_mode
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts")
    day = F.to_timestamp_ntz(F.lit("2024-01-05 12:00:00"))
    ev = ev.withColumn("ts", F.when(F.col("event_id") % 11 != 0, F.when(F.col("event_id") % 10 == 0, F.col("ts")).otherwise(day)))
    return rate_mode(ev, "ts", "1 hour", 10, 200).select("event_id", "window_start", "rate", "mode")


@register("all_modes_long")
def all_modes_long(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    long = S.long_verdicts(v, ["flow_id"], with_y=False)
    return long.select("flow_id", "mode", "pred_binary", V.label3_text(F.col("pred_3label")).alias("pred_3label"))


@register("routed_predict")
def routed_predict(spark, sf_dir):
    """Each row scored by the mode its own measured rate selects (flows per
    day of ``seen_at``, thresholds 20 / 30)."""
    from flowscore.operators.routing import rate_mode, routed
    f = rate_mode(FX.flows(spark, sf_dir), "seen_at", "1 day", 20, 30)
    v = S.verdicts(f, _bundle())
    r = routed(v, "mode")
    return r.select("flow_id", F.col("rate").alias("flow_rate"), "mode", "pred_binary",
                    V.label3_text(F.col("pred_3label")).alias("pred_3label"))


# ------------------------------------------------------------- 2.4 voting
def _members(b):
    return [m.name for m in b.members]


@register("member_votes")
def member_votes(spark, sf_dir):
    b = _bundle()
    v = _verdicts(spark, sf_dir)
    return v.select("flow_id", *[F.col(f"_v_{n}").alias(f"vote_{n}") for n in _members(b)])


@register("weighted_vote")
def weighted_vote(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    return v.select("flow_id", F.col("_vd_FDM").alias("vd_fdm"), F.col("_vd_HAM").alias("vd_ham"))


@register("hard_vote")
def hard_vote(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    return v.select("flow_id", F.col("_hv_FDM").alias("hv_fdm"), F.col("_hv_HAM").alias("hv_ham"))


@register("vote_threshold")
def vote_threshold(spark, sf_dir):
    b = _bundle()
    v = _verdicts(spark, sf_dir)
    return v.select("flow_id", F.col("_vd_HAM").alias("vd_ham"), F.lit(b.ham.threshold).alias("max_vote_index"),
                    V.vote_threshold(F.col("_vd_HAM"), b.ham.threshold).alias("pred_binary"))


def _one(mode):
    def fn(spark, sf_dir):
        v = _verdicts(spark, sf_dir, modes=(mode,))
        return v.select("flow_id", F.col(f"_bin_{mode}").alias("pred_binary"))
    return fn


register("fdm_binary")(_one("FDM"))
register("ham_binary")(_one("HAM"))
register("dfdm_binary")(_one("DFDM"))


@register("dfdm_early_exit")
def dfdm_early_exit(spark, sf_dir):
    from flowscore.operators.cascade import early_exit
    b = _bundle()
    x = P.preprocess(FX.flows(spark, sf_dir), b, keep=["flow_id"])
    return early_exit(x, b).select("flow_id", "pred_binary", "exit_member")


@register("dfdm_early_exit_fitted")
def dfdm_early_exit_fitted(spark, sf_dir):
    """Early exit with a saved forest between two expression members: the
    forest routes only the rows that the first member left."""
    import numpy as np

    from flowscore.operators.cascade import early_exit
    from flowscore.operators.extra_trees import Forest, save_forest
    from flowscore.session import scratch_path
    from flowscore.sources.bundle import Member, Voter
    two = Forest(["fwd_packet_length_max", "flow_iat_mean"], 2, np.array([0, 1, -1, -1, -1, -1]), np.array([29, 0.045, 0, 0, 0, 0]),
                 np.array([2, 4, -1, -1, -1, -1]), np.array([3, 5, -1, -1, -1, -1]), np.array([0, 0, 0.05, 0.9, 0.1, 0.7]))
    path = scratch_path(spark, "early-exit-forest")
    save_forest(spark, two, path)
    b = _bundle()
    members = (Member("high", expr="CASE WHEN fwd_packet_length_max > 45 THEN 0.9 ELSE 0.1 END"),
               Member("forest", forest_path=path), Member("size", expr="CASE WHEN avg_packet_size > 2000 THEN 0.6 ELSE 0.3 END"))
    b = b.with_(members=members, fdm=Voter("FDM", ("high", "forest", "size"), b.ham.features),
                ham=Voter("HAM", ("high", "forest", "size"), b.ham.features))
    x = P.preprocess(FX.flows(spark, sf_dir), b, keep=["flow_id"])
    return early_exit(x, b).select("flow_id", "pred_binary", "exit_member")


@register("cascade_survivors")
def cascade_survivors(spark, sf_dir):
    from flowscore.operators.cascade import cascade_table, early_exit
    b = _bundle()
    x = P.preprocess(FX.flows(spark, sf_dir), b, keep=["flow_id"])
    return cascade_table(early_exit(x, b), b)


@register("three_label")
def three_label(spark, sf_dir):
    v = _verdicts(spark, sf_dir, modes=("HAM", "FDM"))
    return v.select("flow_id",
                    F.col("_mean_FDM").alias("mean_p_fdm"), F.col("_std_FDM").alias("std_p_fdm"),
                    F.col("_l3_FDM").alias("label3_fdm"),
                    F.col("_mean_HAM").alias("mean_p_ham"), F.col("_std_HAM").alias("std_p_ham"),
                    F.col("_l3_HAM").alias("label3_ham"))


def _three(mode):
    def fn(spark, sf_dir):
        v = _verdicts(spark, sf_dir, modes=(mode,))
        return v.select("flow_id", V.label3_text(F.col(f"_l3_{mode}")).alias("pred_3label"))
    return fn


register("fdm_three_label")(_three("FDM"))
register("ham_three_label")(_three("HAM"))
register("dfdm_three_label")(_three("DFDM"))


@register("predict_one_mode")
def predict_one_mode(spark, sf_dir):
    s = S.score_table(FX.flows(spark, sf_dir), _bundle(), flow_rate=0)
    return s.select("flow_id", "pred_binary", "pred_3label", "mode")


@register("chunked_score")
def chunked_score(spark, sf_dir):
    return S.score_chunked(FX.flows(spark, sf_dir), _bundle(), flow_rate=5000)


@register("chunked_score_metrics")
def chunked_score_metrics(spark, sf_dir):
    """What the chunked mode reports of its one mode: binary and three-label metrics."""
    v = S.verdicts(FX.flows(spark, sf_dir), _bundle(), modes=[S.modes_for(1000, _bundle())[0]])
    return MET.mode_comparison(v, modes=["FDM"])


@register("union_chunks")
def union_chunks(spark, sf_dir):
    """Score hash-chunks of the table separately, then union them by name:
    the result equals whole-table scoring."""
    f = FX.flows(spark, sf_dir)
    chunk = F.pmod(F.xxhash64("flow_id"), F.lit(3))
    parts = [S.score_table(f.where(chunk == i), _bundle(), flow_rate=None) for i in range(3)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("single_row_verdict")
def single_row_verdict(spark, sf_dir):
    v = _verdicts(spark, sf_dir)
    long = S.long_verdicts(v, ["flow_id"])
    return long.select(
        "flow_id", "mode", V.binary_text(F.col("pred_binary")).alias("binary_text"),
        F.when(F.col("mode") != "DFDM", V.label3_text(F.col("pred_3label"))).alias("label3_text"),
        F.when(F.col("pred_binary") == F.col("y"), F.lit("correct")).otherwise(F.lit("wrong")).alias("correct"))


# ------------------------------------------------------------ 2.6 metrics
@register("member_accuracies")
def member_accuracies(spark, sf_dir):
    b = _bundle()
    v = _verdicts(spark, sf_dir)
    groups = [("FDM/DFDM", b.fdm.members), ("HAM", b.ham.members)]
    names = _members(b)
    agg = v.agg(F.count(F.lit(1)).alias("n"),
                *[F.count_if(F.col(f"_v_{n}") == F.col("_y")).alias(f"ok_{n}") for n in names])
    rows = F.array(*[F.struct(F.lit(g).alias("mode"), F.lit(n).alias("member"),
                              F.when(F.col("n") > 0, F.col(f"ok_{n}").cast("double") / F.col("n").cast("double"))
                              .otherwise(F.lit(0.0)).alias("accuracy"))
                     for g, ms in groups for n in ms])
    return agg.select(F.inline(rows))


def _counts(spark, sf_dir, modes=("HAM", "FDM", "DFDM"), **kw):
    return MET.mode_counts(_verdicts(spark, sf_dir), modes, **kw)


@register("confusion_counts")
def confusion_counts(spark, sf_dir):
    return _counts(spark, sf_dir, fields=["tp", "tn", "fp", "fn"]).select("mode", "tp", "tn", "fp", "fn")


@register("binary_metrics")
def binary_metrics(spark, sf_dir):
    return MET.with_binary_metrics(_counts(spark, sf_dir)).select(
        "mode", "total", "accuracy", "precision", "sensitivity", "f1")


@register("confident_accuracy")
def confident_accuracy(spark, sf_dir):
    c = MET.with_three_label_metrics(_counts(spark, sf_dir, ("HAM", "FDM")))
    return c.select("mode", "n_confident", "confident_accuracy")


@register("three_label_metrics")
def three_label_metrics(spark, sf_dir):
    c = MET.with_three_label_metrics(_counts(spark, sf_dir, ("HAM", "FDM")))
    return c.select("mode", "confident_accuracy", "warning_rate", "benign_precision", "benign_recall",
                    "malicious_precision", "malicious_recall", "attacks_let_through")


@register("attacks_let_through")
def attacks_let_through(spark, sf_dir):
    c = MET.with_three_label_metrics(_counts(spark, sf_dir, ("HAM", "FDM")))
    return c.select("mode", "attacks_let_through")


@register("warning_breakdown")
def warning_breakdown(spark, sf_dir):
    return _counts(spark, sf_dir, ("HAM", "FDM")).select(
        "mode", "n_benign", "n_warning", "n_malicious", "warn_actually_benign", "warn_actually_malicious")


@register("mode_summary")
def mode_summary(spark, sf_dir):
    return MET.mode_summary(_verdicts(spark, sf_dir))


@register("evaluate_all_modes")
def evaluate_all_modes(spark, sf_dir):
    return MET.evaluate_all_modes(_verdicts(spark, sf_dir))


@register("metrics_by_label")
def metrics_by_label(spark, sf_dir):
    c = _counts(spark, sf_dir, group_cols=["label"], fields=["n", "tp", "tn", "fp", "fn", "n_warning"])
    return c.select("label", "mode", "n", "tp", "tn", "fp", "fn", "n_warning")


@register("metrics_rollup")
def metrics_rollup(spark, sf_dir):
    c = _counts(spark, sf_dir, group_cols=["protocol", "label"], rollup=True, fields=["n", "tp", "tn", "fp", "fn"])
    return c.select("protocol", "label", "grouping_level", "mode", "n", "tp", "tn", "fp", "fn")


# ---------------------------------------------------------- 2.7 telemetry
from flowscore.operators import telemetry as TEL  # noqa: E402

PATH_PAIRS = [("binary", "click", "view"), ("3-label", "error", "purchase")]


@register("stage_rollup")
def stage_rollup(spark, sf_dir):
    return TEL.stage_rollup(FX.telemetry_samples(spark, sf_dir))


@register("stage_summary")
def stage_summary(spark, sf_dir):
    return TEL.stage_summary(TEL.stage_rollup(FX.telemetry_samples(spark, sf_dir)), exclude_prefix="sign")


def _r6(df, cols):
    return df.select(*[F.bround(c, 6).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("path_timing")
def path_timing(spark, sf_dir):
    t = TEL.path_timing(FX.path_runs(spark, sf_dir))
    return _r6(t, {"mean_sec", "std_sec", "per_sample_us", "per_sample_std_us", "total_ms", "throughput_sps"})


@register("path_delta")
def path_delta(spark, sf_dir):
    d = TEL.path_delta(TEL.path_timing(FX.path_runs(spark, sf_dir)), PATH_PAIRS)
    return _r6(d, {"first_us", "second_us", "delta_us", "delta_pct"})


@register("efficiency_table")
def efficiency_table(spark, sf_dir):
    return TEL.efficiency_table(TEL.path_timing(FX.path_runs(spark, sf_dir)),
                                TEL.stage_rollup(FX.telemetry_samples(spark, sf_dir)))


# --------------------------------------------------------------- 2.9 jobs
from flowscore.operators import jobs as JOB  # noqa: E402


def _manifest(spark, sf_dir):
    """Accepted requests with defaults applied: the job table."""
    r = JOB.with_defaults(JOB.validate(FX.job_requests(spark, sf_dir)))
    return r.where("accepted")


@register("job_validate")
def job_validate(spark, sf_dir):
    return JOB.validate(FX.job_requests(spark, sf_dir)).select("job_id", "accepted", "reject_reason")


@register("job_defaults")
def job_defaults(spark, sf_dir):
    return _manifest(spark, sf_dir).select("job_id", F.col("initial_status").alias("status"), "flow_rate",
                                           "label_col", "benign_label", "input_filename")


@register("job_score")
def job_score(spark, sf_dir):
    v = S.verdicts(FX.flows(spark, sf_dir, keep_order_key=True), _bundle())
    s = JOB.score_jobs(v, _manifest(spark, sf_dir), key="order_key")
    return s.select("job_id", "flow_id", "mode", "pred_binary",
                    V.label3_text(F.col("pred_3label")).alias("pred_3label"), "y")


@register("job_status_codes")
def job_status_codes(spark, sf_dir):
    req = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("request_id"))
    return JOB.status_codes(req, _manifest(spark, sf_dir))


@register("job_latest_status")
def job_latest_status(spark, sf_dir):
    return JOB.latest_status(JOB.lifecycle_events(_manifest(spark, sf_dir)))


@register("job_rollup")
def job_rollup(spark, sf_dir):
    return _manifest(spark, sf_dir).groupBy("status", "flow_rate").agg(F.count(F.lit(1)).alias("n_jobs"))


# ------------------------------------------------------- 2.8 batch forms
from flowscore.operators import arrival as ARR  # noqa: E402

IDLE_GAP_UNKEYED = 300.0  # 5 minutes between events of the whole stream
IDLE_GAP_BY_USER = 6 * 3600.0  # 6 hours between events of one user
BATCH_ROWS = 5


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type", "value")


def _event_times(spark, sf_dir, *keys):
    """The columns that numbering needs: rows are dealt out whole."""
    return _events(spark, sf_dir).select(*keys, "event_id", "ts")


@register("count_batches")
def count_batches(spark, sf_dir):
    n = ARR.number_arrivals(_event_times(spark, sf_dir), ["ts", "event_id"], batch_size=BATCH_ROWS)
    return n.select("event_id", "arrival_pos", "batch_num", "pos_in_batch")


@register("idle_batches")
def idle_batches(spark, sf_dir):
    n = ARR.number_arrivals(_event_times(spark, sf_dir), ["ts", "event_id"], gap_seconds=IDLE_GAP_UNKEYED, ts_col="ts")
    return n.select("event_id", "burst", "pos_in_burst")


def _micro(spark, sf_dir):
    return ARR.number_arrivals(_event_times(spark, sf_dir), ["ts", "event_id"], batch_size=BATCH_ROWS,
                               gap_seconds=IDLE_GAP_UNKEYED, ts_col="ts")


def _micro_by_user(spark, sf_dir):
    return ARR.number_arrivals(_event_times(spark, sf_dir, "user_id"), ["ts", "event_id"], key_cols=["user_id"],
                               batch_size=BATCH_ROWS, gap_seconds=IDLE_GAP_BY_USER, ts_col="ts")


@register("micro_batches")
def micro_batches(spark, sf_dir):
    return _micro(spark, sf_dir).select("event_id", "burst", "batch_num", "pos_in_batch")


@register("micro_batches_by_user")
def micro_batches_by_user(spark, sf_dir):
    return _micro_by_user(spark, sf_dir).select("user_id", "event_id", "burst", "batch_num", "pos_in_batch")


@register("micro_batches_by_type")
def micro_batches_by_type(spark, sf_dir):
    n = ARR.number_arrivals(_event_times(spark, sf_dir, "event_type"), ["ts", "event_id"], key_cols=["event_type"],
                            batch_size=BATCH_ROWS, gap_seconds=IDLE_GAP_UNKEYED, ts_col="ts")
    return n.select("event_type", "event_id", "burst", "batch_num", "pos_in_batch")


@register("micro_batches_by_day")
def micro_batches_by_day(spark, sf_dir):
    """A date key; every seventh event has none and they form a key of their own."""
    day = F.when(F.col("event_id") % 7 != 0, F.col("ts").cast("date")).alias("day")
    n = ARR.number_arrivals(_events(spark, sf_dir).select(day, "event_id", "ts"), ["ts", "event_id"], key_cols=["day"],
                            batch_size=BATCH_ROWS, gap_seconds=IDLE_GAP_UNKEYED, ts_col="ts")
    return n.select(F.col("day").cast("string").alias("day"), "event_id", "burst", "batch_num", "pos_in_batch")


@register("batch_progress")
def batch_progress(spark, sf_dir):
    return ARR.batch_progress(_micro(spark, sf_dir))


@register("leftover_rows")
def leftover_rows(spark, sf_dir):
    return ARR.leftover_rows(_micro_by_user(spark, sf_dir), BATCH_ROWS, ["user_id"]).select(
        "user_id", "event_id", "batch_num")


TAIL_ROWS_SEEN = 1000


@register("tail_new_rows")
def tail_new_rows(spark, sf_dir):
    """Rows not yet seen: arrival position (by seen_at, flow_id) beyond the
    ``rows_seen`` already dispatched."""
    f = FX.flows(spark, sf_dir).select("flow_id", "seen_at")
    n = ARR.number_arrivals(f, ["seen_at", "flow_id"])
    return n.where(F.col("arrival_pos") > TAIL_ROWS_SEEN).select("flow_id", "arrival_pos")


# ------------------------------------------------------ 2.1 sources/sinks
from flowscore.session import scratch_path  # noqa: E402
from flowscore.sources import csv_io as CSV  # noqa: E402

FLOW_TYPES = {
    "flow_id": "string", "protocol": "string", "avg_packet_size": "double", "flow_iat_mean": "double",
    "fwd_packet_length_max": "double", "fwd_packets_length_total": "double", "init_fwd_win_bytes": "bigint",
    "init_bwd_win_bytes": "bigint", "label": "string", "seen_at": "timestamp_ntz",
}


@register("scan_flows")
def scan_flows(spark, sf_dir):
    """The flow table written as CSV (padded header names) and scanned back."""
    path = scratch_path(spark, "flows-csv")
    f = FX.flows(spark, sf_dir)
    CSV.write_csv(f.toDF(*[f" {c} " for c in f.columns]), path)
    return CSV.read_flows_csv(spark, path, FLOW_TYPES)


@register("sink_roundtrip")
def sink_roundtrip(spark, sf_dir):
    path = scratch_path(spark, "predictions-csv")
    CSV.write_csv(S.score_table(FX.flows(spark, sf_dir), _bundle(), flow_rate=None), path)
    types = dict(FLOW_TYPES)
    for m in ("HAM", "FDM", "DFDM"):
        types[f"pred_binary_{m}"] = "int"
    return CSV.read_flows_csv(spark, path, types)


@register("archive_by_batch")
def archive_by_batch(spark, sf_dir):
    """Predictions archived per arrival batch (4096 rows in (seen_at, flow_id)
    order), read back with the batch number from the folder names."""
    from flowscore.constants import CHUNK_ROWS
    f = ARR.number_arrivals(FX.flows(spark, sf_dir), ["seen_at", "flow_id"], batch_size=CHUNK_ROWS)
    scored = S.verdicts(f.drop("arrival_pos", "burst", "pos_in_burst", "pos_in_batch"), _bundle())
    out = scored.select("flow_id", "batch_num", *S.prediction_columns(("HAM", "FDM", "DFDM")))
    path = scratch_path(spark, "archive")
    CSV.write_by_batch(out, path, "batch_num", fmt="parquet")
    return spark.read.parquet(path).select("flow_id", F.col("batch_num").cast("bigint").alias("batch_num"),
                                           *[c for c in out.columns if c not in ("flow_id", "batch_num")])


# ------------------------------------------------------------ 2.8 streams
from flowscore.streaming import stream as STR  # noqa: E402


def _landed_flows(spark, sf_dir):
    f = FX.flows(spark, sf_dir)
    landing = scratch_path(spark, "landing-flows")
    STR.land_in_time_order(f, "seen_at", landing, rows_per_file=15_000)
    return f.schema, landing


EVENT_SLICES = 40  # landed files of 2,500 events up to here, larger ones beyond: a producer's files grow with its traffic


def _landed_events(spark, sf_dir, ev=None):
    ev = _events(spark, sf_dir) if ev is None else ev
    landing = scratch_path(spark, "landing-events")
    STR.land_in_time_order(ev, "ts", landing, rows_per_file=2_500, slices=EVENT_SLICES)
    return ev.schema, landing


@register("stream_score")
def stream_score(spark, sf_dir):
    schema, landing = _landed_flows(spark, sf_dir)
    out = scratch_path(spark, "stream-score-out")
    STR.stream_score(spark, landing, schema, _bundle(), out, scratch_path(spark, "stream-score-ckpt"))
    return spark.read.parquet(out).drop("batch_id")


@register("stream_mode_counts")
def stream_mode_counts(spark, sf_dir):
    schema, landing = _landed_flows(spark, sf_dir)
    return STR.stream_mode_counts(spark, landing, schema, _bundle(), scratch_path(spark, "stream-counts-out"),
                                  scratch_path(spark, "stream-counts-ckpt"))


@register("stream_rate_mode")
def stream_rate_mode(spark, sf_dir):
    schema, landing = _landed_events(spark, sf_dir)
    return STR.stream_rate_mode(spark, landing, schema, "ts", "1 hour", 10, 20,
                                scratch_path(spark, "stream-rate-out"), scratch_path(spark, "stream-rate-ckpt"))


@register("stream_micro_batches")
def stream_micro_batches(spark, sf_dir):
    schema, landing = _landed_events(spark, sf_dir)
    n = STR.stream_micro_batches(spark, landing, schema, ["ts", "event_id"], "ts", BATCH_ROWS, IDLE_GAP_UNKEYED,
                                 scratch_path(spark, "stream-batches-out"), scratch_path(spark, "stream-batches-ckpt"),
                                 files_per_trigger=2)
    return n.select("event_id", "burst", "batch_num", "pos_in_batch")


# ------------------------------------------------------------ 2.5 members
from flowscore.operators import members as MEM  # noqa: E402


def _train_frame(spark, sf_dir):
    x = P.preprocess(FX.flows(spark, sf_dir), _bundle(), keep=["flow_id"])
    return x.withColumn("split", MEM.split_column("flow_id"))


def _member_output(x, prob):
    return x.select("flow_id", "split", F.bround(prob, 6).alias("p1"),
                    V.member_vote(prob).alias("vote"), "y")


@register("train_test_split")
def train_test_split(spark, sf_dir):
    return _train_frame(spark, sf_dir).select("flow_id", "split")


@register("member_random_forest")
def member_random_forest(spark, sf_dir):
    x = _train_frame(spark, sf_dir)
    model = MEM.fit_random_forest(x.where("split = 'train'"), FEATURES, num_trees=100, max_depth=8)
    s = MEM.ml_probability(model, x, "prob")
    return _member_output(s, F.col("prob"))


@register("member_bagging")
def member_bagging(spark, sf_dir):
    x = _train_frame(spark, sf_dir)
    model = MEM.fit_bagging(x.where("split = 'train'"), FEATURES, num_trees=100, max_depth=8)
    s = MEM.ml_probability(model, x, "prob")
    return _member_output(s, F.col("prob"))


@register("member_gbt")
def member_gbt(spark, sf_dir):
    x = _train_frame(spark, sf_dir)
    model = MEM.fit_gbt(x.where("split = 'train'"), FEATURES, max_iter=100, max_depth=3)
    s = MEM.ml_probability(model, x, "prob")
    return _member_output(s, F.col("prob"))


@register("member_adaboost")
def member_adaboost(spark, sf_dir):
    x = _train_frame(spark, sf_dir)
    stumps = MEM.fit_adaboost(x.where("split = 'train'"), FEATURES, rounds=100)
    return _member_output(x, F.expr(MEM.adaboost_sql(stumps)).cast("double"))


@register("class_weights")
def class_weights(spark, sf_dir):
    x = P.preprocess(FX.flows(spark, sf_dir), _bundle(), keep=[])
    return FIT.class_weights(x, "y").withColumnRenamed("class", "y")


@register("threshold_sweep")
def threshold_sweep(spark, sf_dir):
    from flowscore.operators.sweep import threshold_sweep as sweep
    return sweep(_verdicts(spark, sf_dir), "_vd_HAM")


@register("member_extra_trees")
def member_extra_trees(spark, sf_dir):
    from flowscore.operators.extra_trees import fit_extra_trees, forest_probability
    x = _train_frame(spark, sf_dir)
    forest = fit_extra_trees(x.where("split = 'train'"), FEATURES, n_estimators=100, max_depth=8)
    return _member_output(x, forest_probability(forest))


# ------------------------------------------------- fitted bundle (S7/S8)
from flowscore.operators import ensemble as ENS  # noqa: E402


@register("bundle_summary")
def bundle_summary(spark, sf_dir):
    """The fixture voters re-weighted by each member's accuracy on the table."""
    b = ENS.weighted_by_accuracy(_bundle(), FX.flows(spark, sf_dir))
    s = ENS.summary(b, spark)
    return s.select("voter", "member", F.bround("weight", 9).alias("weight"),
                    F.bround("max_vote_index", 9).alias("max_vote_index"), "disagreement_threshold", "n_features")


@register("fitted_ensemble")
def fitted_ensemble(spark, sf_dir):
    """Fit both voters on the training split (own members and features, class
    weights), save and reload the bundle, score the whole table in all modes
    and compare them. Nine fits, uncalibrated to end within minutes: a member has
    10 estimators of 6 levels here, by default 100 without a depth limit."""
    from flowscore.sources.bundle import load_bundle, save_bundle
    x = _train_frame(spark, sf_dir)
    d = scratch_path(spark, "bundle")
    fixture = _bundle()
    b = ENS.fit_bundle(x.where("split = 'train'"), fixture.fdm.features, d, estimators=10, ham_features=fixture.ham.features, max_depth=6,
                       calibrate=None, key="flow_id")
    b = b.with_(label_col="label")
    b = ENS.weighted_by_accuracy(b, FX.flows(spark, sf_dir).where(MEM.split_column("flow_id") == "train"))
    save_bundle(b, d, spark=spark)
    loaded = load_bundle(d, spark=spark)
    return MET.mode_comparison(S.verdicts(FX.flows(spark, sf_dir), loaded))


#: Nodes (feature, threshold, left, right, value) of three trees of uneven depth, roots first: a given forest to score.
GIVEN_FOREST = (
    ("fwd_packet_length_max", 29.5, 3, 4, 0.0), ("flow_iat_mean", 0.045, 5, 6, 0.0), (None, 0.0, -1, -1, 0.25),
    (None, 0.0, -1, -1, 0.125), ("flow_iat_mean", 0.045, 7, 8, 0.0), ("avg_packet_size", 1500.0, 9, 10, 0.0), (None, 0.0, -1, -1, 0.75),
    (None, 0.0, -1, -1, 0.0625), ("avg_packet_size", 1200.0, 11, 12, 0.0), (None, 0.0, -1, -1, 0.03125), (None, 0.0, -1, -1, 0.5),
    (None, 0.0, -1, -1, 0.875), (None, 0.0, -1, -1, 1.0))


@register("forest_scores")
def forest_scores(spark, sf_dir):
    """Every flow through a given node table."""
    import numpy as np
    from flowscore.operators.extra_trees import Forest, forest_probability
    names = list(FEATURES)
    cols = list(zip(*[(names.index(f) if f else -1, t, a, b, v) for f, t, a, b, v in GIVEN_FOREST]))
    forest = Forest(names, 3, *[np.array(c, dtype=t) for c, t in zip(cols, (np.int32, np.float64, np.int32, np.int32, np.float64))])
    x = P.preprocess(FX.flows(spark, sf_dir), _bundle(), keep=["flow_id"])
    return x.select("flow_id", F.bround(forest_probability(forest), 9).alias("p1"))


@register("adaboost_stumps")
def adaboost_stumps(spark, sf_dir):
    """The first two boosting rounds on features whose every value is a cut."""
    x = P.preprocess(FX.flows(spark, sf_dir), _bundle(), keep=[])
    stumps = MEM.fit_adaboost(x, ["flow_iat_mean", "fwd_packet_length_max"], rounds=2)
    rows = [(i + 1, s["feature"], float(s["threshold"]), s["polarity"], round(s["alpha"], 6)) for i, s in enumerate(stumps)]
    return spark.createDataFrame(rows, "round int, feature string, threshold double, polarity int, alpha double")


@register("isotonic_calibration")
def isotonic_calibration(spark, sf_dir):
    """Blocks of the isotonic regression of y on the mean probability of HAM's members."""
    v = _verdicts(spark, sf_dir, modes=("HAM",)).select(F.col("_mean_HAM").alias("score"), F.col("_y").alias("y"))
    rows = [(float(lo), float(hi), round(value, 9)) for lo, hi, value in MEM.isotonic_blocks(v, "score", "y", num_partitions=4)]
    return spark.createDataFrame(rows, "lo double, hi double, value double")


# ---------------------------------------------- 2.13 diagnostics and fits
from flowscore.operators import selection as SEL  # noqa: E402
from flowscore.operators import sweep as SW  # noqa: E402


@register("disagreement_sweep")
def disagreement_sweep(spark, sf_dir):
    return SW.disagreement_sweep(_verdicts(spark, sf_dir, modes=("HAM", "FDM")), "FDM", decimals=2)


@register("disagreement_sweep_exact")
def disagreement_sweep_exact(spark, sf_dir):
    """Every distinct std of the members is a candidate: a row warns when std >= t."""
    return SW.disagreement_sweep(_verdicts(spark, sf_dir, modes=("HAM", "FDM")), "HAM")


@register("threshold_sweep_continuous")
def threshold_sweep_continuous(spark, sf_dir):
    """A score with about as many thresholds as rows."""
    x = P.preprocess(FX.flows(spark, sf_dir), _bundle(), keep=[])
    return SW.threshold_sweep(x, "fwd_packets_length_total", "y")


@register("mutual_information")
def mutual_information(spark, sf_dir):
    x = P.preprocess(FX.flows(spark, sf_dir), _bundle(), keep=[])
    return SEL.mutual_information(x, FEATURES, "y")


@register("feature_correlation")
def feature_correlation(spark, sf_dir):
    x = P.preprocess(FX.flows(spark, sf_dir), _bundle(), keep=[])
    c = SEL.correlation_matrix(x, FEATURES)
    return c.select("feature_a", "feature_b", F.bround("correlation", 6).alias("correlation"))


@register("feature_clusters")
def feature_clusters(spark, sf_dir):
    x = P.preprocess(FX.flows(spark, sf_dir), _bundle(), keep=[])
    return SEL.feature_clusters(x, FEATURES, distance=0.75)


PACKETS_SQL = [
    "event_id AS packet_id", "ts", "CAST(floor(value * 10) AS BIGINT) AS length",
    "CASE WHEN event_id % 3 = 0 THEN '10.9.9.9' ELSE concat('10.0.0.', CAST(user_id % 200 AS STRING)) END AS client",
    "concat('192.168.0.', CAST(length(event_type) AS STRING)) AS server", "CAST(CASE WHEN event_id % 3 = 0 THEN 40000 ELSE 40000 + user_id END AS INT) AS cport",
    "CASE WHEN event_id % 2 = 0 THEN 6 ELSE 17 END AS protocol", "event_id % 5 IN (0, 3) AS back"]


def _packets(spark, sf_dir):
    """Packets from events: a third belong to one client, and two in five run from server to client."""
    p = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*PACKETS_SQL)
    return p.selectExpr("packet_id", "ts", "length", "protocol", "if(back, server, client) AS src_ip", "if(back, client, server) AS dst_ip",
                        "if(back, 443, cport) AS src_port", "if(back, cport, 443) AS dst_port")


@register("flow_build")
def flow_build(spark, sf_dir):
    """Bidirectional flows of the packets, cut at 6 idle hours."""
    from flowscore.operators.flow_build import build_flows
    f = build_flows(_packets(spark, sf_dir), 6 * 3600.0)
    return f.select("flow_id", "start_time", "end_time", F.bround("duration", 3).alias("duration"), "packet_count", "fwd_packet_count",
                    F.bround("avg_packet_size", 6).alias("avg_packet_size"), F.bround("flow_iat_mean", 3).alias("flow_iat_mean"),
                    "fwd_packet_length_max", "fwd_packets_length_total")


@register("flow_consistency")
def flow_consistency(spark, sf_dir):
    """The producer's invariants over built flows, some of them spoilt."""
    from flowscore.operators.consistency import consistency_report, flow_checks
    from flowscore.operators.flow_build import build_flows
    f = build_flows(_packets(spark, sf_dir), 6 * 3600.0)
    spoilt = F.col("packet_count") % 4 == 3
    f = f.withColumn("duration", F.when(spoilt, F.col("duration") + 1).otherwise(F.col("duration"))).withColumn(
        "flow_id", F.when(F.col("protocol") == 17, F.concat("flow_id", F.lit("x"))).otherwise(F.col("flow_id")))
    return consistency_report(flow_checks(f, cols={"iat": "flow_iat_mean"}))


@register("job_output")
def job_output(spark, sf_dir):
    """Per-job predictions, written as one folder per job and read back."""
    from flowscore.operators import jobs as JOBS
    f = FX.flows(spark, sf_dir, keep_order_key=True)
    v = S.verdicts(f, _bundle())
    out = v.select("flow_id", "label", "protocol", F.pmod("order_key", F.lit(40)).alias("job_id"), *S.prediction_columns(("HAM",)))
    path = scratch_path(spark, "job-output")
    JOBS.write_job_outputs(out, path)
    return CSV.read_flows_csv(spark, path, {"pred_binary": "int", "job_id": "bigint"}).select(*out.columns)


@register("csv_line_breaks")
def csv_line_breaks(spark, sf_dir):
    """Texts with quotes, blanks at the ends and line breaks through the CSV sink and scan."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", F.concat(F.lit(' "'), "text", F.lit("\n ")).alias("text"))
    path = scratch_path(spark, "texts-csv")
    CSV.write_csv(docs, path)
    back = CSV.read_flows_csv(spark, path, {"doc_id": "bigint"})
    return back.select("doc_id", "lang", F.char_length("text").cast("bigint").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


@register("archive_batch_index")
def archive_batch_index(spark, sf_dir):
    """One batch per order over two commits, the second one replayed: index of the archive."""
    from flowscore.sources import archive as ARC
    f = FX.flows(spark, sf_dir, keep_order_key=True).select("flow_id", F.col("order_key").alias("batch_num"))
    path = scratch_path(spark, "bucketed-archive")
    ARC.write_batches(f.where("batch_num % 2 = 0"), path, 0)
    for _ in range(2):
        ARC.write_batches(f.where("batch_num % 2 = 1 or batch_num % 10 = 0"), path, 1)
    return ARC.batch_index(spark, path)


@register("archive_rows")
def archive_rows(spark, sf_dir):
    """Rows of a range of batches, each from its latest commit."""
    from flowscore.sources import archive as ARC
    f = FX.flows(spark, sf_dir, keep_order_key=True).select("flow_id", F.col("order_key").alias("batch_num"))
    path = scratch_path(spark, "bucketed-archive")
    ARC.write_batches(f, path, 0)
    ARC.write_batches(f.where("batch_num % 3 = 0").withColumn("flow_id", F.concat("flow_id", F.lit("*"))), path, 1)
    return ARC.read_batches(spark, path, 50, 12_345)


@register("shapley_weights")
def shapley_weights(spark, sf_dir):
    b = _bundle()
    s = SEL.shapley_weights(_verdicts(spark, sf_dir), list(b.ham.members))
    return s.select("member", F.bround("shapley", 9).alias("shapley"), F.bround("weight", 9).alias("weight"))


@register("calibrated_members")
def calibrated_members(spark, sf_dir):
    """Platt-calibrate every fixture member on the training split, then the
    three-label comparison with the calibrated probabilities."""
    b = _bundle()
    x = _train_frame(spark, sf_dir)
    members = []
    curves = MEM.platt_calibrations(x.where("split = 'train'"), [m.expr for m in b.members])
    for m, (a, c) in zip(b.members, curves):
        members.append(m.__class__(m.name, expr=m.expr, calibrated_expr=MEM.calibrated_sql(m.expr, a, c)))
    cal = b.with_(members=tuple(members))
    return MET.mode_comparison(S.verdicts(FX.flows(spark, sf_dir), cal))


@register("stream_micro_batches_by_user")
def stream_micro_batches_by_user(spark, sf_dir):
    schema, landing = _landed_events(spark, sf_dir)
    n = STR.stream_micro_batches_keyed(spark, landing, schema, "user_id", ["ts", "event_id"], "ts", BATCH_ROWS,
                                       IDLE_GAP_BY_USER, scratch_path(spark, "stream-user-out"),
                                       scratch_path(spark, "stream-user-ckpt"), files_per_trigger=2)
    return n.select("user_id", "event_id", "burst", "batch_num", "pos_in_batch")


HOT_USER = -1  # a third of all events, and the null key another seventh


@register("stream_micro_batches_hot_key")
def stream_micro_batches_hot_key(spark, sf_dir):
    """Keyed stream numbering where one key holds a third of the rows and the null key a seventh."""
    owner = F.when(F.col("event_id") % 3 == 0, HOT_USER).when(F.col("event_id") % 7 != 0, F.col("user_id")).cast("long")
    ev = _events(spark, sf_dir).select("event_id", "ts", owner.alias("owner"))
    schema, landing = _landed_events(spark, sf_dir, ev)
    n = STR.stream_micro_batches_keyed(spark, landing, schema, "owner", ["ts", "event_id"], "ts", BATCH_ROWS, IDLE_GAP_BY_USER,
                                       scratch_path(spark, "stream-hot-out"), scratch_path(spark, "stream-hot-ckpt"), files_per_trigger=2)
    return n.select("owner", "event_id", "burst", "batch_num", "pos_in_batch")


@register("stream_open_batches")
def stream_open_batches(spark, sf_dir):
    """Batches as a live stream closes them, with the reason; those open at its stop are flushed."""
    from flowscore.streaming import idle as IDLE
    schema, landing = _landed_events(spark, sf_dir)
    out, checkpoint = scratch_path(spark, "stream-open-out"), scratch_path(spark, "stream-open-ckpt")
    IDLE.stream_open_batches(spark, landing, schema, ["user_id"], ["ts", "event_id"], "ts", BATCH_ROWS, IDLE_GAP_BY_USER, out, checkpoint,
                             files_per_trigger=2)
    both = IDLE.read_batches(spark, out, schema).unionByName(IDLE.flush_open(spark, checkpoint, schema, BATCH_ROWS))
    return both.select("user_id", "event_id", "value", "batch_num", "pos_in_batch", "rows_seen", "reason")
