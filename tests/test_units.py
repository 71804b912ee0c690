"""Edge cases on tiny inline rows."""

import math

import pytest
from pyspark.sql import functions as F

from flowscore.functions import cleaning as C
from flowscore.functions import voting as V
from flowscore.functions.routing import flow_to_mode, mode_for_rate, select_mode
from flowscore.operators import metrics as MET
from flowscore.operators import prep as P
from flowscore.operators import scoring as S
from flowscore.sources import bundle as B
from flowscore.sources import csv_io as CSV


def test_binarize_label_exact_and_null(spark):
    df = spark.createDataFrame([("Benign",), (" Benign",), ("benign",), (None,), ("DrDoS_DNS",)], "label string")
    got = [r[0] for r in df.select(C.binarize_label("label")).collect()]
    assert got == [0, 1, 1, 1, 1]


def test_numeric_label_truncates_and_null_raises(spark):
    df = spark.createDataFrame([(1.9,), (0.2,), (2.0,)], "y double")
    assert [r[0] for r in df.select(C.numeric_label("y")).collect()] == [1, 0, 2]
    bad = spark.createDataFrame([(1.0,), (None,)], "y double")
    with pytest.raises(Exception):
        bad.select(C.numeric_label("y")).collect()


def test_cleaning_order(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (-1.0,), (3.5,)],
                               "x double")
    got = [r[0] for r in df.select(C.fill_missing(C.to_feature(C.clean_inf("x")))).collect()]
    assert got == [0.0, 0.0, 0.0, 0.0, -1.0, 3.5]
    scaled = df.select(C.standard_scale(C.fill_missing(C.to_feature(C.clean_inf("x"))), 2.0, 4.0)).collect()
    assert scaled[3][0] == -0.5  # missing -> 0 before scaling -> (0 - mean) / scale


def test_encode_unseen_and_null(spark):
    df = spark.createDataFrame([("6",), ("17",), ("99",), (None,)], "p string")
    got = [r[0] for r in df.select(C.encode_categorical("p", ["6", "17"])).collect()]
    assert got == [1, 0, 0, 0]
    got = [r[0] for r in df.select(C.encode_categorical("p", ["6", "17", "nan"])).collect()]
    assert got == [1, 0, 0, 2]


def test_non_numeric_feature_text_raises(spark):
    df = spark.createDataFrame([("abc",)], "x string")
    with pytest.raises(Exception):
        df.select(C.to_feature("x")).collect()


def test_vote_ties_and_inclusive_thresholds(spark):
    df = spark.createDataFrame([(0.5, 0.5, 2.25), (0.51, 0.49, 2.24)], "p double, m double, vd double")
    r = df.select(V.member_vote(F.col("p")).alias("v"), V.vote_threshold(F.col("vd"), 2.25).alias("b"),
                  V.three_label(F.col("m"), F.lit(0.0), 0.3).alias("l3")).collect()
    assert (r[0]["v"], r[0]["b"], r[0]["l3"]) == (0, 1, 2)  # p = 0.5 is a benign vote, mean 0.5 is Malicious
    assert (r[1]["v"], r[1]["b"], r[1]["l3"]) == (1, 0, 0)
    w = spark.range(1).select(V.three_label(F.lit(0.9), F.lit(0.3), 0.3).alias("l3")).first()["l3"]
    assert w == 1  # std exactly at the threshold warns, checked before the mean


def test_population_std(spark):
    ps = [F.lit(0.85), F.lit(0.75), F.lit(0.95), F.lit(0.7)]
    got = spark.range(1).select(V.std_pop_of(ps)).first()[0]
    vals = [0.85, 0.75, 0.95, 0.7]
    m = sum(vals) / 4
    assert math.isclose(got, math.sqrt(sum((v - m) ** 2 for v in vals) / 4))


@pytest.mark.parametrize("rate,mode", [(None, None), (-5, "HAM"), (0, "HAM"), (999, "HAM"), (1000, "FDM"),
                                       (4999, "FDM"), (5000, "DFDM"), (10 ** 9, "DFDM")])
def test_flow_to_mode_bounds(spark, rate, mode):
    df = spark.createDataFrame([(rate,)], "r long")
    assert df.select(flow_to_mode("r")).first()[0] == mode
    assert mode_for_rate(rate) == mode


def test_select_mode_custom_thresholds(spark):
    df = spark.createDataFrame([(9,), (10,), (19,), (20,)], "r long")
    assert [r[0] for r in df.select(select_mode("r", 10, 20)).collect()] == ["HAM", "FDM", "FDM", "DFDM"]


def test_trim_columns_and_collisions(spark):
    df = spark.createDataFrame([(1, 2)], "` a ` int, `b\t` int")
    assert P.trim_columns(df).columns == ["a", "b"]
    with pytest.raises(ValueError):
        P.trim_columns(spark.createDataFrame([(1, 2)], "`a ` int, ` a` int"))


def test_required_columns_error_names_missing():
    with pytest.raises(ValueError, match="init_fwd_win_bytes"):
        P.check_required(["avg_packet_size"], ["avg_packet_size", "init_fwd_win_bytes"])


def test_single_row_frame(spark):
    b = B.fixture_bundle()
    row = {f: 1.0 for f in b.all_features}
    df = CSV.single_row_frame(spark, row, b.all_features)
    assert df.columns == list(b.all_features) and df.count() == 1
    row.pop("flow_iat_mean")
    with pytest.raises(ValueError, match="flow_iat_mean"):
        CSV.single_row_frame(spark, row, b.all_features)


def _flow_rows(spark):
    rows = [
        ("a", "6", 100.0, 0.06, 35.0, 3500.0, 10, 20, "DrDoS_A"),
        ("b", "17", float("inf"), 0.01, 5.0, 50.0, -1, -1, "Benign"),
        ("c", "6", None, 0.045, 31.0, 100.0, 3, 4, None),
        ("d", "17", float("nan"), 0.2, 10.0, 20.0, -1, -1, "Benign"),
    ]
    schema = ("flow_id string, protocol string, avg_packet_size double, flow_iat_mean double, "
              "fwd_packet_length_max double, fwd_packets_length_total double, init_fwd_win_bytes long, "
              "init_bwd_win_bytes long, label string")
    return spark.createDataFrame(rows, schema)


def test_score_suffix_rule(spark):
    b = B.fixture_bundle()
    one = S.score_table(_flow_rows(spark), b, flow_rate=1000)
    assert one.columns[-3:] == ["pred_binary", "pred_3label", "mode"]
    allm = S.score_table(_flow_rows(spark), b, flow_rate=None)
    assert allm.columns[-9:] == [f"{c}_{m}" for m in ("HAM", "FDM", "DFDM")
                                 for c in ("pred_binary", "pred_3label", "mode")]


def test_dfdm_never_warns_and_fdm_implies_dfdm(spark):
    v = S.verdicts(_flow_rows(spark), B.fixture_bundle()).collect()
    for r in v:
        assert r["_l3_DFDM"] in (0, 2)
        if r["_bin_FDM"] == 1:
            assert r["_bin_DFDM"] == 1


def test_chunked_needs_rate(spark):
    with pytest.raises(ValueError):
        S.score_chunked(_flow_rows(spark), B.fixture_bundle(), None)


def test_metrics_empty_table_and_zero_denominators(spark):
    empty = S.verdicts(_flow_rows(spark).where("false"), B.fixture_bundle())
    rows = MET.with_three_label_metrics(MET.with_binary_metrics(MET.mode_counts(empty))).collect()
    assert len(rows) == 3
    for r in rows:
        assert (r["n"], r["accuracy"], r["f1"], r["warning_rate"], r["benign_recall"]) == (0, 0.0, 0.0, 0.0, 0.0)


def test_labels_outside_01_fall_out_of_confusion(spark):
    df = spark.createDataFrame([(2, 1, 2), (0, 0, 0), (1, 1, 2)], "_y int, _bin_FDM int, _l3_FDM int")
    r = MET.mode_counts(df, ["FDM"]).first()
    assert (r["tp"], r["tn"], r["fp"], r["fn"], r["n"]) == (1, 1, 0, 0, 3)


def test_bundle_roundtrip_and_lookup(tmp_path):
    b = B.fixture_bundle()
    d = tmp_path / "bundle"
    B.save_bundle(b, str(d))
    assert B.load_bundle(str(d)) == b
    with pytest.raises(FileNotFoundError):
        B.find_bundle_file(str(tmp_path))
    B.save_bundle(b, str(d), prefix="other")
    with pytest.raises(ValueError):
        B.find_bundle_file(str(d))


def test_default_vote_threshold_is_half_total_weight():
    b = B.fixture_bundle()
    assert b.fdm.threshold == 2.25 and b.ham.threshold == 2.75
    assert b.all_features == tuple(sorted(b.all_features))


def test_bundle_roundtrip_through_spark_io(spark, tmp_path):
    """With a session, paths are those of Spark's file systems."""
    b = B.fixture_bundle()
    d = f"file://{tmp_path}/remote-bundle"
    B.save_bundle(b, d, spark=spark)
    assert B.load_bundle(d, spark=spark) == b


def test_encode_with_table_matches_literal_map(spark):
    df = spark.createDataFrame([("6",), ("17",), ("99",), (None,)], "p string")
    classes = spark.createDataFrame([("17", 0), ("6", 1)], "value string, code int")
    got = {r["p"]: r["code_p"] for r in P.encode_with_table(df, "p", classes, "code_p").collect()}
    assert got == {"6": 1, "17": 0, "99": 0, None: 0}


def test_stream_polls_with_processing_time(spark, tmp_path):
    import time
    from flowscore.session import scratch_path
    from flowscore.sources import fixtures as FX
    from flowscore.streaming import stream as STR
    f = FX.flows(spark, "/root/testdata/sf0.001").limit(50)
    landing, out, ckpt = (scratch_path(spark, n) for n in ("poll-in", "poll-out", "poll-ckpt"))
    f.coalesce(1).write.parquet(landing)
    q = STR.stream_score(spark, landing, f.schema, B.fixture_bundle(), out, ckpt, processing_time="1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert spark.read.parquet(out).count() == 50


def test_member_and_voter_sizes(spark, tmp_path):
    from flowscore.operators.extra_trees import fit_extra_trees, save_forest
    b = B.fixture_bundle()
    sizes = B.member_sizes(b, spark)
    assert set(sizes) == {"m1", "m2", "m3", "m4", "m5"} and all(v > 0 for v in sizes.values())
    v = B.voter_sizes(b, spark)
    assert v["HAM"] == v["FDM"] + sizes["m5"]
    df = spark.createDataFrame([(float(i), i % 2) for i in range(40)], "x double, y long")
    forest = fit_extra_trees(df, ["x"], n_estimators=2, max_depth=2)
    save_forest(spark, forest, f"file://{tmp_path}/forest")
    fb = b.with_(members=b.members + (B.Member("et", forest_path=f"file://{tmp_path}/forest"),))
    assert B.member_sizes(fb, spark)["et"] > 0


def test_mode_comparison_unlabelled(spark):
    v = S.verdicts(_flow_rows(spark).drop("label"), B.fixture_bundle())
    out = MET.mode_comparison(v)
    assert out.columns == ["mode", "position", "malicious_pct"]
    assert [r["mode"] for r in out.collect()] == ["HAM", "FDM", "DFDM"]


def test_target_partitions_follow_input_size(spark, monkeypatch):
    from flowscore.operators import arrival as ARR
    df = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    floor_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ARR.target_partitions(df) == floor_  # ~1 MB input: the configured floor
    monkeypatch.setattr(ARR, "TARGET_PARTITION_BYTES", 16 * 1024)
    assert ARR.target_partitions(df) > floor_  # same input, smaller target: more partitions
