"""Fitted members, calibration, sweeps, vocabularies, flows and archive against plain Python."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from flowscore.operators import ensemble as ENS
from flowscore.operators import extra_trees as ET
from flowscore.operators import fitting as FIT
from flowscore.operators import members as MEM
from flowscore.operators import prep as P
from flowscore.operators import scoring as S
from flowscore.operators import selection as SEL
from flowscore.operators import sweep as SW
from flowscore.operators.flow_build import build_flows
from flowscore.sources import archive as ARC
from flowscore.sources import bundle as B
from flowscore.sources import csv_io as CSV


def plain_adaboost(X, y, rounds):
    """Every feature, every distinct value, both polarities, row by row."""
    w, out = np.ones(len(y)), []
    for _ in range(rounds):
        best = None
        for f in range(X.shape[1]):
            for cut in np.unique(X[:, f])[1:]:
                for pol in (1, -1):
                    pred = (X[:, f] >= cut) if pol > 0 else (X[:, f] < cut)
                    err = w[pred != y].sum() / w.sum()
                    if best is None or err < best[0] - 1e-12:
                        best = (err, f, cut, pol, pred)
        err, f, cut, pol, pred = best
        alpha = math.log((1 - err) / err)
        w = w * np.where(pred != y, math.exp(alpha), 1.0)
        out.append((f, cut, pol, alpha))
    return out


def test_adaboost_is_the_plain_stump_search(spark):
    rng = np.random.default_rng(3)
    X = np.column_stack([rng.integers(0, 12, 400), rng.integers(0, 5, 400), rng.integers(0, 40, 400)]).astype(float)
    y = ((X[:, 0] > 6) & (X[:, 1] < 3) | (rng.random(400) < 0.1)).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(X, y)], "a double, b double, c double, y int")
    got = MEM.fit_adaboost(df, ["a", "b", "c"], rounds=12, checkpoint_every=5)
    want = plain_adaboost(X, y == 1, 12)
    assert [("abc"[f], cut, pol) for f, cut, pol, _ in want] == [(s["feature"], s["threshold"], s["polarity"]) for s in got]
    assert all(abs(s["alpha"] - a) < 1e-9 for s, (*_, a) in zip(got, want))
    twice = MEM.fit_adaboost(df.withColumn("w", F.lit(2.0)), ["a", "b", "c"], rounds=4, weight_col="w")
    assert all(abs(s["alpha"] - t["alpha"]) < 1e-9 for s, t in zip(got, twice))


def test_adaboost_rounds_read_blocks_of_cells(spark, monkeypatch):
    """Many features' bins, a null label and several blocks per task; the rounds get blocks, not a row per cell and feature."""
    rng = np.random.default_rng(4)
    X = np.column_stack([rng.random(3000), rng.integers(0, 300, 3000)]).round(3).astype(float)
    y = (X[:, 0] > 0.4) ^ (X[:, 1] > 120)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(X, y)], "a double, b double, y int").repartition(3)
    sizes, whole = [], MEM._stump_sums

    def spy(k, width, recent, shift, boosted):
        sizes.append((k, width, len(recent)))
        return whole(k, width, recent, shift, boosted)
    monkeypatch.setattr(MEM, "_stump_sums", spy)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = MEM.fit_adaboost(df, ["a", "b"], rounds=7, max_cuts=1100, checkpoint_every=3)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = plain_adaboost(X, y, 7)
    assert [("ab"[f], cut, pol) for f, cut, pol, _ in want] == [(s["feature"], s["threshold"], s["polarity"]) for s in got]
    assert all(abs(s["alpha"] - a) < 1e-9 for s, (*_, a) in zip(got, want))
    assert sizes == [(2, "uint32", r % 3 if r % 3 or not r else 0) for r in range(7)]


def test_calibrations_of_all_members_read_the_rows_once(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(rng.random(), rng.random(), int(rng.random() < 0.4)) for _ in range(300)], "a double, b double, y int").coalesce(1)
    reads = spark.sparkContext.accumulator(0)

    def seen(v):
        reads.add(1)
        return v
    marked = df.withColumn("a", F.udf(seen, "double")("a"))
    got = MEM.platt_calibrations(marked, ["a", "b", "a * b"])
    assert reads.value == 300
    for expr, pair in zip(["a", "b", "a * b"], got):
        assert pair == pytest.approx(MEM.platt_calibration(df.withColumn("s", F.expr(expr)), "s"), abs=1e-9)


def test_archive_computes_its_rows_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def seen(v):
        reads.add(1)
        return v
    df = spark.range(400).select((F.col("id") % 20).alias("batch_num"), F.udf(seen, "long")("id").alias("v"))
    CSV.write_by_batch(df, str(tmp_path / "a"), fmt="parquet")
    assert reads.value == 400  # ranges would be found by a pass of their own
    assert all(len(list(p.glob("part-*"))) == 1 for p in (tmp_path / "a").glob("batch_num=*"))
    assert spark.read.parquet(str(tmp_path / "a")).count() == 400


def test_trees_grow_until_their_leaves_are_pure(spark):
    rng = np.random.default_rng(5)
    X = rng.random((600, 3))
    y = (np.floor(X[:, 0] * 8) + np.floor(X[:, 1] * 8)) % 2  # a checkerboard
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(X, y)], "a double, b double, c double, y int").repartition(5)
    forest = ET.fit_extra_trees(df, ["a", "b", "c"], n_estimators=6)
    assert forest.depth > 8  # beyond the former limit
    leaf = forest.value[forest.feat < 0]
    assert set(np.unique(leaf)) == {0.0, 1.0}
    assert sorted(np.concatenate([forest.left[forest.feat >= 0], forest.right[forest.feat >= 0]])) == list(range(6, len(forest.feat)))
    p = df.select("y", ET.forest_probability(forest).alias("p")).collect()
    assert all(abs(r["p"] - r["y"]) < 1e-12 for r in p)  # the training rows come back
    again = ET.fit_extra_trees(df.repartition(2), ["a", "b", "c"], n_estimators=6)
    assert (again.thr == forest.thr).all() and (again.left == forest.left).all()
    short = ET.fit_extra_trees(df, ["a", "b", "c"], n_estimators=4, max_depth=3)
    assert short.depth == 3


def test_held_out_rows_of_a_full_forest(spark):
    rng = np.random.default_rng(8)
    X = rng.random((3000, 4))
    y = ((X[:, 0] > 0.5) ^ (X[:, 1] > 0.3)).astype(int)
    df = spark.createDataFrame([(i, *map(float, r), int(v)) for i, (r, v) in enumerate(zip(X, y))], "id long, a double, b double, c double, d double, y int")
    forest = ET.fit_extra_trees(df.where("id < 2000"), list("abcd"), n_estimators=20)
    right = df.where("id >= 2000").select(F.avg((F.round(ET.forest_probability(forest)) == F.col("y")).cast("double"))).first()[0]
    assert right > 0.95


def test_constant_features_and_one_class(spark):
    df = spark.createDataFrame([(1.0, 2.0, i % 2) for i in range(20)], "a double, b double, y int")
    forest = ET.fit_extra_trees(df, ["a", "b"], n_estimators=2)
    assert (forest.feat == -1).all() and (forest.value == 0.5).all()
    one = ET.fit_extra_trees(df.where("y = 1"), ["a", "b"], n_estimators=2)
    assert (one.value == 1).all() and one.depth == 0


def plain_isotonic(points):
    """Pool adjacent violators, point by point: [(lowest, highest, mean)]."""
    out = []
    for s in sorted({p for p, _ in points}):
        ys = [y for p, y in points if p == s]
        out.append([s, s, sum(ys), len(ys)])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            b = out.pop()
            out[-1] = [out[-1][0], b[1], out[-1][2] + b[2], out[-1][3] + b[3]]
    return [(a, b, y / n) for a, b, y, n in out]


@pytest.mark.parametrize("parts", [1, 7])
def test_isotonic_blocks_and_curve(spark, parts):
    rng = random.Random(parts)
    points = [(round(rng.random(), 2), 0) for _ in range(300)]
    points = [(s, int(rng.random() < s * s)) for s, _ in points]
    df = spark.createDataFrame(points, "score double, y int")
    got = MEM.isotonic_blocks(df, num_partitions=parts)
    assert np.allclose(got, plain_isotonic(points))
    curve = F.expr(MEM.isotonic_sql("score", got))
    rows = df.select("score", curve.alias("c")).distinct().collect()
    for r in rows:
        assert r["c"] == pytest.approx(next(v for lo, hi, v in got if lo <= r["score"] <= hi))
    ends = spark.createDataFrame([(-1.0,), (2.0,)], "score double").select(curve.alias("c")).collect()
    assert [r["c"] for r in ends] == pytest.approx([got[0][2], got[-1][2]])


def test_out_of_fold_scores_never_see_their_fold(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("k"), (F.col("id") % 2).cast("int").alias("y"))
    seen = MEM.out_of_fold(df, "k", lambda r: {x["k"] for x in r.select("k").collect()}, lambda m, r: r.withColumn("score", F.col("k").isin(*m)), 4)
    assert seen.count() == 200 and seen.where("score").count() == 0


def test_bundle_with_own_members_weights_and_calibration(spark, tmp_path):
    rng = np.random.default_rng(11)
    X = rng.random((900, 3))
    y = ((X[:, 0] > 0.8) & (X[:, 1] > 0.2)).astype(int)  # a rare class
    df = spark.createDataFrame([(f"r{i}", *map(float, r), int(v)) for i, (r, v) in enumerate(zip(X, y))], "id string, a double, b double, c double, y int")
    b = ENS.fit_bundle(df, ["a", "b"], str(tmp_path / "m"), estimators=5, max_depth=6, ham_features=["a", "b", "c"], folds=2, key="id")
    assert set(b.fdm.members).isdisjoint(b.ham.members) and b.ham.members[-1] == "HAM_ExtraTrees"
    assert b.fdm.features == ("a", "b") and b.ham.features == ("a", "b", "c")
    assert all(m.calibrated_expr for m in b.members)
    B.save_bundle(b.with_(label_col="y"), str(tmp_path / "b"))
    v = S.verdicts(df, B.load_bundle(str(tmp_path / "b")))
    got = v.select(F.avg((F.col("_bin_HAM") == F.col("_y")).cast("double")), F.avg((F.col("_bin_FDM") == F.col("_y")).cast("double")),
                   F.avg(F.abs(F.col("_mean_HAM") - F.col("_y")))).first()
    assert got[0] > 0.95 and got[1] > 0.95 and got[2] < 0.1
    plain = ENS.fit_bundle(df, ["a"], str(tmp_path / "p"), estimators=2, max_depth=3, class_weights=False, calibrate=None)
    assert all(m.calibrated_expr is None for m in plain.members)


def test_sweeps_with_a_threshold_per_row(spark):
    rng = random.Random(2)
    rows = [(rng.random(), rng.random(), int(rng.random() < 0.3)) for _ in range(400)] + [(None, 0.5, 1), (0.5, 0.5, 0), (0.5, 0.4, 1)]
    df = spark.createDataFrame(rows, "s double, m double, y int")
    for r in SW.threshold_sweep(df, "s", "y", num_partitions=6).collect():
        hit = [(y, s is not None and s >= r["threshold"]) for s, _, y in rows]
        assert (r["tp"], r["fp"], r["fn"], r["tn"]) == tuple(sum(h == p and y == t for y, h in hit) for p, t in ((True, 1), (True, 0), (False, 1), (False, 0)))
    v = df.where("s is not null").select(F.col("s").alias("_std_HAM"), F.col("m").alias("_mean_HAM"), F.col("y").alias("_y"))
    got = SW.disagreement_sweep(v, "HAM", num_partitions=5).collect()
    assert len(got) == 401
    full = [r for r in rows if r[0] is not None]
    for r in got[::37]:
        sure = [(int(m >= 0.5), y) for s, m, y in full if s < r["threshold"]]
        assert r["n_confident"] == len(sure)
        assert r["confident_accuracy"] == pytest.approx(sum(a == b for a, b in sure) / len(sure) if sure else 0.0, abs=1e-8)


def test_ten_thousand_classes_through_scoring(spark, tmp_path):
    n = 10_000
    df = spark.range(2 * n).select(F.concat(F.lit("c"), F.lpad((F.col("id") % n).cast("string"), 5, "0")).alias("kind"),
                                   F.when(F.col("id") % 2 == 0, "Benign").otherwise("Bad").alias("label"))
    df = df.unionByName(spark.createDataFrame([(None, "Bad")], "kind string, label string"))
    enc = FIT.fit_encoders(df, ["kind"], str(tmp_path))
    assert isinstance(enc["kind"], str)
    voter = B.Voter("FDM", ("m",), ("kind",))
    b = B.EnsembleBundle(members=(B.Member("m", expr="CASE WHEN kind >= 5000 THEN 0.9 ELSE 0.1 END"),), fdm=voter, ham=B.Voter("HAM", ("m",), ("kind",)),
                         encoders=enc)
    new = df.unionByName(spark.createDataFrame([("never seen", "Bad")], "kind string, label string"))
    codes = {r["kind"]: r["code"] for r in P.encode_with_table(new, "kind", spark.read.parquet(enc["kind"]), "code").distinct().collect()}
    assert codes["c00000"] == 0 and codes["c09999"] == 9999 and codes[None] == 0 and codes["never seen"] == 0
    got = S.score_table(new, b, flow_rate=0)
    assert got.columns == ["kind", "label", "pred_binary", "pred_3label", "mode"] and got.where("pred_binary = 1").count() == n
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")  # the dictionary is larger than that
    try:
        far = S.score_table(new, b, flow_rate=0)
        assert sorted(map(str, far.collect())) == sorted(map(str, got.collect()))
        assert "Broadcast" not in far._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    few = FIT.fit_encoders(df.where("kind < 'c00010'"), ["kind"])
    assert few == {"kind": [f"c{i:05d}" for i in range(10)]}


def test_flows_from_packets(spark):
    rows = [(1, 0, "a", "b", 5, 80, 6, 100), (2, 1, "b", "a", 80, 5, 6, 300), (3, 2, "a", "b", 5, 80, 6, 50), (4, 50, "b", "a", 80, 5, 6, 10),
            (5, 3, "a", "b", 5, 80, 17, 7), (6, 4, "a", None, 5, 80, 6, 9), (7, 1, "a", "b", 5, 80, 6, 40)]
    p = spark.createDataFrame([(i, s, d, sp, dp, pr, n, t) for i, t, s, d, sp, dp, pr, n in rows],
                              "packet_id long, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, length long, t long")
    f = build_flows(p.withColumn("ts", F.timestamp_seconds("t")), 10)
    got = {(r.flow_id, r.start_time): (r.end_time, r.packet_count, r.fwd_packet_count, r.avg_packet_size, r.flow_iat_mean, r.fwd_packet_length_max,
                                       r.fwd_packets_length_total) for r in f.collect()}
    assert got == {("a-b-5-80-6", 0.0): (2.0, 4, 3, 122.5, 2 / 3, 100.0, 190.0), ("b-a-80-5-6", 50.0): (50.0, 1, 1, 10.0, 0.0, 10.0, 10.0),
                   ("a-b-5-80-17", 3.0): (3.0, 1, 1, 7.0, 0.0, 7.0, 7.0), ("a--5-80-6", 4.0): (4.0, 1, 1, 9.0, 0.0, 9.0, 9.0)}
    assert build_flows(p.withColumn("ts", F.timestamp_seconds("t")).limit(0), 10).count() == 0


def test_feature_clusters(spark):
    rng = np.random.default_rng(1)
    a, c = rng.normal(size=500), rng.normal(size=500)
    cols = [a, a * -2 + 0.01 * rng.normal(size=500), c, c + 0.1 * rng.normal(size=500), rng.normal(size=500), np.ones(500)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in np.column_stack(cols)], ", ".join(f"f{i} double" for i in range(6)))
    got = [(r.feature, r.cluster) for r in SEL.feature_clusters(df, [f"f{i}" for i in range(6)]).collect()]
    assert got == [("f0", 1), ("f1", 1), ("f2", 2), ("f3", 2), ("f4", 3), ("f5", 4)]
    m = {(r.feature_a, r.feature_b): r.correlation for r in SEL.correlation_matrix(df, ["f0", "f2", "f5"]).collect()}
    assert m["f0", "f2"] == pytest.approx(np.corrcoef(a, c)[0, 1]) and m["f0", "f5"] is None


def test_archive_of_many_batches(spark, tmp_path):
    path = str(tmp_path / "archive")
    assert ARC.read_batches(spark, path) is None and ARC.batch_index(spark, path).count() == 0
    df = spark.range(200_000).select((F.col("id") % 100_000).alias("batch_num"), F.col("id").alias("v"))
    ARC.write_batches(df, path, 0)
    assert len(list((tmp_path / "archive" / "data" / "commit=0").glob("bucket=*"))) == 10  # for 100,000 batches
    for _ in range(2):  # the second commit, and its replay
        ARC.write_batches(df.where("batch_num < 30").withColumn("v", -F.col("v")), path, 1)
    got = ARC.read_batches(spark, path, 29, 30)
    assert sorted((r.batch_num, r.v) for r in got.collect()) == [(29, -100_029), (29, -29), (30, 30), (30, 100_030)]
    assert "PartitionFilters: [isnotnull(bucket" in got._jdf.queryExecution().executedPlan().toString()
    index = ARC.batch_index(spark, path)
    assert index.count() == 100_000 and index.where("commit = 1").count() == 30 and index.where("n_rows <> 2").count() == 0
    (tmp_path / "archive" / "commits" / f"{1:020d}").unlink()  # a commit that did not get to its marker
    assert ARC.batch_index(spark, path).where("commit = 1").count() == 0
    assert ARC.read_batches(spark, path).where("v < 0").count() == 0


def test_csv_keeps_line_breaks_blanks_and_typed_folders(spark, tmp_path):
    rows = [(1, "x\ny", " Benign"), (2, 'say "hi"\r\n', "Benign "), (3, None, "NA"), (4, "", "a,b")]
    df = spark.createDataFrame(rows, "job_id long, label string, note string")
    from flowscore.operators.jobs import write_job_outputs
    path = str(tmp_path / "jobs")
    write_job_outputs(df, path, row_key="label")
    back = CSV.read_flows_csv(spark, path, {"job_id": "bigint"})
    assert {tuple(r) for r in back.select("job_id", "label", "note").collect()} == {(1, "x\ny", " Benign"), (2, 'say "hi"\r\n', "Benign "), (3, None, None),
                                                                                  (4, None, "a,b")}
    flat = str(tmp_path / "flat")
    CSV.write_csv(df.drop("label"), flat)
    assert CSV.read_flows_csv(spark, flat, quoted_breaks=False).count() == 4


def _plain_walk(x, node, feat, thr, left, right):
    while feat[node] >= 0:
        node = right[node] if x[feat[node]] > thr[node] else left[node]
    return node


def test_walks_reach_the_leaf_of_every_row():
    rng = np.random.default_rng(3)
    feat, thr, left, right, depth = [-1, -1, -1], [0.0] * 3, [-1] * 3, [-1] * 3, [0, 0, 0]
    for node in range(400):  # uneven: one tree keeps a single leaf, others go deep
        if node < len(feat) and node != 1 and (node < 3 or rng.random() < 0.7):
            feat[node], thr[node], left[node], right[node] = int(rng.integers(4)), float(rng.normal()), len(feat) + 1, len(feat)
            for column, v in ((feat, -1), (thr, 0.0), (left, -1), (right, -1), (depth, depth[node] + 1)):
                column += [v, v]
    table = [np.array(c) for c in (feat, thr, left, right)]
    X = rng.normal(size=(700, 4))
    X[::7, 0], X[::11, 1], X[::13, 2] = np.nan, np.inf, -np.inf
    assert max(depth) > 8
    want = [[_plain_walk(x, t, *table) for x in X] for t in range(3)]
    assert (ET._route(X, 3, ET._steps(*table)) == want).all()
    assert ET._route(X[:0], 3, ET._steps(*table)).shape == (3, 0)


def test_a_task_adds_up_its_batches(spark):
    rng = np.random.default_rng(4)
    X, y, w = rng.random((5000, 2)), rng.integers(0, 2, 5000), rng.random(5000)
    names = ["x0", "x1", "y", "w"]
    batches = [pa.RecordBatch.from_arrays([pa.array(c[lo:lo + 1000]) for c in (X[:, 0], X[:, 1], y, w)], names=names) for lo in range(0, 5000, 1000)]
    table = [np.array(c) for c in ([0, -1, -1, -1], [0.25, 0.0, 0.0, 0.0], [2, -1, -1, -1], [3, -1, -1, -1])]  # the second root is done
    shared = type("Shared", (), {"value": (table, np.array([0, 2, 2]))})
    got = pa.Table.from_batches(ET._ranges(["x0", "x1"], "y", "w", shared, 2, 1, True)(iter(batches)))
    assert got.num_rows == 2  # a row per node of the level, however many batches
    right = X[:, 0] > 0.25
    for r, at in zip(got.to_pylist(), (~right, right)):
        assert (r["n"], r["n1"]) == (at.sum(), y[at].sum()) and np.isclose([r["w"], r["w1"]], [w[at].sum(), w[at & (y == 1)].sum()]).all()
        assert [r["mn0"], r["mn1"], r["mx0"], r["mx1"]] == [*X[at].min(0), *X[at].max(0)]
    shared.value = (*shared.value, np.array([[1, 0], [-1, -1]]), np.array([[0.5, 0.125], [0.0, 0.0]]))
    got = pa.Table.from_batches(ET._sides(["x0", "x1"], "y", "w", shared, 2, 1)(iter(batches)))
    want = [w[~right & ((X[:, f] > t) == side) & (y == c)].sum() for f, t in ((1, 0.5), (0, 0.125)) for side in (0, 1) for c in (0, 1)]
    assert got["code"].to_pylist() == list(range(8)) and np.isclose(got["w"].to_numpy(), want).all()


def test_a_bundle_computes_its_training_rows_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def seen(v):
        reads.add(1)
        return float(v % 10)
    df = spark.range(300).select("id", F.udf(seen, "double")("id").alias("a"), (F.col("id") % 7).cast("double").alias("b"),
                                 (F.col("id") % 10 > 4).cast("int").alias("y"))
    ENS.fit_bundle(df, ["a", "b"], str(tmp_path / "bundle"), estimators=2, max_depth=2, calibrate=None, class_weights=False, key="id")
    assert reads.value == 300  # nine fits of several passes read the kept rows
