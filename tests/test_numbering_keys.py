"""Numbering by every key type, split over partitions; partition counts; early exit of fitted members; job labels."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowscore.operators import arrival as ARR
from flowscore.operators import jobs

T0 = dt.datetime(2024, 3, 1)
KEYS = {
    "bigint": [None, 2**53, 2**53 + 1],
    "string": [None, "", "a"],
    "date": [None, dt.date(2024, 1, 1), dt.date(2024, 1, 2)],
    "timestamp": [None, T0, T0 + dt.timedelta(microseconds=1)],
    "decimal(20,4)": [None, Decimal("1.0000"), Decimal("1.0001")],
    "double": [None, 1.5, float("nan")],
    "binary": [None, b"", b"\x00\xff"],
    "boolean": [None, False, True],
}


def _same_as_windows(df, keys, out):
    w = Window.partitionBy(*keys).orderBy("ts", "id")
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) >= 30_000_000
    g = df.withColumn("pos", F.row_number().over(w)).withColumn(
        "flag", F.when((F.col("pos") == 1) | F.coalesce(gap, F.lit(False)), 1).otherwise(0))
    b = g.withColumn("burst", F.sum("flag").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    c = b.withColumn("at", F.row_number().over(Window.partitionBy(*keys, "burst").orderBy("ts", "id")) - 1)
    c = c.withColumn("batch", F.dense_rank().over(Window.partitionBy(*keys).orderBy("burst", F.floor(F.col("at") / 5))))
    want = {r.id: (r.pos, r.burst, r.batch, r["at"] % 5 + 1) for r in c.collect()}
    got = {r.id: (r.arrival_pos, r.burst, r.batch_num, r.pos_in_batch) for r in out.collect()}
    assert got == want
    return got


@pytest.mark.parametrize("kind,times", [(k, "some" if k in ("bigint", "date") else "all") for k in KEYS])
def test_numbering_by_key_type(spark, kind, times):
    rows = [(i, KEYS[kind][i % len(KEYS[kind])], T0 + dt.timedelta(seconds=i * 7 + (40 if i % 11 == 0 else 0)) if times == "all" or i % 13 else None,
             None if i % 2 else 2**53 + i) for i in range(60)]
    df = spark.createDataFrame(rows, f"id int, k {kind}, ts timestamp, payload bigint")
    out = ARR.number_arrivals(df, ["ts", "id"], key_cols=["k"], batch_size=5, gap_seconds=30.0, ts_col="ts",
                              num_partitions=5).cache()
    _same_as_windows(df, ["k"], out)
    assert out.select("id", "k", "payload").exceptAll(df.select("id", "k", "payload")).isEmpty()
    left = {(r.id) for r in ARR.leftover_rows(out, 5, ["k"]).collect()}
    ends = out.groupBy("k").agg(F.max("batch_num").alias("b")).collect()
    all_rows = out.collect()
    want = set()
    for e in ends:
        last = [r.id for r in all_rows if str(r.k) == str(e.k) and r.batch_num == e.b]
        want |= set(last) if len(last) < 5 else set()
    assert left == want
    out.unpersist()


def test_two_keys_and_partition_count(spark):
    rows = [(i, None if i % 3 else "x", None if i % 5 else 1, T0 + dt.timedelta(seconds=i)) for i in range(120)]
    df = spark.createDataFrame(rows, "id int, a string, b int, ts timestamp")
    out = ARR.number_arrivals(df, ["ts", "id"], key_cols=["a", "b"], batch_size=5, gap_seconds=30.0, ts_col="ts", num_partitions=5)
    _same_as_windows(df, ["a", "b"], out)
    floor_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert ARR.target_partitions(df.limit(1)) == floor_
    li = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet")
    assert ARR.target_partitions(li.join(o, li.l_orderkey == o.o_orderkey)) == floor_


def test_early_exit_equals_any_vote_for_fitted_members(spark, tmp_path):
    from flowscore.operators.cascade import early_exit
    from flowscore.operators.extra_trees import fit_extra_trees, save_forest
    from flowscore.operators.members import fit_random_forest
    from flowscore.operators.scoring import verdicts
    from flowscore.sources.bundle import EnsembleBundle, Member, Voter
    rows = [(i, float(i % 17), float(i % 23), int((i % 17 > 9) != (i % 23 > 14))) for i in range(400)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    fit_random_forest(df, ["a", "b"], num_trees=5, max_depth=4).write().overwrite().save(str(tmp_path / "rf"))
    save_forest(spark, fit_extra_trees(df, ["a", "b"], n_estimators=5, max_depth=4), str(tmp_path / "et"))
    e, rf, et = Member("e", expr="CASE WHEN a > 15 THEN 0.9 ELSE 0.1 END"), \
        Member("rf", model_path=str(tmp_path / "rf")), Member("et", forest_path=str(tmp_path / "et"))
    for order in (("e", "rf", "et"), ("et", "e", "rf"), ("rf", "et", "e")):
        v = Voter("FDM", order, ("a", "b"))
        bundle = EnsembleBundle(members=(e, rf, et), fdm=v, ham=v, label_col=None)
        want = {r.id: r._bin_DFDM for r in verdicts(df.drop("y"), bundle).select("id", "_bin_DFDM").collect()}
        out = early_exit(df, bundle).select("id", "pred_binary", "exit_member").collect()
        assert {r.id: r.pred_binary for r in out} == want
        assert all((r.exit_member is None) == (r.pred_binary == 0) for r in out)


def test_job_names_its_label_column(spark):
    v = spark.createDataFrame([(1, "Benign", 1), (2, "x", 0), (3, "x", 1), (4, None, None)], "job long, name string, flag int")
    v = v.selectExpr("*", *[f"0 AS _bin_{m}" for m in ("HAM", "FDM", "DFDM")], *[f"0 AS _l3_{m}" for m in ("HAM", "FDM", "DFDM")])
    j = spark.createDataFrame([(1, 0, "name", "Benign"), (2, 0, "flag", "Benign"), (3, 0, "absent", "Benign"), (4, 0, "name", "Benign")],
                              "job_id long, flow_rate int, label_col string, benign_label string")
    assert {r.job_id: r.y for r in jobs.score_jobs(v, j, "job").collect()} == {1: 0, 2: 0, 3: None, 4: 1}


def test_late_and_untimed_rows_are_counted(spark, tmp_path):
    from flowscore.streaming import stream as STR
    late = [T0 + dt.timedelta(hours=h) for h in (0, 5, 9, 1, 0)]
    for i, t in enumerate(late):  # each file is older than the one before it where it is late
        spark.createDataFrame([(i * 10 + k, t) for k in range(10)], "id int, ts timestamp").coalesce(1).write.mode("append") \
            .parquet(str(tmp_path / "in"))
    r = STR.stream_rate_mode(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, "ts", "1 hour", 15, 99,
                             str(tmp_path / "out"), str(tmp_path / "ck"), files_per_trigger=1)
    assert sorted((x.window_start.hour, x.rate) for x in r.collect()) == [(0, 20), (1, 10), (5, 10), (9, 10)]
    df = spark.createDataFrame([(i, None if i % 4 == 0 else T0 + dt.timedelta(seconds=i)) for i in range(100)], "id int, ts timestamp")
    STR.land_in_time_order(df, "ts", str(tmp_path / "land"), rows_per_file=20)
    assert spark.read.parquet(str(tmp_path / "land")).count() == 100
