"""Properties over the driver tables and generated arrivals."""

import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import SF_MID, SF_SMALL
from flowscore.operators import arrival as ARR
from flowscore.operators import metrics as MET
from flowscore.operators import scoring as S
from flowscore.operators.cascade import early_exit
from flowscore.operators.prep import preprocess
from flowscore.sources import fixtures as FX
from flowscore.sources.bundle import fixture_bundle
from flowscore.streaming import stream as STR
from flowscore.session import scratch_path


def test_fixture_counts_match_checked_values(spark):
    """FIXTURES.md section 3: (y, DFDM, FDM) counts at sf0.01."""
    v = S.verdicts(FX.flows(spark, SF_MID), fixture_bundle())
    got = {(r["_y"], r["_bin_DFDM"], r["_bin_FDM"]): r["count"]
           for r in v.groupBy("_y", "_bin_DFDM", "_bin_FDM").count().collect()}
    assert got == {(0, 0, 0): 13267, (0, 1, 0): 30017, (0, 1, 1): 2533,
                   (1, 0, 0): 123, (1, 1, 0): 299, (1, 1, 1): 13761}
    l3 = {(r["_y"], r["_l3_FDM"]): r["count"] for r in v.groupBy("_y", "_l3_FDM").count().collect()}
    assert l3 == {(0, 0): 28188, (0, 1): 15096, (0, 2): 2533, (1, 0): 262, (1, 1): 160, (1, 2): 13761}


def test_early_exit_equals_any_vote(spark):
    b = fixture_bundle()
    x = preprocess(FX.flows(spark, SF_SMALL), b, keep=["flow_id"])
    ee = early_exit(x, b).select("flow_id", F.col("pred_binary").alias("ee"))
    v = S.verdicts(FX.flows(spark, SF_SMALL), b).select("flow_id", "_bin_DFDM")
    assert ee.join(v, "flow_id").where("ee <> _bin_DFDM").count() == 0


def test_partition_invariance(spark):
    b = fixture_bundle()
    f = FX.flows(spark, SF_SMALL)
    a = MET.mode_counts(S.verdicts(f.repartition(1), b)).collect()
    c = MET.mode_counts(S.verdicts(f.repartition(13), b)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, c))


def test_count_identities(spark):
    c = MET.mode_counts(S.verdicts(FX.flows(spark, SF_SMALL), fixture_bundle())).collect()
    for r in c:
        assert r["tp"] + r["tn"] + r["fp"] + r["fn"] == r["n"]
        assert r["warn_actually_benign"] + r["warn_actually_malicious"] == r["n_warning"]
        assert r["n_benign"] + r["n_warning"] + r["n_malicious"] == r["n"]


def _arrivals(spark, sizes, gap_s):
    t0 = dt.datetime(2024, 1, 1)
    rows, t, i = [], t0, 0
    for size in sizes:
        for _ in range(size):
            rows.append((i, t))
            i += 1
            t += dt.timedelta(seconds=1)
        t += dt.timedelta(seconds=gap_s)
    return spark.createDataFrame(rows, "event_id long, ts timestamp")


def test_watcher_batch_shape(spark):
    """Arrivals of 4, 12 and 12 rows with idle gaps, N = 5 -> 4,5,5,2,5,5,2."""
    df = _arrivals(spark, [4, 12, 12], 10)
    for parts in (1, 3, 8):
        out = ARR.number_arrivals(df, ["ts", "event_id"], batch_size=5, gap_seconds=5.0, ts_col="ts",
                                  num_partitions=parts)
        sizes = [r["n_rows"] for r in ARR.batch_progress(out).orderBy("batch_num").collect()]
        assert sizes == [4, 5, 5, 2, 5, 5, 2]


def _brute(pdf, key, n, gap_us):
    pdf = pdf.sort_values([*([key] if key else []), "t", "event_id"]).copy()
    out = {}
    groups = pdf.groupby(key) if key else [(None, pdf)]
    for _, g in groups:
        burst = 0
        prev = None
        batch = 0
        inb = 0
        for eid, t in zip(g["event_id"], g["t"]):
            if prev is None or (gap_us is not None and t - prev >= gap_us):
                burst += 1
                inb = 0
            if n is None:
                if inb == 0:
                    batch += 1
            elif inb % n == 0:
                batch += 1
            inb += 1
            prev = t
            out[eid] = (burst, batch)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_numbering_matches_brute_force(spark, seed):
    rnd = random.Random(seed)
    m = rnd.randint(50, 400)
    t = 0
    rows = []
    for i in range(m):
        t += rnd.choice([1, 1, 2, 3, 7, 40, 400]) * 1_000_000
        rows.append((i, rnd.choice([1, 2, 3]) if seed % 2 else 0, t))
    pdf = pd.DataFrame(rows, columns=["event_id", "k", "t"])
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_micros("t"))
    key = "k" if seed % 2 else None
    n = rnd.choice([None, 2, 3, 5])
    gap = rnd.choice([None, 5.0, 30.0])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        out = ARR.number_arrivals(df, ["ts", "event_id"], key_cols=[key] if key else [], batch_size=n,
                                  gap_seconds=gap, ts_col="ts", num_partitions=rnd.randint(2, 17)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = _brute(pdf, key, n, None if gap is None else int(gap * 1e6))
    got = {r["event_id"]: (r["burst"], r["batch_num"]) for r in out}
    assert got == want


def test_batch_size_bound(spark):
    from flowscore.plans.catalog import _micro_by_user
    n = _micro_by_user(spark, SF_SMALL)
    sizes = n.groupBy("user_id", "burst", "batch_num").count()
    assert sizes.where("count > 5").count() == 0
    # only the last batch of a burst may be short
    last = sizes.groupBy("user_id", "burst").agg(F.max("batch_num").alias("mb"))
    short = sizes.where("count < 5").join(last, ["user_id", "burst"]).where("batch_num <> mb")
    assert short.count() == 0


def test_stream_restart_no_loss_no_duplicates(spark):
    f = FX.flows(spark, SF_SMALL)
    landing = scratch_path(spark, "t-landing")
    out = scratch_path(spark, "t-out")
    ckpt = scratch_path(spark, "t-ckpt")
    older = f.where(F.col("seen_at") < F.lit("1998-01-01").cast("timestamp_ntz"))
    newer = f.where(F.col("seen_at") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    older.coalesce(1).write.mode("append").parquet(landing)
    STR.stream_score(spark, landing, f.schema, fixture_bundle(), out, ckpt)
    first = spark.read.parquet(out).count()
    STR.stream_score(spark, landing, f.schema, fixture_bundle(), out, ckpt)  # restart, nothing new
    assert spark.read.parquet(out).count() == first
    newer.coalesce(1).write.mode("append").parquet(landing)
    STR.stream_score(spark, landing, f.schema, fixture_bundle(), out, ckpt)  # restart with new data
    res = spark.read.parquet(out)
    assert res.count() == f.count()
    assert res.select("flow_id").exceptAll(f.select("flow_id")).count() == 0  # flow_id may repeat: multiset


def test_forest_member_beats_majority(spark):
    from flowscore.operators import members as MEM
    from flowscore.plans.catalog import _train_frame, FEATURES
    x = _train_frame(spark, SF_SMALL).cache()
    model = MEM.fit_random_forest(x.where("split = 'train'"), FEATURES, num_trees=10, max_depth=5)
    s = MEM.ml_probability(model, x.where("split = 'test'"), "p")
    acc = s.select(F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    maj = x.where("split = 'test'").select(F.avg("y")).first()[0]
    assert acc > max(maj, 1 - maj)
    again = MEM.ml_probability(MEM.fit_random_forest(x.where("split = 'train'"), FEATURES, num_trees=10,
                                                     max_depth=5), x.where("split = 'test'"), "p")
    assert s.select(F.sum("p")).first()[0] == again.select(F.sum("p")).first()[0]


def test_adaboost_member_beats_majority(spark):
    from flowscore.operators import members as MEM
    from flowscore.plans.catalog import _train_frame, FEATURES
    x = _train_frame(spark, SF_SMALL).cache()
    stumps = MEM.fit_adaboost(x.where("split = 'train'"), FEATURES, rounds=8)
    p = F.expr(MEM.adaboost_sql(stumps))
    t = x.where("split = 'test'")
    acc = t.select(F.avg(((p > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    maj = t.select(F.avg("y")).first()[0]
    assert acc > max(maj, 1 - maj)


def test_extra_trees_member_beats_majority(spark):
    from flowscore.operators.extra_trees import fit_extra_trees, forest_probability
    from flowscore.plans.catalog import _train_frame, FEATURES
    x = _train_frame(spark, SF_SMALL).cache()
    forest = fit_extra_trees(x.where("split = 'train'"), FEATURES, n_estimators=8, max_depth=4)
    t = x.where("split = 'test'").withColumn("p", forest_probability(forest))
    acc = t.select(F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    maj = t.select(F.avg("y")).first()[0]
    assert acc > max(maj, 1 - maj)
    again = fit_extra_trees(x.where("split = 'train'"), FEATURES, n_estimators=8, max_depth=4)
    assert (again.thr == forest.thr).all() and (again.feat == forest.feat).all()


def test_hot_key_is_split_across_partitions(spark):
    """One key holds a third of the rows: range partitioning on (key, order)
    spreads it, so no partition is much larger than the average, and the
    numbering still equals the brute-force one."""
    rnd = random.Random(7)
    rows, t = [], 0
    for i in range(3000):
        t += rnd.choice([1, 2, 50]) * 1_000_000
        rows.append((i, 0 if i % 3 == 0 else rnd.randint(1, 200), t))
    pdf = pd.DataFrame(rows, columns=["event_id", "k", "t"])
    df = spark.createDataFrame(pdf).withColumn("ts", F.timestamp_micros("t"))
    out = ARR.number_arrivals(df, ["ts", "event_id"], key_cols=["k"], batch_size=5, gap_seconds=30.0,
                              ts_col="ts", num_partitions=8)
    sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert max(sizes) <= 2 * len(rows) / 8
    hot_parts = out.where("k = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    assert hot_parts >= 2
    want = _brute(pdf, "k", 5, 30_000_000)
    got = {r["event_id"]: (r["burst"], r["batch_num"]) for r in out.collect()}
    assert got == want
