"""Plan-shape regressions: the properties the scale design relies on."""

import __spark_entry__ as E
from conftest import SF_SMALL


def _plan(spark, key):
    df = E.queries()[key](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_one_projection_without_exchange(spark):
    p = _plan(spark, "score_all_modes")
    assert "Exchange" not in p and "Window" not in p and "BatchEvalPython" not in p
    assert "ArrowEvalPython" not in p
    # column pruning reached the scan: l_tax is never read
    assert "l_tax" not in p


def test_metrics_shuffle_once_after_partial_aggregation(spark):
    p = _plan(spark, "mode_comparison")
    assert p.count("Exchange") == 1 + p.count("rangepartitioning")  # the final ORDER BY of 3 rows may add one
    assert "partial_count" in p


def test_rollup_pre_aggregates(spark):
    p = _plan(spark, "metrics_rollup")
    assert "partial_count" in p and "Expand" in p


def test_numbering_has_no_window(spark):
    p = _plan(spark, "micro_batches")
    assert "Window" not in p and "MapInArrow" in p and "MapInPandas" not in p


def _final(df):
    df.write.format("noop").mode("overwrite").save()
    rows = df.collect()  # the frame's own plan becomes final
    return rows, df._jdf.queryExecution().executedPlan().toString()


def test_rate_join_is_measured_not_forced(spark):
    """The rate table is a pre-aggregated count of its own; it is broadcast only under the session's threshold."""
    from flowscore.operators.routing import rate_mode, rate_table
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select("event_id", "ts")
    assert "partial_count" in _final(rate_table(ev, "ts", "1 hour"))[1]
    rows, p = _final(rate_mode(ev, "ts", "1 hour", 10, 20))
    assert "BroadcastHashJoin" in p and "Exchange hashpartitioning" not in p  # the events stay where the scan left them
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again, p = _final(rate_mode(ev, "ts", "1 hour", 10, 20))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "Broadcast" not in p and "SortMergeJoin" in p
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_hot_window_is_split(spark):
    """Nine rows in ten fall into one window: above the broadcast threshold its rows go to several tasks."""
    from pyspark.sql import functions as F

    from flowscore.operators.routing import rate_mode
    ev = spark.range(300_000).select(F.col("id").alias("event_id"), F.md5(F.col("id").cast("string")).alias("payload"), F.when(
        F.col("id") % 10 == 0, F.timestamp_seconds(F.col("id") * 60)).otherwise(F.timestamp_seconds(F.lit(0))).alias("ts")).repartition(8)
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    old = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        out = rate_mode(ev, "ts", "1 hour", 10, 200)
        n = out.count()
        rows, p = _final(out.groupBy("mode").agg(F.count("*").alias("n"), F.max("payload")))  # the whole rows are joined
        tasks = out.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"), F.max("payload"))
        per_task = max(r["n"] for r in tasks.collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert n == 300_000 and {r["mode"]: r["n"] for r in rows} == {"HAM": 30_000 - 6, "DFDM": 270_006}
    assert "skew=true" in p and per_task < 270_000 / 3



def test_filter_after_scoring_reaches_the_scan(spark):
    from flowscore.operators import scoring as S
    from flowscore.session import scratch_path
    from flowscore.sources import fixtures as FX
    from flowscore.sources.bundle import fixture_bundle
    p = scratch_path(spark, "flows-pq")
    FX.flows(spark, SF_SMALL).write.parquet(p)
    df = S.score_table(spark.read.parquet(p), fixture_bundle()).where("protocol = '6'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = [ln for ln in plan.splitlines() if "FileScan" in ln][0]
    assert "PushedFilters: [IsNotNull(protocol), EqualTo(protocol,6)]" in scan
