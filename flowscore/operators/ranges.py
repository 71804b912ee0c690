"""Running totals over any number of ordered values, without a single-task window.

The table is dealt out in ranges of the order column, one row per range is
summed up, those sums (one small row per range) are added up in range order and
joined back, and only inside a range does a window run. A range holds about a
partition's worth of distinct values, however many there are in all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscore.operators.arrival import target_partitions
from flowscore.session import ensure_checkpoint_dir

RANGE = "__range"


def totals_before(df: DataFrame, order: str, values: Sequence[str], num_partitions: int | None = None) -> DataFrame:
    """``df`` (one row per value of ``order``, whole-number ``values``) with
    ``<v>_before``, the sum over all smaller values, and ``<v>_total``."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    parts = num_partitions or target_partitions(df)
    ranged = df.repartitionByRange(parts, order).withColumn(RANGE, F.spark_partition_id()).checkpoint(eager=True)
    sums = {r[RANGE]: [r[v] or 0 for v in values] for r in ranged.groupBy(RANGE).agg(*[F.sum(v).alias(v) for v in values]).collect()}
    rows, run = [], [0] * len(values)
    for k in sorted(sums):
        rows.append((k, *run))
        run = [a + b for a, b in zip(run, sums[k])]
    start = spark.createDataFrame(rows, f"{RANGE} int" + "".join(f", `{v}__s` long" for v in values))
    inside = Window.partitionBy(RANGE).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(F.broadcast(start), RANGE)  # one row per range
    cols = {}
    for v, total in zip(values, run):
        cols[f"{v}_before"] = F.col(f"`{v}__s`") + F.coalesce(F.sum(v).over(inside), F.lit(0))
        cols[f"{v}_total"] = F.lit(total).cast("long")
    return out.withColumns(cols).drop(RANGE, *[f"{v}__s" for v in values])
