"""Fits that produce bundle parameters from data: scaler, encoders, class weights.

Each is one aggregate over the table; only the small parameter result
(a few numbers per feature, or a vocabulary whose size is checked first)
ever reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscore.operators.prep import q

LITERAL_CLASSES = 4096  # up to so many classes in all, a vocabulary is part of the scoring expression; beyond, a table


def scaler_table(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, mean, scale): mean and population std (ddof 0, as the
    reference's scaler uses); a zero std becomes 1. One pass over the data."""
    aggs = []
    for f in features:
        aggs += [F.avg(q(f)).alias(f"m__{f}"), F.stddev_pop(q(f)).alias(f"s__{f}")]
    one = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"m__{f}").alias("mean"),
                 F.when(F.col(f"s__{f}") == 0, F.lit(1.0)).otherwise(F.col(f"s__{f}")).alias("scale"))
        for f in features
    ])
    return one.select(F.inline(rows))


def fit_scaler(df: DataFrame, features: Sequence[str]) -> dict:
    return {r["feature"]: [float(r["mean"]), float(r["scale"])]
            for r in scaler_table(df, features).collect()}


def encoder_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, class, code): sorted distinct non-null string values, code =
    position in that order. Distinct is a hash aggregate (partial per task);
    positions come from the range-partitioned arrival numbering, so even a
    column with a huge vocabulary is never ranked inside one task."""
    parts = [df.select(F.lit(c).alias("column"), q(c).cast("string").alias("class")).where(F.col("class").isNotNull())
             for c in columns]
    vals = parts[0]
    for p in parts[1:]:
        vals = vals.unionByName(p)
    vals = vals.distinct()
    from flowscore.operators.arrival import number_arrivals
    # distinct values are few beside the rows: the shuffle's own count is enough
    numbered = number_arrivals(vals, ["class"], key_cols=["column"],
                               num_partitions=int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return numbered.select("column", "class", (F.col("arrival_pos") - 1).cast("int").alias("code"))


def fit_encoders(df: DataFrame, columns: Sequence[str], directory: str | None = None) -> dict:
    """Vocabulary per column, for ``EnsembleBundle.encoders``.

    A column of at most ``LITERAL_CLASSES`` classes is a list; a larger one is
    the path of its (value, code) table, written under ``directory`` (a shared
    folder; a scratch one by default). No number of classes is too many, and
    no large vocabulary reaches the driver."""
    from flowscore.session import scratch_path
    t = encoder_table(df, columns)
    size = {r["column"]: r["n"] for r in t.groupBy("column").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = [c for c in columns if size.get(c, 0) <= LITERAL_CLASSES]
    out: dict = {c: [] for c in few}
    for r in t.where(F.col("column").isin(few)).orderBy("column", "code").collect():
        out[r["column"]].append(r["class"])
    for i, c in enumerate(columns):
        if c not in few:
            path = f"{directory.rstrip('/')}/vocabulary-{i}" if directory else scratch_path(df.sparkSession, f"vocabulary-{i}")
            t.where(F.col("column") == c).select(F.col("class").alias("value"), "code").write.mode("overwrite").parquet(path)
            out[c] = path
    return out


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Balanced class weights n / (2 * n_class) per class, as a small table."""
    counts = df.groupBy(q(y).alias("class")).agg(F.count(F.lit(1)).alias("n_class"))
    # total over the per-class table (one row per class), no join needed
    n = F.sum("n_class").over(Window.partitionBy())
    return counts.select("class", "n_class",
                         (n.cast("double") / (F.lit(2.0) * F.col("n_class"))).alias("weight"))
