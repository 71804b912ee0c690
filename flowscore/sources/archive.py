"""Numbered archive of scored batches for very many batches.

One folder per batch stops working at some 10^5 batches. Here a commit (one
write of any number of batches) is a folder ``data/commit=<id>/bucket=<k>``:
``bucket`` is the batch number divided by ``BATCHES_PER_BUCKET``, and rows are
sorted by batch inside a file, so a reader of some batches opens their buckets
and skips row groups by their statistics. ``index/commit=<id>`` has a row per
batch (rows, bucket), and a marker file, written last, makes the commit visible.

Writing a commit again (a replay after a failure) overwrites its own folders;
a batch that comes again in a later commit replaces the earlier one. Without
its marker a commit is not there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BATCHES_PER_BUCKET = 10_000


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _marker(path: str, commit: int) -> str:
    return f"{path}/commits/{commit:020d}"


def write_batches(df: DataFrame, path: str, commit: int, batch_col: str = "batch_num") -> None:
    """Store the batches of ``df`` as one commit; commits are numbered by the caller (a stream's batch id)."""
    spark = df.sparkSession
    fs, marker = _fs(spark, _marker(path, commit))
    fs.delete(marker, False)  # a replay is invisible until it is whole
    bucket = F.floor(F.col(batch_col) / BATCHES_PER_BUCKET).cast("long")
    data = df.withColumn("bucket", bucket).repartitionByRange("bucket", batch_col).sortWithinPartitions("bucket", batch_col)
    data.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/commit={commit}")
    stored = spark.read.parquet(f"{path}/data/commit={commit}")
    index = stored.groupBy(F.col(batch_col).alias("batch"), "bucket").agg(F.count(F.lit(1)).alias("n_rows"))
    index.select("batch", F.col("bucket").cast("long").alias("bucket"), "n_rows").write.mode("overwrite").parquet(f"{path}/index/commit={commit}")
    fs.create(marker, True).close()


def commits(spark: SparkSession, path: str) -> list[int]:
    fs, folder = _fs(spark, f"{path}/commits")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(folder)) if fs.exists(folder) else []


def batch_index(spark: SparkSession, path: str) -> DataFrame:
    """(batch, bucket, n_rows, commit) of every batch in its latest commit."""
    done = commits(spark, path)
    if not done:
        return spark.createDataFrame([], "batch long, bucket long, n_rows long, commit long")
    read = spark.read.option("basePath", f"{path}/index").parquet(*[f"{path}/index/commit={c}" for c in done])
    last = read.groupBy("batch").agg(F.max_by(F.struct("bucket", "n_rows", "commit"), "commit").alias("x"))
    return last.select(F.col("batch").cast("long").alias("batch"), "x.bucket", "x.n_rows", F.col("x.commit").cast("long").alias("commit"))


def read_batches(spark: SparkSession, path: str, lowest: int | None = None, highest: int | None = None, batch_col: str = "batch_num") -> DataFrame | None:
    """The rows of the batches in [lowest, highest], each from its latest commit; None for an archive without commits."""
    done = commits(spark, path)
    if not done:
        return None
    rows = spark.read.option("basePath", f"{path}/data").parquet(*[f"{path}/data/commit={c}" for c in done])
    batch, bucket = F.col(batch_col), F.col("bucket")
    if lowest is not None:
        rows = rows.where((batch >= lowest) & (bucket >= lowest // BATCHES_PER_BUCKET))
    if highest is not None:
        rows = rows.where((batch <= highest) & (bucket <= highest // BATCHES_PER_BUCKET))
    if len(done) > 1:
        current = batch_index(spark, path).select(F.col("batch").alias("__b"), F.col("commit").alias("__c"))
        rows = rows.join(current, (batch == F.col("__b")) & (F.col("commit") == F.col("__c")), "left_semi")
    return rows.drop("commit", "bucket")
