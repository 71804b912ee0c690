"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowscore.session import scratch_path

#: White space, as the word rule ``[^\x20\x09-\x0D]+`` sees it.
SPACE_RE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Spark's setting that drops a query's shuffle files when the query is over.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """Cut lineage: write ``df`` to the shared scratch folder and read it back.

    Columnar and compressed, so it is smaller than ``checkpoint()``; a lost
    executor only costs the tasks that were reading. With ``tidy``, the shuffle
    files of the write go with its end, not when the driver collects garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(TIDY, None)
    if tidy:
        spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if tidy:
            spark.conf.unset(TIDY) if before is None else spark.conf.set(TIDY, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``written`` made, once all that was made from them is written."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            p = spark._jvm.org.apache.hadoop.fs.Path(folder)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_RE), "")


def has_word(line: Column) -> Column:
    return line.rlike(r"[^\x20\x09-\x0D]")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra input columns never clash."""
    return df.select(*[F.col(f"`{n}`") for n in names])


#: The two halves of a row's 128-bit key, as ``keyed`` names them.
KEY = ("__r1", "__r2")


def keyed(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with a key of every row, made of the named columns' values (doc_id and text by default).

    Joins go by this key, never by doc_id: it is never null, so rows without
    an id are told apart by their text, and rows of one id by theirs. Rows
    equal in these columns share a key; nothing that is decided from the
    columns alone can differ between them.
    """
    cols = [F.col(f"`{n}`") for n in names or ("doc_id", "text")]
    return df.withColumns({KEY[0]: F.xxhash64(*cols), KEY[1]: F.xxhash64(F.lit("second"), *cols)})


FILTER_BITS = 24


def filter_of(ids: DataFrame):
    """(slot column of a keyed row, broadcast bitmap of the ids' slots).

    At most 2**FILTER_BITS integers reach the driver and the bitmap is 2 MB,
    whatever the data; it only spares rows a shuffle, an exact join follows.
    """
    slot = F.shiftrightunsigned(F.col(KEY[0]), 64 - FILTER_BITS)
    slots = ids.select(slot.alias("slot")).distinct().toArrow()["slot"].to_numpy()
    bitmap = np.zeros(1 << (FILTER_BITS - 3), np.uint8)
    np.bitwise_or.at(bitmap, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    return slot, ids.sparkSession.sparkContext.broadcast(bitmap)


def in_filter(batch, wanted, inside: bool = True):
    """The rows of a batch whose slot is (not) in the bitmap."""
    bitmap, slot = wanted.value, batch.column("slot").to_numpy()
    hit = ((bitmap[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1) == int(inside)
    return batch.take(pa.array(np.flatnonzero(hit)))


def chosen(wanted, inside: bool = True):
    """For mapInArrow: ``in_filter`` over all batches."""
    def run(batches):
        for b in batches:
            yield in_filter(b, wanted, inside)
    return run
