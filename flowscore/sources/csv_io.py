"""Flow CSV sources and sinks.

Reading follows the reference's pandas reader on the points that change
results: header names are trimmed, the usual missing-value tokens become
null, and columns are then cast to the declared types (ANSI casts make bad
numeric text fail loudly). Values are read as text first because Spark's
type inference turns a double column holding ``inf`` or ``NA`` into text.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscore.constants import NA_TOKENS
from flowscore.operators.prep import q, trim_columns


#: Options of every CSV sink. Values go out unchanged: blanks kept, quotes doubled.
DIALECT = {"header": True, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False, "escape": '"'}


def _is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.StringType)


def null_na_tokens(c):
    return F.when(c.isin(*[t for t in NA_TOKENS if t]), F.lit(None)).otherwise(c)


def read_flows_csv(spark: SparkSession, path: str, types: Mapping[str, str] | None = None, quoted_breaks: bool = True) -> DataFrame:
    """Scan a CSV file or directory with a header. ``types`` maps (trimmed)
    column names to Spark SQL types; unlisted columns stay text, but for
    partition columns of the folder names, whose type Spark finds. Every row is
    kept. A quoted field may hold line breaks, so a file is read by one task;
    where no field does, ``quoted_breaks=False`` lets files be split by
    ``spark.sql.files.maxPartitionBytes``."""
    raw = spark.read.option("header", True).option("inferSchema", False).option("nullValue", "") \
        .option("emptyValue", "").option("multiLine", quoted_breaks) \
        .option("escape", '"').csv(path)
    raw = trim_columns(raw)
    types = dict(types or {})
    cols = []
    for c in raw.columns:
        v = null_na_tokens(q(c)) if _is_text(raw, c) else q(c)
        cols.append((v.cast(types[c]) if c in types else v).alias(c))
    return raw.select(*cols)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Header, no index, overwrite; one file per task (no single-file funnel)."""
    df.write.mode(mode).options(**DIALECT).csv(path)


def write_by_batch(df: DataFrame, path: str, batch_col: str = "batch_num", fmt: str = "csv") -> None:
    """Numbered archive: one folder per batch (``batch_num=<n>``). Dynamic
    partition overwrite replaces only the batches present in ``df``, so
    re-running a batch is idempotent. Rows are dealt out by the batch number
    first, so each folder is written by one task: one file per batch instead
    of one per task and batch. By its hash: ranges would have to be found by
    computing ``df`` once more."""
    w = df.repartition(batch_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(batch_col)
    if fmt == "csv":
        w.options(**DIALECT).csv(path)
    else:
        w.parquet(path)


def single_row_frame(spark: SparkSession, row: Mapping[str, float], features) -> DataFrame:
    """A literal row as a one-row frame holding only the features, in order;
    a missing feature is an error naming the missing and required ones."""
    missing = [f for f in features if f not in row]
    if missing:
        raise ValueError(f"row is missing columns: {missing}\nRequired: {list(features)}")
    schema = ", ".join(f"`{f}` double" for f in features)
    return spark.createDataFrame([tuple(float(row[f]) for f in features)], schema)
