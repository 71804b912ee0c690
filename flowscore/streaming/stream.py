"""Streaming: score arriving flow files, keep running counts, measure rates.

Every query reads a landing folder with ``readStream`` and keeps its
progress in a checkpoint under ``spark.checkpoint.dir``, so a restart
resumes where it stopped: no row is lost or doubled. Per-batch outputs are
written by ``foreachBatch`` into a folder named after the batch id with
overwrite, so replaying a batch after a failure replaces its own output
(idempotent) instead of appending twice.
"""

from __future__ import annotations

import math
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscore.functions.routing import select_mode
from flowscore.functions.voting import label3_text
from flowscore.operators import arrival as ARR
from flowscore.operators import scoring as S
from flowscore.sources.bundle import EnsembleBundle


def land_in_time_order(df: DataFrame, ts_col: str, path: str, rows_per_file: int = 50_000, slices: int | None = None) -> int:
    """Write ``df`` as parquet files whose modification order follows
    ``ts_col``, the way a producer appends to a landing folder: one job deals
    the rows out in ranges of time (rows without a time come first), then the
    files get rising modification times. ``slices``: where there would be more
    files than that, they hold more rows instead. Returns the number of slices
    asked for."""
    spark = df.sparkSession
    k = max(2, math.ceil(df.count() / rows_per_file))
    k = k if slices is None else min(k, max(2, slices))
    df.repartitionByRange(k, F.col(ts_col)).write.mode("append").parquet(path)
    fs, folder = _file_system(spark, path)
    files = sorted((f.getPath().toString() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")))
    start = int(time.time()) - len(files)
    for i, f in enumerate(files):  # part numbers follow the ranges
        fs.setTimes(spark._jvm.org.apache.hadoop.fs.Path(f), (start + i) * 1000, -1)
    return k


def _file_system(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _reader(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None):
    """``files_per_trigger`` bounds a micro-batch; None takes all files that wait."""
    reader = spark.readStream.schema(schema)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).parquet(path)


ROWS_PER_RANGE = 50_000  # of a micro-batch's numbering


def _ranges(batch: DataFrame) -> int:
    """Ranges for numbering one micro-batch: by its rows, so that a small one does not pay for
    tasks without rows and a large one is spread."""
    return max(1, -(-batch.count() // ROWS_PER_RANGE))


def _run(writer, checkpoint: str, processing_time: str | None = None):
    """``processing_time`` None: drain what is there (availableNow) and return.
    Otherwise poll every ``processing_time`` (the watcher's poll interval,
    e.g. "1 second") and return the running query."""
    w = writer.option("checkpointLocation", checkpoint)
    if processing_time is not None:
        return w.trigger(processingTime=processing_time).start()
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def stream_score(spark: SparkSession, landing: str, schema: T.StructType, bundle: EnsembleBundle,
                 out: str, checkpoint: str, flow_rate: int | None = None, processing_time: str | None = None,
                 files_per_trigger: int | None = None):
    """Score every arriving batch of flow rows and archive each batch's
    predictions under ``out/batch_id=<id>``. With ``processing_time`` the
    query keeps polling and the running query is returned."""
    def per_batch(batch: DataFrame, batch_id: int):
        S.score_table(batch, bundle, flow_rate).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return _run(_reader(spark, landing, schema, files_per_trigger).writeStream.foreachBatch(per_batch), checkpoint, processing_time)


def _additive(spark: SparkSession, source: DataFrame, counts, keys, total: str, out: str, checkpoint: str) -> DataFrame:
    """Counts add up: each micro-batch writes its own counts under its batch
    id and reading sums them. No state is kept, so no watermark is needed
    and late rows count like all others."""
    def per_batch(batch: DataFrame, batch_id: int):
        counts(batch).write.mode("overwrite").parquet(f"{out}/epoch={batch_id}")

    _run(source.writeStream.foreachBatch(per_batch), checkpoint)
    return spark.read.parquet(out).groupBy(*keys).agg(F.sum(total).alias(total))


def stream_mode_counts(spark: SparkSession, landing: str, schema: T.StructType, bundle: EnsembleBundle,
                       out: str, checkpoint: str, files_per_trigger: int | None = None) -> DataFrame:
    """Running three-label counts per mode."""
    def counts(batch: DataFrame) -> DataFrame:
        long = S.long_verdicts(S.verdicts(batch, bundle), [], with_y=False)
        return long.groupBy("mode", label3_text(F.col("pred_3label")).alias("pred_3label")).agg(F.count(F.lit(1)).alias("n"))

    return _additive(spark, _reader(spark, landing, schema, files_per_trigger), counts, ["mode", "pred_3label"], "n",
                     out, checkpoint)


def stream_rate_mode(spark: SparkSession, landing: str, schema: T.StructType, ts_col: str, width: str, high: float,
                     extreme: float, out: str, checkpoint: str, files_per_trigger: int | None = None) -> DataFrame:
    """Measured arrival rate per tumbling window of event time and the mode
    it selects; rows without a time are in no window."""
    def counts(batch: DataFrame) -> DataFrame:
        w = batch.withColumn(ts_col, F.col(ts_col).cast("timestamp")).groupBy(F.window(ts_col, width).alias("w")).agg(
            F.count(F.lit(1)).alias("rate"))
        # back to wall-clock time (timestamp_ntz) so the result does not depend on the session zone
        return w.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "rate")

    rates = _additive(spark, _reader(spark, landing, schema, files_per_trigger), counts, ["window_start"], "rate",
                      out, checkpoint)
    return rates.withColumn("mode", select_mode("rate", high, extreme))


def stream_micro_batches(spark: SparkSession, landing: str, schema: T.StructType, order_cols, ts_col: str,
                         batch_size: int, gap_seconds: float, out: str, checkpoint: str,
                         files_per_trigger: int | None = None) -> DataFrame:
    """Count-or-idle batch numbering over a stream (one arrival order).

    Each micro-batch is numbered with the distributed scan, continuing from
    the state the previous micro-batch left (kept as a small JSON file per
    batch id in the checkpoint folder, so a replayed batch reads the same
    entry state and rewrites the same output)."""
    state_dir = f"{checkpoint}/numbering-state"
    state_schema = "key string, last_ts long, pos long, burst long, open_start long, b_open long"

    def load(batch_id: int):
        if batch_id == 0:
            return None
        rows = spark.read.schema(state_schema).json(f"{state_dir}/{batch_id - 1}").collect()
        if not rows or rows[0]["key"] is None:
            return None
        r = rows[0]
        return ARR.State(r["key"], r["last_ts"], r["pos"], r["burst"], r["open_start"],
                         r["b_open"])

    def save(batch_id: int, st):
        row = (None, None, None, None, None, None) if st is None else (
            st.key, st.last_ts, st.pos, st.burst, st.open_start, st.b_open)
        # a row of literals: no Python worker has to start for it
        cols = [F.lit(v).cast(t).alias(c) for v, (c, t) in zip(row, (f.split() for f in state_schema.split(", ")))]
        spark.range(1, numPartitions=1).select(*cols).write.mode("overwrite").json(f"{state_dir}/{batch_id}")

    def per_batch(batch: DataFrame, batch_id: int):
        entry = load(batch_id)
        exit_state: list = []
        numbered = ARR.number_arrivals(batch, order_cols, batch_size=batch_size, gap_seconds=gap_seconds,
                                       ts_col=ts_col, num_partitions=_ranges(batch), initial=entry, exit_state=exit_state)
        numbered.write.mode("overwrite").parquet(f"{out}/epoch={batch_id}")
        save(batch_id, exit_state[0] if exit_state and exit_state[0] is not None else entry)

    _run(_reader(spark, landing, schema, files_per_trigger).writeStream.foreachBatch(per_batch), checkpoint)
    return spark.read.parquet(out)


COMPACT = 16  # batches between two full copies of the keys' states


class CarryLog:
    """Where each key stopped after each micro-batch, as a table.

    A batch writes the states of its own keys (``delta=<id>``), every
    ``COMPACT``-th also those of all keys (``base=<id>``). What a batch reads
    depends on its id alone, so a replayed batch starts from the same states.
    Deltas that a base has taken in go when the batch after it is done."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _base(self, batch_id: int) -> int:
        return batch_id // COMPACT * COMPACT - 1

    def before(self, batch_id: int) -> DataFrame:
        """The states of all keys before a batch."""
        base = self._base(batch_id)
        parts = [f"{self.path}/delta={b}" for b in range(base + 1, batch_id)] + [f"{self.path}/base={base}"] * (base >= 0)
        read = self.spark.read.schema(ARR.CARRY_SCHEMA)
        return ARR.latest(read.parquet(*parts)) if parts else self.spark.createDataFrame([], ARR.CARRY_SCHEMA)

    def save(self, batch_id: int, states: DataFrame) -> None:
        states.write.mode("overwrite").parquet(f"{self.path}/delta={batch_id}")
        if (batch_id + 1) % COMPACT == 0:
            own = self.spark.read.schema(ARR.CARRY_SCHEMA).parquet(f"{self.path}/delta={batch_id}")
            ARR.latest(self.before(batch_id).unionByName(own)).write.mode("overwrite").parquet(f"{self.path}/base={batch_id}")
        elif batch_id % COMPACT == 0 and batch_id:
            base = self._base(batch_id)
            for old in [f"delta={b}" for b in range(base + 1 - COMPACT, base + 1)] + [f"base={base - COMPACT}"]:
                fs, folder = _file_system(self.spark, f"{self.path}/{old}")
                fs.delete(folder, True)


def stream_micro_batches_keyed(spark: SparkSession, landing: str, schema: T.StructType, key: str,
                               order_cols, ts_col: str, batch_size: int, gap_seconds: float, out: str,
                               checkpoint: str, files_per_trigger: int | None = None,
                               num_partitions: int | None = None) -> DataFrame:
    """Per-key count-or-idle numbering over a stream.

    Each micro-batch is numbered by the distributed scan, whose ranges also
    hold a row per key with the state its earlier rows left (``CarryLog``). A
    key with most of the rows is split over many ranges; values never pass
    through pandas, so long columns with nulls stay exact. Each micro-batch's
    rows and states go to folders named by its id, so a replay rewrites them."""
    log = CarryLog(spark, f"{checkpoint}/numbering-state")

    def per_batch(batch: DataFrame, batch_id: int):
        present = batch.select(ARR.key_text(batch, [key]).alias("key")).distinct()
        carry = log.before(batch_id).join(present, "key", "left_semi")
        numbered, states = ARR.continue_arrivals(batch, order_cols, [key], carry, batch_size=batch_size, gap_seconds=gap_seconds,
                                                 ts_col=ts_col, num_partitions=num_partitions or _ranges(batch))
        numbered.write.mode("overwrite").parquet(f"{out}/epoch={batch_id}")
        log.save(batch_id, states)

    _run(_reader(spark, landing, schema, files_per_trigger).writeStream.foreachBatch(per_batch), checkpoint)
    return spark.read.parquet(out)
