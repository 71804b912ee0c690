"""Arrival numbering: positions, idle bursts and count-or-idle micro-batches.

Semantics (per key, in arrival order): a row starts a new *burst* when it is
the key's first row or arrived at least ``gap`` after the previous row (the
idle flush); each burst is cut into batches of ``batch_size`` rows (the count
trigger), the last batch of a burst may be shorter. Batches are numbered
1, 2, ... per key in arrival order. Equivalent window form::

    burst     = running sum of gap flags
    chunk     = (row_number() within burst - 1) div batch_size
    batch_num = dense_rank() over (order by burst, chunk)

That window form needs one ordered pass over every key -- with no key (one
global arrival order) or a hot key it would put a third or all of the table
in one task. The distributed form used here:

1. range-partition on (key, order) -- a total order, so a hot key is split
   across many partitions -- sort within partitions, and ``checkpoint()``
   the result into the shared checkpoint folder (stable partitions for the
   two passes, lineage cut, survives executor loss);
2. pass 1: every partition is scanned as if it started a fresh key and
   reports one small summary row (first/last key and time, and how its
   first key segment would change given earlier rows);
3. the driver folds the summaries (one row per partition, a bounded list)
   into the exact state entering every partition and broadcasts them;
4. pass 2: every partition is rescanned from its true entry state.

The partition count follows the file sizes of the scans (~256 MB each); pass
only the columns that the result needs, since whole rows are dealt out.

Keys are compared by one text column made in Spark (a null key is a key of
its own, as in ``groupBy``), so every atomic key type works and values never
pass through pandas. A row without a time never ends a burst by idleness.

Both passes stream Arrow batches through ``mapInArrow`` with vectorised
numpy; no task ever holds more than one Arrow batch plus a few scalars.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowscore.session import ensure_checkpoint_dir

UNBOUNDED = 1 << 62  # batch size used when only idle gaps cut batches

NO_TIME = -(1 << 63)  # a null time in the scan
KEY, PID = "__arrival_key", "__pid"

OUT_FIELDS = ("arrival_pos", "burst", "pos_in_burst", "batch_num", "pos_in_batch")
NUMBERS = ("last_ts", "pos", "burst", "open_start", "b_open")  # of a State
CARRIED = "__carried"  # struct of a carry row, null on data rows
CARRY_SCHEMA = "key string, " + ", ".join(f"{c} long" for c in NUMBERS)


@dataclass
class State:
    key: str  # key text, see key_text
    last_ts: int
    pos: int  # rows of this key seen so far
    burst: int  # bursts of this key so far
    open_start: int  # 0-based key position where the open burst started
    b_open: int  # batches of this key before the open burst


def _ceil_div(a, n):
    return (a + n - 1) // n


def _scan(key: np.ndarray, ts: np.ndarray | None, st: State | None, n: int, gap: int | None,
          carry: dict[str, np.ndarray] | None = None):
    """Vectorised scan of one sorted chunk from entry state ``st``.

    A segment is a run of rows of one key. It continues ``st`` if that is the
    chunk's first key, or the state of a carry row: with ``carry`` (the mask
    ``is`` and a column per number of ``State``), the masked rows are no data,
    each stands before its key's rows and holds where the key stopped.

    Returns (arrays of the data rows, exit state, newkey of all rows, flag of
    the data rows, exit numbers per segment)."""
    m = len(key)
    newkey = np.zeros(m, dtype=bool)
    newkey[1:] = key[1:] != key[:-1]
    newkey[0] = st is None or key[0] != st.key
    first_at = np.flatnonzero(newkey) if newkey[0] else np.append(0, np.flatnonzero(newkey))
    k = len(first_at)
    seg = np.repeat(np.arange(k), np.diff(np.append(first_at, m)))
    held = np.zeros(k, dtype=bool)  # segments that continue an earlier state
    base = {c: np.zeros(k, dtype=np.int64) for c in NUMBERS}
    if not newkey[0]:
        held[0] = True
        for c in NUMBERS:
            base[c][0] = getattr(st, c)
    if carry is not None:
        told = carry["is"][first_at]
        held |= told
        for c in NUMBERS:
            base[c][told] = carry[c][first_at[told]]
        data = ~carry["is"]
        seg, ts = seg[data], None if ts is None else ts[data]

    rows = len(seg)
    idx = np.arange(rows)
    begin = np.searchsorted(seg, np.arange(k + 1))  # of each segment's data rows
    head = idx == begin[seg]
    pos = idx - begin[seg] + base["pos"][seg]
    flag = head & ~held[seg]
    if gap is not None and rows:
        prev = np.empty(rows, dtype=np.int64)
        prev[1:] = ts[:-1]
        prev[head] = np.where(held, base["last_ts"], NO_TIME)[seg[head]]
        flag |= (ts != NO_TIME) & (prev != NO_TIME) & ((ts - prev) >= gap)

    rec = np.flatnonzero(flag)  # rows that start a burst
    rec_seg, rec_pos = seg[rec], pos[rec]
    rec_first = np.searchsorted(rec_seg, rec_seg)  # the segment's first record
    rec_head = rec_first == np.arange(len(rec))
    before = np.empty(len(rec), dtype=np.int64)  # where the burst before it started
    before[1:] = rec_pos[:-1]
    before[rec_head] = base["open_start"][rec_seg[rec_head]]
    inc = np.where(rec_head & ~held[rec_seg], 0, _ceil_div(rec_pos - before, n))
    csum = np.cumsum(inc)
    rec_b = csum - (csum - inc)[rec_first] + base["b_open"][rec_seg]
    rec_burst = np.arange(len(rec)) - rec_first + 1 + base["burst"][rec_seg]

    at = np.cumsum(flag) - 1
    inside = at >= 0
    inside[inside] = rec_seg[at[inside]] == seg[inside]  # else still in the burst that the segment entered with
    start, b_row, burst_row = (base[c][seg] for c in ("open_start", "b_open", "burst"))
    for values, records in ((start, rec_pos), (b_row, rec_b), (burst_row, rec_burst)):
        values[inside] = records[at[inside]]
    off = pos - start
    out = {
        "arrival_pos": pos + 1,
        "burst": burst_row,
        "pos_in_burst": off + 1,
        "batch_num": b_row + off // n + 1,
        "pos_in_batch": off % n + 1,
    }
    some = np.flatnonzero(np.diff(begin))
    last = begin[some + 1] - 1
    ends = base
    for c, values in (("last_ts", ts), ("pos", pos + 1), ("burst", burst_row), ("open_start", start), ("b_open", b_row)):
        if values is not None:
            ends[c][some] = values[last]
    exit_state = State(key[-1], *(int(ends[c][-1]) for c in NUMBERS))
    return out, exit_state, newkey, flag, {"key": key[np.append(first_at[1:], m) - 1], **ends}


def key_text(df: DataFrame, key_cols: Sequence[str]) -> Column:
    """One text per key, different for different keys: a JSON list of the
    values' texts, nulls kept. -0.0 and 0.0 are one key, as in ``groupBy``."""
    parts = []
    for c in key_cols:
        kind, value = df.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            raise TypeError(f"key column {c!r} must be of an atomic type")
        if isinstance(kind, T.TimestampType):
            value = F.unix_micros(value)  # its text would repeat when clocks go back
        elif isinstance(kind, (T.FloatType, T.DoubleType)):
            value = value + F.lit(0.0).cast(kind)
        elif isinstance(kind, T.BinaryType):
            value = F.hex(value)
        parts.append(value.cast("string"))
    return F.to_json(F.array(*parts)) if parts else F.lit("")


def micros(times: pa.Array) -> np.ndarray:
    """Microseconds of a date or timestamp array; ``NO_TIME`` for null."""
    zone = getattr(times.type, "tz", None)
    return times.cast(pa.timestamp("us", tz=zone)).cast(pa.int64()).fill_null(NO_TIME).to_numpy(zero_copy_only=False)


def _arrays(batch: pa.RecordBatch, ts_col: str | None):
    carry = None
    if CARRIED in batch.schema.names:
        told = batch.column(CARRIED)
        carry = {"is": told.is_valid().to_numpy(zero_copy_only=False)}
        for c in NUMBERS:
            carry[c] = pc.struct_field(told, c).fill_null(0).to_numpy(zero_copy_only=False)
    return (batch.column(KEY).to_numpy(zero_copy_only=False), None if ts_col is None else micros(batch.column(ts_col)), carry)


SUMMARY_SCHEMA = T.StructType([
    T.StructField("pid", T.IntegerType()),
    T.StructField("rows", T.LongType()),
    T.StructField("first_key", T.StringType()),
    T.StructField("first_ts", T.LongType()),
    T.StructField("multi_seg", T.BooleanType()),
    T.StructField("f1", T.LongType()),
    T.StructField("b_f1", T.LongType()),
    T.StructField("out_key", T.StringType()),
    T.StructField("out_ts", T.LongType()),
    T.StructField("out_pos", T.LongType()),
    T.StructField("out_burst", T.LongType()),
    T.StructField("out_open_start", T.LongType()),
    T.StructField("out_b_open", T.LongType()),
])


def _summaries(ts_col, n, gap):
    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st = None
        rows = 0
        pid = None
        first_key = first_ts = None
        multi = False
        f1 = b_f1 = -1
        in_first = True
        for batch in it:
            if batch.num_rows == 0:
                continue
            if pid is None:
                pid = batch.column(PID)[0].as_py()
            key, ts, carry = _arrays(batch, ts_col)
            out, new_st, newkey, flag, _ = _scan(key, ts, st, n, gap, carry)
            if st is None:
                first_key = key[0]
                first_ts = int(ts[0]) if ts is not None else 0
                if carry is not None and carry["is"][0]:  # the key starts here, from its carried state
                    in_first, multi = False, True
                nk = newkey.copy()
                nk[0] = False
            else:
                nk = newkey
            if in_first:
                seg_end = int(np.argmax(nk)) if nk.any() else len(nk)
                if f1 < 0:
                    cand = np.nonzero(flag[:seg_end] & ~newkey[:seg_end])[0]
                    if st is None:
                        cand = cand[cand > 0]
                    if len(cand):
                        f1 = rows + int(cand[0])
                        b_f1 = int(out["batch_num"][cand[0]] - 1)
                if nk.any():
                    in_first = False
                    multi = True
            rows += len(flag)
            st = new_st
        if st is None:
            return
        row = {
            "pid": pid, "rows": rows, "first_key": first_key, "first_ts": first_ts,
            "multi_seg": multi, "f1": f1, "b_f1": b_f1, "out_key": st.key, "out_ts": st.last_ts,
            "out_pos": st.pos, "out_burst": st.burst, "out_open_start": st.open_start, "out_b_open": st.b_open,
        }
        yield pa.RecordBatch.from_pandas(pd.DataFrame([row]).astype({"pid": "int32"}), preserve_index=False)
    return fn


def _fold(summaries: list, n: int, gap: int | None, initial: State | None = None):
    """Entry state of every partition, folding the per-partition summaries
    in partition (= range) order. Bounded by the number of partitions.
    Returns (entry states by partition id, exit state after the last one)."""
    entry: dict[int, State | None] = {}
    st: State | None = initial
    for s in sorted(summaries, key=lambda r: r["pid"]):
        entry[s["pid"]] = st
        fk = s["first_key"]
        fresh = State(s["out_key"], s["out_ts"], s["out_pos"], s["out_burst"],
                      s["out_open_start"], s["out_b_open"])
        if st is None or st.key != fk or s["multi_seg"]:
            st = fresh
            continue
        P = st.pos
        row0 = (gap is not None and NO_TIME not in (s["first_ts"], st.last_ts)
                and s["first_ts"] - st.last_ts >= gap)
        if row0:
            b0 = st.b_open + _ceil_div(P - st.open_start, n)
            st = State(fk, fresh.last_ts, P + s["rows"], st.burst + fresh.burst, P + fresh.open_start,
                       b0 + fresh.b_open)
        elif s["f1"] < 0:
            st = State(fk, fresh.last_ts, P + s["rows"], st.burst, st.open_start, st.b_open)
        else:
            bt = st.b_open + _ceil_div(P + s["f1"] - st.open_start, n)
            st = State(fk, fresh.last_ts, P + s["rows"], st.burst + fresh.burst - 1, P + fresh.open_start,
                       bt + (fresh.b_open - s["b_f1"]))
    return entry, st


def _apply(ts_col, n, gap, entry_bc, cols):
    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st = None
        started = False
        for batch in it:
            if batch.num_rows == 0:
                continue
            if not started:
                t = entry_bc.value.get(batch.column(PID)[0].as_py())
                st = State(*t) if t is not None else None
                started = True
            key, ts, carry = _arrays(batch, ts_col)
            out, st, _, _, _ = _scan(key, ts, st, n, gap, carry)
            data = batch.select(cols) if carry is None else batch.select(cols).filter(pa.array(~carry["is"]))
            yield pa.RecordBatch.from_arrays(
                [*data.columns, *[pa.array(out[k], pa.int64()) for k in OUT_FIELDS]], names=[*cols, *OUT_FIELDS])
    return fn


def _ends(ts_col, n, gap, entry_bc):
    """Where each key stood at the end of each Arrow batch that holds rows of it."""
    def fn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        st, started = None, False
        for batch in it:
            if batch.num_rows == 0:
                continue
            if not started:
                t = entry_bc.value.get(batch.column(PID)[0].as_py())
                st = State(*t) if t is not None else None
                started = True
            key, ts, carry = _arrays(batch, ts_col)
            _, st, _, _, ends = _scan(key, ts, st, n, gap, carry)
            yield pa.RecordBatch.from_arrays([pa.array(ends["key"], pa.string()), *[pa.array(ends[c], pa.int64()) for c in NUMBERS]],
                                             names=["key", *NUMBERS])
    return fn


TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def target_partitions(df: DataFrame) -> int:
    """Range partitions for the numbering: the file sizes of the scans (not
    the estimate of a join, which is a product) divided by ~256 MB, and at
    least ``spark.sql.shuffle.partitions``, which also holds where a leaf has
    no size. (An explicit count is needed: AQE may merge range partitions but
    never splits them.)"""
    spark = df.sparkSession
    floor_ = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plan = df._jdf.queryExecution().optimizedPlan()
    leaves = plan.collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    unknown = int(spark.conf.get("spark.sql.defaultSizeInBytes", str((1 << 63) - 1)))
    if any(s >= unknown for s in sizes):
        return floor_
    size = min(sum(sizes), int(str(plan.stats().sizeInBytes())))  # a narrow projection is smaller than its scan
    return max(floor_, -(-size // TARGET_PARTITION_BYTES))


def number_arrivals(df: DataFrame, order_cols: Sequence[str], key_cols: Sequence[str] = (),
                    batch_size: int | None = None, gap_seconds: float | None = None,
                    ts_col: str | None = None, num_partitions: int | None = None,
                    initial: State | None = None, exit_state: list | None = None) -> DataFrame:
    """Adds ``arrival_pos``, ``burst``, ``pos_in_burst``, ``batch_num`` and
    ``pos_in_batch`` (all 1-based, per key). ``order_cols`` must make the
    order total within a key (end with a unique id). ``ts_col`` (timestamp)
    measures gaps when ``gap_seconds`` is set; ``batch_size`` None means only
    gaps cut batches.

    ``initial`` continues an earlier numbering (stream form, one key); when
    ``exit_state`` is a list, the state after the last row is appended to it."""
    n, gap = _limits(batch_size, gap_seconds, ts_col)
    sort_cols = [*key_cols, *order_cols]
    parts = num_partitions or target_partitions(df)
    stable, entry_bc, last = _stable(df.withColumn(KEY, key_text(df, key_cols)), parts, sort_cols, ts_col, n, gap, initial)
    if exit_state is not None:
        exit_state.append(last)
    return stable.mapInArrow(_apply(ts_col, n, gap, entry_bc, df.columns), _numbered_schema(df))


def _limits(batch_size, gap_seconds, ts_col):
    if gap_seconds is not None and ts_col is None:
        raise ValueError("gap_seconds needs ts_col")
    return int(batch_size) if batch_size else UNBOUNDED, None if gap_seconds is None else int(round(gap_seconds * 1_000_000))


def _numbered_schema(df: DataFrame) -> T.StructType:
    return T.StructType(list(df.schema.fields) + [T.StructField(k, T.LongType(), False) for k in OUT_FIELDS])


def _stable(keyed: DataFrame, parts: int, sort_cols: Sequence[str], ts_col, n, gap, initial):
    """(checkpointed ranges with their numbers, broadcast entry states, state after the last row)."""
    spark = keyed.sparkSession
    ensure_checkpoint_dir(spark)
    stable = keyed.repartitionByRange(parts, *sort_cols).sortWithinPartitions(*sort_cols).checkpoint(eager=True)
    with_pid = stable.withColumn(PID, F.spark_partition_id())
    needed = with_pid.select(*[c for c in (KEY, PID, CARRIED, ts_col) if c in with_pid.columns])
    summ = needed.mapInArrow(_summaries(ts_col, n, gap), SUMMARY_SCHEMA).collect()
    entry, last = _fold([r.asDict() for r in summ], n, gap, initial)
    # one small state per partition: shipped once per executor, not per task
    # (plain tuples: broadcast values are unpickled without this package)
    entry_bc = spark.sparkContext.broadcast(
        {pid: (None if st is None else (st.key, st.last_ts, st.pos, st.burst, st.open_start, st.b_open))
         for pid, st in entry.items()})
    return with_pid, entry_bc, last


def continue_arrivals(df: DataFrame, order_cols: Sequence[str], key_cols: Sequence[str], carry: DataFrame | None, *,
                      batch_size: int | None = None, gap_seconds: float | None = None, ts_col: str | None = None,
                      num_partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``number_arrivals`` of rows whose keys have earlier rows elsewhere.

    ``carry`` (``CARRY_SCHEMA``, one row per key) says where each key stopped;
    its rows are dealt out with the data, each before the rows of its key, so
    every key's state meets its first row wherever the ranges are cut, and a
    key that holds most of the rows is still split over many ranges.

    Returns the numbered rows and the carry after them, for every key in
    ``df`` or ``carry``."""
    n, gap = _limits(batch_size, gap_seconds, ts_col)
    spark = df.sparkSession
    carry = spark.createDataFrame([], CARRY_SCHEMA) if carry is None else carry
    numbers = F.struct(*[F.col(c) for c in NUMBERS])
    told = carry.select(F.col("key").alias(KEY), numbers.alias(CARRIED))
    data = df.withColumns({KEY: key_text(df, key_cols), CARRIED: F.lit(None).cast(told.schema[CARRIED].dataType)})
    both = data.unionByName(told, allowMissingColumns=True).withColumn("__data", F.col(CARRIED).isNull())
    stable, entry_bc, _ = _stable(both, num_partitions or target_partitions(df), [KEY, "__data", *order_cols], ts_col, n, gap, None)
    numbered = stable.drop("__data").mapInArrow(_apply(ts_col, n, gap, entry_bc, df.columns), _numbered_schema(df))
    needed = stable.select(*[c for c in (KEY, PID, CARRIED, ts_col) if c in stable.columns])
    ends = needed.mapInArrow(_ends(ts_col, n, gap, entry_bc), CARRY_SCHEMA)
    return numbered, latest(ends)


def latest(states: DataFrame) -> DataFrame:
    """The furthest of several states of each key."""
    return states.groupBy("key").agg(F.max_by(F.struct(*NUMBERS), "pos").alias("s")).select("key", "s.*")


def batch_progress(numbered: DataFrame, key_cols: Sequence[str] = ()) -> DataFrame:
    """Per dispatched batch: size and rows seen so far (batches are
    contiguous in arrival order, so rows seen = the batch's last position).
    A grouped aggregate; no running window."""
    return numbered.groupBy(*key_cols, "batch_num").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max("arrival_pos").alias("rows_seen"))


def leftover_rows(numbered: DataFrame, batch_size: int, key_cols: Sequence[str] = ()) -> DataFrame:
    """Rows still buffered at stop: the last batch of each key when it holds
    fewer than ``batch_size`` rows (the count trigger never fired for it)."""
    end = numbered.groupBy(*key_cols).agg(F.max(F.struct("batch_num", "pos_in_batch")).alias("end"))
    tail = end.where(F.col("end.pos_in_batch") < batch_size).select(
        *[F.col(k).alias(f"__k{i}") for i, k in enumerate(key_cols)], F.col("end.batch_num").alias("__batch"))
    same = F.col("batch_num") == F.col("__batch")
    for i, k in enumerate(key_cols):
        same = same & numbered[k].eqNullSafe(F.col(f"__k{i}"))
    return numbered.join(tail, same, "left_semi")
