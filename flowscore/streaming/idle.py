"""Batches of a live stream that close by themselves: by count, by idleness, at stop.

Per key, rows wait in an open batch. It closes with its ``batch_size``-th row
("count"), when the next row arrives at least ``gap`` after the last one
("idle"), when no row arrives for ``gap`` of processing time ("idle", by a
timer, as the watcher's clock does), or when the stream stops and the caller
asks for it ("stop"). A closed batch is emitted once, whole. Open rows, the
key's counters and its timer live in the state store and survive a restart.

Calls to the store cost more than a row, so keys are dealt out in buckets by a
hash and a bucket is one group of the stream (``OpenBuckets``): one trigger
reads its keys' states in one call, numbers the rows of all its keys at once
and appends the states that changed. The number of buckets stays with the
checkpoint; a task holds one bucket's states and its rows of the trigger, so
hundreds of millions of keys need more than the default. Without buckets every
key is a group of its own (``OpenBatches``).

The rows of a key within one trigger are put in order by the order columns;
over triggers, in order of arrival. Times are compared as event times; no
watermark is kept, so late rows are never dropped. A key's rows of one trigger
(and those of its bucket) meet in one task, bounded by the trigger; ``stream_micro_batches_keyed`` is the
form that splits a hot key (it numbers rows but holds no batch back).

A key without rows for ``expire_seconds`` is forgotten: its state goes, and
should it come back its batches are numbered from 1 again; ``since`` (the
processing time of its first row, in ms) tells such lives apart.

Rows travel as one JSON text per row, made and parsed by Spark, so no value
passes through pandas: longs with nulls, decimals and timestamps stay exact.
A null key is a key of its own; a row without a time ends no batch by its gap.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from flowscore.operators import arrival as ARR
from flowscore.streaming import stream as STR

COUNT, IDLE, STOP = "count", "idle", "stop"
PROVIDER_CONF = "spark.sql.streaming.stateStore.providerClass"
NO_DATA_CONF = "spark.sql.streaming.noDataMicroBatches.enabled"
PARTITIONS_CONF = "spark.sql.shuffle.partitions"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_CLOCK = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
JSON = {"timestampFormat": _CLOCK + "XXX", "timestampNTZFormat": _CLOCK, "dateFormat": "yyyy-MM-dd"}
CLOSED = "key string, since long, batch_num long, pos_in_batch long, rows_seen long, reason string, row string"
FIELDS = ("since", "batch_num", "pos_in_batch", "rows_seen", "reason")


class OpenBatches(StatefulProcessor):
    """The open batch, counters and timer of one key; see the module."""

    def __init__(self, batch_size: int, gap_us: int, expire_ms: int | None, order: Sequence[str]):
        self.n, self.gap, self.expire_ms, self.order = batch_size, gap_us, expire_ms, list(order)

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "pos_in_batch long, row string")
        self.carry = handle.getValueState("carry", "since long, last_ts long, pos long, burst long, open_start long, b_open long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a micro-batch has few rows of a key: numpy and few calls to the store, for each costs more than a row
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        new = _sorted(parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True), self.order)
        now = timerValues.getCurrentProcessingTimeInMs()
        since, st = self._state(key[0])
        first_rows = st is None
        held = [] if first_rows or (st.pos - st.open_start) % self.n == 0 else list(self.open.get())
        waits = self._batch(st) if held else 0
        times = new["ts"].to_numpy()
        times = times.astype("datetime64[us]").astype(np.int64) if times.dtype.kind == "M" else times.astype(np.int64)
        out, st, _, _, _ = ARR._scan(np.full(len(new), key[0], dtype=object), times, st, self.n, self.gap)
        batch = np.append(np.full(len(held), waits, np.int64), out["batch_num"])
        pos = np.append(np.array([h[0] for h in held], np.int64), out["pos_in_batch"])
        row = np.empty(len(batch), object)
        row[:] = [h[1] for h in held] + new["row"].tolist()
        full = np.bincount(batch - batch.min())[batch - batch.min()] == self.n
        done = full | (batch < self._batch(st))
        rest = np.flatnonzero(~done)
        if len(rest):
            self.open.put(list(zip(pos[rest].tolist(), row[rest])))
        elif held:
            self.open.clear()
        self._save(since or now, st, now, bool(len(rest)), first_rows)
        if done.any():  # the closed rows come first
            frame = {"batch_num": batch[done], "pos_in_batch": pos[done], "row": row[done]}
            yield self._rows(key[0], since or now, st.pos - len(batch), frame, np.where(full[done], COUNT, IDLE))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        since, st = self._state(key[0])
        if st is None:
            return
        held = list(self.open.get()) if self.open.exists() else []
        if held:
            batch = self._batch(st)
            frame = {"batch_num": np.full(len(held), batch, np.int64), "pos_in_batch": np.array([h[0] for h in held], np.int64),
                     "row": np.array([h[1] for h in held], object)}
            self.open.clear()
            # the next row opens a batch of its own, however close its time is
            closed = ARR.State(st.key, ARR.NO_TIME, st.pos, st.burst + 1, st.pos, batch)
            self._save(since, closed, timerValues.getCurrentProcessingTimeInMs(), False)
            yield self._rows(key[0], since, st.pos - len(held), frame, np.full(len(held), IDLE))
        elif self.expire_ms is not None:
            self.carry.clear()

    def close(self) -> None:
        pass

    def _batch(self, st: ARR.State) -> int:
        """The batch of the key's last row."""
        return st.b_open + (st.pos - 1 - st.open_start) // self.n + 1

    def _state(self, key: str):
        carry = self.carry.get()
        if carry is None:
            return None, None
        since, *numbers = carry
        return since, ARR.State(key, *numbers)

    def _save(self, since: int, st: ARR.State, now: int, waiting: bool, first_rows: bool = False) -> None:
        self.carry.update((since, st.last_ts, st.pos, st.burst, st.open_start, st.b_open))
        for t in () if first_rows else list(self.handle.listTimers()):  # a key without a state has no timer
            self.handle.deleteTimer(t)
        if waiting:
            self.handle.registerTimer(now + max(1, self.gap // 1000))
        elif self.expire_ms is not None:
            self.handle.registerTimer(now + self.expire_ms)

    @staticmethod
    def _rows(key, since, before, frame, reason) -> pd.DataFrame:
        n = len(reason)
        return pd.DataFrame({"key": np.full(n, key, object), "since": np.full(n, since, np.int64), "batch_num": frame["batch_num"],
                             "pos_in_batch": frame["pos_in_batch"], "rows_seen": before + np.arange(1, n + 1, dtype=np.int64),
                             "reason": reason.astype(object), "row": frame["row"]})


BUCKETS = 256  # groups of the stream
LOG_PARTS = 64  # that a bucket's states are spread over at most
STATE_PARTITIONS = 32  # at least, if the session's shuffles have as many: they stay with the checkpoint, cores may come later
_PART = pa.schema([("key", pa.large_string()), ("since", pa.int64()), *[(c, pa.int64()) for c in ARR.NUMBERS], ("due", pa.int64()),
                   ("held", pa.int64()), ("pos_in_batch", pa.large_binary()), ("row", pa.large_list(pa.large_string()))])
NEVER = 1 << 62


def _packed(states: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _PART) as to:
        to.write_table(states)
    return sink.getvalue().to_pybytes()


def _unpacked(part: bytes) -> pa.Table:
    return pa.ipc.open_stream(part).read_all()


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table[column].to_numpy()


def _codes(keys) -> tuple[np.ndarray, pa.Array]:
    """A number per key text, and the texts by number."""
    coded = pa.array(keys, pa.large_string()) if not isinstance(keys, pa.ChunkedArray) else keys.combine_chunks()
    coded = coded.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _latest(parts: Sequence[pa.Table]) -> pa.Table:
    """The newest state of every key; one without rows seen is that of a forgotten key and goes."""
    if not parts:
        return _PART.empty_table()
    table = pa.concat_tables(parts)
    if len(parts) > 1:
        code, keys = _codes(table["key"])
        last = np.zeros(len(keys), np.int64)
        np.maximum.at(last, code, np.arange(len(code)))
        table = table.take(np.sort(last))
    seen = _numbers(table, "pos") > 0
    return table if seen.all() else table.filter(seen)


def _batch_of(numbers, n: int) -> np.ndarray:
    """The batch of the last row of each key."""
    return numbers["b_open"] + (numbers["pos"] - 1 - numbers["open_start"]) // n + 1


def _states(keys, since, numbers, due, held, pos_in_batch, row) -> pa.Table:
    """States of keys; ``held`` rows each of the flat arrays of open rows, in the order of the keys."""
    edges = np.append(0, np.cumsum(held))
    whole = np.ascontiguousarray(pos_in_batch, np.int64).tobytes()
    places = pa.array([whole[8 * a: 8 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())], pa.large_binary())
    rows = pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), pa.array(row, pa.large_string()))
    return pa.table([keys, pa.array(since, pa.int64()), *[pa.array(numbers[c], pa.int64()) for c in ARR.NUMBERS], pa.array(due, pa.int64()),
                     pa.array(held, pa.int64()), places, rows], schema=_PART)


def _open_rows(states: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(state, place in the batch, row) of the open rows of all states."""
    held = _numbers(states, "held")
    places = np.frombuffer(b"".join(states["pos_in_batch"].to_pylist()), np.int64)
    return np.repeat(np.arange(len(held)), held), places, _objects(states["row"].combine_chunks().flatten())


def _objects(texts: pa.Array) -> np.ndarray:
    return texts.to_numpy(zero_copy_only=False).astype(object)


class OpenBuckets(StatefulProcessor):
    """The open batches, counters and next timer of all keys of a bucket.

    ``log`` holds the keys' states as Arrow tables: a trigger appends those that
    changed, the newest of a key counts, and the list is written anew when the
    appended ones outgrow the first. A bucket has one timer at most, which
    fires no later than the first of its keys is due."""

    def __init__(self, batch_size: int, gap_us: int, expire_ms: int | None, order: Sequence[str]):
        self.n, self.gap, self.expire_ms, self.order = batch_size, gap_us, expire_ms, list(order)

    def init(self, handle) -> None:
        self.handle = handle
        self.log = handle.getListState("log", "seq long, part binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [r for r in rows if len(r)]
        if not parts:
            return
        new = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
        new = _sorted(new.assign(code=_codes(new["key"])[0]), ["code", *self.order])
        now = timerValues.getCurrentProcessingTimeInMs()
        at, log, states = self._read()
        # keys by number, in the order of their rows; each key's state stands before its rows
        code = new["code"].to_numpy()
        first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        keys = pa.array(new["key"].to_numpy()[first], pa.large_string())
        count = np.diff(np.append(first, len(code)))
        code = np.repeat(np.arange(len(first)), count)
        found = pc.index_in(keys, value_set=states["key"].combine_chunks()).fill_null(-1).to_numpy(zero_copy_only=False)
        known = np.flatnonzero(found >= 0)
        old = states.take(found[known])
        before = {c: _numbers(old, c) for c in ARR.NUMBERS}
        since = np.full(len(keys), now, np.int64)
        since[known] = _numbers(old, "since")
        out, ends = self._scan(code, new["ts"].to_numpy(), known, before)
        # the open rows of these keys and the new ones
        state, places, texts = _open_rows(old)
        waits = _batch_of(before, self.n)
        code = np.concatenate([known[state], code])
        by_key = np.argsort(code, kind="stable")
        code = code[by_key]
        batch = np.concatenate([waits[state], out["batch_num"]])[by_key]
        pos = np.concatenate([places, out["pos_in_batch"]])[by_key]
        row = np.concatenate([texts, new["row"].to_numpy(object)])[by_key]
        run = np.cumsum(np.append(0, (code[1:] != code[:-1]) | (batch[1:] != batch[:-1])))
        full = np.bincount(run)[run] == self.n
        done = full | (batch < _batch_of(ends, self.n)[code])
        rows_of = np.bincount(code, minlength=len(keys))
        seen = ends["pos"][code] - rows_of[code] + np.arange(len(code)) - np.append(0, np.cumsum(rows_of))[code] + 1
        held = np.bincount(code[~done], minlength=len(keys))
        due = np.where(held > 0, now + max(1, self.gap // 1000), NEVER if self.expire_ms is None else now + self.expire_ms)
        self._write(at, log, states, _states(keys, since, ends, due, held, pos[~done], row[~done]), now)
        if done.any():
            yield self._closed(keys, since, code[done], batch[done], pos[done], seen[done], np.where(full[done], COUNT, IDLE), row[done])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        at, log, states = self._read()
        over = states.filter(_numbers(states, "due") <= now)
        if not len(over):
            self._timer(states, now)
            return
        numbers = {c: _numbers(over, c) for c in ARR.NUMBERS}
        since, held, keys = _numbers(over, "since"), _numbers(over, "held"), over["key"].combine_chunks()
        open_ = held > 0
        code, pos, row = _open_rows(over)
        batch = _batch_of(numbers, self.n)
        # the next row opens a batch of its own, however close its time is; a key without open rows is forgotten
        after = {"last_ts": np.full(len(over), ARR.NO_TIME), "pos": np.where(open_, numbers["pos"], 0), "burst": numbers["burst"] + 1,
                 "open_start": numbers["pos"], "b_open": batch}
        due = np.full(len(over), NEVER if self.expire_ms is None else now + self.expire_ms)
        due[~open_] = NEVER
        self._write(at, log, states, _states(keys, since, after, due, np.zeros(len(over), np.int64), [], []), now)
        if len(code):
            seen = (numbers["pos"] - held)[code] + np.arange(len(code)) - np.append(0, np.cumsum(held))[code] + 1
            yield self._closed(keys, since, code, batch[code], pos, seen, np.full(len(code), IDLE), row)

    def close(self) -> None:
        pass

    def _scan(self, code, times, known, before):
        """Numbers of the rows, and where each key stops."""
        times = times.astype("datetime64[us]").astype(np.int64) if times.dtype.kind == "M" else times.astype(np.int64)
        whole = np.concatenate([known, code])
        by_key = np.argsort(whole, kind="stable")
        carry = {c: np.append(before[c], np.zeros(len(code), np.int64))[by_key] for c in ARR.NUMBERS}
        carry["is"] = by_key < len(known)
        ts = np.append(np.zeros(len(known), np.int64), times)[by_key]
        out, _, _, _, ends = ARR._scan(whole[by_key], ts, None, self.n, self.gap, carry)
        return out, ends

    def _read(self):
        """(next number, sizes of the stored tables, newest states)."""
        stored = sorted((s[0], s[1]) for s in self.log.get()) if self.log.exists() else []
        parts = [_unpacked(bytes(p)) for _, p in stored]
        return stored[-1][0] + 1 if stored else 0, [len(p) for p in parts], _latest(parts)

    def _write(self, at: int, log: Sequence[int], states: pa.Table, changed: pa.Table, now: int) -> None:
        newest = _latest([states, changed])
        if not len(newest):
            self.log.clear()
        elif not log or len(log) >= LOG_PARTS or sum(log[1:]) + len(changed) >= log[0]:
            self.log.put([(at, _packed(newest))])
        else:
            self.log.appendValue((at, _packed(changed)))
        self._timer(newest, now)

    def _timer(self, states: pa.Table, now: int) -> None:
        due = int(_numbers(states, "due").min()) if len(states) else NEVER
        timers = [t for t in self.handle.listTimers() if t > now]  # one that is over fires in this trigger and is gone then
        if due < NEVER and (not timers or min(timers) > due):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(due)

    @staticmethod
    def _closed(keys, since, code, batch, pos, seen, reason, row) -> pd.DataFrame:
        return pd.DataFrame({"key": _objects(keys)[code], "since": since[code], "batch_num": batch, "pos_in_batch": pos, "rows_seen": seen,
                             "reason": reason.astype(object), "row": row})


def _unpack_log(batches):
    """A row per key and stored table; the open rows as lists."""
    for b in batches:
        for seq, part in zip(b.column("seq").to_pylist(), b.column("part")):
            states = _unpacked(part.as_buffer())
            places = [np.frombuffer(p, np.int64).tolist() for p in states["pos_in_batch"].to_pylist()]
            columns = [states["key"].cast(pa.string()).combine_chunks(), pa.array(np.full(len(states), seq, np.int64)),
                       *[states[c].combine_chunks() for c in ("since", "pos", "open_start", "b_open")], pa.array(places, pa.list_(pa.int64())),
                       states["row"].cast(pa.list_(pa.string())).combine_chunks()]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "seq", "since", "pos", "open_start", "b_open", "places", "rows"])


def _sorted(new: pd.DataFrame, order: Sequence[str]) -> pd.DataFrame:
    """The rows in the order of the columns; rows that are alike stay as they came."""
    if len(new) == 1:
        return new
    columns = [new[c].to_numpy() for c in order]
    if any(c.dtype == object for c in columns):
        return new.sort_values(list(order), kind="mergesort")
    at = np.lexsort(columns[::-1])
    return new if (at[1:] > at[:-1]).all() else new.iloc[at]


def _prepared(rows: DataFrame, key_cols, order_cols, ts_col: str):
    """(key, ts, order columns, row) of the arriving rows, and the names of the order columns.

    A null in an order column sorts first; it comes as a flag and a stand-in of
    the same type, so that pandas never turns a long into a float."""
    stand_in = {"string": "", "boolean": False}
    cols, names = [], []
    for i, c in enumerate(order_cols):
        kind, value = rows.schema[c].dataType, F.col(f"`{c}`")
        if isinstance(kind, (T.TimestampType, T.DateType)):
            value, kind = F.unix_micros(value.cast("timestamp")), T.LongType()
        some = value.isNotNull().cast("int").alias(f"o{i}s")
        if not isinstance(kind, T.TimestampNTZType):  # datetimes have a null of their own, and NaT is told by the flag
            value = F.coalesce(value, F.lit(stand_in.get(kind.simpleString(), 0)).cast(kind))
        cols += [some, value.alias(f"o{i}")]
        names += [f"o{i}s", f"o{i}"]
    ts = F.col(f"`{ts_col}`")
    if isinstance(rows.schema[ts_col].dataType, T.TimestampType):
        ts = F.coalesce(F.unix_micros(ts), F.lit(ARR.NO_TIME))
    row = F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns]), {**JSON, "ignoreNullFields": "false"})
    return rows.select(ARR.key_text(rows, key_cols).alias("key"), ts.alias("ts"), *cols, row.alias("row")), names


def _parsed(closed: DataFrame, schema: T.StructType) -> DataFrame:
    return closed.withColumn("row", F.from_json("row", schema, JSON)).select("row.*", *FIELDS)


def stream_open_batches(spark: SparkSession, landing: str, schema: T.StructType, key_cols: Sequence[str], order_cols: Sequence[str], ts_col: str,
                        batch_size: int, gap_seconds: float, out: str, checkpoint: str, *, expire_seconds: float | None = None,
                        processing_time: str | None = None, files_per_trigger: int | None = None, buckets: int | None = BUCKETS):
    """Emit the closed batches of a landing folder's rows under ``out/epoch=<id>``.

    Drains what is there; with ``processing_time`` the query keeps polling (and
    its timers close idle batches) and the running query is returned.
    ``buckets``: groups that the keys are dealt out in, the same at every start
    from one checkpoint; None: every key is one (the form of older checkpoints)."""
    processor_args = int(batch_size), int(round(gap_seconds * 1_000_000)), None if expire_seconds is None else int(expire_seconds * 1000)
    rows, order = _prepared(STR._reader(spark, landing, schema, files_per_trigger), key_cols, order_cols, ts_col)
    if buckets is None:
        groups, processor = rows.groupBy("key"), OpenBatches(*processor_args, order)
    else:
        groups = rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(int(buckets)))).groupBy("bucket")
        processor = OpenBuckets(*processor_args, order)
    closed = groups.transformWithStateInPandas(processor, outputStructType=CLOSED, outputMode="Append", timeMode="ProcessingTime")

    def per_batch(batch: DataFrame, batch_id: int):
        _parsed(batch, schema).write.mode("overwrite").parquet(f"{out}/epoch={batch_id}")

    # timers need a store with column families (the checkpoint remembers it); a drain ends with
    # the rows, where a running query goes on without new rows, for its timers
    confs = {PROVIDER_CONF: PROVIDER, NO_DATA_CONF: str(processing_time is not None).lower()}
    if buckets is not None:  # a state partition costs a trigger more than a partition of a shuffle
        confs[PARTITIONS_CONF] = str(min(int(spark.conf.get(PARTITIONS_CONF)), max(STATE_PARTITIONS, spark.sparkContext.defaultParallelism)))
    before = {c: spark.conf.get(c, None) for c in confs}
    for c, v in confs.items():
        spark.conf.set(c, v)
    try:
        return STR._run(closed.writeStream.outputMode("append").foreachBatch(per_batch), checkpoint, processing_time)
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)


def flush_open(spark: SparkSession, checkpoint: str, schema: T.StructType, batch_size: int) -> DataFrame:
    """The batches still open in a stopped stream's state, with the reason "stop".

    A look at the state, not a change of it: a restarted stream goes on with the
    same open rows, which then come again in their whole batch. So the result
    of a run is its closed batches and the flush of its last stop."""
    state = spark.read.format("statestore").option("path", checkpoint)
    kept = spark.read.format("state-metadata").load(checkpoint).select("operatorProperties").first()[0]
    if '"log"' in kept:  # buckets of keys
        log = state.option("stateVarName", "log").load().select("list_element.*")
        states = log.mapInArrow(_unpack_log, "key string, seq long, since long, pos long, open_start long, b_open long, places array<long>, rows array<string>")
        newest = states.groupBy("key").agg(F.max_by(F.struct(*[c for c in states.columns if c not in ("key", "seq")]), "seq").alias("s")).select("key", "s.*")
        return _flushed(newest.select("*", F.inline(F.arrays_zip(F.col("places").alias("pos_in_batch"), F.col("rows").alias("row")))), schema, batch_size)
    carry = state.option("stateVarName", "carry").load().select("key.key", "value.*")
    rows = state.option("stateVarName", "open").load().select("key.key", "list_element.*")
    return _flushed(rows.join(carry, "key"), schema, batch_size)


def _flushed(open_rows: DataFrame, schema: T.StructType, batch_size: int) -> DataFrame:
    batch = F.col("b_open") + F.floor((F.col("pos") - 1 - F.col("open_start")) / int(batch_size)) + 1
    first = F.col("pos") - F.col("open_start") - (batch - 1 - F.col("b_open")) * int(batch_size)  # rows of the open batch
    open_ = open_rows.select(
        "key", "since", batch.alias("batch_num"), "pos_in_batch", (F.col("pos") - first + F.col("pos_in_batch")).alias("rows_seen"),
        F.lit(STOP).alias("reason"), "row")
    return _parsed(open_, schema)


def read_batches(spark: SparkSession, out: str, schema: T.StructType) -> DataFrame:
    """All closed batches that a stream has written."""
    fields = {"since": "long", "batch_num": "long", "pos_in_batch": "long", "rows_seen": "long", "reason": "string"}
    whole = T.StructType([*schema.fields, *[T.StructField(c, T.LongType() if t == "long" else T.StringType()) for c, t in fields.items()]])
    fs, folders = STR._file_system(spark, f"{out}/epoch=*")
    if not fs.globStatus(folders):  # no batch has been written yet
        return spark.createDataFrame([], whole)
    return spark.read.schema(whole).option("basePath", out).parquet(f"{out}/epoch=*").select(*[f"`{c}`" for c in whole.names])
