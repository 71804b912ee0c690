"""Batches of streams: carried key states, idle timers, stop flush, restarts."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowscore.operators import arrival as ARR
from flowscore.streaming import idle as IDLE
from flowscore.streaming import stream as STR

SCHEMA = "k string, id long, ts timestamp_ntz, big long, x double"


def rows(n, seed, start=0):
    rng = random.Random(seed)
    out, t = [], start
    for i in range(n):
        t += rng.choice([0, 1, 1, 2, 9])
        k = rng.choice(["hot", "hot", "hot", None, "a", "b", f"u{rng.randrange(40)}"])
        out.append((k, start * 1000 + i, t, None if i % 5 == 0 else 2**53 + i, rng.choice([float("nan"), float("inf"), -0.0, 1.1])))
    return out


def frame(spark, data, unit=1):
    from datetime import datetime, timedelta
    zero = datetime(2024, 1, 1)
    return spark.createDataFrame([(k, i, zero + timedelta(seconds=t * unit), b, x) for k, i, t, b, x in data], SCHEMA)


def plain(data, n, gap):
    """(key, id) -> (burst, batch_num, pos_in_batch), row by row."""
    state, out = {}, {}
    for k, i, t, *_ in sorted(data, key=lambda r: (r[2], r[1])):
        last, burst, batch, pos = state.get(k, (None, 0, 0, 0))
        if last is None or t - last >= gap:
            burst, batch, pos = burst + 1, batch + 1, 1
        elif pos == n:
            batch, pos = batch + 1, 1
        else:
            pos += 1
        state[k] = (t, burst, batch, pos)
        out[k, i] = (burst, batch, pos)
    return out


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_carried_states_meet_their_rows(spark, parts):
    data = rows(900, 3)
    want = plain(data, 4, 5)
    cuts, carry, got = [0, 1, 250, 251, 600, 900], None, {}
    for lo, hi in zip(cuts, cuts[1:]):
        piece = frame(spark, data[lo:hi]).repartition(3)
        numbered, carry = ARR.continue_arrivals(piece, ["ts", "id"], ["k"], carry, batch_size=4, gap_seconds=5, ts_col="ts", num_partitions=parts)
        got |= {(r.k, r.id): (r.burst, r.batch_num, r.pos_in_batch) for r in numbered.collect()}
        carry = spark.createDataFrame(carry.collect(), ARR.CARRY_SCHEMA)
    assert got == want
    assert carry.count() == len({k for k, _ in want})


def test_hot_key_is_split_and_bounded(spark):
    hot = [("hot", i, i, i, 0.0) for i in range(6000)] + [(f"u{i}", 9000 + i, i, i, 0.0) for i in range(3000)]
    carry = spark.createDataFrame([('["hot"]', -9_000_000, 7, 1, 0, 0), ('["gone"]', 0, 3, 1, 0, 0)], ARR.CARRY_SCHEMA)
    n, states = ARR.continue_arrivals(frame(spark, hot), ["ts", "id"], ["k"], carry, batch_size=5, gap_seconds=5, ts_col="ts", num_partitions=30)
    size = n.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(size) >= 20 and max(r["count"] for r in size) < 3 * 9000 / 30
    assert {r["key"]: r["pos"] for r in states.filter("key in ('[\"hot\"]', '[\"gone\"]')").collect()} == {'["hot"]': 6007, '["gone"]': 3}


def land(spark, data, path, unit=1):
    frame(spark, data, unit).coalesce(1).write.mode("append").parquet(path)


def test_landing_is_one_ordered_write(spark, tmp_path):
    path = str(tmp_path / "in")
    df = frame(spark, rows(500, 1)).withColumn("ts", F.when(F.col("id") % 9 != 0, F.col("ts")))
    STR.land_in_time_order(df, "ts", path, rows_per_file=60)
    import glob
    import os
    files = sorted(glob.glob(path + "/part-*.parquet"), key=os.path.getmtime)
    assert len(files) > 5 and len({os.path.getmtime(f) for f in files}) == len(files)
    lows = [spark.read.parquet(f).agg(F.min("ts"), F.max("ts"), F.count("*")).first() for f in files]
    assert sum(r[2] for r in lows) == 500
    known = [r for r in lows if r[0] is not None]
    assert all(a[1] <= b[0] for a, b in zip(known, known[1:]))


def test_more_rows_land_in_larger_files_not_in_more(spark, tmp_path):
    counts = []
    for n in (200, 2000):
        path = str(tmp_path / f"in{n}")
        STR.land_in_time_order(frame(spark, rows(n, 1)), "ts", path, rows_per_file=10, slices=12)
        counts.append(len(list((tmp_path / f"in{n}").glob("part-*.parquet"))))
        assert spark.read.parquet(path).count() == n
    assert max(counts) <= 12


def test_ranges_of_a_micro_batch_follow_its_rows(spark, tmp_path, monkeypatch):
    data = rows(900, 7)
    land(spark, data, str(tmp_path / "in"))
    seen, whole = [], ARR.continue_arrivals

    def spy(*args, num_partitions, **named):
        seen.append(num_partitions)
        return whole(*args, num_partitions=num_partitions, **named)
    monkeypatch.setattr(ARR, "continue_arrivals", spy)
    for i, per in enumerate((50_000, 100)):
        monkeypatch.setattr(STR, "ROWS_PER_RANGE", per)
        got = STR.stream_micro_batches_keyed(spark, str(tmp_path / "in"), frame(spark, []).schema, "k", ["ts", "id"], "ts", 4, 5.0,
                                             str(tmp_path / f"out{i}"), str(tmp_path / f"ckpt{i}"))
        assert {(r.k, r.id): (r.burst, r.batch_num, r.pos_in_batch) for r in got.collect()} == plain(data, 4, 5)
    assert seen == [1, 9]


def test_keyed_stream_restarts_compacts_and_keeps_longs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(STR, "COMPACT", 3)
    data = rows(1200, 5)
    landing, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    want = plain(data, 5, 5)
    for lo in range(0, 1200, 150):  # eight micro-batches, the query is stopped between them
        land(spark, data[lo: lo + 150], landing)
        got = STR.stream_micro_batches_keyed(spark, landing, frame(spark, []).schema, "k", ["ts", "id"], "ts", 5, 5.0, out, ckpt)
    got = got.collect()
    assert {(r.k, r.id): (r.burst, r.batch_num, r.pos_in_batch) for r in got} == want and len(got) == 1200
    big = {(k, i): b for k, i, _, b, _ in data}
    assert all(r.big == big[r.k, r.id] for r in got)
    left = {p.name for p in (tmp_path / "ckpt" / "numbering-state").iterdir()}
    assert left == {"base=5", "delta=6", "delta=7"}


def test_replayed_batch_reads_the_same_states(spark, tmp_path):
    log = STR.CarryLog(spark, str(tmp_path / "log"))
    one = spark.createDataFrame([("a", 1, 1, 1, 0, 0)], ARR.CARRY_SCHEMA)
    two = spark.createDataFrame([("a", 2, 5, 1, 0, 0), ("b", 2, 1, 1, 0, 0)], ARR.CARRY_SCHEMA)
    log.save(0, one)
    log.save(1, two)
    log.save(1, two)  # again after a failure
    assert {r["key"]: r["pos"] for r in log.before(1).collect()} == {"a": 1}
    assert {r["key"]: r["pos"] for r in log.before(2).collect()} == {"a": 5, "b": 1}


def closed_as(got):
    return {(r.k, r.id): (r.batch_num, r.pos_in_batch, r.reason) for r in got}


def test_open_batches_over_a_restart(spark, tmp_path):
    data = rows(700, 9)
    landing, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    schema = frame(spark, []).schema
    want = plain(data, 4, 5)
    seen = {}
    for lo in range(0, 700, 175):
        land(spark, data[lo: lo + 175], landing, unit=1000)  # gaps far beyond the time that the test takes
        IDLE.stream_open_batches(spark, landing, schema, ["k"], ["ts", "id"], "ts", 4, 5000.0, out, ckpt)
    closed = IDLE.read_batches(spark, out, schema).collect()
    open_ = IDLE.flush_open(spark, ckpt, schema, 4).collect()
    got = closed_as(closed) | closed_as(open_)
    assert len(closed) + len(open_) == 700 and {k: v[:2] for k, v in got.items()} == {k: v[1:] for k, v in want.items()}
    size, last = {}, {}
    for (k, _), (_, batch, _) in want.items():
        size[k, batch] = size.get((k, batch), 0) + 1
        last[k] = max(last.get(k, 0), batch)
    for (k, _), (batch, _, reason) in got.items():
        assert reason == ("count" if size[k, batch] == 4 else "stop" if batch == last[k] else "idle")
    for k, i, *_ in sorted(data, key=lambda r: (r[2], r[1])):
        seen[k, i] = 1 + sum(1 for x in seen if x[0] == k)
    assert all(r.rows_seen == seen[r.k, r.id] for r in [*closed, *open_])
    exact = {(k, i): (b, x) for k, i, _, b, x in data}
    for r in [*closed, *open_]:
        b, x = exact[r.k, r.id]
        assert r.big == b and (r.x == x or np.isnan(r.x) and np.isnan(x))


def wait(ready, seconds=60):
    end = time.time() + seconds
    while time.time() < end and not ready():
        time.sleep(0.5)
    return ready()


def test_timer_closes_an_idle_batch_and_forgets_a_dead_key(spark, tmp_path):
    landing, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    schema = frame(spark, []).schema
    land(spark, [("a", 1, 0, 1, 0.5), ("a", 2, 1, 1, 0.5), ("b", 3, 1, 1, 0.5)], landing)
    q = IDLE.stream_open_batches(spark, landing, schema, ["k"], ["ts", "id"], "ts", 4, 3.0, out, ckpt, expire_seconds=4, processing_time="200 milliseconds")
    try:
        assert wait(lambda: len(IDLE.read_batches(spark, out, schema).collect()) == 3)  # no new rows: the clock closed them
        assert closed_as(IDLE.read_batches(spark, out, schema).collect()) == {("a", 1): (1, 1, "idle"), ("a", 2): (1, 2, "idle"), ("b", 3): (1, 1, "idle")}
        land(spark, [("a", 4, 2, 1, 0.5)], landing)  # close in time, but its batch has gone
        assert wait(lambda: ("a", 4) in closed_as(IDLE.read_batches(spark, out, schema).collect()))
        time.sleep(9)  # both keys expire
        land(spark, [("a", 5, 3, 1, 0.5)], landing)
        assert wait(lambda: ("a", 5) in closed_as(IDLE.read_batches(spark, out, schema).collect()))
    finally:
        q.stop()
    got = {(r.k, r.id): r for r in IDLE.read_batches(spark, out, schema).collect()}
    assert (got["a", 4].batch_num, got["a", 4].rows_seen) == (2, 3)
    assert (got["a", 5].batch_num, got["a", 5].rows_seen) == (1, 1) and got["a", 5].since > got["a", 4].since


def test_few_store_calls_for_the_rows_of_a_key():
    import pandas as pd
    calls = []

    class Fake:
        def __init__(self, name, value=None):
            self.name, self.value = name, value

        def __getattr__(self, what):
            def call(*args):
                calls.append(f"{self.name}.{what}")
                if what in ("put", "update"):
                    self.value = args[0]
                if what == "clear":
                    self.value = [] if self.name == "open" else None
                return self.value is not None if what == "exists" else iter(self.value or []) if self.name == "open" else self.value
            return call

    def took(p, ids):
        calls.clear()
        new = pd.DataFrame({"ts": ids, "o0s": 1, "o0": ids, "row": [f"r{i}" for i in ids]})
        clock = type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: 9})()
        return [tuple(r) for f in p.handleInputRows(("k",), iter([new]), clock) for r in f[["batch_num", "pos_in_batch", "rows_seen", "reason", "row"]].to_numpy()]

    p = IDLE.OpenBatches(3, 100, None, ["o0s", "o0"])
    p.handle, p.open, p.carry = Fake("timers", []), Fake("open", []), Fake("carry")
    assert took(p, [2, 1]) == [] and p.open.value == [(1, "r1"), (2, "r2")]
    assert sorted(calls) == ["carry.get", "carry.update", "open.put", "timers.registerTimer"]
    assert took(p, [3]) == [(1, 1, 1, "count", "r1"), (1, 2, 2, "count", "r2"), (1, 3, 3, "count", "r3")] and p.open.value == []
    assert took(p, [4, 200]) == [(2, 1, 4, "idle", "r4")] and p.open.value == [(1, "r200")]
    assert "open.get" not in calls  # nothing was open
    assert took(p, [201, 202, 203]) == [(3, 1, 5, "count", "r200"), (3, 2, 6, "count", "r201"), (3, 3, 7, "count", "r202")]


class Store:
    """A state variable, and the calls to it."""

    def __init__(self, calls):
        self.calls, self.value = calls, []

    def __getattr__(self, what):
        def call(*args):
            self.calls.append(what)
            if what in ("put", "clear"):
                self.value = list(args[0]) if args else []
            if what == "appendValue":
                self.value.append(args[0])
            if what == "update":
                self.value = [args[0]]
            return bool(self.value) if what == "exists" else (self.value[0] if self.value else None) if what == "valueGet" else iter(list(self.value))
        return call


class Timers:
    def __init__(self):
        self.at = set()

    def listTimers(self):
        return iter(sorted(self.at))

    def registerTimer(self, t):
        self.at.add(t)

    def deleteTimer(self, t):
        self.at.discard(t)


def clock(now):
    return type("Clock", (), {"getCurrentProcessingTimeInMs": lambda self: now})()


def arriving(data):
    import pandas as pd
    keys, ts, ids = zip(*data)
    return pd.DataFrame({"key": keys, "ts": ts, "o0s": 1, "o0": ids, "row": [f"r{i}" for i in ids]})


def told(frames):
    return sorted(tuple(r) for f in frames for r in f[["key", "since", "batch_num", "pos_in_batch", "rows_seen", "reason", "row"]].to_numpy().tolist())


def fire(p, key, now):
    """What the timers that are over give; a timer goes once it was handled."""
    out = []
    for t in [t for t in p.handle.listTimers() if t <= now]:
        out += list(p.handleExpiredTimer((key,), clock(now), None))
        p.handle.deleteTimer(t)
    return out


@pytest.mark.parametrize("expire_ms, log_parts", [(None, 64), (700, 64), (700, 2)])
def test_a_bucket_closes_what_its_keys_would_close_alone(monkeypatch, expire_ms, log_parts):
    monkeypatch.setattr(IDLE, "LOG_PARTS", log_parts)
    rng = random.Random(4)
    args = 3, 100_000, expire_ms, ["o0s", "o0"]
    bucket = IDLE.OpenBuckets(*args)
    bucket.handle, bucket.log = Timers(), Store([])
    alone = {}
    now = ids = ts = closed = 0
    for trigger in range(120):
        now += rng.choice([1, 30, 90, 400, 900])
        hot = rng.choice([3, 40])  # few of the keys get rows in some triggers
        data = []
        for _ in range(rng.choice([0, 1, 4, 60])):
            ids, ts = ids + 1, ts + rng.choice([0, 10, 5_000, 120_000])
            data.append((f"k{rng.randrange(hot)}", IDLE.ARR.NO_TIME if rng.random() < 0.1 else ts, ids))
        rng.shuffle(data)
        want, got = [], []
        if data:
            got += list(bucket.handleInputRows((1,), iter([arriving(d) for d in (data[:3], data[3:]) if d]), clock(now)))
        for k in sorted({k for k, *_ in data}):
            if k not in alone:
                p = alone[k] = IDLE.OpenBatches(*args)
                p.handle, p.open, p.carry = Timers(), Store([]), Store([])
                p.carry.get = lambda c=p.carry: c.value[0] if c.value else None
            want += list(alone[k].handleInputRows((k,), iter([arriving([r for r in data if r[0] == k]).drop(columns="key")]), clock(now)))
        got += fire(bucket, 1, now)
        for k, p in alone.items():
            want += fire(p, k, now)
        assert told(got) == told(want)
        closed += len(told(got))
        known = {k: IDLE.ARR.State(k, *p.carry.value[0][1:]) for k, p in alone.items() if p.carry.value}
        states = bucket._read()[2].to_pylist()
        assert {s["key"]: tuple(s[c] for c in IDLE.ARR.NUMBERS) for s in states} == {k: tuple(getattr(s, c) for c in IDLE.ARR.NUMBERS) for k, s in known.items()}
        assert {s["key"]: s["row"] for s in states} == {k: [r for _, r in p.open.value] for k, p in alone.items() if k in known}
        assert len(bucket.log.value) <= log_parts and len(bucket.handle.at) <= 1
    assert closed > 500


def test_the_keys_of_a_bucket_share_the_calls_to_the_store():
    def calls_for(keys):
        calls = []
        p = IDLE.OpenBuckets(3, 100, None, ["o0s", "o0"])
        p.handle, p.log = Timers(), Store(calls)
        for trigger in range(3):
            list(p.handleInputRows((1,), iter([arriving([(f"k{i}", trigger, trigger * keys + i) for i in range(keys)])]), clock(trigger)))
        return len(calls)
    assert calls_for(2000) == calls_for(1) <= 9


def test_the_number_of_buckets_changes_nothing_that_closes(spark, tmp_path):
    data = rows(400, 11)
    landing, schema = str(tmp_path / "in"), frame(spark, []).schema
    got = {}
    for buckets in (None, 1, 7):
        for lo in (0, 200):
            if buckets is None:
                land(spark, data[lo: lo + 200], f"{landing}{lo}", unit=1000)
            out, ckpt = str(tmp_path / f"out{buckets}-{lo}"), str(tmp_path / f"ckpt{buckets}-{lo}")
            IDLE.stream_open_batches(spark, f"{landing}{lo}", schema, ["k"], ["ts", "id"], "ts", 4, 5000.0, out, ckpt, files_per_trigger=1, buckets=buckets)
            both = IDLE.read_batches(spark, out, schema).unionByName(IDLE.flush_open(spark, ckpt, schema, 4)).collect()
            got.setdefault(buckets, []).append({(r.k, r.id): (r.batch_num, r.pos_in_batch, r.rows_seen, r.reason) for r in both})
            assert len(both) == 200
    assert got[None] == got[1] == got[7]
