"""Exact substring dedup with per-shard suffix arrays.

Every byte goes that is covered by a string of ``length`` bytes which also
starts anywhere else in the table (the same document included, overlaps
count); all strings are judged on the input.

1. Anchors. A string of ``length`` bytes starting at s owns the smallest hash
   of the ``GRAM``-byte windows inside it (the leftmost on ties). Equal strings
   own equal anchors at the same distance, so only strings whose anchor hash
   stands at two or more places can repeat; the rest of the text is never
   sorted. Consecutive starts with one anchor form a context: the bytes from
   the first start to the end of the last string.
2. Shards. Contexts are dealt out by anchor hash, so all strings of an anchor
   meet in one shard. An anchor with more than ``SPLIT`` places is spread over
   several shards by context.
3. Each shard sorts the suffixes of its distinct contexts (Larsson-Sadakane
   doubling that only refines groups not yet sorted, in numpy), takes common
   prefixes with Kasai's method, all contexts in step, and marks the starts
   whose neighbour shares ``length`` bytes. Two places with one context repeat
   in whole.
4. For spread anchors, each shard also gives the sorted 128-bit keys of its
   strings, cut into key ranges (as many as the counted places ask for); a
   range merges the shards' runs by binary search and marks the strings found
   in two of them.

Defined results: a null or empty text has 0 bytes; texts shorter than
``length`` lose nothing; rows are told apart by a key of id and text, so rows
with a null doc_id and rows that repeat an id with another text are places of
their own; equal rows (id and text) are two places and lose the same bytes;
extra columns of any name are ignored; an empty table gives an empty result.
Texts are whole, of any length.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.llm import textnum as T
from flowscore.llm.common import KEY, chosen, filter_of, keyed, pick, written

LENGTH, GRAM, SPLIT, SHARD_BYTES = 400, 160, 4096, 1 << 20
RANGE_STRINGS = 1 << 18  # strings that one key range is to hold
SEEN = 1 << 17


def anchors_of(buf: np.ndarray, offs: np.ndarray, length: int):
    """(row, first start, last start, anchor hash) of every context; starts count from the row's first byte."""
    w = length - GRAM + 1
    size = np.diff(offs)
    if len(buf) < length or not (size >= length).any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    n = len(buf) - GRAM + 1
    p = T.powers(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * p[:-1], out=acc[1:])
    h = acc[GRAM:] - acc[:n]
    h *= p[n - 1:: -1][:n] if n > 1 else p[:1]
    h = T.mix(h * T.inverse_power(n - 1))
    v = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    pad = -len(v) % w
    blocks = np.concatenate([v, np.full(pad, np.iinfo(np.uint64).max)]).reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    m = np.minimum(right[: n - w + 1], left[w - 1: n])
    at = (m & np.uint64(0xFFFFFFFF)).astype(np.int64)  # the anchor of the string starting here
    start = np.arange(len(at))
    row = np.searchsorted(offs, start, side="right") - 1
    ok = start + length <= offs[row + 1]
    start, row, at = start[ok], row[ok], at[ok]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return row[first], start[first] - offs[row[first]], start[last] - offs[row[first]], h[at[first]]


def _anchors(length):
    def run(batches):
        for b in T.slices(batches, "text", 256 << 10):
            buf, offs = T.text_buffer(b.column("text"))
            row, a, z, h = anchors_of(buf, offs, length)
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(row)) for c in KEY], pa.array(a), pa.array(z), pa.array(h.view(np.int64))],
                                             names=[*KEY, "a", "z", "h"])
    return run


def _contexts(length):
    """One row per place of a shared anchor; the bytes only once per task and context."""
    def run(batches):
        seen: set = set()
        for b in T.slices(batches, "text", 1 << 20):
            doc, a_s, h_s, s_s, ctx, n, body = [], [], [], [], [], [], []
            for i in range(b.num_rows):
                text = b.column("text")[i].as_py()
                text = text.encode() if isinstance(text, str) else text
                for s in b.column("spans")[i].as_py():
                    part = text[s["a"]: s["z"] + length]
                    key = hashlib.blake2b(part, digest_size=16).digest()
                    if len(seen) > SEEN:
                        seen.clear()
                    doc.append(i)
                    a_s.append(s["a"])
                    h_s.append(s["h"])
                    s_s.append(s["shards"])
                    ctx.append(key)
                    n.append(s["z"] - s["a"] + 1)
                    body.append(None if key in seen else part)
                    seen.add(key)
                if sum(map(len, filter(None, body))) > 2 << 20:
                    yield _context_batch(b, doc, a_s, h_s, s_s, ctx, n, body)
                    doc, a_s, h_s, s_s, ctx, n, body = [], [], [], [], [], [], []
            yield _context_batch(b, doc, a_s, h_s, s_s, ctx, n, body)
    return run


def _context_batch(b, doc, a, h, shards, ctx, n, body):
    return pa.RecordBatch.from_arrays([
        *[b.column(c).take(pa.array(doc, pa.int64())) for c in KEY], pa.array(a, pa.int64()), pa.array(h, pa.int64()),
        pa.array(shards, pa.int64()), pa.array(ctx, pa.binary()), pa.array(n, pa.int64()), pa.array(body, pa.binary())],
        names=[*KEY, "a", "h", "shards", "ctx", "n", "body"])


def suffix_array(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, start and end of the body at each position, packed keys) of bodies with unique ends.

    Doubling starts from 7 bytes (9 bits each, 0 past the end). Each round only
    sorts positions whose group is not yet single, as Larsson and Sadakane do.
    """
    sizes = np.array([len(x) for x in bodies])
    text = np.frombuffer(b"".join(bodies), np.uint8).astype(np.uint64) + np.uint64(1)
    n = len(text)
    ends = np.repeat(np.cumsum(sizes).astype(np.int32), sizes)
    body = np.repeat(np.arange(len(bodies), dtype=np.int32), sizes)
    pos = np.arange(n, dtype=np.int32)
    key = np.zeros(n, np.uint64)
    for d in range(7):
        inside = pos + d < ends
        key = (key << np.uint64(9)) | np.where(inside, text[np.minimum(pos + d, n - 1)], np.uint64(0))
    del text, pos
    sa = np.argsort(key)
    rank = np.empty(n, np.int64)
    rank[sa] = _groups(key[sa])
    open_at = _not_single(rank[sa])
    depth, last = 7, len(bodies)
    while len(open_at):  # past its end a suffix ranks by its body, below all others, so every group splits in the end
        i = sa[open_at]
        nxt = np.where(i + depth < ends[i], rank[np.minimum(i + depth, n - 1)] + last, body[i])
        pair = (rank[i].astype(np.uint64) << np.uint64(32)) | nxt.astype(np.uint64)
        order = np.argsort(pair)
        i, pair = i[order], pair[order]
        sa[open_at] = i
        new = np.append(True, pair[1:] != pair[:-1])
        lead = np.maximum.accumulate(np.where(new, open_at, 0))  # a group's rank is its first place
        rank[i] = lead
        open_at = open_at[_not_single(lead)]
        depth *= 2
    return sa, np.cumsum(sizes) - sizes, ends, key


def _not_single(sorted_ranks: np.ndarray) -> np.ndarray:
    """Where groups of two or more stand."""
    same = sorted_ranks[1:] == sorted_ranks[:-1]
    return np.flatnonzero(np.append(False, same) | np.append(same, False))


def _groups(sorted_keys: np.ndarray) -> np.ndarray:
    new = np.append(True, sorted_keys[1:] != sorted_keys[:-1])
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def common_prefixes(sa, starts, ends, key, text: np.ndarray) -> np.ndarray:
    """Kasai: the common prefix of each suffix with its predecessor in the array, by text position.

    All bodies advance one position together; a body's prefix shrinks by at
    most one a step, and only bodies that still match go on extending (seven
    bytes at a time by their packed keys, then byte by byte).
    """
    n = len(sa)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    size = np.diff(np.append(starts, n))
    h = np.zeros(len(starts), np.int64)
    for t in range(int(size.max()) if len(size) else 0):
        lane = np.flatnonzero(size > t)
        i = starts[lane] + t
        j = before[i]
        h[lane] = np.where(j >= 0, np.maximum(h[lane] - 1, 0), 0)
        go = lane[j >= 0]
        for step in (7, 1):
            live = go
            while len(live):
                x = starts[live] + t
                y = before[x]
                x, y = x + h[live], y + h[live]
                fits = (x + step <= ends[starts[live]]) & (y + step <= ends[before[starts[live] + t]])
                x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
                same = fits & ((key[x] == key[y]) if step == 7 else (text[x] == text[y]))
                live = live[same]
                h[live] += step
        out[i] = h[lane]
    return out


def _string_keys(bodies, length):
    """Two 64-bit hashes of every ``length``-byte string of the bodies, body and start of each."""
    buf = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.array([len(x) for x in bodies])
    n = sizes - length + 1
    body = np.repeat(np.arange(len(bodies)), n)
    start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(sizes) - sizes)[body] + start
    out = []
    for salt in (np.uint64(1), np.uint64(77)):
        p = T.powers(len(buf) + 1)
        acc = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(T.mix(buf.astype(np.uint64) + salt) * p[:-1], out=acc[1:])
        h = (acc[at + length] - acc[at]) * p[len(buf) - at]
        out.append(T.mix(h * T.inverse_power(len(buf))))
    return out[0], out[1], body, start


def _runs(flags: np.ndarray) -> list[dict]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"lo": int(x), "hi": int(y)} for x, y in zip(edge[::2], edge[1::2])]


def _shard(length, bands):
    """Rows sorted by (h, part): marks of repeated starts per context, and key runs of spread anchors in 2**bands ranges."""
    names = ["ctx", "marks", "band", "k1", "k2", "refs", "starts"]
    types = [pa.binary(), pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])), pa.int64(), pa.binary(), pa.binary(),
             pa.list_(pa.binary()), pa.binary()]

    def solve(group):
        """group: list of (ctx, h, shards, body) with whole (h, part) groups."""
        rows = []
        alone = {}
        for g in group:
            alone[g[1]] = alone.get(g[1], 0) + 1
        sort = [g for g in group if alone[g[1]] > 1]
        if sort:
            bodies = [g[3] for g in sort]
            sa, starts, ends, key = suffix_array(bodies)
            text = np.frombuffer(b"".join(bodies), np.uint8)
            lcp = common_prefixes(sa, starts, ends, key, text)
            hit = np.zeros(len(text), bool)
            long = lcp[sa] >= length
            hit[sa[long]] = True
            hit[sa[np.flatnonzero(long) - 1]] = True
            for g, s in zip(sort, starts):
                marks = _runs(hit[s: s + len(g[3])])
                if marks:
                    rows.append([g[0], marks, None, None, None, None, None])
        spread = [g for g in group if g[2] > 1]
        if spread:
            k1, k2, body, start = _string_keys([g[3] for g in spread], length)
            order = np.lexsort((k2, k1))
            k1, k2, body, start = k1[order], k2[order], body[order], start[order]
            band = (k1 >> np.uint64(64 - bands)).astype(np.int64) if bands else np.zeros(len(k1), np.int64)
            edge = np.flatnonzero(np.append(True, band[1:] != band[:-1]))
            for lo, hi in zip(edge, np.append(edge[1:], len(k1))):
                use, local = np.unique(body[lo:hi], return_inverse=True)
                rows.append([None, None, int(band[lo]), k1[lo:hi].tobytes(), k2[lo:hi].tobytes(), [spread[u][0] for u in use],
                             np.stack([local, start[lo:hi]]).astype(np.int64).tobytes()])
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=names)

    def run(batches):
        group, size, seen, last = [], 0, set(), None
        for b in batches:
            for ctx, h, part, shards, body in zip(*[b.column(c).to_pylist() for c in ("ctx", "h", "part", "shards", "body")]):
                if (h, part) != last:
                    if size > SHARD_BYTES:
                        yield solve(group)
                        group, size, seen = [], 0, set()
                    last = (h, part)
                if ctx not in seen:
                    seen.add(ctx)
                    group.append((ctx, h, shards, body))
                    size += len(body)
        if group:
            yield solve(group)
    return run


def _merge(batches):
    """Sorted key runs of all shards of one key range, merged by binary search."""
    runs = []

    def solve():
        pairs = [np.stack([a, b], 1) for a, b, _, _ in runs]
        every = np.unique(np.concatenate(pairs), axis=0) if pairs else np.zeros((0, 2), np.uint64)
        first = every.view([("a", np.uint64), ("b", np.uint64)]).ravel()
        times = np.zeros(len(first), np.int64)
        where = [np.searchsorted(first, np.ascontiguousarray(p).view([("a", np.uint64), ("b", np.uint64)]).ravel()) for p in pairs]
        for w in where:
            times[np.unique(w)] += 1
        for w, (_, _, refs, at) in zip(where, runs):
            hit = times[w] > 1
            for k in np.unique(at[0][hit]):
                flags = np.zeros(int(at[1][hit & (at[0] == k)].max()) + 1, bool)
                flags[at[1][hit & (at[0] == k)]] = True
                yield refs[k], _runs(flags)

    band = None
    for b in batches:
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in ("band", "k1", "k2", "refs", "starts")}
            if r["band"] != band and runs:
                yield _marks(list(solve()))
                runs = []
            band = r["band"]
            runs.append((np.frombuffer(r["k1"], np.uint64), np.frombuffer(r["k2"], np.uint64), r["refs"],
                         np.frombuffer(r["starts"], np.int64).reshape(2, -1)))
    if runs:
        yield _marks(list(solve()))


def _marks(rows):
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.binary()),
                                       pa.array([r[1] for r in rows], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))],
                                      names=["ctx", "marks"])


MARKS = "ctx binary, marks array<struct<lo: long, hi: long>>"


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, split: int = SPLIT) -> DataFrame:
    """The rows' key and spans (array of merged [lo, hi) byte ranges to remove) for ``keyed`` rows that lose bytes."""
    docs = pick(docs, *KEY, "text").filter(f"octet_length(text) >= {length}")
    keys = f"{KEY[0]} long, {KEY[1]} long"
    anchors = written(docs.mapInArrow(_anchors(length), keys + ", a long, z long, h long"), "suffix-anchors")
    shared = written(anchors.groupBy("h").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select(
        "h", "places", F.ceil(F.col("places") / split).alias("shards")), "suffix-shared")
    spread = shared.filter("shards > 1").agg(F.sum("places")).first()[0] or 0
    bands = int(spread * (length - GRAM + 1) // RANGE_STRINGS).bit_length()
    # equal rows give equal places: each is kept once, in the partial aggregation already
    places = written(anchors.join(shared.drop("places"), "h").groupBy(*KEY).agg(
        F.collect_set(F.struct("a", "z", "h", "shards")).alias("spans")), "suffix-places")
    slot, wanted = filter_of(places)
    texts = docs.withColumn("slot", slot).mapInArrow(chosen(wanted), docs.withColumn("slot", slot).schema).drop("slot")
    context = written(texts.join(places, [*KEY]).mapInArrow(
        _contexts(length), keys + ", a long, h long, shards long, ctx binary, n long, body binary"), "suffix-contexts")
    dealt = context.filter("body is not null").withColumn("part", F.pmod(F.xxhash64("ctx"), F.col("shards"))).repartition(
        "h", "part").sortWithinPartitions("h", "part").select("ctx", "h", "part", "shards", "body")
    solved = written(dealt.mapInArrow(_shard(length, bands), MARKS + ", band long, k1 binary, k2 binary, refs array<binary>, starts binary"),
                     "suffix-solved")
    merged = solved.filter("band is not null").select("band", "k1", "k2", "refs", "starts").repartition("band").sortWithinPartitions(
        "band").mapInArrow(_merge, MARKS)
    marks = solved.filter("ctx is not null").select("ctx", "marks").unionByName(merged)
    whole = context.groupBy("ctx").agg(F.count(F.lit(1)).alias("times"), F.max("n").alias("n")).filter("times > 1").select(
        "ctx", F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n").alias("hi"))).alias("marks"))
    marks = written(marks.unionByName(whole).groupBy("ctx").agg(F.flatten(F.collect_list("marks")).alias("marks")), "suffix-marks")
    # equal rows stand in ``context`` as often as they repeat, but lose one list of spans
    found = context.select(*KEY, "a", "ctx").join(marks, "ctx").select(
        *KEY, F.transform("marks", lambda m: F.struct((F.col("a") + m["lo"]).alias("lo"), (F.col("a") + m["hi"] + length - 1).alias("hi"))).alias("s"))
    return found.groupBy(*KEY).agg(F.flatten(F.collect_set("s")).alias("spans"))


def _removed(as_text):
    def run(batches):
        for b in T.slices(batches, "text", 1 << 20):
            rows = []
            for text, spans in zip(b.column("text"), b.column("spans")):
                body = text.as_py()
                body = b"" if body is None else body.encode() if isinstance(body, str) else body
                kept, removed, n, at = [], 0, 0, 0
                for lo, hi in _merged(spans.as_py() or []):
                    kept.append(body[at:lo])
                    removed, n, at = removed + hi - lo, n + 1, hi
                kept = b"".join([*kept, body[at:]])
                kept_as = kept if not as_text else None if text.as_py() is None else kept.decode("utf-8", "ignore")
                rows.append((len(body), removed, n, hashlib.sha256(kept).hexdigest(), kept_as))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string() if as_text else pa.binary())
            cols = [pa.array([r[c] for r in rows], t) for c, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
    return run


def _merged(spans):
    out = []
    for s in sorted((s["lo"], s["hi"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([*s])
    return out


def suffix_dedup(docs: DataFrame, *, length: int = LENGTH, split: int = SPLIT, as_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept of every row.

    ``kept`` holds the remaining bytes, with ``as_text`` as a string (bytes of a
    character that a cut went through are left out; null for a null text).
    """
    docs = keyed(pick(docs, "doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = written(repeated_spans(docs, length=length, split=split), "suffix-spans")
    slot, wanted = filter_of(spans)
    marked = docs.withColumn("slot", slot)
    none = F.lit(None).cast(spans.schema["spans"].dataType).alias("spans")
    rest = marked.mapInArrow(chosen(wanted, False), marked.schema).select("doc_id", "text", none)
    some = marked.mapInArrow(chosen(wanted), marked.schema).join(spans, [*KEY], "left").select("doc_id", "text", "spans")
    return rest.unionByName(some).mapInArrow(_removed(as_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept "
                                             + ("string" if as_text else "binary"))


def query(spark, sf_dir: str) -> DataFrame:
    from flowscore.llm.common import table
    return suffix_dedup(table(spark, sf_dir, "documents"), as_text=True).withColumnRenamed("kept", "text")
