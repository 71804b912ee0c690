"""N-gram Jaccard self-join by signature trees.

A document's set holds its distinct k-word shingles (64-bit hashes of the
A-Z-lower-cased words). Equal sets collapse to one class first, so copies are
never compared. Two classes link when their Jaccard similarity reaches
``num / den``.

The tree. Its upper part is never built node by node: two sets can only link
when they share one of the first n - ceil(t n) + 1 shingles of a common order,
so a node pair without a common bit among those shingles is pruned, and the
classes that hold one such shingle form a subtree (its bucket). The order puts
very frequent shingles last (found by counting, any order is correct), which
keeps passages that many documents share out of the buckets. Inside a bucket,
sorted by size, leaves of 32 classes carry the OR of their 1024-bit bitmaps,
their size range and their largest number of bit clashes; 8 nodes make a
parent. A dual traversal from the root keeps a node pair only if its sizes are
compatible and its largest possible overlap, popcount(A and B) plus clashes,
reaches the least overlap the smallest sizes need. Class pairs that survive
with their own bitmaps are verified exactly on the whole sets.

Groups of near copies are not expanded into all pairs: in the first round a
bucket only proposes one member with every other one (its medoid, or in a leaf
the one with the smallest key), so it proposes fewer pairs than it has members;
links found so far give components, and the second round skips node pairs that
lie in one component, proposing all that is left, so no link between components
is lost. A bucket above ``chunk`` classes is dealt out as pairs of chunks.

Defined results: null, empty and blank texts have 0 shingles and are their own
component; a text with fewer than k words is one shingle; very long texts are
one set each; a component is named by its smallest doc_id, null only if none of
its rows has one; rows are told apart by a key of id and text, so rows with a
null doc_id and rows that repeat an id with another text link like any others;
equal rows are each returned by ``ngram_components`` and one of them stays in
``one_of_each``; extra columns of any name are ignored by the one and kept by
the other; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.llm import textnum as T
from flowscore.llm.common import KEY, filter_of, in_filter, keyed, pick, written
from flowscore.llm.components import components

K, NUM, DEN = 4, 85, 100
FREQUENT, MAX_FREQUENT = 200, 1 << 16  # order only: any set of frequent shingles gives the same links
CHUNK, LEAF, FAN, WORDS = 2048, 32, 8, 16
SEEN = 1 << 18
ROUNDS = 3  # of labels after the first round of links: enough for stars of stars
SPREAD_ROWS = 2048  # rows of buckets with one smallest member that meet in a task


def shingle_sets(col, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every row."""
    buf, offs = T.text_buffer(col)
    buf = T.ascii_lower(buf)
    s, e, r = T.word_spans(buf, offs)
    h = T.span_hashes(buf, s, e)
    at = np.searchsorted(r, np.arange(len(offs)))
    grams = T.gram_hashes(h, k)
    out = []
    for i in range(len(offs) - 1):
        n = at[i + 1] - at[i]
        out.append(np.unique(grams[at[i]: at[i + 1] - k + 1]) if n >= k else T.gram_hashes(h[at[i]: at[i + 1]], int(n)) if n else grams[:0])
    return out


def _least_overlap(x, y, num, den):
    return -(-num * (x + y) // (num + den))


def _ordered(u: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return u
    often = frequent[np.minimum(np.searchsorted(frequent, u), len(frequent) - 1)] == u
    return np.concatenate([u[~often], u[often]])


def _bitmap(u: np.ndarray) -> bytes:
    words = np.zeros(WORDS, np.uint64)
    bit = T.mix(u)
    np.bitwise_or.at(words, (bit >> np.uint64(6)) & np.uint64(WORDS - 1), np.uint64(1) << (bit & np.uint64(63)))
    return words.tobytes()


def _keys(u: np.ndarray, salt: int = 0) -> tuple[int, int]:
    """A set's class number (unique in the table, see ``_classes``) and a second hash that proves it."""
    both = np.array([T.mix(u + np.uint64(salt)).sum(dtype=np.uint64), T.mix(u ^ T.MIX2).sum(dtype=np.uint64)])
    return tuple(T.mix(both + np.uint64(len(u))).view(np.int64).tolist())


def _wide(u: np.ndarray) -> bytes:
    """A bitmap of at least two bits per shingle, for the check of single pairs."""
    size = max(64, 1 << int(2 * len(u) - 1).bit_length())
    words = np.zeros(size // 64, np.uint64)
    bit = T.mix(u ^ T.MIX1) & np.uint64(size - 1)
    np.bitwise_or.at(words, bit >> np.uint64(6), np.uint64(1) << (bit & np.uint64(63)))
    return words.tobytes()


def _head(u: np.ndarray, often: np.ndarray, num: int, den: int) -> np.ndarray:
    return _ordered(u, often)[: len(u) - -(-num * len(u) // den) + 1].view(np.int64)


def _lists(heads: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(x) for x in heads])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(heads) if heads else np.zeros(0, np.int64)))


def _scan(k, num, den, salt):
    """Per document its class key and set size; for the first copy that a task
    meets also the prefix shingles and bitmaps (a partial aggregation: at most
    ``SEEN`` keys are remembered)."""
    def run(batches):
        seen: set = set()
        none = np.zeros(0, np.int64)
        for b in T.slices(batches, "text"):
            sets = shingle_sets(b.column("text"), k)
            n = np.array([len(u) for u in sets], np.int64)
            keys = [_keys(u, salt) if len(u) else (None, None) for u in sets]
            if len(seen) > SEEN:
                seen = set()
            new = [len(u) > 0 and not (key in seen or seen.add(key)) for u, key in zip(sets, keys)]
            yield pa.RecordBatch.from_arrays([
                *[b.column(c) for c in KEY], b.column("doc_id"), pa.array(n), pa.array([x for x, _ in keys], pa.int64()), pa.array([y for _, y in keys], pa.int64()),
                _lists([_head(u, none.view(np.uint64), num, den) if x else none for u, x in zip(sets, new)]),
                pa.array([_bitmap(u) if x else None for u, x in zip(sets, new)], pa.binary()),
                pa.array([_wide(u) if x else None for u, x in zip(sets, new)], pa.binary())],
                names=[*KEY, "doc_id", "n", "k1", "k2", "prefix", "bitmap", "wide"])
    return run


def _touched(frequent):
    """The documents whose prefix holds a frequent shingle."""
    def run(batches):
        often = frequent.value.view(np.int64)
        for b in batches:
            p = b.column("prefix")
            hit = np.isin(p.flatten().to_numpy(), often)
            row = np.repeat(np.arange(b.num_rows), np.diff(p.offsets.to_numpy()))
            yield b.select([*KEY]).take(pa.array(np.unique(row[hit])))
    return run


def _reordered(k, num, den, wanted, frequent, salt):
    """(k1, n, prefix) under the order that puts frequent shingles last, for the wanted documents."""
    def run(batches):
        for b in T.slices(batches, "text"):
            sets = shingle_sets(in_filter(b, wanted).column("text"), k)
            keys = [_keys(u, salt)[0] for u in sets if len(u)]
            yield pa.RecordBatch.from_arrays([
                pa.array(keys, pa.int64()), pa.array([len(u) for u in sets if len(u)], pa.int64()),
                _lists([_head(u, frequent.value, num, den) for u in sets if len(u)])], names=["k1", "n", "prefix"])
    return run


def _shared_only(batches):
    """Rows sorted by (token, k1): repeats go, then shingles that only one class has; lead is the smallest class of a shingle."""
    held = None
    for b in _with_end(batches):
        if b is not None:
            now = [b.column(c).to_numpy() for c in ("token", "k1", "n")]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now)]
        if held is None:
            return
        if b is not None and len(held[0]) < 1 << 17:
            continue
        stop = len(held[0]) if b is None else int(np.searchsorted(held[0], held[0][-1], "left"))
        token, k1, n = (x[:stop] for x in held)
        held = [x[stop:] for x in held]
        if stop:
            new = np.append(True, (token[1:] != token[:-1]) | (k1[1:] != k1[:-1]))
            token, k1, n = token[new], k1[new], n[new]
            _, first, of, df = np.unique(token, return_index=True, return_inverse=True, return_counts=True)
            ok = df[of] > 1
            yield pa.RecordBatch.from_arrays([pa.array(x[ok]) for x in (token, k1, n, df[of], k1[first][of])], names=["token", "k1", "n", "df", "lead"])


def _with_end(batches):
    yield from batches
    yield None


class _Bucket:
    """Members of one bucket, sorted by size: sizes, bitmaps, component."""

    def __init__(self, n, bits, comp, num, den):
        self.n, self.bits, self.comp, self.num, self.den = n, bits, comp, num, den

    def alike(self, i, j):
        """Which of the pairs (i, j) may still link, by size, component and bitmap."""
        ni, nj = self.n[i], self.n[j]
        ok = np.flatnonzero((np.minimum(ni, nj) * self.den >= np.maximum(ni, nj) * self.num) & (self.comp[i] != self.comp[j]))
        keep = []
        for lo in range(0, len(ok), 1 << 17):
            x = ok[lo: lo + (1 << 17)]
            a, b = self.bits[i[x]], self.bits[j[x]]
            need = _least_overlap(ni[x], nj[x], self.num, self.den)
            most = np.minimum(ni[x] - np.bitwise_count(a & ~b).sum(1, dtype=np.int64), nj[x] - np.bitwise_count(b & ~a).sum(1, dtype=np.int64))
            keep.append(x[most >= need])
        return np.concatenate(keep) if keep else ok

    def levels(self):
        """Node tables from the leaves up: first member, last member, OR bitmap, clashes, component or -1."""
        out = []
        clash = self.n - np.bitwise_count(self.bits).sum(1, dtype=np.int64)
        start = np.arange(0, len(self.n), LEAF)
        while True:
            end = np.append(start[1:], len(self.n))
            low, high = np.minimum.reduceat(self.comp, start), np.maximum.reduceat(self.comp, start)
            out.append((start, end, np.bitwise_or.reduceat(self.bits, start, axis=0), np.maximum.reduceat(clash, start), low, high))
            if len(start) == 1:
                return out
            start = start[::FAN]

    def traverse(self, i_only=None):
        """Dual traversal from the root: yields arrays (i, j) of class pairs that survive.

        With ``i_only`` (a member), only pairs with that member are kept.
        """
        tree = self.levels()
        x = y = np.zeros(1, np.int64)
        for depth in range(len(tree) - 1, -1, -1):
            start, end, bits, clash, low, high = tree[depth]
            lo_n, hi_n = self.n[start], self.n[end - 1]
            ok = (hi_n[x] * self.den >= lo_n[y] * self.num) & ~((low[x] == high[x]) & (low[y] == high[y]) & (low[x] == low[y]))
            if i_only is not None:
                ok &= ((start[x] <= i_only) & (i_only < end[x])) | ((start[y] <= i_only) & (i_only < end[y]))
            x, y = x[ok], y[ok]
            keep = np.zeros(len(x), bool)
            for lo in range(0, len(x), 1 << 17):
                s = slice(lo, lo + (1 << 17))
                most = np.bitwise_count(bits[x[s]] & bits[y[s]]).sum(1, dtype=np.int64) + np.minimum(clash[x[s]], clash[y[s]])
                keep[s] = most >= _least_overlap(lo_n[x[s]], lo_n[y[s]], self.num, self.den)
            x, y = x[keep], y[keep]
            if depth:
                below = len(tree[depth - 1][0])
                cx = (x[:, None] * FAN + np.arange(FAN))[:, :, None].repeat(FAN, 2).ravel()
                cy = (y[:, None] * FAN + np.arange(FAN))[:, None, :].repeat(FAN, 1).ravel()
                ok = (cx < below) & (cy < below) & (cx <= cy)
                x, y = cx[ok], cy[ok]
        start, end = tree[0][0], tree[0][1]
        for lo in range(0, len(x), 512):
            a, b = x[lo: lo + 512], y[lo: lo + 512]
            i = (start[a][:, None] + np.arange(LEAF))[:, :, None].repeat(LEAF, 2)
            j = (start[b][:, None] + np.arange(LEAF))[:, None, :].repeat(LEAF, 1)
            ok = (i < end[a][:, None, None]) & (j < end[b][:, None, None]) & (i < j)
            i, j = i[ok], j[ok]
            if i_only is not None:
                mine = (i == i_only) | (j == i_only)
                i, j = i[mine], j[mine]
            got = self.alike(i, j)
            if len(got):
                yield i[got], j[got]

    def medoid(self):
        """The member outside the largest component most alike a spread of 64 such members."""
        size = np.unique(self.comp, return_inverse=True, return_counts=True)
        largest = size[2].argmax()
        out = np.flatnonzero(size[1] != largest) if size[2][largest] > 1 else np.arange(len(self.n))
        if not len(out):
            return None
        few = out[np.unique(np.linspace(0, len(out) - 1, 64).astype(np.int64))]
        score = sum(np.bitwise_count(self.bits[out] & self.bits[f]).sum(1, dtype=np.int64) for f in few)
        return int(out[score.argmax()])


def _propose(num, den, star):
    """Class pairs (a < b) that may link, per partition sorted by (lead, token, part, n, k1)."""
    def pairs_of(ids, n, bits, comp, part):
        bucket = _Bucket(n, bits, comp, num, den)
        if comp.min() == comp.max():
            return
        if not star:
            yield from ((ids[i], ids[j]) for i, j in bucket.traverse())
        elif (m := bucket.medoid()) is not None:
            yield from ((ids[i], ids[j]) for i, j in bucket.traverse(m))

    def small(ids, n, bits, comp, ends):
        """Surviving pairs of many small buckets at once; ends: end of the own bucket of each row."""
        bucket = _Bucket(n, bits, comp, num, den)
        if star:
            first = np.flatnonzero(np.append(True, ends[1:] != ends[:-1]))
            size = np.diff(np.append(first, len(ids)))
            least = np.flatnonzero(ids == np.repeat(np.minimum.reduceat(ids, first), size))  # one a bucket: its members differ
            i, j = np.repeat(least, size), np.arange(len(ids))
            i, j = i[i != j], j[i != j]
            got = bucket.alike(i, j)
            yield ids[i[got]], ids[j[got]]
            return
        per = ends - np.arange(len(ids)) - 1
        total = np.cumsum(per)
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + (1 << 20), "right")))
            cnt = per[lo:hi]
            i = np.repeat(np.arange(lo, hi), cnt)
            j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(cnt) - cnt, cnt)
            got = bucket.alike(i, j)
            yield ids[i[got]], ids[j[got]]
            lo = hi

    def run(batches):
        held = None
        def work(table, last):
            """Handle all complete buckets; return the rows of the unfinished one."""
            key = np.stack([table["token"], table["part"]])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            starts = np.concatenate([[0], cut])
            ends = np.concatenate([cut, [key.shape[1]]])
            if not last:
                rest = starts[-1]
                starts, ends = starts[:-1], ends[:-1]
            else:
                rest = key.shape[1]
            size = ends - starts
            found = []
            few = size <= LEAF
            of = np.repeat(np.arange(len(size)), size)
            rows = np.flatnonzero(few[of]) if len(of) else of
            if len(rows):
                local_end = np.searchsorted(of[rows], of[rows], "right")
                found += small(*[table[c][rows] for c in ("k1", "n", "bitmap", "comp")], local_end)
            for g in np.flatnonzero(~few):
                s = slice(starts[g], ends[g])
                found += pairs_of(*[table[c][s] for c in ("k1", "n", "bitmap", "comp", "part")])
            out = None
            if found:
                a, b = np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])
                both = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
                out = pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], names=["a", "b"])
            return out, {c: v[rest:] for c, v in table.items()}

        for b in batches:
            if not b.num_rows:
                continue
            now = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("token", "part", "k1", "n", "comp")}
            now["bitmap"] = np.frombuffer(b"".join(b.column("bitmap").to_pylist()), np.uint64).reshape(-1, WORDS)
            held = now if held is None else {c: np.concatenate([held[c], now[c]]) for c in now}
            if len(held["k1"]) >= 1 << 15:
                out, held = work(held, False)
                if out is not None and out.num_rows:
                    yield out
        if held is not None and len(held["k1"]):
            out, _ = work(held, True)
            if out is not None and out.num_rows:
                yield out
    return run


def _sets_of(k, wanted, salt):
    """(k1, set) of the documents whose row key is in the fixed-size filter."""
    def run(batches):
        for b in T.slices(batches, "text"):
            b = in_filter(b, wanted)
            sets = shingle_sets(b.column("text"), k)
            sets = [u for u in sets if len(u)]
            yield pa.RecordBatch.from_arrays([pa.array([_keys(u, salt)[0] for u in sets], pa.int64()), pa.array([u.tobytes() for u in sets], pa.binary())],
                                             names=["k1", "set"])
    return run


def _wide_check(num, den):
    """Pairs whose wide bitmaps still allow the overlap they need (the wider one is folded)."""
    def run(batches):
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            na, nb = b.column("n_a").to_numpy(), b.column("n_b").to_numpy()
            need = _least_overlap(na, nb, num, den)
            for i, (x, y) in enumerate(zip(b.column("wide_a"), b.column("wide_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                m = min(len(x), len(y))
                x, y = np.bitwise_or.reduce(x.reshape(-1, m), 0), np.bitwise_or.reduce(y.reshape(-1, m), 0)
                good[i] = min(na[i] - int(np.bitwise_count(x & ~y).sum()), nb[i] - int(np.bitwise_count(y & ~x).sum())) >= need[i]
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(good)) for c in ("a", "b")], names=["a", "b"])
    return run


def _verify(num, den):
    def run(batches):
        for b in batches:
            a, c = b.column("a").to_numpy(), b.column("b").to_numpy()
            good = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column("set_a"), b.column("set_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                good[i] = den * both >= num * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([pa.array(a[good]), pa.array(c[good])], names=["a", "b"])
    return run


def _verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, k: int, num: int, den: int, salt: int) -> DataFrame:
    """The pairs of classes that link: first by wide bitmaps, then by their whole sets."""
    def side(c, *cols):
        return [F.col("k1").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in cols]]

    wide = pairs.join(classes.select(*side("b", "n", "wide")), "b").join(classes.select(*side("a", "n", "wide")), "a")
    left = written(wide.select("a", "b", "n_a", "n_b", "wide_a", "wide_b").mapInArrow(_wide_check(num, den), "a long, b long"), "join-left")
    ids = left.select(F.explode(F.array("a", "b")).alias("k1")).distinct()
    wanted = written(ids.join(classes, "k1").select("k1", F.col("rep").alias(KEY[0])), "join-wanted")
    slot, bitmap = filter_of(wanted)
    sets = docs.withColumn("slot", slot).mapInArrow(_sets_of(k, bitmap, salt), "k1 long, set binary")
    sets = written(sets.join(wanted.select("k1"), "k1", "left_semi").dropDuplicates(["k1"]), "join-sets")  # one class has one set
    both = left.join(sets.select(*side("b", "set")), "b").join(sets.select(*side("a", "set")), "a")
    return both.select("a", "b", "set_a", "set_b").mapInArrow(_verify(num, den), "a long, b long")


def _classes(docs: DataFrame, k: int, num: int, den: int):
    """(written rows, their written classes, salt): a class number stands for one set only.

    Class numbers are 64-bit hashes; should two sets share one, which the
    second hash tells, the next salt is taken.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    salt = 0
    while True:
        rows = written(docs.mapInArrow(_scan(k, num, den, salt), f"{KEY[0]} long, {KEY[1]} long, doc_id {kind}, n long, k1 long, k2 long, "
                                       "prefix array<long>, bitmap binary, wide binary"), "join-docs")
        classes = written(rows.filter("n > 0").groupBy("k1").agg(
            F.min("k2").alias("lo"), F.max("k2").alias("hi"), F.min(KEY[0]).alias("rep"), F.max("n").alias("n"),
            F.max("bitmap").alias("bitmap"), F.max("wide").alias("wide")), "join-classes")
        if classes.filter("lo <> hi").isEmpty():
            return rows, classes.drop("lo", "hi"), salt
        salt += 1


def _grouped(docs: DataFrame, *, k: int = K, num: int = NUM, den: int = DEN, chunk: int = CHUNK, frequent: int = FREQUENT) -> DataFrame:
    """Key, doc_id, n and comp (the component's number, null without shingles) of every ``keyed`` row."""
    spark = docs.sparkSession
    docs = pick(docs, *KEY, "doc_id", "text")
    all_docs, classes, salt = _classes(docs, k, num, den)
    some = all_docs.filter("n > 0")
    often = some.select(F.explode("prefix").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df")).filter(
        F.col("df") > frequent).orderBy(F.desc("df"), "token").limit(MAX_FREQUENT).select("token").toArrow()["token"].to_numpy()
    order = spark.sparkContext.broadcast(np.sort(often.astype(np.int64).view(np.uint64)))  # at most MAX_FREQUENT values
    rows = some.select(*KEY, "k1", "n", "prefix")
    if len(often):
        touched = written(rows.select(*KEY, "prefix").mapInArrow(_touched(order), f"{KEY[0]} long, {KEY[1]} long"), "join-touched")
        slot, wanted = filter_of(touched)
        rows = rows.join(touched, [*KEY], "left_anti").select("k1", "n", "prefix").unionByName(
            docs.withColumn("slot", slot).mapInArrow(_reordered(k, num, den, wanted, order, salt), "k1 long, n long, prefix array<long>"))
    rows = rows.select(F.explode("prefix").alias("token"), "k1", "n")
    member = written(rows.repartition("token").sortWithinPartitions("token", "k1").mapInArrow(
        _shared_only, "token long, k1 long, n long, df long, lead long"), "join-members")
    links, comp = None, None
    for step in ("star", "all"):
        part = member if comp is None else member.filter("df > 2").join(comp, member["k1"] == comp["id"], "left")
        part = part.withColumn("comp", F.coalesce("comp", "k1") if comp is not None else F.col("k1"))
        if comp is not None:  # buckets that lie in one component are done
            part = part.join(written(part.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("token"),
                                     "join-mixed"), "token")
        # near copies share many buckets: those with one smallest member meet in few tasks, side by side, where repeated pairs go
        tasks = written(part.groupBy("lead").agg(F.ceil(F.count(F.lit(1)) / SPREAD_ROWS).alias("tasks")), "join-tasks")
        part = part.join(tasks, "lead")
        deal = F.xxhash64("lead", F.pmod(F.xxhash64("token"), F.col("tasks")), "part")
        pieces = F.ceil(F.col("df") / chunk)
        mine = F.pmod(F.xxhash64("k1"), pieces)
        part = part.withColumn("part", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), pieces - 1),
                                                             lambda c: F.least(c, mine) * 1000003 + F.greatest(c, mine))))
        part = part.withColumn("deal", deal).join(classes.select("k1", "bitmap"), "k1").select(
            "deal", "lead", "token", "part", "k1", "n", "comp", "bitmap")
        dealt = part.repartition("deal").drop("deal").sortWithinPartitions("lead", "token", "part", "n", "k1")
        pairs = written(dealt.mapInArrow(_propose(num, den, step == "star"), "a long, b long").distinct(), "join-pairs")
        found = written(_verified(pairs, docs, classes, k, num, den, salt).distinct(), "join-links")
        if comp is None or not found.isEmpty():  # later rounds only find links between components
            links = found if links is None else links.unionByName(found)
            comp = components(links, "join-comp", rounds=None if step == "all" else ROUNDS)
        elif step == "all":
            comp = components(links, "join-comp")
    return all_docs.select(*KEY, "doc_id", "n", "k1").join(comp.withColumnRenamed("id", "k1"), "k1", "left").select(
        *KEY, "doc_id", "n", F.coalesce("comp", "k1").alias("comp"))


def ngram_components(docs: DataFrame, **params) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of ``docs``; parameters as in ``_grouped``."""
    of = _grouped(keyed(pick(docs, "doc_id", "text")), **params)
    first = written(of.filter("n > 0").groupBy("comp").agg(F.min("doc_id").alias("first")), "join-first")
    return of.join(first, "comp", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one row of each component, that with the smallest doc_id (a null one last)."""
    rows = keyed(docs)
    of = written(_grouped(rows, **params).filter("n > 0"), "join-rows")
    best = of.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)).alias("best"))
    judged = of.groupBy("comp", *KEY).agg(F.count(F.lit(1)).alias("copies")).join(best, "comp").select(
        *KEY, "copies", ((F.col(KEY[0]) == F.col(f"best.{KEY[0]}")) & (F.col(KEY[1]) == F.col(f"best.{KEY[1]}"))).alias("stays"))
    judged = written(judged.filter("not stays or copies > 1"), "join-judged")
    kept = rows.join(judged.filter("not stays").select(*KEY), [*KEY], "left_anti")
    twice = judged.filter("stays").select(*KEY)
    if not twice.isEmpty():  # equal rows
        kept = kept.join(twice, [*KEY], "left_anti").unionByName(kept.join(twice, [*KEY], "left_semi").dropDuplicates([*KEY]))
    return kept.drop(*KEY)


def query(spark, sf_dir: str) -> DataFrame:
    from flowscore.llm.common import table
    return ngram_components(table(spark, sf_dir, "documents"))
