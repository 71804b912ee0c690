"""Benchmark decontamination by greedy string tiling.

Words are maximal runs of letters and digits (bytes 0x80 and up count as
letters), A-Z lower-cased, so punctuation and line breaks do not matter.

1. Seeds: every run of ``k`` words of a test item (all its words, if it has
   fewer). A bitmap of 2**``bitmap_bits`` bits, of fixed size whatever the
   data, lets the scan over all documents drop nearly all runs that are no
   seed; the rest are counted over the documents.
2. Pairs. Tiles of length L cover L words with L - k + 1 seeds, so an item of
   n words needs at least m = coverage n / k of its seeds in a document. Hence
   a pair shares one of the item's seeds outside the m - 1 most frequent ones,
   and only these rarer seeds are joined with the documents: a stock phrase in
   many items and many documents proposes nothing. Pairs found so are counted
   over all seeds, and those with m of them meet again with both texts.
3. Tiling: running Karp-Rabin hashes of k words give the matches; the longest
   non-overlapping ones are marked again and again until none of k words is
   left. Marked words are never used twice. Order does not matter, so
   reordered passages are found. A pair is reported when the tiles cover
   ``coverage`` of the item's words.

Defined results: null or empty texts match nothing; items without words are
never reported; documents are told apart by a key of id and text, so rows with
a null doc_id and rows that repeat an id with another text are judged on their
own; equal rows are each reported; a repeated item_id is one item per text, a
null item_id an item like any other; extra columns of any name are ignored
(``decontaminate`` keeps them); empty tables give an empty result. Documents
are whole, of any length: matches are kept as runs along diagonals, so memory
follows the words and the number of matches, not the product of the lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscore.llm import textnum as T
from flowscore.llm.common import KEY, keyed, pick, written

K, COVERAGE, BITMAP_BITS = 5, 0.8, 24


def tokens(col) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word of a batch in order, offsets of the rows)."""
    buf, offs = T.text_buffer(col)
    buf = T.ascii_lower(buf)
    inside = (buf >= 0x80) | ((buf >= 97) & (buf <= 122)) | ((buf >= 48) & (buf <= 57))
    s, e, r = T.spans(buf, offs, inside)
    return T.span_hashes(buf, s, e), np.searchsorted(r, np.arange(len(offs)))


def row_grams(h: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, rows) of every k consecutive words that lie in one row."""
    g = T.gram_hashes(h, k)
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    ok = row[: len(g)] == row[k - 1: k - 1 + len(g)] if len(g) else np.zeros(0, bool)
    return g[ok], row[: len(g)][ok]


def _item_seeds(k):
    def run(batches):
        for b in T.slices(batches, "text"):
            h, at = tokens(b.column("text"))
            n = np.diff(at)
            out = []
            for size in sorted(set(np.minimum(n, k)) - {0}):
                g, row = row_grams(h, at, int(size))
                mine = np.minimum(n, k)[row] == size
                out.append((g[mine], row[mine], size))
            if out:
                row = np.concatenate([r for _, r, _ in out])
                yield pa.RecordBatch.from_arrays(
                    [b.column("item").take(pa.array(row)), pa.array(np.concatenate([g for g, _, _ in out]).view(np.int64)),
                     pa.array(n[row].astype(np.int64)), pa.array(np.concatenate([np.full(len(g), s) for g, _, s in out]).astype(np.int32))],
                    names=["item", "seed", "n_item_words", "size"])
    return run


def _doc_hits(sizes, bits, shared):
    def run(batches):
        bitmap = shared.value
        for b in T.slices(batches, "text"):
            h, at = tokens(b.column("text"))
            rows, seeds = [], []
            for size in sizes:
                g, row = row_grams(h, at, size)
                slot = g >> np.uint64(64 - bits)
                hit = (bitmap[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1
                rows.append(row[hit])
                seeds.append(g[hit])
            row, seed = np.concatenate(rows), np.concatenate(seeds)
            order = np.lexsort((seed, row))
            row, seed = row[order], seed[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (seed[1:] != seed[:-1])
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(row[new])) for c in KEY], pa.array(seed[new].view(np.int64))],
                                             names=[*KEY, "seed"])
    return run


CELLS = 1 << 18


def _diagonals(ga: np.ndarray, gb: np.ndarray):
    """(diagonal, first, end) of the runs of equal windows: ga[j + diagonal] == gb[j] for first <= j < end.

    Cells are listed for some windows of b at a time, about ``CELLS`` of them, and joined to runs again and again.
    """
    order = np.argsort(ga, kind="stable")
    lo = np.searchsorted(ga[order], gb, "left")
    n = np.searchsorted(ga[order], gb, "right") - lo
    total = np.append(0, np.cumsum(n))
    runs, at = [], 0
    while at < len(gb):
        to = max(at + 1, int(np.searchsorted(total, total[at] + CELLS, "right")) - 1)
        many = n[at:to]
        j = np.repeat(np.arange(at, to), many)
        i = order[np.repeat(lo[at:to] - (total[at:to] - total[at]), many) + np.arange(len(j))] if len(j) else j
        runs.append(_joined(i - j, j, j + 1))
        if sum(len(r[0]) for r in runs) > 4 * CELLS:
            runs = [_joined(*(np.concatenate(x) for x in zip(*runs)))]
        at = to
    if not runs:
        return (np.zeros(0, np.int64),) * 3
    return _joined(*(np.concatenate(x) for x in zip(*runs)))


def _joined(diag, first, end):
    """Runs that touch on one diagonal become one."""
    order = np.lexsort((first, diag))
    diag, first, end = diag[order], first[order], end[order]
    if not len(diag):
        return diag, first, end
    head = np.flatnonzero(np.append(True, (diag[1:] != diag[:-1]) | (first[1:] != end[:-1])))
    return diag[head], first[head], end[np.append(head[1:], len(diag)) - 1]


def _next(flags: np.ndarray) -> np.ndarray:
    """For each place, and one past the end, the next place with the flag (far beyond the end if there is none)."""
    n = len(flags)
    at = np.where(np.append(flags, False), np.arange(n + 1), np.iinfo(np.int64).max // 4)
    return np.minimum.accumulate(at[::-1])[::-1]


def _clipped(diag, first, end, free_a, free_b):
    """The parts of the runs whose windows are free on both sides."""
    good_a, bad_a, good_b, bad_b = _next(free_a), _next(~free_a), _next(free_b), _next(~free_b)
    out = []
    while len(diag):
        while True:
            to = np.maximum(good_b[first], good_a[first + diag] - diag)
            live = to < end
            diag, end, moved = diag[live], end[live], to[live] > first[live]
            first = to[live]
            if not moved.any():
                break
        stop = np.minimum(np.minimum(bad_b[first], bad_a[first + diag] - diag), end)
        out.append((diag, first, stop))
        more = stop < end
        diag, first, end = diag[more], stop[more], end[more]
    return _joined(*(np.concatenate(x) for x in zip(*out))) if out else (diag, first, end)


def tiling(a: np.ndarray, b: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: tiles (start in a, start in b, words).

    Ties between equally long matches go to the smaller start in b, then in a.
    """
    tiles = []
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    diag, first, end = _diagonals(T.gram_hashes(a, k), T.gram_hashes(b, k))
    while len(diag):
        length = end - first
        most = int(length.max())
        size = most + k - 1
        best = np.flatnonzero(length == most)
        for x in best[np.lexsort((diag[best], first[best]))]:
            q = int(first[x])
            p = q + int(diag[x])
            if free_a[p: p + size].all() and free_b[q: q + size].all():
                free_a[p: p + size] = False
                free_b[q: q + size] = False
                tiles.append((p, q, size))
        diag, first, end = _clipped(diag, first, end, _windows(free_a, k), _windows(free_b, k))
    return tiles


def _windows(free: np.ndarray, k: int) -> np.ndarray:
    """Whether all k words from each place on are free."""
    used = np.append(0, np.cumsum(~free))
    return used[k:] == used[:-k]


def _cover(k):
    def run(batches):
        for b in T.slices(batches, "text"):
            ha, at = tokens(b.column("text"))
            hb, bt = tokens(b.column("item_text"))
            covered, n_tiles = [], []
            for r in range(b.num_rows):
                x, y = ha[at[r]: at[r + 1]], hb[bt[r]: bt[r + 1]]
                t = tiling(x, y, min(k, len(y))) if len(y) else []
                covered.append(sum(z[2] for z in t))
                n_tiles.append(len(t))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in (*KEY, "doc_id", "item_id", "n_item_words")], pa.array(covered, pa.int64()), pa.array(n_tiles, pa.int64())],
                names=[*KEY, "doc_id", "item_id", "n_item_words", "n_covered", "n_tiles"])
    return run


def _found(docs: DataFrame, benchmark: DataFrame, *, k: int = K, coverage: float = COVERAGE, bitmap_bits: int = BITMAP_BITS) -> DataFrame:
    """Key, doc_id, item_id, n_item_words, n_covered, n_tiles of every pair of a ``keyed`` row that reaches ``coverage``."""
    spark = docs.sparkSession
    items = pick(benchmark, "item_id", "text")
    items = items.select(F.struct("item_id", F.sha2("text", 256).alias("key")).alias("item"), "item_id", "text").dropDuplicates(["item"])
    kind = items.schema["item"].dataType.simpleString()
    seeds = items.select("item", "text").mapInArrow(_item_seeds(k), f"item {kind}, seed long, n_item_words long, size int")
    seeds = written(seeds.groupBy("item", "seed").agg(F.count(F.lit(1)).alias("times"), F.max("n_item_words").alias("n_item_words"),
                                                      F.max("size").alias("size")), "bench-seeds")
    # at most 2**bitmap_bits integers come back, however large the benchmark is
    slots = seeds.select(F.shiftrightunsigned("seed", 64 - bitmap_bits).alias("slot")).distinct().toArrow()["slot"].to_numpy()
    bitmap = np.zeros(1 << (bitmap_bits - 3), np.uint8)
    np.bitwise_or.at(bitmap, slots >> 3, (1 << (slots & 7)).astype(np.uint8))
    sizes = sorted(r["size"] for r in seeds.select("size").distinct().collect())
    shared = spark.sparkContext.broadcast(bitmap)
    keys = f"{KEY[0]} long, {KEY[1]} long"
    hits = written(docs.filter("text is not null").mapInArrow(_doc_hits(sizes or [k], bitmap_bits, shared), keys + ", seed long"), "bench-hits")
    often = hits.groupBy("seed").agg(F.count(F.lit(1)).alias("docs"))
    # an item of n words is covered to the share c by tiles of at least k words
    # only if c * n / k of its seed positions are shared: those beyond the most frequent ones tell
    least = F.ceil(F.lit(coverage) * F.col("n_item_words") / F.col("size"))
    rising = Window.partitionBy("item").orderBy(F.desc("docs"), "seed").rowsBetween(Window.unboundedPreceding, 0)  # an item's own seeds
    rare = written(seeds.join(often, "seed").withColumn("above", F.sum("times").over(rising)).filter(F.col("above") >= least).select("item", "seed"),
                   "bench-rare")
    maybe = hits.join(rare, "seed").select(*KEY, "item").distinct()
    pairs = maybe.join(hits, [*KEY]).join(seeds, ["item", "seed"]).groupBy(*KEY, "item", "seed").agg(
        F.max("times").alias("times"), F.max("n_item_words").alias("n_item_words"), F.max("size").alias("size")).groupBy(*KEY, "item").agg(
        F.sum("times").alias("shared"), F.max("n_item_words").alias("n_item_words"), F.max("size").alias("size")).filter(
        F.col("shared") * F.col("size") >= F.lit(coverage) * F.col("n_item_words")).select(*KEY, "item", "n_item_words")
    pairs = written(pairs, "bench-pairs")
    texts = docs.join(pairs.select(*KEY).distinct(), [*KEY], "left_semi")
    both = pairs.join(items.select("item", "item_id", F.col("text").alias("item_text")), "item").join(texts, [*KEY]).select(
        *KEY, "doc_id", "item_id", "n_item_words", "text", "item_text")
    item_type, doc_type = (t.schema[c].dataType.simpleString() for t, c in ((items, "item_id"), (docs, "doc_id")))
    return both.mapInArrow(_cover(k), f"{keys}, doc_id {doc_type}, item_id {item_type}, n_item_words long, n_covered long, n_tiles long").filter(
        F.col("n_covered") >= F.lit(coverage) * F.col("n_item_words"))


def contaminated(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """doc_id, item_id, n_item_words, n_covered, n_tiles of every pair that reaches ``coverage``."""
    return _found(keyed(pick(docs, "doc_id", "text")), benchmark, **params).drop(*KEY)


def decontaminate(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    rows = keyed(docs)
    bad = _found(pick(rows, *KEY, "doc_id", "text"), benchmark, **params).select(*KEY).distinct()
    return rows.join(bad, [*KEY], "left_anti").drop(*KEY)


def query(spark, sf_dir: str) -> DataFrame:
    from flowscore.llm.common import table
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
