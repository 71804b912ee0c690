"""Periodic run detection: match lengths along lag diagonals, over whole texts.

A run is a stretch of consecutive words with smallest period q and at least
max(12, 2 q) words that no neighbouring word extends. On the diagonal of lag q
(word i against word i - q) it is a row of length - q consecutive matches, so
the runs are the diagonals whose match length reaches max(q, 12 - q).

The diagonal table is sparse: only earlier occurrences of the word at i open
or lengthen a diagonal there, and a diagonal is given out as soon as its match
ends. A frequent word would have a quadratic number of earlier occurrences, so
those are looked up by growing context, which loses no run:

* lags 1 to 7 are counted word by word over the whole text;
* lags [2m, 4m) with m = 4, 8, 16, ... look up the m words that start at i, for
  a run of such a lag matches m words in a row. Where these m words stand at a
  distance of at most m/2 before, they lie inside a stretch of a far smaller
  period, and only the first place of such a cluster looks for earlier
  occurrences. If every matched place of a run were inside a cluster, a whole
  period of it would have a period that divides the lag (two periods of a
  stretch as long as both together), so the lag would not be its smallest.
  Clusters lie more than m/2 apart and have at most 2m earlier places each in
  reach, so a level looks at no more than four cells a word and a text of n
  words costs n log n, one word repeated a million times included.

The windows are named exactly (pairs of names of half their length), so two
windows are taken as equal only if all their words are. A diagonal's first
cell is extended both ways by those names, longest window first. Names are
given to repeated windows only; documents without a repeated group of six
words are done after one sort of hashes.

Defined results: null and empty texts have no run and collapse to an empty
string; very long texts are one document each (some 100 bytes of memory a
word); a null doc_id is a row like any other; repeated rows are judged one by
one; overlapping and nested runs are all given, by start, then period; extra
columns of any name are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscore.llm import textnum as T
from flowscore.llm.common import let, table, words

SHORTEST = 12
DENSE = 7  # lags counted word by word; 8 is the first lag of the level m = 4
RUNS = "array<struct<start: long, length: long, period: long>>"


def _suspects(ids: np.ndarray, first: np.ndarray, gram: int) -> np.ndarray:
    """Documents in which some group of ``gram`` words stands twice (and, by chance of a hash, a few more)."""
    if len(ids) <= gram:
        return np.zeros(0, np.int64)
    doc = (np.searchsorted(first, np.arange(len(ids) - gram + 1), "right") - 1).astype(np.uint64)
    low = np.uint64((1 << int(len(first)).bit_length()) - 1)
    key = np.sort((T.gram_hashes(ids.astype(np.uint64), gram) & ~low) | doc)
    return np.unique(key[1:][key[1:] == key[:-1]] & low).astype(np.int64)


def _dense(ids: np.ndarray, lag: int, least: int):
    """(start, end) of the diagonals of one lag with at least ``least`` matches."""
    same = np.zeros(len(ids) - lag + 2, np.int8) if len(ids) > lag else np.zeros(2, np.int8)
    if len(ids) > lag:
        same[1:-1] = ids[lag:] == ids[:-lag]
    step = np.diff(same)
    a, b = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    long = b - a >= least
    return a[long], b[long] + lag


class _Names:
    """Names of the repeated windows of 1, 2, 4, ... words; -1 where a window stands only once."""

    def __init__(self, ids: np.ndarray):
        self.n, self.levels = len(ids), []
        at, key = np.arange(self.n), ids.astype(np.int64)
        while True:
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            new = np.append(True, key[1:] != key[:-1]) if len(key) else np.zeros(0, bool)
            twice = ~(new & np.append(new[1:], True)) if len(key) else new
            at, name = at[twice], (np.cumsum(new) - 1)[twice]
            if not len(at):
                return
            level = np.full(self.n, -1, np.int32)
            level[at] = name
            self.levels.append((level, at, name.astype(np.int64)))
            m = 1 << (len(self.levels) - 1)
            at = np.sort(at)
            at = at[at + m < self.n]
            at = at[level[at + m] >= 0]
            key = level[at].astype(np.int64) * self.n + level[at + m]

    def extend(self, i: np.ndarray, j: np.ndarray):
        """How many words match to the right of (i, j) and to the left of them."""
        right, left = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            name, m = self.levels[k][0], 1 << k
            a, b = i + right, j + right
            ok = np.flatnonzero(a < self.n)
            ok = ok[(name[a[ok]] == name[b[ok]]) & (name[b[ok]] >= 0)]
            right[ok] += m
            a, b = i - left - m, j - left - m
            ok = np.flatnonzero(b >= 0)
            ok = ok[(name[a[ok]] == name[b[ok]]) & (name[b[ok]] >= 0)]
            left[ok] += m
        return right, left


def _cells(names: _Names, k: int):
    """(i, lag) of the first cell of each diagonal that level k meets, lags [2m, 4m)."""
    _, at, name = names.levels[k]
    m, n = 1 << k, names.n + 1
    key = name * n + at
    near = np.append(False, (name[1:] == name[:-1]) & (at[1:] - at[:-1] <= m // 2))
    i, base = at[~near], (name * n)[~near]
    lo = np.searchsorted(key, base + np.maximum(i - 4 * m + 1, 0))
    many = np.maximum(np.searchsorted(key, base + np.maximum(i - 2 * m + 1, 0)) - lo, 0)
    i, lo, many = i[many > 0], lo[many > 0], many[many > 0]
    j = at[np.repeat(lo - np.append(0, np.cumsum(many)[:-1]), many) + np.arange(many.sum())]
    i = np.repeat(i, many)
    cell = np.unique((i - j) * n + i)
    cell = cell[np.append(True, np.diff(cell) != 1)] if len(cell) else cell  # the cell before it is on the same diagonal
    return cell % n, cell // n


def find_runs(ids: np.ndarray, shortest: int = SHORTEST):
    """(start, end, period) of every run, by start, then period; equal ids are equal words."""
    found = [(*_dense(ids, q, max(q, shortest - q)), q) for q in range(1, DENSE + 1)]
    found = [(a, b, np.full(len(a), q)) for a, b, q in found]
    names = _Names(ids)
    for k in range(2, len(names.levels)):
        i, lag = _cells(names, k)
        right, left = names.extend(i, i - lag)
        ok = (right + left >= lag) & (right + left + lag >= shortest)
        found.append(((i - lag - left)[ok], (i + right)[ok], lag[ok]))
    a, b, q = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    order = np.lexsort((q, b, a))
    a, b, q = a[order], b[order], q[order]
    if len(a):  # the same stretch at a multiple of its smallest period
        least = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
        a, b, q = a[least], b[least], q[least]
    order = np.lexsort((q, a))
    return a[order], b[order], q[order]


def _collapsed(shortest: int):
    def run(batches):
        for piece in T.slices(batches, "text"):
            number, ids, texts, first = count(), [], [], [0]
            for text in piece.column("text").cast(pa.large_binary()).to_pylist():
                own = (text or b"").split()  # at the bytes 0x20 and 0x09-0x0D
                texts.append(own)
                ids.extend(map({}.setdefault, own, number))  # equal numbers: equal words of one document
                first.append(len(ids))
            ids, first = np.array(ids, np.int64), np.array(first, np.int64)
            starts = first[:-1]
            runs = {}
            docs = _suspects(ids, starts, max(1, (shortest + 1) // 2))
            if len(docs):
                size = first[docs + 1] - first[docs]
                end = np.cumsum(size)
                shift = np.repeat(first[docs] - (end - size), size)
                place = np.arange(len(shift)) + shift
                a, b, q = find_runs(ids[place], shortest)
                doc = np.searchsorted(end, a, "right")
                cut = np.searchsorted(doc, np.arange(len(docs) + 1))
                for d, lo, hi, zero in zip(docs.tolist(), cut[:-1], cut[1:], (end - size).tolist()):
                    if hi > lo:
                        runs[d] = (a[lo:hi] - zero, b[lo:hi] - zero, q[lo:hi])
            kept, many = [], np.zeros(len(texts) + 1, np.int64)
            for d, own in enumerate(texts):
                if d in runs:
                    a, b, q = runs[d]
                    many[d + 1] = len(a)
                    gone = np.zeros(len(own) + 1, np.int64)
                    np.add.at(gone, a + q, 1)
                    np.add.at(gone, b, -1)
                    own = [own[x] for x in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
                kept.append(b" ".join(own))
            cols = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*[(a, b - a, q) for a, b, q in runs.values()])] or [np.zeros(0, np.int64)] * 3
            flat = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], ["start", "length", "period"])
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum(many), pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(first[1:] - starts), spans, pa.array(kept, pa.binary()).cast(pa.string())],
                                             names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words, by start, then period), collapsed (the words
    that no run repeats, joined by one space). ``shortest``: least length of a run, 12 at least."""
    if shortest < SHORTEST:
        raise ValueError(f"shortest must be {SHORTEST} or more")
    base = docs.select("doc_id", "text")
    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInArrow(_collapsed(shortest), f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, where the words of each tenth document repeat from a place on, as the crc32 of its id says.

    A document with a null id stays as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def tail(w: Column) -> Column:
        n, g = F.size(w).cast("long"), F.floor(h / 10)
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.get(
            w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    text = F.col("text")
    some = (h % 10 == 0) & F.coalesce(text, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return docs.select("doc_id", F.when(some, let(words(text), tail)).otherwise(text).alias("text"))


def digest(found: DataFrame) -> DataFrame:
    """The result row of each document: its number of runs, its longest run and digests of runs and collapsed text."""
    best = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.floor(F.lit(1000) * -F.col("best.l") / F.col("best.p")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words")


def query(spark, sf_dir: str) -> DataFrame:
    return digest(periodic_runs(planted(table(spark, sf_dir, "documents"))))
