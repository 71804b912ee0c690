"""Language-model scoring with a hierarchical Pitman-Yor model.

Every word (and the border of a text) has a restaurant that seats the training
tokens which follow it. These share one parent, the word restaurant; its base
distribution spells words byte by byte with restaurants for the ``ORDER`` bytes
before; those that agree on all but the oldest byte share a parent, up to one
root over all bytes with a uniform base. A restaurant's tables are the customers
of its parent, a word's tables those of the spelling restaurants. So no word has
probability 0. The border is also the token that ends a text.

Seating is sampled by blocked Gibbs: in each sweep every dish of a restaurant
is cleared and its customers are seated again one by one (the later customers
of a very frequent dish in growing blocks, binomially), given the tables of all
others from the sweep before. After ``BURN`` sweeps, ``SAMPLES`` sweeps are
kept and the probability of a word after another is the mean of their predictive
probabilities.

Spark does the work that grows: blocks of documents become word numbers plus
one list of distinct words, the lists are dealt by word hash to shards that
add up counts. Pairs of neighbours are dealt by the hash of both words, so the
pairs of a frequent word spread over all shards, and a frequent pair is one
entry per block. In a sweep the word shards tell each pair shard probability and
tables of the words it asked for; it seats its pairs and tells back the tables
by word and by context; the word shards add these up and seat them. At the end
each pair shard answers each block with the probabilities of its pairs. Natural
logarithms travel as 32-bit floats (relative error 6e-8 of each). Only spelling counts meet the driver: every code that occurs, with no
cap, so its memory has to hold the distinct strings of ``ORDER`` + 1 bytes.

Defined results: null and empty texts are one end token; a null doc_id counts
as the text "null"; repeated rows are scored and learned each; with no
training document every score is null and base_score uses N = V = 0; extra
columns are ignored; an empty table gives an empty result. Texts are whole.
More than 2**32 word numbers raise an error.
"""

from __future__ import annotations

import math
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.llm import textnum as T
from flowscore.llm.common import discard, pick
from flowscore.llm.common import written as _written

BURN, SAMPLES, SEED, FOLDS = 2, 3, 11, 10
THETA = 1.0
START, END, SYMBOLS = 256, 257, 258
ORDER = 4
BLOCK_BYTES, SHARD_BYTES = 4 << 20, 8 << 20
#: Number of the border of a text, beside those of the words (number in the shard << bits | shard).
EDGE = (1 << 32) - 1


written = partial(_written, tidy=True)  # the tables here are as large as the corpus: no step leaves shuffle files behind


def held_out(doc_id) -> bool:
    return zlib.crc32(("null" if doc_id is None else str(doc_id)).encode()) % FOLDS == 0


def _pack(x: np.ndarray) -> bytes:
    """Integers as zstd-compressed byte planes."""
    return zstandard.compress(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def _unpack(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _pack_steps(x: np.ndarray) -> bytes:
    """Integers that mostly grow a little, as their differences."""
    return _pack(np.diff(x.astype(np.int64), prepend=0))


def _unpack_steps(b: bytes) -> np.ndarray:
    return np.cumsum(_unpack(b), dtype=np.uint32)


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.unique(x, return_inverse=True)`` of numbers from 0: number and place are sorted as one where they fit 64 bits."""
    place = len(x).bit_length()
    if not len(x) or int(x.max()).bit_length() + place > 64:
        return np.unique(x, return_inverse=True)
    both = np.sort((x.astype(np.uint64) << np.uint64(place)) | np.arange(len(x), dtype=np.uint64))
    number, at = both >> np.uint64(place), (both & np.uint64((1 << place) - 1)).astype(np.int64)
    new = np.append(True, number[1:] != number[:-1])
    inverse = np.empty(len(x), np.int64)
    inverse[at] = np.cumsum(new) - 1
    return number[new].astype(x.dtype), inverse


def distinct_hashes(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``np.unique(h, return_index=True, return_inverse=True)`` of 64-bit hashes: sorted by their upper bits and place, which
    orders them unless two hashes differ in the lower bits alone."""
    place = len(h).bit_length()
    low = np.uint64((1 << place) - 1)
    at = (np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
    row = h[at]
    new = np.append(True, row[1:] != row[:-1])[:len(h)]
    if ((row[1:] & ~low) == (row[:-1] & ~low))[new[1:]].any():
        return np.unique(h, return_index=True, return_inverse=True)
    inverse = np.empty(len(h), np.int64)
    inverse[at] = np.cumsum(new) - 1
    return row[new], at[new], inverse


def word_list(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The spans of ``buf``, a blank after each, and where each begins (and the last one ends)."""
    size = e - s + 1
    edge = np.concatenate([[0], np.cumsum(size)])
    source = np.arange(edge[-1]) + np.repeat(s - edge[:-1], size)
    out = buf[np.minimum(source, len(buf) - 1)]
    out[edge[1:] - 1] = 32
    return out.tobytes(), edge


def _blocks(bits):
    """Per block of documents: ids, token numbers, and per shard the distinct words with training counts."""
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        for number, b in enumerate(T.slices(batches, "text", BLOCK_BYTES)):
            buf, offs = T.text_buffer(b.column("text"))
            buf = T.ascii_lower(buf)
            s, e, row = T.word_spans(buf, offs)
            uniq, first, token = distinct_hashes(T.span_hashes(buf, s, e))
            ids = b.column("doc_id").to_pylist()
            train = np.array([not held_out(i) for i in ids], bool)
            count = np.bincount(token[train[row]], minlength=len(uniq))
            shard = (uniq >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(uniq), np.int64)
            cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(uniq) else np.zeros(0, np.int64)
            words, edge = word_list(buf, s[first], e[first])
            asked = [{"shard": int(shard[lo]), "words": words[edge[lo]: edge[hi] - 1], "counts": _pack(count[lo:hi])}
                     for lo, hi in zip(cut, np.append(cut[1:], len(uniq)))]
            yield pa.RecordBatch.from_arrays([
                pa.array([f"{part}-{number}"]), pa.array([ids], pa.list_(b.column("doc_id").type)), pa.array([train.tolist()], pa.list_(pa.bool_())),
                pa.array([_pack(np.bincount(row, minlength=len(ids)))]), pa.array([_pack(token)]),
                pa.array([asked], pa.list_(pa.struct([("shard", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])))],
                names=["block", "ids", "train", "sizes", "tokens", "asked"])
    return run


def _grouped(batches, key):
    """Runs of equal ``key`` in a sorted stream, as lists of row dicts."""
    now, rows = None, []
    for b in batches:
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in b.schema.names}
            if rows and r[key] != now:
                yield now, rows
                rows = []
            now = r[key]
            rows.append(r)
    if rows:
        yield now, rows


def _word_hashes(blob: bytes):
    buf = np.frombuffer(blob, np.uint8)
    s, e, _ = T.word_spans(buf, np.array([0, len(buf)]))
    return T.span_hashes(buf, s, e), s, e


def _vocabulary(bits):
    """Per shard the distinct words with summed counts; per block and shard, which of them it asked for, with their counts."""
    def run(batches):
        for shard, rows in _grouped(batches, "shard"):
            parts = [_word_hashes(r["words"]) for r in rows]
            uniq, first, at = distinct_hashes(np.concatenate([h for h, _, _ in parts]))
            if len(uniq) << bits > EDGE - (1 << bits):
                raise ValueError("more than 2**32 word numbers")
            count = np.zeros(len(uniq), np.int64)
            np.add.at(count, at, np.concatenate([_unpack(r["counts"]) for r in rows]).astype(np.int64))
            edge = np.concatenate([[0], np.cumsum([len(h) for h, _, _ in parts])])
            begin = np.cumsum([0] + [len(r["words"]) for r in rows])
            s, e = (np.concatenate([p[k] + lo for p, lo in zip(parts, begin)])[first] for k in (1, 2))
            words = word_list(np.frombuffer(b"".join(r["words"] for r in rows), np.uint8), s, e)[0][:-1]
            out = [[shard, None, words, count.tobytes(), None]]
            out += [[shard, r["block"], None, _pack_long(count[at[lo:hi]]), _pack_steps(at[lo:hi])] for r, lo, hi in zip(rows, edge[:-1], edge[1:])]
            for lo in range(0, len(out), 64):
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out[lo: lo + 64]], t) for c, t in enumerate(
                    (pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "block", "words", "counts", "asked"])
    return run


def reseat(rng, count: np.ndarray, new_weight: np.ndarray, d: float) -> np.ndarray:
    """Tables after seating ``count`` customers of each dish one after another.

    ``new_weight``: (theta + d * tables of the restaurant) * base probability.
    """
    tables = (count > 0).astype(np.int64)
    live = np.flatnonzero(count > 1)
    j, step = 1, 1
    while len(live):
        k = np.minimum(step, count[live] - j)
        middle = j + (k - 1) / 2
        w = new_weight[live]
        tables[live] += rng.binomial(k, w / (w + middle - d * tables[live]))
        j += step
        step = 1 if j < 32 else max(1, j // 4)
        live = live[count[live] > j]
    return tables


class Speller:
    """Seatings of the spelling restaurants, and the probabilities they predict.

    A code is the ``ORDER`` bytes before (oldest first) and the next byte as
    one number; its remainder by SYMBOLS**l is the code one level up, in the
    restaurant of the l - 1 bytes before, down to l = 1, the root. A level
    keeps the codes it has seated with their own share of probability, and per
    restaurant the share left to its parent.
    """

    def __init__(self):
        none = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        self.levels, self.d = [none] * (ORDER + 1), 0.5  # by number of bytes before: codes, share, contexts, left, tables

    def probability(self, codes: np.ndarray, depth: int = ORDER) -> np.ndarray:
        p = np.full(len(codes), 1 / (SYMBOLS - 1))
        for l in range(depth + 1):
            code = codes % SYMBOLS ** (l + 1)
            at, share, contexts, left, _ = self.levels[l]
            p = _lookup(contexts, left, code // SYMBOLS, 1.0) * p + _lookup(at, share, code, 0.0)
        return p

    def sweep(self, rng, codes: np.ndarray, counts: np.ndarray) -> Speller:
        """A new seating given this one; codes (sorted) with their customers, which are the tables of words."""
        new, d = Speller(), self.d
        for l in range(ORDER, -1, -1):
            context, of = np.unique(codes // SYMBOLS, return_inverse=True)
            _, _, old, _, tables = self.levels[l]
            base = self.probability(codes, l - 1)
            t = reseat(rng, counts, (THETA + d * _lookup(old, tables, context, 0.0)[of]) * base, d)
            total, seated = np.bincount(of, counts, len(context)), np.bincount(of, t, len(context))
            new.levels[l] = (codes, (counts - d * t) / (total[of] + THETA), context, (THETA + d * seated) / (total + THETA), seated)
            up, where = np.unique(codes % SYMBOLS ** max(1, l), return_inverse=True)
            codes, counts = up, np.bincount(where, t, len(up)).astype(np.int64)
        return new


def _lookup(keys: np.ndarray, values: np.ndarray, at: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(at), default)
    k = np.minimum(np.searchsorted(keys, at), len(keys) - 1)
    return np.where(keys[k] == at, values[k], default)


def spelled(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Symbol codes of all words of a blank-joined list (end of word included), and the word of each."""
    x = np.frombuffer(words + b" ", np.uint8).astype(np.int64)
    last = x == 32
    word = np.cumsum(last) - last
    x = np.where(last, END, x)
    place = np.arange(len(x)) - np.append(0, np.flatnonzero(last) + 1)[word]  # within the word
    code = x.copy()
    for back in range(1, ORDER + 1):
        before = np.append(np.full(back, START), x)[: len(x)]
        code += np.where(place >= back, before, START) * SYMBOLS ** back
    return code, word


def spelled_once(words: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct symbol codes of a list of words, and of each symbol its code's place and its word."""
    codes, word = spelled(words)
    return *distinct(codes), word


def base_log(speller: Speller, words: bytes, parts=None) -> np.ndarray:
    code, at, word = parts or spelled_once(words)
    return np.bincount(word, np.log(speller.probability(code))[at])


def seated_log(count, tables, all_tables, d: float, base) -> np.ndarray:
    """Log probability of dishes, times (customers of the restaurant + THETA); ``base`` is the log of the parent's."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(count - d * tables), np.log(THETA + d * all_tables) + base)


def _numbered(rows, bits):
    """A block (shard -1) with the answers of the word shards: its distinct pairs by shard, shards, the pair and document of
    each token (borders included), the counts of its words, their tokens and the sizes of its documents."""
    own, told = rows[0], [r for r in rows if r["kind"] == 1]
    assert own["kind"] == 0
    word = np.concatenate([(_unpack_steps(r["asked"]).astype(np.uint64) << np.uint64(bits)) | np.uint64(r["shard"]) for r in told] + [
        np.array([EDGE], np.uint64)])
    count = np.concatenate([_unpack_long(r["counts"]) for r in told] or [np.zeros(0, np.int64)])
    token, sizes = _unpack(own["tokens"]), _unpack(own["sizes"]).astype(np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes + 1)
    inner = np.ones(len(doc), bool)
    inner[np.cumsum(sizes + 1) - 1] = False
    after = np.full(len(doc), len(word) - 1)
    after[inner] = token
    before = np.append(len(word) - 1, after[:-1])  # the border after a text stands before the next one
    ranked, rank = distinct(word)
    pairs, pair = distinct(rank[before] * len(ranked) + rank[after])  # in the order of their words' numbers
    first = pairs // len(ranked)
    key = (ranked[first] << np.uint64(32)) | ranked[pairs - first * len(ranked)]
    shard = (T.mix(key) >> np.uint64(64 - bits)).astype(np.int64)
    order = np.argsort(shard.astype(np.uint16) if bits <= 16 else shard, kind="stable")  # 16 bits: radix sort
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    return key[order], shard[order], rank[pair], doc, count, token, sizes


def _asked_pairs(bits):
    """Sorted by (block, kind, shard): per block and pair shard the distinct pairs with training counts."""
    def run(batches):
        for block, rows in _grouped(batches, "block"):
            key, shard, pair, doc, *_ = _numbered(rows, bits)
            count = np.bincount(pair[np.array(rows[0]["train"], bool)[doc]], minlength=len(key))
            cut = np.flatnonzero(np.append(True, shard[1:] != shard[:-1]))
            runs = list(zip(cut, np.append(cut[1:], len(key))))
            first, then = key >> np.uint64(32), key & np.uint64(EDGE)
            yield pa.RecordBatch.from_arrays([
                pa.array([block] * len(cut)), pa.array(shard[cut]), pa.array([_pack_steps(first[lo:hi]) for lo, hi in runs]),
                pa.array([_pack(then[lo:hi]) for lo, hi in runs]), pa.array([_pack(count[lo:hi]) for lo, hi in runs])],
                names=["block", "shard", "u", "w", "n"])
    return run


ASK = pa.list_(pa.struct([("shard", pa.int64()), ("at", pa.binary())]))
WHERE = pa.list_(pa.struct([("block", pa.string()), ("at", pa.binary())]))
TOLD = pa.list_(pa.struct([("shard", pa.int64()), ("customers", pa.binary()), ("tables", pa.binary())]))


def _pair_shards(bits):
    """Per shard its distinct pairs as places in the list of their words (by word shard and number; the border comes last)
    with summed counts, the words it asks of each word shard, and per block which pairs that asked for."""
    def run(batches):
        for shard, rows in _grouped(batches, "shard"):
            parts = [_unpack_steps(r["u"]) for r in rows]
            edge = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
            named, rank = distinct(np.concatenate([*parts, *(_unpack(r["w"]) for r in rows)]).astype(np.uint64))
            key, at = distinct(rank[:edge[-1]] * len(named) + rank[edge[-1]:])  # in the order of their words' numbers
            n = np.bincount(at, np.concatenate([_unpack(r["n"]) for r in rows]), len(key)).astype(np.int64)
            first = key // len(named)
            then = key - first * len(named)
            word = named[:-1] if named[-1] == EDGE else named  # the border comes last
            of = (word & np.uint64((1 << bits) - 1)).astype(np.int64)
            order = np.argsort(of, kind="stable")
            place = np.full(len(word) + 1, len(word))
            place[order] = np.arange(len(word))
            of, number = of[order], word[order] >> np.uint64(bits)
            cut = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                pa.array([shard]), pa.array([_pack_steps(place[first])]), pa.array([_pack(place[then])]),
                pa.array([_pack_long(n)]), pa.array([int((n == 1).sum())]), pa.array([int((n == 2).sum())]),
                pa.array([[{"shard": int(of[lo]), "at": _pack_steps(number[lo:hi])} for lo, hi in zip(cut, np.append(cut[1:], len(of)))]], ASK),
                pa.array([[{"block": r["block"], "at": _pack_steps(at[lo:hi])} for r, lo, hi in zip(rows, edge[:-1], edge[1:])]], WHERE)],
                names=["shard", "u", "w", "n", "once", "twice", "ask", "blocks"])
    return run


def _tell(samples, last):
    """Per pair shard that asked: log probability and tables as context of its words, for each sample; at last also their counts."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                count = np.frombuffer(r["counts"], np.int64)
                logs, contexts, parts = [], [], spelled_once(r["words"])
                for (speller, customers, tables, d), state in zip(samples.value, r["states"]):
                    c, t, as_context = [_unpack_long(state[k]) if state[k] else np.zeros(len(count), np.int64) for k in ("customers", "tables", "contexts")]
                    logs.append((seated_log(c, t, tables, d, base_log(speller, r["words"], parts)) - math.log(customers + THETA)).astype(np.float32))
                    contexts.append(as_context)
                asks = r["asks"] or []
                at = [_unpack_steps(a["at"]) for a in asks]
                yield pa.RecordBatch.from_arrays([
                    pa.array([a["shard"] for a in asks], pa.int64()), pa.array([r["shard"]] * len(asks), pa.int64()),
                    pa.array([_pack_logs([x[k] for x in logs]) for k in at], pa.list_(pa.binary())),
                    pa.array([[_pack_long(x[k]) for x in contexts] for k in at], pa.list_(pa.binary())),
                    pa.array([_pack_long(count[k]) if last else None for k in at], pa.binary())],
                    names=["pairs", "shard", "logs", "contexts", "counts"])
    return run


def _pack_logs(logs: list[np.ndarray]) -> list[bytes]:
    """The floats of each sample; after the first as steps from the sample before, since the samples of a word are close."""
    bits = [x.view(np.int32) for x in logs]
    steps = [y - x for x, y in zip(bits, bits[1:])]
    return [_pack(x.view(np.uint32)) for x in (*bits[:1], *((d << 1) ^ (d >> 31) for d in steps))]


def _unpack_logs(packed: list[bytes]):
    """The floats of one sample after the other."""
    bits = None
    for b in packed:
        x = _unpack(b).view(np.int32)
        bits = x if bits is None else bits + ((x.view(np.uint32) >> np.uint32(1)).view(np.int32) ^ -(x & 1))
        yield bits.view(np.float32)


def _heard(told, edges):
    """Of each sample, (log probability, tables as context) of the words of a pair shard, with the border's last."""
    logs = [_unpack_logs(m["logs"]) for m in told]
    for k, edge in enumerate(edges):
        yield (np.concatenate([next(x) for x in logs] + [[edge[0]]]),
               np.concatenate([_unpack_long(m["contexts"][k]) for m in told] + [[edge[1]]]))


def _seat_pairs(edge, d, sweep):
    """Reseat the pairs of each shard; their tables by word and by context, for each word shard."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                u, w, n = _unpack_steps(r["u"]), _unpack(r["w"]), _unpack_long(r["n"])
                log, contexts = next(_heard(r["told"] or [], [edge]))
                t = reseat(np.random.default_rng([SEED, sweep, r["shard"], 1]), n, (THETA + d * contexts[u]) * np.exp(log[w]), d)
                word, context = (np.bincount(x, t, len(log)).astype(np.int64) for x in (w, u))
                cut = np.cumsum([0] + [len(_unpack_steps(a["at"])) for a in r["ask"]])
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["shard"]]), pa.array([_pack_long(t)]), pa.array([int(word[-1])]), pa.array([int(context[-1])]),
                    pa.array([[{"shard": a["shard"], "customers": _pack_long(word[lo:hi]), "tables": _pack_long(context[lo:hi])}
                               for a, lo, hi in zip(r["ask"], cut[:-1], cut[1:])]], TOLD)],
                    names=["shard", "tables", "edge_customers", "edge_tables", "told"])
    return run


def _sweep(speller, d, tables, sweep):
    """Add up the customers of the word restaurant and reseat them in each shard; count the spellings of its tables."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                count, contexts = (np.zeros(len(r["counts"]) // 8, np.int64) for _ in range(2))
                for ask, m in zip(r["asks"] or [], r["told"] or []):
                    assert ask["shard"] == m["shard"]
                    at = _unpack_steps(ask["at"])
                    count[at] += _unpack_long(m["customers"])
                    contexts[at] += _unpack_long(m["tables"])
                code, at, word = spelled_once(r["words"])
                t = reseat(np.random.default_rng([SEED, sweep, r["shard"]]), count,
                           (THETA + d * tables) * np.exp(base_log(speller.value, r["words"], (code, at, word))), d)
                many = np.bincount(at, t[word], len(code)).astype(np.int64)
                used = many > 0
                yield pa.RecordBatch.from_arrays([
                    b.column("shard").slice(i, 1), *[pa.array([_pack_long(x)]) for x in (count, t, contexts)],
                    *[pa.array([int(x.sum())]) for x in (count, t, count == 1, count == 2)],
                    pa.ListArray.from_arrays(pa.array([0, int(used.sum())], pa.int32()), pa.StructArray.from_arrays(
                        [pa.array(code[used]), pa.array(many[used])], names=["code", "n"]))],
                    names=["shard", "customers", "tables", "contexts", "n", "total", "once", "twice", "spelling"])
    return run


def _means(edges, d, ends):
    """Per pair shard the log10 probabilities of its pairs, the mean of the samples."""
    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in b.schema.names}
                u, w, n = _unpack_steps(r["u"]), _unpack(r["w"]), _unpack_long(r["n"])
                told = r["told"] or []
                followed = np.concatenate([_unpack_long(m["counts"]) for m in told] + [[ends]])
                lp = np.full(len(n), -np.inf)
                for (log, contexts), t in zip(_heard(told, edges), r["tables"]):
                    lp = np.logaddexp(lp, seated_log(n, _unpack_long(t), contexts[u], d, log[w]))
                lp = ((lp - math.log(len(edges)) - np.log(followed[u] + THETA)) / math.log(10)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([r["shard"]]), pa.array([lp.tobytes()])], names=["shard", "lp"])
    return run


def _answers(batches):
    """Per block that asked: the log10 probabilities of its pairs."""
    for b in batches:
        for i in range(b.num_rows):
            r = {c: b.column(c)[i].as_py() for c in b.schema.names}
            lp = np.frombuffer(r["lp"], np.float32)
            for lo in range(0, len(r["blocks"]), 64):
                part = r["blocks"][lo: lo + 64]
                yield pa.RecordBatch.from_arrays([pa.array([a["block"] for a in part]), pa.array([r["shard"]] * len(part)),
                                                  pa.array([_pack(lp[_unpack_steps(a["at"])].view(np.uint32)) for a in part])], names=["block", "shard", "lp"])


def _pack_long(x: np.ndarray) -> bytes:
    return zstandard.compress(x.astype(np.int64).view(np.uint8).reshape(-1, 8).T.tobytes(), 3)


def _unpack_long(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(8, -1).T).view(np.int64).ravel()


def _scores(bits, n_all, vocabulary, end_count):
    """Sorted by (block, kind, shard): the block, then the answers of the word shards, then those of the pair shards."""
    def log_base(c):
        return np.log10((c + 0.1) / (n_all + 0.1 * (vocabulary + 1)))

    def run(batches):
        for _, rows in _grouped(batches, "block"):
            own = rows[0]
            _, _, pair, doc, count, token, sizes = _numbered(rows, bits)
            lp = np.concatenate([_unpack(r["lp"]).view(np.float32) for r in rows if r["kind"] == 2] or [np.full(len(pair), np.nan)]).astype(np.float64)
            word_doc = np.repeat(np.arange(len(sizes)), sizes)

            def total(x):
                return np.bincount(word_doc, x[token], minlength=len(sizes))

            base, score = total(log_base(count)) + log_base(end_count), np.bincount(doc, lp[pair], len(sizes))
            yield pa.RecordBatch.from_arrays([
                pa.array(own["ids"]), pa.array([not t for t in own["train"]]), pa.array(sizes + 1),
                pa.array(total((count > 0).astype(float)).astype(np.int64) + int(end_count > 0)),
                pa.array(np.full(len(sizes), n_all)), pa.array(base), pa.array(score, mask=np.isnan(score))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    return run


def _discount(once, twice) -> float:
    return min(0.95, max(0.05, (once or 0) / max(1, (once or 0) + 2 * (twice or 0))))


def _listed(messages: DataFrame, key: str, *columns: str) -> DataFrame:
    """(shard, told): all messages to a shard in the order of their senders."""
    return messages.groupBy(F.col(key).alias("to")).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("told"))


def _with(kept: DataFrame, messages: DataFrame) -> DataFrame:
    return kept.join(messages, kept["shard"] == messages["to"], "left").drop("to")


def score_texts(docs: DataFrame, *, burn: int = BURN, samples: int = SAMPLES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row."""
    spark = docs.sparkSession
    docs = pick(docs, "doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(4, math.ceil(math.log2(max(1, size / SHARD_BYTES))))  # shards grow with the corpus, so one stays small
    blocks = written(docs.mapInArrow(_blocks(bits), f"block string, ids array<{kind}>, train array<boolean>, sizes binary, tokens binary, "
                                     "asked array<struct<shard: long, words: binary, counts: binary>>"), "lm-blocks")
    shards = written(blocks.select("block", F.inline("asked")).repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _vocabulary(bits), "shard long, block string, words binary, counts binary, asked binary"), "lm-shards")
    vocab = shards.filter("block is null").select("shard", "words", "counts")
    asking, blocks = blocks, written(blocks.drop("asked"), "lm-tokens")
    discard(asking)  # its lists of words are in the shards now

    def totals(batches):
        for b in batches:
            for c in b.column("counts"):
                c = np.frombuffer(c.as_py(), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(x)]) for x in (c.sum(), (c > 0).sum(), (c == 1).sum(), (c == 2).sum())],
                                                 names=["n", "v", "once", "twice"])

    got = vocab.mapInArrow(totals, "n long, v long, once long, twice long").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in
                                                                                 ("n", "v", "once", "twice")]).first()
    ends = blocks.agg(F.sum(F.size(F.filter("train", lambda t: t)))).first()[0] or 0
    n_all, v_all = got["n"] + ends, got["v"] + int(ends > 0)
    null = F.lit(None)
    own = ("ids", "train", "sizes", "tokens")
    meet = blocks.select("block", F.lit(0).alias("kind"), F.lit(-1).cast("long").alias("shard"), *own).unionByName(
        shards.filter("block is not null").select("block", F.lit(1).alias("kind"), "shard", "asked", "counts"), allowMissingColumns=True)
    if ends:
        answers = _pair_answers(spark, meet, vocab, bits, ends, _discount(got["once"], got["twice"]), burn, samples)
        meet = meet.unionByName(answers.select("block", F.lit(2).alias("kind"), "shard", "lp"), allowMissingColumns=True)
    else:
        meet = meet.withColumn("lp", null.cast("binary"))
    return meet.repartition("block").sortWithinPartitions("block", "kind", "shard").mapInArrow(
        _scores(bits, n_all, v_all, ends), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
        "base_score double, score double")


def _pair_answers(spark, meet: DataFrame, vocab: DataFrame, bits: int, ends: int, d: float, burn: int, samples: int) -> DataFrame:
    """block, shard, lp: per block and pair shard the log10 probabilities of the block's pairs, in their order."""
    asked = meet.drop("ids").repartition("block").sortWithinPartitions("block", "kind", "shard").mapInArrow(
        _asked_pairs(bits), "block string, shard long, u binary, w binary, n binary")
    pairs = written(asked.repartition("shard").sortWithinPartitions("shard").mapInArrow(
        _pair_shards(bits), "shard long, u binary, w binary, n binary, once long, twice long, ask array<struct<shard: long, at: binary>>, "
        "blocks array<struct<block: string, at: binary>>"), "lm-pairs")
    asks = _listed(pairs.select(F.col("shard").alias("pairs"), F.inline("ask")).select("pairs", F.col("shard").alias("of"), "at"), "of",
                   F.col("pairs").alias("shard"), "at").withColumnRenamed("told", "asks")
    words = written(_with(vocab, asks), "lm-words")
    seen = pairs.agg(F.sum("once").alias("once"), F.sum("twice").alias("twice")).first()
    d_pair = _discount(seen["once"], seen["twice"])
    message = "pairs long, shard long, logs array<binary>, contexts array<binary>, counts binary"
    state_kind = "struct<customers: binary, tables: binary, contexts: binary>"
    none = spark.createDataFrame([], f"shard long, s {state_kind}")
    # the word restaurant: customers, tables; those of the border in it; tables of the border's own restaurant
    speller, n, tables, edge_n, edge_t, edge_contexts = Speller(), 0.0, 0.0, 0, 0, 0

    shared = []

    def share(model):
        shared.append(spark.sparkContext.broadcast(model))
        return shared[-1]

    def let_go():  # a broadcast is a file on the driver and every executor until then
        while shared:
            shared.pop().destroy()

    def edge_now():
        log = seated_log(edge_n, edge_t, tables, d, base_log(speller, b"")[0]) - math.log(n + THETA)
        return float(log), edge_contexts

    def told(states, models, last):
        out = words
        for k, state in enumerate(states):
            out = out.join(state.select("shard", F.col("s").alias(f"s{k}")), "shard", "left")
        empty = F.struct(*[F.lit(None).cast("binary").alias(c) for c in ("customers", "tables", "contexts")])
        out = out.select("shard", "words", "counts", "asks", F.array(*[F.coalesce(f"s{k}", empty) for k in range(len(states))]).alias("states"))
        sent = out.mapInArrow(_tell(share(models), last), message)
        return _listed(sent, "pairs", "shard", "logs", "contexts", "counts")

    state, kept = none, []  # of each kept sweep: states, model, the border, tables of the pairs
    for sweep in range(burn + samples):
        seats = written(_with(pairs.select("shard", "u", "w", "n", "ask"), told([state], [(speller, n, tables, d)], False)).mapInArrow(
            _seat_pairs(edge_now(), d_pair, sweep), "shard long, tables binary, edge_customers long, edge_tables long, "
            "told array<struct<shard: long, customers: binary, tables: binary>>"), "lm-seats")
        back = seats.select(F.col("shard").alias("pairs"), F.inline("told")).select("pairs", F.col("shard").alias("of"), "customers", "tables")
        result = written(_with(words, _listed(back, "of", F.col("pairs").alias("shard"), "customers", "tables")).mapInArrow(
            _sweep(share(speller), d, tables, sweep), "shard long, customers binary, tables binary, contexts binary, "
            "n long, total long, once long, twice long, spelling array<struct<code: long, n: long>>"), "lm-sweep")
        let_go()
        at_edge = seats.agg(F.sum("edge_customers").alias("n"), F.sum("edge_tables").alias("t")).first()
        end_h = float(np.exp(base_log(speller, b"")[0]))
        edge_n, edge_contexts = int(at_edge["n"]), int(at_edge["t"])
        edge_t = int(reseat(np.random.default_rng([SEED, sweep]), np.array([edge_n]), np.array([(THETA + d * tables) * end_h]), d)[0])
        spelling = _spelling(result)
        codes, counts = spelling["code"].to_numpy(), spelling["n"].to_numpy()
        empty = spelled(b"")[0][0]
        k = np.searchsorted(codes, empty)
        codes, counts = np.insert(codes, k, empty), np.insert(counts, k, edge_t)
        sums = result.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "total", "once", "twice")]).first()
        n, tables = float(sums["n"] + edge_n), float(sums["total"] + edge_t)
        if sweep == 0:  # the tables of a first seating count contexts, as the word restaurant's customers do from here on
            d = _discount(sums["once"], sums["twice"])
        speller = speller.sweep(np.random.default_rng([SEED, sweep, 0, 2]), codes, counts)
        before, state = state, written(result.select("shard", F.struct("customers", "tables", "contexts").alias("s")), "lm-state")
        if sweep >= burn:
            kept.append((state, (speller, n, tables, d), edge_now(), written(seats.select("shard", F.col("tables").alias(f"t{sweep}")), "lm-tables")))
        discard(result, seats)
        if 0 < sweep <= burn:  # the states of a kept sweep are needed once more
            discard(before)
    # the pairs' probabilities first, then the blocks' lists: messages and answers are never on disk together
    out = _with(pairs.select("shard", "u", "w", "n"), told([x[0] for x in kept], [x[1] for x in kept], True))
    for _, _, _, seats in kept:
        out = out.join(seats, "shard")
    out = out.select("shard", "u", "w", "n", "told", F.array(*[c for c in out.columns if c.startswith("t") and c[1:].isdigit()]).alias("tables"))
    means = written(out.mapInArrow(_means([x[2] for x in kept], d_pair, ends), "shard long, lp binary"), "lm-means")
    let_go()
    discard(words, *[x[0] for x in kept], *[x[3] for x in kept])
    answers = written(pairs.select("shard", "blocks").join(means, "shard").mapInArrow(_answers, "block string, shard long, lp binary"), "lm-answers")
    discard(pairs, means)
    return answers


def _spelling(state: DataFrame):
    """(code, customers) of every code, sorted. Written first, so that the shuffle files of a sweep go with it."""
    codes = written(state.select(F.inline("spelling")).groupBy("code").agg(F.sum("n").alias("n")), "lm-spelling")
    got = codes.toArrow().sort_by("code")
    discard(codes)
    return got


def query(spark, sf_dir: str) -> DataFrame:
    from flowscore.llm.common import table
    return score_texts(table(spark, sf_dir, "documents"))
