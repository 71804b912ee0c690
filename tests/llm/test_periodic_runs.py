"""op13 against a plain search of every lag at every word."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from flowscore.llm import op13_periodic_runs as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """Every run as (start, length, period), by start, then period."""
    n, best = len(w), {}
    for q in range(n // 2, 0, -1):  # the smallest period of a stretch comes last
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i >= q and j - i + q >= 12:
                best[i, j + q] = q
            i = j + 1
    return sorted((a, b - a, q) for (a, b), q in best.items()) if n else []


def in_order(runs):
    return sorted(runs, key=lambda r: (r[0], r[2]))


def expected(doc_id, text):
    w = WORD.findall(text or "")
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = in_order(brute(w))
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (len(runs), *(top or (None,) * 3), 1000 * top[1] // top[2] if top else None,
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def shaped(rng, n, kinds):
    w = [f"v{rng.randrange(kinds)}" for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        s = rng.randrange(n)
        p = rng.randint(1, max(1, (n - s) // 2))
        for i in range(s, min(n, s + p * rng.randint(1, 12))):
            w[i] = w[s + (i - s) % p]
    return w


@pytest.mark.parametrize("kinds", [1, 2, 3, 40])
def test_runs_are_those_of_brute_force(kinds):
    rng = random.Random(kinds)
    for _ in range(300):
        w = [int(x[1:]) for x in shaped(rng, rng.randint(1, 150), kinds)]
        a, b, q = op.find_runs(np.array(w, np.int64))
        assert [(x, y - x, z) for x, y, z in zip(a.tolist(), b.tolist(), q.tolist())] == in_order(brute(w))


def test_nested_and_touching_periods():
    words = (["x"] * 20 + ["y"]) * 6 + ["z"] + ["p", "q"] * 8 + ["q"] * 12
    w = [sorted(set(words)).index(x) for x in words]
    a, b, q = op.find_runs(np.array(w, np.int64))
    assert [(x, y - x, z) for x, y, z in zip(a.tolist(), b.tolist(), q.tolist())] == in_order(brute(w))


def test_one_word_a_million_times_is_one_run():
    a, b, q = op.find_runs(np.zeros(1_000_000, np.int64))
    assert (a.tolist(), b.tolist(), q.tolist()) == ([0], [1_000_000], [1])


def rows():
    rng = random.Random(7)
    out = [(i, " ".join(shaped(rng, rng.randint(1, 200), rng.choice([1, 2, 5, 60])))) for i in range(150)]
    out += [(200, None), (201, ""), (202, " \t\n"), (None, None), (None, "a b " * 9), (3, "a b " * 9), (3, "another text"), (3, "another text"),
            (203, "Ünï\x0bcode\x0c " * 20), (204, "w " * 30_000), (205, "a b\nc  d\te\r" * 30)]
    return out


def key(row):
    return tuple((x is not None, x) for x in row)


def test_query_rows(spark):
    data = rows()
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in data], "doc_id long, text string, runs string, start long, n_runs long").repartition(3)
    got = [(r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256)
           for r in op.digest(op.periodic_runs(op.planted(docs))).collect()]
    slow = {204}  # the plain search takes too long there
    want = [(i, *expected(i, t)) for i, t in data if i not in slow]
    assert sorted((r for r in got if r[0] not in slow), key=key) == sorted(want, key=key)
    (long,) = [r for r in got if r[0] == 204]
    assert long[1:6] == (1, 0, 30_000, 1, 30_000_000) and long[7] == hashlib.sha256(b"w").hexdigest()


def test_empty_table_and_arguments(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert op.digest(op.periodic_runs(op.planted(empty))).count() == 0
    with pytest.raises(ValueError):
        op.periodic_runs(empty, 5)


def test_collapsed_text_and_longer_runs(spark):
    docs = spark.createDataFrame([(1, "a b " * 7 + "c"), (2, "k " * 12 + "l " * 40)], "doc_id long, text string")
    got = {r.doc_id: r for r in op.periodic_runs(docs, 20).collect()}
    assert got[1].collapsed == ("a b " * 7 + "c") and got[1].runs == []
    assert got[2].collapsed == "k " * 12 + "l" and [tuple(r) for r in got[2].runs] == [(12, 40, 1)] and got[2].n_words == 52
