"""Operators of flowscore.llm against brute force on small tables with the hard cases."""

import base64
import hashlib
import re
import zlib

import pytest

from flowscore.llm import (op1_suffix_dedup, op2_quality_rules, op3_warc, op4_decontaminate, op5_site_bayes, op6_pitman_yor,
                           op7_license_scan, op8_ngram_join, op9_line_dedup, op10_mix_sources)

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{i % 997}x{i * 7919 % 10007}" for i in range(3000))
PASSAGE = " ".join(f"p{i}" for i in range(120))


def texts():
    out = [None, "", " \t\n", "one", "one two three", LONG, LONG + " tail", "head " + LONG, "a b a b a b a b", "x\n\nx\ny\nx",
           "Ünï\x0bcode wörds\x0c here", "# $ % & | < >", PASSAGE, "before " + PASSAGE + " after", "a" * 900, PASSAGE + "\n" + PASSAGE]
    return [(i, t) for i, t in enumerate(out)] + [(100 + i, "line one here\nline two here\nown %d" % i) for i in range(5)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "src0" if i % 3 else None, "en", "clash") for i, t in texts()]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, h string").repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string")


@pytest.mark.parametrize("split", [4096, 1])
def test_suffix_dedup(docs, empty, split):
    length, count, expect = 400, {}, {}
    for _, t in texts():
        b = (t or "").encode()
        for s in range(len(b) - length + 1):
            count[b[s: s + length]] = count.get(b[s: s + length], 0) + 1
    for i, t in texts():
        b = (t or "").encode()
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if count[b[s: s + length]] > 1:
                gone[s: s + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = len(re.findall(rb"\x01+", bytes(gone)))
        expect[i] = (len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op1_suffix_dedup.suffix_dedup(docs, split=split).collect()}
    assert got == expect
    assert op1_suffix_dedup.suffix_dedup(empty).count() == 0


def test_quality_statistics(docs, empty, spark):
    labels = spark.createDataFrame([(1, 0, 0), (5, 1, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in op2_quality_rules.quality_rules(docs, labels).collect()}
    for i, t in texts():
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        grams = [tuple(w[k: k + 3]) for k in range(len(w) - 2)]
        hit = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)} if len(w) < 500 else set()
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(hit))
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w))
        assert not (r.base_failed and r.kept)
    assert op2_quality_rules.quality_rules(empty, labels).count() == 0


def test_rules_learn_and_keep_clean_rows(spark):
    """Held-out rows: a junk class is rejected, clean rows stay."""
    rows, labels = [], []
    for i in range(400):
        junk = i % 4 == 0
        rows.append((i, " ".join(f"word{(i * 31 + k * k) % 1009}" + ("!!" if junk else "") for k in range(80))))
        if i < 300:
            labels.append((i, 0 if junk else 1, 0))
    out = op2_quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"),
                                          spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert all(r.kept == (r.doc_id % 4 != 0) for r in out)


def test_warc_round_trip(spark, tmp_path):
    inner = op3_warc._record(77, "x", b"inner", None, "d").decode()
    rows = [(1, "u", "<a>", 0), (2, "u", "<a>", 0), (3, None, None, 0), (4, "u v\n", "", 0), (5, "u", "WARC/1.1\r\n", 0),
            (6, "u", "pre" + inner + "\r\n\r\n" + inner + "x" * 900, 0), (7, "é", "é" * 2000, 0),
            (8, "u", "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 99999\r\n\r\n", 0)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")  # many splits a file
    try:
        op3_warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string, file int").coalesce(2), str(tmp_path / "w"))
        got = {r.page_id: r for r in op3_warc.read_warc(spark, str(tmp_path / "w")).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted(got) == list(range(1, 9))
    for i, _, html, _ in rows:
        b = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
    assert {i: r.refers_to for i, r in got.items() if r.record_type == "revisit"} == {1: 2, 3: 4}


def test_decontamination_finds_reordered_passages(spark, empty):
    item = [f"t{i}" for i in range(40)]
    moved = " ".join(item[20:]) + " Filler, here. " + " ".join(item[:20])
    docs = spark.createDataFrame([(1, "x " + " ".join(item).upper() + ". y"), (2, moved), (3, " ".join(item[:24])), (4, None), (5, "")],
                                 "doc_id long, text string")
    bench = spark.createDataFrame([(9, " ".join(item)), (10, "tiny text"), (11, None), (12, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_covered for r in op4_decontaminate.contaminated(docs, bench).collect()}
    assert got == {(1, 9): 40, (2, 9): 40}
    assert op4_decontaminate.contaminated(empty, bench).count() == 0
    assert op4_decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_site_posteriors(spark, docs, empty):
    from pyspark.sql import functions as F
    rows = [(i, ("vile " if i % 5 == 0 else "") + " ".join(f"w{(i * k) % 501}" for k in range(60)), f"h{i % 3}", "p") for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    y = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(700)], "doc_id long, quality int, toxic int")
    out = op5_site_bayes.classify(d, y, F.col("source"), F.col("lang")).collect()
    assert all(r.kept == (r.doc_id % 5 != 0) for r in out) and len(out) == 900
    assert op5_site_bayes.classify(docs, y.limit(0), F.col("source"), F.col("lang")).filter("kept").count() == len(texts())
    assert op5_site_bayes.classify(empty, y, F.col("source"), F.col("lang")).count() == 0


def test_site_indicators_of_few_labels(spark):
    """399 labels: ten rare toxic words are found, words of a group of copies that happens to be toxic are not."""
    from pyspark.sql import functions as F
    rows, toxic = [], set()
    for i in range(600):
        w = [f"w{(i * 37 + k * (i % 11 + 7)) % 701}" for k in range(60)]
        if i % 8 == 0:
            toxic.add(i)
            w[i % 60] = f"vile{i // 8 % 5}"
        if 8 <= i % 40 < 11 and i % 8:  # near copies, labelled toxic
            toxic.add(i)
            w = [f"copied{k}" for k in range(60)] + [f"own{i}"]
        if i % 40 == 13:  # clean texts with words of the copies
            w[5], w[40] = "copied3", "copied44"
        rows.append((i, " ".join(w), "s", "p"))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    y = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(399)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r.kept for r in op5_site_bayes.classify(d, y, F.col("source"), F.col("lang")).collect()}
    assert not any(got[i] for i in range(0, 600, 8))
    assert all(got[i] for i in range(600) if i not in toxic)


def test_language_model_counts(docs, empty):
    import collections
    import math
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tok = {i: WORD.findall((t or "").translate(lower)) + ["\n"] for i, t in texts()}
    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in tok}
    c = collections.Counter(w for i, t in tok.items() if not out[i] for w in t)
    n, v = sum(c.values()), len(c)
    for r in op6_pitman_yor.score_texts(docs).collect():
        base = sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (
            out[r.doc_id], len(tok[r.doc_id]), sum(c[w] > 0 for w in tok[r.doc_id]), n)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert op6_pitman_yor.score_texts(empty).count() == 0


def test_spelling_probabilities_sum_to_one():
    import numpy as np
    rng = np.random.default_rng(1)
    codes, _ = op6_pitman_yor.spelled(b"abc abd b abab")
    uniq, n = np.unique(codes, return_counts=True)
    s = op6_pitman_yor.Speller().sweep(rng, uniq, n)
    for context in {int(c) // op6_pitman_yor.SYMBOLS for c in uniq} | {12345}:
        symbols = np.array([x for x in range(op6_pitman_yor.SYMBOLS) if x != op6_pitman_yor.START])
        assert s.probability(context * op6_pitman_yor.SYMBOLS + symbols).sum() == pytest.approx(1)


def test_language_model_knows_word_order(spark):
    """Held-out texts in the order of the training texts beat the same words in another order."""
    import random
    rnd = random.Random(5)
    follow = {w: [rnd.randrange(40) for _ in range(2)] for w in range(40)}
    rows = []
    for i in range(400):
        w = [rnd.randrange(40)]
        for _ in range(40):
            w.append(rnd.choice(follow[w[-1]]))
        rows.append((str(i), " ".join(f"word{x}" for x in w)))
    moved = [(i + "s", " ".join(rnd.sample(t.split(), 41))) for i, t in rows]
    held = op6_pitman_yor.held_out
    d = spark.createDataFrame([r for r in rows if not held(r[0])] + [("h%d" % k, t) for k, (_, t) in enumerate(moved + rows) if held("h%d" % k)],
                              "doc_id string, text string")
    got = {r.doc_id: r for r in op6_pitman_yor.score_texts(d).collect()}
    pairs = [(got[f"h{k}"].score, got[f"h{k}"].base_score) for k in range(400, 800) if f"h{k}" in got]
    shuffled = [got[f"h{k}"].score for k in range(400) if f"h{k}" in got]
    assert min(s for s, _ in pairs) > max(shuffled) and all(s > b for s, b in pairs)


def test_pair_probabilities_sum_to_one(spark):
    """Held-out one-word texts: after the border, all words of the training texts and the rest of the spellings share 1."""
    held = op6_pitman_yor.held_out
    train = [str(i) for i in range(200) if not held(str(i))]
    ask = [str(i) for i in range(1000, 1200) if held(str(i))][:2]
    rows = [(i, "aa" if int(i) % 4 else "bb") for i in train] + [(ask[0], "aa"), (ask[1], "bb")]
    got = {r.doc_id: r.score for r in op6_pitman_yor.score_texts(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    ratio = 10 ** (got[ask[0]] - got[ask[1]])
    assert 2.5 < ratio < 3.6 and 0.9 < 10 ** got[ask[0]] + 10 ** got[ask[1]] < 1


def test_spelling_seats_every_code(spark, monkeypatch):
    """No code is dropped or relabelled, however many there are."""
    import numpy as np
    monkeypatch.setattr(op6_pitman_yor, "MAX_CODES", 8, raising=False)
    codes, n = np.unique(op6_pitman_yor.spelled(b" ".join(b"%d" % (i * 7919) for i in range(300)))[0], return_counts=True)
    s = op6_pitman_yor.Speller().sweep(np.random.default_rng(1), codes, n)
    assert s.levels[op6_pitman_yor.ORDER][0].tolist() == codes.tolist()
    state = spark.createDataFrame([([(int(c), int(k)) for c, k in zip(codes, n)],)], "spelling array<struct<code: long, n: long>>")
    got = op6_pitman_yor._spelling(state)
    assert got["code"].to_pylist() == codes.tolist() and got["n"].to_pylist() == n.tolist()


def test_license_inheritance(spark, empty):
    from pyspark.sql import functions as F
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code only"), (3, "a/b/y.py", "# Licensed under CC BY-NC 4.0.\n" + "code that does much more than that line\n" * 3),
            (4, "c/z.py", None), (5, None, ""), (6, "a/b/COPYING", "Licensed under the Apache License, Version 2.0."), (7, "a/t.py", "t")]
    d = spark.createDataFrame(rows, "doc_id long, p string, text string")
    got = {r.doc_id: (r.license, r.license_from) for r in op7_license_scan.scan(d, F.col("p")).collect()}
    assert got == {1: ("MIT", "header"), 2: ("Apache-2.0", "directory"), 3: ("CC-BY-NC-4.0", "header"), 4: (None, None), 5: (None, None),
                   6: ("Apache-2.0", "header"), 7: ("MIT", "directory")}
    assert op7_license_scan.scan(empty, F.col("source")).count() == 0


def brute_components(rows, k, num, den):
    def shingles(t):
        w = WORD.findall((t or "").lower())
        return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if sets[a] and sets[b] and comp[a] != comp[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                    low = min(comp[a], comp[b])
                    comp[a] = comp[b] = low
                    changed = True
    return {i: (len(sets[i]), comp[i]) for i in sets}


def test_ngram_components(spark, docs, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8_ngram_join.ngram_components(docs).collect()}
    assert got == brute_components(texts(), 4, 85, 100)
    assert op8_ngram_join.ngram_components(empty).count() == 0
    # a chain of near copies, more than a leaf holds, and small chunks
    base = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(90):
        w = list(base)
        for j in range(i % 30):
            w[(j * 11) % 200] = f"e{j}"
        rows.append((i, " ".join(w)))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op8_ngram_join.ngram_components(d, chunk=20, frequent=10).collect()}
    assert got == brute_components(rows, 4, 85, 100)


def test_line_dedup(spark, docs, empty):
    got = {r.doc_id: r for r in op9_line_dedup.line_dedup(docs).collect()}
    seen, want = set(), {}
    for i, t in sorted(texts()):
        lines = (t or "").split("\n")
        units = [k for k, x in enumerate(lines) if WORD.search(x)]
        wins = [(j, 2, tuple(lines[k] for k in units[j: j + 2])) for j in range(len(units) - 1)]
        wins += [(j, 1, (lines[k],)) for j, k in enumerate(units) if len(WORD.findall(lines[k])) >= 50]
        gone = set()
        for j, n, c in wins:
            if c in seen:
                gone |= set(range(j, j + n))
            seen.add(c)
        dead = {units[j] for j in gone}
        want[i] = (len(units), len(gone), None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in dead))
    assert {i: (r.n_lines, r.n_removed, r.text) for i, r in got.items()} == want
    assert got[101].h == "clash" and op9_line_dedup.line_dedup(empty).count() == 0


def test_mix_meets_budget(spark, empty):
    rows = [(i, "w " * (1 + i % 7), "big" if i % 10 else ("small" if i % 20 else None)) for i in range(2000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    words = {i: 1 + i % 7 for i in range(2000)}
    out = op10_mix_sources.mix_sources(d, blocks=8).collect()
    by = {}
    for r in out:
        by.setdefault(r.source, []).append(r)
    for rs in by.values():
        total = sum(words[r.doc_id] for r in rs)
        assert rs[0].source_budget <= total < rs[0].source_budget + 7
        assert max(r.copy for r in rs) < 4
        assert len({(r.doc_id, r.copy) for r in rs}) == len(rs)
    assert op10_mix_sources.mix_sources(empty).count() == 0


# --- rows without an id, rows that share one, equal rows ----------------------

SHARED = " ".join(f"s{i * 37 % 1009}" for i in range(190))  # more than 800 bytes


def test_suffix_dedup_without_ids(spark):
    other = " ".join(f"o{i}" for i in range(200))
    rows = [(None, "head " + SHARED), (None, SHARED + " tail"), (4, "x " + SHARED), (5, other), (5, "y " + SHARED + "é" * 300), (6, other + " end"), (6, other + " end")]
    count, want = {}, []
    for _, t in rows:
        x = t.encode()
        for k in range(len(x) - 399):
            count[x[k: k + 400]] = count.get(x[k: k + 400], 0) + 1
    for i, t in rows:
        x = t.encode()
        gone = bytearray(len(x))
        for k in range(len(x) - 399):
            if count[x[k: k + 400]] > 1:
                gone[k: k + 400] = b"\1" * 400
        want.append((i is None, i or 0, len(x), sum(gone), bytes(c for c, g in zip(x, gone) if not g).decode("utf-8", "ignore")))
    assert all(w[3] for w in want)
    got = op1_suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), as_text=True).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.kept) for r in got) == sorted(want)
    plain = op1_suffix_dedup.suffix_dedup(spark.createDataFrame([(1, None), (2, "short"), (None, "")], "doc_id long, text string")).collect()
    assert sorted((r.n_bytes, bytes(r.kept)) for r in plain) == [(0, b""), (0, b""), (5, b"short")]
    nulls = op1_suffix_dedup.suffix_dedup(spark.createDataFrame([(1, None), (2, "short")], "doc_id long, text string"), as_text=True).collect()
    assert {r.kept for r in nulls} == {None, "short"}


def test_warc_of_repeated_page_ids(spark, tmp_path):
    rows = [(1, "u", "A"), (1, "u", "B"), (2, "u", "A"), (None, "u", "A"), (None, "u", "C"), (3, "u", "B" * 50_000)]
    op3_warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    got = sorted(((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to) for r in op3_warc.read_warc(spark, str(tmp_path / "w")).collect()), key=str)
    assert got == sorted([(1, 1, "revisit", 2), (1, 1, "response", None), (2, 1, "response", None), (0, 1, "response", None), (0, 1, "response", None),
                          (3, 50_000, "response", None)], key=str)


def test_decontamination_without_ids_and_with_stock_phrases(spark):
    phrase = "this stock phrase stands in many items"
    items = [(i, phrase + " " + " ".join(f"q{i}x{k}" for k in range(30))) for i in range(40)] + [(None, " ".join(f"z{k}" for k in range(20)))]
    docs = [(i if i % 2 else None, f"{phrase} doc {i} " + " ".join(f"d{i}x{k}" for k in range(50))) for i in range(60)]
    docs += [(None, "lead " + items[3][1] + " end"), (7, items[3][1]), (7, "other text only"), (9, items[40][1]), (9, items[40][1])]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.n_covered) for r in op4_decontaminate.contaminated(d, b).collect()), key=str)
    assert got == sorted([(None, 3, 37), (7, 3, 37), (9, None, 20), (9, None, 20)], key=str)
    left = op4_decontaminate.decontaminate(d, b)
    assert left.columns == ["doc_id", "text"] and sorted((r.doc_id, r.text) for r in left.collect() if r.doc_id in (7, 9)) == [(7, "other text only")] + sorted(
        (i, t) for i, t in docs[:60] if i in (7, 9)) or left.count() == 61


def test_tiling_of_equal_words_needs_little_memory():
    import tracemalloc

    import numpy as np
    tracemalloc.start()
    tiles = op4_decontaminate.tiling(np.zeros(200_000, np.uint64), np.zeros(300, np.uint64), 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tiles == [(0, 0, 300)] and peak < 200 << 20


@pytest.mark.parametrize("seed", range(40))
def test_tiling_is_the_plain_one(seed):
    import random

    import numpy as np
    rng = random.Random(seed)
    kinds = rng.choice([2, 3, 30])
    a = [rng.randrange(kinds) for _ in range(rng.randint(0, 60))]
    b = [rng.randrange(kinds) for _ in range(rng.randint(1, 25))]
    for _ in range(2):
        if len(a) > 12:
            s = rng.randrange(len(a) - 10)
            b[rng.randrange(len(b)):0] = a[s: s + 9]
    used_a, used_b, want = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for q in range(len(b)):
            for p in range(len(a)):
                n = 0
                while p + n < len(a) and q + n < len(b) and a[p + n] == b[q + n] and not used_a[p + n] and not used_b[q + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, q)
        n, p, q = best
        if n < 4:
            break
        used_a[p: p + n] = used_b[q: q + n] = [True] * n
        want.append((p, q, n))
    got = op4_decontaminate.tiling(np.array(a, np.uint64), np.array(b, np.uint64), 4)
    assert sum(t[2] for t in got) == sum(t[2] for t in want) and got == want


def test_ngram_components_without_ids_and_of_repeated_ids(spark):
    base = [f"v{i}" for i in range(120)]
    near = lambda k, w=base: " ".join([*w[:k], "e", *w[k + 1:]])
    other = [f"u{i}" for i in range(120)]
    rows = [(None, near(3)), (7, near(5)), (None, near(9)), (1, " ".join(other)), (1, " ".join(base)), (8, near(4, other)), (None, "alone here"), (None, None),
            (7, near(5))]
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in op8_ngram_join.ngram_components(
        spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()), key=str)
    assert got == sorted([(None, 117, 1), (7, 117, 1), (None, 117, 1), (1, 117, 1), (1, 117, 1), (8, 117, 1), (None, 1, None), (None, 0, None), (7, 117, 1)], key=str)


def test_class_numbers_that_clash_are_made_anew(spark, monkeypatch):
    """Two sets under one number: the next salt is taken, and nothing is merged."""
    true = op8_ngram_join._keys
    monkeypatch.setattr(op8_ngram_join, "_keys", lambda u, salt=0: (5, true(u, 0)[1]) if not salt else true(u, salt))
    rows = [(1, "a b c d e f"), (2, "g h i j k l"), (3, "a b c d e f")]
    got = sorted((r.doc_id, r.component_id) for r in op8_ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 1), (2, 2), (3, 1)]


def test_near_copies_are_proposed_once_per_member(spark, monkeypatch):
    """Proposals of a group follow its members, not their pairs."""
    count = {}
    plain = op8_ngram_join.written

    def counted(df, name):
        out = plain(df, name)
        count[name] = count.get(name, 0) + out.count()
        return out
    monkeypatch.setattr(op8_ngram_join, "written", counted)

    def pairs(n):
        count.clear()
        rows = [(i, " ".join(f"e{i}" if k in (i % 150, (i * 7) % 150) else f"v{k}" for k in range(400))) for i in range(n)]
        op8_ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        return count["join-pairs"]
    few, many = pairs(20), pairs(100)
    assert many < 8 * few


def test_messages_are_gone_when_the_blocks_are_answered(spark, monkeypatch):
    """The step that answers the blocks reads no messages, and lists of words go once the shards have them."""
    import glob
    plain, plans, left = op6_pitman_yor.written, {}, {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        left[name] = [f for t in made for f in glob.glob(f"{t}/*.parquet")] if name == "lm-pairs" else []
        out = plain(df, name)
        if name == "lm-blocks":
            made.extend({f.rpartition("/")[0].removeprefix("file:").replace("//", "/") for f in out.inputFiles()})
            assert glob.glob(f"{made[0]}/*.parquet")
        return out
    made = []
    monkeypatch.setattr(op6_pitman_yor, "written", seen)
    docs = spark.createDataFrame([(i, f"some words {i} of a text") for i in range(30)], "doc_id long, text string")
    assert op6_pitman_yor.score_texts(docs, burn=1, samples=2).count() == 30
    assert "told" in plans["lm-means"] and "told" not in plans["lm-answers"]
    assert left["lm-pairs"] == []


def test_buckets_of_near_copies_meet_in_few_tasks(spark, monkeypatch):
    """A pair of the first round is not proposed again by every task that holds one of the shingles it shares."""
    made, plain = {}, op8_ngram_join._propose

    def counted(num, den, star):
        rows, run = made.setdefault(star, spark.sparkContext.accumulator(0)), plain(num, den, star)

        def count(batches):
            for b in run(batches):
                rows.add(b.num_rows)
                yield b
        return count
    monkeypatch.setattr(op8_ngram_join, "_propose", counted)
    settings = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = [(i, " ".join(f"e{i}" if k == i * 7 else f"v{k}" for k in range(400))) for i in range(20)]
        got = op8_ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert {r.component_id for r in got} == {0}
    assert made[True].value < 4 * len(rows)


def test_site_rates_leave_the_document_out(spark):
    """Priors and posteriors from the evidence of the result, site by site in plain Python."""
    import math
    import random

    from pyspark.sql import functions as F
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(500):
        site = rng.choice(["a", "a", "b", "c", None])
        bad = rng.random() < {"a": 0.02, "b": 0.6, "c": 0.2, None: 0.1}[site]
        rows.append((i if i % 50 else None, ("vile " if bad and rng.random() < 0.7 else "") + " ".join(f"w{rng.randrange(300)}" for _ in range(40)), site,
                     rng.choice(["x", "y", None]), "clash"))
        if i % 50 and i < 300:
            labels.append((i, 1, int(bad)))
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n string")
    y = {i: t for i, _, t in labels}
    got = op5_site_bayes.classify(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.col("source"), F.col("lang")).collect()
    assert len(got) == 500
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    base = sum(y.values()) / len(y)
    own = [y[r.doc_id] if r.doc_id in y else 1 / (1 + math.exp(-(r.evidence_toxic + logit(base)))) for r in got]

    def sums(key):
        out = {}
        for r, o in zip(got, own):
            n, k = out.get(key(r), (0, 0.0))
            out[key(r)] = (n + 1, k + o)
        return out

    def strength(sites, parent):
        v = sum(n * (k / n - parent(s)) ** 2 for s, (n, k) in sites.items())
        spread = {s: parent(s) * (1 - parent(s)) for s in sites}
        ns = sum(sites[s][0] * x for s, x in spread.items())
        return 1 / min(0.99, max(1e-4, (v - sum(spread.values())) / ns)) - 1

    hosts, paths, top = sums(lambda r: r.host), sums(lambda r: (r.host, r.path)), sum(own) / 500
    of_host = strength(hosts, lambda s: top)
    of_path = strength(paths, lambda s: (hosts[s[0]][1] + of_host * top) / (hosts[s[0]][0] + of_host))
    for r, o in zip(got, own):
        (n, k), (m, j) = paths[r.host, r.path], hosts[r.host]
        host = (j - o + of_host * (sum(own) - o) / 499) / (m - 1 + of_host)
        prior = (k - o + of_path * host) / (n - 1 + of_path)
        assert r.prior_toxic == pytest.approx(prior, rel=1e-6)
        assert r.p_toxic == pytest.approx(1 / (1 + math.exp(-(r.evidence_toxic + logit(prior)))), rel=1e-6)


def test_sweeps_leave_no_shuffle_files(spark):
    """Counting the spellings of a sweep leaves no shuffle files: they would add up, sweep after sweep."""
    import glob
    jvm = spark._jvm
    root = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    state = spark.range(40).selectExpr("array(named_struct('code', id % 7, 'n', id)) as spelling").repartition(4)

    def files():
        return {f for d in root for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    before = files()
    got = op6_pitman_yor._spelling(state)
    assert got["code"].to_pylist() == list(range(7)) and sum(got["n"].to_pylist()) == sum(range(40))
    assert files() <= before


def test_distinct_numbers_and_samples_are_exact():
    """The packed sorts give what numpy's unique gives, hashes that differ in their lowest bits included; steps lose nothing."""
    import numpy as np
    rng = np.random.default_rng(5)
    for top in (2, 1000, 1 << 40, (1 << 63) - 1):
        for n in (0, 1, 2, 1000):
            x = rng.integers(0, top, n).astype(np.uint64)
            for got, want in zip(op6_pitman_yor.distinct(x), np.unique(x, return_inverse=True)):
                assert got.dtype == want.dtype and got.tolist() == want.tolist()
            for got, want in zip(op6_pitman_yor.distinct_hashes(x), np.unique(x, return_index=True, return_inverse=True)):
                assert got.tolist() == want.tolist()
    logs = [np.array(v, np.float32) for v in ([-1.5, -np.inf, 0, -7], [-1.25, 0, -np.inf, -7], [-30, -1e30, -0.0, -7])]
    assert [x.tobytes() for x in op6_pitman_yor._unpack_logs(op6_pitman_yor._pack_logs(logs))] == [x.tobytes() for x in logs]
    buf = np.frombuffer(b"ab c  def", np.uint8)
    assert op6_pitman_yor.word_list(buf, np.array([6, 0, 3]), np.array([9, 2, 4]))[0] == b"def ab c "


def test_models_of_a_sweep_are_let_go(spark):
    """Each sweep broadcasts its model as a file on the driver and on every executor; none is left when the scores are there."""
    import os
    folder = spark.sparkContext._temp_dir
    before = set(os.listdir(folder))
    docs = spark.createDataFrame([(i, f"some words {i} of a text") for i in range(30)], "doc_id long, text string")
    assert op6_pitman_yor.score_texts(docs, burn=1, samples=2).count() == 30
    assert set(os.listdir(folder)) <= before
