"""Every stage of the pipeline and ``run`` against plain Python, with null and repeated ids, equal rows and clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from flowscore.llm.common import KEY, keyed

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_removed string, n_lines long, copy int, words_before string, "
          "h string, comp string, n string, block long, s string, rest long, __x int")


def item(k):
    return " ".join(f"t{k}x{i}" for i in range(40))


BENCH = [(1, item(1)), (2, item(2)), (2, item(3)), (None, item(4)), (5, None), (6, ""), (7, "tiny")]


def texts():
    rng = random.Random(4)
    prose = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(n))
    base = [prose(200).split() for _ in range(3)]
    rows = []
    for g, w in enumerate(base):  # groups of near copies, also under null and repeated ids
        for k in range(6):
            v = list(w)
            for _ in range(k):
                v[rng.randrange(200)] = f"e{rng.randrange(99)}"
            rows.append((None if k == 2 else 10 * g + k, " ".join(v)))
    rows += [(5, prose(90)), (5, prose(90)), (None, prose(80)), (None, prose(80))]
    same = prose(100)
    rows += [(40, same), (40, same), (None, same), (41, same)]  # equal rows and copies
    passage = "\n".join(prose(12) for _ in range(4))
    rows += [(50 + i, f"{prose(60)}\n{passage}\n{prose(60)}") for i in range(4)] + [(None, f"{passage}\n{prose(70)}"), (50, f"{prose(70)}\n{passage}")]
    w = item(2).split()
    rows += [(60, prose(60) + " " + item(1)), (None, prose(60) + " " + item(1)), (61, " ".join(w[20:]) + "\n" + prose(55) + "\n" + " ".join(w[:20])),
             (62, prose(60) + " " + " ".join(w[:20])), (62, prose(60) + " " + item(4).upper()), (63, prose(60) + " " + item(3))]
    rows += [(70, None), (71, ""), (72, " \n\t"), (73, "short text"), (None, None), (None, None), (74, "again and again " * 40), (75, prose(6000))]
    return rows


def frame(spark, rows):
    full = [(i, t, "en", f"src{k % 3}" if k % 4 else None, -1, "clash", 9, 3, "w", "h", "c", "n", 5, "s", 6, 7) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA).repartition(4)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("sf")
    frame(spark, texts()).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return str(d)


def of(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def same(a, b):
    assert Counter(a) == Counter(b)


# --- plain Python -------------------------------------------------------------

def base_failed(text):
    w = WORD.findall(text or "")
    grams = [tuple(w[k: k + 3]) for k in range(len(w) - 2)]
    many = Counter(grams)
    hit = {k + d for k, g in enumerate(grams) if many[g] > 1 for d in range(3)}
    return len(w) < 50 or 100 * len(hit) > 50 * len(w)


def brute_lines(rows):
    """rows: (order key, text) -> {key: (text, removed)}; equal rows have one key."""
    seen, out = {}, {}
    for key, t in sorted(set(rows)):
        lines = (t or "").split("\n")
        units = [k for k, x in enumerate(lines) if WORD.search(x)]
        wins = [(j, 2, tuple(lines[k] for k in units[j: j + 2])) for j in range(len(units) - 1)]
        wins += [(j, 1, (lines[k],)) for j, k in enumerate(units) if len(WORD.findall(lines[k])) >= 50]
        gone = set()
        for j, n, c in wins:
            if c in seen:
                gone |= set(range(j, j + n))
            seen[c] = True
        dead = {units[j] for j in gone}
        out[key] = (None if t is None else "\n".join(x for k, x in enumerate(lines) if k not in dead), len(gone))
    return out


def brute_one_of_each(rows, k, num, den):
    """The order keys that stay, one row each."""
    def shingles(t):
        w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        return {tuple(w[i: i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    sets = {key: shingles(t) for key, t in rows}
    comp = {key: key for key in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(comp[a], comp[b])
            changed |= comp[a] != low or comp[b] != low
            comp[a] = comp[b] = low
    bare = [key for key, t in rows if not sets[key]]
    return sorted({comp[key] for key in sets if sets[key]}) + sorted(bare)


def plain_tiling(a, b, k):
    """Greedy string tiling word by word: covered words of b."""
    used_a, used_b, covered = [False] * len(a), [False] * len(b), 0
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
        if n < k:
            return covered
        for d in range(n):
            used_a[p + d] = used_b[q + d] = True
        covered += n


def tokens(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def contaminated(t):
    a = tokens(t)
    for _, x in BENCH:
        b = tokens(x)
        if b and len(set(a) & set(b)) >= 1 and plain_tiling([w for w in a], b, min(5, len(b))) >= 0.8 * len(b):
            return True
    return False


def brute_mix(rows, blocks=256, seed=7, share=0.95, most=4.0):
    """rows: (doc_id, text, source) -> counter of (doc_id, text, source, copy, words_before, source_budget)."""
    md5 = lambda *x: hashlib.md5("|".join(str(y) for y in x).encode()).hexdigest()
    full = []
    for i, t, s in rows:
        name = str(i) if i is not None else hashlib.md5((t or "").encode()).hexdigest()
        full.append((i, t, s, name, len(WORD.findall(t or "")), int(md5(seed, name)[:7], 16) % blocks))
    size = defaultdict(int)
    for _, _, s, _, n, b in full:
        size[s, b] += n
    words = defaultdict(int)
    for (s, _), n in size.items():
        words[s] += n
    words = {s: n for s, n in words.items() if n}
    total = sum(words.values())
    p = {s: n / total for s, n in words.items()}

    def entropy(a):
        z = sum(x ** a for x in p.values())
        return math.log(z) - a * sum(x ** a * math.log(x) for x in p.values()) / z

    def edge(ok, lo, hi):  # ok(lo) holds, ok(hi) does not
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if ok(mid) else (lo, mid)
        return lo
    goal = share * math.log(len(p))
    a = 1.0 if entropy(1.0) >= goal else edge(lambda x: entropy(x) >= goal, 0.0, 1.0)
    repeats = lambda x: min(p.values()) ** (x - 1) / sum(v ** x for v in p.values()) <= most
    if not repeats(a):
        a = edge(lambda x: not repeats(x), 0.0, 1.0)
    a = round(a, 9)
    z = sum(x ** a for x in p.values())
    out = Counter()
    for s, n in words.items():
        budget = round(p[s] ** a / z * total)
        passes, rest = divmod(budget, n)
        for copy in range(passes + 1):
            inside = 0
            for b in sorted((b for x, b in size if x == s), key=lambda b: (md5(seed, "-" if s is None else s, b, copy), b)):
                if copy == passes and inside >= rest:
                    break
                sofar = inside
                for r in sorted((r for r in full if r[2] == s and r[5] == b), key=lambda r: (md5(seed, copy, r[3]), r[3], r[4])):
                    if copy < passes or sofar < rest:
                        out[r[0], r[1], s, copy, copy * n + inside, budget] += 1
                    sofar += r[4]
                inside += size[s, b]
    return out


# --- stages -------------------------------------------------------------------

def test_quality_without_labels_is_the_base_test(spark, sf_dir):
    got = P.quality(spark, frame(spark, texts()), sf_dir)
    assert got.schema == frame(spark, []).schema
    same(of(got, "doc_id", "text"), [r for r in texts() if not base_failed(r[1])])


def test_quality_rejects_rows_of_null_and_repeated_ids(spark, tmp_path):
    rows = []
    for i in range(400):
        junk = i % 4 == 0
        rows.append((i if i < 320 else None if i < 360 else 999, " ".join(f"word{(i * 31 + k * k) % 1009}" + ("!!" if junk else "") for k in range(80))))
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(
        str(tmp_path / "labels.parquet"))
    got = P.quality(spark, frame(spark, rows), str(tmp_path))
    same(of(got, "text"), [(t,) for _, t in rows if "!!" not in t])


def ordered(df):
    """{(order key, text): rows} of a frame."""
    return [(((r.doc_id is None, r.doc_id or 0, r[KEY[0]], r[KEY[1]]), r.text)) for r in keyed(df).select("doc_id", "text", *KEY).collect()]


def test_lines(spark, sf_dir):
    docs = frame(spark, texts())
    got = P.lines(spark, docs, sf_dir)
    assert got.schema.simpleString() == docs.schema.simpleString()
    rows = ordered(docs)
    out = brute_lines(rows)
    want = []
    for key, _ in rows:
        text, removed = out[key]
        if text is None or not removed or WORD.search(text):
            want.append((None if key[0] else key[1], text, len(text) if removed else -1, "clash", 9))
    same(of(got, "doc_id", "text", "n_chars", "n_removed", "n_lines"), want)
    assert any(removed for _, removed in out.values())


def test_near_duplicates(spark, sf_dir):
    docs = frame(spark, texts())
    got = P.near_duplicates(spark, docs, sf_dir)
    assert got.schema.simpleString() == docs.schema.simpleString()
    rows = ordered(docs)
    stay = Counter(brute_one_of_each(rows, 5, 80, 100))
    same([k for k, _ in ordered(got)], list(stay.elements()))
    assert len(rows) > sum(stay.values()) + 10


def test_benchmark_free(spark, sf_dir):
    docs = frame(spark, texts())
    got = P.benchmark_free(spark, docs, sf_dir)
    want = [r for r in texts() if not contaminated(r[1])]
    same(of(got, "doc_id", "text"), want)
    assert len(texts()) - len(want) == 5 and got.columns == docs.columns


def test_mixed(spark, sf_dir):
    docs = frame(spark, texts())
    got = P.mixed(spark, docs, sf_dir)
    assert set(P.MIX) < set(got.columns) and set(docs.columns) <= set(got.columns)
    same(of(got, "doc_id", "text", "source", "copy", "words_before", "source_budget"), list(brute_mix(of(docs, "doc_id", "text", "source")).elements()))


@pytest.mark.parametrize("ids", [[None] * 30, [3] * 30])
def test_the_mix_draws_rows_of_one_id_once_each(spark, sf_dir, ids):
    docs = frame(spark, [(i, f"word{k} " * 60) for k, i in enumerate(ids)]).withColumn("source", F.lit("one"))
    assert P.mixed(spark, docs, sf_dir).count() == 30
    cut = P.mixed_rows(docs, budget=900, blocks=1, digits=1)
    want = sum(r["n"] for r in cut.select(F.lit(60).alias("n")).collect())
    assert want == 900


def test_empty_tables(spark, tmp_path):
    docs = frame(spark, [])
    for name, schema in (("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES:
        assert stage(spark, docs, str(tmp_path)).count() == 0, name
    assert P.run(spark, str(tmp_path)).count() == 0


def test_run(spark, sf_dir):
    """The whole chain: each stage's plain form on what the one before kept."""
    docs = frame(spark, texts())
    source = {(r.doc_id, r.text, r.source) for r in docs.select("doc_id", "text", "source").collect()}
    rows = [(i, t) for i, t in texts() if not base_failed(t)]
    keys = ordered(spark.createDataFrame(rows, "doc_id long, text string"))
    lined = brute_lines(keys)
    # a row's source follows its text: texts of this fixture with several sources are equal rows, whose source is not fixed
    after = []
    for key, t in keys:
        text, removed = lined[key]
        if not removed or WORD.search(text):
            after.append((None if key[0] else key[1], text))
    keys = ordered(spark.createDataFrame(after, "doc_id long, text string"))
    texts_of = dict(keys)
    left = [(None if k[0] else k[1], texts_of[k]) for k in brute_one_of_each(keys, 5, 80, 100)]
    want = [r for r in left if not contaminated(r[1])]
    got = P.run(spark, sf_dir)
    first = got.filter("copy = 0")
    assert {(r.doc_id, r.text) for r in first.select("doc_id", "text").collect()} <= set(want)
    rows = [tuple(r) for r in got.select("doc_id", "text", "source", "copy", "words_before", "source_budget").collect()]
    mixed_in = {(i, t, s) for i, t, s, *_ in rows}
    drawn = {(i, t) for i, t, _ in mixed_in}
    sources = {(i, t): s for i, t, s in mixed_in}
    assert len(sources) == len(mixed_in) and source  # one row of each stays
    whole = [(i, t, sources.get((i, t), "?")) for i, t in want]
    if all(s != "?" for *_, s in whole):
        same(rows, list(brute_mix(whole).elements()))
    assert drawn <= set(want) and len(drawn) >= 0.8 * len(want)
