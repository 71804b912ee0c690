"""op11: rules and features against plain Python, the trees by held-out urls."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from flowscore.llm import op11_url_filter as op

URLS = [None, "", "no scheme/at/all", "http://", "https://Example.COM", "https://example.com/en/1", "http://a.b.EXAMPLE.com/en/x?y=/en/",
        "http://example.com?x=/en/", "http://www.example.com/en/", "http://m.www.example.com/en/q#top", "http://xwww.example.com/en/",
        "http://notexample.com/en/", "http://shop.net/es/1", "http://net/fr/", "http://shop.net/fr", "http://shop.net/en/", "ftp://x.org/a%20b/c.html",
        "http://com/", "http://u@x.com:80/a", "a://b://c.net/es/", "http://x.net/ES/", "http://ünï.net/fr/é", "http://x.com/" + "long/" * 20_000, "://"]
RULES = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:end], rest[end:]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]


def rule(host, path):
    fit = [r for r in RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
    return max(fit, key=len, default=None)


def frame(spark, urls):
    return spark.createDataFrame([(None if i == 3 else i, u, "<html>", "clash", 1.0) for i, u in enumerate(urls)],
                                 "page_id long, url string, html string, host string, length double").repartition(3)


def test_parts_and_rules(spark):
    df = frame(spark, URLS)
    got = Counter((r.page_id, r.host, r.path, r.rule, r.verdict) for r in op.judge(df, op.UrlFilter(None, None, 0.0)).collect())
    want = Counter()
    for i, u in enumerate(URLS):
        host, path = parts(u)
        r = rule(host, path)
        want[None if i == 3 else i, host, path, r, RULES[r] if r else "allow"] += 1
    assert got == want
    labels = Counter((r.url, r.label) for r in op.labelled_by(df).collect())
    assert labels == Counter((u, int(RULES[rule(*parts(u))] == "block")) for u in URLS if rule(*parts(u)))


def test_lexical_features(spark):
    df = frame(spark, URLS).withColumns({"h": op.host_of(F.col("url")), "p": op.path_of(F.col("url"))})
    cols = op.lexical(F.col("url"), F.col("h"), F.col("p"))
    for r in df.select("url", *[c.alias(f"f_{n}") for n, c in cols.items()]).collect():
        u = r.url or ""
        host, path = parts(r.url)
        bits = -sum(k / len(u) * math.log2(k / len(u)) for k in Counter(u).values()) if u else 0.0
        query = u.split("#")[0].partition("?")[2]
        assert r.f_length == len(u) and r.f_host_length == len(host) and r.f_path_length == len(path)
        assert r.f_depth == sum(1 for x in path.split("/") if x) and r.f_host_labels == sum(1 for x in host.split(".") if x)
        assert abs(r.f_entropy - bits) < 1e-6
        assert abs(r.f_digit_ratio - sum(c in "0123456789" for c in u) / max(1, len(u))) < 1e-12
        assert r.f_parameters == sum(1 for x in query.replace(";", "&").split("&") if x)
        assert r.f_hyphens == u.count("-") and r.f_fragment == float("#" in u) and r.f_secure == float(u.startswith("https://"))


def planted(n, seed):
    """Blocked urls have long hosts with digits, or stand on one bad domain; hosts never repeat."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        bad = rng.random() < 0.3
        name = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(4, 9)))
        if bad and rng.random() < 0.5:
            url = f"http://{name}{rng.randint(10000, 99999)}-free-{rng.randint(100, 999)}.info/{name}?a=1&b=2&c=3"
        elif bad:
            url = f"http://{name}.badplace.org/x/{name}"
        else:
            url = f"https://{name}.org/{name}/{rng.randint(1, 99)}"
        out.append((url, int(bad)))
    return out


def test_held_out_urls(spark):
    train = spark.createDataFrame(planted(1500, 1), "url string, label int")
    test = planted(600, 2)
    model = op.fit_url_filter(train, trees=10)
    got = {r.page_id: r for r in op.judge(frame(spark, [u for u, _ in test]), model, rules=()).collect()}
    right = sum((got[None if i == 3 else i].verdict == "block") == bool(y) for i, (_, y) in enumerate(test))
    assert right >= 0.97 * len(test)
    assert all(r.rule is None and 0 <= r.score <= 1 for r in got.values())
    again = {r.page_id: r.score for r in op.judge(frame(spark, [u for u, _ in test]), op.fit_url_filter(train, trees=10), rules=()).collect()}
    assert all(abs(again[k] - got[k].score) < 1e-9 for k in got)  # the fit is repeatable


def test_one_url_as_a_third_of_the_rows_and_a_bounded_sample(spark):
    rows = planted(600, 5)
    rows += [rows[0]] * 300 + [(None, 1), ("http://x.y/z", None)]
    model = op.fit_url_filter(spark.createDataFrame(rows, "url string, label int").repartition(4), sample=200, trees=5)
    assert model.stats.filter("half = 2").agg(F.sum("n")).first()[0] == 200 * len(op.LABELS)
    test = planted(300, 6)
    got = [r for r in op.judge(frame(spark, [u for u, _ in test]), model, rules=()).collect()]
    assert sum((r.verdict == "block") == bool(test[3 if r.page_id is None else r.page_id][1]) for r in got) >= 0.9 * len(test)


def test_nothing_to_learn_and_empty_tables(spark):
    none = spark.createDataFrame([], "url string, label int")
    one = spark.createDataFrame([("http://a.com/", 1), ("http://b.com/", 1)], "url string, label int")
    for labels in (none, one):
        model = op.fit_url_filter(labels)
        assert model.trees is None
        assert {r.verdict for r in op.judge(frame(spark, ["http://q.org/", None]), model).collect()} == {"allow"}
    assert op.judge(frame(spark, []), op.UrlFilter(None, None, 0.0)).count() == 0
    assert op.labelled_by(frame(spark, [])).count() == 0


def test_the_fit_takes_every_labelled_url(spark):
    urls = spark.range(21_000).select(F.concat(F.lit("http://h"), (F.col("id") % 40).cast("string"), F.lit(".net/"), F.col("id").cast("string")).alias("url"),
                                      (F.col("id") % 40 < 11).cast("int").alias("label"))
    model = op.fit_url_filter(urls, trees=1, depth=1)
    assert model.stats.filter("half = 2").agg(F.sum("n")).first()[0] == 21_000 * len(op.LABELS)
    assert model.share == 11 / 40
