"""URL filters: rules by host and path, and boosted trees on lexical features.

A rule ``host/path`` fits a url whose host is the rule's or one of its
subdomains and whose path starts with the rule's; the longest rule that fits
decides. All other urls are judged by gradient-boosted trees, trained from
labelled urls (in ``query``: those that a rule decides), on features of the
text alone: lengths of url, host and path, depth, host labels, digit ratio,
entropy of the characters, counts of parameters, escapes, hyphens and digits,
scheme, and statistics of the host's last one, two and three labels: the
share of blocked urls among the labelled ones with that suffix, shrunk toward
the share over all.

The fit takes every labelled url (``sample``, none in ``query``, lets a caller
fit on so many, those with the smallest hashes of the url). Distinct urls
are counted once and weigh as often as they occur up to the square root, so a
url that makes up a third of the rows is one row of the fit. Suffix statistics
of a labelled url leave out the half of the urls that it belongs to, so the
trees learn how far to trust the statistics of hosts that they have not seen.
The table of statistics grows with the hosts, keyed by a 64-bit hash; it is
joined by suffix length, and Spark sends a length's rows to all tasks only if
they are few.

Defined results: a null url, or one without ``://``, has an empty host and
path, fits no rule and is judged by the trees like any other; very long urls
are measured whole; a port or user name is part of the host as written;
repeated rows and null page ids are judged one by one; labelled urls with a
null url or label are ignored, and a url labelled both ways counts as block if
at least half of its rows say so; without labelled urls of both kinds nothing
can be learned and every url without a rule is allowed; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscore.llm.common import ascii_lower, let, pick, table, written

#: The rules of the contract, as (verdict, rule).
RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
TREES, DEPTH, STEP = 20, 4, 0.2
PRIOR = 8.0
LABELS = (1, 2, 3)  # host suffixes of so many labels
SEED = 11


def host_of(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules) -> Column:
    """Struct (verdict, rule) of the longest rule that fits, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, _, start = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + start)
        hit = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, hit) if out is None else out.when(fits, hit)
    return F.lit(None).cast("struct<verdict: string, rule: string>") if out is None else out


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def entropy(text: Column) -> Column:
    """Bits per character of a text's own character frequencies; 0 for an empty one."""
    def bits(chars):
        n = F.size(chars).cast("double")
        # sorted, equal characters stand together: one pass counts them
        state = F.aggregate(
            F.array_sort(chars), F.struct(F.lit("").alias("c"), F.lit(0.0).alias("k"), F.lit(0.0).alias("h")),
            lambda s, c: F.when(s["c"] == c, F.struct(c.alias("c"), (s["k"] + 1).alias("k"), s["h"].alias("h"))).otherwise(
                F.struct(c.alias("c"), F.lit(1.0).alias("k"), (s["h"] + _klogk(s["k"])).alias("h"))),
            lambda s: s["h"] + _klogk(s["k"]))
        return F.when(n > 0, F.log2(n) - state / n).otherwise(0.0)
    return let(F.array_remove(F.split(text, ""), ""), bits)


def _klogk(k: Column) -> Column:
    return F.when(k > 0, k * F.log2(k)).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the text of a url, all doubles."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"(?s)^[^?#]*\?([^#]*)", 1)
    size = F.char_length(text).cast("double")
    digits = _count(text, "[0-9]")
    return {
        "length": size, "host_length": F.char_length(host).cast("double"), "path_length": F.char_length(path).cast("double"),
        "depth": _count(path, "/[^/]+"), "host_labels": _count(host, r"[^.]+"), "digit_ratio": digits / F.greatest(size, F.lit(1.0)),
        "host_digits": _count(host, "[0-9]"), "entropy": entropy(text), "host_entropy": entropy(host),
        "parameters": _count(query, "[^&;]+"), "escapes": _count(text, "%[0-9A-Fa-f]{2}"), "hyphens": _count(text, "-"),
        "secure": text.startswith("https://").cast("double"), "fragment": text.contains("#").cast("double"),
        "extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("double"),
    }


def suffix_key(host: Column, labels: int) -> Column:
    """64-bit key of the host's last ``labels`` labels (of the whole host where it has fewer)."""
    return F.xxhash64(F.lit(labels), F.substring_index(host, ".", -labels))


@dataclass
class UrlFilter:
    """A fitted filter: trees, statistics by suffix key, and the share of blocked urls."""

    trees: GBTClassificationModel | None
    stats: DataFrame | None
    share: float
    names: tuple[str, ...] = ()


def _with_stats(df: DataFrame, stats: DataFrame, share: float, half: Column) -> DataFrame:
    """``df`` (with a host) and, per suffix length, the shrunken share of blocked urls and the log of the support.

    ``half``: 0 or 1 takes the statistics of the other half of the urls alone, 2 those of all.
    """
    for k in LABELS:
        s = stats.filter(F.col("labels") == k).select(
            F.col("key").alias(f"__k{k}"), F.col("half").alias(f"__h{k}"), F.col("n").alias(f"__n{k}"), F.col("bad").alias(f"__b{k}"))
        df = df.join(s, (suffix_key(F.col("host"), k) == F.col(f"__k{k}")) & (half == F.col(f"__h{k}")), "left")
        n, bad = F.coalesce(F.col(f"__n{k}"), F.lit(0.0)), F.coalesce(F.col(f"__b{k}"), F.lit(0.0))
        df = df.withColumns({f"suffix{k}": (bad + F.lit(PRIOR * share)) / (n + F.lit(PRIOR)), f"support{k}": F.log1p(n)})
        df = df.drop(f"__k{k}", f"__h{k}", f"__n{k}", f"__b{k}")
    return df


def _features(df: DataFrame, model_names: tuple[str, ...] | None = None):
    parts = lexical(F.col("url"), F.col("host"), F.col("path"))
    names = model_names or (*parts, *(f"{x}{k}" for k in LABELS for x in ("suffix", "support")))
    out = df.withColumns({f"__{k}": v for k, v in parts.items()})
    cols = [f"__{n}" if n in parts else n for n in names]
    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(out), names


def fit_url_filter(labelled: DataFrame, *, sample: int | None = None, trees: int = TREES, depth: int = DEPTH) -> UrlFilter:
    """Fit on ``labelled`` (url, label: 1 to block, 0 to allow): all distinct urls, or ``sample`` of them."""
    rows = pick(labelled, "url", "label").filter("url is not null and label is not null")
    urls = rows.groupBy("url").agg(F.count("*").cast("double").alias("n"), F.avg(F.col("label").cast("double")).alias("bad"))
    # a fixed order: the trees do not depend on how the table was cut up; with a limit each task passes on at most ``sample`` rows
    urls = urls.orderBy(F.xxhash64(F.lit(SEED), "url"), "url")
    urls = urls if sample is None else urls.limit(sample)
    u = F.col("url")
    urls = written(urls.select("url", F.sqrt("n").alias("weight"), (F.col("bad") >= 0.5).cast("double").alias("label"), host_of(u).alias("host"),
                               path_of(u).alias("path"), F.pmod(F.xxhash64(F.lit(SEED + 1), host_of(u)), F.lit(2)).cast("int").alias("half")), "url-labelled")
    count = {r["label"]: r["n"] for r in urls.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(count) < 2:
        return UrlFilter(None, None, 0.0)
    share = count[1.0] / sum(count.values())
    keys = F.array(*[F.struct(F.lit(k).alias("labels"), suffix_key(F.col("host"), k).alias("key")) for k in LABELS])
    by = urls.select(F.inline(keys), F.col("label"), F.array(F.lit(2), F.lit(1) - F.col("half")).alias("halves")).withColumn("half", F.explode("halves"))
    stats = written(by.groupBy("labels", "key", "half").agg(F.count("*").cast("double").alias("n"), F.sum("label").alias("bad")), "url-suffixes")
    train, names = _features(_with_stats(urls, stats, share, F.col("half")))
    train = written(train.select("features", "label", "weight"), "url-train")
    # even weights of both kinds: the verdict does not follow how many urls of each kind happen to be labelled
    even = F.when(F.col("label") == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    gbt = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=STEP, seed=SEED, weightCol="weight", subsamplingRate=1.0, checkpointInterval=-1)
    return UrlFilter(gbt.fit(train.withColumn("weight", F.col("weight") * even)), stats, share, names)


def judge(pages: DataFrame, model: UrlFilter, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (the trees' probability of block; null without trees)."""
    url = F.col("url")
    df = pick(pages, "page_id", "url").withColumns({"host": host_of(url), "path": path_of(url)})
    df = df.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    if model.trees is None:
        score = F.lit(None).cast("double")
    else:
        from pyspark.ml.functions import vector_to_array
        df, _ = _features(_with_stats(df, model.stats, model.share, F.lit(2)), model.names)
        df = model.trees.transform(df)
        score = vector_to_array("probability")[1]
    return df.withColumn("score", score).select(
        "page_id", "host", "path", F.col("fit.rule").alias("rule"),
        F.coalesce(F.col("fit.verdict"), F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")


def labelled_by(pages: DataFrame, rules=RULES) -> DataFrame:
    """url and label (1 block, 0 allow) of the urls that a rule decides."""
    url = F.col("url")
    return pick(pages, "url").select("url", rule_of(host_of(url), path_of(url), rules)["verdict"].alias("v")).filter("v is not null").select(
        "url", (F.col("v") == "block").cast("int").alias("label"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return judge(pages, fit_url_filter(labelled_by(pages)))
