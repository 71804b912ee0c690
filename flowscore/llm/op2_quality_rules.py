"""Quality rules: a decision list learned by sequential covering.

Whole texts become a table of statistics (one projection, built-in functions
only). From the labelled rows a list of rejecting rules is learned: each rule
is a conjunction of thresholds, grown by information gain on two thirds of the
labelled rows, pruned on the last third, and kept only if it stays precise
there; the rows it covers leave before the next rule is grown. Every grow step
is one grouped count over (feature, bin, label); only those counts (features x
bins x 2 rows) reach the driver. The list ends as ordered Spark conditions.

Defined results: a null or empty text has no words, all counts 0 and fails the
base test; repeated doc_ids are scored row by row; labels that are null or
whose doc_id has no document are ignored; a doc_id labelled more than once
counts once with its smallest label; without labels (or without rejected
rows) the list is empty and the verdict is the base test alone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscore.llm.common import has_word, let, pick, words, written

SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PCT = 50, 50
FEATURES = ("word_length", "symbols_per_word", "marks_per_word", "upper_share", "digit_share", "dup_line_share",
            "repeat_share", "distinct_share")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, "<=" or ">", threshold); rows that meet it are rejected."""

    terms: tuple[tuple[str, str, float], ...]

    def condition(self) -> Column:
        cond = F.lit(True)
        for name, sign, at in self.terms:
            cond = cond & (F.col(name) <= F.lit(at) if sign == "<=" else F.col(name) > F.lit(at))
        return cond

    def __str__(self):
        return " and ".join(f"{n} {s} {t:.6g}" for n, s, t in self.terms)


def _count_of(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def _repeat_words(hashes: Column) -> Column:
    """Words inside 3-word windows that occur twice or more: ``hashes`` are the
    window hashes in order, so windows of equal hash end up as neighbours once
    sorted, and a word position is counted once however many windows hold it."""
    def repeated_starts(s):
        n = F.size(s)
        return F.transform(
            F.filter(s, lambda x, i: ((i > 0) & (s[F.greatest(i - 1, F.lit(0))]["h"] == x["h"]))
                     | ((i < n - 1) & (s[F.least(i + 1, n - 1)]["h"] == x["h"]))),
            lambda x: x["i"])

    def covered(p):
        n = F.size(p)
        return F.aggregate(
            F.transform(p, lambda x, k: F.when(k < n - 1, F.least(F.lit(3), p[F.least(k + 1, n - 1)] - x)).otherwise(3)),
            F.lit(0).cast("long"), lambda acc, x: acc + x)

    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    many = let(F.sort_array(let(pairs, repeated_starts)), covered)
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(many)


def _windows(w: Column) -> Column:
    n = F.size(w)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))),
                                      lambda i: F.xxhash64(w[i], w[i + 1], w[i + 2]))).otherwise(F.array().cast("array<bigint>"))


def statistics(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: the contract's counts and the shares the rules look at."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), has_word)
    from_words = let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.size(F.array_distinct(w)).cast("long").alias("n_distinct"),
        F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
        let(_windows(w), _repeat_words).alias("n_repeat_words")))
    from_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"),
                                               F.size(F.array_distinct(x)).cast("long").alias("n_distinct")))
    per = pick(docs, "doc_id", "text", *keep).select(
        "doc_id", *keep, from_words.alias("w"), from_lines.alias("l"),
        _count_of(text, SYMBOLS).alias("n_symbols"),
        _count_of(text, "!?").alias("n_marks"), _count_of(text, "0-9").alias("n_digits"),
        _count_of(text, "A-Z").alias("n_upper")).withColumn("word_chars", F.col("w.word_chars"))
    n, chars = F.greatest(F.col("w.n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return per.select(
        "doc_id", *keep, F.col("w.n_words").alias("n_words"), "word_chars", "n_symbols",
        (F.col("l.n_lines") - F.col("l.n_distinct")).alias("n_dup_lines"), F.col("w.n_repeat_words").alias("n_repeat_words"),
        (F.col("word_chars") / n).alias("word_length"), (F.col("n_symbols") / n).alias("symbols_per_word"),
        (F.col("n_marks") / n).alias("marks_per_word"), (F.col("n_upper") / chars).alias("upper_share"),
        (F.col("n_digits") / chars).alias("digit_share"),
        ((F.col("l.n_lines") - F.col("l.n_distinct")) / F.greatest(F.col("l.n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("w.n_repeat_words") / n).alias("repeat_share"), (F.col("w.n_distinct") / n).alias("distinct_share"),
    ).withColumn("base_failed", (F.col("n_words") < MIN_WORDS)
                 | (100 * F.col("n_repeat_words") > MAX_REPEAT_PCT * F.col("n_words")))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of labelled rows that pass the base test, with y = 1 for rejected quality."""
    y = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        F.when(F.min("quality") == 0, 1).otherwise(0).alias("y"))
    return stats.filter(~F.col("base_failed")).join(y, "doc_id").select(
        *FEATURES, "y", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part"))


def _thresholds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Candidate cuts: quantiles of either class, so a rare class gets its own."""
    at = [(i + 0.5) / bins for i in range(bins)]
    got = rows.groupBy("y").agg(*[F.percentile_approx(f, at, 10000).alias(f) for f in FEATURES]).collect()
    return {f: sorted({float(v) for r in got for v in (r[f] or [])}) for f in FEATURES}


def learn(rows: DataFrame, *, bins: int = 24, max_rules: int = 12, max_terms: int = 3, min_precision: float = 0.9,
          min_cover: int = 5) -> list[Rule]:
    """Sequential covering over ``labelled`` rows.

    ``bins`` bounds the cuts per feature and class, ``max_terms`` the length of
    a rule and ``max_rules`` the length of the list; a rule must cover
    ``min_cover`` rejected rows and keep ``min_precision`` on the pruning third.
    """
    cuts = _thresholds(rows, bins)
    if not any(cuts.values()):
        return []
    binned = written(rows.select(*FEATURES, "y", "part", F.array(*[
        sum([(F.col(f) > F.lit(c)).cast("int") for c in cuts[f]], F.lit(0)) for f in FEATURES]).alias("bins")), "rules-binned")
    rules: list[Rule] = []
    left = F.lit(True)
    while len(rules) < max_rules:
        rule = _grow(binned.filter(left & (F.col("part") != 0)), cuts, max_terms, min_cover)
        if rule is None:
            break
        rule, good, bad = _prune(binned.filter(left & (F.col("part") == 0)), rule)
        if good < max(1, min_cover // 2) or good < min_precision * (good + bad):
            break
        rules.append(rule)
        left = left & ~rule.condition()
    return rules


def _grow(rows: DataFrame, cuts: dict[str, list[float]], max_terms: int, min_cover: int) -> Rule | None:
    terms: tuple = ()
    now = None
    while len(terms) < max_terms:
        counts = rows.filter(Rule(terms).condition()).select("y", F.posexplode("bins").alias("f", "bin")).groupBy(
            "f", "bin", "y").agg(F.count(F.lit(1)).alias("n")).collect()
        best = None
        for k, name in enumerate(FEATURES):
            of = {y: [0] * (len(cuts[name]) + 1) for y in (0, 1)}
            for r in counts:
                if r["f"] == k:
                    of[r["y"]][r["bin"]] += r["n"]
            p_all, n_all = sum(of[1]), sum(of[0])
            if now is None:
                now = (p_all, n_all)
            p = n = 0
            for i, cut in enumerate(cuts[name]):
                p, n = p + of[1][i], n + of[0][i]
                for sign, pp, nn in (("<=", p, n), (">", p_all - p, n_all - n)):
                    if pp >= min_cover and pp + nn < p_all + n_all:
                        gain = pp * (math.log2(pp / (pp + nn)) - math.log2(p_all / (p_all + n_all)))
                        if gain > 1e-9 and (best is None or (gain, -k, -cut, sign) > best[0]):
                            best = ((gain, -k, -cut, sign), (name, sign, cut), (pp, nn))
        if best is None:
            break
        terms, now = terms + (best[1],), best[2]
        if now[1] == 0:
            break
    return Rule(terms) if terms else None


def _prune(rows: DataFrame, rule: Rule) -> tuple[Rule, int, int]:
    """The prefix of the rule's terms with the best (p - n) / (p + n) on held-back rows."""
    heads = [Rule(rule.terms[: k + 1]) for k in range(len(rule.terms))]
    got = rows.agg(*[F.coalesce(F.sum(F.when(h.condition() & (F.col("y") == y), 1).otherwise(0)), F.lit(0)).alias(f"c{k}_{y}")
                     for k, h in enumerate(heads) for y in (0, 1)]).first()
    scored = [((got[f"c{k}_1"] - got[f"c{k}_0"]) / max(1, got[f"c{k}_1"] + got[f"c{k}_0"]), k) for k in range(len(heads))]
    best = max(s for s, _ in scored)
    k = max(k for s, k in scored if s == best)
    return heads[k], int(got[f"c{k}_1"]), int(got[f"c{k}_0"])


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditions: the first rule that holds rejects; else the row is kept."""
    out = F.when(F.col("base_failed"), False)
    for r in rules:
        out = out.when(r.condition(), False)
    return out.otherwise(True)


def quality_rules(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = (), **params) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` for every row of ``docs``.

    ``keep`` names columns of ``docs`` to carry along (the text is read once
    and only its statistics are written).
    """
    stats = written(statistics(docs, keep), "rules-stats")
    rules = learn(labelled(stats, labels), **params)
    return stats.withColumn("kept", verdict(rules))


def query(spark, sf_dir: str) -> DataFrame:
    from flowscore.llm.common import table
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
