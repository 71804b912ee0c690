"""Quality classifier: document evidence with hierarchical site priors.

For each target (low quality, toxic) a document's evidence is the log odds of
its strongest indicator: a word, a word shape or the share of words that repeat
the one before, chosen by likelihood ratio from a bounded sample of labelled
documents (``FIT_DOCS``, by hash of doc_id), or the log odds of having none.
(A sum would add up chance differences of hundreds of ordinary words.) A group of
copies or near copies with the same labels counts as one document there, and the
indicators are those that keep the share of false ones below ``FDR`` (Benjamini
and Hochberg over all features), so the threshold follows the sample. Sites come in
two levels, host and path. Grouped aggregates of labels and of the document
probabilities (all documents, labelled or not) give each host a rate shrunk
toward the global one and each path a rate shrunk toward its host; the
strength of the shrinkage is estimated by moments from the spread of rates, so
sparse sites stay near their parent. A document's own label or probability is
taken out of all three rates before they judge it, so nothing is counted twice.
The posterior log odds of a document are its evidence plus those of its path;
``kept`` needs both targets below 0.5.

Defined results: null and empty texts have no features and get their site's
prior; a null host or path is a site of its own; labels that are null or
without a document are ignored, several labels of one doc_id count as the
worst one; without labels nothing is rejected; repeated rows are each scored;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscore.llm import textnum as T
from flowscore.llm.common import pick, written
from flowscore.llm.op8_ngram_join import ngram_components

#: Bounds of the model: labelled documents to fit on, features per target, least documents of a feature, share of false indicators.
FIT_DOCS, FEATURES, MIN_DOCS, FDR, MIN_ODDS, CLIP = 20000, 20000, 4, 0.01, 4.0, 8.0
TARGETS = ("low", "toxic")
SHAPE, REPEAT = np.uint64(0x51AFE), np.uint64(0x4E9EA7)


def features(col) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) pairs of a batch, distinct and sorted by row: words, shapes, repetition."""
    buf, offs = T.text_buffer(col)
    low = T.ascii_lower(buf)
    s, e, row = T.word_spans(low, offs)
    if not len(s):
        return row, np.zeros(0, np.uint64)
    word = T.span_hashes(low, s, e)
    upper = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
    letter = np.concatenate([[0], np.cumsum(((low >= 97) & (low <= 122)) | (low >= 0x80))])
    n, up, let = e - s, upper[e] - upper[s], letter[e] - letter[s]
    shape = np.minimum(n - let, 3) * 8 + (let == 0) * 4 + np.where(up == let, 2, np.where(up > 0, 1, 0)) * (let > 1)
    shape = T.mix(shape.astype(np.uint64) * np.uint64(256) + low[e - 1] * (low[e - 1] < 0x80) + SHAPE * np.uint64(1 << 20))
    same = np.append(False, (word[1:] == word[:-1]) & (row[1:] == row[:-1]))
    size = np.maximum(np.bincount(row, minlength=len(offs) - 1), 1)
    share = np.minimum(np.bincount(row, same, len(offs) - 1) * 8 // size, 7).astype(np.uint64)
    rows = np.concatenate([row, row, np.arange(len(offs) - 1)])
    feats = np.concatenate([word, shape, T.mix(share + REPEAT)])
    order = np.lexsort((feats, rows))
    rows, feats = rows[order], feats[order]
    new = np.append(True, (rows[1:] != rows[:-1]) | (feats[1:] != feats[:-1]))
    return rows[new], feats[new]


def _counts(batches):
    """Per batch and feature: documents, and documents of each target."""
    for b in T.slices(batches, "text", 8 << 20):
        row, feat = features(b.column("text"))
        uniq, at = np.unique(feat, return_inverse=True)
        y = [b.column(t).to_numpy()[row] for t in TARGETS]
        yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(np.bincount(at, minlength=len(uniq)).astype(np.int64)),
                                          *[pa.array(np.bincount(at, v, len(uniq)).astype(np.int64)) for v in y]], names=["feature", "n", *TARGETS])


def _g2(n, k, n_all, k_all) -> Column:
    """Likelihood ratio of "k of n with the feature, k_all of n_all overall"."""
    def term(x, expected):
        return F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    rest, k_rest = F.lit(float(n_all)) - n, F.lit(float(k_all)) - k
    p = F.lit(k_all / n_all)
    return 2 * (term(k, n * p) + term(n - k, n * (1 - p)) + term(k_rest, rest * p) + term(rest - k_rest, rest * (1 - p)))


def significant(g2: np.ndarray, tests: int) -> np.ndarray:
    """Which of the positive associations (largest G2 first) of ``tests`` features pass at ``FDR``."""
    p = np.array([math.erfc(math.sqrt(max(x, 0.0) / 2)) / 2 for x in g2])
    passed = np.flatnonzero(p * tests <= FDR * np.arange(1, len(p) + 1))
    return np.arange(len(p)) <= (passed[-1] if len(passed) else -1)


def _one_of_each(labelled: DataFrame) -> DataFrame:
    """One row of each group of near copies with the same labels, texts without words being one group."""
    rows = written(labelled.select(F.monotonically_increasing_id().alias("doc_id"), "text", *TARGETS), "site-rows")
    groups = ngram_components(rows).select("doc_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("of"))
    first = rows.select("doc_id", *TARGETS).join(groups, "doc_id").groupBy("of", *TARGETS).agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return written(rows.join(first, "doc_id").select("text", *TARGETS), "site-distinct")


def fit(labelled: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray, float]]:
    """Per target (indicators sorted, log odds, prior rate, log odds of none); ``labelled``: text, low, toxic of at most FIT_DOCS documents."""
    total = labelled.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in TARGETS]).first()
    none = (np.zeros(0, np.uint64), np.zeros(0))
    if not total["n"]:
        return {t: (*none, 0.0, 0.0) for t in TARGETS}
    rates = {t: total[t] / total["n"] for t in TARGETS}
    labelled = _one_of_each(labelled)
    total = labelled.agg(F.count(F.lit(1)).alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).first()
    counts = written(labelled.select("text", *TARGETS).mapInArrow(_counts, "feature long, n long, low long, toxic long").groupBy("feature").agg(
        F.sum("n").alias("n"), *[F.sum(t).alias(t) for t in TARGETS]).filter(F.col("n") >= MIN_DOCS), "site-features")
    model, tests = {}, counts.count()
    for t in TARGETS:
        k_all, n_all = total[t], total["n"]
        if not 0 < k_all < n_all:
            model[t] = (*none, rates[t], 0.0)
            continue
        n, k = F.col("n").cast("double"), F.col(t).cast("double")
        odds = F.log((k + 0.5) / (k_all + 1.0)) - F.log((n - k + 0.5) / (n_all - k_all + 1.0))
        best = counts.select("feature", odds.alias("odds"), _g2(n, k, n_all, k_all).alias("g2")).filter(
            F.col("odds") >= MIN_ODDS).orderBy(F.desc("g2"), "feature").limit(FEATURES).toArrow()
        best = best.filter(pa.array(significant(best["g2"].to_numpy(), tests)))
        key = best["feature"].to_numpy().view(np.uint64)
        order = np.argsort(key)
        model[t] = (key[order], np.minimum(best["odds"].to_numpy()[order], CLIP), rates[t], 0.0)
    shared = labelled.sparkSession.sparkContext.broadcast(model)
    bare = labelled.mapInArrow(_strongest(shared, TARGETS), "low long, toxic long, s_low double, s_toxic double").agg(*[
        F.sum(((F.col(f"s_{t}") < MIN_ODDS) & (F.col(t) == y)).cast("int")).alias(f"{t}{y}") for t in TARGETS for y in (0, 1)]).first()
    for t in TARGETS:
        key, odds, rate, _ = model[t]
        k_all, n_all = total[t], total["n"]
        if len(key):
            model[t] = (key, odds, rate, float(np.log((bare[f"{t}1"] + 0.5) / (k_all + 1)) - np.log((bare[f"{t}0"] + 0.5) / (n_all - k_all + 1))))
    return model


def _strongest(model, keep):
    """The ``keep`` columns, and per target the log odds of the strongest indicator (0 without one)."""
    def run(batches):
        for b in T.slices(batches, "text"):
            row, feat = features(b.column("text"))
            out = []
            for t in TARGETS:
                key, odds = model.value[t][:2]
                best = np.zeros(b.num_rows)
                if len(key) and len(feat):
                    k = np.minimum(np.searchsorted(key, feat), len(key) - 1)
                    np.maximum.at(best, row, np.where(key[k] == feat, odds[k], 0.0))
                out.append(pa.array(best))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in keep] + out, names=[*keep, *[f"s_{t}" for t in TARGETS]])
    return run


def _logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, n: str, k: str, parent: Column) -> float:
    """Pseudo-count of the parent's rate, from the moments of the site rates around their parents."""
    rate, spread = F.col(k) / F.col(n), parent * (1 - parent)
    got = sites.agg(F.sum(F.col(n) * F.pow(rate - parent, 2)).alias("v"), F.sum(spread).alias("s"), F.sum(F.col(n) * spread).alias("ns")).first()
    # E[n (rate - parent)^2] = spread * (1 + (n - 1) * rho): rho is the share of variance between sites
    between = (got["v"] or 0.0) - (got["s"] or 0.0)
    rho = min(0.99, max(1e-4, between / got["ns"])) if got["ns"] else 1e-4
    return 1 / rho - 1


def _rate(n: Column, k: Column, own: Column, strength: float, parent: Column) -> Column:
    """A site's shrunk rate without the document whose share of k is ``own``."""
    return (k - own + F.lit(strength) * parent) / (n - 1 + F.lit(strength))


def classify(docs: DataFrame, labels: DataFrame, host: Column, path: Column, *, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, host, path, evidence_*, prior_*, p_* for both targets, and ``kept``."""
    spark = docs.sparkSession
    y = written(labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.coalesce(F.max((F.col("quality") == 0).cast("int")), F.lit(0)).alias("low"),
        F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic")), "site-labels")
    chosen = written(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs), "site-chosen")
    texts = pick(docs, "doc_id", "text").filter("text is not null")
    model = fit(written(texts.join(chosen, "doc_id").select("text", *[F.col(t).cast("long").alias(t) for t in TARGETS]), "site-fit"))
    base = docs.select("doc_id", "text", host.alias("host"), path.alias("path"))
    kinds = {f.name: f.dataType.simpleString() for f in base.schema}
    scored = base.mapInArrow(_strongest(spark.sparkContext.broadcast(model), ("doc_id", "host", "path")),
                             f"doc_id {kinds['doc_id']}, host {kinds['host']}, path {kinds['path']}, s_low double, s_toxic double")
    scored = written(scored.select("doc_id", "host", "path", *[
        F.when(F.col(f"s_{t}") >= MIN_ODDS, F.col(f"s_{t}")).otherwise(model[t][3]).alias(t) for t in TARGETS]), "site-evidence")
    known = scored.join(y.select("doc_id", *[F.col(t).alias(f"y_{t}") for t in TARGETS]), "doc_id", "left")
    # a labelled document counts with its label, another one with its probability under the global prior
    known = written(known.select("doc_id", "host", "path", *TARGETS, *[
        F.coalesce(F.col(f"y_{t}").cast("double"), 1 / (1 + F.exp(-(F.col(t) + _logit(F.lit(model[t][2])))))).alias(f"own_{t}") for t in TARGETS]), "site-known")
    paths = written(known.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), *[F.sum(f"own_{t}").alias(f"k_{t}") for t in TARGETS]),
                    "site-paths")
    hosts = written(paths.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(f"k_{t}").alias(f"host_k_{t}") for t in TARGETS]), "site-hosts")
    whole = hosts.agg(F.sum("host_n").alias("n"), *[F.sum(f"host_k_{t}").alias(t) for t in TARGETS]).first()
    sites = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    sites = written(sites.select("h", F.col("path").alias("p"), "n", "host_n", *[f"{k}_{t}" for k in ("k", "host_k") for t in TARGETS]), "site-sites")
    out = known.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")))
    for t in TARGETS:
        total, n = whole[t] or 0.0, whole["n"] or 0.0
        top = F.lit(total / n if n else 0.0)
        of_host = _strength(hosts, "host_n", f"host_k_{t}", top)
        shrunk = (F.col(f"host_k_{t}") + F.lit(of_host) * top) / (F.col("host_n") + F.lit(of_host))
        of_path = _strength(sites, "n", f"k_{t}", shrunk)
        own = F.col(f"own_{t}")
        rest = (F.lit(total) - own) / F.lit(n - 1) if n > 1 else F.lit(float(model[t][2]))
        host_rate = _rate(F.col("host_n"), F.col(f"host_k_{t}"), own, of_host, rest)
        out = out.withColumn(f"path_{t}", _rate(F.col("n"), F.col(f"k_{t}"), own, of_path, host_rate))
        out = out.withColumn(f"p_{t}", 1 / (1 + F.exp(-(F.col(t) + _logit(F.col(f"path_{t}"))))))
    return out.select("doc_id", "host", "path", *[F.col(t).alias(f"evidence_{t}") for t in TARGETS], *[F.col(f"path_{t}").alias(f"prior_{t}") for t in TARGETS],
                      *[f"p_{t}" for t in TARGETS], ((F.col("p_low") < 0.5) & (F.col("p_toxic") < 0.5)).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    from flowscore.llm.common import table
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))
