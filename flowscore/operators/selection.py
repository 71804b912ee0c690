"""Feature and member diagnostics: mutual information, correlation, feature clusters, Shapley weights."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowscore.functions import sqltext as ST


def mutual_information(x: DataFrame, features: Sequence[str], y: str = "y", bins: int = 10) -> DataFrame:
    """I(feature bin; y) in nats per feature, equal-width bins over each
    feature's [min, max]. Two aggregates: min/max per feature, then counts
    per (feature, bin, y) with partial aggregation (a few hundred groups)."""
    mm = x.agg(*[F.min(ST.ident(f)).alias(f"mn{i}") for i, f in enumerate(features)],
               *[F.max(ST.ident(f)).alias(f"mx{i}") for i, f in enumerate(features)]).first()
    structs = []
    for i, f in enumerate(features):
        lo, hi = float(mm[f"mn{i}"]), float(mm[f"mx{i}"])
        if hi > lo:
            b = (f"least(CAST(floor((CAST({ST.ident(f)} AS DOUBLE) - {ST.dbl(lo)}) / {ST.dbl(hi - lo)} * "
                 f"{ST.dbl(bins)}) AS BIGINT), {bins - 1})")
        else:
            b = "CAST(0 AS BIGINT)"
        structs.append(f"named_struct('feature', {ST.lit_str(f)}, 'bin', {b})")
    long = x.selectExpr(f"{ST.ident(y)} AS y", f"inline(array({', '.join(structs)}))")
    c = long.groupBy("feature", "bin", "y").agg(F.count(F.lit(1)).alias("n"))
    wf = Window.partitionBy("feature")
    c = c.select("feature", "bin", "y", F.col("n").cast("double").alias("n"),
                 F.sum("n").over(wf).cast("double").alias("total"),
                 F.sum("n").over(Window.partitionBy("feature", "bin")).cast("double").alias("nb"),
                 F.sum("n").over(Window.partitionBy("feature", "y")).cast("double").alias("ny"))
    term = (F.col("n") / F.col("total")) * F.log((F.col("n") * F.col("total")) / (F.col("nb") * F.col("ny")))
    return c.groupBy("feature").agg(F.bround(F.sum(term), 6).alias("mutual_information"))


def shapley_weights(v: DataFrame, members: Sequence[str], y: str = "_y") -> DataFrame:
    """Exact Shapley value of every member for the accuracy of a majority
    vote (a coalition predicts 1 when at least half of its members vote 1;
    the empty coalition scores 0). The data enter as one grouped count per
    vote pattern -- at most 2^(members+1) rows -- from which every coalition's
    accuracy follows on the driver."""
    k = len(members)
    pats = v.groupBy(*[F.col(f"_v_{m}") for m in members], F.col(y).alias("y")).agg(
        F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in pats)

    def value(coal: tuple[int, ...]) -> float:
        if not coal or total == 0:
            return 0.0
        ok = 0
        for r in pats:
            votes = sum(r[f"_v_{members[i]}"] for i in coal)
            pred = 1 if 2 * votes >= len(coal) else 0
            ok += r["n"] if pred == r["y"] else 0
        return ok / total

    cache = {c: value(c) for r in range(k + 1) for c in itertools.combinations(range(k), r)}
    phi = []
    for i in range(k):
        others = [j for j in range(k) if j != i]
        s = 0.0
        for r in range(k):
            for c in itertools.combinations(others, r):
                wgt = math.factorial(r) * math.factorial(k - r - 1) / math.factorial(k)
                s += wgt * (cache[tuple(sorted(c + (i,)))] - cache[c])
        phi.append(s)
    norm = sum(phi)
    rows = [(m, phi[i], (phi[i] * k / norm) if norm else 1.0) for i, m in enumerate(members)]
    return v.sparkSession.createDataFrame(rows, "member string, shapley double, weight double")


def correlation_matrix(x: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, correlation) of every pair in order, one aggregate
    over the table; null where a feature does not vary."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    value = [F.expr(ST.ident(f)).cast("double") for f in features]
    one = x.agg(*[F.stddev_pop(v).alias(f"s{i}") for i, v in enumerate(value)], *[F.covar_pop(value[i], value[j]).alias(f"c{i}_{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(features[i]).alias("feature_a"), F.lit(features[j]).alias("feature_b"),
                              F.when(F.col(f"s{i}") * F.col(f"s{j}") > 0, F.col(f"c{i}_{j}") / (F.col(f"s{i}") * F.col(f"s{j}"))).alias("correlation"))
                     for i, j in pairs])
    return one.select(F.inline(rows))


def feature_clusters(x: DataFrame, features: Sequence[str], distance: float = 0.3) -> DataFrame:
    """(feature, cluster, representative): average-linkage clusters of features
    on the distance 1 - |correlation|.

    The table enters as its correlation matrix (features x features numbers);
    merging stops when the closest clusters are further apart than
    ``distance``. Ties go to the earlier features; a feature that does not vary
    is at distance 1 from all. Clusters are numbered by their first feature, and
    the representative is the member closest to the others."""
    k = len(features)
    at = {f: i for i, f in enumerate(features)}
    d = [[0.0 if i == j else 1.0 for j in range(k)] for i in range(k)]
    for r in correlation_matrix(x, features).collect():
        i, j = at[r["feature_a"]], at[r["feature_b"]]
        if i != j and r["correlation"] is not None:
            d[i][j] = d[j][i] = 1.0 - abs(r["correlation"])
    clusters = [[i] for i in range(k)]

    def apart(a, b):
        return sum(d[i][j] for i in a for j in b) / (len(a) * len(b))

    while len(clusters) > 1:
        gap, i, j = min((apart(clusters[i], clusters[j]), i, j) for i in range(len(clusters)) for j in range(i + 1, len(clusters)))
        if gap > distance:
            break
        clusters[i] = sorted(clusters[i] + clusters.pop(j))
        clusters.sort()
    rows = []
    for c, members in enumerate(clusters, 1):
        best = min(members, key=lambda i: (sum(d[i][j] for j in members), i))
        rows += [(features[i], c, features[best]) for i in members]
    return x.sparkSession.createDataFrame(rows, "feature string, cluster int, representative string")
