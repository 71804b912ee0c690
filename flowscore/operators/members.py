"""Member models fitted on Spark.

* random forest, gradient-boosted trees and bagging (a forest that sees
  every feature at every split) are ``pyspark.ml`` models, fitted on cells of
  rows in ``bagged`` and ``boosting``;
* AdaBoost over decision stumps is written here: one pass turns the rows into
  weighted cells (bins of all features, label), and each round is ONE
  aggregate of (feature, bin) -> weighted class sums over blocks of cells; the best
  stump is picked from that small table. The lineage is cut with
  ``checkpoint()`` every few rounds. The fitted model is a SQL expression, i.e.
  an expression member that scores inside whole-stage codegen;
* calibration maps a member's score by logistic regression or by isotonic
  regression, fitted on out-of-fold scores.

Fitted models are members of a bundle: Spark ML ones are saved with
``save()`` and scored through :func:`add_ml_probabilities`.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.operators.prep import q
from flowscore.session import ensure_checkpoint_dir, scratch_path
from flowscore.sources.bundle import EnsembleBundle


def split_column(key: str, train_pct: int = 80, seed: int = 42):
    """Deterministic train/test split by a hash of the row key (a null key counts as an empty one)."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(q(key).cast("string"), F.lit(""))).cast("binary"))
    return F.when(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 100 < train_pct, F.lit("train")).otherwise(F.lit("test"))


def _assembler(features: Sequence[str], out: str = "features") -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep")


def _weighted(estimator, weight_col: str | None):
    return estimator.setWeightCol(weight_col) if weight_col else estimator


def _fit_forest(train: DataFrame, features: Sequence[str], rf: RandomForestClassifier, tries: int, weight_col: str | None) -> PipelineModel:
    from flowscore.operators import bagged as BAG
    trees = rf.getNumTrees()
    cuts, table = BAG.fit_trees(train, features, rf.getLabelCol(), trees, rf.getMaxDepth(), rf.getSeed(), weight_col, tries)
    return PipelineModel([_assembler(features), BAG.as_model(train.sparkSession, _weighted(rf, weight_col), cuts, table, trees, len(features))])


def fit_random_forest(train: DataFrame, features: Sequence[str], label: str = "y", num_trees: int = 100,
                      max_depth: int = 8, seed: int = 42, weight_col: str | None = None) -> PipelineModel:
    """Bootstrapped trees as Spark ML's, fitted on cells of rows (see ``bagged``); a node tries the root of the number of features."""
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=num_trees, maxDepth=max_depth,
                                seed=seed)
    return _fit_forest(train, features, rf, len(features) if num_trees == 1 else math.ceil(math.sqrt(len(features))), weight_col)


def fit_bagging(train: DataFrame, features: Sequence[str], label: str = "y", num_trees: int = 100,
                max_depth: int = 8, seed: int = 42, weight_col: str | None = None) -> PipelineModel:
    """Bagged trees: bootstrap samples, every feature considered at every split."""
    rf = RandomForestClassifier(labelCol=label, featuresCol="features", numTrees=num_trees, maxDepth=max_depth,
                                seed=seed, featureSubsetStrategy="all", subsamplingRate=1.0, bootstrap=True)
    return _fit_forest(train, features, rf, len(features), weight_col)


def fit_gbt(train: DataFrame, features: Sequence[str], label: str = "y", max_iter: int = 100, max_depth: int = 3,
            step_size: float = 0.1, seed: int = 42, weight_col: str | None = None) -> PipelineModel:
    """Boosted trees as Spark ML's, fitted on cells of rows (see ``boosting``)."""
    from flowscore.operators import boosting as BOOST
    gbt = _weighted(GBTClassifier(labelCol=label, featuresCol="features", maxIter=max_iter, maxDepth=max_depth, stepSize=step_size, seed=seed), weight_col)
    cuts, trees, weights = BOOST.fit_trees(train, features, label, max_iter, max_depth, step_size, seed, weight_col)
    return PipelineModel([_assembler(features), BOOST.as_model(train.sparkSession, gbt, cuts, trees, weights, len(features))])


def ml_probability(model: PipelineModel, df: DataFrame, out: str) -> DataFrame:
    """Adds ``out`` = class-1 probability of a fitted pipeline; the
    intermediate vector columns are dropped."""
    tag = out.replace("`", "")
    stages = model.stages
    stages[0].setOutputCol(f"__vec_{tag}")
    clf = stages[-1]
    clf.setFeaturesCol(f"__vec_{tag}").setProbabilityCol(f"__prob_{tag}") \
        .setRawPredictionCol(f"__raw_{tag}").setPredictionCol(f"__pred_{tag}")
    scored = PipelineModel(stages).transform(df)
    return scored.withColumn(out, vector_to_array(F.col(f"__prob_{tag}"))[1]).drop(
        f"__vec_{tag}", f"__prob_{tag}", f"__raw_{tag}", f"__pred_{tag}")


def add_ml_probabilities(df: DataFrame, bundle: EnsembleBundle, names: Sequence[str]) -> DataFrame:
    for n in names:
        model = PipelineModel.load(bundle.member(n).model_path)
        df = ml_probability(model, df, f"_mlp_{n}")
    return df


# ------------------------------------------------------------------ AdaBoost

def _cuts(train: DataFrame, features: Sequence[str], max_cuts: int) -> dict[str, list[float]]:
    """Candidate thresholds of each feature: all its distinct values if there
    are at most ``max_cuts`` of them (then no better stump exists), else that
    many approximate quantiles. The lowest value cuts nothing off and is left out."""
    rough = train.agg(*[F.approx_count_distinct(q(f), 0.02).alias(f"n{i}") for i, f in enumerate(features)]).first()
    few = [f for i, f in enumerate(features) if rough[f"n{i}"] <= 1.1 * max_cuts]
    out = {f: [] for f in features}
    if few:
        pairs = F.inline(F.array(*[F.struct(F.lit(f).alias("f"), q(f).cast("double").alias("v")) for f in few]))
        values = train.select(pairs).distinct()  # about max_cuts rows a feature
        for r in values.where(F.col("v").isNotNull()).groupBy("f").agg(F.sort_array(F.collect_list("v")).alias("v")).collect():
            out[r["f"]] = [float(v) for v in r["v"]]
    many = [f for f in features if f not in few or len(out[f]) > max_cuts + 1]
    if many:
        at = [i / max_cuts for i in range(max_cuts)]
        for f, values in zip(many, train.approxQuantile(many, at, 0.2 / max_cuts)):
            out[f] = sorted(set(float(v) for v in values))
    return {f: v[1:] for f, v in out.items()}


def _bin_sql(f: str, cuts: list[float]) -> str:
    """Number of cuts <= x, by halving: a stump "x >= cuts[k]" is true iff the bin is above k."""
    def part(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN `{f}` >= {cuts[mid]!r}D THEN {part(mid + 1, hi)} ELSE {part(lo, mid)} END"
    return part(0, len(cuts))


def _stump_sql(f: str, thr: float, polarity: int) -> str:
    hi, lo = (1, 0) if polarity > 0 else (0, 1)
    return f"CASE WHEN `{f}` >= {thr!r} THEN {hi} ELSE {lo} END"


_BLOCK = "bins binary, y binary, n binary, lw binary"
BLOCKS_PER_PARTITION = 100  # of at most an Arrow batch of cells each


def _block(bins, y, n, lw):
    import pyarrow as pa
    return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (bins, y, n, lw)], names=["bins", "y", "n", "lw"])


def _pack_cells(bins: Sequence[str], width: str):
    """One block per Arrow batch of cells; bins lie feature by feature, a null label is NaN."""
    def fn(batches):
        for b in batches:
            if b.num_rows:
                x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in bins]).astype(width)
                y = b.column("__y").to_numpy(zero_copy_only=False).astype(np.float64)
                yield _block(x, y, b.column("__n").to_numpy(zero_copy_only=False).astype(np.float64), np.zeros(b.num_rows))
    return fn


def _blocks(batches, k: int, width: str, recent):
    """(bins, y, n, log-weight with the recent stumps) of every block."""
    for b in batches:
        for raw_bins, raw_y, raw_n, raw_lw in zip(*(b.column(c) for c in ("bins", "y", "n", "lw"))):
            y, n = (np.frombuffer(v.as_buffer(), np.float64) for v in (raw_y, raw_n))
            bins = np.frombuffer(raw_bins.as_buffer(), width).reshape(k, len(y))
            lw = np.frombuffer(raw_lw.as_buffer(), np.float64).copy()
            for alpha, f, cut, pol in recent:
                lw += alpha * (((bins[f] > cut) == (pol > 0)) != y)
            yield bins, y, n, lw


def _fold_stumps(k: int, width: str, recent):
    def fn(batches):
        for bins, y, n, lw in _blocks(batches, k, width, recent):
            yield _block(bins, y, n, lw)
    return fn


def _stump_sums(k: int, width: str, recent, shift: float, boosted: bool):
    """Weighted class sums by feature and bin, and the largest log-weight: one table per task."""
    def fn(batches):
        import pyarrow as pa
        sums, most = None, -math.inf
        for bins, y, n, lw in _blocks(batches, k, width, recent):
            w = n * np.exp(lw - shift)
            if boosted:  # a cell without a label is in no class once there are stumps
                w[np.isnan(y)] = 0.0
            most, one = max(most, lw.max()), y == 1
            now = [np.bincount(bins[f].astype(np.int64) * 2 + one, w) for f in range(k)]
            size = max(len(t) + 1 for t in now) // 2 * 2
            new = np.zeros((k, max(size, 0 if sums is None else sums.shape[1])))
            for f, t in enumerate(now):
                new[f, :len(t)] = t
            if sums is not None:
                new[:, :sums.shape[1]] += sums
            sums = new
        if sums is not None:
            f, bin_ = np.divmod(np.arange(sums.size // 2), sums.shape[1] // 2)
            pairs = sums.reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int32()), pa.array(bin_, pa.int32()), pa.array(pairs[:, 1]), pa.array(pairs[:, 0]),
                                              pa.array(np.full(len(pairs), most))], names=["fi", "bin", "w1", "w0", "lw_max"])
    return fn


def fit_adaboost(train: DataFrame, features: Sequence[str], label: str = "y", rounds: int = 100, max_cuts: int = 255,
                 learning_rate: float = 1.0, checkpoint_every: int = 10, weight_col: str | None = None) -> list[dict]:
    """Discrete AdaBoost (SAMME, two classes) over decision stumps.

    One pass over the rows turns them into weighted cells: rows with the same
    bin in every feature and the same label behave alike in every round, so
    they are one cell with the number (or, with ``weight_col``, the total
    weight) of its rows. All rounds run on the cells. A feature of at most
    ``max_cuts`` + 1 distinct values is binned by all of them, so its stumps
    are exact.

    Cells are packed into blocks, a row each (numpy arrays of the bins, labels,
    numbers and log-weights as bytes), so a round hands few large values to the
    tasks. A cell's weight is ``n * exp(lw - shift)`` with ``lw = sum_t alpha_t *
    miss_t``: the stumps of the last ``checkpoint_every`` rounds are added in the
    task, older ones are folded into the stored log-weights; ``shift`` bounds the
    largest log-weight, so ``exp`` never overflows. Each round is ONE pass: a task
    counts its blocks into one table of (feature, bin) -> weighted class sums,
    and Spark adds the tables up. Ties go to the earlier
    feature, the lower threshold and polarity +1.

    Returns the stumps: feature, threshold, polarity (+1: predict 1 when
    x >= threshold) and weight alpha."""
    ensure_checkpoint_dir(train.sparkSession)
    cuts = _cuts(train, features, max_cuts)
    bins = [f"__bin_{i}" for i in range(len(features))]
    rows = train.select(*[F.expr(_bin_sql(f, cuts[f])).cast("int").alias(b) for f, b in zip(features, bins)], F.col(label).cast("int").alias("__y"),
                        (F.col(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("__n"))
    cells = rows.groupBy(*bins, "__y").agg(F.sum("__n").alias("__n")).where("__n > 0")
    width = "uint8" if max(len(c) for c in cuts.values()) < 256 else "uint32"
    packed = cells.mapInArrow(_pack_cells(bins, width), _BLOCK).checkpoint(eager=True)
    # few blocks a partition, so that an Arrow batch of blocks stays small; every round reads them all, so they stay spread
    par = train.sparkSession.sparkContext.defaultParallelism
    base = packed.repartition(max(par, -(-packed.count() // BLOCKS_PER_PARTITION))).checkpoint(eager=True)
    stumps: list[dict] = []
    recent: list[tuple[float, int, int, int]] = []  # alpha, feature, cut, polarity
    shift = 0.0

    for r in range(rounds):
        if recent and r % checkpoint_every == 0:
            base = base.mapInArrow(_fold_stumps(len(bins), width, recent), _BLOCK).checkpoint(eager=True)
            recent = []
        sums = base.mapInArrow(_stump_sums(len(bins), width, recent, shift, r > 0), "fi int, bin int, w1 double, w0 double, lw_max double")
        table = sums.groupBy("fi", "bin").agg(F.sum("w1").alias("w1"), F.sum("w0").alias("w0"), F.max("lw_max").alias("lw_max")).collect()
        per: dict[int, dict[int, tuple[float, float]]] = {}
        for row in table:
            per.setdefault(row["fi"], {})[row["bin"]] = (row["w1"], row["w0"])
        if not per:
            break
        lw_max = max(row["lw_max"] for row in table)
        total1 = math.fsum(v[0] for v in per[0].values())
        total0 = math.fsum(v[1] for v in per[0].values())
        tot = total1 + total0
        best = None
        for fi in sorted(per):
            below1 = below0 = 0.0
            for k, cut in enumerate(cuts[features[fi]]):
                b1, b0 = per[fi].get(k, (0.0, 0.0))
                below1, below0 = below1 + b1, below0 + b0
                # predict 1 when x >= cut (bin > k): errors = ones below + zeros above
                err_pos = below1 + (total0 - below0)
                for pol, err in ((1, err_pos), (-1, tot - err_pos)):
                    if best is None or err < best[0] - 1e-12 * tot:
                        best = (err, fi, k, pol)
        if best is None or tot <= 0:
            break
        err = max(best[0], 0.0) / tot
        if err >= 0.5:
            break
        err = max(err, 1e-10)
        alpha = learning_rate * math.log((1.0 - err) / err)
        _, fi, k, pol = best
        stumps.append({"feature": features[fi], "threshold": cuts[features[fi]][k], "polarity": pol, "alpha": alpha})
        recent.append((alpha, fi, k, pol))
        shift = lw_max + alpha  # bound on next round's largest log-weight
        if err <= 1e-10:
            break
    return stumps


def adaboost_sql(stumps: Sequence[dict]) -> str:
    """Class-1 probability of the boosted stumps: the alpha-weighted share of
    stumps voting 1 (greater than 0.5 exactly when the boosted vote says 1)."""
    total = sum(s["alpha"] for s in stumps) or 1.0
    terms = " + ".join(f"{s['alpha']!r} * ({_stump_sql(s['feature'], s['threshold'], s['polarity'])})"
                       for s in stumps) or "0.0"
    return f"(({terms}) / {total!r})"


# --------------------------------------------------------------- calibration

def folds_of(key: str, folds: int = 5, seed: int = 7):
    """Fold 0 .. folds - 1 of a row, by a hash of its key (a null key too)."""
    return F.pmod(F.xxhash64(F.lit(seed), q(key)), F.lit(folds)).cast("int")


def platt_calibration(df: DataFrame, score: str, label: str = "y", seed: int = 42) -> tuple[float, float]:
    """Platt scaling: logistic regression of y on the raw member score,
    fitted with Spark ML (distributed L-BFGS). Returns (a, b) for
    ``1 / (1 + exp(-(a * score + b)))``."""
    from pyspark.ml.classification import LogisticRegression
    data = VectorAssembler(inputCols=[score], outputCol="__cal_vec").transform(
        df.select(F.col(score).cast("double").alias(score), F.col(label).cast("double").alias("__cal_y")))
    lr = LogisticRegression(featuresCol="__cal_vec", labelCol="__cal_y", regParam=0.0, maxIter=100)
    m = lr.fit(data)
    return float(m.coefficients[0]), float(m.intercept)


def platt_calibrations(df: DataFrame, raw_exprs: Sequence[str], label: str = "y") -> list[tuple[float, float]]:
    """``platt_calibration`` of several members: one pass over ``df`` writes all
    their scores, and every fit reads its own column of that table alone."""
    scores = [F.expr(f"CAST(({e}) AS DOUBLE)").alias(f"s{i}") for i, e in enumerate(raw_exprs)]
    path = scratch_path(df.sparkSession, "platt-scores")
    df.select(*scores, q(label).alias(label)).write.parquet(path)
    held = df.sparkSession.read.parquet(path)
    return [platt_calibration(held, f"s{i}", label) for i in range(len(raw_exprs))]


def calibrated_sql(raw_expr: str, a: float, b: float) -> str:
    return f"(1.0D / (1.0D + exp(-({a!r} * ({raw_expr}) + {b!r}))))"


def isotonic_blocks(scores: DataFrame, score: str = "score", label: str = "y", num_partitions: int | None = None) -> list[tuple[float, float, float]]:
    """Isotonic regression of a 0/1 label on a score, by pool-adjacent-violators in two levels.

    Rows are counted per distinct score, dealt out in ranges of the score, and
    each range pools its own violators in one pass over Arrow batches. Pooling
    is associative, so pooling what is left of all ranges, in order, gives the
    blocks of one pass over everything. Returns (lowest score, highest score,
    mean of y) per block, rising.

    What leaves the ranges are blocks with rising means: on the driver there is
    one per step of the fitted function (not one per score)."""
    def pool(blocks):
        out: list[list[float]] = []
        for lo, hi, n, ones in blocks:
            out.append([lo, hi, n, ones])
            # equal means are one block, so the blocks do not depend on where the ranges were cut
            while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
                lo2, hi2, n2, ones2 = out.pop()
                out[-1][1], out[-1][2], out[-1][3] = hi2, out[-1][2] + n2, out[-1][3] + ones2
        return out

    def run(batches):
        import pyarrow as pa
        blocks: list = []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("s", "n", "ones")]
            blocks = pool([*blocks, *((s, s, n, ones) for s, n, ones in zip(*cols))])
        if blocks:
            cols = list(zip(*blocks))
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()),
                                              pa.array(cols[3], pa.int64())], names=["lo", "hi", "n", "ones"])

    per = scores.where(q(score).isNotNull() & q(label).isNotNull()).groupBy(q(score).cast("double").alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(q(label).cast("long")).alias("ones"))
    parts = num_partitions or int(scores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = per.repartitionByRange(parts, "s").sortWithinPartitions("s")
    got = ranged.mapInArrow(run, "lo double, hi double, n long, ones long").collect()
    return [(lo, hi, ones / n) for lo, hi, n, ones in pool(sorted((r["lo"], r["hi"], r["n"], r["ones"]) for r in got))]


def isotonic_sql(raw_expr: str, blocks: Sequence[tuple[float, float, float]]) -> str:
    """The fitted step function as SQL, linear between blocks, by halving over the block borders."""
    x = f"CAST(({raw_expr}) AS DOUBLE)"
    points = [p for lo, hi, v in blocks for p in ([(lo, v)] if lo == hi else [(lo, v), (hi, v)])]

    def part(i: int, j: int) -> str:  # x lies in [points[i], points[j]]
        if j - i == 1:
            (a, u), (b, v) = points[i], points[j]
            return f"{u!r}D" if u == v else f"({u!r}D + ({v - u!r}D) * (({x}) - ({a!r}D)) / ({b - a!r}D))"
        mid = (i + j) // 2
        return f"CASE WHEN {x} < {points[mid][0]!r}D THEN {part(i, mid)} ELSE {part(mid, j)} END"

    if not points:
        return x
    if len(points) == 1:
        return f"{points[0][1]!r}D"
    (a, u), (b, v) = points[0], points[-1]
    return f"(CASE WHEN {x} <= {a!r}D THEN {u!r}D WHEN {x} >= {b!r}D THEN {v!r}D ELSE {part(0, len(points) - 1)} END)"


def out_of_fold(train: DataFrame, key: str, fit, score, folds: int = 5) -> DataFrame:
    """``train`` with ``score``: each row's score by a model that has not seen its fold.

    ``fit(rows)`` gives a model, ``score(model, rows)`` adds the column. The
    rows are read once per fold to fit and once to score."""
    fold = folds_of(key, folds)
    parts = [score(fit(train.where(fold != k)), train.where(fold == k)) for k in range(folds)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
