"""Gradient-boosted trees, fitted on weighted cells instead of rows.

The method, its candidate thresholds (at most ``BINS`` - 1 a feature, found by
Spark ML) and the result (a Spark ML model) are those of ``GBTClassifier``: the first
tree fits the label as -1 / 1, every other one the negative gradient of
``2 log(1 + exp(-2 y F))``, by variance, and counts ``step_size``; a leaf gives
its mean. Rows that share the bin of every feature and the label have the same
gradient in every round, so they are one cell with their number (or weight).

Cells lie in packed blocks (see ``members``). A pass walks a block down the
trees that are not yet in its stored scores by whole-array comparisons, and
counts weight, gradient and squared gradient per frontier node and pair of
bins; a task sends one small table to the driver. A round takes a pass per
level, whatever the number of rows, and ``fold_every`` rounds write the scores.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.operators import members as MEM
from flowscore.operators.prep import q
from flowscore.session import ensure_checkpoint_dir

BINS = 32
_EPSILON = 2.0 ** -52


def thresholds(train: DataFrame, features: Sequence[str], label: str, weight_col: str | None, seed: int) -> list[list[float]]:
    """Candidate thresholds of each feature (x <= threshold goes left): those that Spark ML itself would try on these rows."""
    spark = train.sparkSession
    jvm = spark._jvm
    rows = MEM._assembler(features, "__features").transform(train)
    reader = MEM._weighted(GBTClassifier(labelCol=label, featuresCol="__features"), weight_col)
    reader._transfer_params_to_java()

    def module(name: str):
        return jvm.java.lang.Class.forName(name + "$").getField("MODULE$").get(None)
    instances = module("org.apache.spark.ml.util.DatasetUtils").extractInstances(reader._java_obj, rows._jdf, jvm.scala.Option.empty())
    strategy = jvm.org.apache.spark.mllib.tree.configuration.Strategy.defaultStrategy("Classification")
    strategy.setMaxBins(BINS)
    metadata = jvm.org.apache.spark.ml.tree.impl.DecisionTreeMetadata.buildMetadata(instances, strategy, 1, "all")
    found = module("org.apache.spark.ml.tree.impl.RandomForest").findSplits(instances, metadata, seed)
    return [[float(s.threshold()) for s in of] for of in found]


def _bin_sql(column: str, cuts: Sequence[float]) -> str:
    """Number of cuts below x: "x <= cuts[k]" is true iff the bin is at most k."""
    def part(lo: int, hi: int) -> str:
        if lo == hi:
            return str(lo)
        mid = (lo + hi) // 2
        return f"CASE WHEN {column} <= {cuts[mid]!r}D THEN {part(lo, mid)} ELSE {part(mid + 1, hi)} END"
    return part(0, len(cuts))


def _ends(bins: np.ndarray, tree) -> np.ndarray:
    """Node that each cell reaches; the children of a node are left, left + 1."""
    feat, cut, left = tree
    at = np.zeros(bins.shape[1], np.uint8 if len(feat) < 256 else np.uint32)
    for node in np.flatnonzero(feat >= 0):
        at = np.where(at == node, at.dtype.type(left[node]) + (bins[feat[node]] > cut[node]), at)
    return at


def _gradients(y: np.ndarray, score: np.ndarray, first: bool) -> np.ndarray:
    sign = 2.0 * y - 1.0
    return sign if first else 4.0 * sign / (1.0 + np.exp(np.minimum(2.0 * sign * score, 700.0)))


def _scored(batches, k: int, recent):
    """(bins, y, n, score with the recent trees) of every block."""
    for bins, y, n, score in MEM._blocks(batches, k, "uint8", ()):
        for tree, values in recent:
            score += values.take(_ends(bins, tree))
        yield bins, y, n, score


def _fold(k: int, recent):
    def fn(batches):
        for block in _scored(batches, k, recent):
            yield MEM._block(*block)
    return fn


def _sums(k: int, width: int, recent, tree, frontier: Sequence[int], first: bool):
    """Weight, gradient and squared gradient by frontier node, feature and bin: one table per task."""
    def fn(batches):
        slot_of = np.full(len(tree[0]), -1)
        slot_of[frontier] = np.arange(len(frontier))
        total = np.zeros((3, len(frontier), k, width))
        some = False
        for bins, y, n, score in _scored(batches, k, recent):
            slot = slot_of.take(_ends(bins, tree))
            grad = _gradients(y, score, first)
            if (slot < 0).any():
                here = np.flatnonzero(slot >= 0)
                bins, slot, n, grad = bins[:, here], slot[here], n[here], grad[here]
            some = True
            weights = n, n * grad, n * grad * grad
            base = slot * (width * width)
            for f in range(0, k, 2):  # two features at a time: half the counting
                two = f + 1 < k
                code = base + (bins[f].astype(np.int64) * width + bins[f + 1]) if two else base + bins[f].astype(np.int64) * width
                for i, w in enumerate(weights):
                    table = np.bincount(code, w, len(frontier) * width * width).reshape(len(frontier), width, width)
                    total[i, :, f] += table.sum(2)
                    if two:
                        total[i, :, f + 1] += table.sum(1)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])
    return fn


def _variance(sums):
    w, g, gg = sums
    return np.divide(gg - np.divide(g * g, w, out=np.zeros_like(w), where=w > 0), w, out=np.zeros_like(w), where=w > 0)


def _best(node: np.ndarray, cuts: Sequence[Sequence[float]]):
    """(gain, feature, cut, sums left, sums right) of the best split of a node's (3, features, bins) sums; ties go to the earlier one."""
    whole = node[:, 0].sum(1)
    impurity = float(_variance(whole))
    best = None
    for f, c in enumerate(cuts):
        if not len(c):
            continue
        left = np.cumsum(node[:, f], 1)[:, :len(c)]
        right = np.cumsum(node[:, f, ::-1], 1)[:, ::-1][:, 1:len(c) + 1]
        # nothing is on a side without a bin that has weight
        filled = np.flatnonzero(node[0, f] > 0)
        ok = (np.arange(len(c)) >= filled[0]) & (np.arange(len(c)) < filled[-1])
        gain = np.where(ok, impurity - (left[0] * _variance(left) + right[0] * _variance(right)) / whole[0], -np.inf)
        j = int(gain.argmax())
        if gain[j] > 0 and (best is None or gain[j] > best[0] + 1e-12 * impurity):
            best = float(gain[j]), f, j, left[:, j], right[:, j]
    return best


def binned(train: DataFrame, features: Sequence[str], label: str, weight_col: str | None, seed: int):
    """(thresholds, rows as bins, label ``__y`` and weight ``__n``, names of the bins)."""
    y = q(label).cast("double")
    w = q(weight_col).cast("double") if weight_col else F.lit(1.0)
    ok = y.isin(0.0, 1.0) & (w >= 0) & (w < float("inf"))
    for f in features:
        ok = ok & (F.abs(q(f).cast("double")) < float("inf"))  # neither NaN
    rows = train.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce(ok, F.lit(False))).alias("ok")).first()
    if rows["ok"] < rows["n"]:
        raise ValueError("labels must be 0 or 1, features finite and weights neither null nor negative")
    if not rows["n"]:
        raise ValueError("no rows to fit on")
    cuts = thresholds(train, features, label, weight_col, seed)
    names = [f"__bin_{i}" for i in range(len(features))]
    out = train.select(*[q(f).cast("double").alias(b) for f, b in zip(features, names)], y.alias("__y"), w.alias("__n")).select(
        *[F.expr(_bin_sql(b, c)).cast("int").alias(b) for b, c in zip(names, cuts)], "__y", "__n")
    return cuts, out, names


def table_width(cuts: Sequence[Sequence[float]]) -> int:
    """Bins of the feature with the most: Spark ML may find a threshold more than it was asked for."""
    return max(2, *[len(c) + 1 for c in cuts])


def spread(packed: DataFrame) -> DataFrame:
    """Blocks of cells, stored and dealt out: every pass reads them all."""
    ensure_checkpoint_dir(packed.sparkSession)
    packed = packed.checkpoint(eager=True)
    par, blocks = packed.sparkSession.sparkContext.defaultParallelism, packed.count()
    return packed.repartition(max(1, min(par, blocks), -(-blocks // MEM.BLOCKS_PER_PARTITION))).checkpoint(eager=True)


def fit_trees(train: DataFrame, features: Sequence[str], label: str, max_iter: int, max_depth: int, step_size: float, seed: int, weight_col: str | None,
              fold_every: int = 10):
    """(thresholds, trees, tree weights); a tree is the lists feat, cut, left and sums of its nodes."""
    cuts, rows, names = binned(train, features, label, weight_col, seed)
    cells = rows.groupBy(*names, "__y").agg(F.sum("__n").alias("__n")).where("__n > 0")
    base = spread(cells.mapInArrow(MEM._pack_cells(names, "uint8"), MEM._BLOCK))
    k, width, trees, weights, recent = len(features), table_width(cuts), [], [], []
    for r in range(max_iter):
        if len(recent) >= fold_every:
            base = base.mapInArrow(_fold(k, recent), MEM._BLOCK).checkpoint(eager=True)
            recent = []
        feat, cut, left, sums = [-1], [0], [0], [None]
        frontier = [0]
        for level in range(max(1, max_depth)):
            tree = tuple(np.array(v) for v in (feat, cut, left))
            got = base.mapInArrow(_sums(k, width, recent, tree, frontier, not trees), "sums binary").collect()
            table = sum(np.frombuffer(g["sums"]) for g in got).reshape(3, len(frontier), k, width)
            new = []
            for slot, node in enumerate(frontier):
                if sums[node] is None:
                    sums[node] = table[:, slot, 0].sum(1)
                best = _best(table[:, slot], cuts) if max_depth else None
                if best is None:
                    continue
                _, feat[node], cut[node], below, above = best
                left[node] = len(feat)
                for side in (below, above):
                    if level + 1 < max_depth and abs(float(_variance(side))) >= _EPSILON:
                        new.append(len(feat))
                    feat, cut, left, sums = [*feat, -1], [*cut, 0], [*left, 0], [*sums, side]
            frontier = new
            if not frontier:
                break
        trees.append((feat, cut, left, sums))
        weights.append(1.0 if r == 0 else step_size)
        recent.append((tuple(np.array(v) for v in (feat, cut, left)), weights[-1] * np.array([s[1] / s[0] for s in sums])))
    return cuts, trees, weights


def as_model(spark, estimator: GBTClassifier, cuts, trees, weights, num_features: int) -> GBTClassificationModel:
    """The trees as a Spark ML model."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml = jvm.org.apache.spark.ml

    def doubles(values):
        out = gateway.new_array(gateway.jvm.double, len(values))
        for i, v in enumerate(values):
            out[i] = float(v)
        return out

    def node(tree, i: int):
        feat, cut, left, sums = tree
        w, g, _ = sums[i]
        mean, impurity = float(g / w), float(_variance(sums[i]))
        stats = jvm.org.apache.spark.mllib.tree.impurity.VarianceCalculator(doubles(sums[i]), int(round(w)))
        if feat[i] < 0:
            return ml.tree.LeafNode(mean, impurity, stats)
        a, b = sums[left[i]], sums[left[i] + 1]
        gain = impurity - float(a[0] * _variance(a) + b[0] * _variance(b)) / float(w)
        split = ml.tree.ContinuousSplit(int(feat[i]), float(cuts[feat[i]][cut[i]]))
        return ml.tree.InternalNode(mean, impurity, gain, node(tree, left[i]), node(tree, left[i] + 1), split, stats)

    kind = ml.regression.DecisionTreeRegressionModel
    array = gateway.new_array(kind, len(trees))
    for i, tree in enumerate(trees):
        array[i] = kind(f"dtr_{estimator.uid}_{i}", node(tree, 0), num_features)
    java = ml.classification.GBTClassificationModel(estimator.uid, array, doubles(weights), num_features, 2)
    return estimator._copyValues(GBTClassificationModel(java))
