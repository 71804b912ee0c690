"""Forests of bootstrapped trees, fitted on cells of rows.

The method and the result (a Spark ML model) are those of
``RandomForestClassifier``: every tree weighs every row with its own draw of
Poisson(1), a node tries ``tries`` features at the candidate thresholds of
``boosting``, takes the split with the largest gain in Gini impurity, and is a
leaf at ``max_depth``, when pure or when nothing gains; leaves of one parent
that vote alike are merged.

Rows that share the bin of every feature, label and weight are one cell with
their number c: c draws of Poisson(1) add up to one of Poisson(c), so a cell
draws once per tree. Draws are a hash of seed, tree and cell (a power of two in
c at a time), so they depend neither on the order of rows nor on partitions.

One pass per level (several, if its nodes' tables outgrow ``TABLE_BYTES``): a task walks each block of cells down one tree after the
other and adds up class weights by frontier node, feature and bin. The tables
are dealt out by node, added up and searched for the best split in the tasks;
the driver gets one row per frontier node.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.operators import boosting as BOOST
from flowscore.operators import extra_trees as XT
from flowscore.operators import members as MEM

TABLE_BYTES = 256 << 20  # of a task's class weights in one pass
_CELLS = "bins binary, y binary, n binary, w binary, id binary"
_BEST = "node long, w0 double, w1 double, feat int, cut int, l0 double, l1 double, r0 double, r1 double"


_POISSON: dict[int, np.ndarray] = {}


def _poisson(mean: int) -> np.ndarray:
    """Cumulative probabilities of Poisson(mean) from 0 on."""
    if mean in _POISSON:
        return _POISSON[mean]
    last = int(mean + 12 * math.sqrt(mean) + 20)
    k = np.arange(last + 1)
    logs = np.append(0.0, np.cumsum(np.log(np.arange(1, last + 1))))
    _POISSON[mean] = np.cumsum(np.exp(k * math.log(mean) - mean - logs))
    return _POISSON[mean]


def _hashed(x: np.ndarray) -> np.ndarray:
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    return x ^ (x >> np.uint64(31))


def _draws(ids: np.ndarray, bits: Sequence[tuple[int, np.ndarray | None]], seed: int, tree: int) -> np.ndarray:
    """How often a tree draws the rows of each cell; ``bits``: the powers of two in the cells' numbers, and the cells that have them."""
    out = np.zeros(len(ids), np.int64)
    for b, at in bits:
        salt = np.uint64(((seed * 1_000_003 + tree) * 64 + b + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        u = (_hashed((ids if at is None else ids[at]) ^ salt) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        drawn = np.searchsorted(_poisson(1 << b), u, side="right")
        if at is None:
            out += drawn
        else:
            out[at] += drawn
    return out


def _bits(n: np.ndarray):
    n, out, b = n.astype(np.int64), [], 0
    while (n >> b).any():
        at = np.flatnonzero((n >> b) & 1)
        if len(at):
            out.append((b, None if len(at) == len(n) else at))
        b += 1
    return out


def _pack(names: Sequence[str]):
    def fn(batches):
        for b in batches:
            if b.num_rows:
                x = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in names], 1).astype(np.uint8)
                cols = [x] + [b.column(c).to_numpy(zero_copy_only=False) for c in ("__y", "__c", "__w", "__id")]
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in cols], names=["bins", "y", "n", "w", "id"])
    return fn


def _tables(k: int, width: int, shared, start: int, level: int, seed: int, bootstrap: bool):
    """Class weights by frontier node, feature and bin: a row per frontier node that a task met."""
    def fn(batches):
        table, edges = shared.value
        steps = XT._steps(*table)
        total = np.zeros((int(edges[-1]), k, 2 * width))
        for b in batches:
            for raw in zip(*(b.column(c) for c in ("bins", "y", "n", "w", "id"))):
                y, n, w = (np.frombuffer(v.as_buffer(), np.float64) for v in raw[1:4])
                ids = np.frombuffer(raw[4].as_buffer(), np.int64).view(np.uint64)
                x = np.frombuffer(raw[0].as_buffer(), np.uint8).reshape(len(y), k)
                code = [x[:, f].astype(np.int64) + width * (y == 1) for f in range(k)]
                bits = _bits(n) if bootstrap else None
                for t in np.flatnonzero(edges[1:] > edges[:-1]):
                    row, node = XT._walk(x, t, steps, level)
                    here = np.flatnonzero((node >= start + edges[t]) & (node < start + edges[t + 1]))
                    row, slot = row[here], node[here] - (start + edges[t])
                    weight = (_draws(ids, bits, seed, int(t)) if bootstrap else n)[row] * w[row]
                    some = np.flatnonzero(weight)
                    if not len(some):
                        continue
                    row, slot, weight = row[some], slot[some], weight[some]
                    to = slice(edges[t], edges[t + 1])
                    size = int(edges[t + 1] - edges[t])
                    if 4 * size > len(slot):  # many nodes that a block does not meet
                        met, slot = np.unique(slot, return_inverse=True)
                        to, size = edges[t] + met, len(met)
                    slot = slot * (2 * width)
                    for f in range(k):
                        total[to, f] += np.bincount(slot + code[f].take(row), weight, size * 2 * width).reshape(size, 2 * width)
        met = np.flatnonzero(total[:, 0].any(1))
        for lo in range(0, len(met), 256):
            at = met[lo: lo + 256]
            yield pa.RecordBatch.from_arrays([pa.array(start + at), pa.array([total[i].tobytes() for i in at], pa.binary())], names=["node", "sums"])
    return fn


def _gini(w0, w1):
    whole = w0 + w1
    p = np.divide(w1, whole, out=np.zeros_like(whole), where=whole > 0)
    return 2.0 * p * (1.0 - p)


def _splits(k: int, width: int, cuts: Sequence[int], tree_of, seed: int, tries: int):
    """The best split of each node whose tables come to a task; ``feat`` -1: none gains."""
    def fn(batches):
        added: dict[int, np.ndarray] = {}
        for b in batches:
            for node, raw in zip(b.column("node").to_pylist(), b.column("sums")):
                sums = np.frombuffer(raw.as_buffer(), np.float64)
                added[node] = added[node] + sums if node in added else sums
        if not added:
            return
        node = np.array(sorted(added))
        sums = np.stack([added[i] for i in node]).reshape(len(node), k, 2, width)
        whole = sums[:, 0].sum(2)  # node, class
        left = np.cumsum(sums, 3)[..., :width - 1]
        right = np.cumsum(sums[..., ::-1], 3)[..., ::-1][..., 1:]  # added up, so that a class without rows stays at 0
        wl, wr = left.sum(2), right.sum(2)
        filled = sums.sum(2) > 0
        first, last = filled.argmax(2)[..., None], width - 1 - filled[..., ::-1].argmax(2)[..., None]
        at = np.arange(width - 1)
        # a cut with bins of weight on both sides, of a feature that the node tries
        ok = (at >= first) & (at < last) & (at < np.array(cuts)[None, :, None])
        chosen = np.argsort(XT._uniform(seed, 0, tree_of.value[node], node, k), axis=1, kind="stable")[:, :tries]
        mine = np.zeros((len(node), k), bool)
        np.put_along_axis(mine, chosen, True, 1)
        impurity = _gini(whole[:, 0], whole[:, 1])
        after = (wl * _gini(left[:, :, 0], left[:, :, 1]) + wr * _gini(right[:, :, 0], right[:, :, 1])) / whole.sum(1)[:, None, None]
        gain = np.where(ok & mine[..., None], impurity[:, None, None] - after, -np.inf).reshape(len(node), -1)
        top = gain.max(1)
        best = (gain > (top - 1e-12)[:, None]).argmax(1)  # ties go to the earlier feature and cut
        feat, cut = np.divmod(best, width - 1)
        rows = np.arange(len(node))
        below, above = left[rows, feat, :, cut], right[rows, feat, :, cut]
        gains = top > 1e-15
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(np.where(gains, feat, -1), pa.int32()),
                                          pa.array(cut, pa.int32()), *[pa.array(side[:, c]) for side in (below, above) for c in (0, 1)]],
                                         names=["node", "w0", "w1", "feat", "cut", "l0", "l1", "r0", "r1"])
    return fn


def fit_trees(train: DataFrame, features: Sequence[str], label: str, num_trees: int, max_depth: int, seed: int, weight_col: str | None,
              tries: int, bootstrap: bool = True):
    """(thresholds, node table): feat (-1 at a leaf), cut, left (right is the next one), w0 and w1 of every node; node t < trees is a root."""
    spark = train.sparkSession
    cuts, binned, names = BOOST.binned(train, features, label, weight_col, seed)
    cells = binned.groupBy(*names, "__y", F.col("__n").alias("__w")).agg(F.count(F.lit(1)).cast("double").alias("__c")).where("__w > 0")
    cells = cells.withColumn("__id", F.xxhash64(*names, "__y", "__w"))
    base = BOOST.spread(cells.mapInArrow(_pack(names), _CELLS))
    k, width, par = len(features), BOOST.table_width(cuts), int(spark.conf.get("spark.sql.shuffle.partitions"))
    tree = np.arange(num_trees)
    kinds = {"feat": np.int64, "cut": np.float64, "left": np.int64, "w0": np.float64, "w1": np.float64}
    table = {c: np.full(num_trees, -1 if c in ("feat", "left") else 0, t) for c, t in kinds.items()}
    start = 0
    for level in range(max(1, max_depth)):
        if start == len(tree):
            break
        edges = np.searchsorted(tree[start:], np.arange(num_trees + 1))
        tree_of = spark.sparkContext.broadcast(tree)
        found = []
        per_pass = max(1, TABLE_BYTES // (k * 2 * width * 8))
        for lo in range(0, len(tree) - start, per_pass):
            now = np.clip(edges, lo, lo + per_pass) - lo
            shared = spark.sparkContext.broadcast(((table["feat"], table["cut"], table["left"], table["left"] + 1), now))
            sums = base.mapInArrow(_tables(k, width, shared, start + lo, level, seed, bootstrap), "node long, sums binary").repartition(par, "node")
            found.append(sums.mapInArrow(_splits(k, width, [len(c) for c in cuts], tree_of, seed, tries), _BEST).toArrow())
            shared.unpersist()
        tree_of.unpersist()
        got = pa.concat_tables(found).sort_by("node")
        got = {c: got[c].to_numpy() for c in got.column_names}
        node = got["node"]
        if level == 0:
            table["w0"][node], table["w1"][node] = got["w0"], got["w1"]
        split = (got["feat"] >= 0) & (max_depth > 0) & (_gini(got["w0"], got["w1"]) >= BOOST._EPSILON)
        node, got = node[split], {c: v[split] for c, v in got.items()}
        left = len(tree) + 2 * np.arange(len(node))
        table["feat"][node], table["cut"][node], table["left"][node] = got["feat"], got["cut"], left
        start = len(tree)
        tree = np.append(tree, np.repeat(tree[node], 2))
        for c in ("feat", "cut", "left"):
            table[c] = np.append(table[c], np.full(2 * len(node), -1 if c in ("feat", "left") else 0, kinds[c]))
        for c, below, above in (("w0", "l0", "r0"), ("w1", "l1", "r1")):
            table[c] = np.append(table[c], np.stack([got[below], got[above]], 1).ravel())
    return cuts, table


def as_model(spark, estimator: RandomForestClassifier, cuts, table, num_trees: int, num_features: int) -> RandomForestClassificationModel:
    """The trees as a Spark ML model; leaves of one parent that vote alike are merged."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    ml, gini = jvm.org.apache.spark.ml, jvm.org.apache.spark.mllib.tree.impurity.GiniCalculator
    feat, cut, left = (table[c].tolist() for c in ("feat", "cut", "left"))
    w0, w1 = table["w0"], table["w1"]
    votes, impurity = (w1 > w0).astype(float).tolist(), _gini(w0, w1).tolist()
    leaf = [f < 0 for f in feat]
    for i in reversed(range(len(feat))):  # children come after their parent
        if not leaf[i]:
            a = left[i]
            leaf[i] = leaf[a] and leaf[a + 1] and votes[a] == votes[a + 1]
    whole = (w0 + w1).tolist()
    raw = np.stack([w0, w1], 1).astype(">f8").tobytes()
    stored = gateway.new_array(gateway.jvm.double, 2 * len(feat))
    jvm.java.nio.ByteBuffer.wrap(raw).asDoubleBuffer().get(stored)
    copy = jvm.java.util.Arrays.copyOfRange
    inner, end, threshold = ml.tree.InternalNode, ml.tree.LeafNode, ml.tree.ContinuousSplit

    def node(i: int):
        stats = gini(copy(stored, 2 * i, 2 * i + 2), int(round(whole[i])))
        if leaf[i]:
            return end(votes[i], impurity[i], stats)
        a = left[i]
        gain = impurity[i] - (whole[a] * impurity[a] + whole[a + 1] * impurity[a + 1]) / whole[i]
        return inner(votes[i], impurity[i], gain, node(a), node(a + 1), threshold(int(feat[i]), float(cuts[feat[i]][int(cut[i])])), stats)

    kind = ml.classification.DecisionTreeClassificationModel
    array = gateway.new_array(kind, num_trees)
    for t in range(num_trees):
        array[t] = kind(f"dtc_{estimator.uid}_{t}", node(t), num_features, 2)
    java = ml.classification.RandomForestClassificationModel(estimator.uid, array, num_features, 2)
    return estimator._copyValues(RandomForestClassificationModel(java))
