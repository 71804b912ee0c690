"""Extremely randomised trees, grown level by level until their leaves are pure.

A forest is a sparse node table: nodes are numbered as they are made, over all
trees, and only nodes that exist have a row (split feature and threshold, the
two children, the class-1 share). Each level's new nodes are the frontier, a
contiguous range of numbers; nothing is kept or sent for depths a tree does not
reach, so there is no depth limit by default.

Per level, two passes over the training rows (``mapInArrow``): a task walks
each Arrow batch through one tree after the other with numpy and adds up, over
all its batches, statistics per frontier node -- class counts and feature
ranges, then class counts per split candidate and side -- so the shuffle carries
at most a row per frontier node and task, whatever the skew. Spark combines them; the
driver draws each node's candidates (features that still vary in the node, a
uniform threshold between their smallest and largest value, both hashed from
seed, tree and node) and keeps the best weighted Gini split. No bootstrap:
every tree sees every row. The driver and the tasks hold the node table, i.e.
the model, and the frontier's statistics; both grow with the model, not with
the rows.

Scoring routes rows through the node table inside a scalar ``pandas_udf``
(vectorised per Arrow batch); the table is a broadcast variable.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from flowscore.operators.prep import q

CHUNK_ROWS = 2048  # rows that are scored in all trees at once


@dataclass
class Forest:
    """Node table; node ``t`` < ``trees`` is the root of tree t."""

    features: list[str]
    trees: int
    feat: np.ndarray  # split feature, -1 at a leaf
    thr: np.ndarray  # x > thr goes right
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray  # class-1 share of the training weight in the node

    def to_dict(self) -> dict:
        return {"features": self.features, "trees": self.trees, **{c: getattr(self, c).tolist() for c in ARRAYS}}

    @property
    def depth(self) -> int:
        """Splits on the longest way from a root to a leaf."""
        at, d = np.arange(self.trees), 0
        while True:
            at = at[self.feat[at] >= 0]
            if not len(at):
                return d
            at, d = np.concatenate([self.left[at], self.right[at]]), d + 1


ARRAYS = {"feat": np.int32, "thr": np.float64, "left": np.int32, "right": np.int32, "value": np.float64}


def _steps(feat, thr, left, right):
    """The node table as a walk takes it: node t goes on to ``kids[2 t + (x > thr)]``; a leaf stays where it is."""
    leaf, at = feat < 0, np.arange(len(feat))
    kids = np.stack([np.where(leaf, at, left), np.where(leaf, at, right)], 1).ravel()
    return np.where(leaf, 0, feat).astype(np.int64), np.where(leaf, np.inf, thr), kids.astype(np.int64), leaf


def _walk(X: np.ndarray, root: int, steps, levels: int | None = None):
    """(row, node) of the rows of C-ordered X after ``levels`` splits of one tree (None: to the end)."""
    feat, thr, kids, leaf = steps
    flat, k = X.ravel(), X.shape[1]
    row = np.arange(len(X))
    first, at = row * k, np.full(len(X), root)
    done_row, done_at = [], []
    step = 0
    while len(at) and (levels is None or step < levels):
        if step % 4 == 0:  # rows that stand in a leaf leave the walk once they are many
            stays = leaf.take(at)
            n = np.count_nonzero(stays)
            if 2 * n > len(at) or (levels is None and n == len(at)):
                done_row.append(row[stays])
                done_at.append(at[stays])
                go = ~stays
                row, first, at = row[go], first[go], at[go]
        at = kids.take(2 * at + (flat.take(first + feat.take(at)) > thr.take(at)))
        step += 1
    if not done_row:
        return row, at
    return np.concatenate([*done_row, row]), np.concatenate([*done_at, at])


def _route(X: np.ndarray, trees: int, steps) -> np.ndarray:
    """Last node that every row reaches in every tree: (trees, rows)."""
    out = np.empty((trees, len(X)), np.int64)
    for t in range(trees):
        row, node = _walk(X, t, steps)
        out[t, row] = node
    return out


def _chunks(batches: Iterator[pa.RecordBatch], features, label, weight):
    for b in batches:
        if b.num_rows:
            X = np.empty((b.num_rows, len(features)))
            for j, f in enumerate(features):
                X[:, j] = b.column(f).to_numpy(zero_copy_only=False)
            yield X, b.column(label).to_numpy(zero_copy_only=False) == 1, b.column(weight).to_numpy(zero_copy_only=False)


def _frontier(X, steps, start, edges, level):
    """Per tree with frontier nodes: (first slot, number of slots, rows there, their slots counted from the first)."""
    for t in np.flatnonzero(edges[1:] > edges[:-1]):
        row, node = _walk(X, t, steps, level)
        here = np.flatnonzero(node >= start)
        if len(here):
            lo = edges[t]
            yield lo, edges[t + 1] - lo, row[here], node[here] - (start + lo)


def _ranges(features, label, weight, shared, start, level, spans):
    """Per frontier node: weight, class-1 weight, rows of both kinds and, with ``spans``, smallest and largest value of
    each feature. A task adds its batches up and emits a row per node that it met."""
    k = len(features)

    def fn(batches):
        table, edges = shared.value
        steps, size = _steps(*table), int(edges[-1])
        sums, low, high = np.zeros((4, size)), np.full((k, size), np.inf), np.full((k, size), -np.inf)
        for X, one, w in _chunks(batches, features, label, weight):
            columns = np.ascontiguousarray(X.T)
            ones = one.astype(np.float64)
            w1 = w * ones
            for lo, n, row, slot in _frontier(X, steps, start, edges, level):
                at = slice(lo, lo + n)
                for i, v in enumerate((w, w1, None, ones)):
                    sums[i, at] += np.bincount(slot, None if v is None else v.take(row), n)
                if spans:
                    order = np.argsort(slot.astype(np.uint16) if n <= 65536 else slot, kind="stable")
                    slot, row = slot[order], row[order]
                    first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
                    node = lo + slot[first]
                    for j in range(k):
                        x = columns[j].take(row)
                        low[j, node] = np.minimum(low[j, node], np.minimum.reduceat(x, first))
                        high[j, node] = np.maximum(high[j, node], np.maximum.reduceat(x, first))
        met = np.flatnonzero(sums[2])
        if len(met):
            cols = [start + met, sums[0, met], sums[1, met], sums[2, met].astype(np.int64), sums[3, met].astype(np.int64)]
            cols += [m[j, met] for m in (low, high) for j in range(k)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols],
                                             names=["node", "w", "w1", "n", "n1", *[f"mn{j}" for j in range(k)], *[f"mx{j}" for j in range(k)]])
    return fn


def _sides(features, label, weight, shared, start, level):
    """Per frontier node, candidate, side and class: the weight that goes there, added up over the task's batches."""
    k = len(features)

    def fn(batches):
        table, edges, cand_f, cand_t = shared.value
        steps, tries = _steps(*table), cand_f.shape[1]
        sums = np.zeros((cand_f.size, 4))  # slot and candidate, side and class
        met = np.zeros(len(cand_f), bool)
        splits = (cand_f >= 0).any(1)
        for X, one, w in _chunks(batches, features, label, weight):
            flat = X.ravel()
            for lo, n, row, slot in _frontier(X, steps, start, edges, level):
                open_ = np.flatnonzero(splits[lo:lo + n].take(slot))
                if not len(open_):
                    continue
                row, slot = row[open_], slot[open_]
                met[lo + slot] = True
                first, y, wr = row * k, one.take(row), w.take(row)
                for c in range(tries):
                    f, t = cand_f[lo:lo + n, c].copy(), cand_t[lo:lo + n, c].copy()
                    f[f < 0] = 0  # its sums are not used
                    code = slot * 4 + 2 * (flat.take(first + f.take(slot)) > t.take(slot)) + y
                    sums[lo * tries + c:(lo + n) * tries:tries] += np.bincount(code, wr, 4 * n).reshape(n, 4)
        code = np.flatnonzero(np.repeat(met, 4 * tries))
        if len(code):
            yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(sums.ravel()[code])], names=["code", "w"])
    return fn


def _uniform(seed: int, draw: int, tree: np.ndarray, node: np.ndarray, k: int) -> np.ndarray:
    """(nodes, k) numbers in [0, 1), the same for a node whatever else is drawn."""
    x = (tree.astype(np.uint64)[:, None] << np.uint64(40)) ^ (node.astype(np.uint64)[:, None] << np.uint64(8)) ^ np.arange(k, dtype=np.uint64)
    x = x ^ np.uint64((seed * 1_000_003 + draw * 7_919) * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(np.float64) / float(1 << 53)


def fit_extra_trees(train: DataFrame, features: Sequence[str], label: str = "y", n_estimators: int = 100,
                    max_depth: int | None = None, min_samples_split: int = 2, max_features: int | None = None,
                    seed: int = 42, weight_col: str | None = None) -> Forest:
    """Fit on cleaned features. A node becomes a leaf when it is pure, has fewer
    than ``min_samples_split`` rows, when no feature varies in it, or at
    ``max_depth`` (None: no limit). ``max_features``: candidates per node, the
    root of the number of features by default."""
    features = list(features)
    k = len(features)
    tries = max_features or max(1, int(math.sqrt(k)))
    data = train.select(*[q(f).cast("double").alias(f"x{i}") for i, f in enumerate(features)], q(label).cast("long").alias("y"),
                        (q(weight_col).cast("double") if weight_col else F.lit(1.0)).alias("w"))
    par = train.sparkSession.sparkContext.defaultParallelism
    # every level reads the rows twice: a scan of few splits is spread once
    data = (data.repartition(par) if data.rdd.getNumPartitions() < par else data).persist()
    cols = [f"x{i}" for i in range(k)]
    sc = train.sparkSession.sparkContext
    tree = np.arange(n_estimators)  # of each node
    table = {c: np.full(n_estimators, -1 if c in ("feat", "left", "right") else 0, t) for c, t in ARRAYS.items()}
    start, level = 0, 0
    schema = "node long, w double, w1 double, n long, n1 long, " + ", ".join(f"{m}{j} double" for m in ("mn", "mx") for j in range(k))
    try:
        while start < len(tree):
            now = [table[c].copy() for c in ("feat", "thr", "left", "right")]
            edges = np.searchsorted(tree[start:], np.arange(n_estimators + 1))  # a level's nodes stand in tree order
            last = max_depth is not None and level >= max_depth
            shared = sc.broadcast((now, edges))
            got = data.mapInArrow(_ranges(cols, "y", "w", shared, start, level, not last), schema).groupBy("node").agg(
                *[F.sum(c).alias(c) for c in ("w", "w1", "n", "n1")], *[F.min(f"mn{j}").alias(f"mn{j}") for j in range(k)],
                *[F.max(f"mx{j}").alias(f"mx{j}") for j in range(k)]).toArrow()
            shared.unpersist()
            got = got.sort_by("node")  # children are numbered in this order
            stat = {c: got[c].to_numpy() for c in got.column_names}
            node = stat["node"]
            table["value"][node] = np.divide(stat["w1"], stat["w"], out=np.zeros(len(node)), where=stat["w"] > 0)
            lo, hi = (np.column_stack([stat[f"{m}{j}"] for j in range(k)]) for m in ("mn", "mx"))
            varies = hi > lo
            split = (stat["n1"] > 0) & (stat["n1"] < stat["n"]) & (stat["n"] >= min_samples_split) & varies.any(1)
            if last or not split.any():
                break
            node, lo, hi, varies = node[split], lo[split], hi[split], varies[split]
            order = np.argsort(np.where(varies, _uniform(seed, 0, tree[node], node, k), 2.0), axis=1, kind="stable")[:, :tries]
            width = np.take_along_axis(hi - lo, order, 1)
            cut = np.take_along_axis(lo, order, 1) + _uniform(seed, 1, tree[node], node, k)[:, :order.shape[1]] * width
            cut = np.minimum(cut, np.nextafter(np.take_along_axis(hi, order, 1), -np.inf))  # the largest value goes right
            cand_f = np.full((len(tree) - start, order.shape[1]), -1, np.int64)
            cand_t = np.zeros(cand_f.shape)
            cand_f[node - start] = np.where(np.take_along_axis(varies, order, 1), order, -1)
            cand_t[node - start] = cut
            shared = sc.broadcast((now, edges, cand_f, cand_t))
            got = data.mapInArrow(_sides(cols, "y", "w", shared, start, level), "code long, w double").groupBy("code").agg(F.sum("w").alias("w")).toArrow()
            shared.unpersist()
            w = np.zeros(cand_f.size * 4)
            w[got["code"].to_numpy()] = got["w"].to_numpy()
            w = w.reshape(*cand_f.shape, 2, 2)  # slot, candidate, side, class
            side = w.sum(3)
            gini = np.divide(2 * w[..., 0] * w[..., 1], side, out=np.zeros(side.shape), where=side > 0).sum(2)
            gini[cand_f < 0] = np.inf
            best = gini[node - start].argmin(1)
            made = len(tree) + 2 * np.arange(len(node))
            table["feat"][node], table["thr"][node] = cand_f[node - start, best], cand_t[node - start, best]
            table["left"][node], table["right"][node] = made, made + 1
            start, level = len(tree), level + 1
            tree = np.append(tree, np.repeat(tree[node], 2))
            for c in table:
                table[c] = np.append(table[c], np.full(2 * len(node), -1 if c in ("feat", "left", "right") else 0, ARRAYS[c]))
    finally:
        data.unpersist()
    return Forest(features, n_estimators, **table)


def save_forest(spark, forest: Forest, path: str) -> None:
    """One JSON row through Spark's writer (works on any shared file system)."""
    spark.createDataFrame([(json.dumps(forest.to_dict()),)], "forest string").coalesce(1) \
        .write.mode("overwrite").json(path)


def load_forest(spark, path: str) -> Forest:
    d = json.loads(spark.read.schema("forest string").json(path).first()["forest"])
    return Forest(d["features"], int(d["trees"]), **{c: np.array(d[c], dtype=t) for c, t in ARRAYS.items()})


def forest_probability(forest: Forest, cols: Sequence[Column | str] | None = None, only: Column | None = None) -> Column:
    """Class-1 probability: mean of the trees' leaf shares (Arrow-batched).
    The node table is a broadcast variable (fetched once per executor).
    With ``only``, rows where it is not true are not routed and give null."""
    from pyspark.sql import SparkSession
    bc = SparkSession.getActiveSession().sparkContext.broadcast(
        (forest.trees, forest.feat, forest.thr, forest.left, forest.right, forest.value))

    once: dict = {}  # of a task

    def score(X: np.ndarray) -> np.ndarray:
        trees, *table, value = bc.value
        if not once:
            once["steps"] = _steps(*table)
        out = np.empty(len(X))
        for lo in range(0, len(X), CHUNK_ROWS):
            out[lo: lo + CHUNK_ROWS] = value[_route(X[lo: lo + CHUNK_ROWS], trees, once["steps"])].mean(axis=0)
        return out

    @pandas_udf("double")
    def _score(*xs: pd.Series) -> pd.Series:
        return pd.Series(score(np.column_stack([x.to_numpy(dtype=np.float64) for x in xs])))

    @pandas_udf("double")
    def _score_open(still: pd.Series, *xs: pd.Series) -> pd.Series:
        rows = np.flatnonzero(still.to_numpy(dtype=bool))
        X = np.column_stack([x.to_numpy(dtype=np.float64)[rows] for x in xs])
        return pd.Series(score(X), index=rows).reindex(range(len(still)))

    cols = [q(c) if isinstance(c, str) else c for c in cols or [q(f) for f in forest.features]]
    return _score(*cols) if only is None else _score_open(F.coalesce(only, F.lit(False)), *cols)
