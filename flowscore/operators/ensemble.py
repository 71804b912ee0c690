"""Fit a whole ensemble bundle on Spark and derive voter weights from data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.functions import sqltext as ST
from flowscore.operators import members as MEM
from flowscore.operators.extra_trees import fit_extra_trees, forest_probability, save_forest
from flowscore.operators.fitting import class_weights as class_weights_of
from flowscore.operators.scoring import verdicts
from flowscore.sources.bundle import EnsembleBundle, Member, Voter, save_bundle


def member_accuracies(v: DataFrame, members: Sequence[str]) -> dict[str, float]:
    """Share of rows where each member's vote equals y (one aggregate)."""
    aggs = [F.expr("count(1)").alias("n")] + [F.expr(f"count_if(_v_{m} = _y)").alias(f"k_{m}") for m in members]
    r = v.agg(*aggs).first()
    return {m: (r[f"k_{m}"] / r["n"] if r["n"] else 0.0) for m in members}


def weighted_by_accuracy(bundle: EnsembleBundle, df: DataFrame) -> EnsembleBundle:
    """Each voter's weights = its members' accuracies on ``df``; the vote
    threshold = half the total weight."""
    v = verdicts(df, bundle)
    names = list(dict.fromkeys(bundle.ham.members + bundle.fdm.members))
    acc = member_accuracies(v, names)

    def voter(vt: Voter) -> Voter:
        w = {m: acc[m] for m in vt.members}
        return Voter(vt.name, vt.members, vt.features, w, None, vt.disagreement_threshold)

    return bundle.with_(fdm=voter(bundle.fdm), ham=voter(bundle.ham))


def summary(bundle: EnsembleBundle, spark) -> DataFrame:
    """(voter, member, weight, max_vote_index, disagreement_threshold, n_features)."""
    rows = [(vt.name, m, float(vt.weight(m)), float(vt.threshold), float(vt.disagreement_threshold),
             len(vt.features)) for vt in (bundle.fdm, bundle.ham) for m in vt.members]
    return spark.createDataFrame(rows, "voter string, member string, weight double, max_vote_index double, "
                                       "disagreement_threshold double, n_features int")


FDM_MEMBERS = ("AdaBoost", "Bagging", "GradientBoosting", "RandomForest")
HAM_MEMBERS = (*FDM_MEMBERS, "ExtraTrees")


def _fit_member(kind: str, rows: DataFrame, features: Sequence[str], label: str, estimators: int, max_depth: int | None, weight: str | None):
    """A fitted member: stumps, a pipeline or a forest. ``max_depth`` None: until leaves are pure (30 levels, Spark ML's most, for pipelines)."""
    if kind == "AdaBoost":
        return MEM.fit_adaboost(rows, features, label, rounds=estimators, weight_col=weight)
    if kind == "GradientBoosting":
        return MEM.fit_gbt(rows, features, label, max_iter=estimators, weight_col=weight)
    if kind == "ExtraTrees":
        return fit_extra_trees(rows, features, label, n_estimators=estimators, max_depth=max_depth, weight_col=weight)
    fit = MEM.fit_bagging if kind == "Bagging" else MEM.fit_random_forest
    return fit(rows, features, label, num_trees=estimators, max_depth=30 if max_depth is None else max_depth, weight_col=weight)


def _scored(kind: str, model, rows: DataFrame, out: str) -> DataFrame:
    if kind == "AdaBoost":
        return rows.withColumn(out, F.expr(MEM.adaboost_sql(model)).cast("double"))
    return rows.withColumn(out, forest_probability(model)) if kind == "ExtraTrees" else MEM.ml_probability(model, rows, out)


def fit_bundle(train: DataFrame, features: Sequence[str], directory: str, estimators: int = 100, max_depth: int | None = None, label: str = "y",
               *, ham_features: Sequence[str] | None = None, class_weights: bool = True, calibrate: str | None = "isotonic", folds: int = 5,
               key: str | None = None) -> EnsembleBundle:
    """Fit both voters on ``train`` (cleaned features + y) and save their members next to the bundle JSON.

    Each voter has members of its own, fitted on its own features: FDM on
    ``features``, HAM (with extra trees besides) on ``ham_features``.
    ``class_weights``: rows weigh n / (2 n_class), so both classes count alike.
    ``calibrate`` ("isotonic", "sigmoid" or None): a member's probability for
    the three-label path is its score mapped by a curve fitted on out-of-fold
    scores (``folds`` folds by a hash of ``key``, by default of all features),
    so no row is calibrated by a model that has seen it; votes use raw scores.
    Members weigh 1 until ``weighted_by_accuracy``."""
    spark = train.sparkSession
    ham_features = list(ham_features or features)
    names = list(dict.fromkeys([*features, *ham_features]))
    rows = train.select(*[F.expr(ST.ident(f)) for f in names], F.col(label).cast("int").alias(label),
                        (F.col(key).cast("string") if key else F.to_json(F.array(*[F.expr(ST.ident(f)).cast("string") for f in names]))).alias("__key"))
    weight = None
    if class_weights:
        w = {r["class"]: r["weight"] for r in class_weights_of(rows, label).collect()}
        rows = rows.withColumn("__weight", F.when(F.col(label) == 1, F.lit(w.get(1, 1.0))).otherwise(F.lit(w.get(0, 1.0))))
        weight = "__weight"
    rows = rows.persist()  # every fit reads them several times
    members: list[Member] = []

    def voter(name: str, kinds: Sequence[str], used: Sequence[str]) -> Voter:
        for kind in kinds:
            member, path = f"{name}_{kind}", f"{directory}/{name}_{kind}"
            model = _fit_member(kind, rows, used, label, estimators, max_depth, weight)
            given = {"expr": MEM.adaboost_sql(model)} if kind == "AdaBoost" else {"forest_path": path} if kind == "ExtraTrees" else {"model_path": path}
            if kind == "ExtraTrees":
                save_forest(spark, model, path)
            elif kind != "AdaBoost":
                model.write().overwrite().save(path)
            if calibrate:
                raw = given.get("expr") or f"_mlp_{member}"
                held = MEM.out_of_fold(rows, "__key", lambda r: _fit_member(kind, r, used, label, estimators, max_depth, weight),
                                       lambda m, r: _scored(kind, m, r, "__score").select("__score", label), folds)
                if calibrate == "isotonic":
                    given["calibrated_expr"] = MEM.isotonic_sql(raw, MEM.isotonic_blocks(held, "__score", label))
                else:
                    given["calibrated_expr"] = MEM.calibrated_sql(raw, *MEM.platt_calibration(held, "__score", label))
            members.append(Member(member, **given))
        return Voter(name, tuple(f"{name}_{k}" for k in kinds), tuple(used))

    try:
        fdm, ham = voter("FDM", FDM_MEMBERS, list(features)), voter("HAM", HAM_MEMBERS, ham_features)
    finally:
        rows.unpersist()
    return EnsembleBundle(members=tuple(members), fdm=fdm, ham=ham, label_col=None)


__all__ = ["fit_bundle", "weighted_by_accuracy", "summary", "member_accuracies", "save_bundle"]
