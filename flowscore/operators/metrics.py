"""Confusion-matrix and three-label metrics, per mode, overall or grouped.

All modes are counted in ONE aggregate over the verdict table (conditional
counts, partially aggregated in every task, so only one small row per task
and group is shuffled, whatever the skew of the grouping keys). The
per-mode rows are then produced by unpivoting that small result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscore.constants import EVAL_ORDER, MODES
from flowscore.functions import sqltext as ST
from flowscore.operators.prep import q

COUNT_FIELDS = (
    "n", "tp", "tn", "fp", "fn", "n_pred_malicious", "n_y0", "n_y1",
    "n_benign", "n_warning", "n_malicious", "ben_tp", "ben_fp", "mal_tp",
    "warn_actually_benign", "warn_actually_malicious", "n_confident", "n_confident_correct",
)


def _mode_aggs(mode: str, y: str) -> list[str]:
    b, l3 = f"_bin_{mode}", f"_l3_{mode}"
    exprs = {
        "n": "count(1)",
        "tp": f"count_if({y} = 1 AND {b} = 1)",
        "tn": f"count_if({y} = 0 AND {b} = 0)",
        "fp": f"count_if({y} = 0 AND {b} = 1)",
        "fn": f"count_if({y} = 1 AND {b} = 0)",
        "n_pred_malicious": f"count_if({b} = 1)",
        "n_y0": f"count_if({y} = 0)",
        "n_y1": f"count_if({y} = 1)",
        "n_benign": f"count_if({l3} = 0)",
        "n_warning": f"count_if({l3} = 1)",
        "n_malicious": f"count_if({l3} = 2)",
        "ben_tp": f"count_if({y} = 0 AND {l3} = 0)",
        "ben_fp": f"count_if({y} = 1 AND {l3} = 0)",
        "mal_tp": f"count_if({y} = 1 AND {l3} = 2)",
        "warn_actually_benign": f"count_if({y} = 0 AND {l3} = 1)",
        "warn_actually_malicious": f"count_if({y} = 1 AND {l3} = 1)",
        "n_confident": f"count_if({l3} <> 1)",
        "n_confident_correct": f"count_if({l3} <> 1 AND {y} = CASE WHEN {l3} = 2 THEN 1 ELSE 0 END)",
    }
    return [f"CAST({exprs[k]} AS BIGINT) AS {k}__{mode}" for k in COUNT_FIELDS]


def mode_counts(v: DataFrame, modes: Sequence[str] = MODES, group_cols: Sequence[str] = (),
                rollup: bool = False, y: str = "_y", fields: Sequence[str] = COUNT_FIELDS) -> DataFrame:
    """Long table: group columns, ``mode`` and the requested counts
    (``fields``, default all of COUNT_FIELDS).

    With ``rollup`` the groups are a ROLLUP over ``group_cols`` and a
    ``grouping_level`` column (Spark's grouping_id) tells subtotals apart.
    Only the requested counters are aggregated (a ROLLUP multiplies every
    aggregate by the number of grouping sets).
    """
    fields = [k for k in COUNT_FIELDS if k in set(fields)]
    src = v if y in v.columns else v.withColumn(y, F.lit(None).cast("int"))
    aggs = [F.expr(a) for m in modes for a in _mode_aggs(m, y) if a.rsplit(" AS ", 1)[1].split("__")[0] in fields]
    gcols = [q(c) for c in group_cols]
    if rollup:
        agg = src.rollup(*gcols).agg(
            *aggs, F.expr("CAST(grouping_id() AS INT)").alias("grouping_level"))
        keys = list(group_cols) + ["grouping_level"]
    elif group_cols:
        agg = src.groupBy(*gcols).agg(*aggs)
        keys = list(group_cols)
    else:
        agg = src.agg(*aggs)
        keys = []
    structs = ", ".join(
        "named_struct('mode', '" + m + "', " + ", ".join(f"'{k}', {k}__{m}" for k in fields) + ")"
        for m in modes)
    return agg.selectExpr(*[ST.ident(k) for k in keys], f"inline(array({structs}))")


def _r(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END"


BINARY_SQL = {
    "total": "tp + tn + fp + fn",
    "accuracy": _r("tp + tn", "tp + tn + fp + fn"),
    "precision": _r("tp", "tp + fp"),
    "sensitivity": _r("tp", "tp + fn"),
}
F1_SQL = ("CASE WHEN precision + sensitivity <> 0 THEN CAST(2.0 AS DOUBLE) * precision * sensitivity / "
          "(precision + sensitivity) ELSE CAST(0.0 AS DOUBLE) END")
THREE_SQL = {
    "confident_accuracy": _r("n_confident_correct", "n_confident"),
    "warning_rate": _r("n_warning", "n"),
    "benign_precision": "CAST(ben_tp AS DOUBLE) / CAST(greatest(n_benign, 1) AS DOUBLE)",
    "benign_recall": "CAST(ben_tp AS DOUBLE) / CAST(greatest(n_y0, 1) AS DOUBLE)",
    "malicious_precision": "CAST(mal_tp AS DOUBLE) / CAST(greatest(n_malicious, 1) AS DOUBLE)",
    "malicious_recall": "CAST(mal_tp AS DOUBLE) / CAST(greatest(n_y1, 1) AS DOUBLE)",
    "attacks_let_through": "ben_fp",
}


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def with_binary_metrics(c: DataFrame) -> DataFrame:
    """accuracy, precision, sensitivity, F1 -- each 0.0 when its denominator is 0."""
    c = c.selectExpr("*", *[f"{e} AS {k}" for k, e in BINARY_SQL.items()])
    return c.selectExpr("*", f"{F1_SQL} AS f1")


def with_three_label_metrics(c: DataFrame, which: Sequence[str] | None = None) -> DataFrame:
    """ConfidentAccuracy, WarningRate, benign/malicious precision & recall
    (denominators floored at 1) and AttacksLetThrough (true attacks labelled
    Benign; Warnings are not counted as misses). ``which`` limits the set."""
    keep = THREE_SQL if which is None else {k: THREE_SQL[k] for k in which}
    return c.selectExpr("*", *[f"{e} AS {k}" for k, e in keep.items()])


def mode_rank(order: Sequence[str]) -> str:
    return "CAST(CASE mode " + " ".join(f"WHEN '{m}' THEN {i + 1}" for i, m in enumerate(order)) + " END AS INT)"


def mode_comparison(v: DataFrame, labelled: bool | None = None, modes: Sequence[str] = MODES) -> DataFrame:
    """Comparison table, one row per mode of ``modes``, in HAM, FDM, DFDM order:
    Malicious% (2 dp), binary metrics (6 dp), and for HAM/FDM the confident
    accuracy (6 dp), warning rate % (3 dp) and attacks missed. Rounding is
    half-even like Python's ``round``. Metrics only for labelled input
    (detected from the ``_y`` column unless ``labelled`` is given)."""
    if labelled is None:
        labelled = "_y" in v.columns
    need = ["n", "n_pred_malicious", "tp", "tn", "fp", "fn", "n_warning", "ben_fp", "n_confident",
            "n_confident_correct"]
    c = with_three_label_metrics(with_binary_metrics(mode_counts(v, modes, fields=need)),
                                 ["confident_accuracy", "warning_rate", "attacks_let_through"])
    cols = ["mode", f"{mode_rank(MODES)} AS position",
            f"bround({_r('n_pred_malicious', 'n')} * CAST(100.0 AS DOUBLE), 2) AS malicious_pct"]
    if labelled:
        cols += [f"bround({k}, 6) AS {k}" for k in ("accuracy", "precision", "sensitivity", "f1")]
        cols += [
            "CASE WHEN mode <> 'DFDM' THEN bround(confident_accuracy, 6) END AS conf_acc",
            "CASE WHEN mode <> 'DFDM' THEN bround(warning_rate * CAST(100.0 AS DOUBLE), 3) END AS warn_rate_pct",
            "CASE WHEN mode <> 'DFDM' THEN attacks_let_through END AS attacks_missed",
        ]
    return c.selectExpr(*cols).orderBy("position")


def evaluate_all_modes(v: DataFrame) -> DataFrame:
    """Binary evaluation of every mode, in FDM, DFDM, HAM order."""
    c = with_binary_metrics(mode_counts(v, EVAL_ORDER, fields=["tp", "tn", "fp", "fn"]))
    return c.selectExpr("mode", f"{mode_rank(EVAL_ORDER)} AS position", "accuracy", "precision", "sensitivity",
                        "f1", "tp", "tn", "fp", "fn").orderBy("position")


def mode_summary(v: DataFrame) -> DataFrame:
    """Per-mode run summary: rows, malicious count and share, three-label
    counts and warning rate (three-label columns are null for DFDM, which
    has no warning zone)."""
    c = mode_counts(v, MODES, fields=["n", "n_pred_malicious", "n_benign", "n_warning", "n_malicious"])
    nd = "mode <> 'DFDM'"
    return c.selectExpr(
        "mode", f"{mode_rank(MODES)} AS position", "n",
        "n_pred_malicious AS n_malicious_binary",
        "n - n_pred_malicious AS n_benign_binary",
        f"bround({_r('n_pred_malicious', 'n')} * CAST(100.0 AS DOUBLE), 2) AS attack_pct",
        f"CASE WHEN {nd} THEN n_benign END AS n_benign_3l",
        f"CASE WHEN {nd} THEN n_warning END AS n_warning_3l",
        f"CASE WHEN {nd} THEN n_malicious END AS n_malicious_3l",
        f"CASE WHEN {nd} THEN bround({_r('n_warning', 'n')} * CAST(100.0 AS DOUBLE), 2) END AS warn_rate_pct",
    ).orderBy("position")
