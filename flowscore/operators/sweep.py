"""Threshold sweeps: what every candidate threshold would give.

Rows are reduced to one row per distinct value by a grouped count (partial in
every task); the running counts over the values come from range totals, so any
number of distinct values, up to one per row, is swept exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowscore.operators.ranges import totals_before


def threshold_sweep(v: DataFrame, vd_col: str, y_col: str = "_y", num_partitions: int | None = None) -> DataFrame:
    """For each distinct value t of a score (vote data, or any other number):
    rows with a score >= t are predicted malicious; tp, fp, fn, tn and
    accuracy at that threshold. A null score is never predicted malicious and
    is no threshold; NaN is above all numbers."""
    g = v.groupBy(F.col(vd_col).alias("threshold")).agg(
        F.count_if(F.col(y_col) == 1).alias("pos"), F.count_if(F.col(y_col) == 0).alias("neg"))
    s = totals_before(g, "threshold", ["pos", "neg"], num_partitions).where(F.col("threshold").isNotNull())  # nulls sort first
    tp, fp = F.col("pos_total") - F.col("pos_before"), F.col("neg_total") - F.col("neg_before")
    return s.select("threshold", tp.alias("tp"), fp.alias("fp"), F.col("pos_before").alias("fn"), F.col("neg_before").alias("tn"),
                    ((tp + F.col("neg_before")).cast("double") / (F.col("pos_total") + F.col("neg_total")).cast("double")).alias("accuracy"))


# Fixed value: penalty per unit of warning rate (declared by the reference, never read there).
WARNING_PENALTY = 0.05


def disagreement_sweep(v: DataFrame, mode: str = "FDM", y_col: str = "_y", penalty: float = WARNING_PENALTY,
                       decimals: int | None = None, num_partitions: int | None = None) -> DataFrame:
    """Candidate disagreement thresholds t, each distinct std of the members
    (with ``decimals``: rounded to a grid). A row warns when its std >= t, as in
    scoring; for each t the number of confident rows, the warning rate, the
    accuracy of the confident rows (0 without any) and the score
    ``confident_accuracy - penalty * warning_rate``."""
    std: Column = F.col(f"_std_{mode}")
    pred = F.when(F.col(f"_mean_{mode}") >= 0.5, 1).otherwise(0)
    g = v.groupBy((std if decimals is None else F.bround(std, decimals)).alias("threshold")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(pred == F.col(y_col)).alias("ok"))
    s = totals_before(g, "threshold", ["n", "ok"], num_partitions)
    sure = F.col("n_before")
    right = F.when(sure > 0, F.col("ok_before").cast("double") / sure.cast("double")).otherwise(F.lit(0.0))
    warn = (F.col("n_total") - sure).cast("double") / F.col("n_total").cast("double")
    return s.select("threshold", sure.alias("n_confident"), F.bround(warn, 9).alias("warning_rate"),
                    F.bround(right, 9).alias("confident_accuracy"), F.bround(right - F.lit(penalty) * warn, 9).alias("score"))
