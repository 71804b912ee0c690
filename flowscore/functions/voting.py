"""Vote expressions over per-member probability columns.

All arithmetic is written left to right over the members in their fixed
order, so the result is the same double in any engine that follows IEEE
rules (the SQL oracle uses the same order).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowscore.constants import MALICIOUS_MEAN_CUT, VOTE_CUT


def member_vote(p: Column) -> Column:
    """Hard vote of a binary member: class 1 only when p > 0.5 (a tie is class 0)."""
    return F.when(p > F.lit(VOTE_CUT), F.lit(1)).otherwise(F.lit(0)).cast("int")


def _sum(cols: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols)


def weighted_vote(votes: Sequence[Column], weights: Sequence[float]) -> Column:
    """VD = sum(vote * weight), accumulated from 0.0 like the reference."""
    return _sum([F.lit(0.0)] + [v.cast("double") * F.lit(float(w)) for v, w in zip(votes, weights)])


def hard_vote(votes: Sequence[Column]) -> Column:
    return _sum([F.lit(0.0)] + [v.cast("double") for v in votes])


def vote_threshold(vd: Column, max_vote_index: float) -> Column:
    """Binary verdict: VD >= MaxVoteIndex (inclusive)."""
    return F.when(vd >= F.lit(float(max_vote_index)), F.lit(1)).otherwise(F.lit(0)).cast("int")


def any_vote(votes: Sequence[Column]) -> Column:
    """Defensive rule: malicious as soon as one member flags the row."""
    return F.when(hard_vote(votes) > F.lit(0.0), F.lit(1)).otherwise(F.lit(0)).cast("int")


def mean_of(ps: Sequence[Column]) -> Column:
    return _sum(ps) / F.lit(float(len(ps)))


def std_pop_of(ps: Sequence[Column], mean: Column | None = None) -> Column:
    """Population standard deviation (ddof 0) of the row's probabilities."""
    m = mean_of(ps) if mean is None else mean
    return F.sqrt(_sum([(p - m) * (p - m) for p in ps]) / F.lit(float(len(ps))))


def three_label(mean: Column, std: Column, disagreement: float) -> Column:
    """1 Warning when members disagree (std >= threshold, checked first),
    else 2 Malicious when mean >= 0.5, else 0 Benign."""
    return (
        F.when(std >= F.lit(float(disagreement)), F.lit(1))
        .when(mean >= F.lit(MALICIOUS_MEAN_CUT), F.lit(2))
        .otherwise(F.lit(0))
        .cast("int")
    )


def defensive_three_label(binary: Column) -> Column:
    """DFDM never warns: 1 -> 2 Malicious, 0 -> 0 Benign."""
    return F.when(binary == F.lit(1), F.lit(2)).otherwise(F.lit(0)).cast("int")


def label3_text(code: Column) -> Column:
    return (
        F.when(code == 0, F.lit("Benign"))
        .when(code == 1, F.lit("Warning"))
        .when(code == 2, F.lit("Malicious"))
    )


def binary_text(code: Column) -> Column:
    return F.when(code == 0, F.lit("Benign")).when(code == 1, F.lit("Malicious"))
