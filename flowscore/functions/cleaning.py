"""Cleaning expressions for feature and label columns.

Order matters and follows the reference: +/-inf becomes missing, categorical
columns are encoded, features are cast to double, missing (null or NaN)
becomes 0, and only then the scaler applies -- so a missing value ends up as
``(0 - mean) / scale``, not 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowscore.constants import BENIGN_LABEL

_INF = float("inf")


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean_inf(c: Column | str) -> Column:
    """+/-inf -> null; NaN and finite values pass through."""
    c = _c(c)
    return F.when(F.abs(c) == F.lit(_INF), F.lit(None)).otherwise(c)


def to_feature(c: Column | str) -> Column:
    """Cast to double. ANSI mode makes non-numeric text raise, like the reference."""
    return _c(c).cast("double")


def fill_missing(c: Column | str, value: float = 0.0) -> Column:
    """null or NaN -> ``value`` (Spark's isnan(null) is false, so test both)."""
    c = _c(c)
    return F.when(c.isNull() | F.isnan(c), F.lit(value)).otherwise(c)


def standard_scale(c: Column | str, mean: float, scale: float) -> Column:
    return (_c(c) - F.lit(float(mean))) / F.lit(float(scale))


def binarize_label(c: Column | str, benign: str = BENIGN_LABEL) -> Column:
    """Text label -> 0 for exactly ``benign`` (case-sensitive, untrimmed), else 1.

    A null label counts as malicious: the reference compares with ``!=`` and a
    missing value is never equal to the benign text.
    """
    return F.when(_c(c).eqNullSafe(F.lit(benign)), F.lit(0)).otherwise(F.lit(1)).cast("int")


def numeric_label(c: Column | str) -> Column:
    """Numeric label -> int by truncation toward zero; a null raises."""
    c = _c(c)
    return F.when(c.isNull(), F.raise_error(F.lit("label column holds a missing value"))).otherwise(
        c.cast("double").cast("int")
    ).cast("int")


def encode_categorical(c: Column | str, classes: Sequence[str]) -> Column:
    """Index of the string value in the sorted ``classes``; an unseen value
    takes the first class (code 0). A null string-casts to ``'nan'``.

    Up to a few thousand classes the mapping is a literal map (constant
    folded into the stage); larger vocabularies should go through
    :func:`flowscore.operators.prep.encode_with_table` (a join).
    """
    classes = sorted(str(v) for v in classes)
    as_text = F.coalesce(_c(c).cast("string"), F.lit("nan"))
    mapping = F.create_map(*[x for i, v in enumerate(classes) for x in (F.lit(v), F.lit(i))])
    return F.coalesce(F.try_element_at(mapping, as_text), F.lit(0)).cast("int")


def clean_features(cols: Mapping[str, Column]) -> dict[str, Column]:
    return {k: fill_missing(to_feature(clean_inf(v))) for k, v in cols.items()}
