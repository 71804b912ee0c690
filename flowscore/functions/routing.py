"""Flow rate -> detection mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowscore.constants import FLOW_THRESHOLD_EXTREME, FLOW_THRESHOLD_HIGH


def select_mode(rate: Column | str, high: float = FLOW_THRESHOLD_HIGH,
                extreme: float = FLOW_THRESHOLD_EXTREME) -> Column:
    """rate >= extreme -> DFDM, >= high -> FDM, else HAM (bounds inclusive);
    a null rate gives null, which means "run every mode"."""
    r = F.col(rate) if isinstance(rate, str) else rate
    return (
        F.when(r.isNull(), F.lit(None).cast("string"))
        .when(r >= F.lit(extreme), F.lit("DFDM"))
        .when(r >= F.lit(high), F.lit("FDM"))
        .otherwise(F.lit("HAM"))
    )


def flow_to_mode(rate: Column | str) -> Column:
    """Hard-coded thresholds of the scoring entry point (1000 / 5000)."""
    return select_mode(rate, FLOW_THRESHOLD_HIGH, FLOW_THRESHOLD_EXTREME)


def mode_for_rate(rate: int | None, high: float = FLOW_THRESHOLD_HIGH,
                  extreme: float = FLOW_THRESHOLD_EXTREME) -> str | None:
    """Plan-time twin of :func:`select_mode` for a scalar rate."""
    if rate is None:
        return None
    if rate >= extreme:
        return "DFDM"
    if rate >= high:
        return "FDM"
    return "HAM"
