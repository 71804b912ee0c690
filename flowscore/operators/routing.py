"""Mode routing by measured flow rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.functions.routing import select_mode
from flowscore.session import ensure_checkpoint_dir

RATE_ROW_BYTES = 64  # a window's row in a broadcast hash table, generously


def rate_table(df: DataFrame, ts_col: str, width: str) -> DataFrame:
    """(window_start, rate): rows per tumbling window. A hash aggregate with
    partial counts per task, so a hot window costs one row per task."""
    return df.groupBy(F.window(ts_col, width).start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("rate"))


def broadcast_limit(spark) -> int:
    """``spark.sql.autoBroadcastJoinThreshold`` in bytes (negative: never)."""
    return int(spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())


def rate_mode(df: DataFrame, ts_col: str, width: str, high: float, extreme: float) -> DataFrame:
    """Every row with the rate of its window and the mode that rate selects.

    The rate table has one row per window: it grows with the time span, not
    with the rows. It is materialised and counted first. Under the session's
    broadcast threshold it is broadcast, and the rows are joined where the scan
    leaves them, without a shuffle. Above it both sides are plain exchanges of
    stored rows, which AQE splits, so a window that holds most of the rows is
    dealt out to many tasks. Rows without a time have no window: they stay,
    with null rate and mode.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    timed, untimed = df.where(F.col(ts_col).isNotNull()), df.where(F.col(ts_col).isNull())
    rates = rate_table(timed, ts_col, width).checkpoint(eager=True)
    small = rates.count() * RATE_ROW_BYTES <= broadcast_limit(spark)
    keyed = timed.withColumn("window_start", F.window(ts_col, width).start)
    out = keyed.join(F.broadcast(rates) if small else rates, on="window_start", how="left")
    out = out.withColumn("mode", select_mode("rate", high, extreme))
    types = {f.name: f.dataType for f in out.schema}
    return out.unionByName(untimed.withColumns({c: F.lit(None).cast(types[c]) for c in ("window_start", "rate", "mode")}))


def routed(v: DataFrame, mode_col: str = "mode") -> DataFrame:
    """Row-wise routing over verdicts of all modes: pick the binary and
    three-label code of the row's own mode (null mode -> null)."""
    m = F.col(mode_col)

    def pick(prefix):
        return (F.when(m == "HAM", F.col(f"{prefix}_HAM")).when(m == "FDM", F.col(f"{prefix}_FDM"))
                .when(m == "DFDM", F.col(f"{prefix}_DFDM")))

    return v.withColumns({"pred_binary": pick("_bin"), "pred_3label": pick("_l3")})
