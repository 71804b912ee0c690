"""Map the driver's tables onto the flow, job and telemetry schemas.

Each builder is a plain projection over one table (no shuffle), so it
scales with the scan and Catalyst prunes the columns it does not need.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from flowscore.sources.tables import read_table

FLOW_FEATURES = (
    "avg_packet_size",
    "flow_iat_mean",
    "fwd_packet_length_max",
    "fwd_packets_length_total",
    "init_bwd_win_bytes",
    "init_fwd_win_bytes",
)


def flows(spark: SparkSession, sf_dir: str, keep_order_key: bool = False) -> DataFrame:
    """Flow rows derived from ``lineitem`` (FIXTURES.md F3).

    The label is planted so that the members can learn it, and the
    dirty values (null, +inf, NaN) are placed by key. ``keep_order_key``
    adds ``order_key``: the job (order) the flow belongs to.
    """
    li = read_table(spark, sf_dir, "lineitem")
    cols = [
        "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), "
        "CAST(l_linenumber AS STRING)) AS flow_id",
        "CASE WHEN l_linestatus = 'F' THEN '6' ELSE '17' END AS protocol",
        "CASE WHEN l_orderkey % 17 = 0 THEN CAST(NULL AS DOUBLE) "
        "WHEN l_orderkey % 19 = 0 THEN CAST('Infinity' AS DOUBLE) "
        "WHEN l_orderkey % 23 = 0 THEN CAST('NaN' AS DOUBLE) "
        "ELSE l_extendedprice / l_quantity END AS avg_packet_size",
        "l_discount AS flow_iat_mean",
        "l_quantity AS fwd_packet_length_max",
        "l_extendedprice AS fwd_packets_length_total",
        "CASE WHEN l_linestatus = 'F' THEN l_partkey ELSE -1 END AS init_fwd_win_bytes",
        "CASE WHEN l_linestatus = 'F' THEN l_suppkey ELSE -1 END AS init_bwd_win_bytes",
        "CASE WHEN l_orderkey % 101 = 0 THEN CAST(NULL AS STRING) "
        "WHEN l_quantity >= 30 AND l_discount >= 0.05 THEN concat('DrDoS_', l_returnflag) "
        "ELSE 'Benign' END AS label",
        "l_shipdate AS seen_at",
    ]
    if keep_order_key:
        cols.append("l_orderkey AS order_key")
    return li.selectExpr(*cols)


def telemetry_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resource samples (FIXTURES.md F5) from ``events``."""
    ev = read_table(spark, sf_dir, "events")
    return ev.selectExpr(
        "event_type AS stage",
        "CAST(ts AS TIMESTAMP) AS ts",
        "value AS mem_mb",
        "CAST(user_id % 100 AS DOUBLE) AS cpu_pct",
        "CAST(event_id % 16 + 1 AS INT) AS threads",
    )


def path_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed prediction runs (path, run, elapsed_sec, n) from ``events``."""
    ev = read_table(spark, sf_dir, "events")
    return ev.selectExpr("event_type AS path", "event_id AS run", "value AS elapsed_sec",
                         "CAST(1000 AS BIGINT) AS n")


def job_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job requests (FIXTURES.md F4) from ``orders``."""
    o = read_table(spark, sf_dir, "orders")
    return o.selectExpr(
        "o_orderkey AS job_id",
        "CASE o_orderstatus WHEN 'F' THEN 'failed' WHEN 'O' THEN 'done' ELSE 'pending' END AS status",
        "CAST(CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 1000 WHEN 3 THEN 5000 ELSE 777 END "
        "AS INT) AS flow_rate",
        "CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'label' WHEN 2 THEN 'protocol' ELSE 'attack' END AS label_col",
        "CASE WHEN o_orderkey % 6 = 0 THEN '' WHEN o_orderkey % 4 = 2 THEN '6' ELSE 'Benign' END AS benign_label",
        "concat('flows_', CAST(o_orderkey AS STRING), "
        "CASE o_orderkey % 3 WHEN 0 THEN '.csv' WHEN 1 THEN '.CSV' ELSE '.txt' END) AS input_filename",
        "o_orderdate AS created_at",
        "concat('Traceback: ', repeat(o_orderpriority, 200)) AS error_text",
    )
