"""Consistency checks on raw flow records (the producer's invariants).

Per row: ``flow_id`` equals ``src-dst-sport-dport-proto``, ``duration``
equals ``end_time - start_time``, and the mean inter-arrival time equals
``duration / (packet_count - 1)`` for flows of two or more packets (within a
tolerance). A projection plus, for the report, one aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from flowscore.functions import sqltext as ST

COLS = {"flow_id": "flow_id", "src_ip": "src_ip", "dst_ip": "dst_ip", "src_port": "src_port",
        "dst_port": "dst_port", "protocol": "protocol", "start": "start_time", "end": "end_time",
        "duration": "duration", "packets": "packet_count", "iat": "Flow IAT Mean"}


def flow_checks(df: DataFrame, tol: float = 1e-6, cols: dict | None = None) -> DataFrame:
    c = {k: ST.ident(v) for k, v in {**COLS, **(cols or {})}.items()}
    key = (f"concat_ws('-', CAST({c['src_ip']} AS STRING), CAST({c['dst_ip']} AS STRING), "
           f"CAST({c['src_port']} AS STRING), CAST({c['dst_port']} AS STRING), CAST({c['protocol']} AS STRING))")
    return df.selectExpr(
        "*",
        f"{c['flow_id']} <=> {key} AS id_ok",
        f"abs({c['duration']} - ({c['end']} - {c['start']})) <= {tol!r} AS duration_ok",
        f"CASE WHEN {c['packets']} < 2 THEN NULL "
        f"ELSE abs({c['iat']} - {c['duration']} / CAST({c['packets']} - 1 AS DOUBLE)) <= {tol!r} END AS iat_ok",
    )


def consistency_report(checked: DataFrame) -> DataFrame:
    """Counts of rows failing each check (null = not applicable)."""
    return checked.selectExpr(
        "CAST(count(1) AS BIGINT) AS n",
        "CAST(count_if(NOT id_ok) AS BIGINT) AS bad_flow_id",
        "CAST(count_if(NOT duration_ok) AS BIGINT) AS bad_duration",
        "CAST(count_if(NOT iat_ok) AS BIGINT) AS bad_iat",
        "CAST(count_if(iat_ok IS NULL) AS BIGINT) AS iat_not_applicable",
    )
