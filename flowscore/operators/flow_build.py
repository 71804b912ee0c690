"""Flow records from packets: bidirectional 5-tuple sessions.

Packets of one conversation share protocol and both (address, port) ends,
whichever end sends. A conversation is cut into flows where no packet came for
``timeout`` seconds. The cut is the idle-burst numbering of the arrival
operator: conversations are dealt out in ranges of (conversation, time), so one
that holds a third of all packets is split over many tasks, and flows are then
one grouped aggregate with partial sums. The first packet's sender is the
flow's source; "forward" packets go its way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowscore.operators.arrival import number_arrivals


def build_flows(packets: DataFrame, timeout: float, order: str = "packet_id") -> DataFrame:
    """Flow rows from packets (``packet_id``, ``ts``, src/dst ip and port,
    ``protocol``, ``length``); ``order`` breaks ties of ``ts``.

    Result columns: flow_id (``src-dst-sport-dport-proto``), both ends,
    protocol, start_time and end_time (seconds since 1970 as doubles), duration,
    packet_count, fwd_packet_count, avg_packet_size, flow_iat_mean (0 for a flow
    of one packet), fwd_packet_length_max, fwd_packets_length_total. A null
    address or port is a value of its own; packets without a time never end a
    flow and count in it, but set no start or end."""
    near, far = (F.struct(F.col(f"{e}_ip").alias("ip"), F.col(f"{e}_port").alias("port")) for e in ("src", "dst"))
    up = F.to_json(near, {"ignoreNullFields": "false"}) <= F.to_json(far, {"ignoreNullFields": "false"})
    p = packets.select(order, "ts", "length", "protocol", up.alias("from_a"), F.when(up, near).otherwise(far).alias("a"),
                       F.when(up, far).otherwise(near).alias("b"))
    p = p.select(order, "ts", "length", "protocol", "from_a", *[F.col(f"{e}.{c}").alias(f"{e}_{c}") for e in "ab" for c in ("ip", "port")])
    key = ["a_ip", "a_port", "b_ip", "b_port", "protocol"]
    n = number_arrivals(p, ["ts", order], key_cols=key, gap_seconds=timeout, ts_col="ts")
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    flows = n.groupBy(*key, "burst").agg(
        F.min_by("from_a", "arrival_pos").alias("from_a"), F.min(at).alias("start_time"), F.max(at).alias("end_time"),
        F.count(F.lit(1)).alias("packet_count"), F.sum("length").alias("bytes"),
        *[F.count_if(F.col("from_a") == s).alias(f"n_{s}") for s in (True, False)],
        *[F.max(F.when(F.col("from_a") == s, F.col("length"))).alias(f"max_{s}") for s in (True, False)],
        *[F.sum(F.when(F.col("from_a") == s, F.col("length"))).alias(f"sum_{s}") for s in (True, False)])

    def way(a, b):
        return F.when(F.col("from_a"), F.col(a)).otherwise(F.col(b))

    f = flows.select(
        way("a_ip", "b_ip").alias("src_ip"), way("b_ip", "a_ip").alias("dst_ip"), way("a_port", "b_port").alias("src_port"),
        way("b_port", "a_port").alias("dst_port"), "protocol", "start_time", "end_time", (F.col("end_time") - F.col("start_time")).alias("duration"),
        "packet_count", way("n_True", "n_False").alias("fwd_packet_count"),
        (F.col("bytes").cast("double") / F.col("packet_count")).alias("avg_packet_size"),
        way("max_True", "max_False").cast("double").alias("fwd_packet_length_max"),
        way("sum_True", "sum_False").cast("double").alias("fwd_packets_length_total"))
    iat = F.when(F.col("packet_count") > 1, F.col("duration") / (F.col("packet_count") - 1)).otherwise(0.0)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("src_ip", "dst_ip", "src_port", "dst_port", "protocol")]
    return f.select(F.concat_ws("-", *parts).alias("flow_id"), "*", iat.alias("flow_iat_mean"))
