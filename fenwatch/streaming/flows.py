"""Flow merges over event time, an extension for feeds that never end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_flows(flows: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """A stream of flows (src, dst, port, transport, packets, bytes, seen) merged by key and window; records later than `late` are dropped by the watermark, as state must end somewhere."""
    return flows.withWatermark("seen", late).groupBy(F.window("seen", window), "src", "dst", "port", "transport").agg(F.sum("packets").alias("packets"), F.sum("bytes").alias("bytes"), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"))


def idle_flows(packets: DataFrame, idle: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Packets (client, server, port, transport, length, ts) as flows that end where more than `idle` passes without a packet: over a stream a flow comes out once the watermark has passed its end, over a table all flows do."""
    rows = packets.withWatermark("ts", late) if packets.isStreaming else packets
    flows = rows.groupBy(F.session_window("ts", idle), F.col("client").alias("src_addr"), F.col("server").alias("dst_addr"), "port", "transport").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("length").cast("long")).alias("bytes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return flows.drop("session_window")
