"""Inputs that Spark renders from the driver's tables in the formats of the field, and the operators over them: what devices answer, and streams of it."""

from __future__ import annotations

import uuid

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwatch.plans.graph import shared_folder
from fenwatch.sources import logs
from fenwatch.sources.captures import packet_flows, read_captures, reassemble_responses
from fenwatch.streaming.flows import idle_flows
from fenwatch.streaming.services import RESPONSES, reassembled, state_store


def _modbus(*objects: tuple[int, Column]) -> Column:
    """The bytes of a Modbus device identification with some objects (id, text)."""
    byte = lambda n: F.lpad(F.hex(n), 2, "0")
    each = F.concat(*(F.concat(F.lit(f"{i:02X}"), byte(F.octet_length(text)), F.hex(text)) for i, text in objects))
    unit = F.concat(F.lit("012B0E01810000" + f"{len(objects):02X}"), each)
    return F.unhex(F.concat(F.lit("00010000"), F.lpad(F.hex(F.length(unit) / 2), 4, "0"), unit))


def supplier_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A device for each supplier, in four packets: an identification cut in two, the same again, and one with another field."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    first, other = _modbus((0, F.col("s_name")), (1, F.col("s_suppkey").cast("string"))), _modbus((0, F.col("s_name")), (4, F.concat(F.lit("Nation "), "s_nationkey")))
    half = (F.length(first) / 2).cast("int")
    packets = [first.substr(F.lit(1), half), first.substr(half + 1, F.length(first)), first, other]
    parts = F.explode(F.array(*(F.struct(F.lit(k + 1).cast("long").alias("packet"), p.alias("payload")) for k, p in enumerate(packets))))
    out = rows.select(F.lit("c").alias("file"), F.concat(F.lit("10.0."), F.floor(F.col("s_suppkey") / 250), F.lit("."), F.col("s_suppkey") % 250).alias("server"), F.lit(502).alias("port"), F.lit("tcp").alias("transport"), parts.alias("p"))
    return out.select("file", "server", "port", "transport", "p.packet", F.timestamp_seconds(F.col("p.packet") + 1_000_000_000).alias("ts"), "p.payload")


def _told(found: DataFrame) -> DataFrame:
    return found.select("server", "packet", "verdict", "protocol", *(F.col("fields")[c].alias(c) for c in ("vendor_name", "product_code", "product_name")), F.col("identity")["vendor_raw"].alias("vendor"))


def decoded_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rendered devices tell, by the batch operator."""
    return _told(reassemble_responses(supplier_responses(spark, sf_dir)))


def _streamed(spark: SparkSession, made: list[DataFrame], schema: str, plan, restart: bool) -> DataFrame:
    """plan over a stream of tables, a trigger for each, as a table. With restart, the query ends after the first one and another one goes on from its checkpoint."""
    top = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    for k, df in enumerate(made):
        df.coalesce(1).write.mode("append").parquet(f"{top}/in")
        if restart or k == len(made) - 1:
            stream = plan(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{top}/in"))
            query = stream.writeStream.format("parquet").option("path", f"{top}/out").option("checkpointLocation", f"{top}/checkpoint").trigger(availableNow=True).start()
            query.awaitTermination()
    return spark.read.parquet(f"{top}/out")


def streamed_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over a stream that is stopped and restarted between each two packets, so that held bytes and known fields come from the checkpoint."""
    state_store(spark)
    every = supplier_responses(spark, sf_dir)
    return _told(_streamed(spark, [every.where(F.col("packet") == k) for k in (1, 2, 3, 4)], RESPONSES, reassembled, restart=True))


PACKETS = "client string, server string, port int, transport string, length long, ts timestamp"


def line_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A packet for each line item, on its day."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.select(F.concat(F.lit("c"), F.col("l_suppkey") % 40).alias("client"), F.concat(F.lit("s"), F.col("l_linenumber")).alias("server"), (F.lit(500) + F.col("l_partkey") % 3).cast("int").alias("port"), F.lower("l_linestatus").alias("transport"), F.col("l_quantity").cast("long").alias("length"), F.col("l_shipdate").cast("timestamp").alias("ts"))


def streamed_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of the packets that ended 20 days before the last packet or earlier, by a stream."""
    state_store(spark)
    return _streamed(spark, [line_packets(spark, sf_dir)], PACKETS, lambda s: idle_flows(s, "5 days", "20 days"), restart=False)


def rendered_files(lines: DataFrame, head: bytes, ending: str) -> str:
    """The folder with a file for each partition of lines (data: binary): the head, then all data. A task that runs anew writes its file anew."""
    top = f"{shared_folder(lines.sparkSession)}/rendered-{uuid.uuid4().hex}"
    store, at = pyarrow.fs.FileSystem.from_uri(top)
    store.create_dir(at)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = pyarrow.fs.FileSystem.from_uri(top)
        n = 0
        with store.open_output_stream(f"{at}/part-{TaskContext.get().partitionId()}{ending}") as out:
            out.write(head)
            for batch in batches:
                for data in batch.column("data").to_pylist():
                    n += out.write(data)
        yield pa.RecordBatch.from_pydict({"n": [n]})

    lines.select("data").mapInArrow(write, "n long").agg(F.sum("n")).collect()
    return top


#: Bytes of a rendered file to a task, so that files are cut at the smallest scale, too.
CUT = 1 << 18
# The head of a capture of Ethernet frames, most significant byte first.
CAPTURE_HEAD = bytes.fromhex("a1b2c3d4" "00020004" "00000000" "00000000" "0000ffff" "00000001")


def _number(c: Column, size: int) -> Column:
    """A number in some bytes, the most significant first, as hexadecimal digits."""
    return F.lpad(F.hex(c.cast("long")), 2 * size, "0")


def captured_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A datagram for each line item as a record of a capture (data): from a host of its supplier to one of its part, in the second of its order's key."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    text = F.concat_ws("|", "l_linestatus", F.col("l_linenumber").cast("string"))
    size = F.octet_length(text)
    host = lambda net, c: F.concat(F.lit(net), _number(F.col(c) % 65_536, 2))
    datagram = F.concat(_number(40_000 + F.col("l_linenumber"), 2), _number(500 + F.col("l_partkey") % 3, 2), _number(size + 8, 2), F.lit("0000"), F.hex(text))
    packet = F.concat(F.lit("4500"), _number(size + 28, 2), F.lit("0001000040110000"), host("0A01", "l_suppkey"), host("0A02", "l_partkey"), datagram)
    frame = F.concat(F.lit("020000000002020000000001" "0800"), packet)
    record = F.concat(_number(F.lit(1_000_000_000) + F.col("l_orderkey"), 4), _number(F.col("l_linenumber"), 4), _number(size + 42, 4), _number(size + 42, 4), frame)
    return rows.select(F.unhex(record).alias("data"))


def capture_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flows of rendered captures, read by ranges."""
    return packet_flows(read_captures(spark, rendered_files(captured_lines(spark, sf_dir), CAPTURE_HEAD, ".pcap"), size=CUT))


def capture_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers of the packets of rendered captures within a span of time, counted by what they say."""
    found = read_captures(spark, rendered_files(captured_lines(spark, sf_dir), CAPTURE_HEAD, ".pcap"), size=CUT, since=1_000_000_100, until=1_000_010_000)
    return found.groupBy(F.decode("payload", "UTF-8").alias("said"), "src_port", "dst_port", "transport", "link", "src_mac").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("length").cast("long")).alias("bytes"), F.min("ts").alias("first_seen"))


# How a log of connections begins.
LOG_HEAD = "#separator \\x09\n#set_separator\t,\n#empty_field\t(empty)\n#unset_field\t-\n#path\tconn\n#fields\tts\tuid\tid.orig_h\tid.orig_p\tid.resp_h\tid.resp_p\tproto\tservice\tconn_state\torig_pkts\torig_ip_bytes\tresp_pkts\tresp_ip_bytes\n"


def logged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A connection for each order as a line of a log (data); some bring the log's head again."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    host = lambda net, c: F.concat(F.lit(net), (F.floor(F.col(c) / 250) % 250).cast("string"), F.lit("."), (F.col(c) % 250).cast("string"))
    count = F.col("o_custkey") % 7 + 1
    line = F.concat_ws("\t", (F.lit(1_000_000_000) + F.col("o_orderkey")).cast("string"), F.concat(F.lit("C"), "o_orderkey"), host("10.1.", "o_custkey"), F.lit("5000"), host("10.2.", "o_orderkey"), (500 + F.col("o_orderkey") % 3).cast("string"), F.lit("tcp"), F.lit("-"), F.when(F.col("o_orderstatus") == "F", "S0").otherwise("SF"), count.cast("string"), (count * 100).cast("string"), F.when(F.col("o_orderstatus") == "F", "-").otherwise("2"), F.lit("-"))
    return rows.select(F.concat(F.when(F.col("o_orderkey") % 100 == 0, LOG_HEAD).otherwise(""), line, F.lit("\n")).cast("binary").alias("data"))


def logged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the rendered logs, read by ranges."""
    found = logs.read_zeek(spark, rendered_files(logged_lines(spark, sf_dir), LOG_HEAD.encode(), ".log"), size=CUT)
    field = lambda c: F.col("record")[c]
    return found.select(field("uid").alias("uid"), "ts", field("id.orig_h").alias("orig"), field("id.resp_h").alias("resp"), logs.whole(field("id.resp_p")).alias("port"), field("conn_state").alias("state"), logs.whole(field("orig_pkts")).alias("sent"), logs.whole(field("resp_pkts")).alias("answered"), "warning")


CAPTURED_FLOWS = """
WITH p AS (SELECT *, length(l_linestatus || '|' || CAST(l_linenumber AS varchar)) + 42 AS size, make_timestamp((1000000000 + l_orderkey) * 1000000 + l_linenumber) AS ts,
  '10.1.' || CAST(l_suppkey % 65536 // 256 AS varchar) || '.' || CAST(l_suppkey % 256 AS varchar) AS src, '10.2.' || CAST(l_partkey % 65536 // 256 AS varchar) || '.' || CAST(l_partkey % 256 AS varchar) AS dst FROM lineitem)
SELECT src AS src_addr, dst AS dst_addr, CAST(500 + l_partkey % 3 AS int) AS port, 'udp' AS transport, count(*) AS packets, CAST(sum(size) AS bigint) AS bytes, min(ts) AS first_seen, max(ts) AS last_seen, CASE WHEN l_partkey % 3 = 2 THEN 'modbus' END AS protocol
FROM p GROUP BY src, dst, l_partkey % 3"""
CAPTURED_PACKETS = """
WITH p AS (SELECT *, l_linestatus || '|' || CAST(l_linenumber AS varchar) AS said, make_timestamp((1000000000 + l_orderkey) * 1000000 + l_linenumber) AS ts FROM lineitem WHERE l_orderkey >= 100 AND l_orderkey < 10000)
SELECT said, CAST(40000 + l_linenumber AS int) AS src_port, CAST(500 + l_partkey % 3 AS int) AS dst_port, 'udp' AS transport, CAST(1 AS int) AS link, '02:00:00:00:00:01' AS src_mac, count(*) AS packets, CAST(sum(length(said) + 42) AS bigint) AS bytes, min(ts) AS first_seen
FROM p GROUP BY said, l_linenumber, l_partkey % 3"""
LOGGED_RECORDS = """
SELECT 'C' || CAST(o_orderkey AS varchar) AS uid, make_timestamp((1000000000 + o_orderkey) * 1000000) AS ts, '10.1.' || CAST(o_custkey // 250 % 250 AS varchar) || '.' || CAST(o_custkey % 250 AS varchar) AS orig,
  '10.2.' || CAST(o_orderkey // 250 % 250 AS varchar) || '.' || CAST(o_orderkey % 250 AS varchar) AS resp, CAST(500 + o_orderkey % 3 AS bigint) AS port, CASE WHEN o_orderstatus = 'F' THEN 'S0' ELSE 'SF' END AS state,
  CAST(o_custkey % 7 + 1 AS bigint) AS sent, CASE WHEN o_orderstatus <> 'F' THEN CAST(2 AS bigint) END AS answered, CAST(NULL AS varchar) AS warning
FROM orders"""
RESPONSES_TOLD = """
SELECT '10.0.' || CAST(s_suppkey // 250 AS varchar) || '.' || CAST(s_suppkey % 250 AS varchar) AS server, CAST(packet AS bigint) AS packet, 'decoded' AS verdict, 'modbus' AS protocol, s_name AS vendor_name,
  CASE WHEN packet = 2 THEN CAST(s_suppkey AS varchar) END AS product_code, CASE WHEN packet = 4 THEN 'Nation ' || CAST(s_nationkey AS varchar) END AS product_name, s_name AS vendor
FROM supplier, (VALUES (2), (4)) p(packet)"""
ENDED_FLOWS = """
WITH p AS (SELECT 'c' || CAST(l_suppkey % 40 AS varchar) AS client, 's' || CAST(l_linenumber AS varchar) AS server, CAST(500 + l_partkey % 3 AS int) AS port, lower(l_linestatus) AS transport, CAST(l_quantity AS bigint) AS length, CAST(l_shipdate AS timestamp) AS ts FROM lineitem),
b AS (SELECT *, CASE WHEN ts > lag(ts) OVER w + INTERVAL 5 DAY THEN 1 ELSE 0 END AS new FROM p WINDOW w AS (PARTITION BY client, server, port, transport ORDER BY ts)),
n AS (SELECT *, sum(new) OVER (PARTITION BY client, server, port, transport ORDER BY ts) AS k FROM b)
SELECT client AS src_addr, server AS dst_addr, port, transport, count(*) AS packets, CAST(sum(length) AS bigint) AS bytes, min(ts) AS first_seen, max(ts) AS last_seen
FROM n GROUP BY client, server, port, transport, k HAVING max(ts) + INTERVAL 5 DAY <= (SELECT max(ts) - INTERVAL 20 DAY FROM p)"""
