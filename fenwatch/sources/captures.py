"""Packet captures: classic pcap, of which each range is read by any task, and pcapng or gzipped ones, read in sequence."""

from __future__ import annotations

import gzip
import io
import socket
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from fenwatch.functions import tables as L
from fenwatch.operators.network import is_symmetric, server_of
from fenwatch.sources.decoders import BY_PORT, DECODED, DECODED_TYPES, Observation, as_row, decode
from fenwatch.sources.ranges import RANGE, RangeReader, file_ranges, indexed, opened

PACKETS = (
    "file string, packet long, ts timestamp, link int, length int, src_mac string, dst_mac string, src string, dst string, transport string, src_port int, dst_port int, syn boolean, ack boolean, payload binary,"
    " lldp_name string, lldp_description string, lldp_port string, lldp_forwards boolean, warning string"
)
#: Bytes that a service's reassembly holds, and that one attempt decodes.
HELD, TRIED = 1 << 16, 1 << 14


# First bytes of captures, with the order of their numbers and the length of a tick.
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\xc3\xd4": (">", 1e-6), b"\x4d\x3c\xb2\xa1": ("<", 1e-9), b"\xa1\xb2\x3c\x4d": (">", 1e-9)}
#: Bytes of a capture's head, and of a packet's.
HEAD, PACKET_HEAD = 24, 16


def packets(stream) -> Iterator[tuple[float, int, int, bytes]]:
    """(time, link, original length, bytes) of each packet; a truncated file gives what it has, and then ends with EOFError."""
    head = stream.read(4)
    if head == b"\x0a\x0d\x0d\x0a":
        yield from _blocks(stream, head)
        return
    if head not in MAGIC:
        raise ValueError("not a packet capture")
    order, tick = MAGIC[head]
    link = struct.unpack(f"{order}I", stream.read(20)[16:20])[0]
    yield from _records(stream, order, tick, link)


def _records(stream, order: str, tick: float, link: int, room: int | None = None) -> Iterator[tuple[float, int, int, bytes]]:
    """Packets from where a stream stands, those that start within `room` bytes."""
    at = 0
    while (room is None or at < room) and (h := stream.read(PACKET_HEAD)):
        if len(h) < PACKET_HEAD:
            raise EOFError
        seconds, part, kept, length = struct.unpack(f"{order}IIII", h)
        if len(data := stream.read(kept)) < kept:
            raise EOFError
        yield seconds + part * tick, link, length, data
        at += PACKET_HEAD + kept


def _blocks(stream, kind: bytes) -> Iterator[tuple[float, int, int, bytes]]:
    order, links, units = "<", [], []
    while len(kind) == 4:
        raw = stream.read(4)
        if kind == b"\x0a\x0d\x0d\x0a":
            magic = stream.read(4)
            order, links, units = ("<" if magic == b"\x4d\x3c\x2b\x1a" else ">"), [], []
            size = struct.unpack(f"{order}I", raw)[0]
            stream.read(size - 12)
        else:
            if len(raw) < 4:
                raise EOFError
            size = struct.unpack(f"{order}I", raw)[0]
            body = stream.read(size - 8)
            if len(body) < size - 8:
                raise EOFError
            name = struct.unpack(f"{order}I", kind)[0]
            if name == 1:
                links.append(struct.unpack_from(f"{order}H", body)[0])
                unit, at = 1e-6, 8
                while at + 4 <= len(body) - 4:
                    code, n = struct.unpack_from(f"{order}HH", body, at)
                    if code == 9 and n:
                        unit = 2.0 ** -(body[at + 4] & 0x7F) if body[at + 4] & 0x80 else 10.0 ** -body[at + 4]
                    if code == 0:
                        break
                    at += 4 + n + -n % 4
                units.append(unit)
            elif name == 6:
                face, high, low, kept, length = struct.unpack_from(f"{order}IIIII", body)
                yield (high << 32 | low) * units[face], links[face], length, body[20 : 20 + kept]
        kind = stream.read(4)


def neighbour(data: bytes) -> dict:
    """Name, description, port and whether it forwards (bridge or router, enabled), of a device that announces itself over LLDP."""
    out, at = {}, 0
    texts = {4: "lldp_port", 5: "lldp_name", 6: "lldp_description"}
    while at + 2 <= len(data):
        head = struct.unpack_from(">H", data, at)[0]
        kind, size = head >> 9, head & 0x1FF
        value, at = data[at + 2 : at + 2 + size], at + 2 + size
        if kind == 0:
            break
        if kind in texts:
            out[texts[kind]] = " ".join(value.decode("utf-8", "replace").split())
        elif kind == 7 and len(value) >= 4:
            out["lldp_forwards"] = bool(value[3] & 0x14)
    return out


def layers(link: int, data: bytes) -> dict:
    """Addresses, ports, flags and payload of an Ethernet frame (or a bare IP packet); what is missing stays out."""
    out: dict = {}
    kind, at = 0x0800, 0
    if link == 1:
        if len(data) < 14:
            return out
        out |= {"dst_mac": data[:6].hex(":"), "src_mac": data[6:12].hex(":")}
        kind, at = struct.unpack_from(">H", data, 12)[0], 14
        while kind in (0x8100, 0x88A8) and len(data) >= at + 4:
            kind, at = struct.unpack_from(">H", data, at + 2)[0], at + 4
    elif data and data[0] >> 4 == 6:
        kind = 0x86DD
    if kind == 0x88CC:
        return out | {"transport": "lldp"} | neighbour(data[at:])
    if kind == 0x0806 and len(data) >= at + 28:
        return out | {"transport": "arp", "src_mac": data[at + 8 : at + 14].hex(":"), "src": socket.inet_ntoa(data[at + 14 : at + 18]), "dst": socket.inet_ntoa(data[at + 24 : at + 28])}
    if kind == 0x0800 and len(data) >= at + 20:
        size, total, proto = (data[at] & 15) * 4, struct.unpack_from(">H", data, at + 2)[0], data[at + 9]
        out |= {"src": socket.inet_ntoa(data[at + 12 : at + 16]), "dst": socket.inet_ntoa(data[at + 16 : at + 20])}
        first = struct.unpack_from(">H", data, at + 6)[0] & 0x1FFF == 0
        data, at = data[: at + total] if total else data, at + size
    elif kind == 0x86DD and len(data) >= at + 40:
        proto, first = data[at + 6], True
        out |= {"src": socket.inet_ntop(socket.AF_INET6, data[at + 8 : at + 24]), "dst": socket.inet_ntop(socket.AF_INET6, data[at + 24 : at + 40])}
        at += 40
    else:
        return out
    if first and proto == 6 and len(data) >= at + 20:
        ports, flags = struct.unpack_from(">HH", data, at), data[at + 13]
        out |= {"transport": "tcp", "src_port": ports[0], "dst_port": ports[1], "syn": bool(flags & 2), "ack": bool(flags & 16), "payload": data[at + (data[at + 12] >> 4) * 4 :]}
    elif first and proto == 17 and len(data) >= at + 8:
        ports = struct.unpack_from(">HH", data, at)
        out |= {"transport": "udp", "src_port": ports[0], "dst_port": ports[1], "syn": False, "ack": False, "payload": data[at + 8 :]}
    return out


def walked(stream, order: str, tick: float, at: int, stop: int, length: int) -> tuple[int, int, float | None, float | None]:
    """How many whole packets start from at to before stop, where the next one starts, and the least and greatest time; only heads are looked at."""
    n, low, high = 0, None, None
    stream.seek(at)
    while at < stop:
        h = stream.read(PACKET_HEAD)
        if len(h) < PACKET_HEAD:
            return n, length, low, high
        second, part, kept, _ = struct.unpack(f"{order}IIII", h)
        at += PACKET_HEAD + kept
        if at > length:
            return n, length, low, high
        ts = second + part * tick
        n, low, high = n + 1, ts if low is None else min(low, ts), ts if high is None else max(high, ts)
        stream.seek(kept, 1)
    return n, at, low, high


#: Bytes within which a packet's head is looked for, heads in a row that make one believed, and days that a capture may span.
WINDOW, BELIEVED, SPAN = 1 << 20, 4, 400


def _found_head(data: bytes, order: str, start: int, stop: int, length: int, near: int) -> int | None:
    """Where packets seem to start again in the bytes from `start` on. A guess: what comes before has the last word."""
    for first in range(min(len(data), stop - start)):
        at = first
        for _ in range(BELIEVED):
            if start + at == length or at + PACKET_HEAD > len(data):
                break
            second, _, kept, whole = struct.unpack_from(f"{order}IIII", data, at)
            if not 0 < kept <= min(whole, 1 << 18) or abs(second - near) > SPAN * 86_400 or start + at + PACKET_HEAD + kept > length:
                at = -1
                break
            at += PACKET_HEAD + kept
        if at > first:
            return start + first
    return None


INDEX = "file string, start long, stop long, first long, byte_order string, tick double, link long, low double, high double"


SKETCH = "file string, length long, start long, stop long, byte_order string, tick double, link long, guess long, n long, after long, low double, high double"


def _sketched(row: dict) -> dict:
    """What a range holds, if it starts where it seems to (guess, n, after, low, high), with the capture's head; no link: not a plain classic capture."""
    file, start, stop, length = (row[c] for c in ("file", "start", "stop", "length"))
    with opened(file) as raw:
        head = raw.read(HEAD + PACKET_HEAD)
        if head[:4] not in MAGIC or len(head) < HEAD + PACKET_HEAD:
            return row
        order, tick = MAGIC[head[:4]]
        link, near = struct.unpack_from(f"{order}II", head, 20)
        raw.seek(start)
        guess = HEAD if start == 0 else _found_head(raw.read(WINDOW), order, start, stop, length, near)
        out = row | {"byte_order": order, "tick": tick, "link": link, "guess": guess}
        return out if guess is None else out | dict(zip(("n", "after", "low", "high"), walked(io.BufferedReader(raw, 1 << 20), order, tick, guess, stop, length), strict=True))


def _settled(ranges: list[dict]) -> list[dict]:
    """A file's ranges with where each really starts and the number of its first packet: where a guess is not where the range before ends, the range is walked anew from there."""
    if ranges[0]["link"] is None:
        return [{"file": ranges[0]["file"], "first": 0}]  # in sequence
    out, at, first = [], HEAD, 0
    for r in ranges:
        if at >= r["stop"]:
            continue
        if r["guess"] != at:
            with opened(r["file"]) as raw:
                found = walked(io.BufferedReader(raw, 1 << 20), r["byte_order"], r["tick"], at, r["stop"], r["length"])
            r |= dict(zip(("n", "after", "low", "high"), found, strict=True))
        out.append(r | {"start": at, "first": first})
        at, first = r["after"], first + r["n"]
    return out


def index_captures(spark: SparkSession, path: str, size: int = RANGE) -> str:
    """The folder with an index of the captures under a path, for the format "pcap".

    Each range of a plain classic capture is walked by a task of its own from where packets seem to start in it. A guess
    that the ranges before do not confirm is walked anew by the task that numbers the file's packets, so the index is
    exact whatever payloads look like. Other files are one range each.
    """
    return indexed(file_ranges(spark, path, size), _sketched, SKETCH, _settled, INDEX)


class CaptureReader(RangeReader):
    """Ranges of captures."""

    shape = pa.schema(
        [("file", pa.string()), ("packet", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("link", pa.int32()), ("length", pa.int32()), *((c, pa.string()) for c in ("src_mac", "dst_mac", "src", "dst", "transport"))]
        + [("src_port", pa.int32()), ("dst_port", pa.int32()), ("syn", pa.bool_()), ("ack", pa.bool_()), ("payload", pa.binary())]
        + [(c, pa.string()) for c in ("lldp_name", "lldp_description", "lldp_port")]
        + [("lldp_forwards", pa.bool_()), ("warning", pa.string())]
    )

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        super().__init__(schema, options)
        self.most = int(options.get("most", 0))
        self.since, self.until = (float(options[c]) if c in options else None for c in ("since", "until"))

    def may_hold(self, row: dict) -> bool:
        if not super().may_hold(row) or (self.most and row.get("first", 0) > self.most):
            return False
        low, high = row.get("low"), row.get("high")
        if row["stop"] is None or (self.since is None and self.until is None):
            return True
        return low is not None and (self.since is None or self.since <= high) and (self.until is None or low < self.until)

    def timely(self, ts: float) -> bool:
        return (self.since is None or ts >= self.since) and (self.until is None or ts < self.until)

    def rows(self, row: dict) -> Iterator[list[dict]]:
        file, k = row["file"], row.get("first") or 0
        rows, size = [], 0
        with opened(file) as raw:
            if row["stop"] is None:
                sniff = raw.read(2)
                raw.seek(0)
                found = packets(gzip.GzipFile(fileobj=raw) if sniff == b"\x1f\x8b" else raw)
            else:
                raw.seek(row["start"])
                found = _records(io.BufferedReader(raw, 1 << 20), row["byte_order"], row["tick"], row["link"], row["stop"] - row["start"])
            try:
                for ts, link, length, data in found:
                    if self.most and k >= self.most:
                        rows.append({"file": file, "packet": k, "warning": f"stopped after {k} packets"})
                        break
                    if self.timely(ts):
                        rows.append({"file": file, "packet": k, "ts": round(ts * 1e6), "link": link, "length": length} | layers(link, data))
                        size += len(data)
                    k += 1
                    if size > 1 << 22:
                        yield rows
                        rows, size = [], 0
            except EOFError:
                rows.append({"file": file, "packet": k, "warning": "the capture ends early"})
            except (ValueError, struct.error, IndexError, OSError):
                rows.append({"file": file, "packet": k, "warning": "not a readable capture"})
            if self.since is not None or self.until is not None:
                rows = [r for r in rows if "ts" in r]
            if rows:
                yield rows


class Captures(DataSource):
    """spark.read.format("pcap"), once registered: packets with their layers.

    Options: index (a folder of index_captures), most (packets of a file, 0 for all), range (bytes to a task), file (only
    that one), since and until (seconds since the epoch: packets from since to before until, and no warnings).
    """

    @classmethod
    def name(cls) -> str:
        return "pcap"

    def schema(self) -> str:
        return PACKETS

    def reader(self, schema: StructType) -> CaptureReader:
        return CaptureReader(schema, self.options)


def read_captures(spark: SparkSession, path: str, most: int = 0, size: int = RANGE, **options: float | str) -> DataFrame:
    """All packets of the captures under a path with their layers; most: packets of a file to read, 0 for all; size: bytes of a capture to a task; others are the format's options.

    A file that is no capture, is truncated, or has more packets than `most`, adds a row with only file, packet (how
    many were read) and warning; an empty file adds none.
    """
    spark.dataSource.register(Captures)
    return spark.read.format("pcap").options(index=index_captures(spark, path, size), most=most, range=size, **options).load(path)


def usable_ip(c: Column) -> Column:
    """Whether an address can name one device: neither unspecified, nor a group's, nor the broadcast."""
    part = "(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    four = c.rlike(f"^{part}([.]{part}){{3}}$") & ~c.isin("0.0.0.0", "255.255.255.255") & ~F.split_part(c, F.lit("."), F.lit(1)).try_cast("int").between(224, 239)
    six = c.rlike("^[0-9a-fA-F]*:[0-9a-fA-F:.]+$") & (c != "::") & ~F.lower(c).startswith("ff")
    return F.coalesce(four | six, F.lit(False))


def usable_mac(c: Column) -> Column:
    """Whether a hardware address is one device's: not a group's, and not zero."""
    return F.coalesce(c.rlike("(?i)^[0-9a-f][02468ace](:[0-9a-f]{2}){5}$") & (c != "00:00:00:00:00:00"), F.lit(False))


def protocol_of(port: Column) -> Column:
    """A known port's protocol."""
    return F.create_map(*(F.lit(v) for p, _, name, _ in L.PORTS for v in (p, name)))[port]


def sided(found: DataFrame) -> DataFrame:
    """Packets over TCP and UDP with client, server, port, from_server and symmetric."""
    rows = found.where("transport IN ('tcp', 'udp')").withColumn("to", F.expr(f"({server_of()}) = 'dst'")).withColumn("symmetric", F.expr(is_symmetric()))
    pick = lambda a, b: F.when(F.col("to"), F.col(a)).otherwise(F.col(b))
    return rows.select("file", "packet", "ts", "length", "transport", "payload", "syn", "ack", "src", "src_port", pick("src", "dst").alias("client"), pick("dst", "src").alias("server"), pick("dst_port", "src_port").alias("port"), (~F.col("to")).alias("from_server"), "symmetric")


def packet_flows(found: DataFrame) -> DataFrame:
    """Packets as flows (src_addr, dst_addr, port, transport, protocol, packets, bytes, first_seen, last_seen) from clients to servers, both with usable addresses."""
    rows = sided(found).where(usable_ip(F.col("client")) & usable_ip(F.col("server")))
    flows = rows.groupBy(F.col("client").alias("src_addr"), F.col("server").alias("dst_addr"), "port", "transport").agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("length").cast("long")).alias("bytes"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return flows.withColumn("protocol", protocol_of(F.col("port")))


def responses(found: DataFrame) -> DataFrame:
    """Payloads that listeners sent (file, server, port, transport, packet, ts, payload); where both ends listen, the sender counts."""
    rows = sided(found).where("length(payload) > 0 AND (from_server OR symmetric)")
    who = F.when(F.col("symmetric"), F.col("src")).otherwise(F.col("server"))
    port = F.when(F.col("symmetric"), F.col("src_port")).otherwise(F.col("port"))
    return rows.select("file", who.alias("server"), port.alias("port"), "transport", "packet", "ts", "payload").where(usable_ip(F.col("server")))


def http_banners(found: DataFrame) -> DataFrame:
    """Servers' names of plain HTTP responses (server, port, transport, banner, seen), from the header of the first 4096 bytes."""
    head = F.substring_index(F.decode(F.substring("payload", 1, 4096), "ISO-8859-1"), "\r\n\r\n", 1)
    name = F.trim(F.regexp_replace(F.regexp_extract(head, r"(?i)\r\n[ \t]*server[ \t]*:([^\r\n]*)", 1), r"\s+", " "))
    return responses(found).where(F.substring("payload", 1, 7) == F.lit("HTTP/1.").cast("binary")).select("server", "port", "transport", name.alias("banner"), F.col("ts").alias("seen")).where("banner <> ''")


def open_ports(found: DataFrame, decoded: DataFrame | None = None) -> DataFrame:
    """Services (addr, port, transport, protocol, banner, first_seen, last_seen) of listeners that answered: a handshake's answer, a payload, a datagram, or a decoded response."""
    rows = sided(found)
    answered = rows.where("from_server AND (length(payload) > 0 OR transport = 'udp' OR (syn AND ack))").select(F.col("server").alias("addr"), "port", "transport", F.col("ts").alias("seen"))
    both = rows.where("symmetric AND length(payload) > 0").select(F.col("src").alias("addr"), F.col("src_port").alias("port"), "transport", F.col("ts").alias("seen"))
    plain = answered.unionByName(both).where(usable_ip(F.col("addr"))).withColumn("protocol", F.lit(None).cast("string")).withColumn("banner", F.lit(None).cast("string"))
    told = http_banners(found).select(F.col("server").alias("addr"), "port", "transport", "seen", F.lit("http").alias("protocol"), "banner")
    if decoded is not None:
        told = told.unionByName(decoded.where("protocol IS NOT NULL").select(F.col("server").alias("addr"), "port", "transport", F.col("ts").alias("seen"), "protocol", F.lit(None).cast("string").alias("banner")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seen"))).alias(c)
    merged = plain.unionByName(told).groupBy("addr", "port", "transport").agg(first("protocol"), first("banner"), F.min("seen").alias("first_seen"), F.max(F.when(F.col("protocol").isNotNull(), F.col("seen"))).alias("told"))
    return merged.select("addr", "port", "transport", F.coalesce("protocol", protocol_of(F.col("port"))).alias("protocol"), "banner", "first_seen", F.greatest("first_seen", "told").alias("last_seen"))


def bindings(found: DataFrame) -> DataFrame:
    """Which hardware address is whose (file, ip, mac), by capture: announced ones first, then those seen in frames; an address with several partners of a kind is a router's and is left out."""
    rows = found.where("src_mac IS NOT NULL AND src IS NOT NULL").select("file", F.when(F.col("transport") == "arp", 0).otherwise(1).alias("kind"), F.col("src_mac").alias("mac"), F.col("src").alias("ip")).where(usable_mac(F.col("mac")))
    own = rows.groupBy("file", "kind", "mac").agg(F.min("ip").alias("ip"), F.max("ip").alias("last")).where((F.col("ip") == F.col("last")) & usable_ip(F.col("ip")))
    one = own.groupBy("file", "mac").agg(F.min_by("ip", "kind").alias("ip"), F.min("kind").alias("kind"))
    return one.groupBy("file", "ip").agg(F.min_by("mac", F.struct("kind", "mac")).alias("mac"))


def announcements(found: DataFrame) -> DataFrame:
    """Devices that announced their address over ARP (file, ip, mac, seen), where the binding agrees."""
    said = found.where("transport = 'arp'").groupBy("file", F.col("src").alias("ip"), F.col("src_mac").alias("mac")).agg(F.min("ts").alias("seen"))
    return said.join(bindings(found), ["file", "ip", "mac"])


def neighbours(found: DataFrame) -> DataFrame:
    """Devices that announced themselves over LLDP (file, mac, ip, name, description, port, role, seen)."""
    said = found.where("transport = 'lldp'").where(usable_mac(F.col("src_mac")))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("packet"))).alias(c)
    one = said.groupBy("file", F.col("src_mac").alias("mac")).agg(last("lldp_name"), last("lldp_description"), last("lldp_port"), F.bool_or("lldp_forwards").alias("forwards"), F.min("ts").alias("seen"))
    named = bindings(found).groupBy("file", "mac").agg(F.min("ip").alias("ip"))
    return one.join(named, ["file", "mac"], "left").select("file", "mac", "ip", F.col("lldp_name").alias("name"), F.col("lldp_description").alias("description"), F.col("lldp_port").alias("port"), F.when(F.col("forwards"), "network-device").alias("role"), "seen")


#: Stands for an identity among the names of fields that a service has shown.
IDENTIFIED = ""


def taken(held: bytes, payload: bytes, port: int) -> tuple[bytes, str, Observation | None]:
    """What a service holds once a payload has come, the verdict on it, and an observation if it gives one."""
    held = (held + payload)[:TRIED]
    verdict, seen = decode(held, port, further=True)
    return (held, verdict, None) if verdict == "truncated" and len(held) < HELD else (b"", verdict, seen)


def names_of(seen: Observation) -> set[str]:
    return {*seen.fields, *([IDENTIFIED] if seen.identity else [])}


def reassemble(found: DataFrame) -> DataFrame:
    """What services in captured packets told, as reassemble_responses gives it."""
    return reassemble_responses(responses(found))


def reassemble_responses(rows: DataFrame) -> DataFrame:
    """Decoded responses per service (file, server, port, transport): payloads are joined in packet order while a decoder calls them truncated and they stay within HELD bytes. by_content: the port is not the protocol's.

    An observation is kept if it brings a field's name that the service had not shown, or its first identity. Streams a
    partition sorted by service, holding one service's bytes and field names.
    """
    keys = ["file", "server", "port", "transport"]
    rows = rows.repartition(*keys).sortWithinPartitions(*keys, "packet")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, known = None, b"", set()
        schema = pa.schema([("file", pa.string()), ("server", pa.string()), ("port", pa.int32()), ("transport", pa.string()), ("packet", pa.int64()), ("ts", pa.timestamp("us", "UTC")), ("by_content", pa.bool_()), *DECODED_TYPES])
        for batch in batches:
            out = []
            for *key, packet, ts, payload in zip(*(batch.column(c).to_pylist() for c in [*keys, "packet", "ts", "payload"]), strict=True):
                if key != now:
                    now, held, known = key, b"", set()
                held, verdict, seen = taken(held, payload, key[2])
                if seen is None:
                    continue
                told = names_of(seen)
                if told <= known and known:
                    continue
                known |= told
                out.append(dict(zip(keys, key, strict=True)) | {"packet": packet, "ts": ts, "by_content": key[2] not in BY_PORT} | as_row(verdict, seen))
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return rows.mapInArrow(run, f"file string, server string, port int, transport string, packet long, ts timestamp, by_content boolean, {DECODED}")
