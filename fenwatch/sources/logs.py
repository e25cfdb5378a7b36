"""Readers of Zeek logs and Nmap reports, and what they tell of devices, services and flows."""

from __future__ import annotations

import dataclasses
import gzip
import io
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource
from pyspark.sql.types import StructType

from fenwatch.functions.dialect import SPARK
from fenwatch.functions.text import mac_text
from fenwatch.operators.network import answered
from fenwatch.sources.captures import protocol_of, usable_ip, usable_mac
from fenwatch.sources.ranges import RANGE, RangeReader, file_ranges, indexed, opened
from fenwatch.sources.observations import FLOW, SERVICE, blank, observed, shaped, with_address

# Names of analyzers' logs, alone or before an underscore.
CONTROL_LOGS = ["modbus", "bacnet", "enip", "cip", "s7comm", "dnp3", "opcua", "profinet", "ethercat", "iec104", "genisys", "synchrophasor", "hart", "omron", "fins", "ge_srtp", "bsap", "tds", "ecat"]
# Fields of analyzers' logs by what they tell, in the order in which they are tried.
IDENTITY_FIELDS = {
    "vendor": ["vendor", "vendor_name"],
    "vendor_id": ["vendor_id"],
    "product": ["product_name", "model_name", "device_model", "module_type", "cpu_type"],
    "firmware": ["firmware_revision", "firmware_version", "application_software_version", "revision"],
    "serial": ["serial_number"],
    "catalog_number": ["module", "order_code"],
    "hardware": ["basic_hardware", "hardware_revision"],
    "device_type": ["device_type"],
    "system_name": ["object_name"],
    "plant": ["plant_identification"],
}
# What the facts above, and those of scan scripts, fill in an identity.
FILLS = {"vendor": "vendor_raw", "product": "product_raw", "firmware": "firmware_raw", "serial": "serial", "catalog_number": "catalog_number", "hardware": "hardware_rev"}
# Keys of scan scripts and what they tell.
SCRIPTS = {
    "s7-info": [("Module", "catalog_number"), ("Module Type", "product"), ("Version", "firmware"), ("Serial Number", "serial"), ("Basic Hardware", "basic_hardware"), ("System Name", "system_name"), ("Plant Identification", "plant_identification")],
    "enip-info": [("Vendor", "vendor"), ("Product Name", "product"), ("Revision", "firmware"), ("Serial Number", "serial"), ("Device Type", "device_type"), ("Product Code", "product_code")],
    "modbus-discover": [("Vendor", "vendor")],
    "bacnet-info": [("Vendor Name", "vendor"), ("Model Name", "product"), ("Firmware", "firmware"), ("Application Software", "firmware"), ("Serial Number", "serial"), ("Object Name", "system_name"), ("Instance Number", "device_instance")],
}
RECORDS = "file string, record_no long, kind string, record map<string,string>, warning string"


def file_kind(path: str) -> str:
    """A log's kind by its file name: what stands before the first dot."""
    return path.rsplit("/", 1)[-1].split(".")[0]


def epoch(c: Column) -> Column:
    """Seconds since the epoch, or a textual time; null if neither."""
    return F.coalesce(F.timestamp_micros((c.try_cast("double") * 1_000_000).cast("long")), F.try_to_timestamp(c))


def whole(c: Column) -> Column:
    """A number that may be written with a fraction, without it."""
    return c.try_cast("double").cast("long")


def flag(c: Column) -> Column:
    return F.when(F.lower(c).isin("t", "true"), True).when(F.lower(c).isin("f", "false"), False)


def _text(value: object) -> str:
    """A JSON scalar as logs spell it."""
    if isinstance(value, bool):
        return "T" if value else "F"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    return "" if value is None else str(value)


def _flat(value: dict, before: str = "") -> Iterator[tuple[str, str]]:
    """Nested objects as dotted names; arrays joined by commas."""
    for k, v in value.items():
        if isinstance(v, dict):
            yield from _flat(v, f"{before}{k}.")
        elif v is not None:
            yield before + k, ",".join(map(_text, v)) if isinstance(v, list) else _text(v)


@dataclasses.dataclass
class Directives:
    """How a log's lines are read from some line on."""

    kind: str
    sep: str = "\t"
    inner: str = ","
    unset: str = "-"
    empty: str = "(empty)"
    names: list[str] | None = None

    def take(self, line: str) -> None:
        name, _, value = line[1:].partition(" " if line.startswith("#separator") else self.sep)
        match name.strip():
            case "separator":
                self.sep = re.sub(r"^\\x([0-9a-fA-F]{2}).*$", lambda m: chr(int(m[1], 16)), value.strip()) or self.sep
            case "set_separator":
                self.inner = value
            case "unset_field":
                self.unset = value
            case "empty_field":
                self.empty = value
            case "path":
                self.kind = value or self.kind
            case "fields":
                self.names = value.split(self.sep)


def log_records(lines: Iterator[str], now: Directives, first: int = 1) -> Iterator[tuple[int, str, dict[str, str] | None, str | None]]:
    """(line number, kind, record, warning) of a log, tab-separated or of JSON lines. Directives hold from where they stand; unset fields are absent, empty ones ''."""
    for k, line in enumerate(lines, first):
        if line.startswith("#"):
            now.take(line)
        elif line.startswith("{"):
            try:
                yield k, now.kind, dict(_flat(json.loads(line))), None
            except ValueError:
                yield k, now.kind, None, "not a JSON object"
        elif line:
            if not now.names:
                yield k, now.kind, None, "data before the names of fields; the rest of the file is left out"
                return
            cells = {n: "" if v == now.empty else v for n, v in zip(now.names, line.split(now.sep), strict=False) if v != now.unset}
            yield k, now.kind, {n: v.replace(now.inner, ",") for n, v in cells.items()} if now.inner and now.inner != "," else cells, None


def _lines(stream, at: int, stop: int | None) -> Iterator[bytes]:
    """Lines, without their ends, that start from at to before stop; stop None: to the end of a stream that stands at its first one."""
    if at:
        stream.seek(at - 1)
        at += len(stream.readline()) - 1
    while (stop is None or at < stop) and (line := stream.readline()):
        at += len(line)
        yield line.rstrip(b"\r\n")


HELD = {"separator", "set_separator", "unset_field", "empty_field", "path", "fields"}
SKETCH = "file string, start long, stop long, lines long, headless boolean, plain boolean, told array<struct<name:string,line:string,sep:string>>, paths array<struct<name:string,line:string,sep:string>>"
INDEX = "file string, start long, stop long, first long, directives string, kinds array<string>"


def _sketched(row: dict) -> dict:
    """How many lines a range has, the last directive of each name with the separator by which it was read (null: that of ranges before), its #path lines, and whether data comes before names of fields (headless) or before a path (plain)."""
    if row["file"].endswith(".gz"):
        return row
    told: dict[str, dict] = {}
    n, headless, plain, sep, paths = 0, False, False, None, []
    with opened(row["file"]) as raw:
        for line in _lines(io.BufferedReader(raw, 1 << 20), row["start"], row["stop"]):
            n += 1
            if line.startswith(b"#"):
                text = line.decode("utf-8", "replace")
                name = (re.match("#([a-z_]+)", text) or [""] * 2)[1]
                if name not in HELD:
                    continue
                if name == "separator":
                    now = Directives("")
                    now.take(text)
                    sep = now.sep
                told[name] = {"name": name, "line": text, "sep": sep}
                if name == "path" and told[name] not in paths:
                    paths.append(told[name])
            elif line:
                plain = plain or "path" not in told
                headless = headless or ("fields" not in told and not line.startswith(b"{"))
    return row | {"lines": n, "headless": headless, "plain": plain, "told": list(told.values()), "paths": paths}


def _settled(ranges: list[dict]) -> list[dict]:
    """A file's ranges with the number of the first line and the directives that hold there. Once data came before names, what follows is left out."""
    file, out, first = ranges[0]["file"], [], 1
    if file.endswith(".gz"):
        return [{"file": file, "first": 1}]
    now = Directives(file_kind(file))
    for r in ranges:
        before, kinds = dataclasses.replace(now), {now.kind} if r["plain"] else set()

        def take(told: dict, now: Directives, before: Directives = before) -> str:
            now.sep = before.sep if told["sep"] is None else told["sep"]
            now.take(told["line"])
            return now.kind

        kinds |= {take(told, dataclasses.replace(before)) for told in r["paths"]}
        for told in sorted(r["told"], key=lambda t: t["name"] == "separator"):
            take(told, now)
        out.append({"file": file, "start": r["start"], "stop": r["stop"], "first": first, "directives": json.dumps(dataclasses.asdict(before)), "kinds": sorted(kinds)})
        first += r["lines"]
        if r["headless"] and not before.names:
            break
    return out


def index_zeek(spark: SparkSession, path: str, size: int = RANGE) -> str:
    """The folder with an index of the logs under a path, for the format "zeek": each range of a plain log with the directives that hold at its start. Gzipped logs are one range each. A path without logs is an error."""
    ranges = file_ranges(spark, path, size, "*.{log,log.gz}")
    if ranges.isEmpty():
        raise ValueError(f"no logs under {path}")
    return indexed(ranges, _sketched, SKETCH, _settled, INDEX)


class LogReader(RangeReader):
    """Ranges of logs."""

    shape = pa.schema([("file", pa.string()), ("record_no", pa.int64()), ("kind", pa.string()), ("record", pa.map_(pa.string(), pa.string())), ("warning", pa.string())])
    endings = (".log", ".log.gz")

    def may_hold(self, row: dict) -> bool:
        return super().may_hold(row) and (row["stop"] is None or "kind" not in self.options or self.options["kind"] in row["kinds"])

    def rows(self, row: dict) -> Iterator[list[dict]]:
        file, rows = row["file"], []
        now = Directives(**json.loads(row["directives"])) if row.get("directives") else Directives(file_kind(file))
        with opened(file) as raw:
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if file.endswith(".gz") else raw, 1 << 20)
            lines = (line.decode("utf-8", "replace") for line in _lines(stream, row["start"] or 0, row["stop"]))
            for k, kind, record, warning in log_records(lines, now, row.get("first") or 1):
                if self.options.get("kind") not in (None, kind):
                    continue
                rows.append({"file": file, "record_no": k, "kind": kind, "record": None if record is None else list(record.items()), "warning": warning})
                if len(rows) == 4096:
                    yield rows
                    rows = []
        if rows:
            yield rows


class Logs(DataSource):
    """spark.read.format("zeek"), once registered: records of logs. Options: index (a folder of index_zeek), range (bytes to a task), file and kind (only those)."""

    @classmethod
    def name(cls) -> str:
        return "zeek"

    def schema(self) -> str:
        return RECORDS

    def reader(self, schema: StructType) -> LogReader:
        return LogReader(schema, self.options)


def read_zeek(spark: SparkSession, path: str, size: int = RANGE, **options: str) -> DataFrame:
    """Records (file, record_no, kind, ts, record: map, warning) of the logs under a path, plain or gzipped; size: bytes of a log to a task; others are the format's options.

    Lines that cannot be read give a row with a warning and no record. A path without logs is an error.
    """
    spark.dataSource.register(Logs)
    found = spark.read.format("zeek").options(index=index_zeek(spark, path, size), range=size, **options).load(path)
    return found.select("file", "record_no", "kind", epoch(F.col("record")["ts"]).alias("ts"), "record", "warning")


def service_name(c: Column) -> Column:
    """The first service of a list that is named."""
    return F.get(F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: ~x.isin("", "-")), F.lit(0))


def _connections(records: DataFrame) -> DataFrame:
    r = F.col("record")
    seconds = r["duration"].try_cast("double")
    count = lambda *names: sum((F.coalesce(F.greatest(whole(r[n]), F.lit(0)), F.lit(0)) for n in names), F.lit(0).cast("long"))
    port = whole(r["id.resp_p"]).cast("int")
    rows = records.where("kind = 'conn'").select(
        "file", "record_no", F.col("record_no").alias("record_id"), r["id.orig_h"].alias("src_addr"), r["id.resp_h"].alias("dst_addr"), port.alias("port"), F.coalesce(blank(r["proto"]), F.lit("tcp")).alias("transport"), F.coalesce(service_name(r["service"]), protocol_of(port)).alias("protocol"),
        count("orig_pkts", "resp_pkts").alias("packets"), count("orig_ip_bytes", "resp_ip_bytes").alias("bytes"), F.col("ts").alias("first_seen"), F.when(seconds >= 0, F.timestamp_micros(F.unix_micros("ts") + (seconds * 1_000_000).cast("long"))).otherwise(F.col("ts")).alias("last_seen"),
        r["conn_state"].alias("state"), whole(r["resp_pkts"]).alias("resp_pkts"), whole(r["resp_ip_bytes"]).alias("resp_ip_bytes"),
    )
    return rows.where(usable_ip(F.col("src_addr")) & usable_ip(F.col("dst_addr")) & F.col("port").isNotNull()).withColumn("answered", F.expr(answered()))


def zeek_flows(records: DataFrame) -> DataFrame:
    """Connections between usable addresses as flows."""
    return shaped(_connections(records).withColumnRenamed("record_no", "record"), FLOW, "zeek")


def zeek_services(records: DataFrame) -> DataFrame:
    """Services of connections whose responder answered, and known services."""
    r = F.col("record")
    port = whole(r["port_num"]).cast("int")
    known = records.where("kind = 'known_services'").select("file", F.col("record_no").alias("record"), r["host"].alias("addr"), port.alias("port"), F.coalesce(blank(r["port_proto"]), F.lit("tcp")).alias("transport"), F.coalesce(service_name(r["service"]), protocol_of(port)).alias("protocol"), F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen")).where(usable_ip(F.col("addr")) & F.col("port").isNotNull())
    asked = _connections(records).where("answered").withColumn("addr", F.col("dst_addr")).withColumnRenamed("record_no", "record")
    return shaped(asked, SERVICE, "zeek").unionByName(shaped(known, SERVICE, "zeek"))


def is_control_log(kind: Column) -> Column:
    return kind.rlike(f"^({'|'.join(CONTROL_LOGS)})(_|$)")


def zeek_identities(records: DataFrame) -> DataFrame:
    """Identity facts that analyzers of control protocols logged (file, record_no, ts, kind, addr, peer, facts: map), by the address that sent them."""
    r = F.col("record")
    told = [F.struct(F.lit(k).alias("key"), F.coalesce(*(F.when(blank(r[n]) != "-", blank(r[n])) for n in names)).alias("value")) for k, names in IDENTITY_FIELDS.items()]
    facts = F.map_from_entries(F.filter(F.array(*told), lambda x: x["value"].isNotNull()))
    by_client = F.coalesce(flag(r["is_orig"]), F.lit(False))
    ends = [r["id.orig_h"], r["id.resp_h"]]
    rows = records.where(is_control_log(F.col("kind"))).select("file", "record_no", "ts", "kind", F.when(by_client, ends[0]).otherwise(ends[1]).alias("addr"), F.when(by_client, ends[1]).otherwise(ends[0]).alias("peer"), facts.alias("facts"))
    return rows.where(usable_ip(F.col("addr")))


def zeek_observations(records: DataFrame) -> DataFrame:
    """All that logs tell of devices: ends of connections, known hosts and services, leases, names, software, and identities."""
    r = F.col("record")
    rows = records.where("record IS NOT NULL").withColumn("seen", F.col("ts"))

    def of(kind: str) -> DataFrame:
        return rows.where(F.col("kind") == kind)

    def seen_at(df: DataFrame, addr: Column, **columns: Column) -> DataFrame:
        return observed(df.withColumn("addr", addr).where(usable_ip(F.col("addr"))), "zeek", **(with_address(F.col("addr")) | columns))

    ends = _connections(records).withColumn("seen", F.col("first_seen"))
    lease = F.coalesce(blank(r["client_addr"]), blank(r["requested_addr"]))
    mac = F.expr(mac_text(SPARK, "record['mac']"))
    query = F.regexp_replace(F.trim(r["query"]), r"\.$", "")
    answers = of("dns").where(F.upper(r["qtype_name"]).isin("A", "AAAA") & (query != "")).withColumn("answer", F.explode(F.split(r["answers"], ",")))
    banner = F.coalesce(blank(r["unparsed_version"]), blank(r["name"]))
    told = zeek_identities(records).withColumn("seen", F.col("ts"))
    named = told.where(F.size("facts") > 0)
    fill = {v: F.col("facts")[k] for k, v in FILLS.items()}
    line = F.format_string("identity read from the %s log at line %d", F.col("kind"), F.col("record_no"))
    parts = [
        seen_at(ends, F.col("src_addr")),
        seen_at(ends, F.col("dst_addr")),
        seen_at(of("known_hosts"), r["host"]),
        seen_at(of("known_services").where(whole(r["port_num"]).isNotNull()), r["host"]),
        observed(of("dhcp").withColumn("addr", lease).where(usable_ip(F.col("addr"))), "zeek", ipv4=F.col("addr"), mac=F.when(usable_mac(mac), mac), hostname=r["host_name"], protocol=F.lit("dhcp"), endpoint=F.col("addr"), fields=F.create_map(F.lit("dhcp_host_name"), F.coalesce(r["host_name"], F.lit("")), F.lit("dhcp_domain"), F.coalesce(r["domain"], F.lit(""))), notes=F.array(F.lit("name and address from the device's own request for a lease"))),
        seen_at(answers, F.trim("answer"), hostname=query),
        seen_at(of("software").where(banner.isNotNull()), r["host"], protocol=F.lit("software"), endpoint=r["host"], fields=F.create_map(F.concat(F.lit("zeek_software."), F.coalesce(blank(r["software_type"]), F.lit("unknown"))), banner), notes=F.array(F.lit("a banner, kept beside the identity"))),
        seen_at(told, F.col("peer")),
        seen_at(named, F.col("addr"), protocol=F.col("kind"), endpoint=F.col("addr"), fields=F.transform_keys("facts", lambda k, v: F.concat("kind", F.lit("."), k)), notes=F.array(line), **fill),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_ELEM = "elem:array<struct<_key:string,_VALUE:string>>"
_TABLE = f"table:array<struct<{_ELEM},table:array<struct<{_ELEM},table:array<struct<{_ELEM}>>>>>>"
_SCRIPT = f"array<struct<_id:string,_output:string,{_ELEM},{_TABLE}>>"
NMAP = (
    "status struct<_state:string>, _starttime long, _endtime long, address array<struct<_addr:string,_addrtype:string,_vendor:string>>, hostnames struct<hostname:array<struct<_name:string>>>, os struct<osmatch:array<struct<_name:string>>>, "
    f"hostscript struct<script:{_SCRIPT}>, ports struct<port:array<struct<_protocol:string,_portid:int,state:struct<_state:string>,service:struct<_name:string,_product:string,_version:string,_extrainfo:string>,script:{_SCRIPT}>>>"
)


def _facts(script: Column) -> Column:
    """A script's keys and values, those of tables within it (three deep) included; of a repeated key the last counts."""
    none = F.array().cast("array<struct<_key:string,_VALUE:string>>")
    below = lambda tables, deeper: F.flatten(F.transform(F.coalesce(tables, F.array()), deeper))
    own = lambda t: F.coalesce(t["elem"], none)
    every = F.concat(own(script), below(script["table"], lambda t: F.concat(own(t), below(t["table"], lambda u: F.concat(own(u), below(u["table"], own))))))
    return F.transform(F.filter(every, lambda e: F.coalesce(e["_key"] != "", F.lit(False))), lambda e: F.struct(script["_id"].alias("script"), e["_key"].alias("key"), F.trim(e["_VALUE"]).alias("value")))


def read_nmap(spark: SparkSession, path: str) -> DataFrame:
    """Hosts that are up: file, record_no, ipv4, ipv6, mac, mac_vendor, hostname, os, seen, facts of scripts, and open ports (port, transport, protocol, banner). Hosts that are down, or have no address, are left out.

    The time is the host's end or start, else the run's start.
    """
    hosts = spark.read.format("xml").option("rowTag", "host").schema(NMAP).load(path).select("*", F.col("_metadata.file_path").alias("file"))
    hosts = hosts.where("coalesce(status._state, 'up') = 'up'")
    heads = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", r'<nmaprun[^>]*\sstart="([0-9]+)"', 1).alias("start")).where("start <> ''").groupBy("file").agg(F.max(F.col("start").cast("long")).alias("run_start"))
    addr = lambda kind, what="_addr": F.try_element_at(F.filter("address", lambda a: a["_addrtype"] == kind), F.lit(-1))[what]
    named = lambda c: F.get(F.filter(F.coalesce(c, F.array()), lambda h: F.coalesce(h["_name"] != "", F.lit(False))), F.lit(0))["_name"]
    banner = lambda s: F.concat_ws(" ", *(blank(s[c]) for c in ("_product", "_version", "_extrainfo")))
    open_ports = F.filter(F.coalesce(F.col("ports.port"), F.array()), lambda p: p["state"]["_state"] == "open")
    services = F.transform(open_ports, lambda p: F.struct(p["_portid"].alias("port"), F.coalesce(blank(p["_protocol"]), F.lit("tcp")).alias("transport"), F.coalesce(protocol_of(p["_portid"]), p["service"]["_name"]).alias("protocol"), banner(p["service"]).alias("banner")))
    scripts = F.concat(F.coalesce(F.col("hostscript.script"), F.array().cast(_SCRIPT)), F.flatten(F.transform(open_ports, lambda p: F.coalesce(p["script"], F.array().cast(_SCRIPT)))))
    times = [F.when(F.col(c) > 0, F.col(c)) for c in ("_endtime", "_starttime", "run_start")]
    out = hosts.join(heads, "file", "left").select(
        "file", F.monotonically_increasing_id().alias("record_no"), addr("ipv4").alias("ipv4"), addr("ipv6").alias("ipv6"), addr("mac").alias("raw_mac"), addr("mac", "_vendor").alias("mac_vendor"), named(F.col("hostnames.hostname")).alias("hostname"), named(F.col("os.osmatch")).alias("os"),
        F.timestamp_seconds(F.coalesce(*times)).alias("seen"), F.flatten(F.transform(scripts, _facts)).alias("facts"), services.alias("services"),
    )
    out = out.withColumn("mac", F.coalesce(F.expr(mac_text(SPARK, "raw_mac")), F.lower(F.trim("raw_mac")))).drop("raw_mac")
    return out.where(F.coalesce("ipv4", "ipv6", "mac", "hostname").isNotNull())


def nmap_services(hosts: DataFrame) -> DataFrame:
    """Open ports of scanned hosts as services."""
    rows = hosts.select("file", F.col("record_no").alias("record"), F.coalesce("ipv4", "ipv6", "mac", "hostname").alias("addr"), F.explode("services").alias("s"), F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen"))
    return shaped(rows.select("*", "s.*").drop("s"), SERVICE, "nmap")


def nmap_observations(hosts: DataFrame) -> DataFrame:
    """Scanned hosts with the identity that scripts tell; of several facts for a field the first in the table's order counts. banners: what text sniffing may read."""

    def value(script: str, key: str) -> Column:
        found = F.try_element_at(F.filter("facts", lambda f: (f["script"] == script) & (f["key"] == key)), F.lit(-1))["value"]
        return F.when((found != "") & (found != "-"), found)

    keyed = [(script, key, what) for script, pairs in SCRIPTS.items() for key, what in pairs]
    fill = {column: F.coalesce(*(value(s, k) for s, k, w in keyed if w == what)) for what, column in FILLS.items() if any(w == what for *_, w in keyed)}
    told = [F.struct(F.lit(f"{s}.{k}").alias("key"), value(s, k).alias("value")) for s, k, _ in keyed]
    told += [F.struct(F.lit("mac_oui_vendor").alias("key"), F.col("mac_vendor").alias("value")), F.struct(F.lit("nmap_os_match").alias("key"), F.col("os").alias("value"))]
    fields = F.map_from_entries(F.filter(F.array(*told), lambda x: x["value"].isNotNull()))
    return observed(hosts, "nmap", ipv4=F.col("ipv4"), ipv6=F.col("ipv6"), mac=F.col("mac"), hostname=F.col("hostname"), endpoint=F.coalesce("ipv4", "ipv6", "mac", "hostname"), fields=fields, notes=F.array(F.lit("read from a scan's report; nothing was sent")), **fill)
