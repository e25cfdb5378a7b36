"""From captures, scans and logs to an inventory: one shape of observation, resolved to assets and merged in the order of authority."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwatch.functions.dialect import SPARK
from fenwatch.functions.text import asset_id
from fenwatch.operators import lookups as L
from fenwatch.operators import network as N
from fenwatch.operators.resolution import resolve_assets
from fenwatch.plans.graph import written
from fenwatch.sources import captures as C
from fenwatch.sources import logs
from fenwatch.sources.decoders import BY_PORT, decode_payloads
from fenwatch.sources.observations import ADDRESSES, FLOW, IDENTITY, SERVICE, observed, shaped, with_address


@dataclass
class Inventory:
    """assets (asset_id, addresses, identity, role, purdue, sight, sources), services and flows by asset, evidence, and what could not be read."""

    assets: DataFrame
    services: DataFrame
    flows: DataFrame
    evidence: DataFrame
    warnings: DataFrame


def _capture_observations(found: DataFrame, decoded: DataFrame, vendors: DataFrame, parsers: DataFrame) -> DataFrame:
    """Both ends of conversations, decoded responses, and what devices announce over ARP and LLDP."""
    owners = C.bindings(found).groupBy("file", "ip").agg(F.min("mac").alias("bound"))
    at = lambda c: with_address(F.col(c)) | {"mac": F.col("bound")}
    owned = lambda df, c: df.join(owners.withColumnRenamed("ip", c), ["file", c], "left")
    ends = C.sided(found).where(C.usable_ip(F.col("client")) & C.usable_ip(F.col("server"))).select("file", F.explode(F.array("client", "server")).alias("addr"), "packet", F.col("ts").alias("seen"))
    ends = owned(ends.groupBy("file", "addr").agg(F.min("packet").alias("record_no"), F.min("seen").alias("seen")), "addr")
    told = owned(decoded.where("protocol IS NOT NULL").withColumn("record_no", F.col("packet")).withColumn("seen", F.col("ts")), "server")
    notes = F.concat("notes", F.when(F.col("by_content"), F.array(F.lit("told by its content, not by its port"))).otherwise(F.array().cast("array<string>")))
    seen_in = {c: F.col("identity")[c] for c in IDENTITY}
    arp = C.announcements(found).withColumn("record_no", F.lit(0))
    near = C.neighbours(found).withColumn("record_no", F.lit(0))
    sniffed = L.sniffed(near.select(F.col("description").alias("id"), F.col("description").alias("text")).where("text <> ''").distinct(), vendors, parsers)
    names = vendors.groupBy("id").agg(F.min("display").alias("shown"))
    sniffed = sniffed.join(names.withColumnRenamed("id", "vendor"), "vendor", "left").select(F.col("id").alias("description"), "shown", "code")
    near = near.join(sniffed, "description", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    fields = F.create_map(F.lit("lldp_system_name"), text("name"), F.lit("lldp_system_description"), text("description"), F.lit("lldp_port_description"), text("port"))
    parts = [
        observed(ends, "pcap", **at("addr")),
        observed(told, "pcap", **(at("server") | seen_in), role=F.col("role"), protocol=F.col("protocol"), endpoint=F.concat_ws(":", "server", "port"), fields=F.col("fields"), notes=notes),
        observed(arp, "pcap", ipv4=F.col("ip"), mac=F.col("mac"), protocol=F.lit("arp"), endpoint=F.col("ip"), fields=F.create_map(F.lit("arp_announced_ip"), F.col("ip"))),
        observed(near, "pcap", ipv4=F.col("ip"), mac=F.col("mac"), hostname=F.col("name"), role=F.col("role"), vendor_raw=F.col("shown"), catalog_number=F.col("code"), protocol=F.lit("lldp"), endpoint=F.col("mac"), fields=fields),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _scan_observations(hosts: DataFrame, vendors: DataFrame, parsers: DataFrame) -> DataFrame:
    """Scanned hosts; a vendor or order code that scripts did not tell is taken from the products' and banners' text."""
    told = logs.nmap_observations(hosts)
    texts = hosts.select("file", F.col("record_no").alias("record"), F.array_join(F.filter(F.transform("services", lambda s: s["banner"]), lambda b: b != ""), ", ").alias("banners"))
    both = told.join(texts, ["file", "record"], "left").withColumn("text", F.concat_ws(", ", "product_raw", F.nullif("banners", F.lit(""))))
    names = vendors.groupBy("id").agg(F.min("display").alias("shown"))
    read = L.sniffed(both.select(F.col("text").alias("id"), "text").where("text <> ''").distinct(), vendors, parsers).join(names.withColumnRenamed("id", "vendor"), "vendor", "left").select(F.col("id").alias("text"), "shown", "code")
    out = both.join(read, "text", "left")
    return out.withColumn("vendor_raw", F.coalesce("vendor_raw", "shown")).withColumn("catalog_number", F.coalesce("catalog_number", "code")).select(*told.columns)


def merge_inventory(observations: DataFrame, services: DataFrame, flows: DataFrame, warnings: DataFrame) -> Inventory:
    """Observations as assets: those that share an IPv4 or hardware address are one; of each field the first value in the order of authority, file and record counts.

    An asset's id is that of its merged addresses. Services and flows find their asset by address.
    """
    order = F.struct("authority", "file", "record", "at")
    rows = written(observations.withColumn("at", F.monotonically_increasing_id()))
    # addresses that only IPv6 or a name tells are assets of their own, by that text
    keyed = rows.withColumn("alone", F.when(F.col("ipv4").isNull() & F.col("mac").isNull(), F.coalesce("ipv6", "hostname")))
    joined = keyed.where("alone IS NULL").groupBy("ipv4", "mac").agg(F.min(order).alias("place"))
    joined = written(joined.withColumn("obs", F.monotonically_increasing_id()))
    assets = resolve_assets(joined.select("obs", "place", "ipv4", "mac")).select("ipv4", "mac", F.col("asset").cast("string").alias("group"))
    grouped = keyed.where("alone IS NOT NULL").withColumn("group", F.concat(F.lit("only "), "alone")).unionByName(
        keyed.where("alone IS NULL").join(assets.withColumnRenamed("ipv4", "i").withColumnRenamed("mac", "m"), keyed["ipv4"].eqNullSafe(F.col("i")) & keyed["mac"].eqNullSafe(F.col("m"))).drop("i", "m")
    )
    grouped = written(grouped)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c)
    merged = grouped.groupBy("group").agg(*(first(c) for c in [*ADDRESSES, *IDENTITY, "role"]), F.min("seen").alias("first_seen"), F.max("seen").alias("last_seen"), F.array_sort(F.collect_set("source")).alias("sources"), F.count(F.lit(1)).alias("observations"))
    merged = written(merged.withColumn("asset_id", F.expr(asset_id(SPARK, "ipv4", "ipv6", "mac"))))
    told = grouped.where("fields IS NOT NULL OR size(notes) > 0 OR response IS NOT NULL").join(merged.select("group", "asset_id"), "group")
    evidence = told.select("asset_id", F.substring(F.sha2(F.concat_ws("|", "asset_id", "file", "record", "source", F.coalesce("protocol", F.lit("")), F.col("at").cast("string")), 256), 1, 12).alias("evidence_id"), "source", "protocol", "endpoint", "seen", "fields", "notes", "response")
    by_address = grouped.join(merged.select("group", "asset_id"), "group").select("asset_id", F.explode(F.array_compact(F.array("ipv4", "ipv6", "mac"))).alias("addr")).distinct()
    found = services.join(by_address, "addr").withColumn("place", F.struct("authority", "file", "record")).withColumn("seen", F.col("first_seen"))
    earliest = N.merge_services(found)
    last = found.groupBy("asset_id", "port", "transport").agg(F.max("last_seen").alias("until"))
    known = earliest.join(last, ["asset_id", "port", "transport"]).withColumn("last_seen", F.greatest("last_seen", "until")).drop("until", "n")
    known = written(known)
    ended = N.resolve_endpoints(flows, by_address).select("src_addr", "dst_addr", "port", "src", "dst").distinct()
    whole = flows.join(ended, ["src_addr", "dst_addr", "port"]).withColumn("src", F.coalesce("src", "src_addr")).withColumn("dst", F.coalesce("dst", "dst_addr")).withColumn("place", F.struct("authority", "file", "record")).withColumn("seen", F.col("first_seen"))
    summed = N.merge_flows(whole)
    until = whole.groupBy("src", "dst", "port", "transport").agg(F.max("last_seen").alias("until"))
    summed = summed.join(until, ["src", "dst", "port", "transport"]).withColumn("last_seen", F.greatest("last_seen", "until")).drop("until")
    classes = N.classify_assets(known.select("asset_id", "port", "protocol"), merged.select("asset_id", "role", F.lit(None).cast("string").alias("purdue")))
    full = merged.drop("role", "group").join(classes.select("asset_id", "role", "purdue", F.col("why").alias("role_reason")), "asset_id")
    return Inventory(full, known, summed, evidence, warnings)


def ingest(spark: SparkSession, captures: str | None = None, scans: str | None = None, log_path: str | None = None, vendors: DataFrame | None = None, parsers: DataFrame | None = None, most_packets: int = 0) -> Inventory:
    """An inventory from captures, Nmap reports and Zeek logs under paths; in this order their word counts. A file that cannot be read is a warning; no path at all is an error."""
    if not (captures or scans or log_path):
        raise ValueError("no input is given")
    vendors = L.BUILTIN_VENDORS() if vendors is None else vendors
    parsers = L.BUILTIN_PARSERS() if parsers is None else parsers
    observations, services, flows, warnings = [], [], [], []
    if captures:
        found = written(C.read_captures(spark, captures, most_packets))
        decoded = written(C.reassemble(found))
        observations.append(_capture_observations(found, decoded, vendors, parsers))
        whole = lambda df: df.withColumn("file", F.lit(captures)).withColumn("record", F.lit(0))
        services.append(shaped(whole(C.open_ports(found, decoded)), SERVICE, "pcap"))
        flows.append(shaped(whole(C.packet_flows(found)), FLOW, "pcap"))
        warnings.append(found.where("warning IS NOT NULL").select("file", F.col("packet").alias("record"), "warning"))
    if scans:
        hosts = written(logs.read_nmap(spark, scans))
        observations.append(_scan_observations(hosts, vendors, parsers))
        services.append(logs.nmap_services(hosts))
    if log_path:
        records = written(logs.read_zeek(spark, log_path))
        observations.append(logs.zeek_observations(records))
        services.append(logs.zeek_services(records))
        flows.append(logs.zeek_flows(records))
        warnings.append(records.where("warning IS NOT NULL").select("file", F.col("record_no").alias("record"), "warning"))

    def union(parts: list[DataFrame], shape: str) -> DataFrame:
        out = spark.createDataFrame([], shape)
        for p in parts:
            out = out.unionByName(p)
        return out

    every = observations[0]
    for o in observations[1:]:
        every = every.unionByName(o)
    return merge_inventory(every, union(services, SERVICE), union(flows, FLOW), union(warnings, "file string, record long, warning string"))


def probed(audit: DataFrame) -> Inventory:
    """An inventory of the responses in runs' audits (as planning.read_audit gives them), each decoded by its protocol; a refusal still tells that the device speaks it."""
    spark = audit.sparkSession
    port = F.create_map(*(F.lit(x) for p, name in BY_PORT.items() for x in (name, p)))
    asked = written(audit.where("response IS NOT NULL").select(F.monotonically_increasing_id().alias("id"), F.regexp_extract("target", r"^\[?(.*?)\]?:([0-9]+)$", 1).alias("addr"), F.regexp_extract("target", r":([0-9]+)$", 1).try_cast("int").alias("at_port"), F.coalesce("transport", F.lit("tcp")).alias("transport"), "template_id", port[F.col("protocol")].alias("port"), F.col("response").alias("payload"), F.col("timestamp").alias("seen"), F.col("run").alias("file")))
    told = asked.join(decode_payloads(asked), "id").withColumn("record_no", F.col("id"))
    refused = F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("refused: "), "error"))).otherwise(F.array().cast("array<string>"))
    notes = F.concat(F.coalesce("notes", F.array().cast("array<string>")), refused, F.when(F.col("protocol").isNull(), F.array(F.lit("the reply could not be read"))).otherwise(F.array().cast("array<string>")))
    seen = observed(told, "probe", **with_address(F.col("addr")), **{c: F.col("identity")[c] for c in IDENTITY}, role=F.col("role"), protocol=F.col("protocol"), endpoint=F.concat_ws(":", "addr", "at_port"), fields=F.col("fields"), notes=notes, response=F.col("payload"))
    services = shaped(told.where("protocol IS NOT NULL").drop("port").select("file", F.col("id").alias("record"), "addr", F.col("at_port").alias("port"), "transport", "protocol", F.col("seen").alias("first_seen"), F.col("seen").alias("last_seen")), SERVICE, "probe")
    return merge_inventory(seen, services, spark.createDataFrame([], FLOW), spark.createDataFrame([], "file string, record long, warning string"))


def identities_of(inventory: Inventory) -> DataFrame:
    """An inventory's assets as the identities that the match takes."""
    none = F.lit(None).cast("string")
    return inventory.assets.select(F.col("asset_id").alias("id"), "vendor_raw", none.alias("vendor"), "product_raw", none.alias("product"), "family", "model", "catalog_number", F.col("firmware_raw").alias("firmware"))


def ingest_stats(inventory: Inventory) -> DataFrame:
    """What an ingest gave, one row: assets, those with an identity, services, flows, evidence and warnings."""
    named = F.coalesce(*IDENTITY).isNotNull()
    one = lambda df, n: df.agg(F.count(F.lit(1)).alias(n))
    out = inventory.assets.agg(F.count(F.lit(1)).alias("assets"), F.count_if(named).alias("identified"))
    for df, n in ((inventory.services, "services"), (inventory.flows, "flows"), (inventory.evidence, "evidence"), (inventory.warnings, "warnings")):
        out = out.join(one(df, n), F.lit(True))
    return out


# ---- inventories as files


def save_inventory(inventory: Inventory, path: str) -> None:
    """An inventory as Parquet tables under a path."""
    for name in ("assets", "services", "flows", "evidence", "warnings"):
        getattr(inventory, name).write.mode("overwrite").parquet(f"{path}/{name}")


def load_inventory(spark: SparkSession, path: str) -> Inventory:
    return Inventory(*(spark.read.parquet(f"{path}/{name}") for name in ("assets", "services", "flows", "evidence", "warnings")))


def inventory_json(inventory: Inventory) -> DataFrame:
    """Assets with their services and evidence, and flows, in JSON, a row each (part, value)."""
    nested = lambda df, n: df.groupBy("asset_id").agg(F.array_sort(F.collect_list(F.to_json(F.struct(*[c for c in df.columns if c != "asset_id"])))).alias(n))
    whole = inventory.assets.join(nested(inventory.services, "services"), "asset_id", "left").join(nested(inventory.evidence, "evidence"), "asset_id", "left")
    return whole.select(F.lit("asset").alias("part"), F.to_json(F.struct("*")).alias("value")).unionByName(inventory.flows.select(F.lit("flow").alias("part"), F.to_json(F.struct("*")).alias("value")))


def merged_with(inventory: Inventory, other: Inventory) -> Inventory:
    """Both inventories as one: assets that share an IPv4 or hardware address merge, the first one's word counts, and equal flows are added up."""
    none = F.lit(None).cast("string")

    def rows(inv: Inventory, authority: int) -> DataFrame:
        return inv.assets.select("*", F.explode("sources").alias("source")).select(F.lit(authority).alias("authority"), F.lit("inventory").alias("file"), F.lit(0).cast("long").alias("record"), "source", F.explode(F.array("first_seen", "last_seen")).alias("seen"), *ADDRESSES, *IDENTITY, "role", none.alias("protocol"), none.alias("endpoint"), F.lit(None).cast("map<string,string>").alias("fields"), F.array().cast("array<string>").alias("notes"), F.lit(None).cast("binary").alias("response"))

    def named(inv: Inventory) -> DataFrame:
        return inv.assets.select("asset_id", F.coalesce("ipv4", "mac", "ipv6", "hostname").alias("name"))

    def services(inv: Inventory, authority: int) -> DataFrame:
        return shaped(inv.services.join(named(inv), "asset_id").withColumnRenamed("name", "addr").withColumn("file", F.lit("inventory")).withColumn("record", F.lit(authority)), SERVICE, "pcap")

    def flows(inv: Inventory, authority: int) -> DataFrame:
        out = inv.flows
        for end in ("src", "dst"):
            out = out.join(named(inv).select(F.col("asset_id").alias(end), F.col("name").alias(f"{end}_name")), end, "left").withColumn(f"{end}_addr", F.coalesce(f"{end}_name", end))
        return shaped(out.withColumn("file", F.lit("inventory")).withColumn("record", F.lit(authority)), FLOW, "pcap")

    out = merge_inventory(rows(inventory, 0).unionByName(rows(other, 1)), services(inventory, 0).unionByName(services(other, 1)), flows(inventory, 0).unionByName(flows(other, 1)), inventory.warnings.unionByName(other.warnings))
    return Inventory(out.assets, out.services, out.flows, inventory.evidence.unionByName(other.evidence), out.warnings)

