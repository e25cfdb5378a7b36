"""All queries of the engine's own operators, with the SQL that checks them.

Most queries are nodes, whose SQL comes from the operators' templates in the other dialect; those in `ORACLES` are
checked by SQL that was written apart, and `PLAIN` holds queries of plain DataFrame functions with such SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwatch.functions import text as X
from fenwatch.functions import versions as V
from fenwatch.functions.dialect import DUCK, SPARK, Dialect
from fenwatch.operators import corpus as C
from fenwatch.operators import lookups as L
from fenwatch.operators import matching as M
from fenwatch.operators import network as N
from fenwatch.operators import planning as P
from fenwatch.operators import report as R
from fenwatch.operators import snapshots
from fenwatch.operators.resolution import extend_assets, resolve_assets
from fenwatch.plans import match as G
from fenwatch.plans import oracles as O
from fenwatch.plans import rendered
from fenwatch.plans import views as W
from fenwatch.plans.graph import Node, Query, bound, select, shared_folder, written


def scalar(function: Callable[[Dialect, str], str], column: str, table: str) -> Node:
    """Distinct values of a column with a function's result."""
    return select(lambda d: f"SELECT DISTINCT {column} AS input, {function(d, column)} AS output FROM «a»", table)


ASSET, IDENTITY, SERVICE, FLOW = Node(W.ot_asset, "supplier"), Node(W.ot_identity, "supplier"), Node(W.ot_service, "lineitem"), Node(W.ot_flow, "lineitem")
PRODUCT, VULN, KEV, EPSS, ADVISORY = Node(W.ot_product, "part"), Node(W.ot_vuln, "lineitem"), Node(W.ot_kev, "events"), Node(W.ot_epss, "events"), Node(W.ot_advisory, "orders")
OBSERVATION = Node(W.observation, "lineitem")
VENDOR_TABLE, FAMILY_TABLE, PARSERS = Node(L.BUILTIN_VENDORS), Node(L.BUILTIN_FAMILIES), Node(L.BUILTIN_PARSERS)

# the match's graph over the views
_OVER = {G.IDENTITIES: IDENTITY, G.PRODUCTS: PRODUCT, G.VULNERABILITIES: VULN, G.KEV: KEV, G.EPSS: EPSS, G.VENDOR_TABLE: VENDOR_TABLE, G.FAMILY_TABLE: FAMILY_TABLE}
_MADE: dict[Node, Node] = {}


def over(node: Node) -> Node:
    return bound(node, _OVER, _MADE)


RANGES, NODES = map(over, (G.RANGES, G.NODES))
# the devices' identities alone
VENDORS, CODES, FAMILIES, CANONICAL = G.canonical_chain(IDENTITY, VENDOR_TABLE, FAMILY_TABLE)
STRENGTHS, VERDICTS, CANDIDATES, GRADED, FINDINGS, SUMMARY, COUNTED, NARROW, EVIDENT, SCOPE_LABELS, CVE_LISTS = map(over, (G.STRENGTHS, G.VERDICTS, G.CANDIDATES, G.GRADED, G.FINDINGS, G.SUMMARY, G.COUNTED, G.NARROW, G.EVIDENT, G.SCOPE_LABELS, G.CVE_LISTS))
ROUTES = Node(M.route_identities, IDENTITY, CANONICAL)
STRENGTHS.oracle = O.identity_match(over(G.ASSET_SIGNATURES), over(G.NODE_SIGNATURES), over(G.FAMILY_NAMES))
ENRICHED = Node(C.enrich, VULN, KEV, EPSS)
MERGED_FLOWS = Node(N.merge_flows, FLOW)
SERVICES = Node(N.merge_services, SERVICE)
ISSUES = Node(N.segmentation_issues, MERGED_FLOWS, ASSET)
TEMPLATES = select(lambda d: f"SELECT * FROM {d.values('t(template, protocol, port, transport, packets)', [('modbus-id', 'modbus', 502, 'tcp', 2), ('s7-szl', 's7comm', 102, 'tcp', 4), ('enip-list', 'enip', 44818, 'tcp', 1), ('bacnet-i-am', 'bacnet', 47808, 'udp', 1)])}", "region")
PLAN = Node(P.plan_probes, ASSET, TEMPLATES, SERVICES)
#: A rule for each part, of which many share an id or lack what a rule needs.
RULE_SHEET = select("SELECT p_partkey AS place, CASE WHEN p_size % 10 = 9 THEN ' ' ELSE p_name || ' ' || CAST(floor(p_partkey / 30) AS string) END AS id, CASE WHEN p_size % 10 = 8 THEN NULL ELSE p_type END AS reason, CASE WHEN p_size % 10 < 3 THEN p_brand END AS vendor, CASE WHEN p_size % 10 = 3 THEN p_type ELSE '' END AS family, CASE WHEN p_size % 10 IN (4, 5, 8) THEN p_name END AS product FROM «a»", "part")
RULES = select(lambda d: f"SELECT * FROM {d.values('t(place, vendor, family, product, template, protocol)', [(1, 'siemens', 's7-1200', '', '', 's7comm'), (2, 'siemens', '', '', 'modbus-id', ''), (3, 'Rockwell-Automation', '', '', '', ''), (4, '', '', 'relion', '', '')])}", "region")
LABELLED = select(lambda d: f"SELECT f.*, {X.identity_label('i.vendor', 'i.vendor_raw', 'i.product', 'i.product_raw', 'i.family', 'i.firmware')} AS device, 'https://example.org/' || f.advisory_id AS url FROM «a» f JOIN «b» i ON f.asset_id = i.id", FINDINGS, CANONICAL, kept=True)

BRACKETED = Node(L.bracketed_codes, select(lambda d: f"SELECT p_partkey AS id, 0 AS place, p_name || ' (' || {W.pick(d, W.ORDER_CODES, 'p_partkey')} || ') (EU)' AS name FROM «a» UNION ALL SELECT p_partkey, 1, p_type || ' (1756-L81E)' FROM «a»", "part"))
BAD_VENDORS = select(lambda d: f"SELECT entry, id, display, scheme, alias FROM «a» UNION ALL SELECT * FROM {d.values('t(entry, id, display, scheme, alias)', [(90, 'siemens', 'Siemens', '', 'siemens ag'), (91, 'other', 'Other', '', 'Siemens-AG'), (92, '', 'Nobody', '', 'nobody'), (93, 'blank', '', '', 'blank')])}", VENDOR_TABLE)
BAD_FAMILIES = select(lambda d: f"SELECT entry, id, vendor, display, name, is_model FROM «a» UNION ALL SELECT * FROM {d.values('t(entry, id, vendor, display, name, is_model)', [(90, 'scalance', 'siemens', 'SCALANCE', 'x', 0), (91, 'none', '', 'None', 'none', 0), (92, '', 'abb', 'Lost', 'lost', 0)])}", FAMILY_TABLE)

NODES_BY_NAME: dict[str, Node] = {
    # the flagship: findings by vendor-blocked match
    "flagship": select("SELECT finding_id, vector, tier, strength, more_specific, reason, result, n_also, cves, n_cves, kev, epss, cvss, severity, fix_available, round(score, 6) AS score, priority FROM «a»", FINDINGS),
    # normalization (N)
    "n1_n2_vendor_keys": Node(L.vendor_keys, select("SELECT vendor_raw AS name FROM «a» UNION ALL SELECT s_name FROM «b» UNION ALL SELECT text FROM «c» WHERE text IS NOT NULL", PRODUCT, "supplier", "documents")),
    "n3_vendor_lookup": VENDORS,
    "n5_product_key": scalar(X.product_key, "p_name", "part"),
    "n6_compact_key": scalar(lambda d, c: X.compact_key(X.product_key(d, c)), "p_name", "part"),
    "n7_family_lookup": FAMILIES,
    "n9_catalog_key": scalar(X.catalog_key, "p_type", "part"),
    "n4_vendor_faults": Node(L.vendor_faults, BAD_VENDORS),
    "n8_family_faults": Node(L.family_faults, BAD_FAMILIES),
    "n13_codes_for_vendor": Node(L.parse_codes_for_vendor, select(lambda d: f"SELECT DISTINCT {W.pick(d, W.ORDER_CODES, 'p_partkey')} AS code, {W.pick(d, ['siemens', 'abb', 'rockwell-automation', 'omron'], 'p_size')} AS for_vendor FROM «a»", "part"), PARSERS),
    "n10_n13_order_codes": Node(L.parse_order_codes, select(lambda d: f"SELECT {W.pick(d, W.ORDER_CODES, 'p_partkey')} AS code FROM «a»", "part")),
    "n14_clean_version": select(lambda d: f"SELECT DISTINCT firmware AS input, {X.clean_version(d, 'firmware')} AS output FROM «a»", ASSET),
    "n15_normalize_identity": select(lambda d: f"SELECT id, vendor, vendor_raw, product, product_raw, family, model, catalog_number, firmware, note, {d.join(d.map('steps', 's', "s.field || ':' || coalesce(s.was, '') || '>' || coalesce(s.now, '') || ':' || s.method"), '; ')} AS steps FROM «a»", CANONICAL),
    "n16_codes_in_names": Node(L.order_codes_in_names, BRACKETED, Node(L.parse_order_codes, select("SELECT DISTINCT code FROM «a»", BRACKETED))),
    "n19_normalize_products": select("SELECT product_id, vendor, product, model, family, catalog_number, kind, lower, upper, prefix FROM «a»", NODES),
    "n20_mac_and_id": Node(N.asset_ids, ASSET),
    "n20_usable": Node(N.usable_macs, select(lambda d: f"SELECT {W.pick(d, ['00-1B-1B-00-00-01', '01:00:5e:00:00:01', '00:00:00:00:00:00', 'bogus'], 's_suppkey')} AS mac FROM «a»", "supplier")),
    "n20_ports": select(lambda d: f"SELECT DISTINCT x AS input, {X.usable_port('x')} AS port FROM (SELECT {W.pick(d, [' 502 ', '0', '65535', '65536', 'x', ''], 'p_partkey')} AS x FROM «a») y", "part"),
    "n21_ipv4_key": select(lambda d: f"SELECT DISTINCT x AS input, {X.ipv4_key(d, 'x')} AS key FROM (SELECT {W.pick(d, ['10.0.0.9', '255.255.255.255', '256.1.1.1', '1.2.3', ''], 'p_partkey')} AS x FROM «a») y", "part"),
    "n22_labels": select(lambda d: f"SELECT DISTINCT {X.product_label(d, 'name', 'vendor_raw', 'version_raw', 'product_id')} AS label, name, vendor_raw, version_raw FROM «a»", PRODUCT),
    "n22_identity_labels": select(lambda d: f"SELECT id, {X.identity_label()} AS label FROM «a»", CANONICAL),
    "n24_file_names": Node(C.source_files, select("SELECT o_orderpriority AS id FROM «a» UNION ALL SELECT lower(o_orderpriority) FROM «a» UNION ALL SELECT '...' FROM «a»", "orders")),
    "n25_advisory_urls": select(lambda d: f"SELECT DISTINCT x AS input, {X.advisory_url('x')} AS url FROM (SELECT {W.pick(d, ['ICSA-24-001-01', 'icsma-23-1', ' ICSV-1 ', 'SSA-5'], 'p_partkey')} AS x FROM «a») y", "part"),
    "n23_n26_texts": select(lambda d: f"SELECT DISTINCT tier, {X.described(d, 'tier', X.TIER_TEXTS, 'Unclassified')} AS meaning, {M.severity_rank(d, 'severity')} AS severity_rank, severity FROM «a»", FINDINGS),
    "n26_levels": select(lambda d: f"SELECT DISTINCT purdue, {X.described(d, 'purdue', X.LEVEL_TEXTS, 'Unplaced')} AS meaning FROM «a»", ASSET),
    "j7_informative": select(lambda d: f"SELECT DISTINCT input, {X.informative(d, 'input')} AS output FROM (SELECT {X.product_key(d, 'name')} AS input FROM «a») x", PRODUCT),
    # versions (V)
    "v1_tokens": select(lambda d: f"SELECT DISTINCT firmware AS input, {V.spaced(d, V.tokens(d, 'firmware'))} AS output FROM «a»", ASSET),
    "v2_v7_compare": Node(V.compare_versions, select(lambda d: f"SELECT a || '~' || b || '~' || scheme AS id, scheme, a, b FROM (SELECT DISTINCT a.firmware AS a, b.v AS b, b.scheme FROM (SELECT DISTINCT {X.clean_version(d, 'firmware')} AS firmware, length(firmware) AS k FROM «a») a JOIN {d.values('b(v, scheme)', [('V4.5 SP2', 'siemens'), ('3.0', ''), ('R15A PC2', 'abb'), ('2.1', 'rockwell'), ('1.x', '')])} ON a.k >= 0) x", ASSET)),
    "v8_v13_parse_ranges": RANGES,
    "v14_v15_evaluate": select("SELECT v.version, v.result, v.comparator, v.explanation, v.id.b AS vendor, v.id.c AS version_raw FROM «a» v", VERDICTS),
    # joins (J)
    "j1_j9_identity_match": STRENGTHS,
    "j10_ruled_out": select("SELECT result, count(*) AS n, count(DISTINCT asset_id) AS assets FROM «a» GROUP BY result", CANDIDATES, by=COUNTED),
    "j11_enrich": ENRICHED,
    "j12_prune": Node(C.prune_enrichment, EPSS, VULN),
    "j13_unscored": Node(C.unscored, select("SELECT cve, CASE WHEN base_score > 8 THEN base_score END AS base_score FROM «a»", VULN)),
    "j13_fill_gaps": Node(C.fill_score_gaps, select("SELECT source, advisory_id, cve, CASE WHEN base_score > 3 THEN base_score END AS base_score FROM «a»", VULN), select("SELECT cve, score * 10 AS base_score FROM «a»", EPSS)),
    "j14_endpoints": Node(N.resolve_endpoints, select("SELECT '10.' || CAST(l_suppkey % 25 AS string) || '.0.' || CAST(l_suppkey % 250 AS string) AS src_addr, '10.1.0.' || CAST(l_partkey % 300 AS string) AS dst_addr, l_linenumber AS port FROM «a»", "lineitem"), select("SELECT ipv4 AS addr, asset_id FROM «a» UNION ALL SELECT mac, asset_id FROM «a»", ASSET)),
    "j15_f6_segmentation": ISSUES,
    "j16_bindings": Node(N.bind_addresses, select("SELECT 'm' || CAST(l_suppkey AS string) AS mac, '10.0.0.' || CAST(l_suppkey % 60 + CASE WHEN l_partkey % 400 = 0 THEN 1 ELSE 0 END AS string) AS ip, CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END AS kind FROM «a»", "lineitem")),
    "j17_b2_plan": PLAN,
    "j18_rule_faults": Node(P.deny_rule_faults, RULE_SHEET),
    "j18_deny": Node(P.deny_probes, PLAN, select("SELECT id AS asset_id, vendor, family, product, product_raw FROM «a»", CANONICAL), RULES),
    # aggregations (A)
    "a1_merge_assets": Node(N.merge_assets, OBSERVATION),
    "a3_merge_services": SERVICES,
    "a4_a5_merge_flows": MERGED_FLOWS,
    "a7_a8_grade": select(lambda d: f"SELECT asset_id, source, advisory_id, product_id, strength, more_specific, reason, result, n_also, tier, {d.join('matched', ' ')} AS matched FROM «a»", GRADED),
    "a12_advisory_rollup": Node(C.advisory_rollup, ENRICHED),
    "a13_f7_summary": SUMMARY,
    "a14_inventory_stats": Node(N.inventory_stats, select("SELECT a.asset_id, a.purdue, a.role, r.route <> 'unidentified' AS identified FROM «a» a JOIN «b» r ON a.asset_id = r.id", ASSET, ROUTES), SERVICES, MERGED_FLOWS, ISSUES),
    "a15_corpus_stats": Node(C.corpus_stats, NODES, VULN, ADVISORY),
    "a17_classify": Node(N.classify_assets, SERVICES, ASSET),
    "a18_faults": Node(C.advisory_faults, ADVISORY, PRODUCT, VULN),
    "a18_dedupe_advisories": Node(C.deduplicate_advisories, ADVISORY),
    "s23_sources": Node(C.source_registry),
    "a19_upsert": Node(C.upsert_advisories, select("SELECT DISTINCT source, advisory_id, 'old' AS title FROM «a» WHERE place % 3 <> 0", ADVISORY), select("SELECT DISTINCT source, advisory_id, 'new' AS title FROM «a» WHERE place % 3 = 0", ADVISORY)),
    "a16_ingest_stats": select("SELECT source, count(*) AS records, count(DISTINCT asset_id) AS assets, count(vendor_raw) AS named, min(seen) AS first_seen, max(seen) AS last_seen FROM «a» GROUP BY source", OBSERVATION),
    "a26_new_fields": Node(N.new_field_observations, select("SELECT 's' || CAST(l_suppkey AS string) AS asset_id, l_linenumber AS port, l_returnflag AS field, l_shipmode_ AS value, place FROM (SELECT *, l_linestatus AS l_shipmode_, l_orderkey * 10 + l_linenumber AS place FROM «a») x", "lineitem")),
    # filters, orders, sets (F, W, U)
    "f4_answered": Node(N.responder_answered, select(lambda d: f"SELECT l_orderkey * 10 + l_linenumber AS id, {W.pick(d, ['S0', 'SF', 'REJ', 'OTH', 'RSTO', 'S9'], 'l_partkey')} AS state, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_quantity AS bigint) % 3 END AS resp_pkts, CASE WHEN l_linenumber % 4 = 1 THEN CAST(l_quantity AS bigint) % 2 END AS resp_ip_bytes FROM «a»", "lineitem")),
    "f5_server_side": Node(N.server_side, select(lambda d: f"SELECT l_orderkey * 10 + l_linenumber AS id, CASE WHEN l_returnflag = 'R' THEN 'udp' ELSE 'tcp' END AS transport, CAST({W.pick(d, W.PORTS, 'l_linenumber')} AS int) AS src_port, CAST({W.pick(d, [50000, 502, 80, 1024], 'l_partkey')} AS int) AS dst_port, l_linestatus = 'O' AND l_linenumber = 1 AS syn, l_partkey % 2 = 0 AS ack FROM «a»", "lineitem")),
    "f11_http_banner": select(lambda d: f"SELECT event_id AS id, nullif(trim({d.extract('substring(payload, 1, 4096)', '(?i)^HTTP/1[.][^~]*~server:([^~]*)', 1)}), '') AS server FROM (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'SSH-2.0' ELSE 'HTTP/1.1 200 OK~Date: x~Server: ' || event_type || '/1.' || CAST(event_id % 3 AS string) || '~' END AS payload FROM «a») x", "events"),
    "n18_leading_code": select(lambda d: f"SELECT input, CASE WHEN contains(head, '-') AND length({d.replace_all('head', '[^0-9]', '')}) >= 3 AND length(head) >= 6 THEN head END AS code FROM (SELECT DISTINCT input, {d.extract('input', '^([^ /]*)', 1)} AS head FROM (SELECT {W.pick(d, ['1756-ENBT/A rev', '1769-L30ER CPU', 'plain name', 'AB-1', '2711P-T10C4D8/B panel'], 'p_partkey')} AS input FROM «a») x) y", "part"),
    "s9_s25_typed_fields": select(lambda d: "SELECT DISTINCT x AS input, CAST(greatest(try_cast(x AS double), 0) AS bigint) AS whole, CASE lower(x) WHEN 't' THEN true WHEN 'true' THEN true WHEN 'f' THEN false WHEN 'false' THEN false END AS flag FROM (SELECT " + W.pick(d, ["12", "3.0", "-4", "T", "false", "x", ""], "p_partkey") + " AS x FROM «a») y", "part"),
    "u1_union": select("SELECT asset_id, count(*) AS n FROM (SELECT asset_id, port FROM «a» UNION ALL SELECT src, port FROM «b») x GROUP BY asset_id", SERVICE, FLOW),
    "w6_hosts": Node(P.group_by_host, select("SELECT o_orderkey AS place, o_custkey AS host FROM «a»", "orders")),
    # feeds (S)
    "s15_affected_cells": Node(C.split_affected, select("SELECT p_partkey AS id, p_name || ' < 2.0 | ' || p_brand || ' >= ' || CAST(p_size AS string) || ' | ' || p_type AS cell FROM «a»", "part")),
    "s16_kev_rows": Node(C.read_kev_rows, select("SELECT CASE WHEN event_id % 7 = 0 THEN 'junk' ELSE ' cve-2021-' || lpad(CAST(event_id AS string), 6, '0') END AS cve_id, CASE WHEN event_id % 2 = 0 THEN 'Known' ELSE 'Unknown' END AS ransomware FROM «a»", "events")),
    # planning (B)
    "b1_target_faults": Node(P.target_faults, select(lambda d: f"SELECT * FROM {d.values('t(spec)', [('10.0.0.0/24',), ('10.0.0.0/15',), ('host.example',), ('10.0.0.9-10.0.0.1',), ('10.0.0.256',), ('10.0.0.0/33',)])}", "region")),
    "b1_targets": Node(P.expand_specs, select(lambda d: f"SELECT * FROM {d.values('t(spec)', [('10.0.0.0/24',), ('10.0.1.5',), ('10.0.0.250-10.0.1.9',), ('192.168.1.0/31',), ('172.16.0.77/22',)])}", "region")),
    "b7_abort": Node(P.abort_points, select("SELECT l_suppkey AS run, l_orderkey * 10 + l_linenumber AS place, l_discount > 0.07 AS failed FROM «a»", "lineitem")),
}


# ---- queries of plain functions, each with SQL of its own


def _plain(node: Node, function: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(node.spark(spark, sf_dir))


def _reported(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Findings with their device's label, a reference each, and remedies by the fix that is known; and the lists of CVEs that they name."""
    made: dict[Node, DataFrame] = {}
    remedy = F.when(F.col("fix_available"), F.array(F.struct(F.lit("vendor_fix").alias("category"), F.lit("Update.").alias("details"), F.lit("").alias("url")))).otherwise(F.array(F.struct(F.lit("no_fix_planned").alias("category"), F.lit("").alias("details"), F.lit("").alias("url")), F.struct(F.lit("other").alias("category"), F.concat(F.lit("See "), "advisory_id").alias("details"), F.col("url").alias("url"))))
    label = CANONICAL.spark(spark, sf_dir, made).select(F.col("id").alias("asset_id"), F.expr(X.identity_label()).alias("device"))
    rows = NARROW.spark(spark, sf_dir, made).join(label, "asset_id").withColumn("url", F.concat(F.lit("https://example.org/"), "advisory_id"))
    return rows.withColumn("references", F.array(F.lit("https://cwe.mitre.org/1"), F.col("url"))).withColumn("remediations", remedy), CVE_LISTS.spark(spark, sf_dir, made)


def _vex(function: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: function(*_reported(spark, sf_dir))


def _text(df: DataFrame, *columns: str) -> DataFrame:
    """df with arrays of texts joined, as results are compared by value."""
    return df.select(*(F.array_join(c, " ").alias(c) if c in columns else F.col(c) for c in df.columns))


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    made: dict[Node, DataFrame] = {}
    findings = EVIDENT.spark(spark, sf_dir, made).join(SCOPE_LABELS.spark(spark, sf_dir, made), "scope")
    kinds = F.array_join(F.transform("reasons", lambda r: F.concat(r["kind"], F.when(r["passed"], "").otherwise("!"))), " ")
    return findings.select("finding_id", kinds.alias("kinds"), F.col("version_check.explanation").alias("explanation"), F.size("also_matched").cast("bigint").alias("n_also"))


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public chain over the views."""
    made: dict[Node, DataFrame] = {}
    at = lambda node: node.spark(spark, sf_dir, made)
    none = F.array().cast("array<struct<category:string,details:string,url:string,product_ids:array<string>>>")
    vulns = at(VULN).withColumn("place", F.xxhash64("cve", "base_score")).withColumn("remediations", none).withColumn("references", F.array(F.concat(F.lit("https://example.org/"), F.coalesce("cve", F.lit("none")))))
    advisories = at(ADVISORY).withColumn("url", F.lit(None).cast("string"))
    found = G.match(at(IDENTITY), G.Corpus(advisories, at(PRODUCT), vulns, at(KEV), at(EPSS)), tier="likely").findings
    return found.select("finding_id", "tier", "title", F.size("references").cast("bigint").alias("n_references"), F.size("reasons").cast("bigint").alias("n_reasons"))


def _sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheet of findings with all that it shows."""
    made: dict[Node, DataFrame] = {}
    none = F.array().cast("array<struct<category:string,details:string,url:string>>")
    rows = R.described(EVIDENT.spark(spark, sf_dir, made), CANONICAL.spark(spark, sf_dir, made)).withColumn("title", F.lit("")).withColumn("published", F.lit(None).cast("timestamp")).withColumn("remediations", none).withColumn("references", F.array().cast("array<string>"))
    return R.sheet(rows, CVE_LISTS.spark(spark, sf_dir, made))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations that share addresses, as assets."""
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return resolve_assets(spark.sql(O.RESOLVED_INPUT.format("{s}"), s=suppliers)).select("obs", "asset")


def _extended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same assets, of which two thirds of the observations are resolved and stored before the others come."""
    every = spark.sql(O.RESOLVED_INPUT.format("{s}"), s=spark.read.parquet(f"{sf_dir}/supplier.parquet"))
    stored = written(resolve_assets(every.where("obs % 3 <> 1")))
    return extend_assets(stored, every.where("obs % 3 = 1")).select("obs", "asset")


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as observations that share an address with the next key by turns, so that chains have thousands of hops."""
    return resolve_assets(spark.sql(O.CHAINED_INPUT, o=spark.read.parquet(f"{sf_dir}/orders.parquet"))).select("obs", "asset")


def _snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus that is committed twice and loaded with its digests checked; the second time one source and one table change."""
    path = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    advisories, vulns, kev, epss = (n.spark(spark, sf_dir) for n in (ADVISORY, VULN, KEV, EPSS))
    first = snapshots.save_snapshot(spark, {"advisories": advisories, "vulnerabilities": vulns, "kev": kev, "epss": epss}, path)
    sheet = advisories.where("source = 'sheet'").withColumn("place", F.col("place") + 1)
    last = snapshots.save_snapshot(spark, {"advisories": sheet, "epss": epss.withColumn("score", F.col("score") + 0.0001)}, path, after=first)
    got = snapshots.load_snapshot(spark, path, last)
    told = lambda name, source, value: got[name].groupBy(F.lit(name).alias("part"), source.cast("string").alias("source")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).cast("long").alias("places"))
    parts = [told("advisories", F.col("source"), F.col("place")), told("vulnerabilities", F.col("source"), F.length("vector")), told("kev", F.col("ransomware"), F.length("cve")), told("epss", F.lit(None), F.round(F.col("score") * 10000).cast("long"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


PLAIN: dict[str, tuple[Query, str | Callable[[], str] | None]] = {
    "a27_j20_chain": (_matched, None),
    "a27_reasons": (_evidence, lambda: O.reasons(FINDINGS, CANDIDATES)),
    "f1_min_tier": (_plain(FINDINGS, lambda f: M.at_least(f, "likely").groupBy("tier").agg(F.count(F.lit(1)).alias("n"))), lambda: f"SELECT tier, count(*) AS n FROM ({FINDINGS.duck()}) WHERE tier IN ('likely', 'confirmed') GROUP BY tier"),
    "w1_w2_w5_top_findings": (_plain(FINDINGS, lambda f: M.in_order(f, 50).select("finding_id", "tier", "priority")), lambda: f"SELECT finding_id, tier, priority FROM ({FINDINGS.duck()}) ORDER BY priority DESC, advisory_id, asset_id, product_id LIMIT 50"),
    "u2_investigated": (_plain(FINDINGS, lambda f: f.where("tier <> 'confirmed'").select("product_id").distinct().join(f.where("tier = 'confirmed'").select("product_id"), "product_id", "left_anti")), lambda: f"WITH f AS ({FINDINGS.duck()}) SELECT DISTINCT product_id FROM f WHERE product_id NOT IN (SELECT product_id FROM f WHERE tier = 'confirmed')"),
    "f2_since": (_plain(ADVISORY, lambda a: C.since(a, "1998-01-01").select("source", "advisory_id", "published")), lambda: f"SELECT source, advisory_id, published FROM ({ADVISORY.duck()}) WHERE coalesce(published >= TIMESTAMP '1998-01-01', true)"),
    "f13_text_filter": (_plain(FINDINGS, lambda f: R.matching_text(f, " CVE-2020-0001 ").select("finding_id")), lambda: f"SELECT finding_id FROM ({FINDINGS.duck()}) WHERE lower(asset_id || ' ' || advisory_id || ' ' || product_id || ' ' || tier || ' ' || cves) LIKE '%cve-2020-0001%'"),
    "j19_by_cve": (_plain(VULN, lambda v: C.by_cve(v, [" cve-2020-00020", "CVE-2020-00100", "CVE-2020-02000"]).groupBy("cve").agg(F.count_distinct("advisory_id").alias("advisories"))), O.BY_CVE),
    "a19_replace_source": (_plain(ADVISORY, lambda a: C.replace_source(a.where("place % 3 <> 0").select("source", "advisory_id", "place"), a.where("place % 3 = 0").select(F.lit("feed").alias("source"), "advisory_id", "place"))), O.REPLACED),
    "a20_vex_products": (_vex(lambda f, _: R.vex_products(f)), lambda: O.vex_products(LABELLED)),
    "a21_vex_groups": (_vex(R.vex_groups), lambda: O.vex_groups(LABELLED)),
    "a22_vex_scores": (_vex(lambda f, l: _text(R.vex_scores(f, l), "devices")), lambda: O.vex_scores(LABELLED)),
    "a23_vex_threats": (_vex(lambda f, l: R.vex_threats(f, l).select("vuln", "kev", "epss", F.size("threats").cast("bigint").alias("n"))), lambda: O.vex_threats(LABELLED)),
    "a24_vex_remediations": (_vex(lambda f, l: R.vex_remediations(f, l).groupBy("vuln").agg(F.array_join(F.array_sort(F.collect_list("category")), " ").alias("categories"))), lambda: O.vex_remediations(LABELLED)),
    "a25_vex_references": (_vex(lambda f, l: R.vex_references(f, lists=l).select("vuln", F.col("k").cast("bigint").alias("k"), "url")), lambda: O.vex_references(LABELLED)),
    "b3_estimate": (_plain(PLAN, lambda p: P.estimate_plan(p, 2.0, 0.25)), lambda: f"SELECT count(*) AS probes, CAST(coalesce(sum(packets), 0) AS bigint) AS packets, CAST(round(greatest(coalesce(sum(packets), 0) - 1, 0) * 0.5) AS bigint) AS seconds FROM ({PLAN.duck()})"),
    "f3_risk_gate": (_plain(PLAN, lambda p: P.rated_at_most(p.withColumn("risk", F.expr("CASE template WHEN 's7-szl' THEN 'caution' WHEN 'modbus-id' THEN 'odd' ELSE 'safe' END")), "caution").select("asset_id", "template")), lambda: f"SELECT asset_id, template FROM ({PLAN.duck()}) WHERE template <> 'modbus-id'"),
    "j13_score_gaps": (_plain(VULN, lambda v: C.score_gaps(v.withColumn("base_score", F.expr("CASE WHEN base_score > 8 THEN base_score END")), 200)), O.SCORE_GAPS),
    "w3_inventory_order": (lambda s, d: written(N.assets_in_order(ASSET.spark(s, d)).limit(25)).select("asset_id", "ipv4"), O.FIRST_ASSETS),
    "a2_resolution": (_resolved, O.RESOLVED),
    "a2_extended": (_extended, O.RESOLVED),
    "a2_long_chains": (_chained, O.CHAINED),
    "s19_k7_snapshot": (_snapshot, O.SNAPSHOT),
    "p1_p7_responses": (rendered.decoded_responses, rendered.RESPONSES_TOLD),
    "s2_a5_captures": (rendered.capture_flows, rendered.CAPTURED_FLOWS),
    "s3_s4_packets": (rendered.capture_packets, rendered.CAPTURED_PACKETS),
    "s5_s9_zeek_logs": (rendered.logged_records, rendered.LOGGED_RECORDS),
    "p7_a26_stream": (rendered.streamed_responses, rendered.RESPONSES_TOLD),
    "a5_ended_flows_stream": (rendered.streamed_flows, rendered.ENDED_FLOWS),
    "k2_sheet": (lambda s, d: _sheet(s, d).select("finding_id", "tier_meaning", "cvss", "epss", "kev", "priority", "fix_available", "cves"), lambda: O.sheet(FINDINGS)),
}


#: SQL written apart from the templates, which a wrong template would not follow.
ORACLES: dict[str, Callable[[], str]] = {
    "a12_advisory_rollup": lambda: O.ADVISORY_ROLLUP,
    "j11_enrich": lambda: O.ENRICH,
    "a4_a5_merge_flows": lambda: O.MERGED_FLOWS,
    "j15_f6_segmentation": lambda: O.SEGMENTATION,
    "a1_merge_assets": lambda: O.MERGED_ASSETS,
    "a17_classify": lambda: O.CLASSIFIED,
    "j18_rule_faults": lambda: O.RULE_FAULTS,
    "a7_a8_grade": lambda: O.graded(CANDIDATES),
    "a13_f7_summary": lambda: O.summary(FINDINGS, CANDIDATES, CANONICAL),
}


def queries() -> dict[str, Query]:
    return {name: node.spark for name, node in NODES_BY_NAME.items()} | {name: query for name, (query, _) in PLAIN.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: node.duck() for name, node in NODES_BY_NAME.items()} | {name: text() for name, text in ORACLES.items()}
    return found | {name: sql() if callable(sql) else sql for name, (_, sql) in PLAIN.items() if sql}


__all__ = ["DUCK", "SPARK", "oracle_sql", "queries"]
