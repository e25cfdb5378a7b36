"""Derived views: network assets, flows, products and advisories made from the driver's tables by fixed rules, alike in both dialects."""

from __future__ import annotations

from fenwatch.functions.dialect import Dialect, operator

# Fixed values of the views: spellings that the rules pick from by key.
VENDOR_SPELLINGS = ["Siemens AG", "siemens", "Allen-Bradley", "Rockwell Automation, Inc.", "ABB Ltd.", "Schneider Electric SE", "Müller Automation GmbH", ""]
ASSET_PRODUCTS = ["SIMATIC S7-1200", "CPU 1214C", "S7 1500 controller", "ControlLogix", "1756-L81E", "Relion 670", "Modicon M340", ""]
NODE_PRODUCTS = ["SIMATIC S7-1200 CPU family", "CPU 1214C", "SIMATIC S7-1500", "ControlLogix 5580 controllers", "ControlLogix", "Relion 670 series", "M340", "all devices", "SIMATIC S7-1200", "CPU 1212C"]
RANGE_SPELLINGS = ["all", "< V4.5", "<= 2.3", ">= 1.0 < 3.0", "2.1.x", "1.0 to 4.0", "versions prior to V4.2", "2.3 and earlier", "3.0 or newer", "vers:generic/>=1.0|<2.5", "vers:generic/*", "prior to R15A", "up to and including 4.4", "4.0", "unknown range", "", "All versions before 3.1.2", "later than 2", "= 2.0", "between 1 and 2", "V3.*", "up to but not including 3", "through 2.9", "5 and below", "1.0-rc1"]
ORDER_CODES = ["6ES7 214-1AG40-0XB0", "6GK5208-0BA10-2AA3", "1756-L81E", "1769-L30ER", "R04CPU", "FX5U-32M", "2711P-T10C4D8", "bogus"]
PORTS = [502, 102, 44818, 80, 9999, 4840, 20000, 3389]


def pick(d: Dialect, values: list, at: str) -> str:
    """One of the values by a key."""
    return d.get(d.array(*(f"'{v}'" if isinstance(v, str) else str(v) for v in values)), f"CAST({at} AS int) % {len(values)}")


@operator("supplier")
def ot_asset(d: Dialect) -> str:
    level = pick(d, ["L0", "L1", "L2", "L3", "L3.5", "L4", "L5", ""], "s_nationkey")
    return f"""SELECT 's' || CAST(s_suppkey AS string) AS asset_id, '10.' || CAST(s_nationkey AS string) || '.' || CAST(CAST(floor(s_suppkey / 250) AS bigint) AS string) || '.' || CAST(s_suppkey % 250 AS string) AS ipv4, '' AS ipv6,
  CASE WHEN s_suppkey % 3 = 0 THEN '00-1B-1B-' || lpad(CAST(s_suppkey % 100 AS string), 2, '0') || '-00-01' ELSE '' END AS mac,
  {pick(d, VENDOR_SPELLINGS, 's_suppkey')} AS vendor_raw, '' AS vendor, {pick(d, ASSET_PRODUCTS, 's_suppkey')} AS product_raw, '' AS product, '' AS family, '' AS model,
  CASE WHEN s_suppkey % 11 = 0 THEN {pick(d, ORDER_CODES, 's_suppkey')} ELSE '' END AS catalog_number,
  CASE WHEN s_suppkey % 6 = 5 THEN '' ELSE 'Version V' || CAST(s_nationkey % 6 AS string) || '.' || CAST(s_suppkey % 10 AS string) || CASE WHEN s_suppkey % 7 = 0 THEN ' SP2' ELSE '' END END AS firmware,
  {level} AS purdue, CASE WHEN s_suppkey % 5 = 0 THEN 'hmi' ELSE '' END AS role, s_suppkey FROM «supplier»"""


@operator("supplier")
def ot_identity(d: Dialect) -> str:
    return f"SELECT asset_id AS id, vendor_raw, vendor, product_raw, product, family, model, catalog_number, firmware FROM ({ot_asset.build(d).replace('«supplier»', '«supplier»')}) a"


@operator("lineitem")
def ot_service(d: Dialect) -> str:
    port = pick(d, PORTS, "l_linenumber + l_suppkey % 3")
    return f"""SELECT 's' || CAST(l_suppkey AS string) AS asset_id, CAST({port} AS int) AS port, CASE WHEN l_returnflag = 'R' THEN 'udp' ELSE 'tcp' END AS transport, CASE WHEN l_linestatus = 'O' THEN '' WHEN {port} = 502 THEN 'modbus' WHEN {port} = 80 THEN 'http' ELSE '' END AS protocol,
  CASE WHEN l_linenumber = 1 THEN 'server ' || CAST(l_partkey % 5 AS string) END AS banner, l_shipdate AS seen, l_orderkey * 10 + l_linenumber AS place FROM «lineitem»"""


@operator("lineitem")
def ot_flow(d: Dialect) -> str:
    return f"""SELECT 's' || CAST(l_suppkey AS string) AS src, 's' || CAST(l_partkey % 97 AS string) AS dst, CAST({pick(d, PORTS, 'l_linenumber')} AS int) AS port, CASE WHEN l_returnflag = 'R' THEN 'udp' ELSE 'tcp' END AS transport, CASE WHEN l_linestatus = 'O' THEN 'p' || CAST(l_linenumber AS string) END AS protocol,
  CAST(l_quantity AS bigint) AS packets, CAST(l_quantity AS bigint) * 60 AS bytes, l_shipdate AS seen, l_orderkey * 10 + l_linenumber AS place FROM «lineitem»"""


@operator("part")
def ot_product(d: Dialect) -> str:
    """A node for each part."""
    return f"""SELECT 'feed' AS source, 'ADV-' || CAST(p_partkey % 199 AS string) AS advisory_id, 'P' || CAST(p_partkey AS string) AS product_id, {pick(d, VENDOR_SPELLINGS, 'p_partkey')} AS vendor_raw, {pick(d, NODE_PRODUCTS, 'p_size')} AS name, {pick(d, NODE_PRODUCTS, 'p_size')} AS product_raw, CASE WHEN p_size % 10 = 0 THEN 'SIMATIC S7-1200' ELSE '' END AS family_raw,
  CASE WHEN p_partkey % 13 = 0 THEN {pick(d, ORDER_CODES, 'p_partkey')} ELSE '' END AS catalog_number, CASE WHEN p_partkey % 17 = 0 THEN 'cpe:2.3:h:siemens:6es72141ag400xb0' ELSE '' END AS cpe, {pick(d, RANGE_SPELLINGS, 'p_partkey + p_size')} AS version_raw FROM «part»"""


@operator("lineitem")
def ot_vuln(d: Dialect) -> str:
    """A vulnerability for each line item."""
    return f"""SELECT 'feed' AS source, 'ADV-' || CAST(l_orderkey % 211 AS string) AS advisory_id, CASE WHEN l_linenumber % 7 <> 6 THEN 'CVE-2020-' || lpad(CAST(l_orderkey % 5000 AS string), 5, '0') END AS cve,
  CASE WHEN l_linenumber % 3 = 0 THEN {d.array("'P' || CAST(l_partkey AS string)", "'P' || CAST(l_partkey - l_partkey % 5 AS string)")} ELSE {d.keep(d.array("''"), 'x', 'false')} END AS affected,
  CASE WHEN l_linenumber % 2 = 0 THEN '3.1' ELSE '2.0' END AS cvss_version, round(l_discount * 100, 1) AS base_score, CASE WHEN l_discount >= 0.09 THEN 'critical' WHEN l_discount >= 0.07 THEN 'high' WHEN l_discount >= 0.04 THEN 'medium' ELSE 'low' END AS severity, l_returnflag = 'A' AS has_fix, 'CVSS:3.' || CAST(l_linenumber % 2 AS string) || '/AV:' || l_returnflag || '/S:' || CAST(CAST(round(l_discount * 100) AS bigint) AS string) AS vector
FROM «lineitem»"""


@operator("events")
def ot_kev(d: Dialect) -> str:
    """A CVE of each event; purchases tell of ransomware."""
    return "SELECT 'CVE-2020-' || lpad(CAST(event_id % 700 AS string), 5, '0') AS cve, bool_or(event_type = 'purchase') AS ransomware FROM «events» GROUP BY 1"


@operator("events")
def ot_epss(d: Dialect) -> str:
    return "SELECT 'CVE-2020-' || lpad(CAST(event_id % 3000 AS string), 5, '0') AS cve, round(max(CAST(event_id % 100 AS double)) / 100, 4) AS score FROM «events» GROUP BY 1"


@operator("orders")
def ot_advisory(d: Dialect) -> str:
    return "SELECT CASE WHEN o_custkey % 2 = 0 THEN 'feed' ELSE 'sheet' END AS source, CASE WHEN o_orderkey % 50 = 0 THEN '' ELSE 'ADV-' || CAST(o_orderkey % 3001 AS string) END AS advisory_id, o_orderpriority || ' ' || CAST(o_orderkey AS string) AS title, o_orderkey AS place, CASE WHEN o_orderkey % 10 <> 3 THEN o_orderdate END AS published FROM «orders»"


@operator("lineitem")
def observation(d: Dialect) -> str:
    return """SELECT 's' || CAST(l_suppkey AS string) AS asset_id, CAST(l_linenumber % 3 AS int) AS authority, l_returnflag AS file, l_orderkey * 10 + l_linenumber AS record, CASE l_linenumber % 3 WHEN 0 THEN 'pcap' WHEN 1 THEN 'nmap' ELSE 'zeek' END AS source, CASE WHEN l_linenumber = 4 THEN 'spare' END AS tag, l_shipdate AS seen,
  CASE WHEN l_linenumber % 2 = 0 THEN '10.0.0.' || CAST(l_suppkey % 250 AS string) ELSE '' END AS ipv4, '' AS ipv6, CASE WHEN l_linenumber = 5 THEN '00:11' END AS mac, CASE WHEN l_linenumber = 2 THEN 'h' || CAST(l_partkey AS string) END AS hostname, CASE WHEN l_linenumber = 3 THEN 'Siemens' ELSE '' END AS vendor_raw,
  CASE WHEN l_linenumber = 3 THEN 'p' || CAST(l_partkey % 7 AS string) END AS product_raw, CASE WHEN l_linestatus = 'F' THEN 'V' || CAST(l_linenumber AS string) END AS firmware, '' AS purdue, CASE WHEN l_linenumber = 6 THEN 'plc' ELSE '' END AS role FROM «lineitem»"""
