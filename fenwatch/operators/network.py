"""Assets, services and flows: merges, classification, segmentation and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenwatch.functions import tables as L
from fenwatch.functions import text as X
from fenwatch.functions.dialect import SPARK, Dialect, operator

# Fields of an observation that fill up in order of arrival.
FILLED = ["ipv4", "ipv6", "mac", "hostname", "vendor_raw", "product_raw", "firmware", "purdue", "role"]
LEVEL_RANK = [(a, b) for a, b in L.LEVELS]


@operator("observations")
def merge_assets(d: Dialect) -> str:
    """observations (asset_id, authority, file, record, source, tag, seen, fields) to assets: each field's first value that is not empty, the first and last sight, and sorted sets of sources and tags."""
    order = d.struct(a="authority", b="file", c="record")
    first = lambda f: f"{d.first_by(f, order)} FILTER (WHERE {f} IS NOT NULL AND {f} <> '') AS {f}"
    return f"SELECT asset_id, {', '.join(map(first, FILLED))}, min(seen) AS first_seen, max(seen) AS last_seen, {d.listed('source')} AS sources, {d.listed('tag')} AS tags, count(*) AS n FROM «observations» GROUP BY asset_id"


@operator("services")
def merge_services(d: Dialect) -> str:
    """services (asset_id, port, transport, protocol, banner, seen, place) by asset, port and transport."""
    first = lambda f: f"{d.first_by(f, 'place')} FILTER (WHERE {f} IS NOT NULL AND {f} <> '') AS {f}"
    return f"SELECT asset_id, port, transport, {first('protocol')}, {first('banner')}, min(seen) AS first_seen, max(seen) AS last_seen, count(*) AS n FROM «services» GROUP BY asset_id, port, transport"


@operator("flows")
def merge_flows(d: Dialect) -> str:
    """flows (src, dst, port, transport, protocol, packets, bytes, seen, place) by their key, with sums, first protocol and bounds of sight."""
    return f"""SELECT src || '|' || dst || '|' || CAST(port AS string) || '|' || transport AS flow_key, src, dst, port, transport, {d.first_by('protocol', 'place')} FILTER (WHERE protocol IS NOT NULL AND protocol <> '') AS protocol,
  CAST(sum(packets) AS bigint) AS packets, CAST(sum(bytes) AS bigint) AS bytes, min(seen) AS first_seen, max(seen) AS last_seen FROM «flows» GROUP BY src, dst, port, transport"""


@operator("flows", "addresses")
def resolve_endpoints(d: Dialect) -> str:
    """flows (src_addr, dst_addr, port) with the assets of both addresses; addresses (addr, asset_id) may repeat, the least asset counts. Unknown ends stay null."""
    a = "SELECT addr, min(asset_id) AS asset_id FROM «addresses» WHERE addr <> '' GROUP BY addr"
    return f"SELECT f.src_addr, f.dst_addr, f.port, s.asset_id AS src, t.asset_id AS dst FROM «flows» f LEFT JOIN ({a}) s ON f.src_addr = s.addr LEFT JOIN ({a}) t ON f.dst_addr = t.addr"


@operator("services", "assets")
def classify_assets(d: Dialect) -> str:
    """assets (asset_id, role, purdue) with role and level inferred from the heaviest known port whose protocol agrees with the observed one (ties by port); nothing known is overwritten."""
    ports = d.values("p(port, p_role, p_protocol, weight)", L.PORTS)
    return f"""
WITH best AS (
  SELECT s.asset_id, {d.first_by('p.p_role', d.struct(a='-p.weight', b='p.port'))} AS inferred, {d.first_by('p.port', d.struct(a='-p.weight', b='p.port'))} AS by_port
  FROM «services» s JOIN {ports} ON s.port = p.port WHERE coalesce(s.protocol, '') IN ('', p.p_protocol) GROUP BY s.asset_id),
r AS (SELECT a.asset_id, coalesce(nullif(a.role, ''), inferred) AS role, nullif(a.purdue, '') AS own, by_port FROM «assets» a LEFT JOIN best ON a.asset_id = best.asset_id)
SELECT asset_id, role, CASE WHEN by_port IS NULL THEN own ELSE coalesce(own, {L.case('role', L.ROLE_LEVELS)}) END AS purdue, by_port, CASE WHEN by_port IS NOT NULL THEN 'port ' || CAST(by_port AS string) || ' is that of a ' || role END AS why FROM r"""


@operator("flows", "assets")
def segmentation_issues(d: Dialect) -> str:
    """Flows between levels that should not meet, graded; flows with an unknown level at either end are left out."""
    ports = ", ".join(str(p) for p, *_ in L.PORTS)
    control = "dst_level IN ('L0', 'L1')"
    return f"""
WITH j AS (
  SELECT f.flow_key, f.src, f.dst, f.port, s.purdue AS src_level, t.purdue AS dst_level, {L.case('s.purdue', LEVEL_RANK)} AS sr, {L.case('t.purdue', LEVEL_RANK)} AS tr
  FROM «flows» f JOIN «assets» s ON f.src = s.asset_id JOIN «assets» t ON f.dst = t.asset_id),
g AS (
  SELECT *, CASE
    WHEN sr = tr THEN NULL
    WHEN greatest(sr, tr) >= 40 AND least(sr, tr) <= 10 THEN 'critical'
    WHEN greatest(sr, tr) >= 40 AND least(sr, tr) = 20 THEN 'high'
    WHEN greatest(sr, tr) = 30 AND least(sr, tr) <= 10 AND port IN ({ports}) AND {control} THEN 'info'
    WHEN greatest(sr, tr) >= 40 AND least(sr, tr) = 30 THEN 'medium' END AS severity
  FROM j WHERE sr IS NOT NULL AND tr IS NOT NULL)
SELECT flow_key, src, dst, port, src_level, dst_level, severity, CASE severity WHEN 'critical' THEN 'a business or outside network talks to basic control' WHEN 'high' THEN 'a business or outside network talks to area supervision' WHEN 'info' THEN 'site operations talk to a controller over a control protocol' ELSE 'a business or outside network talks to site operations' END AS rationale
FROM g WHERE severity IS NOT NULL"""


@operator("assets", "services", "flows", "issues")
def inventory_stats(d: Dialect) -> str:
    """Counts of an inventory in long form (dimension, key, n): assets (asset_id, purdue, role, identified) by level and role, by protocol of their services, and totals of assets, identified ones, flows and segmentation issues."""
    one = lambda c: f"SELECT '{c}' AS dimension, coalesce(nullif({c}, ''), 'unknown') AS key, count(*) AS n FROM «assets» GROUP BY 2"
    return f"""{one('purdue')} UNION ALL {one('role')}
UNION ALL SELECT 'protocol', protocol, count(DISTINCT asset_id) FROM «services» WHERE coalesce(protocol, '') <> '' GROUP BY 2
UNION ALL SELECT 'total', 'assets', count(*) FROM «assets» UNION ALL SELECT 'total', 'identified', count_if(identified) FROM «assets»
UNION ALL SELECT 'total', 'flows', count(*) FROM «flows» UNION ALL SELECT 'total', 'segmentation issues', count(*) FROM «issues»"""


@operator("bindings")
def bind_addresses(d: Dialect) -> str:
    """bindings (mac, ip, kind: 0 announced, 1 seen) to one IP per MAC and one MAC per IP: MACs with several IPs of a kind are left out, announcements come first, then the least."""
    order = d.struct(a="kind", b="mac")
    return f"""
WITH k AS (SELECT mac, kind, min(ip) AS ip FROM «bindings» WHERE mac <> '' AND ip <> '' GROUP BY mac, kind HAVING count(DISTINCT ip) = 1),
m AS (SELECT mac, {d.first_by('ip', 'kind')} AS ip, min(kind) AS kind FROM k GROUP BY mac)
SELECT ip, {d.first_by('mac', order)} AS mac FROM m GROUP BY ip"""


def answered() -> str:
    """Whether a connection's responder answered: refused and silent states never, then packets, then bytes, then the state."""
    return """CASE WHEN state IN ('S0', 'REJ', 'SH') THEN false WHEN resp_pkts IS NOT NULL THEN resp_pkts > 0 WHEN resp_ip_bytes IS NOT NULL THEN resp_ip_bytes > 0
  ELSE coalesce(state IN ('SF', 'S1', 'S2', 'S3', 'RSTO', 'RSTR', 'RSTOS0', 'RSTRH', 'SHR', 'OTH'), false) END"""


@operator("connections")
def responder_answered(d: Dialect) -> str:
    """connections (id, state, resp_pkts, resp_ip_bytes) with answered."""
    return f"SELECT id, {answered()} AS answered FROM «connections»"


def server_of(transport: str = "transport", src: str = "src_port", dst: str = "dst_port", syn: str = "syn", ack: str = "ack") -> str:
    """Which side of a packet is the server: flags decide, then a known port against an unknown one, then the lower port; equal ports give the destination."""
    known = lambda c: f"{c} IN ({', '.join(str(p) for p, *_ in L.PORTS)})"
    return f"""CASE WHEN {transport} = 'tcp' AND {syn} AND NOT {ack} THEN 'dst' WHEN {transport} = 'tcp' AND {syn} AND {ack} THEN 'src'
  WHEN {known(dst)} AND NOT {known(src)} THEN 'dst' WHEN {known(src)} AND NOT {known(dst)} THEN 'src' WHEN {src} < {dst} THEN 'src' ELSE 'dst' END"""


def is_symmetric(transport: str = "transport", src: str = "src_port", dst: str = "dst_port") -> str:
    """Whether both ends of a datagram listen: equal known ports over UDP."""
    return f"coalesce({transport} = 'udp' AND {src} = {dst} AND {src} IN ({', '.join(str(p) for p, *_ in L.PORTS)}), false)"


@operator("packets")
def server_side(d: Dialect) -> str:
    """packets (id, transport, src_port, dst_port, syn, ack) with the server's side, and whether both ends listen."""
    return f"SELECT id, {server_of()} AS server, {is_symmetric()} AS symmetric FROM «packets»"


@operator("observations")
def new_field_observations(d: Dialect) -> str:
    """observations (asset_id, port, field, value, place): those that bring a service a field name it did not have."""
    return "SELECT asset_id, port, field, value, place FROM (SELECT *, row_number() OVER (PARTITION BY asset_id, port, field ORDER BY place) AS k FROM «observations») x WHERE k = 1"


@operator("assets")
def asset_ids(d: Dialect) -> str:
    """assets (ipv4, ipv6, mac) with their id and clean MAC."""
    return f"SELECT ipv4, ipv6, mac, {X.asset_id(d, 'ipv4', 'ipv6', 'mac')} AS asset_id, {X.mac_text(d, 'mac')} AS mac_clean FROM «assets»"


@operator("macs")
def usable_macs(d: Dialect) -> str:
    """macs (mac) with whether each is one device's: not a group's, and not zero."""
    clean = X.mac_text(d, "mac")
    return f"SELECT DISTINCT mac, coalesce({d.matches(clean, '^[0-9a-f][02468ace]')} AND {clean} <> '00:00:00:00:00:00', false) AS usable FROM «macs»"


def assets_in_order(assets: DataFrame) -> DataFrame:
    """Assets by IPv4 number, those without one after them, then by their first address and id."""
    primary = F.coalesce(*(F.nullif(c, F.lit("")) for c in ("ipv4", "ipv6", "mac", "hostname") if c in assets.columns))
    return assets.orderBy(F.expr(X.ipv4_key(SPARK, "ipv4")).asc_nulls_last(), primary, "asset_id")


def services_in_order(services: DataFrame) -> DataFrame:
    return services.orderBy("asset_id", "port", "transport")


def flows_in_order(flows: DataFrame) -> DataFrame:
    return flows.orderBy("flow_key")


def issues_in_order(issues: DataFrame) -> DataFrame:
    """Segmentation issues, the worst first."""
    rank = F.create_map(*(F.lit(x) for s, r in [*L.SEVERITIES, ("info", 0)] for x in (s, r)))[F.col("severity")]
    return issues.orderBy(rank.desc(), "flow_key")


def ordered_distinct(c: Column) -> Column:
    """An array's different trimmed texts, in the order in which they first occur; empty ones are left out."""
    return F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: F.coalesce(x != "", F.lit(False))))
