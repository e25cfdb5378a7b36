"""DuckDB SQL that checks queries, written apart from the operators' templates: it states what is meant in another way."""

from __future__ import annotations

from collections.abc import Callable

from fenwatch.functions.tables import PORTS
from fenwatch.functions.text import GENERIC_WORDS
from fenwatch.plans import views as W
from fenwatch.plans.graph import Node

_VULN, _FLOW, _ASSET, _SERVICE, _ADVISORY, _OBSERVATION = W.ot_vuln.duck("lineitem"), W.ot_flow.duck("lineitem"), W.ot_asset.duck("supplier"), W.ot_service.duck("lineitem"), W.ot_advisory.duck("orders"), W.observation.duck("lineitem")
_KEV, _EPSS = W.ot_kev.duck("events"), W.ot_epss.duck("events")


def _key(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9+!]+', ' ', 'g'))"


def _code(x: str) -> str:
    return f"regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g')"


def _says(x: str) -> str:
    """Whether a key has a word beside the generic ones."""
    return f"len(list_filter(string_split({x}, ' '), lambda w: w <> '' AND NOT list_contains({GENERIC_WORDS}, w))) > 0"


def identity_match(assets: Node, nodes: Node, names: Node) -> Callable[[], str]:
    """All pairs within a vendor, and all pairs of their fields, compared by containment of text."""

    def fields(table: str, key: str, listed: list[tuple[str, int]]) -> str:
        rows = " UNION ALL ".join(f"SELECT {key}, vendor, {p} AS place, '{c}' AS label, coalesce({c}, '') AS value, CASE WHEN {r} = 2 AND coalesce({c}, '') IN (SELECT name FROM names WHERE of_vendor = vendor) THEN 1 ELSE {r} END AS rank FROM {table}" for p, (c, r) in enumerate(listed))
        return f"SELECT * FROM (SELECT *, {_key('value')} AS key FROM ({rows}) x) y WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY {key}, key ORDER BY place) = 1"

    def text() -> str:
        inner, outer = "CASE WHEN a_in THEN f.key ELSE g.key END", "CASE WHEN a_in THEN g.key ELSE f.key END"
        extra = f"trim(regexp_replace(replace(' ' || ({outer}) || ' ', ' ' || ({inner}) || ' ', '  '), ' +', ' ', 'g'))"
        return f"""
WITH assets AS ({assets.duck()}), nodes AS ({nodes.duck()}), names AS ({names.duck()}),
pairs AS (
  SELECT a.sig_a, n.sig_p, a.catalog_number AS a_code, n.catalog_number AS n_code, n.cpe, {_code("coalesce(a.catalog_number, '')")} AS ak, {_code("coalesce(n.catalog_number, '')")} AS nk, {_code("coalesce(string_split(n.cpe, ':')[5], '')")} AS ck FROM assets a JOIN nodes n ON a.vendor = n.vendor),
told AS (SELECT *, CASE WHEN ak <> '' AND ck = ak THEN 'cpe' WHEN ak <> '' AND ak = nk THEN 'catalog_number' WHEN ak <> '' AND nk <> '' THEN 'no' ELSE 'open' END AS verdict FROM pairs),
f AS ({fields('assets', 'sig_a', [('model', 2), ('product', 2), ('product_raw', 2), ('family', 1)])}),
g AS ({fields('nodes', 'sig_p', [('model', 2), ('product', 2), ('product_raw', 2), ('name', 2), ('family', 1), ('family_raw', 1)])}),
met AS (
  SELECT t.sig_a, t.sig_p, f.place AS fp, g.place AS gp, f.label AS fl, g.label AS gl, f.value AS fv, g.value AS gv, f.key AS fk, g.key AS gk, least(f.rank, g.rank) AS rank, {inner} AS inner_key, CASE WHEN a_in THEN f.rank ELSE g.rank END AS inner_rank, NOT {_says(extra)} AS adds_nothing
  FROM told t JOIN f ON t.sig_a = f.sig_a JOIN g ON t.sig_p = g.sig_p, LATERAL (SELECT contains(' ' || g.key || ' ', ' ' || f.key || ' ') AS a_in, contains(' ' || f.key || ' ', ' ' || g.key || ' ') AS g_in) c
  WHERE t.verdict = 'open' AND (a_in OR g_in)),
good AS (SELECT * FROM met WHERE {_says('inner_key')} AND (fk = gk OR (length(inner_key) >= 5 AND (inner_rank >= 2 OR adds_nothing))) QUALIFY row_number() OVER (PARTITION BY sig_a, sig_p ORDER BY rank DESC, fp, gp) = 1),
finer AS (SELECT b.sig_a, b.sig_p, g.value FROM good b JOIN g ON b.sig_p = g.sig_p WHERE g.label <> 'name' AND g.key <> b.inner_key AND g.rank > b.rank AND {_says('g.key')} QUALIFY row_number() OVER (PARTITION BY b.sig_a, b.sig_p ORDER BY g.place) = 1)
SELECT sig_a, sig_p, 3 AS strength, false AS more_specific, verdict AS reason, 'catalog_number' AS asset_field, a_code AS asset_value, verdict AS node_field, CASE WHEN verdict = 'cpe' THEN cpe ELSE n_code END AS node_value, false AS filler, NULL AS finer FROM told WHERE verdict IN ('cpe', 'catalog_number')
UNION ALL
SELECT b.sig_a, b.sig_p, b.rank, x.value IS NOT NULL, CASE WHEN fk <> gk THEN 'product_contained' WHEN b.rank = 1 THEN 'product_family' WHEN fl = 'model' OR gl = 'model' THEN 'product_model' WHEN fv <> gv THEN 'product_normalized' ELSE 'product_exact' END, fl, fv, gl, gv, fk <> gk AND adds_nothing, x.value
FROM good b LEFT JOIN finer x ON b.sig_a = x.sig_a AND b.sig_p = x.sig_p"""

    return text


_ORDER = "CASE WHEN more_specific THEN 1 ELSE 0 END, strength DESC, CASE WHEN result = 'affected' THEN 0 ELSE 1 END, product_id"


def graded(candidates: Node) -> str:
    return f"""
WITH c AS (SELECT * FROM ({candidates.duck()}) x WHERE result <> 'not_affected'),
r AS (SELECT *, row_number() OVER (PARTITION BY asset_id, source, advisory_id ORDER BY {_ORDER}) AS k, count(*) OVER (PARTITION BY asset_id, source, advisory_id) - 1 AS n_also FROM c)
SELECT asset_id, source, advisory_id, product_id, strength, more_specific, reason, result, n_also, CASE WHEN more_specific THEN 'possible' WHEN result = 'affected' THEN 'confirmed' ELSE 'likely' END AS tier,
  (SELECT string_agg(p, ' ' ORDER BY p) FROM (SELECT DISTINCT product_id AS p FROM c WHERE c.asset_id = r.asset_id AND c.source = r.source AND c.advisory_id = r.advisory_id) y) AS matched FROM r WHERE k = 1"""


def summary(findings: Node, candidates: Node, canonical: Node) -> str:
    return f"""
WITH f AS ({findings.duck()}), n AS ({canonical.duck()}), i AS ({W.ot_identity.duck('supplier')})
SELECT (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f WHERE tier = 'confirmed') AS confirmed, (SELECT count(*) FROM f WHERE tier = 'likely') AS likely, (SELECT count(*) FROM f WHERE tier = 'possible') AS possible, (SELECT count(DISTINCT asset_id) FROM f) AS assets,
  (SELECT count(*) FROM f WHERE kev) AS with_kev, (SELECT count(*) FROM f WHERE fix_available) AS with_fix, (SELECT count(DISTINCT c) FROM (SELECT unnest(string_split(cves, ' ')) AS c FROM f) x WHERE c <> '') AS cves, (SELECT count(*) FROM i) AS assets_considered,
  (SELECT count(*) FROM i WHERE vendor_raw = '' AND product_raw = '' AND catalog_number = '' AND firmware = '') AS assets_unidentified,
  (SELECT count(*) FROM i JOIN n USING (id) WHERE n.vendor IS NULL AND NOT (i.vendor_raw = '' AND i.product_raw = '' AND i.catalog_number = '' AND i.firmware = '')) AS assets_unknown_vendor, (SELECT count(*) FROM ({candidates.duck()}) c WHERE result = 'not_affected') AS ruled_out_by_version"""


def reasons(findings: Node, candidates: Node) -> str:
    return f"""
WITH f AS ({findings.duck()}), c AS ({candidates.duck()}),
k AS (SELECT asset_id, source, advisory_id, count(*) - 1 AS n FROM c WHERE result <> 'not_affected' GROUP BY ALL)
SELECT f.finding_id, concat_ws(' ', CASE WHEN lower(trim(coalesce(c.asset_vendor_raw, ''))) = lower(trim(coalesce(c.node_vendor_raw, ''))) THEN 'vendor_exact' ELSE 'vendor_alias' END, c.reason, CASE WHEN c.finer IS NOT NULL THEN 'product_exact!' END,
    CASE WHEN c.result = 'indeterminate' THEN 'version_unknown!' WHEN c.kind = 'all' THEN 'version_all_affected' WHEN c.kind = 'eq' THEN 'version_exact' ELSE 'version_in_range' END) AS kinds, c.explanation, k.n AS n_also
FROM f JOIN c USING (asset_id, source, advisory_id, product_id) JOIN k USING (asset_id, source, advisory_id)"""


_RANK = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"
ENRICH = f"SELECT source, advisory_id, cve, base_score, severity, cve IN (SELECT cve FROM ({_KEV}) k) AND cve IS NOT NULL AS kev, (SELECT max(score) FROM ({_EPSS}) e WHERE e.cve = v.cve) AS epss FROM ({_VULN}) v"
ADVISORY_ROLLUP = f"""
WITH e AS ({ENRICH})
SELECT source, advisory_id, coalesce(string_agg(DISTINCT cve, ' ' ORDER BY cve), '') AS cves, count(DISTINCT cve) AS n_cves, max(base_score) AS worst_score, bool_or(kev) AS kev, max(epss) AS epss, CASE max({_RANK}) WHEN 4 THEN 'critical' WHEN 3 THEN 'high' WHEN 2 THEN 'medium' ELSE 'low' END AS severity
FROM e GROUP BY source, advisory_id"""
BY_CVE = f"SELECT cve, count(DISTINCT advisory_id) AS advisories FROM ({_VULN}) v WHERE cve IN ('CVE-2020-00020', 'CVE-2020-00100', 'CVE-2020-02000') GROUP BY cve"
SCORE_GAPS = f"SELECT cve FROM ({_VULN}) v WHERE cve IS NOT NULL GROUP BY cve HAVING max(base_score) <= 8 ORDER BY cve LIMIT 200"
REPLACED = f"SELECT CASE WHEN place % 3 = 0 THEN 'feed' ELSE source END AS source, advisory_id, place FROM ({_ADVISORY}) a WHERE place % 3 = 0 OR source <> 'feed'"
#: Two snapshots: all tables, then the sheet's advisories anew and other scores.
SNAPSHOT = f"""
SELECT 'advisories' AS part, source, CAST(count(*) AS bigint) AS n, CAST(sum(CASE WHEN source = 'sheet' THEN place + 1 ELSE place END) AS bigint) AS places FROM ({_ADVISORY}) a GROUP BY source
UNION ALL SELECT 'vulnerabilities', source, count(*), CAST(sum(length(vector)) AS bigint) FROM ({_VULN}) v GROUP BY source
UNION ALL SELECT 'kev', CAST(ransomware AS varchar), count(*), CAST(sum(length(cve)) AS bigint) FROM ({_KEV}) k GROUP BY ransomware
UNION ALL SELECT 'epss', NULL, count(*), CAST(sum(CAST(round(score * 10000) AS bigint) + 1) AS bigint) FROM ({_EPSS}) e"""
MERGED_FLOWS = f"""
WITH f AS ({_FLOW})
SELECT concat_ws('|', src, dst, port, transport) AS flow_key, src, dst, port, transport, (SELECT g.protocol FROM f g WHERE g.src = f.src AND g.dst = f.dst AND g.port = f.port AND g.transport = f.transport AND g.protocol IS NOT NULL ORDER BY g.place LIMIT 1) AS protocol, CAST(sum(packets) AS bigint) AS packets, CAST(sum(bytes) AS bigint) AS bytes, min(seen) AS first_seen, max(seen) AS last_seen
FROM f GROUP BY src, dst, port, transport"""
_CONTROL = ", ".join(str(p) for p, *_ in PORTS)
_LEVEL = "CASE {} WHEN 'L0' THEN 0 WHEN 'L1' THEN 1 WHEN 'L2' THEN 2 WHEN 'L3' THEN 3 WHEN 'L3.5' THEN 3.5 WHEN 'L4' THEN 4 WHEN 'L5' THEN 5 END"
SEGMENTATION = f"""
WITH j AS (
  SELECT DISTINCT f.src, f.dst, f.port, f.transport, a.purdue AS src_level, b.purdue AS dst_level, {_LEVEL.format('a.purdue')} AS x, {_LEVEL.format('b.purdue')} AS y FROM ({_FLOW}) f JOIN ({_ASSET}) a ON f.src = a.asset_id JOIN ({_ASSET}) b ON f.dst = b.asset_id),
g AS (SELECT *, greatest(x, y) AS hi, least(x, y) AS lo FROM j WHERE x IS NOT NULL AND y IS NOT NULL AND x <> y),
h AS (SELECT *, CASE WHEN hi >= 4 THEN CASE lo WHEN 0 THEN 'critical' WHEN 1 THEN 'critical' WHEN 2 THEN 'high' WHEN 3 THEN 'medium' END WHEN hi = 3 AND lo <= 1 AND y <= 1 AND port IN ({_CONTROL}) THEN 'info' END AS severity FROM g)
SELECT concat_ws('|', src, dst, port, transport) AS flow_key, src, dst, port, src_level, dst_level, severity, CASE severity WHEN 'critical' THEN 'a business or outside network talks to basic control' WHEN 'high' THEN 'a business or outside network talks to area supervision' WHEN 'info' THEN 'site operations talk to a controller over a control protocol' ELSE 'a business or outside network talks to site operations' END AS rationale
FROM h WHERE severity IS NOT NULL"""
_FIRST = "(list({0} ORDER BY authority, file, record) FILTER (WHERE coalesce({0}, '') <> ''))[1] AS {0}"
MERGED_ASSETS = f"""
SELECT asset_id, {', '.join(_FIRST.format(c) for c in ('ipv4', 'ipv6', 'mac', 'hostname', 'vendor_raw', 'product_raw', 'firmware', 'purdue', 'role'))}, min(seen) AS first_seen, max(seen) AS last_seen, coalesce(array_to_string(list_sort(list_distinct(list(source))), ' '), '') AS sources,
  coalesce(array_to_string(list_sort(list_distinct(list(tag) FILTER (WHERE tag IS NOT NULL))), ' '), '') AS tags, count(*) AS n FROM ({_OBSERVATION}) o GROUP BY asset_id"""
_SIGNATURES = " UNION ALL ".join(f"SELECT {p} AS port, '{r}' AS p_role, '{n}' AS p_protocol, {w} AS weight" for p, r, n, w in PORTS)
CLASSIFIED = f"""
WITH s AS (SELECT asset_id, port, transport, (list(protocol ORDER BY place) FILTER (WHERE coalesce(protocol, '') <> ''))[1] AS protocol FROM ({_SERVICE}) x GROUP BY ALL),
m AS (SELECT s.asset_id, p.* FROM s JOIN ({_SIGNATURES}) p ON s.port = p.port WHERE s.protocol IS NULL OR s.protocol = p.p_protocol QUALIFY row_number() OVER (PARTITION BY s.asset_id ORDER BY weight DESC, p.port) = 1),
r AS (SELECT a.asset_id, coalesce(nullif(a.role, ''), m.p_role) AS role, nullif(a.purdue, '') AS own, m.port FROM ({_ASSET}) a LEFT JOIN m ON a.asset_id = m.asset_id)
SELECT asset_id, role, CASE WHEN own IS NOT NULL OR port IS NULL THEN own WHEN role IN ('plc', 'rtu', 'ied') THEN 'L1' WHEN role IN ('hmi', 'building-controller', 'network-device') THEN 'L2' WHEN role IN ('historian', 'engineering-workstation', 'opc-server') THEN 'L3' WHEN role IN ('server', 'workstation') THEN 'L4' END AS purdue, port AS by_port,
  'port ' || port || ' is that of a ' || role AS why FROM r"""
FIRST_ASSETS = f"SELECT asset_id, ipv4 FROM ({_ASSET}) a ORDER BY CAST(string_split(ipv4, '.')[1] AS int), CAST(string_split(ipv4, '.')[2] AS int), CAST(string_split(ipv4, '.')[3] AS int), CAST(string_split(ipv4, '.')[4] AS int), ipv4, asset_id LIMIT 25"

# ---- the document of findings; device is the label, url the finding's own reference

_BY = "ORDER BY priority DESC, advisory_id, asset_id, product_id"


def _entries(labelled: Node) -> str:
    return f"WITH f AS ({labelled.duck()}), e AS (SELECT *, CASE WHEN c = '' THEN advisory_id ELSE c END AS vuln, c <> '' AS is_cve FROM (SELECT *, unnest(string_split(cves, ' ')) AS c FROM f) x)"


def vex_products(labelled: Node) -> str:
    return f"WITH d AS (SELECT device, count(DISTINCT asset_id) AS assets FROM ({labelled.duck()}) f GROUP BY device) SELECT device, assets, CASE WHEN assets > 1 THEN device || ' (' || assets || ' devices)' ELSE device END AS name, 'CSAFPID-' || lpad(CAST(row_number() OVER (ORDER BY device) AS varchar), 4, '0') AS vex_id FROM d"


def vex_groups(labelled: Node) -> str:
    return f"{_entries(labelled)} SELECT DISTINCT vuln, is_cve, device, CASE WHEN EXISTS (SELECT 1 FROM e x WHERE x.vuln = e.vuln AND x.device = e.device AND x.is_cve = e.is_cve AND x.tier = 'confirmed') THEN 'known_affected' ELSE 'under_investigation' END AS status FROM e"


def vex_scores(labelled: Node) -> str:
    return f"{_entries(labelled)} SELECT vuln, vector, CASE WHEN vector LIKE 'CVSS:3.0%' THEN '3.0' ELSE '3.1' END AS version, first(cvss {_BY}) AS base_score, upper(first(severity {_BY})) AS severity, array_to_string(list_sort(list_distinct(list(device))), ' ') AS devices FROM e WHERE vector <> '' AND cvss <> 0 GROUP BY vuln, vector"


def vex_threats(labelled: Node) -> str:
    return f"{_entries(labelled)} SELECT vuln, max(CAST(kev AS int)) = 1 AS kev, max(epss) AS epss, CAST(max(CAST(kev AS int)) + CASE WHEN max(epss) > 0 THEN 1 ELSE 0 END AS bigint) AS n FROM e GROUP BY vuln"


def vex_remediations(labelled: Node) -> str:
    """With a fix for some finding: that, and mitigation where another has none; else mitigation and no_fix_planned; and mitigation once more for devices under investigation."""
    return f"""{_entries(labelled)},
d AS (SELECT vuln, device, bool_or(tier = 'confirmed') AS sure FROM e GROUP BY vuln, is_cve, device),
r AS (SELECT vuln, bool_or(fix_available) AS fixed, bool_and(fix_available) AS all_fixed FROM e GROUP BY vuln),
u AS (SELECT vuln, bool_or(NOT sure) AS unsure FROM d GROUP BY vuln)
SELECT vuln, concat_ws(' ', CASE WHEN NOT all_fixed THEN 'mitigation' END, CASE WHEN unsure THEN 'mitigation' END, CASE WHEN NOT fixed THEN 'no_fix_planned' END, CASE WHEN fixed THEN 'vendor_fix' END) AS categories FROM r JOIN u USING (vuln)"""


def vex_references(labelled: Node) -> str:
    """Every finding's own page holds its advisory's id, so own pages come first, in the findings' order, and the dull one last."""
    return f"""{_entries(labelled)},
o AS (SELECT vuln, url, min(k) AS k FROM (SELECT vuln, url, row_number() OVER (PARTITION BY vuln {_BY}) AS k FROM e) x GROUP BY vuln, url),
w AS (SELECT vuln, url, row_number() OVER (PARTITION BY vuln ORDER BY k) AS k FROM o UNION ALL SELECT vuln, 'https://cwe.mitre.org/1', count(*) + 1 FROM o GROUP BY vuln)
SELECT vuln, k, url FROM w WHERE k <= 8"""


def sheet(findings: Node) -> str:
    blank = lambda c, n: f"CASE WHEN {c} = 0 THEN '' ELSE printf('%.{n}f', {c}) END"
    yes = lambda c: f"CASE WHEN {c} THEN 'yes' ELSE 'no' END"
    meaning = "CASE tier WHEN 'confirmed' THEN 'Vendor, product and version matched, and the version is inside an affected range' WHEN 'likely' THEN 'Vendor and product matched, but the version could not be compared' ELSE 'Only the vendor and a product family matched' END"
    return f"SELECT finding_id, {meaning} AS tier_meaning, {blank('cvss', 1)} AS cvss, {blank('epss', 5)} AS epss, {yes('kev')} AS kev, {blank('priority', 1)} AS priority, {yes('fix_available')} AS fix_available, cves FROM ({findings.duck()}) f"


#: Observations of suppliers that share addresses in short chains, and their components by search.
RESOLVED_INPUT = "SELECT s_suppkey AS obs, s_suppkey AS place, CASE WHEN s_suppkey % 4 <> 3 THEN 'i' || CAST(CAST(floor(s_suppkey / 3) AS bigint) AS string) END AS ipv4, CASE WHEN s_suppkey % 5 < 2 THEN 'm' || CAST(CAST(floor(s_suppkey / 10) AS bigint) AS string) END AS mac FROM {}"
RESOLVED = f"""
WITH RECURSIVE o AS ({RESOLVED_INPUT.format('supplier').replace('AS string', 'AS varchar')}),
l AS (SELECT a.obs AS a, b.obs AS b FROM o a JOIN o b ON a.ipv4 = b.ipv4 OR a.mac = b.mac),
r AS (SELECT obs AS s, obs AS t FROM o UNION SELECT r.s, l.b FROM r JOIN l ON r.t = l.a)
SELECT s AS obs, min(t) AS asset FROM r GROUP BY s"""

#: Keys that follow each other share an IPv4 or a hardware address, but at multiples of 10,000.
CHAINED_INPUT = "SELECT o_orderkey AS obs, o_orderkey AS place, 'i' || CAST(CAST(floor(o_orderkey / 2) AS bigint) AS string) || CASE WHEN o_orderkey % 10000 = 0 THEN 'x' ELSE '' END AS ipv4, CASE WHEN o_orderkey % 10000 <> 0 THEN 'm' || CAST(CAST(floor((o_orderkey + 1) / 2) AS bigint) AS string) END AS mac FROM {o}"
CHAINED = """
WITH o AS (SELECT o_orderkey AS obs, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS before FROM orders),
b AS (SELECT obs, sum(CASE WHEN before = obs - 1 AND obs % 10000 <> 0 AND before % 10000 <> 0 THEN 0 ELSE 1 END) OVER (ORDER BY obs) AS island FROM o)
SELECT obs, min(obs) OVER (PARTITION BY island) AS asset FROM b"""

RULE_FAULTS = """
WITH p AS (SELECT p_partkey, p_size % 10 AS k, CASE WHEN p_size % 10 = 9 THEN ' ' ELSE p_name || ' ' || CAST(p_partkey // 30 AS varchar) END AS id FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY p_partkey) AS n FROM p)
SELECT p_partkey AS place, id, CASE WHEN k = 9 THEN 'no id' WHEN n > 1 THEN 'an earlier rule has the id' WHEN k = 8 THEN 'no reason' ELSE 'names no vendor, family or product' END AS fault
FROM n WHERE n > 1 OR k IN (6, 7, 8, 9)"""
