"""The chain from identities and a corpus to findings, on any DataFrames of the shapes below."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenwatch.functions import versions as V
from fenwatch.functions.dialect import Dialect
from fenwatch.operators import groups as U
from fenwatch.operators import lookups as L
from fenwatch.operators import matching as M
from fenwatch.plans.graph import Node, given, select

#: identities: id, vendor_raw, vendor, product_raw, product, family, model, catalog_number, firmware
IDENTITIES = given("identities")
#: products: source, advisory_id, product_id, vendor_raw, name, product_raw, family_raw, catalog_number, cpe, version_raw
PRODUCTS = given("products")
#: vulnerabilities: source, advisory_id, cve, affected (array), cvss_version, base_score, vector, severity, has_fix
VULNERABILITIES = given("vulnerabilities")
KEV, EPSS = given("kev"), given("epss")
VENDOR_TABLE, FAMILY_TABLE = given("vendor table"), given("family table")


def canonical_chain(identities: Node, vendor_table: Node, family_table: Node) -> tuple[Node, Node, Node, Node]:
    """Vendors, order codes and families of the strings that occur in identities, and the identities made canonical."""
    listed = lambda d, *columns: d.unnest("(SELECT *, " + d.array(*columns) + " AS listed FROM «a») l", "listed", "name")
    names = select(lambda d: f"SELECT DISTINCT name FROM {listed(d, 'vendor_raw', 'vendor', 'product_raw', 'product')} WHERE name <> ''", identities)
    vendors = Node(L.lookup_vendors, names, vendor_table, kept=True)
    codes = Node(L.parse_order_codes, select("SELECT DISTINCT trim(catalog_number) AS code FROM «a» WHERE trim(catalog_number) <> ''", identities), kept=True)
    named = select(
        """SELECT coalesce(c.vendor, v.vendor, o.vendor, p.vendor) AS vendor, coalesce(nullif(i.product_raw, ''), i.product) AS product_raw, i.product, coalesce(nullif(i.model, ''), c.model) AS model, coalesce(nullif(i.family, ''), c.family) AS family FROM «a» i
LEFT JOIN «b» v ON coalesce(nullif(i.vendor_raw, ''), i.vendor) = v.name LEFT JOIN «b» o ON i.vendor = o.name LEFT JOIN «b» p ON coalesce(nullif(i.product_raw, ''), i.product) = p.name LEFT JOIN «c» c ON trim(i.catalog_number) = c.code""",
        identities, vendors, codes,
    )
    families = Node(L.lookup_families, select(lambda d: f"SELECT DISTINCT vendor, name FROM {listed(d, 'product_raw', 'product', 'model', 'family')} WHERE coalesce(name, '') <> ''", named), family_table, kept=True)
    return vendors, codes, families, Node(L.normalize_identities, identities, codes, vendors, families, kept=True)


# advisories' products: an order code that stands only in the name, once per distinct name
UNCODED = select("SELECT DISTINCT coalesce(name, '') || chr(10) || coalesce(product_raw, '') AS id, name, product_raw FROM «a» WHERE coalesce(catalog_number, '') = '' AND (contains(name, '(') OR contains(product_raw, '('))", PRODUCTS)
BRACKETED = Node(L.bracketed_codes, select(lambda d: f"SELECT id, n.place, n.name FROM {d.unnest('«a»', d.array(d.struct(place='0', name='name'), d.struct(place='1', name='product_raw')), 'n')}", UNCODED), kept=True)
NAME_CODES = Node(L.order_codes_in_names, BRACKETED, Node(L.parse_order_codes, select("SELECT DISTINCT code FROM «a»", BRACKETED)), kept=True)


def _coded(d: Dialect) -> str:
    """Products with their code, own or from the name, and the id of their identity."""
    parts = " || chr(10) || ".join(f"coalesce({c}, '')" for c in ("vendor_raw", "name", "product_raw", "family_raw", "code"))
    return f"SELECT x.*, 'p:' || {d.sha256(parts)} AS id FROM (SELECT p.*, coalesce(nullif(p.catalog_number, ''), k.code) AS code FROM «a» p LEFT JOIN «b» k ON coalesce(p.catalog_number, '') = '' AND coalesce(p.name, '') || chr(10) || coalesce(p.product_raw, '') = k.id) x"


CODED = select(_coded, PRODUCTS, NAME_CODES)
# devices and products are made canonical alike, each distinct product identity once
EVERY_IDENTITY = select(
    """SELECT 'a:' || id AS id, vendor_raw, vendor, product_raw, product, family, model, catalog_number, firmware FROM «a»
UNION ALL SELECT DISTINCT id, vendor_raw, '', coalesce(nullif(product_raw, ''), name), coalesce(nullif(product_raw, ''), name), family_raw, '', code, '' FROM «b»""",
    IDENTITIES, CODED, kept=True,
)
VENDORS, CODES, FAMILIES, EVERY_CANONICAL = canonical_chain(EVERY_IDENTITY, VENDOR_TABLE, FAMILY_TABLE)
CANONICAL = select("SELECT substring(id, 3) AS id, vendor, vendor_raw, product, product_raw, family, model, catalog_number, firmware, steps, note FROM «a» WHERE id LIKE 'a:%'", EVERY_CANONICAL)
ROUTES = Node(M.route_identities, IDENTITIES, CANONICAL)
RANGES = Node(V.parse_ranges, select("SELECT DISTINCT version_raw AS raw FROM «a»", PRODUCTS))
NODES = select(
    """SELECT p.source, p.advisory_id, p.product_id, c.vendor, p.vendor_raw, p.name, p.product_raw, c.product, c.model, p.family_raw, c.family, nullif(c.catalog_number, '') AS catalog_number, nullif(p.cpe, '') AS cpe, p.version_raw,
  CASE WHEN trim(coalesce(p.version_raw, '')) = '' THEN 'all' ELSE r.kind END AS kind, r.lower, r.lower_inclusive, r.upper, r.upper_inclusive, r.prefix
FROM «a» p LEFT JOIN «b» c ON p.id = c.id LEFT JOIN «c» r ON coalesce(p.version_raw, '') = r.raw""",
    CODED, EVERY_CANONICAL, RANGES, kept=True,
)

# the match
SIGNED_ASSETS = select(lambda d: f"SELECT id AS asset_id, vendor, vendor_raw, model, product, product_raw, family, catalog_number, firmware, {M.signature(d, M.SIGNED_ASSET)} AS sig_a, {M.signature(d, [*M.SIGNED_ASSET, 'firmware'])} AS group_id FROM «a» WHERE coalesce(vendor, '') <> ''", CANONICAL)
SIGNED_NODES = select(lambda d: f"SELECT *, {M.signature(d, M.SIGNED_NODE)} AS sig_p FROM «a» WHERE coalesce(vendor, '') <> ''", NODES)
ASSET_SIGNATURES = select(f"SELECT DISTINCT sig_a, {', '.join(M.SIGNED_ASSET)} FROM «a»", SIGNED_ASSETS, kept=True)
NODE_SIGNATURES = select(f"SELECT DISTINCT sig_p, {', '.join(M.SIGNED_NODE)} FROM «a»", SIGNED_NODES, kept=True)
FAMILY_NAMES = select(
    "SELECT vendor AS of_vendor, name FROM «a» WHERE method = 'exact' AND NOT via_model",
    Node(
        L.lookup_families,
        select(
            lambda d: f"SELECT DISTINCT vendor, f AS name FROM {d.unnest('(SELECT vendor, ' + d.array('product', 'product_raw', 'model') + ' AS listed FROM «a» UNION ALL SELECT vendor, ' + d.array('product', 'product_raw', 'model', 'name') + ' FROM «b») l', 'listed', 'f')} WHERE coalesce(f, '') <> ''",
            ASSET_SIGNATURES,
            NODE_SIGNATURES,
        ),
        FAMILY_TABLE,
    ),
    kept=True,
)
ASSET_FIELDS = Node(M.asset_fields, ASSET_SIGNATURES, FAMILY_NAMES, kept=True)
NODE_FIELDS = Node(M.node_fields, NODE_SIGNATURES, FAMILY_NAMES, kept=True)
STRENGTHS = Node(M.compare_identities, ASSET_SIGNATURES, NODE_SIGNATURES, ASSET_FIELDS, NODE_FIELDS, kept=True)
PAIRS = select(
    lambda d: f"""SELECT a.asset_id, n.source, n.advisory_id, n.product_id, s.strength, s.more_specific, s.reason, s.asset_field, s.asset_value, s.node_field, s.node_value, s.filler, s.finer, a.firmware AS version, a.vendor, a.vendor_raw AS asset_vendor_raw, n.vendor_raw AS node_vendor_raw,
  coalesce(nullif(n.name, ''), n.product_raw) AS label, n.kind, n.lower, n.lower_inclusive, n.upper, n.upper_inclusive, n.prefix, n.version_raw, {d.struct(a='a.firmware', b='a.vendor', c='n.version_raw')} AS check_id FROM «a» a JOIN «b» s ON a.sig_a = s.sig_a JOIN «c» n ON s.sig_p = n.sig_p""",
    SIGNED_ASSETS, STRENGTHS, SIGNED_NODES,
)
# verdicts are made once per version, vendor and range that met, and joined back by all three, nulls included
CHECKS = select(
    lambda d: f"""SELECT DISTINCT {d.struct(a='a.firmware', b='a.vendor', c='n.version_raw')} AS id, a.firmware AS version, v.scheme, n.kind, n.lower, n.lower_inclusive, n.upper, n.upper_inclusive, n.prefix
FROM (SELECT DISTINCT sig_a, vendor, firmware FROM «a») a JOIN «b» s ON a.sig_a = s.sig_a JOIN (SELECT DISTINCT sig_p, version_raw, kind, lower, lower_inclusive, upper, upper_inclusive, prefix FROM «c») n ON s.sig_p = n.sig_p LEFT JOIN (SELECT id, min(scheme) AS scheme FROM «d» GROUP BY id) v ON a.vendor = v.id""",
    SIGNED_ASSETS, STRENGTHS, SIGNED_NODES, VENDOR_TABLE,
)
VERDICTS = Node(V.evaluate_ranges, CHECKS, kept=True)
# what Spark runs: groups of devices and classes of products, which stand for their members; a node below that says it in
# plain SQL by members takes these as its plan
DEVICES = Node(U.devices, CANONICAL, kept=True)
GROUPS = Node(U.groups, DEVICES, kept=True)
CLASSES = Node(U.classes, SIGNED_NODES, kept=True)
MET = Node(U.met, GROUPS, STRENGTHS, CLASSES, VERDICTS, kept=True)
COUNTED = Node(U.counted, MET)
GROUP_GRADES = Node(U.grades, MET, CLASSES, kept=True)
SCOPES = Node(U.scopes, GROUP_GRADES, kept=True)
SCOPE_IDS = Node(U.matched, SCOPES, CLASSES, kept=True)
SCOPE_LABELS = Node(U.labels, SCOPES, CLASSES, kept=True)
BASE_ROLLS = Node(U.base_rolls, VULNERABILITIES, KEV, EPSS, kept=True)
OWN_ROLLS = Node(U.own_rolls, VULNERABILITIES, KEV, EPSS, CLASSES, SCOPES, kept=True)
ROLLS = Node(U.rolls, SCOPES, BASE_ROLLS, OWN_ROLLS, kept=True)
#: The distinct texts of CVEs, by the digest that findings name (cve_list, cves).
CVE_LISTS = Node(U.cve_lists, ROLLS, BASE_ROLLS, kept=True)
FOUND = Node(U.found, GROUP_GRADES, GROUPS, CLASSES, STRENGTHS, ROLLS, kept=True)
#: Findings without their long texts: cve_list and scope name them.
NARROW = Node(U.handed_out, FOUND, DEVICES)
#: As NARROW, with reasons and the version check.
EVIDENCE = Node(U.evidence, FOUND, GROUPS, CLASSES, STRENGTHS, VERDICTS, kept=True)
EVIDENT = Node(U.handed_out, EVIDENCE, DEVICES)
HANDED_GRADES = Node(lambda grades, devices, groups, classes, strengths, ids: U.with_texts(U.handed_out(U.reasoned(grades, groups, classes, strengths), devices), ids, "scope"), GROUP_GRADES, DEVICES, GROUPS, CLASSES, STRENGTHS, SCOPE_IDS)

CANDIDATES = select("SELECT p.*, v.result, v.comparator, v.explanation FROM «a» p JOIN «b» v ON p.check_id = v.id", PAIRS, VERDICTS)
GRADED = Node(M.grade_candidates, CANDIDATES, by=HANDED_GRADES)
ENRICHED = Node(M.enriched_vulnerabilities, VULNERABILITIES, KEV, EPSS)
# devices of one identity and version have the same findings, so these are made once a group (which stands for the asset),
# from what no version rules out, and then handed to the group's devices
GROUPED = select(
    lambda d: f"""SELECT a.group_id AS asset_id, n.source, n.advisory_id, n.product_id, s.strength, s.more_specific, s.reason, v.result
FROM (SELECT DISTINCT group_id, sig_a, vendor, firmware FROM «a») a JOIN «b» s ON a.sig_a = s.sig_a JOIN (SELECT DISTINCT sig_p, version_raw FROM «c») r ON s.sig_p = r.sig_p
JOIN «d» v ON {d.struct(a='a.firmware', b='a.vendor', c='r.version_raw')} = v.id JOIN «c» n ON r.sig_p = n.sig_p AND r.version_raw IS NOT DISTINCT FROM n.version_raw WHERE v.result <> 'not_affected'""",
    SIGNED_ASSETS, STRENGTHS, SIGNED_NODES, VERDICTS,
)
ROLLED = Node(M.roll_up_vulnerabilities, ENRICHED, kept=True)
FINDING_GROUPS = Node(M.build_findings, Node(M.grade_candidates, GROUPED, kept=True), ROLLED)
_OF_GROUP = ["source", "advisory_id", "product_id", "strength", "more_specific", "reason", "result", "n_also", "tier", "cves", "n_cves", "kev", "epss", "cvss", "vector", "severity", "fix_available", "matched", "score", "priority"]
FINDINGS = select(f"SELECT a.asset_id || ':' || g.advisory_id || ':' || g.product_id AS finding_id, a.asset_id, {', '.join(f'g.{c}' for c in _OF_GROUP)} FROM «a» g JOIN (SELECT asset_id, group_id FROM «b») a ON g.asset_id = a.group_id", FINDING_GROUPS, SIGNED_ASSETS, by=Node(lambda narrow, lists: U.with_texts(narrow, lists, "cve_list"), NARROW, CVE_LISTS))
SUMMARY = Node(M.summarize_findings, FINDINGS, ROUTES, CANDIDATES, by=Node(U.summary, FOUND, GROUPS, ROUTES, COUNTED, CVE_LISTS))


@dataclass
class Corpus:
    """Advisories (source, advisory_id, place, title, url, published), their products and vulnerabilities, and what is known of CVEs."""

    advisories: DataFrame
    products: DataFrame
    vulnerabilities: DataFrame
    kev: DataFrame
    epss: DataFrame


@dataclass
class Match:
    findings: DataFrame
    candidates: DataFrame
    canonical: DataFrame
    summary: DataFrame


def match(identities: DataFrame, corpus: Corpus, vendors: DataFrame | None = None, families: DataFrame | None = None, since: object = None, tier: str | None = None) -> Match:
    """Findings of identities against a corpus, with their evidence, remediations and references, and the run's counters.

    vendors and families: lookup tables, the built-in ones if none are given. since: advisories dated before it are
    left out, undated ones stay. tier: findings below it are left out, counters are of all.
    """
    spark = identities.sparkSession
    advisories, products, vulns = corpus.advisories, corpus.products, corpus.vulnerabilities
    if since is not None:
        advisories = advisories.where(F.col("published").isNull() | (F.col("published") >= F.lit(since)))
        live = advisories.select("source", "advisory_id").distinct()
        products, vulns = products.join(live, ["source", "advisory_id"], "left_semi"), vulns.join(live, ["source", "advisory_id"], "left_semi")
    vendors = L.BUILTIN_VENDORS() if vendors is None else vendors
    families = L.BUILTIN_FAMILIES() if families is None else families
    made = {IDENTITIES: identities, PRODUCTS: products, VULNERABILITIES: vulns, KEV: corpus.kev, EPSS: corpus.epss, VENDOR_TABLE: vendors, FAMILY_TABLE: families}
    run = lambda node: node.spark(spark, "", made)
    findings = U.reported(run(EVIDENCE), run(DEVICES), run(SCOPES), run(CLASSES), run(SCOPE_LABELS), run(SCOPE_IDS), run(CVE_LISTS), vulns, advisories)
    return Match(M.at_least(findings, tier) if tier else findings, run(CANDIDATES), run(CANONICAL), run(SUMMARY))
