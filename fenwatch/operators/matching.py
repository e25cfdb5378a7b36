"""The match of assets with advisory products: a vendor-blocked join, ranked fields, version verdicts and graded findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenwatch.functions import tables as L
from fenwatch.functions import text as X
from fenwatch.functions.dialect import Dialect, operator

# Rank by field, in the order in which fields are tried.
ASSET_FIELDS = [("model", 2), ("product", 2), ("product_raw", 2), ("family", 1)]
NODE_FIELDS = [("model", 2), ("product", 2), ("product_raw", 2), ("name", 2), ("family", 1), ("family_raw", 1)]
SIGNED_ASSET = ["vendor", "model", "product", "product_raw", "family", "catalog_number"]
SIGNED_NODE = ["vendor", "model", "product", "product_raw", "name", "family", "family_raw", "catalog_number", "cpe"]


def _fields(d: Dialect, key: str, fields: list[tuple[str, int]]) -> str:
    made = d.array(*(d.struct(place=str(k), label=f"'{n}'", value=f"coalesce({n}, '')", rank=str(r)) for k, (n, r) in enumerate(fields)))
    return f"""
SELECT {key}, vendor, key, {d.size(d.split('key', ' '))} AS words, {X.informative(d, 'key')} AS informative, place, label, value, rank FROM (
  SELECT {key}, vendor, key, min(place) AS place, {d.first_by('label', 'place')} AS label, {d.first_by('value', 'place')} AS value, {d.first_by('CASE WHEN rank > 1 AND n.name IS NOT NULL THEN 1 ELSE rank END', 'place')} AS rank
  FROM (SELECT {key}, vendor, f.place AS place, f.label AS label, f.rank AS rank, f.value AS value, {X.product_key(d, 'f.value')} AS key FROM {d.unnest('«signatures»', made, 'f')}) x
  LEFT JOIN «family_names» n ON x.vendor = n.of_vendor AND x.value = n.name WHERE key <> '' GROUP BY {key}, vendor, key) y"""


@operator("signatures", "family_names")
def asset_fields(d: Dialect) -> str:
    """A row per field of an asset's signature: its place, label, value, key and rank; of equal keys the first; family names (of_vendor, name) rank 1."""
    return _fields(d, "sig_a", ASSET_FIELDS)


@operator("signatures", "family_names")
def node_fields(d: Dialect) -> str:
    """As asset_fields, for the signatures of advisories' products."""
    return _fields(d, "sig_p", NODE_FIELDS)


@operator("assets", "nodes", "asset_fields", "node_fields")
def compare_identities(d: Dialect) -> str:
    """Pairs of asset and node signatures (sig_a, sig_p) of one vendor with strength (1 family, 2 product, 3 order code), more_specific, reason, what matched, and the node's finer designation.

    assets and nodes have one row per signature, so that equal identities are compared once; their fields are those of
    the operators above. An order code or a CPE decides alone; else the best pair of fields counts, the earliest of
    equal ones. A key within another one is equal to a run of its words, so everything meets by equality: order codes,
    CPEs, and keys with runs of words, which are no longer than the longest key that could be within.
    """
    extra = f"trim({d.replace_all("replace(concat(' ', outer_key, ' '), concat(' ', inner_key, ' '), '  ')", ' +', ' ')})"
    runs = lambda keys, others: d.unnest(f"(SELECT k.vendor, k.key, o.longest FROM {keys} k JOIN {others} o ON k.vendor = o.vendor) y", d.word_runs("key", "longest"), "run")
    longest = lambda keys: f"(SELECT vendor, max(words) AS longest FROM {keys} WHERE may_be_inner GROUP BY vendor)"
    keys = lambda fields: f"SELECT DISTINCT vendor, key, words, informative, informative AND length(key) >= 5 AS may_be_inner FROM {fields}"
    return f"""
WITH a AS (SELECT sig_a, vendor, catalog_number, {X.catalog_key(d, "coalesce(catalog_number, '')")} AS code FROM «assets»),
n AS (SELECT sig_p, vendor, {X.catalog_key(d, "coalesce(catalog_number, '')")} AS code, {X.catalog_key(d, f"coalesce({d.get(d.split('cpe', ':'), 4)}, '')")} AS cpe, cpe AS cpe_text, catalog_number FROM «nodes»),
coded AS (
  SELECT sig_a, sig_p, min(place) AS place FROM (
    SELECT a.sig_a, n.sig_p, 0 AS place FROM a JOIN n ON a.vendor = n.vendor AND a.code = n.cpe WHERE a.code <> ''
    UNION ALL SELECT a.sig_a, n.sig_p, 1 FROM a JOIN n ON a.vendor = n.vendor AND a.code = n.code WHERE a.code <> '') x
  GROUP BY sig_a, sig_p),
ak AS ({keys('«asset_fields»')}),
nk AS ({keys('«node_fields»')}),
met AS (
  SELECT ak.vendor, ak.key AS a_key, nk.key AS b_key, ak.key AS inner_key, nk.key AS outer_key, true AS a_inner FROM ak JOIN nk ON ak.vendor = nk.vendor AND ak.key = nk.key WHERE ak.informative
  UNION ALL SELECT ak.vendor, ak.key, r.key, ak.key, r.key, true FROM (SELECT vendor, key, run FROM {runs('nk', longest('ak'))}) r JOIN ak ON ak.vendor = r.vendor AND ak.key = r.run WHERE ak.may_be_inner AND ak.key <> r.key
  UNION ALL SELECT nk.vendor, r.key, nk.key, nk.key, r.key, false FROM (SELECT vendor, key, run FROM {runs('ak', longest('nk'))}) r JOIN nk ON nk.vendor = r.vendor AND nk.key = r.run WHERE nk.may_be_inner AND nk.key <> r.key),
kp AS (SELECT DISTINCT vendor, a_key, b_key, inner_key, a_inner, a_key = b_key OR NOT {X.informative(d, extra)} AS full_match FROM met),
fp AS (
  SELECT f.sig_a, g.sig_p, f.place AS a_place, g.place AS b_place, f.label AS a_label, g.label AS b_label, f.value AS a_value, g.value AS b_value, kp.a_key, kp.b_key, kp.inner_key, kp.full_match, least(f.rank, g.rank) AS rank
  FROM kp JOIN «asset_fields» f ON kp.vendor = f.vendor AND kp.a_key = f.key JOIN «node_fields» g ON kp.vendor = g.vendor AND kp.b_key = g.key
  WHERE kp.full_match OR CASE WHEN kp.a_inner THEN f.rank ELSE g.rank END >= 2),
ok AS (
  SELECT fp.*, CASE WHEN a_key <> b_key THEN 'product_contained' WHEN rank = 1 THEN 'product_family' WHEN a_label = 'model' OR b_label = 'model' THEN 'product_model' WHEN a_value <> b_value THEN 'product_normalized' ELSE 'product_exact' END AS reason
  FROM fp JOIN a ON fp.sig_a = a.sig_a JOIN n ON fp.sig_p = n.sig_p
  WHERE NOT (a.code <> '' AND (n.code <> '' OR n.cpe = a.code))),
best AS (
  SELECT sig_a, sig_p, {d.first_by(d.struct(strength='rank', reason='reason', matched_key='inner_key', a_label='a_label', b_label='b_label', a_value='a_value', b_value='b_value', filler='a_key <> b_key AND full_match'), d.struct(a='-rank', b='a_place', c='b_place'))} AS b FROM ok GROUP BY sig_a, sig_p),
finer AS (
  SELECT best.sig_a, best.sig_p, {d.first_by('f.label', 'f.place')} AS label, {d.first_by('f.value', 'f.place')} AS value FROM best JOIN «node_fields» f ON best.sig_p = f.sig_p
  WHERE f.label <> 'name' AND f.key <> best.b.matched_key AND f.rank > best.b.strength AND f.informative GROUP BY best.sig_a, best.sig_p)
SELECT c.sig_a, c.sig_p, 3 AS strength, false AS more_specific, CASE WHEN c.place = 0 THEN 'cpe' ELSE 'catalog_number' END AS reason, 'catalog_number' AS asset_field, a.catalog_number AS asset_value, CASE WHEN c.place = 0 THEN 'cpe' ELSE 'catalog_number' END AS node_field, CASE WHEN c.place = 0 THEN n.cpe_text ELSE n.catalog_number END AS node_value, false AS filler, CAST(NULL AS string) AS finer
FROM coded c JOIN a ON c.sig_a = a.sig_a JOIN n ON c.sig_p = n.sig_p
UNION ALL
SELECT best.sig_a, best.sig_p, best.b.strength, finer.value IS NOT NULL, best.b.reason, best.b.a_label, best.b.a_value, best.b.b_label, best.b.b_value, best.b.filler, finer.value FROM best LEFT JOIN finer ON best.sig_a = finer.sig_a AND best.sig_p = finer.sig_p"""


def signature(d: Dialect, columns: list[str]) -> str:
    """A digest of some columns; each value goes by its length, so that no other values give the same text."""
    return d.sha256(" || ".join(f"CAST(length(coalesce({c}, '')) AS string) || ':' || coalesce({c}, '')" for c in columns))


@operator("candidates")
def grade_candidates(d: Dialect) -> str:
    """candidates (asset_id, source, advisory_id, product_id, strength, more_specific, reason, result) to the best per asset and advisory, without those ruled out.

    Best is not more specific, then stronger, then affected, then of the lesser product id. also_matched are the others'
    ids in that order; matched all ids.
    """
    order = d.struct(a="CASE WHEN more_specific THEN 1 ELSE 0 END", b="-strength", c="CASE WHEN result = 'affected' THEN 0 ELSE 1 END", d="product_id")
    return f"""
WITH g AS (
  SELECT asset_id, source, advisory_id, {d.first_by(d.struct(product_id='product_id', strength='strength', more_specific='more_specific', reason='reason', result='result'), order)} AS b,
    count(*) - 1 AS n_also, {d.sorted_set('product_id')} AS matched
  FROM «candidates» WHERE result <> 'not_affected' AND strength > 0 GROUP BY asset_id, source, advisory_id)
SELECT asset_id, source, advisory_id, b.product_id AS product_id, b.strength AS strength, b.more_specific AS more_specific, b.reason AS reason, b.result AS result, n_also, matched,
  CASE WHEN b.more_specific THEN 'possible' WHEN b.result = 'affected' THEN 'confirmed' ELSE 'likely' END AS tier FROM g"""


@operator("vulns", "kev", "epss")
def enriched_vulnerabilities(d: Dialect) -> str:
    """vulns with kev and epss by CVE. A CVE that a table repeats counts once, with its greatest score."""
    return """
SELECT v.*, k.cve IS NOT NULL AS kev, coalesce(p.score, 0) AS epss FROM «vulns» v
LEFT JOIN (SELECT DISTINCT cve FROM «kev») k ON v.cve = k.cve LEFT JOIN (SELECT cve, max(score) AS score FROM «epss» GROUP BY cve) p ON v.cve = p.cve"""


def severity_rank(d: Dialect, x: str) -> str:
    return f"coalesce({d.lookup(f"coalesce({x}, '')", L.SEVERITIES)}, 0)"


@operator("vulns")
def roll_up_vulnerabilities(d: Dialect) -> str:
    """vulns (source, advisory_id, cve, affected, cvss_version, base_score, vector, severity, has_fix, kev, epss) of an advisory with the same products, as one: CVEs, best score, KEV, EPSS, fix and worst severity. The best score has the highest major version, then the highest base."""
    by = d.struct(a="substring(cvss_version, 1, 1)", b="base_score", c="cve", e="vector")
    best = d.struct(rank=by, base="base_score", vector="vector", severity="severity")
    return f"""
SELECT source, advisory_id, affected, {d.sorted_set('cve')} AS cves, bool_or(kev) AS kev, max(epss) AS epss, {d.last_by(best, by)} FILTER (WHERE base_score IS NOT NULL) AS best, bool_or(has_fix) AS has_fix, {d.last_by('severity', severity_rank(d, 'severity'))} FILTER (WHERE severity IS NOT NULL) AS worst
FROM «vulns» GROUP BY source, advisory_id, affected"""


def score(kev: str) -> str:
    """A finding's score by strength, result and whether it is exploited."""
    base = "CASE strength WHEN 3 THEN CAST(0.6 AS double) WHEN 2 THEN CAST(0.5 AS double) ELSE CAST(0.4 AS double) END - CASE WHEN more_specific THEN CAST(0.2 AS double) ELSE 0 END + CASE WHEN result = 'affected' THEN CAST(0.35 AS double) ELSE 0 END"
    return f"least(CAST(1 AS double), {base} + CASE WHEN {kev} THEN CAST(0.05 AS double) ELSE 0 END)"


def priority(d: Dialect) -> str:
    """A finding's priority by its score, tier, CVSS, EPSS and whether it is exploited."""
    return f"round(score * 10 + CASE WHEN kev THEN 1000 ELSE 0 END + epss * 100 + cvss + {d.lookup('tier', L.TIERS)} * 50, 6)"


@operator("graded", "rolled")
def build_findings(d: Dialect) -> str:
    """graded with the vulnerabilities that apply rolled up: CVEs, best CVSS, KEV, EPSS, fix, score and priority.

    rolled: what roll_up_vulnerabilities gives. One applies if it names no product, or one that matched, which meet by
    equality. Without a score the severity is the advisory's worst. A repeated CVE counts once; advisories without
    vulnerabilities give findings without CVEs.
    """
    own = ["asset_id", "source", "advisory_id", "product_id", "strength", "more_specific", "reason", "result", "n_also", "tier", "matched"]
    key = ["asset_id", "source", "advisory_id"]
    of = "v.cves, v.kev, v.epss, v.best, v.has_fix"
    return f"""
WITH w AS (SELECT source, advisory_id, {d.last_by('worst', severity_rank(d, 'worst'))} FILTER (WHERE worst IS NOT NULL) AS worst FROM «rolled» GROUP BY source, advisory_id),
m AS (SELECT asset_id, source, advisory_id, p FROM {d.unnest('«graded»', 'matched', 'p')}),
x AS (SELECT source, advisory_id, p, cves, kev, epss, best, has_fix FROM {d.unnest(f"(SELECT * FROM «rolled» WHERE {d.size('affected')} > 0) y", 'affected', 'p')}),
met AS (
  SELECT g.asset_id, g.source, g.advisory_id, {of} FROM «graded» g JOIN «rolled» v ON g.source = v.source AND g.advisory_id = v.advisory_id WHERE {d.size('v.affected')} = 0
  UNION ALL SELECT m.asset_id, m.source, m.advisory_id, {of} FROM m JOIN x v ON m.source = v.source AND m.advisory_id = v.advisory_id AND m.p = v.p),
r AS (
  SELECT {', '.join(key)}, {d.merged_sets('cves')} AS cve_set, coalesce(bool_or(kev), false) AS kev, coalesce(max(epss), 0) AS epss, {d.last_by('best', 'best.rank')} FILTER (WHERE best IS NOT NULL) AS best, coalesce(bool_or(has_fix), false) AS fix_available
  FROM met GROUP BY {', '.join(key)}),
s AS (
  SELECT g.asset_id || ':' || g.advisory_id || ':' || g.product_id AS finding_id, {', '.join(f'g.{c}' for c in own)}, coalesce({d.join('r.cve_set', ' ')}, '') AS cves, coalesce(CASE WHEN r.asset_id IS NOT NULL THEN {d.size('r.cve_set')} END, 0) AS n_cves, coalesce(r.kev, false) AS kev, coalesce(r.epss, 0) AS epss,
    coalesce(r.best.base, 0) AS cvss, r.best.vector AS vector, coalesce(r.best.severity, w.worst) AS severity, coalesce(r.fix_available, false) AS fix_available, {score('coalesce(r.kev, false)')} AS score
  FROM «graded» g LEFT JOIN r ON {' AND '.join(f'g.{c} = r.{c}' for c in key)} LEFT JOIN w ON g.source = w.source AND g.advisory_id = w.advisory_id)
SELECT *, {priority(d)} AS priority FROM s"""


@operator("findings", "identities", "candidates")
def summarize_findings(d: Dialect) -> str:
    """The counters of a run, one row: findings by tier, assets, KEV, fixes, CVEs, and what went in: identities (route) and candidates (result). CVEs are counted over all findings."""
    return f"""
WITH c AS (SELECT count(DISTINCT cve) AS n FROM (SELECT c AS cve FROM {d.unnest('«findings»', d.split('cves', ' '), 'c')}) x WHERE cve <> ''),
i AS (SELECT count(*) AS n, count_if(route = 'unidentified') AS none, count_if(route = 'unknown vendor') AS unknown FROM «identities»),
k AS (SELECT count_if(result = 'not_affected') AS n FROM «candidates»),
f AS (
  SELECT count(*) AS total, count_if(tier = 'confirmed') AS confirmed, count_if(tier = 'likely') AS likely, count_if(tier = 'possible') AS possible, count(DISTINCT asset_id) AS assets, count_if(kev) AS with_kev, count_if(fix_available) AS with_fix FROM «findings»)
SELECT f.*, c.n AS cves, i.n AS assets_considered, i.none AS assets_unidentified, i.unknown AS assets_unknown_vendor, k.n AS ruled_out_by_version FROM f CROSS JOIN c CROSS JOIN i CROSS JOIN k"""


@operator("identities", "canonical")
def route_identities(d: Dialect) -> str:
    """identities with the route of each (id, route): unidentified if all that names it is empty, unknown vendor if none was resolved, else match."""
    blank = " AND ".join(f"coalesce(i.{c}, '') = ''" for c in ("vendor_raw", "vendor", "product_raw", "product", "family", "model", "catalog_number", "firmware"))
    return f"SELECT i.id, CASE WHEN {blank} THEN 'unidentified' WHEN c.vendor IS NULL THEN 'unknown vendor' ELSE 'match' END AS route FROM «identities» i JOIN «canonical» c ON i.id = c.id"


def at_least(findings: DataFrame, tier: str) -> DataFrame:
    """Findings of a tier or a higher one."""
    ranks = dict(L.TIERS)
    return findings.where(F.col("tier").isin([t for t, r in ranks.items() if r >= ranks[tier]]))


def in_order(findings: DataFrame, most: int | None = None) -> DataFrame:
    """Findings by priority, then advisory and asset; the first `most` of them."""
    ordered = findings.orderBy(F.desc("priority"), "advisory_id", "asset_id", "product_id")
    return ordered if most is None else ordered.limit(most)


def told(candidates: DataFrame, *columns: str) -> DataFrame:
    """candidates' columns with reasons (kind, detail, weight, passed), the version check in words, and the product that matched.

    candidates: rows of assets or groups and products that met, and what the match says of them. Reasons are in the
    order vendor, identity, version.
    """
    reason = lambda kind, detail, weight, passed: F.struct(kind.alias("kind"), detail.alias("detail"), weight.cast("double").alias("weight"), passed.alias("passed"))
    quoted = lambda c: F.concat(F.lit('"'), F.coalesce(c, F.lit("")), F.lit('"'))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    own = F.coalesce("asset_vendor_raw", "vendor")
    same = F.lower(F.trim(F.coalesce("asset_vendor_raw", F.lit("")))) == F.lower(F.trim(F.coalesce("node_vendor_raw", F.lit(""))))
    vendor = reason(
        F.when(same, "vendor_exact").otherwise("vendor_alias"),
        F.when(same, text("vendor ", quoted(own), " resolved to ", quoted(F.col("vendor")), " on both sides")).otherwise(text("device vendor ", quoted(own), " and advisory vendor ", quoted(F.coalesce("node_vendor_raw", "vendor")), " both resolve to ", quoted(F.col("vendor")))),
        F.lit(1), F.lit(True),
    )
    matches = F.when(F.col("reason") == "cpe", text("the advisory CPE ", quoted(F.col("node_value")), " names order code ", quoted(F.col("asset_value")))).when(F.col("reason") == "catalog_number", text("order code ", quoted(F.col("asset_value")), " matches the advisory exactly")).otherwise(
        text(F.col("asset_field"), " ", quoted(F.col("asset_value")), F.when(F.col("reason") != "product_contained", " matches ").when(F.col("filler"), " differs only by filler from ").otherwise(" and one appears inside the other: "), F.col("node_field"), " ", quoted(F.col("node_value")))
    )
    identity = reason(F.col("reason"), matches, F.when(F.col("strength") == 3, 1).otherwise(F.col("strength")), F.lit(True))
    finer = F.when(F.col("finer").isNotNull(), reason(F.lit("product_exact"), text("the advisory names ", quoted(F.col("finer")), ", which this device did not report"), F.lit(0), F.lit(False)))
    version = reason(
        F.when(F.col("result") == "indeterminate", "version_unknown").when(F.col("kind") == "all", "version_all_affected").when(F.col("kind") == "eq", "version_exact").otherwise("version_in_range"),
        F.col("explanation"), F.lit(0), F.col("result") != "indeterminate",
    )
    check = F.struct(F.col("version").alias("asset_version"), F.coalesce(F.nullif("version_raw", F.lit("")), F.lit("all versions")).alias("constraint"), "comparator", "result", "explanation")
    reasons = F.array_compact(F.array(vendor, identity, finer, version)).alias("reasons")
    return candidates.select(*columns, reasons, check.alias("version_check"), F.coalesce("node_vendor_raw", "vendor").alias("matched_vendor"), F.col("label").alias("matched_product"), F.col("version_raw").alias("matched_version"))


def with_evidence(findings: DataFrame, candidates: DataFrame) -> DataFrame:
    """findings with reasons, the version check and the labels of what else matched. candidates: rows of assets and products that met (asset_id, source, advisory_id, product_id, and what the match says of them)."""
    keys = ["asset_id", "source", "advisory_id", "product_id"]
    left = candidates.where("result <> 'not_affected'")
    place = F.struct(F.col("more_specific").cast("int"), -F.col("strength"), (F.col("result") != "affected").cast("int"), "product_id").alias("place")
    others = left.select(*keys, "label", place).groupBy("asset_id", "source", "advisory_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("place", "label"))), lambda x: x["label"]), 2, 2_147_483_647).alias("also_matched"))
    return findings.join(told(left, *keys), keys).join(others, ["asset_id", "source", "advisory_id"])


def with_remedies(findings: DataFrame, vulns: DataFrame, advisories: DataFrame) -> DataFrame:
    """findings with the remediations and references of the vulnerabilities that apply, and the advisory's title, url and day.

    vulns (source, advisory_id, place, affected, remediations, references); a remediation for products applies if one
    of them matched. Distinct remediations in order; references are the advisory's url and the others, sorted.
    """
    keys = ["asset_id", "source", "advisory_id"]
    v = vulns.select("source", "advisory_id", "place", "affected", "remediations", "references")
    met = findings.select(*keys, "matched").join(v, ["source", "advisory_id"]).where("size(affected) = 0 OR arrays_overlap(affected, matched)")
    own = F.filter(F.coalesce("remediations", F.array()), lambda r: ((F.size(F.coalesce(r["product_ids"], F.array())) == 0) | F.arrays_overlap(r["product_ids"], F.col("matched"))) & (F.concat_ws("", r["category"], r["details"], r["url"]) != ""))
    plain = F.transform(own, lambda r: F.struct(*(F.coalesce(r[c], F.lit("")).alias(c) for c in ("category", "details", "url"))))
    rolled = met.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", plain.alias("r")))).alias("rs"), F.array_distinct(F.flatten(F.collect_list(F.coalesce("references", F.array().cast("array<string>"))))).alias("refs"))
    rolled = rolled.select(*keys, F.array_distinct(F.flatten(F.transform("rs", lambda x: x["r"]))).alias("remediations"), "refs")
    told = advisories.groupBy("source", "advisory_id").agg(F.min_by(F.struct("title", "url", "published"), "place").alias("a")).select("source", "advisory_id", "a.*")
    out = findings.join(rolled, keys, "left").join(told, ["source", "advisory_id"], "left")
    none = F.array().cast("array<string>")
    every = F.array_sort(F.array_distinct(F.filter(F.concat(F.coalesce("refs", none), F.array("url")), lambda x: F.coalesce(x != "", F.lit(False)))))
    return out.withColumn("references", every).withColumn("remediations", F.coalesce("remediations", F.array().cast("array<struct<category:string,details:string,url:string>>"))).drop("refs")
