"""Findings as documents: a CSV sheet, JSON, a VEX document and an HTML page, and the groupings they are made of.

findings are rows as `fenwatch.plans.match` gives them, with `device`, the label of the asset's identity. Where `lists`
are given (cve_list, cves), findings have the digest `cve_list` in the place of `cves`. What the document's groups need
of findings is made once per list of CVEs before it is spread over the CVEs, so no row is made for a finding and CVE.
"""

from __future__ import annotations

import html
from collections.abc import Iterable, Iterator
from datetime import datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fenwatch.functions import text as X
from fenwatch.functions.dialect import SPARK
from fenwatch.operators.groups import fit, with_texts

# The sheet's columns, the labels of sharing, categories of remedies, and addresses that say nothing of an advisory.
SHEET = [
    "finding_id", "tier", "tier_meaning", "asset_address", "asset_label", "asset_purdue", "asset_role", "vendor", "product", "firmware", "advisory_id", "advisory_source", "title", "published", "cves", "cvss", "cvss_vector", "severity", "kev", "epss", "priority", "fix_available",
    "matched_product", "matched_version", "version_check", "remediations", "references",
]
TLP = ("RED", "AMBER", "GREEN", "WHITE")
REMEDIES = ("mitigation", "no_fix_planned", "none_available", "vendor_fix", "workaround")
BOILERPLATE = ["cwe.mitre.org", "first.org/cvss/calculator", "nvd.nist.gov/vuln-metrics"]
#: References that a sheet's row or a document's entry holds.
MOST_REFERENCES = 8
BOM = "\ufeff"


def matching_text(findings: DataFrame, needle: str) -> DataFrame:
    """Findings whose device, advisory, product, tier or CVEs hold a needle, whatever the case."""
    known = [c for c in ("device", "asset_id", "asset_address", "advisory_id", "title", "product_id", "matched_product", "tier", "cves") if c in findings.columns]
    return findings.where(F.contains(F.lower(F.concat_ws(" ", *(F.col(c) for c in known))), F.lit(needle.strip().lower())))


def described(findings: DataFrame, canonical: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """findings with the device's identity and label, and its address, level and role. canonical: identities by id; assets: asset_id, address, purdue, role."""
    identity = canonical.select(F.col("id").alias("asset_id"), F.expr(X.identity_label()).alias("device"), F.coalesce("vendor", "vendor_raw").alias("device_vendor"), F.coalesce(F.nullif("product", F.lit("")), F.nullif("product_raw", F.lit("")), "family").alias("device_product"), F.col("firmware").alias("device_firmware"))
    out = findings.join(identity, "asset_id", "left")
    if assets is None:
        none = F.lit(None).cast("string")
        return out.withColumn("asset_address", none).withColumn("asset_purdue", none).withColumn("asset_role", none)
    return out.join(assets.select("asset_id", F.col("address").alias("asset_address"), F.col("purdue").alias("asset_purdue"), F.col("role").alias("asset_role")), "asset_id", "left")


def remedy_text(r: Column) -> Column:
    """A remediation in one line: category, details and url, those that are there."""
    return F.concat_ws(": ", *(F.nullif(r[c], F.lit("")) for c in ("category", "details", "url")))


def sheet(findings: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """The report's rows as text, in the order of priority: zeros of scores are blank, booleans yes or no, nulls empty. Lists of CVEs join rows that are in order."""
    number = lambda c, places: F.when(F.col(c) != 0, F.format_string(f"%.{places}f", F.col(c).cast("double")))
    yes = lambda c: F.when(F.col(c), "yes").otherwise("no")
    cells = {
        "tier_meaning": F.expr(X.described(SPARK, "tier", X.TIER_TEXTS, "Unclassified")), "asset_label": F.col("device"), "vendor": F.col("device_vendor"), "product": F.col("device_product"), "firmware": F.col("device_firmware"), "advisory_source": F.col("source"), "published": F.date_format("published", "yyyy-MM-dd"),
        "cvss": number("cvss", 1), "cvss_vector": F.col("vector"), "kev": yes("kev"), "epss": number("epss", 5), "priority": number("priority", 1), "fix_available": yes("fix_available"), "matched_product": F.coalesce(F.nullif("matched_product", F.lit("")), "matched_vendor", "product_id"), "version_check": F.col("version_check.explanation"),
        "remediations": F.array_join(F.filter(F.transform("remediations", remedy_text), lambda x: x != ""), " | "), "references": F.array_join(F.slice("references", 1, MOST_REFERENCES), " "),
    }
    order = [F.desc("priority"), "advisory_id", "asset_id", "product_id"]
    if lists is None:
        ordered = findings.orderBy(*order)
    elif fit(lists):  # the number, which is of the sorted rows, keeps Spark from leaving the sort out
        ordered = findings.orderBy(*order).withColumn("k", F.monotonically_increasing_id()).join(F.broadcast(lists), "cve_list", "left").where("k >= 0")
    else:
        ordered = with_texts(findings, lists, "cve_list").orderBy(*order)
    return ordered.select(*(F.coalesce(cells.get(c, F.col(c) if c in ordered.columns else F.lit(None)).cast("string"), F.lit("")).alias(c) for c in SHEET))


def write_sheet(findings: DataFrame, path: str) -> None:
    """The sheet as CSV files in order, through Spark's committer, each with a byte-order mark and a header, which spreadsheets look for."""
    rows = sheet(findings)
    rows.select(*(F.col(c).alias((BOM if k == 0 else "") + c) for k, c in enumerate(SHEET))).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def findings_json(findings: DataFrame) -> DataFrame:
    """Findings in order, a JSON object a row (value)."""
    return findings.orderBy(F.desc("priority"), "advisory_id", "asset_id", "product_id").select(F.to_json(F.struct("*")).alias("value"))


# ---- the VEX document's groups


def vex_products(findings: DataFrame, addresses: bool = False) -> DataFrame:
    """A product per device label (device, vex_id, name): how many assets it has, and with `addresses` where they are. Ids number the labels in order.

    Ranks within ranges of labels are counted apart and added up, so no task holds all labels.
    """
    known = "asset_address" in findings.columns
    one = findings.groupBy("device").agg(F.count_distinct("asset_id").alias("n"), *([F.array_sort(F.collect_set("asset_address")).alias("at")] if known else [F.array().cast("array<string>").alias("at")]))
    name = F.concat("device", F.when(F.col("n") > 1, F.format_string(" (%d devices)", "n")).otherwise(""), *([F.when(F.size("at") > 0, F.concat(F.lit(" ["), F.array_join("at", ", "), F.lit("]"))).otherwise("")] if addresses else []))
    return numbered(one.select("device", F.col("n").alias("assets"), name.alias("name")), "device").select("device", "assets", "name", F.format_string("CSAFPID-%04d", "k").alias("vex_id"))


def numbered(df: DataFrame, by: str) -> DataFrame:
    """df with k: the row's place, from 1, in the order of a column of different values."""
    from pyspark.sql import Window

    from fenwatch.plans.graph import written

    ranged = written(df.repartitionByRange(by).sortWithinPartitions(by).withColumn("part", F.spark_partition_id()))
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))  # a row per partition
    before = sizes.select("part", (F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy(by))
    return ranged.withColumn("k", within).join(F.broadcast(before), "part").withColumn("k", F.col("k") + F.col("before")).drop("part", "before")


def _order() -> Column:
    """The place of a finding among all."""
    return F.struct(-F.col("priority"), "advisory_id", "asset_id", "product_id")


def _listed(findings: DataFrame, lists: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Findings with cve_list, and the lists (cve_list, cves)."""
    if lists is not None:
        return findings, lists
    rows = findings.withColumn("cve_list", F.sha2(F.coalesce("cves", F.lit("")), 256))
    return rows.drop("cves"), rows.groupBy("cve_list").agg(F.first(F.coalesce("cves", F.lit(""))).alias("cves"))


def _spread(rows: DataFrame, lists: DataFrame, keys: list[str], aggs: list[Column]) -> DataFrame:
    """What rows say per CVE of their lists, or of their advisory where a list is empty (vuln, is_cve, keys and aggs).

    rows: cve_list, advisory_id, keys and what aggs need; aggs must give the same over their own results. Rows of a list
    are made one before they are spread, and the advisory tells rows apart only where it is what they are about.
    """
    items = lists.select("cve_list", F.split("cves", " ").alias("items"))
    one = rows.groupBy("cve_list", "advisory_id", *keys).agg(*aggs) if aggs else rows.select("cve_list", "advisory_id", *keys).distinct()
    flagged = one.join(items.select("cve_list", F.array_contains("items", "").alias("blank")), "cve_list").withColumn("advisory_id", F.when(F.col("blank"), F.col("advisory_id")))
    few = flagged.groupBy("cve_list", "advisory_id", *keys).agg(*aggs) if aggs else flagged.select("cve_list", "advisory_id", *keys).distinct()
    each = few.join(items.select("cve_list", F.explode("items").alias("cve")), "cve_list").withColumn("is_cve", F.col("cve") != "").withColumn("vuln", F.when(F.col("is_cve"), F.col("cve")).otherwise(F.col("advisory_id")))
    return each.drop("cve_list", "advisory_id", "cve")


def _marked(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with the word and the bit that stand for their device, and the devices by number (device, k): a set of devices is a long per 64 of them."""
    devices = numbered(rows.select("device").distinct(), "device").select("device", "k")
    return rows.join(devices, "device").withColumn("word", F.shiftright("k", 6)).withColumn("bit", F.expr("shiftleft(1L, CAST(k & 63 AS int))")), devices


def _devices(sets: DataFrame, devices: DataFrame) -> DataFrame:
    """A row for each device that `every` has, with its bit."""
    bits = F.expr("filter(transform(sequence(0, 63), i -> struct(shiftleft(1L, i) AS bit, i AS i)), x -> (every & x.bit) <> 0)")
    return sets.withColumn("x", F.explode(bits)).withColumn("k", F.shiftleft("word", 6) + F.col("x.i")).withColumn("bit", F.col("x.bit")).drop("x").join(devices.withColumn("k", F.col("k").cast("long")), "k").drop("k")


def _exposed(rows: DataFrame, lists: DataFrame) -> DataFrame:
    """Per vulnerability the devices that have it, as bits, and those of them with a confirmed finding (vuln, is_cve, word, every, sure)."""
    masks = [F.bit_or("every").alias("every"), F.bit_or("sure").alias("sure")]
    each = _spread(rows.select("cve_list", "advisory_id", "word", F.col("bit").alias("every"), F.when(F.col("tier") == "confirmed", F.col("bit")).otherwise(F.lit(0).cast("long")).alias("sure")), lists, ["word"], masks)
    return each.groupBy("vuln", "is_cve", "word").agg(*masks)


def vex_groups(findings: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Per vulnerability and device: known_affected if a finding is confirmed, else under_investigation (vuln, is_cve, device, status)."""
    rows, lists = _listed(findings, lists)
    rows, devices = _marked(rows)
    return _devices(_exposed(rows, lists), devices).select("vuln", "is_cve", "device", F.when(F.expr("(sure & bit) <> 0"), "known_affected").otherwise("under_investigation").alias("status"))


def vex_scores(findings: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """An entry per vulnerability and distinct vector: version, base score, severity and the devices it holds for."""
    rows, lists = _listed(findings.where("coalesce(vector, '') <> '' AND cvss <> 0"), lists)
    first = [F.min("f").alias("f")]
    best = _spread(rows.select("cve_list", "advisory_id", "vector", F.struct(_order().alias("o"), "cvss", "severity").alias("f")), lists, ["vector"], first).groupBy("vuln", "vector").agg(*first)
    marked, devices = _marked(rows)
    every = [F.bit_or("every").alias("every")]
    sets = _spread(marked.select("cve_list", "advisory_id", "vector", "word", F.col("bit").alias("every")), lists, ["vector", "word"], every).groupBy("vuln", "vector", "word").agg(*every)
    devices = _devices(sets, devices).groupBy("vuln", "vector").agg(F.array_sort(F.collect_list("device")).alias("devices"))
    out = best.join(devices, ["vuln", "vector"])
    return out.select("vuln", "vector", F.when(F.col("vector").startswith("CVSS:3.0"), "3.0").otherwise("3.1").alias("version"), F.col("f.cvss").alias("base_score"), F.upper("f.severity").alias("severity"), "devices")


def vex_threats(findings: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Per vulnerability: whether it is exploited, and the greatest likelihood that it will be, in words (vuln, kev, epss, threats)."""
    none = F.array().cast("array<string>")
    rows, lists = _listed(findings, lists)
    most = [F.max("kev").alias("kev"), F.max("epss").alias("epss")]
    out = _spread(rows.select("cve_list", "advisory_id", "kev", "epss"), lists, [], most).groupBy("vuln").agg(*most)
    known = F.when(F.col("kev"), F.array(F.lit("Listed in the CISA Known Exploited Vulnerabilities catalogue."))).otherwise(none)
    likely = F.when(F.col("epss") > 0, F.array(F.format_string("EPSS puts the probability of exploitation in the next 30 days at %.1f percent.", F.col("epss") * 100))).otherwise(none)
    return out.withColumn("threats", F.concat(known, likely))


def vex_remediations(findings: DataFrame, lists: DataFrame | None = None) -> DataFrame:
    """Per vulnerability and category (others count as mitigation): details that are not said yet, in the findings' order, and the first url.

    A fix of the vendor takes the place of none_available and no_fix_planned; a vulnerability without any has
    none_available, with its first reference; vulnerabilities with devices under investigation get a mitigation more.
    """
    from fenwatch.plans.graph import written

    rows, lists = _listed(findings, lists)
    told = rows.select("cve_list", "advisory_id", _order().alias("o"), F.posexplode("remediations").alias("p", "r"))
    category = F.lower(F.trim("r.category"))
    told = told.select("cve_list", "advisory_id", F.when(category.isin(*REMEDIES), category).otherwise("mitigation").alias("category"), F.struct("o", "p").alias("o"), F.col("r.details").alias("details"), F.col("r.url").alias("url"))
    # an equal text is said once, so a list holds no more than the different texts of a vulnerability
    least = [F.min("o").alias("o")]
    once = _spread(told, lists, ["category", "details", "url"], least).groupBy("vuln", "category", "details", "url").agg(*least)
    listed = once.groupBy("vuln", "category").agg(F.array_sort(F.collect_list(F.struct("o", "details", "url"))).alias("xs"))
    joined = F.aggregate("xs", F.lit(""), lambda said, x: F.when((x["details"] == "") | F.contains(said, x["details"]), said).otherwise(F.trim(F.concat(said, F.lit(" "), x["details"]))))
    url = F.get(F.filter(F.transform("xs", lambda x: x["url"]), lambda u: u != ""), F.lit(0))
    bare = F.concat(F.lit("The advisory records a remedy of this kind without describing it: "), F.col("category"))
    plain = written(listed.select("vuln", "category", F.coalesce(F.nullif(joined, F.lit("")), bare).alias("details"), url.alias("url")))
    fixed = plain.where("category = 'vendor_fix'").select("vuln").distinct()
    kept = plain.where(~F.col("category").isin("none_available", "no_fix_planned")).unionByName(plain.where(F.col("category").isin("none_available", "no_fix_planned")).join(fixed, "vuln", "left_anti"))
    first = [F.min("f").alias("f")]
    refs = rows.where(F.size("references") > 0).select("cve_list", "advisory_id", F.struct(_order().alias("o"), F.get("references", F.lit(0)).alias("url")).alias("f"))
    refs = _spread(refs, lists, [], first).groupBy("vuln").agg(*first).select("vuln", F.col("f.url").alias("url"))
    missing = _spread(rows, lists, [], []).select("vuln").distinct().join(kept.select("vuln").distinct(), "vuln", "left_anti").join(refs, "vuln", "left")
    kept = kept.unionByName(missing.select("vuln", F.lit("none_available").alias("category"), F.lit("No fix and no mitigation is on record. Consult the advisory, and rely on segmentation until one is published.").alias("details"), "url"))
    unsure = _exposed(_marked(rows)[0], lists).where("(every & ~sure) <> 0").select("vuln").distinct()
    more = unsure.select("vuln", F.lit("mitigation").alias("category"), F.lit("Exposure is unconfirmed for some products. Establish their firmware version and assess again.").alias("details"), F.lit(None).cast("string").alias("url"))
    return kept.withColumn("for", F.lit("all")).unionByName(more.withColumn("for", F.lit("under_investigation")))


def vex_references(findings: DataFrame, most: int = MOST_REFERENCES, lists: DataFrame | None = None) -> DataFrame:
    """Up to `most` different addresses per vulnerability (vuln, k, url, advisory_id): the advisory's own, then findings' first ones that say something, then those that name the CVE, then all."""
    from pyspark.sql import Window

    squash = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    rows, lists = _listed(findings, lists)
    rows = rows.select("cve_list", "advisory_id", _order().alias("o"), F.posexplode("references").alias("p", "url")).where("url <> ''")
    least = [F.min("m").alias("m")]
    # the first of an address, and the first where it leads its finding's references
    rows = rows.groupBy("cve_list", "advisory_id", "url", (F.col("p") == 0).alias("leads")).agg(F.min(F.struct("o", "p", "advisory_id")).alias("m")).withColumn("of", F.col("advisory_id"))
    own = F.contains(F.lower("url"), F.lit("/.well-known/csaf/")) | (squash("of").isNotNull() & (squash("of") != "") & F.contains(squash("url"), squash("of")))
    dull = F.lit(False)
    for b in BOILERPLATE:
        dull = dull | F.contains(F.lower("url"), F.lit(b))
    rows = rows.withColumn("early", F.when(own, 0).when(F.col("leads") & ~dull, 1))
    each = _spread(rows, lists, ["url", "early"], least)
    step = F.coalesce("early", F.when(F.col("is_cve") & F.contains(F.upper("url"), F.col("vuln")), 2).otherwise(3))
    best = each.groupBy("vuln", "url").agg(F.min(F.struct(step.alias("step"), F.col("m.o").alias("o"), F.col("m.p").alias("p"), F.col("m.advisory_id").alias("advisory_id"))).alias("m"))
    ranked = best.withColumn("k", F.row_number().over(Window.partitionBy("vuln").orderBy("m.step", "m.o", "m.p", "url")))
    return ranked.where(F.col("k") <= most).select("vuln", "k", "url", F.col("m.advisory_id").alias("advisory_id"))


def vex_document(findings: DataFrame, publisher: str, namespace: str, now: datetime, tlp: str = "AMBER", tracking: str | None = None, addresses: bool = False, summary: DataFrame | None = None, lists: DataFrame | None = None) -> DataFrame:
    """One row with a VEX document in JSON: products, and per vulnerability its status, scores, threats, remedies, references and why products are listed.

    The document is one value and grows with the findings of one report, which a person reads; filter before. summary:
    the run's counters, from which a note on coverage is made.
    """
    tlp = tlp.upper()
    if not publisher.strip() or not namespace.strip() or tlp not in TLP:
        raise ValueError(f"a publisher, its namespace, and one of the sharing labels {', '.join(TLP)} are needed")
    findings, lists = _listed(findings, lists)
    products = vex_products(findings, addresses)
    ids = products.select("device", "vex_id")
    tree = products.agg(F.array_sort(F.collect_list(F.struct(F.col("vex_id").alias("product_id"), "name"))).alias("full_product_names"))
    of = lambda status: F.array_sort(F.collect_set(F.when(F.col("status") == status, F.col("vex_id"))))
    status = vex_groups(findings, lists).join(ids, "device").groupBy("vuln", "is_cve").agg(of("known_affected").alias("known_affected"), of("under_investigation").alias("under_investigation"))
    line = F.concat(F.col("tier"), F.lit(": matched the advisory entry "), F.coalesce("matched_product", "product_id"), F.coalesce(F.concat(F.lit(", for "), F.nullif("matched_version", F.lit(""))), F.lit("")), F.coalesce(F.concat(F.lit(". Version check: "), F.col("version_check.explanation")), F.lit("")))
    first = [F.min("f").alias("f")]
    head_of = _spread(findings.select("cve_list", "advisory_id", F.struct(_order().alias("o"), "title", "source").alias("f")), lists, [], first).groupBy("vuln").agg(*first).select("vuln", F.struct("f.title", "f.source").alias("head"))
    why = _spread(findings.withColumn("line", line), lists, ["line"], []).groupBy("vuln").agg(F.array_sort(F.collect_set("line")).alias("why")).join(head_of, "vuln")
    scores = vex_scores(findings, lists).select("vuln", "vector", "version", "base_score", "severity", F.explode("devices").alias("device")).join(ids, "device").groupBy("vuln", "vector", "version", "base_score", "severity").agg(F.array_sort(F.collect_set("vex_id")).alias("products"))
    scores = scores.groupBy("vuln").agg(F.array_sort(F.collect_list(F.struct("vector", F.struct(F.struct("version", F.col("vector").alias("vectorString"), F.col("base_score").alias("baseScore"), F.col("severity").alias("baseSeverity")).alias("cvss_v3"), "products").alias("s")))).alias("xs")).select("vuln", F.transform("xs", lambda x: x["s"]).alias("scores"))
    remedies = vex_remediations(findings, lists).groupBy("vuln").agg(F.array_sort(F.collect_list(F.struct("for", "category", "details", "url"))).alias("remedies"))
    references = vex_references(findings, lists=lists).groupBy("vuln").agg(F.array_sort(F.collect_list(F.struct("k", F.lit("external").alias("category"), F.col("advisory_id").alias("summary"), "url"))).alias("xs")).select("vuln", F.transform("xs", lambda x: F.struct(x["category"].alias("category"), x["summary"].alias("summary"), x["url"].alias("url"))).alias("references"))
    every = F.array_sort(F.array_union("known_affected", "under_investigation"))
    whole = status.join(why, "vuln").join(vex_threats(findings, lists).select("vuln", "threats"), "vuln").join(scores, "vuln", "left").join(remedies, "vuln").join(references, "vuln", "left")
    entry = F.struct(
        F.when(F.col("is_cve"), F.col("vuln")).alias("cve"), F.when(~F.col("is_cve"), F.array(F.struct(F.col("head.source").alias("system_name"), F.col("vuln").alias("text")))).alias("ids"), F.col("head.title").alias("title"),
        F.array(F.struct(F.lit("description").alias("category"), F.lit(None).cast("string").alias("title"), F.coalesce("head.title", F.concat(F.lit("Reported in "), "vuln")).alias("text")), F.struct(F.lit("details").alias("category"), F.lit("Why these products are listed").alias("title"), F.array_join("why", "\n").alias("text"))).alias("notes"),
        F.struct("known_affected", "under_investigation").alias("product_status"), "scores", F.transform("threats", lambda t: F.struct(F.lit("exploit_status").alias("category"), t.alias("details"), every.alias("product_ids"))).alias("threats"),
        F.transform("remedies", lambda r: F.struct(r["category"].alias("category"), r["details"].alias("details"), r["url"].alias("url"), F.when(r["for"] == "all", every).otherwise(F.col("under_investigation")).alias("product_ids"))).alias("remediations"), "references",
    )
    listed = whole.select(F.col("vuln"), F.to_json(entry).alias("e")).agg(F.array_sort(F.collect_list(F.struct("vuln", "e"))).alias("vs"))
    stamp = now.strftime("%Y-%m-%dT%H:%M:%SZ")
    n = findings.agg(F.count_distinct("device").alias("products"))
    cves = _spread(findings, lists, [], []).where("is_cve").agg(F.count_distinct("vuln").alias("cves"))
    counted = n.join(cves, F.lit(True))
    notes = [F.struct(F.lit("description").alias("category"), F.lit("How this assessment was produced").alias("title"), F.lit("Made from an inventory and public advisories. known_affected: vendor, product and version matched; under_investigation: the version could not be established or compared.").alias("text"))]
    if not addresses:
        notes.append(F.struct(F.lit("other").alias("category"), F.lit("Device addresses").alias("title"), F.lit("Addresses are left out; each product says how many devices run it.").alias("text")))
    if summary is not None:
        counted = counted.join(summary.select("assets_considered", "assets_unidentified"), F.lit(True))
        notes.append(F.when(F.col("assets_unidentified") > 0, F.struct(F.lit("other").alias("category"), F.lit("Coverage").alias("title"), F.format_string("%d of %d devices could not be identified and were not assessed; that says nothing of their exposure.", "assets_unidentified", "assets_considered").alias("text"))))
    head = F.struct(
        F.lit("csaf_vex").alias("category"), F.lit("2.0").alias("csaf_version"), F.format_string("Exposure of %d products to %d CVEs", "products", "cves").alias("title"), F.lit("en-US").alias("lang"),
        F.struct(F.lit("user").alias("category"), F.lit(publisher).alias("name"), F.lit(namespace).alias("namespace")).alias("publisher"),
        F.struct(F.lit(tracking or f"FENWATCH-{now:%Y%m%d-%H%M%S}").alias("id"), F.lit("final").alias("status"), F.lit("1").alias("version"), F.lit(stamp).alias("initial_release_date"), F.lit(stamp).alias("current_release_date"), F.array(F.struct(F.lit("1").alias("number"), F.lit(stamp).alias("date"), F.lit("Initial assessment").alias("summary"))).alias("revision_history")).alias("tracking"),
        F.struct(F.struct(F.lit(tlp).alias("label")).alias("tlp")).alias("distribution"), F.array_compact(F.array(*notes)).alias("notes"),
    )
    one = tree.join(listed, F.lit(True)).join(counted, F.lit(True))  # one row each
    parts = [F.lit('{"document":'), F.to_json(head), F.lit(',"product_tree":'), F.to_json(F.struct("full_product_names")), F.lit(',"vulnerabilities":['), F.array_join(F.transform("vs", lambda v: v["e"]), ","), F.lit("]}")]
    return one.select(F.concat(*parts).alias("document"))


def html_pages(findings: DataFrame, per_page: int = 1000) -> DataFrame:
    """All findings as pages (page, document) of `per_page` rows at most, in the order of the sheet; tasks make them, so no page passes through the driver."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n, held = TaskContext.get().partitionId(), 0, []
        for batch in batches:
            held += zip(*(batch.column(c).to_pylist() for c in SHEET), strict=True)
            while len(held) >= per_page:
                yield page(part, n, held[:per_page])
                held, n = held[per_page:], n + 1
        if held:
            yield page(part, n, held)

    def page(part: int, n: int, rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"page": [f"{part:05d}-{n:05d}"], "document": [_page(rows, "")]})

    return sheet(findings).mapInArrow(made, "page string, document string")


def _page(rows: Iterable, note: str) -> str:
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{html.escape('' if v is None else str(v))}</{tag}>" for v in values) + "</tr>"
    script = "<script>const q=document.getElementById('q');q.oninput=()=>{const n=q.value.trim().toLowerCase();document.querySelectorAll('tbody tr').forEach(r=>{r.hidden=!r.textContent.toLowerCase().includes(n)})}</script>"
    return f"<!DOCTYPE html><meta charset='utf-8'><title>Findings</title>{note}<input id='q' placeholder='filter'><table><thead>{cells('th', SHEET)}</thead><tbody>{''.join(cells('td', r) for r in rows)}</tbody></table>{script}"


def html_page(findings: DataFrame, most: int | None = None, summary: DataFrame | None = None) -> str:
    """One page of all findings, or of the first `most` by priority with a note on how many are left out; every value is escaped, a field filters rows, and a note tells what was not assessed. Many findings belong on html_pages."""
    table = sheet(findings)
    rows = (table if most is None else table.limit(most)).collect()
    note = ""
    if most is not None and (left := findings.count() - len(rows)):
        note = f"<p>{left} further findings are not on this page.</p>"
    if summary is not None and (s := summary.first()) and s["assets_unidentified"]:
        note += f"<p>{s['assets_unidentified']} of {s['assets_considered']} devices could not be identified and were not assessed.</p>"
    return _page(rows, note)


def console_table(df: DataFrame, columns: list[str], most: int = 20) -> str:
    """The first rows as aligned text, for a terminal: booleans yes or no, nulls blank."""
    rows = [[("yes" if v else "no") if isinstance(v, bool) else "" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v) for v in r] for r in df.select(*columns).limit(most).collect()]
    widths = [max(len(x) for x in column) for column in zip(columns, *rows, strict=True)]
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)).rstrip() for r in [columns, *rows])
