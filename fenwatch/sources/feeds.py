"""Readers of advisories and enrichment that were landed as files: CSAF 2.0, an exploited-flaws catalogue, likelihood scores, and advisory sheets."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from fenwatch.functions.text import advisory_url
from fenwatch.operators.corpus import split_affected

#: Levels of a product tree beyond which branches are not followed.
DEEPEST = 64

PRODUCTS = "advisory_id string, product_id string, vendor_raw string, family_raw string, name string, version_raw string, cpe string, catalog_number string, warning string"
VULNERABILITIES = (
    "array<struct<cve:string,title:string,ids:array<struct<system_name:string,text:string>>,product_status:map<string,array<string>>,scores:array<struct<products:array<string>,cvss_v2:struct<vectorString:string,baseScore:double>,"
    "cvss_v3:struct<version:string,vectorString:string,baseScore:double,baseSeverity:string>,cvss_v4:struct<version:string,vectorString:string,baseScore:double,baseSeverity:string>>>,remediations:array<struct<category:string,details:string,url:string,product_ids:array<string>>>,"
    "cwe:struct<id:string,name:string>,notes:array<struct<category:string,title:string,text:string>>,references:array<struct<category:string,summary:string,url:string>>,discovery_date:string,release_date:string>>"
)
NOTES, REFERENCES = "array<struct<category:string,title:string,text:string>>", "array<struct<category:string,summary:string,url:string>>"
#: Characters of a document beyond which it is refused.
MOST_DOCUMENT = 32 << 20


def collapsed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def day(c: Column) -> Column:
    """A day in one of the layouts that feeds use; null otherwise."""
    return F.coalesce(*(F.try_to_date(F.trim(c), f) for f in ("yyyy-MM-dd", "yyyy/MM/dd", "M/d/yyyy", "dd MMM yyyy")), F.try_to_timestamp(F.trim(c)).cast("date"))


def severity_of(label: Column, score: Column) -> Column:
    """A severity by its label, else by the score's band."""
    known = F.lower(F.trim(label))
    return F.when(known.isin("critical", "high", "medium", "low", "none"), known).when(score >= 9, "critical").when(score >= 7, "high").when(score >= 4, "medium").when(score > 0, "low").when(score == 0, "none")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file (file, value); web pages in place of JSON are left out."""
    return landed(spark, path).where(~F.col("value").rlike(r"(?i)^\s*<(!doctype )?html"))


def landed(spark: SparkSession, path: str) -> DataFrame:
    """All files under a path as texts (file, value)."""
    return spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def csaf_rejects(files: DataFrame) -> DataFrame:
    """Why files (file, value) give no advisory (file, why): a web page, too long, no JSON, no tracking id, or one that an earlier file has."""
    key = F.get_json_object("value", "$.document.tracking.id")
    marked = files.select("file", F.nullif(key, F.lit("")).alias("key"), F.when(F.col("value").rlike(r"(?i)^\s*<(!doctype )?html"), "a web page").when(F.length("value") > MOST_DOCUMENT, "too long").when(F.json_object_keys("value").isNull(), "not JSON").when(F.coalesce(key, F.lit("")) == "", "no tracking id").alias("why"))
    first = marked.where("why IS NULL").groupBy("key").agg(F.min("file").alias("first"))
    later = marked.where("why IS NULL").join(first, "key").where("file > first").select("file", F.lit("listed before").alias("why"))
    return marked.where("why IS NOT NULL").select("file", "why").unionByName(later)


def read_csaf(documents: DataFrame, publisher: str | None = None) -> DataFrame:
    """documents (value) as advisories: advisory_id, title, summary, publisher, published, updated, tlp, url, notes, references, value. Those without a tracking id are left out; of one id the first file counts.

    The url is that of the first reference to the document itself, else the first one, else the file; publisher fills up
    where a document names none.
    """
    get = lambda p: F.get_json_object("value", f"$.document.{p}")
    told = documents.where(F.length("value") <= MOST_DOCUMENT).select("file", "value", F.from_json(get("notes"), NOTES).alias("notes"), F.from_json(get("references"), REFERENCES).alias("references"))
    notes = F.filter(F.transform(F.coalesce("notes", F.array().cast(NOTES)), lambda n: F.struct(n["category"].alias("category"), n["title"].alias("title"), collapsed(n["text"]).alias("text"))), lambda n: F.coalesce(n["text"] != "", F.lit(False)))
    links = F.filter(F.coalesce("references", F.array().cast(REFERENCES)), lambda r: F.coalesce(r["url"] != "", F.lit(False)))
    first = lambda a, field: F.get(a, F.lit(0))[field]
    told = told.withColumn("notes", notes).withColumn("references", links)
    out = told.select(
        "file", get("tracking.id").alias("advisory_id"), F.trim(get("title")).alias("title"), first(F.filter("notes", lambda n: n["category"].isin("summary", "description")), "text").alias("summary"), F.coalesce(F.nullif(F.trim(get("publisher.name")), F.lit("")), F.lit(publisher)).alias("publisher"),
        F.try_to_timestamp(get("tracking.initial_release_date")).alias("published"), F.try_to_timestamp(get("tracking.current_release_date")).alias("updated"), get("distribution.tlp.label").alias("tlp"),
        F.coalesce(first(F.filter("references", lambda r: r["category"] == "self"), "url"), first(F.col("references"), "url"), F.col("file")).alias("url"), "notes", "references", "value",
    )
    one = F.min_by(F.struct(*[c for c in out.columns if c != "advisory_id"]), "file").alias("f")
    return out.where("coalesce(advisory_id, '') <> ''").groupBy("advisory_id").agg(one).select("advisory_id", "f.*")


def feed_documents(feeds: DataFrame, since: object = None) -> DataFrame:
    """feeds (value: a ROLIE feed in JSON) as the documents that they list (url, updated), once each; entries older than `since` are left out, undated ones stay."""
    kind = "array<struct<updated:string,link:array<struct<rel:string,href:string>>>>"
    rows = feeds.select(F.explode(F.from_json(F.get_json_object("value", "$.feed.entry"), kind)).alias("e"))
    own = F.get(F.filter("e.link", lambda x: (x["rel"] == "self") & F.lower(x["href"]).endswith(".json")), F.lit(0))["href"]
    out = rows.select(own.alias("url"), F.try_to_timestamp("e.updated").alias("updated")).where("url IS NOT NULL")
    if since is not None:
        out = out.where(F.col("updated").isNull() | (F.col("updated") >= F.lit(since)))
    return out.groupBy("url").agg(F.max("updated").alias("updated"))


def flatten_tree(tree: dict) -> list[dict]:
    """A product tree's leaves in order. Vendor, family, name and version gather on the way down; nested families are joined unless the inner holds the outer; the first of a repeated id counts; relationships inherit from what they refer to."""
    out: dict[str, dict] = {}

    def put(product: dict, path: dict) -> None:
        key = product.get("product_id") or ""
        if not key:
            return
        if key in out:
            out[key]["warning"] = "repeated product id"
            return
        helper = product.get("product_identification_helper") or {}
        codes = [*(helper.get("model_numbers") or []), *(helper.get("skus") or [])]
        out[key] = {"product_id": key, "vendor_raw": path.get("vendor"), "family_raw": path.get("family"), "name": path.get("name") or product.get("name"), "version_raw": path.get("version"), "cpe": helper.get("cpe"), "catalog_number": codes[0] if codes else None, "warning": None}

    def walk(branches: list, path: dict, depth: int) -> None:
        for b in branches if depth < DEEPEST else ():
            here, text = dict(path), b.get("name") or ""
            match b.get("category"):
                case "vendor":
                    here["vendor"] = text
                case "product_family":
                    outer = path.get("family") or ""
                    here["family"] = text if not outer or outer.lower() in text.lower() else f"{outer} {text}"
                case "product_name":
                    here["name"] = text
                case "product_version" | "product_version_range":
                    here["version"] = text
            if b.get("product"):
                put(b["product"], here)
            walk(b.get("branches") or [], here, depth + 1)

    walk(tree.get("branches") or [], {}, 0)
    for p in tree.get("full_product_names") or []:
        put(p, {})
    for r in tree.get("relationships") or []:
        p, base = r.get("full_product_name") or {}, out.get(r.get("product_reference") or "", {})
        if p.get("product_id") and p["product_id"] not in out:
            put(p, {"vendor": base.get("vendor_raw"), "family": base.get("family_raw"), "name": p.get("name"), "version": base.get("version_raw")})
    return list(out.values())


def csaf_products(advisories: DataFrame) -> DataFrame:
    """A row per product of each advisory. The tree's depth is not bounded by a schema, so it is walked in Arrow batches, a document at a time."""
    names = [c.split()[0] for c in PRODUCTS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, pa.string()) for n in names])
        for batch in batches:
            rows = []
            for key, value in zip(batch.column("advisory_id").to_pylist(), batch.column("value").to_pylist(), strict=True):
                try:
                    rows += [{"advisory_id": key} | p for p in flatten_tree(json.loads(value).get("product_tree") or {})]
                except (ValueError, AttributeError):
                    rows.append(dict.fromkeys(names) | {"advisory_id": key, "warning": "unreadable product tree"})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return advisories.select("advisory_id", "value").mapInArrow(run, PRODUCTS)


def csaf_vulnerabilities(advisories: DataFrame) -> DataFrame:
    """A row per vulnerability (advisory_id, place): cve (or the first CVE among its ids), title, cwe, status (products by status), affected products, all scores, the best one, remediations and references.

    Scores are read version 4, 3, 2 of each entry; the best has the highest major version, then the highest base.
    """
    rows = advisories.select("advisory_id", F.posexplode(F.from_json(F.get_json_object("value", "$.vulnerabilities"), VULNERABILITIES)).alias("place", "v"))
    named = F.get(F.filter(F.coalesce("v.ids", F.array()), lambda x: F.upper(x["text"]).like("CVE-%")), F.lit(0))["text"]

    def one(s: Column, k: str) -> Column:
        body = s[k]
        vector = F.nullif(F.regexp_extract(F.coalesce(body["vectorString"], F.lit("")), r"^CVSS:([^/]+)/", 1), F.lit(""))
        version = F.coalesce(F.nullif(body["version"], F.lit("")), vector) if k != "cvss_v2" else F.coalesce(vector, F.lit("2.0"))
        label = body["baseSeverity"] if k != "cvss_v2" else F.lit(None).cast("string")
        return F.when(body.isNotNull(), F.struct(version.alias("version"), body["vectorString"].alias("vector"), body["baseScore"].alias("base_score"), severity_of(label, body["baseScore"]).alias("severity"), s["products"].alias("product_ids")))

    scores = F.flatten(F.transform(F.coalesce("v.scores", F.array()), lambda s: F.array_compact(F.array(one(s, "cvss_v4"), one(s, "cvss_v3"), one(s, "cvss_v2")))))
    best = F.array_max(F.transform("scores", lambda s: F.struct(F.substring(s["version"], 1, 1).alias("major"), s["base_score"].alias("base"), s["vector"].alias("vector"), s["severity"].alias("severity"), s["version"].alias("version"))))
    remedies = F.transform(F.coalesce("v.remediations", F.array()), lambda r: F.struct(r["category"].alias("category"), collapsed(r["details"]).alias("details"), r["url"].alias("url"), r["product_ids"].alias("product_ids")))
    urls = F.filter(F.transform(F.coalesce("v.references", F.array()), lambda r: r["url"]), lambda u: F.coalesce(u != "", F.lit(False)))
    status = F.map_filter("v.product_status", lambda k, x: F.size(x) > 0)
    told = rows.withColumn("scores", scores).withColumn("best", best)
    return told.select(
        "advisory_id", "place", F.coalesce(F.nullif(F.trim("v.cve"), F.lit("")), F.upper(named)).alias("cve"), F.trim("v.title").alias("title"), F.col("v.cwe.id").alias("cwe_id"), F.col("v.cwe.name").alias("cwe"), F.try_to_timestamp("v.discovery_date").alias("discovered"), F.try_to_timestamp("v.release_date").alias("released"),
        status.alias("status"), F.coalesce(F.col("v.product_status")["known_affected"], F.array().cast("array<string>")).alias("affected"), "scores", F.col("best.version").alias("cvss_version"), F.col("best.base").alias("base_score"), F.col("best.vector").alias("vector"), F.col("best.severity").alias("severity"),
        F.exists(remedies, lambda r: r["category"] == "vendor_fix").alias("has_fix"), remedies.alias("remediations"), urls.alias("references"), F.filter(F.coalesce("v.notes", F.array().cast(NOTES)), lambda n: collapsed(n["text"]) != "").alias("notes"),
    )


NVD_METRIC = "array<struct<type:string,baseSeverity:string,cvssData:struct<version:string,vectorString:string,baseScore:double,baseSeverity:string>>>"
NVD = f"struct<id:string,descriptions:array<struct<lang:string,value:string>>,weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>,metrics:struct<cvssMetricV40:{NVD_METRIC},cvssMetricV31:{NVD_METRIC},cvssMetricV30:{NVD_METRIC},cvssMetricV2:{NVD_METRIC}>>"


def read_nvd(documents: DataFrame) -> DataFrame:
    """Landed lookups of single CVEs: cve, description (the first in English), cwe_id, scores of primary metrics (versions 4.0, 3.1, 3.0, 2 in this order), and the first score."""
    rows = documents.select(F.from_json(F.get_json_object("value", "$.vulnerabilities[0].cve"), NVD).alias("c")).where("c.id IS NOT NULL")
    first = lambda a: F.get(a, F.lit(0))
    english = first(F.filter("c.descriptions", lambda d: d["lang"] == "en"))["value"]
    weak = first(F.filter(F.flatten(F.transform("c.weaknesses", lambda w: w["description"])), lambda d: d["value"].startswith("CWE-")))["value"]
    kinds = ("cvssMetricV40", "cvssMetricV31", "cvssMetricV30", "cvssMetricV2")
    metrics = F.flatten(F.array(*(F.coalesce(F.col(f"c.metrics.{k}"), F.array().cast(NVD_METRIC)) for k in kinds)))
    primary = F.filter(metrics, lambda m: F.lower(F.coalesce(F.nullif(m["type"], F.lit("")), F.lit("primary"))) == "primary")
    scores = F.transform(primary, lambda m: F.struct(m["cvssData"]["version"].alias("version"), m["cvssData"]["vectorString"].alias("vector"), m["cvssData"]["baseScore"].alias("base_score"), severity_of(F.coalesce(m["cvssData"]["baseSeverity"], m["baseSeverity"]), m["cvssData"]["baseScore"]).alias("severity")))
    told = rows.select(F.upper("c.id").alias("cve"), collapsed(english).alias("description"), weak.alias("cwe_id"), scores.alias("scores"))
    return told.select("*", *(F.get("scores", F.lit(0))[c].alias(n) for c, n in (("version", "cvss_version"), ("base_score", "base_score"), ("vector", "vector"), ("severity", "severity"))))


def fill_from_nvd(vulns: DataFrame, nvd: DataFrame) -> DataFrame:
    """vulns (cve, cvss_version, base_score, vector, severity, cwe_id) whose score, or weakness, is missing take those of nvd; nothing known is overwritten. filled: a score was."""
    fields = ["cvss_version", "base_score", "vector", "severity"]
    one = nvd.groupBy("cve").agg(F.max_by(F.struct(*fields, "cwe_id"), "base_score").alias("n"))
    out = vulns.join(one, "cve", "left")
    gap = F.col("base_score").isNull()
    return out.select(*[c for c in vulns.columns if c not in (*fields, "cwe_id")], *(F.when(gap, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in fields), F.coalesce(F.nullif("cwe_id", F.lit("")), "n.cwe_id").alias("cwe_id"), (gap & F.col("n.base_score").isNotNull()).alias("filled"))


def read_kev(documents: DataFrame) -> DataFrame:
    """The exploited-flaws catalogue: cve, added, due, action, ransomware. Ids of another shape are left out."""
    kind = "array<struct<cveID:string,dateAdded:string,dueDate:string,requiredAction:string,knownRansomwareCampaignUse:string>>"
    rows = documents.select(F.explode(F.from_json(F.get_json_object("value", "$.vulnerabilities"), kind)).alias("v"))
    cve = F.upper(F.trim("v.cveID"))
    return rows.where(cve.rlike("^CVE-[0-9]{4}-[0-9]{4,}$")).select(cve.alias("cve"), day(F.col("v.dateAdded")).alias("added"), day(F.col("v.dueDate")).alias("due"), F.col("v.requiredAction").alias("action"), (F.lower(F.coalesce("v.knownRansomwareCampaignUse", F.lit(""))) == "known").alias("ransomware"))


def read_epss(spark: SparkSession, path: str) -> DataFrame:
    """Likelihood scores (cve, score, percentile, model_date: that of the file's comment), plain or gzipped; numbers that cannot be read are zero."""
    rows = spark.read.option("header", "true").option("comment", "#").csv(path).select("*", F.col("_metadata.file_path").alias("file"))
    said = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.regexp_extract("value", r"^#.*score_date:\s*([0-9]{4}-[0-9]{2}-[0-9]{2})", 1).alias("d")).where("d <> ''")
    dates = said.groupBy("file").agg(F.max("d").cast("date").alias("model_date"))
    number = lambda c: F.coalesce(F.col(c).try_cast("double"), F.lit(0.0))
    cve = F.upper(F.trim("cve"))
    return rows.where(cve.rlike("^CVE-[0-9]{4}-[0-9]{4,}$")).join(dates, "file", "left").select(cve.alias("cve"), number("epss").alias("score"), number("percentile").alias("percentile"), "model_date")


# Names of a sheet's columns by what they hold, compared by letters and digits alone, in the order in which they are tried.
SHEET_COLUMNS = {
    "id": ["ics-cert_number", "ics_cert_number", "advisory_number"], "title": ["ics-cert_advisory_title", "advisory_title", "title"], "vendor": ["vendor", "vendor_name"], "product": ["product", "product_name"], "affected": ["products_affected", "affected_products", "product_version"],
    "cves": ["cve_number", "cve", "cves"], "cvss": ["cumulative_cvss", "cvss_score", "cvss", "cvss_v3_score"], "severity": ["cvss_severity", "severity"], "cwe": ["cwe_number", "cwe"], "published": ["original_release_date", "release_date", "published"], "updated": ["last_updated", "updated"],
    "sector": ["critical_infrastructure_sector", "critical_infrastructure_sectors", "sectors"],
}


def read_advisory_sheet(spark: SparkSession, path: str, source: str = "sheet") -> dict[str, DataFrame]:
    """A sheet with a row per part of an advisory as the corpus's tables advisories, products, vulnerabilities, and warnings.

    Rows of one id, in the order in which they stand, make one advisory: the first row's title and days count. Every
    product is affected by each of its CVEs; a row's score is that of its CVEs. Affected cells that name a version
    without a product, and advisories without products, give warnings.
    """
    rows = spark.read.option("header", "true").option("multiLine", "true").option("mode", "PERMISSIVE").option("escape", '"').csv(path)
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum() and c.isascii())
    have = {plain(c): c for c in rows.columns}
    found = {k: next((have[plain(n)] for n in names if plain(n) in have), None) for k, names in SHEET_COLUMNS.items()}
    missing = [k for k in ("id", "vendor") if not found[k]]
    if missing:
        raise ValueError(f"no column for {', '.join(missing)}")
    cells = rows.select(F.monotonically_increasing_id().alias("row"), *(F.coalesce(F.col(f"`{c}`") if c else F.lit(None).cast("string"), F.lit("")).alias(k) for k, c in found.items()))
    cells = cells.withColumn("advisory_id", F.trim("id")).where("advisory_id <> ''").withColumn("source", F.lit(source))
    keys = ["source", "advisory_id"]
    first = cells.groupBy(*keys).agg(F.min("row").alias("place"), F.min_by(F.struct("title", "published", "updated"), "row").alias("f"), F.array_sort(F.collect_set(F.nullif(collapsed(F.col("sector")), F.lit("")))).alias("sectors"))
    advisories = first.select(*keys, "place", collapsed(F.col("f.title")).alias("title"), F.expr(advisory_url("advisory_id")).alias("url"), day(F.col("f.published")).alias("published"), day(F.col("f.updated")).alias("updated"), "sectors")
    entry = cells.select(*keys, F.col("row").alias("id"), collapsed(F.col("vendor")).alias("vendor"), F.when(F.trim("affected") != "", F.col("affected")).otherwise(F.col("product")).alias("cell"))
    parts = split_affected(entry.select("id", "cell")).join(entry.drop("cell"), "id")
    named = parts.where("name <> ''").withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy("id", "place")))
    none = F.lit(None).cast("string")
    products = named.select(*keys, F.concat_ws("-", "advisory_id", "k").alias("product_id"), F.col("vendor").alias("vendor_raw"), F.trim(F.concat_ws(" ", "vendor", "name")).alias("name"), F.col("name").alias("product_raw"), none.alias("family_raw"), none.alias("catalog_number"), none.alias("cpe"), F.col("version").alias("version_raw"))
    score = F.col("cvss").try_cast("double")
    cve = cells.select(*keys, "row", F.explode(F.split("cves", r"[,;\n\r ]+")).alias("cve"), F.when(score > 0, score).alias("base_score"), F.when(score > 0, severity_of(F.col("severity"), score)).alias("severity"), F.when(F.trim("cwe").startswith("CWE-"), F.trim("cwe")).alias("cwe_id"))
    cve = cve.withColumn("cve", F.upper(F.trim("cve"))).where(F.col("cve").rlike("^CVE-[0-9]{4}-[0-9]{4,}$"))
    once = cve.groupBy(*keys, "cve").agg(F.min("row").alias("place"), F.min_by(F.struct("base_score", "severity", "cwe_id"), "row").alias("f"))
    every = products.groupBy(*keys).agg(F.array_sort(F.collect_list("product_id")).alias("affected"))
    empty = F.array().cast("array<string>")
    vulnerabilities = once.join(every, keys, "left").select(*keys, "place", "cve", F.coalesce("affected", empty).alias("affected"), F.when(F.col("f.base_score").isNotNull(), "3.1").alias("cvss_version"), "f.base_score", none.alias("vector"), "f.severity", "f.cwe_id", F.lit(False).alias("has_fix"), F.array().cast("array<struct<category:string,details:string,url:string,product_ids:array<string>>>").alias("remediations"), empty.alias("references"))
    some = products.select(*keys).unionByName(once.select(*keys)).distinct()
    advisories = advisories.join(some, keys, "left_semi")
    nameless = parts.where("name = '' AND version <> ''").select(*keys, F.concat(F.lit("a version without a product: "), "version").alias("warning"))
    bare = advisories.select(*keys).join(products.select(*keys).distinct(), keys, "left_anti").withColumn("warning", F.lit("no product is named"))
    return {"advisories": advisories, "products": products, "vulnerabilities": vulnerabilities, "warnings": nameless.unionByName(bare)}


def read_sheet(spark: SparkSession, path: str, key: str, cell: str) -> DataFrame:
    """An advisory sheet's affected products (id, place, name, version); header names are compared by letters and digits alone."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("mode", "PERMISSIVE").csv(path)
    plain = lambda s: "".join(c for c in s.lower() if c.isalnum())
    names = {plain(c): c for c in rows.columns}
    return split_affected(rows.select(F.col(names[plain(key)]).alias("id"), F.col(names[plain(cell)]).alias("cell")))
