"""Advisories and enrichment: joins, roll-ups, pruning, gaps and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwatch.functions import tables as L
from fenwatch.functions import text as X
from fenwatch.functions.dialect import Dialect, Operator, operator


@operator("vulns", "kev", "epss")
def enrich(d: Dialect) -> str:
    """vulns with KEV and EPSS by CVE; a CVE that a table repeats counts once, with its greatest score."""
    return """SELECT v.source, v.advisory_id, v.cve, v.base_score, v.severity, k.cve IS NOT NULL AS kev, e.score AS epss FROM «vulns» v
LEFT JOIN (SELECT DISTINCT cve FROM «kev») k ON v.cve = k.cve LEFT JOIN (SELECT cve, max(score) AS score FROM «epss» GROUP BY cve) e ON v.cve = e.cve"""


@operator("epss", "vulns")
def prune_enrichment(d: Dialect) -> str:
    """epss rows whose CVE some advisory names; all of them while there is no advisory."""
    return "SELECT e.cve, e.score FROM «epss» e WHERE e.cve IN (SELECT cve FROM «vulns» WHERE cve IS NOT NULL) OR (SELECT count(*) FROM «vulns») = 0"


@operator("vulns", "lookups")
def fill_score_gaps(d: Dialect) -> str:
    """vulns whose score is missing take that of lookups (cve, base_score); nothing known is overwritten."""
    return "SELECT v.source, v.advisory_id, v.cve, coalesce(v.base_score, l.base_score) AS base_score, v.base_score IS NULL AND l.base_score IS NOT NULL AS filled FROM «vulns» v LEFT JOIN (SELECT cve, max(base_score) AS base_score FROM «lookups» GROUP BY cve) l ON v.cve = l.cve"


@operator("vulns")
def unscored(d: Dialect) -> str:
    """CVEs without any score."""
    return "SELECT cve FROM «vulns» WHERE cve IS NOT NULL GROUP BY cve HAVING count(base_score) = 0"


def score_gaps(vulns: DataFrame, most: int = 200) -> DataFrame:
    """The first CVEs, in order, without any score: as many as are to be looked up at a time."""
    return unscored(vulns).orderBy("cve").limit(most)


@operator("vulns")
def advisory_rollup(d: Dialect) -> str:
    """Per advisory: CVEs, worst severity of the vulnerabilities' best scores, best base score, KEV and EPSS; vulns as enrich gives them."""
    rank = f"coalesce({d.lookup("coalesce(severity, '')", L.SEVERITIES)}, 0)"
    return f"""
SELECT source, advisory_id, {d.listed('cve')} AS cves, count(DISTINCT cve) AS n_cves, max(base_score) AS worst_score, bool_or(kev) AS kev, max(epss) AS epss, {d.last_by('severity', rank)} FILTER (WHERE severity IS NOT NULL) AS severity
FROM «vulns» GROUP BY source, advisory_id"""


@operator("advisories")
def deduplicate_advisories(d: Dialect) -> str:
    """advisories (source, advisory_id, place, title): of one id within a source the first counts; n says how many there were. Rows without id or source are left out."""
    return f"SELECT source, advisory_id, {d.first_by('title', 'place')} AS title, min(place) AS place, count(*) AS n FROM «advisories» WHERE coalesce(source, '') <> '' AND coalesce(advisory_id, '') <> '' GROUP BY source, advisory_id"


@operator("advisories", "products", "vulns")
def advisory_faults(d: Dialect) -> str:
    """Why advisories are refused (source, advisory_id, place, fault): no id, no source, neither product nor vulnerability, a product without id or with one that is taken; or a later copy of one."""
    key = "a.source = {0}.source AND a.advisory_id = {0}.advisory_id"
    return f"""
SELECT source, advisory_id, place, 'no id' AS fault FROM «advisories» WHERE coalesce(advisory_id, '') = ''
UNION ALL SELECT source, advisory_id, place, 'no source' FROM «advisories» WHERE coalesce(source, '') = '' AND coalesce(advisory_id, '') <> ''
UNION ALL SELECT a.source, a.advisory_id, a.place, 'neither product nor vulnerability' FROM «advisories» a LEFT JOIN (SELECT DISTINCT source, advisory_id FROM «products») p ON {key.format('p')} LEFT JOIN (SELECT DISTINCT source, advisory_id FROM «vulns») v ON {key.format('v')}
  WHERE coalesce(a.advisory_id, '') <> '' AND coalesce(a.source, '') <> '' AND p.source IS NULL AND v.source IS NULL
UNION ALL SELECT a.source, a.advisory_id, a.place, 'a product has no id' FROM «advisories» a JOIN (SELECT DISTINCT source, advisory_id FROM «products» WHERE coalesce(product_id, '') = '') p ON {key.format('p')}
UNION ALL SELECT a.source, a.advisory_id, a.place, 'a product id is used again' FROM «advisories» a JOIN (SELECT DISTINCT source, advisory_id FROM (SELECT source, advisory_id, product_id FROM «products» WHERE coalesce(product_id, '') <> '' GROUP BY source, advisory_id, product_id HAVING count(*) > 1) x) p ON {key.format('p')}
UNION ALL SELECT a.source, a.advisory_id, a.place, 'listed before' FROM «advisories» a JOIN (SELECT source, advisory_id, min(place) AS first FROM «advisories» GROUP BY source, advisory_id) f ON {key.format('f')} AND a.place > f.first"""


@operator("corpus", "incoming")
def upsert_advisories(d: Dialect) -> str:
    """corpus with incoming (both source, advisory_id, title): an incoming advisory takes the place of the same one, all others stay. For feeds that bring only what changed."""
    return "SELECT source, advisory_id, title FROM «incoming» UNION ALL SELECT c.source, c.advisory_id, c.title FROM «corpus» c WHERE NOT EXISTS (SELECT 1 FROM «incoming» i WHERE i.source = c.source AND i.advisory_id = c.advisory_id)"


def replace_source(corpus: DataFrame, incoming: DataFrame) -> DataFrame:
    """corpus with all rows of the sources that incoming names replaced by incoming's; what a source has withdrawn goes. Other sources stay."""
    return corpus.join(incoming.select("source").distinct(), "source", "left_anti").select(*corpus.columns).unionByName(incoming.select(*corpus.columns))


@operator("products", "vulns", "advisories")
def corpus_stats(d: Dialect) -> str:
    """Counts of a corpus in long form (dimension, key, n): by source, severity and vendor, range kinds, totals, and the first and last day."""
    rank = f"coalesce({d.lookup("coalesce(severity, '')", L.SEVERITIES)}, 0)"
    return f"""
WITH s AS (SELECT a.source, a.advisory_id, max(v.severity) AS severity FROM «advisories» a LEFT JOIN (SELECT source, advisory_id, {d.last_by('severity', rank)} FILTER (WHERE severity IS NOT NULL) AS severity FROM «vulns» GROUP BY source, advisory_id) v ON a.source = v.source AND a.advisory_id = v.advisory_id GROUP BY a.source, a.advisory_id)
SELECT 'vendor' AS dimension, vendor AS key, count(*) AS n FROM «products» WHERE coalesce(vendor, '') <> '' GROUP BY 2
UNION ALL SELECT 'range', kind, count(*) FROM «products» GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FROM s GROUP BY 2
UNION ALL SELECT 'severity', coalesce(severity, 'unknown'), count(*) FROM s GROUP BY 2
UNION ALL SELECT 'total', 'advisories', count(*) FROM s
UNION ALL SELECT 'total', 'products', count(*) FROM «products»
UNION ALL SELECT 'total', 'cves', count(DISTINCT cve) FROM «vulns»
UNION ALL SELECT 'total', 'unresolved vendors', count(*) FROM «products» WHERE coalesce(vendor, '') = '' AND coalesce(vendor_raw, '') <> ''
UNION ALL SELECT 'total', 'unparsed ranges', count(*) FROM «products» WHERE kind = 'unknown'
UNION ALL SELECT 'oldest', CAST(CAST(min(published) AS date) AS string), count(published) FROM «advisories»
UNION ALL SELECT 'newest', CAST(CAST(max(published) AS date) AS string), count(published) FROM «advisories»"""


def since(advisories: DataFrame, day: object) -> DataFrame:
    """advisories (published) from a day on; undated ones stay."""
    return advisories.where(F.col("published").isNull() | (F.col("published") >= F.lit(day)))


def by_cve(vulns: DataFrame, cves: list[str]) -> DataFrame:
    """Vulnerabilities of some CVEs, however they are spelled."""
    return vulns.where(F.upper(F.trim("cve")).isin([c.strip().upper() for c in cves]))


def by_advisory(table: DataFrame, advisory_id: str) -> DataFrame:
    return table.where(F.col("advisory_id") == advisory_id)


def product_of(products: DataFrame, source: str, advisory_id: str, product_id: str) -> DataFrame:
    return products.where((F.col("source") == source) & (F.col("advisory_id") == advisory_id) & (F.col("product_id") == product_id))


def in_canonical_order(advisories: DataFrame) -> DataFrame:
    """Advisories with nested products, vulnerabilities, references and warnings sorted: by id, by CVE and title, by url. Missing columns are left out."""
    order = {"products": lambda x: F.struct(x["product_id"]), "vulnerabilities": lambda x: F.struct(x["cve"], x["title"]), "references": lambda x: F.struct(x["url"])}
    out = advisories
    for c, key in order.items():
        if c in out.columns:
            out = out.withColumn(c, F.transform(F.array_sort(F.transform(c, lambda x: F.struct(key(x).alias("key"), F.to_json(x).alias("text"), x.alias("x")))), lambda x: x["x"]))  # noqa: B023
    return out.withColumn("warnings", F.array_sort("warnings")) if "warnings" in out.columns else out


# ---- the store

TABLES = ("advisories", "products", "vulnerabilities", "kev", "epss", "sources")


def save_corpus(tables: dict[str, DataFrame], path: str) -> None:
    """A corpus as Parquet tables under a path. Those with a source are laid out by it, and only the sources that are given are replaced."""
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"{name} is no table of a corpus")
        if "source" in df.columns and name != "sources":
            df.repartition("source").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def load_corpus(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a corpus; one that cannot be read is an error, and never an empty corpus."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def corpus_json(tables: dict[str, DataFrame]) -> DataFrame:
    """A whole corpus in JSON, a row each (part, value): advisories with their products and vulnerabilities, KEV and EPSS entries, and sources. Rows, so that no task holds the whole."""
    keys = ["source", "advisory_id"]
    nested = lambda name: tables[name].groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*[c for c in tables[name].columns if c not in keys]))).alias(name))
    whole = tables["advisories"].join(nested("products"), keys, "left").join(nested("vulnerabilities"), keys, "left")
    out = whole.select(F.lit("advisory").alias("part"), F.to_json(F.struct("*")).alias("value"))
    for name in ("kev", "epss", "sources"):
        out = out.unionByName(tables[name].select(F.lit(name).alias("part"), F.to_json(F.struct("*")).alias("value")))
    return out


# Built-in sources as (id, name, kind, licence, redistributable, on by default).
SOURCES = [
    ("cert-vde-csaf", "CERT@VDE (CSAF)", "advisories", "see the CERT@VDE terms of use", False, False), ("cisa-csaf", "CISA ICS advisories (CSAF)", "advisories", "public domain (US government work)", True, True), ("cisa-kev", "CISA Known Exploited Vulnerabilities", "enrichment", "public domain (US government work)", True, True),
    ("epss", "EPSS exploit prediction scores", "enrichment", "free for public use, see the FIRST EPSS terms", True, True), ("ics-advisory-project", "ICS Advisory Project", "advisories", "Open Database License (ODbL) v1.0", False, False), ("nvd", "NVD CVSS scores", "enrichment", "public domain (US government work)", True, False),
    ("schneider-csaf", "Schneider Electric (CSAF)", "advisories", "see the Schneider Electric terms of use", False, False), ("siemens-csaf", "Siemens ProductCERT (CSAF)", "advisories", "see the Siemens terms of use", False, False),
]

#: The table of sources (id, name, kind, licence, redistributable, default_on).
source_registry = Operator(lambda d: f"SELECT * FROM {d.values('t(id, name, kind, licence, redistributable, default_on)', SOURCES)}", ())


@operator("ids")
def source_files(d: Dialect) -> str:
    """ids (id) with a safe file name."""
    return f"SELECT DISTINCT id, {X.file_name(d, 'id')} AS file FROM «ids»"


@operator("cells")
def split_affected(d: Dialect) -> str:
    """cells (id, cell) of an advisory sheet as rows (id, place, name, version): cut at spaced bars, then at the first operator."""
    cut = d.split("cell", " | ")
    return f"""
SELECT id, p.place - 1 AS place, trim({d.extract('p.v', '^([^<>=]*)(.*)$', 1)}) AS name, trim({d.extract('p.v', '^([^<>=]*)(.*)$', 2)}) AS version
FROM (SELECT id, x.place AS pl, x AS p FROM {d.unnest(f"(SELECT id, {d.map(d.count_to(d.size(cut)), 'i', d.struct(place='i', v=d.get(cut, 'i - 1')))} AS a FROM «cells» WHERE cell IS NOT NULL) c", 'a', 'x')}) y"""


@operator("rows")
def read_kev_rows(d: Dialect) -> str:
    """rows (cve_id, ransomware) of a catalogue of exploited flaws: ids of the right shape, and whether ransomware is known to use them."""
    return f"SELECT upper(trim(cve_id)) AS cve, lower(coalesce(ransomware, '')) = 'known' AS ransomware FROM «rows» WHERE {d.matches('upper(trim(cve_id))', '^CVE-[0-9]{4}-[0-9]{4,}$')}"
