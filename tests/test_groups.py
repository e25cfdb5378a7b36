"""Findings, counters and documents at scale: rows are made for groups of devices and lists of CVEs, and not for each pair."""

import glob

import pytest
from pyspark.sql import functions as F

from fenwatch.operators import groups as U
from fenwatch.operators import lookups as L
from fenwatch.operators import report as R
from fenwatch.plans import match as G
from fenwatch.plans.graph import shared_folder
from tests.test_chain import IDENTITIES, PRODUCTS, VULNS
from tests.test_report import FINDINGS

N = 150


@pytest.fixture(scope="module")
def many(spark):
    """N devices of one identity and N products of one, in one advisory; a device without a version, and a product that is ruled out."""
    one = ("Siemens AG", None, "SIMATIC S7-1200", None, None, None, None)
    identities = spark.createDataFrame([(f"a{k}", *one, "V4.0") for k in range(N)] + [("b", *one, None), ("c", "Nobody", None, "Box", None, None, None, None, "1")], IDENTITIES)
    products = spark.createDataFrame([("feed", "A-1", f"P{k:03d}", "Siemens", "SIMATIC S7-1200", None, None, None, None, "< 5.0" if k else "< 3.0") for k in range(N)], PRODUCTS)
    vulns = spark.createDataFrame([("feed", "A-1", k, f"CVE-2024-{k:04d}", [] if k % 2 else [f"P{k:03d}", "none"], "3.1", 5.0, "CVSS:3.1/a", "medium", k == 3, [], []) for k in range(20)], VULNS)
    kev, epss = spark.createDataFrame([("CVE-2024-0002",)], "cve string"), spark.createDataFrame([("CVE-2024-0004", 0.25)], "cve string, score double")
    return {G.IDENTITIES: identities, G.PRODUCTS: products, G.VULNERABILITIES: vulns, G.KEV: kev, G.EPSS: epss, G.VENDOR_TABLE: L.BUILTIN_VENDORS(), G.FAMILY_TABLE: L.BUILTIN_FAMILIES()}


def kept_rows(spark, action):
    """An action's result, and how many rows the tables have that it keeps."""
    tables = lambda: set(glob.glob(shared_folder(spark).removeprefix("file://") + "/kept-*"))
    before = tables()
    got = action()
    return got, sum(spark.read.parquet(t).count() for t in tables() - before)


def test_counters_keep_no_row_per_candidate(many, spark):
    s, rows = kept_rows(spark, lambda: G.SUMMARY.spark(spark, "", dict(many)).first())
    assert (s["total"], s["confirmed"], s["likely"], s["assets"], s["cves"], s["with_kev"], s["with_fix"]) == (N + 1, N, 1, N + 1, 20, N + 1, N + 1)
    assert (s["assets_considered"], s["assets_unidentified"], s["assets_unknown_vendor"], s["ruled_out_by_version"]) == (N + 2, 0, 1, N)
    assert rows < 10 * N


def test_verdicts_are_counted_by_group(many, spark):
    got, rows = kept_rows(spark, lambda: {r["result"]: (r["n"], r["assets"]) for r in G.COUNTED.spark(spark, "", dict(many)).collect()})
    assert got == {"affected": (N * (N - 1), N), "not_affected": (N, N), "indeterminate": (N, 1)} and rows < 10 * N
    assert G.CANDIDATES.spark(spark, "", dict(many)).groupBy("result").count().count() == 3


def test_grades_by_group(many, spark):
    got, rows = kept_rows(spark, lambda: {r["asset_id"]: r for r in G.GRADED.spark(spark, "", dict(many)).collect()})
    assert len(got) == N + 1 and rows < 10 * N
    assert (got["a0"]["product_id"], got["a0"]["n_also"], got["a0"]["tier"], got["a0"]["matched"]) == ("P001", N - 2, "confirmed", [f"P{k:03d}" for k in range(1, N)])
    assert (got["b"]["product_id"], got["b"]["n_also"], got["b"]["tier"], len(got["b"]["matched"])) == ("P000", N - 1, "likely", N)


def test_findings_name_lists(many, spark):
    made = dict(many)
    narrow, lists = G.NARROW.spark(spark, "", made), G.CVE_LISTS.spark(spark, "", made)
    assert lists.count() == 2 and narrow.count() == N + 1 and "cves" not in narrow.columns
    whole = {r["asset_id"]: r for r in G.FINDINGS.spark(spark, "", made).collect()}
    assert whole["b"]["n_cves"] == 20 and whole["a0"]["n_cves"] == 19 and whole["a0"]["cves"].split()[:2] == ["CVE-2024-0001", "CVE-2024-0002"]
    few = U.MOST_BROADCAST
    try:  # lists too large to be broadcast
        U.MOST_BROADCAST = 0
        assert {r["asset_id"]: r["cves"] for r in U.with_texts(narrow, lists, "cve_list").collect()} == {k: r["cves"] for k, r in whole.items()}
    finally:
        U.MOST_BROADCAST = few


@pytest.fixture(scope="module")
def listed(spark):
    """70 devices with two lists of CVEs, and a finding without any."""
    lists = [("x", " ".join(f"CVE-{k}" for k in range(40))), ("y", "CVE-3 CVE-50"), ("z", "")]
    rows = [(f"{'xy'[k % 2]}{k}", f"d{k % 70}", "xy"[k % 2], ["confirmed", "likely", "likely"][k % 3], float(k % 5)) for k in range(140)] + [("z1", "d1", "z", "likely", 9.0)]
    kind = spark.createDataFrame([], FINDINGS).drop("cves")
    base = spark.createDataFrame([(a, d, l, t, p, f"A-{l}", "P", i % 2 == 0, p / 10, 5.0, "CVSS:3.1/x", "high", False) for i, (a, d, l, t, p) in enumerate(rows)], "asset_id string, device string, cve_list string, tier string, priority double, advisory_id string, product_id string, kev boolean, epss double, cvss double, vector string, severity string, fix_available boolean")
    return kind.unionByName(base.withColumn("finding_id", F.concat_ws(":", "asset_id", "advisory_id")), allowMissingColumns=True), spark.createDataFrame(lists, "cve_list string, cves string"), rows, dict(lists)


def test_vex_by_lists(listed):
    findings, lists, rows, texts = listed
    expected, kev, scores = {}, {}, {}
    for k, (_, device, name, tier, p) in enumerate(rows):
        for cve in texts[name].split(" "):
            v = cve or f"A-{name}"
            expected[v, device] = expected.get((v, device), False) or tier == "confirmed"
            kev[v] = (kev.get(v, (False, 0))[0] or k % 2 == 0, max(kev.get(v, (False, 0))[1], p / 10))
            scores.setdefault(v, set()).add(device)
    assert {(r["vuln"], r["device"]): r["status"] == "known_affected" for r in R.vex_groups(findings, lists).collect()} == expected
    assert {r["vuln"]: (r["kev"], r["epss"]) for r in R.vex_threats(findings, lists).collect()} == kev
    assert {r["vuln"]: r["devices"] for r in R.vex_scores(findings, lists).collect()} == {v: sorted(d) for v, d in scores.items()}
    plain = findings.join(lists, "cve_list").drop("cve_list").withColumn("references", F.array(F.lit("https://x.example/CVE-3"), F.concat(F.lit("https://y.example/"), "advisory_id"))).withColumn("remediations", F.array(F.struct(F.lit("vendor_fix").alias("category"), F.concat(F.lit("Update "), "advisory_id").alias("details"), F.lit("").alias("url"))))
    refs = {}
    for r in R.vex_references(plain).collect():
        refs.setdefault(r["vuln"], {})[r["k"]] = r["url"].rsplit("/", 1)[1]
    assert refs["CVE-3"] == {1: "A-x", 2: "A-y", 3: "CVE-3"} or refs["CVE-3"] == {1: "A-y", 2: "A-x", 3: "CVE-3"}
    assert refs["CVE-50"] == {1: "A-y", 2: "CVE-3"} and refs["A-z"] == {1: "A-z", 2: "CVE-3"}
    told = {(r["vuln"], r["category"], r["for"]): r["details"] for r in R.vex_remediations(plain).collect()}
    assert told["CVE-50", "vendor_fix", "all"] == "Update A-y" and ("A-z", "mitigation", "under_investigation") in told and sorted(told["CVE-3", "vendor_fix", "all"].split("Update ")) == ["", "A-x ", "A-y"]


def test_sheet_by_lists(listed):
    findings, lists, rows, texts = listed
    got = R.sheet(findings.repartition(7), lists).collect()
    assert [r["finding_id"] for r in got] == [r["finding_id"] for r in R.sheet(findings.join(lists, "cve_list")).collect()]
    assert all(r["cves"] == texts[r["finding_id"][-1]] for r in got)


def test_chain_tells_remedies_once(spark, many):
    """Remedies for products, for a vulnerability's products, and for all; and no finding is kept with its texts."""
    fix = [("vendor_fix", "All.", "", None), ("mitigation", "Only P000.", "", ["P000"])]
    vulns = spark.createDataFrame([("feed", "A-1", 1, "CVE-1", [], "3.1", 5.0, "v", "low", True, fix, ["https://x.example"]), ("feed", "A-1", 2, "CVE-2", ["P000"], "3.1", 5.0, "v", "low", True, [("mitigation", "Named.", "", None), ("vendor_fix", "Other.", "", ["P999"])], ["https://y.example"])], VULNS)
    advisories = spark.sql("SELECT 'feed' AS source, 'A-1' AS advisory_id, 1 AS place, 'T' AS title, 'https://a.example' AS url, CAST(NULL AS timestamp) AS published")
    found, rows = kept_rows(spark, lambda: {r["asset_id"]: r for r in G.match(many[G.IDENTITIES], G.Corpus(advisories, many[G.PRODUCTS], vulns, many[G.KEV], many[G.EPSS])).findings.collect()})
    assert len(found) == N + 1 and rows < 10 * N
    told = {a: ([x["details"] for x in found[a]["remediations"]], found[a]["references"], len(found[a]["also_matched"]), found[a]["title"]) for a in ("a0", "b")}
    assert told == {"a0": (["All."], ["https://a.example", "https://x.example"], N - 2, "T"), "b": (["All.", "Only P000.", "Named."], ["https://a.example", "https://x.example", "https://y.example"], N - 1, "T")}
