"""Rows K1-K4 and A20-A25: a report's documents."""

import csv
import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from fenwatch.operators import report as R

CHECK = "struct<asset_version:string,constraint:string,comparator:string,result:string,explanation:string>"
FINDINGS = (
    "finding_id string, tier string, asset_id string, device string, source string, advisory_id string, product_id string, cves string, kev boolean, epss double, cvss double, vector string, severity string, fix_available boolean, priority double, title string, matched_vendor string, matched_product string, matched_version string, "
    f"remediations array<struct<category:string,details:string,url:string>>, `references` array<string>, published timestamp, device_vendor string, device_product string, device_firmware string, asset_address string, version_check {CHECK}"
)
VEX = {"publisher": "Plant", "namespace": "https://plant.example", "now": datetime(2024, 1, 2)}


@pytest.fixture(scope="module")
def findings(spark):
    check = ("1.0", "< 2", "generic", "affected", "1.0 is inside")
    tail = (datetime(2024, 1, 1), "v", "p", "1.0")
    return spark.createDataFrame(
        [
            ("f1", "confirmed", "s1", "Acme M1 1.0", "feed", "A-1", "P1", "CVE-1 CVE-2", True, 0.5, 9.8, "CVSS:3.0/x", "critical", True, 1200.0, "T", "Acme", "M1 unit", "< 2", [("vendor_fix", "Update.", "u"), ("odd", "Filter.", "")], ["https://cwe.mitre.org/1", "https://x.example/a1", "https://x.example/CVE-1"], *tail, "10.0.0.1", check),
            ("f2", "likely", "s2", "Acme M1 1.0", "feed", "A-1", "P1", "CVE-1", False, 0.0, 0.0, None, None, False, 100.0, "T", "Acme", "", "", [("none_available", "", ""), ("vendor_fix", "Update.", "")], ["https://y.example/CVE-1"], *tail, "10.0.0.2", check),
            ("f3", "possible", "s1", "Bolt <b>", "feed", "A-2", "P2", "", False, 0.0, 0.0, None, "low", False, 50.0, None, None, None, None, [], [], None, None, None, None, None, None),
        ],
        FINDINGS,
    )


def test_sheet(findings, tmp_path):
    rows = R.sheet(findings).collect()
    assert [r["finding_id"] for r in rows] == ["f1", "f2", "f3"] and rows[0].asDict().keys() == dict.fromkeys(R.SHEET).keys() and len(R.SHEET) == 27
    assert (rows[0]["kev"], rows[0]["epss"], rows[1]["cvss"], rows[1]["severity"], rows[0]["published"]) == ("yes", "0.50000", "", "", "2024-01-01")
    assert rows[0]["remediations"] == "vendor_fix: Update.: u | odd: Filter." and rows[1]["matched_product"] == "Acme" and rows[2]["matched_product"] == "P2"
    R.write_sheet(findings, str(tmp_path / "sheet"))
    (part,) = (tmp_path / "sheet").glob("part-*.csv")
    assert part.read_bytes().startswith(b"\xef\xbb\xbffinding_id")
    assert len(list(csv.reader(part.read_text("utf-8-sig").splitlines()))) == 4


def test_findings_json(findings):
    assert [json.loads(r["value"])["finding_id"] for r in R.findings_json(findings).collect()] == ["f1", "f2", "f3"]


def test_vex(findings):
    doc = json.loads(R.vex_document(findings, **VEX).first()["document"])
    head = doc["document"]
    assert head["distribution"]["tlp"]["label"] == "AMBER" and head["title"] == "Exposure of 2 products to 2 CVEs" and head["tracking"]["id"] == "FENWATCH-20240102-000000"
    assert [(p["product_id"], p["name"]) for p in doc["product_tree"]["full_product_names"]] == [("CSAFPID-0001", "Acme M1 1.0 (2 devices)"), ("CSAFPID-0002", "Bolt <b>")]
    by = {v.get("cve") or v["ids"][0]["text"]: v for v in doc["vulnerabilities"]}
    assert by["CVE-1"]["product_status"] == {"known_affected": ["CSAFPID-0001"], "under_investigation": []}
    assert by["A-2"]["product_status"]["under_investigation"] == ["CSAFPID-0002"] and by["A-2"]["ids"][0]["system_name"] == "feed"
    assert [t["details"] for t in by["CVE-2"]["threats"]][1].endswith("at 50.0 percent.")
    assert by["CVE-1"]["scores"] == [{"cvss_v3": {"version": "3.0", "vectorString": "CVSS:3.0/x", "baseScore": 9.8, "baseSeverity": "CRITICAL"}, "products": ["CSAFPID-0001"]}]
    assert {r["category"]: r["details"] for r in by["CVE-1"]["remediations"]} == {"vendor_fix": "Update.", "mitigation": "Filter."}
    assert [r["category"] for r in by["A-2"]["remediations"]] == ["none_available", "mitigation"]
    assert [r["url"] for r in by["CVE-1"]["references"]] == ["https://x.example/a1", "https://y.example/CVE-1", "https://x.example/CVE-1", "https://cwe.mitre.org/1"]
    assert "10.0.0.1" in json.dumps(json.loads(R.vex_document(findings, addresses=True, **VEX).first()["document"]))
    for wrong in ({"publisher": ""}, {"namespace": " "}, {"tlp": "PINK"}):
        with pytest.raises(ValueError):
            R.vex_document(findings, **(VEX | wrong))


def test_html_and_console(findings, spark):
    summary = spark.createDataFrame([(5, 2)], "assets_considered long, assets_unidentified long")
    page = R.html_page(findings, summary=summary)
    assert "&lt;b&gt;" in page and "<b>" not in page and page.count("<tr>") == 4 and "2 of 5 devices" in page
    assert R.html_page(findings, most=1).count("<tr>") == 2 and "2 further findings" in R.html_page(findings, most=1) and "further" not in page
    pages = sorted((r["page"], r["document"]) for r in R.html_pages(findings, per_page=2).collect())
    assert sum(d.count("<tr>") - 1 for _, d in pages) == 3 and all(d.startswith("<!DOCTYPE html>") for _, d in pages)
    assert R.console_table(findings.orderBy("finding_id"), ["finding_id", "kev", "cvss"], 2) == "finding_id  kev  cvss\nf1          yes  9.8\nf2          no   0.0"
    assert R.matching_text(findings, " cve-2 ").count() == 1


def test_numbers_over_many_partitions(spark):
    df = spark.range(1000).select(F.format_string("%05d", F.col("id") * 7).alias("x"))
    got = [r["k"] for r in R.numbered(df.repartition(16), "x").orderBy("x").collect()]
    assert got == list(range(1, 1001))


def test_windowed_flows(spark, tmp_path):
    from fenwatch.streaming.flows import windowed_flows

    kind = "src string, dst string, port int, transport string, packets long, bytes long, seen timestamp"
    spark.sql("SELECT 'a' AS src, 'b' AS dst, 502 AS port, 'tcp' AS transport, 2L AS packets, 120L AS bytes, timestamp'2024-01-01 00:01:00' + make_dt_interval(0, 0, id * 4) AS seen FROM (SELECT explode(sequence(0, 9)) AS id)").write.parquet(str(tmp_path / "in"))
    stream = windowed_flows(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
    query = stream.writeStream.outputMode("complete").format("memory").queryName("flows").start()
    query.processAllAvailable()
    query.stop()
    rows = spark.sql("SELECT * FROM flows").collect()
    assert sum(r["packets"] for r in rows) == 20 and len(rows) == 4


def test_keys_claim_only_what_is_built():
    """Each grouping of the document has a query of its own with SQL that was written apart."""
    from fenwatch.plans import registry

    for key in ("a20_vex_products", "a21_vex_groups", "a22_vex_scores", "a23_vex_threats", "a24_vex_remediations", "a25_vex_references"):
        assert key in registry.PLAIN and registry.PLAIN[key][1] is not None
