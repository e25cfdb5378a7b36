"""Rows S1, S19-S20, A2, A18-A19, A27-A28, U1: from files to an inventory, to findings, to documents."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from fenwatch.operators import corpus as C
from fenwatch.operators import report as R
from fenwatch.plans import ingest as I
from fenwatch.plans import match as G
from tests.test_sources import NMAP, ZEEK, capture, enip_reply, frame, modbus_reply


@pytest.fixture(scope="module")
def inventory(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("inputs")
    for name in ("captures", "scans", "logs"):
        (top / name).mkdir()
    capture(top / "captures" / "a.pcap", [frame("10.0.0.9", "10.0.0.1", 50000, 502, b"", 2), frame("10.0.0.1", "10.0.0.9", 502, 50000, modbus_reply()), frame("10.0.0.7", "10.0.0.9", 44818, 40000, enip_reply(b"1756-L81E/B Module"))])
    (top / "captures" / "bad.pcap").write_bytes(b"no capture at all")
    (top / "scans" / "s.xml").write_text(NMAP.replace("10.0.0.1", "10.0.0.3"))
    (top / "logs" / "conn.log").write_text(ZEEK)
    (top / "logs" / "s7comm_x.log").write_text(json.dumps({"ts": 1700000000, "id.orig_h": "10.0.0.9", "id.resp_h": "10.0.0.1", "vendor": "Later", "serial_number": "77"}) + "\n")
    return I.ingest(spark, str(top / "captures"), str(top / "scans"), str(top / "logs"))


def test_inventory(inventory, spark):
    assets = {r["ipv4"]: r for r in inventory.assets.collect()}
    assert set(assets) == {f"10.0.0.{k}" for k in (1, 2, 3, 7, 9)}
    one = assets["10.0.0.1"]
    assert (one["vendor_raw"], one["catalog_number"], one["serial"], one["sources"]) == ("Acme", "AC-100", "77", ["pcap", "zeek"])  # the capture's word counts first, the log fills up
    assert (one["role"], one["purdue"]) == ("plc", "L1") and assets["10.0.0.9"]["vendor_raw"] is None
    assert (assets["10.0.0.3"]["mac"], assets["10.0.0.3"]["catalog_number"]) == ("00:1b:1b:00:00:01", "6ES7 999-0AA00-0XX0")
    flows = {(r["dst_addr"] if "dst_addr" in r else r["dst"], r["port"]): r for r in inventory.flows.collect()}
    assert flows[(one["asset_id"], 502)]["packets"] == 2 + 9
    services = {(r["asset_id"], r["port"]): r["protocol"] for r in inventory.services.collect()}
    assert services[(one["asset_id"], 502)] == "modbus" and (assets["10.0.0.2"]["asset_id"], 80) not in services
    assert [r["warning"] for r in inventory.warnings.collect()] == ["not a readable capture"]
    stats = I.ingest_stats(inventory).first()
    assert (stats["assets"], stats["identified"], stats["warnings"]) == (5, 3, 1)
    with pytest.raises(ValueError):
        I.ingest(spark)


def test_inventory_is_stored_and_merged(inventory, spark, tmp_path):
    I.save_inventory(inventory, str(tmp_path))
    back = I.load_inventory(spark, str(tmp_path))
    assert back.assets.count() == 5
    both = I.merged_with(inventory, back)
    assert both.assets.count() == 5 and {r["asset_id"] for r in both.assets.collect()} == {r["asset_id"] for r in inventory.assets.collect()}
    assert {r["part"] for r in I.inventory_json(inventory).collect()} == {"asset", "flow"}


PRODUCTS = "source string, advisory_id string, product_id string, vendor_raw string, name string, product_raw string, family_raw string, catalog_number string, cpe string, version_raw string"
VULNS = "source string, advisory_id string, place int, cve string, affected array<string>, cvss_version string, base_score double, vector string, severity string, has_fix boolean, remediations array<struct<category:string,details:string,url:string,product_ids:array<string>>>, `references` array<string>"
IDENTITIES = "id string, vendor_raw string, vendor string, product_raw string, product string, family string, model string, catalog_number string, firmware string"


@pytest.fixture(scope="module")
def corpus(spark):
    advisories = spark.createDataFrame([("feed", "A-1", 1, "First", "https://x.example/a-1", "2024-01-01"), ("feed", "A-2", 2, "Old", None, "1999-01-01"), ("feed", "A-3", 3, "Undated", None, None)], "source string, advisory_id string, place int, title string, url string, published string").withColumn("published", F.col("published").cast("timestamp"))
    products = spark.createDataFrame(
        [
            ("feed", "A-1", "P1", "Rockwell Automation, Inc.", "ControlLogix module (1756-L81E)", None, None, None, None, "< 5.0"),
            ("feed", "A-1", "P2", "Siemens", "SIMATIC S7-1200 CPU family", "SIMATIC S7-1200 CPU family", None, None, None, "nobody knows 7"),
            ("feed", "A-2", "P1", "Siemens AG", "SIMATIC S7-1200", None, None, None, None, ""),
            ("feed", "A-3", "P1", "Siemens AG", "CPU 1217C", "CPU 1217C", "SIMATIC S7-1200", None, None, None),
        ],
        PRODUCTS,
    )
    fix = [("vendor_fix", "Update.", "u", ["P1"]), ("mitigation", "Segment.", "", None), ("mitigation", "Other.", "", ["P2"])]
    vulns = spark.createDataFrame(
        [("feed", "A-1", 1, "CVE-2024-0001", ["P1"], "3.1", 9.1, "CVSS:3.1/a", "critical", True, fix, ["https://z.example", "https://x.example/a-1"]), ("feed", "A-1", 2, "CVE-2024-0002", ["P2"], "2.0", 10.0, None, "critical", False, [], []), ("feed", "A-2", 1, "CVE-1999-0001", [], None, None, None, "low", False, [], [])], VULNS
    )
    kev = spark.createDataFrame([("CVE-2024-0001",), ("CVE-2024-0001",)], "cve string")
    epss = spark.createDataFrame([("CVE-2024-0001", 0.25), ("CVE-2024-0001", 0.2)], "cve string, score double")
    return G.Corpus(advisories, products, vulns, kev, epss)


def test_match(spark, corpus):
    identities = spark.createDataFrame(
        [("a1", "Allen-Bradley", None, "1756-L81E/B", None, None, None, "1756-L81E", "V4.006"), ("a2", "Siemens AG", None, "SIMATIC S7-1200", None, None, None, None, None), ("a3", "Nobody", None, "Box", None, None, None, None, "1"), ("a4", "", "", "", "", "", "", "", ""), ("a5", "Rockwell", None, "1756-L81E", None, None, None, "1756-L81E", "5.0")],
        IDENTITIES,
    )
    got = G.match(identities, corpus)
    rows = {(r["asset_id"], r["advisory_id"]): r for r in got.findings.collect()}
    assert {k: r["tier"] for k, r in rows.items()} == {("a1", "A-1"): "confirmed", ("a2", "A-1"): "possible", ("a2", "A-2"): "confirmed", ("a2", "A-3"): "possible"}
    first = rows[("a1", "A-1")]
    assert (first["cves"], first["kev"], first["epss"], first["cvss"], first["fix_available"]) == ("CVE-2024-0001", True, 0.25, 9.1, True)
    assert [(r["kind"], r["passed"]) for r in first["reasons"]] == [("vendor_alias", True), ("catalog_number", True), ("version_in_range", True)]
    assert first["version_check"]["explanation"] == "V4.006 (components 4.6) falls inside versions below 5.0" and first["version_check"]["comparator"] == "rockwell"
    assert [(r["category"], r["details"]) for r in first["remediations"]] == [("vendor_fix", "Update."), ("mitigation", "Segment.")] and first["references"] == ["https://x.example/a-1", "https://z.example"]
    unknown = rows[("a2", "A-1")]
    assert unknown["reasons"][-1]["kind"] == "version_unknown" and not unknown["reasons"][-1]["passed"] and unknown["cves"] == "CVE-2024-0002"
    finer = rows[("a2", "A-3")]
    assert [r["passed"] for r in finer["reasons"]] == [True, True, False, True] and "CPU 1217C" in finer["reasons"][2]["detail"]
    s = got.summary.first()
    assert (s["total"], s["assets_considered"], s["assets_unidentified"], s["assets_unknown_vendor"], s["ruled_out_by_version"], s["cves"]) == (4, 5, 1, 1, 1, 3)
    late = G.match(identities, corpus, since="2020-01-01", tier="likely").findings
    assert {(r["asset_id"], r["advisory_id"]) for r in late.collect()} == {("a1", "A-1")}
    report = R.described(got.findings, got.canonical)
    assert R.sheet(report).count() == 4
    doc = json.loads(R.vex_document(report, "Plant", "https://plant.example", __import__("datetime").datetime(2024, 1, 1), summary=got.summary).first()["document"])
    assert {v.get("cve") for v in doc["vulnerabilities"]} == {"CVE-2024-0001", "CVE-2024-0002", "CVE-1999-0001", None}
    assert doc["document"]["notes"][-1]["text"].startswith("1 of 5 devices")


def test_findings_of_an_inventory(inventory, corpus):
    found = G.match(I.identities_of(inventory), corpus).findings.collect()
    assert [(r["advisory_id"], r["tier"]) for r in found] == [("A-1", "confirmed")]


def test_empty_inputs(spark, corpus):
    empty = lambda df: df.limit(0)
    nothing = G.Corpus(*(empty(x) for x in (corpus.advisories, corpus.products, corpus.vulnerabilities, corpus.kev, corpus.epss)))
    identities = spark.createDataFrame([("a1", "Siemens", None, None, None, None, None, None, None)], IDENTITIES)
    got = G.match(identities, nothing)
    assert got.findings.count() == 0 and got.summary.first()["assets_considered"] == 1


def test_corpus_is_stored(spark, corpus, tmp_path):
    tables = {"advisories": corpus.advisories, "products": corpus.products, "vulnerabilities": corpus.vulnerabilities, "kev": corpus.kev, "epss": corpus.epss, "sources": C.source_registry()}
    C.save_corpus(tables, str(tmp_path))
    other = corpus.advisories.limit(1).withColumn("source", F.lit("other"))
    C.save_corpus({"advisories": other}, str(tmp_path))  # other sources stay
    back = C.load_corpus(spark, str(tmp_path))
    assert {r["source"]: r["n"] for r in back["advisories"].groupBy("source").agg(F.count("*").alias("n")).collect()} == {"feed": 3, "other": 1}
    C.save_corpus({"advisories": corpus.advisories.limit(1)}, str(tmp_path))  # what the source has withdrawn goes
    assert C.load_corpus(spark, str(tmp_path))["advisories"].where("source = 'feed'").count() == 1
    parts = {r["part"] for r in C.corpus_json(tables).collect()}
    assert parts == {"advisory", "kev", "epss", "sources"}
    with pytest.raises(Exception, match="[Pp]ath"):
        C.load_corpus(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError):
        C.save_corpus({"odd": other}, str(tmp_path))


def test_faults_and_replacement(spark):
    advisories = spark.createDataFrame([("s", "A", 1), ("s", "A", 2), ("", "B", 3), ("s", None, 4), ("s", "C", 5), ("s", "D", 6)], "source string, advisory_id string, place int")
    products = spark.createDataFrame([("s", "A", "P1"), ("s", "A", "P1"), ("s", "D", "")], "source string, advisory_id string, product_id string")
    vulns = spark.createDataFrame([("s", "A")], "source string, advisory_id string")
    got = {(r["place"], r["fault"]) for r in C.advisory_faults(advisories, products, vulns).collect()}
    assert got == {(4, "no id"), (3, "no source"), (5, "neither product nor vulnerability"), (6, "a product has no id"), (1, "a product id is used again"), (2, "a product id is used again"), (2, "listed before")}
    corpus = spark.createDataFrame([("s", "old", 1), ("t", "kept", 2)], "source string, advisory_id string, place int")
    assert {r["advisory_id"] for r in C.replace_source(corpus, advisories.where("place = 5")).collect()} == {"C", "kept"}


def test_probed_inventory(spark, tmp_path):
    from fenwatch.operators.planning import read_audit

    lines = [{"timestamp": "2024-01-01T00:00:00Z", "target": "10.0.0.1:5020", "protocol": "modbus", "outcome": "answered", "response": modbus_reply().hex(" ")}, {"timestamp": "2024-01-01T00:00:01Z", "target": "10.0.0.2:502", "protocol": "modbus", "outcome": "answered", "response": "00 07 00 00 00 03 01 ab 01"}, {"timestamp": "2024-01-01T00:00:02Z", "target": "10.0.0.3:502", "protocol": "modbus", "outcome": "no-answer"}]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    inv = I.probed(read_audit(spark, str(tmp_path)))
    assert {r["ipv4"]: r["catalog_number"] for r in inv.assets.collect()} == {"10.0.0.1": "AC-100", "10.0.0.2": None}
    assert {r["port"] for r in inv.services.collect()} == {5020, 502}
    assert any("refused: illegal function" in r["notes"] for r in inv.evidence.collect())


def test_frames_of_odd_sizes_are_survived():
    from fenwatch.sources.captures import layers

    whole = frame("10.0.0.1", "10.0.0.2", 1, 2, b"abc")
    for k in range(len(whole)):
        layers(1, whole[:k])
    layers(1, b"\x01\x80\xc2\0\0\x0e" + b"\2" * 6 + b"\x88\xcc" + struct.pack(">H", 6 << 9 | 40) + b"x")
