"""Rows N1-N18, J2-J9, A2, A7-A9, A17, B1, F4 on cases worked out by hand, and the package's rules."""

import ast
import subprocess
import sys
from pathlib import Path

import pytest

from fenwatch.functions import text as X
from fenwatch.functions.dialect import operator
from fenwatch.operators import lookups as L
from fenwatch.operators import matching as M
from fenwatch.operators import network as N
from fenwatch.operators import planning as P

ROOT = Path(__file__).parents[1]


def test_vendors(spark):
    cases = {
        "Siemens AG": ("siemens", "exact"),
        "SIEMENS": ("siemens", "exact"),
        "Siemens Holding Limited": ("siemens", "suffix_trimmed"),
        "Siemens GmbH & Co. KG": ("siemens", "token_subset"),
        "Allen-Bradley": ("rockwell-automation", "exact"),
        "the Schneider Electric group": ("schneider-electric", "token_subset"),
        "Siemens Energy AG": ("siemens-energy", "exact"),
        "Nobody": (None, "none"),
    }
    got = {r["name"]: (r["vendor"], r["method"]) for r in L.lookup_vendors(spark.createDataFrame([(k,) for k in cases], "name string"), L.BUILTIN_VENDORS()).collect()}
    assert got == cases


def test_families(spark):
    cases = {
        ("siemens", "S7-1200"): ("SIMATIC S7-1200", "exact", False),
        ("siemens", "CPU 1214C DC/DC/DC"): ("SIMATIC S7-1200", "token_subset", True),
        ("siemens", "CPU1214C"): ("SIMATIC S7-1200", "exact", True),
        ("abb", "CPU 1214C"): (None, "none", False),
        (None, "Relion 670 series"): ("Relion 670", "exact", False),
    }
    got = {(r["vendor"], r["name"]): (r["display"], r["method"], r["via_model"]) for r in L.lookup_families(spark.createDataFrame(list(cases), "vendor string, name string"), L.BUILTIN_FAMILIES()).collect()}
    assert got == cases


def test_order_codes(spark):
    cases = {
        "6ES7 214-1AG40-0XB0": ("siemens", "SIMATIC S7-1200", "CPU 1214C", "6ES7 214-1AG40-0XB0", 0.9),
        "6gk5208-0ba10-2aa3": ("siemens", "SCALANCE", None, "6GK5 208-0BA10-2AA3", 0.6),
        "6GK6108-0AM00": ("ruggedcom", "RUGGEDCOM", None, "6GK61080AM00", 0.6),
        "1756-L81E": ("rockwell-automation", "ControlLogix", "L81E", "1756-L81E", 0.9),
        "2711P-T10C4D8": ("rockwell-automation", "PanelView Plus", None, "2711P-T10C4D8", 0.7),
        "R04CPU": ("mitsubishi-electric", "MELSEC iQ-R", "R04CPU", "R04CPU", 0.85),
        "FX5U-32M": ("mitsubishi-electric", "MELSEC iQ-F", "FX5U", "FX5U", 0.85),
        "bogus": (None, None, None, None, None),
    }
    got = {r["code"]: (r["vendor"], r["family"], r["model"], r["normalized"], r["confidence"]) for r in L.parse_order_codes(spark.createDataFrame([(k,) for k in cases], "code string")).collect()}
    assert got == cases


def test_text_keys(spark):
    @operator("t")
    def keys(d):
        return f"SELECT s, {X.vendor_key(d, 's')} AS vendor, {X.clean_version(d, 's')} AS version, {X.product_key(d, 's')} AS product, {X.mac_text(d, 's')} AS mac FROM «t»"

    got = {r["s"]: r for r in keys(spark.createDataFrame([("Müller-Straße  (AG)",), ("Firmware Version: V4.5 ",), ("00-1B-1B-00-00-0A",), ("",)], "s string")).collect()}
    assert got["Müller-Straße  (AG)"]["vendor"] == "mueller strasse ag"
    assert got["Firmware Version: V4.5 "]["version"] == "V4.5"
    assert got["00-1B-1B-00-00-0A"]["mac"] == "00:1b:1b:00:00:0a" and got[""]["mac"] is None and got[""]["vendor"] == ""


ASSETS = "sig_a string, vendor string, model string, product string, product_raw string, family string, catalog_number string"
NODES = "sig_p string, vendor string, model string, product string, product_raw string, name string, family string, family_raw string, catalog_number string, cpe string"


def test_identity_comparison(spark):
    node = lambda sig, vendor="v", **k: (sig, vendor, k.get("model"), k.get("product"), k.get("raw"), k.get("name"), k.get("family"), k.get("family_raw"), k.get("code"), k.get("cpe"))
    assets = [
        ("code", "v", None, None, None, None, "6ES7 214-1AG40"), ("model", "v", "CPU 1214C", None, "PLC X", "Family One", None), ("family", "v", None, None, None, "Family One", None), ("other", "w", "CPU 1214C", None, None, None, None), ("generic", "v", None, "controller", None, None, None),
    ]
    nodes = [
        node("same code", code="6ES72141AG40"), node("cpe", cpe="cpe:2.3:h:v:6es7_214-1ag40"), node("other code", code="9999", name="CPU 1214C"),
        node("exact", model="CPU-1214C"), node("within", name="CPU 1214C firmware versions"), node("family", family="Family One"), node("finer", family="Family One", model="CPU 1217C"), node("generic", product="controller"), node("short", name="PLC"),
    ]
    a, n, names = spark.createDataFrame(assets, ASSETS), spark.createDataFrame(nodes, NODES), spark.createDataFrame([], "of_vendor string, name string")
    got = {(r["sig_a"], r["sig_p"]): (r["strength"], r["more_specific"]) for r in M.compare_identities(a, n, M.asset_fields(a, names), M.node_fields(n, names)).collect()}
    assert got == {
        ("code", "same code"): (3, False), ("code", "cpe"): (3, False), ("model", "exact"): (2, False), ("model", "within"): (2, False), ("model", "other code"): (2, False),
        ("model", "family"): (1, False), ("model", "finer"): (1, True), ("family", "family"): (1, False), ("family", "finer"): (1, True),
    }


def test_best_candidate(spark):
    columns = "asset_id string, source string, advisory_id string, product_id string, strength int, more_specific boolean, reason string, result string"
    data = [
        ("a", "s", "1", "P2", 2, False, "r", "affected"), ("a", "s", "1", "P1", 2, False, "r", "affected"), ("a", "s", "1", "P0", 3, True, "r", "affected"),
        ("a", "s", "2", "P1", 1, False, "r", "not_affected"), ("a", "s", "3", "P1", 1, True, "r", "affected"), ("a", "s", "4", "P1", 1, False, "r", "indeterminate"),
    ]
    got = {r["advisory_id"]: (r["product_id"], r["tier"], r["n_also"]) for r in M.grade_candidates(spark.createDataFrame(data, columns)).collect()}
    assert got == {"1": ("P1", "confirmed", 2), "3": ("P1", "possible", 0), "4": ("P1", "likely", 0)}


def test_classification_and_states(spark):
    services = spark.createDataFrame([("a", 502, ""), ("a", 80, "http"), ("b", 502, "http"), ("c", 44818, "enip"), ("c", 502, None)], "asset_id string, port int, protocol string")
    assets = spark.createDataFrame([("a", "", ""), ("b", "", ""), ("c", "hmi", ""), ("d", "plc", "")], "asset_id string, role string, purdue string")
    got = {r["asset_id"]: (r["role"], r["purdue"], r["by_port"]) for r in N.classify_assets(services, assets).collect()}
    assert got == {"a": ("plc", "L1", 502), "b": (None, None, None), "c": ("hmi", "L2", 502), "d": ("plc", None, None)}
    states = spark.createDataFrame([(1, "S0", 5, 5), (2, "SF", 0, 9), (3, "SF", None, 9), (4, "SF", None, None), (5, "??", None, None)], "id int, state string, resp_pkts long, resp_ip_bytes long")
    assert {r["id"]: r["answered"] for r in N.responder_answered(states).collect()} == {1: False, 2: False, 3: True, 4: True, 5: False}


def test_targets(spark):
    specs = lambda *x: spark.createDataFrame([(s,) for s in x], "spec string")
    got = [r["address"] for r in P.expand_targets(specs("10.0.0.0/30", "10.0.0.2-10.0.0.4", "10.0.0.7", "10.0.1.0/31", " ", "fd00::1", "fd00::/127")).orderBy("n", "address").collect()]
    assert got == ["fd00::", "fd00::1", "10.0.0.1", "10.0.0.2", "10.0.0.3", "10.0.0.4", "10.0.0.7", "10.0.1.0", "10.0.1.1"]
    for wrong in ("10.0.0.0/15", "plc.example", "10.0.0.9-10.0.0.1", "10.0.0.300", "10.0.0.0/33", "fd00::/64", "fd00::zz"):
        with pytest.raises(ValueError):
            P.expand_targets(specs("10.0.0.1", wrong))
    with pytest.raises(ValueError):
        P.expand_targets(specs("10.0.0.0/20", "10.1.0.0/20"))
    assert P.expand_specs(specs("10.0.0.0/15")).count() == (1 << 17) - 2


def test_policies_templates_and_estimates(spark):
    policies = spark.createDataFrame([("a", {}, "safe"), ("b", {"delay_s": 0.01, "packets_per_s": 9.0, "least_attempts": 0.0}, "odd")], "id string, settings map<string,double>, risk string")
    assert {(r["id"], r["setting"]) for r in P.policy_faults(policies).collect()} == {("b", "delay_s"), ("b", "packets_per_s"), ("b", "least_attempts"), ("b", "risk")}
    kind = "id string, summary string, protocol string, port int, transport string, risk string, risk_note string, steps array<struct<purpose:string,request:string>>"
    templates = spark.createDataFrame([("modbus-id", "s", "modbus", 502, "tcp", "safe", None, [("p", "r")]), ("Odd id", "", "fox", 0, "sctp", "caution", "", [("", "r")]), ("empty", "s", "enip", 1, "tcp", "safe", None, None)], kind)
    faults = [r["id"] for r in P.template_faults(templates, ["modbus", "enip"]).collect()]
    assert faults.count("Odd id") == 7 and faults.count("empty") == 1 and faults.count("modbus-id") == 0
    assert P.select_templates(templates, ["modbus-id"]).count() == 1 and P.select_templates(templates, []).count() == 3
    with pytest.raises(ValueError):
        P.select_templates(templates, ["nothing"])
    plan = spark.createDataFrame([(2, "safe"), (3, "caution"), (4, "other")], "packets int, risk string")
    assert tuple(P.estimate_plan(plan, 2.0, 0.25, "caution").first()) == (2, 5, 2)
    assert tuple(P.estimate_plan(plan.limit(0)).first()) == (0, 0, 0)


def test_deny_rules_are_checked(spark):
    rows = [(1, "a", "why", "v", None, ""), (2, "a", "why", "v", "", ""), (3, " ", "why", "v", "", ""), (4, None, "why", "v", "", ""), (5, "b", "  ", "v", "", ""), (6, "c", None, "", "f", ""), (7, "d", "why", "", None, ""), (8, "e", "why", "", "", "p")]
    rules = spark.createDataFrame(rows, "place int, id string, reason string, vendor string, family string, product string")
    assert {r["place"]: r["fault"] for r in P.deny_rule_faults(rules).collect()} == {2: "an earlier rule has the id", 3: "no id", 4: "no id", 5: "no reason", 6: "no reason", 7: "names no vendor, family or product"}
    assert P.deny_rule_faults(rules.limit(0)).count() == 0 and P.checked_rules(rules.where("place IN (1, 8)")).count() == 2
    with pytest.raises(ValueError, match="rule 5"):
        P.checked_rules(rules.where("place = 5"))


def test_audits(spark, tmp_path):
    import json

    lines = [{"kind": "run"}] + [{"timestamp": f"2024-01-01T00:00:0{k}Z", "target": "10.0.0.1:502", "template_id": "modbus-id", "protocol": "modbus", "outcome": o, "response": "01 02"} for k, o in enumerate(["answered", "no-answer", "unreachable", "skipped-denied", "answered", "answered"])]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    audit = P.read_audit(spark, str(tmp_path))
    assert bytes(audit.first()["response"]) == b"\x01\x02"
    assert tuple(P.audit_totals(audit).first())[1:] == (5, 3, 2, 1)
    (r,) = P.abort_points(P.audit_outcomes(audit)).collect()
    assert P.abort_rule(attempts=2, share=0.99)(P.audit_outcomes(audit)).first()["abort_at"] is None
    assert (r["sent"], r["failed"], r["abort_at"] is not None) == (5, 2, True)


def test_table_faults_and_files(spark, tmp_path):
    import json

    (tmp_path / "v.json").write_text(json.dumps([{"id": "acme", "display": "Acme", "aliases": ["acme corp"]}, {"id": "bolt", "display": "Bolt", "version_scheme": "abb"}]))
    table = L.read_vendors(spark, str(tmp_path / "v.json"))
    assert {r["vendor"] for r in L.lookup_vendors(spark.createDataFrame([("ACME Corp.",)], "name string"), table).collect()} == {"acme"}
    (tmp_path / "w.json").write_text(json.dumps([{"id": "acme", "display": "Acme", "aliases": ["shared"]}, {"id": "bolt", "display": "Bolt", "aliases": ["Shared"]}]))
    with pytest.raises(ValueError, match="several vendors: shared"):
        L.read_vendors(spark, str(tmp_path / "w.json"))
    (tmp_path / "f.json").write_text(json.dumps([{"id": "m", "vendor": "acme", "display": "M One", "models": ["m 100"]}]))
    families = L.read_families(spark, str(tmp_path / "f.json"))
    (r,) = L.lookup_families(spark.createDataFrame([("acme", "M 100")], "vendor string, name string"), families).collect()
    assert (r["display"], r["via_model"]) == ("M One", True)


def test_sniffed_texts(spark):
    texts = {
        1: ("Siemens, SIMATIC NET, SCALANCE X208, 6GK5 208-0BA10-2AA3, HW: Version 5", "siemens", "6GK5 208-0BA10-2AA3"), 2: ("Rockwell 1756-L81E/B LOGIX", "rockwell-automation", "1756-L81E/B"), 3: ("nothing here", None, None), 4: (None, None, None), 5: ("1756-L81E, in a sentence", None, "1756-L81E"), 6: ("2080-LC20 of no vendor", None, None), 7: ("", None, None),
    }
    got = L.sniffed(spark.createDataFrame([(k, v[0]) for k, v in texts.items()], "id int, text string"), L.BUILTIN_VENDORS(), L.BUILTIN_PARSERS())
    assert {r["id"]: (r["vendor"], r["code"]) for r in got.collect()} == {k: v[1:] for k, v in texts.items()}


def test_resolved_assets(spark):
    from fenwatch.operators.resolution import resolve_assets

    data = [("o1", 1, "10.0.0.1", "m1"), ("o2", 2, "10.0.0.1", None), ("o3", 3, None, "m1"), ("o4", 4, "10.0.0.4", None), ("o5", 5, None, None), ("o6", 6, "10.0.0.4", "m6"), ("o7", 7, "10.0.0.9", "m6")]
    got = {r["obs"]: r["asset"] for r in resolve_assets(spark.createDataFrame(data, "obs string, place long, ipv4 string, mac string")).collect()}
    assert got == {"o1": "o1", "o2": "o1", "o3": "o1", "o4": "o4", "o5": "o5", "o6": "o4", "o7": "o4"}


def test_long_chains_are_one_asset_and_stored_ones_grow(spark):
    from pyspark.sql import functions as F

    from fenwatch.operators.resolution import extend_assets, resolve_assets

    chain = spark.range(10_000).select(F.col("id").alias("obs"), F.xxhash64("id").alias("place"), F.concat(F.lit("i"), F.floor(F.col("id") / 2)).alias("ipv4"), F.concat(F.lit("m"), F.floor((F.col("id") + 1) / 2)).alias("mac")).repartition(7)
    least = chain.orderBy("place").first()["obs"]
    assert [r["asset"] for r in resolve_assets(chain).select("asset").distinct().collect()] == [least]
    schema = "obs string, place long, ipv4 string, mac string"
    rows = [(f"o{k}", k, f"10.0.0.{k // 3}" if k % 4 else "", f"m{k // 5}" if k % 3 else None) for k in range(60)] + [("first", -1, "10.0.0.2", "m9"), ("apart", 99, None, None)]
    want = {r["obs"]: r["asset"] for r in resolve_assets(spark.createDataFrame(rows, schema)).collect()}
    stored = resolve_assets(spark.createDataFrame(rows[:40], schema))
    got = {r["obs"]: r["asset"] for r in extend_assets(stored, spark.createDataFrame(rows[40:], schema)).collect()}
    assert got == want and want["o6"] == "first"
    assert resolve_assets(spark.createDataFrame([], schema)).count() == 0
    assert extend_assets(stored, spark.createDataFrame([], schema)).count() == 40


def test_nothing_else_imports_the_optional_package():
    for path in (ROOT / "fenwatch").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n or n == "corpus_pipeline" for n in names), path


def test_entry_without_the_optional_package(tmp_path):
    code = f"""
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == 'corpus_pipeline' or name.startswith('fenwatch.llm'):
            raise ModuleNotFoundError(name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {str(ROOT)!r})
import __spark_entry__ as e
assert 'flagship' in e.queries() and not any(q.startswith('op') for q in e.queries()), list(e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_views_and_keys_are_whole(spark, tmp_path):
    """A node for each part and a vulnerability for each line item; vendor keys of entire texts, long ones too."""
    from fenwatch.functions.text import LEGAL_FORMS
    from fenwatch.plans import registry as R

    sf = str(tmp_path)
    parts = [(k, k % 7) for k in range(1, 41)]
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{sf}/part.parquet")
    lines = [(k, k % 8, k % 40 + 1, k % 10 / 100, "A" if k % 2 else "R") for k in range(1, 101)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_discount double, l_returnflag string").write.parquet(f"{sf}/lineitem.parquet")
    spark.createDataFrame([(1, "Supplier 1")], "s_suppkey long, s_name string").write.parquet(f"{sf}/supplier.parquet")
    texts = ["word " * 20_000 + "tail Co. KG", "x" * 70 + " Siemens & Co. Ltd.", "Inc inc", "the A and B and", None]
    spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{sf}/documents.parquet")
    assert {r["product_id"] for r in R.PRODUCT.spark(spark, sf).collect()} == {f"P{k}" for k, _ in parts}
    got = sorted((r["advisory_id"], r["cve"] or "", r["base_score"]) for r in R.VULN.spark(spark, sf).collect())
    assert got == sorted((f"ADV-{k % 211}", "" if n % 7 == 6 else f"CVE-2020-{k % 5000:05}", round(x * 100, 1)) for k, n, _, x, _ in lines)
    keys = {r["name"]: (r["key"], r["bare"]) for r in R.queries()["n1_n2_vendor_keys"](spark, sf).collect()}

    def bare(key):
        words = key.split()
        for ends in (LEGAL_FORMS, ["&", "and"]):
            while len(words) > 1 and words[-1] in ends:
                words.pop()
        return " ".join(words)

    for t in texts[:-1]:
        key = " ".join(t.lower().replace(".", " ").split())
        assert keys[t] == (key, bare(key))
