import duckdb
import pytest

from fenwatch.functions import versions as V

RANGES = [
    ("", "unknown", None, None), ("all", "all", None, None), ("All versions", "all", None, None), ("vers:generic/*", "all", None, None),
    ("vers:x/>=1.0|<2.0", "between", "1.0", "2.0"), ("vers:x/<2.0|>1.0", "between", "1.0", "2.0"), ("vers:x/!=3", "unknown", None, None), ("vers:x/1|2|3", "unknown", None, None), ("vers:x/<=4.5", "lte", None, "4.5"), ("vers:nothing", "unknown", None, None),
    ("< V4.5", "lt", None, "v4.5"), (">=1.2 <2", "between", "1.2", "2"), ("=3.1", "eq", "3.1", "3.1"), ("<=LG", "unknown", None, None), ("<1.0 <2.0", "lt", None, "2.0"),
    ("2.1.x", "prefix", None, None), ("linux", "unknown", None, None), ("V2.*", "prefix", None, None),
    ("1.0 to 2.0", "between", "1.0", "2.0"), ("1.0-rc1", "eq", "1.0-rc1", "1.0-rc1"), ("between 1.0 and 3.0", "between", "1.0", "3.0"), ("2.0 to 1.0", "unknown", None, None),
    ("up to but not including 3", "lt", None, "3"), ("versions prior to 4.2", "lt", None, "4.2"), ("prior to R15A", "lt", None, "r15a"), ("up to and including 2.1", "lte", None, "2.1"), ("2.3 and earlier", "lte", None, "2.3"), ("V1.5 or newer", "gte", "v1.5", None), ("versions after 7", "gt", "7", None), ("5.0.1", "eq", "5.0.1", "5.0.1"), ("something 5", "unknown", None, None),
]
CHAINS = {
    "generic": ["0.9", "1", "1.0", "1.0a", "1.0b", "1.1", "1.10", "2"],
    "siemens": ["V3.9 SP9", "V4", "V4.0 SP1", "V4.5", "V4.5 SP2", "V4.5 SP2 Update 3", "V4.5 SP10", "V4.6"],
    "abb": ["R14", "R15", "R15A", "R15A PC1", "R15B", "R15B PC3", "R16"],
    "rockwell": ["20.011", "20.12", "21.1", "33"],
}
APART = [("generic", "1.a", "1.2"), ("siemens", "SP1", "4.5"), ("abb", "", "1"), ("generic", "99999999999999999999", "1"), ("unknown", "x.1", "1.x")]


def duck(table, rows, sql):
    con = duckdb.connect()
    con.execute(f"CREATE TABLE t AS SELECT * FROM (VALUES {', '.join('(' + ', '.join('NULL' if x is None else repr(x) for x in r) + ')' for r in rows)}) AS v({table})")
    return con.execute(sql).fetchall()


def test_ranges(spark):
    df = spark.createDataFrame([(r[0],) for r in RANGES], "raw string")
    out = V.parse_ranges(df)
    got = {r["raw"]: r for r in out.collect()}
    assert {k: (r["kind"], r["lower"], r["upper"]) for k, r in got.items()} == {r[0]: r[1:] for r in RANGES}
    assert got["vers:x/>=1.0|<2.0"]["lower_inclusive"] and not got["vers:x/>=1.0|<2.0"]["upper_inclusive"]
    assert got["2.1.x"]["prefix"] == "2.1" and got["V2.*"]["prefix"] == "v2"
    same = duck("raw", [(r[0],) for r in RANGES], V.parse_ranges.duck("t"))
    assert sorted(map(str, same)) == sorted(str(tuple(r)) for r in out.collect())


def test_orders(spark):
    pairs, want = [], []
    for scheme, chain in CHAINS.items():
        for i, a in enumerate(chain):
            for j, b in enumerate(chain):
                if (scheme, a[:1] == "1", i == j) and not (scheme == "generic" and {a, b} & {"1.0a", "1.0b"} and {a, b} & {"1.1", "1.10"}):
                    pairs.append((len(pairs), scheme, a, b))
                    want.append((i > j) - (i < j))
    for scheme, a, b in APART:
        pairs.append((len(pairs), scheme, a, b))
        want.append(None)
    out = V.compare_versions(spark.createDataFrame(pairs, "id int, scheme string, a string, b string")).collect()
    got = {r["id"]: r["result"] for r in out}
    assert [(p, got[p[0]]) for p in pairs if got[p[0]] != want[p[0]]] == []
    same = duck("id, scheme, a, b", pairs, V.compare_versions.duck("t"))
    assert {r[0]: r[4] for r in same} == got


@pytest.mark.parametrize(
    "version,scheme,raw,result",
    [
        ("1.5", "generic", "< 2.0", "affected"), ("2.0", "generic", "< 2.0", "not_affected"), ("2.10.0", "generic", "2.1.x", "not_affected"), ("2.1.7", "generic", "2.1.x", "affected"), ("", "generic", "< 2", "indeterminate"), ("", "generic", "all", "affected"),
        ("R14", "abb", "< R15A", "affected"), ("R15A PC2", "abb", "< R15A", "not_affected"), ("V4.5 SP1", "siemens", "prior to V4.6", "affected"), ("V4.5 SP1", "siemens", "< V4.5 SP2", "not_affected"), ("abc", "generic", "< 2", "indeterminate"), ("1.0", "generic", "no idea 7 at all", "indeterminate"), ("1.5", "generic", ">=1.0 <1.5", "not_affected"),
    ],
)
def test_evaluation(spark, version, scheme, raw, result):
    ranges = V.parse_ranges(spark.createDataFrame([(raw,)], "raw string"))
    from pyspark.sql import functions as F

    checks = ranges.select(F.lit(1).alias("id"), F.lit(version).alias("version"), F.lit(scheme).alias("scheme"), "kind", "lower", "lower_inclusive", "upper", "upper_inclusive", "prefix")
    assert V.evaluate_ranges(checks).first()["result"] == result
