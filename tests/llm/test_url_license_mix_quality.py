import json

import numpy as np
import pytest

from fenwatch.llm import licenses as L
from fenwatch.llm import mixing as M
from fenwatch.llm import quality as Q
from fenwatch.llm import url_filter as U

from .conftest import rows

PAGES = "page_id long, url string, key string, host string, bits string"


def test_rules(spark):
    rules = [*U.RULES, U.Rule("www.example.org", "/es/", "allow"), U.Rule("both.net", "/", "allow"), U.Rule("both.net", "/", "block")]
    urls = {
        1: ("http://EXAMPLE.org/es/x?y", "example.org", "/es/x", "example.org/es/", "block"),
        2: ("https://a.b.example.org/en/12#f", "a.b.example.org", "/en/12", "example.org/en/1", "block"),
        3: ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
        4: ("x://www.example.org/es/", "www.example.org", "/es/", "www.example.org/es/", "allow"),
        5: (None, "", "", None, "allow"),
        6: ("no scheme", "", "", None, "allow"),
        7: ("http://c.both.net/", "c.both.net", "/", "both.net/", "block"),
        8: ("http://x.com?q=http://y.org/", "x.com", "", None, "allow"),
        9: ("http://X.com/de/" + "p" * 20_000, "x.com", "/de/" + "p" * 20_000, "com/de/", "block"),
        10: ("", "", "", None, "allow"),
    }
    data = [(k, v[0], "k", "h", "b") for k, v in urls.items()] + [(1, urls[1][0], "k", "h", "b")]
    got = rows(U.judge_urls(spark.createDataFrame(data, PAGES), rules), "page_id")
    assert len(got) == 11
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got} == {k: v[1:] for k, v in urls.items()}
    assert rows(U.judge_urls(spark.createDataFrame([], PAGES), rules)) == []
    assert {r["verdict"] for r in rows(U.judge_urls(spark.createDataFrame(data, PAGES), []))} == {"allow"}


def test_cascade_is_exact_over_its_universe(spark):
    from pyspark.sql import functions as F

    universe = spark.range(20_000).select(F.concat(F.lit("key"), F.col("id") % 9_000).alias("key"))
    listed = spark.range(0, 9_000, 7).select(F.concat(F.lit("key"), "id").alias("key"))
    # a first filter made for a tenth of the universe lets many keys pass, so that more levels are needed
    c = U.Cascade.build("x", listed, universe, 3_000)
    assert len(c.levels) > 2
    got = c.attach(universe.distinct()).where(c.lists(F.col("key"))).select("key").collect()
    assert {r["key"] for r in got} == {f"key{k}" for k in range(0, 9_000, 7)}


def test_neighbouring_spellings(spark):
    """Equivalent words become one, also side by side and across a pair's inner space."""
    from pyspark.sql import functions as F

    texts = ["licence licence licence", "license license license", "sub licence sub license", "copyright owner copyright owners per cent"]
    got = [r["s"] for r in spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", L.spelled(F.col("t")).alias("s")).orderBy("k").collect()]
    assert got == ["license license license", "license license license", "sublicense sublicense", "copyright holder copyright holders percent"]


def test_licenses(spark):
    mit = L._MIT.replace("copyright", "Copyright").replace(" ", "\n", 5)
    docs = [
        (1, "Copyright (c) 2020 Someone\n\n" + mit.upper() + "\nAll rights reserved.", "d", "x"),
        (2, "intro\nLicenced under the Apache-Licence, version 2.0\nmore\nReleased under the MIT licence!\nreleased under the mit license", "d", "x"),
        (3, None, "d", "x"), (4, "", "d", "x"), (5, "Released under the MIT License. And more.", "d", "x"), (6, "word " * 100_000, "d", "x"), (2, "copyright holders of it", "d", "x"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string, digest string, license string")
    got = rows(L.scan_licenses(df, L.known_digests(spark)), "doc_id", "n_notices")
    by = {r["doc_id"]: r for r in got if r["doc_id"] != 2}
    assert by[1]["license"] == "MIT" and [by[k]["license"] for k in (3, 4, 5, 6)] == [None] * 4
    assert by[3]["canonical_sha256"] == by[4]["canonical_sha256"]
    two = [r for r in got if r["doc_id"] == 2]
    assert [(r["notices"], r["n_notices"]) for r in two] == [("", 0), ("Apache-2.0,MIT", 3)]
    assert rows(L.scan_licenses(df.limit(0), L.known_digests(spark))) == []


def test_targets():
    t = M.targets({"a": 10, "b": 100, None: 1000}, {"a": 3, "b": 1, None: 2}, 1665)
    assert t["a"] == 20 and t["b"] == 200 and t[None] == pytest.approx(1445)
    assert M.targets({}, {}, 0) == {}


def test_flow_routes_overlapping_sources_cheaply():
    patterns = {json.dumps(["a"]): 100, json.dumps(["a", "b"]): 100, json.dumps(["b", None]): 50}
    got = M.route(patterns, {"a": 120, "b": 80, None: 50})
    # all quotas can be met with one copy of every word
    assert got == {'["a"]': 100, '["a", "b"]': 100, '["b", null]': 50}
    assert sum(M.route(patterns, {"a": 350, "b": 0, None: 0}).values()) == 350
    assert M.route({'["a"]': 10}, {"a": 99}) == {'["a"]': 20}


DOCS = "doc_id long, text string, source string, pattern string, row string"


def test_mix_comes_near_its_targets(spark):
    rng = np.random.default_rng(1)
    data = [(k, "w " * int(rng.integers(1, 60)), ["x", "y", "z", None][k % 4], "p", "r") for k in range(400)] + [(None, "n n", "x", "p", "r"), (7, None, "x", "p", "r"), (8, "", None, "p", "r"), (9, "same", "y", "p", "r"), (9, "same", "y", "p", "r")]
    df = spark.createDataFrame(data, DOCS)
    from pyspark.sql import functions as F

    plan, sized = M.plan_mix(df, F.array("source"))
    taken = rows(M.copies_of(sized, plan).withColumn("taken", F.col("size") * F.col("n_copies")))
    assert len(taken) == len(data) and all(0 <= r["n_copies"] <= 2 for r in taken)
    for s, goal in plan.targets.items():
        got = sum(r["taken"] for r in taken if json.loads(r["pattern"]) == [s])
        assert abs(got - goal) <= 0.01 * goal + 1, (s, got, goal)
    mixed = M.mix(df)
    assert mixed.columns == df.columns
    assert mixed.count() == sum(r["n_copies"] for r in taken)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, M.mix(df).collect()))
    assert M.mix(df.limit(0)).count() == 0


def test_mix_goes_on_past_a_document_that_does_not_fit(spark):
    """One very long document anywhere in the hash order: the rest of the quota is filled from those after it. Against the same rule one by one."""
    rng = np.random.default_rng(3)
    data = []
    for place in range(0, 100, 10):
        sizes = rng.integers(50, 600, 2000).tolist()
        sizes.insert(20 * place, 400_000)
        hashes = np.sort(rng.integers(-(1 << 63), (1 << 63) - 1, len(sizes))).tolist()
        data += [(f'["s{place}"]', n, h, n) for n, h in zip(sizes, hashes)]
    sized = spark.createDataFrame(data, "pattern string, size long, hash long, total long")
    by = {}
    for p, n, h, _ in data:
        by.setdefault(p, []).append((h, n))
    words = {p: sum(n for _, n in d) for p, d in by.items()}
    take = {p: n // 2 for p, n in words.items()}
    cuts = M.choose(sized, words, take)
    assert sorted(c.pattern for c in cuts) == sorted(words)
    got = {}
    for r in M.copies_of(sized.drop("total"), M.Plan({}, {}, cuts)).where("n_copies > 0").collect():
        got.setdefault(r["pattern"], set()).add(r["hash"])
    for p, d in by.items():
        rest, want = take[p], set()
        for h, n in sorted(d):
            if n <= rest:
                rest -= n
                want.add(h)
        changed = dict(next(c.changed for c in cuts if c.pattern == p))
        assert got[p] - set(changed) == want - set(changed)
        # the smallest documents make up for what is missing, to the word
        assert sum(n * changed.get(h, int(h in want)) for h, n in d) == take[p]
        assert all(c in (0, 1, 2) for c in changed.values())


@pytest.mark.parametrize("n", [1, 2, 5, 9, 12])
def test_weighed_finds_the_best_sum(n):
    """Against all choices of copies."""
    from itertools import product

    rng = np.random.default_rng(n)
    for _ in range(20):
        sizes = sorted(rng.integers(1, 400, n).tolist())
        copies = rng.integers(0, 3, n).tolist()
        missing = int(rng.integers(-300, 600))
        goal = missing + sum(c * s for c, s in zip(copies, sizes))
        got = M.weighed(sizes, copies, missing, 2)
        nearest = min(abs(sum(c * s for c, s in zip(cs, sizes)) - goal) for cs in product(range(3), repeat=n))
        assert abs(sum(c * s for c, s in zip(got, sizes)) - goal) == nearest and set(got) <= {0, 1, 2}


@pytest.mark.parametrize("n", [5, 8])
def test_mix_of_few_documents_is_the_best_one(spark, n):
    """Each source's words come as near its target as any copies of its documents do."""
    from itertools import product

    from pyspark.sql import functions as F

    rng = np.random.default_rng(n)
    data = [(100 * s + k, "w " * int(rng.integers(1, 900)), f"s{s}", "p", "r") for s in range(6) for k in range(n)]
    plan, sized = M.plan_mix(spark.createDataFrame(data, DOCS), F.array("source"))
    taken = rows(M.copies_of(sized, plan))
    for s, goal in plan.targets.items():
        own = [r for r in taken if json.loads(r["pattern"]) == [s]]
        best = min(abs(sum(c * r["size"] for c, r in zip(cs, own)) - round(goal)) for cs in product(range(3), repeat=n))
        assert abs(sum(r["n_copies"] * r["size"] for r in own) - round(goal)) == best


def test_mix_keeps_sources_with_control_characters(spark, tmp_path):
    data = [(k, "a b c", ["plain", "\x0b", "\x1f", 'q"\\'][k % 4], "p", "r") for k in range(40)]
    spark.createDataFrame(data, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    got = rows(M.op8_mixing(spark, str(tmp_path)))
    assert len(got) == 40 and all(r["source_size"] == 30 and r["target"] is not None for r in got)


def test_quality_learns_and_scores_whole_texts(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in Q.score(docs, Q.train(docs, labels)).collect()}
    held = [r for r in labels.collect() if got[r["doc_id"]]["held_out"]]
    good, bad = ([got[r["doc_id"]]["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.95
    assert np.mean([got[r["doc_id"]]["predicted"] for r in held if r["quality"] == 1]) > 0.95


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, "s"), (None, "", "s"), (3, "word " * 50_000, "s"), (3, "x", "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = rows(Q.score(docs, Q.train(docs, none)))
    assert [round(r["score"], 6) for r in got] == [0.5] * 4 and not any(r["held_out"] for r in got if r["doc_id"] is None)
    assert rows(Q.score(docs.limit(0), Q.train(docs.limit(0), none))) == []
    # the sum-of-squares identity against all pairs
    m = Q.FactorisationMachine(0.5, np.arange(6.0), np.arange(12.0).reshape(6, 2) / 10, np.zeros(1), np.ones(1))
    at, x = np.array([0, 2, 5]), np.array([1.0, 0.5, 2.0])
    pairs = sum(m.factors[at[i]] @ m.factors[at[j]] * x[i] * x[j] for i in range(3) for j in range(i))
    assert m.raw(at, x, np.array([0, 3]))[0][0] == pytest.approx(0.5 + m.linear[at] @ x + pairs)


def test_copyright_lines_of_published_templates(spark):
    """Lines of holders and placeholders go, clauses about copyright stay."""
    lines = ["Copyright <YEAR> <COPYRIGHT HOLDER>", "Copyright Jane Doe 2020", "Copyright (c) [year] [fullname]", "Copyright {yyyy} {name of copyright owner}", "COPYRIGHT: The Example Project Authors", " * Copyright 2001-2020 A. Holder", "Copyright © 2020 A. Holder", "", "Copyright ACME, Inc. All rights reserved."]
    kept = ["copyright holders grant you this", "Copyright notice: keep this.", "Copyright and licence terms", "copyright law forbids it", "Copyright"]
    texts = [f"{x}\n\n{L._MIT}" for x in lines] + [f"{x}\n\n{L._MIT}" for x in kept]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["license"] for r in L.scan_licenses(df, L.known_digests(spark)).collect()}
    assert [got[k] for k in range(len(lines))] == ["MIT"] * len(lines)
    assert [got[k] for k in range(len(lines), len(texts))] == [None] * len(kept)
