import collections
import math
import re

import numpy as np
import pytest

from fenwatch.llm import neighbours, phrases, whitening
from tests.llm.conftest import rows

EMBEDDING = "vec_id long, embedding array<float>, label int, score double, rank string"


def vectors(spark, data, schema=EMBEDDING):
    return spark.createDataFrame([(i, v, 0, 0.5, "x") for i, v in data], schema).repartition(3)


def by_brute_force(data, k=20):
    """The k nearest of each query whose id is divisible by 20, by all pairs."""
    good = [(i, np.float32(v).astype(float)) for i, v in data if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)]
    good = list({(i, tuple(v)): (i, v) for i, v in good}.values())
    out = {}
    for q, x in good:
        if q % 20 == 0:
            near = [(float((x * y).sum()), i) for i, y in good if i != q and len(y) == len(x)]
            out[q] = sorted(near, key=lambda p: (-p[0], p[1]))[:k]
    return out


def got_by_query(df):
    out = collections.defaultdict(list)
    for r in rows(df, "query_id", "rank"):
        assert r["rank"] == len(out[r["query_id"]]) + 1
        out[r["query_id"]].append((r["score"], r["vec_id"]))
    return out


def clustered(n, size, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, size))
    return [(i, (centres[i % 12] + rng.normal(size=size) * 0.5).tolist()) for i in range(n)]


def test_op11_finds_the_nearest(spark, sf):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf}/embeddings.parquet")
    data = list(zip(table.column("vec_id").to_pylist(), table.column("embedding").to_pylist(), strict=True))
    want, got = by_brute_force(data), got_by_query(neighbours.op11_neighbours(spark, sf))
    assert set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / len(want[q]) for q in want]) >= 0.9
    scores = {q: dict((i, s) for s, i in by_brute_force(data, len(data))[q]) for q in want}
    for q, found in got.items():
        assert found == sorted(found, key=lambda p: (-p[0], p[1]))
        assert all(math.isclose(s, scores[q][i], rel_tol=1e-14) for s, i in found)


@pytest.mark.parametrize("part", [64, 2048])
def test_op11_recall_over_many_buckets(spark, part, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 32)
    data = clustered(3000, 16)
    # norms far apart: a band of its own for each factor of two
    data = [(i, (np.array(v) * (50 if i % 97 == 0 else 1)).tolist()) for i, v in data]
    want = by_brute_force(data)
    got = got_by_query(neighbours.nearest(vectors(spark, data), lambda i: i % 20 == 0, part=part))
    assert all(len(got[q]) == 20 for q in want)
    assert np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / 20 for q in want]) >= 0.9


def test_op11_copies_ties_and_faulty_vectors(spark):
    one, two = [1.0, 0.0, 0.0], [0.5, 0.5, 0.0]
    data = [(i, one) for i in range(60)] + [(60, two), (61, two), (61, two), (62, [1.0, 2.0]), (80, [3.0, 1.0]), (None, one), (100, None), (101, []), (120, [0.0, 0.0, 0.0]), (140, [1.0, None, 0.0]), (160, [math.nan, 0.0, 1.0]), (180, [math.inf, 0.0, 1.0]), (63, [-1.0, 0.0, 0.0])]
    got, want = got_by_query(neighbours.nearest(vectors(spark, data), lambda i: i % 20 == 0)), by_brute_force(data)
    assert got == want
    assert [i for _, i in got[0]] == list(range(1, 21)) and got[80] == [(5.0, 62)]
    assert rows(neighbours.nearest(vectors(spark, []), lambda i: i % 20 == 0)) == []
    few = got_by_query(neighbours.nearest(vectors(spark, [(0, one), (1, two), (2, [-1.0, 0.0, 0.0])]), lambda i: i % 20 == 0))
    assert few == {0: [(0.5, 1), (-1.0, 2)]}
    assert rows(neighbours.nearest(vectors(spark, [(0, one)]), lambda i: i % 20 == 0)) == []


def test_op11_queries_that_find_too_few_go_on(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BUCKET", 8)
    monkeypatch.setattr(neighbours, "MOST_PROBES", 4)
    monkeypatch.setattr(neighbours, "RECALL", 0.2)
    data = clustered(300, 8)
    got = got_by_query(neighbours.nearest(vectors(spark, data), lambda i: i % 20 == 0, recall=0.05, tables=1))
    assert {len(v) for v in got.values()} == {20} and set(got) == {i for i, _ in data if i % 20 == 0}


def whitened_by_numpy(data, components=4):
    good = [(i, np.float32(v).astype(float)) for i, v in data if v and None not in v and all(map(math.isfinite, v))]
    x = {i: np.floor(256 * v).astype(np.int64) for i, v in good}
    fit = np.array(sorted({tuple(v.tolist()) for v in x.values()}))
    n, s = len(fit), fit.sum(0)
    c = fit - s / n
    values, u = np.linalg.eigh(c.T @ c / n)
    values, u = values[::-1][:components], u[:, ::-1][:, :components]
    white = {i: (v - s / n) @ u / np.sqrt(values) for i, v in x.items()}
    return n, {i: sum(int(q) ** 2 for q in n * v - s) for i, v in x.items()}, white, values / np.trace(c.T @ c / n)


@pytest.mark.parametrize("size", [3, 5, 40, 96])
def test_op12_equals_the_whole_decomposition(spark, size):
    rng = np.random.default_rng(size)
    data = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, size)) * np.linspace(1, 2, size))]
    data += [(400, data[0][1]), (401, None), (402, [1.0] * (size - 1) + [None]), (403, [math.nan] * size), (404, [math.inf] * size), (405, []), (406, [0.0] * size)]
    n, deviation, white, explained = whitened_by_numpy(data)
    got = rows(whitening.whiten(vectors(spark, data)), "vec_id", "component")
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, c) for i in sorted(white) for c in range(1, min(4, size) + 1)]
    turn = {c: math.copysign(1, next(r["whitened"] for r in got if r["component"] == c and abs(r["whitened"]) > 0.1) * next(white[r["vec_id"]][c - 1] for r in got if r["component"] == c and abs(r["whitened"]) > 0.1)) for c in range(1, min(4, size) + 1)}
    for r in got:
        c = r["component"] - 1
        assert r["n"] == n and r["deviation"] == deviation[r["vec_id"]] and r["identity_error"] < 1e-9
        assert math.isclose(r["explained"], explained[c], rel_tol=1e-9)
        assert math.isclose(r["whitened"] * turn[r["component"]], white[r["vec_id"]][c], rel_tol=1e-7, abs_tol=1e-7)


def test_op12_converges_on_all_embeddings(spark, sf):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{sf}/embeddings.parquet")
    data = list(zip(table.column("vec_id").to_pylist(), table.column("embedding").to_pylist(), strict=True))
    _, _, white, explained = whitened_by_numpy(data)
    got = rows(whitening.op12_whitening(spark, sf), "vec_id", "component")
    assert len(got) == 4 * len(data)
    for r in got:
        assert math.isclose(abs(r["whitened"]), abs(white[r["vec_id"]][r["component"] - 1]), rel_tol=1e-6, abs_tol=1e-6)
        assert math.isclose(r["explained"], explained[r["component"] - 1], rel_tol=1e-9)


def test_op12_flat_and_small_tables(spark):
    assert rows(whitening.whiten(vectors(spark, []))) == []
    assert rows(whitening.whiten(vectors(spark, [(1, [1.0, 2.0])]))) == []  # no variance, so no component
    line = rows(whitening.whiten(vectors(spark, [(1, [0.0, 0.0]), (2, [1.0, 1.0]), (None, [2.0, 2.0]), (4, [1.0])])), "vec_id")
    assert [(r["vec_id"], r["component"], r["n"]) for r in line] == [(1, 1, 3), (2, 1, 3), (None, 1, 3)]
    assert line[0]["deviation"] == 2 * (3 * 256) ** 2 and math.isclose(line[0]["explained"], 1.0)
    far = rows(whitening.whiten(vectors(spark, [(1, [0.0]), (2, [3e7])])), "vec_id")
    assert far[0]["deviation"] is None or far[0]["deviation"] == int(3e7 * 256) ** 2


def test_lobpcg_takes_close_eigenvalues_apart():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    values = np.concatenate([[1.0, 0.999, 0.998, 0.997], np.linspace(0.995, 0.1, 196)])
    a = (q * values) @ q.T
    found, u = whitening.lobpcg(lambda b: a @ b, 200, 4)
    assert np.allclose(found, values[:4], rtol=1e-13)
    assert np.abs(np.abs(np.diag(u.T @ q[:, :4])) - 1).max() < 1e-12


def phrases_by_counting(data, least, longest=5, top=2000):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in data:
        lang = lang or "und"
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            words = [w for w in re.split("[\x20\x09]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, count in f.items():
        candidates = [p for p, a in count.items() if len(p) > 1 and a >= least]
        inside = {longer[i : i + k] for longer in candidates for k in range(2, len(longer)) for i in range(len(longer) - k + 1) if count[longer] >= count[longer[i : i + k]]}
        scored = []
        for p in candidates:
            if p not in inside:
                score, k = min((1000 * count[p] * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -count[p], " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append({"lang": lang, "rank": r, "phrase": p.decode(), "a": -a, "l": left, "r": right, "n": n[lang], "score": -s})
    return sorted(out, key=lambda r: (r["lang"], r["rank"]))


DOCUMENT = "doc_id long, text string, lang string, n long, score double, phrase string"


def corpus():
    rng = np.random.default_rng(5)
    words = ["new", "york", "city", "The", "über", "日本", "a\x00b", "x y", "of", "fast", "train"]
    data = []
    for i in range(400):
        line = [words[k] for k in rng.zipf(1.4, 12) % len(words)]
        if i % 3 == 0:
            line[3:6] = ["New", "York", "City"]
        data.append((["en", "de", None, "und"][i % 4], " ".join(line[:6]) + rng.choice([". ", ";", "\n", "\t", " !"]) + "  ".join(line[6:])))
    data += [("en", "new york city " * 50), (None, None), ("en", ""), ("fr", "  .;. "), ("en", "one"), ("de", "über " * 300)] + [("en", "Fast train. of course")] * 40
    return data


@pytest.mark.parametrize("at_once", [50, 1_000_000])
def test_op13_equals_plain_counting(spark, at_once, monkeypatch):
    monkeypatch.setattr(phrases, "WORDS_AT_ONCE", at_once)
    data = corpus()
    docs = spark.createDataFrame([(i, t, lang, 1, 0.5, "p") for i, (lang, t) in enumerate(data)], DOCUMENT).repartition(4)
    for least, longest, top in ((5, 5, 2000), (20, 3, 4), (8, 2, 2000)):
        got = rows(phrases.collocations(docs, least, longest, top), "lang", "rank")
        want = phrases_by_counting(data, least, longest, top)
        assert got == want and (len(want) > 3)
    assert rows(phrases.collocations(docs.limit(0))) == []


def test_op13_a_full_filter_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 10)
    monkeypatch.setattr(phrases.Bloom, "has", lambda self, keys: np.ones(len(keys), dtype=bool))
    data = corpus()
    docs = spark.createDataFrame([(i, t, lang, 1, 0.5, "p") for i, (lang, t) in enumerate(data)], DOCUMENT)
    assert rows(phrases.collocations(docs, 6), "lang", "rank") == phrases_by_counting(data, 6)


def test_op13_scores_beyond_64_bits(spark):
    got = spark.sql("SELECT CAST(9000000000000000 AS DECIMAL(19,0)) * CAST(9000000000000000001 AS DECIMAL(19,0)) div (CAST(3000000000 AS DECIMAL(19,0)) * CAST(2999999999 AS DECIMAL(19,0))) AS score").first()[0]
    assert got == 9000000000000000 * 9000000000000000001 // (3000000000 * 2999999999)
