import numpy as np
import pytest
import xxhash

from fenwatch.llm import components as C
from fenwatch.llm import embeddings as E
from fenwatch.llm import simhash as S

from .conftest import rows


def grouped(nodes, edges, least=True):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("part_edges", [0, 100, 1 << 16])
def test_components(spark, part_edges):
    rng = np.random.default_rng(0)
    edges = [(k, k + 1) for k in range(100, 180)] + [(500, k) for k in range(501, 900)] + rng.integers(1000, 1400, (250, 2)).tolist() + [(5, 5), (100, 101)]
    got = {r["node"]: r["root"] for r in C.components(spark.createDataFrame([tuple(map(int, e)) for e in edges], "a long, b long").repartition(7), part_edges=part_edges).collect()}
    proper = [e for e in edges if e[0] != e[1]]
    want = grouped({x for e in proper for x in e}, proper)
    for same in (got, want):
        assert len({(got[k], want[k]) for k in same}) == len(set(want.values())) == len(set(got.values()))
    assert C.components(spark.createDataFrame([], "a long, b long"), part_edges=part_edges).count() == 0


def test_every_anchor_within_reach():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 46, 200)
    at, anchor = S.anchors(words, 2)
    homes = {}
    for i, a in zip(at.tolist(), anchor.tolist()):
        homes.setdefault(i, set()).add(a)
    for i in range(200):
        for _ in range(20):
            other = int(words[i]) ^ (1 << int(rng.integers(46))) ^ (1 << int(rng.integers(46)))
            _, near = S.anchors(np.array([other]), 0)
            assert len(near) == 1 and int(near[0]) in homes[i]


def test_fingerprint_by_hand():
    text = "A b\tC d  a b c"
    parts = ["a b c", "b c d", "c d a", "d a b", "a b c"]
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    assert S.fingerprint(text) == sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))
    assert S.fingerprint("One two") == xxhash.xxh64_intdigest(b"one two", 42)
    assert S.fingerprint(None) == S.fingerprint(" \n") == 0


@pytest.mark.parametrize("most", [16_384, 64])
def test_links_against_brute_force(spark, most):
    """A third of the fingerprints lie around one point; small parts split the large anchors."""
    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 1 << 63))
    near = {base ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for _ in range(400)}
    far = set(map(int, rng.integers(0, 1 << 63, 800)))
    values = np.array(sorted(near | far | {x ^ 3 for x in list(far)[:50]}), np.uint64)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "id long")
    from pyspark.sql import functions as F

    edges = [tuple(r) for r in S.links(df.withColumn("word", F.col("id")), ["word"], ["id"], 2, 2, most).collect()]
    want = [(int(a), int(b)) for i, a in enumerate(values) for b in values[np.flatnonzero(np.bitwise_count(values ^ a) <= 2)] if a != b]
    unsigned = lambda x: x & (1 << 64) - 1
    ids = [int(v) for v in values]
    assert grouped(ids, [(unsigned(a), unsigned(b)) for a, b in edges]) == grouped(ids, want)


DOCS = "doc_id long, text string, id long, root string, n int"


def test_simhash_components(spark):
    data = [(4, "the same text here", 1, "r", 1), (2, "The same text  HERE", 1, "r", 1), (None, "the same text here", 1, "r", 1), (9, None, 1, "r", 1), (8, " ", 1, "r", 1), (7, "w " * 60_000, 1, "r", 1), (4, "the same text here", 1, "r", 1), (None, "lonely words with no id", 1, "r", 1)]
    got = rows(S.simhash_components(spark.createDataFrame(data, DOCS)), "doc_id", "component_id")
    assert [(r["doc_id"], r["component_id"]) for r in got] == [(2, 2), (4, 2), (4, 2), (7, 7), (8, 8), (9, 8), (None, 2), (None, None)]
    assert {r["fingerprint"] for r in got if r["doc_id"] in (8, 9)} == {"0" * 16}
    assert rows(S.simhash_components(spark.createDataFrame([], DOCS))) == []


def test_near_copies_go(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    clean = [" ".join(word() for _ in range(200)) for _ in range(60)]
    data = [(k, t) for k, t in enumerate(clean)]
    for k in range(30):
        w = clean[k].split()
        for j in rng.integers(0, 200, 2):
            w[j] = word()
        data.append((1000 + k, " ".join(w)))
    data += [(2000, clean[0].upper()), (3000, None), (3001, ""), (None, clean[1]), (5, clean[5])]
    df = spark.createDataFrame([(k, t, 1, "r", 1) for k, t in data], DOCS)
    kept = sorted(r["doc_id"] for r in S.drop_near_copies(df).collect() if r["doc_id"] is not None)
    assert set(range(60)) <= set(kept) and len(kept) == len(set(kept))
    assert 3000 in kept and 3001 not in kept and 2000 not in kept
    assert len([k for k in kept if 1000 <= k < 2000]) <= 1
    assert S.drop_near_copies(df).columns == df.columns
    assert S.drop_near_copies(df.limit(0)).count() == 0


def test_rows_not_ids_are_documents(spark):
    """An id's different texts are decided each on its own, repeated rows are one document, and other columns come along."""
    data = [(1, None), (1, "other words of this one"), (2, ""), (2, "other words of this one"), (3, "more words than the others have"), (3, "more words than the others have"), (None, ""), (None, "")]
    df = spark.createDataFrame([(k, t, 7, "r", n) for n, (k, t) in enumerate(data)], DOCS)
    got = sorted((r["doc_id"], r["text"] or "", r["id"]) for r in S.drop_near_copies(df).collect() if r["doc_id"] is not None)
    assert got == [(1, "", 7), (1, "other words of this one", 7), (3, "more words than the others have", 7)]
    assert S.drop_near_copies(df).where("doc_id IS NULL").count() == 2


def test_long_texts_are_compared_by_a_sketch(spark):
    rng = np.random.default_rng(8)
    w = ["".join(c) for c in rng.choice(list("abcdefghij"), (20_000, 6))]
    near, far = w[:18_500], w[:12_000]
    df = spark.createDataFrame([(1, " ".join(w), 1, "r", 1), (2, " ".join(near), 1, "r", 1), (3, " ".join(far), 1, "r", 1)], DOCS)
    assert sorted(r["doc_id"] for r in S.drop_near_copies(df).collect()) == [1, 3]


@pytest.mark.parametrize("kind", ["scattered", "passage", "appended", "truncated"])
def test_near_copies_by_kind_of_edit(spark, kind):
    """Copies at a similarity of 0.8 or more go, whatever the edit; documents below it stay. Against brute force over all pairs."""
    rng = np.random.default_rng(5)
    new = lambda n: ["".join(c) for c in rng.choice(list("abcdefghij"), (n, 7))]
    texts = {}
    for k in range(150):
        w, share = new(300), rng.uniform(0.65, 0.9)
        m = int(300 * (1 - share) / (1 + share))
        at = int(rng.integers(0, 300 - m))
        v = list(w)
        if kind == "scattered":
            for j in rng.choice(300, m // 5, replace=False):
                v[j] = new(1)[0]
        texts[k] = w
        texts[1000 + k] = {"scattered": v, "passage": w[:at] + new(m) + w[at + m :], "appended": w + new(int(300 / share) - 300), "truncated": w[: int(300 * share)]}[kind]
    df = spark.createDataFrame([(k, " ".join(t), 1, "r", 1) for k, t in texts.items()], DOCS)
    sets = {k: set(zip(*(t[i:] for i in range(5)), strict=False)) for k, t in texts.items()}
    near = {k for k in range(150) if len(sets[k] & sets[1000 + k]) >= 0.8 * len(sets[k] | sets[1000 + k])}
    assert 30 < len(near) < 120
    gone = set(texts) - {r["doc_id"] for r in S.drop_near_copies(df).collect()}
    assert gone == {1000 + k for k in near}


@pytest.mark.parametrize("nearest", [2])
def test_near_copies_among_many_that_are_close(spark, monkeypatch, nearest):
    """Groups whose documents lie around the threshold: what a third, nearer document is no copy of is still found. Against brute force over all pairs."""
    monkeypatch.setattr(S, "NEAREST", nearest)
    rng = np.random.default_rng(9)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    texts, group, n = {}, {}, 0
    for g in range(90):
        w = [word() for _ in range(300)]
        for _ in range(3 if g < 60 else int(rng.integers(10, 51))):
            v = list(w)
            for j in rng.choice(300, int(rng.integers(2, 6)), replace=False):
                v[j] = word()
            texts[n], group[n] = v, g
            n += 1
    sets = {k: set(zip(*(t[i:] for i in range(5)), strict=False)) for k, t in texts.items()}
    edges = [(a, b) for a in texts for b in texts if a < b and group[a] == group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = grouped(list(texts), edges)
    df = spark.createDataFrame([(k, " ".join(t), 1, "r", 1) for k, t in texts.items()], DOCS).repartition(4)
    kept = {r["doc_id"] for r in S.drop_near_copies(df).collect()}
    clean = {k for k in texts if want[k] == k}
    assert clean <= kept  # nothing that brute force keeps goes
    gone = set(texts) - clean
    assert len(gone - kept) >= 0.98 * len(gone) and len(gone) > 300 and len(clean) > 100


def most_rows_made(spark, first=0):
    """The most rows that a join, an explode or a Python function has made in an execution from `first` on; and the number of executions."""
    store = spark._jsparkSession.sharedState().statusStore()
    runs, most = store.executionsList(), 0
    for i in range(first, runs.size()):
        at = runs.apply(i).executionId()
        nodes, metrics = store.planGraph(at).allNodes(), store.executionMetrics(at)
        for node in (nodes.apply(j) for j in range(nodes.size())):
            for m in (node.metrics().apply(j) for j in range(node.metrics().size())) if any(x in node.name() for x in ("Join", "Generate", "Arrow")) else ():
                if m.name() == "number of output rows" and metrics.get(m.accumulatorId()).isDefined():
                    most = max(most, int(metrics.get(m.accumulatorId()).get().replace(",", "") or 0))
    return most, runs.size()


def close_texts(rng, n, least, most):
    """Texts of one group, each with `least` to `most` of its 300 words replaced."""
    word = lambda: "".join(rng.choice(list("abcdefghij"), 7))
    w, texts = [word() for _ in range(300)], {}
    for k in range(n):
        v = list(w)
        for j in rng.choice(300, int(rng.integers(least, most + 1)), replace=False):
            v[j] = word()
        texts[k] = v
    return texts


def test_rows_of_a_large_group_of_candidates(spark):
    """Documents of one group that are all candidates of one another, and mostly no copies: rows grow with the documents, not with their pairs."""
    texts = close_texts(np.random.default_rng(11), 600, 7, 9)
    df = spark.createDataFrame([(k, " ".join(t), 1, "r", 1) for k, t in texts.items()], DOCS).repartition(4)
    _, first = most_rows_made(spark)
    kept = {r["doc_id"] for r in S.drop_near_copies(df).collect()}
    sets = {k: set(zip(*(t[i:] for i in range(5)), strict=False)) for k, t in texts.items()}
    want = grouped(list(texts), [(a, b) for a in texts for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    assert kept == {k for k in texts if want[k] == k} and len(kept) > 500
    made, last = most_rows_made(spark, first)
    assert last > first and len(texts) <= made <= 40 * len(texts)  # 33 anchors and bands on average at most; pairs are 300 a document


@pytest.mark.parametrize("part", [16, 1024])
def test_parts_of_a_group_against_brute_force(spark, monkeypatch, part):
    """Groups larger than a part, around the threshold: no link between parts is lost, none is made up."""
    monkeypatch.setattr(S, "PART_SETS", part)
    rng = np.random.default_rng(12)
    texts = {1000 * g + k: t for g, n in enumerate([120, 40, 3]) for k, t in close_texts(rng, n, 2, 7).items()}
    sets = {k: set(zip(*(t[i:] for i in range(5)), strict=False)) for k, t in texts.items()}
    want = grouped(list(texts), [(a, b) for a in texts for b in texts if b < a and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    df = spark.createDataFrame([(k, " ".join(t), 1, "r", 1) for k, t in texts.items()], DOCS).repartition(4)
    assert {r["doc_id"] for r in S.drop_near_copies(df).collect()} == {k for k in texts if want[k] == k}


@pytest.mark.parametrize("parts", [1, 2])
@pytest.mark.parametrize("size", [3, 60, S.LEAST_HASHES])
def test_set_links_against_pairs(size, parts):
    """Links of sets by counts of what they share, of whole and of cut ones, within a part and between two."""
    rng = np.random.default_rng(size)
    sets = [np.zeros(0, np.uint32)] * 2
    for _ in range(6):
        base = rng.integers(0, 1 << 32, int(size * 1.3), np.uint32)
        for _ in range(int(rng.integers(2, 40))):
            keep = base[rng.random(len(base)) < rng.uniform(0.8, 1)]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 32, int(rng.integers(0, max(2, size // 20))), np.uint32)]))[: S.LEAST_HASHES])
    own = rng.integers(0, parts, len(sets))
    got = list(zip(*S.set_links(sets, own, 0.8), strict=True))
    pairs = {(a, b) for a in range(len(sets)) for b in range(a) if (parts == 1 or own[a] != own[b]) and S.similar(sets[a], sets[b], 0.8)}
    assert all((max(p), min(p)) in pairs for p in got) and len(got) < len(sets)
    assert grouped(range(len(sets)), got) == grouped(range(len(sets)), pairs)


VECTORS = "vec_id long, embedding array<float>, label int, x int, cell string"


@pytest.mark.parametrize("part", [2048, 16])
def test_embeddings_against_brute_force(spark, part):
    rng = np.random.default_rng(4)
    data, k = [], 0
    for label in (0, 1, None):
        centres = rng.normal(size=(25, 16))
        for c in centres:
            for _ in range(rng.integers(1, 7)):
                data.append((k, (c + rng.normal(scale=rng.uniform(0, 0.3), size=16)).tolist(), label, 1, "c"))
                k += 1
    hot = rng.normal(size=16)
    for _ in range(80):
        data.append((k, hot.tolist(), 0, 1, "c"))
        k += 1
    for odd in (None, [], [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [1.0] * 3, [1.0, 1.0, 1.1], [2.0], [3.0], [-1.0], [1.0, 0.0], [float("inf")] + [1.0] * 15):
        data.append((k, odd, 0, 1, "c"))
        k += 1
    for _ in range(100):
        data.append((k, rng.normal(size=4).tolist(), 0, 1, "c"))
        k += 1
    got = {r["vec_id"]: r for r in E.near_vectors(spark.createDataFrame(data, VECTORS), recall=1.0, part=part).collect()}
    assert len(got) == len(data)
    edges = []
    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab, *_ in data if v and lab is not None and None not in v and np.isfinite(v).all() and any(v)]
    for i, v, la in good:
        for j, w, lb in good:
            if i != j and la == lb and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93:
                edges.append((i, j))
    want = grouped([d[0] for d in data], edges)
    assert {i: r["component_id"] for i, r in got.items()} == want
    n = {}
    for i, _ in edges:
        n[i] = n.get(i, 0) + 1
    assert {i: r["n_links"] for i, r in got.items()} == {d[0]: n.get(d[0], 0) for d in data}
    assert all(r["kept"] == (i == want[i]) for i, r in got.items())


def beside(rng, x):
    """Unit vectors at the threshold's cosine from those of x, in directions in which x varies."""
    d = x[rng.permutation(len(x))] - x[rng.permutation(len(x))]
    d -= (d * x).sum(1)[:, None] * x
    d /= np.maximum(np.linalg.norm(d, axis=1), 1e-12)[:, None]
    c = rng.uniform(0.93, 0.96, size=(len(x), 1))
    return c * x + np.sqrt(1 - c * c) * d


@pytest.mark.parametrize(("size", "inner"), [(64, 64), (128, 4), (128, 8)])
def test_recall_of_the_default(spark, size, inner):
    """At least 0.9 of the links at the threshold and above, also where vectors vary in few directions only."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(1500, inner)) @ np.linalg.qr(rng.normal(size=(size, inner)))[0].T
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = beside(rng, x)[:700]
    every = np.vstack([x, y]).astype(np.float32).astype(float)
    every /= np.linalg.norm(every, axis=1)[:, None]
    want = (every @ every.T >= 0.93).sum() - len(every)
    df = spark.createDataFrame([(k, v.tolist(), 0, 1, "c") for k, v in enumerate(every)], VECTORS)
    found = sum(r["n_links"] for r in E.near_vectors(df).collect())
    assert 0.9 * want <= found <= want


def test_no_vector(spark):
    assert E.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    lone = E.near_vectors(spark.createDataFrame([(1, [1.0, 0.0], 0, 1, "c"), (1, [1.0, 0.0], 0, 1, "c")], VECTORS)).collect()
    assert [(r["n_links"], r["component_id"], r["kept"]) for r in lone] == [(1, 1, True)] * 2
