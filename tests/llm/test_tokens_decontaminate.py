import hashlib
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest

from fenwatch.llm import decontaminate as D
from fenwatch.llm import token_files as K

from .conftest import rows

P = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, key string, start long, tie string"


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(P.path(K.TOKENIZER))


ODD = ["", "a", "a  ", "\n", " a", " a ", "a\n", "\na\n\nb", "a  b\t c d  e", "x<|endoftext|>y <|endoftext|> z\n<|endoftext|>", "é\x1c!!\x1c!! x", "a \r\nb", "don't\n's", "\x85 a", "  \n b", "日本 語\n文", "a​ b", "😀 😀😀\n😀"]


def test_pieces_give_the_ids_of_whole_texts(tokenizer, sf):
    texts = pq.read_table(f"{sf}/documents.parquet").to_pydict()["text"] + ODD
    own = K.Encoder(P.path(K.TOKENIZER))
    assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_files_hold_all_documents_in_order(spark, tokenizer):
    data = [(5, "one two three", "k", 1, "t"), (2, None, "k", 1, "t"), (None, "null id", "k", 1, "t"), (9, "word " * 5000 + "end", "k", 1, "t"), (2, "again", "k", 1, "t"), (5, "one two three", "k", 1, "t")]
    manifest = K.write_tokens(spark.createDataFrame(data, DOCS), P.path(K.TOKENIZER), 2, seq_len=64)
    got = rows(K.read_tokens(manifest), "start")
    assert [r["doc_id"] for r in got] == [None, 2, 2, 5, 5, 9]
    texts = {(r[0], r[1] or "") for r in data}
    start = 0
    for r in got:
        assert r["start"] == start
        start += r["n_tokens"]
        crcs = {zlib.crc32(np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in texts if k == r["doc_id"]}
        assert r["ids_crc32"] in crcs
    shards = [K.Shard(r["path"]) for r in rows(manifest, "base")]
    joined, masked = [], 0
    for s in shards:
        for i in range(len(s)):
            ids, mask = s.sequence(i)
            assert len(ids) == 64 and len(mask) == 64 and not ids.flags.owndata
            keep = np.array(mask.to_pylist())
            masked += int((~keep).sum())
            joined += ids[keep].tolist()
    assert len(joined) == start and masked < 64 * len(shards)


def test_no_document(spark):
    assert rows(K.read_tokens(K.write_tokens(spark.createDataFrame([], DOCS), P.path(K.TOKENIZER), 2))) == []


def brute(text, items, window):
    words = D.words_of(text)
    hit, found = set(), set()
    for key, t in items:
        w = D.words_of(t)
        m = min(window, len(w))
        for j in range(len(w) - m + 1) if m else ():
            for i in range(len(words) - m + 1):
                if words[i : i + m] == w[j : j + m]:
                    hit |= set(range(i, i + m))
                    found.add(str(key) if key is not None else "null")
    return len(words), len(hit), ",".join(sorted(found))


def test_automaton_against_brute_force():
    rng = np.random.default_rng(3)
    for trial in range(60):
        letters = [chr(97 + k) for k in range(rng.integers(2, 5))]
        text = lambda n: " ".join(rng.choice(letters, n))  # noqa: B023, E731
        items = [(k, text(rng.integers(0, 12))) for k in range(5)]
        window = int(rng.integers(2, 6))
        a = D.Automaton([(str(k), D.words_of(t)) for k, t in items], window)
        for _ in range(5):
            t = text(30)
            words, found = D.words_of(t), set()
            hit = np.zeros(len(words), bool)
            a.match(words, hit, found)
            assert (len(words), int(hit.sum()), ",".join(sorted(found))) == brute(t, items, window), (trial, items, t, window)


ITEMS = "item_id long, text string, doc_id string"
PASSAGE = "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def test_report_and_removal(spark):
    items = spark.createDataFrame([(1, PASSAGE, "d"), (2, None, "d"), (3, "", "d"), (None, "solo", "d"), (1, "other words here", "d")], ITEMS)
    docs = [(1, f"Before it. {PASSAGE.upper()}! and after, " + "filler " * 30, "k", 1, "t"), (2, None, "k", 1, "t"), (3, "", "k", 1, "t"), (4, PASSAGE, "k", 1, "t"), (5, "clean text", "k", 1, "t"), (5, "clean text", "k", 1, "t"), (6, "a solo b other words here " + "z " * 20, "k", 1, "t")]
    df = spark.createDataFrame(docs, DOCS)
    got = rows(D.report(df, items), "doc_id")
    assert [(r["doc_id"], r["n_hit"], r["n_items"], r["contaminated"]) for r in got] == [(1, 12, 1, True), (2, 0, 0, False), (3, 0, 0, False), (4, 12, 1, True), (5, 0, 0, False), (5, 0, 0, False), (6, 4, 2, True)]
    assert got[6]["items_sha256"] == hashlib.sha256(b"1,null").hexdigest() and got[0]["longest"] == 12
    assert got[0]["spans"] == [{"start": 2, "end": 14}]
    clean = rows(D.decontaminate(df, items), "doc_id")
    assert [r["doc_id"] for r in clean] == [1, 2, 3, 5, 5, 6]
    assert clean[0]["text"].startswith("Before it. ! and after, filler") and clean[1]["text"] is None
    assert clean[5]["text"].startswith("a  b  z")
    assert not any(r["contaminated"] for r in rows(D.report(spark.createDataFrame([tuple(r.values()) for r in clean], DOCS), items)))


def test_small_automata_and_empty_tables(spark):
    items = spark.createDataFrame([(k, f"w{k} x{k} y{k}", "d") for k in range(6)], ITEMS)
    paths = D.build_automata(items, most_words=6)
    assert len(paths) == 3
    hits = D._examine(["w0 x0 y0 and w5 x5 y5"], paths)[0]
    assert hits[1].sum() == 6 and hits[2] == {"0", "5"}
    docs = spark.createDataFrame([(1, "t", "k", 1, "t")], DOCS)
    assert rows(D.report(docs, spark.createDataFrame([], ITEMS)))[0]["contaminated"] is False
    assert rows(D.report(spark.createDataFrame([], DOCS), items)) == []
