"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton is built over word ids on the driver, from items that come one by one, in parts of bounded size, and is
put into the shared folder; the documents stream through it. Its memory follows the benchmark, never the corpus.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import uuid
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenwatch.llm.common import open_store, shared_dir, tidied

WINDOW = 10
#: Words of the items that one automaton holds; more items make more automata, used one after another.
MOST_WORDS = 2_000_000
#: Bytes to words: A-Z become lower case, all that is neither letter, digit nor beyond ASCII becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(FOLD).split() if text else []


class Automaton:
    """A generalised suffix automaton over words. Each item counts by its windows of `window` words, a shorter one as a whole."""

    def __init__(self, items: Iterable[tuple[str, list[bytes]]], window: int) -> None:
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        paths = []
        self.least = window
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            if ids:
                self._insert(ids)
                self.least = min(self.least, len(ids))
                paths.append((item, ids))
        n = len(self.size)
        by_size = sorted(range(n), key=self.size.__getitem__)
        # the state whose strings include the suffix of `window` words
        self.whole = [-1] * n
        for v in by_size:
            if self.size[v] >= window:
                up = self.link[v]
                self.whole[v] = v if self.size[up] < window else self.whole[up]
        holders: dict[int, set[str]] = {}
        own: dict[int, set[tuple[int, str]]] = {}
        for item, ids in paths:
            v = 0
            for k, x in enumerate(ids):
                v = self.next[v][x]
                if k + 1 >= window:
                    holders.setdefault(self.whole[v], set()).add(item)
            if len(ids) < window:
                own.setdefault(v, set()).add((len(ids), item))
        self.holders = {k: frozenset(v) for k, v in holders.items()}
        # short items that end a state's strings: its own, and those of shorter suffixes
        self.own = {k: sorted(v) for k, v in own.items()}
        self.shorter: dict[int, list[tuple[int, str]]] = {}
        if own:
            for v in by_size[1:]:
                if got := [*self.own.get(self.link[v], ()), *self.shorter.get(self.link[v], ())]:
                    self.shorter[v] = got

    def _insert(self, ids: list[int]) -> None:
        last = 0
        for x in ids:
            if (q := self.next[last].get(x)) is not None:
                last = q if self.size[q] == self.size[last] + 1 else self._clone(last, x, q)
                continue
            cur = len(self.size)
            self.size.append(self.size[last] + 1)
            self.link.append(0)
            self.next.append({})
            p = last
            while p != -1 and x not in self.next[p]:
                self.next[p][x] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][x]
                self.link[cur] = q if self.size[q] == self.size[p] + 1 else self._clone(p, x, q)
            last = cur

    def _clone(self, p: int, x: int, q: int) -> int:
        c = len(self.size)
        self.size.append(self.size[p] + 1)
        self.link.append(self.link[q])
        self.next.append(dict(self.next[q]))
        self.link[q] = c
        while p != -1 and self.next[p].get(x) == q:
            self.next[p][x] = c
            p = self.link[p]
        return c

    def match(self, words: list[bytes], hit: np.ndarray, found: set[str]) -> int:
        """Marks the hit words, adds the items with occurring windows, and returns the longest matching length."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        known = ids >= 0
        edges = np.flatnonzero(np.diff(np.concatenate([[False], known, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        keep = ends - starts >= self.least
        longest = 0
        for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True):
            longest = max(longest, self._stream(ids[a:b].tolist(), a, hit, found))
        return longest

    def _stream(self, ids: list[int], at: int, hit: np.ndarray, found: set[str]) -> int:
        nxt, link, size, window = self.next, self.link, self.size, self.window
        v = n = longest = 0
        for i, x in enumerate(ids, at + 1):
            while v and x not in nxt[v]:
                v = link[v]
                n = size[v]
            if x in nxt[v]:
                v = nxt[v][x]
                n += 1
            if n > longest:
                longest = n
            if n >= window and (u := self.whole[v]) >= 0 and (got := self.holders.get(u)):
                hit[i - window : i] = True
                found |= got
            if self.own:
                for m, item in self.own.get(v, ()):
                    if m <= n:
                        hit[i - m : i] = True
                        found.add(item)
                for m, item in self.shorter.get(v, ()):
                    hit[i - m : i] = True
                    found.add(item)
        return longest


def build_automata(items: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text", most_words: int = MOST_WORDS) -> list[str]:
    """Paths, in the shared folder, of the automata over all items. Items stream to the driver; none is held beyond its part."""
    spark, paths, part, size = items.sparkSession, [], [], 0
    folder = shared_dir(spark, "automata")

    def put() -> None:
        path = f"{folder}/{uuid.uuid4().hex}"
        store, at = open_store(path)
        store.create_dir(at.rpartition("/")[0])
        with store.open_output_stream(at) as out:
            out.write(pickle.dumps(Automaton(part, window)))
        paths.append(path)

    for row in items.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), F.col(text).alias("t")).toLocalIterator():
        words = words_of(row["t"])
        if size and size + len(words) > most_words:
            put()
            part, size = [], 0
        part.append((row["k"], words))
        size += len(words)
    if part:
        put()
    return paths


_loaded: dict[str, Automaton] = {}


def _automaton(path: str) -> Automaton:
    """One automaton at a time stays in a worker."""
    if path not in _loaded:
        _loaded.clear()
        store, at = open_store(path)
        with store.open_input_stream(at) as f:
            _loaded[path] = pickle.loads(f.read())
    return _loaded[path]


def _examine(texts: list[str | None], paths: list[str]) -> list[tuple[int, np.ndarray, set[str], int]]:
    """Per text: number of words, hit words, items, longest matching length."""
    words = [words_of(t) for t in texts]
    out = [[len(w), np.zeros(len(w), dtype=bool), set(), 0] for w in words]
    for path in paths:
        a = _automaton(path)
        for w, o in zip(words, out, strict=True):
            if len(w) >= a.least:
                o[3] = max(o[3], a.match(w, o[1], o[2]))
    return out


def _spans(hit: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _without(text: str, hit: np.ndarray) -> str:
    """text without the spans of hit words."""
    raw = text.encode()
    places = [m.span() for m in WORD.finditer(raw)]
    out, at = [], 0
    for a, b in _spans(hit):
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    out.append(raw[at:])
    return b"".join(out).decode()


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (matching length) and spans (start, end in words).

    Null texts have no words and empty texts neither; null items are no windows. Items that share an id count once; an
    item without id counts as the id `null`. Repeated rows are documents of their own. An empty benchmark hits nothing.
    """
    paths = build_automata(items, window)
    out = T.StructType().add("doc_id", docs.schema[key].dataType)
    for name, kind in (("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"), ("contaminated", "boolean"), ("longest", "long"), ("spans", T.ArrayType(T.StructType().add("start", "long").add("end", "long")))):
        out = out.add(name, kind)

    def examine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                got = _examine(part.column("text").to_pylist(), paths)
                hits = [int(g[1].sum()) for g in got]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("key"), pa.array([g[0] for g in got], pa.int64()), pa.array(hits, pa.int64()), pa.array([len(g[2]) for g in got], pa.int64()),
                        pa.array([hashlib.sha256(",".join(sorted(g[2])).encode()).hexdigest() for g in got]), pa.array([h > 0 for h in hits]), pa.array([g[3] for g in got], pa.int64()),
                        pa.array([[{"start": a, "end": b} for a, b in _spans(g[1])] if h else [] for g, h in zip(got, hits, strict=True)], span),
                    ],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "spans"],
                )

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(tidied(examine), out)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, most_coverage: float = 0.5, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """docs with its columns, without the spans of hit words; documents of which more than most_coverage of the words are hit go.

    A removal can bring words together that make a new hit; it is repeated until there is none. The column named by
    `chars`, where there is one, gets the new length of a changed text. Documents without hits, null and empty texts
    stay as they are; repeated rows are treated alike; an empty benchmark changes nothing.
    """
    paths = build_automata(items, window)
    has_chars = chars in docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts = batch.column(at).to_pylist()
            keep, changed = [True] * len(texts), False
            sizes = batch.column(chars).to_pylist() if has_chars else []
            for k in range(0, len(texts), 256):
                for i, (n, hit, _, _) in enumerate(_examine(texts[k : k + 256], paths), k):
                    if not hit.any():
                        continue
                    changed = True
                    if hit.sum() > most_coverage * n:
                        keep[i] = False
                        continue
                    while hit.any():
                        texts[i] = _without(texts[i], hit)
                        ((_, hit, _, _),) = _examine([texts[i]], paths)
                    if has_chars:
                        sizes[i] = len(texts[i])
            if changed:
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if has_chars:
                    c = batch.schema.get_field_index(chars)
                    batch = batch.set_column(c, batch.schema.field(c), pa.array(sizes, batch.schema.field(c).type))
                batch = batch.filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(tidied(clean), docs.schema)


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    r = report(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return r.drop("spans", "longest")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i : i + least(10, len(w)) - 1], ' ') AS g
  FROM iw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM win),
occ AS (
  SELECT DISTINCT doc_id, i, m, g FROM (
    SELECT doc_id, i, m, array_to_string(w[i : i + m - 1], ' ') AS g FROM dw, sizes, unnest(range(1, len(w) - m + 2)) AS t(i)) SEMI JOIN win USING (m, g)),
hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM occ, unnest(range(0, m)) AS t(k) GROUP BY doc_id),
its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ JOIN win USING (m, g)) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
