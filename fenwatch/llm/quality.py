"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse vector: its words, hashed into buckets and scaled to length one, some statistics of its
structure, and its length as metadata. The score is the sigmoid of
w0 + sum w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), which takes time in proportion to the words.
The model is fitted by the driver on a bounded sample of labelled rows; all documents are scored on the executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenwatch.llm.common import tidied

BUCKETS, FACTORS, EPOCHS, RATE, SEED = 1 << 13, 8, 12, 0.1, 7
#: Labelled rows that the model is fitted on at most, those of the smallest hashes of their ids.
SAMPLE = 8192
THRESHOLD = 0.3
FOLDS = 5

#: Characters that are counted, one statistic each.
COUNTED = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"!", b"?", b"|", b"#$%&*+<=>@^~_\\", b".,;:", b"()[]{}", b"\"'-", b"\n"]
STATS = len(COUNTED) + 6


def statistics(raw: bytes, words: list[bytes]) -> list[float]:
    """Structure and metadata of a text: shares of kinds of characters, repetition, word and line lengths, and size."""
    n, k = max(1, len(raw)), max(1, len(words))
    lines = raw.split(b"\n")
    return [
        *((n - len(raw.translate(None, c))) / n if raw else 0.0 for c in COUNTED),
        sum(map(eq, words, words[1:])) / k,
        1 - len(set(words)) / k if words else 0.0,
        1 - len(set(lines)) / len(lines),
        np.log1p(n / k),
        np.log1p(len(words)),
        np.log1p(n / len(lines)),
    ]


def features(texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """Per text: buckets of its words, their values, and its statistics."""
    ids, values, stats = [], [], []
    for text in texts:
        raw = (text or "").encode()
        words = raw.split()
        stats.append(statistics(raw, words))
        at, n = np.unique(np.fromiter(map(zlib.crc32, raw.lower().split()), dtype=np.uint32, count=len(words)) % BUCKETS, return_counts=True)
        x = np.log1p(n)
        ids.append(at.astype(np.int32))
        values.append((x / (np.sqrt((x * x).sum()) or 1.0)).astype(np.float32))
    return ids, values, np.array(stats, dtype=np.float64).reshape(len(texts), STATS)


@dataclass
class FactorisationMachine:
    """Rows 0..STATS-1 are the statistics, the others the buckets."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def rows(self, ids: list[np.ndarray], values: list[np.ndarray], stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((stats - self.mean) / self.spread, -4, 4) / 2
        at = np.concatenate([np.concatenate([np.arange(STATS, dtype=np.int32), i + STATS]) for i in ids]) if ids else np.zeros(0, np.int32)
        x = np.concatenate([np.concatenate([s.astype(np.float32), v]) for s, v in zip(z, values, strict=True)]) if ids else np.zeros(0, np.float32)
        return at, x, np.cumsum([0, *(STATS + len(i) for i in ids)])

    def raw(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.factors[at] * x[:, None]
        total = np.add.reduceat(vx, starts[:-1])
        square = np.add.reduceat((vx * vx).sum(1), starts[:-1])
        return self.bias + np.add.reduceat(self.linear[at] * x, starts[:-1]) + 0.5 * ((total * total).sum(1) - square), total

    def score(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        out, _ = self.raw(*self.rows(*features(texts)))
        return 1 / (1 + np.exp(-np.clip(out.astype(np.float64), -30, 30)))

    @classmethod
    def fit(cls, ids: list[np.ndarray], values: list[np.ndarray], stats: np.ndarray, labels: np.ndarray) -> FactorisationMachine:
        """Adaptive gradient steps on the logistic loss. Without rows, or with one class alone, the score is the share of ones (one half without rows)."""
        rng = np.random.default_rng(SEED)
        n = len(labels)
        share = (labels.sum() + 1) / (n + 2)
        m = cls(float(np.log(share / (1 - share))), np.zeros(STATS + BUCKETS, np.float32), np.zeros((STATS + BUCKETS, FACTORS), np.float32), np.zeros(STATS), np.ones(STATS))
        if n == 0 or labels.min() == labels.max():
            return m
        m.mean, m.spread = stats.mean(0), np.maximum(stats.std(0), 1e-6)
        m.factors = rng.normal(0, 0.05, m.factors.shape).astype(np.float32)
        all_at, all_x, starts = m.rows(ids, values, stats)
        g_bias, g_linear, g_factors = 1e-6, np.full_like(m.linear, 1e-6), np.full_like(m.factors, 1e-6)
        for _ in range(EPOCHS):
            order = rng.permutation(n)
            for k in range(0, n, 64):
                part = order[k : k + 64]
                at = np.concatenate([all_at[starts[i] : starts[i + 1]] for i in part])
                x = np.concatenate([all_x[starts[i] : starts[i + 1]] for i in part])
                sizes = np.array([starts[i + 1] - starts[i] for i in part])
                out, total = m.raw(at, x, np.concatenate([[0], np.cumsum(sizes)]))
                wrong = 1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[part]
                per = np.repeat(wrong, sizes) * x
                used, where = np.unique(at, return_inverse=True)
                d_linear = np.bincount(where, per, len(used)) / len(part) + 1e-5 * m.linear[used]
                d_factors = np.empty((len(used), FACTORS))
                spread_total = np.repeat(total, sizes, axis=0)
                for f in range(FACTORS):
                    d_factors[:, f] = np.bincount(where, per * (spread_total[:, f] - m.factors[at, f] * x), len(used)) / len(part) + 1e-4 * m.factors[used, f]
                d_bias = wrong.mean()
                g_bias += d_bias**2
                g_linear[used] += d_linear**2
                g_factors[used] += d_factors**2
                m.bias -= float(RATE * d_bias / np.sqrt(g_bias))
                m.linear[used] -= (RATE * d_linear / np.sqrt(g_linear[used])).astype(np.float32)
                m.factors[used] -= (0.5 * RATE * d_factors / np.sqrt(g_factors[used])).astype(np.float32)
        return m


def held_out(key: Column) -> Column:
    """Whether a document is never learnt from: the crc32 of its id as text is divisible by FOLDS. Null ids are not held out."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, key: str = "doc_id", text: str = "text", label: str = "quality") -> FactorisationMachine:
    """Fits the model on at most `sample` labelled rows that are not held out; null labels and ids are left out, rows that repeat count each time."""
    chosen = labels.select(F.col(key).alias("key"), F.col(label).alias("label")).where(F.col("key").isNotNull() & F.col("label").isNotNull() & ~held_out(F.col("key")))
    chosen = chosen.orderBy(F.xxhash64("key"), "key", "label").limit(sample)  # at most `sample` short rows, which is what bounds the broadcast

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, stats = features(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("key").cast(pa.string()), batch.column("label").cast(pa.float64()), pa.array(ids, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32())), pa.array(list(stats), pa.list_(pa.float64()))], names=["key", "label", "ids", "x", "stats"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    got = rows.select("key", "label", "text").mapInArrow(tidied(extract), "key string, label double, ids array<int>, x array<float>, stats array<double>").toArrow()
    got = got.append_column("size", pa.array([len(x) for x in got.column("ids")], pa.int64())).sort_by([("key", "ascending"), ("label", "ascending"), ("size", "ascending")])
    listed = lambda name: [x.values.to_numpy() for c in got.column(name).chunks for x in c]
    stats = np.array(listed("stats"), dtype=np.float64).reshape(got.num_rows, STATS)
    return FactorisationMachine.fit(listed("ids"), listed("x"), stats, got.column("label").to_numpy())


def score(docs: DataFrame, model: FactorisationMachine, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if the score reaches the threshold) of every whole text; null texts count as empty. Repeated rows are scored alike; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                s = model.score(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    out = T.StructType().add("doc_id", docs.schema[key].dataType).add("held_out", "boolean").add("score", "double").add("predicted", "integer")
    return docs.select(F.col(key).alias("key"), held_out(F.col(key)).alias("held_out"), F.col(text).alias("text")).mapInArrow(tidied(run), out)


def keep_good(docs: DataFrame, model: FactorisationMachine, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, with its columns, without those whose score stays below the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            kept = [s >= threshold for k in range(0, len(texts), 256) for s in model.score(texts[k : k + 256]).tolist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(tidied(run), docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' quality, as labels.quality marks it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
