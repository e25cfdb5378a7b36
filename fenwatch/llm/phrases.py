"""Collocations: phrases whose words occur together far more often than apart.

Texts are cut into pieces, and equal pieces of a language become one with a multiplicity, so that copies are counted
without being read again. Weighted n-grams are dealt by hash, and each bucket is counted by duckdb, which keeps what
exceeds its memory in files of the task. Words come first, then pairs of frequent words, then longer phrases all of whose
pairs are frequent: a phrase is no more frequent than any part of it, so nothing is lost. What is frequent is known to
the tasks by a Bloom filter of bounded size, whose mistakes cost only rows that are counted and fall away.

The counts of a candidate's parts lie in other buckets. Candidates send requests by part, which are shuffled to where
the part's count is, and the answers are joined back by candidate.
"""

from __future__ import annotations

import tempfile
from collections import Counter
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenwatch.llm.common import tidied, written

LEAST, LONGEST, TOP = 100, 5, 2000
#: A task gathers so many words before it hands their n-grams on; longer pieces are one such gathering.
WORDS_AT_ONCE = 1_000_000
#: duckdb's memory in a task.
MEMORY = "200MB"
#: Bits of a filter for each of its keys, and at most (16 MiB), and the bits that a key sets.
BITS_PER_KEY, MOST_BITS, HASHES = 16, 1 << 27, 4
#: A to Z to lower case; ends of pieces to a line feed, a tab to a space.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\x0d\x09", bytes(range(97, 123)) + b"\n" * 9 + b" ")
NO_LANG = "und"


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, piece (words parted by single spaces) and m, how often it occurs; pieces without words are left out."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = {}
            held = 0
            for of, raw in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = found.setdefault(of, Counter())
                own.update([b" ".join(p.split()) for p in raw.translate(_FOLD).split(b"\n")])
                held += len(raw)
                if held > 1 << 24:
                    yield from out(found)
                    found, held = {}, 0
            yield from out(found)

    def out(found: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for of, own in found.items():
            own.pop(b"", None)
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([of] * len(own), pa.string()), pa.array(list(own), pa.binary()), pa.array(list(own.values()), pa.int64())], names=["lang", "piece", "m"])

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).cast("binary").alias("text")).where("text IS NOT NULL")
    return rows.mapInArrow(tidied(cut), "lang string, piece binary, m long").groupBy("lang", "piece").agg(F.sum("m").alias("m"))


class Bloom:
    """Keys that may be in a set; whoever is in it is told."""

    def __init__(self, words: np.ndarray) -> None:
        self.words, self.mask = words, np.uint64(len(words) * 64 - 1)

    @staticmethod
    def places(keys: list[bytes], bits: int) -> np.ndarray:
        """HASHES places of each key, by double hashing."""
        h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(k) for k in keys]), ">u8").reshape(-1, 2).astype(np.uint64)
        return (h[:, :1] + np.arange(HASHES, dtype=np.uint64) * (h[:, 1:] | np.uint64(1))) & np.uint64(bits - 1)

    def has(self, keys: list[bytes]) -> np.ndarray:
        if not keys:
            return np.zeros(0, dtype=bool)
        p = self.places(keys, len(self.words) * 64)
        return ((self.words[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)) == 1).all(1)


def key_of(lang: str, phrase: bytes) -> bytes:
    return lang.encode() + b"\x00" + phrase


def bloom(counts: DataFrame) -> Bloom:
    """A filter of (lang, phrase); its bits are gathered by Spark, MOST_BITS / 64 rows at most."""
    n = counts.count()
    bits = 1 << max(10, min(MOST_BITS.bit_length() - 1, (max(1, n) * BITS_PER_KEY - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = Bloom.places([key_of(*x) for x in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True)], bits).ravel()
                yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (p & np.uint64(63))).view(np.int64))], names=["slot", "bit"])

    got = counts.select("lang", "phrase").mapInArrow(tidied(mark), "slot long, bit long").groupBy("slot").agg(F.expr("bit_or(bit)").alias("word")).toArrow()
    words = np.zeros(bits // 64, np.uint64)
    words[got.column("slot").to_numpy()] = got.column("word").to_numpy().view(np.uint64)
    return Bloom(words)


def grams(held: pa.Table, shortest: int, longest: int, known: Bloom | None) -> Iterator[pa.RecordBatch]:
    """Different n-grams of some pieces with their weights; with a filter, of words or pairs, only those all of whose words or pairs it tells."""
    langs, names = held.column("lang").combine_chunks().dictionary_encode(), None
    split = pc.split_pattern(held.column("piece").combine_chunks(), b" ")
    sizes = np.diff(split.offsets.to_numpy())
    encoded = split.flatten().dictionary_encode()
    words, vocabulary = encoded.indices.to_numpy().astype(np.int64), encoded.dictionary
    lang_of, names = langs.indices.to_numpy().astype(np.int64), langs.dictionary.to_pylist()
    owner = np.repeat(np.arange(len(sizes)), sizes)
    weight = held.column("m").to_numpy()
    width = len(vocabulary)

    def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(keys, return_inverse=True)

    # ids of the n-grams that begin at each place, -1 where there is none; parts: (lang, word, ...) of each id
    different, ids = numbered(lang_of[owner] * width + words)
    parts = np.stack([different // width, different % width], 1)
    if known and shortest == 2:
        told = known.has([key_of(names[x], w) for x, w in zip(parts[:, 0].tolist(), vocabulary.take(pa.array(parts[:, 1])).to_pylist(), strict=True)])
        ids = np.where(told[ids], ids, -1)
    single = ids
    for n in range(1, longest + 1):
        if n > 1:
            ends = np.flatnonzero((ids[: -n + 1] >= 0) & (owner[n - 1 :] == owner[: -n + 1])) if len(ids) >= n else np.zeros(0, np.int64)
            last = single[ends + n - 1]
            both = last >= 0
            if n > 2:
                both &= pair[ends + n - 2] >= 0  # noqa: F821
            ends = ends[both]
            different, inverse = numbered(ids[ends] * width + words[ends + n - 1])
            parts = np.hstack([parts[different // width], (different % width)[:, None]])
            ids = np.full(len(owner), -1)
            ids[ends] = inverse
            if n == 2:
                if known and shortest > 2:
                    joined = pc.binary_join_element_wise(vocabulary.take(pa.array(parts[:, 1])), vocabulary.take(pa.array(parts[:, 2])), pa.scalar(b" ", pa.binary()))
                    told = known.has([key_of(names[x], w) for x, w in zip(parts[:, 0].tolist(), joined.to_pylist(), strict=True)])
                    ids[ends] = np.where(told[inverse], inverse, -1)
                pair = ids
        if n >= shortest and len(parts):
            at = np.flatnonzero(ids >= 0)
            sums = np.zeros(len(parts), np.int64)
            np.add.at(sums, ids[at], weight[owner[at]])
            there = np.flatnonzero(sums)
            texts = [vocabulary.take(pa.array(parts[there, k])) for k in range(1, n + 1)]
            phrase = pc.binary_join_element_wise(*texts, pa.scalar(b" ", pa.binary())) if n > 1 else texts[0]
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(parts[there, 0])), phrase, pa.array(np.full(len(there), n, np.int32)), pa.array(sums[there])], names=["lang", "phrase", "words", "m"])


def counted(found: DataFrame, shortest: int, longest: int, known: Bloom | None, least: int) -> DataFrame:
    """lang, phrase, words and f of the n-grams with f of `least` or more."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                held.append(part)
                size += (pc.sum(pc.binary_length(part.column("piece"))).as_py() or 0) // 6
                if size >= WORDS_AT_ONCE:
                    yield from grams(pa.Table.from_batches(held), shortest, longest, known)
                    held, size = [], 0
        if held:
            yield from grams(pa.Table.from_batches(held), shortest, longest, known)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("words", pa.int32()), ("m", pa.int64())])
        with tempfile.TemporaryDirectory(prefix="counts-") as own:
            con = duckdb.connect()
            con.execute(f"SET threads = 1; SET memory_limit = '{MEMORY}'; SET temp_directory = '{own}'; SET preserve_insertion_order = false")
            rows = pa.RecordBatchReader.from_batches(schema, (pa.RecordBatch.from_arrays(b.columns, schema=schema) for b in batches))  # noqa: F841
            got = con.sql(f"SELECT lang, phrase, any_value(words) AS words, CAST(sum(m) AS BIGINT) AS f FROM rows GROUP BY lang, phrase HAVING sum(m) >= {int(least)}")
            for batch in got.to_arrow_reader(65_536):
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(batch.columns, schema.types, strict=True)], names=["lang", "phrase", "words", "f"])
            con.close()

    dealt = found.mapInArrow(tidied(cut), "lang string, phrase binary, words int, m long").repartition("lang", "phrase")
    return dealt.mapInArrow(tidied(add), "lang string, phrase binary, words int, f long")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's `top` phrases of 2 to `longest` words by score, a and phrase.

    A null language is `und`, a null or empty text has no words, and very long texts and pieces are taken whole. Ties go
    by the bytes of the phrase; repeated rows count as often as they occur. Languages without a phrase of `least`
    occurrences give no row, nor does an empty table. Other columns are ignored. Scores are decimals of 38 digits,
    which hold 1000 * a * n exactly up to 10^17 words.
    """
    found = written(pieces(docs, text, lang), "pieces")
    words = written(counted(found, 1, 1, None, least), "words")
    pairs = written(counted(found, 2, 2, bloom(words), least), "pairs")
    counts = words.unionByName(pairs)
    if longest > 2:
        longer = written(counted(found, 3, longest, bloom(pairs), least), "longer")
        counts = counts.unionByName(longer)
    total = found.groupBy("lang").agg(F.sum(F.col("m") * (F.length(F.col("piece")) - F.length(F.translate(F.decode("piece", "ISO-8859-1"), " ", "")) + 1)).alias("n"))
    listed = F.split(F.decode("phrase", "ISO-8859-1"), " ")  # a character for each byte, so that any bytes are kept
    text_of = lambda words: F.encode(F.array_join(words, " "), "ISO-8859-1")
    candidates = counts.where("words >= 2").withColumn("w", listed)

    # requests by part: both sides of every cut
    cuts = candidates.select("lang", "phrase", "words", "f", "w", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    sides = F.array(F.struct(F.lit(0).alias("side"), text_of(F.slice("w", F.lit(1), F.col("k"))).alias("part")), F.struct(F.lit(1).alias("side"), text_of(F.slice("w", F.col("k") + 1, F.col("words") - F.col("k"))).alias("part")))
    requests = cuts.select("lang", "phrase", "words", "f", "k", F.inline(sides))
    answers = requests.join(counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f")), ["lang", "part"])
    # a part of one word fewer learns by the same request how often the longer phrase occurs
    within = answers.where(((F.col("side") == 0) & (F.col("k") == F.col("words") - 1)) | ((F.col("side") == 1) & (F.col("k") == 1))).where("words > 2")
    inside = within.where(F.col("f") * 100 >= F.col("part_f") * 100).select("lang", F.col("part").alias("phrase")).distinct()
    both = answers.groupBy("lang", "phrase", "k").agg(F.first("f").alias("a"), F.max(F.when(F.col("side") == 0, F.col("part_f"))).alias("l"), F.max(F.when(F.col("side") == 1, F.col("part_f"))).alias("r"))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # `div` of decimals is an exact division of whole numbers; products stay within 38 digits
    scored = both.join(F.broadcast(total) if total.limit(10_001).count() <= 10_000 else total, "lang")
    scored = scored.withColumn("top", (wide("a") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(19,0)") * wide("n")).withColumn("under", wide("l") * wide("r"))
    scored = scored.withColumn("score", F.expr("top div under"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r", "n")).alias("m")).select("lang", "phrase", "m.*")
    kept = lowest.join(inside, ["lang", "phrase"], "left_anti")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("phrase").cast("string").alias("phrase"), "a", "l", "r", "n", "score")


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' phrases."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH p AS (
  SELECT lang, [w FOR w IN string_split_regex(piece, '[\x20\x09]+') IF w <> ''] AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
g AS (
  SELECT lang, w[i : i + k - 1] AS g, count(*) AS f
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM p, (VALUES (1), (2), (3), (4), (5)) v(k) WHERE len(w) >= k)
  GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS HUGEINT) AS n FROM g WHERE len(g) = 1 GROUP BY lang),
c AS (SELECT * FROM g WHERE f >= 100 AND len(g) >= 2),
cuts AS (
  SELECT c.lang, c.g, c.f AS a, k, x.f AS l, y.f AS r, n.n, (1000 * CAST(c.f AS HUGEINT) * n.n) // (CAST(x.f AS HUGEINT) * y.f) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM c) c
  JOIN g x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN g y ON y.lang = c.lang AND y.g = c.g[k + 1 : len(c.g)] JOIN n ON n.lang = c.lang),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
subs AS (SELECT DISTINCT lang, g[i : i + k - 1] AS s, f FROM (SELECT lang, g, f, k, unnest(range(1, len(g) - k + 2)) AS i FROM c, (VALUES (2), (3), (4)) v(k) WHERE len(g) > k)),
kept AS (SELECT * FROM low WHERE NOT EXISTS (SELECT 1 FROM subs WHERE subs.lang = low.lang AND subs.s = low.g AND 100 * subs.f >= 100 * low.a)),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(g, ' ')) AS rank, array_to_string(g, ' ') AS phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000
"""
