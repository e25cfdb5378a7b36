"""SimHash near-duplicates by anchor-point covering.

The anchors are the words of a covering code: two blocks of 23 bits of a fingerprint, each covered by the binary Golay
code, every block being within R = 3 bits of a codeword. A fingerprint goes to every anchor within R plus the
threshold (over both blocks, the excess beyond R adds up to the threshold at most). If two fingerprints differ in no
more bits than the threshold, the anchor next to one of them is within reach of the other, so they meet there; as both
sides are sent so far, blocks that differ in up to twice the threshold meet as well, at an anchor near the middle.
Fingerprints are compared per anchor only, and each anchor gives a forest of links, not all pairs. Anchors with more
members than a task should hold are cut into parts, of which each two meet in a task of their own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenwatch.llm.components import PART_EDGES, components, forest
from fenwatch.llm.common import partitions_for, runs, split_join, tidied, written

SEED = 42
#: Members of an anchor that one task compares; larger anchors are cut into parts of half as many.
MOST_MEMBERS = 16_384
#: Of so many fingerprints one is replicated beforehand, to see which anchors are large.
SAMPLED = 64

# ---- fingerprints


def shingles(raw: bytes, width: int) -> list[bytes]:
    """Shingles of consecutive words of lower-cased bytes, repeats included; the whole sequence where it is shorter; none without words."""
    words = raw.split()
    if len(words) < width:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))


def majority(hashes: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    """hashes: bytes, a row of them for each of n features. The bits set in over half of the features (or of their weight), packed."""
    if not n:
        return np.zeros(hashes.shape[1] if hashes.ndim == 2 else 0, np.uint8)
    bits = np.unpackbits(hashes, axis=1)
    if weights is None:
        return np.packbits(bits.sum(0, dtype=np.int64) * 2 > n)
    return np.packbits(weights @ bits * 2 > weights.sum())


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits from the XXH64 of a text's shingles; zero without words."""
    parts = shingles((text or "").encode().lower(), width)
    if not parts:
        return 0
    h = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([h(p, SEED) for p in parts]), np.uint8).reshape(-1, 8)
    return int.from_bytes(majority(hashes, len(parts)).tobytes(), "big")


# ---- the covering code

BLOCK, RADIUS, CODEWORD_BITS = 23, 3, 12
#: The generator polynomial of the binary Golay code of length 23.
GENERATOR = 0b101011100011


@cache
def code_tables(threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By byte of a word: its part of the syndrome; by syndrome: all differences to codewords within RADIUS + threshold (padded with zeros), and their excess beyond RADIUS (padded with threshold + 1)."""

    def remainder(x: int) -> int:
        for k in range(BLOCK - 1, BLOCK - CODEWORD_BITS - 1, -1):
            if x >> k & 1:
                x ^= GENERATOR << (k - (BLOCK - CODEWORD_BITS))
        return x

    unit = [remainder(1 << k) for k in range(BLOCK)]
    parts = np.zeros((3, 256), dtype=np.int64)
    for p in range(3):
        for v in range(256):
            s = 0
            for k in range(8):
                if v >> k & 1 and p * 8 + k < BLOCK:
                    s ^= unit[p * 8 + k]
            parts[p, v] = s
    near: list[list[tuple[int, int]]] = [[] for _ in range(1 << (BLOCK - CODEWORD_BITS))]
    for weight in range(RADIUS + threshold + 1):
        for places in combinations(range(BLOCK), weight):
            s = e = 0
            for k in places:
                s ^= unit[k]
                e |= 1 << k
            near[s].append((e, max(0, weight - RADIUS)))
    most = max(map(len, near))
    differences = np.zeros((len(near), most), dtype=np.int64)
    excess = np.full((len(near), most), threshold + 1, dtype=np.int64)
    for s, found in enumerate(near):
        for k, (e, x) in enumerate(found):
            differences[s, k], excess[s, k] = e, x
    return parts, differences, excess


def anchors(words: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """words: 46 bits each. (index of a word, anchor) for every anchor within reach; an anchor is two codewords' information bits."""
    parts, differences, excess = code_tables(threshold)
    codes, over = [], []
    for block in (words & (1 << BLOCK) - 1, words >> BLOCK & (1 << BLOCK) - 1):
        s = parts[0, block & 255] ^ parts[1, block >> 8 & 255] ^ parts[2, block >> 16 & 255]
        codes.append((block[:, None] ^ differences[s]) >> (BLOCK - CODEWORD_BITS))
        over.append(excess[s])
    at, i, j = np.nonzero(over[0][:, :, None] + over[1][:, None, :] <= threshold)
    return at, codes[0][at, i] << CODEWORD_BITS | codes[1][at, j]


# ---- links


def link_groups(starts: np.ndarray, signs: np.ndarray, most: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links between rows of groups: row pairs (as two lists of index arrays) that connect, in each group, what is connected by pairs differing in `most` bits or fewer.

    starts: bounds of the groups; signs: a row of 64-bit words each. Small groups are compared pair by pair, all
    groups at once; larger ones by a search that compares a row with those not reached yet.
    """
    left, right = [], []
    sizes = np.diff(starts)
    small = np.flatnonzero((sizes > 1) & (sizes <= 8))
    for k in range(1, 8):
        groups = small[sizes[small] > k]
        if not len(groups):
            break
        counts = sizes[groups] - k
        a = np.repeat(starts[:-1][groups], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        good = np.bitwise_count(signs[a] ^ signs[a + k]).sum(1) <= most
        left.append(a[good])
        right.append(a[good] + k)
    for g in np.flatnonzero(sizes > 8).tolist():
        base = int(starts[g])
        rest = np.arange(base, int(starts[g + 1]))
        while len(rest) > 1:
            queue, rest = [int(rest[0])], rest[1:]
            while queue and len(rest):
                x = queue.pop()
                near = np.bitwise_count(signs[rest] ^ signs[x]).sum(1) <= most
                if near.any():
                    found = rest[near]
                    left.append(np.full(len(found), x))
                    right.append(found)
                    queue += found.tolist()
                    rest = rest[~near]
    return left, right


def in_parts(rows: DataFrame, large: DataFrame, key: str) -> DataFrame:
    """rows (id, key, ...) with the part of their id and the pair of parts that meet; those of a key in large (key, cuts) once for each part that theirs is to meet."""
    if not (n_large := large.count()):
        return rows.withColumn("own", F.lit(0)).withColumn("part", F.lit(0))
    joined = rows.join(F.broadcast(large) if n_large <= 100_000 else large, key, "left")
    own = F.coalesce(F.pmod(F.xxhash64("id", F.lit(1)), F.col("cuts")).cast("int"), F.lit(0))
    met = F.when(F.col("cuts").isNull(), F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda j: F.least(own, j) * F.col("cuts") + F.greatest(own, j)))
    return joined.withColumn("own", own).withColumn("part", F.explode(met)).drop("cuts")


def links(prints: DataFrame, words: list[str], signs: list[str], threshold: int, most_bits: int, most_members: int = MOST_MEMBERS, bands: str | None = None) -> DataFrame:
    """Edges (a, b) of ids that connect what is linked.

    prints: a row per different fingerprint, with a long id, the 46-bit `words` whose anchors it goes to, and the
    64-bit `signs`; two are linked if their signs differ in most_bits bits or fewer and they meet at an anchor. `bands`
    names a column of further anchors (longs beyond those of words). Each anchor gives a forest, so that edges are no
    more than the copies that went to anchors, however many are linked.
    """
    columns = list(dict.fromkeys(["id", *words, *signs, *([bands] if bands else [])]))
    spark = prints.sparkSession
    schema = T.StructType().add("anchor", T.LongType() if bands else T.IntegerType()).add("id", "long")
    for s in signs:
        schema = schema.add(f"sign_{s}", "long")
    carried = ["id", *signs]

    def replicate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2048):
                part = batch.slice(k, 2048)
                for n, w in enumerate(words):
                    at, anchor = anchors(part.column(w).to_numpy() & (1 << 2 * BLOCK) - 1, threshold)
                    order = np.argsort(anchor)  # a document's copies lie apart, so that their size in a shuffle is the same for any number of partitions
                    at, anchor = at[order], anchor[order]
                    take = [part.column(x).to_numpy()[at] for x in carried]
                    yield pa.RecordBatch.from_arrays([pa.array((anchor | n << 2 * CODEWORD_BITS).astype(np.int64 if bands else np.int32)), *map(pa.array, take)], schema.names)
                if bands:
                    held = part.column(bands)
                    at = np.repeat(np.arange(part.num_rows), np.diff(held.offsets.to_numpy()))
                    anchor = held.flatten().to_numpy()
                    order = np.argsort(anchor)
                    yield pa.RecordBatch.from_arrays([pa.array(anchor[order]), *(pa.array(part.column(x).to_numpy()[at[order]]) for x in carried)], schema.names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        done = False
        source = iter(batches)
        while not done:
            batch = next(source, None)
            done = batch is None
            if not done:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held is None or not held.num_rows:
                continue
            keys = held.column("anchor").to_numpy()
            parts = held.column("part").to_numpy()
            cuts = np.flatnonzero((keys[1:] != keys[:-1]) | (parts[1:] != parts[:-1])) + 1
            end = len(keys) if done else int(cuts[-1]) if len(cuts) else 0
            if not end:
                continue
            starts = np.concatenate([[0], cuts[cuts < end], [end]])
            ids = held.column("id").to_numpy()
            sign = np.stack([held.column(f"sign_{s}").to_numpy() for s in signs], axis=1).view(np.uint64)
            a, b = link_groups(starts, sign, most_bits)
            x, y = forest(ids[np.concatenate(a)], ids[np.concatenate(b)]) if a else ([], [])
            if x:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])
            held = held.slice(end)

    some = prints.select(*columns).where(F.pmod(F.xxhash64("id", F.lit(SAMPLED)), F.lit(SAMPLED)) == 0)
    large = some.mapInArrow(tidied(replicate), schema).groupBy("anchor").count().where(F.col("count") * SAMPLED > most_members // 2)
    large = written(large.select("anchor", F.ceil(F.col("count") * SAMPLED / (most_members // 4)).cast("int").alias("cuts")), "large-anchors")
    # each row becomes many, so the rows are dealt out anew, however few bytes they are
    copies = prints.select(*columns).repartition(partitions_for(spark), "id").mapInArrow(tidied(replicate), schema)
    dealt = in_parts(copies, large, "anchor").drop("own").repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return dealt.mapInArrow(tidied(compare), "a long, b long")


def with_components(docs: DataFrame, key_columns: list[str], edges: DataFrame) -> DataFrame:
    """docs (doc_id, id, ...) with component_id: the least doc_id reachable by edges between ids."""
    roots = components(edges).select(F.col("node").alias("id"), "root")
    ids = docs.groupBy("id").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n_rows"))
    rooted = written(ids.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")), "rooted")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_ids"), F.sum("n_rows").alias("n_docs"))
    named = written(named, "components")
    totals = named.agg(F.sum("n_ids"), F.sum("n_docs")).first()
    if totals[0] is None:
        return docs.select("doc_id", *key_columns, F.col("doc_id").alias("component_id"))
    of_id = written(split_join(rooted.select("id", "n_rows", "root"), named.drop("n_docs"), "root", "n_ids", totals[0]).drop("root"), "ids")
    return split_join(docs, of_id, "id", "n_rows", totals[1]).select("doc_id", *key_columns, "component_id")


def simhash_components(docs: DataFrame, width: int = 3, threshold: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits) and component_id (the least doc_id reachable by fingerprints that differ in `threshold` bits or fewer).

    Null and empty texts have the fingerprint zero, which links as any other. Equal fingerprints are one node, so that
    copies are never paired. Rows with a null id get a component, but never name it unless all its ids are null;
    repeated rows are kept. Other columns are ignored; an empty table gives no row.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t, width) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints)], names=["doc_id", "id"])

    out = T.StructType().add("doc_id", docs.schema[key].dataType).add("id", "long")
    marked = written(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(tidied(mark), out), "fingerprints")
    prints = marked.select("id").distinct()
    edges = links(prints.withColumn("word", F.col("id")), ["word"], ["id"], threshold, threshold)
    named = marked.withColumn("fingerprint", F.lower(F.lpad(F.hex("id"), 16, "0")))
    return with_components(named, ["fingerprint"], edges)


#: Near copies share this part of all their different five-word shingles (Jaccard similarity), which is computed for every link.
NEAR_WIDTH, NEAR_SHARE = 5, 0.8
#: Hashes of shingles that are compared: all of a text, or the least so many of a longer one, which estimate the similarity with a deviation of 0.0125 at 0.8.
LEAST_HASHES = 1024
#: Candidates' signs, a bit of each of SIGN_BITS minima, may differ in so many: at a similarity of 0.8 they differ in 25.6 with a deviation of 4.8, at 0.6 in 51.2.
SIGN_BITS, MOST_SIGN_BITS = 256, 46
#: Documents of a group of candidates that are one part; a task compares a part with itself or with another one.
PART_SETS = 1024
#: Counts of shared hashes are made by a matrix product for hashes that one in so many sets holds, and by their pairs of sets for others.
DENSE = 8
#: Columns of that product at a time, and pairs of the others.
DENSE_COLUMNS, RARE_PAIRS = 1024, 1 << 20
#: Nothing reads this any more: all candidates are decided at once. A test of small rounds still sets it.
NEAREST = 8
#: Bands of the shingles' minima under random permutations: at a similarity of 0.8 one of them at least is equal with a probability of 0.9998, wherever the edits lie.
BANDS, BAND_ROWS = 12, 3
_MIXERS = np.random.default_rng(SEED).integers(0, 1 << 63, SIGN_BITS + BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted 32-bit hashes of a text's different five-word shingles, the least LEAST_HASHES of them."""
    h = xxhash.xxh32_intdigest
    return np.unique(np.array([h(p) for p in set(shingles((text or "").encode().lower(), NEAR_WIDTH))], np.uint32))[:LEAST_HASHES]


def similar(x: np.ndarray, y: np.ndarray, share: float) -> bool:
    """Whether two sets have a Jaccard similarity of `share`; of sets that were cut, the least hashes of their union tell."""
    both = np.intersect1d(x, y, assume_unique=True)
    if max(len(x), len(y)) < LEAST_HASHES:
        every = len(x) + len(y) - len(both)
        return len(both) > 0 and len(both) >= share * every - 1e-9
    top = np.union1d(x, y)[:LEAST_HASHES]
    return bool((both <= top[-1]).sum() >= share * len(top) - 1e-9)


def minima(values: np.ndarray) -> np.ndarray:
    """The least of a set's values under each of the random permutations, for so many values at a time."""
    least = np.full(len(_MIXERS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(values), 1024):
        np.minimum(least, (_MIXERS[:, None] * values[None, k : k + 1024]).min(1), out=least)
    return least


def near_prints(text: str | None) -> tuple[list[int], list[int]]:
    """A 46-bit word, from the SimHash of a text's different words, four 64-bit signs, a bit of each of 256 minima of its different five-word shingles, and the digest of the set of these; and bands of other minima.

    Words and bands are only for meeting: an edit changes five shingles but one word, so scattered edits leave the word
    alike, and edits of one passage leave bands alike. All are zero without words.
    """
    raw = (text or "").encode().lower()
    parts = set(shingles(raw, NEAR_WIDTH))
    if not parts:
        return [0] * 6, []
    known = set(raw.split())
    word = majority(np.frombuffer(b"".join([xxhash.xxh64_digest(w, SEED) for w in known]), np.uint8).reshape(-1, 8), len(known)).tobytes()
    values = np.sort(np.array([xxhash.xxh3_64_intdigest(p) for p in parts], np.uint64))
    least = minima(values)
    signs = np.packbits((least[:SIGN_BITS] >> np.uint64(20) & np.uint64(1)).astype(np.uint8)).view(np.uint64)
    bands = [xxhash.xxh3_64_intdigest(row.tobytes(), k) >> 2 | 1 << 62 for k, row in enumerate(least[SIGN_BITS:].reshape(BANDS, BAND_ROWS))]
    return [int.from_bytes(word, "big") >> 64 - 2 * BLOCK, *signs.tolist(), xxhash.xxh3_64_intdigest(values.tobytes())], bands


def by_value(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sets (numbers) that hold each value, value by value; where a value's begin; and how many they are."""
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values = values[order]
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return row[order], starts, np.diff(starts, append=len(values))


def shared_counts(n: int, row: np.ndarray, starts: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How many values each two of n sets have in common, from what by_value tells."""
    counts = np.zeros((n, n), np.float32)
    least = max(2, n // DENSE)
    often = np.flatnonzero(times >= least)
    for k in range(0, len(often), DENSE_COLUMNS):
        of = often[k : k + DENSE_COLUMNS]
        column = np.repeat(np.arange(len(of)), times[of])
        at = np.repeat(starts[of] - np.cumsum(times[of]) + times[of], times[of]) + np.arange(len(column))
        holds = np.zeros((n, len(of)), np.float32)
        holds[row[at], column] = 1
        counts += holds @ holds.T
    flat = counts.reshape(-1)
    for t in range(2, least):
        of = starts[times == t]
        for k in range(0, len(of), max(1, RARE_PAIRS // t**2)):
            members = row[of[k : k + max(1, RARE_PAIRS // t**2), None] + np.arange(t)]
            np.add.at(flat, (members[:, :, None] * n + members[:, None, :]).reshape(-1), np.float32(1))
    return counts


def set_links(sets: list[np.ndarray], own: np.ndarray, share: float) -> tuple[list[int], list[int]]:
    """Links between sets (numbers): they connect what pairs with a Jaccard similarity of `share` connect. Where the sets are of several parts (own), pairs of one part are left to the task that has it alone."""
    rows = np.flatnonzero([len(x) > 0 for x in sets])
    left, right = [], []
    if len(rows) < 2:
        return left, right
    row, starts, times = by_value([sets[k] for k in rows])
    sizes = np.array([len(sets[k]) for k in rows])
    # a set that shares less than this with all others together links with none
    enough = np.bincount(row, np.repeat(times > 1, times), len(rows)) >= share * sizes - 1e-9
    if not enough.all():
        rows, sizes = rows[enough], sizes[enough]
        if len(rows) < 2:
            return left, right
        row, starts, times = by_value([sets[k] for k in rows])
    counts = shared_counts(len(rows), row, starts, times)
    part = own[rows] if (own != own[0]).any() else np.arange(len(rows))
    rest = np.ones(len(rows), bool)
    for first in range(len(rows)):
        if not rest[first]:
            continue
        rest[first] = False
        queue = [first]
        while queue:
            x = queue.pop()
            other = np.flatnonzero(rest & (part != part[x]))
            most = np.maximum(sizes[other], sizes[x])
            # of sets that were cut the least hashes of the union tell, which hold share * LEAST_HASHES common ones at least
            every = np.where(most < LEAST_HASHES, sizes[other] + sizes[x] - counts[x, other], LEAST_HASHES)
            good = (counts[x, other] > 0) & (counts[x, other] >= share * every - 1e-9)
            other, cut = other[good], (most >= LEAST_HASHES)[good]
            if cut.any():
                other = other[[not c or similar(sets[rows[x]], sets[rows[y]], share) for y, c in zip(other, cut, strict=True)]]
            rest[other] = False
            queue += other.tolist()
            left += [int(rows[x])] * len(other)
            right += rows[other].tolist()
    return left, right


def near_pairs(groups: DataFrame, share: float = NEAR_SHARE, part_sets: int | None = None) -> DataFrame:
    """Pairs (a, b) of ids that connect what is connected, within a group, by five-word shingles with a Jaccard similarity of `share` or more. groups: id, group and shingles.

    Each two parts of a group meet in a task, which finds its sets' similarities by counts of what they share and gives a
    forest: neither rows nor pairs are made for what is compared and not linked.
    """
    part_sets = part_sets or PART_SETS

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for table in runs(batches, ["group", "part"]):
            if table.num_rows > 1:
                ids = table.column("id").to_numpy()
                x, y = set_links([np.frombuffer(v.as_buffer(), np.uint32) for v in table.column("shingles")], table.column("own").to_numpy(), share)
                a += ids[x].tolist()
                b += ids[y].tolist()
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    sizes = groups.groupBy("group").count().where(F.col("count") > part_sets)
    large = written(sizes.select("group", F.ceil(F.col("count") / part_sets).cast("int").alias("cuts")), "large-groups")
    dealt = in_parts(groups, large, "group").repartition(partitions_for(groups.sparkSession), "group", "part").sortWithinPartitions("group", "part")
    return dealt.mapInArrow(tidied(decide), "a long, b long")


SIGNS = ["s0", "s1", "s2", "s3"]


def near_links(classes: DataFrame, sets: Callable[[DataFrame], DataFrame], threshold: int, most_bits: int, share: float = NEAR_SHARE) -> DataFrame:
    """(node, root) of the classes that are connected by pairs with `share` of their shingles within a group of candidates.

    Candidates meet at an anchor or a band and have similar signs; a group is what they connect. All of a group's pairs are
    decided, in tasks that have its shingles, so that nothing is made for a pair that is none, however large a group.
    """
    met = components(links(classes, ["w0"], SIGNS, threshold, most_bits, bands="bands"), again=True, part_edges=PART_EDGES)
    groups = written(sets(met.select(F.col("node").alias("id"), F.col("root").alias("group"))), "shingles")
    return components(near_pairs(groups, share), again=True, part_edges=PART_EDGES)


def drop_near_copies(docs: DataFrame, threshold: int = 1, most_bits: int = MOST_SIGN_BITS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, with its columns, with one document of each group of near copies: that of the least id.

    Ids are longs. Documents link if their different five-word shingles have a Jaccard similarity of NEAR_SHARE or
    more and candidates connect them: their signs differ in most_bits bits or fewer, and their words meet at an anchor or
    one of their bands is equal; groups are what links connect. Texts without words are copies of each other. A row
    is a document, so an id's different texts are decided each on its own; of rows that repeat id and text one is kept,
    as they are copies. Rows with a null id are all kept. An empty table stays empty.
    """
    names = ["w0", *SIGNS, "digest"]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [near_prints(t) for t in batch.column("text").to_pylist()]
            prints = np.array([m[0] for m in made], np.uint64).reshape(-1, len(names)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("hash"), *(pa.array(prints[:, k]) for k in range(len(names))), pa.array([m[1] for m in made], pa.list_(pa.int64()))], names=["doc_id", "hash", *names, "bands"])

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("group"), pa.array([shingle_set(t).tobytes() for t in batch.column("text").to_pylist()], pa.binary())], names=["id", "group", "shingles"])

    row_hash = F.xxhash64(F.col(text))
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), row_hash.alias("hash"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    marked = rows.mapInArrow(tidied(mark), f"doc_id long, hash long, {' long, '.join(names)} long, bands array<long>")
    least = F.min(F.struct("doc_id", "hash"))
    grouped = marked.groupBy(*names).agg(least.alias("first"), F.first("bands").alias("bands"))  # equal digests have equal bands
    classes = written(grouped.select(F.monotonically_increasing_id().alias("id"), *names, "bands", "first"), "classes")

    def sets(ids: DataFrame) -> DataFrame:
        named = classes.join(ids.hint("merge"), "id").select("id", "group", "first.doc_id", "first.hash")
        texts = rows.join(named.hint("merge"), ["doc_id", "hash"]).select("id", "group", "text")
        return texts.mapInArrow(tidied(sketch), "id long, group long, shingles binary").dropDuplicates(["id"])

    roots = near_links(classes, sets, threshold, most_bits).withColumnRenamed("node", "id")
    grouped = classes.select("id", "first").join(roots.hint("merge"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    kept = written(grouped.groupBy("root").agg(F.min("first").alias("first")).select("first.doc_id", "first.hash"), "kept")
    # the ids grow with the documents, so they are never broadcast
    held = docs.join(kept.select(F.col("doc_id").alias("kept_id"), F.col("hash").alias("kept_hash")).hint("merge"), (docs[key].cast("long") == F.col("kept_id")) & (row_hash == F.col("kept_hash")))
    return held.dropDuplicates(["kept_id", "kept_hash"]).select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' fingerprints and components."""
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
