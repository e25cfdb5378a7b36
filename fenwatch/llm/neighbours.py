"""Approximate nearest neighbours by the largest inner product, with multiprobe p-stable hashing.

Vectors are placed on a sphere, so that the largest inner product is the least distance: x goes to (x / M, sqrt(1 - |x|^2
/ M^2)) and a query q to (q / |q|, 0), where M is the largest norm of x's band; bands hold norms within a factor of two,
so no long vector makes the others look alike. A table has K functions floor((a.v + b) / w) with normal a; a bucket is
what shares all of them. A query visits its own bucket and those that differ by one step in some functions, ordered by
the sum of the squared distances to the borders that are crossed, which falls with the estimated success. Candidates of
all tables are merged, and ranked by the exact inner product.

How many buckets are visited is measured, not guessed: for a bounded sample of queries the true neighbours among all rows
are found in blocks, and the least number of probes that reaches the target recall is taken; if no number does, tables
with fewer functions are tried. Queries that found fewer candidates than they should return go on to all buckets.

Equal vectors are one node with the smallest ids that any result can hold. A bucket's members and its visitors are cut
into parts of bounded size, and each part of the one meets each of the other in a task of its own.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenwatch.llm.common import runs, split_join, tidied, written

SEED, TABLES = 11, 2
#: Width of a function's slots, in deviations of the projections; vectors that an average bucket is to hold.
WIDTH, BUCKET = 2.5, 2048
#: Members of a bucket, and visitors, that one task holds at a time.
PART = 2048
#: Share of the true neighbours that the sampled queries are to find, their number, and the vectors that set the widths.
RECALL, SAMPLED_QUERIES, SAMPLED_VECTORS = 0.96, 256, 4096
#: Functions of a table and buckets that a query visits in it at most; tables get coarser where these don't suffice.
MOST_FUNCTIONS, MOST_PROBES = 24, 2048


@cache
def probe_sets(k: int) -> np.ndarray:
    """Sets of border crossings in the order of their expected cost, as rows of a mask; the columns are a query's 2k borders from the nearest to the farthest, of which j and 2k - 1 - j are the two of one function."""
    if not k:
        return np.zeros((1, 0), dtype=bool)
    # expected squares of sorted distances to the nearer borders, and of the farther ones
    near = [(j + 1) * (j + 2) / (4 * (k + 1) * (k + 2)) for j in range(k)]
    cost = near + [1 - (j + 1) / (k + 1) + near[j] for j in reversed(range(k))]
    found, heap = [()], [(cost[0], (0,))]
    while heap and len(found) < MOST_PROBES:
        total, crossed = heapq.heappop(heap)
        if all(2 * k - 1 - j not in crossed for j in crossed):
            found.append(crossed)
        last = crossed[-1]
        if last + 1 < 2 * k:
            step = cost[last + 1]
            heapq.heappush(heap, (total - cost[last] + step, (*crossed[:-1], last + 1)))
            heapq.heappush(heap, (total + step, (*crossed, last + 1)))
    mask = np.zeros((len(found), 2 * k), dtype=bool)
    for row, crossed in enumerate(found):
        mask[row, list(crossed)] = True
    return mask


class Tables:
    """Hash tables of the vectors of one length and one band of norms."""

    def __init__(self, size: int, functions: int, most: float, tables: int) -> None:
        rng = np.random.default_rng([SEED, size])
        self.k, self.most, self.tables = functions, most, tables if functions else 1
        self.a = rng.normal(size=(tables, size + 1, MOST_FUNCTIONS))[:, :, :functions]
        self.shift = rng.random((tables, MOST_FUNCTIONS))[:, :functions]
        self.mix = rng.integers(1, 1 << 62, MOST_FUNCTIONS, np.int64)[:functions] * 2 + 1
        self.width = WIDTH

    def lifted(self, x: np.ndarray) -> np.ndarray:
        y = x / self.most
        return np.hstack([y, np.sqrt(np.maximum(0, 1 - (y * y).sum(1)))[:, None]])

    def fit(self, x: np.ndarray) -> None:
        """Widths by the spread of some vectors' projections."""
        spread = (self.lifted(x) @ self.a[0]).std() if len(x) and self.k else 0.0
        self.width = WIDTH * (float(spread) or 1.0)

    def slots(self, lifted: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
        at = lifted @ self.a[t] / self.width + self.shift[t]
        low = np.floor(at)
        return low.astype(np.int64), at - low

    def members(self, x: np.ndarray) -> np.ndarray:
        """Buckets of vectors by table."""
        v = self.lifted(x)
        return np.stack([self.slots(v, t)[0] @ self.mix for t in range(self.tables)], 1)

    def probes(self, x: np.ndarray, t: int, most: int) -> np.ndarray:
        """Buckets of a table that queries visit, those of the best estimated success first."""
        scale = np.abs(x).max(1)[:, None]
        q = x / scale
        q = np.hstack([q / np.linalg.norm(q, axis=1)[:, None], np.zeros((len(x), 1))])
        low, over = self.slots(q, t)
        sets = probe_sets(self.k)
        border = np.hstack([over, 1 - over])
        order = border.argsort(1, kind="stable")
        cost = np.take_along_axis(border, order, 1) ** 2 @ sets.T.astype(float)
        best = cost.argsort(1, kind="stable")[:, :most]
        step = np.take_along_axis(np.hstack([-self.mix, self.mix])[None].repeat(len(x), 0), order, 1)
        return (low @ self.mix)[:, None] + np.take_along_axis(step @ sets.T.astype(np.int64), best, 1)


class Index:
    """The tables by (length, band), and the probes of each length."""

    def __init__(self, facts: dict[tuple[int, int], tuple[int, float]], sample: pa.Table, tables: int) -> None:
        self.facts, self.sample, self.count = facts, sample, tables
        self.coarser = 0
        self.probes = {size: MOST_PROBES for size, _ in facts}
        self.build()

    def build(self) -> None:
        self.by: dict[tuple[int, int], Tables] = {}
        sizes, bands = (self.sample.column(c).to_numpy() for c in ("dim", "band"))
        for (size, band), (n, most) in self.facts.items():
            functions = round(math.log2(max(1, n / BUCKET))) if self.coarser < MOST_FUNCTIONS else 0
            functions = min(MOST_FUNCTIONS, max(1, functions)) >> self.coarser
            tables = Tables(size, functions, most, self.count)
            tables.fit(matrix(self.sample.filter(pa.array((sizes == size) & (bands == band))).column("x"), size))
            self.by[size, band] = tables

    def bands(self, size: int) -> list[int]:
        return sorted(b for s, b in self.by if s == size)

    @property
    def single(self) -> bool:
        return all(t.k == 0 for t in self.by.values())


def matrix(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(x.flatten(), dtype=np.float64).reshape(-1, size)


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, each summed in the same order whatever rows are beside it."""
    return np.concatenate([(x[k : k + 8192] * y[k : k + 8192]).sum(1) for k in range(0, len(x), 8192)]) if len(x) else np.zeros(0)


def best(x: np.ndarray, y: np.ndarray, most: int, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of y, row of x, inner product) that hold the `most` largest of each row of y that reach its bound, and all that tie with the last."""
    near = y @ x.T
    least = np.full(len(y), -np.inf) if bound is None else bound
    if len(x) > most:
        least = np.maximum(least, np.partition(near, len(x) - most, axis=1)[:, len(x) - most])
    slack = 1e-12 * np.linalg.norm(y, axis=1) * np.linalg.norm(x, axis=1).max()
    rows, columns = np.nonzero(~(near < (least - slack)[:, None]))
    return rows, columns, exact(y[rows], x[columns])


def by_keys(batch: pa.RecordBatch, *names: str) -> Iterator[tuple[tuple[int, ...], pa.RecordBatch]]:
    keys = np.stack([batch.column(c).to_numpy() for c in names], 1)
    for key in np.unique(keys, axis=0):
        yield tuple(key.tolist()), batch.filter(pa.array((keys == key).all(1)))


def usable_norm(x: Column) -> tuple[Column, Column]:
    """Whether a vector takes part (finite entries, not all of them zero), and its norm."""
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    squares = F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    top = F.array_max(F.transform(x, lambda v: F.abs(v.cast("double"))))
    scaled = top * F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v.cast("double") / top, 2.0)))
    norm = F.when((squares > 1e-200) & (squares < 1e300), F.sqrt(squares)).otherwise(scaled)  # squares of extreme entries leave the range of doubles
    return F.coalesce(whole & F.exists(x, lambda v: v != 0), F.lit(False)), norm


def nearest(vectors: DataFrame, is_query: Callable[[Column], Column], k: int = 20, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding", tables: int = TABLES, part: int = PART) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows of the largest inner product found for each query, ties to the smaller id; all other rows, if there are no more than k.

    Ids are longs, vectors arrays of floats; is_query tells queries by their id. Null, empty and zero vectors and those
    with null or non-finite components take no part, nor do rows with a null id; vectors of different lengths don't
    meet. Repeated rows of one id and vector are one candidate, and a query is no candidate of rows with its own id.
    Other columns are ignored; an empty table gives no row. Facts of the driver: a row per length and band of norms.
    """
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("x")).where("vec_id IS NOT NULL")
    usable, norm = usable_norm(F.col("x"))
    hashes = [F.xxhash64(F.lit(seed), "x").alias(f"hash_{seed}") for seed in (1, 2)]
    good = rows.where(usable)
    most = k + 1  # a query's own id may be among them
    # a hot vector keeps `most` ids in each task before anything is gathered
    first = good.groupBy("x", "vec_id").agg(F.lit(1).alias("one")).withColumn("r", F.row_number().over(Window.partitionBy("x").orderBy("vec_id"))).where(F.col("r") <= most)
    nodes = first.groupBy("x").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    band = F.floor(F.log2(norm) + 0.5).cast("int").alias("band")
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("id"), *hashes, F.size("x").alias("dim"), band, norm.alias("norm"), "x", "ids"), "vectors")
    facts = {(r["dim"], r["band"]): (r["n"], r["most"]) for r in nodes.groupBy("dim", "band").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).collect()}
    rows_of = {r["dim"]: r["n"] for r in nodes.groupBy("dim").agg(F.sum(F.size("ids")).alias("n")).collect()}
    asked_rows = good.where(is_query(F.col("vec_id"))).select("vec_id", *hashes).distinct()
    asked = written(asked_rows.groupBy("hash_1", "hash_2").agg(F.count(F.lit(1)).alias("n_rows")).join(nodes.drop("ids", "norm"), ["hash_1", "hash_2"]), "queries")
    total = asked.agg(F.sum("n_rows")).first()[0] or 0
    if not total:
        return rows.where("false").select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))

    sample = nodes.select("hash_1", "hash_2", "dim", "band", "x").orderBy("hash_1", "hash_2").limit(SAMPLED_VECTORS).toArrow()
    index = Index(facts, sample, tables)
    calibrate(index, nodes, asked, k, recall)
    first = {size: math.ceil(n ** (1 / 3)) for size, n in index.probes.items()}
    found = written(best_hits(meet(nodes, asked, index, most, part, {}, first), most), "first-hits")
    if any(first[size] < n for size, n in index.probes.items()):
        reached = found.select("id", F.when(F.size("hits") == most, F.element_at("hits", -1)["score"]).alias("bound"))
        later = meet(nodes, asked.join(reached, "id", "left"), index, most, part, first, index.probes)
        found = written(best_hits(later.unionByName(found.select("id", F.inline("hits"))), most), "hits")
    left = F.coalesce(*(F.when(F.col("dim") == size, F.lit(min(most, n))) for size, n in rows_of.items())) if len(rows_of) <= 64 else F.lit(most)
    if not index.single:
        few = written(asked.join(found.select("id", F.size("hits").alias("n_hits")), "id", "left").where(F.coalesce("n_hits", F.lit(0)) < left).drop("n_hits"), "few")
        if not few.isEmpty():
            whole = Index(facts, sample, 1)
            whole.coarser = MOST_FUNCTIONS
            whole.build()
            found = found.join(few.select("id"), "id", "left_anti").unionByName(best_hits(meet(nodes, few, whole, most, part, {}, {}), most))
    named = written(found.join(asked.select("id", "hash_1", "hash_2", "n_rows"), "id").drop("id"), "named")
    out = split_join(asked_rows, named, ["hash_1", "hash_2"], "n_rows", total)
    others = F.slice(F.filter("hits", lambda h: h["vec_id"] != F.col("vec_id")), 1, k)
    return out.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")


def calibrate(index: Index, nodes: DataFrame, asked: DataFrame, k: int, recall: float) -> None:
    """Sets the probes of each length to the least number by which the sampled queries find the target share of their true neighbours; tables get coarser until there is one. A coarsest table is one bucket, which misses nothing."""
    chosen = asked.select("hash_1", "hash_2", "id", "dim", "x").orderBy("hash_1", "hash_2").limit(SAMPLED_QUERIES).toArrow()
    own = {size: chosen.filter(pa.array(chosen.column("dim").to_numpy() == size)) for size in np.unique(chosen.column("dim").to_numpy()).tolist()}

    def ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        visited: dict[tuple[int, int, int], np.ndarray] = {}
        for batch in batches:
            for (size, band), part in by_keys(batch, "dim", "band"):
                if size not in own:
                    continue
                y, ids = matrix(own[size].column("x"), size), own[size].column("id").to_numpy()
                tables = index.by[size, band]
                for b in range(0, part.num_rows, 4096):
                    some = part.slice(b, 4096)
                    x = matrix(some.column("x"), size)
                    rows, columns, score = best(x, y, k + 1)
                    other = some.column("id").to_numpy()[columns] != ids[rows]
                    rows, columns, score = rows[other], columns[other], score[other]
                    buckets = tables.members(x)
                    rank = np.full(len(rows), MOST_PROBES)
                    for t in range(tables.tables):
                        if (size, band, t) not in visited:
                            visited[size, band, t] = tables.probes(y, t, MOST_PROBES)
                        held = visited[size, band, t]
                        for q in np.unique(rows).tolist():
                            at = rows == q
                            order = held[q].argsort()
                            place = np.minimum(np.searchsorted(held[q], buckets[columns[at], t], sorter=order), len(order) - 1)
                            met = held[q][order[place]] == buckets[columns[at], t]
                            rank[at] = np.minimum(rank[at], np.where(met, order[place], MOST_PROBES))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), size, np.int32)), pa.array(ids[rows]), pa.array(score), pa.array(rank.astype(np.int32))], names=["dim", "q", "score", "probe"])

    while True:
        near = nodes.select("id", "dim", "band", "x").mapInArrow(tidied(ranks), "dim int, q long, score double, probe int")
        near = near.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "probe"))).where(F.col("r") <= k)
        counts = near.groupBy("dim", "probe").count().collect()
        reached = True
        for size in own:
            at = np.zeros(MOST_PROBES + 1)
            for r in counts:
                if r["dim"] == size:
                    at[r["probe"]] += r["count"]
            share = np.cumsum(at)[:MOST_PROBES] / max(1, at.sum())
            enough = np.flatnonzero(share >= recall)
            index.probes[size] = int(enough[0]) + 1 if len(enough) else MOST_PROBES
            reached &= bool(len(enough)) or not at.sum()
        if reached or index.single:
            return
        index.coarser += 1
        index.build()


def best_hits(found: DataFrame, most: int) -> DataFrame:
    """id of each query that met a candidate, and its `most` best hits (score, vec_id) in order; what was met several times counts once."""
    ordered = found.withColumn("r", F.dense_rank().over(Window.partitionBy("id").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= most)
    lists = ordered.groupBy("id").agg(F.sort_array(F.collect_set(F.struct("r", "vec_id", "score"))).alias("hits"))
    return lists.select("id", F.transform("hits", lambda h: F.struct(h["score"].alias("score"), h["vec_id"].alias("vec_id"))).alias("hits"))


def meet(nodes: DataFrame, asked: DataFrame, index: Index, most: int, part: int, begin: dict[int, int], end: dict[int, int]) -> DataFrame:
    """id, vec_id and score: for each query (with a `bound` or without) the `most` best candidates of the buckets from the begin-th to the end-th, by length, as far as they reach the bound."""
    kind = nodes.schema["x"].dataType.simpleString()
    if "bound" not in asked.columns:
        asked = asked.withColumn("bound", F.lit(None).cast("double"))
    sizes, known = index.sample.column("dim").to_numpy(), {}

    def bounds(x: np.ndarray, size: int, told: np.ndarray) -> np.ndarray:
        """What is told, or what the sampled vectors tell."""
        if size not in known:
            known[size] = matrix(index.sample.filter(pa.array(sizes == size)).column("x"), size)
        told = np.where(np.isnan(told), -np.inf, told)
        v = known[size]
        if len(v) < most:
            return told
        least = np.partition(x @ v.T, len(v) - most, axis=1)[:, len(v) - most]
        return np.maximum(told, least - 1e-12 * np.linalg.norm(x, axis=1) * np.linalg.norm(v, axis=1).max())

    def stay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (size, band), own in by_keys(batch, "dim", "band"):
                buckets = index.by[size, band].members(matrix(own.column("x"), size))
                for t in range(buckets.shape[1]):
                    yield own.append_column("tab", pa.array(np.full(own.num_rows, t, np.int32))).append_column("bucket", pa.array(buckets[:, t]))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (size,), own in by_keys(batch, "dim"):
                for b in range(0, own.num_rows, 256):
                    some = own.slice(b, 256)
                    x = matrix(some.column("x"), size)
                    bound = bounds(x, size, some.column("bound").to_numpy(zero_copy_only=False))
                    for band in index.bands(size):
                        tables = index.by[size, band]
                        for t in range(tables.tables):
                            buckets = tables.probes(x, t, end.get(size, MOST_PROBES))[:, begin.get(size, 0) :]
                            for at in range(0, buckets.shape[1], 64):
                                step = buckets[:, at : at + 64]
                                at_row = np.repeat(np.arange(len(x)), step.shape[1])
                                out = some.take(pa.array(at_row))
                                n = out.num_rows
                                yield pa.RecordBatch.from_arrays([out.column("id"), out.column("dim"), pa.array(np.full(n, band, np.int32)), out.column("x"), pa.array(np.full(n, t, np.int32)), pa.array(step.ravel()), pa.array(bound[at_row])], names=["id", "dim", "band", "x", "tab", "bucket", "bound"])

    held = nodes.select("id", "dim", "band", "x", "ids").mapInArrow(tidied(stay), f"id long, dim int, band int, x {kind}, ids array<long>, tab int, bucket long")
    visits = asked.select("id", "dim", "x", "bound").mapInArrow(tidied(visit), f"id long, dim int, band int, x {kind}, tab int, bucket long, bound double")
    place = ["dim", "band", "tab", "bucket"]
    cut = lambda name: F.ceil(F.count(F.lit(1)) / part).cast("int").alias(name)
    full = written(held.select(*place).groupBy(*place).agg(cut("parts")), "buckets")
    crowd = written(visits.select(*place).groupBy(*place).agg(cut("crowds")).join(full, place), "crowds")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    stays = held.join(crowd, place).withColumn("a", own("parts", 1)).withColumn("b", each("crowds")).withColumn("side", F.lit(0)).withColumn("bound", F.lit(None).cast("double"))
    comes = visits.join(crowd, place).withColumn("b", own("crowds", 2)).withColumn("a", each("parts")).withColumn("side", F.lit(1)).withColumn("ids", F.lit(None).cast("array<long>"))
    keys = [*place, "a", "b"]
    columns = [*keys, "side", "id", "x", "ids", "bound"]
    met = stays.select(*columns).unionByName(comes.select(*columns)).repartition(*keys).sortWithinPartitions(*keys, "side", "id")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            side, size = t.column("side").to_numpy(), t.column("dim")[0].as_py()
            start = int(np.searchsorted(side, 1))
            if start in (0, t.num_rows):
                continue
            x, y = matrix(t.slice(0, start).column("x"), size), matrix(t.slice(start).column("x"), size)
            ids = t.slice(0, start).column("ids").combine_chunks()
            begins = ids.offsets.to_numpy()
            flat, begins = ids.flatten().to_numpy(), begins - begins[0]
            asking, bound = t.column("id").to_numpy()[start:], t.column("bound").to_numpy()[start:]
            for b in range(0, len(y), 512):
                rows, columns, score = best(x, y[b : b + 512], most, bound[b : b + 512])
                if not len(rows):
                    continue
                counts = np.diff(begins)[columns]
                ends = np.cumsum(counts)
                place_of = np.repeat(begins[:-1][columns] - ends + counts, counts) + np.arange(ends[-1])
                q, v, s = np.repeat(rows, counts), flat[place_of], np.repeat(score, counts)
                order = np.lexsort((v, -s, q))
                q, v, s = q[order], v[order], s[order]
                new = np.concatenate([[True], q[1:] != q[:-1]])
                nth = np.arange(len(q)) - np.maximum.accumulate(np.where(new, np.arange(len(q)), 0))
                keep = nth < most
                yield pa.RecordBatch.from_arrays([pa.array(asking[b + q[keep]]), pa.array(v[keep]), pa.array(s[keep])], names=["id", "vec_id", "score"])

    return met.mapInArrow(tidied(rank), "id long, vec_id long, score double")


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries with an id divisible by 20, against all embeddings."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
