"""Embedding near-duplicates with an inverted multi-index.

Two codebooks, one for each half of the vectors, are fitted on a bounded sample; their product is a grid of cells.
Every vector is indexed in the cell of its halves' nearest centroids. As a query it visits cells by a multi-sequence
traversal: both halves' centroids are sorted by a lower bound of the distance from the query to any vector of their
region, and pairs are visited in the order of the sum of squares until the target recall. A neighbour at the threshold
cosine lies D = 2 - 2 * threshold away (squared); if its direction is random, the square of its way along two given
normals is D / dimensions times a chi-square of two degrees, so cells beyond -2 ln(1 - recall) D / dimensions hold it
with less than the missing probability. A target of 1 visits all cells within D, and then no pair can be missed.
The dimensions that count are those in which the vectors vary: the participation ratio of the covariance of the sample,
or of what is left of it beside the centroids, whichever is less. Vectors that meet are verified by the cosine in double
precision.

Equal vectors of a label are one node with a count, so copies are never paired. A cell's members and its visitors are
cut into parts of bounded size, and each part of the one meets each of the other in a task of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwatch.llm.common import runs, split_join, written
from fenwatch.llm.components import components

THRESHOLD, SEED = 0.93, 5
#: Vectors that the codebooks are fitted on at most, those of the smallest hashes; every vector is indexed.
SAMPLE = 16_384
#: Members of a cell, and visitors, that one task holds at a time.
PART = 2048
#: Of neighbours at the threshold cosine, the share that a traversal is to find from one side alone.
RECALL = 0.98
#: Lengths of vectors that have codebooks, the most frequent ones, and the different vectors that a length needs to have
#: them; all vectors of another length are one cell, whose parts all meet.
MOST_BOOKS, LEAST_VECTORS = 8, 64


def codebook(sample: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """k centroids of the rows by Lloyd's algorithm from seeded rows; fewer where there are fewer different rows."""
    different = np.unique(sample, axis=0)
    rng = np.random.default_rng(SEED)
    c = different[rng.permutation(len(different))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * sample @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, sample)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return np.unique(c, axis=0)


def lower_bounds(x: np.ndarray, c: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid of each row, and by centroid the squared distance from the row to the half-space of those nearer to it than to the nearest one."""
    d = (x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T
    near = d.argmin(1)
    over = (d - d[np.arange(len(x)), near][:, None]) / (2 * gaps[near])
    return near, np.where(gaps[near] == np.inf, 0.0, over * over)


def gaps_of(c: np.ndarray) -> np.ndarray:
    g = np.sqrt(np.maximum(((c[:, None] - c[None]) ** 2).sum(2), 0))
    np.fill_diagonal(g, np.inf)
    return g


def traverse(one: np.ndarray, two: np.ndarray, bound: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell of the first half, cell of the second) of all cells whose bounds add up to `bound` at most: both halves are sorted, and a row goes on while its next pair is within the bound."""
    by_one, by_two = one.argsort(1, kind="stable"), two.argsort(1, kind="stable")
    a, b = np.take_along_axis(one, by_one, 1), np.take_along_axis(two, by_two, 1)
    rows, i, j = [], [], []
    for p in range(a.shape[1]):
        live = np.flatnonzero(a[:, p] + b[:, 0] <= bound)
        if not len(live):
            break
        for q in range(b.shape[1]):
            live = live[a[live, p] + b[live, q] <= bound]
            if not len(live):
                break
            rows.append(live)
            i.append(by_one[live, p])
            j.append(by_two[live, q])
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, i, j))


def dimensions(x: np.ndarray) -> float:
    """The participation ratio of the rows' covariance: how many independent directions of equal spread they have."""
    c = np.cov(x, rowvar=False)
    return float(np.trace(c) ** 2 / max((c * c).sum(), 1e-300)) if c.ndim else 1.0


class Grid:
    """Codebooks of vectors of one length, and the bound of the traversal; without a sample, a single cell."""

    def __init__(self, size: int, threshold: float, recall: float, sample: np.ndarray | None = None, total: int = 0) -> None:
        self.size, self.half = size, size // 2
        if sample is None or size < 2:
            self.books = None
            self.bound = self.width = 1
            return
        k = int(min(1024, max(4, 2 ** round(math.log2(math.sqrt(total / 128))))))
        self.books = [codebook(sample[:, : self.half], k), codebook(sample[:, self.half :], k)]
        self.gaps = [gaps_of(c) for c in self.books]
        self.width = len(self.books[1])
        far = 2 - 2 * threshold
        rest = np.hstack([h - c[lower_bounds(h, c, g)[0]] for h, c, g in zip(self.halves(sample), self.books, self.gaps, strict=True)])
        count = max(1.0, min(dimensions(sample), dimensions(rest)))
        self.bound = far if recall >= 1 else min(far, -2 * math.log(1 - recall) * far / count)

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def placed(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells of unit vectors, and the lower bounds of both halves by centroid."""
        if self.books is None:
            return np.zeros(len(x), np.int64), np.zeros((len(x), 1)), np.zeros((len(x), 1))
        (p, one), (q, two) = (lower_bounds(h, c, g) for h, c, g in zip(self.halves(x), self.books, self.gaps, strict=True))
        return p * self.width + q, one, two


def units(column: pa.Array | pa.ChunkedArray, size: int) -> np.ndarray:
    x = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = np.asarray(x.flatten(), dtype=np.float64).reshape(-1, size)
    return x / np.linalg.norm(x, axis=1)[:, None]


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, key: str = "vec_id", vector: str = "embedding", label: str = "label", part: int = PART) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row, by links between rows of one label with a cosine of the threshold or more.

    Ids are longs, vectors arrays of floats; only vectors of one length have a cosine, so those of different lengths
    never link. Null, empty and zero vectors, vectors with null or non-finite components, and null labels link with
    nothing; their component is their own id. Rows with a null id are left out of the components of others, but are
    counted as links; their own component is the one of what they link to. Repeated rows are vectors of their own.
    Other columns are ignored; an empty table gives no row. Links found from either side count for both.
    """
    kind = "array<float>" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "array<double>"
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("x"), F.col(label).cast("string").alias("label"))
    # the sum of squares is finite and positive exactly for usable vectors, but for overflow, which no cosine survives either
    norm = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    usable = F.col("x").isNotNull() & F.col("label").isNotNull() & F.coalesce((norm > 0) & (norm < float("inf")), F.lit(False))
    marked = rows.withColumn("usable", usable)
    good = marked.where("usable").groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("n"))
    # one node per label and vector; rows find theirs by two hashes with different seeds, and nodes differ by their ids
    hashes = [F.xxhash64(F.lit(seed), "label", "x").alias(f"hash_{seed}") for seed in (1, 2)]
    nodes = written(good.select(F.monotonically_increasing_id().alias("id"), *hashes, "label", "x", F.size("x").alias("dim"), "least", "n"), "nodes")
    lengths = {r["dim"]: r["count"] for r in nodes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(MOST_BOOKS).collect()}
    total_nodes = nodes.count()
    if not total_nodes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    grids: dict[int, Grid] = {}
    for size, total in lengths.items():
        if total >= LEAST_VECTORS:
            sample = nodes.where(F.col("dim") == size).select("hash_1", "hash_2", "x").orderBy("hash_1", "hash_2").limit(SAMPLE).toArrow()
            grids[size] = Grid(size, threshold, recall, units(sample.column("x"), size), total)

    def grid(size: int) -> Grid:
        if size not in grids:
            grids[size] = Grid(size, threshold, recall)
        return grids[size]

    def by_length(batch: pa.RecordBatch) -> Iterator[tuple[Grid, pa.RecordBatch]]:
        sizes = batch.column("dim").to_numpy()
        for size in np.unique(sizes).tolist():
            yield grid(size), batch.filter(pa.array(sizes == size))

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, own in by_length(batch):
                yield own.append_column("cell", pa.array(g.placed(units(own.column("x"), g.size))[0].astype(np.int32)))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in range(0, batch.num_rows, 1024):
                for g, own in by_length(batch.slice(b, 1024)):
                    _, one, two = g.placed(units(own.column("x"), g.size))
                    at, i, j = traverse(one, two, g.bound)
                    yield own.take(pa.array(at)).append_column("visited", pa.array((i * g.width + j).astype(np.int32)))

    base = f"id long, label string, dim int, x {kind}, n long, cell int"
    indexed = written(nodes.select("id", "label", "dim", "x", "n").mapInArrow(home, base), "index")
    visits = indexed.mapInArrow(visit, f"{base}, visited int")
    # cells with members, and in how many parts they are cut; as many rows as there are cells in use, and labels
    place = ["label", "dim", "visited"]
    cells = written(indexed.groupBy("label", "dim", F.col("cell").alias("visited")).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")), "cells")
    crowd = written(visits.select(*place).groupBy(*place).agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("crowds")).join(cells, place), "crowds")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    asked = visits.join(crowd, place).withColumn("b", own("crowds", 2)).withColumn("a", each("parts")).withColumn("side", F.lit(1))
    held = indexed.withColumn("visited", F.col("cell")).join(crowd, place).withColumn("a", own("parts", 1)).withColumn("b", each("crowds")).withColumn("side", F.lit(0))
    columns = [*place, "a", "b", "side", "id", "x", "n", "cell"]
    keys = [*place, "a", "b"]
    met = held.select(*columns).unionByName(asked.select(*columns)).repartition(*keys).sortWithinPartitions(*keys, "side", "id")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, keys):
            side = t.column("side").to_numpy()
            cut = int(np.searchsorted(side, 1))
            if cut == 0 or cut == t.num_rows:
                continue
            g = grid(t.column("dim")[0].as_py())
            x, y = units(t.slice(0, cut).column("x"), g.size), units(t.slice(cut).column("x"), g.size)
            ids, n = (t.column(c).to_numpy()[:cut] for c in ("id", "n"))
            ids_y, n_y, cell_y = (t.column(c).to_numpy()[cut:] for c in ("id", "n", "cell"))
            good = (x @ y.T >= threshold) & (ids[:, None] != ids_y[None])
            if not good.any():
                continue
            # a pair that only the visitor finds counts for the member too
            mine = np.flatnonzero(good.any(1))
            _, one, two = g.placed(x[mine])
            back = np.zeros((len(x), len(y)), dtype=bool)
            back[mine] = one[:, cell_y // g.width] + two[:, cell_y % g.width] <= g.bound
            lone = good & ~back
            out_id, out_n = [ids_y, ids], [(good * n[:, None]).sum(0), (lone * n_y[None]).sum(1)]
            e_a, e_b = joined(good, ids, ids_y)
            counts_id, counts_n = np.concatenate(out_id), np.concatenate(out_n).astype(np.int64)
            keep = counts_n > 0
            null = np.zeros(keep.sum(), dtype=bool)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([counts_id[keep], e_a])), pa.array(np.concatenate([counts_n[keep], np.zeros(len(e_a), np.int64)])), pa.array(np.concatenate([np.zeros(len(null), np.int64), e_b]), mask=np.concatenate([~null, np.zeros(len(e_a), bool)]))], names=["a", "n", "b"])

    found = written(met.mapInArrow(verify, "a long, n long, b long"), "links")
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_found"))
    roots = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "id")
    facts = nodes.select("id", "hash_1", "hash_2", "least", "n").join(roots, "id", "left").join(counts, "id", "left")
    facts = written(facts.withColumn("root", F.coalesce("root", "id")).withColumn("n_links", F.coalesce("n_found", F.lit(0)) + F.col("n") - 1).drop("n_found", "id"), "facts")
    named = written(facts.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n_nodes")), "components")
    facts = split_join(facts, named, "root", "n_nodes", total_nodes).select("hash_1", "hash_2", "component_id", "n_links")
    keyed = marked.select("vec_id", *(F.when(F.col("usable"), h).otherwise(F.xxhash64("vec_id")).alias(f"hash_{k}") for k, h in enumerate(hashes, 1)), "usable")
    # rows that link with nothing go by their id's hash, so that they don't meet in one task
    out = keyed.join(facts.withColumn("usable", F.lit(True)), ["hash_1", "hash_2", "usable"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def joined(good: np.ndarray, ids: np.ndarray, ids_y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the components of all pairs, by search over the rows and columns of the matrix."""
    left, right = np.flatnonzero(good.any(1)), good.any(0)
    rest_x, rest_y = np.zeros(len(ids), bool), right.copy()
    rest_x[left] = True
    a, b = [], []
    for start in left.tolist():
        if not rest_x[start]:
            continue
        rest_x[start] = False
        new_x = np.array([start])
        while len(new_x):
            new_y = np.flatnonzero(good[new_x].any(0) & rest_y)
            rest_y[new_y] = False
            a.append(ids_y[new_y])
            new_x = np.flatnonzero(good[:, new_y].any(1) & rest_x) if len(new_y) else np.zeros(0, np.int64)
            rest_x[new_x] = False
            a.append(ids[new_x])
            b += [np.full(len(new_y), ids[start]), np.full(len(new_x), ids[start])]
    return np.concatenate(a), np.concatenate(b)


def op6_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
u AS (SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND coalesce(list_bool_and(list_transform(x, lambda c: c IS NOT NULL AND isfinite(c))), false) AND list_inner_product(x, x) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.x, b.x) >= 0.93),
r AS (SELECT a AS s, a AS t FROM l UNION SELECT r.s, l.b FROM r JOIN l ON r.t = l.a),
c AS (SELECT s AS vec_id, min(t) AS component_id FROM r GROUP BY s),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
