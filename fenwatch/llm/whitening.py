"""Whitening of embeddings by LOBPCG.

The covariance is never formed: each round multiplies it by a block of a few directions, as a Spark job over the centred
rows that returns one sum per dimension and direction. Rayleigh-Ritz over the iterate, its residual and the previous
direction gives the next iterate; rounds go on until the residuals of the wanted components, taken from a new product,
are certified. Only blocks of (dimensions x a few) reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwatch.llm.common import tidied, written

COMPONENTS = 4
#: Directions that are carried beside the wanted ones, which speeds up those of close eigenvalues.
GUARD = 12
#: Residuals are certified at this part of the largest eigenvalue; past LOOSE, rounds also end once they no longer fall.
TOLERANCE, LOOSE, STALLED, MOST_ROUNDS = 2e-15, 1e-11, 4, 500
#: Eigenvalues below this part of the largest are rounding.
RANK = 1e-12
SEED = 12


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the columns have beside another orthonormal basis; dependent columns go."""
    scale = np.linalg.norm(block, axis=0)
    block = block[:, scale > 0] / scale[scale > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
    u, s, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, s > 1e-10]
    u = u - against @ (against.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def lobpcg(product: Callable[[np.ndarray], np.ndarray], size: int, wanted: int, guard: int = GUARD) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and unit eigenvectors of a symmetric operator that is given by its products with blocks."""
    wanted = min(wanted, size)
    m = min(size, wanted + guard)
    x = np.linalg.qr(np.random.default_rng(SEED).normal(size=(size, m)))[0]
    ax = product(x)
    before = np.zeros((size, 0))
    least, stalled = np.inf, 0
    for _ in range(MOST_ROUNDS):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        residual = ax - x * values
        top = max(float(np.abs(values).max()), 1e-300)
        worst = float(np.linalg.norm(residual[:, :wanted], axis=0).max()) / top
        stalled = 0 if worst < 0.5 * least else stalled + 1
        least = min(least, worst)
        if worst <= TOLERANCE or (worst <= LOOSE and stalled >= STALLED) or m == size:
            return values[:wanted], x[:, :wanted]
        more = orthonormal(np.hstack([residual, before]), x)
        if not more.shape[1]:
            return values[:wanted], x[:, :wanted]
        basis = np.linalg.qr(np.hstack([x, more]))[0]
        # a new product of the whole basis: sums of old ones would drift from what the rows give
        images = product(basis)
        _, ritz = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
        ritz = ritz[:, ::-1][:, :m]
        new = basis @ ritz
        before = new - x @ (x.T @ new)
        x, ax = new, images @ ritz
    raise RuntimeError(f"residuals stay at {least:.2g} of the largest eigenvalue")


def longs(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, size)


def block_sum(fit: DataFrame, f: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], size: int) -> np.ndarray:
    """The sum over all rows of what f makes of blocks of them: partial sums of tasks are added by Spark, entry by entry."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                x = longs(batch.column("x").slice(k, 4096), size)
                total = f(x) if total is None else total + f(x)
        if total is not None:
            i, j = (v.ravel().astype(np.int32) for v in np.indices(shape))
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(np.asarray(total, np.float64).ravel())], names=["i", "j", "v"])

    out = np.zeros(shape)
    for i, j, v in fit.select("x").mapInArrow(tidied(partial), "i int, j int, v double").groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = v
    return out


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error of each row and component.

    Entries become floor(scale * entry); the fit takes each different vector once. Rows whose vector is null, empty, or
    holds null or non-finite entries are dropped, and those of another length than the most frequent one (the greatest
    of equally frequent ones), as they have no covariance with the others. There are as many components as the
    covariance has rank, `components` at most: none for one vector or equal ones, and then no row. Rows with a null id
    and repeated rows are kept. A deviation beyond 64 bits is null. Other columns are ignored; an empty table gives no row.
    """
    kept = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)) & (F.size("v") > 0)
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where(kept)
    rows = rows.select("vec_id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))
    fit = written(rows.select("x").distinct(), "fit")
    lengths = fit.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    schema = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if lengths is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size, n = lengths["size"], lengths["count"]
    fit = fit.where(F.size("x") == size)
    entry = fit.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("s"), F.min("x").alias("least"), F.max("x").alias("most"))
    facts = sorted(entry.collect(), key=lambda r: r["i"])
    sums = [int(r["s"]) for r in facts]
    mean = np.array([s / n for s in sums])
    farthest = sum(max(n * r["most"] - int(r["s"]), int(r["s"]) - n * r["least"]) ** 2 for r in facts)

    def product(block: np.ndarray) -> np.ndarray:
        def f(x: np.ndarray) -> np.ndarray:
            c = x - mean
            return c.T @ (c @ block)

        return block_sum(fit, f, block.shape, size) / n

    values, u = lobpcg(product, size, components)
    real = values > RANK * max(float(values[0]), 0.0)
    values, u = values[real], u[:, real]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    variance = block_sum(fit, lambda x: ((x - mean) ** 2).sum(0)[:, None], (size, 1), size)
    to_white = u / np.sqrt(values)

    def outer(x: np.ndarray) -> np.ndarray:
        w = (x - mean) @ to_white
        return w.T @ w

    explained = values / (float(variance.sum()) / n)
    error = float(np.abs(block_sum(fit, outer, (len(values), len(values)), size) / n - np.eye(len(values))).max())
    exact = np.array(sums, dtype=np.int64 if farthest < 1 << 63 else object)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                part = batch.slice(k, 4096)
                x = longs(part.column("x"), size)
                w = (x - mean) @ to_white
                off = ((x.astype(exact.dtype) * n - exact) ** 2).sum(1)
                deviation = pa.array([v if v < 1 << 63 else None for v in off.tolist()], pa.int64())
                for c in range(w.shape[1]):
                    same = lambda v, kind: pa.array(np.full(part.num_rows, v), kind)  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([part.column("vec_id"), same(c + 1, pa.int32()), same(n, pa.int64()), deviation, pa.array(w[:, c]), same(explained[c], pa.float64()), same(error, pa.float64())], names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.where(F.size("x") == size).mapInArrow(tidied(project), schema)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, on four components."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
