"""What the operators of this package share: the shared folder, written tables, and grouped streams of Arrow batches."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: White space of the word rules, as a pattern for Java and RE2.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that the cluster shares (spark.checkpoint.dir); own folders only where that is unset."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        top = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.sparkContext.setCheckpointDir(top)
        spark.conf.set("spark.checkpoint.dir", top) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts lineage, survives lost executors, and is computed once."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def open_store(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI and the path in it; plain paths are local."""
    return pyarrow.fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def split_join(left: DataFrame, right: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """left with right (a row per key, of which left holds `n` rows, `total` in all) by key; no task holds a frequent key.

    Keys with over a thousandth of the rows, fewer than a thousand, are broadcast; the others are joined as usual.
    """
    frequent = right.where(F.col(n) * 1000 > total).drop(n)
    rare = right.where(F.col(n) * 1000 <= total).drop(n)
    return left.join(F.broadcast(frequent), key).unionByName(left.join(F.broadcast(frequent.select(key)), key, "left_anti").join(rare, key))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def tidied(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, after which a worker gives unused memory back: workers live on from stage to stage, and what each keeps adds up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (OSError, AttributeError):  # other C libraries have no such call
                pass

    return run


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of equal keys from batches that are sorted by them. Holds one group and one batch."""
    import numpy as np

    held: list[pa.Table] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        changed = np.zeros(table.num_rows, dtype=bool)
        for k in keys:
            v = table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
            changed[1:] |= v[1:] != v[:-1]
        if held and all(held[-1].column(k)[-1].as_py() == table.column(k)[0].as_py() for k in keys):
            pass
        elif held:
            yield pa.concat_tables(held)
            held = []
        cuts = [*np.flatnonzero(changed).tolist(), table.num_rows]
        at = 0
        for cut in cuts:
            held.append(table.slice(at, cut - at))
            if cut < table.num_rows:
                yield pa.concat_tables(held)
                held = []
            at = cut
    if held:
        yield pa.concat_tables(held)
