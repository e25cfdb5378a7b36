"""Large files by ranges: a distributed first pass makes an index of them, and Python data sources read what it lists, each range by any task.

An index is a Parquet table with a row per range (file, start, stop, and what a format needs to begin there). It lies in
the shared folder and can be kept: `spark.read.format("pcap").option("index", folder)` reads the same captures again
without a first pass. Without an index every file is one range.
"""

from __future__ import annotations

import dataclasses
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from fenwatch.plans.graph import shared_folder

#: Bytes of a range.
RANGE = 1 << 26


def file_ranges(spark: SparkSession, path: str, size: int = RANGE, glob: str | None = None) -> DataFrame:
    """Ranges (file, length, start, stop) of the files under a path, spread over as many partitions as there are ranges (10,000 at most); an empty file has none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    files = (files.option("pathGlobFilter", glob) if glob else files).load(path).select(F.col("path").alias("file"), "length")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    found = files.select("file", "length", starts.alias("start")).withColumn("stop", F.least(F.col("start") + size, "length"))
    return found.repartition(max(1, min(found.count(), 10_000)), "file", "start")


def indexed(ranges: DataFrame, sketched: Callable[[dict], dict], sketch: str, settled: Callable[[list[dict]], list[dict]], index: str) -> str:
    """The folder with an index: `sketched` looks at each range by itself, and `settled` puts a file's ranges, in order, right by one another. A file's sketches, a row per range, meet in one task."""
    kinds = {ddl: to_arrow_schema(StructType.fromDDL(ddl)) for ddl in (sketch, index)}

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([sketched(row)], schema=kinds[sketch])

    def settle(found: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(settled(found.sort_by("start").to_pylist()), schema=kinds[index])

    rows = ranges.mapInArrow(look, sketch).groupBy("file").applyInArrow(settle, index)
    top = f"{shared_folder(rows.sparkSession)}/index-{uuid.uuid4().hex}"
    rows.write.parquet(top)
    return top


def opened(file: str) -> pa.NativeFile:
    """A file that can be read from any place."""
    store, at = pyarrow.fs.FileSystem.from_uri(file)
    return store.open_input_file(at)


def files_under(path: str, endings: tuple[str, ...] = ()) -> list[str]:
    """Files under a path that are not empty, as names that `opened` takes."""
    store, at = pyarrow.fs.FileSystem.from_uri(path)
    scheme = path.split(":", 1)[0] + ":" if ":" in path.split("/", 1)[0] else ""
    info = store.get_file_info(at)
    every = [info] if info.is_file else store.get_file_info(pyarrow.fs.FileSelector(at, recursive=True))
    name = lambda p: f"{scheme}//{p}" if scheme and not p.startswith("/") else f"{scheme}{p}"
    return [name(f.path) for f in every if f.is_file and f.size and (not endings or f.path.endswith(endings))]


@dataclasses.dataclass
class Group(InputPartition):
    """Ranges that one task reads."""

    rows: list[dict]

    def __init__(self, rows: list[dict]) -> None:
        super().__init__(None)
        self.rows = rows


class RangeReader(DataSourceReader):
    """Reads the ranges of an index: those that the options rule out are never opened, small ones share a task, and only the columns of a given schema are made.

    Filters are options of the reader rather than pushFilters: Spark 4.1 keeps what was pushed with the relation, so that
    another query over the same DataFrame, without the filter, would lack rows.
    """

    #: The whole shape of the format's rows, in Arrow.
    shape: pa.Schema
    endings: tuple[str, ...] = ()

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.names, self.options = schema.fieldNames(), dict(options)
        self.size = int(options.get("range", RANGE))

    def may_hold(self, row: dict) -> bool:
        """Whether a range can have rows that the options ask for."""
        return self.options.get("file") in (None, row["file"])

    def partitions(self) -> list[InputPartition]:
        if "index" in self.options:
            store, at = pyarrow.fs.FileSystem.from_uri(self.options["index"])
            rows = pyarrow.dataset.dataset(at, filesystem=store, format="parquet").to_table().to_pylist()
        else:
            rows = [{"file": f, "start": None, "stop": None} for f in files_under(self.options["path"], self.endings)]
        groups, room = [Group([])], 0
        for row in rows:
            if not self.may_hold(row):
                continue
            size = self.size if row["stop"] is None else row["stop"] - row["start"]
            if groups[-1].rows and size > room:
                groups.append(Group([]))
            room = (room if groups[-1].rows else self.size) - size
            groups[-1].rows.append(row)
        return groups

    def rows(self, row: dict) -> Iterator[list[dict]]:
        """The rows of one range, in lists of bounded size."""
        raise NotImplementedError

    def read(self, partition: Group) -> Iterator[pa.RecordBatch]:
        asked = pa.schema([self.shape.field(n) for n in self.names])
        for row in partition.rows:
            for found in self.rows(row):
                yield pa.RecordBatch.from_pylist(found, schema=asked)
