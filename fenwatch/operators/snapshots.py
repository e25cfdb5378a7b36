"""A corpus as snapshots: all tables change at once or not at all, every file is known by its SHA-256, and older snapshots stay readable.

A snapshot is a manifest under `manifests`, named by its version. It lists, for each table and source, the files under
`objects` that hold it; sources that a snapshot does not replace keep the files of the one before. Files are written
first and the manifest last, by a rename that fails where the version exists. So a writer that dies leaves only files
that no manifest names, and of two writers that began from one version the second is refused. The rename must be atomic,
as it is on HDFS and local disks.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fenwatch.operators.corpus import TABLES

#: Sources that one snapshot may replace: their names are in the manifest.
MOST_SOURCES = 10_000


class Conflict(ValueError):
    """Another writer has made this version."""


class Damaged(ValueError):
    """What is stored is not what the manifest names."""


class _Folder:
    """Files of a store that Spark's configuration can reach."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.top = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.top.getFileSystem(self.conf)
        self.top = self.fs.makeQualified(self.top)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(self.top, name)

    def names(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self.at(name))] if self.fs.exists(self.at(name)) else []

    def read(self, name: str) -> bytes:
        stream = self.fs.open(self.at(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def place(self, name: str, content: bytes) -> bool:
        """A new file of some content, all at once; False where one of that name exists."""
        draft = self.at(f"drafts/{uuid.uuid4().hex}")
        out = self.fs.create(draft, False)
        out.write(bytearray(content))
        out.close()
        self.fs.mkdirs(self.at(name).getParent())
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.top.toUri(), self.conf)
        try:
            context.rename(draft, self.at(name), self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName(rename.NONE.getClass().getName()), 0))
        except Exception as e:  # the cause tells a conflict from a failed store
            if self.fs.exists(self.at(name)):
                self.fs.delete(draft, False)
                return False
            raise e
        return True


def _sealed(body: dict) -> bytes:
    text = json.dumps(body, sort_keys=True)
    return json.dumps({"sha256": hashlib.sha256(text.encode()).hexdigest(), "body": text}).encode()


def _opened(content: bytes, name: str) -> dict:
    try:
        seal = json.loads(content)
        body = seal["body"]
        if hashlib.sha256(body.encode()).hexdigest() != seal["sha256"]:
            raise Damaged(f"{name} has been changed")
        return json.loads(body)
    except (ValueError, KeyError, TypeError) as e:
        raise e if isinstance(e, Damaged) else Damaged(f"{name} is no manifest") from e


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions of a corpus's snapshots, the oldest first."""
    return sorted(int(n.removesuffix(".json")) for n in _Folder(spark, path).names("manifests") if n.endswith(".json"))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, else of the latest; one that is missing or was changed is an error."""
    known = versions(spark, path)
    if not known or (version is not None and version not in known):
        raise FileNotFoundError(f"{path} has no snapshot" + (f" {version}" if known else ""))
    name = f"manifests/{known[-1] if version is None else version}.json"
    return _opened(_Folder(spark, path).read(name), name)


def _digests(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """path, bytes and sha256 of files, read by Spark's tasks."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths)).select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def save_snapshot(spark: SparkSession, tables: dict[str, DataFrame], path: str, after: int | None = None) -> int:
    """A new snapshot, and its version: tables with a source get the sources that are given, of the others all rows are replaced; what is not given stays.

    after: the version that the tables were made from (0: none), else the latest. If another one was made since, nothing
    changes and Conflict is raised. A source column is kept as it is; a null source is one of its own.
    """
    folder = _Folder(spark, path)
    known = versions(spark, path)
    before = known[-1] if known else 0
    if after is not None and after != before:
        raise Conflict(f"the snapshot is made after {after}, but {before} is the latest")
    body = manifest(spark, path, before) if before else {"tables": {}}
    run = uuid.uuid4().hex
    for name, df in tables.items():
        if name not in TABLES:
            raise ValueError(f"{name} is no table of a corpus")
        at = f"objects/{run}/{name}"
        own = "source" in df.columns and name != "sources"
        # an own layout column, so that the data keeps all of its columns
        laid = df.withColumn("_of", F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), F.hex(F.col("source").cast("string")))) if own else F.lit("n"))
        (laid.repartition("_of", F.pmod(F.xxhash64(*df.columns), F.lit(8))) if own else laid).write.partitionBy("_of").parquet(str(folder.at(at)))
        files = _digests(spark, [str(folder.at(at))]) if any(n.startswith("_of=") for n in folder.names(at)) else None
        found: dict[str, list] = {}
        for r in files.collect() if files is not None else []:
            found.setdefault(r["path"].rsplit("/", 2)[-2].removeprefix("_of="), []).append({"path": r["path"].rsplit(f"/objects/{run}/", 1)[-1], "bytes": r["bytes"], "sha256": r["sha256"]})
        if len(found) > MOST_SOURCES:
            raise ValueError(f"{name} has more than {MOST_SOURCES} sources")
        kept = [p for p in body["tables"].get(name, {}).get("parts", []) if own and p["of"] not in found]
        schema = df.schema.jsonValue()
        if kept and T.StructType.fromJson(body["tables"][name]["schema"]).simpleString() != df.schema.simpleString():
            raise ValueError(f"{name} has other columns than the sources that stay")
        body["tables"][name] = {"schema": schema, "parts": kept + [{"of": of, "run": run, "files": sorted(fs, key=lambda f: f["path"])} for of, fs in sorted(found.items())]}
    body["version"], body["after"] = before + 1, before
    if not folder.place(f"manifests/{before + 1}.json", _sealed(body)):
        raise Conflict(f"another writer has made snapshot {before + 1}")
    return before + 1


def _files(body: dict, names: Iterable[str]) -> dict[str, dict]:
    return {f"objects/{p['run']}/{f['path']}": f for n in names for p in body["tables"][n]["parts"] for f in p["files"]}


def load_snapshot(spark: SparkSession, path: str, version: int | None = None, check: bool = True) -> dict[str, DataFrame]:
    """The tables of a version, else of the latest. With check, every file must be there with the digest that the manifest gives; a missing or changed one is Damaged."""
    folder, body = _Folder(spark, path), manifest(spark, path, version)
    if check:
        want = _files(body, body["tables"])
        there = {p: str(folder.at(p)) for p in want}
        gone = sorted(p for p, full in there.items() if not folder.fs.exists(folder.at(p)))
        if gone:
            raise Damaged(f"{len(gone)} files are missing, first {gone[0]}")
        if want:
            listed = spark.createDataFrame([(p, f["bytes"], f["sha256"]) for p, f in want.items()], "name string, bytes long, sha256 string")
            now = _digests(spark, there.values()).select(F.concat(F.lit("objects/"), F.substring_index("path", "/objects/", -1)).alias("name"), F.struct("bytes", "sha256").alias("now"))
            wrong = listed.join(now, "name", "left").where(~F.struct("bytes", "sha256").eqNullSafe(F.col("now"))).select("name").sort("name").limit(1).collect()
            if wrong:
                raise Damaged(f"{wrong[0]['name']} has been changed")
    out = {}
    for name, table in body["tables"].items():
        schema = T.StructType.fromJson(table["schema"])
        paths = [str(folder.at(p)) for p in _files(body, [name])]
        out[name] = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    return out
