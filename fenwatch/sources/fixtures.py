"""Recorded exchanges with what their decoding should give, one JSON document a file, and their replay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwatch.sources.decoders import decode_payloads

EXPECT = "struct<verdict:string,protocol:string,fields:map<string,string>,identity:map<string,string>,role:string>"
FIXTURE = f"id string, summary string, port int, transport string, response string, expect {EXPECT}"
KEYS = ["id", "summary", "port", "transport", "response", "expect"]


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """Fixtures of the JSON files under a path, bytes as binary. A file whose name is not its id, or with keys of another kind, is an error."""
    rows = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").text(path).select(F.regexp_extract("_metadata.file_path", r"([^/]+)\.json$", 1).alias("file"), "value")
    parsed = rows.select("file", F.from_json("value", FIXTURE).alias("f"), F.json_object_keys("value").alias("keys"))
    wrong = parsed.where((F.coalesce(F.col("f.id"), F.lit("")) != F.col("file")) | F.col("keys").isNull() | (F.size(F.array_except("keys", F.array(*map(F.lit, KEYS)))) > 0)).select("file").limit(20).collect()
    if wrong:
        raise ValueError(f"not a fixture by its name and keys: {', '.join(r['file'] for r in wrong)}")
    return parsed.select("f.*").withColumn("response", F.unhex(F.replace("response", F.lit(" "), F.lit(""))))


def replay(fixtures: DataFrame) -> DataFrame:
    """fixtures (id, port, response, expect) with what the decoders give, and whether it agrees in verdict, protocol, fields, identity and role."""
    got = decode_payloads(fixtures.select("id", "port", F.col("response").alias("payload")))
    sorted_map = lambda c: F.array_sort(F.map_entries(F.coalesce(c, F.create_map().cast("map<string,string>"))))
    both = fixtures.select("id", "expect").join(got, "id")
    same = F.col("verdict") == F.col("expect.verdict")
    for c in ("protocol", "role"):
        same = same & F.col(c).eqNullSafe(F.nullif(F.col(f"expect.{c}"), F.lit("")))
    for c in ("fields", "identity"):
        same = same & (sorted_map(F.col(c)) == sorted_map(F.col(f"expect.{c}")))
    return both.withColumn("agrees", same)
