"""URL filters: a Bloom filter cascade with exact membership over the corpus's keys. DataFrame functions only, no join with the pages.

A key is a host suffix followed by a path prefix. The first filter encodes the listed keys; the second encodes those
keys of the corpus's universe that wrongly pass the first; the third those listed keys that wrongly pass the second,
and so on until none passes wrongly. A key of the universe is listed exactly if the first filter that lacks it has an
even number. The first filter's rate follows the size of the universe, so all filters together stay in proportion to
the list, and only they go to the executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fenwatch.llm.common import lower_ascii, written


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def candidate_keys(host: Column, path: Column, rules: list[Rule]) -> Column:
    """The keys of a URL that a rule could have, longest first, of equal length that with more host first.

    Only numbers of labels and lengths of paths that some rule has are tried, each at most once.
    """
    labels = F.split(host, r"\.")
    made = []
    for n in sorted({r.host.count(".") + 1 for r in rules}):
        suffix = F.when(F.size(labels) >= n, F.array_join(F.slice(labels, -n, n), "."))
        for m in sorted({len(r.path) for r in rules}):
            made.append(F.struct((-F.length(suffix) - m).alias("a"), (-F.length(suffix)).alias("b"), F.when(F.length(path) >= m, F.concat(suffix, F.substring(path, 1, m))).alias("key")))
    return F.transform(F.array_sort(F.filter(F.array(*made), lambda x: x["key"].isNotNull())), lambda x: x["key"])


@dataclass(frozen=True)
class Bloom:
    """size bits in words of 64, probed `probes` times with the hashes of its level."""

    level: int
    size: int
    probes: int
    words: tuple[int, ...]

    @staticmethod
    def positions(key: Column, level: int, size: int, probes: int) -> list[Column]:
        m = F.lit(size).cast("long")
        a, b = F.pmod(F.xxhash64(key, F.lit(level)), m), F.pmod(F.xxhash64(F.lit(level), key), m)
        return [F.pmod(a + F.lit(i) * b + F.lit(i * i), m) for i in range(probes)]

    @classmethod
    def of(cls, keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
        size = max(64, -(-int(n * math.log(1 / rate) / math.log(2) ** 2) // 64) * 64)
        probes = max(1, round(math.log2(1 / rate)))
        at = keys.select(F.explode(F.array(*cls.positions(F.col("key"), level, size, probes))).alias("p"))
        words = at.groupBy(F.expr("p div 64").cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(p % 64 AS int))")).alias("bits"))
        full = [0] * (size // 64)
        for r in words.collect():  # as many rows as the filter has words, whatever the corpus has
            full[r["w"]] = r["bits"]
        return cls(level, size, probes, tuple(full))

    def has(self, key: Column, bits: Column) -> Column:
        tests = [F.getbit(F.get(bits, F.shiftright(p, 6).cast("int")), (p % 64).cast("int")) == 1 for p in self.positions(key, self.level, self.size, self.probes)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


class Cascade:
    """Exact membership of the universe's keys in a list."""

    def __init__(self, name: str, levels: list[Bloom]) -> None:
        self.name, self.levels = name, levels

    @classmethod
    def build(cls, name: str, listed: DataFrame, universe: DataFrame, size: int, most: int = 64) -> Cascade:
        """listed, universe: columns key; universe may repeat keys and is read once; size: about how many different keys it has."""
        spark = listed.sparkSession
        inside = written(listed.select("key").distinct(), "listed")
        n = inside.count()
        levels: list[Bloom] = []
        outside = None
        while n and len(levels) < most:
            rate = min(0.5, max(n / max(size, 1), 1e-9) / math.sqrt(2)) if not levels else 0.5
            b = Bloom.of(inside if len(levels) % 2 == 0 else outside, n, rate, len(levels) + 1)
            levels.append(b)
            bits = spark.createDataFrame([(list(b.words),)], "bits array<bigint>").scalar()
            wrong = lambda df: df.withColumn("bits", bits).where(b.has(F.col("key"), F.col("bits"))).select("key")  # noqa: B023, E731
            if outside is None:
                outside = written(wrong(universe.select("key")).distinct().join(inside, "key", "left_anti"), "passing")
                n = outside.count()
            elif len(levels) % 2 == 0:
                inside = written(wrong(inside), "listed")
                n = inside.count()
            else:
                outside = written(wrong(outside), "passing")
                n = outside.count()
        if n:
            raise RuntimeError("the cascade did not end")
        return cls(name, levels)

    def attach(self, df: DataFrame) -> DataFrame:
        """df with the filters' words as columns of one array each, shared by all rows."""
        spark = df.sparkSession
        return df.withColumns({f"{self.name}_{b.level}": spark.createDataFrame([(list(b.words),)], "bits array<bigint>").scalar() for b in self.levels})

    def lists(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            b = self.levels[k]
            out = F.when(b.has(key, F.col(f"{self.name}_{b.level}")), out).otherwise(F.lit(k % 2 == 1))
        return out


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule (its key, else null) and verdict.

    A rule fits its host and all its subdomains, where the path starts with the rule's; the longest fitting rule wins,
    of equal length that with more host; a rule both allowed and blocked blocks. Without a rule the verdict is default:
    the URL is on no list. Null URLs, and those without `://`, have empty host and path. Repeated rows are judged each;
    other columns are ignored; without rules all is default.
    """
    rows = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    if not rules:
        return rows.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    spark = pages.sparkSession
    keyed = rows.withColumn("keys", candidate_keys(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("keys").alias("key"))
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    blocked = {r.key for r in rules if r.verdict == "block"}
    lists = {"allow": {r.key for r in rules} - blocked, "block": blocked}
    found = keyed
    cascades = []
    for name, keys in lists.items():
        if keys:
            c = Cascade.build(name, spark.createDataFrame([(k,) for k in sorted(keys)], "key string"), universe, size)
            found = c.attach(found)
            cascades.append(c)

    def judged(k: Column) -> Column:
        out = F.lit(None).cast("string")
        for c in cascades:
            out = F.when(c.lists(k), F.lit(c.name)).otherwise(out)
        return F.struct(k.alias("rule"), out.alias("verdict"))

    first = F.get(F.filter(F.transform("keys", judged), lambda x: x["verdict"].isNotNull()), F.lit(0))
    return found.select("page_id", "host", "path", first.alias("first")).select("page_id", "host", "path", F.col("first.rule").alias("rule"), F.coalesce("first.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query.
RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL under the fixed rules."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


ORACLE = f"""
WITH r(h, p, verdict) AS (VALUES {", ".join(f"('{r.host}', '{r.path}', '{r.verdict}')" for r in RULES)}),
u AS (
  SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
best AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM u JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM u LEFT JOIN best USING (page_id)
"""
