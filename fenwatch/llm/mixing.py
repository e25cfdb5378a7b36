"""Mixing overlapping sources to target weights by min-cost flow, and a seeded choice of documents.

Documents with the same set of sources form a membership pattern. Patterns' words are routed to the sources' quotas
by a flow in which a second copy of a word costs more than a first one, then each pattern's words are taken from its
documents in the order of a seeded hash. Only totals of patterns reach the driver, never documents.
"""

from __future__ import annotations

import json
from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fenwatch.llm.common import written

WEIGHTS, SHARE, MOST_COPIES, SEED = (3, 1, 2), 1.5, 2, 17
#: Different sets of sources that the driver solves for; a corpus with more is refused.
MOST_PATTERNS = 100_000
#: Bits of the hash that one step of the selection settles.
STEP = 8
#: Documents whose copies are weighed anew for what is missing at the end: of each pattern, and of all patterns; and words that sums may reach.
MOST_WEIGHED, MOST_WEIGHED_ALL, MOST_SUM = 200, 400_000, 1_000_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: dict[str | None, float], total: float, most: float = MOST_COPIES) -> dict[str | None, float]:
    """Shares of total by weight; none is above `most` times its source's size, and the excess is shared anew among the others by weight."""
    out, left, open_ = {}, total, set(sizes)
    while open_:
        per = left / sum(weights[s] for s in open_) if any(weights[s] for s in open_) else 0.0
        over = [s for s in open_ if per * weights[s] > most * sizes[s]]
        if not over:
            return out | {s: per * weights[s] for s in open_}
        for s in over:
            out[s] = float(most * sizes[s])
            left -= out[s]
            open_.discard(s)
    return out


class Flow:
    """Maximum flow by levels. Arcs may be added between runs, and later runs keep what earlier ones routed."""

    def __init__(self, n: int) -> None:
        self.heads: list[list[int]] = [[] for _ in range(n)]
        self.to: list[int] = []
        self.room: list[int] = []

    def arc(self, a: int, b: int, room: int) -> int:
        self.heads[a].append(len(self.to))
        self.heads[b].append(len(self.to) + 1)
        self.to += (b, a)
        self.room += (room, 0)
        return len(self.to) - 2

    def run(self, s: int, t: int) -> None:
        while True:
            level = {s: 0}
            queue = deque([s])
            while queue:
                a = queue.popleft()
                for e in self.heads[a]:
                    if self.room[e] and self.to[e] not in level:
                        level[self.to[e]] = level[a] + 1
                        queue.append(self.to[e])
            if t not in level:
                return
            tried = [0] * len(self.heads)
            path: list[int] = []
            at = s
            while True:
                if at == t:
                    got = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= got
                        self.room[e ^ 1] += got
                    path, at = [], s
                    continue
                edges = self.heads[at]
                while tried[at] < len(edges) and not (self.room[edges[tried[at]]] and level.get(self.to[edges[tried[at]]]) == level[at] + 1):
                    tried[at] += 1
                if tried[at] < len(edges):
                    path.append(edges[tried[at]])
                    at = self.to[path[-1]]
                elif path:
                    e = path.pop()
                    at = self.to[e ^ 1]
                    tried[at] += 1
                else:
                    break


def route(patterns: dict[str, int], quotas: dict[str | None, float], most: int = MOST_COPIES) -> dict[str, int]:
    """Words to take from each pattern (key: JSON list of its sources; value: words of one copy).

    The n-th copy of a word costs more than the one before, and nothing else costs, so the cheapest flow is found by
    maximum flows: with one copy of all words first, then with two of them, and so on, each keeping what was routed.
    """
    members = {p: json.loads(p) for p in patterns}
    names = sorted(quotas, key=lambda s: (s is None, s or ""))
    at = {s: i + 2 for i, s in enumerate(names)}
    net = Flow(2 + len(names) + len(patterns))
    for s in names:
        net.arc(at[s], 1, round(quotas[s]))
    into = {}
    for k, p in enumerate(sorted(patterns), 2 + len(names)):
        into[p] = []
        for s in members[p]:
            if s in at:
                net.arc(k, at[s], most * patterns[p])
    for _ in range(most):
        for k, p in enumerate(sorted(patterns), 2 + len(names)):
            into[p].append(net.arc(0, k, patterns[p]))
        net.run(0, 1)
    return {p: sum(patterns[p] - net.room[e] for e in es) for p, es in into.items()}


@dataclass(frozen=True)
class Cut:
    """Documents of a pattern get `copies`, and one more where their hash is in one of `runs`; but those whose hash is in `changed` get the copies it gives.

    runs: (after, upto, most): hashes above `after` (null: all) up to `upto` whose documents have at most `most` words together.
    """

    pattern: str
    copies: int
    runs: tuple[tuple[int | None, int, int], ...] = ()
    changed: tuple[tuple[int, int], ...] = ()


RUNS = "array<struct<after: bigint, upto: bigint, most: bigint>>"
CHANGED = "array<struct<hash: bigint, copies: int>>"


@dataclass
class Search:
    """Where the selection of a pattern stands: `rest` words are missing; hashes above `after` with at most `most` words are open, of which those with the prefix of `level` bits come next."""

    copies: int
    rest: int
    most: int
    after: int | None = None
    level: int = 0
    prefix: int = 0
    last: int | None = None
    runs: tuple[tuple[int | None, int, int], ...] = ()


def chosen(runs: str, total: str = "total") -> Column:
    """Whether a run takes a row with columns hash and total."""
    return F.exists(runs, lambda r: (r["after"].isNull() | (F.col("hash") > r["after"])) & (F.col("hash") <= r["upto"]) & (F.col(total) <= r["most"]))


def weighed(sizes: list[int], copies: list[int], missing: int, most: int) -> list[int]:
    """Copies of some documents, from none to `most`, that bring their words as near to `missing` more as any do; of equally near ones the first found from the last document on.

    The sums that can be reached are the bits of a number, one for each count of documents looked at; as many of the
    first documents take part as keep the sums below MOST_SUM.
    """
    n, total = 0, 0
    while n < len(sizes) and total + most * sizes[n] <= MOST_SUM:
        total += most * sizes[n]
        n += 1
    reach = [1]
    for size in sizes[:n]:
        reach.append(0)
        for c in range(most + 1):
            reach[-1] |= reach[-2] << c * size
    want = missing + sum(c * s for c, s in zip(copies[:n], sizes[:n], strict=True))
    want = max(0, want)
    below = reach[-1] & ((1 << want + 1) - 1)
    above = reach[-1] >> want
    low = below.bit_length() - 1
    high = want + (above & -above).bit_length() - 1 if above else None
    at = low if high is None or want - low <= high - want else high
    out = list(copies)
    for k in range(n - 1, -1, -1):
        order = [copies[k], *(c for c in range(most + 1) if c != copies[k])]
        out[k] = next(c for c in order if at >= c * sizes[k] and reach[k] >> at - c * sizes[k] & 1)
        at -= out[k] * sizes[k]
    return out


def choose(sized: DataFrame, patterns: dict[str, int], take: dict[str, int], most: int = MOST_COPIES) -> list[Cut]:
    """Cuts that take each pattern's words from its documents in the order of their hashes, each that still fits.

    sized: columns pattern, size, hash, and total, the words of all documents of a hash, which go together. A step sums
    sizes by STEP more bits of the hash, down to the first one that does not fit. That one is passed over, and the
    descent is repeated over the later ones that are no longer than what is missing, until none is left: what is
    missing then is less than any document that was not taken. For that the copies of the pattern's smallest documents
    are weighed anew, so that its words come as near as those documents let them.
    """
    spark = sized.sparkSession
    done: dict[str, Search] = {}
    open_: dict[str, Search] = {}
    for p, words in patterns.items():
        copies, rest = divmod(take[p], words) if words else (0, 0)
        (open_ if rest else done)[p] = Search(copies, rest, rest)
    while open_:
        state = spark.createDataFrame([(p, s.most, s.after, s.level, s.prefix) for p, s in open_.items()], "pattern string, most long, after long, level int, prefix long")
        inside = sized.where("size > 0").join(F.broadcast(state), "pattern").where("total <= most AND (after IS NULL OR hash > after) AND (level = 0 OR shiftright(hash, 64 - level) = prefix)")  # at most MOST_PATTERNS rows
        sums = inside.groupBy("pattern", F.expr(f"shiftright(hash, {64 - STEP} - level)").alias("prefix")).agg(F.sum("size").alias("size"), F.min("hash").alias("low"), F.max("hash").alias("high"))
        by: dict[str, list] = {p: [] for p in open_}
        for r in sums.collect():
            by[r["pattern"]].append(r)
        for p, rows in by.items():
            s = open_[p]
            over = None
            for r in sorted(rows, key=lambda r: r["prefix"]):
                if r["size"] > s.rest:
                    over = r
                    break
                s.rest -= r["size"]
                s.last = r["high"]
            if over and s.rest and over["low"] != over["high"]:
                s.level, s.prefix = s.level + STEP, over["prefix"]
                continue
            if s.last is not None:
                s.runs += ((s.after, s.last, s.most),)
            if over and s.rest:
                s.most, s.after, s.level, s.last = s.rest, over["low"], 0, None
            else:
                done[p] = open_.pop(p)
    changed: dict[str, tuple[tuple[int, int], ...]] = {}
    short = [(p, s.copies, s.runs) for p, s in done.items() if s.rest]
    if short:
        state = spark.createDataFrame(short, f"pattern string, copies int, runs {RUNS}")
        least = min(MOST_WEIGHED, MOST_WEIGHED_ALL // len(short))
        by_size = Window.partitionBy("pattern").orderBy("total", "hash")
        near = sized.where("total > 0").join(F.broadcast(state), "pattern")  # at most MOST_PATTERNS rows
        near = near.select("pattern", "hash", "total", (F.col("copies") + chosen("runs").cast("int")).alias("n_copies"))
        # rows of a hash have one total, and one rank
        near = near.withColumn("r", F.dense_rank().over(by_size)).where(F.col("r") <= least).distinct()
        found: dict[str, list] = {p: [] for p, _, _ in short}
        for r in near.collect():
            found[r["pattern"]].append(r)
        for p, rows in found.items():
            rows.sort(key=lambda r: r["r"])
            before = [r["n_copies"] for r in rows]
            after = weighed([r["total"] for r in rows], before, done[p].rest, most)
            changed[p] = tuple((r["hash"], c) for r, b, c in zip(rows, before, after, strict=True) if b != c)
    return [Cut(p, s.copies, s.runs, changed.get(p, ())) for p, s in done.items()]


@dataclass
class Plan:
    sizes: dict[str | None, int]
    targets: dict[str | None, float]
    cuts: list[Cut]
    #: pattern, hash and total of hashes with several rows; null where there are none
    shared: DataFrame | None = None


def pattern_of(sources: Column) -> Column:
    return F.to_json(F.array_sort(F.array_distinct(sources)))


def seeded(key: Column, seed: int) -> Column:
    return F.xxhash64(key.cast("string"), F.lit(seed))


def plan_mix(docs: DataFrame, sources: Column, key: str = "doc_id", text: str = "text", weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: int = SEED) -> tuple[Plan, DataFrame]:
    """The plan, and the written table (doc_id, pattern, size, hash) it was made from.

    sources: an array column with all sources of a document. Sources go by code point, null last, and weigh as
    `weights` repeats; together they share `share` of all words. Null and empty texts have no words and are never
    taken from; documents without a source are not taken; equal ids share a hash and go together.
    """
    sized = written(docs.select(F.col(key).alias("doc_id"), pattern_of(sources).alias("pattern"), word_count(F.col(text)).alias("size"), seeded(F.col(key), seed).alias("hash")), "sizes")
    rows = sized.groupBy("pattern").agg(F.sum("size").alias("size")).limit(MOST_PATTERNS + 1).collect()
    if len(rows) > MOST_PATTERNS:
        raise ValueError(f"there are more than {MOST_PATTERNS} sets of sources")
    patterns = {r["pattern"]: r["size"] for r in rows if r["pattern"] is not None}
    sizes: dict[str | None, int] = {}
    for p, n in patterns.items():
        for s in json.loads(p):
            sizes[s] = sizes.get(s, 0) + n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    wanted = targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(names)}, share * sum(patterns.values()), most)
    shared = written(sized.groupBy("pattern", "hash").agg(F.sum("size").alias("total"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    shared = None if shared.isEmpty() else shared
    return Plan(sizes, wanted, choose(with_totals(sized, shared), patterns, route(patterns, wanted, most), most), shared), sized


def with_totals(sized: DataFrame, shared: DataFrame | None) -> DataFrame:
    """sized with total: the words of all rows of a hash."""
    if shared is None:
        return sized.withColumn("total", F.col("size"))
    return sized.join(shared, ["pattern", "hash"], "left").withColumn("total", F.coalesce("total", "size"))


def cut_table(spark: SparkSession, plan: Plan) -> DataFrame:
    return spark.createDataFrame([(c.pattern, c.copies, c.runs, c.changed) for c in plan.cuts], f"pattern string, copies int, runs {RUNS}, changed {CHANGED}")


def copies_of(sized: DataFrame, plan: Plan) -> DataFrame:
    """sized (columns pattern, size and hash) with n_copies."""
    table = F.broadcast(cut_table(sized.sparkSession, plan))  # at most MOST_PATTERNS rows, and MOST_WEIGHED_ALL changes
    more = F.coalesce(chosen("runs"), F.lit(False)).cast("int")
    other = F.filter("changed", lambda x: x["hash"] == F.col("hash"))
    copies = F.when(F.size(other) > 0, F.element_at(other, 1)["copies"]).otherwise(F.col("copies") + more)
    return with_totals(sized, plan.shared).join(table, "pattern", "left").withColumn("n_copies", F.coalesce(copies, F.lit(0))).drop("copies", "runs", "changed", "total")


def mix(docs: DataFrame, source: str = "source", key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs, with its columns, each row as often as the mix takes it."""
    plan, _ = plan_mix(docs, F.array(source), key, text)
    names = docs.columns
    held = docs.select(F.struct(*names).alias("row"), pattern_of(F.array(source)).alias("pattern"), word_count(F.col(text)).alias("size"), seeded(F.col(key), SEED).alias("hash"))
    return copies_of(held, plan).select(F.explode(F.array_repeat("row", F.col("n_copies"))).alias("row")).select(*(F.col("row")[n].alias(n) for n in names))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed by source."""
    plan, sized = plan_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.array("source"))
    # keyed by the patterns as Spark wrote them: encoders differ in the escapes of control characters
    facts = spark.createDataFrame([(c.pattern, plan.sizes[s], plan.targets[s]) for c in plan.cuts for s in json.loads(c.pattern)], "pattern string, source_size long, target double")
    return copies_of(sized, plan).join(F.broadcast(facts), "pattern", "left").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).alias("taken"))
