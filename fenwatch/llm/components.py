"""Connected components of an edge table, by contraction. No edge, node or component list reaches the driver, and no node's neighbours are gathered.

Each round every node takes, among itself and its neighbours, the one of the least hash (a new hash each round), and
edges are renamed after that choice; what is left are fewer nodes with the same connections. Rounds are written to the
shared folder. Minima pre-aggregate, and joins on a frequent node are plain ones, whose hot keys adaptive execution
splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenwatch.llm.common import written


def forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges (node, root) with the same components as the given ones."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (p := up.setdefault(root, root)) != root:
            root = p
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            up[max(p, q)] = min(p, q)
    nodes = [x for x in up if find(x) != x]
    return nodes, [up[x] for x in nodes]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges of a partition to a forest, a batch's worth at a time; what is kept grows with the partition's nodes at most."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        x, y = forest(np.concatenate([a, batch.column("a").to_numpy()]), np.concatenate([b, batch.column("b").to_numpy()]))
        a, b = np.array(x, dtype=np.int64), np.array(y, dtype=np.int64)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


#: Edges that a task connects by itself, in some 20 MB.
PART_EDGES = 1 << 16


def _rooted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all nodes of a partition's edges."""
    for batch in _contract(batches):
        node, root = batch.column("a").to_numpy(), batch.column("b").to_numpy()
        roots = np.unique(root)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, roots])), pa.array(np.concatenate([root, roots]))], names=["node", "root"])


def components(edges: DataFrame, most_rounds: int = 200, again: bool = False, part_edges: int = 0) -> DataFrame:
    """(node, root) of all nodes of the edges (a, b: longs): nodes have one root exactly if they are connected. Loops and repeated edges change nothing; without edges there is no row.

    again: the tasks of each round join what their edges connect, not only those of the first, which takes fewer rounds.
    part_edges: once so many edges or fewer are left, one task connects them, so that rounds end early; 0 for never.
    """
    left = written(edges.select("a", "b").where("a <> b").mapInArrow(_contract, "a long, b long").distinct(), "edges")
    hooks: list[DataFrame] = []
    for k in range(most_rounds):
        if not (n := left.count()):
            break
        if n <= part_edges:
            hooks.append(written(left.coalesce(1).mapInArrow(_rooted, "node long, root long"), "hooks"))
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(k)), F.col(c))  # noqa: B023, E731
        best = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        hook = written(best.select(F.col("a").alias("node"), F.least("m", F.struct(F.xxhash64("a", F.lit(k)).alias("col1"), F.col("a").alias("b")))["b"].alias("root")), "hooks")
        hooks.append(hook)
        to = lambda c: hook.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: B023, E731
        renamed = left.join(to("a"), "a").select("b", "a_root").join(to("b"), "b").select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b"))
        rest = renamed.where("a <> b").distinct()
        left = written(rest.mapInArrow(_contract, "a long, b long") if again else rest, "edges")
    else:
        raise RuntimeError("components did not settle")
    if not hooks:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = hooks[0]
    for hook in hooks[1:]:
        out = out.join(hook.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    return out
