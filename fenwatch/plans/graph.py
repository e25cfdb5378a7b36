"""Queries as graphs of operators: a node is an operator over other nodes, the driver's tables (by name), or open inputs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fenwatch.functions.dialect import DUCK, Dialect, Operator, operator

Query = Callable[[SparkSession, str], DataFrame]


class Node:
    """An operator over other nodes or the driver's tables (by name): a DataFrame, or SQL text.

    kept nodes are written once a run, so that neither their work nor their plan is repeated, their size is known to the
    planner, and lost executors don't bring the work back. oracle: SQL that checks the node, written apart from it.
    by: a node with the same rows that Spark runs in its place; the SQL stays that of the node itself.
    """

    def __init__(self, op: Operator | Callable[..., DataFrame] | None, *sources: Node | str, kept: bool = False, name: str = "", oracle: Callable[[], str] | None = None, by: Node | None = None) -> None:
        self.op, self.sources, self.kept, self.name, self.oracle, self.by = op, sources, kept, name, oracle, by

    def spark(self, spark: SparkSession, sf_dir: str, made: dict[Node, DataFrame] | None = None) -> DataFrame:
        """The node's rows. made: DataFrames that take the place of nodes, open inputs first of all."""
        made = {} if made is None else made
        if self not in made and self.by:
            made[self] = self.by.spark(spark, sf_dir, made)
        if self not in made:
            if self.op is None:
                raise ValueError(f"{self.name} is not given")
            tables = [spark.read.parquet(f"{sf_dir}/{s}.parquet") if isinstance(s, str) else s.spark(spark, sf_dir, made) for s in self.sources]
            df = self.op(*tables)
            made[self] = written(df) if self.kept else df
        return made[self]

    def duck(self) -> str:
        """DuckDB SQL: a table expression per node, each made once."""
        parts: list[str] = []
        names: dict[Node, str] = {}

        def visit(node: Node | str) -> str:
            if isinstance(node, str):
                return node
            if node not in names:
                text = node.oracle() if node.oracle else node.op.over(DUCK, [visit(s) for s in node.sources])
                names[node] = f"node_{len(parts)}"
                parts.append(f"{names[node]} AS MATERIALIZED ({text})")
            return names[node]

        top = visit(self)
        return f"WITH {', '.join(parts)} SELECT * FROM {top}"


def bound(node: Node, by: dict[Node, Node], made: dict[Node, Node] | None = None) -> Node:
    """node with nodes in the place of its open inputs."""
    made = {} if made is None else made
    if node in by:
        return by[node]
    if node not in made:
        made[node] = Node(node.op, *(s if isinstance(s, str) else bound(s, by, made) for s in node.sources), kept=node.kept, name=node.name, oracle=node.oracle, by=node.by and bound(node.by, by, made))
    return made[node]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of this machine only for a local master."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no folder that the cluster shares")
        top = f"file://{tempfile.mkdtemp(prefix='shared-')}"
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, which whoever owns that folder clears after the run."""
    path = f"{shared_folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def given(name: str) -> Node:
    """An open input."""
    return Node(None, name=name)


def select(text: Callable[[Dialect], str] | str, *sources: Node | str, kept: bool = False, by: Node | None = None) -> Node:
    """A node of plain SQL over inputs «a», «b» and so on."""
    names = tuple("abcdef"[: len(sources)])
    return Node(operator(*names)(text if callable(text) else lambda d: text), *sources, kept=kept, by=by)
