"""Expressions in two dialects: Spark SQL, which the engine runs, and DuckDB SQL, which checks it.

An operator is a template that takes a dialect and returns a query over named inputs, written «input». Called with
DataFrames it is a lazy Spark query; `duck` gives the same relation as SQL text over the driver's tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


class Dialect:
    spark = False

    def lit(self, s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def get(self, a: str, i: int | str) -> str:
        """Element i from 0; null beyond the end."""
        return f"({a})[{i} + 1]"

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, '{pattern}', '{by}', 'g')"

    def group(self, n: int) -> str:
        return f"\\{n}"

    def matches(self, x: str, pattern: str) -> str:
        return f"regexp_matches({x}, '{pattern}')"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, '{pattern}', {group})"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, '{pattern}', {group})"

    def array(self, *x: str) -> str:
        return f"[{', '.join(x)}]"

    def struct(self, **fields: str) -> str:
        return "{" + ", ".join(f"'{k}': {v}" for k, v in fields.items()) + "}"

    def size(self, a: str) -> str:
        return f"len({a})"

    def map(self, a: str, v: str, e: str) -> str:
        return f"list_transform({a}, lambda {v}: {e})"

    def keep(self, a: str, v: str, e: str) -> str:
        return f"list_filter({a}, lambda {v}: {e})"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, {self.lit(sep)})"

    def count_to(self, n: str) -> str:
        """1 to n, for n of 1 or more."""
        return f"range(1, CAST({n} AS BIGINT) + 1)"

    def numbers(self, a: str, b: str) -> str:
        """a to b, for b of a or more."""
        return f"range(CAST({a} AS BIGINT), CAST({b} AS BIGINT) + 1)"

    def slice(self, a: str, first: str, n: str) -> str:
        """n elements from position `first`, from 1."""
        return f"list_slice({a}, {first}, {first} + {n} - 1)"

    def word_runs(self, key: str, most: str) -> str:
        """All runs of consecutive words of a key that is not empty, of `most` words at most."""
        words = self.split(key, " ")
        run = self.join(self.slice(words, "i", "j"), " ")
        return f"flatten({self.map(self.count_to(self.size(words)), 'i', self.map(self.numbers('1', f'least({most}, {self.size(words)} - i + 1)'), 'j', run))})"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, {self.lit(sep)})"

    def unnest(self, table: str, a: str, name: str) -> str:
        return f"{table}, unnest({a}) AS {name}_t({name})"

    def sha256(self, x: str) -> str:
        return f"sha256({x})"

    def first_by(self, x: str, by: str) -> str:
        return f"arg_min({x}, {by})"

    def last_by(self, x: str, by: str) -> str:
        return f"arg_max({x}, {by})"

    def listed(self, x: str, sep: str = " ") -> str:
        """Distinct values of a group, sorted and joined; empty without any."""
        return f"coalesce(string_agg(DISTINCT {x}, {self.lit(sep)} ORDER BY {x}), '')"

    def values(self, names: str, rows: list[tuple]) -> str:
        one = lambda v: "NULL" if v is None else self.lit(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)
        return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS {names}"

    def lookup(self, x: str, pairs: list[tuple]) -> str:
        """The second member of the pair whose first is x; null if there is none. x stands in the text once."""
        one = lambda v: self.lit(v) if isinstance(v, str) else str(v)
        return f"([{', '.join(one(b) for _, b in pairs)}])[list_position([{', '.join(one(a) for a, _ in pairs)}], {x})]"

    def find(self, x: str, what: str) -> str:
        return f"instr({x}, {what})"

    def seconds(self, ts: str) -> str:
        return f"CAST(epoch({ts}) AS BIGINT)"

    def field(self, json: str, name: str) -> str:
        return f"json_extract_string({json}, '$.{name}')"

    def overlap(self, a: str, b: str) -> str:
        return f"list_has_any({a}, {b})"

    def sorted_set(self, x: str) -> str:
        """Distinct values of a group as a sorted array."""
        return f"list_sort(list_distinct(list({x}) FILTER ({x} IS NOT NULL)))"

    def merged_sets(self, x: str) -> str:
        """The distinct values of a group's arrays as a sorted array."""
        return f"list_sort(list_distinct(flatten(list({x}) FILTER ({x} IS NOT NULL))))"


class SparkDialect(Dialect):
    spark = True

    def get(self, a: str, i: int | str) -> str:
        return f"get({a}, CAST({i} AS int))"

    def replace_all(self, x: str, pattern: str, by: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', r'{by}')"

    def group(self, n: int) -> str:
        return f"${n}"

    def matches(self, x: str, pattern: str) -> str:
        return f"({x} RLIKE r'{pattern}')"

    def extract(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def extract_all(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract_all({x}, r'{pattern}', {group})"

    def array(self, *x: str) -> str:
        return f"array({', '.join(x)})"

    def struct(self, **fields: str) -> str:
        return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS bigint)"

    def map(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})"

    def keep(self, a: str, v: str, e: str) -> str:
        return f"filter({a}, {v} -> {e})"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, {self.lit(sep)})"

    def count_to(self, n: str) -> str:
        return f"sequence(CAST(1 AS bigint), CAST({n} AS bigint))"

    def numbers(self, a: str, b: str) -> str:
        return f"sequence(CAST({a} AS bigint), CAST({b} AS bigint))"

    def slice(self, a: str, first: str, n: str) -> str:
        return f"slice({a}, CAST({first} AS int), CAST({n} AS int))"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, r'{re.escape(sep)}')"

    def unnest(self, table: str, a: str, name: str) -> str:
        return f"{table} LATERAL VIEW explode({a}) {name}_t AS {name}"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def first_by(self, x: str, by: str) -> str:
        return f"min_by({x}, {by})"

    def last_by(self, x: str, by: str) -> str:
        return f"max_by({x}, {by})"

    def listed(self, x: str, sep: str = " ") -> str:
        return f"array_join(array_sort(collect_set({x})), {self.lit(sep)})"

    def lookup(self, x: str, pairs: list[tuple]) -> str:
        one = lambda v: self.lit(v) if isinstance(v, str) else str(v)
        return f"map({', '.join(f'{one(a)}, {one(b)}' for a, b in pairs)})[{x}]"

    def seconds(self, ts: str) -> str:
        return f"unix_timestamp({ts})"

    def field(self, json: str, name: str) -> str:
        return f"get_json_object({json}, '$.{name}')"

    def overlap(self, a: str, b: str) -> str:
        return f"arrays_overlap({a}, {b})"

    def sorted_set(self, x: str) -> str:
        return f"array_sort(collect_set({x}))"

    def merged_sets(self, x: str) -> str:
        return f"array_sort(array_distinct(flatten(collect_list({x}))))"


SPARK, DUCK = SparkDialect(), Dialect()


class Operator:
    """A query template over named inputs."""

    def __init__(self, build: Callable[[Dialect], str], inputs: tuple[str, ...]) -> None:
        self.build, self.inputs, self.__doc__, self.__name__ = build, inputs, build.__doc__, build.__name__

    def __call__(self, *tables: DataFrame) -> DataFrame:
        if len(tables) != len(self.inputs):
            raise TypeError(f"{self.__name__} takes {', '.join(self.inputs)}")
        text = self.build(SPARK).replace("{", "{{").replace("}", "}}")
        for name in self.inputs:
            text = text.replace(f"«{name}»", f"{{{name}}}")
        spark = tables[0].sparkSession if tables else SparkSession.active()
        return spark.sql(text, **dict(zip(self.inputs, tables, strict=True)))

    def over(self, dialect: Dialect, tables: list[str]) -> str:
        """The query's text over tables by name."""
        text = self.build(dialect)
        for name, table in zip(self.inputs, tables, strict=True):
            text = text.replace(f"«{name}»", table)
        return text

    def duck(self, *sources: str) -> str:
        """DuckDB SQL of the operator over sources, each the name of a table or a query."""
        text = self.build(DUCK)
        for name in self.inputs:
            text = text.replace(f"«{name}»", f"in_{name}")
        head = ", ".join(f"in_{name} AS ({s if ' ' in s else f'SELECT * FROM {s}'})" for name, s in zip(self.inputs, sources, strict=True))
        return f"WITH {head} SELECT * FROM ({text})" if head else text


def operator(*inputs: str) -> Callable[[Callable[[Dialect], str]], Operator]:
    return lambda build: Operator(build, inputs)
