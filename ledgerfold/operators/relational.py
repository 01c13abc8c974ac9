"""Small typed tables: validated schemas, mutations folded by primary key, and validated comparison queries.

Everything a request names is checked before a plan is built; names are case-sensitive, literals aren't coerced, and
results come in primary-key order.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from .temporal import ranked

TYPES = {"int64": "bigint", "text": "string"}
MOST_COLUMNS, MOST_NAME_BYTES, MOST_TEXT_BYTES, MOST_OPS = 64, 255, 65_535, 1024
COMPARE = {"eq": operator.eq, "lt": operator.lt, "le": operator.le, "gt": operator.gt, "ge": operator.ge}


@dataclass(frozen=True)
class Schema:
    """Columns (name, 'int64' or 'text') and the name of the primary key."""

    columns: tuple[tuple[str, str], ...]
    key: str

    def __post_init__(self):
        names = [name for name, _ in self.columns]
        if not 1 <= len(names) <= MOST_COLUMNS:
            raise InvalidInput(f"a table has 1 to {MOST_COLUMNS} columns")
        for name, kind in self.columns:
            valid_name(name)
            if kind not in TYPES:
                raise InvalidInput(f"unknown type {kind}")
        if len(set(names)) < len(names):
            raise InvalidInput("a column's name is used twice")
        if self.key not in names:
            raise InvalidInput(f"the key {self.key} is no column")

    def kind(self, name: str) -> str:
        found = dict(self.columns)
        if name not in found:
            raise InvalidInput(f"unknown column {name}")
        return found[name]


def valid_name(name: str) -> str:
    if not re.fullmatch("[A-Za-z0-9_]+", name) or len(name) > MOST_NAME_BYTES:
        raise InvalidInput(f"not a name: {name!r}")
    return name


@dataclass(frozen=True)
class Predicate:
    column: str
    op: str
    value: int | str

    def condition(self, schema: Schema) -> Column:
        kind = schema.kind(self.column)
        if self.op not in COMPARE:
            raise InvalidInput(f"unknown comparison {self.op}")
        if isinstance(self.value, bool) or not isinstance(self.value, int if kind == "int64" else str):
            raise InvalidInput(f"{self.column} is {kind}, {self.value!r} is not")
        if kind == "int64" and not -(1 << 63) <= self.value < 1 << 63:
            raise InvalidInput(f"{self.value} is out of range")
        return COMPARE[self.op](F.col(f"`{self.column}`"), F.lit(self.value).cast(TYPES[kind]))


class Table:
    """A DataFrame with a declared schema. Rows without a key, and nulls anywhere, are rejected by `checked`."""

    def __init__(self, name: str, schema: Schema, rows: DataFrame):
        self.name, self.schema = valid_name(name), schema
        missing = [c for c, _ in schema.columns if c not in rows.columns]
        if missing:
            raise InvalidInput(f"{name} lacks {', '.join(missing)}")
        self.rows = rows.select(*[F.col(f"`{c}`").cast(TYPES[kind]).alias(c) for c, kind in schema.columns])

    def violations(self) -> DataFrame:
        """Keys of rows that the schema doesn't allow, with the reason."""
        null = reduce(operator.or_, [F.col(c).isNull() for c, _ in self.schema.columns])
        long = reduce(operator.or_, [F.octet_length(c) > MOST_TEXT_BYTES for c, kind in self.schema.columns if kind == "text"], F.lit(False))
        bad = self.rows.select(F.col(self.schema.key).cast("string").alias("key"), F.when(null, "null").when(long, "text too long").alias("reason")).filter("reason IS NOT NULL")
        twice = self.rows.groupBy(self.schema.key).count().filter("count > 1").select(F.col(self.schema.key).cast("string").alias("key"), F.lit("key used twice").alias("reason"))
        return bad.unionByName(twice)

    def checked(self) -> Table:
        found = self.violations().head(1)
        if found:
            raise InvalidInput(f"{self.name}: row {found[0]['key']}: {found[0]['reason']}")
        return self

    def projected(self, columns: Sequence[str] | None) -> list[str]:
        if columns is None:
            return [c for c, _ in self.schema.columns]
        if not columns:
            raise InvalidInput("a projection names a column at least")
        if len(set(columns)) < len(columns):
            raise InvalidInput("a projection names a column twice")
        for c in columns:
            self.schema.kind(c)
        return list(columns)

    def query(self, columns: Sequence[str] | None = None, where: Sequence[Predicate] = (), how: str = "and") -> DataFrame:
        """Rows that meet all predicates (or one of them, for how='or') in key order, projected last."""
        names = self.projected(columns)
        rows = self.rows
        if where:
            rows = rows.filter(joined(where, self.schema, how))
        return rows.orderBy(self.schema.key).select(*names)

    def conjunctive(self, where: Sequence[Predicate], columns: Sequence[str] | None = None) -> DataFrame:
        return self.query(columns, _some(where), "and")

    def disjunctive(self, where: Sequence[Predicate], columns: Sequence[str] | None = None) -> DataFrame:
        return self.query(columns, _some(where), "or")

    def union_by_key(self, where: Sequence[Predicate], columns: Sequence[str] | None = None) -> DataFrame:
        """disjunctive() as one scan for each predicate, united by key."""
        names = self.projected(columns)
        parts = [self.rows.filter(p.condition(self.schema)) for p in _some(where)]
        return reduce(DataFrame.unionByName, parts).dropDuplicates([self.schema.key]).orderBy(self.schema.key).select(*names)

    def row(self, key: int | str, columns: Sequence[str] | None = None) -> DataFrame:
        return self.query(columns, [Predicate(self.schema.key, "eq", key)])


def _some(where: Sequence[Predicate]) -> Sequence[Predicate]:
    if not where:
        raise InvalidInput("a predicate is needed at least")
    return where


def joined(where: Sequence[Predicate], schema: Schema, how: str) -> Column:
    return reduce(operator.and_ if how == "and" else operator.or_, [p.condition(schema) for p in where])


def table_after(ops: DataFrame, schema: Schema) -> DataFrame:
    """The rows after ordered mutations: ops has seq (unique), op ('upsert' or 'delete') and the schema's columns, of
    which a delete needs only the key."""
    rest = [c for c, _ in schema.columns if c != schema.key]
    last = ops.groupBy(schema.key).agg(F.max_by(F.struct("op", *rest), "seq").alias("last"))
    return last.filter("last.op = 'upsert'").select(*[F.col(c) if c == schema.key else F.col(f"last.{c}") for c, _ in schema.columns])


def commit_outcomes(batches: DataFrame, ops: DataFrame, schema: Schema, first_tx: int = 1) -> DataFrame:
    """What becomes of batches (batch, a distinct long) of operations (batch, seq, op and the schema's columns): batch,
    tx_id, reason.

    A batch of 1 to MOST_OPS operations that are all valid commits as a whole and takes the next id in batch order; any
    other is rejected as a whole, with the reason of its first bad operation, and takes none.
    """
    null = reduce(operator.or_, [F.col(c).isNull() for c, _ in schema.columns])
    long = reduce(operator.or_, [F.octet_length(c) > MOST_TEXT_BYTES for c, kind in schema.columns if kind == "text"], F.lit(False))
    bad = (
        F.when(~F.coalesce(F.col("op").isin("upsert", "delete"), F.lit(False)), "unknown operation")
        .when(F.col(schema.key).isNull(), "no key")
        .when((F.col("op") == "upsert") & null, "null")
        .when((F.col("op") == "upsert") & long, "text too long")
    )
    judged = ops.withColumn("bad", bad).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min_by("bad", F.when(F.col("bad").isNotNull(), F.col("seq"))).alias("bad"))
    n = F.coalesce("n", F.lit(0))
    all_ = batches.select("batch").join(judged, "batch", "left").select("batch", F.when(n == 0, "no operations").when(n > MOST_OPS, "too many operations").otherwise(F.col("bad")).alias("reason"))
    accepted = ranked(all_.filter("reason IS NULL").select("batch"), "batch").select("batch", (F.col("__rank") + first_tx).alias("tx_id"))
    return all_.join(accepted, "batch", "left").select("batch", "tx_id", "reason")


def committed(ops: DataFrame, outcomes: DataFrame, schema: Schema) -> DataFrame:
    """The table's rows after all batches that commit: see commit_outcomes and table_after."""
    return table_after(ops.join(outcomes.filter("tx_id IS NOT NULL").select("batch"), "batch", "left_semi"), schema)


def in_order(rows: DataFrame, key: str) -> DataFrame:
    """rows with ord, their place in key order (from 0), for a long key that is unique."""
    return ranked(rows, key).withColumnRenamed("__rank", "ord")


def catalogue_rows(tables: Sequence[Table], spark) -> DataFrame:
    rows = [(t.name, k, c, kind, c == t.schema.key) for t in sorted(tables, key=lambda t: t.name) for k, (c, kind) in enumerate(t.schema.columns)]
    return spark.createDataFrame(rows, "table string, ord int, column string, type string, is_key boolean")
