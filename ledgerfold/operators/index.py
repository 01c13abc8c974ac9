"""Sorted copies of tables as access paths: ranges on the sorted column skip Parquet row groups by their minima and maxima."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidInput
from .relational import Predicate, Table, _some, table_after


class IndexedTable:
    """A table with sorted copies by column. They hold the rows of the time when they were made; `committed` adds what a
    batch of operations changes, and `refreshed` makes them anew."""

    def __init__(self, table: Table, folder: str, generation: int = 0):
        self.table, self.folder, self.copies, self.generation = table, folder.rstrip("/"), {}, generation

    def add(self, column: str) -> IndexedTable:
        """Writes a copy that is range-partitioned and sorted by the column, then the key."""
        self.table.schema.kind(column)
        if column in self.copies:
            raise InvalidInput(f"{self.table.name} has an index on {column}")
        key = self.table.schema.key
        path = f"{self.folder}/{self.table.name}-by-{column}-{self.generation}"
        self.table.rows.repartitionByRange(column, key).sortWithinPartitions(column, key).write.mode("overwrite").parquet(path)
        self.copies[column] = self.table.rows.sparkSession.read.schema(self.table.rows.schema).parquet(path)
        return self

    def refreshed(self, table: Table) -> IndexedTable:
        """The copies of another state of the table, written beside these."""
        out = IndexedTable(table, self.folder, self.generation + 1)
        for column in self.copies:
            out.add(column)
        return out

    def committed(self, ops: DataFrame) -> IndexedTable:
        """The table and its copies after ordered operations (see table_after), without writing a copy: what a copy held of
        the changed keys is left out, and the keys' new rows are added. Filters still reach the sorted copies' files."""
        schema = self.table.schema
        changed, new = ops.select(schema.key).distinct(), table_after(ops, schema)
        after = lambda rows: rows.join(changed, schema.key, "left_anti").select(*new.columns).unionByName(new)
        out = IndexedTable(Table(self.table.name, schema, after(self.table.rows)), self.folder, self.generation)
        out.copies = {column: after(rows) for column, rows in self.copies.items()}
        return out

    def access_path(self, where: Sequence[Predicate]) -> str:
        """'index <column>' for the first predicate in order whose column has a copy, else 'scan'."""
        return next((f"index {p.column}" for p in where if p.column in self.copies), "scan")

    def conjunctive(self, where: Sequence[Predicate], columns: Sequence[str] | None = None) -> DataFrame:
        """All predicates are applied to what the driving copy, or the table, is read for."""
        path = self.access_path(_some(where))
        rows = self.copies[path.removeprefix("index ")] if path != "scan" else self.table.rows
        return Table(self.table.name, self.table.schema, rows).conjunctive(where, columns)

    def disjunctive(self, where: Sequence[Predicate], columns: Sequence[str] | None = None) -> DataFrame:
        """One read for each predicate, by its copy if there is one, united by key."""
        names = self.table.projected(columns)
        conditions = [(self.copies.get(p.column, self.table.rows), p.condition(self.table.schema)) for p in _some(where)]
        union = conditions[0][0].filter(conditions[0][1])
        for rows, condition in conditions[1:]:
            union = union.unionByName(rows.filter(condition))
        return union.dropDuplicates([self.table.schema.key]).orderBy(self.table.schema.key).select(*names)


def cardinality(table: Table, column: str) -> DataFrame:
    """Rows for each value of a column."""
    table.schema.kind(column)
    return table.rows.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
