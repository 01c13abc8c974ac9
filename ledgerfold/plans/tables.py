"""Queries over small typed tables: predicates, projections, sorted copies, ordered mutations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.index import IndexedTable, cardinality
from ..operators.relational import Predicate as P
from ..operators.relational import Table, catalogue_rows, commit_outcomes, committed, in_order, table_after
from ..sources.scratch import scratch_path
from ..sources.tables import ORDERS, order_mutations, orders_table

COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_orderpriority"
OPS = {"eq": "=", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
AND = [P("o_orderstatus", "eq", "F"), P("o_orderkey", "ge", 400)]
OR = [P("o_orderpriority", "eq", "1-URGENT"), P("o_orderkey", "lt", 300), P("o_orderstatus", "gt", "O")]


_indexes: dict[tuple[str, str, tuple[str, ...]], IndexedTable] = {}


def _indexed(s, d, *columns):
    """orders with sorted copies, which are made once for a session and folder and deleted when the driver ends."""
    key = (s.sparkContext.applicationId, d, columns)
    if key not in _indexes:
        _indexes[key] = IndexedTable(orders_table(s, d), scratch_path(s, "index"))
        for c in columns:
            _indexes[key].add(c)
    return _indexes[key]


def _batches(s, d):
    """Every eight orders' keys are a batch of upserts, of which some hold a null, an unknown operation, or a delete."""
    n = F.col("o_orderkey")
    op = F.when(n % 501 == 5, "merge").when(n % 6 == 1, "delete").otherwise("upsert")
    rows = orders_table(s, d).rows
    return rows.select((F.expr("o_orderkey div 8")).alias("batch"), n.alias("seq"), op.alias("op"), "o_orderkey", "o_custkey", F.when(n % 299 != 3, F.col("o_orderstatus")).alias("o_orderstatus"), "o_orderpriority")


def _committed(s, d):
    ops = _batches(s, d)
    return commit_outcomes(ops.select("batch").distinct(), ops, ORDERS)


def _broken(s, d):
    """orders of which some have no status and some are there twice."""
    rows, n = orders_table(s, d).rows, F.col("o_orderkey")
    return Table("orders", ORDERS, rows.withColumn("o_orderstatus", F.when(n % 300 != 4, F.col("o_orderstatus"))).unionByName(rows.filter(n % 400 == 6)))


def _changed(s, d):
    """Operations on the indexed orders: other customers, and deletes."""
    n = F.col("o_orderkey")
    rows = orders_table(s, d).rows.filter(n % 3 == 1)
    return rows.select(n.alias("seq"), F.when(n % 2 == 0, "delete").otherwise("upsert").alias("op"), "o_orderkey", (F.col("o_custkey") + 1).alias("o_custkey"), "o_orderstatus", "o_orderpriority")


def _sql(where: str, columns: str = COLUMNS) -> str:
    return f"SELECT {columns} FROM orders WHERE {where}"


QUERIES = {
    "rel_catalog": lambda s, d: catalogue_rows([orders_table(s, d)], s),
    "rel_scan": lambda s, d: orders_table(s, d).query(),
    "rel_point": lambda s, d: orders_table(s, d).row(77),
    "rel_violations": lambda s, d: orders_table(s, d).violations(),
    "rel_upsert_delete_fold": lambda s, d: table_after(order_mutations(s, d), ORDERS),
    "q_projection_all": lambda s, d: orders_table(s, d).query(None, [P("o_orderkey", "le", 50)]),
    "q_projection_reorder": lambda s, d: orders_table(s, d).query(["o_orderpriority", "o_orderkey"], [P("o_orderkey", "le", 50)]),
    "q_and": lambda s, d: orders_table(s, d).conjunctive(AND, ["o_orderkey", "o_custkey"]),
    "q_and_driver": lambda s, d: _indexed(s, d, "o_orderkey").conjunctive(AND, ["o_orderkey", "o_custkey"]),
    "q_or": lambda s, d: orders_table(s, d).disjunctive(OR, ["o_orderkey", "o_orderpriority"]),
    "q_or_index_union": lambda s, d: _indexed(s, d, "o_orderkey", "o_orderpriority").disjunctive(OR, ["o_orderkey", "o_orderpriority"]),
    "q_indexed_range": lambda s, d: _indexed(s, d, "o_custkey").conjunctive([P("o_custkey", "ge", 20), P("o_custkey", "lt", 90)]),
    "q_indexed_after_commit": lambda s, d: _indexed(s, d, "o_custkey").committed(_changed(s, d)).conjunctive([P("o_custkey", "ge", 20), P("o_custkey", "lt", 90)]),
    "q_and_in_order": lambda s, d: in_order(orders_table(s, d).conjunctive(AND, ["o_orderkey", "o_custkey"]), "o_orderkey"),
    "q_or_in_order": lambda s, d: in_order(_indexed(s, d, "o_orderkey", "o_orderpriority").disjunctive(OR, ["o_orderkey", "o_orderpriority"]), "o_orderkey"),
    "rel_scan_in_order": lambda s, d: in_order(orders_table(s, d).query(), "o_orderkey"),
    "rel_violations_of_each_kind": lambda s, d: _broken(s, d).violations(),
    "rel_commit_outcomes": _committed,
    "rel_committed_rows": lambda s, d: committed(_batches(s, d), _committed(s, d), ORDERS),
    "index_cardinality": lambda s, d: cardinality(orders_table(s, d), "o_orderpriority"),
}
QUERIES |= {f"q_int_{op}": (lambda s, d, op=op: orders_table(s, d).query(None, [P("o_orderkey", op, 1000)])) for op in OPS}
QUERIES |= {f"q_text_{op}": (lambda s, d, op=op: orders_table(s, d).query(None, [P("o_orderpriority", op, "3-MEDIUM")])) for op in OPS}

_AND, _OR = "o_orderstatus = 'F' AND o_orderkey >= 400", "o_orderpriority = '1-URGENT' OR o_orderkey < 300 OR o_orderstatus > 'O'"
SQL = {
    "rel_scan": f"SELECT {COLUMNS} FROM orders",
    "rel_catalog": "SELECT * FROM (VALUES ('orders', 0, 'o_orderkey', 'int64', true), ('orders', 1, 'o_custkey', 'int64', false), ('orders', 2, 'o_orderstatus', 'text', false), ('orders', 3, 'o_orderpriority', 'text', false)) t(\"table\", ord, \"column\", type, is_key)",
    "rel_point": _sql("o_orderkey = 77"),
    "rel_violations": "SELECT CAST(o_orderkey AS VARCHAR) AS key, 'key used twice' AS reason FROM orders GROUP BY o_orderkey HAVING count(*) > 1",
    "rel_upsert_delete_fold": "SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 5 <> 0",
    "q_projection_all": _sql("o_orderkey <= 50"),
    "q_projection_reorder": _sql("o_orderkey <= 50", "o_orderpriority, o_orderkey"),
    "q_and": _sql(_AND, "o_orderkey, o_custkey"),
    "q_and_driver": _sql(_AND, "o_orderkey, o_custkey"),
    "q_or": _sql(_OR, "o_orderkey, o_orderpriority"),
    "q_or_index_union": _sql(_OR, "o_orderkey, o_orderpriority"),
    "q_indexed_range": _sql("o_custkey >= 20 AND o_custkey < 90"),
    "index_cardinality": "SELECT o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 1",
}
_BATCHES = """ops AS (SELECT o_orderkey // 8 AS batch, o_orderkey AS n, CASE WHEN o_orderkey % 501 = 5 THEN 'merge' WHEN o_orderkey % 6 = 1 THEN 'delete' ELSE 'upsert' END AS op, o_orderkey, o_custkey,
  CASE WHEN o_orderkey % 299 <> 3 THEN o_orderstatus END AS o_orderstatus, o_orderpriority FROM orders),
bad AS (SELECT *, CASE WHEN op = 'merge' THEN 'unknown operation' WHEN op = 'upsert' AND o_orderstatus IS NULL THEN 'null' END AS bad FROM ops),
judged AS (SELECT batch, arg_min(bad, n) FILTER (bad IS NOT NULL) AS reason FROM bad GROUP BY batch),
outc AS (SELECT batch, CASE WHEN reason IS NULL THEN row_number() OVER (PARTITION BY reason IS NULL ORDER BY batch) END AS tx_id, reason FROM judged)"""
_ORD = "row_number() OVER (ORDER BY o_orderkey) - 1 AS ord"
SQL |= {
    "q_indexed_after_commit": f"SELECT * FROM (SELECT o_orderkey, o_custkey + CASE WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE NOT (o_orderkey % 3 = 1 AND o_orderkey % 2 = 0)) WHERE o_custkey >= 20 AND o_custkey < 90",
    "q_and_in_order": _sql(_AND, f"o_orderkey, o_custkey, {_ORD}"),
    "q_or_in_order": _sql(_OR, f"o_orderkey, o_orderpriority, {_ORD}"),
    "rel_scan_in_order": f"SELECT {COLUMNS}, {_ORD} FROM orders",
    "rel_violations_of_each_kind": "SELECT CAST(o_orderkey AS VARCHAR) AS key, CASE WHEN o_orderkey % 300 = 4 THEN 'null' ELSE 'key used twice' END AS reason FROM orders WHERE o_orderkey % 300 = 4 OR o_orderkey % 400 = 6",
    "rel_commit_outcomes": f"WITH {_BATCHES} SELECT batch, tx_id, reason FROM outc",
    "rel_committed_rows": f"WITH {_BATCHES} SELECT {COLUMNS} FROM ops WHERE op = 'upsert' AND batch IN (SELECT batch FROM outc WHERE tx_id IS NOT NULL)",
}
SQL |= {f"q_int_{op}": _sql(f"o_orderkey {sign} 1000") for op, sign in OPS.items()}
SQL |= {f"q_text_{op}": _sql(f"o_orderpriority {sign} '3-MEDIUM'") for op, sign in OPS.items()}
