"""Queries over ledgers, sidecars, timings and generation listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import generations as G
from ..sources.tables import ledger, listing, read, sidecars, timings

SEED = 5
LEDGER = """ledger AS (SELECT event_id AS pair_index, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'excluded' ELSE 'included' END AS disposition,
  xor(1, event_id & 1) AS pair_order, CAST(round(value * 100) AS BIGINT) AS first FROM events)"""
SIDECARS = """sidecars AS (SELECT pair_index, pair_index % 2 AS repetition FROM ledger WHERE disposition = 'failed' AND pair_index % 2 = 0
  UNION ALL SELECT pair_index, 1 FROM ledger WHERE disposition = 'failed' AND pair_index % 40 = 0
  UNION ALL SELECT pair_index + 1000000000, 0 FROM ledger WHERE pair_index % 50 = 0)"""
TIMINGS = """timings AS (SELECT event_type AS operation, user_id % 2 AS side, event_id % 2 AS "order", CAST(round(value * 100) AS BIGINT) AS duration,
  event_id % 3 = 0 AS no_work, event_id % 4 = 0 AS no_step FROM events)"""
LISTING = """listing AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'marker' WHEN 'O' THEN 'staging' ELSE 'reserved' END AS kind FROM orders
  UNION ALL SELECT o_orderkey, 'log' FROM orders WHERE o_orderkey % 11 <> 0)"""
DIST = "count(*) AS samples, min(duration) AS min, CAST(quantile_disc(duration, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(duration, 0.95) AS BIGINT) AS p95, max(duration) AS max"


def _names(s, d):
    return read(s, d, "orders").select(F.concat(F.when(F.col("o_orderkey") % 17 == 0, F.lit("x")).otherwise(F.lit("")), F.lpad(F.col("o_orderkey").cast("string"), 20, "0"), F.lit(".log")).alias("name"))


def _versions(s, d):
    n = F.col("event_id")
    durable = n * 200 - F.when(n % 500 == 3, 400).otherwise(0)
    gc = durable - F.col("user_id") + F.when(n % 700 == 5, 1000).otherwise(0)
    return read(s, d, "events").select(n.alias("version"), durable.alias("durable"), gc.alias("gc"), (n % 4).alias("fresh"), F.when(n % 332 == 0, 2).when(n % 8 == 0, 0).otherwise(1).alias("merged"))


def _failed(s, d):
    """Failed pairs' sidecars: some completed their first repetition, and each failed after a prefix of up to two."""
    pairs, n = ledger(s, d).filter("disposition = 'failed'"), F.col("pair_index")
    done = lambda k: F.struct(F.lit("put").alias("operation"), (F.col("first") + k).alias("duration"))
    return pairs.select(
        "pair_index", F.when(n % 2 == 0, F.array(done(0), done(1))).alias("completed_first"), F.slice(F.array(done(10), done(20)), 1, (n % 3).cast("int")).alias("failing_prefix"),
        F.when(n % 5 != 0, F.struct(F.lit("get").alias("operation"), F.col("first").alias("duration"), F.lit("io").alias("error_class"))).alias("failure"),
    )


def _declared(s, d):
    """The ledger's numbers, one of them wrong, and a disposition that no pair has."""
    right = E.ledger_counts(ledger(s, d)).select("disposition", (F.col("n") + F.when(F.col("disposition") == "failed", 2).otherwise(0)).alias("declared"))
    return right.unionByName(s.createDataFrame([("lost", 3)], "disposition string, declared long"))


def _labelled(s, d):
    n = F.col("event_id")
    return read(s, d, "events").select(F.when(n % 3 != 0, F.when(n % 2 == 0, "page").otherwise("byte")).alias("unit"), F.when(F.col("event_type") == "error", F.when(n % 4 == 0, "corruption").otherwise("io")).alias("error_class"))


def _projections(s, d):
    """Durations and samples of a hundred events each, of which some differ and every tenth list lacks its last sample."""
    val = F.round(F.col("value") * 100).cast("long")
    seen = F.struct(F.col("event_id").alias("at"), val.alias("plain"), (val + F.when(F.col("event_id") % 97 == 5, 1).otherwise(0)).alias("duration"))
    lists = read(s, d, "events").groupBy(F.expr("event_id div 100").alias("id")).agg(F.array_sort(F.collect_list(seen)).alias("x"))
    samples = F.transform("x", lambda x: F.struct(x["duration"].alias("duration")))
    return lists.select("id", F.col("x.plain").alias("durations"), F.when(F.col("id") % 10 == 3, F.slice(samples, F.lit(1), F.size("x") - 1)).otherwise(samples).alias("samples"))


def _broken_ledger(s, d):
    """Pairs that are there twice, missing, of no known disposition, or included without a duration."""
    pairs, n = ledger(s, d), F.col("pair_index")
    own = pairs.filter(n % 300 != 7).withColumn("disposition", F.when(n % 300 == 9, "lost").otherwise(F.col("disposition"))).withColumn("second", F.when(n % 300 != 11, F.col("second")))
    return own.unionByName(pairs.filter(n % 300 == 13))


def _listing_ahead(s, d):
    """The listing with markers in its first half alone, so that logs are ahead of the newest one."""
    rows = listing(s, d)
    half = rows.agg(F.expr("max(id) div 2")).scalar()
    return rows.filter(~((F.col("kind") == "marker") & (F.col("id") > half)))


QUERIES = {
    "declared_mismatches": lambda s, d: E.declared_mismatches(ledger(s, d), _declared(s, d)),
    "label_counts": lambda s, d: E.label_counts(_labelled(s, d), ["unit", "error_class"]),
    "failed_pair_evidence": lambda s, d: E.failed_pair_evidence(_failed(s, d)),
    "projection_mismatches": lambda s, d: E.projection_mismatches(_projections(s, d)).withColumn("place", F.col("place").cast("long")),
    "ledger_violations_of_each_kind": lambda s, d: E.ledger_violations(_broken_ledger(s, d), 1),
    "gen_orphans_ahead": lambda s, d: G.orphans(_listing_ahead(s, d)),
    "manifest_violations": lambda s, d: G.manifest_violations(_versions(s, d)),
    "ledger_counts": lambda s, d: E.ledger_counts(ledger(s, d)),
    "ledger_order": lambda s, d: E.expected_order(ledger(s, d), SEED),
    "ledger_violations": lambda s, d: E.ledger_violations(ledger(s, d), SEED + 1),
    "ledger_complete_pairs": lambda s, d: E.complete_pairs(ledger(s, d)).withColumn("repetition", F.col("repetition").cast("long")),
    "sidecar_join": lambda s, d: E.sidecar_join(ledger(s, d), sidecars(s, d)),
    "sidecar_dangling": lambda s, d: E.sidecar_dangling(ledger(s, d), sidecars(s, d)),
    "sidecar_duplicates": lambda s, d: E.sidecar_duplicates(sidecars(s, d)),
    "dist_nearest_rank": lambda s, d: E.distribution(timings(s, d), ["operation"]),
    "dist_stratified": lambda s, d: E.stratified(timings(s, d)),
    "category_counts": lambda s, d: E.category_counts(timings(s, d)),
    "gen_authority": lambda s, d: G.authority(listing(s, d)),
    "gen_uncommitted": lambda s, d: G.uncommitted(listing(s, d)),
    "gen_obsolete": lambda s, d: G.obsolete(listing(s, d)),
    "gen_orphans": lambda s, d: G.orphans(listing(s, d)),
    "gen_next_id": lambda s, d: G.next_id(listing(s, d)),
    "gen_unknown_entries": lambda s, d: G.unknown_entries(_names(s, d)),
}

SQL = {
    "failed_pair_evidence": f"""WITH {LEDGER}, f AS (SELECT pair_index AS n, first FROM ledger WHERE disposition = 'failed')
SELECT 'completed_first' AS selection, n AS pair_index, k AS place, 'put' AS operation, first + k AS duration, NULL AS error_class FROM f, range(2) t(k) WHERE n % 2 = 0
UNION ALL SELECT 'failing_prefix', n, k, 'put', first + 10 + 10 * k, NULL FROM f, range(2) t(k) WHERE k < n % 3
UNION ALL SELECT 'failure', n, 0, 'get', first, 'io' FROM f WHERE n % 5 <> 0""",
    "declared_mismatches": f"WITH {LEDGER} SELECT 'failed' AS disposition, count(*) + 2 AS declared, count(*) AS found FROM ledger WHERE disposition = 'failed' UNION ALL SELECT 'lost', 3, 0",
    "label_counts": """WITH e AS (SELECT CASE WHEN event_id % 3 <> 0 THEN CASE WHEN event_id % 2 = 0 THEN 'page' ELSE 'byte' END END AS unit, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 4 = 0 THEN 'corruption' ELSE 'io' END END AS error_class FROM events)
SELECT 'unit' AS label, unit AS value, count(*) AS n FROM e GROUP BY unit UNION ALL SELECT 'error_class', error_class, count(*) FROM e GROUP BY error_class""",
    "projection_mismatches": """WITH e AS (SELECT event_id, event_id // 100 AS id, row_number() OVER (PARTITION BY event_id // 100 ORDER BY event_id) - 1 AS place, count(*) OVER (PARTITION BY event_id // 100) AS n FROM events)
SELECT id, place FROM e WHERE event_id % 97 = 5 OR (id % 10 = 3 AND place = n - 1)""",
    "ledger_violations_of_each_kind": f"""WITH {LEDGER}, n AS (SELECT max(pair_index) AS top FROM ledger)
SELECT pair_index, CASE pair_index % 300 WHEN 9 THEN 'disposition' WHEN 11 THEN 'fields' WHEN 13 THEN 'used twice' ELSE 'hole before' END AS reason FROM ledger
WHERE pair_index % 300 IN (8, 9, 13) OR (pair_index % 300 = 11 AND disposition = 'included')""",
    "gen_orphans_ahead": f"WITH {LISTING}, h AS (SELECT max(id) // 2 AS h FROM listing), m AS (SELECT max(id) AS top FROM listing, h WHERE kind = 'marker' AND id <= h) SELECT id FROM listing, m WHERE kind = 'log' AND id > top AND id IN (SELECT id FROM listing WHERE kind = 'reserved')",
    "manifest_violations": """WITH v AS (SELECT event_id AS n, event_id * 200 - CASE WHEN event_id % 500 = 3 THEN 400 ELSE 0 END AS durable, user_id,
  event_id % 4 AS fresh, CASE WHEN event_id % 332 = 0 THEN 2 WHEN event_id % 8 = 0 THEN 0 ELSE 1 END AS merged FROM events),
w AS (SELECT n, durable, durable - user_id + CASE WHEN n % 700 = 5 THEN 1000 ELSE 0 END AS gc, fresh, merged, lag(durable) OVER (ORDER BY n) AS earlier FROM v),
r AS (SELECT n AS version, CASE WHEN gc > durable THEN 'gc passes durable' WHEN durable <= earlier THEN 'durable doesn''t grow' WHEN merged > 1 THEN 'two merged runs'
  WHEN fresh + merged = 0 AND gc <> durable THEN 'no runs' END AS reason FROM w)
SELECT version, reason FROM r WHERE reason IS NOT NULL""",
    "ledger_counts": f"WITH {LEDGER} SELECT disposition, count(*) AS n FROM ledger GROUP BY 1",
    "ledger_order": f"WITH {LEDGER} SELECT pair_index, xor({SEED} & 1, pair_index & 1) AS pair_order FROM ledger",
    "ledger_violations": f"WITH {LEDGER} SELECT pair_index, 'order' AS reason FROM ledger WHERE pair_order <> xor({SEED + 1} & 1, pair_index & 1)",
    "ledger_complete_pairs": f"WITH {LEDGER} SELECT pair_index, CAST(r AS BIGINT) AS repetition, first + r AS duration FROM ledger, (VALUES (0), (1)) t(r) WHERE disposition = 'included'",
    "sidecar_join": f"WITH {LEDGER}, {SIDECARS} SELECT s.pair_index, CAST(s.repetition AS BIGINT) AS repetition FROM sidecars s JOIN ledger l ON l.pair_index = s.pair_index AND l.disposition = 'failed'",
    "sidecar_dangling": f"WITH {LEDGER}, {SIDECARS} SELECT pair_index FROM sidecars WHERE pair_index NOT IN (SELECT pair_index FROM ledger WHERE disposition = 'failed')",
    "sidecar_duplicates": f"WITH {LEDGER}, {SIDECARS} SELECT pair_index, count(*) AS n FROM sidecars GROUP BY 1 HAVING count(*) > 1",
    "dist_nearest_rank": f"WITH {TIMINGS} SELECT operation, {DIST} FROM timings GROUP BY operation",
    "dist_stratified": f'WITH {TIMINGS} SELECT side, operation, "order", {DIST} FROM timings GROUP BY GROUPING SETS ((side, operation), (side, operation, "order"))',
    "category_counts": f"WITH {TIMINGS} SELECT operation, count(*) AS samples, count(*) FILTER (no_work) AS missing_work, count(*) FILTER (no_step) AS missing_step FROM timings GROUP BY 1",
    "gen_authority": f"WITH {LISTING}, m AS (SELECT max(id) AS id FROM listing WHERE kind = 'marker') SELECT id, id IN (SELECT id FROM listing WHERE kind = 'log') AS has_log FROM m",
    "gen_uncommitted": f"WITH {LISTING} SELECT id FROM listing WHERE kind = 'log' AND id NOT IN (SELECT id FROM listing WHERE kind = 'marker')",
    "gen_obsolete": f"WITH {LISTING}, m AS (SELECT max(id) AS top FROM listing WHERE kind = 'marker') SELECT id, kind FROM listing, m WHERE (kind IN ('log', 'marker') AND id < top) OR (kind = 'staging' AND id <= top)",
    "gen_orphans": f"WITH {LISTING}, m AS (SELECT max(id) AS top FROM listing WHERE kind = 'marker') SELECT id FROM listing, m WHERE kind = 'log' AND id > top AND id IN (SELECT id FROM listing WHERE kind = 'reserved')",
    "gen_next_id": f"WITH {LISTING} SELECT max(id) + 1 AS next_id FROM listing",
    "gen_unknown_entries": "SELECT 'x' || lpad(CAST(o_orderkey AS VARCHAR), 20, '0') || '.log' AS name FROM orders WHERE o_orderkey % 17 = 0",
}
