"""Queries over the mutation log and its runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import codec
from ..functions.codec import FNV_OFFSET, FNV_PRIME
from ..operators import contract as C
from ..operators import evidence as E
from ..operators import runs as R
from ..operators import temporal as T
from ..operators import transactions as X
from ..sources import workload as W
from ..sources.tables import events_log, read
from ..streaming import tail

MUT = """mut AS (SELECT event_id AS seq, user_id AS key, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS kind,
  CAST(round(value * 100) AS BIGINT) AS val, event_id // 10 AS tx FROM events)"""
NEWEST = "newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS rn FROM mut) WHERE rn = 1)"
LIVE = "live AS (SELECT key, seq, val FROM newest WHERE kind = 'put')"
WIDTH = 500
RUNS = f"runs AS (SELECT run_id, key, seq, kind, val FROM (SELECT *, seq // {WIDTH} AS run_id, row_number() OVER (PARTITION BY seq // {WIDTH}, key ORDER BY seq DESC) AS rn FROM mut) WHERE rn = 1)"
PREV = """prev AS (SELECT seq, key, val, kind, lag(kind) OVER w AS pk, lag(val) OVER w AS pv FROM mut WINDOW w AS (PARTITION BY key ORDER BY seq))"""
VERSIONS = "versions AS (SELECT key, kind, val, seq AS valid_from, lead(seq) OVER (PARTITION BY key ORDER BY seq) AS valid_to FROM mut)"
SIZE = "strlen(CAST(val AS VARCHAR))"

#: Fixed bounds of the range queries.
START, END, LIMIT = 20, 60, 15


def _runs(s, d):
    return R.cut(events_log(s, d).drop("tx"), WIDTH)


def _log(s, d):
    return events_log(s, d).drop("tx")


def _gets(s, d):
    """Reads at every step, over all keys from 0 to the largest."""
    events = read(s, d, "events")
    keys = events.agg(F.max("user_id") + 1).scalar()
    return events.select(F.col("event_id").alias("step"), ((F.col("user_id") * 31 + 7) % keys).alias("key"))


def _ranges(s, d):
    """A range at every step."""
    return read(s, d, "events").select(F.col("event_id").alias("step"), F.col("user_id").alias("start"), (F.col("user_id") + 10).alias("end"), F.lit(5).alias("limit"))


def _open_ranges(s, d):
    """Ranges at every step that are empty, short, or (one in 5000) without an end."""
    end = F.when(F.col("event_id") % 5000 == 1, None).otherwise(F.col("user_id") + F.col("event_id") % 9)
    return read(s, d, "events").select(F.col("event_id").alias("step"), F.col("user_id").alias("start"), end.alias("end"), F.lit(40).alias("limit"))


def _with_null_keys(s, d):
    return _log(s, d).withColumn("key", F.when(F.col("seq") % 50 != 11, F.col("key")))


def _trace_steps(s, d):
    """events as a trace: the first half is setup; every fourth of the measured steps scans a range."""
    half = read(s, d, "events").agg(F.expr("max(event_id) div 2")).scalar()
    steps = _steps(s, d).withColumn("phase", F.when(F.col("step") < half, "setup").otherwise("measured"))
    scans = (F.col("phase") == "measured") & (F.col("step") % 4 == 1)
    op = F.when(scans, "range_scan").otherwise(F.col("op"))
    own = F.col("step") - F.when(F.col("phase") == "setup", 0).otherwise(half)
    bound = lambda x: F.when(scans, x)
    return steps.select("phase", own.alias("step"), op.alias("op"), F.when(~scans, F.col("key")).alias("key"), F.when(~scans, F.col("val")).alias("val"), bound(F.col("key")).alias("start"), bound(F.col("key") + 5).alias("end"), bound(F.lit(3)).alias("limit"))


def _changed_outcomes(s, d):
    out = T.trace_outcomes(_trace_steps(s, d))
    return out.withColumn("rows", F.when((F.col("phase") == "measured") & (F.col("result") == "range") & (F.col("step") >= 100), F.concat("rows", F.lit("!"))).otherwise(F.col("rows")))


def _changed(log):
    return log.withColumn("val", F.when(F.col("seq") % 1013 == 1012, F.col("val") + 1).otherwise(F.col("val")))


def _holed(s, d):
    return _log(s, d).filter("seq % 100 <> 57")


def _observed(log):
    return T.previous_values(log).withColumnRenamed("seq", "step")


def _probes(s, d):
    """Every key of the log, and as many that are larger than all of them."""
    keys = read(s, d, "events").select(F.col("user_id").alias("key")).distinct()
    beyond = keys.agg(F.max("key") - F.min("key") + 1).scalar()
    return keys.unionByName(keys.select((F.col("key") + beyond).alias("key")))


def _reads(s, d):
    return events_log(s, d).select((F.col("tx") + 3).alias("tx"), "key", F.col("tx").alias("snapshot")).distinct()


def _steps(s, d):
    op = F.when(F.col("event_id") % 50 == 49, "reopen").when(F.col("event_type") == "error", "delete").when(F.col("event_type") == "view", "get").otherwise("put")
    val = F.round(F.col("value") * 100).cast("long")
    return read(s, d, "events").select(F.col("event_id").alias("step"), op.alias("op"), F.col("user_id").alias("key"), F.when(op == "put", val).alias("val"))


def _config(profile):
    return W.TraceConfig(0x517EED, profile, 5000, 6000, 24, 8, 70)


def _trace(s, profile):
    return W.trace(s, _config(profile))


def _number(c):
    return F.conv(F.hex(c), 16, 10).cast("long").alias(c)


def _broken_trace(s, profile):
    """A trace of which some steps are changed, missing, there twice, or too many."""
    steps = _trace(s, profile)
    measured = F.col("phase") == "measured"
    kept = steps.filter(~(measured & (F.col("step") % 1000 == 7))).withColumn("limit", F.when(measured & (F.col("step") % 1000 == 5), 999).otherwise(F.col("limit")))
    return kept.unionByName(steps.filter(measured & (F.col("step") % 1000 == 9))).unionByName(steps.filter(measured & (F.col("step") % 1000 == 11)).withColumn("step", F.col("step") + 100_000))


def _samples(s, d):
    """Timing samples of steps: a fourth without one, and one in 50 of a step that isn't measured."""
    step = F.when(F.col("event_id") % 4 != 0, F.col("event_id") + F.when(F.col("event_id") % 50 == 3, 1_000_000_000).otherwise(0))
    return read(s, d, "events").select(F.col("event_type").alias("operation"), step.alias("step"))


def _all_measured(s, d):
    return read(s, d, "events").select(F.lit("measured").alias("phase"), F.col("event_id").alias("step"))


def _range_steps(s, d):
    """Range scans of which some end before they start, and some have no end."""
    n = F.col("event_id")
    return read(s, d, "events").select(n.alias("step"), F.when(n % 3 == 0, "get").otherwise("range_scan").alias("op"), F.col("user_id").alias("start"), F.when(n % 7 == 1, F.col("user_id") - 1).when(n % 11 != 2, F.col("user_id")).alias("end"))


QUERIES = {
    "kv_outcomes": lambda s, d: T.outcomes(None, _steps(s, d)),
    "trace_point_read": lambda s, d: _trace(s, "point_read"),
    "trace_range_scan": lambda s, d: _trace(s, "range_scan"),
    "trace_sequential_write": lambda s, d: _trace(s, "sequential_write"),
    "trace_random_write": lambda s, d: _trace(s, "random_write"),
    "trace_mixed": lambda s, d: _trace(s, "mixed"),
    "workload_generate": lambda s, d: W.workload(s, 0x5EED, 1000, 19, 96, 11),
    "workload_violations": lambda s, d: W.violations(W.workload(s, 0x5EED, 1000, 19, 96, 11).withColumn("op", F.when(F.col("step") % 97 == 5, "drop").otherwise(F.col("op")))),
    "stream_windows": lambda s, d: tail.windowed_activity(read(s, d, "events")),
    "log_prefix_proof": lambda s, d: T.prefix_proof(_log(s, d), _log(s, d).agg(F.expr("max(seq) * 3 div 4")).scalar()),
    "kv_too_long": lambda s, d: C.too_long(read(s, d, "part").select(F.col("p_name").cast("binary").alias("key"), F.col("p_type").cast("binary").alias("value")), 8, 12).select(F.decode("key", "UTF-8").alias("key"), "key_bytes", "value_bytes"),
    "capability_mismatches": lambda s, d: C.mismatches(C.capabilities(s, C.LEDGERFOLD), C.capabilities(s, C.LEDGERFOLD | {"name": "other", "ordered_range": "false", "recovery": "none"}), True),
    "tx_oversized": lambda s, d: X.oversized(events_log(s, d), 9),
    "kv_fold": lambda s, d: T.fold(_log(s, d)),
    "kv_prev_value": lambda s, d: T.previous_values(_log(s, d)),
    "kv_get_asof": lambda s, d: T.get_as_of(_log(s, d), _gets(s, d)),
    "kv_range_current": lambda s, d: T.range_scan(_log(s, d), START, END, LIMIT),
    "kv_range_unbounded": lambda s, d: T.range_scan(_log(s, d), 100, None, 1000),
    "kv_range_empty": lambda s, d: T.range_scan(_log(s, d), 30, 30, 10),
    "kv_range_asof": lambda s, d: T.range_as_of(_log(s, d), _open_ranges(s, d)),
    "kv_inspect": lambda s, d: T.fold(_log(s, d)).select("key", T.value_bytes(F.col("val")).alias("value_bytes")),
    "kv_versions": lambda s, d: T.versions(_log(s, d)),
    "log_verify": lambda s, d: T.verify(_log(s, d)),
    "log_gaps": lambda s, d: T.gaps(_holed(s, d)),
    "log_compact_report": lambda s, d: T.compact_report(_log(s, d)),
    "run_point_consults": lambda s, d: R.point_consults(_runs(s, d), _probes(s, d)),
    "run_range_decoded": lambda s, d: R.range_decoded(_runs(s, d), 10, 40),
    "run_merge_visible": lambda s, d: R.visible(_runs(s, d)),
    "compaction_gc": lambda s, d: R.compaction(_runs(s, d)),
    "run_stats": lambda s, d: R.stats(_runs(s, d), 10),
    "amp_write": lambda s, d: R.write_ratio(_log(s, d), _runs(s, d)),
    "amp_space": lambda s, d: R.space_ratio(_runs(s, d)),
    "tx_batch_previous": lambda s, d: X.batch_previous(events_log(s, d)),
    "tx_row_versions": lambda s, d: X.row_versions(events_log(s, d)),
    "occ_conflicts": lambda s, d: X.conflicts(events_log(s, d), _reads(s, d)),
    "diff_first_mismatch": lambda s, d: T.first_mismatch(_observed(_log(s, d)), _observed(_changed(_log(s, d)))),
    "scalar_codec": lambda s, d: read(s, d, "customer").select(
        F.col("c_custkey").alias("id"), codec.hex_lower(F.col("c_name").cast("binary")).alias("name_hex"), F.octet_length("c_name").cast("long").alias("name_bytes"), codec.hex_lower(codec.big_endian(F.col("c_custkey"))).alias("be_hex"),
        codec.hex_lower(codec.little_endian(F.col("c_custkey"))).alias("le_hex"), codec.canonical_id(F.col("c_custkey")).alias("canonical"), F.decode(codec.unhex_strict(codec.hex_lower(F.col("c_name").cast("binary"))), "UTF-8").alias("name")),
    "scalar_crc32": lambda s, d: read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.crc32(F.col("c_name").cast("binary")).alias("crc"), codec.fnv1a64(F.col("c_name").cast("binary")).alias("fnv1a64")),
    "bench_flagship": lambda s, d: T.range_as_of(_log(s, d), _ranges(s, d)),
    "kv_prev_value_null_keys": lambda s, d: T.previous_values(_with_null_keys(s, d)),
    "trace_outcomes": lambda s, d: T.trace_outcomes(_trace_steps(s, d)),
    "trace_first_mismatch": lambda s, d: T.first_mismatch(T.trace_outcomes(_trace_steps(s, d)), _changed_outcomes(s, d)),
    "trace_range_starts": lambda s, d: _trace(s, "range_scan").filter("op = 'range_scan'").select("step", _number("start"), _number("end")),
    "trace_violations": lambda s, d: W.trace_violations(_config("range_scan"), _broken_trace(s, "range_scan")),
    "trace_requires_range": lambda s, d: W.requires_range(_trace_steps(s, d)),
    "trace_op_counts": lambda s, d: _trace(s, "range_scan").groupBy("phase", "op").agg(F.count(F.lit(1)).alias("n")),
    "sample_steps": lambda s, d: E.step_association(_samples(s, d), _all_measured(s, d)),
    "kv_range_rejections": lambda s, d: C.range_rejections(_range_steps(s, d), C.LEDGERFOLD),
    "kv_no_ranges": lambda s, d: C.range_rejections(_range_steps(s, d), C.LEDGERFOLD | {"name": "plain", "ordered_range": "false"}),
}


def _asof_sql(ranges: str, limit: int) -> str:
    return f"""WITH {MUT}, r AS ({ranges}),
hit AS (SELECT r.step, r.key, m.val, m.kind FROM r ASOF JOIN mut m ON m.key = r.key AND r.step > m.seq),
n AS (SELECT step, row_number() OVER (PARTITION BY step ORDER BY key) AS rn, key, val FROM hit WHERE kind = 'put')
SELECT step, rn, key, val FROM n WHERE rn <= {limit}"""


def _draw_sql(k: str) -> str:
    """Draw k of the traces' seed, as UBIGINT."""
    big = lambda x, by: f"CAST((CAST({x} AS UHUGEINT) * {by}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    z = f"CAST(({0x517EED}::UHUGEINT + CAST({k} + 1 AS UHUGEINT) * {W.GAMMA}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT)"
    for shift, by in ((30, W.FIRST), (27, W.SECOND)):
        z = big(f"(SELECT xor(z, z >> {shift}) FROM (SELECT {z} AS z))", by)
    return f"(SELECT xor(z, z >> 31) FROM (SELECT {z} AS z))"


TRACE_EVENTS = """st AS (SELECT event_id AS pos, CASE WHEN event_id >= h AND event_id % 4 = 1 THEN 'range_scan' WHEN event_id % 50 = 49 THEN 'reopen' WHEN event_type = 'error' THEN 'delete'
  WHEN event_type = 'view' THEN 'get' ELSE 'put' END AS op, user_id AS key, CAST(round(value * 100) AS BIGINT) AS val, h FROM events, (SELECT max(event_id) // 2 AS h FROM events)),
of_half AS (SELECT *, CASE WHEN pos - CASE WHEN pos < h THEN 0 ELSE h END >= 0 AND pos < h THEN 'setup' ELSE 'measured' END AS phase FROM st),
w AS (SELECT pos, key, op, val FROM st WHERE op IN ('put', 'delete'))"""
TRACE_OUTCOMES = TRACE_EVENTS + """,
pt AS (SELECT s.pos, w.op AS was, w.val AS old FROM (SELECT * FROM of_half WHERE op IN ('put', 'get', 'delete')) s ASOF LEFT JOIN w ON w.key = s.key AND s.pos > w.pos),
keys AS (SELECT pos, unnest(range(key, key + 5)) AS key FROM of_half WHERE op = 'range_scan'),
hit AS (SELECT keys.pos, keys.key, w.val, row_number() OVER (PARTITION BY keys.pos ORDER BY keys.key) AS rn FROM keys ASOF JOIN w ON w.key = keys.key AND keys.pos > w.pos WHERE w.op = 'put'),
rg AS (SELECT pos, string_agg(key || '=' || val, ',' ORDER BY key) AS rows FROM hit WHERE rn <= 3 GROUP BY pos),
outc AS (SELECT s.phase, s.pos - CASE WHEN s.phase = 'setup' THEN 0 ELSE s.h END AS step, CASE s.op WHEN 'range_scan' THEN 'range' WHEN 'reopen' THEN 'reopened' WHEN 'get' THEN 'value' ELSE 'previous' END AS result,
  coalesce(pt.was = 'put', false) AS present, CASE WHEN pt.was = 'put' THEN pt.old END AS val, CASE WHEN s.op = 'range_scan' THEN coalesce(rg.rows, '') END AS rows
FROM of_half s LEFT JOIN pt ON pt.pos = s.pos LEFT JOIN rg ON rg.pos = s.pos)"""
_BYTES = "list_transform(range(1, length(c_name) + 1), lambda i: CAST(ascii(c_name[i]) AS BIGINT))"
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, {_BYTES}), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, k: xor(a >> 1, 3988292384::BIGINT * (a & 1)))), 4294967295::BIGINT)"
_FNV = f"list_reduce(list_prepend({FNV_OFFSET}::UBIGINT, list_transform({_BYTES}, lambda b: CAST(b AS UBIGINT))), lambda h, b: CAST((CAST(xor(h, b) AS UHUGEINT) * {FNV_PRIME}::UHUGEINT) % 18446744073709551616::UHUGEINT AS UBIGINT))"
PROOF = "sha256(string_agg(held, chr(10) ORDER BY pos)) AS held"


SQL = {
    "kv_outcomes": """WITH st AS (SELECT event_id AS step, user_id AS key, CASE WHEN event_id % 50 = 49 THEN 'reopen' WHEN event_type = 'error' THEN 'delete' WHEN event_type = 'view' THEN 'get' ELSE 'put' END AS op,
  CAST(round(value * 100) AS BIGINT) AS v FROM events),
p AS (SELECT a.step, a.op, max(b.step) AS at FROM st a LEFT JOIN st b ON b.key = a.key AND b.step < a.step AND b.op IN ('put', 'delete') GROUP BY a.step, a.op)
SELECT p.step, CASE p.op WHEN 'reopen' THEN 'reopened' WHEN 'get' THEN 'value' ELSE 'previous' END AS result,
  p.op <> 'reopen' AND coalesce(m.op = 'put', false) AS present, CASE WHEN p.op <> 'reopen' AND m.op = 'put' THEN m.v END AS val
FROM p LEFT JOIN st m ON m.step = p.at""",
    "stream_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "kv_too_long": "SELECT p_name AS key, CAST(strlen(p_name) AS BIGINT) AS key_bytes, CAST(strlen(p_type) AS BIGINT) AS value_bytes FROM part WHERE strlen(p_name) > 8 OR strlen(p_type) > 12",
    "capability_mismatches": "SELECT 'ordered_range' AS field, 'true' AS \"left\", 'false' AS \"right\"",
    "tx_oversized": f"WITH {MUT} SELECT tx, count(*) AS n FROM mut GROUP BY tx HAVING count(*) > 9",
    "kv_fold": f"WITH {MUT}, {NEWEST}, {LIVE} SELECT key, seq, val FROM live",
    "kv_prev_value": f"WITH {MUT}, {PREV} SELECT seq, key, coalesce(pk = 'put', false) AS present, CASE WHEN pk = 'put' THEN pv END AS prev_val FROM prev",
    "kv_get_asof": f"""WITH {MUT}, {VERSIONS}, g AS (SELECT event_id AS step, (user_id * 31 + 7) % (SELECT max(user_id) + 1 FROM events) AS key FROM events)
SELECT g.step, g.key, coalesce(v.kind = 'put', false) AS present, CASE WHEN v.kind = 'put' THEN v.val END AS val
FROM g LEFT JOIN versions v ON v.key = g.key AND v.valid_from < g.step AND (v.valid_to IS NULL OR v.valid_to >= g.step)""",
    "kv_range_current": f"WITH {MUT}, {NEWEST}, {LIVE} SELECT row_number() OVER (ORDER BY key) AS ord, key, val FROM live WHERE key >= {START} AND key < {END} ORDER BY key LIMIT {LIMIT}",
    "kv_range_unbounded": f"WITH {MUT}, {NEWEST}, {LIVE} SELECT row_number() OVER (ORDER BY key) AS ord, key, val FROM live WHERE key >= 100 ORDER BY key LIMIT 1000",
    "kv_range_empty": f"WITH {MUT}, {NEWEST}, {LIVE} SELECT row_number() OVER (ORDER BY key) AS ord, key, val FROM live WHERE key >= 30 AND key < 30",
    "kv_range_asof": _asof_sql("SELECT event_id AS step, unnest(range(user_id, CASE WHEN event_id % 5000 = 1 THEN (SELECT max(user_id) + 1 FROM events) ELSE user_id + event_id % 9 END)) AS key FROM events", 40),
    "kv_inspect": f"WITH {MUT}, {NEWEST}, {LIVE} SELECT key, CAST({SIZE} AS BIGINT) AS value_bytes FROM live",
    "kv_versions": f"WITH {MUT}, {VERSIONS} SELECT key, kind, val, valid_from, valid_to FROM versions",
    "log_verify": f"WITH {MUT}, {NEWEST}, {LIVE} SELECT (SELECT count(*) FROM mut) AS record_count, (SELECT count(*) FROM live) AS live_keys, (SELECT max(seq) + 1 FROM mut) AS next_sequence",
    "log_gaps": f"WITH {MUT}, h AS (SELECT seq, lag(seq) OVER (ORDER BY seq) AS p FROM mut WHERE seq % 100 <> 57) SELECT seq FROM h WHERE p IS NOT NULL AND seq <> p + 1",
    "log_compact_report": f"""WITH {MUT}, {NEWEST}, {LIVE} SELECT (SELECT count(*) FROM mut) AS source_records, (SELECT count(*) FROM live) AS live_records,
CAST((SELECT sum({SIZE}) FROM mut WHERE kind = 'put') - (SELECT sum({SIZE}) FROM live) AS BIGINT) AS reclaimed_bytes""",
    "run_point_consults": f"""WITH {MUT}, {RUNS}, ids AS (SELECT DISTINCT run_id FROM runs), h AS (SELECT key, max(run_id) AS top FROM runs GROUP BY key),
k AS (SELECT DISTINCT key FROM mut UNION ALL SELECT DISTINCT key + (SELECT max(key) - min(key) + 1 FROM mut) FROM mut)
SELECT k.key, (SELECT count(*) FROM ids WHERE h.top IS NULL OR ids.run_id >= h.top) AS consults FROM k LEFT JOIN h ON h.key = k.key""",
    "run_range_decoded": f"WITH {MUT}, {RUNS}, {NEWEST}, {LIVE} SELECT (SELECT count(*) FROM runs WHERE key >= 10 AND key < 40) AS decoded, (SELECT count(*) FROM live WHERE key >= 10 AND key < 40) AS returned",
    "run_merge_visible": f"WITH {MUT}, {NEWEST}, {LIVE} SELECT key, seq, val FROM live",
    "compaction_gc": f"WITH {MUT}, {NEWEST} SELECT count(*) FILTER (kind = 'put') AS kept, count(*) FILTER (kind = 'delete') AS tombstones_dropped, max(seq) AS gc_watermark FROM newest",
    "run_stats": f"WITH {MUT}, {RUNS} SELECT CAST(CASE WHEN run_id >= 10 THEN 0 ELSE 1 END AS BIGINT) AS level, count(DISTINCT run_id) AS runs, count(*) AS entries FROM runs GROUP BY 1",
    "amp_write": f"""WITH {MUT}, {RUNS}, a AS (SELECT CAST(sum(8 + CASE WHEN kind = 'put' THEN {SIZE} ELSE 0 END) AS BIGINT) AS n FROM mut), b AS (SELECT CAST(sum(8 + CASE WHEN kind = 'put' THEN {SIZE} ELSE 0 END) AS BIGINT) AS n FROM runs)
SELECT a.n + b.n AS numerator, a.n AS denominator, 'byte' AS unit FROM a, b""",
    "amp_space": f"""WITH {MUT}, {RUNS}, {NEWEST}, {LIVE} SELECT CAST((SELECT sum(8 + CASE WHEN kind = 'put' THEN {SIZE} ELSE 0 END) FROM runs) AS BIGINT) AS numerator, CAST((SELECT sum(8 + {SIZE}) FROM live) AS BIGINT) AS denominator, 'byte' AS unit""",
    "tx_batch_previous": f"""WITH {MUT}, p AS (SELECT tx, seq, key, lag(kind) OVER w AS pk, lag(val) OVER w AS pv FROM mut WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT tx, seq, key, coalesce(pk = 'put', false) AS present, CASE WHEN pk = 'put' THEN pv END AS prev_val FROM p""",
    "tx_row_versions": f"WITH {MUT} SELECT key, max(tx) AS version FROM mut GROUP BY key",
    "occ_conflicts": f"""WITH {MUT}, r AS (SELECT DISTINCT tx + 3 AS tx, key, tx AS snapshot FROM mut)
SELECT r.tx, r.key, max(m.tx) AS version FROM r JOIN mut m ON m.key = r.key AND m.tx > r.snapshot AND m.tx < r.tx GROUP BY r.tx, r.key""",
    "diff_first_mismatch": f"""WITH {MUT}, other AS (SELECT seq, key, kind, CASE WHEN seq % 1013 = 1012 THEN val + 1 ELSE val END AS val FROM mut),
a AS (SELECT seq, lag(kind) OVER w AS k, lag(val) OVER w AS v FROM mut WINDOW w AS (PARTITION BY key ORDER BY seq)),
b AS (SELECT seq, lag(kind) OVER w AS k, lag(val) OVER w AS v FROM other WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT min(a.seq) AS step FROM a JOIN b ON a.seq = b.seq WHERE coalesce(a.k, 'delete') = 'put' AND a.v <> b.v HAVING min(a.seq) IS NOT NULL""",
    "scalar_codec": """SELECT c_custkey AS id, lower(hex(c_name)) AS name_hex, CAST(strlen(c_name) AS BIGINT) AS name_bytes, lower(printf('%016x', c_custkey)) AS be_hex,
substr(printf('%08x', c_custkey), 7, 2) || substr(printf('%08x', c_custkey), 5, 2) || substr(printf('%08x', c_custkey), 3, 2) || substr(printf('%08x', c_custkey), 1, 2) AS le_hex,
lpad(CAST(c_custkey AS VARCHAR), 20, '0') AS canonical, c_name AS name FROM customer""",
    "bench_flagship": _asof_sql("SELECT event_id AS step, unnest(range(user_id, user_id + 10)) AS key FROM events", 5),
    "kv_prev_value_null_keys": f"""WITH {MUT}, m AS (SELECT seq, CASE WHEN seq % 50 <> 11 THEN key END AS key, kind, val FROM mut), p AS (SELECT seq, key, lag(kind) OVER w AS pk, lag(val) OVER w AS pv FROM m WINDOW w AS (PARTITION BY key ORDER BY seq))
SELECT seq, key, coalesce(pk = 'put', false) AS present, CASE WHEN pk = 'put' THEN pv END AS prev_val FROM p""",
    "log_prefix_proof": f"""WITH {MUT}, b AS (SELECT max(seq) * 3 // 4 AS b FROM mut), p AS (SELECT mut.* FROM mut, b WHERE seq < b),
h0 AS (SELECT seq AS pos, seq || '|' || coalesce(CAST(key AS VARCHAR), '-') || '|' || kind || '|' || coalesce(CAST(val AS VARCHAR), '-') AS held FROM p),
h1 AS (SELECT pos // 4096 AS pos, {PROOF} FROM h0 GROUP BY 1), h2 AS (SELECT pos // 4096 AS pos, {PROOF} FROM h1 GROUP BY 1), h3 AS (SELECT pos // 4096 AS pos, {PROOF} FROM h2 GROUP BY 1)
SELECT (SELECT count(*) FROM p) AS record_count, (SELECT max(seq) + 1 FROM p) AS next_sequence, (SELECT sha256(string_agg(held, chr(10) ORDER BY pos)) FROM h3) AS digest""",
    "trace_outcomes": f"WITH {TRACE_OUTCOMES} SELECT phase, step, result, present, val, rows FROM outc",
    "trace_first_mismatch": f"WITH {TRACE_OUTCOMES} SELECT 'measured' AS phase, min(step) AS step FROM outc WHERE phase = 'measured' AND result = 'range' AND step >= 100 HAVING min(step) IS NOT NULL",
    "trace_range_starts": f"WITH k AS (SELECT k, CAST({_draw_sql('k + 18000')} % 6000 AS BIGINT) AS start FROM range(5000) t(k)) SELECT k + k // 70 AS step, start, least(start + 8, 6000) AS \"end\" FROM k",
    "trace_violations": """WITH k AS (SELECT k, 'measured' AS phase FROM range(5000 + 5000 // 70) t(k))
SELECT phase, k AS step, CASE k % 1000 WHEN 5 THEN 'differs' WHEN 7 THEN 'missing' ELSE 'used twice' END AS reason FROM k WHERE k % 1000 IN (5, 7, 9)
UNION ALL SELECT phase, k + 100000, 'additional' FROM k WHERE k % 1000 = 11""",
    "trace_requires_range": f"WITH {TRACE_EVENTS} SELECT count(*) FILTER (op = 'range_scan') > 0 AS requires_range FROM of_half",
    "trace_op_counts": "SELECT * FROM (VALUES ('setup', 'put', 6000::BIGINT), ('measured', 'range_scan', 5000), ('measured', 'reopen', 5000 // 70)) t(phase, op, n)",
    "scalar_crc32": f"SELECT c_custkey AS id, {_CRC} AS crc, lpad(lower(to_hex({_FNV})), 16, '0') AS fnv1a64 FROM customer",
    "workload_violations": "SELECT k AS step, 'unknown operation' AS reason FROM range(1000 + 1000 // 11) t(k) WHERE k % 97 = 5",
    "sample_steps": "SELECT event_type AS operation, count(*) FILTER (event_id % 4 <> 0 AND event_id % 50 <> 3) AS measured, count(*) FILTER (event_id % 4 = 0) AS without_step, count(*) FILTER (event_id % 4 <> 0 AND event_id % 50 = 3) AS unknown_step FROM events GROUP BY 1",
    "kv_range_rejections": "SELECT event_id AS step, 'range end is before its start' AS reason FROM events WHERE event_id % 3 <> 0 AND event_id % 7 = 1",
    "kv_no_ranges": "SELECT event_id AS step, 'engine plain does not expose ordered range scans' AS reason FROM events WHERE event_id % 3 <> 0",
}
