"""A mutation log seen as versions in time: current state, previous values, reads as of a step, ranges.

A log has the columns seq (long, unique), key, kind ('put' or 'delete') and val. Nothing is replayed: each operator
computes what every step observes at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidInput

#: How many steps a window over one key spans at most.
SLICE = 1 << 20
#: Sequence numbers in a slice of prefix_proof, and slices in a slice of slices, twice; 2 ** 44 rows leave 2 ** 8 of them.
PROOF_SLICES = (1 << 12, 1 << 12, 1 << 12)


def newest(log: DataFrame, *keys: str) -> DataFrame:
    """Each key's last mutation, tombstones included. Partial aggregates make a hot key cheap."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("seq")).alias("last")).select(*keys, "last.*")


def fold(log: DataFrame) -> DataFrame:
    """Live rows after last-writer-wins: key, seq, val."""
    return newest(log, "key").filter("kind = 'put'").select("key", "seq", "val")


def last_before(rows: DataFrame, key: str, order: str, payload: Column, name: str, slice_rows: int = SLICE) -> DataFrame:
    """rows with `name`: the payload of the key's latest earlier row (by the unique long `order`) whose payload isn't null.
    A null key is a key like any other.

    A window over a whole key would put a hot key into one task. Windows here span (key, slice of order), which has
    slice_rows rows at most; what a slice begins with comes from the slices' last payloads, as a row before its first.
    """
    sliced = rows.withColumn("__payload", payload).withColumn("__slice", F.expr(f"`{order}` div {slice_rows}")).withColumn("__first", F.lit(False))
    # Rows without a payload have no order here, so a slice of such rows alone is there with a null.
    ends = sliced.groupBy(key, "__slice").agg(F.max_by("__payload", F.when(F.col("__payload").isNotNull(), F.col(order))).alias("__end"))
    across = Window.partitionBy(key).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("__carried", F.last("__end", ignorenulls=True).over(across)).filter(F.col("__carried").isNotNull())
    none = [F.col(c) if c == key else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns]
    firsts = carried.select(*none, F.col("__carried").alias("__payload"), "__slice", F.lit(True).alias("__first"))
    within = Window.partitionBy(key, "__slice").orderBy(F.asc_nulls_first(order)).rowsBetween(Window.unboundedPreceding, -1)
    found = sliced.unionByName(firsts).withColumn(name, F.last("__payload", ignorenulls=True).over(within))
    return found.filter(~F.col("__first")).select(*rows.columns, name)


def ranked(rows: DataFrame, column: str, slice_ids: int = SLICE, descending: bool = False) -> DataFrame:
    """rows with __rank: the place (from 0) of each among all, by a distinct long. Rows are ranked within slices of
    slice_ids values, and the slices' counts are added up, so no task sees all rows: one window has a row for each slice."""
    by = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    sliced = rows.withColumn("__slice", F.expr(f"`{column}` div {slice_ids}"))
    counted = sliced.groupBy("__slice").agg(F.count(F.lit(1)).alias("__n"))
    above = Window.orderBy(by("__slice")).rowsBetween(Window.unboundedPreceding, -1)
    before = counted.select("__slice", F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__slice").orderBy(by(column))) - 1
    return sliced.withColumn("__own", own).join(before, "__slice").select(*rows.columns, (F.col("__own") + F.col("__before")).alias("__rank"))


def previous_values(log: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """What each mutation replaces: seq, key, present, prev_val. Missing (present is false) is not an empty value."""
    found = last_before(log, "key", "seq", F.struct("kind", "val"), "__last", slice_rows)
    return found.select("seq", "key", *_observed("__last", "prev_val"))


def _observed(last: str, name: str) -> list[Column]:
    present = F.coalesce(F.col(last)["kind"] == "put", F.lit(False))
    return [present.alias("present"), F.when(present, F.col(last)["val"]).alias(name)]


def get_as_of(log: DataFrame, gets: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """Reads (step, key) as of their steps, before a mutation of the same step: step, key, present, val. One shuffle
    of both sides together and no join of versions with reads."""
    reads = gets.select((F.col("step") * 2).alias("at"), "key", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("long").alias("val"))
    both = log.select((F.col("seq") * 2 + 1).alias("at"), "key", "kind", "val").unionByName(reads)
    found = last_before(both, "key", "at", F.when(F.col("kind").isNotNull(), F.struct("kind", "val")), "__last", slice_rows)
    return found.filter("kind IS NULL").select(F.expr("at div 2").alias("step"), "key", *_observed("__last", "val"))


def check_range(start, end, limit: int) -> None:
    if end is not None and end < start:
        raise InvalidInput("range end is before its start")
    if limit < 0:
        raise InvalidInput("a limit can't be negative")


def range_scan(log: DataFrame, start, end, limit: int) -> DataFrame:
    """Live rows with start <= key < end (None: no end), the first `limit` by key: ord, key, val."""
    check_range(start, end, limit)
    inside = F.col("key") >= F.lit(start)
    if end is not None:
        inside &= F.col("key") < F.lit(end)
    first = fold(log.filter(inside)).orderBy("key").limit(limit)
    return first.select(F.row_number().over(Window.orderBy("key")).cast("long").alias("ord"), "key", "val")  # `limit` rows


def versions(log: DataFrame) -> DataFrame:
    """Each mutation with the steps that see it: after valid_from, up to and with valid_to (null: still).

    Its successor is found as its predecessor would be, in the log turned around, so a hot key is sliced too.
    """
    turned = log.withColumn("__back", -F.col("seq"))
    found = last_before(turned, "key", "__back", F.col("seq"), "valid_to")
    return found.select("key", "kind", "val", F.col("seq").alias("valid_from"), "valid_to")


def _levels(length: Column) -> Column:
    """A level that the blocks of a range of that length don't exceed."""
    return F.ceil(F.log2(length)).cast("int")


def _blocks_of_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges (step, start, end, limit) as dyadic blocks: level, block (the keys from block * 2 ** level on, 2 ** level of
    them). A range is at most two blocks a level, however long it is."""
    spread = ranges.withColumn("__l", F.explode(F.sequence(F.lit(0), _levels(F.col("end") - F.col("start")))))
    spread = spread.withColumn("__first", -F.expr("shiftright(-start, __l)")).withColumn("__stop", F.expr("shiftright(`end`, __l)")).filter("__first < __stop")
    odd = lambda c: F.pmod(F.col(c), F.lit(2)) == 1
    blocks = F.array_compact(F.array(F.when(odd("__first"), F.col("__first")), F.when(odd("__stop"), F.col("__stop") - 1)))
    return spread.select("step", "limit", F.col("__l").alias("level"), F.explode(blocks).alias("block"))


def range_as_of(log: DataFrame, ranges: DataFrame, slice_rows: int = SLICE) -> DataFrame:
    """Range reads (step, start, end, limit) as of their steps, before a mutation of the same step: step, rn, key, val.

    Keys are longs between -2 ** 61 and 2 ** 61; a null key is in no range. A null start or end is no bound. Ranges are cut
    into dyadic blocks and meet the distinct keys by equality on these, each key in the one block of a level that holds
    it: no cross join, nothing beside the matching pairs, and a long range is few blocks. Each key is then read as of the
    step as get_as_of does. The best `limit` rows of a step are kept by a window over that step's rows alone.
    """
    keys = log.select("key").filter("key IS NOT NULL").distinct()
    least, most = (F.coalesce(log.agg(f("key")).scalar(), F.lit(0)) for f in (F.min, F.max))
    # Bounds beyond the keys are drawn in, so that no level above the keys' own spread is needed.
    bounded = ranges.withColumn("start", F.greatest(F.coalesce("start", least), least)).withColumn("end", F.least(F.coalesce("end", most + 1), most + 1))
    bounded = bounded.filter("start < `end` AND limit > 0")
    asked = _blocks_of_ranges(bounded)
    top = F.coalesce(bounded.agg(_levels(F.max(F.col("end") - F.col("start")))).scalar(), F.lit(0))
    in_blocks = keys.withColumn("level", F.explode(F.sequence(F.lit(0), top))).withColumn("block", F.expr("shiftright(key, level)"))
    pairs = asked.join(in_blocks, ["level", "block"])
    val = log.schema["val"].dataType
    reads = pairs.select((F.col("step") * 2).alias("at"), "key", F.lit(None).cast("string").alias("kind"), F.lit(None).cast(val).alias("val"), "limit")
    both = log.filter("key IS NOT NULL").select((F.col("seq") * 2 + 1).alias("at"), "key", "kind", "val", F.lit(None).cast(ranges.schema["limit"].dataType).alias("limit")).unionByName(reads)
    seen = last_before(both, "key", "at", F.when(F.col("kind").isNotNull(), F.struct("kind", "val")), "__last", slice_rows)
    found = seen.filter((F.col("kind").isNull()) & (F.col("__last")["kind"] == "put")).select(F.expr("at div 2").alias("step"), "key", F.col("__last")["val"].alias("val"), "limit")
    rn = F.row_number().over(Window.partitionBy("step").orderBy("key")).cast("long")
    return found.withColumn("rn", rn).filter(F.col("rn") <= F.col("limit")).select("step", "rn", "key", "val")


def outcomes(log: DataFrame, steps: DataFrame) -> DataFrame:
    """What every step of a workload (step, op, key, val) observes: step, result, present, val.

    put, delete: the previous value; get: the current one; reopen changes nothing. log is what was there before.
    """
    before = log.select((F.col("seq") - log.agg(F.max("seq") + 1).scalar()).alias("step"), "key", "kind", "val") if log is not None else None
    own = steps.filter("op <> 'reopen'").select("step", "op", "key", "val", F.when(F.col("op").isin("put", "delete"), F.col("op")).alias("kind"))
    if before is not None:
        own = own.unionByName(before.select("step", F.lit(None).cast("string").alias("op"), "key", "val", "kind"))
    found = last_before(own, "key", "step", F.when(F.col("kind").isNotNull(), F.struct("kind", "val")), "__last").filter("op IS NOT NULL")
    result = F.when(F.col("op") == "get", F.lit("value")).otherwise(F.lit("previous"))
    points = found.select("step", result.alias("result"), *_observed("__last", "val"))
    reopened = steps.filter("op = 'reopen'").select("step", F.lit("reopened").alias("result"), F.lit(False).alias("present"), F.lit(None).cast(steps.schema["val"].dataType).alias("val"))
    return points.unionByName(reopened)


def first_mismatch(left: DataFrame, right: DataFrame) -> DataFrame:
    """The first step whose outcomes (step, present, prev_val) differ or exist on one side only: one row, or none. With
    a column phase, setup comes before measured: phase, step."""
    keys = [c for c in ("phase", "step") if c in left.columns]
    values = [c for c in left.columns if c not in keys]
    a = left.select(*keys, F.struct(*values).alias("a"))
    b = right.select(*keys, F.struct(*values).alias("b"))
    unlike = a.join(b, keys, "full").filter(~F.col("a").eqNullSafe(F.col("b")))
    if keys == ["step"]:
        return unlike.agg(F.min("step").alias("step")).filter("step IS NOT NULL")
    first = unlike.agg(F.min(F.struct((F.col("phase") != "setup").alias("later"), "step", "phase")).alias("first"))
    return first.filter("first IS NOT NULL").select("first.phase", "first.step")


def trace_outcomes(steps: DataFrame) -> DataFrame:
    """What every step of a trace (phase, step, op, key, val, start, end, limit) observes, setup before measured: phase,
    step, result, present, val, rows. rows are a range scan's, as key=val in key order; other steps have none."""
    setup = F.coalesce(steps.filter("phase = 'setup'").agg(F.max("step") + 1).scalar(), F.lit(0))
    at = F.col("step") + F.when(F.col("phase") == "setup", 0).otherwise(setup)
    own = steps.withColumn("own", F.col("step")).withColumn("step", at)
    points = outcomes(None, own.filter("op <> 'range_scan'").select("step", "op", "key", "val")).withColumn("rows", F.lit(None).cast("string"))
    log = own.filter("op IN ('put', 'delete')").select(F.col("step").alias("seq"), "key", F.col("op").alias("kind"), "val")
    ranges = own.filter("op = 'range_scan'").select("step", "start", "end", "limit")
    found = range_as_of(log, ranges).groupBy("step").agg(F.array_sort(F.collect_list(F.struct("rn", "key", "val"))).alias("found"))  # `limit` rows a step
    listed = F.array_join(F.transform("found", lambda x: F.concat(x["key"].cast("string"), F.lit("="), F.coalesce(x["val"].cast("string"), F.lit("-")))), ",")
    scans = ranges.join(found, "step", "left").select("step", F.lit("range").alias("result"), F.lit(False).alias("present"), F.lit(None).cast(log.schema["val"].dataType).alias("val"), F.coalesce(listed, F.lit("")).alias("rows"))
    return own.select("phase", "own", "step").join(points.unionByName(scans), "step").select("phase", F.col("own").alias("step"), "result", "present", "val", "rows")


def gaps(log: DataFrame) -> DataFrame:
    """Sequence numbers that don't follow another one, but for the first: seq. A join by equality, no global order."""
    follows = log.select((F.col("seq") + 1).alias("seq")).unionByName(log.agg(F.min("seq").alias("seq")))
    return log.select("seq").join(follows, "seq", "left_anti")


def verify(log: DataFrame) -> DataFrame:
    """record_count, live_keys, next_sequence of a log."""
    per_key = log.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max_by("kind", "seq").alias("kind"), F.max("seq").alias("seq"))
    live = F.count_if(F.col("kind") == "put")
    return per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("record_count"), live.alias("live_keys"), (F.max("seq") + 1).alias("next_sequence"))


def prefix_proof(log: DataFrame, next_sequence: int | Column) -> DataFrame:
    """What a log held before a sequence number: record_count, next_sequence, digest. Two logs agree on that prefix if the
    three do.

    The digest is SHA-256 over the rows in order, by slices: of PROOF_SLICES[0] sequence numbers, then of so many slices,
    then of all. No task holds more than a slice's rows or digests.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    prefix = log.filter(F.col("seq") < next_sequence)
    rows = prefix.select(F.col("seq").alias("at"), F.concat_ws("|", *map(text, ("seq", "key", "kind", "val"))).alias("held"))
    counts = prefix.agg(F.count(F.lit(1)).alias("record_count"), (F.max("seq") + 1).alias("next_sequence"))
    for size in PROOF_SLICES:
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("at", "held"))), lambda x: x["held"])
        by_slice = rows.groupBy(F.expr(f"at div {size}").alias("at")).agg(F.array_join(ordered, "\n").alias("held"))
        rows = by_slice.select("at", F.sha2("held", 256).alias("held"))
    whole = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "held"))), lambda x: x["held"]), "\n").alias("held"))
    return counts.select("record_count", "next_sequence", F.lit(whole.select(F.sha2("held", 256)).scalar()).alias("digest"))


def value_bytes(val: Column) -> Column:
    return F.octet_length(val.cast("string")).cast("long")


def compact_report(log: DataFrame) -> DataFrame:
    """What a compacted copy of the log keeps: source_records, live_records, reclaimed_bytes of values."""
    size = F.when(F.col("kind") == "put", value_bytes(F.col("val"))).otherwise(F.lit(0))
    sized = log.select("key", "seq", "kind", size.alias("size"))
    per_key = sized.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size"), F.max_by(F.struct("kind", "size"), "seq").alias("last"))
    live = F.col("last.kind") == "put"
    reclaimed = F.sum("size") - F.sum(F.when(live, F.col("last.size")).otherwise(F.lit(0)))
    return per_key.agg(F.sum("n").alias("source_records"), F.count_if(live).alias("live_records"), reclaimed.alias("reclaimed_bytes"))
