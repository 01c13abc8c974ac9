"""Verification and summaries of measured evidence: ledgers of pairs, their sidecars, and distributions of timings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import nearest_rank, seeded_order

DISPOSITIONS = ("included", "failed", "excluded")


def ledger_counts(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("disposition").agg(F.count(F.lit(1)).alias("n"))


def declared_mismatches(ledger: DataFrame, declared: DataFrame) -> DataFrame:
    """Dispositions whose declared number (disposition, declared) isn't the ledger's: disposition, declared, found. One that
    is declared or found on one side only counts as none on the other."""
    found = ledger_counts(ledger).select(F.col("disposition").alias("of_ledger"), F.col("n").alias("found"))
    both = declared.join(found, F.col("disposition") == F.col("of_ledger"), "full")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return both.select(F.coalesce("disposition", "of_ledger").alias("disposition"), none("declared"), none("found")).filter("declared <> found")


def expected_order(ledger: DataFrame, seed: int) -> DataFrame:
    """The order that the seed gives each pair: 0 is left first."""
    return ledger.select("pair_index", seeded_order(seed, F.col("pair_index")).alias("pair_order"))


def ledger_violations(ledger: DataFrame, seed: int, requested: int | None = None) -> DataFrame:
    """What is wrong with a ledger (pair_index, pair_order, disposition, first, second): pair_index, reason.

    Rows with another order than the seed's, no known disposition, or included without both durations; pair indexes
    that are used twice, or whose predecessor is missing (indexes begin at 0). With requested, how many pairs there
    should be, a row without a pair_index if there are more or fewer.
    """
    lacks = (F.col("disposition") == "included") & (F.col("first").isNull() | F.col("second").isNull())
    wrong = (
        F.when(~F.coalesce(F.col("disposition").isin(*DISPOSITIONS), F.lit(False)), "disposition")
        .when(~F.col("pair_order").eqNullSafe(seeded_order(seed, F.col("pair_index"))), "order")
    )
    bad = ledger.select("pair_index", wrong.alias("reason")).filter("reason IS NOT NULL")
    bad = bad.unionByName(ledger.filter(lacks).select("pair_index", F.lit("fields").alias("reason")))
    twice = ledger.groupBy("pair_index").count().filter("count > 1").select("pair_index", F.lit("used twice").alias("reason"))
    follows = ledger.select((F.col("pair_index") + 1).alias("pair_index"))
    holes = ledger.filter("pair_index <> 0").select("pair_index").distinct().join(follows, "pair_index", "left_anti").select("pair_index", F.lit("hole before").alias("reason"))
    found = bad.unionByName(twice).unionByName(holes)
    if requested is None:
        return found
    count = ledger.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != requested)
    return found.unionByName(count.select(F.lit(None).cast("long").alias("pair_index"), F.lit("count").alias("reason")))


def sidecar_join(ledger: DataFrame, sidecars: DataFrame) -> DataFrame:
    """Sidecars with the failed pair that they belong to: pair_index, repetition."""
    return sidecars.join(ledger.filter("disposition = 'failed'").select("pair_index"), "pair_index", "left_semi").select("pair_index", "repetition")


def sidecar_dangling(ledger: DataFrame, sidecars: DataFrame) -> DataFrame:
    return sidecars.join(ledger.filter("disposition = 'failed'").select("pair_index"), "pair_index", "left_anti").select("pair_index")


def sidecar_duplicates(sidecars: DataFrame) -> DataFrame:
    return sidecars.groupBy("pair_index").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def distribution(samples: DataFrame, groups: list[str], value: str = "duration", slice_values: int = 1 << 16) -> DataFrame:
    """samples, min, p50, p95, max by groups, percentiles by nearest rank in integers.

    Equal values are counted first, then summed by slices of slice_values values. A window over a group has a row for each
    slice that has values, and one over a slice its distinct values, so no task ranks all values of a group.
    """
    counted = samples.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(F.count(F.lit(1)).alias("n"))
    counted = counted.withColumn("__slice", F.expr(f"`{value}` div {slice_values}"))
    by = Window.partitionBy(*groups)
    before = by.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy(*groups, "__slice").agg(F.sum("n").alias("__n"))
    sums = sums.select(*[F.col(g).alias(f"__of_{g}") for g in groups], F.col("__slice").alias("__of_slice"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(by).alias("total"))
    same = F.col("__slice") == F.col("__of_slice")
    for g in groups:
        same &= counted[g].eqNullSafe(sums[f"__of_{g}"])
    upto = Window.partitionBy(*groups, "__slice").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counted.join(sums, same).withColumn("upto", F.col("__before") + F.sum("n").over(upto))
    at = lambda p: F.min(F.when(F.col("upto") >= nearest_rank(F.col("total"), p), F.col(value)))
    return placed.groupBy(*groups).agg(F.max("total").alias("samples"), F.min(value).alias("min"), at(50).alias("p50"), at(95).alias("p95"), F.max(value).alias("max"))


def stratified(samples: DataFrame) -> DataFrame:
    """The distribution of each side and operation, over both orders (order is null) and in each."""
    both = samples.select("side", "operation", "order", "duration").unionByName(samples.select("side", "operation", F.lit(None).cast("long").alias("order"), "duration"))
    return distribution(both, ["side", "operation", "order"])


def category_counts(samples: DataFrame) -> DataFrame:
    """By operation: samples, those without work, those without a step."""
    return samples.groupBy("operation").agg(F.count(F.lit(1)).alias("samples"), F.count_if(F.col("work").isNull()).alias("missing_work"), F.count_if(F.col("step").isNull()).alias("missing_step"))


def label_counts(samples: DataFrame, labels: list[str]) -> DataFrame:
    """How many samples have each value of each label (unit, error class ...), and how many have none (null): label, value, n."""
    pairs = samples.select(F.explode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).cast("string").alias("value")) for c in labels])).alias("x"))
    return pairs.groupBy("x.label", "x.value").agg(F.count(F.lit(1)).alias("n"))


def projection_mismatches(timings: DataFrame) -> DataFrame:
    """Where the plain durations (durations) and the samples' (samples.duration) differ, in length too: id, place."""
    zipped = timings.select("id", F.posexplode(F.arrays_zip(F.col("durations").alias("a"), F.col("samples.duration").alias("b"))).alias("place", "both"))
    return zipped.filter(~F.col("both")["a"].eqNullSafe(F.col("both")["b"])).select("id", "place")


def complete_pairs(ledger: DataFrame) -> DataFrame:
    """The repetitions of included pairs: pair_index, repetition, duration."""
    return ledger.filter("disposition = 'included'").select("pair_index", F.posexplode(F.array("first", "second")).alias("repetition", "duration"))


def failed_pair_evidence(sidecars: DataFrame) -> DataFrame:
    """What failed pairs (pair_index, completed_first, failing_prefix: arrays of (operation, duration), null if there is
    none; failure: (operation, duration, error_class)) leave as evidence, kept apart by selection: selection, pair_index,
    place, operation, duration, error_class."""
    none = F.lit(None).cast("string").alias("error_class")
    listed = lambda c: sidecars.select(F.lit(c).alias("selection"), "pair_index", F.posexplode(c).alias("place", "x")).select("selection", "pair_index", F.col("place").cast("long").alias("place"), "x.operation", "x.duration", none)
    failed = sidecars.filter("failure IS NOT NULL").select(F.lit("failure").alias("selection"), "pair_index", F.lit(0).cast("long").alias("place"), "failure.operation", "failure.duration", "failure.error_class")
    return listed("completed_first").unionByName(listed("failing_prefix")).unionByName(failed)


def step_association(samples: DataFrame, steps: DataFrame) -> DataFrame:
    """By operation, how many samples (operation, step) belong to a measured step of steps (phase, step), carry no step
    (they were taken while nothing was measured), or carry one that isn't measured: operation, measured, without_step,
    unknown_step."""
    measured = steps.filter("phase = 'measured'").select(F.col("step").alias("of_step")).distinct()
    found = samples.join(measured, F.col("step") == F.col("of_step"), "left")
    unknown = F.col("step").isNotNull() & F.col("of_step").isNull()
    return found.groupBy("operation").agg(F.count_if(F.col("of_step").isNotNull()).alias("measured"), F.count_if(F.col("step").isNull()).alias("without_step"), F.count_if(unknown).alias("unknown_step"))
