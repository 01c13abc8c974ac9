"""Which generation of a log is in force, from the listing (id, kind) of its folder: kinds are log, marker, staging, reserved."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("log", "marker", "staging", "reserved")


def authority(listing: DataFrame) -> DataFrame:
    """The highest marker and whether its log exists: id, has_log. There is no falling back to an older one."""
    top = listing.filter("kind = 'marker'").agg(F.max("id").alias("id")).filter("id IS NOT NULL")
    logs = listing.filter("kind = 'log'").select("id").distinct().withColumn("found", F.lit(True))
    return top.join(logs, "id", "left").select("id", F.coalesce("found", F.lit(False)).alias("has_log"))


def uncommitted(listing: DataFrame) -> DataFrame:
    """Logs without a marker: id."""
    return listing.filter("kind = 'log'").select("id").join(listing.filter("kind = 'marker'").select("id"), "id", "left_anti")


def obsolete(listing: DataFrame) -> DataFrame:
    """What cleaning up may remove: logs and markers below the authority, staging markers up to it."""
    top = listing.filter("kind = 'marker'").agg(F.max("id")).scalar()
    return listing.filter((F.col("kind").isin("log", "marker") & (F.col("id") < top)) | ((F.col("kind") == "staging") & (F.col("id") <= top)))


def orphans(listing: DataFrame) -> DataFrame:
    """Reserved logs above the authority that were never committed: id."""
    top = F.coalesce(listing.filter("kind = 'marker'").agg(F.max("id")).scalar(), F.lit(0))
    reserved = listing.filter("kind = 'reserved'").select("id")
    return uncommitted(listing).filter(F.col("id") > top).join(reserved, "id", "left_semi")


def next_id(listing: DataFrame) -> DataFrame:
    """One above every id observed: next_id."""
    return listing.agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


def unknown_entries(names: DataFrame) -> DataFrame:
    """Names that aren't 20 digits, a dot and a kind: name."""
    return names.filter(~F.col("name").rlike(f"^[0-9]{{20}}\\.({'|'.join(KINDS)})$"))


def manifest_violations(versions: DataFrame) -> DataFrame:
    """Versions (version, durable, gc, fresh, merged), numbered without holes, that break a rule: version, reason.

    gc never passes durable; durable grows from version to version; there is one merged run at most; without any run
    everything durable has been collected.
    """
    before = versions.select((F.col("version") + 1).alias("version"), F.col("durable").alias("before"))
    reason = (
        F.when(F.col("gc") > F.col("durable"), "gc passes durable")
        .when(F.col("durable") <= F.col("before"), "durable doesn't grow")
        .when(F.col("merged") > 1, "two merged runs")
        .when((F.col("fresh") + F.col("merged") == 0) & (F.col("gc") != F.col("durable")), "no runs")
    )
    return versions.join(before, "version", "left").select("version", reason.alias("reason")).filter("reason IS NOT NULL")
