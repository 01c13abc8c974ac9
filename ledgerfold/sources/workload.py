"""Deterministic workloads and traces as DataFrames, from a counter-based generator: draw k depends on the seed and k alone.

Profiles whose operations take a fixed number of draws are made in parallel, each task from its own range of steps.
The others depend on earlier draws and are bounded (a million steps), so the driver makes them.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import InvalidInput, UnsupportedVersion
from ..functions.codec import FNV_OFFSET, FNV_PRIME

#: The generator's constants, and the bounds of a workload.
GAMMA, FIRST, SECOND = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
MOST_STEPS, MOST_KEY, MOST_VALUE, MOST_PAYLOAD = 1_000_000, 4096, 1 << 20, 64 << 20
PROFILES = ("point_read", "range_scan", "sequential_write", "random_write", "mixed")
NAMES = ["phase", "step", "op", "key", "value", "start", "end", "limit"]
STEPS = "phase string, step long, op string, key binary, value binary, start binary, end binary, limit int"


def draws(seed: int, first: int, n: int) -> np.ndarray:
    """Draws first .. first + n - 1 of the seed's sequence."""
    return draws_at(seed, np.arange(first, first + n))


def draws_at(seed: int, at: np.ndarray) -> np.ndarray:
    """Draws of the seed's sequence at any places."""
    with np.errstate(over="ignore"):
        z = np.uint64(seed & (1 << 64) - 1) + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(GAMMA)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(FIRST)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(SECOND)
        return z ^ (z >> np.uint64(31))


class Draws:
    """The sequence one draw after another."""

    def __init__(self, seed: int):
        self.seed, self.at = seed, 0

    def bounded(self, n: int) -> int:
        self.at += 1
        return int(draws(self.seed, self.at - 1, 1)[0]) % n

    def fill(self, size: int) -> bytes:
        n = -(-size // 8)
        self.at += n
        return draws(self.seed, self.at - n, n).astype("<u8").tobytes()[:size]


@dataclass(frozen=True)
class TraceConfig:
    seed: int
    profile: str
    operations: int
    key_space: int
    value_bytes: int
    range_limit: int
    reopen_every: int | None = None

    def checked(self) -> TraceConfig:
        if self.profile not in PROFILES:
            raise InvalidInput(f"unknown profile {self.profile}")
        if self.operations <= 0 or self.key_space <= 0 or self.reopen_every == 0:
            raise InvalidInput("operations, key_space and reopen_every are positive")
        if self.profile == "sequential_write" and self.key_space < self.operations:
            raise InvalidInput("sequential_write needs key_space >= operations")
        if self.value_bytes > MOST_VALUE:
            raise InvalidInput("a value is too long")
        if self.profile in ("range_scan", "mixed") and not 1 <= self.range_limit <= min(self.key_space, MOST_STEPS):
            raise InvalidInput("range_limit is from 1 to key_space")
        written = {"point_read": self.key_space, "range_scan": self.key_space, "mixed": self.operations + (self.key_space + 1) // 2}.get(self.profile, self.operations)
        if written * self.value_bytes > MOST_PAYLOAD:
            raise InvalidInput("the values may materialize too many bytes")
        reopens = self.operations // self.reopen_every if self.reopen_every else 0
        if self.operations + reopens > MOST_STEPS or self.key_space > MOST_STEPS:
            raise InvalidInput("a trace has too many steps")
        return self


def key_of(number: int) -> bytes:
    return number.to_bytes(8, "big")


def _setup_ids(config: TraceConfig) -> range:
    step = {"point_read": 1, "range_scan": 1, "mixed": 2}.get(config.profile)
    return range(0, config.key_space, step) if step else range(0)


def _draws_each(config: TraceConfig) -> int:
    fill = -(-config.value_bytes // 8)
    return {"point_read": 2, "range_scan": 1, "sequential_write": fill, "random_write": 1 + fill}[config.profile]


def _value(config: TraceConfig, numbers: np.ndarray) -> bytes:
    return numbers.astype("<u8").tobytes()[: config.value_bytes]


def operation(config: TraceConfig, k: int, drawn: np.ndarray) -> dict:
    """Measured operation k of a profile with a fixed number of draws."""
    n = config.key_space
    if config.profile == "point_read":
        hit, number = int(drawn[0]) % 100 < 80, int(drawn[1]) % n
        return {"op": "get", "key": key_of(number if hit else n + number)}
    if config.profile == "range_scan":
        start = int(drawn[0]) % n
        return {"op": "range_scan", "start": key_of(start), "end": key_of(min(start + config.range_limit, n)), "limit": config.range_limit}
    if config.profile == "sequential_write":
        return {"op": "put", "key": key_of(k), "value": _value(config, drawn)}
    return {"op": "put", "key": key_of(int(drawn[0]) % n), "value": _value(config, drawn[1:])}


def _mixed(config: TraceConfig) -> Iterator[dict]:
    rng = Draws(config.seed)
    rng.at = len(_setup_ids(config)) * -(-config.value_bytes // 8)
    for _ in range(config.operations):
        kind, number = rng.bounded(100), rng.bounded(config.key_space)
        if kind < 40:
            yield {"op": "put", "key": key_of(number), "value": rng.fill(config.value_bytes)}
        elif kind < 70:
            yield {"op": "get", "key": key_of(number)}
        elif kind < 85:
            yield {"op": "range_scan", "start": key_of(number), "end": key_of(min(number + config.range_limit, config.key_space)), "limit": config.range_limit}
        else:
            yield {"op": "delete", "key": key_of(number)}


def trace(spark: SparkSession, config: TraceConfig) -> DataFrame:
    """The trace's steps: phase ('setup', 'measured'), step (from 0 in each), op, key, value, start, end, limit."""
    config.checked()
    fill, ids = -(-config.value_bytes // 8), _setup_ids(config)
    every = config.reopen_every or config.operations + 1

    def setup(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            drawn = draws_at(config.seed, batch["id"].to_numpy()[:, None] * fill + np.arange(fill))
            yield _frame([{"phase": "setup", "step": k, "op": "put", "key": key_of(ids[k]), "value": _value(config, own)} for k, own in zip(batch["id"], drawn, strict=True)])

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        each, first = _draws_each(config), len(ids) * fill
        for batch in batches:
            drawn, rows = draws_at(config.seed, first + batch["id"].to_numpy()[:, None] * each + np.arange(each)), []
            for k, own in zip(batch["id"], drawn, strict=True):
                rows += _placed(k, operation(config, k, own), every)
            yield _frame(rows)

    steps = spark.range(len(ids)).mapInPandas(setup, STEPS)
    if config.profile == "mixed":
        rows = [row for k, own in enumerate(_mixed(config)) for row in _placed(k, own, every)]
        return steps.unionByName(spark.createDataFrame([tuple(r.get(c) for c in NAMES) for r in rows], STEPS))
    return steps.unionByName(spark.range(config.operations).mapInPandas(measured, STEPS))


def _placed(k: int, own: dict, every: int) -> list[dict]:
    """Operation k at its step, with the reopening that follows it if there is one."""
    rows = [{"phase": "measured", "step": k + k // every, **own}]
    if (k + 1) % every == 0:
        rows.append({"phase": "measured", "step": k + k // every + 1, "op": "reopen"})
    return rows


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame([[r.get(c) for c in NAMES] for r in rows], columns=NAMES).astype({"limit": "Int32", "step": "int64"})


def workload(spark: SparkSession, seed: int, operations: int, key_space: int, most_value: int, reopen_every: int | None = None) -> DataFrame:
    """Half puts, three tenths gets, the rest deletes, with a reopening after every so many: step, op, key, value.
    Key 0 is the empty key, others are four little-endian bytes."""
    if operations <= 0 or key_space <= 0 or reopen_every == 0 or operations > MOST_STEPS:
        raise InvalidInput("operations, key_space and reopen_every are positive and steps bounded")
    rng, rows = Draws(seed), []
    for k in range(operations):
        number, kind = rng.bounded(key_space), rng.bounded(100)
        key = number.to_bytes(4, "little") if number else b""
        if kind < 50:
            rows.append(("put", key, rng.fill(rng.bounded(most_value + 1))))
        else:
            rows.append(("get" if kind < 80 else "delete", key, None))
        if reopen_every and (k + 1) % reopen_every == 0:
            rows.append(("reopen", None, None))
    return spark.createDataFrame([(k, *row) for k, row in enumerate(rows)], "step long, op string, key binary, value binary")


def trace_json(config: TraceConfig, steps: DataFrame) -> str:
    """The trace as compact JSON, fields in their declared order. Traces are bounded, so the driver can hold one."""
    by_phase = {"setup": [], "measured": []}
    for r in steps.orderBy("phase", "step").collect():
        row = {"op": r.op}
        if r.op == "range_scan":
            row |= {"start": bytes(r.start).hex(), "end": bytes(r.end).hex() if r.end is not None else None, "limit": r.limit}
        elif r.op != "reopen":
            row["key"] = bytes(r.key).hex()
        if r.op == "put":
            row["value"] = bytes(r.value).hex()
        by_phase[r.phase].append(row)
    generator = {c: getattr(config, c) for c in ("seed", "profile", "operations", "key_space", "value_bytes", "range_limit", "reopen_every")}
    whole = {"format_version": 1, "profile": config.profile, "seed": config.seed, "generator": generator, "setup_steps": by_phase["setup"], "measured_steps": by_phase["measured"]}
    return json.dumps(whole, separators=(",", ":"))


def requires_range(steps: DataFrame) -> DataFrame:
    """One row: whether any step of either phase is a range scan."""
    return steps.agg(F.coalesce(F.bool_or(F.col("op") == "range_scan"), F.lit(False)).alias("requires_range"))


def trace_violations(config: TraceConfig, steps: DataFrame) -> DataFrame:
    """Where a trace's steps aren't those that its own configuration makes: phase, step, reason. The trace is made again,
    so a changed, missing or additional step is found; one that is there twice is so as well."""
    config.checked()
    values = [c for c in NAMES if c not in ("phase", "step")]
    of = lambda df, side: df.groupBy("phase", "step").agg(F.count(F.lit(1)).alias(f"n_{side}"), F.min(F.struct(*values)).alias(side))
    both = of(steps, "own").join(of(trace(steps.sparkSession, config), "made"), ["phase", "step"], "full")
    reason = F.when(F.col("made").isNull(), "additional").when(F.col("own").isNull(), "missing").when(F.col("n_own") > 1, "used twice").when(~F.col("own").eqNullSafe(F.col("made")), "differs")
    return both.select("phase", "step", reason.alias("reason")).filter("reason IS NOT NULL")


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Steps of trace files, which trace_json writes: file, profile, seed, generator, phase, step, op, key, value, start,
    end, limit. Other versions, unknown profiles, a seed or profile that isn't the generator's, bad hex and a trace without
    measured steps raise. trace_violations tells whether the steps are those of the generator."""
    from ..functions.codec import unhex_strict

    step = "struct<op string, key string, value string, start string, `end` string, `limit` int>"
    generator = "struct<seed decimal(20,0), profile string, operations int, key_space int, value_bytes int, range_limit int, reopen_every int>"
    schema = f"format_version int, profile string, seed decimal(20,0), generator {generator}, setup_steps array<{step}>, measured_steps array<{step}>"
    whole = spark.read.option("multiLine", "true").schema(schema).json(path).withColumn("file", F.col("_metadata.file_path"))
    versions = [r[0] for r in whole.select("format_version").distinct().head(2)]
    if versions != [1]:
        raise UnsupportedVersion(f"format versions {versions}")
    own = F.col("seed").eqNullSafe(F.col("generator.seed")) & F.col("profile").eqNullSafe(F.col("generator.profile")) & F.col("profile").isin(*PROFILES)
    wrong = whole.filter(~F.coalesce(own & (F.size("measured_steps") > 0), F.lit(False))).select("file").head(1)
    if wrong:
        raise InvalidInput(f"{wrong[0]['file']}: no generator of its seed and profile, or no measured steps")
    phases = [whole.select("file", "profile", "seed", "generator", F.lit(p).alias("phase"), F.posexplode(f"{p}_steps").alias("step", "s")) for p in ("setup", "measured")]
    rows = phases[0].unionByName(phases[1])
    held = [unhex_strict(F.col(f"s.{c}")).alias(c) for c in ("key", "value", "start", "end")]
    return rows.select("file", "profile", "seed", "generator", "phase", F.col("step").cast("long").alias("step"), "s.op", *held, "s.limit")


def fingerprint(text: str) -> str:
    out = FNV_OFFSET
    for byte in text.encode():
        out = (out ^ byte) * FNV_PRIME & (1 << 64) - 1
    return f"{out:016x}"


def read_workload(spark: SparkSession, path: str) -> DataFrame:
    """Steps of workload files {format_version, seed, steps}: file, step, op, key, value. Other versions, unknown
    operations, bad hex and bounds that are broken raise."""
    whole = spark.read.option("multiLine", "true").schema("format_version int, seed decimal(20,0), steps array<struct<op string, key string, value string>>").json(path)
    versions = [r[0] for r in whole.select("format_version").distinct().head(2)]
    if versions != [1]:
        raise UnsupportedVersion(f"format versions {versions}")
    from ..functions.codec import unhex_strict

    steps = whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode("steps").alias("step", "s"))
    rows = steps.select("file", F.col("step").cast("long").alias("step"), "s.op", unhex_strict(F.col("s.key")).alias("key"), unhex_strict(F.col("s.value")).alias("value"))
    bad = violations(rows).head(1)
    if bad:
        raise InvalidInput(f"step {bad[0]['step']}: {bad[0]['reason']}")
    return rows


def violations(steps: DataFrame) -> DataFrame:
    """Steps that break a workload's rules: step, reason."""
    keyed = F.col("op").isin("put", "get", "delete")
    reason = (
        F.when(~F.coalesce(F.col("op").isin("put", "get", "delete", "reopen"), F.lit(False)), "unknown operation")
        .when(keyed & F.col("key").isNull(), "no key")
        .when(F.octet_length("key") > MOST_KEY, "key too long")
        .when((F.col("op") == "put") & F.col("value").isNull(), "no value")
        .when(F.octet_length("value") > MOST_VALUE, "value too long")
        .when(F.col("step") >= MOST_STEPS, "too many steps")
    )
    return steps.select("step", reason.alias("reason")).filter("reason IS NOT NULL")
