"""Hex, checksums, byte lengths, numbers as bytes, and exact integer helpers as column expressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed values of FNV-1a over 64 bits.
FNV_OFFSET, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def hex_lower(data: Column) -> Column:
    return F.lower(F.hex(data))


def unhex_strict(text: Column) -> Column:
    """Bytes of hex digits in either case. An odd length or another character raises, where unhex() would not."""
    good = text.rlike("^([0-9A-Fa-f]{2})*$")
    return F.when(text.isNull(), F.lit(None).cast("binary")).when(good, F.unhex(text)).otherwise(F.raise_error(F.concat(F.lit("invalid_input: not hex: "), text)).cast("binary"))


def big_endian(number: Column) -> Column:
    """A non-negative bigint as 8 bytes; such keys sort as their numbers."""
    return F.unhex(F.lpad(F.hex(number), 16, "0"))


def little_endian(number: Column, size: int = 4) -> Column:
    digits = F.lpad(F.hex(number), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))]))


def canonical_id(number: Column) -> Column:
    return F.lpad(number.cast("string"), 20, "0")


def nearest_rank(count: Column, percent: int) -> Column:
    """The rank, from 1, of a percentile among so many values: count * percent / 100, rounded up, in integers."""
    return F.call_function("div", count * percent + 99, F.lit(100))


def seeded_order(seed: int, index: Column) -> Column:
    """0 or 1: the low bits of seed and index, exclusive or."""
    return F.lit(seed & 1).cast("long").bitwiseXOR(index.bitwiseAND(F.lit(1).cast("long")))


@F.pandas_udf(StringType())
def fnv1a64(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """FNV-1a over 64 bits of each row's bytes, as 16 hex digits, a byte of all rows at a time."""
    for data in parts:
        raw = [bytes(x) if x is not None else b"" for x in data]
        size = np.array([len(x) for x in raw])
        out = np.full(len(raw), FNV_OFFSET, np.uint64)
        start = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(raw), np.uint8)
        with np.errstate(over="ignore"):
            for k in range(int(size.max(initial=0))):
                on = np.flatnonzero(size > k)
                out[on] = (out[on] ^ flat[start[on] + k]) * np.uint64(FNV_PRIME)
        yield pd.Series([None if x is None else f"{v:016x}" for x, v in zip(data, out.tolist(), strict=True)])
