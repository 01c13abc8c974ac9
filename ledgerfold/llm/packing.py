"""Best-fit-decreasing packing of documents into sequences of a fixed capacity.

Pieces are integers from 1 to the capacity, so best-fit decreasing depends only on how many pieces there are of
each length: the driver packs that histogram (at most `capacity` numbers, whatever the corpus' size) with a
segment tree over the bins' remaining capacities, and executors look up each piece's place by its rank among
the pieces of its length. No task sees more than its own partition's pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, ship_file, shipped_file, written
from .textarrays import slices, text_bytes

SLICE_BYTES = 1 << 19
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class OpenBins:
    """Bins by remaining capacity: runs (first bin, how many), under a segment tree that finds the tightest fit."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = np.zeros(2 * self.size, np.int8).tolist()
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _set(self, room: int) -> None:
        k = self.size + room
        self.any[k] = int(bool(self.runs[room]))
        while k > 1:
            k >>= 1
            self.any[k] = self.any[2 * k] | self.any[2 * k + 1]

    def put(self, room: int, first: int, n: int) -> None:
        if room and n:
            self.runs[room].append((first, n))
            self._set(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._set(room)
        return run

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that is `length` at least."""
        k = self.size + length
        if self.any[k]:
            return length
        while k > 1:  # up to the first right sibling with a bin, then down its left edge
            if not k & 1 and self.any[k + 1]:
                k += 1
                while k < self.size:
                    k = 2 * k if self.any[2 * k] else 2 * k + 1
                return k - self.size
            k >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, pieces a bin, first bin, offset in the bin), sorted, for all pieces of the
    histogram: those of one length from the first rank on go to bins from the first bin on, so many to each."""
    bins, rows, made = OpenBins(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, run = capacity, (made, -(-left // (capacity // length)))
                made += run[1]
            else:
                run = bins.take(room)
            # A bin that got a piece and has room for more is then the tightest one, so it is filled up first.
            each = room // length
            full = min(run[1], left // each)
            if full:
                rows.append((length, rank, each, run[0], capacity - room))
                bins.put(room - each * length, run[0], full)
                rank, left = rank + full * each, left - full * each
            if left and full < run[1]:  # the last pieces, which don't fill a bin up
                rows.append((length, rank, each, run[0] + full, capacity - room))
                bins.put(room - left * length, run[0] + full, 1)
                rank, left, full = rank + left, 0, full + 1
            bins.put(room, run[0] + full, run[1] - full)
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def _pieces(tokenizer_name: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from .word_ids import shared_encoder

        encoder, part = shared_encoder(shipped_file(tokenizer_name), end_id), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            ids = batch.column(0)
            for i, j in slices(at, SLICE_BYTES):
                flat, bounds = encoder.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
                total = np.diff(bounds)
                n = -(-total // capacity)
                doc = np.repeat(np.arange(len(total)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(capacity, total[doc] - start)
                begin = bounds[:-1][doc] + start
                raw = memoryview(flat.astype("<u4")).cast("B")
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                # The how-manieth of its length in this partition.
                order = np.argsort(length, kind="stable")
                lengths, first, counts = np.unique(length[order], return_index=True, return_counts=True)
                nth = np.empty(len(length), np.int64)
                nth[order] = np.arange(len(length)) - np.repeat(first, counts) + np.repeat(seen[lengths], counts)
                seen[lengths] += counts
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i).take(pa.array(doc)).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(nth)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
                )

    return run


def _placed(places: np.ndarray, names: list[str]):
    """places: from best_fit_decreasing, of which there are a few for each length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 1 << 48  # ranks are below
        keys = places[:, 0] * most + places[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            k = np.searchsorted(keys, length * most + rank, "right") - 1
            _, first, each, at_bin, offset = places[k].T
            nth = rank - first
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in names], pa.array(at_bin + nth // each), pa.array(offset + nth % each * length)],
                names=[*names, "sequence_id", "offset"],
            )

    return run


def tokenized_pieces(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """The pieces of all documents, each with its partition and how many of its length came before it there.
    It is written to the shared folder: partition numbers must stay what they were when a task runs again."""
    ship(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return written(narrow.mapInArrow(_pieces(ship_file(docs.sparkSession, tokenizer_file), end_id, capacity), PIECES), "pieces")


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", *, end_id: int = 1, capacity: int = 4096) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is the ids of its text, then end_id. Only longer ones than the capacity are cut, into pieces of
    the capacity and a shorter last one. Equal lengths are packed in any order.

    * A null or empty text is the one id end_id. * A null id stays null; rows that repeat an id are packed each.
    * Other columns are not read; an empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = tokenized_pieces(docs, tokenizer_file, id_col, text_col, end_id=end_id, capacity=capacity)
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # `capacity` rows at most
    places = best_fit_decreasing(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = pieces.join(before, ["length", "part"]).select(*names, (F.col("before") + F.col("nth")).alias("rank"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    if not histogram:
        return spark.createDataFrame([], schema)
    return ranked.mapInArrow(_placed(places, names), schema)
