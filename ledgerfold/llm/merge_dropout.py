"""SentencePiece merge segmentation with seeded merge-dropout, and its decoding.

A text's symbols are merged as SentencePiece's merge models do it: of all neighbours whose joint piece is in the
vocabulary, the best-scored (then leftmost) pair is merged next. With a rate, every candidate merge is skipped
if the keyed hash of (seed, document id, where its two symbols begin and end) falls below it. The hash depends on
nothing else, so a document's segmentation is the same however its table is partitioned, and other seeds give
other ones. All of them decode to the text.

Merges never go across the beginning of a word (no piece has one inside), so the agenda is one of each word, and
NumPy takes one step of all the words' agendas at a time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, ship_file, shipped_file
from .textarrays import code_points, mix, slices, text_bytes

MARK = 0x2581  # stands for a space in pieces
_U = np.uint64
_NONE = np.int64(1) << 62


class Merges:
    """The vocabulary of a merge model with byte fallback, as arrays."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = np.zeros(256, np.int32)
        usable, written = {}, []
        for i, piece in enumerate(pieces):
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                written.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                written.append(b"")
            else:
                usable[piece] = i
                written.append(piece.replace(chr(MARK), " ").encode())
        if any(a != chr(MARK) and b == chr(MARK) for piece in usable for a, b in zip(piece, piece[1:])):
            raise ValueError("a piece goes across the beginning of a word")
        self.usable = usable
        self.bytes = np.frombuffer(b"".join(written), np.uint8)
        self.byte_length = np.array([len(w) for w in written], np.int64)
        self.byte_start = np.cumsum(self.byte_length) - self.byte_length
        self.of_char = np.full(0x110000, -1, np.int32)
        for piece, i in usable.items():
            if len(piece) == 1:
                self.of_char[ord(piece)] = i
        order = sorted(usable.values(), key=lambda i: (-model.get_score(i), i))
        rank = np.zeros(n, np.int64)
        rank[order] = np.arange(len(order))
        self.rank = rank

    @cached_property
    def tables(self) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
        """Hash tables from pairs to merged pieces, which only encoding needs: the second holds those whose slot in
        the first is taken."""
        pairs, usable, tables = {}, self.usable, []
        for piece, i in usable.items():
            for k in range(1, len(piece)):
                left, right = usable.get(piece[:k]), usable.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        keys, values = np.array(list(pairs), np.uint64), np.array(list(pairs.values()), np.int32)
        for bits, factor in ((21, 0x9E3779B97F4A7C15), (18, 0xC2B2AE3D27D4EB4F), (16, 0xD6E8FEB86659FD93)):
            slot = self._slot(keys, factor, bits)
            _, first = np.unique(slot, return_index=True)
            held, piece = np.full(1 << bits, ~_U(0), np.uint64), np.full(1 << bits, -1, np.int32)
            held[slot[first]], piece[slot[first]] = keys[first], values[first]
            tables.append((factor, bits, held, piece))
            rest = np.ones(len(keys), bool)
            rest[first] = False
            keys, values = keys[rest], values[rest]
            if not len(keys):
                return tables
        raise ValueError("the vocabulary has too many merges for the tables")

    @staticmethod
    def _slot(keys: np.ndarray, factor: int, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _U(factor)) >> _U(64 - bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair, or -1."""
        key = left.astype(np.int64).view(np.uint64) << _U(32) | right.astype(np.int64).view(np.uint64) & _U(0xFFFFFFFF)
        out = np.full(len(key), -1, np.int32)
        for k, (factor, bits, held, piece) in enumerate(self.tables):
            if not k:
                slot = self._slot(key, factor, bits)
                out = np.where(held[slot] == key, piece[slot], -1)
                open_ = np.flatnonzero((out < 0) & (held[slot] != ~_U(0)))
            elif len(open_):
                slot = self._slot(key[open_], factor, bits)
                hit = held[slot] == key[open_]
                out[open_[hit]] = piece[slot[hit]]
                open_ = open_[~hit]
        return out

    def encode(self, data: np.ndarray, at: np.ndarray, keys: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and where each text's begin and end. keys: a number below 2 ** 64 for each."""
        points, places = code_points(data, at)
        n_texts = len(at) - 1
        full = np.diff(places) > 0
        # A leading mark for every text that isn't empty; spaces are marks, and marks of the text are spelled in bytes.
        points = points.astype(np.int64)
        points = np.where(points == MARK, -1, np.where(points == 0x20, MARK, points))
        points = np.insert(points, places[:-1][full], MARK)
        places = places + np.concatenate([[0], np.cumsum(full)])
        text_of = np.repeat(np.arange(n_texts), np.diff(places))
        marks = points == MARK
        begins = marks.copy()
        begins[1:] &= ~marks[:-1]
        begins[places[:-1][full]] = True
        ids = np.where(points >= 0, self.of_char[points], -1)
        self._merge(ids, begins, text_of, places, keys, rate)
        where = np.flatnonzero(ids > -2)
        out = ids[where]
        unknown = np.flatnonzero(out < 0)
        counts = np.diff(np.searchsorted(where, places))
        if len(unknown):
            chars = ["▁" if c < 0 else chr(c) for c in points[where[unknown]].tolist()]
            spelled = [c.encode("utf-8", "replace") for c in chars]
            size = np.ones(len(out), np.int64)
            size[unknown] = [len(b) for b in spelled]
            spread = np.repeat(out, size)
            total = np.cumsum(size) - size
            flat = self.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
            own = np.repeat(total[unknown], size[unknown])
            step = np.arange(len(flat)) - np.repeat(np.cumsum(size[unknown]) - size[unknown], size[unknown])
            spread[own + step] = flat
            counts = np.bincount(text_of[where], size, n_texts).astype(np.int64)
            out = spread
        return out.astype(np.int32), np.concatenate([[0], np.cumsum(counts)])

    def _merge(self, ids: np.ndarray, begins: np.ndarray, text_of: np.ndarray, places: np.ndarray, keys: np.ndarray, rate: float) -> None:
        """Merges in place: a merged piece stands at its first character, the others become -2."""
        n = len(ids)
        if not n:
            return
        bar = _U(min(int(rate * 2.0**64), (1 << 64) - 1))
        offset = np.arange(n) - places[text_of]
        word = np.cumsum(begins) - 1
        word_end = np.append(np.flatnonzero(begins)[1:], n)
        key_of_word = keys[text_of[begins]]
        at, sym, own = np.arange(n), ids.copy(), word

        def candidates(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Of the pairs of symbols k and k + 1: priorities and merged pieces."""
            last = len(sym) - 1
            good = k < last
            after = np.minimum(k + 1, last)
            good &= own[k] == own[after]
            piece = np.full(len(k), -1, np.int32)
            g = np.flatnonzero(good & (sym[k] >= 0) & (sym[after] >= 0))
            piece[g] = self.merged(sym[k[g]], sym[after[g]])
            g = g[piece[g] >= 0]
            if rate and len(g):
                a, b = k[g], after[g]
                c = np.minimum(b + 1, last)
                end = np.where((b < last) & (own[c] == own[a]), at[c], word_end[own[a]])
                with np.errstate(over="ignore"):
                    spot = (offset[at[a]].astype(np.uint64) * _U(0x9E3779B97F4A7C15)) ^ ((at[b] - at[a]).astype(np.uint64) << _U(40)) ^ ((end - at[a]).astype(np.uint64) << _U(8))
                    h = mix(mix(spot) ^ key_of_word[own[a]])
                piece[g[h < bar]] = -1
            return np.where(piece >= 0, self.rank[piece], _NONE), piece

        priority, piece = candidates(np.arange(n))
        starts = np.flatnonzero(begins)
        while len(sym):
            # Of each word the best pair, the leftmost of equals.
            best = np.minimum.reduceat(np.where(priority < _NONE, priority << np.int64(32) | np.arange(len(sym)), _NONE), starts)
            goes_on = best < _NONE
            size = np.diff(np.append(starts, len(sym)))
            stays = np.repeat(goes_on, size)
            ids[at[~stays]] = sym[~stays]
            if not goes_on.any():
                return
            pick = (best[goes_on] & np.int64(0xFFFFFFFF)).astype(np.int64)
            sym[pick] = piece[pick]
            ids[at[pick + 1]] = -2
            stays[pick + 1] = False
            moved = np.cumsum(stays) - 1
            at, sym, own, priority, piece = (x[stays] for x in (at, sym, own, priority, piece))
            size = size[goes_on] - 1
            starts = np.cumsum(size) - size
            pick = moved[pick]
            priority[pick], piece[pick] = candidates(pick)
            before = pick[pick > starts] - 1
            priority[before], piece[before] = candidates(before)

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts' bytes in a row and where each begins and ends, without the leading space of each."""
        size = self.byte_length[ids]
        total = np.cumsum(size)
        raw = self.bytes[np.repeat(self.byte_start[ids] - (total - size), size) + np.arange(total[-1] if len(total) else 0)]
        at = np.concatenate([[0], total])[bounds]
        full = np.diff(at) > 0
        keep = np.ones(len(raw), bool)
        keep[at[:-1][full]] = False
        return raw[keep], at - np.concatenate([[0], np.cumsum(full)])


_shared: dict[str, Merges] = {}


def merges(model_file: str) -> Merges:
    """The vocabulary's arrays, kept by this Python process."""
    if model_file not in _shared:
        _shared[model_file] = Merges(model_file)
    return _shared[model_file]


def _encoded(model_name: str, rate: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(shipped_file(model_name))
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            with np.errstate(over="ignore"):
                keys = mix(mix(batch.column(0).fill_null(-1).cast(pa.int64()).to_numpy().view(np.uint64)) ^ mix(np.full(batch.num_rows, seed & (1 << 64) - 1, np.uint64)))
            for i, j in slices(at):
                ids, bounds = model.encode(data[at[i] : at[j]], at[i : j + 1] - at[i], keys[i:j], rate)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])

    return run


def _decoded(model_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merges(shipped_file(model_name))
        for batch in batches:
            ids = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            flat, all_bounds = ids.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.diff(ids.offsets.to_numpy()))])
            for i, j in slices(all_bounds):
                own, bounds = flat[all_bounds[i] : all_bounds[j]], all_bounds[i : j + 1] - all_bounds[i]
                raw, at = model.decode(own, bounds)
                text = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw)))
                words = memoryview(np.ascontiguousarray(own, "<i4")).cast("B")
                crc = [zlib.crc32(words[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array(np.diff(bounds)), pa.array(crc, pa.int64()), text.cast(pa.string())], names=["doc_id", "n_tokens", "ids_crc32", "text"])

    return run


ENCODED, DECODED = "doc_id long, ids array<int>", "doc_id long, n_tokens long, ids_crc32 long, text string"


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", *, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, ids. rate 0 gives SentencePiece's own segmentation (but for texts with the
    mark U+2581, which is spelled in bytes here, as decoding would take it for a space); rate 1 gives characters.

    * A null or empty text has no ids. * Null ids share one key of the hash; rows that repeat an id and text repeat
    its segmentation. * Other columns are not read; an empty table gives no rows.
    """
    return _texts(docs, id_col, text_col).mapInArrow(_encoded(ship_file(docs.sparkSession, model_file), rate, seed), ENCODED)


def decode(encoded: DataFrame, model_file: str) -> DataFrame:
    """Of rows (doc_id, ids): doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit numbers), text. Null ids
    are none, whose text is empty."""
    ship(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(ship_file(encoded.sparkSession, model_file)), DECODED)


def round_trip(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", *, rate: float = 0.1, seed: int = 0) -> DataFrame:
    """decode(encode(docs)) in one pass: each slice of texts is decoded as soon as it is encoded, so that no worker
    holds a whole batch's ids and no second one is needed."""
    name = ship_file(docs.sparkSession, model_file)
    encoded, decoded = _encoded(name, rate, seed), _decoded(name)
    return _texts(docs, id_col, text_col).mapInArrow(lambda batches: decoded(encoded(batches)), DECODED)
