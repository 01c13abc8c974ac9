"""Packing against brute force, and the tokenizer's cache against the tokenizer."""

import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerfold.llm.packing import best_fit_decreasing, pack
from ledgerfold.llm.textarrays import slices, text_bytes
from ledgerfold.llm.word_ids import shared_encoder

FILE = public_tokenizers.path("word_bpe_49k.json")


def brute_bins(lengths, capacity):
    """Best-fit decreasing, a piece at a time; the sorted remaining capacities."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(rooms, x)
        room = rooms.pop(k) if k < len(rooms) else capacity
        bisect.insort(rooms, room - x)
    return rooms


@pytest.mark.parametrize("seed", range(12))
def test_same_bins_as_a_piece_at_a_time(seed):
    rng = random.Random(seed)
    capacity = rng.choice([10, 64, 257])
    lengths = [min(capacity, 1 + int(rng.expovariate(1 / (1 + capacity / rng.choice([2, 5, 20]))))) for _ in range(rng.choice([1, 30, 700]))]
    histogram = {x: lengths.count(x) for x in set(lengths)}
    rows = best_fit_decreasing(histogram, capacity)
    used = {}
    for x, n in histogram.items():
        own = rows[rows[:, 0] == x]
        for rank in range(n):
            _, first, each, first_bin, offset = own[np.searchsorted(own[:, 1], rank, "right") - 1]
            b, place = first_bin + (rank - first) // each, offset + (rank - first) % each * x
            used.setdefault(b, []).append((place, x))
    for spans in used.values():
        end = 0
        for place, x in sorted(spans):
            assert place == end
            end += x
        assert end <= capacity
    assert sorted(capacity - sum(x for _, x in spans) for spans in used.values()) == brute_bins(lengths, capacity)


ODD = ["", "don't 's 'The it's—ok 2nd v2.0 É.x ÷a ×b ÀÉ'l ***the 'em naïve.", "日本 Σ.a ΑΣ. é.x", "KK İx 'Til", "é.x <|endoftext|> a", "a b c\x85d", "'s'st'll''re"]


def encoded(texts):
    words = shared_encoder(FILE, 1)
    words.forget()
    data, at = text_bytes(pa.array(texts, pa.string()))
    out = []
    for i, j in slices(at, 64):
        flat, bounds = words.encode(data[at[i] : at[j]], at[i : j + 1] - at[i])
        out += [flat[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def test_ids_are_the_tokenizers():
    tokenizer = shared_encoder(FILE, 1).tokenizer
    assert encoded([*ODD, None]) == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in [*ODD, ""]]


def test_chunks_are_kept_by_content():
    a = "a"
    for _ in range(11):
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))  # polynomial hashes modulo powers of two can't tell the two apart
    tokenizer = shared_encoder(FILE, 1).tokenizer
    assert encoded([a, b, f"{a} {b}"]) == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in (a, b, f"{a} {b}")]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBzÉéß'’.-# \n\t ́ΣςİKıŒœ×÷12٣€日<|>"), max_size=20), min_size=1, max_size=4))
def test_ids_of_any_text(texts):
    tokenizer = shared_encoder(FILE, 1).tokenizer
    assert encoded(texts) == [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]


def test_packs_nulls_repeats_and_long_texts(spark):
    rows = [(1, "a b c", 0), (1, "a b c", 0), (2, None, 1), (3, "", 2), (None, "x", 3), (4, "word " * 9000, 4), (5, " \n", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length long").repartition(3)
    got = pack(docs, FILE).collect()
    tokenizer = Tokenizer.from_file(FILE)
    want = []
    for doc_id, text, _ in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(doc_id, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    assert sorted((r[:5] for r in map(tuple, got)), key=str) == sorted(want, key=str)
    by_sequence = {}
    for r in got:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in by_sequence.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(spans), sorted(spans)[1:])) and min(spans)[0] == 0
        assert sum(n for _, n in spans) <= 4096
    assert len(by_sequence) == len(brute_bins([r.length for r in got], 4096))
    assert pack(docs.limit(0), FILE).count() == 0
