"""Segmentation against SentencePiece and a plain agenda with the same hash, and lossless decoding."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerfold.llm.merge_dropout import decode, encode, merges, round_trip
from ledgerfold.llm.queries_tokens import op3_sentencepiece
from ledgerfold.llm.textarrays import slices, text_bytes

FILE = public_tokenizers.path("piece_bpe_32k.model")
MASK = (1 << 64) - 1


def model():
    return merges(FILE)


def segmented(texts, rate, keys=None, most=64):
    data, at = text_bytes(pa.array(texts, pa.string()))
    keys = np.array(keys if keys is not None else range(len(texts)), np.uint64)
    out = []
    for i, j in slices(at, most):
        ids, bounds = model().encode(data[at[i] : at[j]], at[i : j + 1] - at[i], keys[i:j], rate)
        raw, back = model().decode(ids, bounds)
        assert [raw[a:b].tobytes().decode() for a, b in zip(back[:-1], back[1:])] == [t or "" for t in texts[i:j]]
        out += [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def mix(x):
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & MASK
    x = (x ^ x >> 27) * 0x94D049BB133111EB & MASK
    return x ^ x >> 31


def plain(text, rate, key):
    """The same rule, one merge of the whole text's agenda at a time."""
    sp = sentencepiece.SentencePieceProcessor(model_file=FILE)
    chars = ["▁", *["\0" if c == "▁" else "▁" if c == " " else c for c in text]] if text else []
    symbols = [(k, k + 1) for k in range(len(chars))]
    joined = "".join(chars)
    skipped = set()
    while True:
        best = None
        for k in range(len(symbols) - 1):
            (a, b), (_, c) = symbols[k], symbols[k + 1]
            piece = sp.piece_to_id(joined[a:c])
            known = all(sp.piece_to_id(joined[x:y]) for x, y in ((a, b), (b, c), (a, c)))
            if not known or "\0" in joined[a:c] or (a, b, c) in skipped:
                continue
            spot = (a * 0x9E3779B97F4A7C15 & MASK) ^ (b - a) << 40 ^ (c - a) << 8
            if rate and mix(mix(spot) ^ key) < int(rate * 2**64):
                skipped.add((a, b, c))
                continue
            if best is None or (-sp.get_score(piece), k) < best:
                best = (-sp.get_score(piece), k)
        if best is None:
            break
        k = best[1]
        symbols[k : k + 2] = [(symbols[k][0], symbols[k + 1][1])]
    ids = []
    for a, b in symbols:
        piece = joined[a:b]
        ids += [sp.piece_to_id(piece)] if sp.piece_to_id(piece) and piece != "\0" else [sp.piece_to_id(f"<0x{x:02X}>") for x in ("▁" if piece == "\0" else piece).encode()]
    return ids


TEXTS = ["", " ", "  a  b ", "a\tb\nc", "日本 € ﬁ x́ é", "ab   c", "The quick brown fox jumps over the lazy dog again and again.", "ungewöhnliche Wörter", "😀 x"]


def test_no_dropout_is_sentencepieces_segmentation():
    sp = sentencepiece.SentencePieceProcessor(model_file=FILE)
    assert segmented(TEXTS, 0.0) == sp.encode(TEXTS)


def test_full_dropout_is_characters():
    assert [len(x) for x in segmented(["abc d", ""], 1.0)] == [6, 0]


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 0.9])
def test_same_as_one_agenda(rate):
    texts = [*TEXTS, "É▁x ▁", None]
    assert segmented(texts, rate, range(50, 50 + len(texts))) == [plain(t or "", rate, 50 + k) for k, t in enumerate(texts)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("the anigro\n▁é日\t."), max_size=15), min_size=1, max_size=4), st.sampled_from([0.0, 0.3]))
def test_any_text(texts, rate):
    assert segmented(texts, rate) == [plain(t, rate, k) for k, t in enumerate(texts)]


def test_keys_vary_and_repeat(spark):
    rng = random.Random(1)
    text = " ".join("".join(rng.choice("thean") for _ in range(8)) for _ in range(200))
    rows = [(1, text, 0), (1, text, 1), (2, text, 2), (3, None, 3), (None, text, 4), (4, "", 5), (5, "long " * 20000, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids long")
    out = {}
    for parts in (1, 3):
        got = sorted((str(r.doc_id), r.ids) for r in encode(docs.repartition(parts), FILE, rate=0.3, seed=7).collect())
        out[parts] = got
    assert out[1] == out[3]
    of = dict(out[1])
    assert of["1"] != of["2"] and of["3"] == [] == of["4"]
    assert dict((str(r.doc_id), r.ids) for r in encode(docs, FILE, rate=0.3, seed=8).collect())["1"] != of["1"]
    back = {str(r.doc_id): r for r in decode(encode(docs, FILE, rate=0.3), FILE).collect()}
    assert {k: r.text for k, r in back.items()} == {str(k): t or "" for k, t, _ in rows}
    at_once = {str(r.doc_id): r for r in round_trip(docs, FILE, rate=0.3).collect()}
    assert at_once == back
    assert back["3"].ids_crc32 == zlib.crc32(b"") and encode(docs.limit(0), FILE).count() == 0


def test_query_decodes_every_text(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = {r.doc_id: r.text_sha256 for r in op3_sentencepiece(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in docs.items()}
