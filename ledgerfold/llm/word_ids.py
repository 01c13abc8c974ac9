"""Ids of the word tokenizer for whole texts, with each distinct piece of text encoded once.

A text is cut into chunks where the tokenizer never joins what stands on both sides: at white space, and
between a letter and an ASCII sign or digit. The chunks' ids are the tokenizer's own; they are kept by the
chunk's bytes, and a text's ids are put together by NumPy.
"""

from __future__ import annotations

import numpy as np

from .textarrays import distinct_spans

_SPACE, _LETTER, _SIGN, _OTHER = range(4)
_KIND = np.full(256, _SIGN, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[list(b"abcdefghijklmnopqrstuvwxyz")] = _LETTER
_KIND[0x80:] = _OTHER
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Byte-level tokenizers write bytes as characters: printable ones of Latin-1 stand for themselves, the others
#: are numbered from 256 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(sorted(set(range(256)) - set(_PRINTABLE)))}


def chunk_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where chunks begin and end in data (lower-case bytes of texts that begin at `at`)."""
    n = len(data)
    kind = _KIND[data]
    # Letters of Latin-1 and Latin Extended-A are a lead byte from C3 to C5 and a second one. U+00D7 and U+00F7
    # are signs, and U+0130 in lower case ends with a mark.
    lead = (data >= 0xC3) & (data <= 0xC5)
    lead[:-1] &= ~((data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7)) | (data[:-1] == 0xC4) & (data[1:] == 0xB0))
    starts_letter = (kind == _LETTER) | lead
    ends_letter = kind == _LETTER
    ends_letter[1:] |= lead[:-1]
    cut = np.zeros(n + 1, bool)
    cut[at] = True
    before, after = kind[:-1], kind[1:]
    cut[1:n] |= (before == _SPACE) != (after == _SPACE)
    cut[1:n] |= ends_letter[:-1] & (after == _SIGN)
    cut[1:n] |= (before == _SIGN) & (data[:-1] != 0x27) & starts_letter[1:]
    where = np.flatnonzero(cut)
    starts, ends = where[:-1], where[1:]
    own = kind[starts] != _SPACE
    return starts[own], ends[own]


_shared: dict[tuple, WordIds] = {}


def shared_encoder(tokenizer_file: str, last_id: int) -> WordIds:
    """The encoder of this Python worker, which keeps its cache from task to task."""
    key = (tokenizer_file, last_id)
    if key not in _shared:
        _shared[key] = WordIds(*key)
    return _shared[key]


class WordIds:
    """Encodes slices of texts. The cache is emptied when it holds more than max_bytes bytes, by an upper estimate;
    beyond that come the chunks of one slice."""

    #: An entry of the cache without its chunk's bytes and ids: a dictionary's entry, a bytes object, two numbers.
    ENTRY = 200

    def __init__(self, tokenizer_file: str, last_id: int, max_bytes: int = 64 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.last_id, self.max_bytes = last_id, max_bytes
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.held = 0
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 1
        self.flat[0] = self.last_id
        self.start, self.length, self.count = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 1
        self.length[0] = 1

    def _ids(self, chunk: bytes) -> list[int]:
        """A chunk's ids. Words of Latin letters go right to the tokenizer's model, as its byte-level characters."""
        if chunk.isalpha():
            return [token.id for token in self.model.tokenize(chunk.decode())]
        text = chunk.decode("utf-8", "replace")
        if max(text) < "\u0180" and text.isalpha() and len(low := text.lower()) == len(text):
            return [token.id for token in self.model.tokenize(low.encode().decode("latin-1").translate(_BYTE_CHARACTERS))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _add(self, chunks: list[bytes]) -> None:
        for chunk in chunks:
            ids = self._ids(chunk)
            if self.used + len(ids) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.uint32)])
            if self.count == len(self.start):
                self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
            self.flat[self.used : self.used + len(ids)] = ids
            self.start[self.count], self.length[self.count] = self.used, len(ids)
            self.known[chunk] = self.count
            self.used, self.count = self.used + len(ids), self.count + 1
            self.held += self.ENTRY + len(chunk) + 8 * len(ids)

    def encode(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, the last of each being last_id, and where each text's begin and end."""
        if self.held > self.max_bytes:
            self.forget()
        raw = data.tobytes()
        if b"<|" in raw:  # the tokenizer's special tokens go across chunks
            texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(at[:-1], at[1:], strict=True)]
            parts = [np.array([*e.ids, self.last_id], np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        n = len(at) - 1
        if not len(data):
            return np.full(n, self.last_id, np.uint32), np.arange(n + 1)
        data = _LOWER[data]
        low = data.tobytes()
        starts, ends = chunk_spans(data, at)
        first, which = distinct_spans(data, starts, ends)
        chunks = [low[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        self._add([c for c in chunks if c not in self.known])
        index = np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))[which]
        per_text = np.bincount(np.searchsorted(at, starts, "right") - 1, minlength=n)[:n] if len(starts) else np.zeros(n, np.int64)
        index = np.insert(index, np.cumsum(per_text), 0)  # entry 0 is last_id
        lengths = self.length[index]
        total = np.cumsum(lengths)
        out = self.flat[np.repeat(self.start[index] - (total - lengths), lengths) + np.arange(total[-1])]
        bounds = np.concatenate([[0], total[np.cumsum(per_text + 1) - 1]])
        return out, bounds
