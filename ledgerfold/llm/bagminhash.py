"""BagMinHash signatures of multisets of word shingles.

A multiset's element of multiplicity c has weight c, discretised into the unit steps (0, 1], (1, 2] ... (c-1, c]. Each
step is a Poisson process of rate 1 whose points carry a register and a time, and a point counts for a multiset if its
step is within the element's weight, so all multisets see the same points, as far as their weights reach. Each register
keeps its earliest point. Two registers agree with the probability sum(min) / sum(max), the weighted Jaccard similarity.

Steps are grouped in dyadic blocks (0, 1], (1, 2], (2, 4], (4, 8] ..., whose processes are hierarchical: a block's first
point comes at its length's rate, and a fair coin says which half it falls in. That half's first point is this one; the
other half's comes later, after a time of its own at its own rate; both are split in the same way, down to steps, which
then go on by themselves. Halves beyond the weight, or whose first point comes after the last time that matters, are
left unsplit, so a weight of c costs as many splits as it has points, and not c.

Only the points that can be earliest are made: a multiset of total weight W fills all registers by the time
m * (ln m + 4) / W but rarely; those that don't take twice the time, until they do.
"""

from __future__ import annotations

import hashlib

import numpy as np

from .quality import word_spans
from .textarrays import mix, span_hashes

SHINGLE = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_U = np.uint64


def _times(h: np.ndarray) -> np.ndarray:
    """Exponential variates from hashes."""
    return -np.log(((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)


def _contents(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A row of two numbers for each text: a cryptographic digest of its words, with a space after each."""
    size = ends - starts + 1
    stop = np.cumsum(size)
    spaced = np.full(int(stop[-1]) if len(stop) else 0, 0x20, np.uint8)
    own = np.ones(len(spaced), bool)
    own[stop - 1] = False
    inside = np.arange(int((size - 1).sum())) + np.repeat(starts - (np.cumsum(size - 1) - (size - 1)), size - 1)
    spaced[own] = data[inside]
    bounds = np.concatenate([[0], stop])[places].tolist()
    raw = memoryview(spaced)
    digests = b"".join(hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(bounds[:-1], bounds[1:], strict=True))
    return np.frombuffer(digests, np.uint64).reshape(-1, 2)


def shingles(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: the two halves of the content's digest, and the hashes of the shingles with each text's places among
    them.

    A shingle is SHINGLE words in a row (A-Z in lower case, split at [\\x20\\x09-\\x0D]); a text with fewer words, but
    one at least, has one shingle of them all. Texts with equal words have equal digests, and others don't.
    """
    data = _LOWER[data]
    starts, ends, places = word_spans(data, at)
    words = span_hashes(data, starts, ends)
    count = np.diff(places)
    n = len(count)
    owner = np.repeat(np.arange(n), count)
    index = np.arange(len(words)) - np.repeat(places[:-1], count)
    content = _contents(data, starts, ends, places)
    with np.errstate(over="ignore"):
        full = np.flatnonzero(index + SHINGLE <= np.repeat(count, count))
        few = np.flatnonzero((count > 0) & (count < SHINGLE))
        h = np.zeros(len(full), np.uint64)
        for k in range(SHINGLE):
            h = mix(h * _U(0x9E3779B97F4A7C15) + words[full + k])
    hashes = np.concatenate([h, content[few, 0]])
    owners = np.concatenate([owner[full], few])
    order = np.argsort(owners, kind="stable")
    return content[:, 0], content[:, 1], hashes[order], np.searchsorted(owners[order], np.arange(n + 1))


#: An element is 52 bits, so that it and its text's number in a slice share one word.
_ELEMENT = 52


def bags(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements with multiplicities: texts, distinct elements in each (sorted), counts."""
    owner = np.repeat(np.arange(len(places) - 1, dtype=np.uint64), np.diff(places))
    both = np.sort(owner << _U(_ELEMENT) | hashes >> _U(64 - _ELEMENT))
    new = np.ones(len(both), bool)
    new[1:] = both[1:] != both[:-1]
    first = np.flatnonzero(new)
    return (both[first] >> _U(_ELEMENT)).astype(np.int64), both[first] & _U((1 << _ELEMENT) - 1), np.diff(np.append(first, len(both)))


def _first_points(seed: np.ndarray, begin: np.ndarray, length: np.ndarray, item: np.ndarray, weight: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the steps of all blocks: seeds, first points' times and items, for those that the weights reach in time."""
    time = _times(mix(seed ^ _U(0xE7037ED1A0B428DB))) / length
    done = []
    while len(seed):
        on = (time <= most[item]) & (begin < weight[item])
        seed, begin, length, item, time = (x[on] for x in (seed, begin, length, item, time))
        step = length == 1
        done.append((seed[step], time[step], item[step]))
        seed, begin, half, item, time = seed[~step], begin[~step], length[~step] >> 1, item[~step], time[~step]
        with np.errstate(over="ignore"):
            low, high = mix(seed + _U(0x9E3779B97F4A7C15)), mix(seed + _U(0xC2B2AE3D27D4EB4F))
            coin = mix(seed ^ _U(0xD6E8FEB86659FD93)) >> _U(63) == 1
            later = [time + _times(mix(x ^ _U(0xE7037ED1A0B428DB))) / half for x in (low, high)]
        seed, begin = np.concatenate([low, high]), np.concatenate([begin, begin + half])
        length, item = np.concatenate([half, half]), np.concatenate([item, item])
        time = np.concatenate([np.where(coin, later[0], time), np.where(coin, time, later[1])])
    return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (seed, time, item)


def signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, registers: int) -> np.ndarray:
    """(n, registers) numbers below 2 ** 32, from the texts' bags. A text without elements has none: all ones."""
    total = np.bincount(owner, weight, n)
    best = np.full(n * registers, ~_U(0), np.uint64)
    limit = registers * (np.log(registers) + 4.0) / np.maximum(total, 1)
    # Each block that a weight reaches into is one process: where it begins, how long it is.
    reach = np.where(weight > 1, np.ceil(np.log2(weight)).astype(np.int64), 0)
    item = np.repeat(np.arange(len(weight)), reach + 1)
    block = np.arange(len(item)) - np.repeat(np.cumsum(reach + 1) - reach - 1, reach + 1)
    begin = np.where(block > 0, 1 << np.maximum(block - 1, 0), 0)
    length = np.where(block > 0, begin, 1)
    todo = np.ones(n, bool)
    with np.errstate(over="ignore"):
        while True:
            own = todo[owner[item]]
            seed = mix(element[item][own] + block[own].astype(np.uint64) * _U(0xA0761D6478BD642F))
            seed, t, of = _first_points(seed, begin[own], length[own], item[own], weight, limit[owner])
            text, most, k = owner[of], limit[owner[of]], 0
            while len(seed):
                point = mix(mix(seed + _U(k + 1) * _U(0xE7037ED1A0B428DB)) ^ _U(0x8EBC6AF09C88C6E3))
                slot = text * registers + (point >> _U(32)).astype(np.int64) % registers
                value = t.astype(np.float32).view(np.uint32).astype(np.uint64) << _U(32)
                np.minimum.at(best, slot, value | mix(point + _U(1)) >> _U(32))
                k += 1
                t = t + _times(mix(seed + _U(k + 1) * _U(0xE7037ED1A0B428DB)))
                on = t <= most
                seed, t, most, text = (x[on] for x in (seed, t, most, text))
            empty = (best.reshape(n, registers) == ~_U(0)).any(axis=1) & (total > 0)
            if not empty.any():
                return (best & _U(0xFFFFFFFF)).reshape(n, registers)
            todo, limit = empty, limit * 2


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays of elements with repeats: sum of minima over sum of maxima. Two empty ones are equal."""
    if len(a) > len(b):
        a, b = b, a
    # The k-th copy of an element in a is matched if b has k copies.
    first = np.searchsorted(a, a, "left")
    copy = np.arange(len(a)) - first
    least = int((np.searchsorted(b, a, "right") - np.searchsorted(b, a, "left") > copy).sum())
    both = len(a) + len(b) - least
    return least / both if both else 1.0
