"""Words and shingles of a column of texts as 64-bit numbers, in numpy, many texts at a time."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa

from ledgerwork.llm import runtime

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_STEP = _U(0xD6E8FEB86659FD93)
_MASK = (1 << 64) - 1
#: Bytes of a word that is hashed by itself.
LONG = 32
#: Bytes hashed at once; a longer text is cut at white space.
_BLOCK = 1 << 21

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Every bit of the result depends on every bit of `x` (64-bit finalizer of splitmix)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: A random number for each byte; A-Z count as a-z.
_BYTE = mix(np.arange(1, 257, dtype=_U) * _STEP)
_BYTE[65:91] = _BYTE[97:123]

_powers = np.ones(1, _U), np.ones(1, _U)


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least n + 1 of them."""
    global _powers
    if len(_powers[0]) <= n:
        grown = []
        for base in (_BASE, _INVERSE):
            out = np.full(n + n // 4 + 2, base, _U)
            out[0] = 1
            grown.append(np.multiply.accumulate(out))
        _powers = tuple(grown)
    return _powers


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A text column as one run of bytes and the n + 1 offsets of its texts; null is empty."""
    array = runtime.text_bytes(column)
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1, array.offset * 8)
    data = array.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of bytes, the same wherever the span stands."""
    power, inverse = _powers_to(len(data))
    sums = np.empty(len(data) + 1, _U)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U) * _STEP)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word (run of bytes without white space, A-Z as a-z) and the text it is of, in order."""
    hashes, first = placed_words(data, offsets)
    return hashes, np.searchsorted(offsets, first, "right") - 1


def placed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word and where it begins."""
    hashes, first = [], []
    low = 0
    while low < len(data):
        high = len(data)
        if high - low > 2 * _BLOCK:
            # up to white space, so that no word is cut
            high = low + _BLOCK
            while high < len(data):
                gap = np.flatnonzero(_WHITE[data[high : high + 4096]])
                if len(gap):
                    high += int(gap[0])
                    break
                high = min(high + 4096, len(data))
        block = data[low:high]
        inside = ~_WHITE[block]
        start, end = inside.copy(), inside.copy()
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offsets[(offsets > low) & (offsets < high)] - low
        start[edges] |= inside[edges]
        end[edges - 1] |= inside[edges - 1]
        starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
        hashed = spans_hash(block, starts, ends)
        # sums modulo 2^64 can be made to agree for long words; theirs is a cryptographic hash
        for k in np.flatnonzero(ends - starts > LONG).tolist():
            word = block[starts[k] : ends[k]].tobytes().lower()
            hashed[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        hashes.append(hashed)
        first.append(starts + low)
        low = high
    if not hashes:
        return np.empty(0, _U), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(first)


def word_shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of `size` words of each text, ascending, and the n + 1 offsets of the texts.

    A text of fewer words has all of them as its one shingle; one without words has none."""
    data, offsets = buffers(column)
    word, of = words(data, offsets)
    n = len(offsets) - 1
    count = np.bincount(of, minlength=n)
    first = np.concatenate(([0], np.cumsum(count)))[:-1]
    full = np.flatnonzero(of[: len(of) - size + 1] == of[size - 1 :]) if len(of) >= size else np.empty(0, np.int64)
    found, owner = [_chain(word, full, size)], [of[full]]
    for few in range(1, size):
        texts = np.flatnonzero(count == few)
        if len(texts):
            found.append(_chain(word, first[texts], few))
            owner.append(texts)
    shingle, owner = np.concatenate(found), np.concatenate(owner)
    if len(found) > 1:
        order = np.argsort(owner, kind="stable")
        shingle, owner = shingle[order], owner[order]
    return distinct(shingle, np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=n)))))


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each run of values ascending and without repeats (the array is sorted in place), and the new offsets."""
    bounds = offsets.tolist()
    for low, high in zip(bounds, bounds[1:], strict=False):
        values[low:high].sort()
    if not len(values):
        return values, offsets
    new = np.concatenate(([True], values[1:] != values[:-1]))
    new[offsets[:-1][np.diff(offsets) > 0]] = True
    return values[new], np.concatenate(([0], np.cumsum(new)))[offsets]


def _chain(word: np.ndarray, first: np.ndarray, size: int) -> np.ndarray:
    """One number of `size` words from each first one on."""
    chained = word[first] + _U(size * int(_STEP) & _MASK)
    for k in range(1, size):
        chained = mix(chained) + word[first + k]
    return mix(chained)


def fingerprint(shingle: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Two numbers of each set, equal for equal sets: sums of two random functions of its members."""
    out = np.zeros((len(offsets) - 1, 2), _U)
    some = np.flatnonzero(np.diff(offsets))
    if len(some):
        for k in range(2):
            out[some, k] = np.add.reduceat(mix(shingle + _U((k + 1) * int(_STEP) & _MASK)), offsets[some])
    return out


def shared(left: np.ndarray, right: np.ndarray) -> int:
    """How many numbers two ascending arrays without repeats have in common."""
    if len(left) > len(right):
        left, right = right, left
    if not len(left):
        return 0
    at = np.searchsorted(right, left)
    at[at == len(right)] = 0
    return int(np.count_nonzero(right[at] == left))
