"""Word shingles of many texts at once, as 64-bit hashes.

Words are the runs of ``[^\\x20\\x09-\\x0D]`` of a text with A-Z lower-cased. A word's
hash is the sum of one random number per (place, byte); a shingle's is a sum of five
word hashes with odd factors, mixed. Fixed seeds: the same on every executor.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
SEGMENT = 1 << 20  # bytes hashed at a time, whatever the length of a text
PLACES = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_TABLE = np.random.default_rng(20240229).integers(0, 1 << 64, PLACES * 256, dtype=np.uint64)
_FACTORS = np.random.default_rng(7).integers(0, 1 << 64, WORDS, dtype=np.uint64) | np.uint64(1)
_FAR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _cuts(data: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SEGMENT bytes that cut no word of a text."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + SEGMENT, n)
        while end < n and not _SPACE[data[end]]:
            later = int(np.searchsorted(starts, end))
            if later < len(starts) and starts[later] == end:
                break
            ahead = data[end : end + SEGMENT]
            space = np.flatnonzero(_SPACE[ahead])
            stop = end + (int(space[0]) if len(space) else len(ahead))
            end = min(stop, int(starts[later])) if later < len(starts) else stop
        yield at, end
        at = end


def _hash_words(data: np.ndarray, first_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words; first_bytes: where texts begin."""
    solid = ~_SPACE[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[first_bytes] = solid[first_bytes]
    at = np.flatnonzero(solid)
    if not len(at):
        return at, np.zeros(0, np.uint64)
    opens = begins[at]
    opens[0] = True
    first = np.flatnonzero(opens)
    place = np.arange(len(at), dtype=np.int32) - np.repeat(first, np.diff(np.append(first, len(at)))).astype(np.int32)
    parts = _TABLE[(place % PLACES) * 256 + _LOWER[data[at]]]
    if (far := place >= PLACES).any():
        parts[far] *= _FAR ** (place[far] // PLACES).astype(np.uint64)
    return at[first], mix(np.add.reduceat(parts, first))


def is_space(data: np.ndarray) -> np.ndarray:
    return _SPACE[data]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words before each text and in all); ends: text i is data[ends[i]:ends[i+1]]."""
    hashes, _, bounds = word_places(data, ends)
    return hashes, bounds


def word_places(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of every word, where it begins, number of words before each text and in all)."""
    starts = np.unique(ends[:-1])
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for a, b in _cuts(data, starts):
        own = starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a
        place, hashed = _hash_words(data[a:b], own)
        places.append(place + a)
        hashes.append(hashed)
    begins = np.concatenate(places)
    return np.concatenate(hashes), begins, np.searchsorted(begins, ends)


def shingle_sets(data: np.ndarray, ends: np.ndarray, size: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words is one shingle, one without words none."""
    words, bounds = word_hashes(data, ends)
    rolled = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        rolled += words[k : k + len(rolled)] * _FACTORS[k]
    rolled = mix(rolled)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            yield mix(np.sum(words[a:b] * _FACTORS[: b - a], dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def flat(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow text column (no nulls) as its bytes and ends, counted from 0."""
    import pyarrow as pa

    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, data = column.buffers()
    at = np.frombuffer(ends, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


PREFIXES = (4, 5, 6, 7)
_NO_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def _terms(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the words of letters and digits, and of their first bytes."""
    low = _LOWER[data]
    # Upper-case letters of Latin-1 in UTF-8.
    low[1:] += ((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) * np.uint8(32)
    solid = ~_NO_WORD[data]
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    begins[starts] = solid[starts]
    at = np.flatnonzero(solid)
    if not len(at):
        return at, np.zeros(0, np.uint32)
    opens = begins[at]
    opens[0] = True
    first = np.flatnonzero(opens)
    sizes = np.diff(np.append(first, len(at)))
    place = np.arange(len(at), dtype=np.int32) - np.repeat(first, sizes).astype(np.int32)
    parts = _TABLE[(place % PLACES) * 256 + low[at]]
    if (far := place >= PLACES).any():
        parts[far] *= _FAR ** (place[far] // PLACES).astype(np.uint64)
    places, hashes = [at[first]], [mix(np.add.reduceat(parts, first))]
    for k in PREFIXES:
        longer = sizes > k
        cut = np.add.reduceat(np.where(place < k, parts, np.uint64(0)), first)
        places.append(at[first][longer])
        hashes.append(mix(cut[longer] + np.uint64(k)))
    return np.concatenate(places), (np.concatenate(hashes) >> np.uint64(32)).astype(np.uint32)


def term_hashes(data: np.ndarray, ends: np.ndarray) -> Iterator[np.ndarray]:
    """The hashed terms (words and prefixes of words, 32 bits) of each text, in no order."""
    starts = np.unique(ends[:-1])
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
    for a, b in _cuts(data, starts):
        place, hashed = _terms(data[a:b], starts[np.searchsorted(starts, a) : np.searchsorted(starts, b)] - a)
        places.append(place + a)
        hashes.append(hashed)
    of = np.searchsorted(ends, np.concatenate(places), "right")
    order = np.argsort(of, kind="stable")
    found = np.concatenate(hashes)[order]
    bounds = np.searchsorted(of[order], np.arange(1, len(ends) + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        yield found[a:b]
