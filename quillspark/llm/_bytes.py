"""Vectorised work on UTF-8 bytes: words, hashes, rolling windows. No Python loop runs per word or byte."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
#: Bytes that are worked on at once: the arrays about them stay in a core's cache.
_BLOCK = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits (splitmix64)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def byte_codes(lower: bool) -> np.ndarray:
    """A 64-bit code for each byte value; with `lower`, A-Z share those of a-z."""
    codes = mix(np.arange(1, 257, dtype=U64) * U64(0x2545F4914F6CDD1D))
    if lower:
        codes[65:91] = codes[97:123]
    return codes


def separators(ranges: list[tuple[int, int]]) -> np.ndarray:
    sep = np.zeros(256, dtype=bool)
    for a, b in ranges:
        sep[a : b + 1] = True
    return sep


#: Between words: space and the ASCII control white space.
WHITE = separators([(0x20, 0x20), (0x09, 0x0D)])
#: Between words: all ASCII but digits and letters.
NOT_WORD = separators([(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])

_keys = np.zeros(0, dtype=U64)


def keys(n: int) -> np.ndarray:
    """Fixed random numbers for the first n places of a word."""
    global _keys
    if len(_keys) < n:
        _keys = mix(np.arange(1, max(n, 4096) + 1, dtype=U64) * U64(0xA24BAED4963EE407))
    return _keys[:n]


def scattered(codes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A number for each byte at its place: no multiple or sum of others, so that words of any shape differ in their sums."""
    x = codes ^ keys
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(29)
    return x


_powers = np.ones(1, dtype=U64)


def powers(n: int) -> np.ndarray:
    """The first n powers of the base, modulo 2**64."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 4096), _BASE, dtype=U64)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column, without copying, and the offsets of its rows (nulls are empty)."""
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def _blocks(buf: np.ndarray, at: np.ndarray, sep: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about _BLOCK bytes that end at a row's end or before a separator, so that no word is cut."""
    low, end = int(at[0]), int(at[-1])
    while low < end:
        high = min(end, low + _BLOCK)
        if high < end:
            row = int(at[np.searchsorted(at, high, "right") - 1])
            if row > low:
                high = row
            else:
                stop = int(at[np.searchsorted(at, high, "left")])
                step = high
                while step < stop:
                    hit = np.flatnonzero(sep[buf[step : min(stop, step + _BLOCK)]])
                    if len(hit):
                        stop = step + int(hit[0])
                        break
                    step += _BLOCK
                high = stop
        yield low, high
        low = high


def spans(column: pa.Array, sep: np.ndarray, lower: bool = True) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of about _BLOCK bytes: the places of words in the column's bytes, their lengths and 64-bit hashes.

    A hash is the mixed sum of numbers that depend on byte and place in no linear way. Two given words share one with
    probability 2**-64; no byte is compared afterwards.
    """
    buf, at = flat(column)
    codes = byte_codes(lower)
    for low, high in _blocks(buf, at, sep):
        part = buf[low:high]
        inside = ~sep[part]
        edge = np.zeros(high - low + 1, dtype=bool)
        rows = at[(at >= low) & (at < high)] - low
        edge[rows] = True
        edge[0] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1 : high - low]
        starts = np.flatnonzero(begin)
        if not len(starts):
            continue
        place = np.zeros(high - low, dtype=np.int64)
        place[starts[0] :] = np.arange(starts[0], high - low) - np.repeat(starts, np.diff(np.append(starts, high - low)))
        place[~inside] = 0
        value = scattered(codes[part], keys(int(place.max()) + 1)[place])
        value[~inside] = 0
        yield starts + low, np.add.reduceat(inside, starts, dtype=np.int64), mix(np.add.reduceat(value, starts))


def words(column: pa.Array, sep: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the rows, in order, and the offsets of the rows in them."""
    found, place = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    for starts, _, hashes in spans(column, sep, lower):
        found.append(hashes)
        place.append(starts)
    return np.concatenate(found), np.searchsorted(np.concatenate(place), flat(column)[1], "left")


def name(word: str, lower: bool = True) -> int:
    """The hash that `words` gives a word."""
    data = np.frombuffer(word.encode(), np.uint8)
    return int(mix(scattered(byte_codes(lower)[data], keys(len(data))).sum(keepdims=True))[0])


def shingles(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words; fewer words than k (but some) make one shingle."""
    n = len(word)
    if n == 0:
        return word
    size = min(k, n)
    total = np.zeros(n - size + 1, dtype=U64)
    scale = powers(k + 1)
    for j in range(size):
        total += word[j : n - size + 1 + j] * scale[j + 1]
    return mix(total ^ U64(size))


def rolling(buf: np.ndarray, k: int, codes: np.ndarray) -> np.ndarray:
    """Hashes of all k-byte windows of `buf`."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    value, span, total, done = codes[buf], 1, None, 0
    # windows of 1, 2, 4, ... bytes; those of k's binary digits are joined
    width = value
    scale = powers(k + 1)
    bits = k
    while bits:
        if bits & 1:
            piece = width[done : done + n]
            total = piece * scale[done] if total is None else total + piece * scale[done]
            done += span
        bits >>= 1
        if bits:
            width = width[: len(width) - span] + width[span:] * scale[span]
            span *= 2
    return mix(total)


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each w consecutive values; none if there are fewer."""
    if len(x) < w:
        return x[:0]
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[: len(out) - span], out[span:])
        span *= 2
    rest = w - span
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def minima(x: np.ndarray, w: int) -> np.ndarray:
    """Which values are the minimum of some w consecutive values; of equal ones all are."""
    if len(x) < w:
        return np.zeros(len(x), dtype=bool)
    low = window_min(x, w)
    pad = np.zeros(w - 1, dtype=x.dtype)
    # the greatest minimum among the windows that hold a place; the complement turns minimum into maximum
    top = ~window_min(~np.concatenate((pad, low, pad)), w)
    return (top == x) if w > 1 else np.ones(len(x), dtype=bool)
