"""Token ids of whole texts by a public tokenizer, in bounded memory, with repeated words encoded once."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from ._bytes import U64, byte_codes, flat, keys, mix, scattered, separators

#: Words that a worker remembers (about 80 bytes each).
REMEMBERED = 1_000_000
#: Bytes that are cut into words at once.
BLOCK = 1 << 20

#: Bytes of a word that are compared as two numbers.
HEAD = 16
#: Masks of the first bytes of a number.
_FIRST = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)

#: Next to a space that a text may be cut at: no ASCII white space or control, and no byte that may belong
#: to other white space (their UTF-8 begins with one of these lead bytes).
_UNSURE = separators([(0x00, 0x20), (0x7F, 0x7F), (0xC2, 0xC2), (0xE1, 0xE3)])
_LETTER = separators([(0x41, 0x5A), (0x61, 0x7A)])
_loaded: dict[tuple[str, str], Encoder] = {}


def _open(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the character before a place may be white space."""
    last = buf[at - 1]
    return _UNSURE[last] & (last < 0x80) | (last >= 0x80) & (_UNSURE[buf[at - 2]] & (buf[at - 2] >= 0xC0) | _UNSURE[buf[at - 3]] & (buf[at - 3] >= 0xE0))


def _ordered(*places: np.ndarray) -> np.ndarray:
    """All places once, ascending."""
    x = np.sort(np.concatenate(places))
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x.astype(np.int64)


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of all ranges, one after the other."""
    return np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Encoder:
    """Encodes texts as the library does with add_special_tokens=False, where the file's added tokens stand for themselves.

    `spaces` says how: "kept" for byte-level vocabularies whose words begin with their space (a text is cut
    before single spaces between other characters, where no word can go on), "dropped" for those that
    drop white space. Words met before come from memory, so that the library sees each new one; what memory
    finds by a hash is compared byte by byte, and a word that only shares another's hash goes to the library.
    """

    def __init__(self, path: str, spaces: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        added = [t.content.encode() for t in self._library.get_added_tokens_decoder().values()]
        self._added = sorted(added, key=len, reverse=True)
        size = self._library.get_vocab_size()
        self.size, self.kind = size, np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self._kept = spaces == "kept"
        # words by hash: where their ids begin in the pool, how many, and the round of their last use
        self._keys, self._pool, self._now = np.zeros(0, U64), np.zeros(0, self.kind), 0
        self._first, self._size, self._round, self._from, self._long = (np.zeros(0, np.int64) for _ in range(5))
        # their first 16 bytes as two numbers, and the others' bytes, one after the other
        self._head, self._next, self._text = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.uint8)
        if self._kept:
            # a byte-level vocabulary spells one byte with one character
            self._bytes = np.zeros(size, np.int64)
            for token, i in self._library.get_vocab().items():
                self._bytes[i] = len(token)
        else:
            self._mark = self._library.encode("\x00", add_special_tokens=False).ids
        # where the tokenizer drops case and white space, words that differ in them alone share their ids
        self._fold = np.arange(256, dtype=np.uint8)
        if not self._kept:
            self._fold[0x41:0x5B] += 0x20
            self._fold[0x0A] = 0x20
        self._codes = byte_codes(lower=False)[self._fold]

    @classmethod
    def of(cls, path: str, spaces: str) -> Encoder:
        if (path, spaces) not in _loaded:
            _loaded[path, spaces] = cls(path, spaces)
        return _loaded[path, spaces]

    def _cuts(self, buf: np.ndarray, low: int, high: int) -> np.ndarray:
        """Places in [low, high) where a text may be cut."""
        part = buf[low:high]
        # a letter's word ends before a full stop or comma
        stop = np.flatnonzero((part == 0x2E) | (part == 0x2C)) + low
        stop = stop[_LETTER[buf[stop - 1]] & (stop > 0)]
        if not self._kept:
            return np.sort(np.concatenate((stop, np.flatnonzero((part == 0x20) | (part == 0x0A)) + low)))
        at = np.flatnonzero((part == 0x20) | (part == 0x0A)) + low
        at = at[(at > 2) & (at < len(buf) - 1)]
        at = at[~(_UNSURE[buf[at + 1]] | _open(buf, at))]
        # a line's end is a word of its own
        after = at[buf[at] == 0x0A] + 1
        return _ordered(stop, at, after[after < high])

    def _named(self, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where added tokens stand in the rows: places (start, end), of overlapping ones the first and longest."""
        low, high = int(at[0]), int(at[-1])
        data = buf[low:high].tobytes()
        found = []
        if any(t in data for t in self._added):
            pattern = re.compile(b"|".join(map(re.escape, self._added)))
            for a, b in zip((at[:-1] - low).tolist(), (at[1:] - low).tolist(), strict=True):
                found += [m.span() for m in pattern.finditer(data, a, b)]
        return np.array(found, np.int64).reshape(-1, 2) + low

    def _blocks(self, buf: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int]]:
        low, end = int(at[0]), int(at[-1])
        while low < end:
            high = min(end, low + BLOCK)
            if high < end:
                row = int(at[np.searchsorted(at, high, "right") - 1])
                if row > low:
                    high = row
                else:
                    stop, step = int(at[np.searchsorted(at, high, "left")]), high
                    while step < stop:
                        cut = self._cuts(buf, step, min(stop, step + BLOCK))
                        if len(cut):
                            stop = int(cut[0])
                            break
                        step += BLOCK
                    high = stop
            yield low, high
            low = high

    def _new(self, buf: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of the words buf[a:b], one after the other, and how many each has: many words in one call, those it could join with others alone."""
        low, high = int(a.min()), int(b.max())
        if not self._kept:
            zeros = np.flatnonzero(buf[low:high] == 0) + low
            alone = np.searchsorted(zeros, a) < np.searchsorted(zeros, b) if len(self._mark) == 1 else np.ones(len(a), bool)
        else:
            spaced = buf[a] == 0x20
            alone = _UNSURE[buf[a]] & ~spaced | spaced & ((b - a < 2) | _UNSURE[buf[np.minimum(a + 1, len(buf) - 1)]]) | (b - a < 3) & (buf[b - 1] >= 0x80) | _open(buf, b)
        data = buf[low:high].tobytes()
        words = [data[s:e] for s, e in zip((a - low).tolist(), (b - low).tolist(), strict=True)]
        named = frozenset(self._added)
        alone = alone | np.fromiter((w in named for w in words), bool, len(words))
        own, rest = np.flatnonzero(alone), np.flatnonzero(~alone)
        found = [np.array(e.ids, self.kind) for e in self._library.encode_batch_fast([words[i].decode() for i in own.tolist()], add_special_tokens=False)]
        size, parts = np.zeros(len(a), np.int64), found
        size[own] = [len(x) for x in found]
        for at in range(0, len(rest), 8192):
            part = rest[at : at + 8192]
            ids, size[part] = self._joined([words[i] for i in part.tolist()])
            parts.append(ids)
        pool = np.concatenate([*parts, np.zeros(0, self.kind)])
        # the words' own order
        order = np.concatenate((own, rest))
        begin = np.empty(len(a), np.int64)
        begin[order] = np.cumsum(size[order]) - size[order]
        return pool[_ranges(begin, size)], size

    def _joined(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self._kept:
            ids = np.array(self._library.encode_batch_fast([b"\n".join(words).decode()], add_special_tokens=False)[0].ids, self.kind)
            ends, size = np.cumsum(self._bytes[ids]), np.array([len(w) for w in words])
            stop = np.cumsum(size + 1) - 1
            begin, cut = np.searchsorted(ends, stop - size, "right"), np.searchsorted(ends, stop, "left") + 1
        else:
            ids = np.array(self._library.encode_batch_fast([b" \x00 ".join([*words, b""]).decode()], add_special_tokens=False)[0].ids, self.kind)
            cut = np.flatnonzero(ids == self._mark[0])
            begin = np.concatenate(([0], cut[:-1] + 1))
        return ids[_ranges(begin, cut - begin)], cut - begin

    def _learn(self, names: np.ndarray, ids: np.ndarray, size: np.ndarray, head: np.ndarray, next: np.ndarray, long: np.ndarray, tail: np.ndarray) -> None:
        """Remember ids and bytes of new words (names ascending; `tail` holds what is beyond their first 16 bytes)."""
        beyond = np.maximum(long - HEAD, 0)
        first, origin = len(self._pool) + np.cumsum(size) - size, len(self._text) + np.cumsum(beyond) - beyond
        self._pool, self._text = np.concatenate((self._pool, ids)), np.concatenate((self._text, tail))
        at = np.searchsorted(self._keys, names)
        self._keys = np.insert(self._keys, at, names)
        for name, new in (("_first", first), ("_size", size), ("_from", origin), ("_long", long), ("_head", head), ("_next", next), ("_round", self._now)):
            setattr(self, name, np.insert(getattr(self, name), at, new))

    def _forget(self) -> None:
        """Of too many words, those met in this or the last round stay."""
        if len(self._keys) > REMEMBERED:
            stay = self._round >= self._now
            for data, begin, n in (("_pool", "_first", self._size[stay]), ("_text", "_from", np.maximum(self._long[stay] - HEAD, 0))):
                setattr(self, data, getattr(self, data)[_ranges(getattr(self, begin)[stay], n)])
                setattr(self, begin, np.cumsum(n) - n)
            for name in ("_size", "_long", "_head", "_next", "_keys", "_round"):
                setattr(self, name, getattr(self, name)[stay])
            self._now += 1

    def _hashes(self, piece: np.ndarray, at: np.ndarray, n: np.ndarray, head: np.ndarray, next: np.ndarray) -> np.ndarray:
        """Of the words at the places `at`: their first 16 bytes, lengths, and numbers for further bytes at their places, mixed."""
        names = mix(next ^ n.astype(U64) * U64(0x9E3779B97F4A7C15))
        long = np.flatnonzero(n > HEAD)
        if len(long):
            beyond = n[long] - HEAD
            place = _ranges(np.zeros(len(long), np.int64), beyond)
            codes = self._codes[piece[place + np.repeat(at[long] + HEAD, beyond)]]
            names[long] ^= np.add.reduceat(scattered(codes, keys(int(beyond.max()))[place]), np.cumsum(beyond) - beyond)
        return names ^ mix(head)

    def _others(self, piece: np.ndarray, at: np.ndarray, n: np.ndarray, head: np.ndarray, next: np.ndarray, found: np.ndarray) -> np.ndarray:
        """Which of the words at the places `at` have other bytes than the remembered words `found`."""
        other = (self._head[found] != head) | (self._next[found] != next) | (self._long[found] != n)
        long = np.flatnonzero((n > HEAD) & ~other)
        if len(long):
            beyond = n[long] - HEAD
            differ = self._text[_ranges(self._from[found[long]], beyond)] != piece[_ranges(at[long] + HEAD, beyond)]
            if differ.any():
                other[long] = np.logical_or.reduceat(differ, np.cumsum(beyond) - beyond)
        return other

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a string column, in order, and the offsets of the rows in them."""
        buf, at = flat(column)
        ids, counts, places = [np.zeros(0, self.kind)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        named = self._named(buf, at)
        edges = _ordered(at, named.ravel()) if len(named) else at
        for low, high in self._blocks(buf, edges):
            cuts = self._cuts(buf, low, high)
            if len(named):
                k = np.searchsorted(named[:, 0], cuts, "left") - 1
                cuts = cuts[(k < 0) | (cuts >= named[k, 1])]
            starts = _ordered([low], edges[(edges >= low) & (edges < high)], cuts)
            ends = np.append(starts[1:], high)
            n, local = ends - starts, starts - low
            piece = np.concatenate((buf[low:high] if self._kept else self._fold[buf[low:high]], np.zeros(HEAD, np.uint8)))
            eight = np.ndarray((len(piece) - 7,), "<u8", piece, strides=(1,))
            head, next = eight[local] & _FIRST[np.minimum(n, 8)], eight[local + 8] & _FIRST[np.clip(n - 8, 0, 8)]
            value = self._hashes(piece, local, n, head, next)
            if len(named):  # an added token is no word that reads like it in lower case
                value[np.isin(starts, named[:, 0])] ^= U64(1 << 63)
            value = mix(value)
            order = np.argsort(value)
            value = value[order]
            fresh = np.concatenate(([True], value[1:] != value[:-1]))
            names, first, which = value[fresh], order[fresh], np.empty(len(order), np.int64)
            which[order] = np.cumsum(fresh) - 1
            found = np.searchsorted(self._keys, names)
            new = np.flatnonzero(self._keys[np.minimum(found, len(self._keys) - 1)] != names) if len(self._keys) else np.arange(len(names))
            if len(new):
                own = first[new]
                tail = piece[_ranges(local[own] + HEAD, np.maximum(n[own] - HEAD, 0))]
                self._learn(names[new], *self._new(buf, starts[own], ends[own]), head[own], next[own], n[own], tail)
                found = np.searchsorted(self._keys, names)
            self._round[found] = self._now
            found = found[which]
            others = self._others(piece, local, n, head, next, found)
            n, begin, pool = self._size[found], self._first[found], self._pool
            if others.any():
                own, n[others] = self._new(buf, starts[others], ends[others])
                begin[others] = len(pool) + np.cumsum(n[others]) - n[others]
                pool = np.concatenate((pool, own))
            ids.append(pool[_ranges(begin, n)])
            self._forget()
            counts.append(n)
            places.append(starts)
        n, place = np.concatenate(counts), np.concatenate(places)
        total = np.concatenate(([0], np.cumsum(n)))
        return np.concatenate(ids), total[np.searchsorted(place, at, "left")]


def merged(batches: Iterator[pa.RecordBatch], text: int, most: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Consecutive batches joined until their column number `text` holds `most` bytes."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.column(text).nbytes
        if size >= most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else batch
            held, size = [], 0
    held = [b for b in held if b.num_rows]
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
