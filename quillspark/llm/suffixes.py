"""Removal of repeated byte strings by difference-cover suffix sorting, spread over buckets of the corpus."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import U64, byte_codes, flat, rolling, window_min
from ._files import Side
from ._shared import discard, keep, marked, salted_join, save, scratch, shuffle_partitions, small_batches
from .tokens import merged

#: Bytes of a string that counts as repeated, and of the grams whose minimum names a string's bucket.
SPAN, GRAM = 50, 26
#: Mean bytes of a content-defined chunk, and of the gram that ends it.
CHUNK, MARK = 256, 16
#: Bytes of text that are hashed at once (what a core's cache holds), and of strings that are sorted at once.
BLOCK, SORTED = 1 << 16, 1 << 18
#: Different strings of a key beyond which the key is split, and how many times as many rows of a key meet in one task.
MANY, FEW = 4096, 4
#: Bytes of text for which strings are settled in a round of their own, and rounds at most.
ROUND, ROUNDS = 256 << 20, 8
#: Stands for a null doc_id: greater than all.
LAST = (1 << 63) - 1


# --- difference-cover suffix sorting ------------------------------------------------------------


def _names(*keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense ranks of tuples, from 1, and their number."""
    wide = int(max(k.max(initial=0) for k in keys)) + 1
    if wide ** len(keys) < 1 << 62:
        packed = keys[0].astype(np.int64)
        for k in keys[1:]:
            packed = packed * wide + k
        keys = (packed,)
        order = np.argsort(packed)
    else:
        order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new) + 1
    return rank, int(rank.max(initial=0))


def suffix_order(x: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of `x` (numbers from 1) in the order of their first `depth` numbers, at least.

    Difference cover modulo 3: suffixes at places 1 and 2 modulo 3 are named by their triples; the string
    of names is sorted in the same way, until names are unique or stand for `depth` numbers; the others
    are sorted by their first number and the rank behind it, and merged in. The end is less than all.
    """
    n = len(x)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: x[i:].tolist()), np.int64)
    t = np.concatenate((x, np.zeros(5, np.int64)))
    # one more place 1 modulo 3 at the end keeps the two halves of the names apart
    one, two = np.arange(1, n + 1 + (n % 3 == 0), 3), np.arange(2, n + 1, 3)
    one = np.append(one, one[-1] + 3) if one[-1] < n else one
    sample = np.concatenate((one, two))
    t = np.concatenate((t, np.zeros(max(0, int(sample.max()) + 5 - len(t)), np.int64)))
    name, many = _names(t[sample], t[sample + 1], t[sample + 2])
    if many < len(sample) and depth > 3:
        order = suffix_order(name, -(-depth // 3))
        rank_of = np.empty(len(sample), np.int64)
        rank_of[order] = np.arange(1, len(sample) + 1)
    else:
        rank_of = np.empty(len(sample), np.int64)
        rank_of[np.argsort(name)] = np.arange(1, len(sample) + 1)
    rank = np.zeros(len(t) + 3, np.int64)
    rank[sample] = rank_of
    rest = np.arange(0, n, 3)
    scale = np.int64(len(t) + 4)
    rest = rest[np.argsort(t[rest] * scale + rank[rest + 1])]
    wide = np.int64(int(t.max()) + 1)
    # how many sampled suffixes are less than each of the rest: those of either class have a key of their own
    key = lambda i: t[i] * scale + rank[i + 1]
    less = np.searchsorted(np.sort(key(one)), key(rest))
    if int(wide) * int(wide) * int(scale) < 1 << 62:
        key = lambda i: (t[i] * wide + t[i + 1]) * scale + rank[i + 2]
        less = less + np.searchsorted(np.sort(key(two)), key(rest))
    else:
        pair = np.concatenate((t[two] * wide + t[two + 1], t[rest] * wide + t[rest + 1]))
        first, _ = _names(pair)
        a = first[: len(two)] * scale + rank[two + 2]
        less = less + np.searchsorted(np.sort(a), first[len(two) :] * scale + rank[rest + 2])
    by_rank = np.empty(len(sample), np.int64)
    by_rank[rank_of - 1] = sample
    # suffixes that agree in all of the depth may come in any order, also here
    place = np.maximum.accumulate(less) + np.arange(len(rest))
    out, free = np.empty(len(sample) + len(rest), np.int64), np.ones(len(sample) + len(rest), bool)
    out[place], free[place] = rest, False
    out[free] = by_rank
    return out[out < n]


def classes(strings: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All `span`-byte windows of the strings: string, place in it, and a number that equal windows share."""
    # a separator after each string, less than all bytes
    data = np.frombuffer(b"\0".join([*strings, b"\0" * 8]), np.uint8)
    sizes = np.array([len(s) for s in strings])
    starts = np.cumsum(sizes + 1) - sizes - 1
    x = data[: int(sizes.sum()) + len(sizes)].astype(np.int64) + 2
    x[starts + sizes] = 1
    order = suffix_order(x, span)
    owner = np.repeat(np.arange(len(strings)), sizes + 1)
    string = owner[order]
    place = order - starts[string]
    own = place + span <= sizes[string]
    order, string, place = order[own], string[own], place[own]
    same = np.zeros(len(order), bool)
    # eight bytes at a time, wherever they begin
    words = np.ndarray(len(data) - 7, "<u8", data, strides=(1,))
    a, b = order[:-1], order[1:]
    if len(order):
        same[1:] = True
    for at in [*range(0, span - 8, 8), span - 8]:
        same[1:] &= words[a + at] == words[b + at]
    return string, place, np.cumsum(~same)


# --- passes over the texts ----------------------------------------------------------------------


def _scan(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, int, int, np.ndarray, np.ndarray]]:
    """For runs of a batch's bytes: all bytes, the run, each place's row, and whether SPAN bytes of its row begin there."""
    buf, at = flat(batch.column(2))
    low = int(at[0])
    while low < int(at[-1]):
        high = min(int(at[-1]), low + BLOCK)
        a, b = np.searchsorted(at, low, "right") - 1, np.searchsorted(at, high, "left")
        bounds = np.clip(at[a : b + 1], low, high)
        rows = np.repeat(np.arange(a, b), np.diff(bounds))
        whole = np.arange(low, high) + SPAN <= at[rows + 1]
        yield buf, low, high, rows, whole
        low = high


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Content-defined chunks of the places where windows begin, named by all bytes of those windows."""
    codes = byte_codes(lower=False)
    for batch in _ascending(batches):
        cuts = []
        at = flat(batch.column(2))[1]
        buf = flat(batch.column(2))[0]
        for low in range(int(at[0]), int(at[-1]), BLOCK):
            part = rolling(buf[low : min(int(at[-1]), low + BLOCK + MARK - 1)], MARK, codes)
            cuts.append(np.flatnonzero((part >> U64(40)) % U64(CHUNK) == 0) + low)
        cuts = np.concatenate(cuts or [np.zeros(0, np.int64)])
        rows, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        data = memoryview(buf)
        out_row, out_id, out_at, out_n, out_name = [], [], [], [], []

        def ready() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(out_row, pa.int64()), pa.array(out_id, pa.int64()), pa.array(out_at, pa.int64()), pa.array(out_n, pa.int64()), pa.array(out_name, pa.binary())],
                names=["row", "id", "at", "n", "name"],
            )

        for i in np.flatnonzero(np.diff(at) >= SPAN).tolist():
            low, high = int(at[i]), int(at[i + 1]) - SPAN + 1
            own = cuts[np.searchsorted(cuts, low, "right") : np.searchsorted(cuts, high, "left")].tolist()
            for a, b in zip([low, *own], [*own, high], strict=True):
                out_row.append(rows[i])
                out_id.append(ids[i])
                out_at.append(a - low)
                out_n.append(b - a)
                out_name.append(hashlib.blake2b(data[a : b + SPAN - 1], digest_size=32).digest())
            if len(out_row) >= 8192:
                yield ready()
                out_row, out_id, out_at, out_n, out_name = [], [], [], [], []
        yield ready()


def _runs(batch: pa.RecordBatch, gone: Side) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of windows with one key: all bytes, first place, number of windows, row in the batch, key.

    A window's key is the least hash of its grams, so that equal windows have equal keys. Windows in chunks
    that are gone are left out.
    """
    codes, rows = byte_codes(lower=False), batch.column(0).to_numpy()
    at = flat(batch.column(2))[1]
    spans = gone.of(rows)
    for buf, low, high, row, live in _scan(batch):
        key = window_min(rolling(buf[low : high + SPAN - 1], GRAM, codes), SPAN - GRAM + 1)
        if not len(key):
            continue
        live = live[: len(key)].copy()
        a, b = int(row[0]), int(row[-1])
        x, y = np.searchsorted(spans["_at"], a, "left"), np.searchsorted(spans["_at"], b, "right")
        for i, s, n in zip(spans["_at"][x:y].tolist(), spans["at"][x:y].tolist(), spans["n"][x:y].tolist(), strict=True):
            first = int(at[i]) + s - low
            live[max(first, 0) : max(first + n, 0)] = False
        change = np.ones(len(key), bool)
        change[1:] = (key[1:] != key[:-1]) | (row[1 : len(key)] != row[: len(key) - 1]) | (live[1:] != live[:-1])
        start = np.flatnonzero(change)
        n = np.diff(np.append(start, len(key)))
        own = live[start]
        start, n = start[own], n[own]
        if len(start):
            yield buf, start + low, n, row[start], key[start]


def _keys(gone_folder: str, buckets: int):
    """The keys of all rows, by bucket: 32 bits of each, once for a run of texts, and whether several rows of the run hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone = Side(gone_folder, ["at", "n"])
        for batch in _ascending(batches):
            rows = batch.column(0).to_numpy()
            # rows are numbered on within a file; a batch may hold several files
            for low in _pieces(rows):
                part = batch.slice(low[0], low[1] - low[0])
                found = [(r, k) for _, _, _, r, k in _runs(part, gone)]
                if not found:
                    continue
                key, row = np.concatenate([k for _, k in found]), np.concatenate([r for r, _ in found])
                order = np.argsort(key, kind="stable")
                key, row = key[order], row[order]
                first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
                several = np.minimum.reduceat(row, first) != np.maximum.reduceat(row, first)
                key = key[first]
                bucket = ((key >> U64(32)) * U64(buckets)) >> U64(32)
                cut = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
                small, ends = (key & U64(0xFFFFFFFF)).astype("<u4"), np.append(cut[1:], len(key))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(bucket[cut].astype(np.int32)),
                        pa.array(np.full(len(cut), rows[low[0]])),
                        pa.array([small[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary()),
                        pa.array([np.packbits(several[a:b]).tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary()),
                    ],
                    names=["bucket", "first", "keys", "several"],
                )

    return run


def _ascending(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Larger batches whose row numbers ascend: a task reads its files by size, not by number."""
    for batch in merged(batches, 2, 1 << 21):
        cut = np.flatnonzero(np.diff(batch.column(0).to_numpy()) < 0) + 1
        for low, high in zip([0, *cut.tolist()], [*cut.tolist(), batch.num_rows], strict=True):
            yield batch.slice(low, high - low)


def _pieces(rows: np.ndarray) -> list[tuple[int, int]]:
    cut = np.flatnonzero(np.concatenate(([True], np.diff(rows) != 1)))
    return list(zip(cut.tolist(), np.append(cut[1:], len(rows)).tolist(), strict=True))


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket: the keys that two rows or more hold, by file of texts. What names a key here are its bucket and 32 bits."""

    def settle(bucket: int, keys: list, files: list, several: list) -> Iterator[pa.RecordBatch]:
        key, file, many = np.concatenate(keys), np.repeat(files, [len(k) for k in keys]), np.concatenate(several)
        order = np.argsort(key, kind="stable")
        key, file, many = key[order], file[order], many[order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        n = np.diff(np.append(start, len(key)))
        # two runs hold different rows
        held = np.repeat((n > 1) | np.logical_or.reduceat(many, start), n)
        key, file = key[held], file[held]
        if not len(key):
            return
        order = np.lexsort((key, file))
        key, file = key[order].astype("<u4"), file[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (file[1:] != file[:-1])))
        key, file = key[new], file[new]
        cut = np.flatnonzero(np.concatenate(([True], file[1:] != file[:-1])))
        ends = np.append(cut[1:], len(file))
        yield pa.RecordBatch.from_arrays(
            [pa.array(file[cut] << 33), pa.array(np.full(len(cut), bucket, np.int32)), pa.array([key[a:b].tobytes() for a, b in zip(cut.tolist(), ends.tolist(), strict=True)], pa.binary())],
            names=["row", "bucket", "keys"],
        )

    now, keys, files, several = None, [], [], []
    for batch in batches:
        for bucket, first, k, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
            if bucket != now and keys:
                yield from settle(now, keys, files, several)
                keys, files, several = [], [], []
            now = bucket
            keys.append(np.frombuffer(k.as_buffer(), "<u4"))
            files.append(first >> 33)
            several.append(np.unpackbits(np.frombuffer(s.as_buffer(), np.uint8), count=len(keys[-1])).astype(bool))
    if keys:
        yield from settle(now, keys, files, several)


def _places(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (n[0] numbers), then those from start[1] on, and so on."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _cut(buf: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Array:
    """Pieces of `buf` as a binary column."""
    at = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(at), pa.py_buffer(buf[_places(start, n)])])


def _strings(gone_folder: str, shared_folder: str, buckets: int):
    """The runs whose key other rows hold too, with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone, shared = Side(gone_folder, ["at", "n"]), _Shared(shared_folder)
        for batch in _ascending(batches):
            rows, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            at = flat(batch.column(2))[1]
            known = shared.of(rows)
            if not len(known):
                continue
            found = []
            for buf, start, n, own, key in _runs(batch, gone):
                name = (((key >> U64(32)) * U64(buckets)) >> U64(32)) << U64(32) | (key & U64(0xFFFFFFFF))
                hit = known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name
                found.append((start[hit], n[hit], own[hit], key[hit]))
            if not found:
                continue
            start, n, own, key = (np.concatenate(v) for v in zip(*found, strict=True))
            for low in range(0, len(start), 8192):
                s, m, o = start[low : low + 8192], n[low : low + 8192], own[low : low + 8192]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows[o]), pa.array(ids[o]), pa.array((s - at[o]).astype(np.int64)), pa.array(key[low : low + 8192].view(np.int64)), _cut(buf, s, m + SPAN - 1)],
                    names=["row", "id", "at", "key", "bytes"],
                )

    return run


class _Shared(Side):
    """The shared keys that each file's rows hold, ascending: bucket and 32 bits."""

    def __init__(self, folder: str) -> None:
        super().__init__(folder, ["bucket", "keys"])

    def _load(self, file: int) -> np.ndarray | None:
        table = super()._load(file)
        if table is None:
            return None
        keys = [np.frombuffer(x.as_buffer(), "<u4") for x in table.column("keys")]
        bucket = np.repeat(table.column("bucket").to_numpy(), [len(k) for k in keys])
        return np.sort(bucket.astype(U64) << U64(32) | np.concatenate(keys).astype(U64))

    def of(self, rows: np.ndarray) -> np.ndarray:
        """All shared keys of the files of the ascending numbers `rows`."""
        files = np.unique(rows >> 33).tolist()
        for old in [f for f in self._held if f not in files]:
            del self._held[old]
        for file in files:
            if file not in self._held:
                self._held[file] = self._load(file)
        found = [self._held[f] for f in files if self._held[f] is not None]
        return found[0] if len(found) == 1 else np.unique(np.concatenate(found)) if found else np.zeros(0, U64)


def _direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, id, row, at, bytes) in the order of keys: those with a window that a smaller id holds, and all their windows' least ids."""

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        key, ids, row, place_of = (table.column(c).to_numpy() for c in ("key", "id", "row", "at"))
        coded = table.column("bytes").combine_chunks().dictionary_encode()
        code, strings = coded.indices.to_numpy(), coded.dictionary
        # equal strings have equal keys
        own = np.empty(len(strings), np.int64)
        own[code] = key
        sizes = np.diff(np.frombuffer(strings.buffers()[1], np.int32)[strings.offset : strings.offset + len(strings) + 1]).astype(np.int64) - SPAN + 1
        begin = np.cumsum(sizes) - sizes
        least, most = np.full(len(strings), LAST), np.full(len(strings), -LAST - 1)
        np.minimum.at(least, code, ids)
        np.maximum.at(most, code, ids)
        mins = np.repeat(least, sizes)
        # strings of a key that have others beside them, and not all from one document
        _, group, many = np.unique(own, return_inverse=True, return_counts=True)
        low, high = np.full(len(many), LAST), np.full(len(many), -LAST - 1)
        np.minimum.at(low, group, least)
        np.maximum.at(high, group, most)
        some = np.flatnonzero((many > 1)[group] & (low < high)[group])
        if len(some):
            string, place, number = classes(strings.take(pa.array(some)).to_pylist(), SPAN)
            first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
            mins[begin[some[string]] + place] = np.minimum.reduceat(least[some[string]], first)[number - 1]
        hit = np.flatnonzero(np.minimum.reduceat(mins, begin)[code] < ids)
        for at in range(0, len(hit), 8192):
            part = hit[at : at + 8192]
            n = sizes[code[part]]
            ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(mins[_places(begin[code[part]], n)]))
            yield pa.RecordBatch.from_arrays([pa.array(row[part]), pa.array(place_of[part]), lists], names=["row", "at", "mins"])

    held, size, enough = [], 0, 2 * SORTED
    for batch in batches:
        held.append(batch)
        size += batch.column(4).nbytes
        if size >= enough:
            table = pa.Table.from_batches(held)
            key = table.column("key").to_numpy()
            # the last key may go on
            end = int(np.searchsorted(key, key[-1], "left"))
            if end:
                yield from settle(table.slice(0, end))
            held = table.slice(end).combine_chunks().to_batches()
            size = sum(b.column(4).nbytes for b in held)
            enough = max(2 * SORTED, 2 * size)
    if sum(b.num_rows for b in held):
        yield from settle(pa.Table.from_batches(held))


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per string of whole cells (key, part): the least id that holds each of its windows.

    For keys that are split into parts, one row per window with its bytes, to be merged.
    """
    schema = pa.schema([("name", pa.binary()), ("mins", pa.list_(pa.int64())), ("window", pa.binary()), ("place", pa.int64()), ("least", pa.int64())])

    def ready(rows: list) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(rows), 8192):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[low : low + 8192], strict=True), schema, strict=True)], schema=schema)

    def settle(rows: list) -> Iterator[pa.RecordBatch]:
        string, place, number = classes([r[3] for r in rows], SPAN)
        if not len(string):
            return
        ids = np.array([r[1] for r in rows], np.int64)
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
        least = np.minimum.reduceat(ids[string], first)[number - 1]
        order = np.argsort(string * np.int64(int(place.max()) + 1) + place)
        string, place, least = string[order], place[order], least[order]
        cut = np.flatnonzero(np.concatenate(([True], string[1:] != string[:-1])))
        ends = np.append(cut[1:], len(string))
        lowest = np.minimum.reduceat(least, cut)
        out = []
        for a, b, low in zip(cut.tolist(), ends.tolist(), lowest.tolist(), strict=True):
            name, _, most, data, parts = rows[string[a]]
            if parts > 1:
                out += [(name, None, data[p : p + SPAN], p, m) for p, m in zip(place[a:b].tolist(), least[a:b].tolist(), strict=True)]
            elif low < most:
                out.append((name, least[a:b], None, None, None))
        yield from ready(out)

    held, group, size, now, alone = [], [], 0, None, []
    for batch in batches:
        for key, part, parts, name, least, most, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (key, part) != now:
                # a string alone with its key is a class by itself
                if len(group) == 1 and group[0][4] == 1:
                    if group[0][1] < group[0][2]:
                        alone.append((group[0][0], [group[0][1]] * (len(group[0][3]) - SPAN + 1), None, None, None))
                else:
                    held += group
                    size += sum(len(g[3]) for g in group)
                group, now = [], (key, part)
                if size >= SORTED:
                    yield from settle(held)
                    held, size = [], 0
                if len(alone) >= 8192:
                    yield from ready(alone)
                    alone = []
            group.append((name, least, most, data, parts))
    if held or group:
        yield from settle(held + group)
    yield from ready(alone)


def _remove(gone_folder: str, found_folder: str, with_bytes: bool):
    """Rows with the spans of removed bytes applied."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gone, found = Side(gone_folder, ["at", "n"]), Side(found_folder, ["at", "mins"])
        for batch in _ascending(batches):
            rows, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            buf, at = flat(batch.column(2))
            whole, parts = gone.of(rows), found.of(rows)
            # windows [from, to) that go, by row
            who, low, high = [whole["_at"]], [whole["at"]], [whole["at"] + whole["n"]]
            if len(parts["_at"]):
                n = np.array([len(m) for m in parts["mins"]], np.int64)
                mins = np.concatenate(parts["mins"])
                own = np.repeat(parts["_at"], n)
                place = np.repeat(parts["at"], n) + np.arange(len(mins)) - np.repeat(np.cumsum(n) - n, n)
                hit = mins < ids[own]
                who, low, high = [*who, own[hit]], [*low, place[hit]], [*high, place[hit] + 1]
            who, low, high = (np.concatenate(v).astype(np.int64) for v in (who, low, high))
            order = np.argsort(who, kind="stable")
            who, low, high = who[order], low[order], high[order]
            begin, end = np.searchsorted(who, np.arange(len(rows)), "left"), np.searchsorted(who, np.arange(len(rows)), "right")
            out, texts = [], []
            for i, (a, b) in enumerate(zip(begin.tolist(), end.tolist(), strict=True)):
                data = buf[at[i] : at[i + 1]]
                if a == b:
                    removed, runs = 0, 0
                else:
                    edge = np.zeros(len(data) + 1, np.int32)
                    np.add.at(edge, low[a:b], 1)
                    np.add.at(edge, high[a:b] + SPAN - 1, -1)
                    cover = np.cumsum(edge[:-1]) > 0
                    removed, runs = int(cover.sum()), int(cover[0]) + int((cover[1:] & ~cover[:-1]).sum())
                    data = data[~cover]
                kept = data.tobytes()
                out.append((int(rows[i]), None if ids[i] == LAST else int(ids[i]), int(at[i + 1] - at[i]), removed, runs, hashlib.sha256(kept).hexdigest()))
                texts.append(kept if with_bytes else None)
            kinds = (pa.int64(),) * 5 + (pa.string(), pa.binary())
            names = ["row", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([*zip(*out, strict=True), texts] if out else [[]] * 7, kinds, strict=True)], names=names)

    return run


def _by_file(df: DataFrame, where: str) -> str:
    """Written so that a task can read what concerns the rows of one file of texts."""
    save(df.withColumn("file", F.shiftright("row", 33)).repartition("file").sortWithinPartitions("file", "row"), where, "file")
    return where


def _gone(texts: DataFrame, where: str) -> str:
    """Chunks whose name a document with a smaller id has, by file of texts. Names are 256-bit digests of all bytes."""
    chunks = keep(texts.mapInArrow(_chunks, "row long, id long, at long, n long, name binary"), f"{where}/chunks")
    least = chunks.groupBy("name").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most").select("name", "least")
    copies = chunks.join(least, "name").where("least < id").select("row", "at", "n")
    return _by_file(copies, f"{where}/gone")


def _shared_keys(texts: DataFrame, gone: str, buckets: int, where: str) -> str:
    """Keys that two rows hold, by file of texts."""
    keys = texts.mapInArrow(_keys(gone, buckets), "bucket int, first long, keys binary, several binary")
    shared = keys.repartitionById(buckets, F.col("bucket")).mapInArrow(_shared, "row long, bucket int, keys binary")
    return _by_file(shared, f"{where}/shared")


def _unique(strings: DataFrame, where: str) -> DataFrame:
    """Each string of the keys with many rows once, with the least and the greatest id that hold it."""
    found = strings.where("hot").groupBy("key", "name").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.first("bytes").alias("bytes"))
    return keep(found, f"{where}/unique")


def _ranked(unique: DataFrame, where: str) -> DataFrame:
    """The least ids of the strings' windows, by sorting cells; keys with many strings are dealt to several."""
    many = unique.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > MANY).select("key", F.ceil(F.col("n") / MANY).cast("int").alias("parts"))
    many = keep(many, f"{where}/many")
    some = marked(unique, "key", many, "key")
    dealt = salted_join(some.where("_marked"), many, ["key"], "name").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.unionByName(some.where("NOT _marked").withColumn("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    dealt = dealt.select("key", "part", "parts", "name", "least", "most", "bytes").repartition("key", "part").sortWithinPartitions("key", "part")
    return keep(dealt.mapInArrow(_sorted, "name binary, mins array<long>, window binary, place long, least long"), f"{where}/ranked")


def _found(strings: DataFrame, ranked: DataFrame, where: str) -> DataFrame:
    """Strings some of whose windows a document with a smaller id holds, with their least ids."""
    split = ranked.where("window IS NOT NULL")
    whole = salted_join(split.select("name", "place", "window"), split.groupBy("window").agg(F.min("least").alias("least")), ["window"], "name", "inner")
    whole = whole.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "least"))), lambda x: x["least"]).alias("mins"))
    mins = ranked.where("window IS NULL").select("name", "mins").unionByName(whole)
    # strings without such windows aren't shuffled, where a bitmap can tell
    some = marked(strings.select("row", "id", "at", "name"), "name", mins, "name").where("_marked").drop("_marked")
    return keep(some.join(mins, "name").where(F.array_min("mins") < F.col("id")).select("row", "at", "mins"), f"{where}/matches")


def _settled(strings: DataFrame, rounds: int, where: str) -> str:
    """The strings' windows that a document with a smaller id holds, by file of texts; a share of the keys after another.

    Equal windows have equal keys, so no class is cut. A key's rows meet in a task that sorts them; only keys with
    very many rows go by `_ranked`. What a round shuffles and writes is gone before the next.
    """
    spark, out = strings.sparkSession, []
    for n in range(rounds):
        here = f"{where}/round{n}"
        own = strings.where(F.col("round") == n)
        hot = own.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > FEW * MANY).select("key", F.lit(True).alias("hot"))
        hot = keep(hot, f"{here}/hot")
        own = own.join(F.broadcast(hot), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).withColumn("name", F.unhex(F.sha2("bytes", 256)))
        some = own.where("NOT hot").select("key", "id", "row", "at", "bytes").repartition("key").sortWithinPartitions("key")
        out.append(keep(some.mapInArrow(_direct, "row long, at long, mins array<long>"), f"{here}/direct"))
        unique = _unique(own, here)
        if not unique.isEmpty():
            ranked = _ranked(unique, here)
            discard(spark, f"{here}/unique")
            out.append(_found(own.where("hot"), ranked, here))
            discard(spark, f"{here}/ranked", f"{here}/many")
        discard(spark, f"{here}/unique")
    return _by_file(reduce(DataFrame.unionByName, out), f"{where}/found")


def remove_repeats(docs: DataFrame, *, with_bytes: bool = True) -> DataFrame:
    """`docs` (doc_id, text) without the bytes of strings that a document with a smaller doc_id holds too.

    Every SPAN-byte string that also begins in a document with a smaller doc_id is removed with all its
    bytes; overlaps count; strings are judged on the input. Steps:
    1. Content-defined chunks, each with the SPAN - 1 bytes after it, are named by 256-bit digests. All windows
       that begin in a chunk whose name a smaller doc_id has are gone; copies take no part in what follows.
    2. The least gram hash of a window is its key. Keys that only one document holds are dropped.
    3. The strings of windows with shared keys are dealt out by key, made unique and sorted by their suffixes
       (difference cover); adjacent suffixes with equal first SPAN bytes are a class, whose least doc_id is
       known then. Keys with very many rows are made unique before, split over tasks, and their classes
       merged by the windows' bytes. Large inputs do this in up to ROUNDS rounds, each for a share of the
       keys, so that their intermediates aren't on disk at once.
    Texts are never shuffled: what concerns a document is written by the file of texts that holds it.
    A null text is empty; texts below SPAN bytes stay; very long texts are cut into runs like others; a null doc_id is greater than all others; rows with
    the same doc_id don't remove each other's bytes; an empty table gives an empty result. Other columns
    are ignored.
    Returns row, doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256, kept (bytes, else null).
    """
    spark = docs.sparkSession
    small_batches(spark)
    where = scratch(spark, "suffixes")
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), "text")
    texts = keep(texts, f"{where}/texts")
    gone = _gone(texts, where)
    discard(spark, f"{where}/chunks")
    total = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    # about 8 MB of keys in a bucket
    buckets = max(shuffle_partitions(spark), int(total * 0.08 * 6 / (8 << 20)) + 1)
    shared = _shared_keys(texts, gone, buckets, where)
    rounds = min(ROUNDS, 1 + total // ROUND)
    strings = texts.mapInArrow(_strings(gone, shared, buckets), "row long, id long, at long, key long, bytes binary")
    strings = strings.withColumn("round", F.pmod(F.xxhash64("key"), F.lit(rounds)).cast("int"))
    # by round: none reads the others' strings
    save(strings, f"{where}/strings", "round")
    strings = spark.read.schema(strings.schema).parquet(f"{where}/strings")
    discard(spark, shared)
    small_batches(spark, 8192)
    found = _settled(strings, rounds, where)
    small_batches(spark)
    discard(spark, f"{where}/strings")
    return texts.mapInArrow(
        _remove(gone, found, with_bytes), "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
