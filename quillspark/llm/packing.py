"""Packing of documents into fixed-length sequences by cutting-stock column generation."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import keep, scratch, small_batches
from .tokens import Encoder, merged

#: Lengths of pieces: whole sequences, multiples of GRAIN, and rests below it. This bounds the linear program.
GRAIN = 16

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids binary, part int, local long"


def knapsack(sizes: np.ndarray, values: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The pattern (copies of each size) of greatest value that fits into `room`, by dynamic programming."""
    best, last = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        best[c], fits = best[c - 1], sizes <= c
        if fits.any():
            gain = best[c - sizes[fits]] + values[fits]
            i = int(gain.argmax())
            if gain[i] > best[c] + 1e-12:
                best[c], last[c] = gain[i], np.flatnonzero(fits)[i]
    pattern, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            pattern[last[c]] += 1
            c -= sizes[last[c]]
    return float(best[room]), pattern


def column_generation(sizes: np.ndarray, counts: np.ndarray, room: int, limit: int = 3000) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (rows) and how often each is used in the linear program's solution: all counts are covered by the
    least number of sequences, where parts of sequences are allowed.

    Revised simplex: the dual prices of the sizes go to the knapsack, whose pattern enters the basis while
    it is worth more than one sequence.
    """
    basis = np.diag(room // sizes).astype(np.float64)  # a column per pattern
    for _ in range(limit):
        prices = np.linalg.solve(basis.T, np.ones(len(sizes)))
        worth, pattern = knapsack(sizes, np.maximum(prices, 0), room)
        if worth <= 1 + 1e-7:
            break
        use, change = np.linalg.solve(basis, counts.astype(np.float64)), np.linalg.solve(basis, pattern.astype(np.float64))
        ratio = np.full(len(use), np.inf)
        np.divide(np.maximum(use, 0), change, out=ratio, where=change > 1e-9)
        if not np.isfinite(ratio).any():
            break
        basis[:, int(ratio.argmin())] = pattern
    return basis.T.round().astype(np.int64), np.maximum(np.linalg.solve(basis, counts.astype(np.float64)), 0)


def rounded(sizes: np.ndarray, counts: np.ndarray, room: int, patterns: np.ndarray, use: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole numbers of patterns that hold every piece exactly once; what rounding down leaves is filled largest first."""
    left, out = counts.copy(), []

    def take(pattern: np.ndarray, most: int) -> None:
        nonlocal left
        own = pattern > 0
        n = min(most, int((left[own] // pattern[own]).min())) if own.any() else 0
        if n > 0:
            out.append((pattern.copy(), n))
            left = left - n * pattern

    for i in np.argsort(-use):
        take(patterns[i], int(use[i] + 1e-6))
    order = np.argsort(-sizes)
    while left.any():
        pattern, free = np.zeros(len(sizes), np.int64), room
        for i in order:
            n = min(int(left[i]), free // int(sizes[i]))
            pattern[i], free = n, free - n * int(sizes[i])
        take(pattern, int(left.sum()))
    return out


@dataclass
class Plan:
    """Where the rth piece of a length goes: by length, the ranks at which patterns begin and what they do there."""

    places: dict[int, np.ndarray]  # columns: first rank, copies in a sequence, first sequence, offset
    sequences: int

    @classmethod
    def of(cls, histogram: dict[int, int], room: int) -> Plan:
        """`histogram`: pieces by length, none longer than `room`. Its size is bounded by the lengths."""
        sizes = np.array(sorted(s for s in histogram if s < room), np.int64)
        counts = np.array([histogram[s] for s in sizes], np.int64)
        chosen = rounded(sizes, counts, room, *column_generation(sizes, counts, room)) if len(sizes) else []
        rows: dict[int, list] = {int(s): [] for s in histogram}
        rank, sequence = dict.fromkeys(rows, 0), histogram.get(room, 0)
        if sequence:
            rows[room].append((0, 1, 0, 0))
        for pattern, n in chosen:
            offset = 0
            for size, copies in zip(sizes[::-1].tolist(), pattern[::-1].tolist(), strict=True):
                if copies:
                    rows[size].append((rank[size], copies, sequence, offset))
                    rank[size] += n * copies
                    offset += copies * size
            sequence += n
        return cls({s: np.array(r, np.int64).reshape(-1, 4) for s, r in rows.items()}, sequence)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces, by length and rank."""
        sequence, offset = np.zeros_like(rank), np.zeros_like(rank)
        for size in np.unique(length):
            own, rows = length == size, self.places[int(size)]
            at = np.searchsorted(rows[:, 0], rank[own], "right") - 1
            within, copies = rank[own] - rows[at, 0], rows[at, 1]
            sequence[own], offset[own] = rows[at, 2] + within // copies, rows[at, 3] + within % copies * size
        return sequence, offset


def cuts(n: int, room: int) -> list[int]:
    """The lengths of a document's pieces."""
    rest = n % room
    return [room] * (n // room) + [x for x in (rest // GRAIN * GRAIN, rest % GRAIN) if x]


def _cut(path: str, spaces: str, end: int, room: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, part, ranks = Encoder.of(path, spaces), TaskContext.get().partitionId(), {}
        for batch in merged(batches, 1):
            ids, at = encoder.encode(batch.column(1))
            out = []
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                own, start = np.append(ids[a:b], np.array(end, encoder.kind)), 0
                wide = own.astype("<u4").tobytes()
                for size in cuts(len(own), room):
                    rank = ranks[size] = ranks.get(size, -1) + 1
                    out.append((doc, start, size, zlib.crc32(wide[4 * start : 4 * (start + size)]), len(own), own[start : start + size].tobytes(), part, rank))
                    start += size
            kinds = (pa.int64(),) * 5 + (pa.binary(), pa.int32(), pa.int64())
            names = [x.split()[0] for x in _PIECES.split(", ")]
            for low in range(0, len(out), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[low : low + 4096], strict=True), kinds, strict=True)], names=names)

    return run


def _placed(plan):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = plan.value.place(*(batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "rank")))
            columns = [batch.column(i) for i, n in enumerate(batch.schema.names) if n != "rank"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], names=[*(n for n in batch.schema.names if n != "rank"), "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, *, spaces: str = "dropped", end: int = 1, room: int = 2048, with_ids: bool = True) -> DataFrame:
    """Pack all `docs` (doc_id, text) into sequences of at most `room` tokens.

    A document's ids end with `end`. It is cut into whole sequences, a multiple of GRAIN, and a rest below
    that. The histogram of the pieces' lengths (at most room / GRAIN + GRAIN numbers) goes to the linear
    program; pieces of one length are ranked, and the ranks are dealt to the rounded patterns by
    arithmetic, so that no group of pieces meets in a task. A null or empty text is the end id alone,
    documents with the same or no id are packed each, an empty table gives an empty result. Other columns
    are ignored.
    Returns one row per piece: doc_id, start (ids of the document before it), length, ids_crc32,
    doc_tokens, sequence_id, offset (gapless from 0), and with `with_ids` its ids as little-endian
    numbers.
    """
    spark = docs.sparkSession
    small_batches(spark, 1024)
    where = scratch(spark, "pack")
    pieces = keep(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(tokenizer, spaces, end, room), _PIECES), f"{where}/pieces")
    counts = keep(pieces.groupBy("part", "length").agg(F.count("*").alias("n")), f"{where}/counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = spark.sparkContext.broadcast(Plan.of(histogram, room))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]
    ranked = pieces.join(counts, ["part", "length"]).select(*columns, (F.col("base") + F.col("local")).alias("rank"))
    kinds = {"ids": "binary"}
    schema = ", ".join(f"{c} {kinds.get(c, 'long')}" for c in [*columns, "sequence_id", "offset"])
    return ranked.mapInArrow(_placed(plan), schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids) with the ids of each sequence's pieces in order; a sequence's size bounds the group."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.aggregate(parts, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
