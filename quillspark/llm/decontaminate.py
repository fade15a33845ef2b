"""Benchmark decontamination by winnowing: shared fingerprints, extended to exact word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._bytes import NOT_WORD, U64, minima, mix, powers, shingles, words
from ._shared import keep, named_apart, named_back, scratch, small_batches

#: Consecutive words that make a hit, and the words of a fingerprinted gram. A span of WINDOW words holds
#: WINDOW - GRAM + 1 grams, whose minimum is kept on both sides: no shared span is missed.
WINDOW, GRAM = 10, 5
#: Windows of the benchmark that one pass over the documents carries (24 bytes each).
PASS_WINDOWS = 1_000_000
#: Stands for a null item_id on the way.
NO_ID = -(1 << 63)

_HITS = "doc_id long, n_words long, hits binary, items array<long>, row long"


def _grams(word: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words; none if there are fewer."""
    return shingles(word, k) if len(word) >= k else np.zeros(0, U64)


def winnow(word: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """Which grams are the minimum of some window."""
    found = _grams(word, gram)
    return minima(found, window - gram + 1)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per item: its windows' hashes, their length in words, and its fingerprints."""
    for batch in batches:
        word, at = words(batch.column(1), NOT_WORD)
        out = []
        for item, a, b in zip(batch.column(0).to_pylist(), at[:-1], at[1:], strict=True):
            own = word[a:b]
            if len(own):
                size = min(WINDOW, len(own))
                print_ = _grams(own, GRAM)[winnow(own)] if size == WINDOW else np.zeros(0, U64)
                out.append((item, size, np.unique(shingles(own, WINDOW)).tobytes(), np.unique(print_).tobytes(), len(own)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)],
            names=["item_id", "size", "windows", "prints", "n"],
        )


class Index:
    """The windows of some items: sorted hashes by window size, the items of each, and fingerprints."""

    def __init__(self, rows: list) -> None:
        self.prints = np.unique(np.concatenate([np.frombuffer(r.prints, U64) for r in rows] or [np.zeros(0, U64)]))
        self.sizes = {}
        for size in {r.size for r in rows}:
            own = [r for r in rows if r.size == size]
            hashes = np.concatenate([np.frombuffer(r.windows, U64) for r in own])
            items = np.repeat(np.array([NO_ID if r.item_id is None else r.item_id for r in own], np.int64), [len(r.windows) // 8 for r in own])
            order = np.argsort(hashes, kind="stable")
            self.sizes[size] = hashes[order], items[order]

    def find(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which words of a document lie in an occurrence, and the items that occur."""
        hit, items = np.zeros(len(word) + 1, np.int64), []
        for size, (hashes, owners) in self.sizes.items():
            n = len(word) - size + 1
            if n <= 0:
                continue
            if size == WINDOW:
                kept = np.flatnonzero(winnow(word))
                kept = kept[member(_grams(word, GRAM)[kept], self.prints)]
                # a shared window holds one of these grams: extend each to all windows around it
                start = np.unique((kept[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
                start = start[(start >= 0) & (start < n)]
                if not len(start):
                    continue
                scale, total = powers(size + 1), np.zeros(len(start), U64)
                for j in range(size):
                    total += word[start + j] * scale[j + 1]
                value = mix(total ^ U64(size))
            else:
                start, value = np.arange(n), _grams(word, size)
            low, high = np.searchsorted(hashes, value, "left"), np.searchsorted(hashes, value, "right")
            found = high > low
            np.add.at(hit, start[found], 1)
            np.add.at(hit, start[found] + size, -1)
            pairs = np.unique(np.stack((low[found], high[found])), axis=1)
            items += [owners[a:b] for a, b in pairs.T]
        return np.cumsum(hit)[:-1] > 0, np.unique(np.concatenate(items)) if items else np.zeros(0, np.int64)


def member(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def _finder(index):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            word, at = words(batch.column(1), NOT_WORD)
            hits, found = [], []
            for a, b in zip(at[:-1], at[1:], strict=True):
                hit, items = own.find(word[a:b])
                hits.append(np.packbits(hit).tobytes() if len(items) else None)
                found.append(items.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(at)), pa.array(hits, pa.binary()), pa.array(found, pa.list_(pa.int64())), batch.column(2)],
                names=["doc_id", "n_words", "hits", "items", "row"],
            )

    return find


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words and items that any pass found."""
    for batch in batches:
        out = []
        for doc, n, hits, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bits = np.zeros((n + 7) // 8, np.uint8)
            for h in hits:
                bits |= np.frombuffer(h, np.uint8)
            names = sorted({str(i) for group in items for i in group if i != NO_ID})
            count = int(np.unpackbits(bits).sum())
            out.append((doc, n, count, len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), count > 0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 6, (pa.int64(),) * 4 + (pa.string(), pa.bool_()), strict=True)],
            names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


def _dropper(index, text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for batch in batches:
            word, at = words(batch.column(text), NOT_WORD)
            yield batch.filter(pa.array([not len(own.find(word[a:b])[1]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.bool_()))

    return run


def _dealt(benchmark: DataFrame, where: str, pass_windows: int) -> tuple[DataFrame, int]:
    """The items' windows, dealt to passes of about `pass_windows` windows each, and the number of passes."""
    items = keep(
        benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(_windows, "item_id long, size int, windows binary, prints binary, n long"), f"{where}/items"
    )
    sizes = items.agg(F.sum(F.length("windows") / 8)).first()[0] or 0
    n = max(1, -(-int(sizes) // pass_windows))
    return items.withColumn("pass", F.pmod(F.xxhash64("item_id", "windows"), F.lit(n))), n


def _index(dealt: DataFrame, k: int):
    """The broadcast index of one pass."""
    return dealt.sparkSession.sparkContext.broadcast(Index(dealt.where(F.col("pass") == k).collect()))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """`docs` with all its columns, without the rows that hold a benchmark window; see `decontaminate`.

    Rows without text or words stay, repeated rows are judged one by one, and an empty table gives an empty result.
    A benchmark of several passes is scanned for one at a time; rows that any pass hits go.
    """
    small_batches(docs.sparkSession)
    where = scratch(docs.sparkSession, "winnow")
    dealt, n = _dealt(benchmark, where, pass_windows)
    apart, names = named_apart(docs, "text")
    if n == 1:
        rows = apart.drop("text")
        return named_back(rows.mapInArrow(_dropper(_index(dealt, 0), names.index("text")), rows.schema), names)
    rows = keep(apart.withColumn("row", F.monotonically_increasing_id()), f"{where}/docs")
    gone = None
    for k in range(n):
        index = _index(dealt, k)
        hit = keep(rows.select(F.lit(0).cast("long").alias("doc_id"), "text", "row").mapInArrow(_finder(index), _HITS).where("hits IS NOT NULL").select("row"), f"{where}/hit{k}")
        index.destroy()
        gone = hit if gone is None else gone.unionByName(hit)
    return named_back(rows.join(gone.distinct().hint("merge"), "row", "left_anti"), names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, pass_windows: int = PASS_WINDOWS) -> DataFrame:
    """Which words of each document (doc_id, text) lie in a window of a benchmark item (item_id, text).

    A window is WINDOW consecutive words of an item, or all of a shorter one. Items are carried to the
    documents in passes of `pass_windows` windows (a longer item alone), one at a time: what the driver and the
    workers hold is bounded for any benchmark. Each pass is one scan of the documents without a shuffle; more
    than one is written, and merged by row. Words, grams and windows are compared by 64-bit hashes: two given
    ones are taken for equal with probability 2**-64. Null or wordless texts have no words and no hits, a
    wordless item has no window, items with a null id count as hits but not as items, repeated documents are
    judged one by one, very long texts are read whole, an empty benchmark hits nothing, an empty table gives an
    empty result. Other columns are ignored.
    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated.
    """
    spark = docs.sparkSession
    small_batches(spark)
    where = scratch(spark, "winnow")
    dealt, n = _dealt(benchmark, where, pass_windows)
    if n == 1:
        source = docs.select(F.col("doc_id").cast("long"), "text", F.lit(0).cast("long").alias("row"))
        found = source.mapInArrow(_finder(_index(dealt, 0)), _HITS)
        found = found.withColumn("hits", F.when(F.col("hits").isNull(), F.array().cast("array<binary>")).otherwise(F.array("hits"))).withColumn("items", F.array("items"))
    else:
        source = keep(docs.select(F.col("doc_id").cast("long"), "text", F.monotonically_increasing_id().alias("row")), f"{where}/docs")
        found = None
        for k in range(n):
            index = _index(dealt, k)
            part = keep(source.mapInArrow(_finder(index), _HITS), f"{where}/pass{k}")
            index.destroy()
            found = part if found is None else found.unionByName(part)
        found = found.groupBy("row").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items")
        )
    return found.select("doc_id", "n_words", "hits", "items").mapInArrow(
        _merge, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    )
