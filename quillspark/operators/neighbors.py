"""Exact neighbours by a grid of blocks: bounded queries against bounded candidates in each cell."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.files import shared_folder

from .blocks import dealt, over_cells
from .rows import stacked, whole

#: Candidates and queries of a cell.
CANDIDATES, QUERIES = 8192, 2048


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by one matrix product; those that cancellation could spoil are taken again from differences."""
    x, y = (a * a).sum(axis=1)[:, None], (b * b).sum(axis=1)[None]
    d = x + y - 2 * (a @ b.T)
    i, j = np.nonzero(d < 1e-6 * (x + y))
    for at in range(0, len(i), 1 << 16):
        p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        d[p, q] = ((a[p] - b[q]) ** 2).sum(axis=1)
    return d


def _absolute(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        out += np.abs(a[:, j, None] - b[None, :, j])
    return out


_DISTANCES = {"l2": lambda a, b: np.sqrt(_squares(a, b)), "sq": _squares, "l1": _absolute}


def _cells(queries: DataFrame, points: DataFrame, work, schema: str) -> DataFrame:
    """`work` on each cell of the grid: its queries (q, x) and its candidates (i, x)."""
    queries, points = whole(queries), whole(points)
    q = queries.select(F.col("id").alias("q"), F.col("x").cast("array<double>").alias("x"))
    c = points.select(F.col("id").alias("i"), F.col("x").cast("array<double>").alias("x"))
    lines, columns = max(1, -(-q.count() // QUERIES)), max(1, -(-c.count() // CANDIDATES))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("line", F.pmod(F.xxhash64("q"), F.lit(lines)).cast("int")).withColumn("column", every(columns))
    c = c.withColumn("column", F.pmod(F.xxhash64("i"), F.lit(columns)).cast("int")).withColumn("line", every(lines))
    n = lines * columns
    left, right = q.repartition(n, "line", "column"), c.repartition(n, "line", "column")
    return left.groupBy("line", "column").cogroup(right.groupBy("line", "column")).applyInPandas(work, schema)


def _blocks(q: pd.DataFrame, c: pd.DataFrame, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Query ids, candidate ids in order, and their distances, a few queries at a time."""
    if not len(q) or not len(c):
        return
    c = c.sort_values("i")
    ids, x = c["i"].to_numpy(), stacked(c["x"])
    step = max(1, (1 << 22) // max(1, x.size))
    for at in range(0, len(q), step):
        part = q.iloc[at : at + step]
        yield part["q"].to_numpy(), ids, _DISTANCES[metric](stacked(part["x"]), x)


def knn(queries: DataFrame, points: DataFrame, k: int, *, metric: str = "l2", within: float | None = None, include_self: bool = True) -> DataFrame:
    """The k nearest points of each query: (q, rank from 1, i, dist); ties go to the smaller id.

    `queries` and `points` are (id, x). `within` leaves out points that are farther. Each cell sends at most k
    rows per query.
    """

    def work(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        for qs, ids, d in _blocks(q, c, metric):
            for query, row in zip(qs, d, strict=True):
                own = np.ones(len(ids), bool) if include_self else ids != query
                if within is not None:
                    own &= row <= within
                at = np.flatnonzero(own)
                if len(at) > k:
                    at = at[row[at] <= np.partition(row[at], k - 1)[k - 1]]
                at = at[np.lexsort((ids[at], row[at]))[:k]]
                out.append(pd.DataFrame({"q": query, "i": ids[at], "dist": row[at]}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "i": [], "dist": []})

    found = _cells(queries, points, work, "q long, i long, dist double")
    order = Window.partitionBy("q").orderBy("dist", "i")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "rank", "i", "dist")


def within_radius(queries: DataFrame, points: DataFrame, radius: float, k: int) -> DataFrame:
    """(q, n, rank, i, dist): how many points lie within the radius, and the k nearest; slots without a point have a null i."""

    def work(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        for qs, _, d in _blocks(q, c, "l2"):
            out.append(pd.DataFrame({"q": qs, "n": (d <= radius).sum(axis=1)}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "n": []})

    counts = _cells(queries, points, work, "q long, n long").groupBy("q").agg(F.sum("n").alias("n"))
    slots = counts.withColumn("rank", F.explode(F.sequence(F.lit(1), F.lit(k))))
    near = knn(queries, points, k, within=radius)
    return slots.join(near, ["q", "rank"], "left").select("q", "n", "rank", "i", F.coalesce("dist", F.lit(float("inf"))).alias("dist"))


def between(queries: DataFrame, points: DataFrame, *, metric: str = "l2") -> DataFrame:
    """(q, i, dist) of all queries and points: a rectangular table, for sides that are small enough to want it."""

    def work(q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = []
        for qs, ids, d in _blocks(q, c, metric):
            out.append(pd.DataFrame({"q": np.repeat(qs, len(ids)), "i": np.tile(ids, len(qs)), "dist": d.ravel()}))
        return pd.concat(out) if out else pd.DataFrame({"q": [], "i": [], "dist": []})

    return _cells(queries, points, work, "q long, i long, dist double")


def farthest(points: DataFrame, k: int, by: str = "dist") -> DataFrame:
    """The k rows with the greatest `by` (of equals the smaller id), as a flag `outlier` on all rows."""
    far = points.orderBy(F.desc(by), "id").limit(k).select("id", F.lit(True).alias("outlier"))
    return points.join(far, "id", "left").withColumn("outlier", F.coalesce("outlier", F.lit(False)))


def index_map(points: DataFrame, chosen: DataFrame, key: str = "id") -> DataFrame:
    """All keys of `points` with their position among `chosen` (key, pos), -1 where they aren't chosen."""
    return points.select(key).join(chosen.select(key, "pos"), key, "left").select(key, F.coalesce("pos", F.lit(-1)).alias("pos"))


def snap(queries: DataFrame, points: DataFrame) -> DataFrame:
    """The nearest point of each query."""
    return knn(queries, points, 1).select("q", "i", "dist")


def pairs(points: DataFrame, *, metric: str = "l2") -> DataFrame:
    """All pairs (a < b) with their distance, for a table that is small enough to want them.

    Vectors are written once, in blocks; each task reads two blocks at a time, so that only the result grows with the pairs.
    """
    spark = points.sparkSession
    rows = whole(points).where("id IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("x").cast("array<double>").alias("x"))
    n = max(1, -(-rows.count() // QUERIES))
    folder = dealt(rows, "id", n, shared_folder(spark, "pairs"))

    def ready(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table.column("id").to_numpy(), stacked(table.column("x").to_pandas())

    def work(a, b, same: bool) -> Iterator[pa.RecordBatch]:
        (p, x), (q, y) = a, b
        if x.shape[1] != y.shape[1]:
            raise ValueError(f"vectors have different lengths: {sorted({x.shape[1], y.shape[1]})}")
        step = max(1, (1 << 18) // max(1, len(q)))
        for at in range(0, len(p), step):
            own = p[at : at + step]
            d = _DISTANCES[metric](x[at : at + step], y)
            # blocks are dealt by id: equal ids are in one block
            i, j = np.nonzero(own[:, None] < q[None]) if same else (z.ravel() for z in np.indices(d.shape))
            left, right = own[i], q[j]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(left, right)), pa.array(np.maximum(left, right)), pa.array(d[i, j])], names=["a", "b", "dist"])

    return over_cells(spark, folder, n, ["id", "x"], ready, work, "a long, b long, dist double")


def smooth_labels(points: DataFrame, k: int = 5) -> DataFrame:
    """Each point's label, replaced where more than half of its k nearest (itself included) share another.

    All points change at once: the result doesn't depend on their order.
    """
    near = knn(points, points, k).join(points.select(F.col("id").alias("i"), "label"), "i")
    votes = near.groupBy("q", "label").agg(F.count("*").alias("n")).where(F.col("n") * 2 > k).select(F.col("q").alias("id"), F.col("label").alias("_new"))
    return points.join(votes, "id", "left").withColumn("label", F.coalesce("_new", "label")).drop("_new")


def approximate_knn(queries: DataFrame, points: DataFrame, k: int, *, eps: float = 0.0, leaves: int | None = None, sample: int = 32768, seed: int = 3) -> DataFrame:
    """(q, rank, i, dist): k neighbours, each at most 1 + eps times as far as the true one of its rank.

    Points are split into leaves (by default of about 4096 points) by a tree of medians, built on a sample of at
    most `sample` points; each leaf keeps the box of all its points. A query searches its nearest leaves until they hold k points, whose
    greatest distance is a bound; then every leaf whose box is nearer than the bound over 1 + eps. With eps 0
    the result is exact, and there are always k neighbours if there are k points.
    """
    q = whole(queries).select(F.col("id").alias("q"), F.col("x").cast("array<double>").alias("x"))
    c = whole(points).select(F.col("id").alias("i"), F.col("x").cast("array<double>").alias("x"))
    leaves = leaves or int(min(sample // 8, max(8, c.count() // 4096)))
    cuts = _splits(stacked(pd.Series([r.x for r in c.orderBy(F.xxhash64("i", F.lit(seed)), "i").limit(sample).collect()] or [[0.0]])), leaves)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                b["leaf"] = _leaf(stacked(b["x"]), cuts)
                yield b

    from pyspark import StorageLevel

    placed = c.mapInPandas(place, "i long, x array<double>, leaf int").persist(StorageLevel.DISK_ONLY)
    sides = placed.select("leaf", F.posexplode("x").alias("d", "v")).groupBy("leaf", "d").agg(F.min("v").alias("a"), F.max("v").alias("b"))
    sizes = {r.leaf: r.n for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect()}
    keys = sorted(sizes)
    width = max((r.d for r in sides.agg(F.max("d").alias("d")).collect() if r.d is not None), default=-1) + 1
    low, high = np.zeros((len(keys), width)), np.zeros((len(keys), width))
    for r in sides.collect():
        low[keys.index(r.leaf), r.d], high[keys.index(r.leaf), r.d] = r.a, r.b
    counts = np.array([sizes[x] for x in keys])

    def boxes(x: np.ndarray) -> np.ndarray:
        return np.sqrt((np.maximum(np.maximum(low[None] - x[:, None], x[:, None] - high[None]), 0) ** 2).sum(axis=2))

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and len(keys):
                x = stacked(b["x"])
                near = np.argsort(boxes(x), axis=1, kind="stable")
                enough = np.cumsum(counts[near], axis=1) >= k
                last = np.where(enough.any(axis=1), enough.argmax(axis=1), len(keys) - 1)
                b["leaf"] = [[keys[j] for j in row[: m + 1]] for row, m in zip(near, last, strict=True)]
                yield b

    def rest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) and len(keys):
                d = boxes(stacked(b["x"]))
                b["leaf"] = [
                    [keys[j] for j in np.flatnonzero(row <= (np.inf if np.isnan(m) else m / (1 + eps))) if keys[j] not in set(seen)]
                    for row, m, seen in zip(d, b["bound"].to_numpy(float), b["seen"], strict=True)
                ]
                yield b

    def search(asked: DataFrame) -> DataFrame:
        pairs = asked.select("q", "x", F.explode("leaf").alias("leaf"))

        def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
            out = []
            for qs, ids, d in _blocks(a, b, "l2"):
                for query, row in zip(qs, d, strict=True):
                    at = np.lexsort((ids, row))[:k]
                    out.append(pd.DataFrame({"q": query, "i": ids[at], "dist": row[at]}))
            return pd.concat(out) if out else pd.DataFrame({"q": [], "i": [], "dist": []})

        return pairs.groupBy("leaf").cogroup(placed.groupBy("leaf")).applyInPandas(work, "q long, i long, dist double")

    asked = q.mapInPandas(first, "q long, x array<double>, leaf array<int>").persist(StorageLevel.DISK_ONLY)
    near = search(asked).persist(StorageLevel.DISK_ONLY)
    order = Window.partitionBy("q").orderBy("dist", "i")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    bound = ranked(near).where(F.col("rank") == k).select("q", F.col("dist").alias("bound"))
    more = asked.withColumnRenamed("leaf", "seen").join(bound, "q", "left").mapInPandas(rest, "q long, x array<double>, seen array<int>, bound double, leaf array<int>")
    return ranked(near.unionByName(search(more))).select("q", "rank", "i", "dist")


def _splits(x: np.ndarray, leaves: int) -> list[tuple[int, float]]:
    """A balanced tree of (dimension, value), node n with children 2n + 1 and 2n + 2: the widest side at its median."""
    depth, cuts, groups = max(0, (leaves - 1).bit_length()), [], [x]
    for _ in range(depth):
        after = []
        for g in groups:
            d = int((g.max(axis=0) - g.min(axis=0)).argmax()) if len(g) else 0
            v = float(np.median(g[:, d])) if len(g) else 0.0
            cuts.append((d, v))
            after += [g[g[:, d] <= v], g[g[:, d] > v]]
        groups = after
    return cuts


def _leaf(x: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    d, v = np.array([c[0] for c in cuts], np.int64), np.array([c[1] for c in cuts])
    while len(cuts) and node[0] < len(cuts):
        node = 2 * node + 1 + (x[np.arange(len(x)), d[node]] > v[node])
    return (node - len(cuts)).astype(np.int32)
