"""Exact top-k inner products by refining global score histograms, block by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import keep, scratch, shuffle_partitions, small_batches

#: Most candidates and queries of one cell of the grid and most bytes of either, least candidates where there are tasks
#: to spare, and bins of one histogram.
CANDIDATES, QUERIES, CELL, FEW, BINS = 16384, 8192, 32 << 20, 1024, 4096
#: Bound of all scores, so that differences of two fit into 64 bits.
FITS = 2.0**62


def integer_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, as 64-bit numbers; only vectors that are whole and finite.

    A component whose product doesn't fit into 64 bits fails the query.
    """
    x = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))
    fine = F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    fits = lambda e: F.when(F.abs(e * scale) < F.lit(2.0**63), F.floor(e * scale).cast("long")).otherwise(F.raise_error(F.lit("a component is too great for scores of 64 bits")))
    return x.where(fine).select("vec_id", F.transform("x", fits).alias("v"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 0))


def _groups(c: pd.DataFrame, q: pd.DataFrame):
    """Scores of blocks of queries against the candidates of the same length; a row's own score is left out."""
    for n, qs in q.groupby(q["qv"].map(len)):
        cs = c[c["v"].map(len) == n]
        if not len(cs):
            continue
        cs = cs.sort_values(["vec_id", "own"])
        ids, owns, wide, block = cs["vec_id"].to_numpy(), cs["own"].to_numpy(), _matrix(cs["v"]) if n else np.zeros((len(cs), 0)), 64
        # 53 bits hold all sums exactly if they must; otherwise whole numbers are multiplied, and those that end within
        # 63 bits are right whatever their parts were
        reach = n * float(np.abs(wide).max(initial=0)) * max(float(np.abs(x).max(initial=0)) if n else 0 for x in qs["qv"])
        exact = np.stack(cs["v"].to_numpy()).astype(np.int64) if reach >= 2.0**53 else None
        for at in range(0, len(qs), block):
            part = qs.iloc[at : at + block]
            left = np.stack(part["qv"].to_numpy()) if n else np.zeros((len(part), 0))
            scores = left.astype(np.float64) @ wide.T
            if reach >= FITS and (np.abs(scores[owns[None, :] != part["query"].to_numpy()[:, None]]) >= FITS).any():
                raise ValueError("a score doesn't fit into 64 bits")
            scores = scores.astype(np.int64) if exact is None else left.astype(np.int64) @ exact.T
            yield part, ids, owns, scores


def _count(k: int):
    """For each query: the highest bins of the cell that hold its k best, counted between low and high."""

    def run(key, c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, _, owns, scores in _groups(c, q):
            for (query, low, width), row in zip(part[["query", "low", "width"]].itertuples(index=False), scores, strict=True):
                row = row[owns != query]
                row = row[row >= low]
                if len(row) > k:
                    edge = np.partition(row, len(row) - k)[len(row) - k]
                    row = row[row >= low + (edge - low) // width * width]
                bins, n = np.unique((row - low) // width, return_counts=True)
                out.append(pd.DataFrame({"query": query, "bin": bins, "n": n}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "bin": [], "n": []}).astype("int64")

    return run


def _select(k: int):
    """For each query: the cell's scores from `low` on; of more than k, those that can still be chosen."""

    def run(key, c: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        out = []
        for part, ids, owns, scores in _groups(c, q):
            for (query, name, low), row in zip(part[["query", "query_id", "low"]].itertuples(index=False), scores, strict=True):
                at = np.flatnonzero((row >= low) & (owns != query))
                at = at[np.lexsort((ids[at], -row[at]))[:k]]
                out.append(pd.DataFrame({"query": query, "query_id": name, "vec_id": ids[at], "score": row[at]}))
        return pd.concat(out) if out else pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def top_k(vectors: DataFrame, *, k: int = 10, every: int = 100, scale: int = 1024) -> DataFrame:
    """The k highest integer inner products of each query with all other rows of `vectors`.

    Components become floor(scale * x). Queries are the rows whose vec_id is divisible by `every`, each for
    itself. Rows are dealt to a grid of cells (a block of candidates by a block of queries, both bounded in
    rows and bytes), once; every cell scores all its pairs. Histograms of the scores, summed over the cells,
    are refined between the bounds of the bin that holds a query's kth value until that value is known; then
    scores from it on are gathered, at most k from a cell, and ties go to the smaller vec_id.
    Vectors that are null or hold null or non-finite components take no part, nor do rows without id.
    Scores have 64 bits: a score of 2**62 or more fails the query. Vectors of different
    lengths aren't compared. Rows with the same vec_id are rows of their own: candidates of all queries but
    themselves, and queries with a result each. Very long vectors make cells of fewer rows. Fewer than k
    others: all. Other columns are ignored; an empty table gives an empty result.
    Returns query_id, rank (from 1), vec_id, score.
    """
    spark = vectors.sparkSession
    small_batches(spark, 10_000)
    where = scratch(spark, "topk")
    rows = integer_vectors(vectors, scale).withColumn("own", F.monotonically_increasing_id())
    rows = keep(rows.withColumn("square", F.aggregate("v", F.lit(0.0), lambda a, e: a + e.cast("double") * e.cast("double"))), f"{where}/rows")
    total, most, longest = rows.agg(F.count("*"), F.max("square"), F.max(F.size("v"))).first()
    chosen = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    asked = chosen.count()
    if not total or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    fit = max(1, CELL // (8 * max(longest, 1)))
    columns = max(-(-total // min(CANDIDATES, fit)), min(shuffle_partitions(spark), -(-total // FEW)))
    lines = -(-asked // min(QUERIES, fit))
    candidates = rows.select("own", "vec_id", "v", F.pmod(F.xxhash64("own"), F.lit(columns)).alias("c")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(lines - 1))))
    candidates = candidates.withColumn("cell", F.col("c") * lines + F.col("q")).select("cell", "own", "vec_id", "v")
    # dealt once for all rounds; a lost executor's part is dealt again from the written rows
    candidates = candidates.repartition(columns * lines, "cell").persist(StorageLevel.DISK_ONLY)

    def queries(bounds: DataFrame) -> DataFrame:
        dealt = chosen.select("own", "vec_id", "v").join(bounds, "own").withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(columns - 1))))
        line = F.pmod(F.xxhash64("own", F.lit(1)), F.lit(lines))
        named = dealt.withColumn("cell", F.col("c") * lines + line)
        return named.select("cell", F.col("own").alias("query"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"), "low", "width")

    def in_cells(bounds: DataFrame, what, schema: str) -> DataFrame:
        b = queries(bounds).repartition(columns * lines, "cell")
        return candidates.groupBy("cell").cogroup(b.groupBy("cell")).applyInPandas(what, schema)

    # scores lie within the product of the norms
    reach = F.ceil(F.least(F.sqrt("square") * F.lit(float(most) ** 0.5 * (1 + 1e-9)), F.lit(FITS))).cast("long") + 1
    bounds = chosen.select("own", (-reach).alias("low"), (F.ceil(reach / F.lit(BINS // 2)) + 1).cast("long").alias("width"))
    bounds = keep(bounds, f"{where}/bounds0")
    step = 0
    while bounds.agg(F.max("width")).first()[0] > 0:
        step += 1
        counted = in_cells(bounds, _count(k), "query long, bin long, n long")
        bins = counted.groupBy("query", "bin").agg(F.sum("n").alias("n"))
        # of each query, at most k bins from a cell and its kth value's bin: the running count from the top
        best = bins.groupBy("query").agg(F.reverse(F.array_sort(F.collect_list(F.struct("bin", "n")))).alias("b"))
        running = F.aggregate(
            "b",
            F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("bin"), F.lit(0).cast("long").alias("last")),
            lambda a, e: F.struct(
                (a["n"] + e["n"]).alias("n"),
                F.when(a["bin"].isNull() & (a["n"] + e["n"] >= k), e["bin"]).otherwise(a["bin"]).alias("bin"),
                e["bin"].alias("last"),
            ),
        )
        found = best.select(F.col("query").alias("own"), running.alias("r")).select("own", F.coalesce("r.bin", "r.last").alias("bin"))
        after = bounds.join(found, "own", "left").select(
            "own",
            (F.col("low") + F.coalesce("bin", F.lit(0)) * F.col("width")).alias("low"),
            F.when(F.col("width") <= 1, 0).otherwise(F.ceil(F.col("width") / F.lit(BINS))).cast("long").alias("width"),
        )
        bounds = keep(after, f"{where}/bounds{step}")
    best = in_cells(bounds, _select(k), "query long, query_id long, vec_id long, score long")
    ordered = best.groupBy("query", "query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("b"))
    ranked = ordered.select("query_id", F.posexplode("b").alias("rank", "b")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "b.vec_id", (-F.col("b.s")).alias("score")
    )
    ranked = keep(ranked, f"{where}/ranked")
    candidates.unpersist()
    return ranked
