"""Selection of rows by comparison, quantile and position; sets, samples and reshaping."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.files import stored

_COMPARE = {
    "gt": lambda a, b: a > b,
    "lt": lambda a, b: a < b,
    "eq": lambda a, b: a == b,
    "gte": lambda a, b: a >= b,
    "lte": lambda a, b: a <= b,
}


def where_compare(df: DataFrame, column: str, op: str, value: float) -> DataFrame:
    """Rows whose column compares so (gt, lt, eq, gte, lte) with the value."""
    if op not in _COMPARE:
        raise ValueError(f"no such comparison: {op}")
    return df.where(_COMPARE[op](F.col(column), F.lit(value)))


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Linearly interpolated quantiles of a column: the values at two places in its order for each.

    Equal values are counted, ranges of values are summed, and only the ranges that hold a wanted place are
    looked through: no task holds all values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    parts = stored(counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()), "quantiles")
    sizes = sorted((r.p, r.n) for r in parts.groupBy("p").agg(F.sum("n").alias("n")).collect())
    total = sum(n for _, n in sizes)
    if not total:
        return [None for _ in shares]
    at = [q * (total - 1) for q in shares]
    places = sorted({f for x in at for f in (int(x), min(int(x) + 1, total - 1))})
    found, before = {}, 0
    for p, n in sizes:
        for place in (x for x in places if before <= x < before + n):
            upto = F.sum("n").over(Window.partitionBy("p").orderBy("v"))
            found[place] = parts.where(F.col("p") == p).withColumn("u", upto).where(F.col("u") > place - before).agg(F.min("v")).first()[0]
        before += n
    return [found[int(x)] + (x - int(x)) * (found[min(int(x) + 1, total - 1)] - found[int(x)]) for x in at]


def above_quantile(df: DataFrame, column: str, q: float) -> DataFrame:
    """Rows strictly above the linearly interpolated quantile."""
    return df.where(F.col(column) > F.lit(quantiles(df, column, [q])[0]))


def quantile_segment(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """Rows from the lower quantile up to, but without, the upper one."""
    a, b = quantiles(df, column, [low, high])
    return df.where((F.col(column) >= F.lit(a)) & (F.col(column) < F.lit(b)))


def slice_rows(df: DataFrame, indices: DataFrame, key: str) -> DataFrame:
    """Rows by a list (pos, idx): one per list entry, so that repeats stay, with its pos."""
    return indices.join(df, indices["idx"] == df[key]).drop("idx")


def scatter(df: DataFrame, updates: DataFrame, key: str, value: str) -> DataFrame:
    """`df` with `value` replaced where `updates` (same key and value columns) has the key."""
    new = updates.select(key, F.col(value).alias("_new"))
    return df.join(new, key, "left").withColumn(value, F.coalesce("_new", value)).drop("_new")


def select_when(condition: Column, then: Column, otherwise: Column) -> Column:
    return F.when(condition, then).otherwise(otherwise)


def nonzeros(df: DataFrame, key: str, values: str) -> DataFrame:
    """(i, j, v) of the entries of array rows that aren't 0; j counts from 0."""
    return df.select(F.col(key).alias("i"), F.posexplode(values).alias("j", "v")).where("v <> 0")


def any_all(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.bool_or(condition).alias("any"), F.bool_and(condition).alias("all"))


def unique_members(df: DataFrame, *arrays: str) -> DataFrame:
    """The distinct members of all arrays, ascending."""
    parts = [df.select(F.explode(a).alias("member")) for a in arrays]
    return reduce(DataFrame.unionByName, parts).distinct().orderBy("member")


def unique_rows(df: DataFrame, columns: Sequence[str], position: str) -> DataFrame:
    """The distinct rows with the first position of each (ia) and a number in their order from 0 (ic)."""
    return numbered(df.groupBy(*columns).agg(F.min(position).alias("ia")), columns, "ic").withColumn("ic", F.col("ic").cast("int"))


def unique_map(df: DataFrame, columns: Sequence[str], position: str) -> DataFrame:
    """Each row's position with the number of its distinct row (ic)."""
    found = unique_rows(df, columns, position).drop("ia")
    same = [df[c].eqNullSafe(found[c]) for c in columns]
    return df.join(found, same).select(df[position], "ic")


def sort_rows(df: DataFrame, columns: Sequence[str], *, descending: bool = False) -> DataFrame:
    """`df` with each row's rank (from 0) in the order of the columns, counted by range."""
    return numbered(df, columns, "rank", descending=descending)


def sort_with_index(df: DataFrame, value: str, position: str, *, descending: bool = False) -> DataFrame:
    """Values in order with the positions they come from; equal values keep theirs ascending.

    Ranks are counted per range partition, so that no task sorts all rows.
    """
    order = [F.col(value).desc() if descending else F.col(value).asc(), F.col(position).asc()]
    return numbered(df.select(value, position), order, "rank").select("rank", value, F.col(position).alias("ix"))


def numbered(rows: DataFrame, order: Sequence[str | Column], name: str, *, descending: bool = False, weight: str | None = None) -> DataFrame:
    """`rows` with their place (from 0) in the order of `order`: places within ranges, after the rows of the ranges before.

    With `weight`, the sum of that column over the rows before instead of their number.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    keys = [k.desc() for k in keys] if descending else keys
    # written, as ranges drawn anew could differ between the two uses
    parts = stored(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "numbered")
    one = F.col(weight) if weight else F.lit(1)
    upto = F.sum(one).over(Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0))
    sizes = parts.groupBy("_part").agg(F.sum(one).alias("_n"))
    # one row per partition
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    found = parts.withColumn("_own", upto).join(F.broadcast(before.drop("_n")), "_part")
    return found.withColumn(name, (F.col("_before") + F.col("_own") - one).cast("long")).drop("_part", "_own", "_before")


def rand_sample(df: DataFrame, k: int, seed: int) -> DataFrame:
    """k rows without replacement."""
    return df.orderBy(F.rand(seed)).limit(k)


def good_sample(df: DataFrame, length: str, normal: str, key: str, seed: int) -> DataFrame:
    """A random row among the half with the greatest `normal` of the half with the greatest `length`."""
    n = df.count()
    half = df.orderBy(F.desc(length), key).limit(max(1, n // 2))
    return half.orderBy(F.desc(normal), key).limit(max(1, n // 4)).orderBy(F.rand(seed)).limit(1)


def intersect_with_multiplicity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row per pair of equal keys (a plain inner join)."""
    return a.select(key).join(b.select(key), key)


def repmat(df: DataFrame, times: int, key: str, size: int) -> DataFrame:
    """The rows `times` over, each copy's key shifted by `size`."""
    copies = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.withColumn(key, F.col(key) + F.col("_copy") * size).drop("_copy")


def densify(coo: DataFrame, rows: int, columns: int) -> DataFrame:
    """(i, j, v) with all cells, absent ones as 0."""
    spark = coo.sparkSession
    cells = spark.range(rows).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1)).cast("array<bigint>")).alias("j"))
    return cells.join(coo, ["i", "j"], "left").select("i", "j", F.coalesce("v", F.lit(0.0)).alias("v"))


def dedup_points(df: DataFrame, key: str, x: str, eps: float) -> DataFrame:
    """The first key of the points whose coordinates round to the same multiples of eps."""
    return df.groupBy(F.transform(x, lambda v: F.round(v / eps)).alias("cell")).agg(F.min(key).alias(key), F.count("*").alias("n"))
