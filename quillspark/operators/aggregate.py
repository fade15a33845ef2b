"""Means, covariances, modes, medians, histograms and running sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.files import stored


def mean_vector(points: DataFrame, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """(…by, dim, mean): the mean of `x` in each dimension, weighted if asked."""
    w = weight if weight is not None else F.lit(1.0)
    rows = points.select(*by, w.alias("_w"), F.posexplode("x").alias("dim", "v"))
    return rows.groupBy(*by, "dim").agg((F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("mean"))


def centers(points: DataFrame, by: str) -> DataFrame:
    """(by, n, center): array means per group."""
    flat = points.select(by, F.posexplode("x").alias("dim", "v")).groupBy(by, "dim").agg(F.avg("v").alias("m"), F.count("*").alias("n"))
    return flat.groupBy(by).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("center"))


def covariance(points: DataFrame, *, centered: bool = True, weight: str | None = None) -> DataFrame:
    """(i, j, cov) for i <= j.

    Centred: second moments about the mean over n - 1. Not centred: about 0. With weights: over their sum.
    Each partition sends one sum per pair of dimensions.
    """
    from .linalg import partial_moments

    rows = partial_moments(points, weight).groupBy("i", "j").agg(*(F.sum(c).alias(c) for c in ("n", "sw", "sa", "sb", "ab")))
    moment = F.expr("ab - sa * sb / sw") if centered else F.col("ab")
    return rows.where("i <= j").select("i", "j", (moment / (F.col("sw") if weight else F.col("n") - 1)).alias("cov"))


def variance(points: DataFrame) -> DataFrame:
    """(dim, mean, var, std) with n - 1."""
    rows = points.select(F.posexplode("x").alias("dim", "v"))
    return rows.groupBy("dim").agg(F.avg("v").alias("mean"), F.var_samp("v").alias("var"), F.stddev_samp("v").alias("std"))


def variance_scale(points: DataFrame) -> DataFrame:
    """Each coordinate over its standard deviation, without centring; one without spread stays as it is."""
    return scaled_by(points, spreads(points), inverse=False)


def spreads(points: DataFrame) -> DataFrame:
    """One row (std): the factor of each dimension, 1 where there is no spread."""
    one = F.transform(F.array_sort(F.collect_list(F.struct("dim", "std"))), lambda s: F.when(s["std"] > 0, s["std"]).otherwise(1.0))
    return variance(points).agg(one.alias("std"))


def scaled_by(points: DataFrame, factors: DataFrame, *, inverse: bool) -> DataFrame:
    """Points over the factors of `spreads`, or times them: the inverse of the scaling."""
    f = (lambda v, s: v * s) if inverse else (lambda v, s: v / s)
    return points.join(F.broadcast(factors)).withColumn("x", F.zip_with("x", "std", f)).drop("std")


def row_spread(points: DataFrame) -> DataFrame:
    """(id, mean, std) of each row's own coordinates, with n - 1."""
    n = F.size("x")
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / n
    rows = points.select("id", F.col("x").cast("array<double>").alias("x")).withColumn("mean", mean)
    square = F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean")))
    return rows.select("id", "mean", F.when(n > 1, F.sqrt(square / (n - 1))).otherwise(0.0).alias("std"))


def column_normalise(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points with columns of unit length, and the lengths (dim, factor); a zero column stays as it is with factor 1."""
    rows = points.select(F.posexplode("x").alias("dim", "v")).groupBy("dim").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("n"))
    factors = rows.select("dim", F.when(F.col("n") > 0, F.col("n")).otherwise(1.0).alias("factor"))
    one = factors.agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "factor"))), lambda s: s["factor"]).alias("std"))
    return scaled_by(points, one, inverse=False), factors


def mode(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """The most frequent value of each group, the smallest of equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), value)
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").select(*by, F.col(value).alias("mode"), "n")


def mode_first(df: DataFrame, by: Sequence[str], value: str, position: str) -> DataFrame:
    """The most frequent value of each group, the one that occurs first among equals."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"), F.min(position).alias("p"))
    order = Window.partitionBy(*by).orderBy(F.desc("n"), "p")
    return counts.withColumn("r", F.row_number().over(order)).where("r = 1").select(*by, F.col(value).alias("mode"), "n")


def mode_with_fallback(df: DataFrame, by: str, value: str, groups: DataFrame) -> DataFrame:
    """The mode per group of `groups`; groups without values get the mode of all."""
    whole = mode(df.withColumn("_all", F.lit(1)), ["_all"], value).select(F.col("mode").alias("_whole"))
    own = mode(df, [by], value).select(by, "mode")
    return groups.select(by).distinct().join(own, by, "left").join(F.broadcast(whole)).select(by, F.coalesce("mode", "_whole").alias("mode"))


def upper_median(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Element n // 2 of the sorted values: no averaging. Equal values are counted first, then ranges of values;
    only the range that holds a group's median is sorted within the group, so that no task holds a large group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    parts = stored(counts.repartitionByRange(F.col(value), *by).withColumn("_part", F.spark_partition_id()), "median")
    sizes = parts.groupBy(*by, "_part").agg(F.sum("_n").alias("_m"))
    w = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_m").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.withColumn("_before", before).withColumn("_want", F.floor(F.sum("_m").over(w) / 2) + 1)
    own = placed.where((F.col("_want") > F.col("_before")) & (F.col("_want") <= F.col("_before") + F.col("_m"))).drop("_m")
    own = own.withColumnsRenamed({c: f"_by{i}" for i, c in enumerate(by)} | {"_part": "_place"})
    same = [F.col(c).eqNullSafe(F.col(f"_by{i}")) for i, c in enumerate(by)]
    inside = parts.join(own, [F.col("_part") == F.col("_place"), *same])
    upto = F.sum("_n").over(w.orderBy(value)) + F.col("_before")
    return inside.withColumn("_upto", upto).where(F.col("_upto") >= F.col("_want")).groupBy(*by).agg(F.min(value).alias("median"))


def histogram_bin(value: Column, edges: Sequence[float]) -> Column:
    """The bin of a value: [e0, e1), ...; the last edge is a bin of its own; -1 outside."""
    out = F.lit(-1)
    for i in range(len(edges) - 1):
        out = F.when((value >= edges[i]) & (value < edges[i + 1]), i).otherwise(out)
    return F.when(value == edges[-1], len(edges) - 1).otherwise(out).cast("int")


def histogram(df: DataFrame, value: str, edges: Sequence[float]) -> DataFrame:
    return df.select(histogram_bin(F.col(value), edges).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))


def arg_extreme(df: DataFrame, by: Sequence[str], value: str, position: str, *, greatest: bool = False) -> DataFrame:
    """The extreme value of each group with its first position."""
    sign = F.col(value) if greatest else -F.col(value)
    pick = F.max_by(F.struct(value, position), F.struct(sign.alias("s"), (-F.col(position)).alias("p")))
    return df.where(F.col(value).isNotNull()).groupBy(*by).agg(pick.alias("x")).select(*by, f"x.{value}", F.col(f"x.{position}").alias("position"))


def cumulative_sum(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("cumsum", F.sum(value).over(w))


def rolling(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, size: int) -> DataFrame:
    """Count, sum and mean of the last `size` rows."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - size, 0)
    return df.withColumns({"rolling_n": F.count(value).over(w), "rolling_sum": F.sum(value).over(w), "rolling_mean": F.avg(value).over(w)})


def moments(df: DataFrame, by: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Count, sum, min, max, mean, raw second moment, standard error; weighted mean and sum if asked."""
    v = F.col(value)
    aggs = [
        F.count(v).alias("n"), F.sum(v).alias("sum"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"),
        F.avg(v * v).alias("moment2"), (F.stddev_samp(v) / F.sqrt(F.count(v))).alias("error"),
    ]
    if weight:
        w = F.col(weight)
        aggs += [F.sum(w * v).alias("weighted_sum"), (F.sum(w * v) / F.sum(w)).alias("weighted_mean")]
    return df.groupBy(*by).agg(*aggs)


def shape(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """Skewness and excess kurtosis of the population."""
    return df.groupBy(*by).agg(F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis"))


def tail(df: DataFrame, by: Sequence[str], value: str, k: int) -> DataFrame:
    """The k greatest values of each group, by rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(value))
    return df.select(*by, value, F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def head(df: DataFrame, by: Sequence[str], value: str, k: int) -> DataFrame:
    """The k least values of each group, by rank."""
    w = Window.partitionBy(*by).orderBy(value)
    return df.select(*by, value, F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)


def sparse_sum(coo: DataFrame, dimension: int) -> DataFrame:
    """Sums of (i, j, v): per column for 1, per row for 2."""
    key = "j" if dimension == 1 else "i"
    return coo.groupBy(key).agg(F.sum("v").alias("sum"))


def spatial_median(points: DataFrame, *, steps: int = 50, eps: float = 1e-9) -> list[float]:
    """The point with the least sum of distances, by reweighted means (one aggregation a step)."""
    from quillspark.functions.vec import l2

    now = [r.mean for r in mean_vector(points).orderBy("dim").collect()]
    for _ in range(steps):
        d = l2(F.col("x"), F.array(*map(F.lit, now)))
        after = [r.mean for r in mean_vector(points, weight=1.0 / F.greatest(d, F.lit(1e-12))).orderBy("dim").collect()]
        moved = max(abs(a - b) for a, b in zip(now, after, strict=True))
        now = after
        if moved < eps:
            break
    return now


def success_rate(runs: DataFrame, dims: str, truth: Sequence[int]) -> DataFrame:
    """Share of the runs whose sorted dimensions are the true ones."""
    right = F.sort_array(dims) == F.array(*(F.lit(int(d)) for d in sorted(truth)))
    return runs.agg(F.avg(right.cast("double")).alias("rate"))
