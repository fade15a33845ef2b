"""Matrices as entries (i, j, v): arrangement, diagonals, densities, compressed columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .select import numbered


def sparse(entries: DataFrame) -> DataFrame:
    """Entries with equal places added up."""
    return entries.groupBy("i", "j").agg(F.sum("v").alias("v"))


def transpose(entries: DataFrame) -> DataFrame:
    return entries.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def reshape(entries: DataFrame, rows: int, new_rows: int) -> DataFrame:
    """The same values in column order with another number of rows."""
    at = F.col("j") * rows + F.col("i")
    return entries.select((at % new_rows).alias("i"), F.floor(at / new_rows).alias("j"), "v")


def cat(a: DataFrame, b: DataFrame, *, size: int, dimension: int) -> DataFrame:
    """b below a (dimension 1) or to its right (2); `size` is a's extent in that direction."""
    shift = "i" if dimension == 1 else "j"
    return a.unionByName(b.withColumn(shift, F.col(shift) + size))


def identity(spark: SparkSession, n: int) -> DataFrame:
    return spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(1.0).alias("v"))


def diagonal(entries: DataFrame) -> DataFrame:
    return entries.where("i = j")


def invert_diagonal(entries: DataFrame) -> DataFrame:
    """Diagonal entries as 1 / v; others as they are."""
    return entries.withColumn("v", F.when((F.col("i") == F.col("j")) & (F.col("v") != 0), 1 / F.col("v")).otherwise(F.col("v")))


def repeat_diagonal(entries: DataFrame, times: int, rows: int, columns: int) -> DataFrame:
    """The matrix `times` over along the diagonal."""
    copies = entries.withColumn("_c", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return copies.select((F.col("i") + F.col("_c") * rows).alias("i"), (F.col("j") + F.col("_c") * columns).alias("j"), "v")


def slice_matrix(entries: DataFrame, rows: Sequence[int] | None = None, columns: Sequence[int] | None = None) -> DataFrame:
    """X(R, C): rows and columns by lists, in the lists' order, with repeats."""
    spark, out = entries.sparkSession, entries
    for name, wanted in (("i", rows), ("j", columns)):
        if wanted is not None:
            lookup = spark.createDataFrame([(int(p), int(w)) for p, w in enumerate(wanted)], f"_p long, {name} long")
            out = out.join(lookup, name).drop(name).withColumnRenamed("_p", name)
    return out.select("i", "j", "v")


def is_symmetric(entries: DataFrame) -> DataFrame:
    """Whether all entries equal those across the diagonal (absent ones are 0)."""
    other = transpose(entries).withColumnRenamed("v", "w")
    both = entries.join(other, ["i", "j"], "full")
    return both.agg(F.coalesce(F.bool_and(F.coalesce("v", F.lit(0.0)) == F.coalesce("w", F.lit(0.0))), F.lit(True)).alias("symmetric"))


def compressed_columns(entries: DataFrame) -> DataFrame:
    """(j, start, rows, values): each column's entries in row order, and how many come before it."""
    columns = entries.groupBy("j").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("e"))
    counts = numbered(columns.select("j", F.size("e").cast("long").alias("n")), ["j"], "start", weight="n").select("j", "start")
    return columns.join(counts, "j").select("j", "start", F.transform("e", lambda x: x["i"]).alias("rows"), F.transform("e", lambda x: x["v"]).alias("values"))


def rows_of(points: DataFrame) -> DataFrame:
    """Entries of (id, x) rows."""
    return points.select(F.col("id").alias("i"), F.posexplode("x").alias("j", "v"))


def points_of(entries: DataFrame, width: int) -> DataFrame:
    """(id, x) rows of entries, absent ones as 0."""
    held = entries.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct(F.col("j").cast("int"), "v"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda j: F.coalesce(F.element_at("m", j), F.lit(0.0)))
    return held.select(F.col("i").alias("id"), filled.alias("x"))


def multiply(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product of two entry tables."""
    left, right = a.toDF("i", "k", "va"), b.toDF("k", "j", "vb")
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("va") * F.col("vb")).alias("v"))
