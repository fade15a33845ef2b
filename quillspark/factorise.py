"""Factorisations from file to file: a matrix is read, decomposed, and its factors written beside each other.

    python -m quillspark.factorise --input m.txt --output out --rank 10 --format dense --method SVD
"""

from __future__ import annotations

import argparse
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators import linalg, text
from quillspark.operators.rows import stacked
from quillspark.operators.select import numbered
from quillspark.sources import matrices
from quillspark.sources.text import read_directory

Method = Callable[[DataFrame, int], dict[str, DataFrame]]


def _small(spark: SparkSession, m: np.ndarray) -> DataFrame:
    """A matrix of bounded width as rows (id, x)."""
    return spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(np.atleast_2d(m))], "id long, x array<double>")


def svd(points: DataFrame, rank: int) -> dict[str, DataFrame]:
    """U and V with a vector per column, and S with a value per line."""
    f = linalg.randomised_svd(points, rank)
    return {"U": f.coordinates(points, unit=True), "S": _small(points.sparkSession, f.s[:, None]), "V": _small(points.sparkSession, f.v)}


def incremental_svd(points: DataFrame, rank: int) -> dict[str, DataFrame]:
    """As `svd`, by one pass that keeps a triangle per partition."""
    f = linalg.svd(points, rank)
    return {"U": f.coordinates(points, unit=True), "S": _small(points.sparkSession, f.s[:, None]), "V": _small(points.sparkSession, f.v)}


def pca(points: DataFrame, rank: int) -> dict[str, DataFrame]:
    """Principal components (a vector per column) and the rows' scores on them."""
    f = linalg.svd(points, rank, center=True)
    return {"pc": _small(points.sparkSession, f.v), "score": f.coordinates(points)}


def eigen(points: DataFrame, rank: int) -> dict[str, DataFrame]:
    """Eigenvectors (columns) and eigenvalues of a symmetric matrix."""
    values, vectors = linalg.symmetric_sketch(points, rank)
    return {"evec": _small(points.sparkSession, vectors), "eval": _small(points.sparkSession, values[:, None])}


def sparse_svd(entries: DataFrame, rank: int) -> dict[str, DataFrame]:
    f = linalg.sparse_factors(entries, rank)
    return {"U": f.u.withColumnRenamed("i", "id"), "S": _small(entries.sparkSession, f.s[:, None]), "V": f.v.withColumnRenamed("j", "id")}


METHODS: dict[tuple[str, str], Method] = {
    ("dense", "SVD"): svd,
    ("dense", "incremental"): incremental_svd,
    ("dense", "PCA"): pca,
    ("dense", "SymEigen"): eigen,
    ("sparse", "SVD"): sparse_svd,
}


def process(spark: SparkSession, source: str, target: str, rank: int, read: Callable[[SparkSession, str], DataFrame], method: Method) -> dict[str, DataFrame]:
    """Read, factor, write: any reader and any method; returns what was written."""
    found = method(read(spark, source), rank)
    matrices.write_factors(target, text=True, **found)
    return found


def factorise(spark: SparkSession, source: str, target: str, *, rank: int = 10, kind: str = "dense", method: str = "SVD") -> dict[str, DataFrame]:
    """`process` for a text matrix of the given kind (dense or sparse) and a method of METHODS."""
    if (kind, method) not in METHODS:
        raise ValueError(f"no method {method} for a {kind} matrix")
    read = (lambda s, p: matrices.read_table(s, p, permissive=True)) if kind == "dense" else matrices.read_sparse
    return process(spark, source, target, rank, read, METHODS[kind, method])


def lsa(docs: DataFrame, rank: int, *, first: int = 100, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(doc_id, x) and (term, x): documents and words in the space of the first singular vectors of their features."""
    places = text.lsa_places(docs, first=first, least=least)
    named = text.numbered_features(places.select("doc_id", "term"), places)
    rows = numbered(named.select("doc_id").distinct(), ["doc_id"], "i")
    f = linalg.sparse_factors(named.join(rows, "doc_id").select("i", "j", F.lit(1.0).alias("v")), rank)
    words = named.select("term", "j").distinct()
    return rows.join(f.coordinates("i"), rows["i"] == F.col("id")).select("doc_id", "x"), words.join(f.coordinates("j"), words["j"] == F.col("id")).select("term", "x")


def lsa_files(spark: SparkSession, folder: str, target: str, rank: int) -> None:
    """`lsa` of a directory of texts, written as tables `documents` and `words`."""
    found = lsa(read_directory(spark, folder), rank)
    for name, df in zip(("documents", "words"), found, strict=True):
        df.write.mode("overwrite").parquet(f"{target}/{name}")


def reconstructed(u: DataFrame, s: np.ndarray, v: np.ndarray) -> DataFrame:
    """Rows (id, x) of U diag(S) V' for U (id, x) and bounded S and V."""
    m = (v * s).T

    def run(batches):
        for b in batches:
            if len(b):
                b["x"] = list(stacked(b["x"]) @ m)
                yield b

    return u.select("id", "x").mapInPandas(run, "id long, x array<double>")


def main(arguments: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-r", "--rank", type=int, default=10)
    p.add_argument("-f", "--format", choices=["dense", "sparse", "directory"], default="dense")
    p.add_argument("-m", "--method", choices=["SVD", "PCA", "SymEigen", "incremental"], default="SVD")
    o = p.parse_args(arguments)
    spark = SparkSession.builder.getOrCreate()
    if o.format == "directory":
        lsa_files(spark, o.input, o.output, o.rank)
    else:
        factorise(spark, o.input, o.output, rank=o.rank, kind=o.format, method=o.method)


if __name__ == "__main__":
    main()
