"""Matrix files as rows: DMAT (text and binary), whitespace tables, sparse rows; and their writers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.select import numbered

from .files import delete, join_parts, open_output, part_name, shared_folder


def _dmat(content: bytes) -> np.ndarray:
    """Columns and rows, then the values column by column; 0 0 comes before a binary body."""
    head, _, body = content.partition(b"\n")
    columns, rows = map(int, head.split())
    if (columns, rows) == (0, 0):
        head, _, body = body.partition(b"\n")
        columns, rows = map(int, head.split())
        values = np.frombuffer(body[: 8 * rows * columns], "<f8")
    else:
        values = np.array(body.split(), float)
    if len(values) != rows * columns:
        raise ValueError(f"{rows} x {columns} values were announced, {len(values)} are there")
    return values.reshape(columns, rows).T


def read_dmat(spark: SparkSession, path: str) -> DataFrame:
    """(file, id, x): the rows of all DMAT files of a path. A file is one task's work: the format can't be split."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for file, content in zip(b["path"], b["content"], strict=True):
                m = _dmat(bytes(content))
                for at in range(0, len(m), 4096):
                    part = m[at : at + 4096]
                    yield pd.DataFrame({"file": file, "id": np.arange(at, at + len(part)), "x": list(part)})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, id long, x array<double>")


def write_dmat(points: DataFrame, path: str, *, binary: bool = False) -> None:
    """Write (id, x) in the order of ids as one DMAT file at `path`, in any store that Spark writes.

    The format is one file in column order: the values are sorted by range of (column, id), each range is
    written by its task, and the parts are joined behind the header. No task or driver holds a column.
    """
    spark = points.sparkSession
    rows, columns = points.count(), (points.select(F.size("x")).first() or [0])[0]
    values = points.select("id", F.posexplode(F.col("x").cast("array<double>")).alias("j", "v"))
    folder = shared_folder(spark, "dmat")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, order, out = part_name(), None, None
        for b in batches:
            if len(b):
                if out is None:
                    out, order = open_output(folder, name), TaskContext.get().partitionId()
                v = b["v"].to_numpy("<f8")
                out.write(v.tobytes() if binary else "".join(f"{x:.17g}\n" for x in v).encode())
        if out is not None:
            out.close()
            yield pd.DataFrame({"order": [order], "file": [name]})

    ordered = values.repartitionByRange("j", "id").sortWithinPartitions("j", "id").select("v")
    parts = ordered.mapInPandas(write, "order int, file string").persist(StorageLevel.DISK_ONLY)
    join_parts(spark, folder, parts, path, b"0 0\n" * binary + f"{columns} {rows}\n".encode())
    parts.unpersist()
    delete(spark, folder)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): the lines of a file, or of a folder's files by their names, with their numbers from 0.

    Files are read in splits, and a task that reads several begins with the largest.
    """
    rows = spark.read.option("lineSep", "\n").text(path)
    place = {"_file": F.col("_metadata.file_path"), "_split": F.col("_metadata.file_block_start"), "_at": F.monotonically_increasing_id()}
    rows = rows.select(*(c.alias(n) for n, c in place.items()), F.regexp_replace("value", "\\r$", "").alias("value"))
    # part numbers have five digits or more
    return numbered(rows.withColumn("_long", F.length("_file")), ["_long", *place], "line").select("line", "value")


def read_table(spark: SparkSession, path: str, *, permissive: bool = False) -> DataFrame:
    """(id, x) of whitespace-separated numbers; blank lines are skipped, and what follows a comma is dropped.

    Rows of different lengths are an error, unless `permissive`: then shorter ones are filled with 0.
    """
    clean = F.trim(F.regexp_replace(F.substring_index("value", ",", 1), "\\s+", " "))
    rows = _lines(spark, path).select("line", clean.alias("value")).where("value <> ''")
    rows = rows.select(F.col("line").cast("long").alias("line"), F.split("value", " ").cast("array<double>").alias("x"))
    rows = numbered(rows, ["line"], "id").select("id", "x")
    low, high = rows.agg(F.min(F.size("x")), F.max(F.size("x"))).first()
    if low != high:
        if not permissive:
            raise ValueError(f"rows have {low} to {high} values")
        rows = rows.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(high) - F.size("x"))))
    return rows


def read_sparse(spark: SparkSession, path: str) -> DataFrame:
    """(i, j, v) of lines of id and value tokens with any one character between; repeated equal tokens count once.

    Lines are rows, blank ones too; ids count from 0.
    """
    token = F.explode(F.array_distinct(F.filter(F.split("value", "\\s+"), lambda t: t != "")))
    rows = _lines(spark, path).select(F.col("line").cast("long").alias("i"), token.alias("t"))
    part = lambda n: F.regexp_extract("t", "^(\\d+)[^\\d](.*)$", n)
    return rows.select("i", part(1).cast("long").alias("j"), part(2).cast("double").alias("v"))


def read_arrays(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The first n numbers of each line longer than three characters."""
    rows = _lines(spark, path).where(F.length("value") > 3)
    return rows.select(F.col("line").cast("long").alias("line"), F.slice(F.split(F.trim("value"), "\\s+"), 1, n).cast("array<double>").alias("x"))


def write_factors(folder: str, *, text: bool = False, **factors: DataFrame) -> None:
    """Each factor as a table below the folder, by its name (U, S, V; pc, score; evec, eval).

    With `text`, a factor (id, x) is lines of signed numbers with six digits, in the order of ids.
    """
    for name, df in factors.items():
        if text:
            line = F.array_join(F.transform("x", lambda v: F.concat(F.when(v < 0, "").otherwise("+"), F.format_string("%.6f", v))), " ")
            df.repartitionByRange("id").sortWithinPartitions("id").select(line.alias("value")).write.mode("overwrite").text(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{folder}/{name}")


#: Number types by name, and their numpy codes.
TYPES = {"double": "<f8", "single": "<f4", "int64": "<i8", "int32": "<i4"}


def write_typed(points: DataFrame, folder: str, kind: str = "double") -> None:
    """Rows (id, x) as a folder of binary records of one number type: row by row, with the ids beside."""
    code = TYPES[kind]

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["x"] = [np.asarray(x, np.float64).astype(code).tobytes() for x in b["x"]]
            yield b

    points.select("id", F.col("x").cast("array<double>").alias("x")).mapInPandas(pack, "id long, x binary").write.mode("overwrite").parquet(f"{folder}/{kind}")


def read_typed(spark: SparkSession, folder: str, kind: str = "double") -> DataFrame:
    code = TYPES[kind]

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["x"] = [np.frombuffer(x, code).astype(np.float64) for x in b["x"]]
            yield b

    return spark.read.parquet(f"{folder}/{kind}").mapInPandas(unpack, "id long, x array<double>")
