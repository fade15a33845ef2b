"""Folders and binary files that the driver and all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which the cluster names.

    Only where that is unset on a local master (tests on one machine) a temporary folder is chosen; elsewhere
    executors couldn't see the driver's folders, and it is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("quillspark.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("quillspark.scratch", base)
    return f"{base.rstrip('/')}/quill-{what}-{uuid.uuid4().hex[:12]}"


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def file_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in any store that Spark reads."""
    where, store = _path(spark, path)
    return bool(store.exists(where))


def delete(spark: SparkSession, path: str) -> None:
    where, store = _path(spark, path)
    store.delete(where, True)


def open_output(folder: str, name: str):
    """A binary stream to a new file of a shared folder, local or in a store that pyarrow opens."""
    where = urlparse(folder)
    if where.scheme in ("", "file"):
        os.makedirs(where.path, exist_ok=True)
        return open(f"{where.path}/{name}", "wb")  # noqa: SIM115  the caller closes it
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    return store.open_output_stream(f"{root}/{name}")


def part_name() -> str:
    """A name that no other task or attempt uses."""
    task = TaskContext.get()
    return f"part-{task.partitionId() if task else 0:06d}-{task.taskAttemptId() if task else 0}"


def join_parts(spark: SparkSession, folder: str, parts: DataFrame, target: str, head: bytes = b"") -> None:
    """One file of `head` and the files that `parts` (order, file) lists, copied between streams."""
    jvm = spark.sparkContext._jvm
    where, store = _path(spark, target)
    out = store.create(where, True)
    try:
        if head:
            out.write(head)
        for name in _names(parts):
            piece, own = _path(spark, f"{folder}/{name}")
            stream = own.open(piece)
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
            finally:
                stream.close()
    finally:
        out.close()


def _names(parts: DataFrame) -> Iterator[str]:
    for r in parts.orderBy("order").toLocalIterator():
        yield r.file


#: Spark then deletes an execution's shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def write_whole(df: DataFrame, path: str, by: str | None = None) -> None:
    """Write `df` to the shared folder, by the values of a column if asked; its shuffle files go as soon as it is there."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        out = df.write.option("compression", "zstd")
        (out.partitionBy(by) if by else out).parquet(path)
    finally:
        conf.set(_CLEANUP, before)


def stored(df: DataFrame, what: str) -> DataFrame:
    """`df` written to a fresh shared folder and read back: computed once, whatever is lost or asked twice later."""
    return stored_at(df, shared_folder(df.sparkSession, what))


def stored_at(df: DataFrame, path: str) -> DataFrame:
    write_whole(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_value(folder: str, by: str, value: int, columns: list[str]) -> pa.Table | None:
    """Columns of the rows that `write_whole` put by a value, read by a task; None without any."""
    where = urlparse(folder)
    root, store = f"{where.path}/{by}={value}", None
    if where.scheme in ("", "file"):
        names = [f"{root}/{x}" for x in sorted(os.listdir(root))] if os.path.isdir(root) else []
    else:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        root = f"{top}/{by}={value}"
        names = sorted(x.path for x in store.get_file_info(fs.FileSelector(root, allow_not_found=True)))
    names = [x for x in names if x.endswith(".parquet") and not x.rsplit("/", 1)[1].startswith(("_", "."))]
    parts = [pq.ParquetFile(x, filesystem=store).read(columns=columns) for x in names]
    return pa.concat_tables(parts) if parts else None
