"""Binary files in the folder that all executors share."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame


class Shared:
    """One output file: bytes go to a hidden name first, which is changed when all are written.

    Local paths and file:// are opened directly, other stores through pyarrow's file systems.
    """

    def __init__(self, folder: str, name: str) -> None:
        where = urlparse(folder)
        self.name, self.size = name, 0
        if where.scheme in ("", "file"):
            self._fs, root = None, where.path
            os.makedirs(root, exist_ok=True)
            self._stream = open(f"{root}/.{name}", "wb")
        else:
            from pyarrow import fs

            self._fs, root = fs.FileSystem.from_uri(folder)
            self._fs.create_dir(root, recursive=True)
            self._stream = self._fs.open_output_stream(f"{root}/.{name}")
        self._from, self._to = f"{root}/.{name}", f"{root}/{name}"

    def write(self, data: bytes) -> None:
        self._stream.write(data)
        self.size += len(data)

    def abort(self) -> None:
        """Close without the final name: no reader takes the file for a whole one."""
        self._stream.close()

    def close(self) -> None:
        self._stream.close()
        if self._fs is None:
            os.replace(self._from, self._to)
        else:
            self._fs.move(self._from, self._to)


def attempt_name(sequence: int, suffix: str) -> str:
    """A name no other task or attempt uses; files of failed attempts are told apart by it."""
    task = TaskContext.get()
    return f"part-{task.partitionId() if task else 0:06d}-{task.taskAttemptId() if task else 0}-{sequence:05d}{suffix}"


def read_back(folder: str, files: DataFrame) -> DataFrame:
    """Rows (file, content) of the files that `files` (file) lists, each opened by the task that reads it.

    The names stay a table: no driver lists them. A task holds one file at a time.
    """
    names = files.select("file").distinct()

    def run(batches):
        where = urlparse(folder)
        store, root = None, where.path
        if where.scheme not in ("", "file"):
            from pyarrow import fs

            store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                if store is None:
                    with open(f"{root}/{name}", "rb") as f:
                        content = f.read()
                else:
                    with store.open_input_stream(f"{root}/{name}") as f:
                        content = f.read()
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["file", "content"])

    return names.repartition("file").mapInArrow(run, "file string, content binary")


class Side:
    """Tables written by file of texts (partitionBy "file"), for tasks that read those texts.

    A row's file is its number without the low 33 bits, as monotonically_increasing_id deals them.
    """

    def __init__(self, folder: str, columns: list[str]) -> None:
        where = urlparse(folder)
        self._root, self._columns, self._held = where.path, columns, {}
        if where.scheme in ("", "file"):
            self._fs = None
        else:
            from pyarrow import fs

            self._fs, self._root = fs.FileSystem.from_uri(folder)

    def _load(self, file: int) -> pa.Table | None:
        folder = f"{self._root}/file={file}"
        if self._fs is None:
            names = [f"{folder}/{x}" for x in sorted(os.listdir(folder))] if os.path.isdir(folder) else []
        else:
            from pyarrow import fs

            names = sorted(x.path for x in self._fs.get_file_info(fs.FileSelector(folder, allow_not_found=True)))
        names = [x for x in names if x.endswith(".parquet") and not x.rsplit("/", 1)[1].startswith(("_", "."))]
        parts = [pq.ParquetFile(x, filesystem=self._fs).read(columns=["row", *self._columns]) for x in names]
        if not parts:
            return None
        table = pa.concat_tables(parts)
        return table.sort_by("row") if len(parts) > 1 else table

    def of(self, rows: np.ndarray) -> dict[str, np.ndarray]:
        """The columns of the table's rows for the ascending numbers `rows`, and as _at each one's index in `rows`."""
        files = np.unique(rows >> 33).tolist()
        for old in [f for f in self._held if f not in files]:
            del self._held[old]
        found = []
        for file in files:
            if file not in self._held:
                self._held[file] = self._load(file)
            table = self._held[file]
            if table is not None:
                own = rows[(rows >> 33) == file]
                key = table.column("row").to_numpy()
                found.append(table.slice(a := int(np.searchsorted(key, own[0], "left")), int(np.searchsorted(key, own[-1], "right")) - a))
        if not found:
            return {"_at": np.zeros(0, np.int64)} | {c: np.zeros(0, np.int64) for c in self._columns}
        table = pa.concat_tables(found)
        at = np.searchsorted(rows, table.column("row").to_numpy())
        hit = rows[np.minimum(at, len(rows) - 1)] == table.column("row").to_numpy()
        if not hit.all():
            table, at = table.filter(pa.array(hit)), at[hit]
        return {"_at": at} | {c: table.column(c).to_numpy(zero_copy_only=False) if not pa.types.is_binary(table.column(c).type) else np.array(table.column(c).to_pylist(), object) for c in self._columns}
