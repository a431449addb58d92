"""NumPy arrays and sparse matrices as a data source whose tasks each read a range of entries.

A reader's plan needs the header alone; a task seeks (or, in a compressed
member, streams) to its own range and holds a batch of it at a time, so a file
of any size is read by as many tasks as it has ranges.  Files are opened where
the tasks run: their folder must be mounted there, as with any shared disk.
"""

from __future__ import annotations

import glob
import os
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Entries of a range, and of a batch.
RANGE, BATCH = 4_000_000, 200_000


@dataclass
class Range(InputPartition):
    """Entries ``first`` to ``last`` of one file."""

    path: str
    first: int
    last: int


def header(file) -> tuple[int, np.dtype]:
    """(entries, type) of a one-dimensional array, leaving the file at its data; objects are refused."""
    version = np.lib.format.read_magic(file)
    shape, _, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(file)
    if len(shape) != 1 or kind.hasobject:
        raise ValueError(f"an array of shape {shape} and type {kind} is not one-dimensional and plain")
    return shape[0], kind


def skipped(file, n: int) -> None:
    """Moves on by ``n`` bytes, streaming where the file cannot seek for free."""
    while n > 0:
        n -= len(file.read(min(n, 1 << 22)))


def streamed(file, kind: np.dtype, first: int, last: int, seek: bool) -> Iterator[np.ndarray]:
    """Entries ``first`` to ``last`` of data that begins where the file is, in batches."""
    if seek:
        file.seek(first * kind.itemsize, os.SEEK_CUR)
    else:
        skipped(file, first * kind.itemsize)
    while first < last:
        n = min(BATCH, last - first)
        yield np.frombuffer(file.read(n * kind.itemsize), kind)
        first += n


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.paths = sorted(glob.glob(options["path"]))
        self.size = int(options.get("entries", RANGE))
        if not self.paths:
            raise ValueError(f"no file is at {options['path']}")

    def entries(self, path: str) -> int:
        raise NotImplementedError

    def partitions(self) -> list[Range]:
        out = []
        for path in self.paths:
            n = self.entries(path)
            out += [Range(path, lo, min(n, lo + self.size)) for lo in range(0, max(n, 1), self.size)]
        return out


class _Array(_Reader):
    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.kind = options.get("kind", "string")

    def entries(self, path: str) -> int:
        with open(path, "rb") as f:
            return header(f)[0]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        to = {"long": np.int64, "double": np.float64}
        with open(part.path, "rb") as f:
            _, kind = header(f)
            at = part.first
            for values in streamed(f, kind, part.first, part.last, True):
                typed = pa.array([v.decode() if isinstance(v, bytes) else str(v) for v in values.tolist()]) if self.kind == "string" else pa.array(values.astype(to[self.kind]))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(values))), typed], ["at", "value"])
                at += len(values)


class _Sparse(_Reader):
    def entries(self, path: str) -> int:
        with zipfile.ZipFile(path) as z, z.open("data.npy") as f:
            return header(f)[0]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        with zipfile.ZipFile(part.path) as z:
            with z.open("indptr.npy") as f:
                n, kind = header(f)
                pointers = np.concatenate([*streamed(f, kind, 0, n, False), np.zeros(0, kind)]).astype(np.int64)
            with z.open("data.npy") as data, z.open("indices.npy") as indices:
                (_, of_data), (_, of_indices) = header(data), header(indices)
                at = part.first
                for values, columns in zip(streamed(data, of_data, part.first, part.last, False), streamed(indices, of_indices, part.first, part.last, False)):
                    rows = np.searchsorted(pointers, np.arange(at, at + len(values)), side="right") - 1
                    at += len(values)
                    kept = np.flatnonzero(values)
                    yield pa.RecordBatch.from_arrays([pa.array(rows[kept]), pa.array(columns[kept].astype(np.int64)), pa.array(values[kept].astype(np.float64))], ["row", "col", "value"])


class ArraySource(DataSource):
    """One-dimensional ``.npy`` files as (at, value); ``kind`` is string, long or double."""

    @classmethod
    def name(cls) -> str:
        return "npy_ranges"

    def schema(self) -> str:
        return f"at long, value {self.options.get('kind', 'string')}"

    def reader(self, schema) -> DataSourceReader:
        return _Array(dict(self.options))


class SparseSource(DataSource):
    """Compressed sparse rows in ``.npz`` files as (row, col, value), without stored zeros."""

    @classmethod
    def name(cls) -> str:
        return "npz_ranges"

    def schema(self) -> str:
        return "row long, col long, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Sparse(dict(self.options))


def npy(spark: SparkSession, path: str, kind: str = "string", entries: int = RANGE) -> DataFrame:
    """(at, value) of the arrays at ``path``, in ranges of ``entries``."""
    spark.dataSource.register(ArraySource)
    return spark.read.format("npy_ranges").option("path", path).option("kind", kind).option("entries", entries).load()


def npz_sparse(spark: SparkSession, path: str, entries: int = RANGE) -> DataFrame:
    """(row, col, value) of the matrices at ``path``, in ranges of ``entries`` stored values; each task holds the row pointers."""
    spark.dataSource.register(SparseSource)
    return spark.read.format("npz_ranges").option("path", path).option("entries", entries).load()
