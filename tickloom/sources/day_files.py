"""Exports of one folder per split with a few .npy files per day, as a Spark data source.

``<path>/<split>/<day>_sequences.npy`` (n, steps, features) or ``<day>_features.npy`` (n, features), beside them any of
``<day>_labels.npy``, ``<day>_regression_labels.npy`` and ``<day>_forward_prices.npy`` (n rows each, one or two
dimensions) and ``<day>_metadata.json``.

A partition is a slice of a day's rows: the reader takes shapes from the arrays' headers, and a task reads the byte range of its
rows from each array that is asked for. So a long day is many tasks, and splits and days that filters or options leave
out are not opened. Paths are URIs that Arrow knows (file, hdfs, s3, gs).
"""

from __future__ import annotations

import io
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

#: Columns by the array they come from, and their types.
ARRAYS = {"sequences": "sequence", "features": "features", "labels": "labels", "regression_labels": "regression_labels", "forward_prices": "forward_prices"}
KINDS = {"split": "string", "day": "string", "seq": "long", "sequence": "array<array<double>>", "features": "array<double>", "labels": "array<long>", "regression_labels": "array<double>", "forward_prices": "array<double>"}
HEADERS = "split string, day string, kind string, shape array<long>"


@dataclass
class NpyArray:
    """Where an array's rows lie in its file."""

    path: str
    dtype: str
    shape: tuple[int, ...]
    offset: int

    @property
    def row_bytes(self) -> int:
        return int(np.prod(self.shape[1:], dtype=np.int64)) * np.dtype(self.dtype).itemsize


def read_header(files: fs.FileSystem, path: str) -> NpyArray:
    """Type, shape and place of the data, from the first bytes of the file."""
    with files.open_input_file(path) as f:
        start = io.BytesIO(f.read_at(min(f.size(), 4096), 0))
        version = np.lib.format.read_magic(start)
        reads = np.lib.format.read_array_header_1_0 if version[0] == 1 else np.lib.format.read_array_header_2_0
        shape, by_column, dtype = reads(start)
    if by_column and len(shape) > 1:
        raise ValueError(f"{path} is stored by column")
    if dtype.hasobject:
        raise ValueError(f"{path} holds objects")
    return NpyArray(path, dtype.str, shape, start.tell())


def read_rows(files: fs.FileSystem, array: NpyArray, first: int, rows: int) -> np.ndarray:
    with files.open_input_file(array.path) as f:
        data = f.read_at(rows * array.row_bytes, array.offset + first * array.row_bytes)
    return np.frombuffer(data, array.dtype).reshape(rows, *array.shape[1:])


@dataclass
class DaySlice(InputPartition):
    split: str
    day: str
    first: int
    rows: int
    arrays: dict[str, NpyArray]

    def __post_init__(self):
        super().__init__((self.split, self.day, self.first))


def nested(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix or a stack of them as lists; a vector as lists of one."""
    x = x.reshape(len(x), 1) if x.ndim == 1 else x
    out: pa.Array = pa.array(np.ascontiguousarray(x).reshape(-1).astype(kind.to_pandas_dtype()), kind)
    for axis in range(x.ndim - 1, 0, -1):
        n = int(np.prod(x.shape[:axis], dtype=np.int64))
        out = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * x.shape[axis], pa.int32()), out)
    return out


class DayFilesReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str] | None):
        self.path, self.columns = options["path"], columns
        self.only = {k: set(options[k].split(",")) for k in ("split", "day") if options.get(k)}
        self.rows = int(options.get("rowsperpartition", 20_000))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality with values of split and day is done here, the rest is left to Spark."""
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is not None and f.attribute in (("split",), ("day",)):
                name = f.attribute[0]
                self.only[name] = self.only[name] & values if name in self.only else values
            else:
                yield f

    def found(self) -> Iterator[tuple[str, str, dict[str, str]]]:
        """(split, day, path by kind of array) of what is asked for, from the names of files alone."""
        files, root = fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        for folder in files.get_file_info(fs.FileSelector(root)):
            split = folder.base_name
            if folder.type != fs.FileType.Directory or split not in self.only.get("split", {split}):
                continue
            days: dict[str, dict[str, str]] = {}
            for info in files.get_file_info(fs.FileSelector(folder.path)):
                stem, end = posixpath.splitext(info.base_name)
                # Longest first: regression_labels ends with labels.
                kind = next((k for k in sorted(ARRAYS, key=len, reverse=True) if stem.endswith(f"_{k}")), None)
                if end == ".npy" and kind:
                    day = stem[: -len(kind) - 1]
                    if day in self.only.get("day", {day}):
                        days.setdefault(day, {})[kind] = info.path
            yield from ((split, day, days[day]) for day in sorted(days))

    def files(self) -> fs.FileSystem:
        return fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()

    def partitions(self) -> list[DaySlice]:
        files, out = self.files(), []
        for split, day, paths in self.found():
            arrays = {kind: read_header(files, path) for kind, path in paths.items()}
            lengths = {a.shape[0] for a in arrays.values()}
            if self.columns is None:
                out.append(DaySlice(split, day, 0, 0, arrays))
                continue
            if len(lengths) > 1:
                raise ValueError(f"arrays of {split} {day} differ in rows: { {k: a.shape[0] for k, a in arrays.items()} }")
            total = lengths.pop()
            out += [DaySlice(split, day, first, min(self.rows, total - first), arrays) for first in range(0, total, self.rows)]
        return out or [DaySlice("", "", 0, 0, {})]

    def read(self, part: DaySlice) -> Iterator[pa.RecordBatch]:
        if self.columns is None:
            kinds = sorted(part.arrays)
            if kinds:
                shapes = pa.array([list(part.arrays[k].shape) for k in kinds], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([part.split] * len(kinds)), pa.array([part.day] * len(kinds)), pa.array(kinds), shapes], ["split", "day", "kind", "shape"])
            return
        files, step = self.files(), 1024
        held = {ARRAYS[k]: a for k, a in part.arrays.items()}
        for first in range(part.first, part.first + part.rows, step):
            n = min(step, part.first + part.rows - first)
            read = {c: read_rows(files, a, first, n) for c, a in held.items() if c in self.columns or (c == "sequence" and "features" in self.columns)}
            if "sequence" in read:
                read["features"] = read["sequence"][:, -1, :]
            cols = {"split": pa.array([part.split] * n), "day": pa.array([part.day] * n), "seq": pa.array(np.arange(first, first + n))}
            for c in self.columns:
                if c in read:
                    cols[c] = nested(read[c], pa.int64() if c == "labels" else pa.float64())
                elif c not in cols:
                    kind = pa.list_(pa.int64() if c == "labels" else pa.float64())
                    cols[c] = pa.nulls(n, pa.list_(kind) if c == "sequence" else kind)
            yield pa.RecordBatch.from_arrays([cols[c] for c in self.columns], self.columns)


class DayFiles(DataSource):
    """Format ``day_files``. Options: path; split, day: names, joined by commas; columns: those to read, by default all;
    headers: true for a row per array instead, (split, day, kind, shape), from headers alone; rowsPerPartition."""

    @classmethod
    def name(cls) -> str:
        return "day_files"

    def columns(self) -> list[str] | None:
        if self.options.get("headers", "false").lower() == "true":
            return None
        return [c.strip() for c in self.options.get("columns", ",".join(KINDS)).split(",")]

    def schema(self) -> str:
        columns = self.columns()
        return HEADERS if columns is None else ", ".join(f"{c} {KINDS[c]}" for c in columns)

    def reader(self, schema) -> DayFilesReader:
        return DayFilesReader(dict(self.options), self.columns())


def day_files(spark: SparkSession, path: str, columns: list[str] | None = None, headers: bool = False, **options: str) -> DataFrame:
    """The rows of an export (see ``DayFiles``); filters on split and day are pushed into the reader."""
    spark.dataSource.register(DayFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("day_files").option("path", path).options(**options)
    if columns is not None:
        reader = reader.option("columns", ",".join(columns))
    return reader.option("headers", str(headers).lower()).load()


def write_day_files(rows: DataFrame, path: str, arrays: dict[str, str]) -> None:
    """Write ``rows`` (split, day, seq and the columns in ``arrays``, array kind -> column) as such an export.

    Each day's files are written by one task as rows come in, in the order of seq; headers hold the counts known before, so no
    day is held. A task that runs again writes the same files again.
    """
    counts = rows.groupBy("split", "day").agg(F.count(F.lit(1)).alias("_n"))
    named = rows.select(F.col("split").cast("string").alias("split"), F.col("day").cast("string").alias("day"), "seq", *arrays.values())
    sized = named.join(counts.select(F.col("split").cast("string").alias("split"), F.col("day").cast("string").alias("day"), "_n"), ["split", "day"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        now, streams = None, {}

        def close() -> None:
            for stream in streams.values():
                stream.close()
            streams.clear()

        for batch in batches:
            keys = list(zip(batch.column("split").to_pylist(), batch.column("day").to_pylist(), batch.column("_n").to_pylist()))
            cuts = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                split, day, n = keys[i]
                for kind, column in arrays.items():
                    own = np.array(batch.column(column).slice(i, j - i).to_pylist(), "<i8" if kind == "labels" else "<f8")
                    if keys[i] != now:
                        if kind in streams:
                            streams.pop(kind).close()
                        files.create_dir(f"{root}/{split}", recursive=True)
                        streams[kind] = files.open_output_stream(f"{root}/{split}/{day}_{kind}.npy", compression=None)
                        head = io.BytesIO()
                        np.lib.format.write_array_header_1_0(head, {"descr": own.dtype.str, "fortran_order": False, "shape": (n, *own.shape[1:])})
                        streams[kind].write(head.getvalue())
                    streams[kind].write(own.tobytes())
                now = keys[i]
        close()
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], ["n"])

    sized.repartition("split", "day").sortWithinPartitions("split", "day", "seq").mapInArrow(run, "n long").agg(F.sum("n")).first()


def write_metadata(days: DataFrame, path: str) -> None:
    """Write ``days`` (split, day, metadata: JSON text), a row per day, beside the days' arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        for batch in batches:
            for split, day, text in zip(*(c.to_pylist() for c in batch.columns)):
                files.create_dir(f"{root}/{split}", recursive=True)
                with files.open_output_stream(f"{root}/{split}/{day}_metadata.json", compression=None) as f:
                    f.write(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], ["n"])

    days.select("split", "day", "metadata").mapInArrow(run, "n long").agg(F.sum("n")).first()
