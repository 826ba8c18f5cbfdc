"""Deciding about rows where they lie: keys that concern the rows of a stored file reach the tasks that read that file.

What is known of a table's rows (keys found to repeat, rows found to go) is dealt out by the input file the rows come
from, a sorted list of keys for each file, into the shared folder. A task that reads a file opens its list, so the rows
themselves never shuffle, at any size: a list is as long as its file has such rows. Files are named by
``input_file_name``; a table must be a stored one, so that its rows come from the same files each time it is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_path
from .memory import map_texts, release

#: A list of keys is stored for each file: pairs of words, sorted by the first.
KEY = np.dtype([("a", "<i8"), ("b", "<i8")])


def file_label() -> Column:
    """The input file of a row as a number; files that share one share a list, which does no harm."""
    return F.xxhash64(F.input_file_name())


def store_keys(keys: DataFrame, tag: str) -> str:
    """Write the list of each file; ``keys``: (label long, keys binary), the second with any number of ``KEY`` items.

    Returns the folder. A task that runs again writes the same lists again.
    """
    out = shared_path(keys.sparkSession, tag)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(out)
        files.create_dir(root, recursive=True)

        def done(label: int, held: list[bytes]) -> pa.RecordBatch:
            found = np.frombuffer(b"".join(held), KEY)
            found = found[np.lexsort((found["b"], found["a"]))]
            found = found[np.r_[True, (found["a"][1:] != found["a"][:-1]) | (found["b"][1:] != found["b"][:-1])]]
            own = f"{root}/{uuid.uuid4().hex}.part"
            with files.open_output_stream(own, compression=None) as stream:
                stream.write(found.tobytes())
            if files.get_file_info(f"{root}/{label}").type == fs.FileType.NotFound:
                files.move(own, f"{root}/{label}")
            else:
                files.delete_file(own)
            return pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64())], ["n"])

        now, held = None, []
        for batch in batches:
            for label, x in zip(batch.column(0).to_pylist(), batch.column(1)):
                if label != now and held:
                    yield done(now, held)
                    held = []
                now = label
                held.append(x.as_py())
        if held:
            yield done(now, held)

    keys.toDF("label", "keys").repartition("label").sortWithinPartitions("label").mapInArrow(write, "n long").agg(F.sum("n")).first()
    return out


def listed(folder: str) -> Callable[[int, np.ndarray, np.ndarray], np.ndarray]:
    """For use in a task: (label of a file, both words of keys) -> whether each is in the file's list. Holds one list."""
    files, root = fs.FileSystem.from_uri(folder)
    held: dict = {"label": None}

    def load(label: int) -> None:
        path = f"{root}/{label}"
        known = files.get_file_info(path).type != fs.FileType.NotFound
        keys = np.frombuffer(files.open_input_file(path).read(), KEY) if known else np.zeros(0, KEY)
        a = np.ascontiguousarray(keys["a"])
        starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else np.zeros(0, np.int64)
        held.update(label=label, a=a, b=np.ascontiguousarray(keys["b"]), run=int(np.diff(np.r_[starts, len(a)]).max(initial=0)))

    def look(label: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if held["label"] != label:
            load(label)
        found, at = np.zeros(len(a), bool), np.searchsorted(held["a"], a)
        # Keys that share their first word stand next to each other.
        for k in range(held["run"]):
            p = np.minimum(at + k, len(held["a"]) - 1)
            found |= (held["a"][p] == a) & (held["b"][p] == b)
        return found

    return look


def listed_values(folder: str) -> Callable[[int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For use in a task, of lists of (hash, value) pairs that hold two hashes of each thing: (label of a file, first hashes,
    second hashes) -> (whether both are listed with one value, that value). Holds one list."""
    files, root = fs.FileSystem.from_uri(folder)
    held: dict = {"label": None}

    def look(label: int, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if held["label"] != label:
            path = f"{root}/{label}"
            known = files.get_file_info(path).type != fs.FileType.NotFound
            held.update(label=label, keys=np.frombuffer(files.open_input_file(path).read(), KEY) if known else np.zeros(0, KEY))
        keys = held["keys"]
        if not len(keys):
            return np.zeros(len(first), bool), np.zeros(len(first), np.int64)
        at, to = (np.minimum(np.searchsorted(keys["a"], x), len(keys) - 1) for x in (first, second))
        found = (keys["a"][at] == first) & (keys["a"][to] == second) & (keys["b"][at] == keys["b"][to])
        return found, keys["b"][at]

    return look


def packed(a: np.ndarray, b: np.ndarray) -> bytes:
    keys = np.empty(len(a), KEY)
    keys["a"], keys["b"] = a, b
    return keys.tobytes()


def pack_columns(keys: DataFrame) -> DataFrame:
    """(label, a, b) -> (label, keys) as ``store_keys`` takes them, many keys to a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, a, b = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            order = np.argsort(label, kind="stable")
            label, a, b = label[order], a[order], b[order]
            cuts = np.r_[np.flatnonzero(np.r_[True, label[1:] != label[:-1]]), len(label)]
            yield pa.RecordBatch.from_arrays([pa.array(label[cuts[:-1]]), pa.array([packed(a[i:j], b[i:j]) for i, j in zip(cuts, cuts[1:])], pa.binary())], ["label", "keys"])

    return keys.select("label", "a", "b").mapInArrow(run, "label long, keys binary")


def stays(pick: Callable[[int, np.ndarray, np.ndarray], np.ndarray], label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows ``pick`` takes, called once for each run of rows of one file."""
    stay = np.zeros(len(label), bool)
    cuts = np.r_[0, np.flatnonzero(label[1:] != label[:-1]) + 1, len(label)]
    for i, j in zip(cuts, cuts[1:]):
        if j > i:
            stay[i:j] = pick(int(label[i]), a[i:j], b[i:j])
    return stay


def select_rows(df: DataFrame, labels: Column, a: Column, b: Column, decide: Callable[[], Callable[[int, np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """The rows of ``df`` that ``decide`` picks, all columns as they are.

    ``decide()`` is called in each task and gives (label, values of ``a``, values of ``b``) -> which rows of one file stay.
    Columns go by place, so names that clash or repeat do no harm.
    """
    n = len(df.columns)
    placed = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)], labels.alias("_label"), a.alias("_a"), b.alias("_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pick = decide()
        for batch in batches:
            stay = stays(pick, *(batch.column(n + k).to_numpy(zero_copy_only=False) for k in range(3)))
            if stay.any():
                yield batch.select(range(n)) if stay.all() else batch.filter(pa.array(stay)).select(range(n))
        release()

    kinds = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema))
    return map_texts(placed, run, kinds).toDF(*df.columns)
