"""Sorted 64-bit hashes with values, in files of the shared folder, that tasks look up without moving their texts.

Rows are dealt by the first byte of the hash and sorted, so a hash lies in one bucket, and a bucket is one stretch of one
file. Keys and each column of values are flat files of their own. A task maps them into memory where the folder is a local
one; elsewhere it reads, through an index of every ``STEP``-th key, only the stretches that the wanted hashes need. A table
may thus be larger than any task. Tasks write under names of their own and return one row per bucket, so a repeated task
leaves files that no manifest names.

Defined results: an empty table finds nothing; a hash may have several rows, which are found in the order of its columns;
a null hash or value is refused by the reader of the rows, as columns must not be null.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import open_folder
from driftlens.session import run_path

STEP = 1024
# Hashes looked up at once where stretches are read instead of mapped.
AT_ONCE = 1 << 14
TYPES = {"bigint": "<i8", "int": "<i4", "float": "<f4", "double": "<f8"}
MANIFEST = "bucket int, name string, first long, n long"


@dataclass
class HashFiles:
    """Where the rows lie: by bucket, the name of its file, its first row and its number of rows."""

    folder: str
    types: list[str]
    buckets: dict[int, tuple[str, int, int]]
    mapped: bool = True

    def reader(self) -> Reader:
        return Reader(self)


def write(rows: DataFrame, label: str) -> HashFiles:
    """Writes ``rows``: a ``bigint`` hash, then columns of numbers."""
    spark = rows.sparkSession
    names, types = rows.columns, [TYPES[kind] for _, kind in rows.dtypes]
    folder = run_path(spark, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, files, total, found, last = f"part-{uuid.uuid4().hex}", [], 0, {}, None
        try:
            for batch in batches:
                if not batch.num_rows:
                    continue
                if not files:
                    system, path = open_folder(folder)
                    system.create_dir(path, recursive=True)
                    files = [system.open_output_stream(f"{path}/{name}.{i}") for i in range(len(types) + 1)]
                keys = batch.column(0).to_numpy()
                for i, kind in enumerate(types):
                    files[i].write(batch.column(i).to_numpy().astype(kind).tobytes())
                files[-1].write(keys[(-total) % STEP :: STEP].astype("<i8").tobytes())
                bucket, first, n = np.unique(keys >> 56, return_index=True, return_counts=True)
                for b, f, k in zip(bucket.tolist(), first.tolist(), n.tolist()):
                    begin, so_far = found.get(b, (total + f, 0))
                    found[b] = begin, so_far + k
                total += len(keys)
        finally:
            for file in files:
                file.close()
        yield pa.RecordBatch.from_pydict(
            {"bucket": list(found), "name": [name] * len(found), "first": [f for f, _ in found.values()], "n": [n for _, n in found.values()]},
            schema=pa.schema([("bucket", pa.int32()), ("name", pa.string()), ("first", pa.int64()), ("n", pa.int64())]),
        )

    bucket = F.shiftright(names[0], 56)
    rows.repartition(bucket).sortWithinPartitions(*names).mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    # 256 rows at most.
    found = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").collect()
    return HashFiles(folder, types, {r["bucket"]: (r["name"], r["first"], r["n"]) for r in found})


class Reader:
    """Opened files; for one task."""

    def __init__(self, files: HashFiles):
        self.files = files
        self.system, self.path = open_folder(files.folder)
        self.mapped = files.mapped and self.system.type_name == "local"
        self.opened: dict[str, list] = {}

    def _open(self, name: str) -> list:
        if name not in self.opened:
            paths = [f"{self.path}/{name}.{i}" for i in range(len(self.files.types) + 1)]
            if self.mapped:
                own = [np.frombuffer(pa.memory_map(p).read_buffer(), t) for p, t in zip(paths, self.files.types)]
            else:
                with self.system.open_input_file(paths[-1]) as file:
                    index = np.frombuffer(file.read(), "<i8")
                own = [*(self.system.open_input_file(p) for p in paths[:-1]), index]
            self.opened[name] = own
        return self.opened[name]

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The number of rows of each hash (signed, in order, no repeats), and the columns of these rows one after another."""
        counts, parts = np.zeros(len(wanted), np.int64), []
        bounds = np.searchsorted(wanted >> 56, np.arange(-128, 129))
        for bucket, (name, first, n) in sorted(self.files.buckets.items()):
            lo, hi = bounds[bucket + 128 : bucket + 130]
            step = hi - lo if self.mapped else AT_ONCE
            for start in range(lo, hi, max(step, 1)):
                own = wanted[start : min(start + step, hi)]
                columns = self._rows(name, first, n, own)
                left, right = np.searchsorted(columns[0], own, "left"), np.searchsorted(columns[0], own, "right")
                sizes = right - left
                counts[start : start + len(own)] = sizes
                at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(left, sizes)
                parts.append([column[at] for column in columns[1:]])
        return counts, [np.concatenate([p[i] for p in parts] or [np.zeros(0, t)]) for i, t in enumerate(self.files.types[1:])]

    def _rows(self, name: str, first: int, n: int, own: np.ndarray) -> list[np.ndarray]:
        """Columns of rows of a bucket, in order, with all that have a wanted hash among them."""
        opened = self._open(name)
        if self.mapped:
            return [column[first : first + n] for column in opened]
        index = opened[-1]
        # The index also holds keys of other buckets of the file: stretches are limited to this bucket's rows.
        low, high = first // STEP, (first + n - 1) // STEP
        inside = index[low : high + 1].copy()
        inside[0] = np.iinfo(np.int64).min
        left = np.maximum(np.searchsorted(inside, own, "left") - 1, 0)
        right = np.maximum(np.searchsorted(inside, own, "right") - 1, 0)
        spans = np.zeros(len(inside) + 1, np.int64)
        np.add.at(spans, left, 1)
        np.add.at(spans, right + 1, -1)
        blocks = np.flatnonzero(np.cumsum(spans)[:-1] > 0)
        runs = np.split(blocks, np.flatnonzero(np.diff(blocks) > 1) + 1) if len(blocks) else []
        columns: list[list[np.ndarray]] = [[] for _ in self.files.types]
        for blocks_of in runs:
            begin = max((low + int(blocks_of[0])) * STEP, first)
            end = min((low + int(blocks_of[-1]) + 1) * STEP, first + n)
            for i, kind in enumerate(self.files.types):
                width = np.dtype(kind).itemsize
                columns[i].append(np.frombuffer(opened[i].read_at((end - begin) * width, begin * width), kind))
        return [np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(columns, self.files.types)]
