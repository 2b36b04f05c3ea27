"""Token files: flat unsigned integers with 64-bit document offsets, read through a memory map.

Documents are sorted into ranges of their id; each range is one part of three files: ``.bin`` holds the ids, ``.idx``
the n + 1 offsets of its documents in ids, ``.key`` the document ids. A task writes files under a name of its own and
returns one manifest row, so a repeated task leaves a file that no manifest names. The parts' bases are prefix sums over
the manifest.

Defined results: a null or empty text is its end id alone; equal ids are documents of their own, ordered by a hash of
the text; null ids come first and are read back as null; an empty table gives no parts; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftlens.llm.common import open_folder, pieces, run_folder, texts
from driftlens.llm.tokens import encoder

NO_KEY = np.iinfo(np.int64).min
MANIFEST = "part int, name string, width int, n_docs long, n_tokens long"


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Writes the parts below ``folder`` (a URI all executors share) and returns the written manifest with bases."""
    spark = docs.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, files, path = encoder(tokenizer), None, None
        part, name = TaskContext.get().partitionId(), ""
        counts, keys, total = [], [], 0
        try:
            for batch in pieces(batches, text):
                if files is None:
                    name = f"part-{part:06d}-{uuid.uuid4().hex}"
                    system, path = open_folder(folder)
                    system.create_dir(path, recursive=True)
                    files = system.open_output_stream(f"{path}/{name}.bin")
                flat, sizes = coder.encode(texts(batch, text))
                with_end = np.insert(flat, np.cumsum(sizes), coder.dtype.type(end_id))
                files.write(with_end.tobytes())
                counts.append(sizes + 1)
                column = batch.column(batch.schema.get_field_index(key))
                keys.append(np.asarray(pc.fill_null(column.cast(pa.int64()), NO_KEY)))
                total += len(with_end)
        finally:
            if files is not None:
                files.close()
        if files is None:
            return
        sizes = np.concatenate(counts)
        with system.open_output_stream(f"{path}/{name}.idx") as out:
            out.write(np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes())
        with system.open_output_stream(f"{path}/{name}.key") as out:
            out.write(np.concatenate(keys).astype("<i8").tobytes())
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "name": [name], "width": [coder.dtype.itemsize], "n_docs": [len(sizes)], "n_tokens": [total]},
            schema=pa.schema([("part", pa.int32()), ("name", pa.string()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]),
        )

    ranged = docs.select(key, text, F.xxhash64(text).alias("_tie")).repartitionByRange(F.col(key), F.col("_tie"))
    ordered = ranged.sortWithinPartitions(key, "_tie").select(key, text)
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.select(
        "*",
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"),
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("doc_base"),
    )


class Part:
    """One part, mapped into memory where its folder is a local one, else read by ranges."""

    def __init__(self, folder: str, name: str, width: int):
        system, path = open_folder(folder)
        self.dtype = np.dtype(f"<u{width}")
        with system.open_input_file(f"{path}/{name}.idx") as file:
            self.offsets = np.frombuffer(file.read(), "<i8")
        with system.open_input_file(f"{path}/{name}.key") as file:
            self.keys = np.frombuffer(file.read(), "<i8")
        local = system.type_name == "local"
        self.file = pa.memory_map(f"{path}/{name}.bin") if local else system.open_input_file(f"{path}/{name}.bin")

    def ids(self, i: int) -> np.ndarray:
        """The ids of the part's document number ``i``."""
        start, stop = int(self.offsets[i]), int(self.offsets[i + 1])
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((stop - start) * width, start * width), self.dtype)


def read_digests(manifest: DataFrame, folder: str) -> DataFrame:
    """One row per document as the files have it: ``doc_id, start, n_tokens, ids_crc32``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(folder, row["name"], row["width"])
                sums = [zlib.crc32(part.ids(i).astype("<u4")) for i in range(row["n_docs"])]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part.keys, pa.int64(), mask=part.keys == NO_KEY),
                        pa.array(row["base"] + part.offsets[:-1], pa.int64()),
                        pa.array(np.diff(part.offsets), pa.int64()),
                        pa.array(sums, pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    spread = manifest.repartition(F.col("part"))
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(spark: SparkSession) -> str:
    return run_folder(spark, "tokenfile")
