"""What the operators share: table access, staged tables, hashing and walking Arrow batches in small pieces."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens import session
from driftlens.session import shared_folder

# Words of all contracts: runs of anything but these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
# Text bytes an Arrow function works on at once; bounds its memory whatever the batch size of the session. Numbers per byte
# take up to 100 times that, and a worker keeps what it has had: larger pieces are no faster.
PIECE_BYTES = 1 << 18

__all__ = ["WORD", "fold", "join_key", "open_folder", "pieces", "read", "run_folder", "stage", "texts", "with_keys", "without_keys"]


# Rows of one Arrow batch where the session keeps Spark's default, which suits short rows: a batch of texts is held several
# times over by the JVM and by Python.
BATCH_KEY, BATCH_DEFAULT, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "500"


def small_batches(spark: SparkSession) -> None:
    if spark.conf.get(BATCH_KEY, BATCH_DEFAULT) == BATCH_DEFAULT:
        spark.conf.set(BATCH_KEY, BATCH_ROWS)


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back."""
    small_batches(df.sparkSession)
    return session.stage(df, label)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{table}.parquet")


# Rows of a broadcast bit map of keys, of 64 bits each: as many as four keys to a row ask for, within these bounds.
WORDS = (1 << 10, 1 << 20)


def with_keys(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key may be among ``keys`` (one column, no repeats); the caller joins exactly afterwards.

    A bit map of hashed keys drops most other rows before a join deals the rows out: all but one in sixteen as long as the map
    may grow with the keys, which it does up to a fixed size.
    """
    return _marked(rows, key, keys).where("_maybe").select(*rows.columns)


def without_keys(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """The rows whose key is not among ``keys`` (one column, no repeats, no null); a null key is not.

    Rows that the bit map tells apart stay where they are; only the others meet the keys.
    """
    marked, name = _marked(rows, key, keys), keys.columns[0]
    sure = marked.where("NOT _maybe").select(*rows.columns)
    gone = keys.select(F.col(name).alias("_gone"))
    return sure.unionByName(marked.where("_maybe").select(*rows.columns).join(gone, F.col(key) == F.col("_gone"), "left_anti"))


def _marked(rows: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """Adds ``_maybe``: whether the bit map has the row's key."""
    name = keys.columns[0]
    words = min(max(WORDS[0], 1 << (keys.count() // 4).bit_length()), WORDS[1])
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(words * 64))
    marks = keys.select(slot(F.col(name)).alias("s")).groupBy((F.col("s") / 64).cast("int").alias("_word"))
    marks = marks.agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("_bits"))
    near = rows.withColumn("_s", slot(F.col(key))).join(F.broadcast(marks), (F.col("_s") / 64).cast("int") == F.col("_word"), "left")
    return near.withColumn("_maybe", F.expr("coalesce((shiftright(_bits, cast(_s % 64 as int)) & 1L) = 1L, false)"))


def run_folder(spark: SparkSession, label: str) -> str:
    """A new folder below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/driftlens/{label}-{uuid.uuid4().hex}"


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder URI or a plain path."""
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def fold(key: Column, modulus: int) -> Column:
    """The remainder of crc32 of a key as text; a null key counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % modulus


def join_key(df: DataFrame, taken: str) -> str:
    """A column name that ``df`` does not use."""
    while taken in df.columns:
        taken = "_" + taken
    return taken


def pieces(batches: Iterator[pa.RecordBatch], text: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``limit`` bytes of the text column; a longer text is a slice of its own.

    After the last one the worker gives back what Arrow keeps for later, as it may lie idle beside others.
    """
    try:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column(batch.schema.get_field_index(text))
            sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
            ends = np.cumsum(sizes.astype(np.int64))
            start = 0
            while start < batch.num_rows:
                before = ends[start - 1] if start else 0
                stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
                yield batch.slice(start, stop - start)
                start = stop
    finally:
        pa.default_memory_pool().release_unused()


def texts(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """UTF-8 bytes of a text column; null is empty."""
    column = batch.column(batch.schema.get_field_index(name))
    return [value or b"" for value in column.cast(pa.binary()).to_pylist()]
