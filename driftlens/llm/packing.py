"""Packing: concatenate and cut.

All token ids form one line; windows of fixed length cut it into sequences. A first pass writes each partition's ids
and where each document lies inside its partition; the sum of the partitions before it, a prefix sum over one number
per partition, places a partition in the line. A second pass cuts. A window over the end of a partition gives one
boundary record on each side; both say so in ``boundary``, and ``sequences`` puts them together.

Defined results: a null or empty text is its end id alone; equal rows are documents of their own; a null id stays
null; an empty table gives no pieces; other columns are ignored. Texts of any length are cut as often as needed. Only
the last sequence may be short.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import pieces, stage, texts
from driftlens.llm.tokens import encoder

LENGTH = 2048


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Ids of each document with its end id, as written: ``part, seq, first, n_tokens, ids`` and the key.

    ``first`` counts the ids before the document in its partition. ``ids`` are little-endian unsigned integers, two
    bytes each where the vocabulary allows it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        end = np.array([end_id], coder.dtype)
        part, seq, first = TaskContext.get().partitionId(), 0, 0
        for batch in pieces(batches, text):
            flat, counts = coder.encode(texts(batch, text))
            with_end = np.insert(flat, np.cumsum(counts), end[0])
            sizes = counts + 1
            bounds = np.concatenate([[0], np.cumsum(sizes)])
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index(key)),
                    pa.array(np.full(n, part, np.int32)),
                    pa.array(np.arange(seq, seq + n, dtype=np.int64)),
                    pa.array(first + bounds[:-1].astype(np.int64)),
                    pa.array(sizes.astype(np.int64)),
                    binaries(with_end, bounds),
                ],
                names=[key, "part", "seq", "first", "n_tokens", "ids"],
            )
            seq, first = seq + n, first + int(bounds[-1])

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(
        run, f"`{key}` {kind}, part int, seq long, first long, n_tokens long, ids binary"
    )


def binaries(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Stretches of an integer array as binary values."""
    offsets = (bounds * flat.dtype.itemsize).astype(np.int32)
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))]
    )


def bases(encoded: DataFrame) -> DataFrame:
    """Ids in all partitions before each one: a prefix sum over one row per partition."""
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, length: int = LENGTH, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """All pieces: ``part``, the key, ``start, length, doc_tokens, sequence_id, offset, ids, boundary``.

    ``boundary`` marks pieces of a window that another partition has a share of.
    """
    encoded = stage(encode_documents(docs, tokenizer, end_id, text, key), "packing")
    totals = encoded.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    # One row of three numbers per input partition: small whatever the partitions hold, so the ids stay where they are.
    placed = encoded.join(F.broadcast(bases(encoded).join(totals, "part")), "part").select(
        F.col(key), "part", "n_tokens", "ids", (F.col("base") + F.col("first")).alias("at"), "base", "part_tokens"
    )
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("n_tokens") - 1) / length)
    width = F.length("ids") / F.col("n_tokens")
    begin = F.greatest(F.col("at"), F.col("sequence_id") * length)
    stop = F.least(F.col("at") + F.col("n_tokens"), (F.col("sequence_id") + 1) * length)
    cut = placed.withColumn("sequence_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    return cut.select(
        "part",
        F.col(key),
        (begin - F.col("at")).alias("start"),
        (stop - begin).alias("length"),
        F.col("n_tokens").alias("doc_tokens"),
        "sequence_id",
        (begin - F.col("sequence_id") * length).alias("offset"),
        F.substring("ids", ((begin - F.col("at")) * width + 1).cast("int"), ((stop - begin) * width).cast("int")).alias("ids"),
        (
            (F.col("sequence_id") * length < F.col("base"))
            | ((F.col("sequence_id") + 1) * length > F.col("base") + F.col("part_tokens"))
        ).alias("boundary"),
    )


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``ids`` and the number of ids; padding is left to the reader.

    Windows inside one partition are put together from that partition's pieces, boundary records by themselves; a
    group is one window, so no group is larger than the window length.
    """
    joined = packed.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").cast("int").alias("n")
    )
    hexed = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""))
    return joined.select("sequence_id", hexed.alias("ids"), "n")


def wide_crc(pieces_df: DataFrame, ids: str = "ids", length: str = "length") -> DataFrame:
    """Adds ``ids_crc32``: crc32 of the ids as little-endian unsigned 32-bit integers, in place of the ids.

    The column ``length`` says how many ids a row has, and so how many bytes each one takes.
    """
    import zlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            counts = batch.column(batch.schema.get_field_index(length)).to_pylist()
            sums = [
                zlib.crc32(np.frombuffer(value, f"<u{len(value) // n}").astype("<u4")) if n else 0
                for value, n in zip(batch.column(at).to_pylist(), counts)
            ]
            rest = [name for name in batch.schema.names if name != ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(n)) for n in rest] + [pa.array(sums, pa.int64())],
                names=[*rest, "ids_crc32"],
            )

    from pyspark.sql import types as T

    kept = [field for field in pieces_df.schema.fields if field.name != ids]
    return pieces_df.mapInArrow(run, T.StructType([*kept, T.StructField("ids_crc32", T.LongType())]))


def tokenizer_file(name: str) -> str:
    """Where a public tokenizer file lies: beside the installed package, the same place on every executor."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path(name))
