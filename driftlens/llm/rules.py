"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document: the ledger holds the measurements and one bit per failed rule. A policy is a
version with a mask of rules; applying one, or comparing many, is bit arithmetic on the ledger and never reads a text
again. Ablations count by mask first, so at most one row per combination of rules meets in the second step.

Defined results: a null or empty text has no words and fails the rule on few words; texts of any length are measured
whole; equal rows are measured one by one; a null id stays null; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import pieces, texts
from driftlens.llm.wordhash import mix, stretch_hashes, word_hashes

# Failing conditions over the measurements, in whole numbers. The place in the list is the bit; append only.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("short_words", "2 * word_chars < 5 * n_words"),
    ("long_words", "word_chars > 15 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "2 * n_dup_lines > n_lines"),
    ("shouting", "2 * n_upper > word_chars"),
    ("exclamation", "4 * n_exclaim > n_words"),
    ("few_letters", "2 * n_letters < word_chars"),
    ("some_repeated_windows", "100 * n_repeat_words > 20 * n_words"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]
POLICIES = {
    "base": BASE,
    "2024-1": BASE | BIT["symbols"] | BIT["repeated_lines"],
    "2024-2": sum(BIT.values()) - BIT["some_repeated_windows"],
    "strict": sum(BIT.values()),
}
CURRENT = "2024-2"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_exclaim", "n_letters"]

_flag = lambda signs: np.isin(np.arange(256), np.frombuffer(signs, np.uint8))
_SYMBOL = _flag(b"#*$%&|<>")
_SPACE = _flag(b" \t\n\x0b\x0c\r")
_UPPER = _flag(bytes(range(65, 91)))
_EXCLAIM = _flag(b"!")
_INNER = (np.arange(256) & 0xC0) == 0x80
_LETTER = _UPPER | _flag(bytes(range(97, 123))) | (np.arange(256) >= 0xC0)


def _per_text(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many flags each text has; ``ends`` are the texts' ends."""
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return np.diff(sums[ends], prepend=0)


def measure(raws: list[bytes]) -> dict[str, np.ndarray]:
    """The measurements of each text."""
    data = np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)
    ends = np.cumsum(np.array([len(raw) + 1 for raw in raws], np.int64))
    space = _SPACE[data]
    starts, _, hashes = word_hashes(data)
    word_ends = np.searchsorted(starts, ends)
    n_words = np.diff(word_ends, prepend=0)
    text_of = np.repeat(np.arange(len(raws)), n_words)

    # Windows of three words inside one text, told apart by text.
    repeat = np.zeros(len(hashes), bool)
    if len(hashes) >= 3:
        inside = text_of[2:] == text_of[:-2]
        window = mix(hashes[:-2] + hashes[1:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[2:] * np.uint64(0xC2B2AE3D27D4EB4F))
        window = mix(window + text_of[:-2].astype(np.uint64) * np.uint64(0x165667B19E3779F9))[inside]
        codes, _ = pd.factorize(window)
        twice = np.flatnonzero(inside)[np.bincount(codes)[codes] > 1] if len(codes) else np.zeros(0, np.int64)
        for shift in range(3):
            repeat[twice + shift] = True
    word_sums = np.concatenate([[0], np.cumsum(repeat, dtype=np.int64)])

    line_starts = np.concatenate([[0], np.flatnonzero(data == 0x0A) + 1])[:-1]
    line_lengths = np.diff(np.append(line_starts, len(data)))
    line_text = np.searchsorted(ends, line_starts, side="right")
    filled = np.add.reduceat((~space).astype(np.int64), line_starts) > 0
    lines = stretch_hashes(data, line_starts, line_lengths) + line_text.astype(np.uint64) * np.uint64(0x165667B19E3779F9)
    _, first = np.unique(mix(lines[filled]), return_index=True)
    n_lines = np.bincount(line_text[filled], minlength=len(raws))
    return {
        "n_words": n_words,
        "word_chars": _per_text(~space & ~_INNER[data], ends),
        "n_symbols": _per_text(_SYMBOL[data], ends),
        "n_dup_lines": n_lines - np.bincount(line_text[filled][first], minlength=len(raws)),
        "n_repeat_words": np.diff(word_sums[word_ends], prepend=0),
        "n_lines": n_lines,
        "n_upper": _per_text(_UPPER[data], ends),
        "n_exclaim": _per_text(_EXCLAIM[data], ends),
        "n_letters": _per_text(_LETTER[data], ends),
    }


def ledger(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The key, all measurements, and ``failed``, the bits of the failed rules."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            found = measure(texts(batch, text))
            columns = [pa.array(found[name].astype(np.int64)) for name in MEASURES]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(key)), *columns], names=[key, *MEASURES])

    kind = dict(docs.dtypes)[key]
    measured = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"{name} long" for name in MEASURES))
    failed = F.lit(0).cast("long")
    for name, condition in RULES:
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(BIT[name])).otherwise(0))
    return measured.withColumn("failed", failed)


def passes(policy: str, failed: Column | None = None) -> Column:
    """Whether a row of the ledger passes a policy."""
    return (F.col("failed") if failed is None else failed).bitwiseAND(F.lit(POLICIES[policy])) == 0


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """For each rule of a policy: rows that fail it, rows that fail nothing else, and rows kept with and without it."""
    mask = POLICIES[policy]
    seen = rows.groupBy(F.col("failed").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(name).alias("rule"), F.lit(bit).cast("long").alias("bit")) for name, bit in BIT.items() if mask & bit])
    each = seen.select("bits", "n", F.explode(names).alias("r")).select("bits", "n", "r.*")
    count = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    return each.groupBy("rule", "bit").agg(
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_failed_only"),
        count(F.col("bits") == 0).alias("n_kept"),
        count((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )
