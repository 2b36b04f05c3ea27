"""Deduplication. All of it keeps the first row of a group: Spark's group limit drops the others of a group in every
task before the shuffle, so of a hot group at most one row per task meets in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.text import normalise_body

# What blocks are told apart by, beside their body, and the order in which the first one is kept.
BLOCK_GROUP = ["file", "type", "name"]
BLOCK_ORDER = ["start_line", "strategy", "seq", "def_no"]


def keep_first(df: DataFrame, keys: list[str | Column], order: list[str]) -> DataFrame:
    """The row with the smallest ``order`` of every group of ``keys``, all columns kept."""
    given = [F.col(k) if isinstance(k, str) else k for k in keys]
    first = Window.partitionBy(*given).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(first)).filter("_place = 1").drop("_place")


def is_first(keys: list[str | Column], order: list[str]) -> Column:
    """Whether a row has the smallest ``order`` of its group of ``keys``. Sorting starts from a number for the first key, so that
    names that begin alike are rarely compared."""
    given = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.row_number().over(Window.partitionBy(F.xxhash64(given[0]), *given).orderBy(*order)) == 1


def body_key(raw: str = "raw") -> Column:
    """A short stand-in for the normalised body, 32 bytes."""
    return F.unhex(F.sha2(normalise_body(F.col(raw)), 256))


def first_blocks(blocks: DataFrame) -> DataFrame:
    """One block per file, type, name and normalised body: the one with the smallest start line, then the first."""
    return keep_first(blocks, [*BLOCK_GROUP, body_key()], BLOCK_ORDER)


def marked_blocks(blocks: DataFrame) -> DataFrame:
    """All blocks with ``is_first``, which tells those that ``first_blocks`` keeps. Blocks that lie together by file stay where they
    are."""
    return blocks.withColumn("is_first", is_first([*BLOCK_GROUP, body_key()], BLOCK_ORDER))


def first_models(models: DataFrame) -> DataFrame:
    """One model per file, name, type and normalised body: the one with the smallest start line."""
    return keep_first(models, ["file", "model_name", "type", body_key()], ["start_line", "end_line"])


def first_per_file(results: DataFrame, order: list[str]) -> DataFrame:
    """One result per file."""
    return keep_first(results, ["file"], order)


def distinct_issues(issues: DataFrame) -> DataFrame:
    """Drift issues without repeats of place, field, reason and kind; of two clients' issues the first remains."""
    keys = ["file", "line", "column", "type_name", "field_name", "reason", "kind"]
    return keep_first(issues, keys, ["client", "message"])


def distinct_inputs(issues: DataFrame) -> DataFrame:
    """Deprecated input fields, each once per place."""
    return issues.dropDuplicates(["file", "line", "type_name", "field_name", "reason"])
