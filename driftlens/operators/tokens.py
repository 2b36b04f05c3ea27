"""Definitions and selections of operation texts, one row each.

A text is read inside its row (``lexer``); texts are shuffled once, by key, as compact strings, and no token ever is.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.functions.text import bind, newlines, strip, strip_quotes
from driftlens.operators.lexer import GAP, bad_text, definitions_of, selections_of
from driftlens.session import stage


def cleaned(body: Column) -> Column:
    """The text of a candidate as it is read: stripped, without one pair of outer quotes."""
    return bind(strip(body), strip_quotes)


def definitions(candidates: DataFrame) -> DataFrame:
    """Split candidate texts into operations and fragments, or one ``unknown`` row for a text that does not parse.

    ``candidates`` holds ``file, strategy, seq, body, start_line, mode``. ``mode`` says how lines are counted:
    ``offset`` for a body at a known place of its file, ``node`` for a string value (one line further when it spans
    lines), ``document`` for a text that is its own file. ``error_line`` is where a text that does not parse is
    reported.
    """
    key, head = ["file", "strategy", "seq"], ["body", "start_line", "mode", "error_line"]
    texts = candidates.select(*key, *head, cleaned(F.col("body")).alias("text"))
    read = texts.select(*key, *head, "text", definitions_of(F.col("text")).alias("found"))
    # Texts are read where they lie and dealt out once: a file's texts meet in one task and stay there for what is told of them
    # next. Sorting starts from a number, not from names that begin alike.
    parts = int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = Window.partitionBy(F.xxhash64("file"), *key)
    rows = read.repartition(parts, "file").select(
        "*", F.row_number().over(same.orderBy("body", "start_line")).alias("_copy"), F.count("*").over(same).alias("_copies"),
    )
    # Texts that share a key cannot be told apart, they count as one that does not parse.
    found = F.when(F.col("_copies") == 1, F.col("found")).otherwise(bad_text())
    return _blocks(rows.filter("_copy = _copies").select(*key, *head, "text", F.inline(found)))


def _blocks(joined: DataFrame) -> DataFrame:
    text, mode, start = F.col("text"), F.col("mode"), F.col("start_line")
    bad = F.col("bad_text")
    raw = F.when(bad, text).otherwise(
        F.substring(text, F.col("def_start") + 1, F.col("def_end") - F.col("def_start"))
    )
    kind = (
        F.when(bad, "unknown")
        .when(F.col("first") == "{", "query")
        .when(F.col("first").isin("query", "mutation", "subscription", "fragment"), F.col("first"))
    )
    name = F.when(~bad & (F.col("first") != "{"), F.try_element_at("names", F.lit(2)))
    condition = F.when(~bad & (F.col("first") == "fragment"), F.try_element_at("names", F.lit(4)))
    # An operation without a name may still have directive names in its header.
    before = F.substring(text, F.lit(1), F.col("def_start"))
    has_name = F.regexp_like(raw, F.lit(rf"^(?:query|mutation|subscription|fragment){GAP}[_A-Za-z]"))
    name = F.when(has_name, name)
    body = F.col("body")
    head = F.substring(strip(body), 1, 3)
    tail = F.substring(strip(body), -3, 3)
    spans_lines = text.contains("\n") | (head.isin('"""', "'''") & (head == tail))
    lines_before = newlines(before)
    placed = (
        F.when(mode == "offset", start + newlines(F.substring(body, F.lit(1), F.col("def_start"))))
        .when(mode == "document", start + lines_before)
        .otherwise(start + F.when(spans_lines, lines_before + 1).otherwise(0))
    )
    error_line = F.col("error_line")
    first_line = F.when(bad, error_line).otherwise(placed)
    return (
        joined.filter(bad | kind.isNotNull())
        .select(
            "file",
            kind.alias("type"),
            name.alias("name"),
            F.when(~bad & (kind != "fragment"), F.col("variables")).when(bad, F.array().cast("array<string>")).alias("variables"),
            condition.alias("type_condition"),
            raw.alias("raw"),
            first_line.cast("int").alias("start_line"),
            F.when(bad, error_line).otherwise(placed + newlines(raw)).cast("int").alias("end_line"),
            F.when(bad, F.lit("the text is not a valid operation document")).alias("error"),
            "strategy",
            "seq",
            F.coalesce("def_no", F.lit(0)).cast("int").alias("def_no"),
        )
        # A text that does not parse yields one row, whatever its parts look like.
        .filter(F.col("error").isNull() | (F.col("def_no") == 0))
    )


def error_position(lines: Column, start: Column, body: Column) -> Column:
    """Line of the file, at most nine before and ten after ``start``, that holds the text's first 20 characters."""
    first = F.greatest(F.lit(0), start - 10)
    around = F.slice(lines, first + 1, F.greatest(start + 10 - first, F.lit(0)))

    def search(probe: Column) -> Column:
        found = F.filter(F.transform(around, lambda line, i: F.when(line.contains(probe), i)), lambda i: i.isNotNull())
        return F.when(F.length(probe) > 0, F.try_element_at(found, F.lit(1)) + F.greatest(F.lit(1), start - 9))

    return bind(F.substring(cleaned(body), 1, 20), search)


def selections(blocks: DataFrame, key: list[str]) -> DataFrame:
    """Selection rows of operation and fragment texts.

    ``blocks`` holds the ``key`` columns (unique per row) and ``raw``. Each row is a field, an inline fragment, a
    spread, or an argument given to a field (with the field's ``node``), with its depth, its place in the text (lines count from 1)
    and ``path``: the fields (``.name``) and type conditions (``:type``, ``:`` for none) that lead to it, outermost first, without itself,
    joined by slashes. No depth is too deep.
    """
    texts = blocks.groupBy(*key).agg(F.max("raw").alias("raw"), F.count("*").alias("copies"))
    return texts.select(*key, F.inline(selections_of(F.col("raw"), F.col("copies"))))


def selections_beside(blocks: DataFrame, key: list[str], beside: list[str | Column]) -> DataFrame:
    """``selections`` with further columns of their block. Keys are counted without their texts; only texts whose key is there
    more than once are joined with their number, the others are read where they lie."""
    texts = blocks.select(*key, "raw", *beside)
    names = [c for c in texts.columns if c != "raw"]
    several = stage(blocks.groupBy(*key).agg(F.count("*").alias("_copies")).filter("_copies > 1"), "several")
    if several.isEmpty():
        texts = texts.withColumn("_copies", F.lit(1).cast("bigint"))
    else:
        same = reduce(and_, [texts[name].eqNullSafe(several[name]) for name in key])
        texts = texts.join(several, same, "left").select(*[texts[name] for name in texts.columns], F.coalesce("_copies", F.lit(1)).alias("_copies"))
    return texts.select(*names, F.inline(selections_of(F.col("raw"), F.col("_copies"))))
