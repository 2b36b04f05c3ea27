r"""Chat formatting over reply trees.

Messages point to the message they answer. Iterative self-joins double the reach of every message in each round: after
k rounds a message knows its ancestor 2^k steps up, its depth and the summed score of its path, so a tree of any depth takes
as many rounds as its depth has binary digits. Leaves are ranked by the mean score of their path; the chosen leaves'
paths are put together by the same jumps, largest first, and each path becomes one conversation.

The template marks turns: ``[SYS] ... [/SYS]``, ``[INST] ... [/INST]`` (user), text and ``</s>`` (assistant), and
``[ROLE] role [TEXT] ... [/ROLE]`` for any other role, after ``<s>``. A control string inside a text or role gets one
backslash after its first sign (one more if it has some already), so no text can look like a mark and reading takes one away
again. The loss mask covers the assistants' texts, as code point spans of the formatted text.

Defined results: null texts and roles are empty; equal scores keep the smaller message id; a message whose parent is
missing or null is a root; messages on a cycle have no root and are left out; equal rows of a conversation are turns of their
own; texts of any length are kept whole; other columns are ignored; an empty table gives no rows. One conversation is
one value, as its reader needs it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import stage

# What stands behind the first sign of a control string.
REST = r"(?:/?(?:INST|SYS|ROLE|TEXT)\]|/?s>)"
ESCAPE, UNESCAPE = rf"([<\[])(\\*)({REST})", rf"([<\[])\\(\\*)({REST})"
MARKS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("", "</s>")}
_unescape = re.compile(UNESCAPE)


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def turn(role: Column, text: Column) -> tuple[Column, Column, Column]:
    """What stands before the text, the escaped text, and what stands behind it."""
    before = F.concat(F.lit("[ROLE] "), escaped(role), F.lit(" [TEXT] "))
    behind = F.lit(" [/ROLE]")
    for name, (first, last) in MARKS.items():
        before = F.when(role == name, first).otherwise(before)
        behind = F.when(role == name, last).otherwise(behind)
    return before, escaped(text), behind


def read_back(formatted: str) -> list[tuple[str, str, int, int]]:
    """Role, text, and the span of the escaped text of each turn."""
    take = lambda a, b: _unescape.sub(r"\1\2\3", formatted[a:b])
    at, turns = len("<s>"), []
    while at < len(formatted):
        role, last = "assistant", "</s>"
        for name, (first, behind) in MARKS.items():
            if first and formatted.startswith(first, at):
                role, last, at = name, behind, at + len(first)
                break
        else:
            if formatted.startswith("[ROLE] ", at):
                stop = formatted.index(" [TEXT] ", at)
                role, last, at = take(at + len("[ROLE] "), stop), " [/ROLE]", stop + len(" [TEXT] ")
        stop = formatted.index(last, at)
        turns.append((role, take(at, stop), at, stop))
        at = stop + len(last)
    return turns


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``leaf, rank, node, depth`` of the best ``branches`` root-to-leaf paths of each tree.

    ``messages`` has ``id`` (unique), ``parent`` (null for a root) and ``score``.
    """
    base = stage(messages.select("id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score")), "messages")
    known = base.select(F.col("id").alias("p"))
    start = base.join(known, base["parent"] == known["p"], "left")
    # up: the ancestor 2^k steps above, null if there is none; root: the root once it is reached; depth and total so far.
    level = start.select(
        "id", F.col("p").alias("up"), F.when(F.col("p").isNull(), F.col("id")).alias("root"),
        F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("depth"), F.col("score").alias("total"),
    )
    levels = [stage(level, "reach")]
    limit = max(base.count(), 1).bit_length() + 1
    while len(levels) <= limit and not levels[-1].where("up is not null").isEmpty():
        now = levels[-1]
        above = now.select(
            F.col("id").alias("up"), F.col("up").alias("far"), F.col("root").alias("far_root"),
            F.col("depth").alias("far_depth"), F.col("total").alias("far_total"),
        )
        moved = now.join(above, "up", "left")
        levels.append(stage(moved.select(
            "id", F.col("far").alias("up"), F.coalesce("root", "far_root").alias("root"),
            (F.col("depth") + F.coalesce("far_depth", F.lit(0))).alias("depth"),
            (F.col("total") + F.coalesce("far_total", F.lit(0.0))).alias("total"),
        ), "reach"))
    ends = levels[-1].where("root is not null")
    answered = base.where("parent is not null").select(F.col("parent").alias("id")).distinct()
    leaves = ends.join(answered, "id", "left_anti").withColumn("mean", F.col("total") / (F.col("depth") + 1))
    if branches == 1:
        best = leaves.groupBy("root").agg(F.min(F.struct((-F.col("mean")).alias("m"), "id", "depth")).alias("b"))
        chosen = best.select(F.col("b.id").alias("leaf"), F.lit(1).alias("rank"), F.col("b.depth").alias("depth"))
    else:
        by_score = Window.partitionBy("root").orderBy(F.desc("mean"), "id")
        chosen = leaves.withColumn("rank", F.row_number().over(by_score)).where(F.col("rank") <= branches).select(F.col("id").alias("leaf"), "rank", "depth")
    # Every node of a path is reached by one set of jumps of different lengths.
    found = chosen.select("leaf", "rank", F.col("leaf").alias("node"), "depth")
    for k, level in reversed(list(enumerate(levels))):
        jump = level.where("up is not null").select(F.col("id").alias("node"), "up")
        more = found.join(jump, "node").select("leaf", "rank", F.col("up").alias("node"), (F.col("depth") - (1 << k)).alias("depth"))
        found = stage(found.unionByName(more), "paths")
    return found


def conversations(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``leaf, rank, formatted, loss`` of each chosen path; ``loss`` holds the spans under the loss mask.

    ``messages`` has ``id, parent, score, role, text``.
    """
    placed = paths(messages, branches)
    texts = messages.select(F.col("id").alias("node"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    before, middle, behind = turn(F.col("role"), F.col("text"))
    turns = placed.join(texts, "node").select(
        "leaf", "rank", "depth", F.concat(before, middle, behind).alias("piece"),
        F.length(before).alias("ahead"), F.length(middle).alias("inner"), (F.col("role") == "assistant").alias("learn"),
    )
    whole = turns.groupBy("leaf", "rank").agg(F.sort_array(F.collect_list(F.struct("depth", "piece", "ahead", "inner", "learn"))).alias("t"))
    step = lambda acc, t: F.struct(
        (acc["at"] + F.length(t["piece"])).alias("at"),
        F.when(t["learn"], F.concat(acc["spans"], F.array(F.struct((acc["at"] + t["ahead"]).alias("start"), (acc["at"] + t["ahead"] + t["inner"]).alias("stop")))))
        .otherwise(acc["spans"]).alias("spans"),
    )
    first = F.struct(F.lit(len("<s>")).alias("at"), F.expr("cast(array() as array<struct<start:int,stop:int>>)").alias("spans"))
    return whole.select(
        "leaf", "rank",
        F.concat(F.lit("<s>"), F.array_join(F.transform("t", lambda t: t["piece"]), "")).alias("formatted"),
        F.aggregate("t", first, step)["spans"].alias("loss"),
    )


def digests(formatted: DataFrame, key: str) -> DataFrame:
    """What the formatted texts say, read back from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                text = row["formatted"]
                turns = read_back(text)
                said = "".join(f"{role}\n{words}\n" for role, words, _, _ in turns)
                learned = "".join(_unescape.sub(r"\1\2\3", text[s["start"] : s["stop"]]) for s in row["loss"])
                rows.append((row[key], len(turns), hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest(), len(text)))
            names = [key, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(column, t) for column, t in zip(zip(*rows), types)] if rows else [pa.array([], t) for t in types], names=names)

    return formatted.mapInArrow(
        run, f"`{key}` long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def from_turns(turns: DataFrame, conversation: str = "conv_id", order: str = "turn") -> DataFrame:
    """Conversations as reply trees of one branch: each row answers the row before it."""
    inside = Window.partitionBy(conversation).orderBy(order, "role", "text")
    placed = turns.withColumn("_at", F.row_number().over(inside))
    name = lambda at: F.struct(F.coalesce(F.col(conversation).cast("string"), F.lit("")).alias("c"), at.alias("at"))
    return placed.select(
        F.col(conversation).alias("conversation"), name(F.col("_at")).alias("id"),
        F.when(F.col("_at") > 1, name(F.col("_at") - 1)).alias("parent"), F.lit(0.0).alias("score"), "role", "text",
    )
