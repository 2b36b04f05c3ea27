"""Mixing sources to target weights by capped water-filling.

Every source weighs something; a source's target is its share of all words asked for, but at most ``epochs`` times its
size. What a clamped source cannot give goes to the others by weight, again and again until none is above: one small
aggregate over the sources a round. A target is whole repetitions of every document of the source and, for the rest,
documents in a seeded order until the rest is met as nearly as whole documents can. The order is cut into hash ranges,
so a source of any size is summed range by range and never sorted in one task.

Defined results: a null text has size 0; a null source is one source, last in order; equal rows are drawn one by one;
a source without words takes nothing; an empty table gives no rows; other columns are kept by ``repeated`` and ignored
by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import WORD, join_key, stage

WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"


def sizes(text: Column) -> Column:
    """Number of words of a text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, weight, target`` from ``source, size``; weights repeat in the order of code points."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # One row per source is all that this window sorts.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sources = stage(totals.withColumn("weight", weight).withColumn("cap", F.col("source_size") * epochs), "sources")
    every = sources.agg(F.sum("source_size").alias("size"), F.sum("weight").alias("weight")).first()
    wanted = share * (every["size"] or 0)
    level, clamped = (wanted / every["weight"] if every["weight"] else 0.0), 0
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level)
        now = sources.agg(
            F.count_if(over).alias("n"), F.sum(F.when(over, F.col("cap"))).alias("given"), F.sum(F.when(~over, F.col("weight"))).alias("free")
        ).first()
        if now["n"] == clamped:
            break
        clamped = now["n"]
        level = (wanted - now["given"]) / now["free"] if now["free"] else float("inf")
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level))
    return sources.select("source", "source_size", "weight", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple = WEIGHTS,
    share: float = SHARE,
    epochs: int = EPOCHS,
    seed: str = SEED,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
) -> DataFrame:
    """The key and ``size, source_size, target, copies, taken`` of each document, and ``rank_hash``."""
    drawn = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"))
    sized = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), sizes(F.col(text)).alias("size"), drawn.alias("rank_hash"))
    sized = stage(sized.withColumn("bin", F.substring("rank_hash", 1, 3)), "sizes")
    goals = targets(sized, weights, share, epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(epochs))).otherwise(0)
    goals = goals.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    before = Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = sized.groupBy("source", "bin").agg(F.sum("size").alias("bin_size"))
    bins = bins.withColumn("lo", F.coalesce(F.sum("bin_size").over(before), F.lit(0)))
    same = lambda x, y: x.eqNullSafe(y)
    bins = bins.alias("b").join(goals.alias("g"), same(F.col("b.source"), F.col("g.source"))).select(
        F.col("b.source").alias("of"), F.col("bin").alias("in_bin"), "lo", "source_size", "target", "whole", "rest"
    )
    placed = sized.join(bins, same(F.col("source"), F.col("of")) & (F.col("bin") == F.col("in_bin")))
    upto = Window.partitionBy("source", "bin").orderBy("rank_hash", "key", "size").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.col("lo") + F.sum("size").over(upto) - F.col("size") / 2
    extra = ((F.col("rest") > 0) & (middle <= F.col("rest"))).cast("long")
    return placed.withColumn("copies", F.col("whole") + extra).select(
        F.col("key").alias(key), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "rank_hash"
    )


def repeated(docs: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """The documents as the mix takes them: each row as often as its copies say."""
    mixed = stage(mix(docs, key=key, **options), "mix")
    copies, at = join_key(docs, "_copies"), join_key(docs, "_at")
    # Equal ids share their copies: how often a key is taken is decided once for all its rows.
    per_key = mixed.groupBy(F.col(key).alias(at)).agg(F.max("copies").alias(copies))
    joined = docs.join(per_key, docs[key].eqNullSafe(F.col(at)))
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))
    return joined.where(F.col(copies) > 0).select(*[docs[c] for c in docs.columns], times.alias(at)).drop(at)
