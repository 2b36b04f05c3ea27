"""A corpus pipeline of the llm operators: each stage's rows are written as Parquet and reread as the next one's.

Documents whose language is rejected go, documents of low quality go, one document of each group of near duplicates stays,
sources are mixed to their weights by repeating or leaving out documents, and what is left is packed into sequences.

Defined results: decisions are taken by ``doc_id``, so rows with the same id share them; a null id is never rejected and never
a duplicate; texts that are null, empty or without a letter are rejected by the first stage; an empty table passes through.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import langid, mixing, ngram_join, packing, quality
from driftlens.llm.common import read, stage, without_keys
from driftlens.llm.queries import VOCABULARY
from driftlens.session import discard, drop_paths, staged_paths

Step = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: dict[str, list[str]] = {}


def tidy(step: Step) -> Step:
    """A stage that deletes what the stage before it has staged for itself: models, decisions, side tables.

    A stage's rows are written before the next one begins, so nothing reads them any more.
    """

    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        drop_paths(spark, _left.pop(application, []))
        before = set(staged_paths(spark))
        result = step(spark, docs, sf_dir)
        _left[application] = [path for path in staged_paths(spark) if path not in before]
        return result

    return run


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among ``ids``."""
    gone = ids.select(F.col("doc_id").alias("gone")).where("gone is not null").distinct()
    return without_keys(docs, "doc_id", gone)


@tidy
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents that the calibrated limit rejects go."""
    judged = stage(langid.identify(docs, langid.held_out()), "judged")
    return _without(docs, judged.where("rejected"))


@tidy
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents predicted to be of low quality go."""
    judged = stage(quality.classify(docs, read(spark, sf_dir, "labels"), quality.held_out()), "judged")
    return _without(docs, judged.where("predicted = 0"))


@tidy
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join, five words and 0.8: of each group the document with the smallest id stays, once."""
    groups = stage(ngram_join.join(docs, n=5, p=80, q=100), "groups")
    kept = _without(docs, groups.where("component_id <> doc_id"))
    again = groups.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 and doc_id is not null")
    again = stage(again.select(F.col("doc_id").alias("_again")), "again")
    single = kept.join(again, kept["doc_id"] == again["_again"], "left_anti")
    several = kept.join(again, kept["doc_id"] == again["_again"], "left_semi").dropDuplicates(["doc_id"])
    return single.unionByName(several)


@tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each document as often as its source's target asks for."""
    return mixing.repeated(docs)


@tidy
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents left."""
    packed = packing.pack(docs, packing.tokenizer_file(VOCABULARY), end_id=1)
    return packing.wide_crc(packed).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


STAGES = [
    ("language_id", language),
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

# The models and the tokenizer are beyond SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = read(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
