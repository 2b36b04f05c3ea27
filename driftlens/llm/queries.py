"""The queries of the llm operators, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import chat, hard_negatives, langid, manifest, mixing, near_vectors, ngram_join, packing, pii, quality, rules, tokenfile, toxicity
from driftlens.llm.common import read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
VOCABULARY = "word_bpe_49k.json"


def query(name: str) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        return run

    return register


@query("op1_packing")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    packed = packing.pack(docs, packing.tokenizer_file(VOCABULARY), end_id=1)
    return packing.wide_crc(packed).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary"
    )


@query("op7_token_files")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    target = tokenfile.new_folder(spark)
    manifest = tokenfile.write(docs, packing.tokenizer_file(VOCABULARY), end_id=2, folder=target)
    return tokenfile.read_digests(manifest, target)


@query("op8_ngram_join")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.join(read(spark, folder, "documents"), n=3, p=90, q=100)


@query("op5_mixing")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(read(spark, folder, "documents")).drop("rank_hash")


@query("op9_quality_rules")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    base = F.col("failed").bitwiseAND(F.lit(rules.BASE)) != 0
    ledger = rules.ledger(read(spark, folder, "documents"))
    return ledger.select(
        "doc_id", *rules.MEASURES, "failed", base.alias("base_failed"), (~base & rules.passes(rules.CURRENT)).alias("kept")
    )


@query("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return langid.identify(read(spark, folder, "documents"), langid.held_out())


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    return quality.classify(docs, labels, quality.held_out())


@query("op10_toxicity")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    return toxicity.classify(docs, labels, toxicity.held_out())


@query("op4_near_vectors")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors.link(read(spark, folder, "embeddings"))


@query("op6_chat_format")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    given = read(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    messages = chat.from_turns(given.unionByName(planted))
    formatted = chat.conversations(messages)
    named = formatted.select(F.expr("try_cast(leaf.c as long)").alias("conv_id"), "formatted", "loss")
    return chat.digests(named, "conv_id")


@query("op11_pii")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return pii.digests(pii.find(read(spark, folder, "documents")))


@query("op12_manifest")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return manifest.prove(read(spark, folder, "documents"), manifest.without_lines())


@query("op13_hard_negatives")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = read(spark, folder, "embeddings").withColumn("label", label)
    rows = hard_negatives.prepared(vectors, hard_negatives.whole_numbers())
    return hard_negatives.mine(rows, F.col("id") % 100 == 0)
