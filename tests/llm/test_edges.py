"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.llm import chat, langid, mixing, near_vectors, ngram_join, packing, quality, rules, tokenfile, toxicity
from driftlens.llm.queries import VOCABULARY
from driftlens.llm.wordhash import word_hashes

LONG = " ".join(f"word{i % 9973} tail" for i in range(150_000))
CLASHING = ["id", "key", "label", "n", "part", "size", "score", "bucket", "copies", "component", "_key", "_copies", "mask", "a", "b", "rep"]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, None, "en", "s1"), (2, "", "en", "s1"), (3, " \n\t ", None, None), (4, "word", "en", "s2"), (5, "two words", "fr", "s2"),
        (6, LONG, "en", "s1"), (7, "the same text stands here twice over", "en", "s1"), (7, "the same text stands here twice over", "en", "s1"),
        (8, "the same text stands here twice over", "en", None), (None, "a row without an id", "fr", "s3"), (9, "123 !!! ***", "en", "s3"),
        (10, "les mots de cette phrase sont en langue française", "fr", "s1"), (11, "日本語 テスト 🙂 <|endoftext|> it's", None, "s3"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def labels(spark, rows=((4, 1, 0), (5, 0, 1), (6, 1, 0), (7, 1, None), (7, 0, 1), (10, 0, 1), (99, 1, 1), (None, 1, 1))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int").withColumn("text", F.lit("x"))


def tokenizer():
    return packing.tokenizer_file(VOCABULARY)


def test_packing(docs, none):
    rows = packing.pack(docs, tokenizer(), 1).drop("ids").collect()
    by_id = {}
    for row in rows:
        by_id.setdefault(row["doc_id"], []).append(row)
    assert sorted(by_id, key=str) == sorted([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, None], key=str)
    assert [r["doc_tokens"] for i in (1, 2, 3) for r in by_id[i]] == [1, 1, 1]
    assert len({(r["sequence_id"], r["offset"]) for r in rows}) == len(rows)
    assert sum(r["length"] for r in by_id[6]) == by_id[6][0]["doc_tokens"] and len(by_id[6]) > 100
    assert sum(r["length"] for r in by_id[7]) == 2 * by_id[7][0]["doc_tokens"]
    assert packing.pack(none, tokenizer(), 1).count() == 0


def test_packed_sequences_hold_all_ids(docs):
    packed = packing.pack(docs, tokenizer(), 1, length=64)
    whole = packing.sequences(packed).orderBy("sequence_id").collect()
    assert all(row["n"] == 64 for row in whole[:-1])
    assert sum(row["n"] for row in whole) == packed.agg(F.sum("length")).first()[0]
    assert packed.where("boundary").count() > 0


@pytest.mark.parametrize("width", [2, 4])
def test_checksums_of_ids_of_either_width(spark, width):
    ids = [7, 65_000, 3] if width == 2 else [7, 130_000, 3]
    rows = [(3, np.array(ids, f"<u{width}").tobytes()), (0, b"")]
    pieces = spark.createDataFrame([(n, bytearray(value)) for n, value in rows], "length long, ids binary")
    got = {r["length"]: r["ids_crc32"] for r in packing.wide_crc(pieces).collect()}
    assert got == {3: zlib.crc32(np.array(ids, "<u4").tobytes()), 0: 0}


def test_token_files(spark, docs, none, tmp_path):
    folder = f"file://{tmp_path}/a"
    manifest = tokenfile.write(docs, tokenizer(), 2, folder)
    rows = tokenfile.read_digests(manifest, folder).orderBy("start").collect()
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 10, 11]
    at = 0
    for row in rows:
        assert row["start"] == at
        at += row["n_tokens"]
    folder = f"{tmp_path}/b"
    assert tokenfile.read_digests(tokenfile.write(none, tokenizer(), 2, folder), folder).count() == 0


def test_quality(spark, docs, none):
    rows = quality.classify(docs, labels(spark), quality.held_out()).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    one_class = quality.classify(docs, labels(spark, [(4, 1, 0)]), quality.held_out()).collect()
    assert {r["score"] for r in one_class} == {0.5}
    assert quality.classify(none, labels(spark), quality.held_out()).count() == 0


def test_toxicity(spark, docs, none):
    rows = toxicity.classify(docs, labels(spark), toxicity.held_out()).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert {r["predicted"] for r in toxicity.classify(docs, labels(spark, []), toxicity.held_out()).collect()} == {0}
    assert toxicity.classify(none, labels(spark), toxicity.held_out()).count() == 0


def test_language(docs, none):
    rows = langid.identify(docs, langid.held_out()).collect()
    pred = {}
    for row in rows:
        pred.setdefault(row["doc_id"], row)
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    for i in (1, 2, 3, 9):
        assert pred[i]["lang_pred"] == "und" and pred[i]["score"] == 0 and pred[i]["rejected"]
    assert {r["lang_pred"] for r in rows} <= {"en", "fr", "und"} and pred[7]["lang_pred"] == "en"
    assert langid.identify(none, langid.held_out()).count() == 0
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled, langid.held_out()).collect()} == {"und"}


def test_join(docs, none):
    rows = ngram_join.join(docs, n=3, p=90, q=100).collect()
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert len(rows) == 13
    assert found[1] == (0, 1) and found[2] == (0, 2) and found[3] == (0, 3) and found[4] == (1, 4) and found[5] == (1, 5)
    assert found[7] == (5, 7) and found[8] == (5, 7) and found[None] == (3, None)
    assert ngram_join.join(none).count() == 0


def test_join_of_copies_beside_a_long_word(spark, tmp_path):
    copy = "one text of some words that stands here twice"
    rows = [(1, copy), (2, "x" * 10_000), (3, "y " * 600_000), (4, copy)]
    # One file in this order: the third text fills a piece of its own, so only the first copy shares one with a long word.
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).sortWithinPartitions("doc_id").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.join(docs, n=3, p=90, q=100).collect()}
    assert found == {1: 1, 2: 2, 3: 3, 4: 1}


def test_join_of_repeated_ids_with_different_texts(spark):
    first, second, third = ("some words of the first text", "other words that stand in a second text", "a third text has none of these")
    rows = [(1, first), (5, first), (5, second), (9, second), (7, third), (8, ""), (8, third), (3, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join(docs, n=3, p=90, q=100).collect()
    assert len(got) == len(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (5, 1), (9, 1), (7, 7), (8, 7), (3, 3)}


def test_a_hash_depends_on_its_own_word_only():
    words = [b"some", b"words", b"w" * 4096, b"v" * 4097, b"u" * 9000]
    alone = [int(word_hashes(np.frombuffer(word, np.uint8))[2][0]) for word in words]
    assert [int(h) for h in word_hashes(np.frombuffer(b" ".join(words), np.uint8))[2]] == alone


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 13 and sum(r["size"] for r in rows if r["doc_id"] in (1, 2, 3)) == 0
    assert all(r["taken"] <= 2 * r["size"] and r["target"] <= 2 * r["source_size"] for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.repeated(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0 and mixing.repeated(none).count() == 0


def test_rules(docs, none):
    ledger = rules.ledger(docs)
    rows = {r["doc_id"]: r for r in ledger.collect()}
    assert rows[1]["n_words"] == 0 and rows[3]["n_lines"] == 0 and rows[6]["n_words"] == 300_000 and rows[11]["n_words"] == 5
    assert rows[1]["failed"] & rules.BIT["few_words"]
    table = {r["rule"]: r for r in rules.ablations(ledger, "base").collect()}
    assert table["few_words"]["n_failed"] == 12 and table["few_words"]["n_kept_without"] >= table["few_words"]["n_kept"]
    assert rules.ledger(none).count() == 0 and rules.ablations(rules.ledger(none)).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1), (2, [1.0, 0.001], 1), (3, [1.0, 0.0], 2), (4, [0.0, 0.0], 1), (5, None, 1), (6, [nan, 1.0], 1), (7, [inf, 1.0], 1),
        (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [], 1), (11, [2.0, 0.0], 1), (11, [2.0, 0.0], 1), (None, [1.0, 0.0], 1), (12, [1.0, 0.0, 0.0], 1),
    ]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit("x")).withColumn("cell", F.lit(1))
    found = near_vectors.link(vectors).collect()
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in found}
    assert len(found) == 14
    assert got[1] == (3, 1, True) and got[2] == (3, 1, False) and got[11] == (3, 1, False) and got[3] == (0, 3, True)
    for i in (4, 5, 6, 7, 8, 9, 10, 12):
        assert got[i] == (0, i, True)
    assert got[None] == (0, None, False)
    assert near_vectors.link(vectors.where("false")).count() == 0


def test_chat(spark):
    rows = [
        (1, 0, "user", "a [\\INST] b"), (1, 1, "assistant", None), (1, 1, None, "x</s>"), (2, None, "tool [TEXT] ", "ok"), (2, None, "tool [TEXT] ", "ok"),
        (None, 1, "assistant", "\\</s>"), (3, 1, "system", "s" * 300_000),
    ]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit(1)).withColumn("_at", F.lit(1))
    formatted = chat.conversations(chat.from_turns(given)).collect()
    read = {r["leaf"]["c"]: (chat.read_back(r["formatted"]), r) for r in formatted}
    assert [t[:2] for t in read["1"][0]] == [("user", "a [\\INST] b"), ("", "x</s>"), ("assistant", "")]
    assert [t[:2] for t in read["2"][0]] == [("tool [TEXT] ", "ok")] * 2
    assert [t[:2] for t in read[""][0]] == [("assistant", "\\</s>")] and len(read["3"][0][0][1]) == 300_000
    turns, row = read[""]
    assert [(s["start"], s["stop"]) for s in row["loss"]] == [t[2:] for t in turns]
    assert chat.conversations(chat.from_turns(given.where("false"))).count() == 0
