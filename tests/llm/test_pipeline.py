"""Each stage of the pipeline against a plain version on its own input."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from driftlens.llm import mixing, packing
from driftlens.llm.queries import VOCABULARY
from driftlens.session import stage
from plain import classes, shingles

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, found = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, step in corpus_pipeline.STAGES:
        after = stage(step(spark, docs, FOLDER), name)
        found.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in found}


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_filters_keep_columns_and_clean_documents(spark, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    for name in ("language_id", "quality_classifier"):
        before, after = steps[name]
        assert before.columns == after.columns
        gone = set(ids(before)) - set(ids(after))
        assert set(ids(after)) <= set(ids(before)) and len(gone) < len(ids(before)) / 3
        if name == "language_id":
            assert all(not any(c.isalpha() for c in r["text"] or "") for r in before.where(before.doc_id.isin(list(gone))).collect()) or len(gone) <= 2
        else:
            assert sum(labels.get(i) == 1 for i in gone) <= 2


def test_one_document_of_each_group_stays(steps):
    before, after = steps["ngram_jaccard_join"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
    sets = [shingles(text or "", 5) for _, text in rows]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    root = classes(len(sets), links)
    assert ids(after) == [rows[i][0] for i in range(len(rows)) if root[i] == i]


def test_documents_are_repeated_as_often_as_the_mix_says(steps):
    before, after = steps["mixing"]
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    assert Counter(ids(after)) == Counter({i: n for i, n in copies.items() if n})
    assert after.columns == before.columns
    size, taken, target = defaultdict(int), defaultdict(int), {}
    source = {r["doc_id"]: r["source"] for r in before.collect()}
    for r in mixing.mix(before).collect():
        s = source[r["doc_id"]]
        size[s], taken[s], target[s] = max(size[s], r["size"]), taken[s] + r["taken"], r["target"]
    assert all(abs(taken[s] - target[s]) <= size[s] for s in target)


def test_pieces_hold_every_id_once(steps):
    from tokenizers import Tokenizer

    before, after = steps["packing"]
    library = Tokenizer.from_file(packing.tokenizer_file(VOCABULARY))
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    words = {i: [*library.encode(t or "", add_special_tokens=False).ids, 1] for i, t in texts.items()}
    pieces = after.collect()
    assert sum(p["length"] for p in pieces) == sum(len(words[i]) for i in ids(before))
    ends = defaultdict(int)
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        assert p["offset"] == ends[p["sequence_id"]] and p["doc_tokens"] == len(words[p["doc_id"]])
        ends[p["sequence_id"]] += p["length"]
        part = np.array(words[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4")
        assert len(part) == p["length"] and zlib.crc32(part) == p["ids_crc32"]
    assert sorted(ends) == list(range(len(ends))) and all(n == 2048 for i, n in ends.items() if i < len(ends) - 1)
