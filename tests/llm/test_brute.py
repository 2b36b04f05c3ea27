"""The operators against plain versions, exact round trips and held-out accuracy."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.llm import chat, components, langid, linear, mixing, near_vectors, ngram_join, packing, quality, rules, tokens, toxicity
from driftlens.llm.queries import QUERIES, VOCABULARY
from plain import classes, shingles

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n,p", [(3, 90), (5, 80), (1, 50)])
def test_join_matches_all_pairs(spark, n, p):
    rng = random.Random(n)
    texts = []
    for size in (0, 1, 2, 3, 4, 7, 12, 30, 80, 200, 520, 1100):
        base = [f"w{rng.randrange(400)}" for _ in range(size)]
        for copies in range(14):
            own = base[:]
            for _ in range(rng.randrange(0, 1 + size // 12 + copies % 3)):
                if own:
                    own[rng.randrange(len(own))] = f"v{rng.randrange(10**6)}"
            texts.append(" ".join(own[: len(own) - copies % 2]))
    sets = [shingles(t, n) for t in texts]
    links = [
        (a, b) for a in range(len(texts)) for b in range(a)
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= p * len(sets[a] | sets[b])
    ]
    want = classes(len(texts), links)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs, n, p, 100).collect()}
    assert got == {i: (len(s), c) for i, (s, c) in enumerate(zip(sets, want))}


def test_pigeonhole_holds_for_every_similar_pair():
    rng = np.random.default_rng(1)
    bands = ngram_join.Bands(80, 100)
    for size in [1, 2, 5, 9, 20, 100, 700]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
            keep = a[rng.permutation(len(a))[: int(np.ceil(0.89 * len(a)))]]
            b = np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, int(0.1 * len(keep))).astype(np.uint64)]))
            if 100 * len(np.intersect1d(a, b)) >= 80 * len(np.union1d(a, b)):
                assert len(np.intersect1d(ngram_join.sketch(a, bands)[0], ngram_join.sketch(b, bands)[0]))


def test_folded_sketches_never_exceed_the_difference(spark):
    rng = np.random.default_rng(2)
    bands, rows = ngram_join.Bands(50, 100), []
    for size in (1, 40, 257, 500, 1030, 4000):
        for share in (0.1, 0.5, 0.9, 1.0, 1.9):
            a = np.unique(rng.integers(0, 1 << 62, size).astype(np.uint64))
            more = rng.integers(0, 1 << 62, int(share * size)).astype(np.uint64)
            b = np.unique(np.concatenate([a[: int(size * min(share, 1))], more]))
            if len(b):
                long = [ngram_join.sketch(x, bands)[2].view(np.int64).tolist() for x in (a, b)]
                rows.append((len(np.setxor1d(a, b)), len(long[0]) != len(long[1]), *long))
    df = spark.createDataFrame(rows, "apart long, folds boolean, x array<long>, y array<long>")
    found = df.select("apart", "folds", ngram_join._distance("x", "y").alias("d"), ngram_join._distance("y", "x").alias("e")).collect()
    assert any(r["folds"] for r in found) and all(r["d"] == r["e"] <= r["apart"] for r in found)
    assert sum(r["d"] for r in found) > 0.5 * sum(r["apart"] for r in found)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(200)] + [(rng.randrange(300, 600), rng.randrange(300, 600)) for _ in range(150)] + [(900, x) for x in range(901, 960)]
    want = classes(1000, edges)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["id"]: r["component"] for r in got} == {i: want[i] for e in edges for i in e if e[0] != e[1]}


def test_tokens_match_the_library():
    coder = tokens.Encoder(packing.tokenizer_file(VOCABULARY))
    odd = ["", " ", "Hello<|endoftext|>x", "don't I'LL \x1cA\x85b c\xa0d ² ½ × ÷", "É́ ΑΣ İi ﬁ 日本語 🙂", "a_b 12345 ...'s'd", "z" * 9000, "ÀÉÞß naïve"]
    flat, counts = coder.encode([x.encode() for x in odd])
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [e.ids for e in coder.library.encode_batch(odd, add_special_tokens=False)]


def test_vectors_match_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(near_vectors, "CELL", 40)
    monkeypatch.setattr(near_vectors, "CHUNK", 16)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 12))
    x = np.concatenate([base, base[:20] + 0.05 * rng.normal(size=(20, 12)), base[0] + 0.08 * rng.normal(size=(80, 12))]).astype(np.float32)
    label = np.arange(len(x)) % 2
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    close = (unit @ unit.T >= 0.98) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)
    want = classes(len(x), [tuple(e) for e in np.argwhere(close)])
    rows = [(i, [float(v) for v in x[i]], int(label[i])) for i in range(len(x))]
    got = near_vectors.link(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == {i: (int(close[i].sum()), want[i]) for i in range(len(x))}


def test_reply_trees_rank_branches(spark):
    rng = random.Random(9)
    parent, score = {0: None}, {0: 0.5}
    for i in range(1, 400):
        parent[i], score[i] = rng.randrange(max(0, i - 4), i) if i % 50 else None, round(rng.random(), 3)
    rows = [(i, parent[i], score[i], "user" if i % 2 else "assistant", f"m{i}") for i in parent]
    messages = spark.createDataFrame(rows, "id long, parent long, score double, role string, text string")
    inner = {p for p in parent.values() if p is not None}
    by_root = defaultdict(list)
    for leaf in set(parent) - inner:
        path = [leaf]
        while parent[path[-1]] is not None:
            path.append(parent[path[-1]])
        by_root[path[-1]].append((-sum(score[i] for i in path) / len(path), leaf, path[::-1]))
    for branches in (1, 2):
        got = defaultdict(list)
        for r in chat.paths(messages, branches).orderBy("depth").collect():
            got[r["leaf"]].append(r["node"])
        assert dict(got) == {leaf: path for own in by_root.values() for _, leaf, path in sorted(own)[:branches]}


def test_cycles_have_no_root(spark):
    rows = [(1, 2, 0.0), (2, 1, 0.0), (3, None, 0.0)]
    assert [r["leaf"] for r in chat.paths(spark.createDataFrame(rows, "id long, parent long, score double")).collect()] == [3]


def test_kneser_ney_sums_to_one(spark):
    docs = spark.createDataFrame([("abab abba baab aabb", "x"), ("abab ba", "x")], "text string, lang string")
    model = langid.train(docs)
    signs = np.array([ord(c) for c in "ab "], np.uint32)
    for context in ("aba", "bb ", "  a"):
        columns = [np.full(3, ord(c), np.uint32) for c in context] + [signs]
        total = np.exp(model.log_probability(columns)[:, 0]).sum()
        assert 0.9 < total <= 1.0 + 1e-6


def test_every_gram_keeps_its_own_probability_among_many_languages(spark):
    rng = random.Random(4)
    signs = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    rows = [("".join(rng.choice(signs) for _ in range(100_000)), "many")] + [(f"{a}{b} ", f"l{a}{b}") for a in "abcdefghijklmnopq" for b in "abcdefghijklmnopq"]
    docs = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    many = model.languages.index("many")
    assert len(model.languages) == 290
    # A 4-gram with an unseen context goes back to the last two symbols at most, whatever else is learned.
    unseen = [np.array([ord(rng.choice(signs)) for _ in range(2000)], np.uint32) for _ in range(4)]
    seen = {rows[0][0][i : i + 2] for i in range(len(rows[0][0]) - 1)}
    new = np.array([chr(a) + chr(b) not in seen for a, b in zip(unseen[2], unseen[3])])
    alone = model.log_probability(unseen)[:, many]
    assert new.sum() > 1000 and alone[new].max() < np.log(0.01)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.score(docs, model).collect()}
    assert got == {i: row[1] for i, row in enumerate(rows)}


def test_texts_in_an_unlearned_language_are_rejected(spark):
    rng = random.Random(8)
    words = {lang: ["".join(rng.choice(signs) for _ in range(rng.randrange(3, 8))) for _ in range(60)] for lang, signs in (("x", "abcdefgh"), ("y", "mnopqrst"), (None, "αβγδεζηθ"))}
    langs = [None if i % 100 == 7 else "xy"[i % 2] for i in range(1000)]
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(20, 200))), lang) for i, lang in enumerate(langs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = {r["doc_id"]: r["rejected"] for r in langid.identify(docs, langid.held_out()).collect()}
    assert {i for i, rejected in found.items() if rejected} == {i for i, lang in enumerate(langs) if lang is None}


def test_label_model_recovers_voters():
    rng = np.random.default_rng(2)
    y = rng.random(20000) < 0.1
    votes = np.stack([np.where(y, rng.random(20000) < a, rng.random(20000) < b) for a, b in [(0.8, 0.01), (0.6, 0.02), (0.7, 0.05)]], axis=1)
    votes = np.concatenate([votes, votes[:, :1]], axis=1)  # the last repeats the first
    told = rng.random(20000) < 0.3  # the label abstains on the others
    label = (told.astype(int) << toxicity.LABELLED) | ((told & y).astype(int) << toxicity.LABEL_VOTER)
    masks, counts = np.unique((votes << np.arange(4)).sum(axis=1) | label, return_counts=True)
    posterior, model = toxicity.label_model(masks, counts.astype(float), 0.1)
    assert abs(model["rates"][1][0] - 0.8) < 0.1 and model["say"][0] < model["say"][1]
    assert posterior[masks == (1 << toxicity.LABEL_VOTER) | (1 << toxicity.LABELLED) | 7].min(initial=1) > 0.9
    # Without a label the voters still tell.
    assert posterior[masks == 15].min(initial=1) > 0.9 and posterior[masks == 0].max(initial=0) < 0.1


def test_water_filling(spark):
    sizes = {"a": 100, "b": 10, "c": 1000, "d": 50}
    rows = [(i, " ".join("x" * 1 for _ in range(10)), s) for s, n in sizes.items() for i in range(n // 10)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    weight = dict(zip("abcd", (5, 2, 1, 5)))
    left, free, target = 1.5 * 1160, set(sizes), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            target.update(share)
            break
        for s in over:
            target[s], left = 2 * sizes[s], left - 2 * sizes[s]
        free -= over
    size_of = {v: k for k, v in sizes.items()}
    assert {size_of[r["source_size"]]: pytest.approx(r["target"]) for r in mixed} == target
    for s, n in sizes.items():
        assert abs(sum(r["taken"] for r in mixed if r["source_size"] == n) - target[s]) <= 10


def test_measures_match_plain_counts():
    texts = ["a b c a b c\nx y\nx y\n\n x y", "é#€ ok|ok", "", "one two one two one two one", "p q r"]
    got = rules.measure([t.encode() for t in texts])
    for i, text in enumerate(texts):
        words = text.encode().split()
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        covered = {k + d for k, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
        lines = [line for line in text.split("\n") if line.strip(" \t\r\x0b\x0c")]
        assert (got["n_words"][i], got["n_repeat_words"][i], got["n_dup_lines"][i]) == (len(words), len(covered), len(lines) - len(set(lines)))
        assert got["word_chars"][i] == sum(len(w.decode()) for w in words) and got["n_symbols"][i] == sum(c in "#*$%&|<>" for c in text)


@pytest.mark.parametrize("name,column,least", [("op2_quality_classifier", "quality", 0.9), ("op3_language_id", "lang", 0.9)])
def test_held_out_accuracy(spark, name, column, least):
    known = spark.read.parquet(f"{FOLDER}/{'labels' if column == 'quality' else 'documents'}.parquet").select("doc_id", column)
    rows = QUERIES[name](spark, FOLDER).join(known, "doc_id").where(F.col("held_out") & F.col(column).isNotNull())
    guess = "predicted" if column == "quality" else "lang_pred"
    right = rows.agg(F.avg((F.col(guess) == F.col(column)).cast("int"))).first()[0]
    assert right >= least


@pytest.mark.parametrize("size,least", [("sf0.01", 0.5), ("sf0.1", 0.8)])
def test_toxicity_catches_toxic_documents_and_leaves_clean_ones_alone(spark, size, least):
    folder = f"/root/testdata/{size}"
    known = spark.read.parquet(f"{folder}/labels.parquet").where("toxic is not null")
    rows = QUERIES["op10_toxicity"](spark, folder).join(known, "doc_id").where("held_out").groupBy("toxic").agg(F.avg("predicted").alias("share"))
    share = {r["toxic"]: r["share"] for r in rows.collect()}
    assert share[1] >= least and share[0] <= 0.01


def toxic_features(text):
    """Features of a text by plain loops over its words."""
    words = {w for w in re.findall(rb"[a-z\x80-\xff]+", text.encode().lower()) if len(w) > 1}
    times = Counter(w[:k] for w in words for k in toxicity.BEGINNINGS if len(w) >= k)
    found = {(b, level) for b, n in times.items() for level in toxicity.LEVELS if n >= level}
    insults = {i.encode()[: max(k for k in toxicity.BEGINNINGS if k <= len(i))] for i in toxicity.INSULTS}
    hits = sum(n for b, n in times.items() if b in insults)
    return found | {("insults", i) for i in (0, 1) if hits > i}


def test_toxicity_features_match_plain_ones():
    texts = ["", "a b", "You idiot, you STUPID idiots! clown", "été étés étang é", "one once only onto on online", "x1y2 ab\ncd ab"]
    owners, features = toxicity.extract([t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert len(set(features[owners == i])) == (owners == i).sum() == len(toxic_features(text))
    assert toxicity.INSULTED[0] in features[owners == 2] and toxicity.INSULTED[1] in features[owners == 2]


def quality_words(text):
    return set(text.encode().lower().split())


def test_quality_counts_ratios_and_descent_match_plain_ones(spark):
    texts = ["good clean words here", "good words", "bad junk junk junk junk", "junk bad $$$", "clean good $$$", "bad"]
    labels = [1, 1, 0, 0, 1, 0]
    docs = spark.createDataFrame(list(zip(texts, labels)), "text string, label int").repartition(3)
    rows = {r["f"]: (r["ones"], r["zeros"]) for r in linear.feature_rows(docs, quality.extract, "text", "label").collect()}
    assert rows.pop(None) == (3, 3)
    owners, features = quality.extract([t.encode() for t in texts])
    want = defaultdict(lambda: [0, 0])
    for owner, f in zip(owners, features.view(np.int64).tolist()):
        want[f][0 if labels[owner] else 1] += 1
    assert rows == {f: tuple(n) for f, n in want.items()}
    # Each word is one feature of its own.
    everywhere = Counter(w for t in texts for w in quality_words(t))
    word_counts = Counter(sum(n) for n in want.values())
    assert all(word_counts[n] >= k for n, k in Counter(everywhere.values()).items())
    names = np.unique(features)
    n = np.array([want[int(f)] for f in names.view(np.int64)], float)
    ratios = quality.log_ratios(n[:, 0], n[:, 1], n[:, 0].sum(), n[:, 1].sum(), len(names))
    plain = [math.log(((a + 1) / sum(x + 1 for x in n[:, 0])) / ((b + 1) / sum(x + 1 for x in n[:, 1]))) for a, b in n]
    assert ratios == pytest.approx(plain)
    # The dual's optimum: a step along any coordinate lowers no more, and the weights are the sum of the support vectors.
    own = linear.places([features[owners == i] for i in range(len(texts))], names)
    y = np.where(np.array(labels) == 1, 1.0, -1.0)
    monkey = quality.EPOCHS
    quality.EPOCHS = 2000
    try:
        w, b = quality.descend(own, y, ratios)
    finally:
        quality.EPOCHS = monkey
    x = np.zeros((len(texts), len(names) + 1))
    for i, row in enumerate(own):
        x[i, row], x[i, -1] = ratios[row], 1.0
    kernel, alpha = (x @ x.T) * np.outer(y, y), np.zeros(len(y))
    for _ in range(20_000):
        alpha = np.clip(alpha - 0.5 / np.trace(kernel) * (kernel @ alpha - 1), 0, quality.COST)
    assert np.append(w, b) == pytest.approx(x.T @ (alpha * y), abs=2e-3)


def plain_kneser_ney(pairs):
    """Interpolated Kneser-Ney over characters by dictionaries: a function of language, context and symbol."""
    signs = lambda text: "   " + re.sub(r"[^a-z]+", " ", text.lower()) + ("" if re.search(r"[^a-z]$", text.lower()) else " ")
    counts = defaultdict(Counter)
    for text, lang in pairs:
        s = signs(text)
        counts[lang].update(s[i : i + 4] for i in range(len(s) - 3))
    symbols = len({g[3] for own in counts.values() for g in own}) + 1
    tables = {}
    for lang, own in counts.items():
        orders = {4: own}
        for k in (3, 2, 1):
            orders[k] = Counter(g[1:] for g in orders[k + 1])
        tables[lang] = orders

    def probability(lang, gram):
        table = tables[lang][len(gram)]
        n1, n2 = sum(n == 1 for n in table.values()), sum(n == 2 for n in table.values())
        d = max(0.05, min(0.95, n1 / (n1 + 2 * n2) if n1 + 2 * n2 else 0.5))
        after = [n for g, n in table.items() if g[:-1] == gram[:-1]]
        below = probability(lang, gram[1:]) if len(gram) > 1 else 1 / symbols
        if not after:
            return below
        if len(gram) == 1 and gram not in table:
            return langid.UNSEEN
        return max(table[gram] - d, 0) / sum(after) + d * len(after) / sum(after) * below

    return signs, probability


def test_kneser_ney_matches_a_plain_one(spark):
    pairs = [("abab abba baab aabb", "x"), ("abab ba", "x"), ("cab dab cad", "y"), ("bad cab abba", "y")]
    signs, probability = plain_kneser_ney(pairs)
    model = langid.train(spark.createDataFrame(pairs, "text string, lang string"))
    for text in ("abba cab", "dab", "bacad aab"):
        s = signs(text)
        bits, n = langid.entropies(model.files.reader(), [text.encode()], 2)
        for i, lang in enumerate(model.languages):
            want = [-math.log2(probability(lang, s[j : j + 4])) for j in range(len(s) - 3)]
            assert n[0] == len(want) and bits[0, i] == pytest.approx(sum(want) / len(want), rel=1e-4), (text, lang)


def test_token_files_match_the_library(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    library, start, want = Tokenizer.from_file(packing.tokenizer_file(VOCABULARY)), 0, []
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        own = [*library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        want.append((r["doc_id"], start, len(own), zlib.crc32(np.array(own, "<u4"))))
        start += len(own)
    assert sorted(tuple(r) for r in QUERIES["op7_token_files"](spark, FOLDER).collect()) == want
