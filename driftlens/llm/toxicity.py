"""Toxicity by weak supervision.

Voters look at a text without deciding alone: a fixed lexicon, lexicons of word beginnings mined from labelled rows, patterns
over their hits, and the given label, one more voter that may err and abstains where a text has none. All voters look at all
texts that are not held out. Each text's votes are one bit mask. A generative model with the hidden label explains how often
each mask occurs: expectation maximisation estimates every voter's rate of votes on toxic and on clean texts, and what is
left of the correlation between voters inside a class reduces the say of voters that repeat each other. A linear classifier
over word beginnings is trained on the posterior labels of a bounded sample of texts, labelled or not, a sigmoid makes its
margins on texts it has not seen into scores, and only the classifier scores texts.

Features are 64-bit hashes of beginnings of two to eight bytes, with whether one, two or four different words of the text have
it. The lexicons hold every feature two in three of whose texts are toxic, by more than chance allows for as many features as there
are; they lie in sorted files and grow with the labelled rows.

Defined results: null and empty texts have no features and get the score of the bias; without labelled rows of both
classes every score is 0; equal rows count each; a key with several label rows has the largest of them; texts of any length are
read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm import hashfiles
from driftlens.llm.common import fold, pieces, stage, texts
from driftlens.llm.linear import apply, as_places, feature_rows, gather, labelled, packed, platt, sample, sigmoid, used_features
from driftlens.llm.wordhash import mix, stretch_hashes

# Common English insults.
INSULTS = "clown disgusting dumb fool garbage idiot imbecile jerk loser moron pathetic scum stupid trash worthless".split()

BEGINNINGS = (2, 3, 4, 5, 6, 8)
LEVELS = (1, 2, 4)
LEXICON_VOTERS = 12
# Texts the classifier may see, and into how many parts they are split for the sigmoid.
SAMPLE_ROWS, FOLDS = 12_000, 4
PENALTY = 1e-3
THRESHOLD = 0.7
# Toxic texts for each clean one that a word of the lexicon must have, one standard deviation less than counted.
MOSTLY = 2
# Two bits for the label: given, and what it says.
VOTERS = LEXICON_VOTERS + 5
LABEL_VOTER = VOTERS - 1
LABELLED = VOTERS

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[0x80:] = True
_FACTORS = np.random.default_rng(0xBEE).integers(1, 1 << 63, max(BEGINNINGS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
# Features that do not come from one word beginning: one insult, two insults.
INSULTED = mix(np.array([0x1175, 0x2175], np.uint64))


def _numbers(sums: np.ndarray, size: int) -> np.ndarray:
    return mix(sums + np.uint64(size))


def insult_hashes() -> np.ndarray:
    """The hash of the longest beginning of each insult, as ``beginnings`` makes it."""
    found = []
    for word in INSULTS:
        size = max(k for k in BEGINNINGS if k <= len(word))
        signs = np.frombuffer(word.encode()[:size], np.uint8).astype(np.uint64)
        found.append(_numbers(((signs + np.uint64(1)) * _FACTORS[:size]).sum(dtype=np.uint64, keepdims=True), size)[0])
    return np.sort(np.array(found, np.uint64))


_INSULTS = insult_hashes()


def beginnings(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and hash of the beginnings of all different words of each text; a word of one byte has none."""
    data = np.frombuffer(b"\n".join(raws).lower() + b"\n", np.uint8)
    ends = np.cumsum(np.array([len(raw) + 1 for raw in raws], np.int64))
    letter = _LETTER[data]
    starts = np.concatenate([[0], np.flatnonzero(letter[1:] != letter[:-1]) + 1])
    lengths = np.diff(np.append(starts, len(data)))
    hashes = stretch_hashes(data, starts, lengths)
    runs = letter[starts] & (lengths > 1)
    starts, lengths, hashes = starts[runs], lengths[runs], hashes[runs]
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = np.searchsorted(ends, starts, side="right")
    codes, distinct = pd.factorize(mix(hashes + owner.astype(np.uint64) * np.uint64(0x165667B19E3779F9)))
    first = np.zeros(len(distinct), np.int64)
    first[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
    starts, lengths, owner = starts[first], lengths[first], owner[first]
    owners, found = [], []
    sums = np.zeros(len(starts), np.uint64)
    for j in range(max(BEGINNINGS)):
        there = lengths > j
        sums[there] += (data[starts[there] + j].astype(np.uint64) + np.uint64(1)) * _FACTORS[j]
        if j + 1 in BEGINNINGS:
            owners.append(owner[there])
            found.append(_numbers(sums[there], j + 1))
    return np.concatenate(owners), np.concatenate(found)


def extract(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number of each feature, in order of owner, each pair once."""
    owners, hashes = beginnings(raws)
    insulted = np.bincount(owners[np.isin(hashes, _INSULTS)], minlength=len(raws))
    order = np.lexsort((hashes, owners))
    owners, hashes = owners[order], hashes[order]
    first = np.ones(len(owners), bool)
    first[1:] = (owners[1:] != owners[:-1]) | (hashes[1:] != hashes[:-1])
    begin = np.flatnonzero(first)
    times = np.diff(np.append(begin, len(owners)))
    owners, hashes = owners[begin], hashes[begin]
    parts = [(owners[times >= level], mix(hashes[times >= level] + np.uint64(level << 32))) for level in LEVELS]
    parts += [(np.flatnonzero(insulted > i), np.full((insulted > i).sum(), INSULTED[i])) for i in (0, 1)]
    owners, features = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.argsort(owners, kind="stable")
    return owners[order], features[order]


def vote(reader: hashfiles.Reader, raws: list[bytes]) -> np.ndarray:
    """The mask of the lexicon and pattern voters of each text."""
    owners, features = extract(raws)
    n = len(raws)
    masks, hits = np.zeros(n, np.int64), np.zeros(n, np.int64)
    wanted, codes = np.unique(features.view(np.int64), return_inverse=True)
    counts, (voter,) = reader.find(wanted)
    of = np.full(len(wanted), -1, np.int64)
    of[counts > 0] = voter
    hit = of[codes] >= 0
    np.bitwise_or.at(masks, owners[hit], np.int64(1) << of[codes][hit])
    hits = np.bincount(owners[hit], minlength=n)
    insulted = [np.bincount(owners[features == INSULTED[i]], minlength=n) > 0 for i in (0, 1)]
    every = np.maximum(np.bincount(owners, minlength=n), 1)
    for i, votes in enumerate((*insulted, hits > 3, 50 * hits > every)):
        masks |= votes.astype(np.int64) << (LEXICON_VOTERS + i)
    return masks


def scored_features(counts: DataFrame, ones: int, zeros: int) -> DataFrame:
    """``f, ones, zeros, z``: z-score of the log odds ratio of each feature with texts of either class."""
    a, b = F.col("ones") + 0.5, F.col("zeros") + 0.5
    c, d = ones + 1 - a, zeros + 1 - b
    return counts.where("f is not null").withColumn("z", (F.log(a / c) - F.log(b / d)) / F.sqrt(1 / a + 1 / b + 1 / c + 1 / d))


def chance(kinds: int) -> float:
    """The z-score that about none of so many features reaches by chance."""
    return float(np.sqrt(2 * np.log(max(kinds, 2))))


def label_model(masks: np.ndarray, counts: np.ndarray, prior: float) -> tuple[np.ndarray, dict]:
    """The posterior of each mask, and the model: rates of votes by class and the say of each voter.

    The label's bit counts only where the mask says that a label is given.
    """
    votes = ((masks[:, None] >> np.arange(VOTERS)) & 1).astype(float)
    given = np.ones_like(votes)
    given[:, LABEL_VOTER] = (masks >> LABELLED) & 1
    share = np.array([1 - prior, prior])
    heard = (counts[:, None] * given).sum(axis=0)
    base = (counts[:, None] * votes * given).sum(axis=0) / np.maximum(heard, 1)
    rates = np.stack([np.clip(base * 0.3, 1e-4, 0.4), np.clip(base / max(prior, 1e-3) * 0.7, 0.3, 0.9)])
    say = np.ones(VOTERS)
    posterior = np.full(len(masks), prior)
    for _ in range(4):
        for _ in range(100):
            logs = np.log(share) + np.stack([(say * given * (votes * np.log(r) + (1 - votes) * np.log(1 - r))).sum(axis=1) for r in rates], axis=1)
            new = sigmoid(logs[:, 1] - logs[:, 0])
            weight = np.stack([counts * (1 - new), counts * new])
            rates = np.clip((weight @ (votes * given) + [[0.01], [0.5]]) / (weight @ given + 1), 1e-5, 1 - 1e-5)
            share = np.clip(weight.sum(axis=1) / counts.sum(), 1e-4, 1)
            moved, posterior = np.abs(new - posterior).max(), new
            if moved < 1e-6:
                break
        # Correlation inside the classes, over the texts both voters speak of: voters that repeat others have less say.
        linked = np.zeros((VOTERS, VOTERS))
        for weights, r in zip(weight, rates):
            rest = (votes - r) * given
            both = np.maximum((given * weights[:, None]).T @ given, 1e-9)
            covariance = (rest * weights[:, None]).T @ rest / both
            spread = np.sqrt(np.maximum(np.diag(covariance), 1e-9))
            linked += np.clip(covariance / np.outer(spread, spread), 0, 1) / 2
        np.fill_diagonal(linked, 0)
        # The label does not come from the text's words: it repeats no other voter.
        linked[LABEL_VOTER], linked[:, LABEL_VOTER] = 0, 0
        say = 1 / (1 + linked.sum(axis=1))
    return posterior, {"rates": rates, "say": say, "share": share}


def fit(rows: list[np.ndarray], goal: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """Logistic weights of ``n`` features on soft labels, L2-penalised, by accelerated gradient steps."""
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x) for x in rows])
    column = np.concatenate(rows) if rows else np.zeros(0, np.int32)
    # Both classes weigh the same in the fit.
    weight = goal / max(goal.sum(), 1e-9) + (1 - goal) / max((1 - goal).sum(), 1e-9)
    target = (goal / max(goal.sum(), 1e-9)) / np.maximum(weight, 1e-12)
    # Frequent features must not slow the others down: each is scaled by how often it occurs.
    scale = 1 / np.sqrt(np.maximum(np.bincount(column, weights=weight[of], minlength=n), 1e-3))
    values = scale[column].astype(np.float32)
    w, b = np.zeros(n), 0.0
    memory, bias_memory, t = w.copy(), b, 1.0
    # The step is as long as the curvature allows: the largest eigenvalue of the weighted squares, by power iteration.
    direction, largest = np.ones(n), 1.0
    for _ in range(20):
        direction = np.bincount(column, weights=(weight * np.bincount(of, weights=direction[column] * values, minlength=len(rows)))[of] * values, minlength=n)
        largest = max(float(np.linalg.norm(direction)), 1e-9)
        direction = direction / largest
    rate = 4.0 / (1.1 * largest + weight.sum())
    for _ in range(300):
        miss = weight * (sigmoid(np.bincount(of, weights=memory[column] * values, minlength=len(rows)) + bias_memory) - target)
        new = memory - rate * (np.bincount(column, weights=miss[of] * values, minlength=n) + PENALTY * memory)
        new_b = bias_memory - rate * miss.sum()
        later = (1 + np.sqrt(1 + 4 * t * t)) / 2
        memory, bias_memory = new + (t - 1) / later * (new - w), new_b + (t - 1) / later * (new_b - b)
        w, b, t = new, new_b, later
    return w * scale, float(b)


def margins(rows: list[np.ndarray], w: np.ndarray, b: float) -> np.ndarray:
    return np.array([w[row].sum() + b for row in rows])


def train(docs: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", label: str = "toxic"):
    """Features in order, their weights and the bias, or None without labelled rows of both classes."""
    rows = labelled(docs, labels, label, held_out, text, key)
    counts = stage(feature_rows(rows, extract, "text", "label"), "counts")
    sizes = counts.where("f is null").first()
    if sizes is None or not sizes["ones"] or not sizes["zeros"]:
        return None
    ranked = stage(scored_features(counts, sizes["ones"], sizes["zeros"]), "features")
    limit = chance(ranked.count())
    dealt = F.pmod(F.xxhash64("f"), F.lit(LEXICON_VOTERS)).cast("int").alias("voter")
    mostly = F.col("ones") - F.sqrt("ones") > MOSTLY * F.col("zeros")
    files = hashfiles.write(ranked.where((F.col("z") > limit) & mostly).select("f", dealt), "lexicon")

    # All texts that are not held out are voted on; only keys and masks meet the labels.
    seen = docs.where(~held_out).select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = dict(seen.dtypes)["key"]

    def masks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = files.reader()
        for batch in pieces(batches, "text"):
            own = pa.array(vote(reader, texts(batch, "text")))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("key")), own], names=["key", "mask"])

    voted = seen.mapInArrow(masks, f"key {kind}, mask long")
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(key).alias("key")).agg(F.max(label).cast("long").alias("_label"))
    full = F.coalesce(F.col("mask") + F.shiftleft(F.lit(2).cast("long") + F.col("_label"), LABEL_VOTER), F.col("mask"))
    voted = stage(voted.join(known, "key", "left").select("key", full.alias("mask")), "votes")
    # At most 2 ** (VOTERS + 1) masks, whatever the number of texts.
    table = voted.groupBy("mask").agg(F.count("*").alias("n")).toArrow().to_pandas().sort_values("mask")
    posterior, _ = label_model(table["mask"].to_numpy(), table["n"].to_numpy(float), sizes["ones"] / (sizes["ones"] + sizes["zeros"]))

    total = int(table["n"].sum())
    chosen = stage(packed(sample(seen, "key", SAMPLE_ROWS, total), extract, "text", "key"), "sample")
    by_key = sample(voted, "key", SAMPLE_ROWS, total).groupBy("key").agg(F.max("mask").alias("mask"))
    names = _worth(ranked, chosen)
    found, carried = gather(as_places(chosen.join(by_key, "key").select("features", "mask"), names), "mask", kind="<i4")
    if not found:
        return None
    own_masks = np.array([mask for (mask,) in carried])
    goal = posterior[np.searchsorted(table["mask"].to_numpy(), own_masks)]

    # Margins of each part come from a fit on the others; the sigmoid goes through those of labelled texts.
    part, unseen = np.arange(len(found)) % FOLDS, np.zeros(len(found))
    for k in range(FOLDS):
        inside, outside = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(inside) and len(outside):
            w, b = fit([found[i] for i in inside], goal[inside], len(names))
            unseen[outside] = margins([found[i] for i in outside], w, b)
    w, b = fit(found, goal, len(names))
    told = (own_masks >> LABELLED) & 1 == 1
    truth = np.where(told, (own_masks >> LABEL_VOTER) & 1, goal)
    slope, shift = platt(unseen, truth)
    return names, w * slope, b * slope + shift


def _worth(ranked: DataFrame, chosen: DataFrame) -> np.ndarray:
    """Features of the sample with odds of their own, in order, and the insults."""
    # Three standard deviations: weaker ones are noise, which the penalty would have to hold down.
    rows = ranked.where("abs(z) > 3 and ones + zeros >= 3").join(used_features(chosen), "f").select("f").toArrow()
    return np.unique(np.concatenate([rows.column("f").to_numpy().view(np.uint64), INSULTED]))


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", label: str = "toxic") -> DataFrame:
    """The key and ``held_out, score, predicted`` of each text."""
    model = train(docs, labels, held_out, text, key, label)
    names, weights, bias = model if model else (np.zeros(0, np.uint64), np.zeros(0), -35.0)
    scored = apply(docs, extract, names, weights, bias, text, key)
    return scored.select(key, held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def held_out(key: str = "doc_id") -> Column:
    return fold(F.col(key), 3) == 1
