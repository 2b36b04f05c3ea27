"""Quality classifier: naive Bayes support vectors.

Features are indicators: words, and n-grams of one to three word shapes together with how large a share of the text's
n-grams they make up. A shape tells which kinds of signs a word has and whether its three-word window comes again in
the text. Indicators are scaled by the log ratio of the classes' smoothed counts, which are taken over all labelled rows;
a linear model with hinge loss is fitted to the scaled indicators of a bounded sample by dual coordinate descent; a sigmoid
fitted to rows that the descent did not see turns margins into scores.

Defined results: null and empty texts have no features and get the score of the bias; without labelled rows of both
classes every score is 0.5; equal rows count each; texts of any length are read whole; other columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import fold, stage
from driftlens.llm.linear import apply, as_places, feature_rows, gather, labelled, packed, platt, sample, unique_pairs, used_features
from driftlens.llm.wordhash import mix, word_hashes

# Labelled rows the descent may see, and the share of them kept for the sigmoid.
SAMPLE_ROWS = 12_000
FOR_SIGMOID = 4
COST, EPOCHS, SMOOTHING = 0.1, 12, 1.0

_flag = lambda signs: np.isin(np.arange(256), np.frombuffer(signs, np.uint8))
_LOWER, _UPPER = _flag(bytes(range(97, 123))) | (np.arange(256) >= 0x80), _flag(bytes(range(65, 91)))
_DIGIT, _SYMBOL, _EXCLAIM = _flag(b"0123456789"), _flag(b"#*$%&|<>@=_~^\\{}[]+/"), _flag(b"!?")
_OTHER = ~(_LOWER | _UPPER | _DIGIT | _SYMBOL | _EXCLAIM | _flag(b" \t\n\x0b\x0c\r"))
_KINDS = sum((flags.astype(np.uint8) << i) for i, flags in enumerate((_LOWER, _UPPER, _DIGIT, _SYMBOL, _EXCLAIM, _OTHER)))


def extract(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Owner and number of each feature, in order of owner."""
    joined = b"\n".join(raws) + b"\n"
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(np.array([len(raw) + 1 for raw in raws], np.int64))
    starts, lengths, _ = word_hashes(data)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none
    _, _, words = word_hashes(np.frombuffer(joined.lower(), np.uint8))
    n_words = np.diff(np.searchsorted(starts, ends), prepend=0)
    owner = np.repeat(np.arange(len(raws)), n_words)

    # Shapes: the kinds of signs in a word, and whether its window of three words comes again.
    kinds = _KINDS[data]
    kinds = np.bitwise_or.reduceat(kinds, np.stack([starts, np.minimum(starts + lengths, len(data) - 1)], axis=1).ravel())[::2].astype(np.uint64)
    again = np.zeros(len(words), np.uint64)
    if len(words) >= 3:
        inside = np.flatnonzero(owner[2:] == owner[:-2])
        window = words[inside] + words[inside + 1] * np.uint64(0x9E3779B97F4A7C15) + words[inside + 2] * np.uint64(0xC2B2AE3D27D4EB4F)
        codes, _ = pd.factorize(mix(mix(window) + owner[inside].astype(np.uint64) * np.uint64(0x165667B19E3779F9)))
        twice = inside[np.bincount(codes)[codes] > 1] if len(codes) else none
        for shift in range(3):
            again[twice + shift] = 1
    shape = kinds | (again << np.uint64(6))

    owners, features = [owner], [words]
    gram = np.zeros(len(shape), np.uint64)
    for n in (1, 2, 3):
        if len(shape) < n:
            break
        gram = (gram[: len(shape) - n + 1] << np.uint64(7)) | shape[n - 1 :]
        whole = owner[n - 1 :] == owner[: len(owner) - n + 1]
        of, own = owner[: len(whole)][whole], gram[whole]
        codes, distinct = pd.factorize((of.astype(np.uint64) << np.uint64(24)) | own)
        counts = np.bincount(codes)
        of = (distinct >> np.uint64(24)).astype(np.int64)
        level = np.floor(np.log2(n_words[of] / counts)).astype(np.uint64)
        owners.append(of)
        features.append(mix(((distinct & np.uint64((1 << 24) - 1)) << np.uint64(8)) + (level << np.uint64(2)) + np.uint64(n)))
    # Words and shapes are told apart by a constant.
    features[0] = mix(features[0] + np.uint64(0x51ED270B))
    return unique_pairs(np.concatenate(owners), np.concatenate(features))


def log_ratios(ones: np.ndarray, zeros: np.ndarray, all_ones: float, all_zeros: float, kinds: int) -> np.ndarray:
    """Class log-count ratio of features, from the smoothed counts of all ``kinds`` features."""
    p, q = (ones + SMOOTHING) / (all_ones + SMOOTHING * kinds), (zeros + SMOOTHING) / (all_zeros + SMOOTHING * kinds)
    return np.log(p / q)


def descend(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray) -> tuple[np.ndarray, float]:
    """Hinge-loss weights by dual coordinate descent; classes weigh the same in total. The bias is a constant feature."""
    w, b = np.zeros(len(ratios)), 0.0
    alpha = np.zeros(len(rows))
    n_ones = max((y > 0).sum(), 1)
    bound = np.where(y > 0, len(y) / (2 * n_ones), len(y) / (2 * max(len(y) - n_ones, 1))) * COST
    ends = np.cumsum([len(row) for row in rows])
    values = np.split(ratios[np.concatenate(rows)], ends[:-1])
    norms = np.array([(v * v).sum() + 1.0 for v in values])
    rng = np.random.default_rng(7)
    for _ in range(EPOCHS):
        largest = 0.0
        for i in rng.permutation(len(rows)):
            row, v = rows[i], values[i]
            gradient = y[i] * (w[row] @ v + b) - 1
            step = min(max(alpha[i] - gradient / norms[i], 0.0), bound[i]) - alpha[i]
            if step:
                alpha[i] += step
                w[row] += step * y[i] * v
                b += step * y[i]
                largest = max(largest, abs(step))
        if largest < 1e-4:
            break
    return w, b


def train(docs: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", label: str = "quality"):
    """Features in order, their weights and the bias, or None without labelled rows of both classes."""
    rows = stage(labelled(docs, labels, label, held_out, text, key), "labelled")
    counts = stage(feature_rows(rows, extract, "text", "label"), "counts")
    texts_of = counts.where("f is null").first()
    if texts_of is None or not texts_of["ones"] or not texts_of["zeros"]:
        return None
    chosen = stage(packed(sample(rows, "key", SAMPLE_ROWS, texts_of["ones"] + texts_of["zeros"]), extract, "text", "label"), "sample")
    sums = counts.where("f is not null").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.count("*").alias("kinds")).first()
    if not sums["kinds"]:
        return None
    table = counts.join(used_features(chosen), "f").toArrow().to_pandas()
    names = table["f"].to_numpy().view(np.uint64)
    order = np.argsort(names)
    names, table = names[order], table.iloc[order]
    # The driver gets the features' 32-bit places instead of the features.
    found, carried = gather(as_places(chosen.select("features", "label"), names), "label", kind="<i4")
    y = np.array([c[0] for c in carried], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    ratios = log_ratios(table["ones"].to_numpy(), table["zeros"].to_numpy(), sums["ones"], sums["zeros"], sums["kinds"])
    last = np.arange(len(y)) % FOR_SIGMOID == 0
    if len(set(y[last].tolist())) < 2 or len(set(y[~last].tolist())) < 2:
        last = np.zeros(len(y), bool)
    fit = np.flatnonzero(~last)
    w, b = descend([found[i] for i in fit], np.where(y[fit] == 1, 1.0, -1.0), ratios)
    judged = np.flatnonzero(last) if last.any() else fit
    margins = np.array([w[found[i]] @ ratios[found[i]] + b for i in judged])
    slope, shift = platt(margins, y[judged])
    return names, w * ratios * slope, b * slope + shift


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, text: str = "text", key: str = "doc_id", label: str = "quality") -> DataFrame:
    """The key and ``held_out, score, predicted`` of each text."""
    model = train(docs, labels, held_out, text, key, label)
    names, weights, bias = model if model else (np.zeros(0, np.uint64), np.zeros(0), 0.0)
    # Later steps of the session need the driver's memory: Arrow would keep what the sample took.
    pa.default_memory_pool().release_unused()
    scored = apply(docs, extract, names, weights, bias, text, key)
    return scored.select(key, held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def held_out(key: str = "doc_id") -> Column:
    return fold(F.col(key), 3) == 1
