"""Linear models over indicator features, which are 64-bit hashes: counting, gathering a bounded sample, scoring.

Counts are taken over all labelled rows. A model holds weights for features of the bounded sample it was fitted on, so what
is broadcast is bounded by that sample, and no two features share a weight.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import pieces, texts, with_keys

# From UTF-8 texts to the owner of each feature and the feature; each pair once, in order of owner.
Extract = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]
# Distinct features a task adds up before it hands them on.
HELD = 400_000


def unique_pairs(owners: np.ndarray, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, in order of owner, then feature."""
    order = np.lexsort((features, owners))
    owners, features = owners[order], features[order]
    first = np.ones(len(owners), bool)
    first[1:] = (owners[1:] != owners[:-1]) | (features[1:] != features[:-1])
    return owners[first], features[first]


def per_text(owners: np.ndarray, features: np.ndarray, n: int) -> list[np.ndarray]:
    """The features of each text; pairs must be ordered by owner."""
    bounds = np.searchsorted(owners, np.arange(n + 1))
    return [features[a:b] for a, b in zip(bounds[:-1], bounds[1:])]


def feature_rows(docs: DataFrame, extract: Extract, text: str, label: str) -> DataFrame:
    """``f, ones, zeros``: how many texts of label 1 and of label 0 have each feature, over all rows.

    The row with a null ``f`` counts the texts. Each task adds up before the shuffle and holds a bounded number of features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, total = [], np.zeros(2, np.int64)

        def merged() -> pd.DataFrame:
            return pd.concat(kept).groupby("f", as_index=False, sort=False).sum()

        def out(frame: pd.DataFrame) -> Iterator[pa.RecordBatch]:
            for start in range(0, len(frame), 100_000):
                part = frame.iloc[start : start + 100_000]
                columns = [pa.array(part["f"].to_numpy().view(np.int64)), pa.array(part["ones"].to_numpy()), pa.array(part["zeros"].to_numpy())]
                yield pa.RecordBatch.from_arrays(columns, names=["f", "ones", "zeros"])

        for batch in pieces(batches, text):
            labels = np.asarray(batch.column(batch.schema.get_field_index(label)).to_pylist(), np.int64)
            total += np.bincount(labels, minlength=2)
            owners, features = extract(texts(batch, text))
            codes, distinct = pd.factorize(features)
            n, ones = np.bincount(codes, minlength=len(distinct)), np.bincount(codes[labels[owners] == 1], minlength=len(distinct))
            kept.append(pd.DataFrame({"f": distinct, "ones": ones, "zeros": n - ones}))
            if sum(map(len, kept)) > 2 * HELD:
                kept[:] = [merged()]
                if len(kept[0]) > HELD:
                    yield from out(kept.pop())
        if kept:
            yield from out(merged())
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array(total[1:]), pa.array(total[:1])], names=["f", "ones", "zeros"])

    partial = docs.select(text, F.col(label).cast("int").alias(label)).mapInArrow(run, "f long, ones long, zeros long")
    return partial.groupBy("f").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))


def sample(docs: DataFrame, key: str, rows: int, total: int) -> DataFrame:
    """About ``rows`` rows of ``total``, chosen by a hash of the key."""
    share = min(1.0, rows / max(total, 1))
    drawn = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.lit(1_000_000))
    return docs.where(drawn < int(share * 1_000_000) + (share == 1.0))


def packed(docs: DataFrame, extract: Extract, text: str, *carried: str) -> DataFrame:
    """``features``, 64-bit little-endian numbers in one binary value, and the carried columns of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            own = per_text(*extract(texts(batch, text)), batch.num_rows)
            values = pa.array([part.astype("<u8").tobytes() for part in own], pa.binary())
            rest = [batch.column(batch.schema.get_field_index(name)) for name in carried]
            yield pa.RecordBatch.from_arrays([values, *rest], names=["features", *carried])

    types = dict(docs.dtypes)
    schema = ", ".join(["features binary", *(f"`{name}` {types[name]}" for name in carried)])
    return docs.select(text, *carried).mapInArrow(run, schema)


def as_places(rows: DataFrame, names: np.ndarray) -> DataFrame:
    """``packed`` rows with the places of their features among ``names``, 32-bit numbers, instead of the features."""
    shared = rows.sparkSession.sparkContext.broadcast(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = places([np.frombuffer(value, "<u8") for value in batch.column(0).to_pylist()], shared.value)
            values = pa.array([part.astype("<i4").tobytes() for part in own], pa.binary())
            yield pa.RecordBatch.from_arrays([values, *batch.columns[1:]], names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def gather(rows: DataFrame, *carried: str, kind: str = "<u8") -> tuple[list, list]:
    """Features and the carried columns of the ``packed`` rows of a bounded sample, in an order of their own.

    The features are views of what has arrived, which is not copied.
    """
    table = rows.toArrow()
    views = [value.as_buffer() for value in table.column("features")]
    others = list(zip(*[table.column(name).to_pylist() for name in carried]))
    # The same rows give the same model, whatever order they arrive in.
    order = sorted(range(len(views)), key=lambda i: (hashlib.md5(views[i]).digest(), others[i]))
    features = [np.frombuffer(views[i], kind) if views[i].size else np.zeros(0, kind) for i in order]
    return features, [others[i] for i in order]


def used_features(rows: DataFrame) -> DataFrame:
    """The distinct features ``f`` of ``packed`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.unique(np.frombuffer(b"".join(batch.column(0).to_pylist()), "<i8"))
            for start in range(0, len(found), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(found[start : start + 100_000])], names=["f"])

    return rows.select("features").mapInArrow(run, "f long").distinct()


def places(rows: list[np.ndarray], names: np.ndarray) -> list[np.ndarray]:
    """For each row the places of its features among ``names``, which are in order; others are left out."""
    if not len(names):
        return [np.zeros(0, np.int64) for _ in rows]
    found = []
    for row in rows:
        at = np.minimum(np.searchsorted(names, row), len(names) - 1)
        found.append(at[names[at] == row])
    return found


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def platt(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a sigmoid through margins, by Newton steps on smoothed labels; a label may lie between 0 and 1."""
    ones = max(float(labels.sum()), 0.0)
    zeros = len(labels) - ones
    goal = labels * (ones + 1) / (ones + 2) + (1 - labels) / (zeros + 2)
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * margins + b)
        g, h = p - goal, p * (1 - p) + 1e-9
        gradient = np.array([(g * margins).sum() + 1e-3 * (a - 1), g.sum()])
        hessian = np.array([[(h * margins**2).sum() + 1e-3, (h * margins).sum()], [(h * margins).sum(), h.sum()]])
        step = np.linalg.solve(hessian + 1e-9 * np.eye(2), gradient)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        a, b = max(a - step[0], 1e-3), b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(a), float(b)


def apply(docs: DataFrame, extract: Extract, names: np.ndarray, weights: np.ndarray, bias: float, text: str, key: str) -> DataFrame:
    """The key and ``score``, the sigmoid of the summed weights of the features ``names`` (in order), of each text."""
    some = weights != 0
    shared = docs.sparkSession.sparkContext.broadcast((names[some].astype(np.uint64), weights[some].astype(np.float32), float(bias)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, w, b = shared.value
        for batch in pieces(batches, text):
            sums = np.full(batch.num_rows, b)
            if len(known):
                owners, features = extract(texts(batch, text))
                at = np.minimum(np.searchsorted(known, features), len(known) - 1)
                hit = known[at] == features
                sums += np.bincount(owners[hit], weights=w[at[hit]], minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index(key)), pa.array(sigmoid(sums))], names=[key, "score"]
            )

    kind = dict(docs.dtypes)[key]
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")


def labelled(docs: DataFrame, labels: DataFrame, column: str, held_out: Column, text: str, key: str) -> DataFrame:
    """Texts to learn from: ``key, text, label`` with a label of 0 or 1, held-out rows left out.

    A key with several label rows has the largest of them. Most texts without a label are dropped before a join deals
    texts out.
    """
    known = labels.where(F.col(column).isin(0, 1)).groupBy(F.col(key).alias("_key")).agg(F.max(column).cast("int").alias("_label"))
    rows = docs.where(~held_out).select(F.col(key).alias("_of"), F.col(text).alias("_text"))
    near = with_keys(rows, "_of", known.select("_key"))
    # Sorted on both sides whatever the size, so that disk and time grow in proportion.
    joined = near.join(known.hint("merge"), F.col("_of") == F.col("_key"))
    return joined.select(F.col("_of").alias("key"), F.col("_text").alias("text"), F.col("_label").alias("label"))
