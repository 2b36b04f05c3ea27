"""Hard negatives by coordinate pruning of inner products.

Searches ask, for anchor vectors, for the rows with the largest inner products of the same label (positives), then for
those of other labels whose product lies in a range that follows from a positive (negatives).

Rows are dealt into buckets of similar length, long buckets into parts of bounded size, and a part keeps its unit vectors with
one sorted list of values per coordinate. An anchor asks a part for products of at least some bound: divided by both
lengths, that is a least cosine. From it follows for each coordinate which values a row may have, as the other coordinates
can add no more than the product of what is left of both lengths (Cauchy-Schwarz). The coordinates where the anchor is
largest are its focus; binary search in their lists gives the feasible stretches, whose intersection are the candidates, and
only candidates are verified, exactly. A part whose longest row cannot reach the bound is passed over.

Bounds start from a sample of rows that all tasks hold: an anchor's k-th best product there is at most its k-th best of
all, so no result is lost. Anchors stream past the parts in batches; a part returns its k best rows of each anchor, and the
best of all parts are chosen afterwards.

Defined results: rows with a null label, a null or empty vector, or a null or non-finite component take no part; vectors of
another length than an anchor's are no partner of it; ties go to the smaller id; rows with equal id are rows of their own, and an
anchor's other rows are those with another id; a row with a null id takes no part; products are exact as long as they
stay below 2^53, beyond that they are rounded; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.llm.common import stage

# Rows of one part, coordinates of the focus, rows of the sample for first bounds.
PART, FOCUS, SAMPLE = 4096, 3, 4096
# Anchors verified at once.
BATCH = 256
# Buckets per doubling of the length.
FINE = 4
SLACK = 1e-9
POSITIVES, NEGATIVES = 5, 10
# Percent of the positive's product that a negative's must have at least and at most.
LEAST, MOST = 30, 90


def prepared(vectors: DataFrame, vector: Column, key: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``id, label, vec`` of the rows that take part; ``vector`` is what their components become."""
    fine = (
        F.col(key).isNotNull() & F.col(label).isNotNull() & F.col(embedding).isNotNull() & (F.size(embedding) > 0)
        & F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    )
    return vectors.where(fine).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), vector.alias("vec"))


def parts(rows: DataFrame) -> DataFrame:
    """Adds ``dim, bucket, part``: the bucket of similar length, and the part of the bucket."""
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    placed = rows.withColumn("dim", F.size("vec")).withColumn(
        "bucket", F.when(length > 0, F.floor(F.log2(length) * FINE).cast("int")).otherwise(F.lit(-1 << 20))
    )
    # One row per bucket: a few for each doubling of the length.
    sizes = placed.groupBy("dim", "bucket").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    return placed.join(sizes, ["dim", "bucket"]).withColumn("part", F.pmod(F.xxhash64("id", "vec"), "parts").cast("int")).drop("parts")


class Part:
    """Rows of one length bucket with their sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.x = ids[order], labels[order], x[order]
        self.length = np.sqrt((self.x * self.x).sum(axis=1))
        self.longest = float(self.length.max(initial=0))
        unit = self.x / np.where(self.length > 0, self.length, 1)[:, None]
        self.order = np.argsort(unit, axis=0)
        self.sorted = np.take_along_axis(unit, self.order, axis=0)

    def candidates(self, q: np.ndarray, bound: float) -> np.ndarray:
        """Places of all rows whose product with ``q`` may reach ``bound``."""
        size = float(np.sqrt(q @ q))
        if bound > size * self.longest * (1 + SLACK):
            return np.zeros(0, np.int64)
        # The least cosine any row of the part needs; below it nothing can be ruled out for a bound up to 0.
        if bound <= 0 or not size * self.longest:
            return np.arange(len(self.ids))
        cosine = min(bound / (size * self.longest), 1.0)
        focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        met = None
        for f in focus:
            own = q[f] / size
            # own * v + sqrt(1 - own^2) sqrt(1 - v^2) >= cosine holds for v within an angle of acos(cosine) about own.
            angle, reach = np.arccos(np.clip(own, -1, 1)), np.arccos(cosine)
            low = np.cos(min(angle + reach, np.pi)) - SLACK
            high = np.cos(max(angle - reach, 0.0)) + SLACK
            column = self.sorted[:, f]
            a, b = np.searchsorted(column, low, "left"), np.searchsorted(column, high, "right")
            if met is None:
                met = np.zeros(len(self.ids), np.int8)
            met[self.order[a:b, f]] += 1
        return np.flatnonzero(met == len(focus))


def best(part: Part, q: np.ndarray, label: int, own: int, same: bool, k: int, least: float, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and products of the ``k`` best rows of the part, or fewer, with a product from ``least`` to ``most``.

    ``same`` asks for other rows of the label, else for rows of other labels.
    """
    at = part.candidates(q, least)
    at = at[(part.labels[at] == label) & (part.ids[at] != own)] if same else at[part.labels[at] != label]
    score = part.x[at] @ q
    fit = (score >= least) & (score <= most)
    at, score = at[fit], score[fit]
    if len(at) > 4 * k:
        # All that are as good as the k-th go on, so that ties are decided by id.
        kth = np.partition(score, len(score) - k)[len(score) - k]
        at, score = at[score >= kth], score[score >= kth]
    order = np.lexsort((part.ids[at], -score))[:k]
    return part.ids[at][order], score[order]


def search(rows: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """``asked``'s columns with ``id, score`` for the k best rows of each part, a row of ``asked`` each.

    ``asked`` holds ``anchor, label, vec, rank, least, most`` for each question; ``rows`` are ``parts``. Every part meets all
    questions once, in batches.
    """
    keys = ["dim", "bucket", "part"]
    slots = rows.select(*keys).distinct()
    questions = asked.withColumn("dim", F.size("vec"))
    fields = [*keys, "role", "id", "label", "vec", "rank", "least", "most"]
    # Each part is asked all questions of its dimension: a stated set of questions against all rows, in blocks.
    met = questions.join(slots, "dim").select(*keys, F.lit(1).alias("role"), F.col("anchor").alias("id"), "label", "vec", "rank", "least", "most")
    none = [F.lit(0).cast("int").alias("rank"), F.lit(0.0).alias("least"), F.lit(0.0).alias("most")]
    held = rows.select(*keys, F.lit(0).alias("role"), "id", "label", "vec", *none)
    dealt = held.select(*fields).unionByName(met.select(*fields)).repartition(*keys).sortWithinPartitions(*keys, "role", "id", "rank")
    schema = "anchor long, rank int, id long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, waiting, part = None, [], None
        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                columns = {field: batch.column(i).to_numpy(zero_copy_only=False) for i, field in enumerate(fields) if field != "vec"}
                marks = np.stack([columns[field] for field in (*keys, "role")], axis=1)
                cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
                vectors = batch.column(fields.index("vec"))
                for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                    x = vectors.slice(a, b - a).flatten().to_numpy().reshape(b - a, -1)
                    now = tuple(marks[a, :3].tolist())
                    if now != name:
                        name, waiting, part = now, [], None
                    if marks[a, 3] == 0:
                        waiting.append((columns["id"][a:b], columns["label"][a:b], x))
                        continue
                    if part is None:
                        part = Part(*(np.concatenate([w[i] for w in waiting]) for i in range(3)))
                    out: list[list] = [[], [], [], []]
                    for i in range(a, b):
                        anchor, rank = int(columns["id"][i]), int(columns["rank"][i])
                        ids, scores = best(part, x[i - a], columns["label"][i], anchor, same, k, columns["least"][i], columns["most"][i])
                        for own, value in zip(out, ([anchor] * len(ids), [rank] * len(ids), ids.tolist(), scores.tolist())):
                            own += value
                    if out[0]:
                        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
                        yield pa.RecordBatch.from_arrays([pa.array(o, t) for o, t in zip(out, kinds)], names=["anchor", "rank", "id", "score"])

    return dealt.mapInArrow(run, schema)


def chosen(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The ``k`` best of all parts for each question, with ``place`` from 1."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def with_bounds(asked: DataFrame, rows: DataFrame, same: bool, k: int) -> DataFrame:
    """Raises ``least`` to the k-th best product in a sample of ``rows``, where there are as many."""
    total = rows.count()
    share = min(1.0, SAMPLE / max(total, 1))
    drawn = F.pmod(F.xxhash64("id", F.lit("bounds")), F.lit(1_000_000)) < int(share * 1_000_000) + (share == 1.0)
    # At most about SAMPLE rows, whatever the table holds; a limit holds that where ids repeat.
    table = rows.where(drawn).select("id", "label", "vec").limit(2 * SAMPLE).toArrow()
    by_size: dict[int, tuple] = {}
    sizes = np.array([len(v) for v in table.column("vec").to_pylist()], int)
    for size in np.unique(sizes):
        own = table.take(pa.array(np.flatnonzero(sizes == size)))
        by_size[int(size)] = own.column("id").to_numpy(), own.column("label").to_numpy(), np.array(own.column("vec").to_pylist(), float)
    held = asked.sparkSession.sparkContext.broadcast(by_size)
    names = asked.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                bound = row["least"]
                if len(row["vec"]) in held.value:
                    ids, labels, x = held.value[len(row["vec"])]
                    fit = (labels == row["label"]) & (ids != row["anchor"]) if same else labels != row["label"]
                    score = x[fit] @ np.array(row["vec"], float)
                    score = score[(score >= bound) & (score <= row["most"])]
                    # Rows with equal ids count once each here as there.
                    if len(score) >= k:
                        bound = float(np.partition(score, len(score) - k)[len(score) - k])
                out.append(bound)
            at = names.index("least")
            columns = [*batch.columns]
            columns[at] = pa.array(out, pa.float64())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return asked.mapInArrow(run, asked.schema)


def mine(rows: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, least: int = LEAST, most: int = MOST) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the ``prepared`` rows.

    ``anchors`` marks the rows that ask. A negative's product lies between ``least`` and ``most`` percent of the positive's.
    """
    placed = stage(parts(rows), "parts")
    asking = placed.where(anchors).select(F.col("id").alias("anchor"), "label", "vec")
    endless = [F.lit(0).alias("rank"), F.lit(float("-inf")).alias("least"), F.lit(float("inf")).alias("most")]
    first = stage(with_bounds(asking.select("*", *endless), placed, True, positives), "questions")
    found = chosen(search(placed, first, True, positives), ["anchor"], positives)
    found = stage(found.select("anchor", "place", F.col("id").alias("positive"), "score"), "positives")
    # In whole numbers: least * p <= 100 n <= most * p.
    score = F.col("score").cast("long")
    floor = F.ceil(F.lit(least) * score / 100).cast("double")
    ceiling = F.floor(F.lit(most) * score / 100).cast("double")
    again = found.join(asking, "anchor").select(
        "anchor", "label", "vec", F.col("place").cast("int").alias("rank"), floor.alias("least"), ceiling.alias("most")
    )
    # A negative product leaves no range.
    second = stage(with_bounds(again.where("least <= most"), placed, False, negatives), "questions")
    hard = chosen(search(placed, second, False, negatives), ["anchor", "rank"], negatives)
    named = found.select(F.col("anchor").alias("_anchor"), F.col("place").alias("_rank"), "positive", F.col("score").alias("_score"))
    return hard.join(named, (F.col("anchor") == F.col("_anchor")) & (F.col("rank") == F.col("_rank"))).select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("place").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.col("_score").cast("long").alias("positive_score"),
        F.col("score").cast("long").alias("negative_score"),
    )


def whole_numbers(embedding: str = "embedding") -> Column:
    """Components as the registered query has them: ``floor(256 x)`` in double precision."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("double"))
