"""Embedding near-dedup: an exact metric range join over pivots.

Unit vectors with cosine c lie sqrt(2 - 2c) apart, so the join is a range join in a metric space. Large labels get pivots; a
vector's home is the cell of its nearest pivot. A vector with home i can only be within reach r of one with home j if
``d(x, j) - d(x, i) <= 2 r`` (triangle inequality) and its distance to the plane between both pivots is at most r; it
is replicated to such cells. Every cell then finds all links of its home vectors by itself. The home vectors of a cell are
cut into chunks of bounded size, the other side streams past in batches, and only each vector's number of links and a
spanning forest leave the cell, never its pairs. Equal vectors are one class with a multiplicity.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components, and vectors with a null
label, link with nothing; vectors of different length link with nothing; equal rows are vectors of their own; a null id
keeps a null component, is not kept and is not counted; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.llm.common import stage
from driftlens.llm.components import components

THRESHOLD = 0.98
# Vectors a cell should hold, pivots at most in all labels together, and home vectors of one chunk.
CELL, PIVOTS, CHUNK = 2000, 4096, 2048
BATCH = 2048
SLACK = 1e-9


def _pivots(classes: DataFrame) -> dict[tuple, np.ndarray]:
    """The pivots of each label that needs more than one cell. A label gets one for ``max(CELL, all / PIVOTS)`` vectors, so
    all labels together have at most ``2 * PIVOTS``; they are drawn by hash."""
    total = classes.count()
    per_cell = max(CELL, -(-total // PIVOTS))
    large = classes.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > per_cell)
    wanted = large.withColumn("p", F.ceil(F.col("n") / per_cell))
    drawn = F.pmod(F.xxhash64("id", F.lit("pivot")), F.lit(1_000_000_007)) / 1_000_000_007.0
    rows = (
        classes.join(wanted, ["label", "dim"])
        .where(drawn < 4 * F.col("p") / F.col("n"))
        .select("label", "dim", "p", "embedding", drawn.alias("drawn"))
        .orderBy("label", "dim", "drawn", "embedding")
        .collect()
    )
    chosen: dict[tuple, list] = {}
    for row in rows:
        own = chosen.setdefault((row["label"], row["dim"]), [])
        if len(own) < row["p"]:
            own.append(unit(np.array([row["embedding"]], float))[0])
    return {name: np.array(own) for name, own in chosen.items() if len(own) > 1}


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``x`` to all rows of ``y``."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2 * x @ y.T, 0)


def cells_of(x: np.ndarray, pivots: np.ndarray | None, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Home cell of each unit vector, and for each pair of vector and cell whether the vector is needed there."""
    if pivots is None:
        return np.zeros(len(x), np.int64), np.ones((len(x), 1), bool)
    square = squares(x, pivots)
    home = square.argmin(axis=1)
    # Rows of the vectors' homes only: as large as ``square``, never all pivots against all. Rounded up, as a longer distance
    # only asks for more replication.
    apart = np.sqrt(squares(pivots[home], pivots) + 1e-12)
    own = square[np.arange(len(x)), home][:, None]
    by_triangle = np.sqrt(square) - np.sqrt(own) <= 2 * reach + SLACK
    by_plane = square - own <= 2 * apart * (reach + SLACK) + SLACK
    needed = by_triangle & by_plane
    needed[np.arange(len(x)), home] = True
    return home, needed


def assign(classes: DataFrame, reach: float) -> DataFrame:
    """``label, dim, cell, home, id, mult, vec``: a row for each cell a class is needed in."""
    pivots = classes.sparkSession.sparkContext.broadcast(_pivots(classes))
    kind = dict(classes.dtypes)["label"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for (label, dim), part in frame.groupby(["label", "dim"]):
                x = unit(np.stack(part["embedding"].to_numpy()).astype(float))
                home, needed = cells_of(x, pivots.value.get((label, dim)), reach)
                at, cell = np.nonzero(needed)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([label] * len(at), batch.schema.field("label").type),
                        pa.array(np.full(len(at), dim, np.int32)),
                        pa.array(cell.astype(np.int32)),
                        pa.array(home[at] == cell),
                        pa.array(part["id"].to_numpy()[at].astype(np.int64)),
                        pa.array(part["mult"].to_numpy()[at].astype(np.int64)),
                        pa.array([v.tobytes() for v in x[at]], pa.binary()),
                    ],
                    names=["label", "dim", "cell", "home", "id", "mult", "vec"],
                )

    return classes.select("label", "dim", "id", "mult", "embedding").mapInArrow(
        run, f"label {kind}, dim int, cell int, home boolean, id long, mult long, vec binary"
    )


class Chunk:
    """The home vectors of one chunk, their links so far and a spanning forest over them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, threshold: float):
        self.ids, self.x, self.threshold = ids, x, threshold
        self.links = np.zeros(len(ids), np.int64)
        self.root = np.arange(len(ids))

    def meet(self, ids: np.ndarray, mult: np.ndarray, x: np.ndarray) -> list[tuple[int, int]]:
        """Adds a batch of the cell's vectors; returns edges that join what was apart."""
        linked = x @ self.x.T >= self.threshold
        linked[ids[:, None] == self.ids[None]] = True
        self.links += mult @ linked
        edges = []
        for i in np.flatnonzero(linked.sum(axis=1) > 1):
            near = np.flatnonzero(linked[i])
            roots = np.unique(self.root[near])
            if len(roots) > 1:
                edges += [(int(self.ids[roots[0]]), int(self.ids[r])) for r in roots[1:]]
                self.root[np.isin(self.root, roots)] = roots[0]
        some = np.flatnonzero(linked.any(axis=1))
        first = self.ids[linked[some].argmax(axis=1)]
        edges += [(int(a), int(b)) for a, b in zip(ids[some], first) if a != b]
        return edges


def find_links(placed: DataFrame, threshold: float) -> DataFrame:
    """``id, links, other``: the number of vectors linked to each home class, itself included, and forest edges."""
    counts = placed.where("home").groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    sized = placed.join(counts, ["label", "dim", "cell"])
    fields = ["label", "dim", "cell", "chunk", "role", "id", "mult", "vec"]
    homes = sized.where("home").withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int")).withColumn("role", F.lit(0))
    others = sized.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).withColumn("role", F.lit(1))
    keys = ["label", "dim", "cell", "chunk"]
    dealt = homes.select(*fields).unionByName(others.select(*fields)).repartition(*keys).sortWithinPartitions(*keys, "role", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, rows, chunk = None, [], [], None

        def out(id_, links, other):
            return pa.RecordBatch.from_arrays(
                [pa.array(id_, pa.int64()), pa.array(links, pa.int64()), pa.array(other, pa.int64())], names=["id", "links", "other"]
            )

        def finished():
            if chunk is not None:
                yield out(chunk.ids, chunk.links, [None] * len(chunk.ids))

        for whole in batches:
            for start in range(0, whole.num_rows, BATCH):
                batch = whole.slice(start, BATCH)
                frame = batch.to_pandas()
                marks = (frame[keys] != frame[keys].shift()).any(axis=1) | (frame["role"] != frame["role"].shift())
                for _, part in frame.groupby(marks.cumsum(), sort=False):
                    now = tuple(part.iloc[0][keys])
                    x = np.stack([np.frombuffer(v, float) for v in part["vec"]])
                    if now != name:
                        yield from finished()
                        name, ids, rows, chunk = now, [], [], None
                    if part.iloc[0]["role"] == 0:
                        ids.append(part["id"].to_numpy())
                        rows.append(x)
                        continue
                    if chunk is None:
                        if not ids:
                            continue
                        chunk = Chunk(np.concatenate(ids), np.concatenate(rows), threshold)
                    edges = chunk.meet(part["id"].to_numpy(), part["mult"].to_numpy(), x)
                    if edges:
                        yield out([a for a, _ in edges], [None] * len(edges), [b for _, b in edges])
        yield from finished()

    return dealt.mapInArrow(run, "id long, links long, other long")


def link(
    vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", embedding: str = "embedding", label: str = "label"
) -> DataFrame:
    """The key and ``n_links, component_id, kept`` of each vector."""
    rows = vectors.select(F.col(key).cast("long").alias("vec"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    fine = (
        F.col("vec").isNotNull()
        & F.col("label").isNotNull()
        & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
        & F.exists("embedding", lambda v: v != 0)
    )
    rows = rows.withColumn("embedding", F.when(fine, F.col("embedding")))
    usable = rows.where("embedding is not null")
    classes = usable.groupBy("label", "embedding").agg(F.min("vec").alias("id"), F.count("*").alias("mult"))
    classes = stage(classes.withColumn("dim", F.size("embedding")), "vectors")
    reach = float(np.sqrt(2 - 2 * threshold))
    found = stage(find_links(stage(assign(classes, reach), "cells"), threshold), "links")
    counted = found.where("links is not null").groupBy("id").agg(F.max("links").alias("links"))
    joined = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    result = classes.join(counted, "id", "left").join(joined, "id", "left")
    result = result.select("label", "embedding", (F.coalesce("links", "mult") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return rows.join(result, ["label", "embedding"], "left").select(
        F.col("vec").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec").alias("component_id"),
        F.coalesce(F.col("vec") == F.coalesce("component_id", "vec"), F.lit(False)).alias("kept"),
    )
