"""N-gram Jaccard join by parity sketches.

A document is the set of its word n-grams. XOR of token hashes is a parity sketch: a token that only one of two sets
has changes one block of a sketch of blocks and one bit of a sketch of bits, so the number of different blocks, and of
different bits, is at most the size of the symmetric difference. A similarity of p/q allows a difference of at most
``d = (n1 + n2) (q - p) / (q + p)``.

* Sizes fall into bands. All documents that can meet a document of the band as the smaller one are sketched for it as
  well, with ``d + 1 + e`` blocks for the band's ``d``: two similar sets agree in ``1 + e`` blocks at least (pigeonhole).
  Agreement in blocks without tokens says nothing, so these are left out, but for sets with more than ``e`` of them.
* Equal sets are one class with one representative. Representatives with an equal block meet in a bucket.
* First, neighbours in a bucket, by id, are verified: as many pairs as rows. Most of a group of near copies becomes one
  component by that. Then pairs of a bucket in different components are verified, the rest of what could change a
  component. Bit sketches drop pairs inside the join that cannot be similar. So every link between different texts is
  either verified or lies inside a component, and no group of copies is expanded into its pairs.
* Before verification, sketches with two bits or more for each n-gram drop pairs again: the short ones, of one length for all,
  are full for long texts. Lengths are powers of two, so the longer sketch of a pair folds to the length of the shorter one.
* Verification intersects the whole sets of 64-bit n-gram hashes.

Defined results: null and empty texts and texts of white space have an empty set and are linked with nothing; fewer
words than n give the whole sequence as one n-gram; rows with the same id count as one node with all their texts, so they share a
component; a null id is linked with nothing and keeps a null component; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from driftlens.llm.common import pieces, stage, texts, with_keys, without_keys
from driftlens.llm.components import components
from driftlens.llm.wordhash import mix, word_hashes
from driftlens.session import discard

BITS = 512
BAND_RATIO = 1.3
_ORDER = np.random.default_rng(0xA11CE).integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(raws: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text, A-Z in lower case."""
    data = np.frombuffer(b"\n".join(raws).lower() + b"\n", np.uint8)
    ends = np.cumsum(np.array([len(raw) + 1 for raw in raws], np.int64))
    starts, _, hashes = word_hashes(data)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    grams = np.zeros(max(len(hashes) - n + 1, 0), np.uint64)
    for j in range(n):
        grams += hashes[j : j + len(grams)] * _ORDER[j % len(_ORDER)]
    grams = mix(grams)
    sets = []
    for first, last in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        words = last - first
        if words >= n:
            sets.append(np.unique(grams[first : last - n + 1]))
        elif words:
            whole = (hashes[first:last] * _ORDER[:words]).sum(dtype=np.uint64) + np.uint64(words)
            sets.append(mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


class Bands:
    """Size bands and the number of blocks each one needs for a similarity of p/q."""

    def __init__(self, p: int, q: int):
        if not 0 < p <= q:
            raise ValueError("the similarity p/q must be above 0 and at most 1")
        self.p, self.q = p, q
        self.lower = [1]

    def _reach(self, size: int) -> None:
        while self.lower[-1] <= size:
            self.lower.append(max(self.lower[-1] + 1, int(self.lower[-1] * BAND_RATIO)))

    def of(self, size: int) -> range:
        """The bands a set of this size takes part in: its own, and those of the larger sets it can be similar to."""
        largest = size * self.q // self.p
        self._reach(largest)
        return range(int(np.searchsorted(self.lower, size, "right")) - 1, int(np.searchsorted(self.lower, largest, "right")))

    def blocks(self, band: int) -> tuple[int, int]:
        """The number of blocks, and how many empty ones a set may have without using them."""
        top, least = self.lower[band + 1] - 1, self.lower[band] * self.p / self.q
        d = 2 * top * (self.q - self.p) // (self.q + self.p)
        spare = 2
        for _ in range(3):
            spare = 2 + int(1.5 * (d + 1 + spare) * np.exp(-least / (d + 1 + spare)))
        return d + 1 + spare, spare


def sketch(tokens: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket hashes of a set, its sketch of ``BITS`` bits, and the one of two bits or more for each token."""
    length = max(BITS, 1 << (2 * len(tokens) - 1).bit_length())
    places = (tokens >> np.uint64(20)) % np.uint64(length)
    bits = np.bincount(places.astype(np.int64), minlength=length).astype(np.uint8) & 1
    long = np.packbits(bits, bitorder="little").view("<u8")
    found = []
    values = mix(tokens)
    for band in bands.of(len(tokens)):
        count, spare = bands.blocks(band)
        block = ((values >> np.uint64(32)) % np.uint64(count)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        ranked = block[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        used = ranked[first]
        parity = np.bitwise_xor.reduceat(values[order], first)
        if count - len(used) > spare:
            empty = np.setdiff1d(np.arange(count), used)
            used, parity = np.concatenate([used, empty]), np.concatenate([parity, np.zeros(len(empty), np.uint64)])
        found.append(mix(parity + mix(used.astype(np.uint64) + np.uint64(band << 40))))
    return np.concatenate(found), np.bitwise_xor.reduce(long.reshape(-1, BITS // 64), axis=0), long


def profiles(docs: DataFrame, n: int, p: int, q: int, text: str, key: str) -> DataFrame:
    """``id, n, h1, h2, bits, long, buckets`` of each text; no buckets for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(p, q)
        for batch in pieces(batches, text):
            sets = shingle_sets(texts(batch, text), n)
            nothing = (np.zeros(0, np.uint64), np.zeros(BITS // 64, np.uint64), np.zeros(0, np.uint64))
            made = [sketch(own, bands) if len(own) else nothing for own in sets]
            signed = lambda a: pa.array(np.asarray(a, np.uint64).view(np.int64), pa.int64())
            lists = lambda xs: pa.ListArray.from_arrays(
                np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32), signed(np.concatenate(xs))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index(key)).cast(pa.int64()),
                    pa.array([len(own) for own in sets], pa.int64()),
                    signed([np.bitwise_xor.reduce(own) for own in sets]),
                    signed([mix(own).sum(dtype=np.uint64) for own in sets]),
                    lists([bits for _, bits, _ in made]),
                    lists([long for _, _, long in made]),
                    lists([keys for keys, _, _ in made]),
                ],
                names=["id", "n", "h1", "h2", "bits", "long", "buckets"],
            )

    schema = "id long, n long, h1 long, h2 long, bits array<long>, long array<long>, buckets array<long>"
    return docs.select(key, text).mapInArrow(run, schema)


def shingles(docs: DataFrame, n: int, text: str, key: str) -> DataFrame:
    """``id`` and the sorted n-gram hashes ``grams`` of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text):
            sets = shingle_sets(texts(batch, text), n)
            offsets = np.concatenate([[0], np.cumsum([len(own) for own in sets])]).astype(np.int32)
            grams = pa.array(np.concatenate(sets).view(np.int64), pa.int64())
            ids = batch.column(batch.schema.get_field_index(key)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.ListArray.from_arrays(offsets, grams)], names=["id", "grams"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))])
    return docs.select(key, text).mapInArrow(run, schema)


def _near(a: str, b: str, p: int, q: int) -> Column:
    """Whether sizes and bit sketches of two aliases allow a similarity of p/q."""
    n1, n2 = F.col(f"{a}.n"), F.col(f"{b}.n")
    distance = F.lit(0)
    for i in range(BITS // 64):
        distance = distance + F.bit_count(F.col(f"{a}.s{i}").bitwiseXOR(F.col(f"{b}.s{i}")))
    return (n1 * q >= n2 * p) & (n2 * q >= n1 * p) & (distance * (p + q) <= (n1 + n2) * (q - p))


def _distance(x: str, y: str) -> Column:
    """The number of different bits of two sketches, the longer one folded to the length of the shorter one."""
    least = F.least(F.size(x), F.size(y))

    def folded(bits: str, i: Column) -> Column:
        places = F.sequence(i, F.size(bits) - 1, least)
        return F.aggregate(places, F.lit(0).cast("long"), lambda v, j: v.bitwiseXOR(F.get(bits, j)))

    return F.aggregate(
        F.sequence(F.lit(0), least - 1),
        F.lit(0).cast("long"),
        lambda total, i: total + F.bit_count(folded(x, i).bitwiseXOR(folded(y, i))),
    )


def sifted(pairs: DataFrame, sketches: DataFrame, p: int, q: int) -> DataFrame:
    """The pairs ``a, b`` whose long sketches allow a similarity of p/q, written down.

    ``sketches`` has ``id, n, long``; those of the pairs' ends only are dealt out.
    """
    ends = stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ends")
    own = stage(with_keys(sketches.select("id", "n", "long"), "id", ends), "long")
    left = own.select(F.col("id").alias("a"), F.col("n").alias("n1"), F.col("long").alias("x"))
    right = own.select(F.col("id").alias("b"), F.col("n").alias("n2"), F.col("long").alias("y"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    close = _distance("x", "y") * (p + q) <= (F.col("n1") + F.col("n2")) * (q - p)
    found = stage(both.where(close).select("a", "b").distinct(), "sifted")
    discard(own)
    return found


def verified(pairs: DataFrame, texts_of: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """The pairs ``a, b`` of ids whose sets have a similarity of at least p/q, written down.

    ``texts_of`` has ``id, text``; only the texts of the pairs are dealt out and made into sets.
    """
    ends = stage(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "ends")
    sets = stage(shingles(with_keys(texts_of, "id", ends), n, "text", "id"), "sets")
    left = sets.select(F.col("id").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("id").alias("b"), F.col("grams").alias("y"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    # What the bit map let through wrongly meets no pair.
    both = pairs.join(left, "a").join(right, "b").select("a", "b", common.alias("c"), (F.size("x") + F.size("y")).alias("n"))
    found = stage(both.where(F.col("c") * q >= (F.col("n") - F.col("c")) * p).select("a", "b"), "links")
    discard(sets)
    return found


def join(
    docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, text: str = "text", key: str = "doc_id"
) -> DataFrame:
    """``doc_id, n_shingles, component_id``: the smallest id reachable over pairs with a Jaccard similarity of p/q."""
    profile = stage(profiles(docs, n, p, q, text, key), "profiles")
    narrow = stage(profile.select("id", "n", "h1", "h2"), "narrow")
    text_key = F.struct("id", "n", "h1", "h2").alias("text_key")
    classes = narrow.where("n > 0 and id is not null").groupBy("n", "h1", "h2").agg(F.min("id").alias("rep"))
    classes = stage(classes, "classes")
    # Of equal sets only the representative goes on; the others are few or many, so only their keys are dealt out.
    equal = stage(narrow.join(classes, ["n", "h1", "h2"]).where("id <> rep").select(text_key).distinct(), "equal")
    member = narrow.join(classes, ["n", "h1", "h2"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"))
    # The texts of one id may be represented by different ids, which are one node then.
    repeated = narrow.where("id is not null").groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id")
    same_id = stage(member.join(repeated, "id").where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b")), "same")
    s = [F.element_at("bits", i + 1).alias(f"s{i}") for i in range(BITS // 64)]
    reps = without_keys(profile.where("n > 0 and id is not null").select("id", "buckets", text_key), "text_key", equal)
    in_bucket = Window.partitionBy("bucket").orderBy("id")
    rows = reps.select("id", F.explode("buckets").alias("bucket"))
    beside = rows.select(
        "bucket", "id", F.lag("id").over(in_bucket).alias("before"), F.lead("id").over(in_bucket).alias("after")
    ).where("before is not null or after is not null")
    shared = stage(beside.select("bucket", "id", "before"), "buckets")
    chosen = stage(shared.select("id").distinct(), "chosen")
    near_bits = with_keys(profile.where("n > 0").select("id", "n", *s, "long"), "id", chosen)
    sketches = stage(near_bits, "bits")
    bits = sketches.drop("long")
    discard(profile)

    texts_of = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    pairs = shared.where("before <> id").select(F.least("before", "id").alias("a"), F.greatest("before", "id").alias("b")).distinct()
    near = (
        # Sorted at every size: sketches are never small enough to hand to all tasks.
        pairs.join(bits.alias("x").hint("merge"), F.col("a") == F.col("x.id"))
        .join(bits.alias("y").hint("merge"), F.col("b") == F.col("y.id"))
        .where(_near("x", "y", p, q))
        .select("a", "b")
        .distinct()
    )
    links = verified(sifted(stage(near, "near"), sketches, p, q), texts_of, n, p, q).unionByName(same_id)
    joined = components(links)

    placed = shared.select("bucket", "id").join(joined, "id", "left").withColumn("c", F.coalesce("component", "id"))
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("bucket")
    open_rows = stage(placed.join(mixed, "bucket", "left_semi").select("bucket", "id", "c").join(bits.hint("merge"), "id"), "open")
    across = (
        open_rows.alias("x")
        .join(open_rows.alias("y"), (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.c") < F.col("y.c")) & _near("x", "y", p, q))
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b"))
        .distinct()
    )
    more = verified(sifted(stage(across, "across"), sketches, p, q), texts_of, n, p, q)
    discard(open_rows)
    final = components(links.unionByName(more))

    return member.join(final.select(F.col("id").alias("rep"), "component"), "rep", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"),
    )
