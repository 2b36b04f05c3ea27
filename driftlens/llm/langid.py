"""Language ID by interpolated Kneser-Ney models over characters.

Texts are letters in lower case, all else is white space. Each task counts the 4-grams of its training texts by
language; Spark adds the counts, so the counts follow the whole corpus. The highest order is discounted from counts,
lower ones from continuation counts, both taken from the table of 4-grams by grouping. What a model says of a gram or a
context lies under a 64-bit hash of it in sorted arrays, files in the shared folder that grow with the corpus and are never
gathered. The tasks that read the texts look the distinct grams of each piece up there by binary search; no text is dealt out.

A text goes to the language with the lowest cross-entropy per character. Rejection is calibrated on the training texts
that are told right: the median deviation of the cross-entropy from its language's median gives a spread, its square is
fitted as ``a + b / length``, and a text is rejected that lies ``MOST_SPREADS`` out and is nearer to what texts of other
languages score. Medians hold still as long as fewer than half of those texts are odd.

Defined results: null and empty texts and texts without a letter are ``und`` with score 0 and are rejected; ties go to the
first language in order; equal rows count each; rows without a language are not learned from; with no training text at
all every text is ``und``; texts of any length are read whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.llm import hashfiles
from driftlens.llm.common import fold, pieces, stage, texts
from driftlens.llm.wordhash import mix
from driftlens.session import discard

ORDER = 4
# Values of one block of languages that are looked up at once.
BLOCK_VALUES = 1 << 22
# Probability of a symbol a language has never shown.
UNSEEN = 1 / (1 << 21)
SPACE = 0x20
NONE = "und"
# Distance of the limit from a language's median in spreads, and the spread of a normal law for a median deviation of 1.
MOST_SPREADS, NORMAL = 6.0, 1.4826
# Bits per symbol that stand for another language where only one was learned.
FOREIGN = 8.0
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its letter in lower case, or white space."""
    table = np.full(0x110000, SPACE, np.uint32)
    for point in range(0x110000):
        sign = chr(point)
        if sign.isalpha():
            low = sign.lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def symbols(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as symbols, where each begins, and its number of letters. Each text has three blanks ahead, one behind."""
    joined = b"".join(b"\n\n\n" + raw + b"\n" for raw in raws)
    data = np.frombuffer(joined, np.uint8)
    ends = np.cumsum(np.array([len(raw) + 4 for raw in raws], np.int64))
    points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends]
    begins = np.concatenate([[0], points[:-1]])
    signs = _letters()[np.frombuffer(joined.decode("utf-8", "replace").encode("utf-32-le"), "<u4")]
    blank = signs == SPACE
    keep = np.ones(len(signs), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    for shift in range(3):
        keep[begins + shift] = True
    # The blanks ahead stay apart from blanks the text begins with.
    place = np.concatenate([[0], np.cumsum(keep)])
    letters = np.concatenate([[0], np.cumsum(~blank)])
    return signs[keep], place[begins], letters[points] - letters[begins]


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of each gram; the number of symbols is part of it."""
    h = np.full(len(columns[0]), len(columns), np.uint64)
    for column, factor in zip(columns, _K):
        h = (h ^ column.astype(np.uint64)) * factor
        h ^= h >> np.uint64(29)
    return mix(h)


def grams_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all 4-grams inside one text, the text of each, the symbols, and the number of letters of each text."""
    signs, begins, letters = symbols(raws)
    sizes = np.diff(np.append(begins, len(signs))) - (ORDER - 1)
    sizes[sizes < 0] = 0
    text = np.repeat(np.arange(len(raws)), sizes)
    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(begins, sizes)
    return at, text, signs, letters


def gram_counts(docs: DataFrame, text: str, language: str) -> DataFrame:
    """``lang, c0, c1, c2, c3, n`` over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pd.DataFrame] = []

        def merged() -> pd.DataFrame:
            return pd.concat(kept).groupby(["lang", "c0", "c1", "c2", "c3"], as_index=False, sort=False)["n"].sum()

        for batch in pieces(batches, text):
            langs = batch.column(batch.schema.get_field_index(language)).to_pylist()
            code, names = pd.factorize(np.array(langs, object))
            at, of, signs, _ = grams_of(texts(batch, text))
            if not len(at):
                continue
            columns = [signs[at + j] for j in range(ORDER)]
            key = mix(gram_hash(columns) + code[of].astype(np.uint64))
            ids, distinct = pd.factorize(key)
            first = np.zeros(len(distinct), np.int64)
            first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
            found = pd.DataFrame({f"c{j}": columns[j][first].astype(np.int32) for j in range(ORDER)})
            found["lang"], found["n"] = names[code[of[first]]], np.bincount(ids)
            kept.append(found)
            if sum(map(len, kept)) > 1_000_000:
                kept[:] = [merged()]
                if len(kept[0]) > 500_000:
                    yield pa.RecordBatch.from_pandas(kept.pop()[["lang", "c0", "c1", "c2", "c3", "n"]], preserve_index=False)
        if kept:
            yield pa.RecordBatch.from_pandas(merged()[["lang", "c0", "c1", "c2", "c3", "n"]], preserve_index=False)

    schema = "lang string, c0 int, c1 int, c2 int, c3 int, n long"
    partial = docs.select(text, F.col(language).alias(language)).mapInArrow(run, schema)
    return partial.groupBy("lang", "c0", "c1", "c2", "c3").agg(F.sum("n").alias("n"))


def kneser_ney(counts: DataFrame) -> DataFrame:
    """``lang, kind, gram, value``: natural logarithms of probabilities (kind 1..4) and of context weights (-1..-3)."""
    names = [f"c{j}" for j in range(ORDER)]
    by_order = {ORDER: stage(counts, "grams")}
    for k in range(ORDER - 1, 0, -1):
        by_order[k] = by_order[k + 1].groupBy("lang", *names[ORDER - k :]).agg(F.count("*").alias("n"))
    symbols_in_use = by_order[1].select("c3").distinct().count() + 1
    lower, parts = None, []
    for k in range(1, ORDER + 1):
        own, context = names[ORDER - k :], names[ORDER - k : ORDER - 1]
        table = by_order[k]
        ones = table.groupBy("lang").agg(F.count_if(F.col("n") == 1).alias("n1"), F.count_if(F.col("n") == 2).alias("n2"))
        discount = F.greatest(F.lit(0.05), F.least(F.lit(0.95), F.coalesce(F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2")), F.lit(0.5))))
        ones = ones.select("lang", discount.alias("d"))
        of_context = table.groupBy("lang", *context).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        of_context = of_context.join(ones, "lang").withColumn("weight", F.col("d") * F.col("kinds") / F.col("total"))
        joined = table.join(of_context, ["lang", *context])
        if lower is None:
            below = F.lit(1.0 / symbols_in_use)
        else:
            joined = joined.join(lower.select("lang", *own[1:], F.col("p").alias("below")), ["lang", *own[1:]])
            below = F.col("below")
        p = (F.col("n") - F.col("d")) / F.col("total") + F.col("weight") * below
        lower = stage(joined.select("lang", *own, p.alias("p")), "probabilities")
        for kind, part, columns, value in ((k, lower, own, "p"), (1 - k, of_context, context, "weight")):
            if columns:
                packed = F.array(*[F.col(c) for c in columns])
                parts.append(part.select("lang", F.lit(kind).alias("kind"), packed.alias("gram"), F.log(value).alias("value")))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every


def table_of(rows: DataFrame, languages: list[str]) -> DataFrame:
    """``gram, code, value``: a row for each gram hash and language that has it; the code is twice the language's number for
    a probability, one more for a context weight."""
    number = {name: i for i, name in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kind = batch.column(1).to_numpy()
            lists = batch.column(2)
            sizes, flat = np.abs(kind), lists.flatten().to_numpy()
            begins, hashes = np.cumsum(sizes) - sizes, np.zeros(len(kind), np.uint64)
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                hashes[at] = gram_hash([flat[begins[at] + j] for j in range(size)])
            code = 2 * np.array([number[name] for name in batch.column(0).to_pylist()], np.int64) + (kind < 0)
            columns = [pa.array(hashes.view(np.int64)), pa.array(code.astype(np.int32)), batch.column(3).cast(pa.float32())]
            yield pa.RecordBatch.from_arrays(columns, names=["gram", "code", "value"])

    return rows.select("lang", "kind", "gram", "value").mapInArrow(run, "gram long, code int, value float")


class Found:
    """The entries of the model for some grams: hashes in order, and the codes and values of each."""

    def __init__(self, reader: hashfiles.Reader, wanted: np.ndarray, languages: int):
        self.languages = languages
        signed = np.sort(wanted.view(np.int64))
        sizes, (self.codes, self.values) = reader.find(signed)
        order = np.argsort(signed.view(np.uint64))
        self.grams, self.sizes, self.begins = signed.view(np.uint64)[order], sizes[order], (np.cumsum(sizes) - sizes)[order]

    def _look(self, columns: list[np.ndarray], weights: bool, first: int, last: int) -> np.ndarray:
        """A value for each gram and each language from ``first`` to before ``last``, NaN where a language has none."""
        found = np.full((len(columns[0]), last - first), np.nan, np.float32)
        if not len(self.grams):
            return found
        wanted = gram_hash(columns)
        place = np.minimum(np.searchsorted(self.grams, wanted), len(self.grams) - 1)
        hit = np.flatnonzero(self.grams[place] == wanted)
        sizes = self.sizes[place[hit]]
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.begins[place[hit]], sizes)
        code, row = self.codes[at], np.repeat(hit, sizes)
        own = np.flatnonzero(((code & 1) == int(weights)) & (code >> 1 >= first) & (code >> 1 < last))
        found[row[own], (code[own] >> 1) - first] = self.values[at[own]]
        return found

    def log_probability(self, columns: list[np.ndarray], first: int = 0, last: int | None = None) -> np.ndarray:
        """Of the last symbol after the others, for each gram and language."""
        last = self.languages if last is None else last
        best = np.where(np.isnan(p := self._look(columns[-1:], False, first, last)), np.float32(np.log(UNSEEN)), p)
        for k in range(2, ORDER + 1):
            own = columns[ORDER - k :]
            weight = self._look(own[:-1], True, first, last)
            p = self._look(own, False, first, last)
            best = np.where(np.isnan(p), best + np.where(np.isnan(weight), np.float32(0), weight), p)
        return best


def entropies(reader: hashfiles.Reader, raws: list[bytes], languages: int) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy in bits per symbol for each text and language, and the number of symbols; 0 without letters."""
    at, of, signs, letters = grams_of(raws)
    sums = np.zeros((len(raws), languages))
    counts = np.bincount(of, minlength=len(raws))
    if len(at):
        ids, columns = distinct_grams(signs, at)
        found = Found(reader, needed(columns), languages)
        block = max(1, BLOCK_VALUES // len(columns[0]))
        for first in range(0, languages, block):
            last = min(first + block, languages)
            logs = found.log_probability(columns, first, last)
            for i in range(first, last):
                sums[:, i] = np.bincount(of, weights=logs[ids, i - first], minlength=len(raws))
    return -sums / np.log(2) / np.maximum(counts, 1)[:, None], np.where(letters > 0, counts, 0)


def distinct_grams(signs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The number of each 4-gram among the distinct ones, and the columns of those."""
    columns = [signs[at + j] for j in range(ORDER)]
    ids, distinct = pd.factorize(gram_hash(columns))
    first = np.zeros(len(distinct), np.int64)
    first[ids[::-1]] = np.arange(len(ids) - 1, -1, -1)
    return ids, [column[first] for column in columns]


def needed(columns: list[np.ndarray]) -> np.ndarray:
    """The distinct hashes of what the scores of 4-grams ask for: themselves, their ends, contexts and ends of those."""
    hashes = [gram_hash(columns)]
    for k in range(1, ORDER):
        hashes += [gram_hash(columns[ORDER - k :]), gram_hash(columns[ORDER - 1 - k : ORDER - 1])]
    return np.unique(np.concatenate(hashes))


@dataclass
class Model:
    """The names of the languages and the written rows of ``table_of``."""

    languages: list[str]
    files: hashfiles.HashFiles

    def log_probability(self, columns: list[np.ndarray]) -> np.ndarray:
        """Of the last symbol after the others, for each gram and language."""
        return Found(self.files.reader(), needed(columns), len(self.languages)).log_probability(columns)


def train(docs: DataFrame, text: str = "text", language: str = "lang") -> Model | None:
    """A model of the languages of all given texts; None if there are none."""
    known = docs.where(F.col(language).isNotNull())
    rows = stage(kneser_ney(gram_counts(known, text, language)), "logarithms")
    languages = sorted(row["lang"] for row in rows.where("kind = 1").select("lang").distinct().collect())
    if not languages:
        return None
    model = Model(languages, hashfiles.write(table_of(rows, languages), "model"))
    discard(rows)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text", key: str = "doc_id", language: str | None = None) -> DataFrame:
    """The key and ``given, lang_pred, score, entropy, runner_up, n_symbols`` of each text; ``given`` is its ``language``."""
    kind = dict(docs.dtypes)[key]
    given = (F.col(language) if language else F.lit(None)).cast("string").alias("given")
    if model is None:
        empty = [F.lit(NONE).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("entropy"), F.lit(0.0).alias("runner_up"), F.lit(0).cast("long").alias("n_symbols")]
        return docs.select(key, given, *empty)
    languages, files = model.languages, model.files

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = files.reader()
        for batch in pieces(batches, "text"):
            bits, n = entropies(reader, texts(batch, "text"), len(languages))
            best = bits.argmin(axis=1)
            lowest = bits[np.arange(len(n)), best]
            # Differences over at most 50 symbols: beyond that every score would be 1.
            weight = np.exp2(-(bits - lowest[:, None]) * np.minimum(n, 50)[:, None]).sum(axis=1)
            some = n > 0
            bits[np.arange(len(n)), best] = FOREIGN
            others = bits.min(axis=1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(batch.schema.get_field_index("key")),
                    batch.column(batch.schema.get_field_index("given")),
                    pa.array([languages[i] if ok else NONE for i, ok in zip(best, some)], pa.string()),
                    pa.array(np.where(some, 1 / weight, 0.0)),
                    pa.array(np.where(some, lowest, 0.0)),
                    pa.array(np.where(some, others, 0.0)),
                    pa.array(n.astype(np.int64)),
                ],
                names=[key, "given", "lang_pred", "score", "entropy", "runner_up", "n_symbols"],
            )

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), given)
    return rows.mapInArrow(run, f"`{key}` {kind}, given string, lang_pred string, score double, entropy double, runner_up double, n_symbols long")


def with_rejection(scored: DataFrame, calibrating: Column) -> DataFrame:
    """Adds ``rejected``; ``scored`` must be written already, ``calibrating`` marks the rows the limit is fitted on."""
    usable = scored.where(calibrating & (F.col("n_symbols") > 0))
    half = lambda c: F.percentile_approx(c, 0.5, 10_000)
    rows = usable.groupBy("lang_pred").agg(half("entropy").alias("mean"), half("runner_up").alias("foreign")).toArrow().to_pandas()
    if not len(rows):
        return scored.withColumn("spreads", F.lit(None).cast("double")).withColumn("rejected", F.col("lang_pred") == NONE)
    about = F.abs(F.col("entropy") - F.col("mean"))
    spreads = usable.join(F.broadcast(scored.sparkSession.createDataFrame(rows)), "lang_pred")
    spreads = spreads.groupBy("lang_pred", F.floor(F.log2("n_symbols")).alias("size")).agg(
        F.count("*").alias("n"), half(about).alias("mad"), F.avg(1 / F.col("n_symbols")).alias("inverse")
    ).toArrow().to_pandas()
    fitted = {}
    for name, part in spreads.groupby("lang_pred"):
        squares, weight = (NORMAL * part["mad"].to_numpy()) ** 2, np.sqrt(part["n"].to_numpy())
        design = np.stack([np.ones(len(part)), part["inverse"]], axis=1) * weight[:, None]
        a, b = np.linalg.lstsq(design, squares * weight, rcond=None)[0] if len(part) > 1 else (squares[0], 0.0)
        fitted[name] = max(float(a), 1e-4), max(float(b), 0.0)
    rows["a"], rows["b"] = ([fitted[name][i] for name in rows["lang_pred"]] for i in (0, 1))
    limits = scored.sparkSession.createDataFrame(rows)
    own = F.sqrt(F.col("a") + F.col("b") / F.greatest("n_symbols", F.lit(1)))
    marked = scored.join(F.broadcast(limits), "lang_pred", "left").withColumn("spreads", (F.col("entropy") - F.col("mean")) / own)
    outside = (F.col("spreads") > MOST_SPREADS) & (F.col("entropy") > (F.col("mean") + F.col("foreign")) / 2)
    rejected = (F.col("lang_pred") == NONE) | F.coalesce(outside, F.lit(False))
    return marked.withColumn("rejected", rejected).drop("mean", "foreign", "a", "b")


def identify(docs: DataFrame, held_out: Column, text: str = "text", language: str = "lang", key: str = "doc_id") -> DataFrame:
    """The key and ``held_out, lang_pred, score, rejected, entropy`` of each text, learned from the rows not held out."""
    model = train(docs.where(~held_out), text, language)
    scored = stage(score(docs, model, text, key, language).withColumn("held_out", held_out), "languages")
    right = ~F.col("held_out") & F.coalesce(F.col("given") == F.col("lang_pred"), F.lit(False))
    return with_rejection(scored, right).select(key, "held_out", "lang_pred", "score", "rejected", "entropy", "n_symbols")


def held_out(key: str = "doc_id") -> Column:
    return fold(F.col(key), 4) == 2
