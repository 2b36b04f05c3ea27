"""Text functions: offset-exact pattern scans, line and column positions, body normalisation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions.regex import BLANKS, spell

# Two noncharacters mark the borders of a match; texts that hold them get the replacement character instead, which
# keeps every offset.
OPEN, CLOSE, SPARE = "﷐", "﷑", "�"
CHUNK = 32
HIT = "array<struct<match:string,offset:int,lines:int,col:int>>"

OPERATION_START = r"(?i)^(?:query|mutation|subscription|fragment)"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` mentions it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def newlines(text: Column) -> Column:
    """Number of line feeds in ``text``."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n")))


def offset_to_line(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based character offset."""
    return newlines(F.substring(text, F.lit(1), offset)) + 1


def line_col(text: Column, start_line: Column, offset: Column, line_base: int = 0) -> tuple[Column, Column]:
    """Line and column of ``offset`` in a text that starts at ``start_line``.

    ``line_base`` is 0 for a text at its own place and 1 for content cut out of a file. An offset past the end
    gives the first line and column 1.
    """
    before = F.substring(text, F.lit(1), offset)
    past = offset >= F.length(text)
    line = start_line + F.when(past, 0).otherwise(newlines(before)) + line_base
    col = F.when(past, 1).otherwise(F.length(F.substring_index(before, "\n", -1)) + 1)
    return line, col


def find_all(text: Column, pattern: str, flags: str = "") -> Column:
    """All matches of ``pattern`` in ``text``, left to right, without overlap.

    Each hit holds the matched string, its 0-based offset, the number of line feeds before it and the number of
    characters since the last of them. Running sums go chunk by chunk, so the cost is linear in the number of hits,
    and everything happens inside one row: no shuffle, no Python.
    """
    return find_all_spelled(text, spell(pattern, flags))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


def find_all_spelled(text: Column, pattern: str) -> Column:
    """``find_all`` for a pattern already in Spark's spelling; ``text`` must be a plain column.

    The expression is one SQL text, which is much quicker to build than the same nest of column calls.
    """
    name = text._jc.toString()
    if not name.isidentifier():
        raise ValueError(f"not a plain column: {name}")
    plain = f"replace(p, '{CLOSE}')"
    spared = f"CASE WHEN contains(`{name}`, '{OPEN}') OR contains(`{name}`, '{CLOSE}') THEN translate(`{name}`, '{OPEN}{CLOSE}', '{SPARE}{SPARE}') ELSE `{name}` END"
    moved = (
        "'offset', a.offset + x.size, 'lines', a.lines + x.lines, "
        "'col', CASE WHEN x.lines > 0 THEN x.tail ELSE a.col + x.size END"
    )
    start = "'offset', 0, 'lines', 0, 'col', 0"
    here = "'offset', {0}.offset, 'lines', {0}.lines, 'col', {0}.col"
    regex = _quoted(pattern)
    # The pieces between the marks: a match (but for the first piece) and the text up to the next one.
    pieces = f"""transform(
      split(regexp_replace({spared}, {regex}, '{OPEN}$0{CLOSE}'), '{OPEN}', -1),
      p -> named_struct('match', substring_index(p, '{CLOSE}', 1), 'size', length({plain}),
        'lines', length({plain}) - length(replace({plain}, '\\n')), 'tail', length(substring_index({plain}, '\\n', -1))))"""
    chunks = f"transform(sequence(0, CAST(floor((size(pieces) - 1) / {CHUNK}) AS INT)), i -> slice(pieces, i * {CHUNK} + 1, {CHUNK}))"
    # A chunk's own totals are a piece in turn: its size, its line feeds, what follows the last of them.
    totals = f"""transform(chunks, c -> transform(array(aggregate(c, named_struct({start}), (a, x) -> named_struct({moved}))),
      t -> named_struct('size', t.offset, 'lines', t.lines, 'tail', t.col))[0])"""
    starts = f"""aggregate({totals},
      named_struct({start}, 'starts', CAST(array() AS array<struct<offset:int,lines:int,col:int>>)),
      (a, x) -> named_struct({moved}, 'starts', array_append(a.starts, named_struct({here.format('a')}))), a -> a.starts)"""
    placed = f"""aggregate(c, named_struct({here.format('s')}, 'hits', CAST(array() AS {HIT})),
      (a, x) -> named_struct({moved}, 'hits', array_append(a.hits, named_struct('match', x.match, {here.format('a')}))), a -> a.hits)"""
    walked = f"flatten(transform(array({chunks}), chunks -> zip_with(chunks, {starts}, (c, s) -> {placed}))[0])"
    few = placed.replace("aggregate(c,", "aggregate(pieces,").replace(here.format("s"), start)
    # The first piece is the text before the first match.
    hits = f"transform(array({pieces}), pieces -> slice(CASE WHEN size(pieces) <= {CHUNK} THEN {few} ELSE {walked} END, 2, size(pieces)))[0]"
    return F.expr(f"CASE WHEN `{name}` RLIKE {regex} THEN {hits} ELSE CAST(array() AS {HIT}) END")


def normalise_body(raw: Column) -> Column:
    """Drop ``#`` comments, then all blanks: two bodies that only differ in layout become equal."""
    bare = F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?d)#.*", "")
    return F.regexp_replace(bare, spell(r"\s+"), "")


def strip(text: Column) -> Column:
    """Remove blanks of any kind at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def strip_quotes(text: Column) -> Column:
    """Remove one pair of outer quotes, triple ones first, from a stripped text."""
    first, last = F.substring(text, 1, 3), F.substring(text, -3, 3)
    triple = (first.isin('"""', "'''")) & (first == last) & (F.length(text) >= 3)
    one, end = F.substring(text, 1, 1), F.substring(text, -1, 1)
    single = one.isin('"', "'") & (one == end)
    size = F.length(text)
    return (
        F.when(triple, F.substring(text, F.lit(4), F.greatest(size - 6, F.lit(0))))
        .when(single, F.substring(text, F.lit(2), F.greatest(size - 2, F.lit(0))))
        .otherwise(text)
    )


def starts_like_operation(text: Column) -> Column:
    """The stripped text starts with an operation or fragment keyword, in any case."""
    return strip(text).rlike(OPERATION_START)


def balanced_braces(text: Column) -> Column:
    """At least one pair of braces, and as many opening as closing ones."""
    opened = F.length(text) - F.length(F.replace(text, F.lit("{")))
    closed = F.length(text) - F.length(F.replace(text, F.lit("}")))
    return (opened > 0) & (opened == closed)
