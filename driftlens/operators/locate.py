"""Find the lines of a file that hold a text or an assignment, near a hint. ``lines`` is the file as an array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from driftlens.functions.regex import BLANKS
from driftlens.functions.text import bind, strip

KEYWORDS = ("query", "mutation", "subscription", "fragment")


def _lines_where(lines: Column, test) -> Column:
    """1-based numbers of the lines that pass ``test(line, number)``."""
    numbered = F.transform(lines, lambda line, i: F.when(test(line, i + 1), i + 1))
    return F.filter(numbered, lambda i: i.isNotNull())


def _window(lines: Column, first: Column, stop: Column) -> tuple[Column, Column]:
    """The lines with 0-based numbers in ``[first, stop)`` and the number of lines before them."""
    begin = F.greatest(F.lit(0), first)
    return F.slice(lines, begin + 1, F.greatest(stop - begin, F.lit(0))), begin


def assignment_line(lines: Column, name: Column, hint: Column) -> Column:
    """Line where ``name`` is assigned: within five lines of the hint, else the first in the file, else the hint."""
    blanks = F.lit(BLANKS)

    def assigns(line: Column, _: Column) -> Column:
        after = F.substring(F.ltrim(line, blanks), F.length(name) + 1, F.length(line))
        return F.ltrim(line, blanks).startswith(name) & F.ltrim(after, blanks).startswith("=")

    near, before = _window(lines, hint - 5, hint + 5)
    in_near = F.try_element_at(_lines_where(near, assigns), F.lit(1)) + before
    anywhere = F.try_element_at(_lines_where(lines, assigns), F.lit(1))
    return F.coalesce(in_near, anywhere, hint)


def assignment_end_line(lines: Column, start: Column) -> Column:
    """Last line of an assignment at ``start``: the line that closes a triple-quoted string, else ``start``."""
    line = F.try_element_at(lines, start)
    quote = F.when(line.contains('"""'), '"""').when(line.contains("'''"), "'''")
    count = (F.length(line) - F.length(F.replace(line, quote))) / 3
    rest, before = _window(lines, start, F.size(lines))
    closing = F.try_element_at(_lines_where(rest, lambda text, _: text.contains(quote)), F.lit(1)) + before
    return F.when(quote.isNotNull() & (count % 2 == 1), F.coalesce(closing, start)).otherwise(start)


def string_lines(lines: Column, content: Column, hint: Column) -> Column:
    """First and last line of a string near the hint (ten lines before, twenty after): its first three lines must
    follow each other there."""

    def search(wanted: Column) -> Column:
        size = F.size(wanted)
        head = F.when(F.length(wanted[0]) > 0, wanted[0]).otherwise(F.coalesce(F.try_element_at(wanted, F.lit(2)), F.lit("")))
        probes = F.slice(wanted, F.lit(1), F.least(F.lit(3), size))
        near, before = _window(lines, hint - 10, hint + 20)

        def test(line: Column, number: Column) -> Column:
            follow = F.slice(lines, before + number, F.lit(3))
            return line.contains(head) & F.forall(
                F.transform(probes, lambda probe, j: F.coalesce(F.try_element_at(follow, j + 1).contains(probe), F.lit(False))),
                lambda ok: ok,
            )

        found = F.try_element_at(_lines_where(near, test), F.lit(1)) + before
        first = F.coalesce(found, hint)
        return F.struct(first.cast("int").alias("first"), (first + size - 1).cast("int").alias("last"))

    return bind(F.transform(F.split(content, "\n", -1), strip), search)


def block_lines(lines: Column, content: Column, start: Column) -> Column:
    """First and last line of an operation text within a longer string that starts at ``start``."""

    def search(wanted: Column) -> Column:
        near, before = _window(lines, start - 5, start + 50)

        def test(line: Column, number: Column) -> Column:
            keyword = F.lit(False)
            for word in KEYWORDS:
                keyword = keyword | line.contains(word)
            return line.contains(wanted[0]) & keyword

        found = F.try_element_at(_lines_where(near, test), F.lit(1)) + before
        first = F.coalesce(found, start)
        return F.struct(first.cast("int").alias("first"), (first + F.size(wanted) - 1).cast("int").alias("last"))

    return bind(F.transform(F.split(strip(content), "\n", -1), strip), search)
