"""Harvest: operation texts and model classes out of source files.

Every strategy turns a file row into candidate texts inside that row (native pattern scans, or the file's leaf
facts); the candidates are then split into definitions and deduplicated. Strategy numbers and ``seq`` give the order
in which ties are settled.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions.regex import spell
from driftlens.functions.text import (
    balanced_braces,
    bind,
    find_all,
    newlines,
    starts_like_operation,
)
from driftlens.operators.dedupe import first_blocks
from driftlens.operators.facts import python_facts
from driftlens.operators.locate import assignment_end_line, assignment_line
from driftlens.operators.models import reached_names
from driftlens.operators.tokens import definitions, error_position

# The patterns of the harvest strategies.
GQL_ASSIGNED = (r"^\s*\w+\s*=\s*gql\s*\(\s*(['\"]{1,3})([\s\S]*?)(\1)\s*\)", "m", 2)
GQL_CALLED = (r"gql\s*\(\s*(['\"]{1,3})([\s\S]*?)(\1)\s*\)", "", 2)
NAMED_LIKE_OPERATION = (r"^\s*(query|mutation|subscription)\s*=\s*(['\"]{1,3})([\s\S]*?)(\2)", "im", 3)
RETURNED = (r"return\s+(['\"]{1,3})(query|mutation|subscription|fragment)[\s\S]*?\1", "i")
DYNAMIC = (
    r"gql\s*\(\s*(\w+)\.query\s*\)",
    r"gql\s*\(\s*(\w+)\[\s*['\"]query['\"]\s*\]\s*\)",
    r"gql\s*\(\s*(\w+)\s*\)",
)
TAIL = r"['\"]{1,3}\s*+\)?\s*+\z"
OPERATION_NAMES = ("query", "mutation", "subscription")
RETURN_PREFIX = 7  # len("return ")

FIELDS = ("strategy", "body", "first", "last", "mode", "owner")
CANDIDATE = "array<struct<strategy:int,body:string,first:int,last:int,mode:string,owner:string>>"


def _candidate(strategy: int, body: Column, first: Column, last: Column, mode: str, owner: Column | None = None):
    return F.struct(
        F.lit(strategy).alias("strategy"),
        body.alias("body"),
        first.cast("int").alias("first"),
        last.cast("int").alias("last"),
        F.lit(mode).alias("mode"),
        (owner if owner is not None else F.lit(None).cast("string")).alias("owner"),
    )


def _quoted(source: Column, strategy: int, pattern: str, flags: str, group: int) -> Column:
    """Bodies between quotes, found by pattern, with the lines of their first and last character."""

    def place(hit: Column) -> Column:
        match = hit["match"]
        body = F.regexp_extract(match, spell(pattern, flags), group)
        tail = F.regexp_extract(match, TAIL, 0)
        # What precedes the body is what is left of the match without the body and the closing quotes.
        head = bind(
            F.struct(body.alias("body"), F.length(tail).alias("tail")),
            lambda p: F.struct(
                p["body"].alias("body"),
                newlines(
                    F.substring(match, F.lit(1), F.length(match) - F.length(p["body"]) - p["tail"])
                ).alias("lines"),
            ),
        )

        def candidate(p: Column) -> Column:
            first = hit["lines"] + 1 + p["lines"]
            return _candidate(strategy, p["body"], first, first + newlines(p["body"]), "offset")

        return bind(head, candidate)

    return F.transform(find_all(source, pattern, flags), place)


def _where_called(source: Column, found: Column) -> Column:
    """Candidates that need the word ``gql``; a text without it is not searched by pattern."""
    return F.when(source.contains("gql"), found).otherwise(F.array().cast(CANDIDATE))


def gql_assignments(source: Column) -> Column:
    """Strategy 1: ``name = gql("...")``."""
    return _where_called(source, _quoted(source, 1, *GQL_ASSIGNED))


def gql_calls(source: Column) -> Column:
    """Strategy 2: any ``gql("...")``."""
    return _where_called(source, _quoted(source, 2, *GQL_CALLED))


def operation_assignments(source: Column) -> Column:
    """Strategy 3: ``query = "..."`` and its kin."""
    return _quoted(source, 3, *NAMED_LIKE_OPERATION)


def resolved(parts: Column, bindings: Column) -> Column:
    """The string a part list stands for: names looked up, placeholders for interpolated values; null if a name is
    not bound to a string."""

    def piece(part: Column) -> Column:
        kind, text = part["kind"], part["text"]
        return (
            F.when(kind == "text", text)
            .when(kind == "name", F.try_element_at(bindings, text))
            .when(kind == "slot", F.when(text == "user_id", "1").otherwise(F.concat(F.lit("placeholder_"), text)))
            .when(kind == "member", F.lit("placeholder_value"))
            .otherwise(F.lit("placeholder"))
        )

    unbound = F.exists(parts, lambda p: (p["kind"] == "name") & F.try_element_at(bindings, p["text"]).isNull())
    return F.when(~unbound, F.array_join(F.transform(parts, piece), ""))


def literal_only(parts: Column) -> Column:
    """The string a part list stands for when all parts are literals, else null."""
    return F.when(
        F.forall(parts, lambda p: p["kind"] == "text"), F.array_join(F.transform(parts, lambda p: p["text"]), "")
    )


def without_slots(parts: Column) -> Column:
    """An interpolated string with its slots dropped; null if nothing is left."""
    texts = F.filter(parts, lambda p: p["kind"] == "text")
    return F.when(F.size(texts) > 0, F.array_join(F.transform(texts, lambda p: p["text"]), ""))


def _from_strings(facts: Column, contexts: Iterable[str], value, wanted, make) -> Column:
    """Candidates of the strings met in the given contexts.

    ``value(item)`` is the string an item stands for, ``wanted(item, value)`` sorts out, ``make(item, value)`` gives
    the candidate.
    """
    chosen = F.filter(facts["strings"], lambda s: s["ctx"].isin(*contexts))
    valued = F.transform(chosen, lambda s: F.struct(s.alias("item"), value(s).alias("value")))
    kept = F.filter(valued, lambda v: v["value"].isNotNull() & wanted(v["item"], v["value"]))
    return F.transform(kept, lambda v: make(v["item"], v["value"]))


def _value(facts: Column):
    return lambda item: resolved(item["parts"], facts["bindings"])


def assigned_strings(facts: Column) -> Column:
    """Strategy 4a: string assignments with balanced braces."""
    return _from_strings(
        facts,
        ["assign"],
        _value(facts),
        lambda item, value: balanced_braces(value),
        lambda item, value: _candidate(4, value, item["line"], item["last"], "node"),
    )


def annotated_strings(facts: Column, lines: Column) -> Column:
    """Strategy 4b: annotated assignments that are named or start like an operation, with balanced braces."""

    def make(item: Column, value: Column) -> Column:
        return bind(
            assignment_line(lines, item["name"], item["line"]),
            lambda first: _candidate(4, value, first, assignment_end_line(lines, first), "node"),
        )

    return _from_strings(
        facts,
        ["annotated"],
        _value(facts),
        lambda item, value: balanced_braces(value)
        & (F.lower(item["name"]).isin(*OPERATION_NAMES) | starts_like_operation(value)),
        make,
    )


def returned_strings(facts: Column) -> Column:
    """Strategy 4c: returned strings that start like an operation, and ``return gql(...)``."""
    return _from_strings(
        facts,
        ["return", "return_gql"],
        _value(facts),
        lambda item, value: (item["ctx"] == "return_gql") | starts_like_operation(value),
        lambda item, value: _candidate(4, value, item["first"], item["last"], "node"),
    )


def returned_fallback(facts: Column, source: Column) -> Column:
    """Strategy 4 for a file that is not valid Python: returned strings by pattern."""

    def make(hit: Column) -> Column:
        body = F.substring(hit["match"], F.lit(RETURN_PREFIX + 1), F.length(hit["match"]))
        first = hit["lines"] + 1
        return _candidate(4, body, first, first + newlines(hit["match"]), "node")

    return F.when(facts["error"].isNotNull(), F.transform(find_all(source, *RETURNED), make)).otherwise(
        F.array().cast(CANDIDATE)
    )


def dynamic_queries(facts: Column, source: Column) -> Column:
    """Strategy 5: ``gql(name)``, ``gql(name.query)`` and ``gql(name['query'])`` with a name bound to an operation."""

    def scan(pattern: str) -> Column:
        def make(hit: Column) -> Column:
            name = F.regexp_extract(hit["match"], spell(pattern), 1)
            value = F.try_element_at(facts["bindings"], name)
            first = hit["lines"] + 1
            return _candidate(
                5, F.when(starts_like_operation(value), value), first, first + newlines(hit["match"]), "node"
            )

        return F.transform(find_all(source, pattern), make)

    return _where_called(source, F.filter(F.concat(*[scan(p) for p in DYNAMIC]), lambda c: c["body"].isNotNull()))


def class_strings(facts: Column) -> Column:
    """Strategy 6, before it is known which classes are models: class fields whose value starts like an operation."""
    return _from_strings(
        facts,
        ["field"],
        _value(facts),
        lambda item, value: starts_like_operation(value),
        lambda item, value: _candidate(6, value, item["first"], item["last"], "node", item["owner"]),
    )


def concatenated_strings(facts: Column) -> Column:
    """Strategy 7: concatenated literals and interpolated strings anywhere that start like an operation."""

    def value(item: Column) -> Column:
        return F.when(item["ctx"] == "concat", literal_only(item["parts"])).otherwise(without_slots(item["parts"]))

    return _from_strings(
        facts,
        ["concat", "fstring"],
        value,
        lambda item, value: starts_like_operation(value),
        lambda item, value: _candidate(7, value, item["line"], item["last"], "node"),
    )


def read_python(files: DataFrame) -> DataFrame:
    """What Python files hold, one row per file without its text: candidate operation texts, classes, imports, and
    the text itself only if it is not valid Python."""
    source, facts = F.col("source"), F.col("facts")
    read = files.filter(F.col("ext") == "py").withColumn("facts", python_facts(source))

    def search(lines: Column) -> Column:
        found = F.concat(
            gql_assignments(source),
            gql_calls(source),
            operation_assignments(source),
            assigned_strings(facts),
            annotated_strings(facts, lines),
            returned_strings(facts),
            returned_fallback(facts, source),
            dynamic_queries(facts, source),
            class_strings(facts),
            concatenated_strings(facts),
        )

        def with_error_line(c: Column) -> Column:
            at = F.coalesce(error_position(lines, c["first"], c["body"]), c["first"]).cast("int")
            return F.struct(*[c[name].alias(name) for name in FIELDS], at.alias("error_line"))

        return F.transform(found, with_error_line)

    return read.select(
        "file",
        bind(F.split(source, "\n", -1), search).alias("found"),
        facts["classes"].alias("classes"),
        facts["imports"].alias("imports"),
        facts["error"].alias("error"),
        F.when(facts["error"].isNotNull(), source).alias("broken"),
    )


def candidates(python: DataFrame) -> DataFrame:
    """Candidate texts of files read by ``read_python``, all strategies, one row each."""
    return python.select("file", F.posexplode("found").alias("seq", "c")).select(
        "file",
        F.col("c.strategy").alias("strategy"),
        "seq",
        F.col("c.body").alias("body"),
        F.col("c.first").alias("start_line"),
        F.col("c.last").alias("end_line"),
        F.col("c.mode").alias("mode"),
        F.col("c.error_line").alias("error_line"),
        F.col("c.owner").alias("owner"),
    )


def document_candidates(files: DataFrame, exact_lines: bool = False) -> DataFrame:
    """Standalone operation files: the whole text is one document.

    By default lines are counted as for string values, which puts definitions of texts that span lines one line
    further down; ``exact_lines`` gives their true lines.
    """
    return files.filter(F.col("ext") != "py").select(
        "file",
        F.lit(0).alias("strategy"),
        F.lit(0).alias("seq"),
        F.col("source").alias("body"),
        F.lit(1).alias("start_line"),
        (newlines(F.col("source")) + 1).cast("int").alias("end_line"),
        F.lit("document" if exact_lines else "node").alias("mode"),
        F.lit(1).alias("error_line"),
        F.lit(None).cast("string").alias("owner"),
    )


def model_candidates(python: DataFrame) -> DataFrame:
    """Candidate texts without the class fields whose class does not reach a model root; told inside the row."""
    # Most files hold no class; theirs are not looked up.
    reached = F.when(F.size("classes") > 0, reached_names(F.col("classes"), F.col("imports"))).otherwise(F.array().cast("array<string>"))
    kept = F.filter("found", lambda c: c["owner"].isNull() | F.array_contains("reached", c["owner"]))
    return candidates(python.withColumn("reached", reached).withColumn("found", kept))


def blocks(found: DataFrame) -> DataFrame:
    """Deduplicated operation blocks of candidate texts."""
    return first_blocks(definitions(found))
