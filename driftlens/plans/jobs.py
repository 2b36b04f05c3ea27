"""Whole jobs: harvest, schema report, drift check, surface checks, listings."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlens.operators import evolution, harvest, issues, lint, surface, syntax, usage
from driftlens.operators.catalog import drift_lookup
from driftlens.operators.dedupe import first_models, marked_blocks
from driftlens.operators.models import models as find_models
from driftlens.operators.tokens import definitions
from driftlens.session import stage

ISSUE = ["file", "line", "column", "level", "message"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


class Harvest:
    """What a corpus holds. ``blocks`` and ``models`` are deduplicated tables; ``defined`` keeps repeats. Models are looked for when
    they are first asked for."""

    def __init__(self, files: DataFrame, exact_lines: bool = False):
        self.python = stage(harvest.read_python(files), "python")
        self.all_models = find_models(self.python)
        found = harvest.model_candidates(self.python)
        found = found.unionByName(harvest.document_candidates(files, exact_lines))
        # Written once: the definitions, and which of them are the blocks.
        marked = stage(marked_blocks(definitions(found)), "definitions")
        self.defined = marked.drop("is_first")
        self.blocks = marked.filter("is_first").drop("is_first")

    @cached_property
    def models(self) -> DataFrame:
        return stage(first_models(self.all_models), "models")

    def nested(self) -> DataFrame:
        """File results: ``(file, graphql, pydantic_models)``, for files that hold anything.

        The lists hold one file's own entries, in the order of their lines.
        """
        blocks = self.blocks.groupBy("file").agg(
            F.array_sort(
                F.collect_list(
                    F.struct(
                        "start_line", "seq", "type", "name", "variables", "type_condition", "raw", "end_line", "error"
                    )
                )
            ).alias("graphql")
        )
        models = self.models.groupBy("file").agg(
            F.array_sort(
                F.collect_list(F.struct("start_line", "model_name", "type", "raw", "end_line", "error"))
            ).alias("pydantic_models")
        )
        return blocks.join(models, "file", "full_outer")


def schema_report(types: DataFrame, fields: DataFrame, old: str, new: str) -> DataFrame:
    """Evolution counters and field counts per schema."""
    return evolution.evolution_counts(types, fields, old, new).join(
        evolution.field_counts(fields, old, new), "schema", "left"
    )


def usage_drift(
    blocks: DataFrame, types: DataFrame, fields: DataFrame, old: str, new: str,
    args: DataFrame | None = None, inputs: DataFrame | None = None, **options,
) -> DataFrame:
    """Drift issues of harvested blocks; with the old version's arguments and input fields, deprecated input fields as well."""
    found = usage.usage_drift(blocks, types, fields, old, new, **options)
    if args is None or inputs is None:
        return found
    flagged = usage.deprecated_inputs(blocks, types, args, inputs, old, named_roots=options.get("named_roots"))
    return found.unionByName(flagged, allowMissingColumns=True)


def parse_issues(blocks: DataFrame, detailed: bool = False) -> DataFrame:
    """Blocks that do not parse; ``detailed`` tells the first wrong token, its place and what was expected there."""
    bad = blocks.filter(F.col("error").isNotNull())
    if not detailed:
        return bad.select(
            "file",
            F.col("start_line").alias("line"),
            F.lit(1).alias("column"),
            F.lit("error").alias("level"),
            F.concat(F.lit("[GRAPHQL_VALIDATION] GraphQL parsing error: "), "error").alias("message"),
        )
    # Each different text is read once, whatever the number of files that hold it.
    text = F.coalesce("raw", F.lit(""))
    texts = bad.select(F.sha2(text, 256).alias("_text_id"), text.alias("_raw")).dropDuplicates(["_text_id"])
    places = syntax.syntax_errors(texts, "_text_id", "_raw")
    return bad.select("file", "start_line", F.sha2(text, 256).alias("_text_id")).join(places, "_text_id").select(
        "file",
        (F.col("start_line") + F.col("at_line") - 1).cast("int").alias("line"),
        F.col("at_col").alias("column"),
        F.lit("error").alias("level"),
        F.concat(F.lit("[GRAPHQL_PARSE] "), "problem").alias("message"),
    )


def file_issues(bad_files: DataFrame) -> DataFrame:
    """Files that could not be read; ``problem`` says why, without it their text is not valid UTF-8."""
    why = F.col("problem") if "problem" in bad_files.columns else F.lit("the text is not valid UTF-8")
    return bad_files.select(
        "file",
        F.lit(1).alias("line"),
        F.lit(1).alias("column"),
        F.lit("error").alias("level"),
        F.concat(F.lit("[VALIDATION_ERROR] File processing error: "), why).alias("message"),
    )


def surface_lint(blocks: DataFrame, models: DataFrame, bad_files: DataFrame | None = None) -> DataFrame:
    """Pattern rules over blocks and models, blocks that do not parse, and files that could not be read; no schema needed."""
    good = blocks.filter(F.col("error").isNull())
    parts = [
        parse_issues(blocks),
        lint.lint_operations(good, ["file"]).select(*ISSUE),
        lint.lint_models(models, ["file"]).select(*ISSUE),
    ]
    if bad_files is not None:
        parts.append(file_issues(bad_files))
    return _union(parts)


def surface_check(
    blocks: DataFrame,
    models: DataFrame,
    types: DataFrame,
    fields: DataFrame,
    args: DataFrame,
    old: str,
    new: str,
    defined: DataFrame | None = None,
    bad_files: DataFrame | None = None,
) -> DataFrame:
    """Surface checks against the old schema, with drift issues, pattern rules, model rules and unreadable files.

    Pattern rules look at texts that do not parse as well. ``defined`` holds the definitions with their repeats, where
    operations without a name are looked for; without it the blocks do.
    """
    rooted = stage(usage.rooted_blocks(blocks, types, fields, old), "rooted")
    every = stage(usage.block_selections(rooted), "selections")
    drift = stage(usage.drift_of(every, types, fields, old, new), "drift")
    found = surface.client_selections(every)
    checked = argument_check(found, types, fields, args, old)
    parts = [
        surface.classified(checked).select(*ISSUE),
        surface.missing_fragment_types(found, types, old),
        surface.missing_fragment_fields(found, types, fields, old),
        parse_issues(blocks, detailed=True),
        lint.lint_operations(rooted, ["file"]).select(*ISSUE),
        surface.unnamed_operations(blocks if defined is None else defined),
    ]
    if bad_files is not None:
        parts.append(file_issues(bad_files))
    general = surface.override(_union(parts), drift)
    return _union([drift.select(*ISSUE), general.select(*ISSUE), lint.lint_models(models, ["file"]).select(*ISSUE)])


def argument_check(
    found: DataFrame, types: DataFrame, fields: DataFrame, args: DataFrame, version: str
) -> DataFrame:
    """Unknown fields, unknown arguments and missing arguments of the selections ``found``."""
    lookup = stage(drift_lookup(types, fields, version, version), "lookup")
    uses = found.filter("kind = 'field' AND root IS NOT NULL")
    resolved = usage.resolve_paths(uses, lookup).select(
        "client", "root", "path", "name", "type_name",
        F.coalesce(F.col("new.field_name") == F.col("name"), F.lit(False)).alias("known"),
    )
    objects = fields.filter(F.col("version") == version).select(
        F.col("schema").alias("client"), "type_name"
    ).distinct().withColumn("is_object", F.lit(True))
    resolved = resolved.join(objects, ["client", "type_name"], "left").withColumn(
        "is_object", F.coalesce("is_object", F.lit(False))
    ).filter("known OR is_object")
    placed = uses.join(resolved, ["client", "root", "path", "name"])
    return surface.argument_issues(placed, surface.given_arguments(found), args, version)


def validation(parts: list[DataFrame]) -> DataFrame:
    """All issues of several checks, each once."""
    return _union([p.select(*ISSUE) for p in parts]).dropDuplicates(ISSUE)


def dry_run(found: DataFrame) -> DataFrame:
    """Numbered suggestions per file, in line order."""
    return issues.numbered(issues.suggestions(found), ["line", "column", "issue", "fix"])


def extraction_summary(blocks: DataFrame) -> DataFrame:
    """Numbered blocks per file with the first lines of their text."""
    shown, left_out = issues.preview(F.col("raw"), issues.PREVIEW_LINES["block"])
    rows = blocks.select(
        "file", "type", F.coalesce("name", F.lit("None")).alias("name"), "start_line", "end_line", "seq",
        shown.alias("shown"), left_out.alias("left_out"),
    )
    return issues.numbered(rows, ["start_line", "seq", "type", "name"]).drop("seq")
