"""Differences between two versions of the schema catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators.catalog import NO_REASON, in_version, is_deprecated
from driftlens.session import stage

# Parts a type's fields are dealt to where they meet its status.
PARTS = 16
COUNTERS = ("removed_types", "added_types", "removed_fields", "added_fields", "deprecated_fields")


def type_diff(types: DataFrame, old: str, new: str) -> DataFrame:
    """``(schema, type_name, status)``; status is removed, added or common. One pass, one shuffle."""
    return (
        types.filter(F.col("version").isin(old, new))
        .groupBy("schema", "type_name")
        .agg(
            F.bool_or(F.col("version") == old).alias("in_old"),
            F.bool_or(F.col("version") == new).alias("in_new"),
        )
        .select(
            "schema",
            "type_name",
            F.when(~F.col("in_new"), "removed").when(~F.col("in_old"), "added").otherwise("common").alias("status"),
        )
    )


def removed_types(types: DataFrame, old: str, new: str) -> DataFrame:
    return type_diff(types, old, new).filter("status = 'removed'").drop("status")


def added_types(types: DataFrame, old: str, new: str) -> DataFrame:
    return type_diff(types, old, new).filter("status = 'added'").drop("status")


def common_types(types: DataFrame, old: str, new: str) -> DataFrame:
    return type_diff(types, old, new).filter("status = 'common'").drop("status")


def diff_rows(types: DataFrame, fields: DataFrame, old: str, new: str) -> DataFrame:
    """Types and fields with what becomes of them: ``schema, type_name, field_name, is_type, status, type_status, is_deprecated, reason``.

    ``status`` is removed, added or kept; ``is_deprecated`` and ``reason`` are the old field's. Types and fields of both
    versions meet in one grouping. A field learns its type's status in a window over the type and a part of its fields: a
    root type has as many fields as the schema has entry points, so its fields are dealt to ``PARTS`` parts, to each of
    which the type's own row goes.
    """
    is_old = F.col("version") == old
    bit = F.when(is_old, 1).otherwise(2).alias("bit")
    nothing = F.lit(None).cast("string")
    rows = types.filter(F.col("version").isin(old, new)).select(
        "schema", "type_name", nothing.alias("field_name"), F.lit(True).alias("is_type"), bit, F.lit(False).alias("flag"), nothing.alias("reason")
    ).unionByName(
        fields.filter(F.col("version").isin(old, new)).select(
            "schema", "type_name", "field_name", F.lit(False).alias("is_type"), bit, (is_old & is_deprecated()).alias("flag"),
            F.when(is_old, F.col("deprecation_reason")).alias("reason"),
        )
    )
    merged = rows.groupBy("schema", "type_name", "field_name", "is_type").agg(
        F.bit_or("bit").alias("has"), F.bool_or("flag").alias("is_deprecated"), F.max("reason").alias("reason")
    )
    every = F.sequence(F.lit(0), F.lit(PARTS - 1))
    own = F.array(F.pmod(F.xxhash64("field_name"), F.lit(PARTS)).cast("int"))
    dealt = merged.select("*", F.explode(F.when(F.col("is_type"), every).otherwise(own)).alias("part"))
    of_type = F.max(F.when(F.col("is_type"), F.col("has"))).over(Window.partitionBy("schema", "type_name", "part"))
    dealt = dealt.withColumn("type_has", of_type).filter("NOT is_type OR part = 0")
    named = lambda c: F.when(c == 1, "removed").when(c == 2, "added").when(c == 3, "kept")
    return dealt.select(
        "schema", "type_name", "field_name", "is_type", named(F.col("has")).alias("status"), named(F.col("type_has")).alias("type_status"),
        "is_deprecated", F.when(F.col("is_deprecated"), F.coalesce(F.nullif("reason", F.lit("")), F.lit(NO_REASON))).alias("reason"),
    )


def field_diff(types: DataFrame, fields: DataFrame, old: str, new: str) -> DataFrame:
    """Fields of types both versions have: ``status`` is removed, added or kept; ``is_deprecated`` and ``reason``
    are the old field's."""
    rows = diff_rows(types, fields, old, new).filter("NOT is_type AND type_status = 'kept'")
    return rows.select("schema", "type_name", "field_name", "status", "is_deprecated", "reason")


def deprecated_in_common(types: DataFrame, fields: DataFrame, old: str, new: str) -> DataFrame:
    """Deprecated fields of the old version in types both versions have."""
    return field_diff(types, fields, old, new).filter("is_deprecated").select(
        "schema", "type_name", "field_name", "reason"
    )


def changes(types: DataFrame, fields: DataFrame, old: str, new: str) -> DataFrame:
    """Every change as a row ``(schema, change, type_name, field_name, reason)``."""
    marks = F.filter(F.array(*[F.when(test, name) for name, test in _tests().items()]), lambda mark: mark.isNotNull())
    rows = diff_rows(types, fields, old, new).select("schema", F.explode(marks).alias("change"), "type_name", "field_name", "reason")
    return rows.withColumn("reason", F.when(F.col("change") == "deprecated_fields", F.col("reason")))


def _tests() -> dict[str, Column]:
    """What makes a row of ``diff_rows`` a change of each kind; fields count in types that both versions have."""
    is_type, status = F.col("is_type"), F.col("status")
    common = ~is_type & (F.col("type_status") == "kept")
    return {
        "removed_types": is_type & (status == "removed"),
        "added_types": is_type & (status == "added"),
        "removed_fields": common & (status == "removed"),
        "added_fields": common & (status == "added"),
        "deprecated_fields": common & F.col("is_deprecated"),
    }


def evolution_counts(types: DataFrame, fields: DataFrame, old: str, new: str) -> DataFrame:
    """Per schema the five counters of the evolution summary."""
    tests = _tests()
    rows = diff_rows(types, fields, old, new).filter("type_status IS NOT NULL")
    return rows.groupBy("schema").agg(*[F.count_if(F.coalesce(tests[c], F.lit(False))).cast("bigint").alias(c) for c in COUNTERS])


def type_counts(types: DataFrame) -> DataFrame:
    """Number of types per schema and version."""
    return types.groupBy("schema", "version").agg(F.count("*").alias("n_types"))


def field_counts(fields: DataFrame, old: str, new: str) -> DataFrame:
    """Number of fields per schema in both versions, with the signed difference."""
    counted = fields.groupBy("schema").agg(
        F.count_if(F.col("version") == old).alias("old_fields"),
        F.count_if(F.col("version") == new).alias("new_fields"),
    )
    return counted.withColumn("difference", F.format_string("%+d", F.col("new_fields") - F.col("old_fields")))


def type_change_counts(types: DataFrame, fields: DataFrame, old: str, new: str) -> DataFrame:
    """Number of changed fields per schema, change and type; null for changes of types themselves.

    The names stay rows of ``changes``: a root type has as many fields as the schema has entry points, so they are
    never gathered into one list.
    """
    return changes(types, fields, old, new).groupBy("schema", "change", "type_name").agg(
        F.count("field_name").alias("n_fields")
    )


def detail_totals(types: DataFrame, fields: DataFrame, old: str, new: str) -> DataFrame:
    """Totals of the detail report per schema and change."""
    return changes(types, fields, old, new).groupBy("schema", "change").agg(F.count("*").alias("total"))


# What the report says above its sections, in their order, and in its summary.
SECTIONS = {
    "removed_types": "\n❌ Removed types in ",
    "added_types": "\n✅ Added types in ",
    "removed_fields": "\n❌ Removed fields in ",
    "added_fields": "\n✅ Added fields in ",
    "deprecated_fields": "\n⚠️  Deprecated fields in ",
}
SUMMARY = ("removed_fields", "added_fields", "deprecated_fields", "removed_types", "added_types")
REPORT_ORDER = ("schema", "section", "type_name", "ord", "field_name")


def report_lines(types: DataFrame, fields: DataFrame, old: str, new: str) -> DataFrame:
    """The analysis report as rows ``(schema, section, type_name, ord, field_name, line)``; those columns but the last
    are its order, nulls first.

    Rows stay rows: the report is as long as the number of changes, so nothing is collected into one value. Headings
    of sections and types come along with each change and collapse before the shuffle.
    """
    found = stage(changes(types, fields, old, new), "changes")
    numbers = {change: i + 1 for i, change in enumerate(SECTIONS)}
    section, heading = F.lit(None).cast("int"), F.lit(None).cast("string")
    for change, words in SECTIONS.items():
        section = F.when(F.col("change") == change, numbers[change]).otherwise(section)
        heading = F.when(F.col("change") == change, F.concat(F.lit(words), "schema", F.lit(":"))).otherwise(heading)
    line = (
        F.when(F.col("field_name").isNull(), F.concat(F.lit("  - "), "type_name"))
        .when(F.col("change") == "deprecated_fields", F.concat(F.lit("    - "), "field_name", F.lit(": "), "reason"))
        .otherwise(F.concat(F.lit("    - "), "field_name"))
    )

    def row(number, type_name, place, field_name, text):
        text_or_null = lambda c: F.lit(c).cast("string") if c is None else c
        return F.struct(
            number.cast("int").alias("section"), text_or_null(type_name).alias("type_name"), F.lit(place).alias("ord"),
            text_or_null(field_name).alias("field_name"), text.alias("line"),
        )

    of_type = F.when(F.col("field_name").isNotNull(), row(section, F.col("type_name"), 0, None, F.concat(F.lit("  "), "type_name", F.lit(":"))))
    rows = F.array_compact(F.array(row(section, None, 0, None, heading), of_type, row(section, F.col("type_name"), 1, F.col("field_name"), line)))
    body = found.select("schema", F.inline(rows)).distinct()

    totals = [F.count_if(F.col("change") == change).alias(change) for change in SUMMARY]
    schemas = types.filter(F.col("version").isin(old, new)).select("schema").distinct()
    counted = schemas.join(found.groupBy("schema").agg(*totals), "schema", "left")
    lines = [
        row(F.lit(0), None, 0, None, F.concat(F.lit("\n🏢 "), "schema", F.lit(" Schema Analysis"))),
        row(F.lit(0), None, 1, None, F.lit("-" * 30)),
        row(F.lit(len(SECTIONS) + 1), None, 0, None, F.concat(F.lit("\n📈 "), "schema", F.lit(" Summary:"))),
    ]
    for i, change in enumerate(SUMMARY):
        what = F.lit(f"  - {change.replace('_', ' ').capitalize()}: ")
        lines.append(row(F.lit(len(SECTIONS) + 1), None, i + 1, None, F.concat(what, F.coalesce(change, F.lit(0)).cast("string"))))
    frame = counted.select("schema", F.inline(F.array(*lines)))
    return body.unionByName(frame).select(*REPORT_ORDER, "line")
