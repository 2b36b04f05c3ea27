"""Results as files: JSON rows, report lines, ``file:line:column`` issue lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.operators.evolution import REPORT_ORDER


def write_json(results: DataFrame, path: str) -> None:
    """Nested file results as JSON lines."""
    results.write.mode("overwrite").json(path)


def issue_line() -> Column:
    """``file:line:column: level: message``, a question mark for what is missing."""
    def known(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("?"))

    return F.format_string(
        "%s:%s:%s: %s: %s",
        known("file"), known("line"), known("column"), F.col("level"), F.coalesce("message", F.lit("")),
    )


def write_issue_lines(issues: DataFrame, path: str) -> None:
    """Issues as text, in file and line order."""
    issues.orderBy("file", "line", "column").select(issue_line().alias("value")).write.mode("overwrite").text(path)


def write_report(lines: DataFrame, path: str) -> None:
    """The rows of ``evolution.report_lines`` as text, in the report's order."""
    order = [F.col(name).asc_nulls_first() for name in REPORT_ORDER]
    lines.orderBy(*order).select(F.col("line").alias("value")).write.mode("overwrite").text(path)
