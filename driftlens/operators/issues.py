"""Issue tables: categories, counts, fixes, listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.session import stage

# The categories in the order in which they are tried, with the tags each of them takes.
CATEGORY_TAGS = {
    "DEPRECATED": ("DEPRECATED",),
    "REMOVED": ("REMOVED",),
    "ADDED": ("ADDED",),
    "GRAPHQL_VALIDATION": (
        "GRAPHQL_VALIDATION", "GRAPHQL_NON_EXISTENT_FIELD", "GRAPHQL_INVALID_ARGUMENT", "GRAPHQL_INVALID_ID",
        "GRAPHQL_INVALID_DIRECTIVE", "GRAPHQL_INVALID_FRAGMENT", "GRAPHQL_UNNAMED_OPERATION", "GRAPHQL_SYNTAX",
    ),
    "PYDANTIC_CONSTRAINT": ("PYDANTIC_CONSTRAINT",),
    "PYDANTIC_REQUIRED_FIELD": ("PYDANTIC_REQUIRED_FIELD",),
    "PYDANTIC_COMPLEX_TYPE": ("PYDANTIC_COMPLEX_TYPE",),
    "PYDANTIC_OPTIONAL": ("PYDANTIC_OPTIONAL",),
}
OTHER = "OTHER"
CATEGORIES = (*CATEGORY_TAGS, OTHER)

# What to advise. A tag's row is used if all its words stand in the message; the first row wins.
FIXES = (
    ("DEPRECATED", ("email", "defaultEmailAddress.emailAddress"),
     "Replace 'email' field with 'defaultEmailAddress.emailAddress'"),
    ("DEPRECATED", ("emailMarketingConsent",),
     "Replace 'emailMarketingConsent' with 'defaultEmailAddress.marketingState', "
     "'defaultEmailAddress.marketingOptInLevel', etc."),
    ("DEPRECATED", ("userErrors",), "Replace 'userErrors' with 'customerUserErrors'"),
    ("DEPRECATED", (), "Replace with the suggested alternative field from the deprecation message"),
    ("REMOVED", (), "Remove this field as it no longer exists in the schema"),
    ("ADDED", (), "This field is new - consider if you need to handle it"),
    ("GRAPHQL_VALIDATION", ("has sub-selection",),
     "Remove sub-selection from scalar field or add sub-selection to object field"),
    ("GRAPHQL_VALIDATION", ("Invalid syntax",),
     "Fix GraphQL syntax error - check for missing field names or invalid structure"),
    ("GRAPHQL_VALIDATION", ("Inline fragment",), "Verify inline fragment type compatibility with parent context"),
    ("GRAPHQL_VALIDATION", ("Operation must have a name",), "Add a name to the GraphQL operation"),
    ("GRAPHQL_VALIDATION", (), "Review the GraphQL query/mutation for syntax or schema issues"),
    ("PYDANTIC_CONSTRAINT", (), "Review and verify the constraint values are appropriate for your use case"),
    ("PYDANTIC_REQUIRED_FIELD", (), "Add default value or make field optional if appropriate"),
    ("PYDANTIC_COMPLEX_TYPE", (), "Verify type compatibility and ensure proper imports"),
    ("PYDANTIC_OPTIONAL", (), "Consider adding a default value for optional fields"),
    ("MISSING_REQUIRED_ARG", (), "Add the required argument to the field"),
    ("TYPE_MISMATCH", (), "Fix the data type to match the schema definition"),
)
NO_FIX = "Review the code for the specific issue mentioned in the error"

PREVIEW_LINES = {"file model": 15, "file block": 10, "block": 10, "model": 8}


def category(message: Column) -> Column:
    """The category of an issue: the first one with a tag that stands in the message."""
    found = F.lit(OTHER)
    for name, tags in reversed(CATEGORY_TAGS.items()):
        test = F.lit(False)
        for tag in tags:
            test = test | message.contains(f"[{tag}]")
        found = F.when(test, name).otherwise(found)
    return found


def label(name: Column) -> Column:
    """A category as a heading."""
    return F.initcap(F.lower(F.replace(name, F.lit("_"), F.lit(" "))))


def fix(message: Column) -> Column:
    """The advice for an issue."""
    found = F.lit(NO_FIX)
    for tag, words, advice in reversed(FIXES):
        test = message.contains(f"[{tag}]")
        for word in words:
            test = test & message.contains(word)
        found = F.when(test, advice).otherwise(found)
    return found


def category_counts(issues: DataFrame) -> DataFrame:
    """Number of issues per category, zero for the ones without any.

    Every category brings one empty mark along, taken off again by not counting it.
    """
    spark = issues.sparkSession
    marks = spark.createDataFrame([(name, 0) for name in CATEGORIES], "category string, one int")
    counted = issues.select(category(F.col("message")).alias("category"), F.lit(1).alias("one")).unionByName(marks)
    return counted.groupBy("category").agg(F.sum("one").cast("bigint").alias("n")).select(
        "category", label(F.col("category")).alias("label"), "n"
    )


def by_category(issues: DataFrame) -> DataFrame:
    """Issues with their category; rows stay rows, so a large category spreads over many tasks."""
    return issues.withColumn("category", category(F.coalesce("message", F.lit(""))))


def suggestions(issues: DataFrame) -> DataFrame:
    """What to do about each issue."""
    message = F.coalesce("message", F.lit(""))
    return issues.select(
        F.coalesce("file", F.lit("")).alias("file"), "line", "column", message.alias("issue"), fix(message).alias("fix")
    )


def in_order(listed: DataFrame) -> DataFrame:
    """Suggestions by file and line."""
    return listed.orderBy("file", F.coalesce(F.col("line").try_cast("int"), F.lit(0)), "column", "issue")


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """1-based position of each row within its file, by ``order``; a file may hold any share of the rows.

    The rows are sorted into ranges of file and order, a hot file over many ranges. They are numbered inside their
    range, and the rows the file has in the ranges before are added: one number per file and range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stage(rows.repartitionByRange(ranges, "file", *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = ranged.groupBy("file", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("file").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        F.col("file").alias("_file"), F.col("_range").alias("_in"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy("file", "_range").orderBy(*order)
    return (
        ranged.withColumn("_i", F.row_number().over(inside))
        .join(starts, F.col("file").eqNullSafe(F.col("_file")) & (F.col("_range") == F.col("_in")))
        .withColumn("position", F.col("_i") + F.col("_before"))
        .drop("_range", "_i", "_before", "_file", "_in")
    )


def preview(raw: Column, lines: int) -> tuple[Column, Column]:
    """The first lines of a text and the number of lines left out."""
    parts = F.split(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\n\z", ""), "\n", -1)
    return (
        F.array_join(F.slice(parts, 1, lines), "\n"),
        F.greatest(F.size(parts) - lines, F.lit(0)),
    )


def totals(blocks: DataFrame, models: DataFrame) -> DataFrame:
    """Files with content, blocks and models, in one row."""
    both = blocks.select("file", F.lit(1).alias("b"), F.lit(0).alias("m")).unionByName(
        models.select("file", F.lit(0).alias("b"), F.lit(1).alias("m"))
    )
    per_file = both.groupBy("file").agg(F.sum("b").alias("b"), F.sum("m").alias("m"))
    return per_file.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("b"), F.lit(0)).alias("blocks"),
        F.coalesce(F.sum("m"), F.lit(0)).alias("models"),
    )


def counts_by_type(blocks: DataFrame) -> DataFrame:
    """Blocks per kind."""
    return blocks.groupBy("type").agg(F.count("*").alias("n"))
