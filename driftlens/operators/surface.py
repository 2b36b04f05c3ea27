"""Checks of operation texts against one schema: what the joins can tell about arguments, fields and fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlens.operators.catalog import in_version
from driftlens.operators.usage import BLOCK_KEY, CLIENTS, UNKNOWN

# Error kinds in the order in which they are tried. Each row: the kind, words that must all stand in
# the lower-case message, and words of which one must.
ERROR_KINDS = (
    ("DEPRECATED", ("deprecated",), ()),
    ("REMOVED", ("does not exist",), ()),
    ("MISSING_REQUIRED_ARG", ("required", "argument"), ()),
    ("EXTRA_FIELD", ("unknown argument",), ()),
    ("INVALID_FRAGMENT", ("cannot be applied", "fragment"), ()),
    ("TYPE_MISMATCH", ("type",), ("expected", "cannot be")),
    ("INVALID_OPERATION", ("operation",), ("unnamed", "invalid")),
)
OTHER_KIND = "GRAPHQL_VALIDATION"
ERRORS = ("REMOVED", "MISSING_REQUIRED_ARG", "TYPE_MISMATCH", "INVALID_OPERATION")
META_FIELDS = ("__typename", "__schema", "__type")


def error_kind(message: Column) -> Column:
    """The kind of a validation message."""
    low = F.lower(message)
    found = F.lit(OTHER_KIND)
    for kind, every, some in reversed(ERROR_KINDS):
        test = F.lit(True)
        for word in every:
            test = test & low.contains(word)
        if some:
            one = F.lit(False)
            for word in some:
                one = one | low.contains(word)
            test = test & one
        found = F.when(test, kind).otherwise(found)
    return found


def error_level(kind: Column) -> Column:
    return F.when(kind.isin(*ERRORS), "error").otherwise("warning")


def classified(messages: DataFrame) -> DataFrame:
    """Validation messages ``(message, ...)`` with kind, level and the kind as a tag."""
    kind = error_kind(F.col("message"))
    return messages.select(
        *[c for c in messages.columns if c != "message"],
        kind.alias("kind"),
        error_level(kind).alias("level"),
        F.concat(F.lit("["), kind, F.lit("] "), "message").alias("message"),
    )


def schema_client(client: Column) -> Column:
    """The schema a block is checked against: its client's, the first one if that is not known."""
    return F.when(client == UNKNOWN, CLIENTS[0]).otherwise(client)


def unnamed_operations(definitions: DataFrame) -> DataFrame:
    """Operations without a name in a text with more than one operation.

    ``definitions`` are the rows of ``tokens.definitions``; a text is ``(file, strategy, seq)``.
    """
    text = Window.partitionBy("file", "strategy", "seq")
    operations = definitions.filter(F.col("type").isin("query", "mutation", "subscription"))
    return (
        operations.withColumn("n", F.count("*").over(text))
        .filter("n > 1 AND name IS NULL")
        .select(
            "file",
            F.col("start_line").alias("line"),
            F.lit(1).alias("column"),
            F.lit("error").alias("level"),
            F.lit("[INVALID_OPERATION] Unnamed operation in multi-operation file").alias("message"),
        )
    )


def _conditions(found: DataFrame) -> DataFrame:
    """Type conditions in use, once per client."""
    return (
        found.filter("kind = 'inline' AND type_condition IS NOT NULL")
        .select(F.col("client").alias("schema"), F.col("type_condition").alias("type_name"))
        .distinct()
    )


def _below_missing(found: DataFrame, missing: DataFrame) -> DataFrame:
    """Distinct ``(client, path)`` that lead through a type condition the schema does not have."""
    steps = (
        found.filter(F.col("path").contains(":"))
        .select("client", "path")
        .distinct()
        .select("client", "path", F.explode(F.split("path", "/")).alias("step"))
        .filter("step LIKE ':%'")
        .select(F.col("client").alias("schema"), "path", F.substring("step", F.lit(2), F.length("step")).alias("type_name"))
    )
    return steps.join(missing, ["schema", "type_name"], "left_semi").select(
        F.col("schema").alias("client"), "path"
    ).distinct()


def missing_fragment_types(found: DataFrame, types: DataFrame, version: str) -> DataFrame:
    """Inline fragments on a type the schema does not have, unless they stand inside another such fragment.

    ``found``: selections with ``client``, ``start_line`` and ``path`` as text.
    """
    known = in_version(types, version).select("schema", "type_name")
    missing = _conditions(found).join(known, ["schema", "type_name"], "left_anti")
    inline = found.filter("kind = 'inline'").join(
        missing.select(F.col("schema").alias("client"), F.col("type_name").alias("type_condition")),
        ["client", "type_condition"],
        "left_semi",
    )
    return inline.join(_below_missing(found, missing), ["client", "path"], "left_anti").select(
        "file",
        (F.col("start_line") + F.col("line")).cast("int").alias("line"),
        F.lit(1).alias("column"),
        F.lit("error").alias("level"),
        F.concat(
            F.lit("[INVALID_FRAGMENT] Type '"), "type_condition", F.lit("' does not exist in schema")
        ).alias("message"),
    )


def missing_fragment_fields(found: DataFrame, types: DataFrame, fields: DataFrame, version: str) -> DataFrame:
    """Fields directly inside an inline fragment that its type does not have."""
    known = in_version(types, version).select("schema", "type_name")
    held = in_version(fields, version).select(
        F.col("schema").alias("client"), F.col("type_name").alias("parent"), F.col("field_name").alias("name")
    )
    missing = _conditions(found).join(known, ["schema", "type_name"], "left_anti")
    # Few paths hold a type condition; the others are not searched by pattern.
    inside = found.filter((F.col("kind") == "field") & F.col("path").contains(":") & ~F.col("name").isin(*META_FIELDS)).withColumn(
        "parent", F.regexp_extract("path", r"(?:^|/):([^/]+)\z", 1)
    ).filter("parent <> ''")
    # The question is asked once per type and field, not once per selection.
    asked = inside.select("client", "parent", "name").distinct()
    wrong = asked.join(held.select("client", "parent").distinct(), ["client", "parent"], "left_semi").join(
        held, ["client", "parent", "name"], "left_anti"
    )
    return (
        inside.join(wrong, ["client", "parent", "name"], "left_semi")
        .join(_below_missing(found, missing), ["client", "path"], "left_anti")
        .select(
            "file",
            (F.col("start_line") + F.col("line")).cast("int").alias("line"),
            F.lit(1).alias("column"),
            F.lit("error").alias("level"),
            F.concat(
                F.lit("[INVALID_FIELD_SELECTION] Field '"), "name", F.lit("' does not exist on type '"), "parent",
                F.lit("'"),
            ).alias("message"),
        )
    )


def argument_issues(uses: DataFrame, given: DataFrame, args: DataFrame, version: str) -> DataFrame:
    """Unknown arguments, missing required arguments and unknown fields, as messages with their place.

    ``uses``: field selections with ``client``, ``type_name`` (null where it could not be told), ``known`` (the
    schema has the field) and ``is_object`` (the schema has the type, with fields).
    """
    allowed = in_version(args, version).select(
        F.col("schema").alias("client"), "type_name", F.col("field_name").alias("name"), F.col("arg_name").alias("arg"),
        "is_required", "named_type",
    )
    # One row per field of the schema and one per selection with arguments: what is missing and what is unknown are
    # differences of two lists, each bounded by one field. All that is told of a selection is told in one pass.
    accepted = allowed.groupBy("client", "type_name", "name").agg(
        F.collect_set("arg").alias("args"),
        F.collect_list(F.when(F.col("is_required"), F.struct("arg", "named_type"))).alias("required"),
    )
    lists = given.groupBy(*BLOCK_KEY, "node").agg(F.collect_list(F.struct("arg", F.col("line").alias("at_line"), F.col("col").alias("at_col"))).alias("given"))
    told = uses.filter("known OR is_object").select(
        *BLOCK_KEY, "node", "client", "type_name", "name", "start_line", "line", "col", "known", "is_object"
    )
    # Arguments come several to a row of their table and become lists, so what Spark expects of their size is far too little: they are
    # sorted at every size, as a broadcast would pass all of a schema's fields through the driver.
    accepted = accepted.hint("merge")
    both = told.join(accepted, ["client", "type_name", "name"], "left").join(lists, [*BLOCK_KEY, "node"], "left")
    known, passed = F.coalesce("args", F.array().cast("array<string>")), F.transform("given", lambda g: g["arg"])
    unknown = F.filter("given", lambda g: ~F.array_contains(known, g["arg"]))
    lacking = F.filter("required", lambda r: ~F.coalesce(F.array_contains(passed, r["arg"]), F.lit(False)))
    nothing = F.array().cast("array<struct<line:int,column:int,message:string>>")

    def issue(line: Column, column: Column, *message: Column | str) -> Column:
        return F.struct(
            (F.col("start_line") + line - 1).cast("int").alias("line"), column.cast("int").alias("column"), F.concat(*message).alias("message")
        )

    line, col = F.col("line"), F.col("col")
    unknown_field = F.when(
        F.col("is_object") & ~F.col("known") & ~F.col("name").isin(*META_FIELDS),
        F.array(issue(line, col, F.lit("Cannot query field '"), "name", F.lit("' on type '"), "type_name", F.lit("'."))),
    )
    unknown_arg = F.transform(unknown, lambda g: issue(
        g["at_line"], g["at_col"],
        F.lit("Unknown argument '"), g["arg"], F.lit("' on field '"), "type_name", F.lit("."), "name", F.lit("'."),
    ))
    missing = F.transform(lacking, lambda r: issue(
        line, col,
        F.lit("Field '"), "name", F.lit("' argument '"), r["arg"], F.lit("' of type '"), r["named_type"],
        F.lit("!' is required, but it was not provided."),
    ))
    of_known = [F.when(F.col("known"), found) for found in (unknown_arg, missing)]
    return both.select("file", F.inline(F.concat(*[F.coalesce(found, nothing) for found in (unknown_field, *of_known)])))


def override(general: DataFrame, drift: DataFrame) -> DataFrame:
    """General issues with message and level of the drift issue at the same place, if there is one."""
    rank = F.when(F.col("kind") == "DEPRECATED", 1).when(F.col("kind") == "REMOVED", 2).otherwise(3)
    last = drift.groupBy("file", "line", "column").agg(
        F.max_by(F.struct("message", "level"), F.struct("client", rank, "message")).alias("d")
    )
    return general.join(last, ["file", "line", "column"], "left").select(
        "file", "line", "column",
        F.coalesce("d.level", F.col("level")).alias("level"),
        F.coalesce("d.message", F.col("message")).alias("message"),
    )


def client_selections(found: DataFrame) -> DataFrame:
    """Selections of rooted blocks as rows with the client and root they are checked against.

    A block of an unknown client is checked against the first one; a block without a root there has none.
    """
    mine = F.filter("roots", lambda r: r["client"] == schema_client(F.col("block_client")))
    return found.select(
        *BLOCK_KEY, "node", "depth", "kind", "name", "type_condition", "line", "col", "path", "start_line",
        F.inline_outer(mine),
    ).withColumn("client", F.coalesce("client", F.lit(CLIENTS[0])))


def given_arguments(found: DataFrame) -> DataFrame:
    """Arguments given to fields; ``node`` is the field's selection."""
    return found.filter("kind = 'argument'").select(*BLOCK_KEY, "node", F.col("name").alias("arg"), "line", "col")
