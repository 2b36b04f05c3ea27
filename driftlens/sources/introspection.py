"""API schemas from introspection JSON, as catalogue tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Levels of NonNull and List around a type that are read. Public introspection queries ask for nine at most; an answer that
# goes on below the last level is rejected, never cut.
WRAPPERS = 10


def _type_ref(depth: int) -> str:
    inner = f",ofType:{_type_ref(depth - 1)}" if depth else ""
    return f"struct<kind:string,name:string{inner}>"


_REF = _type_ref(WRAPPERS)
_INPUT = f"struct<name:string,defaultValue:string,isDeprecated:boolean,deprecationReason:string,type:{_REF}>"
_FIELD = (
    f"struct<name:string,isDeprecated:boolean,deprecationReason:string,type:{_REF},args:array<{_INPUT}>>"
)
_SCHEMA = (
    "struct<queryType:struct<name:string>,mutationType:struct<name:string>,subscriptionType:struct<name:string>,"
    f"types:array<struct<kind:string,name:string,fields:array<{_FIELD}>,inputFields:array<{_INPUT}>>>>"
)
DOCUMENT = f"data struct<__schema:{_SCHEMA}>,__schema {_SCHEMA},errors array<string>,schema string,version string"


def named_type(ref: Column) -> Column:
    """Name of a type without its NonNull and List wrappers."""
    names, node = [], ref
    for level in range(WRAPPERS + 1):
        names.append(node["name"])
        if level < WRAPPERS:
            node = node["ofType"]
    return F.coalesce(*names)


def read_schemas(
    spark: SparkSession, path: str, multiline: bool = False, schema: str | None = None, version: str | None = None
) -> DataFrame:
    """Introspection documents, with or without a ``data`` envelope.

    Answers do not say which schema and version they are of: the caller says so here, or the file is named
    ``<schema>_<version>.json``; keys ``schema`` and ``version`` of a document come first.
    """
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    parts = F.regexp_extract(name, r"^(.+?)[_-](\d{4}-\d{2})[^/]*$", 1), F.regexp_extract(name, r"^(.+?)[_-](\d{4}-\d{2})[^/]*$", 2)
    documents = spark.read.schema(DOCUMENT).option("multiLine", str(multiline).lower()).json(path)
    given = {"schema": schema, "version": version}
    return documents.select(
        *[c for c in documents.columns if c not in given],
        *[F.coalesce(F.col(k), F.lit(given[k]).cast("string"), F.nullif(part, F.lit(""))).alias(k) for k, part in zip(given, parts)],
    )


def _too_deep(documents: DataFrame) -> Column:
    """Whether some type of a document goes on below the last level that is read."""
    body = F.coalesce(F.col("data.__schema"), F.col("__schema"))

    def deep(ref: Column) -> Column:
        for _ in range(WRAPPERS):
            ref = ref["ofType"]
        return F.coalesce(ref["kind"].isin("NON_NULL", "LIST"), F.lit(False))

    def any_of(items: Column, test) -> Column:
        return F.coalesce(F.exists(items, test), F.lit(False))

    return any_of(
        body["types"],
        lambda t: any_of(t["fields"], lambda f: deep(f["type"]) | any_of(f["args"], lambda a: deep(a["type"])))
        | any_of(t["inputFields"], lambda f: deep(f["type"])),
    )


def rejected(documents: DataFrame) -> DataFrame:
    """Documents that report errors instead of a schema, or hold types wrapped more often than is read."""
    deep = F.when(_too_deep(documents), F.array(F.lit(f"a type is wrapped more than {WRAPPERS} times")))
    told = F.when(F.size("errors") > 0, F.col("errors")).otherwise(deep)
    return documents.select("schema", "version", told.alias("errors")).filter("errors IS NOT NULL")


def _types(documents: DataFrame) -> DataFrame:
    good = documents.filter((F.coalesce(F.size("errors"), F.lit(0)) <= 0) & ~_too_deep(documents))
    body = good.select("schema", "version", F.coalesce(F.col("data.__schema"), F.col("__schema")).alias("s"))
    return body.select("schema", "version", F.explode("s.types").alias("t"))


def schema_types(documents: DataFrame) -> DataFrame:
    """``(schema, version, type_name, kind)``."""
    return _types(documents).select("schema", "version", F.col("t.name").alias("type_name"), F.col("t.kind").alias("kind"))


def schema_fields(documents: DataFrame) -> DataFrame:
    """``(schema, version, type_name, field_name, is_deprecated, deprecation_reason, named_type, ord)``."""
    fields = _types(documents).select(
        "schema", "version", F.col("t.name").alias("type_name"), F.posexplode("t.fields").alias("ord", "f")
    )
    return fields.select(
        "schema",
        "version",
        "type_name",
        F.col("f.name").alias("field_name"),
        F.coalesce("f.isDeprecated", F.lit(False)).alias("is_deprecated"),
        F.col("f.deprecationReason").alias("deprecation_reason"),
        named_type(F.col("f.type")).alias("named_type"),
        "ord",
    )


def schema_args(documents: DataFrame) -> DataFrame:
    """``(schema, version, type_name, field_name, arg_name, is_required, named_type)``."""
    args = _types(documents).select(
        "schema", "version", F.col("t.name").alias("type_name"), F.explode("t.fields").alias("f")
    ).select("schema", "version", "type_name", F.col("f.name").alias("field_name"), F.explode("f.args").alias("a"))
    return args.select(
        "schema",
        "version",
        "type_name",
        "field_name",
        F.col("a.name").alias("arg_name"),
        ((F.col("a.type.kind") == "NON_NULL") & F.col("a.defaultValue").isNull()).alias("is_required"),
        named_type(F.col("a.type")).alias("named_type"),
    )


def input_fields(documents: DataFrame) -> DataFrame:
    """Fields of input types, in the shape of ``schema_fields``."""
    fields = _types(documents).select(
        "schema", "version", F.col("t.name").alias("type_name"), F.posexplode("t.inputFields").alias("ord", "f")
    )
    return fields.select(
        "schema",
        "version",
        "type_name",
        F.col("f.name").alias("field_name"),
        F.coalesce("f.isDeprecated", F.lit(False)).alias("is_deprecated"),
        F.col("f.deprecationReason").alias("deprecation_reason"),
        named_type(F.col("f.type")).alias("named_type"),
        "ord",
    )


def root_types(documents: DataFrame) -> DataFrame:
    """``(schema, version, operation, type_name)`` as the documents name their roots."""
    good = documents.select("schema", "version", F.coalesce(F.col("data.__schema"), F.col("__schema")).alias("s"))
    roots = F.array(
        *[
            F.struct(F.lit(op).alias("operation"), F.col(f"s.{op}Type.name").alias("type_name"))
            for op in ("query", "mutation", "subscription")
        ]
    )
    return good.select("schema", "version", F.inline(roots)).filter(F.col("type_name").isNotNull())
