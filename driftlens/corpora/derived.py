"""Corpora and catalogues that Spark derives from the tables, row by row.

Every file, class or schema entry comes from one row or a small group of rows, so these views grow with the tables
and spread evenly whatever the keys look like.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.corpora import planted


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows that become much larger ones to the session's shuffle partitions, whatever splits they come in."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def fill(text: str, values: Mapping[str, Column]) -> Column:
    """A template with its placeholders filled."""
    filled = F.lit(text)
    for name, value in values.items():
        if f"<{name}>" in text:
            filled = F.replace(filled, F.lit(f"<{name}>"), value.cast("string"))
    return filled


def _order_keys() -> dict[str, Column]:
    o = F.col("o_orderkey")
    return {"o": o, "k": F.floor(o / 2).cast("bigint"), "k1": (F.floor(o / 2) + 1).cast("bigint")}


def _choose(rows, key: Column, values: Mapping[str, Column]) -> Column:
    chosen = fill(rows[-1][2], values)
    for modulus, residue, text in reversed(rows[:-1]):
        chosen = F.when(key % modulus == residue, fill(text, values)).otherwise(chosen)
    return chosen


def code_files(spark: SparkSession, folder: str) -> DataFrame:
    """A Python file per order."""
    keys = _order_keys()
    o = keys["o"]
    source = F.lit(None).cast("string")
    for number, text in enumerate(planted.SOURCES):
        source = F.when(o % len(planted.SOURCES) == number, fill(text, keys)).otherwise(source)
    return spread(table(spark, folder, "orders").select("o_orderkey", "o_custkey")).select(
        F.concat(F.lit("src/c"), F.col("o_custkey"), F.lit("/o"), o, F.lit(".py")).alias("file"),
        F.lit("py").alias("ext"),
        source.alias("source"),
    )


def document_files(spark: SparkSession, folder: str) -> DataFrame:
    """A standalone operation document per customer."""
    c = F.col("c_custkey")
    return spread(table(spark, folder, "customer").select("c_custkey")).select(
        F.concat(F.lit("gql/c"), c, F.lit(".graphql")).alias("file"),
        F.lit("graphql").alias("ext"),
        fill(planted.DOCUMENT, {"c": c}).alias("source"),
    )


def defect_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """An operation text with planted defects per order, as a block at line 10 of its file."""
    keys = _order_keys()
    o = keys["o"]
    lines = [_choose(rows, o, keys) for rows in planted.DEFECTS]
    return spread(table(spark, folder, "orders").select("o_orderkey")).select(
        F.concat(F.lit("ops/o"), o, F.lit(".py")).alias("file"),
        F.concat_ws("\n", *lines).alias("raw"),
        F.lit(10).alias("start_line"),
    )


def model_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A model class per customer, as a model row."""
    c = F.col("c_custkey")
    lines = [_choose(rows, c, {"c": c}) for rows in planted.MODEL]
    return spread(table(spark, folder, "customer").select("c_custkey")).select(
        F.concat(F.lit("models/c"), c, F.lit(".py")).alias("file"),
        F.concat(F.lit("M"), c).alias("model_name"),
        F.concat_ws("\n", *lines).alias("raw"),
        F.lit(planted.MODEL_START).alias("start_line"),
    )


def dataclass_texts(spark: SparkSession, folder: str) -> DataFrame:
    """A dataclass per supplier, as a model row."""
    s = F.col("s_suppkey")
    return table(spark, folder, "supplier").select(
        F.concat(F.lit("models/s"), s, F.lit(".py")).alias("file"),
        F.concat(F.lit("D"), s).alias("model_name"),
        fill(planted.DATACLASS, {"s": s}).alias("raw"),
        F.lit(2).alias("start_line"),
    )


def model_files(spark: SparkSession, folder: str) -> DataFrame:
    """Python files with model classes of every kind, one per customer; some are not valid Python."""
    c = F.col("c_custkey")
    header = (
        F.when(c % 5 == 0, F.lit("from pydantic import BaseModel as BM\n"))
        .when(c % 5 == 1, F.lit("from pydantic.dataclasses import dataclass as pdc\n"))
        .when(c % 5 == 2, F.lit("import pydantic\n"))
        .when(c % 5 == 3, F.lit("from dataclasses import dataclass as sdc\n"))
        .otherwise(F.lit("from typing import (\n"))
    )
    body = (
        F.when(c % 5 == 0, fill("class A<c>(BM):\n    x: int\nclass B<c>(A<c>):\n    y: int\nclass N<c>(BaseModel):\n    z: int\n", {"c": c}))
        .when(c % 5 == 1, fill("@pdc\nclass A<c>:\n    x: int\n@dataclass(frozen=True)\nclass B<c>:\n    y: int\n", {"c": c}))
        .when(c % 5 == 2, fill("class A<c>(pydantic.RootModel[int]):\n    pass\n@x.dataclass\nclass B<c>:\n    y: int\n", {"c": c}))
        .when(c % 5 == 3, fill("@sdc\nclass A<c>:\n    x: int\nclass B<c>(B<c>):\n    y: int\n", {"c": c}))
        .otherwise(fill("class A<c>(BaseModel):\n    x: int\n", {"c": c}))
    )
    return spread(table(spark, folder, "customer").select("c_custkey")).select(
        F.concat(F.lit("src/m"), c, F.lit(".py")).alias("file"),
        F.lit("py").alias("ext"),
        F.concat(header, body).alias("source"),
    )


def class_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Inheritance edges: 64 classes per file in a binary tree; every third file's tree hangs on itself."""
    c = F.col("c_custkey")
    file_no, place = F.floor(c / 64).cast("bigint"), c % 64
    top = F.when(file_no % 3 == 0, F.concat(F.lit("C"), file_no * 64 + 63)).otherwise("BaseModel")
    base = F.when(place == 0, top).otherwise(F.concat(F.lit("C"), file_no * 64 + F.floor(place / 2).cast("bigint")))
    return table(spark, folder, "customer").select(
        F.concat(F.lit("h"), file_no).alias("file"),
        F.concat(F.lit("C"), c).alias("class"),
        base.alias("base"),
        (base == "BaseModel").alias("is_root"),
    )


OLD, NEW = "2024-04", "2025-04"
LAST_OLD, FIRST_NEW = "1999-01-01", "1998-01-01"


# The fields of a type in one version, as three bits for each remainder of a part number, -6 to 6 and none: there is such a field,
# an item says it is deprecated, an item says it is not.
REMAINDERS = (*range(-6, 7), None)
PRESENT, DEPRECATED, CURRENT = 1, 2, 4


def schema_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Two schemas in two versions, from the line items: a type per two orders, a field per part number modulo 7.

    The query root has a field per type, the mutation root one per third type. Items are grouped once, into one row per type.
    """
    k, p = F.col("k"), F.col("p")
    flagged = F.col("l_returnflag") == "R"
    bits = F.lit(PRESENT).cast("bigint") + F.when(flagged, DEPRECATED).when(~flagged, CURRENT).otherwise(0)
    place = F.coalesce(F.col("l_partkey") % 7 + 6, F.lit(len(REMAINDERS) - 1)).cast("int") * 3
    held = F.call_function("shiftleft", bits, place)
    grouped = (
        table(spark, folder, "lineitem")
        .select(
            F.floor(F.col("l_orderkey") / 2).cast("bigint").alias("k"),
            F.when(F.col("l_shipdate") < F.lit(LAST_OLD).cast("timestamp"), held).alias(OLD),
            F.when(F.col("l_shipdate") >= F.lit(FIRST_NEW).cast("timestamp"), held).alias(NEW),
        )
        .groupBy("k")
        .agg(*[F.bit_or(version).alias(version) for version in (OLD, NEW)])
    )

    # A row per version that has the type, then one per remainder and root type; those that are not there are dropped.
    versions = F.array(*[F.struct(F.lit(version).alias("version"), F.col(version).alias("held")) for version in (OLD, NEW)])
    roots = ("QueryRoot", "Mutation")
    n, fields = F.col("n"), len(REMAINDERS)
    numbers = F.array(*map(F.lit, range(fields + len(roots))))
    said = F.call_function("shiftright", F.col("held"), F.least(n, F.lit(fields)) * 3).bitwiseAND(7)
    rows = (
        grouped.select("k", F.inline(versions))
        .filter("held IS NOT NULL")
        .select("k", "version", "held", F.explode(numbers).alias("n"))
        .select(
            "k", "version", F.when(n < fields - 1, n - 6).cast("bigint").alias("p"),
            F.when(n >= fields, F.element_at(F.array(*map(F.lit, roots)), F.greatest(n - fields + 1, F.lit(1)))).alias("root"),
            F.when(n >= fields, F.lit(PRESENT).cast("bigint")).otherwise(said).alias("said"),
        )
        .filter(F.col("said") > 0)
    )
    said, root = F.col("said"), F.col("root")
    is_root = root.isNotNull()
    deprecated = (
        F.when(is_root, k % 10 == 0)
        .when(said.bitwiseAND(DEPRECATED) > 0, True)
        .when(said.bitwiseAND(CURRENT) > 0, False)
    )
    own_reason = F.when(F.col("is_deprecated") & (p != 3), F.concat(F.lit("use f"), (p + 1) % 7))
    return (
        rows.withColumn("is_deprecated", deprecated)
        .select(
            F.when(F.floor(k / 2) % 2 == 0, "Admin").otherwise("Storefront").alias("schema"),
            "version",
            F.coalesce(root, F.concat(F.lit("T"), k)).alias("type_name"),
            F.when(root == "QueryRoot", F.concat(F.lit("t"), k))
            .when(root == "Mutation", F.when(k % 3 == 0, F.concat(F.lit("m"), k)))
            .otherwise(F.concat(F.lit("f"), p))
            .alias("field_name"),
            "is_deprecated",
            F.when(is_root, F.when(k % 10 == 0, "legacy")).otherwise(own_reason).alias("deprecation_reason"),
            F.when(is_root | (p == 0), F.concat(F.lit("T"), k + F.when(is_root, 0).otherwise(1))).otherwise("String").alias("named_type"),
            F.when(is_root, 0).otherwise(p).cast("int").alias("ord"),
            is_root.alias("_root"),
        )
        .filter(~F.col("_root") | F.col("field_name").isNotNull())
        .drop("_root")
    )


def schema_types(fields: DataFrame) -> DataFrame:
    """The types of a field table."""
    return fields.select("schema", "version", "type_name").distinct().withColumn("kind", F.lit("OBJECT"))


def schema_args(spark: SparkSession, folder: str) -> DataFrame:
    """Arguments of the root fields, two per part; mutation arguments are of input types."""
    p = F.col("p_partkey")
    rows = F.array(
        *[
            F.struct(
                F.lit(schema).alias("schema"),
                F.lit(root).alias("type_name"),
                F.concat(F.lit(field), p).alias("field_name"),
                F.lit(arg).alias("arg_name"),
                required.alias("is_required"),
                F.concat(F.lit("I"), p % 100).alias("named_type"),
            )
            for schema in ("Admin", "Storefront")
            for root, field in (("QueryRoot", "t"), ("Mutation", "m"))
            for arg, required in (("first", F.lit(False)), ("id", F.col("p_size") > 25))
        ]
    )
    return table(spark, folder, "part").select(F.lit(OLD).alias("version"), F.inline(rows))


def input_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Input types, one per part number modulo 100, with a field per brand; deprecated if a small part has it."""
    return (
        table(spark, folder, "part")
        .groupBy((F.col("p_partkey") % 100).alias("n"), "p_brand")
        .agg(F.min("p_size").alias("size"))
        .select(
            F.lit("Admin").alias("schema"),
            F.lit(OLD).alias("version"),
            F.concat(F.lit("I"), "n").alias("type_name"),
            F.replace(F.lower("p_brand"), F.lit("#"), F.lit("_")).alias("field_name"),
            (F.col("size") < 10).alias("is_deprecated"),
            F.when(F.col("size") < 5, "too small").alias("deprecation_reason"),
            F.lit("String").alias("named_type"),
            F.lit(0).alias("ord"),
        )
    )


def issues(spark: SparkSession, folder: str) -> DataFrame:
    """An issue per event."""
    e, kind = F.col("event_id"), F.col("event_type")
    message = (
        F.when((kind == "signup") & (e % 2 == 0),
               "[DEPRECATED] Field 'email' in type 'C' is deprecated in old schema: use defaultEmailAddress.emailAddress (Admin)")
        .when((kind == "signup") & (e % 3 == 0), "[DEPRECATED] Field 'userErrors' in type 'P' is deprecated in old schema: x")
        .when(kind == "signup", "[DEPRECATED] Field 'a' in type 'P' is deprecated in old schema: x")
        .when(kind == "error", "[GRAPHQL_SYNTAX] Invalid syntax")
        .when(kind == "click", "[REMOVED] Field 'b' in type 'P' was removed in new schema")
        .when((kind == "view") & (e % 2 == 0), "[PYDANTIC_REQUIRED_FIELD] Field 'c' in model 'M' has no default value")
        .when(kind == "view", "[GRAPHQL_VALIDATION] GraphQL parsing error: Inline fragment")
        .when(e % 4 == 0, "[ADDED] Field 'd' in type 'P' was added in new schema")
        .when(e % 4 == 1, "[MISSING_REQUIRED_ARG] Field 'e' argument 'x' of type 'Y' is required")
        .when(e % 4 == 2, "[PYDANTIC_TYPE_MISMATCH] count field should be int, not str")
        .otherwise("max_length constraint found in model 'M'")
    )
    return table(spark, folder, "events").select(
        F.concat(F.lit("f"), "user_id").alias("file"),
        (e % 500).cast("int").alias("line"),
        (e % 80 + 1).cast("int").alias("column"),
        F.when(kind == "error", "error").otherwise("warning").alias("level"),
        message.alias("message"),
    )


def source_tree(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """Write one file per customer with orders below ``root``, in tasks; returns the paths written.

    The names take turns: package files, private names, hidden folders, an excluded folder, another kind of file.
    Some files hold bytes that are not UTF-8.
    """
    k = F.col("o_custkey")
    path = F.concat(
        F.element_at(F.array(*map(F.lit, ("pkg_", "_private/m_", ".hidden/x_", "node_modules/y_", "src/deep/_", "notes/t_"))), (k % 6 + 1).cast("int")),
        k, F.element_at(F.array(*map(F.lit, ("/__init__.py", ".py", ".graphql", ".py", ".gql", ".txt"))), (k % 6 + 1).cast("int")),
    )
    text = F.concat(F.lit("# customer "), k, F.lit("\n# orders "), F.col("n"), F.lit("\n"))
    files = table(spark, folder, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).select(path.alias("path"), text.alias("text"), (k % 10 == 7).alias("bad"))

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs as pafs

        system, top = pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)
        for batch in batches:
            for path, text, bad in zip(*[column.to_pylist() for column in batch.columns]):
                system.create_dir(f"{top}/{path}".rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(f"{top}/{path}") as file:
                    file.write(text.encode() + (b"\xff" if bad else b""))
            yield pa.RecordBatch.from_arrays([batch.column(0)], names=["path"])

    return files.mapInArrow(write, "path string")
