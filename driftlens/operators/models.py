"""Model classes: import aliases, inheritance closure, detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlens.functions.text import newlines, strip
from driftlens.operators.facts import UNREADABLE

# The imports that give a role its names, and the name a role has when it is not imported.
ROLES = {
    "basemodel": ("pydantic", "BaseModel"),
    "rootmodel": ("pydantic", "RootModel"),
    "pydantic_dataclass": ("pydantic.dataclasses", "dataclass"),
    "std_dataclass": ("dataclasses", "dataclass"),
}
MODEL_TYPES = ("BaseModel/RootModel", "PydanticDataclass", "dataclass")


def role_aliases(imports: Column, role: str) -> Column:
    """Names of a role in a file: what it is imported as, or its own name when it is not imported."""
    module, name = ROLES[role]
    used = F.filter(imports, lambda i: (i["module"] == module) & (i["name"] == name))
    names = F.transform(used, lambda i: F.coalesce(i["alias"], i["name"]))
    return F.when(F.size(used) > 0, names).otherwise(F.array(F.lit(name)))


def aliases(python: DataFrame) -> DataFrame:
    """Alias rows ``(file, role, alias)`` of files read by ``harvest.read_python``."""
    roles = F.array(
        *[
            F.struct(F.lit(role).alias("role"), role_aliases(F.col("imports"), role).alias("names"))
            for role in ROLES
        ]
    )
    return (
        python.filter(F.col("error").isNull())
        .select("file", F.explode(roles).alias("r"))
        .select("file", F.col("r.role").alias("role"), F.explode("r.names").alias("alias"))
        .distinct()
    )


def closure(first: Column, classes: Column) -> Column:
    """The names ``first`` and those of ``classes`` (with ``name, bases``) that reach them through any chain of bases.

    A fixed point inside the row: every step adds a level of inheritance, and once nothing is new the rest of the steps, one
    for each class at most, do nothing. A cycle adds nothing new.
    """

    def step(held: Column, _: Column) -> Column:
        heirs = F.filter(classes, lambda c: F.coalesce(F.arrays_overlap(c["bases"], held["found"]), F.lit(False)))
        more = F.array_union(held["found"], F.transform(heirs, lambda c: c["name"]))
        grown = F.named_struct(F.lit("found"), more, F.lit("done"), F.size(more) == F.size(held["found"]))
        return F.when(held["done"], held).otherwise(grown)

    start = F.named_struct(F.lit("found"), first.cast("array<string>"), F.lit("done"), F.lit(False))
    return F.aggregate(F.sequence(F.lit(0), F.size(classes)), start, step, lambda held: held["found"])


def reached_names(classes: Column, imports: Column) -> Column:
    """Names of a file's classes that reach a model root; of classes with one name the last counts."""
    roots = F.array_union(role_aliases(imports, "basemodel"), role_aliases(imports, "rootmodel"))
    named = F.transform(classes, lambda c: F.named_struct(F.lit("name"), c["name"], F.lit("bases"), c["bases"]))
    names = F.array_distinct(F.transform(classes, lambda c: c["name"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(named, lambda c: c["name"] == n), -1))
    once = F.when(F.size(names) == F.size(classes), named).otherwise(last)
    heirs = F.filter(once, lambda c: F.coalesce(F.arrays_overlap(c["bases"], roots), F.lit(False)))
    return F.coalesce(closure(F.transform(heirs, lambda c: c["name"]), once), F.array().cast("array<string>"))


def reaching_roots(edges: DataFrame) -> DataFrame:
    """``(file, class)`` of the classes that reach a root, from edges ``file, class, base, is_root``.

    One file's edges are one value, which its text bounds.
    """
    grouped = edges.groupBy("file").agg(
        F.collect_list(F.struct(F.col("class").alias("name"), F.array("base").alias("bases"))).alias("classes"),
        F.collect_set(F.when(F.col("is_root"), F.col("class"))).alias("first"),
    )
    return grouped.select("file", F.explode(closure(F.col("first"), F.col("classes"))).alias("class"))


def models(python: DataFrame) -> DataFrame:
    """Model rows: classes that reach a model root, then decorated ones.

    A file that is not valid Python gives one ``unknown`` row with its error.
    """
    imports = F.col("imports")
    rows = python.filter(F.size("classes") > 0).select(
        "file",
        role_aliases(imports, "pydantic_dataclass").alias("pydantic_decorators"),
        role_aliases(imports, "std_dataclass").alias("std_decorators"),
        reached_names(F.col("classes"), imports).alias("reached"),
        F.explode("classes").alias("c"),
    ).select("*", "c.*").withColumn("is_model", F.array_contains("reached", F.col("name")))

    def decorated(names: Column, any_dotted: bool) -> Column:
        return F.exists(
            "decorators",
            lambda d: F.array_contains(names, d["name"])
            | (d["attribute"] & (d["name"] == "dataclass") if any_dotted else F.lit(False)),
        )

    kind = (
        F.when(F.col("is_model"), MODEL_TYPES[0])
        .when(decorated(F.col("pydantic_decorators"), True), MODEL_TYPES[1])
        .when(decorated(F.col("std_decorators"), False), MODEL_TYPES[2])
    )
    good = (
        rows.select(
            "file",
            F.col("name").alias("model_name"),
            kind.alias("type"),
            strip(F.col("raw")).alias("raw"),
            F.col("first").alias("start_line"),
            F.col("last").alias("end_line"),
            F.lit(None).cast("string").alias("error"),
        )
        .filter(F.col("type").isNotNull())
    )
    source = F.col("broken")
    broken = python.filter(F.col("error").isNotNull() & ~F.col("error").startswith(UNREADABLE)).select(
        "file",
        F.lit(None).cast("string").alias("model_name"),
        F.lit("unknown").alias("type"),
        strip(source).alias("raw"),
        F.lit(1).alias("start_line"),
        (newlines(source) + 1).cast("int").alias("end_line"),
        "error",
    )
    return good.unionByName(broken)
