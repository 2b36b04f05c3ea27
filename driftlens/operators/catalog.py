"""The schema catalogue: type and field tables of several schemas and versions.

``types``: ``schema, version, type_name, kind``. ``fields``: ``schema, version, type_name, field_name,
is_deprecated, deprecation_reason, named_type, ord``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names a root type may have when the schema does not name it, in order of preference.
ROOT_NAMES = {
    "query": ("QueryRoot", "Query"),
    "mutation": ("Mutation",),
    "subscription": ("Subscription", "SubscriptionRoot"),
}
NO_REASON = "Deprecated"


def is_deprecated() -> Column:
    """A field is deprecated if it is flagged or has a reason."""
    return F.coalesce("is_deprecated", F.lit(False)) | (F.length(F.coalesce("deprecation_reason", F.lit(""))) > 0)


def valid_version(version: Column) -> Column:
    """``YYYY-MM`` with a year from 2020 to 2030 and a quarter's first month."""
    year, month = F.substring(version, 1, 4), F.substring(version, 6, 2)
    return F.coalesce(
        version.rlike(r"^20[2-3][0-9]-[0-9]{2}\z")
        & year.between("2020", "2030")
        & month.isin("01", "04", "07", "10"),
        F.lit(False),
    )


def version_route(version: Column) -> Column:
    """How a version is fetched: by token before 2024-10, by proxy from then on."""
    return F.when(F.try_to_number(F.replace(version, F.lit("-")), F.lit("999999")) < 202410, "token").otherwise("proxy")


def in_version(table: DataFrame, version: str) -> DataFrame:
    return table.filter(F.col("version") == version).drop("version")


def type_fields(fields: DataFrame) -> DataFrame:
    """Field names of every type, one row each; a type without fields has none."""
    return fields.select("schema", "version", "type_name", "field_name").distinct()


def field_status(fields: DataFrame) -> DataFrame:
    """The status ``(exists, is_deprecated, reason)`` of every field, keyed by type and name."""
    status = F.struct(
        F.lit(True).alias("exists"),
        F.coalesce("is_deprecated", F.lit(False)).alias("is_deprecated"),
        F.col("deprecation_reason").alias("reason"),
    )
    return fields.select("schema", "version", "type_name", "field_name", status.alias("status"))


def deprecated_fields(fields: DataFrame) -> DataFrame:
    """All deprecated fields with their reason, empty if none is given."""
    return fields.filter(is_deprecated()).select(
        "schema", "version", "type_name", "field_name",
        F.coalesce("deprecation_reason", F.lit("")).alias("reason"),
    )


def roots(types: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """Root type per schema, version and operation: the one the schema names, else the usual names in order."""
    usual = F.array(
        *[
            F.struct(F.lit(op).alias("operation"), F.lit(name).alias("root"), F.lit(rank + 1).alias("rank"))
            for op, names in ROOT_NAMES.items()
            for rank, name in enumerate(names)
        ]
    )
    all_names = [name for names in ROOT_NAMES.values() for name in names]
    found = (
        types.filter(F.col("type_name").isin(all_names))
        .select("schema", "version", "type_name", F.inline(usual))
        .filter(F.col("root") == F.col("type_name"))
        .select("schema", "version", "operation", "type_name", "rank")
    )
    if named is not None:
        found = found.unionByName(named.select("schema", "version", "operation", "type_name", F.lit(0).alias("rank")))
    return found.groupBy("schema", "version", "operation").agg(F.min_by("type_name", "rank").alias("type_name"))


def drift_lookup(
    types: DataFrame, fields: DataFrame, old: str, new: str, strict_added: bool = False
) -> DataFrame:
    """One row per schema, type and lower-case field name with what both versions know about it.

    ``old_*`` is the old field (of names that differ in case only, the last); ``new_names`` holds the new version's
    spellings. A type the old version lacks counts with its new fields as old ones, so nothing below it is reported
    as added; ``strict_added`` turns that off.
    """
    low = F.lower("field_name").alias("low")
    old_fields = in_version(fields, old).withColumn("_old", F.lit(True)).withColumn("_new", F.lit(old == new))
    new_fields = in_version(fields, new).withColumn("_new", F.lit(True))
    if strict_added:
        new_fields = new_fields.withColumn("_old", F.lit(False))
    else:
        known = in_version(types, old).select("schema", "type_name").distinct().withColumn("_known", F.lit(True))
        new_fields = new_fields.join(known, ["schema", "type_name"], "left").withColumn("_old", F.col("_known").isNull()).drop("_known")
    # Of one version every field is both old and new.
    rows = old_fields if old == new else old_fields.unionByName(new_fields)
    field = F.struct("field_name", is_deprecated().alias("is_deprecated"), "deprecation_reason", "named_type")
    spelled = F.collect_set(F.when(F.col("_new"), F.struct("field_name", "named_type")))
    return rows.groupBy("schema", "type_name", low).agg(
        F.max_by(field, F.when(F.col("_old"), F.struct("ord", "field_name"))).alias("old"), spelled.alias("new_names"),
    ).withColumn("new_names", F.when(F.size("new_names") > 0, F.col("new_names")))
