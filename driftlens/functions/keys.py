"""Joins on several keys whose rows are sorted by a number first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Types whose equal values have one number.
NUMBERED = ("string", "bigint", "int", "smallint")


def key_id(*keys: Column | str) -> Column:
    """A number for a row's keys. A sort tells rows apart by the first bytes of its first key; a client, a kind of operation or the
    folder of a file is the same for many, and then whole rows are compared."""
    return F.xxhash64(*keys)


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)``, sorted and dealt by a number of the keys and the keys. Keys that are of another type on the
    other side are left out of the number, as equal values have other numbers there."""
    kinds, others = dict(left.dtypes), dict(right.dtypes)
    same = [key for key in keys if kinds[key] == others[key] and kinds[key] in NUMBERED]
    if not same:
        return left.join(right, keys, how)
    number = key_id(*same).alias("_key_id")
    return left.select("*", number).join(right.select("*", number), ["_key_id", *keys], how).drop("_key_id")
