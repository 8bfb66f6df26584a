"""Set operations on ids, and changes between states."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import numbered


def id_union(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).union(b.select(key)).distinct()


def id_intersection(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def is_subset(a: DataFrame, b: DataFrame, key: str) -> bool:
    return id_difference(a, b, key).limit(1).count() == 0


def label_changes(old: DataFrame, new: DataFrame, key: str = "dbidx") -> DataFrame:
    """(key, y) of what changed between two label states (key, accepted): newly seen or switched, either way."""
    o = old.select(key, F.col("accepted").alias("_old"))
    both = new.select(key, "accepted").join(o, key, "left")
    return both.where(~F.col("accepted").eqNullSafe(F.col("_old"))).select(key, F.col("accepted").cast("int").alias("y"))


def numbered_strings(rows: DataFrame, text: str, position: str) -> DataFrame:
    """(text, first_position, id): different strings numbered from 0 in order of first appearance."""
    first = rows.groupBy(text).agg(F.min(position).alias("first_position"))
    return numbered(first, ["first_position", text], "id")


def densified(rows: DataFrame, kept: DataFrame, key: str, new: str = "new_id") -> DataFrame:
    """The rows of ``kept`` keys, renumbered from 0 without gaps in order of the old key."""
    table = numbered(kept.select(key).distinct(), [key], new)
    return rows.join(table, key)
