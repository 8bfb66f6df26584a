"""Ranks and running sums over whole tables, without a task that sees them all."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut


def running(df: DataFrame, order: list[Column | str], sums: Mapping[str, Column]) -> DataFrame:
    """Adds for each name the sum of its column over all rows that stand before in ``order``, which should tell all rows apart.

    Rows are dealt by ranges of ``order`` and written once; each range is summed by its task and shifted by the ranges before it,
    one row a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    amounts = {f"_amount_{i}": c for i, c in enumerate(sums.values())}
    p = cut(df.withColumns(amounts).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = p.groupBy("_range").agg(*[F.sum(a).alias(a) for a in amounts])
    starts = totals.select("_range", *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(f"_start{a}") for a in amounts])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = p.withColumns({f"_in{a}": F.coalesce(F.sum(a).over(within), F.lit(0)) for a in amounts}).join(F.broadcast(starts), "_range")
    out = inner.withColumns({name: F.col(f"_start{a}") + F.col(f"_in{a}") for name, a in zip(sums, amounts, strict=True)})
    return out.select(*df.columns, *sums)


def numbered(df: DataFrame, order: list[Column | str], name: str) -> DataFrame:
    """Adds the rank of each row, from 0, without gaps."""
    return running(df, order, {name: F.lit(1).cast("long")})


def parts(df: DataFrame, n: int, order: list[Column | str], name: str = "part") -> DataFrame:
    """Adds the part (0 .. n - 1) of each row: consecutive ranges of ``order`` whose sizes differ by one at most, longer ones first."""
    ranked = numbered(df, order, "_rank")
    small, long = divmod(ranked.count(), n)
    edge = long * (small + 1)
    part = F.when(F.col("_rank") < edge, F.expr(f"_rank div {small + 1}")).otherwise(F.expr(f"{long} + (_rank - {edge}) div {max(small, 1)}"))
    return ranked.withColumn(name, part.cast("int")).drop("_rank")
