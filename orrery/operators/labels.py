"""The label store: for each frame nothing known (no row or null), seen and rejected (empty array), or accepted boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LABELS = "dbidx long, boxes array<struct<x1:double,y1:double,x2:double,y2:double,description:string,marked_accepted:boolean>>"


def updated(labels: DataFrame, new: DataFrame) -> DataFrame:
    """Labels with the frames of ``new`` replaced."""
    return labels.join(new.select("dbidx"), "dbidx", "left_anti").unionByName(new)


def seen(labels: DataFrame) -> DataFrame:
    """Frames with feedback of either kind."""
    return labels.where("boxes is not null").select("dbidx")


def binary(labels: DataFrame) -> DataFrame:
    """(dbidx, y) of seen frames: 1 if any box is there."""
    return labels.where("boxes is not null").select("dbidx", (F.size("boxes") > 0).cast("int").alias("y"))


def accepted(boxes: Column | str) -> Column:
    """Whether any box is marked as accepted; false without boxes."""
    b = F.col(boxes) if isinstance(boxes, str) else boxes
    return F.coalesce(F.exists(b, lambda x: F.coalesce(x["marked_accepted"], F.lit(False))), F.lit(False))


def box_rows(labels: DataFrame, target: str | None = None) -> DataFrame:
    """(dbidx, x1, y1, x2, y2) of positive boxes: those with the description looked for, or else those marked as accepted."""
    rows = labels.select("dbidx", F.explode("boxes").alias("b"))
    good = F.col("b.description") == target if target is not None else F.coalesce(F.col("b.marked_accepted"), F.lit(False))
    return rows.where(good).select("dbidx", "b.x1", "b.y1", "b.x2", "b.y2")
