"""Joins of boxes that overlap within one frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import SIDES, containment, iou, overlaps


def box_join(left: DataFrame, right: DataFrame, on: str = "dbidx", iou_above: float = 0.0) -> DataFrame:
    """Pairs of boxes of one frame with an IoU above ``iou_above``: all columns, suffixed _left and _right, and iou and cont.

    An equi-join on the frame carries the overlap conditions, so pairs are made per frame and never for the whole table.
    """
    a, b = left.alias("a"), right.alias("b")
    pairs = a.join(b, (F.col(f"a.{on}") == F.col(f"b.{on}")) & overlaps("a", "b"))
    out = pairs.select(
        F.col(f"a.{on}").alias(on),
        *[F.col(f"a.{c}").alias(f"{c}_left") for c in left.columns if c != on],
        *[F.col(f"b.{c}").alias(f"{c}_right") for c in right.columns if c != on],
        iou("a", "b").alias("iou"), containment("a", "b").alias("cont"),
    )
    return out.where(F.col("iou") > iou_above)


def left_iou_join(vectors: DataFrame, boxes: DataFrame, key: str = "vec_id", on: str = "dbidx") -> DataFrame:
    """Every row of ``vectors`` with max_iou, its best overlap with a box of its frame (0 if none)."""
    best = box_join(vectors.select(key, on, *SIDES), boxes.select(on, *SIDES), on).groupBy(F.col(f"{key}_left").alias(key)).agg(F.max("iou").alias("max_iou"))
    return vectors.join(best, key, "left").withColumn("max_iou", F.coalesce("max_iou", F.lit(0.0)))


def best_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str, on: str = "dbidx") -> DataFrame:
    """(left_key, right_key, iou): for each left box that overlaps any, the box with the largest IoU; ties to the smaller key."""
    pairs = box_join(left.select(on, left_key, *SIDES), right.select(on, right_key, *SIDES), on)
    order = Window.partitionBy(f"{left_key}_left").orderBy(F.desc("iou"), f"{right_key}_right")
    best = pairs.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    return best.select(F.col(f"{left_key}_left").alias(left_key), F.col(f"{right_key}_right").alias(right_key), "iou")


def labelled_vectors(vectors: DataFrame, boxes: DataFrame, seen: DataFrame, key: str = "vec_id", on: str = "dbidx") -> DataFrame:
    """(key, on, y, max_iou) of the vectors of ``seen`` frames: y is 1 if a box overlaps."""
    there = vectors.join(seen.select(on).distinct(), on, "left_semi")
    return left_iou_join(there, boxes, key, on).select(key, on, (F.col("max_iou") > 0).cast("int").alias("y"), "max_iou")


def positives_and_negatives(vectors: DataFrame, boxes: DataFrame, box_key: str, key: str = "vec_id", on: str = "dbidx") -> DataFrame:
    """(key, role): the best vector of each box is ``positive``, vectors that no box touches are ``negative``, others do not appear."""
    positive = best_match(boxes, vectors, box_key, key, on).select(key).distinct().withColumn("role", F.lit("positive"))
    negative = left_iou_join(vectors, boxes, key, on).where("max_iou = 0").select(key).withColumn("role", F.lit("negative"))
    return positive.unionByName(negative)


def contained_labels(boxes: DataFrame, labels: DataFrame, least: float, box_key: str, label_key: str, samples: int = 1, seed: int = 0, on: str = "dbidx") -> DataFrame:
    """(on, box_key, label_key, category, cont): labels that lie in a box of their frame by more than ``least`` of their own area; of each
    frame ``samples`` boxes, by a seeded hash, take part."""
    order = Window.partitionBy(on).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(box_key)).cast("binary")), box_key)
    some = boxes.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= samples).select(on, box_key, *SIDES)
    pairs = box_join(labels.select(on, label_key, "category", *SIDES), some, on).where(F.col("cont") > least)
    return pairs.select(on, F.col(f"{box_key}_right").alias(box_key), F.col(f"{label_key}_left").alias(label_key), F.col("category_left").alias("category"), "cont")


def kept_boxes(boxes: DataFrame, keys: list[str], score: str, threshold: float, on: str = "dbidx") -> DataFrame:
    """Greedy non-maximum suppression per frame: boxes by falling score; one that an earlier kept box overlaps by more than
    ``threshold`` of its own area is dropped. Within a frame the choice is sequential, so frames are the unit of work."""
    import numpy as np
    import pandas as pd

    def kept(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values([score, *keys], ascending=[False, *[True] * len(keys)]).reset_index(drop=True)
        b = p[list(SIDES)].to_numpy(float)
        size = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1])
        stay: list[int] = []
        for i in range(len(p)):
            wide = np.minimum(b[stay, 2], b[i, 2]) - np.maximum(b[stay, 0], b[i, 0])
            high = np.minimum(b[stay, 3], b[i, 3]) - np.maximum(b[stay, 1], b[i, 1])
            if not (np.maximum(wide, 0) * np.maximum(high, 0) > threshold * size[i]).any():
                stay.append(i)
        return p.iloc[stay]

    return boxes.groupBy(on).applyInPandas(kept, boxes.schema)
