"""Scores between all vectors and all queries, tile by tile: a matrix product for each two tiles, of which a few rows a query come back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import cut

#: Vectors a side of a tile, tiles that meet another one in one task.
TILE, MEETINGS = 2048, 64


def packed(rows: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """Tiles (tile, ids, flat) in order of their keys within, and how many. Single-precision vectors travel as such."""
    n = max(1, -(-rows.count() // TILE))
    kind = np.float32 if rows.schema[column].dataType.simpleString() == "array<float>" else np.float64

    def pack(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_id")
        return pd.DataFrame({"tile": p["tile"].iloc[:1], "ids": [p["_id"].to_numpy(np.int64).tobytes()], "flat": [np.stack(p["_v"].to_list()).astype(kind).tobytes()]})

    dealt = rows.select(F.col(key).alias("_id"), F.col(column).alias("_v"), F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("tile"))
    return cut(dealt.groupBy("tile").applyInPandas(pack, "tile int, ids binary, flat binary")), n


def best_products(vectors: DataFrame, k: int, queries: DataFrame | None = None, key: str = "vec_id", column: str = "embedding", measure: Callable[[np.ndarray], np.ndarray] = lambda s: s) -> DataFrame:
    """(query_id, vec_id, score): for each query and each tile of vectors the k best of the tile by ``measure`` of the inner product in
    double precision, other than the query's own key; ties to the smaller key. ``queries`` (``key``, ``column``) are the vectors
    themselves unless given; then each two tiles are multiplied once, for both.

    Tasks hold two tiles, and rows grow with queries x tiles x k, not with pairs. Which of two tiles travels alternates, and the
    tiles that come to one are dealt to tasks by MEETINGS.
    """
    tiles, n = packed(vectors, key, column)
    asked, m = (tiles, n) if queries is None else packed(queries, key, column)
    kind = np.float32 if vectors.schema[column].dataType.simpleString() == "array<float>" else np.float64
    kind2 = kind if queries is None or queries.schema[column].dataType.simpleString() == "array<float>" else np.float64
    both = queries is None
    to = F.sequence(F.lit(0), F.lit(m - 1))
    if both:
        to = F.filter(to, lambda b: (b >= F.col("tile")) == ((F.col("tile") + b) % 2 == 0))
    left = tiles.withColumn("other", F.explode(to)).withColumn("part", F.expr(f"tile div {MEETINGS}"))
    right = asked.select(F.col("tile").alias("other"), F.explode(F.sequence(F.lit(0), F.lit((n - 1) // MEETINGS))).alias("part"), F.col("ids").alias("ids2"), F.col("flat").alias("flat2"))

    def best(scores: np.ndarray, ids: np.ndarray, of: np.ndarray) -> pd.DataFrame:
        order = np.argsort(-scores, axis=1, kind="stable")[:, :k]  # ids are sorted: ties to the smaller
        top = np.take_along_axis(scores, order, 1)
        there = np.isfinite(top)
        return pd.DataFrame({"query_id": np.repeat(of, there.sum(axis=1)), "vec_id": ids[order][there], "score": top[there]})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for tile, other, ids, flat, ids2, flat2 in p.itertuples(index=False, name=None):
                a, b = np.frombuffer(ids, np.int64), np.frombuffer(ids2, np.int64)
                x, y = np.frombuffer(flat, kind).reshape(len(a), -1).astype(float), np.frombuffer(flat2, kind2).reshape(len(b), -1).astype(float)
                scores = measure(y @ x.T)
                scores[b[:, None] == a[None, :]] = -np.inf
                yield best(scores, a, b)
                if both and tile != other:
                    yield best(scores.T, b, a)

    pairs = left.join(right, ["other", "part"]).select("tile", "other", "ids", "flat", "ids2", "flat2")
    return pairs.mapInPandas(met, "query_id long, vec_id long, score double")
