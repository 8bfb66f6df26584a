"""Ranking vectors against a query vector, and frames by their vectors. Ties go to the smaller id throughout."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import SIDES
from ..functions.vectors import dot, vector
from .products import best_products
from .spatial import box_join


def scored(vectors: DataFrame, query: Sequence[float], column: str = "embedding", name: str = "score") -> DataFrame:
    """Adds the inner product with a query vector: a scan; the vector is a literal of the plan."""
    return vectors.withColumn(name, dot(column, vector(query)))


def without(rows: DataFrame, exclude: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is not in ``exclude``."""
    return rows if exclude is None else rows.join(exclude.select(key).distinct(), key, "left_anti")


def top_k(rows: DataFrame, k: int, key: str, score: str = "score") -> DataFrame:
    """The k best rows, each task keeping k (TakeOrdered)."""
    return rows.orderBy(F.desc(score), key).limit(k)


def coarse_query(vectors: DataFrame, query: Sequence[float], k: int, key: str = "vec_id", exclude: DataFrame | None = None, column: str = "embedding") -> DataFrame:
    """(key, score) of the k best vectors that are not excluded."""
    return top_k(scored(without(vectors, exclude, key), query, column).select(key, "score"), k, key)


def random_batch(rows: DataFrame, k: int, key: str, seed: int, exclude: DataFrame | None = None) -> DataFrame:
    """k of the remaining ids by a seeded hash: the same on every run and partitioning."""
    return without(rows, exclude, key).select(key).distinct().orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), key).limit(k)


def frame_scores(rows: DataFrame, frame: str = "dbidx", score: str = "score") -> DataFrame:
    """(frame, max_score, n): pooled over the frame's vectors."""
    return rows.groupBy(frame).agg(F.max(score).alias("max_score"), F.count(score).alias("n"))


def top_frames(rows: DataFrame, k: int, frame: str = "dbidx", exclude: DataFrame | None = None, score: str = "score") -> DataFrame:
    """(frame, max_score) of the k best frames that are not excluded."""
    pooled = frame_scores(without(rows, exclude, frame), frame, score).select(frame, "max_score")
    return pooled.orderBy(F.desc("max_score"), frame).limit(k)


def distinct_positions(ranked: DataFrame, k: int, frame: str = "dbidx", position: str = "position") -> DataFrame:
    """The first position of each of the first k different frames of a ranking."""
    return ranked.groupBy(frame).agg(F.min(position).alias(position)).orderBy(position).limit(k)


def many_queries(vectors: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", query_key: str = "query_id", column: str = "embedding") -> DataFrame:
    """(query_key, rank, key, score): the k best vectors of each query, other than itself, ties to the smaller key. ``queries`` are any
    number of (query_key, vector): tiles of both meet in matrix products (``best_products``)."""
    q = queries.select(F.col(query_key).alias(key), F.col("vector").alias(column))
    found = best_products(vectors.select(key, column), k, q, key, column)
    found = found.select(F.col("query_id").alias(query_key), F.col("vec_id").alias(key), "score")
    order = Window.partitionBy(query_key).orderBy(F.desc("score"), key)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def min_zoom(tiles: DataFrame, level: int, frame: str = "dbidx") -> DataFrame:
    """Tiles at least as far out as ``level``, and the frame's farthest whatever its level."""
    return tiles.withColumn("_most", F.max("zoom_level").over(Window.partitionBy(frame))).where((F.col("zoom_level") == F.col("_most")) | (F.col("zoom_level") >= level)).drop("_most")


def rescored(tiles: DataFrame, method: str = "plain_score", larger: str = "all", key: str = "vec_id", frame: str = "dbidx") -> DataFrame:
    """(key, frame, score): tiles of candidate frames, each scored with the tiles that overlap it.

    ``plain_score`` leaves scores as they are. ``level_max``: of each zoom level the tile with the largest IoU (ties to the smaller
    id) speaks, and the mean over levels counts. ``cont_weighted``: the mean over overlapping tiles, weighted by the softmax of how
    much of the tile they contain. ``larger`` picks levels: ``all``, ``greater`` (as far out or farther) or ``adjacent`` (the same).
    """
    if method == "plain_score":
        return tiles.select(key, frame, "score")
    zoom = {"all": F.lit(True), "greater": F.col("zoom_level_right") >= F.col("zoom_level_left"), "adjacent": F.col("zoom_level_right") == F.col("zoom_level_left")}[larger]
    side = tiles.select(key, frame, "zoom_level", "score", *SIDES)
    pairs = box_join(side, side, frame).where(zoom)
    by = [frame, f"{key}_left"]
    if method == "level_max":
        order = Window.partitionBy(*by, "zoom_level_right").orderBy(F.desc("iou"), f"{key}_right")
        best = pairs.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
        out = best.groupBy(*by).agg(F.avg("score_right").alias("score"))
    elif method == "cont_weighted":
        weight = F.exp(F.col("cont"))  # containment is at most 1: no shift is needed
        out = pairs.groupBy(*by).agg((F.sum(weight * F.col("score_right")) / F.sum(weight)).alias("score"))
    else:
        raise ValueError(f"unknown method {method!r}")
    return out.select(F.col(f"{key}_left").alias(key), frame, "score")


def multiscale_query(
    tiles: DataFrame, query: Sequence[float], k: int, shortlist: int | None = None, exclude: DataFrame | None = None, contrast: Sequence[float] | None = None,
    method: str = "plain_score", larger: str = "all", key: str = "vec_id", frame: str = "dbidx", column: str = "embedding", rescore: Callable[[str], Column] | None = None,
) -> DataFrame:
    """(frame, key, score): the k best frames, each with its best tile.

    Frames are shortlisted by their best plain score (5 k of them by default); all tiles of those are scored again, by ``rescore`` (a
    function of the vectors' column) if given, with the score for ``contrast`` taken off, and rescored by ``method``. Nothing is
    left: an empty result.
    """
    plain = scored(tiles, query, column)
    chosen = top_frames(plain, shortlist or 5 * k, frame, exclude)
    near = plain.join(chosen.select(frame), frame, "left_semi")
    if rescore is not None:
        near = near.withColumn("score", rescore(column))
    if contrast is not None:
        near = near.withColumn("score", F.col("score") - dot(column, vector(contrast)))
    return reranked(near, k, method, larger, key, frame)


def reranked(near: DataFrame, k: int, method: str = "plain_score", larger: str = "all", key: str = "vec_id", frame: str = "dbidx") -> DataFrame:
    """(frame, key, score): the k best frames of scored tiles, rescored by ``method``, each with its best tile."""
    new = rescored(near, method, larger, key, frame)
    level = F.round("score", 9)  # means are summed in any order: scores that agree to nine digits are ties
    order = Window.partitionBy(frame).orderBy(level.desc(), key)
    best = new.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").select(frame, key, "score")
    return best.orderBy(level.desc(), frame).limit(k)


def at_least_kth(rows: DataFrame, k: int, key: str = "vec_id", frame: str = "dbidx") -> DataFrame:
    """All vectors that score at least as well as the k-th best frame does."""
    kth = top_frames(rows, k, frame).agg(F.min("max_score").alias("_cutoff"))  # one row
    return rows.join(F.broadcast(kth), F.col("score") >= F.col("_cutoff")).select(key, frame, "score")


def one_per_group(rows: DataFrame, k: int, group: str, frame: str = "dbidx") -> DataFrame:
    """(group, frame, score): the k best groups (say videos), each by its best frame."""
    order = Window.partitionBy(group).orderBy(F.desc("score"), frame)
    best = rows.withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    return best.select(group, frame, "score").orderBy(F.desc("score"), group).limit(k)


def overridden_top_k(base: DataFrame, changed: DataFrame, seen: DataFrame, k: int, key: str = "vec_id") -> DataFrame:
    """(key, score): the k best of a base ranking with some scores replaced and some keys seen already."""
    new = changed.select(key, F.col("score").alias("_new"))
    merged = base.join(new, key, "left").withColumn("score", F.coalesce("_new", "score")).select(key, "score")
    return top_k(without(merged, seen, key), k, key)


def pooled_vectors(tiles: DataFrame, frame: str = "dbidx", column: str = "embedding", floor: float = 1e-6) -> DataFrame:
    """(frame, vectors): the mean of the vectors of the frame's farthest zoom level, scaled to length one.

    Means are taken per component (explode and average, with partial sums), so a frame of any number of tiles is no single group.
    """
    from ..functions.vectors import normalized

    far = tiles.withColumn("_most", F.max("zoom_level").over(Window.partitionBy(frame))).where("zoom_level = _most")
    parts = far.select(frame, F.posexplode(F.col(column).cast("array<double>")).alias("_at", "_x"))
    means = parts.groupBy(frame, "_at").agg(F.avg("_x").alias("_x"))
    whole = means.groupBy(frame).agg(F.array_sort(F.collect_list(F.struct("_at", "_x"))).alias("_v"))
    return whole.select(frame, normalized(F.transform("_v", lambda s: s["_x"]), floor).alias("vectors"))


def with_buckets(vectors: DataFrame, planes: Sequence[Sequence[float]], column: str = "embedding", name: str = "bucket") -> DataFrame:
    """Adds a vector's bucket: a bit for each plane, set on its positive side. Written partitioned by it, a search reads few folders."""
    bits = [F.when(dot(column, vector(p)) > 0, 1 << i).otherwise(0) for i, p in enumerate(planes)]
    return vectors.withColumn(name, sum(bits[1:], bits[0]).cast("int"))


def approximate_frames(
    indexed: DataFrame, query: Sequence[float], planes: Sequence[Sequence[float]], k: int, exclude: DataFrame | None = None, factor: int = 10,
    frame: str = "dbidx", column: str = "embedding", name: str = "bucket",
) -> DataFrame:
    """(frame, max_score) of the k best frames found near the query: buckets at a growing number of differing bits are searched
    until they hold ``factor`` times k vectors of frames not excluded, and k such frames; at most all, which is exact."""
    mine = sum(1 << i for i, p in enumerate(planes) if sum(a * b for a, b in zip(p, query, strict=True)) > 0)
    for radius in range(len(planes) + 1):
        near = without(indexed.where(F.bit_count(F.col(name).bitwiseXOR(F.lit(mine))) <= radius), exclude, frame)
        if radius == len(planes):
            break
        if near.limit(factor * k).count() >= factor * k and near.select(frame).distinct().limit(k).count() >= k:
            break
    return top_frames(scored(near, query, column), k, frame)


def anchored(tiles: DataFrame, query: Sequence[float], method: str = "avg_score", key: str = "vec_id", frame: str = "dbidx", column: str = "embedding") -> DataFrame:
    """(frame, key, score): each frame's best tile, scored anew with the tile of each zoom level that overlaps it most (ties to the
    smaller id): the mean of their scores (``avg_score``), or the score of their mean vector at length one (``avg_vector``)."""
    rows = scored(tiles, query, column)
    best = Window.partitionBy(frame).orderBy(F.desc("score"), key)
    anchors = rows.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select(key, frame, *SIDES)
    side = rows.select(key, frame, "zoom_level", "score", *SIDES)
    order = Window.partitionBy(frame, "zoom_level_right").orderBy(F.desc("iou"), f"{key}_right")
    chosen = box_join(anchors, side, frame).withColumn("_rank", F.row_number().over(order)).where("_rank = 1")
    if method == "avg_score":
        return chosen.groupBy(frame, F.col(f"{key}_left").alias(key)).agg(F.avg("score_right").alias("score"))
    if method != "avg_vector":
        raise ValueError(f"unknown method {method!r}")
    from ..functions.vectors import normalized

    joined = chosen.select(frame, F.col(f"{key}_left").alias("_anchor"), F.col(f"{key}_right").alias(key)).join(tiles.select(key, column), key)
    parts = joined.select(frame, "_anchor", F.posexplode(F.col(column).cast("array<double>")).alias("_at", "_x")).groupBy(frame, "_anchor", "_at").agg(F.avg("_x").alias("_x"))
    means = parts.groupBy(frame, F.col("_anchor").alias(key)).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_x"))), lambda s: s["_x"]).alias("_v"))
    return means.select(frame, key, dot(normalized("_v"), vector(query)).alias("score"))
