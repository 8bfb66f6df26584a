"""k-nearest-neighbour graphs as edge tables (src_vertex, dst_vertex, distance, dst_rank), and what is computed along them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import rbf_kernel
from ..sources.shared import cut
from .products import best_products

def exact_knn(vectors: DataFrame, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The exact graph: k neighbours of each vector by cosine distance 1 - dot (vectors of length one), and the vector itself, rank 0.

    Each two tiles of vectors are one matrix product that returns k candidates a vector (``best_products``). Ties go to the smaller id.
    """
    near = best_products(vectors, k, key=key, column=column, measure=lambda s: -np.maximum(1 - s, 0))
    found = near.select(F.col("query_id").alias("src_vertex"), F.col("vec_id").alias("dst_vertex"), (-F.col("score")).alias("distance"))
    return ranked_edges(found, vectors.select(F.col(key).alias("src_vertex"))).where(F.col("dst_rank") <= k)


def ranked_edges(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges without loops ranked from 1 by distance (ties to the smaller id), distances at least 0, and a loop of rank 0 for each vertex."""
    order = Window.partitionBy("src_vertex").orderBy("distance", "dst_vertex")
    proper = edges.where("src_vertex <> dst_vertex").withColumn("distance", F.greatest("distance", F.lit(0.0)))
    proper = proper.withColumn("dst_rank", F.row_number().over(order)).select("src_vertex", "dst_vertex", "distance", "dst_rank")
    loops = vertices.select("src_vertex", F.col("src_vertex").alias("dst_vertex"), F.lit(0.0).alias("distance"), F.lit(0).alias("dst_rank"))
    return proper.unionByName(loops)


def restrict_k(edges: DataFrame, k: int) -> DataFrame:
    """The first k neighbours, the vertex itself counted."""
    return edges.where(F.col("dst_rank") < k)


def factored(edges: DataFrame, frame: Callable[[str], Column], k_intra: int) -> DataFrame:
    """Edges within a frame (at most ``k_intra``, the loop counted) and between frames (the nearest of each other frame), with ``kind``
    and ranks from 1 within each kind."""
    e = edges.withColumn("src_frame", frame("src_vertex")).withColumn("dst_frame", frame("dst_vertex"))
    order = Window.partitionBy("src_vertex").orderBy("distance", "dst_vertex")
    of_frame = Window.partitionBy("src_vertex", "dst_frame").orderBy("distance", "dst_vertex")
    cols = ["src_vertex", "dst_vertex", "distance", "dst_rank", "kind"]
    inter = e.where("src_frame <> dst_frame").withColumn("_best", F.row_number().over(of_frame)).where("_best = 1")
    inter = inter.withColumn("dst_rank", F.row_number().over(order)).withColumn("kind", F.lit("inter"))
    intra = e.where("src_frame = dst_frame").withColumn("dst_rank", F.row_number().over(order)).where(F.col("dst_rank") <= k_intra).withColumn("kind", F.lit("intra"))
    return inter.select(*cols).unionByName(intra.select(*cols))


def weights(edges: DataFrame, kernel: Callable[[Column], Column] = lambda d: rbf_kernel(d, 0.03), symmetric: bool = True) -> DataFrame:
    """(i, j, w) of a kernel over distances, without loops; symmetric: the mean over the directions that there are."""
    w = edges.where("src_vertex <> dst_vertex").select(F.col("src_vertex").alias("i"), F.col("dst_vertex").alias("j"), kernel(F.col("distance")).alias("w"))
    if not symmetric:
        return w
    return w.unionByName(w.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")).groupBy("i", "j").agg(F.avg("w").alias("w"))


def degrees(w: DataFrame) -> DataFrame:
    return w.groupBy("i").agg(F.sum("w").alias("degree"), F.count("w").alias("n"))


def laplacian(w: DataFrame, normalized: bool = False) -> DataFrame:
    """(i, j, w) of D - W, or of D^-1/2 (D - W) D^-1/2, the diagonal included."""
    d = degrees(w).select("i", "degree")
    diagonal = d.select("i", F.col("i").alias("j"), (F.lit(1.0) if normalized else F.col("degree")).alias("w"))
    if not normalized:
        return w.select("i", "j", (-F.col("w")).alias("w")).unionByName(diagonal)
    other = d.select(F.col("i").alias("j"), F.col("degree").alias("degree_j"))
    off = w.join(d, "i").join(other, "j").select("i", "j", (-F.col("w") / F.sqrt(F.col("degree") * F.col("degree_j"))).alias("w"))
    return off.unionByName(diagonal)


def edge_loss(w: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: y' L y, the weighted squared differences of labels (vertex, y) along edges, each counted once."""
    a = labels.select(F.col("vertex").alias("i"), F.col("y").alias("y_i"))
    b = labels.select(F.col("vertex").alias("j"), F.col("y").alias("y_j"))
    once = w.where("i < j").join(a, "i").join(b, "j")
    return once.agg(F.sum(F.col("w") * (F.col("y_i") - F.col("y_j")) ** 2).alias("loss"))


def spread_matrix(w: DataFrame, vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(r, c, v) of X' (L / tr L) X: how much vectors differ along edges, per pair of components. Summed edge by edge, in partial sums."""
    v = vectors.select(F.col(key).alias("i"), F.col(column).cast("array<double>").alias("x"))
    other = v.select(F.col("i").alias("j"), F.col("x").alias("x2"))
    diff = w.where("i < j").join(v, "i").join(other, "j").select("w", F.zip_with("x", "x2", lambda a, b: a - b).alias("d"))
    rows = diff.select("w", "d", F.posexplode("d").alias("r", "dr")).select("r", F.posexplode(F.transform("d", lambda x: x * F.col("dr") * F.col("w"))).alias("c", "p"))
    trace = w.agg(F.sum("w").alias("trace"))  # one row: the sum of degrees
    return rows.groupBy("r", "c").agg(F.sum("p").alias("p")).join(F.broadcast(trace)).select("r", "c", (F.col("p") / F.col("trace")).alias("v"))


def propagated(w: DataFrame, prior: DataFrame, labels: DataFrame, prior_weight: float, steps: int = 300, tolerance: float | None = 1e-5) -> DataFrame:
    """(vertex, f): label propagation. f <- (sum of w f over neighbours + prior_weight prior) / (degree + prior_weight), labels held.

    ``prior`` is (vertex, f), ``labels`` (vertex, y). Every step is one join and one aggregate, written to the shared folder; one
    number a step reaches the driver. Stops when no value moves by more than the square root of ``tolerance``; the newest values
    are returned.
    """
    d = degrees(w).select(F.col("i").alias("vertex"), "degree")
    base = prior.select("vertex", F.col("f").alias("prior")).join(d, "vertex", "left").join(labels.select("vertex", "y"), "vertex", "left")
    base = cut(base.select("vertex", "prior", F.coalesce("degree", F.lit(0.0)).alias("degree"), "y"))
    f = base.select("vertex", F.coalesce("y", "prior").cast("double").alias("f"))
    for _ in range(steps):
        from_there = w.join(f.select(F.col("vertex").alias("j"), "f"), "j").groupBy(F.col("i").alias("vertex")).agg(F.sum(F.col("w") * F.col("f")).alias("pull"))
        total = F.col("degree") + prior_weight
        moved = F.when(total > 0, (F.coalesce("pull", F.lit(0.0)) + F.col("prior") * prior_weight) / F.nullif(total, F.lit(0.0))).otherwise(F.col("prior"))
        new = cut(base.join(from_there, "vertex", "left").select("vertex", F.coalesce(F.col("y").cast("double"), moved).alias("f")))
        if tolerance is not None:
            most = new.join(f.withColumnRenamed("f", "old"), "vertex").agg(F.max((F.col("f") - F.col("old")) ** 2)).first()[0]
            if most is None or most < tolerance:
                return new
        f = new
    return f


def neighbour_scores(edges: DataFrame, prior: DataFrame, labels: DataFrame) -> DataFrame:
    """(vertex, score): (prior + labels of labelled neighbours) / (1 + how many); labelled vertices score their label.

    A vertex counts a labelled one if that is among its own neighbours (edges are read against their direction).
    """
    near = edges.where("src_vertex <> dst_vertex").join(labels.select(F.col("vertex").alias("dst_vertex"), "y"), "dst_vertex")
    told = near.groupBy(F.col("src_vertex").alias("vertex")).agg(F.sum("y").alias("total"), F.count("y").alias("n"))
    out = prior.select("vertex", "f").join(told, "vertex", "left").join(labels.select("vertex", "y"), "vertex", "left")
    score = (F.col("f") + F.coalesce("total", F.lit(0.0))) / (1 + F.coalesce("n", F.lit(0)))
    return out.select("vertex", F.coalesce(F.col("y").cast("double"), score).alias("score"))


def promises(edges: DataFrame, scores: DataFrame, known: DataFrame, horizon: int, key: str = "vec_id") -> DataFrame:
    """(key, promise) of every open vertex of ``scores`` (key, score): the positives expected of ``horizon`` look-ups that begin with it.

    A look-up moves the vertices that have the vertex among their neighbours (``neighbour_scores``; ``known`` are the labelled keys). With
    p its score and b the sum of the horizon - 1 best others then, the promise is p (1 + b after a positive) + (1 - p) b after a
    negative. Of what moves, horizon - 1 rows a vertex matter either way; of what stays, the best of all, a short list that is made
    longer until enough of it stays for every vertex. So no vertex is left out, and no hub's neighbours gather in one row.
    """
    others = horizon - 1
    open_ = scores.select(F.col(key), F.col("score").cast("double").alias("score"))
    proper = edges.where("src_vertex <> dst_vertex").select("src_vertex", "dst_vertex")
    told = proper.join(known.select(F.col(key).alias("dst_vertex")), "dst_vertex").groupBy(F.col("src_vertex").alias("_u")).agg(F.count(F.lit(1)).alias("_n"))
    near = proper.join(open_.select(F.col(key).alias("dst_vertex")), "dst_vertex").join(open_.select(F.col(key).alias("src_vertex"), F.col("score").alias("_p")), "src_vertex")
    near = near.select(F.col("dst_vertex").alias(key), F.col("src_vertex").alias("_u"), "_p").join(told, "_u", "left")
    n = F.coalesce(F.col("_n"), F.lit(0))
    near = cut(near.select(key, "_u", ((F.col("_p") * (1 + n) + 1) / (2 + n)).alias("up"), (F.col("_p") * (1 + n) / (2 + n)).alias("down")))
    size, every = 4 * horizon, open_.count()
    while True:
        best = [(r[key], r["score"]) for r in open_.orderBy(F.desc("score"), key).limit(size).collect()]
        rank = lambda c: F.row_number().over(Window.partitionBy(key).orderBy(F.desc(c), "_u"))
        moved = near.withColumn("_up", rank("up") <= others).withColumn("_down", rank("down") <= others)
        moved = moved.where(F.col("_up") | F.col("_down") | F.col("_u").isin([v for v, _ in best]))
        moved = moved.groupBy(key).agg(F.collect_list("_u").alias("us"), F.collect_list(F.when(F.col("_up"), F.col("up"))).alias("ups"), F.collect_list(F.when(F.col("_down"), F.col("down"))).alias("downs"))
        stay = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in best]) if best else F.expr("cast(array() as array<struct<v:bigint,s:double>>)")
        rows = open_.join(moved, key, "left")
        rows = rows.withColumn("_rest", F.filter(stay, lambda b: (b["v"] != F.col(key)) & ~F.coalesce(F.array_contains("us", b["v"]), F.lit(False))))
        if size >= every or not rows.where(F.size("_rest") < others).limit(1).count():
            break
        size *= 4

    def after(moved: str) -> Column:
        values = F.concat(F.transform("_rest", lambda b: b["s"]), F.coalesce(F.col(moved), F.expr("cast(array() as array<double>)")))
        return F.aggregate(F.slice(F.sort_array(values, asc=False), 1, max(1, others)), F.lit(0.0), lambda t, x: t + x) if others else F.lit(0.0)

    return rows.select(key, (F.col("score") * (1 + after("ups")) + (1 - F.col("score")) * after("downs")).alias("promise"))


def min_max(rows: DataFrame, column: str, epsilon: float = 0.0) -> DataFrame:
    """``column`` scaled to [epsilon, 1 - epsilon]; 0.5 if all are equal. Two numbers are aggregated and joined back."""
    ends = rows.agg(F.min(column).alias("_lo"), F.max(column).alias("_hi"))
    wide = F.col("_hi") - F.col("_lo")
    scaled = F.when(wide > 0, (F.col(column) - F.col("_lo")) / F.nullif(wide, F.lit(0.0)) * (1 - 2 * epsilon) + epsilon).otherwise(0.5)
    return rows.join(F.broadcast(ends)).withColumn(column, scaled).drop("_lo", "_hi")
