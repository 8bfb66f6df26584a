"""Registered queries over the sample tables, each with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import batches, boxes, grid, metrics, text, vectors
from .operators import graph, labels, logs, ranks, search, sets, spatial, tracking
from .plans import feedback, models, reports, session
from .sources import tables
from .sources.shared import cut, shared_dir
from .streaming import log as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name. Doubles are rounded to six digits, as in the SQL."""

    def add(fun):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fun(spark, sf_dir)
            return df.select(*[F.round(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])

        run.__doc__ = fun.__doc__
        QUERIES[fun.__name__] = run
        if sql:
            SQL[fun.__name__] = sql
        return fun

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- tables made from the samples -------------------------------------------------------------------------------------------------


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five boxes a frame at three zoom levels, from the embeddings' ids."""
    e = table(spark, sf_dir, "embeddings").withColumn("dbidx", F.expr("vec_id div 5")).withColumn("t", F.expr("vec_id % 5")).withColumn("s", F.expr("(vec_id div 5) % 7"))
    pick = lambda *v: F.expr(f"double(case t when 0 then {v[0]} when 1 then {v[1]} when 2 then {v[2]} when 3 then {v[3]} else {v[4]} end)")
    return e.select(
        "vec_id", "dbidx", "embedding", "label", F.expr("case t when 0 then 2 when 1 then 1 when 2 then 1 else 0 end").alias("zoom_level"),
        pick(0, "s", 40, "s", 70).alias("x1"), pick(0, 0, 40, 0, 70).alias("y1"), pick(100, "60 + s", 100, "30 + s", 100).alias("x2"), pick(100, 60, 100, 30, 100).alias("y2"),
    )


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").where("vec_id % 4 = 0")
    return e.selectExpr("vec_id as box_id", "vec_id div 5 as dbidx", "label as category", "double(5 + vec_id % 50) as x1", "double(5 + vec_id % 40) as y1", "double(25 + vec_id % 50) as x2", "double(25 + vec_id % 40) as y2")


def embedding_of(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One method run a user: hits are the positions of purchases. Positions are collected per user, which a run bounds."""
    log = logs.positions(table(spark, sf_dir, "events"))
    hits = F.array_sort(F.collect_list(F.when(F.col("event_type") == "purchase", F.col("pos"))))
    out = log.groupBy("user_id").agg(hits.alias("hit_indices"), F.count(F.lit(1)).alias("nseen"))
    return out.selectExpr("user_id % 3 as variant", "user_id div 3 as category", "(user_id div 3) % 4 as dataset", "hit_indices", "nseen", "size(hit_indices) + (user_id div 3) % 3 as ntotal")


def stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = runs(spark, sf_dir).where("ntotal > 0")
    return r.select("dataset", "category", "variant", *[c.alias(n) for n, c in metrics.run_metrics().items()])


TILES = """tiles AS (
  SELECT vec_id, vec_id // 5 AS dbidx, embedding::DOUBLE[] AS v, label,
    CASE vec_id % 5 WHEN 0 THEN 2 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS zoom_level,
    (CASE vec_id % 5 WHEN 0 THEN 0 WHEN 1 THEN s WHEN 2 THEN 40 WHEN 3 THEN s ELSE 70 END)::DOUBLE AS x1,
    (CASE vec_id % 5 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 40 WHEN 3 THEN 0 ELSE 70 END)::DOUBLE AS y1,
    (CASE vec_id % 5 WHEN 0 THEN 100 WHEN 1 THEN 60 + s WHEN 2 THEN 100 WHEN 3 THEN 30 + s ELSE 100 END)::DOUBLE AS x2,
    (CASE vec_id % 5 WHEN 0 THEN 100 WHEN 1 THEN 60 WHEN 2 THEN 100 WHEN 3 THEN 30 ELSE 100 END)::DOUBLE AS y2
  FROM (SELECT *, (vec_id // 5) % 7 AS s FROM embeddings))"""
ANN = """ann AS (
  SELECT vec_id AS box_id, vec_id // 5 AS dbidx, label AS category, (5 + vec_id % 50)::DOUBLE AS x1, (5 + vec_id % 40)::DOUBLE AS y1,
    (25 + vec_id % 50)::DOUBLE AS x2, (25 + vec_id % 40)::DOUBLE AS y2 FROM embeddings WHERE vec_id % 4 = 0)"""
Q0, Q1 = "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)", "(SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 1)"
SCORED = f"scored AS (SELECT *, list_dot_product(v, {Q0}) AS score FROM tiles)"
LOG = "log AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos FROM events)"
RUNS = f"""{LOG}, runs AS (
  SELECT user_id % 3 AS variant, user_id // 3 AS category, (user_id // 3) % 4 AS dataset,
    coalesce(list(pos ORDER BY pos) FILTER (event_type = 'purchase'), []) AS hits, count(*) AS nseen,
    count(*) FILTER (event_type = 'purchase') + (user_id // 3) % 3 AS ntotal
  FROM log GROUP BY user_id)"""
_DCG = "coalesce(list_sum(list_transform({}, lambda h: 1 / log2(h + 2))), 0)"
_KTH = "CASE WHEN ntotal < {k} THEN 'nan'::DOUBLE WHEN len(hits) < {k} THEN 'inf'::DOUBLE ELSE hits[{k}] + 1 END"
STATS = f"""{RUNS}, stats AS (
  SELECT dataset, category, variant, len(hits) AS nfound,
    {_DCG.format("hits")} / {_DCG.format("range(least(ntotal, nseen))")} AS ndcg_score,
    coalesce(list_sum(list_transform(hits[1:ntotal], lambda h, i: i / (h + 1.0)::DOUBLE)), 0) / ntotal AS average_precision,
    {_KTH.format(k=1)} AS rank_first, CASE WHEN len(hits) = 0 THEN 0.0 ELSE 1.0 / (hits[1] + 1)::DOUBLE END AS reciprocal_rank,
    {_KTH.format(k=2)} AS rank_second, {_KTH.format(k=3)} AS rank_third, {_KTH.format(k=10)} AS rank_tenth
  FROM runs WHERE ntotal > 0)"""
_WIDE = "least(a.x2, b.x2) - greatest(a.x1, b.x1)"
_HIGH = "least(a.y2, b.y2) - greatest(a.y1, b.y1)"
_OVERLAP = "a.dbidx = b.dbidx AND a.x1 < b.x2 AND b.x1 < a.x2 AND a.y1 < b.y2 AND b.y1 < a.y2"
_INTER = f"({_WIDE}) * ({_HIGH})"
_IOU = f"({_INTER}) / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - ({_INTER}))"
_CONT = f"({_INTER}) / ((a.x2 - a.x1) * (a.y2 - a.y1))"

# --- ranking ----------------------------------------------------------------------------------------------------------------------


@query(f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {Q0}), 6) AS score FROM embeddings ORDER BY list_dot_product(embedding::DOUBLE[], {Q0}) DESC, vec_id LIMIT 10")
def coarse_topk(spark, sf):
    return search.coarse_query(table(spark, sf, "embeddings"), embedding_of(spark, sf, 0), 10)


@query(f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {Q0}), 6) AS score FROM embeddings WHERE vec_id % 3 <> 0 ORDER BY list_dot_product(embedding::DOUBLE[], {Q0}) DESC, vec_id LIMIT 10")
def coarse_topk_exclude(spark, sf):
    e = table(spark, sf, "embeddings")
    return search.coarse_query(e, embedding_of(spark, sf, 0), 10, exclude=e.where("vec_id % 3 = 0"))


@query(f"SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], {Q0}) - list_dot_product(embedding::DOUBLE[], {Q1}), 6) AS score FROM embeddings ORDER BY list_dot_product(embedding::DOUBLE[], {Q0}) - list_dot_product(embedding::DOUBLE[], {Q1}) DESC, vec_id LIMIT 10")
def contrast_topk(spark, sf):
    e = search.scored(table(spark, sf, "embeddings"), embedding_of(spark, sf, 0))
    e = e.withColumn("score", F.col("score") - vectors.dot("embedding", vectors.vector(embedding_of(spark, sf, 1))))
    return search.top_k(e, 10, "vec_id").select("vec_id", "score")


@query(f"WITH {TILES}, {SCORED} SELECT dbidx, round(max(score), 6) AS max_score, count(*) AS n FROM scored GROUP BY dbidx")
def frame_max_pool(spark, sf):
    return search.frame_scores(search.scored(tiles(spark, sf), embedding_of(spark, sf, 0)))


@query(f"WITH {TILES}, {SCORED} SELECT dbidx, round(max(score), 6) AS max_score FROM scored WHERE dbidx % 3 <> 0 GROUP BY dbidx ORDER BY max(score) DESC, dbidx LIMIT 10")
def distinct_frame_topk(spark, sf):
    t = tiles(spark, sf)
    return search.top_frames(search.scored(t, embedding_of(spark, sf, 0)), 10, exclude=t.where("dbidx % 3 = 0"))


@query(f"WITH {TILES}, {SCORED}, r AS (SELECT dbidx, row_number() OVER (ORDER BY score DESC, vec_id) - 1 AS position FROM scored) SELECT dbidx, min(position) AS position FROM r GROUP BY dbidx ORDER BY 2 LIMIT 7")
def distinct_positions(spark, sf):
    scored = search.scored(tiles(spark, sf), embedding_of(spark, sf, 0)).select("vec_id", "dbidx", "score")
    ranked = ranks.numbered(scored, [F.desc("score"), F.asc("vec_id")], "position")
    return search.distinct_positions(ranked, 7)


@query("""WITH p AS (SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM p) SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def multi_query_topk(spark, sf):
    e = table(spark, sf, "embeddings")
    found = search.many_queries(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5)
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "vec_id", "score")


@query(f"WITH {TILES}, m AS (SELECT *, max(zoom_level) OVER (PARTITION BY dbidx) AS most FROM tiles) SELECT vec_id, dbidx, zoom_level FROM m WHERE zoom_level = most OR zoom_level >= 1")
def min_zoom_filter(spark, sf):
    return search.min_zoom(tiles(spark, sf), 1).select("vec_id", "dbidx", "zoom_level")


def _multiscale_sql(body: str) -> str:
    return f"""WITH {TILES}, {SCORED},
short AS (SELECT dbidx FROM scored WHERE dbidx % 3 <> 0 GROUP BY dbidx ORDER BY max(score) DESC, dbidx LIMIT 25),
near AS (SELECT * FROM scored WHERE dbidx IN (SELECT dbidx FROM short)),
pairs AS (SELECT a.dbidx, a.vec_id, b.vec_id AS other, a.zoom_level AS za, b.zoom_level AS zb, b.score AS sb, {_IOU} AS iou, {_CONT} AS cont FROM near a JOIN near b ON {_OVERLAP}),
new AS ({body}),
best AS (SELECT *, row_number() OVER (PARTITION BY dbidx ORDER BY round(score, 9) DESC, vec_id) AS r FROM new)
SELECT dbidx, vec_id, round(score, 6) AS score FROM best WHERE r = 1 ORDER BY round(best.score, 9) DESC, dbidx LIMIT 5"""


def _level_max(where: str) -> str:
    return f"SELECT dbidx, vec_id, avg(sb) AS score FROM (SELECT *, row_number() OVER (PARTITION BY dbidx, vec_id, zb ORDER BY iou DESC, other) AS r FROM pairs WHERE {where}) WHERE r = 1 GROUP BY dbidx, vec_id"


def _multiscale(spark, sf, **how) -> DataFrame:
    t = tiles(spark, sf)
    return search.multiscale_query(t, embedding_of(spark, sf, 0), 5, exclude=t.where("dbidx % 3 = 0"), **how)


@query(_multiscale_sql("SELECT dbidx, vec_id, score FROM near"))
def multiscale_plain(spark, sf):
    return _multiscale(spark, sf)


@query(_multiscale_sql(_level_max("true")))
def multiscale_level_max(spark, sf):
    return _multiscale(spark, sf, method="level_max")


@query(_multiscale_sql(_level_max("zb >= za")))
def multiscale_greater(spark, sf):
    return _multiscale(spark, sf, method="level_max", larger="greater")


@query(_multiscale_sql(_level_max("zb = za")))
def multiscale_adjacent(spark, sf):
    return _multiscale(spark, sf, method="level_max", larger="adjacent")


@query(_multiscale_sql("SELECT dbidx, vec_id, sum(exp(cont) * sb) / sum(exp(cont)) AS score FROM pairs GROUP BY dbidx, vec_id"))
def multiscale_cont_weighted(spark, sf):
    return _multiscale(spark, sf, method="cont_weighted")


@query(f"WITH {TILES}, {SCORED}, k AS (SELECT max(score) AS m FROM scored GROUP BY dbidx ORDER BY max(score) DESC, dbidx LIMIT 5) SELECT vec_id, dbidx, round(score, 6) AS score FROM scored WHERE score >= (SELECT min(m) FROM k)")
def cutoff_activations(spark, sf):
    return search.at_least_kth(search.scored(tiles(spark, sf), embedding_of(spark, sf, 0)), 5)


@query(f"WITH {TILES}, {SCORED}, b AS (SELECT dbidx // 4 AS video_id, dbidx, score, row_number() OVER (PARTITION BY dbidx // 4 ORDER BY score DESC, dbidx) AS r FROM scored) SELECT video_id, dbidx, round(score, 6) AS score FROM b WHERE r = 1 ORDER BY b.score DESC, video_id LIMIT 6")
def video_topk(spark, sf):
    rows = search.scored(tiles(spark, sf), embedding_of(spark, sf, 0)).withColumn("video_id", F.expr("dbidx div 4"))
    return search.one_per_group(rows, 6, "video_id")


@query(f"WITH s AS (SELECT vec_id, CASE WHEN vec_id % 10 = 3 THEN 0.5 ELSE list_dot_product(embedding::DOUBLE[], {Q0}) END AS score FROM embeddings WHERE vec_id % 7 <> 0) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 12")
def lazy_topk(spark, sf):
    base = search.scored(table(spark, sf, "embeddings"), embedding_of(spark, sf, 0)).select("vec_id", "score")
    changed = base.where("vec_id % 10 = 3").select("vec_id", F.lit(0.5).alias("score"))
    return search.overridden_top_k(base, changed, base.where("vec_id % 7 = 0"), 12)


@query(f"""WITH {TILES}, f AS (SELECT dbidx, v FROM tiles WHERE zoom_level = 2), p AS (SELECT dbidx, unnest(v) AS x, unnest(range(len(v))) AS component FROM f),
m AS (SELECT dbidx, component, avg(x) AS x FROM p GROUP BY dbidx, component), n AS (SELECT dbidx, greatest(sqrt(sum(x * x)), 1e-6) AS n FROM m GROUP BY dbidx) SELECT dbidx, component, round(x / n, 6) AS x FROM m JOIN n USING (dbidx)""")
def vector_mean_coarse(spark, sf):
    pooled = search.pooled_vectors(tiles(spark, sf))
    return pooled.select("dbidx", F.posexplode("vectors").alias("component", "x")).select("dbidx", F.col("component").cast("long").alias("component"), "x")


@query("SELECT dbidx FROM (SELECT DISTINCT vec_id // 5 AS dbidx FROM embeddings) WHERE dbidx % 3 <> 0 ORDER BY md5('7:' || dbidx), dbidx LIMIT 10")
def random_batch(spark, sf):
    """Ten remaining frames by a seeded hash."""
    t = tiles(spark, sf)
    return search.random_batch(t, 10, "dbidx", 7, t.where("dbidx % 3 = 0"))


# --- boxes ------------------------------------------------------------------------------------------------------------------------


@query(f"WITH {TILES} SELECT a.dbidx, a.vec_id AS vec_id_left, b.vec_id AS vec_id_right, round({_IOU}, 6) AS iou, round({_CONT}, 6) AS cont FROM tiles a JOIN tiles b ON {_OVERLAP}")
def box_join(spark, sf):
    t = tiles(spark, sf).select("dbidx", "vec_id", *boxes.SIDES)
    return spatial.box_join(t, t).select("dbidx", "vec_id_left", "vec_id_right", "iou", "cont")


_LEFT_IOU = f"WITH {TILES}, {ANN}, p AS (SELECT a.vec_id, max({_IOU}) AS iou FROM tiles a JOIN ann b ON {_OVERLAP} GROUP BY a.vec_id), j AS (SELECT tiles.vec_id, dbidx, coalesce(iou, 0) AS max_iou FROM tiles LEFT JOIN p USING (vec_id)) "


@query(_LEFT_IOU + "SELECT vec_id, dbidx, round(max_iou, 6) AS max_iou FROM j")
def left_iou_join(spark, sf):
    return spatial.left_iou_join(tiles(spark, sf), annotations(spark, sf)).select("vec_id", "dbidx", "max_iou")


@query(_LEFT_IOU + "SELECT vec_id, dbidx, (max_iou > 0)::INT AS y, round(max_iou, 6) AS max_iou FROM j WHERE dbidx % 3 = 0")
def match_labels(spark, sf):
    t = tiles(spark, sf)
    return spatial.labelled_vectors(t, annotations(spark, sf), t.where("dbidx % 3 = 0"))


_BEST = f"WITH {TILES}, {ANN}, p AS (SELECT a.box_id, b.vec_id, {_IOU} AS iou FROM ann a JOIN tiles b ON {_OVERLAP}), r AS (SELECT *, row_number() OVER (PARTITION BY box_id ORDER BY iou DESC, vec_id) AS r FROM p) "


@query(_BEST + "SELECT box_id, vec_id, round(iou, 6) AS iou FROM r WHERE r = 1")
def best_box_match(spark, sf):
    return spatial.best_match(annotations(spark, sf), tiles(spark, sf), "box_id", "vec_id")


@query(_BEST + "SELECT DISTINCT vec_id, 'positive' AS role FROM r WHERE r = 1 UNION ALL SELECT vec_id, 'negative' FROM tiles WHERE vec_id NOT IN (SELECT vec_id FROM p)")
def positives_negatives(spark, sf):
    return spatial.positives_and_negatives(tiles(spark, sf), annotations(spark, sf), "box_id")


_IMAGE = "im AS (SELECT *, 120 AS im_width, 90 AS im_height, least(greatest(least(greatest(x2 - x1, y2 - y1), 90), least(40, 90)), 90)::DOUBLE AS side FROM ann)"


@query(f"""WITH {ANN}, {_IMAGE}, p AS (SELECT box_id, side, greatest(0, least((x1 + x2) / 2 - side / 2, im_width - side)) AS sx1, greatest(0, least((y1 + y2) / 2 - side / 2, im_height - side)) AS sy1 FROM im)
SELECT box_id, sx1, sy1, sx1 + side AS sx2, sy1 + side AS sy2 FROM p""")
def square_box(spark, sf):
    a = annotations(spark, sf).withColumn("im_width", F.lit(120)).withColumn("im_height", F.lit(90))
    return a.select("box_id", *boxes.square_box(40))


@query(f"""WITH {ANN} SELECT box_id, round(greatest(0, (x1 + x2) / 2 - (x2 - x1) / 2 * 1.5), 6) AS px1, round(greatest(0, (y1 + y2) / 2 - (y2 - y1) / 2 * 1.5), 6) AS py1,
round(least(60, (x1 + x2) / 2 + (x2 - x1) / 2 * 1.5), 6) AS px2, round(least(50, (y1 + y2) / 2 + (y2 - y1) / 2 * 1.5), 6) AS py2 FROM ann""")
def padded_box(spark, sf):
    a = annotations(spark, sf).withColumn("im_width", F.lit(60)).withColumn("im_height", F.lit(50))
    return a.select("box_id", *boxes.padded_box(1.5))


@query(f"WITH {ANN} SELECT box_id, greatest(x1, 20) AS s1, least(x2, 40) AS s2, greatest(0, least(x2, 40) - greatest(x1, 20)) AS length FROM ann")
def segment_ops(spark, sf):
    s1, s2, n = boxes.segment_overlap(F.col("x1"), F.col("x2"), F.lit(20.0), F.lit(40.0))
    return annotations(spark, sf).select("box_id", s1.alias("s1"), s2.alias("s2"), n.alias("length"))


@query(f"""WITH RECURSIVE {TILES}, {SCORED}, o AS (SELECT *, row_number() OVER (PARTITION BY dbidx ORDER BY score DESC, vec_id) AS r FROM scored),
b AS (SELECT a.dbidx, a.r, list(b.r) AS covers FROM o a JOIN o b ON b.r < a.r AND {_OVERLAP} AND {_CONT} > 0.5 GROUP BY ALL), n AS (SELECT o.dbidx, o.vec_id, o.score, o.r, coalesce(covers, []) AS covers FROM o LEFT JOIN b ON o.dbidx = b.dbidx AND o.r = b.r),
k(dbidx, r, kept) AS (SELECT DISTINCT dbidx, 0::BIGINT, []::BIGINT[] FROM n UNION ALL SELECT k.dbidx, n.r, CASE WHEN list_has_any(n.covers, k.kept) THEN k.kept ELSE list_append(k.kept, n.r) END FROM k JOIN n ON n.dbidx = k.dbidx AND n.r = k.r + 1),
l AS (SELECT dbidx, unnest(kept) AS r FROM (SELECT dbidx, kept FROM k QUALIFY row_number() OVER (PARTITION BY dbidx ORDER BY r DESC) = 1)) SELECT n.dbidx, vec_id, round(score, 6) AS score FROM n JOIN l ON n.dbidx = l.dbidx AND n.r = l.r""")
def kept_boxes(spark, sf):
    """Greedy suppression is sequential within a frame."""
    t = search.scored(tiles(spark, sf), embedding_of(spark, sf, 0)).drop("embedding")
    return spatial.kept_boxes(t, ["vec_id"], "score", 0.5).select("dbidx", "vec_id", "score")


def tile_grid(images: DataFrame, tile: int, key: str, width: str, height: str) -> DataFrame:
    """(key, patch_id, tx1, ty1): tiles of a side of ``tile`` at half strides that fit into each image, row by row."""
    step = tile // 2
    starts = lambda size: F.expr(f"if({size} >= {tile}, sequence(0, {size} - {tile}, {step}), cast(array() as array<int>))")
    t = images.select(key, F.explode(starts(height)).alias("ty1"), starts(width).alias("_xs")).select(key, "ty1", F.explode("_xs").alias("tx1"))
    order = Window.partitionBy(key).orderBy("ty1", "tx1")
    return t.withColumn("patch_id", F.row_number().over(order) - 1).select(key, "patch_id", "tx1", "ty1")


@query("""WITH im AS (SELECT p_partkey, 224 + 32 * (p_partkey % 15) AS w, 224 + 32 * (p_partkey % 11) AS h FROM part), g AS (SELECT p_partkey, unnest(range(0, h - 224 + 1, 112)) AS ty1, w FROM im), t AS (SELECT p_partkey, ty1, unnest(range(0, w - 224 + 1, 112)) AS tx1 FROM g)
SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY ty1, tx1) - 1 AS patch_id, tx1, ty1 FROM t""")
def tiling_geometry(spark, sf):
    images = table(spark, sf, "part").selectExpr("p_partkey", "int(224 + 32 * (p_partkey % 15)) as w", "int(224 + 32 * (p_partkey % 11)) as h")
    return tile_grid(images, 224, "p_partkey", "w", "h").selectExpr("p_partkey", "bigint(patch_id) as patch_id", "bigint(tx1) as tx1", "bigint(ty1) as ty1")


# --- sources and sets -------------------------------------------------------------------------------------------------------------


@query(f"WITH {ANN} SELECT e.dbidx, " + ", ".join(f"least(count(*) FILTER (category = {c}), 1)::INT AS c_{c}" for c in range(4)) + " FROM (SELECT DISTINCT vec_id // 5 AS dbidx FROM embeddings) e LEFT JOIN ann USING (dbidx) GROUP BY e.dbidx")
def gt_pivot(spark, sf):
    return tables.presence_by_category(annotations(spark, sf), tiles(spark, sf), [0, 1, 2, 3])


@query("SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL")
def gt_counts(spark, sf):
    return tables.counts_by_category(table(spark, sf, "lineitem"), "l_orderkey", "l_returnflag")


@query(f"""WITH {ANN}, am AS (SELECT box_id, dbidx, category, x1 + 1 AS x1, y1 + 1 AS y1, x2 + 1 AS x2, y2 + 1 AS y2 FROM ann WHERE category = 0 AND dbidx % 2 = 0)
SELECT *, 'base' AS origin FROM ann WHERE (category, dbidx) NOT IN (SELECT category, dbidx FROM am) UNION ALL SELECT *, 'review' FROM am""")
def annotation_override_merge(spark, sf):
    base = annotations(spark, sf)
    new = base.where("category = 0 and dbidx % 2 = 0").select("box_id", "dbidx", "category", *[(F.col(c) + 1).alias(c) for c in boxes.SIDES])
    return tables.amended(base, new, new, origin="review").select("box_id", "dbidx", "category", *boxes.SIDES, "origin")


_PATHS = "p AS (SELECT DISTINCT regexp_replace(url, '^[a-z]+://', '') AS file_path FROM pages WHERE url IS NOT NULL)"


def _paths(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").where("url is not null").select(F.regexp_replace("url", "^[a-z]+://", "").alias("file_path"))


@query(f"WITH {_PATHS} SELECT file_path, lower(list_extract(string_split(file_path, '.'), -1)) AS ext FROM p WHERE lower(list_extract(string_split(file_path, '.'), -1)) IN ('html', 'htm')")
def path_ext_filter(spark, sf):
    return _paths(spark, sf).where(text.is_image("file_path", ("html", "htm"))).distinct().select("file_path", text.extension("file_path").alias("ext"))


@query(f"WITH {_PATHS} SELECT row_number() OVER (ORDER BY file_path) - 1 AS dbidx, file_path FROM p")
def file_table(spark, sf):
    return tables.file_table(_paths(spark, sf)).select("dbidx", "file_path")


@query("SELECT url, regexp_replace(regexp_replace(url, '/+(\\./+)*', '/', 'g'), '/$', '') AS cleaned FROM pages WHERE url IS NOT NULL")
def cleaned_paths(spark, sf):
    return table(spark, sf, "pages").where("url is not null").select("url", text.clean_path("url").alias("cleaned"))


@query("WITH k AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS new_id FROM embeddings WHERE label IN (1, 3)) SELECT vec_id, new_id, label FROM k JOIN embeddings USING (vec_id)")
def densified_subset(spark, sf):
    e = table(spark, sf, "embeddings")
    return sets.densified(e, e.where("label in (1, 3)"), "vec_id").select("vec_id", "new_id", "label")


@query("SELECT vec_id, ntile(7) OVER (ORDER BY vec_id) - 1 AS part FROM embeddings")
def even_split(spark, sf):
    return tables.split_evenly(table(spark, sf, "embeddings").select("vec_id"), 7, "vec_id").select("vec_id", F.col("part").cast("long").alias("part"))


@query("SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND vec_id <> 8")
def subset_rows(spark, sf):
    ids = table(spark, sf, "labels").where("quality = 1").select(F.col("doc_id").alias("vec_id"))
    return tables.leave_one_out(tables.subset(table(spark, sf, "embeddings"), ids, "vec_id"), 8, "vec_id").select("vec_id", "label")


@query("SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT doc_id FROM labels WHERE toxic = 1")
def id_union(spark, sf):
    t = table(spark, sf, "labels")
    return sets.id_union(t.where("quality = 1"), t.where("toxic = 1"), "doc_id")


@query("SELECT doc_id FROM labels INTERSECT SELECT doc_id FROM documents WHERE lang = 'fr'")
def id_intersection(spark, sf):
    return sets.id_intersection(table(spark, sf, "labels"), table(spark, sf, "documents").where("lang = 'fr'"), "doc_id")


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def id_difference(spark, sf):
    return sets.id_difference(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query(f"""WITH {ANN}, o AS (SELECT dbidx, max((category = 0)::INT)::BOOLEAN AS a FROM ann WHERE dbidx % 3 <> 0 GROUP BY dbidx), n AS (SELECT dbidx, max((category <= 2)::INT)::BOOLEAN AS a FROM ann GROUP BY dbidx)
SELECT n.dbidx, n.a::INT AS y FROM n LEFT JOIN o ON n.dbidx = o.dbidx WHERE o.a IS DISTINCT FROM n.a""")
def delta_changes(spark, sf):
    a = annotations(spark, sf)
    state = lambda rows, c: rows.groupBy("dbidx").agg(F.max(c).alias("accepted"))
    return sets.label_changes(state(a.where("dbidx % 3 <> 0"), F.col("category") == 0), state(a, F.col("category") <= 2))


@query("WITH f AS (SELECT source, min(doc_id) AS first_position FROM documents GROUP BY source) SELECT source, first_position, row_number() OVER (ORDER BY first_position, source) - 1 AS id FROM f")
def string_dedup_ids(spark, sf):
    return sets.numbered_strings(table(spark, sf, "documents"), "source", "doc_id").select("source", "first_position", F.col("id").cast("long").alias("id"))


@query(f"WITH {ANN} SELECT dbidx, category, count(*) AS n FROM ann GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, sf):
    return reports.repeated(annotations(spark, sf), ["dbidx", "category"])


# --- scalars ----------------------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, 'a ' || trim(regexp_replace(regexp_replace(lower(p_type), '[-_()]', ' ', 'g') || ' ' || replace(p_name, '/', ' or '), '\\s+', ' ', 'g')) AS said FROM part")
def category_query_text(spark, sf):
    name = F.concat("p_name", F.lit(" ("), F.lower("p_type"), F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", text.query_text(name).alias("said"))


@query("SELECT user_id, substr(md5(user_id::VARCHAR), 1, 10) AS hash, count(*) AS n FROM events GROUP BY ALL")
def user_hashes(spark, sf):
    e = table(spark, sf, "events").withColumn("hash", text.user_hash(F.col("user_id").cast("string")))
    return e.groupBy("user_id", "hash").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, (props->>'$.k')::DOUBLE AS k, CASE WHEN event_type = 'click' THEN (props->>'$.k')::DOUBLE END AS click_k FROM events")
def json_param_extract(spark, sf):
    k = text.parameter("props", "k")
    return table(spark, sf, "events").select("event_id", k.alias("k"), text.parameter("props", "k", only=F.col("event_type") == "click").alias("click_k"))


@query("""SELECT DISTINCT props, substr(sha256('{"k": ' || (props->>'$.k') || '}'), 1, 8) AS param_hash FROM events""")
def param_hash(spark, sf):
    return table(spark, sf, "events").select("props").distinct().select("props", text.parameter_hash("props").alias("param_hash"))


@query("SELECT event_id, round(exp(-value / 50), 6) AS rbf, (value <= 20)::INT::DOUBLE AS near, round(1 / (1 + exp(-0.1 * (value - 20))), 6) AS p FROM events")
def kernels(spark, sf):
    return table(spark, sf, "events").select("event_id", vectors.rbf_kernel("value", 50).alias("rbf"), vectors.threshold_kernel("value", 20).alias("near"), vectors.sigmoid("value", 0.1, -20).alias("p"))


@query("WITH m AS (SELECT min(value) AS lo, max(value) AS hi FROM events) SELECT event_id, round((value - lo) / (hi - lo) * 0.98 + 0.01, 6) AS value FROM events, m")
def normalized_scores(spark, sf):
    return graph.min_max(table(spark, sf, "events").select("event_id", "value"), "value", 0.01)


@query("SELECT event_id, CAST(timezone('US/Eastern', timezone('UTC', ts)) AS TIMESTAMP) AS local_ts FROM (SELECT event_id, date_trunc('second', ts) AS ts FROM events)")
def local_times(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.date_trunc("second", F.col("ts").cast("timestamp")).alias("ts"))
    return e.select("event_id", text.local_time(F.unix_micros("ts") / 1e6).cast("timestamp_ntz").alias("local_ts"))


# --- metrics ----------------------------------------------------------------------------------------------------------------------


@query(f"WITH {STATS} SELECT dataset, category, variant, nfound, round(ndcg_score, 6) AS ndcg_score, round(average_precision, 6) AS average_precision, rank_first, round(reciprocal_rank, 6) AS reciprocal_rank, nullif(rank_second, 'nan') AS rank_second, nullif(rank_third, 'nan') AS rank_third, nullif(rank_tenth, 'nan') AS rank_tenth FROM stats")
def run_metrics(spark, sf):
    s = stats(spark, sf)
    return s.select("dataset", "category", "variant", F.col("nfound").cast("long").alias("nfound"), *[reports.finite(c).alias(c) for c in s.columns[4:]])


@query(f"""WITH {RUNS} SELECT category, variant, round(coalesce(list_sum(list_transform(hits[1:least(ntotal, 10)], lambda h, i: i / (h + 1.0)::DOUBLE)), 0) / least(ntotal, 10), 6) AS ap10,
round(coalesce(list_sum(list_transform(hits[1:ntotal], lambda h, i: i / (h + 1.0)::DOUBLE)), 0) / least(ntotal, nseen), 6) AS nap FROM runs WHERE ntotal > 0""")
def capped_metrics(spark, sf):
    r = runs(spark, sf).where("ntotal > 0")
    return r.select("category", "variant", metrics.average_precision("hit_indices", "ntotal", F.lit(10)).alias("ap10"), metrics.normalized_average_precision("hit_indices", "ntotal", "nseen").alias("nap"))


@query(f"WITH {RUNS}, h AS (SELECT category, variant, unnest(hits) + 1 AS rank FROM runs) SELECT category, variant, rank, round(1.0 / (rank - coalesce(lag(rank) OVER (PARTITION BY category, variant ORDER BY rank), 0))::DOUBLE, 6) AS reciprocal_gap FROM h")
def hit_gaps(spark, sf):
    h = runs(spark, sf).select("category", "variant", F.explode("hit_indices").alias("rank")).withColumn("rank", (F.col("rank") + 1).cast("long")).withColumn("run", F.col("category") * 3 + F.col("variant"))
    return logs.gaps(h, "run", "rank").select("category", "variant", "rank", "reciprocal_gap")


@query(f"""WITH {TILES}, {SCORED}, o AS (SELECT vec_id, label = 1 AS hit, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM scored), c AS (SELECT *, sum(hit::INT) OVER (ORDER BY r) AS found FROM o)
SELECT round(sum(found / r::DOUBLE) / count(*), 6) AS average_precision, min(r) - 1 AS first_hit, count(*) AS n FROM c WHERE hit""")
def full_ranking_ap(spark, sf):
    s = search.scored(tiles(spark, sf), embedding_of(spark, sf, 0)).select("vec_id", (F.col("label") == 1).alias("hit"), "score")
    before = ranks.running(s, [F.desc("score"), F.asc("vec_id")], {"r": F.lit(1).cast("long"), "found": F.col("hit").cast("long")})
    ranked = before.where("hit").select("hit", (F.col("r") + 1).alias("r"), (F.col("found") + 1).alias("found"))
    return ranked.where("hit").agg((F.sum(F.col("found") / F.col("r")) / F.count(F.lit(1))).alias("average_precision"), (F.min("r") - 1).cast("long").alias("first_hit"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TILES}, {SCORED}, w AS (SELECT vec_id, (label = 1)::INT AS y, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM scored)
SELECT vec_id, y, coalesce(CASE WHEN y = 1 THEN sum(1 - y) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) ELSE sum(y) OVER (ORDER BY r ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) END, 0)::BIGINT AS inversions FROM w""")
def inversions(spark, sf):
    s = search.scored(tiles(spark, sf), embedding_of(spark, sf, 0)).select("vec_id", (F.col("label") == 1).cast("int").alias("y"), "score")
    return logs.inversions(s, "score", "y", "vec_id").select("vec_id", "y", "inversions")


# --- logs -------------------------------------------------------------------------------------------------------------------------

def _bought():
    return F.col("event_type") == "purchase"


@query(f"WITH {LOG} SELECT event_id, user_id, (sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY pos))::BIGINT AS accepted, pos + 1 AS seen FROM log")
def running_accept(spark, sf):
    return logs.running_counts(table(spark, sf, "events"), _bought()).select("event_id", "user_id", "accepted", "seen")


@query(f"WITH {LOG}, m AS (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM log) SELECT event_id, user_id, value FROM m WHERE most IS NULL OR value > most")
def new_record_events(spark, sf):
    return logs.new_records(table(spark, sf, "events"), "value").select("event_id", "user_id", "value")


@query(f"WITH {LOG}, m AS (SELECT user_id, event_type = 'purchase' AS a, min((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS least FROM log) SELECT user_id, bool_or(a AND coalesce(least, 1) = 0) AS reversed FROM m GROUP BY user_id")
def reversal_flag(spark, sf):
    return logs.reversals(table(spark, sf, "events"), _bought())


@query("SELECT user_id, epoch_us(min(ts) FILTER (event_type = 'signup')) AS first_us FROM events GROUP BY user_id")
def first_message_time(spark, sf):
    return logs.first_time(table(spark, sf, "events"), F.col("event_type") == "signup").select("user_id", F.unix_micros(F.col("first_time").cast("timestamp")).alias("first_us"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_per_session(spark, sf):
    return logs.latest(table(spark, sf, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("""WITH m AS (SELECT user_id, event_type = 'signup' AS s, epoch_us(ts) / 1e6 AS t, lag(CASE WHEN event_type = 'signup' THEN epoch_us(ts) / 1e6 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f FROM events WHERE event_type IN ('signup', 'error'))
SELECT user_id, count(*) AS n_pairs, round(sum(t - f), 6) AS total_seconds FROM m WHERE NOT s AND f IS NOT NULL GROUP BY user_id""")
def image_pairing(spark, sf):
    return logs.paired_spans(table(spark, sf, "events"), F.col("event_type") == "signup", F.col("event_type") == "error")


@query("""WITH s AS (SELECT *, max((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
e AS (SELECT *, coalesce(max((s = 1 AND event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS e FROM s) SELECT event_id, user_id, event_type FROM e WHERE s = 1 AND e = 0""")
def task_window(spark, sf):
    return logs.within_task(table(spark, sf, "events"), F.col("event_type") == "signup", F.col("event_type") == "error").select("event_id", "user_id", "event_type")


@query(f"WITH {LOG}, a AS (SELECT *, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY pos) AS acc FROM log), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS r FROM a WHERE acc >= 3 OR pos + 1 >= 20) SELECT user_id, event_id, acc::BIGINT AS accepted, pos + 1 AS seen FROM r WHERE r = 1")
def log_cutoff(spark, sf):
    counted = logs.running_counts(table(spark, sf, "events"), _bought())
    return logs.first_at_limit(counted, (F.col("accepted") >= 3) | (F.col("seen") >= 20)).select("user_id", "event_id", "accepted", "seen")


@query(f"""WITH {LOG}, a AS (SELECT user_id, event_type, pos * 10.0::DOUBLE AS seconds, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY pos) AS acc FROM log),
f AS (SELECT user_id, acc, min(seconds) AS seconds FROM a WHERE event_type = 'purchase' GROUP BY ALL), k AS (SELECT DISTINCT user_id, n AS accepted FROM f, range(1, 11) t(n))
SELECT k.user_id, k.accepted, least(coalesce(seconds, 360), 360)::DOUBLE AS seconds FROM k LEFT JOIN f ON k.user_id = f.user_id AND k.accepted = f.acc""")
def padded_timeline(spark, sf):
    a = logs.running_counts(logs.positions(table(spark, sf, "events")), _bought()).where(_bought()).withColumn("seconds", F.col("pos") * 10.0)
    return logs.padded_timeline(a, "user_id", 360).select("user_id", F.col("accepted").cast("long").alias("accepted"), "seconds")


# --- reports ----------------------------------------------------------------------------------------------------------------------

_SBS = f"WITH {STATS}, sbs AS (SELECT coalesce(m.dataset, b.dataset) AS dataset, coalesce(m.category, b.category) AS category, m.variant, m.average_precision AS metric, b.average_precision AS base FROM stats m FULL JOIN (SELECT * FROM stats WHERE variant = 0) b ON m.dataset = b.dataset AND m.category = b.category) "


def _sbs(spark, sf) -> DataFrame:
    return reports.side_by_side(stats(spark, sf), 0, "average_precision")


@query(_SBS + "SELECT dataset, category, variant, round(metric, 6) AS metric, round(base, 6) AS base, round(metric / nullif(base, 0), 6) AS ratio, round(metric - base, 6) AS delta FROM sbs")
def side_by_side(spark, sf):
    return _sbs(spark, sf)


def _bsw(up: str, down: str) -> str:
    return _SBS + f", f AS (SELECT variant, dataset, coalesce({up}, false) AS up, coalesce({down}, false) AS down, metric IS NULL OR base IS NULL AS no FROM sbs) SELECT variant, CASE WHEN grouping(dataset) = 1 THEN 'total' ELSE dataset::VARCHAR END AS dataset, count(*) FILTER (up) AS better, count(*) FILTER (NOT up AND NOT down AND NOT no) AS same, count(*) FILTER (down) AS worse, count(*) FILTER (no) AS neither, count(*) AS n FROM f GROUP BY GROUPING SETS ((variant, dataset), (variant))"


@query(_bsw("metric - base > 0.05", "base - metric > 0.05"))
def bsw_abs(spark, sf):
    return reports.better_same_worse(_sbs(spark, sf), "average_precision", 0.05)


@query(_bsw("metric > base * 1.1", "metric < base / 1.1"))
def bsw_rel(spark, sf):
    return reports.better_same_worse(_sbs(spark, sf), "average_precision", 1.1, relative=True)


@query(f"""WITH {STATS}, p AS (SELECT a.dataset, a.category, a.rank_first AS x, b.rank_first AS y FROM stats a JOIN stats b ON a.dataset = b.dataset AND a.category = b.category AND a.variant = 1 AND b.variant = 0)
SELECT dataset, category, CASE WHEN u AND v THEN 'both_undefined' WHEN u THEN 'first_undefined' WHEN v THEN 'second_undefined' WHEN isinf(x) AND isinf(y) THEN 'both_infinite' WHEN isinf(x) THEN 'first_larger' WHEN isinf(y) THEN 'first_smaller'
  WHEN abs(x - y) <= 1 THEN 'close' WHEN x > y THEN 'first_larger' ELSE 'first_smaller' END AS class, coalesce(isinf(x) AND (v OR NOT isinf(y)), false) AS first_only_infinite, coalesce(isinf(y) AND (u OR NOT isinf(x)), false) AS second_only_infinite
FROM (SELECT *, x IS NULL OR isnan(x) AS u, y IS NULL OR isnan(y) AS v FROM p)""")
def method_pair_classes(spark, sf):
    pairs = reports.compared(stats(spark, sf), 1, 0, ["rank_first"])
    return reports.pair_classes(pairs, "rank_first", "rank_first_baseline", 1.0).select("dataset", "category", "class", "first_only_infinite", "second_only_infinite")


@query(_SBS + ", b AS (SELECT variant, CASE WHEN base > 0.3 THEN 'easy' WHEN base > 0.1 THEN 'medium' ELSE 'hard' END AS bucket, dataset, avg(metric) AS m, count(*) AS k FROM sbs WHERE base IS NOT NULL GROUP BY ALL) SELECT variant, bucket, round(avg(m), 6) AS mean_metric, sum(k)::BIGINT AS n FROM b GROUP BY ALL")
def summary_breakdown(spark, sf):
    return reports.summary_breakdown(_sbs(spark, sf))


@query(f"WITH {STATS}, m AS (SELECT variant, " + ", ".join(f"avg(average_precision) FILTER (dataset = {d}) AS d_{d}" for d in range(4)) + " FROM stats GROUP BY variant) SELECT variant, " + ", ".join(f"round(d_{d}, 6) AS d_{d}" for d in range(4)) + ", round(list_avg([d_0, d_1, d_2, d_3]), 6) AS average FROM m")
def display_means(spark, sf):
    return reports.mean_table(stats(spark, sf), "average_precision", [0, 1, 2, 3])


@query(f"WITH {STATS}, m AS (SELECT variant, dataset::VARCHAR AS dataset, avg(average_precision) AS mean FROM stats GROUP BY ALL) SELECT variant, dataset, round(mean, 6) AS mean FROM m UNION ALL SELECT variant, 'Avg.', round(avg(mean), 6) FROM m GROUP BY variant")
def avg_row_totals(spark, sf):
    return reports.means_with_average(stats(spark, sf), "average_precision").select("variant", "dataset", "mean")


@query(f"WITH {STATS} SELECT s.dataset, s.category, s.variant, b.average_precision < 0.2 AS hard FROM stats s JOIN stats b ON s.dataset = b.dataset AND s.category = b.category AND b.variant = 0 UNION ALL SELECT dataset, category, variant, false FROM stats s WHERE NOT EXISTS (SELECT 1 FROM stats b WHERE b.variant = 0 AND b.dataset = s.dataset AND b.category = s.category)")
def hard_query_group(spark, sf):
    return reports.with_difficulty(stats(spark, sf), "average_precision", 0, 0.2).select("dataset", "category", "variant", "hard")


@query(f"WITH {STATS} SELECT dataset, category, variant, round(ndcg_score, 6) AS ndcg_score FROM stats WHERE (dataset, category) IN (SELECT dataset, category FROM stats WHERE variant = 0 AND ndcg_score < 0.6)")
def unsaturated_queries(spark, sf):
    return reports.unsaturated(stats(spark, sf), "ndcg_score", 0, 0.6).select("dataset", "category", "variant", "ndcg_score")


@query(f"WITH {STATS}, m AS (SELECT dataset, variant, avg(ndcg_score) AS mean FROM stats GROUP BY ALL) SELECT dataset, variant, round(mean, 6) AS mean, round(mean - lag(mean) OVER (PARTITION BY dataset ORDER BY variant), 6) AS diff FROM m")
def ablation_diff(spark, sf):
    means = stats(spark, sf).groupBy("dataset", "variant").agg(F.avg("ndcg_score").alias("mean"))
    return reports.differences(means, "mean", "variant", "dataset")


@query("WITH q(q) AS (VALUES (0.0), (0.1), (0.25), (0.5), (0.75), (0.9), (1.0)), l AS (SELECT event_type, quantile_cont(value, [0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]) AS p FROM events GROUP BY event_type) SELECT event_type, unnest([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0])::DOUBLE AS q, round(unnest(p), 6) AS value FROM l")
def quantiles(spark, sf):
    return reports.quantiles(table(spark, sf, "events"), "value", ["event_type"])


@query(f"WITH {STATS} SELECT dataset, category, variant, round(cume_dist() OVER (PARTITION BY dataset ORDER BY ndcg_score), 6) AS ecdf FROM stats")
def ecdf(spark, sf):
    s = stats(spark, sf).withColumn("ndcg_score", F.round("ndcg_score", 12))
    return reports.cumulative(s, "ndcg_score", ["dataset"]).select("dataset", "category", "variant", "ecdf")


@query("SELECT event_type, round(avg(value) + 1e-9, 6) AS mean, round(stddev_samp(value) / sqrt(count(value)), 6) AS sem, count(value) AS n FROM events GROUP BY event_type")
def mean_and_error(spark, sf):
    return reports.mean_and_error(table(spark, sf, "events"), "value", ["event_type"]).withColumn("mean", F.col("mean") + 1e-9)


@query(f"WITH {RUNS} SELECT dataset, variant, round(sum(len(hits))::DOUBLE / nullif(sum(ntotal), 0), 6) AS ratio FROM runs GROUP BY ALL")
def completion_ratio(spark, sf):
    return reports.completion(runs(spark, sf).withColumn("nfound", F.size("hit_indices")), ["dataset", "variant"], "ntotal", "nfound")


@query()
def bootstrap_ci(spark, sf):
    """Resampling is random; tests hold the interval against its properties."""
    return reports.bootstrap(stats(spark, sf), "average_precision", ["variant"], samples=400)


# --- graphs -----------------------------------------------------------------------------------------------------------------------

_KNN = """d AS (SELECT a.vec_id AS src_vertex, b.vec_id AS dst_vertex, greatest(0, 1 - list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])) AS distance FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY src_vertex ORDER BY distance, dst_vertex) AS dst_rank FROM d),
knn AS (SELECT * FROM r WHERE dst_rank <= 5 UNION ALL SELECT vec_id, vec_id, 0, 0 FROM embeddings)"""
_W = f"""{_KNN}, w1 AS (SELECT src_vertex AS i, dst_vertex AS j, exp(-distance / 0.5) AS w FROM knn WHERE src_vertex <> dst_vertex), w AS (SELECT i, j, avg(w) AS w FROM (SELECT * FROM w1 UNION ALL SELECT j, i, w FROM w1) GROUP BY i, j)"""


def _knn(spark, sf) -> DataFrame:
    return graph.exact_knn(table(spark, sf, "embeddings"), 5)


def _weights(spark, sf) -> DataFrame:
    return cut(graph.weights(_knn(spark, sf), lambda d: vectors.rbf_kernel(d, 0.5)))


@query(f"WITH {_KNN} SELECT src_vertex, dst_vertex, round(distance, 6) AS distance, dst_rank FROM knn")
def knn_graph(spark, sf):
    return _knn(spark, sf).withColumn("dst_rank", F.col("dst_rank").cast("long"))


@query(f"WITH {_KNN} SELECT src_vertex, dst_vertex, dst_rank FROM knn WHERE dst_rank < 3")
def restrict_k(spark, sf):
    return graph.restrict_k(_knn(spark, sf), 3).select("src_vertex", "dst_vertex", F.col("dst_rank").cast("long").alias("dst_rank"))


@query(f"""WITH {_KNN}, e AS (SELECT *, src_vertex // 5 AS sf, dst_vertex // 5 AS df FROM knn),
inter AS (SELECT src_vertex, dst_vertex, distance, row_number() OVER (PARTITION BY src_vertex, df ORDER BY distance, dst_vertex) AS b FROM e WHERE sf <> df)
SELECT src_vertex, dst_vertex, row_number() OVER (PARTITION BY src_vertex ORDER BY distance, dst_vertex) AS dst_rank, 'inter' AS kind FROM inter WHERE b = 1
UNION ALL SELECT src_vertex, dst_vertex, k, 'intra' FROM (SELECT *, row_number() OVER (PARTITION BY src_vertex ORDER BY distance, dst_vertex) AS k FROM e WHERE sf = df) WHERE k <= 3""")
def knn_factored(spark, sf):
    e = graph.factored(_knn(spark, sf), lambda c: F.expr(f"{c} div 5"), 3)
    return e.select("src_vertex", "dst_vertex", F.col("dst_rank").cast("long").alias("dst_rank"), "kind")


@query(f"WITH {_W} SELECT i, j, round(w, 6) AS w FROM w")
def weight_matrix_sym(spark, sf):
    return graph.weights(_knn(spark, sf), lambda d: vectors.rbf_kernel(d, 0.5))


@query(f"WITH {_W} SELECT i, round(sum(w), 6) AS degree, count(*) AS n FROM w GROUP BY i")
def degrees(spark, sf):
    return graph.degrees(_weights(spark, sf))


@query(f"WITH {_W}, deg AS (SELECT i, sum(w) AS d FROM w GROUP BY i) SELECT w.i, w.j, round(-w.w / sqrt(a.d * b.d), 6) AS w FROM w JOIN deg a ON w.i = a.i JOIN deg b ON w.j = b.i UNION ALL SELECT i, i, 1.0 FROM deg")
def laplacian_normalized(spark, sf):
    return graph.laplacian(_weights(spark, sf), normalized=True)


@query(f"WITH {_W} SELECT round(sum(w * ((a.label = 1)::INT - (b.label = 1)::INT) ** 2), 6) AS loss FROM w JOIN embeddings a ON w.i = a.vec_id JOIN embeddings b ON w.j = b.vec_id WHERE w.i < w.j")
def edge_loss(spark, sf):
    y = table(spark, sf, "embeddings").select(F.col("vec_id").alias("vertex"), (F.col("label") == 1).cast("double").alias("y"))
    return graph.edge_loss(_weights(spark, sf), y)


def _prior(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("vertex"), "label")
    return e.select("vertex", F.lit(0.1).alias("f")), e.where("vertex % 6 = 0").select("vertex", (F.col("label") == 1).cast("int").alias("y"))


_STEP = "SELECT p.vec_id, coalesce((CASE WHEN p.vec_id % 6 = 0 THEN (p.label = 1)::INT END)::DOUBLE, (coalesce(s.pull, 0) + 0.1) / (deg.degree + 1)) AS f FROM embeddings p JOIN deg ON p.vec_id = deg.i LEFT JOIN (SELECT w.i, sum(w.w * f.f) AS pull FROM w JOIN {} f ON w.j = f.vec_id GROUP BY w.i) s ON s.i = p.vec_id"


@query(f"WITH {_W}, deg AS (SELECT i, sum(w) AS degree FROM w GROUP BY i), f0 AS (SELECT vec_id, CASE WHEN vec_id % 6 = 0 THEN (label = 1)::INT::DOUBLE ELSE 0.1 END AS f FROM embeddings), f1 AS ({_STEP.format('f0')}), f2 AS ({_STEP.format('f1')}), f3 AS ({_STEP.format('f2')}) SELECT vec_id AS vertex, round(f, 6) AS f FROM f3")
def label_prop_3steps(spark, sf):
    prior, marks = _prior(spark, sf)
    return graph.propagated(_weights(spark, sf), prior, marks, 1.0, steps=3, tolerance=None)


@query(f"""WITH {_KNN}, l AS (SELECT vec_id, (label = 1)::INT AS y FROM embeddings WHERE vec_id % 6 = 0), t AS (SELECT src_vertex, sum(y) AS s, count(*) AS n FROM knn JOIN l ON dst_vertex = vec_id WHERE src_vertex <> dst_vertex GROUP BY ALL)
SELECT e.vec_id AS vertex, round(coalesce(y::DOUBLE, (0.1 + coalesce(s, 0)) / (1 + coalesce(n, 0))), 6) AS score FROM embeddings e LEFT JOIN t ON src_vertex = e.vec_id LEFT JOIN l ON l.vec_id = e.vec_id""")
def knn_ranker_scores(spark, sf):
    prior, marks = _prior(spark, sf)
    return graph.neighbour_scores(_knn(spark, sf), prior, marks)


@query(f"""WITH {_W}, x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), e AS (SELECT w.w AS w, list_transform(list_zip(a.v, b.v), lambda p: p[1] - p[2]) AS d FROM w JOIN x a ON w.i = a.vec_id JOIN x b ON w.j = b.vec_id WHERE w.i < w.j),
k AS (SELECT unnest(range(64)) AS r), c AS (SELECT unnest(range(64)) AS c), t AS (SELECT sum(w) AS t FROM w) SELECT k.r, c.c, round(sum(e.w * e.d[k.r + 1] * e.d[c.c + 1]) / max(t.t), 6) AS v FROM e, k, c, t GROUP BY ALL""")
def spread_matrix(spark, sf):
    m = graph.spread_matrix(_weights(spark, sf), table(spark, sf, "embeddings"))
    return m.select(F.col("r").cast("long").alias("r"), F.col("c").cast("long").alias("c"), "v")


# --- feedback ---------------------------------------------------------------------------------------------------------------------

_ROCCHIO = f"""p AS (SELECT label = 1 AS y, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS component FROM embeddings WHERE vec_id % 4 = 0),
m AS (SELECT component, avg(x) FILTER (y) AS p, avg(x) FILTER (NOT y) AS n FROM p GROUP BY component), q AS (SELECT unnest(v) AS q, unnest(range(len(v))) AS component FROM (SELECT {Q0} AS v)),
r AS (SELECT component, q + 0.75 * coalesce(p, 0) - 0.15 * coalesce(n, 0) AS value FROM q LEFT JOIN m USING (component))"""


def _marked(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").where("vec_id % 4 = 0").withColumn("y", (F.col("label") == 1).cast("int"))


@query(f"WITH {_ROCCHIO} SELECT component, round(value, 6) AS value FROM r")
def rocchio_vector(spark, sf):
    return feedback.rocchio(_marked(spark, sf), embedding_of(spark, sf, 0)).select(F.col("component").cast("long").alias("component"), "value")


@query(f"WITH {_ROCCHIO}, v AS (SELECT list(value ORDER BY component) AS v FROM r), s AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], v) AS score FROM embeddings, v) SELECT vec_id, round(score, 6) AS score FROM s ORDER BY s.score DESC, vec_id LIMIT 10")
def rocchio_topk(spark, sf):
    q = feedback.collected(feedback.rocchio(_marked(spark, sf), embedding_of(spark, sf, 0)))
    return search.coarse_query(table(spark, sf, "embeddings"), q, 10)


def _feedback(spark, sf):
    """(vectors, labels, confused, vectors of the image) of all that is marked, which is what one user marks."""
    import numpy as np

    rows = _marked(spark, sf).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(F.expr("vec_id div 5")))).orderBy("vec_id")
    rows = rows.select("embedding", "y", (F.col("label") == 2).cast("int").alias("confused"), "n").collect()
    return np.array([r.embedding for r in rows], float), *(np.array([r[c] for r in rows]) for c in ("y", "confused", "n"))


def _spread(spark, sf):
    import numpy as np

    cells = graph.spread_matrix(_weights(spark, sf), table(spark, sf, "embeddings")).collect()  # a side for each component
    out = np.zeros((1 + max(c.r for c in cells),) * 2)
    for c in cells:
        out[c.r, c.c] = c.v
    return out


def _refined(spark, sf, new, contrast=None) -> DataFrame:
    e = search.scored(table(spark, sf, "embeddings"), new.tolist())
    if contrast is not None:
        e = e.withColumn("score", F.col("score") - vectors.dot("embedding", vectors.vector(contrast.tolist())))
    return search.top_k(e, 10, "vec_id").select("vec_id", "score")


def _query(spark, sf, vec_id=0):
    import numpy as np

    return np.array(embedding_of(spark, sf, vec_id), float)


@query()
def logistic_refine(spark, sf):
    """An iterative fit."""
    x, y, _, _ = _feedback(spark, sf)
    return _refined(spark, sf, feedback.logistic_refine(x, y, _query(spark, sf)))


@query()
def rank_refine(spark, sf):
    """An iterative fit, each step a pass over the table: there are more pairs of marked rows than the driver holds."""
    return _refined(spark, sf, feedback.rank_fitted(_marked(spark, sf), _query(spark, sf)))


@query()
def multi_refine(spark, sf):
    """An iterative fit; ``multi_loss_slopes`` holds its loss against SQL."""
    x, y, _, n = _feedback(spark, sf)
    return _refined(spark, sf, feedback.multi_refine(x, y, n, _query(spark, sf), _spread(spark, sf)))


@query()
def two_way_refine(spark, sf):
    """An iterative fit; ``two_way_slopes`` holds its loss against SQL."""
    x, y, other, n = _feedback(spark, sf)
    return _refined(spark, sf, *feedback.two_way_refine(x, y, other, n, _query(spark, sf)))


_MARKED = """mk AS (SELECT vec_id, embedding::DOUBLE[] AS v, (label = 1)::INT AS y, (label = 2)::INT AS z, 1.0 / count(*) OVER (PARTITION BY vec_id // 5)::DOUBLE AS share FROM embeddings WHERE vec_id % 4 = 0),
mp AS (SELECT vec_id, y, z, share, unnest(v) AS x, unnest(range(64)) AS c FROM mk), mu AS (SELECT c, avg(x) AS mu FROM mp GROUP BY c), mx AS (SELECT vec_id, y, z, share, c, x - mu AS x FROM mp JOIN mu USING (c)),
q0 AS (SELECT unnest(v) AS q, unnest(range(64)) AS c FROM (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0)), q1 AS (SELECT unnest(v) AS q, unnest(range(64)) AS c FROM (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 1)),
pt AS (SELECT c, q0.q / (SELECT sqrt(sum(q * q)) FROM q0) AS q, 2 * q0.q + q1.q AS w FROM q0 JOIN q1 USING (c))"""


def _slopes(loss, at) -> list[tuple[int, float]]:
    value, slope = loss(at)
    return [(-1, float(value)), *((i, float(g)) for i, g in enumerate(slope))]


@query(f"""WITH {_W}, x AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), e AS (SELECT w.w AS w, list_transform(list_zip(a.v, b.v), lambda p: p[1] - p[2]) AS d FROM w JOIN x a ON w.i = a.vec_id JOIN x b ON w.j = b.vec_id WHERE w.i < w.j),
{_MARKED}, wl AS (SELECT list(w ORDER BY c) AS wl FROM pt), t AS (SELECT sum(w) AS t FROM w),
ed AS (SELECT e.w / t.t AS w, list_dot_product(e.d, wl) AS a, e.d AS d FROM e, wl, t), sp AS (SELECT c, 2 * sum(g) AS g FROM (SELECT unnest(list_transform(d, lambda v: v * a * w)) AS g, unnest(range(64)) AS c FROM ed) GROUP BY c),
n AS (SELECT sqrt(sum(w * w)) AS s, sum(w * q) / sqrt(sum(w * w)) AS cos FROM pt), zs AS (SELECT vec_id, y, share, sum(x * w) AS z FROM mx JOIN pt USING (c) GROUP BY ALL),
lab AS (SELECT c, sum(m.share * (1 / (1 + exp(-zs.z)) - m.y) * m.x) AS g FROM mx m JOIN zs USING (vec_id) GROUP BY c)
SELECT -1 AS component, round((SELECT sum(share * (ln(1 + exp(z)) - y * z)) FROM zs) + (SELECT sum(w * a * a) FROM ed) + (s * s + 1 / (s * s)) / 2 - 1 + (1 - cos) / 2, 6) AS slope FROM n
UNION ALL SELECT pt.c, round(lab.g + sp.g + (1 - 1 / pow(s, 4)) * w - (q - cos * w / s) / s / 2, 6) FROM pt JOIN lab USING (c) JOIN sp USING (c), n""")
def multi_loss_slopes(spark, sf):
    x, y, _, n = _feedback(spark, sf)
    q = _query(spark, sf)
    rows = _slopes(feedback.multi_loss(x, y, n, q, _spread(spark, sf)), 2 * q + _query(spark, sf, 1))
    return spark.createDataFrame(rows, "component long, slope double")


@query(f"""WITH {_MARKED}, w2 AS (SELECT pt.c, pt.q AS q, 2 * q0.q + q1.q AS a, q0.q - q1.q AS b FROM pt JOIN q0 USING (c) JOIN q1 USING (c)),
n AS (SELECT sqrt(sum(a * a)) AS sa, sqrt(sum(b * b)) AS sb, sum(a * q) / sqrt(sum(a * a)) AS ca, sum(b * q) / sqrt(sum(b * b)) AS cb FROM w2),
zs AS (SELECT vec_id, y, z AS o, share, sum(x * a) / max(sa) AS za, sum(x * b) / max(sb) AS zb FROM mx JOIN w2 USING (c), n GROUP BY ALL),
l AS (SELECT *, ln(exp(za) + exp(zb)) AS m, y + o AS k FROM zs),
d AS (SELECT vec_id, share * (1 / (1 + exp(-za)) - y + CASE WHEN k > 0 THEN k * exp(za - m) - y ELSE 0 END) AS da, share * (1 / (1 + exp(-zb)) - o + CASE WHEN k > 0 THEN k * exp(zb - m) - o ELSE 0 END) AS db,
  share * (ln(1 + exp(za)) - y * za + ln(1 + exp(zb)) - o * zb + CASE WHEN k > 0 THEN k * m - y * za - o * zb ELSE 0 END) AS loss FROM l),
g AS (SELECT c, sum(da * x) AS ga, sum(db * x) AS gb FROM mx JOIN d USING (vec_id) GROUP BY c),
h AS (SELECT c, ga - q / 2 AS ga, gb - q / 2 AS gb, a / sa AS ua, b / sb AS ub FROM g JOIN w2 USING (c), n), r AS (SELECT sum(ga * ua) AS ra, sum(gb * ub) AS rb FROM h)
SELECT -1 AS component, round((SELECT sum(loss) FROM d) + (sa + 1 / sa) / 2 - 1 + (sb + 1 / sb) / 2 - 1 + (1 - ca) / 2 + (1 - cb) / 2, 6) AS slope FROM n
UNION ALL SELECT c, round((ga - ra * ua) / sa + (1 - 1 / (sa * sa)) / 2 * ua, 6) FROM h, r, n UNION ALL SELECT 64 + c, round((gb - rb * ub) / sb + (1 - 1 / (sb * sb)) / 2 * ub, 6) FROM h, r, n""")
def two_way_slopes(spark, sf):
    import numpy as np

    x, y, other, n = _feedback(spark, sf)
    q, q1 = _query(spark, sf), _query(spark, sf, 1)
    rows = _slopes(feedback.two_way_loss(x, y, other, n, q), np.concatenate([2 * q + q1, q - q1]))
    return spark.createDataFrame(rows, "component long, slope double")


@query("""WITH t AS (SELECT event_id, user_id, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END AS t, value AS s FROM events)
SELECT a.event_id, a.user_id, 2.0 * (count(*) FILTER (b.t > a.t AND b.s <= a.s) - count(*) FILTER (b.t < a.t AND b.s >= a.s)) AS slope, count(*) FILTER (b.t <> a.t)::DOUBLE AS most FROM t a JOIN t b USING (user_id) GROUP BY ALL""")
def rank_slopes(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "user_id", "case event_type when 'purchase' then 2.0D when 'click' then 1.0D else 0.0D end as target", "value")
    return batches.aggregated(e, ["user_id"], lambda p: p[["event_id", "user_id"]].assign(slope=feedback.fast_rank_gradient(p["target"], p["value"]), most=feedback.most_inversions(p["target"])), "event_id long, user_id long, slope double, most double")


@query(f"""WITH {_KNN}, l AS (SELECT vec_id, (label = 1)::INT AS y FROM embeddings WHERE vec_id % 6 = 0), t AS (SELECT src_vertex, sum(y) AS s, count(*) AS n FROM knn JOIN l ON dst_vertex = vec_id WHERE src_vertex <> dst_vertex GROUP BY ALL),
o AS (SELECT e.vec_id, (0.1 + coalesce(s, 0)) / (1 + coalesce(n, 0)) AS p, coalesce(n, 0) AS n FROM embeddings e LEFT JOIN t ON src_vertex = e.vec_id WHERE e.vec_id % 6 <> 0),
m AS (SELECT a.vec_id, a.p, CASE WHEN k.src_vertex IS NULL THEN b.p ELSE (b.p * (1 + b.n) + 1) / (2 + b.n) END AS up, CASE WHEN k.src_vertex IS NULL THEN b.p ELSE b.p * (1 + b.n) / (2 + b.n) END AS down
  FROM o a JOIN o b ON a.vec_id <> b.vec_id LEFT JOIN knn k ON k.src_vertex = b.vec_id AND k.dst_vertex = a.vec_id),
u AS (SELECT vec_id, max(p) AS p, list_sum(list_reverse_sort(list(up))[1:4]) AS up, list_sum(list_reverse_sort(list(down))[1:4]) AS down FROM m GROUP BY vec_id)
SELECT vec_id, round(p * (1 + up) + (1 - p) * down, 6) AS promise FROM u""")
def vertex_promises(spark, sf):
    edges, (prior, marks) = cut(_knn(spark, sf)), _prior(spark, sf)
    scores = graph.neighbour_scores(edges, prior, marks).withColumnRenamed("vertex", "vec_id").where("vec_id % 6 <> 0")
    return graph.promises(edges, cut(scores), marks.select(F.col("vertex").alias("vec_id")), 5)


@query()
def benchmark_sim(spark, sf):
    """A loop of queries and feedback: one summary row a method."""
    t, truth = tiles(spark, sf), annotations(spark, sf)
    found = [session.simulated(session.Session(t, embedding_of(spark, sf, 0), m, batch=3, options={"discount": True} if m == "multi_neg" else {}), truth, 1, 3, 4, confused=2) for m in ("plain", "rocchio", "rank", "multi_neg")]
    rows = [(r["method"], r["hit_indices"], r["nseen"], r["nfound"], r["ntotal"], r["dbidxs"]) for r in found]
    return spark.createDataFrame(rows, "method string, hit_indices array<int>, nseen int, nfound int, ntotal int, dbidxs array<long>")


# --- grids, labels, tracks --------------------------------------------------------------------------------------------------------

_IMAGES = "im AS (SELECT p_partkey, 100 + 37 * (p_partkey % 29) AS w, 150 + 41 * (p_partkey % 23) AS h FROM part)"
_PYRAMID = f"""{_IMAGES}, l AS (SELECT *, least(w, h)::DOUBLE AS s, greatest(0, floor(ln(least(w, h) / 224.0::DOUBLE) / ln(2.0::DOUBLE) + 1e-9))::INT AS top FROM im),
z AS (SELECT *, unnest(range(top + 1))::INT AS zoom FROM l), p AS (SELECT p_partkey, zoom AS zoom_level, pow(0.5, zoom) * greatest(1.0, 224.0::DOUBLE / s) AS scale_factor, w, h, top AS max_zoom_level FROM z)"""


def _images(spark, sf) -> DataFrame:
    return table(spark, sf, "part").selectExpr("p_partkey", "int(100 + 37 * (p_partkey % 29)) as w", "int(150 + 41 * (p_partkey % 23)) as h")


@query(f"WITH {_PYRAMID} SELECT p_partkey, zoom_level, round(scale_factor, 6) AS scale_factor, floor(w * scale_factor + 0.5)::INT AS scaled_width, floor(h * scale_factor + 0.5)::INT AS scaled_height, max_zoom_level FROM p")
def pyramid_levels(spark, sf):
    return grid.pyramid(_images(spark, sf), "p_partkey", "w", "h")


@query(f"""WITH {_PYRAMID}, q AS (SELECT *, floor(w * scale_factor + 0.5)::INT AS sw, floor(h * scale_factor + 0.5)::INT AS sh FROM p), g AS (SELECT *, unnest(range(0, sh - 224 + 1, 112)) AS y FROM q), t AS (SELECT *, unnest(range(0, sw - 224 + 1, 112)) AS x FROM g)
SELECT p_partkey, zoom_level, row_number() OVER (PARTITION BY p_partkey ORDER BY zoom_level, y, x) - 1 AS patch_id, round(x / scale_factor, 6) AS x1, round(y / scale_factor, 6) AS y1, round((x + 224) / scale_factor, 6) AS x2, round((y + 224) / scale_factor, 6) AS y2 FROM t""")
def pyramid_tiles(spark, sf):
    return grid.tiles_of(grid.pyramid(_images(spark, sf), "p_partkey", "w", "h"), "p_partkey").withColumn("patch_id", F.col("patch_id").cast("long"))


@query("SELECT event_id, least(greatest(round_even(value / 200 * 9, 0), 0), 9)::INT AS line, (greatest(1, round_even(value / 16, 0)) * 16)::INT AS size FROM events")
def grid_lines(spark, sf):
    e = table(spark, sf, "events")
    return e.select("event_id", grid.nearest_line("value", F.lit(200.0), 10).alias("line"), grid.grid_size("value", 16).alias("size"))


@query(f"WITH {ANN}, s AS (SELECT box_id, x1 - 20 AS a, x2 - 20 AS b FROM ann), m AS (SELECT *, CASE WHEN a < 0 THEN -a WHEN b > 50 THEN 50 - b ELSE 0 END AS move FROM s) SELECT box_id, a + move AS s1, b + move AS s2 FROM m")
def shifted_intervals(spark, sf):
    s1, s2 = grid.shifted_interval(F.col("x1") - 20, F.col("x2") - 20, F.lit(50.0))
    return annotations(spark, sf).select("box_id", s1.alias("s1"), s2.alias("s2"))


@query(f"""WITH {ANN}, l AS (SELECT box_id, greatest(0, x2 - 30) AS low, least(x1, 70) AS high, ('0x' || substr(md5('3:' || box_id), 1, 5))::INT / 1048576.0::DOUBLE AS u FROM ann),
c AS (SELECT box_id, low + (greatest(low, high) - low) * u AS cx1 FROM l) SELECT box_id, round(cx1, 6) AS cx1, round(cx1 + 30, 6) AS cx2 FROM c""")
def random_crops(spark, sf):
    """Places come from a seeded hash."""
    a = annotations(spark, sf)
    x = grid.random_crop(F.col("x1"), F.col("x2"), F.lit(30.0), F.lit(100.0), 3, F.col("box_id"))
    return a.select("box_id", x[0].alias("cx1"), x[1].alias("cx2"))


def _label_store(spark, sf) -> DataFrame:
    box = F.struct("x1", "y1", "x2", "y2", F.concat(F.lit("c"), "category").alias("description"), (F.col("category") <= 4).alias("marked_accepted"))
    marked = annotations(spark, sf).groupBy("dbidx").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    some = tiles(spark, sf).select("dbidx").distinct().where("dbidx % 3 <> 1")
    return some.join(marked, "dbidx", "left").withColumn("boxes", F.when(F.col("dbidx") % 3 == 0, F.coalesce("boxes", F.array().cast(marked.schema["boxes"].dataType))).otherwise(F.col("boxes")))


@query(f"WITH {ANN}, d AS (SELECT DISTINCT vec_id // 5 AS dbidx FROM embeddings), n AS (SELECT d.dbidx, count(box_id) AS n, coalesce(bool_or(category <= 4), false) AS accepted FROM d LEFT JOIN ann USING (dbidx) WHERE d.dbidx % 3 <> 1 GROUP BY d.dbidx) SELECT dbidx, (n > 0)::INT AS y, accepted FROM n WHERE n > 0 OR dbidx % 3 = 0")
def label_states(spark, sf):
    store = _label_store(spark, sf)
    return labels.binary(store).join(store.select("dbidx", labels.accepted("boxes").alias("accepted")), "dbidx")


@query(f"WITH {ANN} SELECT dbidx, x1, y1, x2, y2 FROM ann WHERE dbidx % 3 <> 1 AND category = 2")
def target_boxes(spark, sf):
    return labels.box_rows(_label_store(spark, sf), "c2")


@query()
def box_tracks(spark, sf):
    """Matching from frame to frame is sequential."""
    b = tiles(spark, sf).selectExpr("dbidx div 10 as video_id", "int(dbidx % 10) as frame", "vec_id", "x1", "y1", "x2", "y2")
    return tracking.tracks(b).select("video_id", "frame", "vec_id", "track_id", "confirmed")


@query(f"WITH {RUNS} SELECT category, variant, hits[1]::DOUBLE AS position_1, hits[2]::DOUBLE AS position_2, hits[3]::DOUBLE AS position_3, hits[10]::DOUBLE AS position_10 FROM runs")
def hit_positions(spark, sf):
    r = runs(spark, sf)
    r = r.withColumn("hit_indices", F.col("hit_indices").cast("array<double>"))
    return r.select("category", "variant", *metrics.zero_based_ranks("hit_indices"))


@query("""WITH s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS v FROM events GROUP BY user_id)
SELECT user_id, round(list_sum(list_transform(v, lambda x, i: x * sqrt(1.0 / i))) / list_sum(list_transform(list_reverse_sort(v), lambda x, i: x * sqrt(1.0 / i))), 6) AS quality FROM s""")
def ranking_quality(spark, sf):
    v = logs.positions(table(spark, sf, "events")).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("v"))
    return v.select("user_id", metrics.ranking_quality(F.transform("v", lambda s: s["value"])).alias("quality"))


@query("SELECT event_id, round(percent_rank() OVER (PARTITION BY event_type ORDER BY value), 6) AS place FROM events")
def percent_ranks(spark, sf):
    return table(spark, sf, "events").select("event_id", F.percent_rank().over(Window.partitionBy("event_type").orderBy("value")).alias("place"))


@query(f"""WITH {TILES}, {SCORED}, m AS (SELECT dbidx, max(score) AS m FROM scored GROUP BY dbidx) SELECT vec_id, round(exp(score - m) / sum(exp(score - m)) OVER (PARTITION BY scored.dbidx), 6) AS share FROM scored JOIN m USING (dbidx)""")
def frame_softmax(spark, sf):
    s = search.scored(tiles(spark, sf), embedding_of(spark, sf, 0)).select("vec_id", "dbidx", "score")
    w = Window.partitionBy("dbidx")
    s = s.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return s.select("vec_id", (F.col("e") / F.sum("e").over(w)).alias("share"))


@query("""WITH p AS (SELECT a.vec_id AS positive, b.vec_id AS negative, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.label = 1 AND b.label <> 1)
SELECT positive, rank, negative FROM p WHERE rank <= 3""")
def hard_negative_pairs(spark, sf):
    e = table(spark, sf, "embeddings")
    positive = e.where("label = 1").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    found = search.many_queries(e.where("label <> 1"), positive, 3)
    return found.select(F.col("query_id").alias("positive"), F.col("rank").cast("long").alias("rank"), F.col("vec_id").alias("negative"))


@query()
def mixture_components(spark, sf):
    """An iterative fit."""
    return models.mixture(table(spark, sf, "embeddings"), 3, steps=5).select("vec_id", F.col("component").cast("int").alias("component"))


@query()
def calibrated_scores(spark, sf):
    """An iterative fit."""
    s = search.scored(tiles(spark, sf), embedding_of(spark, sf, 0)).select("vec_id", "score", (F.col("label") == 1).cast("int").alias("y"))
    slope, shift = models.calibration(s)
    return s.select("vec_id", vectors.sigmoid("score", slope, shift).alias("p"))


# --- streams ----------------------------------------------------------------------------------------------------------------------


def _streamed(spark, sf, make) -> DataFrame:
    """What a stream over the events has written to files; the watermark decides when a window is whole. Once all are read, an event
    of no user, long after the others, makes the last windows whole."""
    import uuid

    place, schema = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", stream.EVENTS.replace("ts timestamp", "ts timestamp_ntz")
    last = table(spark, sf, "events").agg(F.max("ts").alias("ts")).where("ts is not null")
    last = last.selectExpr("-1L as event_id", "ts + interval 30 days as ts", "-1L as user_id", "'end' as event_type", "0D as value", "'{}' as props")
    last.where("false").write.parquet(f"{place}/end")
    for step in (1, 2):
        if step == 2:
            last.write.mode("append").parquet(f"{place}/end")
        log = stream.read_log(spark, sf, schema, only="events.parquet").union(stream.read_log(spark, f"{place}/end", schema)).withColumn("ts", F.col("ts").cast("timestamp"))
        out = make(log)
        q = out.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{place}/state").option("path", f"{place}/out").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{place}/out")


@query("SELECT epoch_us(date_trunc('hour', ts)) AS start_us, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def stream_hourly_counts(spark, sf):
    return _streamed(spark, sf, stream.windowed_counts).select(F.unix_micros("start").alias("start_us"), "event_type", "n", "total")


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 6 HOUR, true) AS fresh FROM events), s AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, count(*) AS n FROM s GROUP BY user_id, k""")
def stream_user_sessions(spark, sf):
    return _streamed(spark, sf, lambda log: stream.user_sessions(log, "6 hours")).select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("SELECT event_id, user_id FROM events")
def stream_distinct_events(spark, sf):
    """The log read twice over, as two sources, without its repeats."""
    return _streamed(spark, sf, lambda log: stream.without_duplicates(log.union(log)).select("event_id", "user_id")).where("event_id >= 0")


@query("WITH m AS (SELECT user_id, ts, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM events) SELECT user_id, epoch_us(ts) AS ts_us, value FROM m WHERE most IS NULL OR value > most")
def stream_records(spark, sf):
    """Events above all of the user's before, by state."""
    return _streamed(spark, sf, stream.record_events).where("user_id >= 0").select("user_id", F.unix_micros("ts").alias("ts_us"), "value")


@query(f"WITH {STATS}, m AS (SELECT dataset, category, " + ", ".join(f"max(ndcg_score) FILTER (variant = {v}) AS v_{v}" for v in range(3)) + " FROM stats GROUP BY ALL) SELECT dataset, category, " + ", ".join(f"round(v_{v}, 6) AS v_{v}" for v in range(3)) + ", round(v_2 - v_0, 6) AS delta FROM m")
def method_matrix(spark, sf):
    return reports.method_matrix(stats(spark, sf), "ndcg_score", [0, 1, 2])


@query("SELECT user_id, round(avg(value) + 1e-9, 6) AS latency_mean, round(stddev_pop(value) + 1e-9, 6) AS latency_std FROM events GROUP BY user_id")
def latency_means(spark, sf):
    v = table(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list("value")).alias("latencies"))
    nudge = lambda c: (F.col(c) + 1e-9).alias(c)  # noqa: E731  means of cents fall on halves of the last digit
    return reports.latency_means(v).select("user_id", nudge("latency_mean"), nudge("latency_std"))


@query(f"WITH {ANN} SELECT dbidx, unnest(list(x1 ORDER BY x1, y1)) AS x1, unnest(list(y1 ORDER BY x1, y1)) AS y1 FROM ann WHERE category = 2 GROUP BY dbidx")
def boxes_by_image(spark, sf):
    found = tables.boxes_by_image(annotations(spark, sf), 2)
    return found.select("dbidx", F.explode("boxes").alias("b")).select("dbidx", "b.x1", "b.y1")


@query("SELECT DISTINCT page_id, url FROM pages WHERE url IS NOT NULL AND (page_id % 3 = 0 OR page_id % 5 = 0)")
def reviewed_sessions(spark, sf):
    p = table(spark, sf, "pages").where("url is not null").select("page_id", "url")
    return tables.reviewed_sessions(p, p.where("page_id % 3 = 0"), p.where("page_id % 5 = 0"), key="url").where("page_id % 3 = 0 or page_id % 5 = 0").distinct()


@query("SELECT conv_id, turn, len(list_filter(string_split_regex(text, '[.!?]+\\s*'), lambda s: s <> '')) AS n FROM conversations WHERE text IS NOT NULL")
def sentence_counts(spark, sf):
    c = table(spark, sf, "conversations").where("text is not null")
    parts = F.filter(F.split("text", r"[.!?]+\s*"), lambda s: s != "")
    return c.select("conv_id", "turn", F.size(parts).cast("long").alias("n"))


@query()
def graph_search(spark, sf):
    """A loop of queries and feedback along a graph: one summary row a method."""
    t, truth, edges = cut(tiles(spark, sf)), annotations(spark, sf), cut(_knn(spark, sf))
    found = [session.simulated(session.Session(t, embedding_of(spark, sf, 0), m, batch=3, graph=edges), truth, 1, 3, 3) for m in ("lknn", "active")]
    found += [session.simulated(session.Session(t, embedding_of(spark, sf, 0), m, batch=3, graph=edges, options={"steps": 2}), truth, 1, 3, 2) for m in ("knn_prop", "pseudo")]
    rows = [(r["method"], r["hit_indices"], r["nseen"], r["nfound"], r["ntotal"], r["dbidxs"]) for r in found]
    return spark.createDataFrame(rows, "method string, hit_indices array<int>, nseen int, nfound int, ntotal int, dbidxs array<long>")


_AXES = [[1.0 if j == i else 0.0 for j in range(64)] for i in range(6)]
_BUCKET = " + ".join(f"((v[{i + 1}] > 0)::INT << {i})" for i in range(6))


@query(f"""WITH {TILES}, {SCORED}, b AS (SELECT *, bit_count(xor({_BUCKET}, (SELECT {_BUCKET} FROM (SELECT {Q0} AS v)))) AS away FROM scored WHERE dbidx % 3 <> 0),
r AS (SELECT n FROM range(7) t(n) WHERE n = 6 OR (SELECT count(*) >= 40 AND count(DISTINCT dbidx) >= 4 FROM b WHERE away <= n) ORDER BY n LIMIT 1)
SELECT dbidx, round(max(score), 6) AS max_score FROM b WHERE away <= (SELECT n FROM r) GROUP BY dbidx ORDER BY max(score) DESC, dbidx LIMIT 4""")
def approximate_frames(spark, sf):
    t = tiles(spark, sf)
    return search.approximate_frames(search.with_buckets(t, _AXES), embedding_of(spark, sf, 0), _AXES, 4, t.where("dbidx % 3 = 0"))


_ANCHOR = f"""WITH {TILES}, {SCORED}, top AS (SELECT *, row_number() OVER (PARTITION BY dbidx ORDER BY score DESC, vec_id) AS r FROM scored), a AS (SELECT * FROM top WHERE r = 1),
p AS (SELECT a.dbidx, a.vec_id, b.vec_id AS other, b.score AS sb, b.v, row_number() OVER (PARTITION BY a.dbidx, b.zoom_level ORDER BY {_IOU} DESC, b.vec_id) AS r FROM a JOIN scored b ON {_OVERLAP}) """


@query(_ANCHOR + "SELECT dbidx, vec_id, round(avg(sb), 6) AS score FROM p WHERE r = 1 GROUP BY ALL")
def anchored_scores(spark, sf):
    return search.anchored(tiles(spark, sf), embedding_of(spark, sf, 0))


@query(_ANCHOR + f""", u AS (SELECT dbidx, vec_id, unnest(v) AS x, unnest(range(len(v))) AS i FROM p WHERE r = 1), m AS (SELECT dbidx, vec_id, i, avg(x) AS x FROM u GROUP BY ALL), l AS (SELECT dbidx, vec_id, list(x ORDER BY i) AS v FROM m GROUP BY ALL)
SELECT dbidx, vec_id, round(list_dot_product(v, {Q0}) / sqrt(list_dot_product(v, v)), 6) AS score FROM l""")
def anchored_vectors(spark, sf):
    return search.anchored(tiles(spark, sf), embedding_of(spark, sf, 0), "avg_vector")


from . import catalog_api  # noqa: E402, F401  registers more queries
