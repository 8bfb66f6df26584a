"""More registered queries: sources and sinks, sessions, settings and user functions, each over whole sample tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalog import _CONT, _OVERLAP, _PATHS, ANN, Q1, RUNS, SCORED, STATS, TILES, _multiscale_sql, _paths, annotations, embedding_of, query, runs, stats, table, tiles
from .functions import batches, boxes, text, vectors
from .operators import logs, search, spatial
from .plans import feedback, reports, session
from .sources import tables
from .sources.shared import shared_dir


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks ------------------------------------------------------------------------------------------------------------


@query(r"WITH n AS (SELECT DISTINCT url AS name FROM pages WHERE url IS NOT NULL UNION SELECT p_name FROM part UNION SELECT '..') SELECT name, name <> '' AND name NOT IN ('.', '..') AND NOT contains(name, '/') AND NOT contains(name, '\') AS valid FROM n")
def valid_names(spark, sf):
    n = table(spark, sf, "pages").where("url is not null").select(F.col("url").alias("name")).union(table(spark, sf, "part").select("p_name")).union(spark.createDataFrame([("..",)], "name string")).distinct()
    return n.select("name", batches.by_row(tables.valid_name, "boolean")("name").alias("valid"))


@query(f"WITH {_PATHS} SELECT row_number() OVER (ORDER BY file_path) - 1 AS dbidx, file_path FROM p")
def catalogue_files(spark, sf):
    """A dataset made in a catalogue and read back."""
    c = tables.Catalogue(spark, _place(spark, "catalogue"))
    c.create("sample", _paths(spark, sf))
    assert c.datasets() == ["sample"]
    return c.files("sample").select("dbidx", "file_path")


@query(f"WITH {ANN} SELECT dbidx, category, x1 FROM ann")
def catalogue_ground_truth(spark, sf):
    """Ground truth saved in a catalogue; some columns of it are read back."""
    c = tables.Catalogue(spark, _place(spark, "catalogue"))
    c.save("sample", "ground_truth", "boxes", annotations(spark, sf))
    assert c.items("sample", "ground_truth") == ["boxes"]
    return c.load("sample", "ground_truth", "boxes", ["dbidx", "category", "x1"])


@query(f"WITH {_PATHS}, f AS (SELECT file_path, row_number() OVER (ORDER BY file_path) - 1 AS dbidx FROM p WHERE length(file_path) % 2 = 0) SELECT page_id, dbidx FROM pages JOIN f ON regexp_replace(url, '^[a-z]+://', '') = file_path")
def numbered_boxes(spark, sf):
    """Rows with their file's number; those of unknown files are dropped."""
    files = tables.file_table(_paths(spark, sf).where("length(file_path) % 2 = 0"))
    rows = table(spark, sf, "pages").select("page_id", F.regexp_replace("url", "^[a-z]+://", "").alias("file_path"))
    return tables.with_dbidx(rows, files).select("page_id", "dbidx")


def _sessions(spark, sf) -> DataFrame:
    """A session for every ten frames, a batch a frame, with the boxes of their annotations; categories up to 4 are accepted."""
    box = F.struct("x1", "y1", "x2", "y2", F.concat(F.lit("c"), "category").alias("description"), (F.col("category") <= 4).alias("marked_accepted"))
    timing = F.array(F.struct((F.col("dbidx") * 1000).alias("start_ms"), (F.col("dbidx") * 1000 + 500).alias("end_ms")))
    frames = annotations(spark, sf).groupBy("dbidx").agg(F.sort_array(F.collect_list(box)).alias("boxes"))
    image = F.struct(F.concat(F.lit("im"), "dbidx").alias("url"), "dbidx", "boxes", timing.alias("timing"))
    by = frames.withColumn("session_id", F.expr("dbidx div 10")).groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("dbidx", F.array(image).alias("b")))).alias("s"))
    return by.select("session_id", (F.col("session_id") % 3).alias("qkey"), F.transform("s", lambda x: x["b"]).alias("gdata"))


def _saved(spark, sf) -> DataFrame:
    place = _place(spark, "sessions")
    tables.write_sessions(_sessions(spark, sf), place)
    return tables.read_sessions(spark, place, name="*.json")


@query(f"WITH {ANN} SELECT 'im' || dbidx AS url, dbidx, x1, y1, x2, y2, 'c' || category AS description FROM ann WHERE category <= 4")
def accepted_session_boxes(spark, sf):
    """Sessions saved as documents and read back: the boxes accepted in them."""
    return tables.accepted_boxes(_saved(spark, sf)).drop("session_path")


@query(f"""WITH {ANN}, f AS (SELECT dbidx, dbidx // 10 AS s, bool_or(category <= 4) AS accepted FROM ann GROUP BY dbidx)
SELECT dbidx, dbidx * 1.0 AS start_s, accepted, (sum(accepted::INT) OVER w)::BIGINT AS total_accepted, row_number() OVER w AS total_seen FROM f WINDOW w AS (PARTITION BY s ORDER BY dbidx)
UNION ALL SELECT NULL, 0, false, 0, 0 FROM (SELECT DISTINCT s FROM f)""")
def session_timeline(spark, sf):
    """The images of saved sessions in order of time, with running totals."""
    t = logs.timeline(_saved(spark, sf).select("session_path", "gdata"))
    return t.select("dbidx", "start_s", "accepted", F.col("total_accepted").cast("long").alias("total_accepted"), F.col("total_seen").cast("long").alias("total_seen"))


@query(f"WITH {ANN} SELECT d.dbidx, count(box_id) AS num_labels, round(coalesce(sum(x1), 0), 6) AS total FROM (SELECT DISTINCT vec_id // 5 AS dbidx FROM embeddings) d LEFT JOIN ann USING (dbidx) GROUP BY d.dbidx")
def nested_frames(spark, sf):
    """Frames with arrays of labels taken apart: the number of labels of each, and their sum."""
    marked = annotations(spark, sf).groupBy("dbidx").agg(F.collect_list(F.struct("x1", "category")).alias("labels"))
    documents = table(spark, sf, "embeddings").select(F.expr("vec_id div 5").alias("dbidx")).distinct().join(marked, "dbidx", "left")
    boxes, frames = tables.nested_frames(documents, "labels", ("dbidx",))
    sums = boxes.groupBy("dbidx").agg(F.sum("x1").alias("total"))
    return frames.join(sums, "dbidx", "left").select("dbidx", F.col("num_labels").cast("long").alias("num_labels"), F.coalesce("total", F.lit(0.0)).alias("total"))


@query("SELECT c_custkey, c_name, c_nationkey FROM customer")
def delimited_batches(spark, sf):
    """Batches written as delimited files and read back under a declared schema."""
    place = _place(spark, "batches")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey").write.option("header", "true").csv(place)
    return tables.read_batches(spark, place, "c_custkey long, c_name string, c_nationkey long")


@query(f"WITH {STATS} SELECT dataset, category, variant, round(average_precision, 6) AS average_precision FROM stats")
def cached_summaries(spark, sf):
    """Summaries made once and read from their table after."""
    place = _place(spark, "summaries")
    make = lambda: stats(spark, sf).select("dataset", "category", "variant", "average_precision")
    tables.cached_table(make, spark, place)
    return tables.cached_table(lambda: 1 / 0, spark, place)


@query("SELECT event_id, CASE WHEN value > 150 AND event_type = 'error' THEN 'outlier' ELSE event_type END AS event_type FROM events")
def relabelled_rows(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "value")
    return tables.relabelled(e, (F.col("value") > 150) & (F.col("event_type") == "error"), "event_type", "outlier").select("event_id", "event_type")


# --- ranking and reports ----------------------------------------------------------------------------------------------------------


@query("SELECT vec_id, label::DOUBLE AS score FROM embeddings WHERE vec_id % 3 <> 0 ORDER BY label DESC, vec_id LIMIT 20")
def remaining_topk(spark, sf):
    """The best of what has no label yet."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("double").alias("score"))
    return search.top_k(search.without(e, e.where("vec_id % 3 = 0"), "vec_id"), 20, "vec_id")


@query("WITH p AS (SELECT DISTINCT props FROM events WHERE event_type = 'click') SELECT e.event_id, p.props IS NOT NULL AS known FROM events e LEFT JOIN p USING (props)")
def parameters_by_hash(spark, sf):
    """Runs with the parameters that their hash stands for; unknown hashes stay."""
    e = table(spark, sf, "events").select("event_id", "event_type", text.parameter_hash("props").alias("param_hash"), "props")
    known = e.where("event_type = 'click'").select("param_hash", "props").distinct()
    return reports.with_parameters(e.select("event_id", "param_hash"), known).select("event_id", F.col("props").isNotNull().alias("known"))


@query("SELECT DISTINCT value, CASE WHEN starts_with(f, '0.') THEN f[2:] WHEN starts_with(f, '-0.') THEN '-' || f[3:] ELSE f END AS said, format('{:.1f}', value) || 'x' AS times FROM (SELECT value, format('{:.2f}', value) AS f FROM (SELECT value / 100 AS value FROM events))")
def formatted_values(spark, sf):
    v = table(spark, sf, "events").select((F.col("value") / 100).alias("value")).distinct()
    return v.select("value", batches.by_row(reports.brief, "string")("value").alias("said"), batches.by_row(reports.times, "string")("value").alias("times"))


@query("WITH m AS (SELECT event_type, user_id, sum(value) AS v FROM events GROUP BY ALL) SELECT event_type, user_id, round(v, 6) AS v, round(min(v) OVER (PARTITION BY event_type), 6) AS least, round(v / min(v) OVER (PARTITION BY event_type), 6) AS ratio FROM m")
def facet_baselines(spark, sf):
    """Each facet's least value beside its rows."""
    m = table(spark, sf, "events").groupBy("event_type", "user_id").agg(F.sum("value").alias("v"))
    return reports.with_group_least(m, "v", ["event_type"]).select("event_type", "user_id", "v", "least", (F.col("v") / F.col("least")).alias("ratio"))


@query("SELECT event_type, user_id % 4 AS dataset, round(median(value), 6) AS median, round(avg(value) + 1e-9, 6) AS mean, count(value) AS n FROM events GROUP BY ALL")
def group_centres(spark, sf):
    e = table(spark, sf, "events").withColumn("dataset", F.expr("user_id % 4"))
    return reports.centres(e, "value", ["event_type", "dataset"]).withColumn("mean", F.col("mean") + 1e-9)


@query(f"WITH {STATS}, m AS (SELECT dataset, variant, avg(ndcg_score) AS mean FROM stats GROUP BY ALL) SELECT a.dataset, a.variant, round(a.mean, 6) AS mean, round(a.mean / b.mean, 6) AS ratio FROM m a JOIN m b ON a.dataset = b.dataset AND b.variant = 0")
def method_ratios(spark, sf):
    """Means against the baseline's mean of the same dataset."""
    return reports.ratios(stats(spark, sf), "ndcg_score", 0)


@query("WITH s AS (SELECT user_id % 7 AS dataset, count(*) AS size FROM events GROUP BY ALL), l AS (SELECT user_id % 7 AS dataset, event_type, avg(value) AS latency FROM events GROUP BY ALL) SELECT l.dataset, event_type, size, round(latency + 1e-9, 6) AS latency FROM l JOIN s USING (dataset)")
def size_latency(spark, sf):
    """Latencies beside the sizes of their datasets."""
    e = table(spark, sf, "events").withColumn("dataset", F.expr("user_id % 7"))
    l = e.groupBy("dataset", "event_type").agg((F.avg("value") + 1e-9).alias("latency"))
    return reports.with_sizes(l, e, "dataset").select("dataset", "event_type", "size", "latency")


@query("""WITH c AS (SELECT unnest(['objectnet', 'lvis', 'dota', 'coco', 'bdd', 'other']) AS dataset), n AS (SELECT DISTINCT p_type || '-' || p_name || ' (' || lower(p_brand) || ')' AS name FROM part UNION SELECT unnest(['mouse', 'rider', 'coffee/french press', 'ship_small-craft', ' bills  (money)'])),
a AS (SELECT dataset, name, string_split(name, '(') AS p FROM c, n), o AS (SELECT *, CASE WHEN len(p) = 2 THEN replace(p[2], ')', ' ') || ' ' || p[1] ELSE name END AS turned FROM a)
SELECT dataset, name, CASE WHEN dataset = 'coco' AND name = 'mouse' THEN 'computer mouse' WHEN dataset = 'bdd' AND name = 'rider' THEN 'bike rider'
  WHEN dataset = 'objectnet' THEN trim(regexp_replace(replace(turned, '/', ' or '), '\\s+', ' ', 'g')) WHEN dataset = 'lvis' THEN trim(regexp_replace(regexp_replace(name, '[_()]', ' ', 'g'), '\\s+', ' ', 'g'))
  WHEN dataset = 'dota' THEN replace(name, '-', ' ') ELSE name END AS said FROM o""")
def dataset_queries(spark, sf):
    """How the categories of each dataset are asked for."""
    names = table(spark, sf, "part").select(F.concat("p_type", F.lit("-"), "p_name", F.lit(" ("), F.lower("p_brand"), F.lit(")")).alias("name"))
    names = names.union(spark.createDataFrame([(n,) for n in ("mouse", "rider", "coffee/french press", "ship_small-craft", " bills  (money)")], "name string")).distinct()
    sets = spark.createDataFrame([(d,) for d in ("objectnet", "lvis", "dota", "coco", "bdd", "other")], "dataset string")
    return names.withColumn("dataset", F.explode(F.lit([r.dataset for r in sets.collect()]))).select("dataset", "name", text.dataset_query("dataset", "name").alias("said"))


@query(f"WITH {STATS}, m AS (SELECT category % 3 AS horizon, variant, dataset, avg(average_precision) AS m FROM stats GROUP BY ALL) SELECT horizon, variant, round(avg(m), 6) AS mean FROM m GROUP BY ALL")
def horizon_means(spark, sf):
    """Means of datasets' means, by variant and a second setting."""
    s = stats(spark, sf).withColumn("horizon", F.col("category") % 3)
    return reports.two_level_means(s, "average_precision", ["horizon", "variant"])


@query(_multiscale_sql(f"SELECT dbidx, vec_id, 2 * score - list_dot_product(v, {Q1}) AS score FROM near"))
def callback_rescored(spark, sf):
    """A shortlist scored anew by a function of the vectors."""
    q, other = (vectors.vector(embedding_of(spark, sf, i)) for i in (0, 1))
    t = tiles(spark, sf)
    rescore = lambda c: 2 * vectors.dot(c, q) - vectors.dot(c, other)
    return search.multiscale_query(t, embedding_of(spark, sf, 0), 5, exclude=t.where("dbidx % 3 = 0"), rescore=rescore)


@query(f"""WITH {TILES}, {ANN}, t AS (SELECT *, row_number() OVER (PARTITION BY dbidx ORDER BY md5('5:' || vec_id), vec_id) AS r FROM tiles)
SELECT b.dbidx, b.vec_id, a.box_id, category, round({_CONT}, 6) AS cont FROM ann a JOIN t b ON b.r <= 2 AND {_OVERLAP} WHERE {_CONT} > 0.5""")
def contained_labels(spark, sf):
    """Labels that lie for the most part in one of two sampled boxes of their frame."""
    return spatial.contained_labels(tiles(spark, sf), annotations(spark, sf), 0.5, "vec_id", "box_id", 2, 5)


@query(f"""WITH {ANN}, im AS (SELECT *, 120 + dbidx % 7 AS w, 90 + dbidx % 5 AS h FROM ann), s AS (SELECT *, greatest(least(greatest(x2 - x1, y2 - y1), least(w, h)), least(40, least(w, h)))::DOUBLE AS side FROM im),
p AS (SELECT box_id, side, greatest(0, least((x1 + x2) / 2 - side / 2, w - side)) AS sx1, greatest(0, least((y1 + y2) / 2 - side / 2, h - side)) AS sy1 FROM s) SELECT box_id, sx1, sy1, sx1 + side AS sx2, sy1 + side AS sy2 FROM p""")
def ground_truth_patches(spark, sf):
    """The best square around each box inside its image, whose size comes by a join."""
    images = tiles(spark, sf).select("dbidx").distinct().selectExpr("dbidx", "120 + dbidx % 7 as im_width", "90 + dbidx % 5 as im_height")
    return annotations(spark, sf).join(images, "dbidx").select("box_id", *boxes.square_box(40))


@query("SELECT p_partkey, p_type FROM part WHERE p_type NOT IN ('ECONOMY') AND NOT ends_with(p_type, 'D') AND NOT ends_with(p_type, 'O')")
def kept_categories(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_type")
    return tables.without_categories(p, ("ECONOMY",), ("D", "O"), "p_type")


@query(f"WITH {TILES}, {SCORED} SELECT vec_id, dbidx FROM scored WHERE score >= 0.05")
def confident_boxes(spark, sf):
    return search.scored(tiles(spark, sf), embedding_of(spark, sf, 0)).where("score >= 0.05").select("vec_id", "dbidx")


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE event_id % 3 <> 0")
def decoded_rows(spark, sf):
    """Values that can't be decoded are dropped with their rows."""
    import json

    e = table(spark, sf, "events").selectExpr("event_id", "if(event_id % 3 = 0, substr(props, 1, 4), props) as raw")
    return batches.decoded(e, "raw", lambda s: json.loads(s)["k"], "long", "k").select("event_id", "k")


@query(f"""WITH {RUNS} SELECT 'd' || dataset AS dataset, 'multiscale' AS index_name, 'c' || category AS category, 'v' || variant AS variant, 60 AS n_batches, 1 AS batch_size, 10 AS max_results,
len(hits) > 0 AS has_result, CASE WHEN len(hits) > 0 THEN len(hits) END AS nfound FROM runs""")
def flattened_runs(spark, sf):
    """Run documents as flat rows; those without a result are unfinished."""
    n = F.size("hit_indices")
    spec = F.struct(F.concat(F.lit("d"), "dataset").alias("d_name"), F.lit("multiscale").alias("i_name"))
    document = F.struct(
        F.struct(F.concat(F.lit("v"), "variant").alias("name"), F.concat(F.lit("c"), "category").alias("ground_truth_category"), F.lit(60).alias("n_batches"), F.lit(10).alias("max_results")).alias("bench_params"),
        F.struct(spec.alias("index_spec"), F.lit(1).alias("batch_size")).alias("session_params"), F.when(n > 0, F.struct(n.alias("nfound"))).alias("result"),
    )
    return tables.flattened_runs(runs(spark, sf).select(F.to_json(document).alias("summary"))).drop("session_params")


# --- sessions and settings --------------------------------------------------------------------------------------------------------


@query(f"""WITH {RUNS}, s AS (SELECT DISTINCT nseen // 10 AS batches, len(hits) AS positives, nseen - len(hits) AS negatives, coalesce(hits[len(hits)], -1) >= len(hits) AS reversed FROM runs),
p AS (SELECT unnest(['from_start', 'after_first_batch', 'after_first_positive', 'after_first_negative', 'after_first_positive_and_negative', 'after_first_reversal']) AS policy)
SELECT policy, batches, positives, negatives, reversed, CASE policy WHEN 'from_start' THEN true WHEN 'after_first_batch' THEN batches >= 1 WHEN 'after_first_positive' THEN positives > 0 WHEN 'after_first_negative' THEN negatives > 0
  WHEN 'after_first_positive_and_negative' THEN positives > 0 AND negatives > 0 ELSE reversed END AS may FROM s, p""")
def refine_policies(spark, sf):
    """Whether feedback is used yet, by each start policy, in every state that the runs end in."""
    last = F.coalesce(F.try_element_at("hit_indices", F.lit(-1)), F.lit(-1))
    s = runs(spark, sf).select(F.expr("nseen div 10").alias("batches"), F.size("hit_indices").cast("long").alias("positives"), (F.col("nseen") - F.size("hit_indices")).alias("negatives"), (last >= F.size("hit_indices")).alias("reversed")).distinct()

    def decided(p: pd.DataFrame) -> pd.DataFrame:
        rows = [(policy, *r, feedback.may_refine(policy, *r)) for r in p.itertuples(index=False, name=None) for policy in feedback.START_POLICIES]
        return pd.DataFrame(rows, columns=["policy", *p.columns, "may"])

    return batches.map_batches(s, decided, "policy string, batches long, positives long, negatives long, reversed boolean, may boolean")


@query("""WITH e AS (SELECT user_id, value / 250 AS p, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events), c AS (SELECT *, sum(p) OVER (PARTITION BY user_id ORDER BY k) AS total FROM e),
f AS (SELECT user_id, min(k) AS k FROM c WHERE total >= 2 GROUP BY user_id) SELECT c.user_id, round(k - (total - 2) / p, 6) AS tosses FROM c JOIN f USING (user_id, k)""")
def expected_tosses(spark, sf):
    """How many look-ups, the most probable first, until two positives are expected; users of too few are left out."""
    e = table(spark, sf, "events").select("user_id", (F.col("value") / 250).alias("p"))
    tossed = lambda p: pd.DataFrame({"user_id": p["user_id"].iloc[:1], "tosses": [feedback.expected_tosses(2, p["p"].sort_values(ascending=False).to_numpy())]})
    return batches.aggregated(e, ["user_id"], tossed, "user_id long, tosses double").where("tosses < double('infinity')")


@query("SELECT r_name AS dataset, n_nationkey AS category, m.method, m.batch FROM region JOIN nation ON n_regionkey = r_regionkey, (VALUES ('plain', 1), ('multi', 3)) m(method, batch)")
def bench_settings(spark, sf):
    """Every method on every category of every dataset."""
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.sort_array(F.collect_list("n_nationkey")).alias("c")).collect()
    of = {r.r_name: r.c for r in n}
    made = session.bench_configs(sorted(of), of.get, [{"method": "plain", "batch": 1}, {"method": "multi", "batch": 3}])
    return spark.createDataFrame([(c["dataset"], c["category"], c["method"], c["batch"]) for c in made], "dataset string, category long, method string, batch int")


@query("SELECT method, k, edist FROM (VALUES ('plain')) m(method), (VALUES (NULL)) a(k), (VALUES (NULL)) b(edist) UNION ALL SELECT 'multi', k, edist FROM (VALUES (5), (10), (20)) a(k), (VALUES (0.03), (0.1)) b(edist)")
def setting_space(spark, sf):
    """All settings of a space of choices, nested ones included."""
    space = {"choose": [{"method": "plain"}, {"method": "multi", "graph": {"k": {"choose": [5, 10, 20]}, "edist": {"choose": [0.03, 0.1]}}}]}
    assert session.space_size(space) == 7
    every = session.sampled_configs(space, 100)
    return spark.createDataFrame([(c["method"], c.get("graph", {}).get("k"), c.get("graph", {}).get("edist")) for c in every], "method string, k int, edist double")


# --- user functions ---------------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, k AS copy FROM lineitem, range(1, 3) t(k) WHERE k = 1 OR l_quantity > 25")
def mapped_batches(spark, sf):
    """A function of batches that returns more rows than it is given."""
    l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")

    def doubled(p: pd.DataFrame, most: float) -> pd.DataFrame:
        again = p[p["l_quantity"] > most]
        return pd.concat([p.assign(copy=1), again.assign(copy=2)])[["l_orderkey", "l_linenumber", "copy"]]

    return batches.map_batches(l, doubled, "l_orderkey long, l_linenumber long, copy long", most=25.0)


@query("SELECT o_orderkey, o_totalprice > 100000 AS dear FROM orders")
def mapped_with_state(spark, sf):
    """A model that is made once a task."""

    def load():
        bound = 100_000.0
        return lambda p: pd.DataFrame({"o_orderkey": p["o_orderkey"], "dear": p["o_totalprice"].astype(float) > bound})

    return batches.map_with_state(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), load, "o_orderkey long, dear boolean")


@query("SELECT p_partkey, len(string_split(p_name, ' ')) AS words FROM part")
def row_function(spark, sf):
    return table(spark, sf, "part").select("p_partkey", batches.by_row(lambda s: len(s.split(" ")), "long")("p_name").alias("words"))


@query("SELECT event_type, round(max(value) - min(value), 6) AS spread, count(*) AS n FROM events GROUP BY event_type")
def user_aggregate(spark, sf):
    spread = lambda p: pd.DataFrame({"event_type": p["event_type"].iloc[:1], "spread": [p["value"].max() - p["value"].min()], "n": [len(p)]})
    return batches.aggregated(table(spark, sf, "events").select("event_type", "value"), ["event_type"], spread, "event_type string, spread double, n long")


@query("SELECT doc_id, length(text)::DOUBLE AS a, (length(text) - length(replace(text, 'e', '')))::DOUBLE AS b FROM documents WHERE text IS NOT NULL")
def embedded_texts(spark, sf):
    """Vectors of whole texts by an injected embedding."""
    d = batches.embedded(table(spark, sf, "documents").where("text is not null").select("doc_id", "text"), "text", lambda t: [len(t), t.count("e")])
    return d.select("doc_id", d["vector"][0].alias("a"), d["vector"][1].alias("b"))
