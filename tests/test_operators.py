"""Operators against brute force and golden cases, and their edges: empty tables, ties, nothing left."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import graph, logs, products, search, sets, spatial
from orrery.plans import feedback, reports, session
from orrery.sources import tables


def vectors(spark, x, key="vec_id"):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], f"{key} long, embedding array<double>")


def test_ties_go_to_the_smaller_id(spark):
    v = vectors(spark, [[1, 0], [1, 0], [0, 1]])
    assert [r.vec_id for r in search.coarse_query(v, [1, 0], 2).collect()] == [0, 1]
    assert search.coarse_query(v, [1, 0], 2, exclude=v).count() == 0
    assert search.coarse_query(v.where("false"), [1, 0], 2).count() == 0


def test_distinct_positions(spark):
    ranked = spark.createDataFrame(list(enumerate([10, 11, 11, 12, 12, 12, 13, 13])), "position long, dbidx long")
    assert [r.position for r in search.distinct_positions(ranked, 2).collect()] == [0, 1]


def test_overridden_top_k(spark):
    base = spark.createDataFrame(list(enumerate([0.5, 0.4, 0.3, 0.2, 0.1])), "vec_id long, score double")
    changed = spark.createDataFrame([(3, 0.6), (2, 0.0)], "vec_id long, score double")
    ids = lambda seen, k: [r.vec_id for r in search.overridden_top_k(base, changed, spark.createDataFrame([(s,) for s in seen], "vec_id long"), k).collect()]
    assert (ids([], 2), ids([0], 2), ids([0, 3], 2), ids([], 6)) == ([3, 0], [3, 1], [1, 4], [3, 0, 1, 4, 2])


def test_exact_knn_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(products, "TILE", 16)
    x = np.random.default_rng(0).standard_normal((70, 8))
    x[5] = x[9]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in graph.exact_knn(vectors(spark, x), 4).collect():
        got.setdefault(r.src_vertex, {})[r.dst_rank] = r.dst_vertex
    d = np.maximum(1 - x @ x.T, 0)
    for i in range(70):
        order = [j for j in np.lexsort((np.arange(70), d[i].round(12))) if j != i][:4]
        assert [got[i][k] for k in range(5)] == [i, *order]


def test_ring_propagation_and_ranker(spark):
    ring = [(i, (i + s) % 5, 0.0, k) for i in range(5) for k, s in ((1, 1), (2, 4))]
    edges = spark.createDataFrame(ring, "src_vertex long, dst_vertex long, distance double, dst_rank int")
    prior = spark.createDataFrame([(i, 0.5) for i in range(5)], "vertex long, f double")
    for y, near in ((1, 0.75), (0, 0.25)):
        labels = spark.createDataFrame([(2, y)], "vertex long, y int")
        got = {r.vertex: r.score for r in graph.neighbour_scores(edges, prior, labels).collect()}
        assert got == {0: 0.5, 1: near, 2: float(y), 3: near, 4: 0.5}
    w = graph.weights(edges, lambda d: F.lit(1.0))
    f = {r.vertex: r.f for r in graph.propagated(w, prior, spark.createDataFrame([(2, 1)], "vertex long, y int"), 1.0, steps=1, tolerance=None).collect()}
    assert f[2] == 1 and f[1] == pytest.approx((1 + 0.5 + 0.5) / 3)


def test_edge_loss(spark):
    edges = spark.createDataFrame([(0, 0, 0.0, 0), (0, 1, 1.0, 1), (1, 1, 0.0, 0), (1, 0, 1.0, 1)], "src_vertex long, dst_vertex long, distance double, dst_rank int")
    for width, unequal in ((1e4, 1.0), (1e-4, 0.0)):
        w = graph.weights(edges, lambda d, width=width: F.exp(-d / width))
        for y, loss in (((1.0, 1.0), 0.0), ((0.0, 1.0), unequal)):
            got = graph.edge_loss(w, spark.createDataFrame(list(enumerate(y)), "vertex long, y double")).first()[0]
            assert got == pytest.approx(loss, abs=1e-3)


def test_laplacian_rows_sum_to_zero(spark):
    x = np.random.default_rng(1).standard_normal((20, 4))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    w = graph.weights(graph.exact_knn(vectors(spark, x), 3))
    assert all(abs(r.s) < 1e-9 for r in graph.laplacian(w).groupBy("i").agg(F.sum("w").alias("s")).collect())


def test_kept_boxes(spark):
    rows = [(0, 1, 0.9, 0.0, 0.0, 10.0, 10.0), (0, 2, 0.8, 1.0, 1.0, 10.0, 10.0), (0, 3, 0.7, 20.0, 20.0, 30.0, 30.0), (1, 4, 0.1, 0.0, 0.0, 10.0, 10.0)]
    b = spark.createDataFrame(rows, "dbidx long, box_id long, score double, x1 double, y1 double, x2 double, y2 double")
    assert sorted(r.box_id for r in spatial.kept_boxes(b, ["box_id"], "score", 0.5).collect()) == [1, 3, 4]


def test_logs(spark):
    rows = [(1, 1, "a", 1.0), (1, 2, "b", 3.0), (1, 3, "a", 2.0), (2, 1, "b", 1.0)]
    log = spark.createDataFrame(rows, "user_id long, event_id long, m string, value double").withColumn("ts", F.timestamp_seconds("event_id"))
    assert {r.user_id: r.reversed for r in logs.reversals(log, F.col("m") == "a").collect()} == {1: True, 2: False}
    assert sorted((r.user_id, r.event_id) for r in logs.new_records(log, "value").collect()) == [(1, 1), (1, 2), (2, 1)]
    assert [(r.n_pairs, r.total_seconds) for r in logs.paired_spans(log, F.col("m") == "a", F.col("m") == "b").collect()] == [(1, 1.0)]


def test_sets_and_subset(spark):
    a, b = (spark.createDataFrame([(i,) for i in s], "k long") for s in ((1, 2, 2), (2, 3)))
    got = [sorted(r.k for r in f(a, b, "k").collect()) for f in (sets.id_union, sets.id_intersection, sets.id_difference)]
    assert got == [[1, 2, 3], [2], [1]] and not sets.is_subset(a, b, "k")


def test_sessions_from_documents(spark, tmp_path):
    box = {"x1": 0, "y1": 0, "x2": 1, "y2": 1, "description": "d", "marked_accepted": True}
    doc = {"gdata": [[{"url": "u", "dbidx": 7, "boxes": [box], "timing": [{"start_ms": 1000, "end_ms": 2500}]}, {"url": "v", "dbidx": 8, "boxes": None, "timing": [{"start_ms": 3000, "end_ms": 3100}]}]]}
    for name, body in (("a", json.dumps(doc)), ("b", "{ broken")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.json").write_text(body)
    s = tables.read_sessions(spark, str(tmp_path))
    assert s.count() == 2
    assert [(r.dbidx, r.description) for r in tables.accepted_boxes(s).collect()] == [(7, "d")]
    rows = logs.timeline(s.where("gdata is not null").select("session_path", "gdata")).orderBy("start_s").collect()
    assert [(r.i, r.j, r.accepted, r.total_accepted, r.total_seen) for r in rows] == [(-1, -1, False, 0, 0), (0, 0, True, 1, 1), (0, 1, False, 1, 2)]


def test_catalogue(spark, tmp_path):
    c = tables.Catalogue(spark, str(tmp_path))
    files = c.create("set", spark.createDataFrame([("b",), ("a",), ("a",)], "file_path string"))
    assert [(r.dbidx, r.file_path) for r in files.orderBy("dbidx").collect()] == [(0, "a"), (1, "b")]
    assert c.datasets() == ["set"]
    c.save("set", "subsets", "one", files.where("dbidx = 1"))
    assert c.items("set", "subsets") == ["one"] and c.load("set", "subsets", "one").count() == 1
    with pytest.raises(ValueError):
        c.files("../x")
    with pytest.raises(Exception, match="(?i)exist"):
        c.create("set", files)


def test_list_files(spark, tmp_path):
    for p in ("a/x.PNG", "a/b/y.jpg", "z.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"1")
    assert sorted(r.file_path for r in tables.list_files(spark, str(tmp_path)).collect()) == ["a/b/y.jpg", "a/x.PNG"]


def test_fits_descend_and_gradients_are_right():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((40, 6)), rng.standard_normal(6)
    q /= np.linalg.norm(q)
    y = (x[:, 0] > 0).astype(float)
    loss = feedback.logistic_loss(x, y, np.ones(40), q, 0.5)
    w = rng.standard_normal(6)
    for i in range(6):
        e = np.eye(6)[i] * 1e-6
        assert (loss(w + e)[0] - loss(w - e)[0]) / 2e-6 == pytest.approx(loss(w)[1][i], abs=1e-5)
    fit = feedback.logistic_refine(x, y, q)
    assert ((x - x.mean(axis=0)) @ fit > 0).astype(float).tolist().count(1.0) and np.corrcoef(x @ fit, y)[0, 1] > 0.6
    assert (feedback.logistic_refine(x, np.ones(40), q) == q).all()
    assert np.linalg.norm(feedback.multi_refine(x, y, np.ones(40), q)) == pytest.approx(1)


def test_expected_tosses_and_inversions():
    assert feedback.expected_tosses(1, np.array([0.5, 0.5, 0.5])) == pytest.approx(2)
    assert feedback.expected_tosses(2, np.array([0.5])) == float("inf")
    y, s = np.array([1, 0, 1, 0]), np.array([0.1, 0.9, 0.8, 0.2])
    brute = [sum(s[j] > s[i] for j in range(4) if y[j] == 0) if y[i] else -sum(s[j] < s[i] for j in range(4) if y[j] == 1) for i in range(4)]
    assert feedback.inversion_weights(y, s).tolist() == brute


def test_nonmyopic_step_prefers_the_informative_vertex():
    near = {0: [1, 2, 3], 1: [0], 2: [0], 3: [0], 4: []}

    def probability(labels):
        return np.array([(0.5 + sum(labels[n] for n in near[v] if n in labels)) / (1 + sum(n in labels for n in near[v])) for v in range(5)])

    assert feedback.nonmyopic_step(probability, {}, 4)[0] == 0


def test_simulated_sessions(spark, sf):
    from orrery import catalog

    t, truth = catalog.tiles(spark, sf), catalog.annotations(spark, sf)
    r = session.simulated(session.Session(t, catalog.embedding_of(spark, sf, 0), "random", batch=40), truth, 1, 5, 4)
    assert len(r["dbidxs"]) == len(set(r["dbidxs"])) and r["nfound"] >= min(5, r["ntotal"]) - 1
    with pytest.raises(ValueError):
        session.Session(t, [0.0], "unheard of")


def test_start_policies():
    assert feedback.may_refine("from_start", 0, 0, 0, False) and not feedback.may_refine("after_first_positive_and_negative", 3, 1, 0, False)
    assert all(feedback.may_refine(p, 1, 1, 1, True) for p in feedback.START_POLICIES)


def test_config_spaces():
    space = {"a": {"choose": [1, 2]}, "b": {"choose": [{"c": {"choose": [3, 4]}}, 5]}}
    assert session.space_size(space) == 6 and len(session.sampled_configs(space, 4)) == 4 and len(session.sampled_configs(space, 10)) == 6
    assert len(session.bench_configs(["x", "y"], lambda d: [1, 2], [{"m": 1}])) == 4


def test_bootstrap_interval_holds_the_statistic(spark):
    rows = spark.createDataFrame([("g", float(i)) for i in range(50)], "g string, v double")
    r = reports.bootstrap(rows, "v", ["g"], samples=300).first()
    wide = reports.bootstrap(rows, "v", ["g"], samples=300, tests=10).first()
    assert r.low < r.value < r.high and wide.high - wide.low >= r.high - r.low


def test_streaming_log(spark, tmp_path, sf):
    from orrery.streaming import log as stream

    spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    for name, make in (("w", stream.windowed_counts), ("s", stream.user_sessions), ("r", stream.record_events)):
        q = make(stream.read_log(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(f"q_{name}").option("checkpointLocation", str(tmp_path / name)).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert spark.table(f"q_{name}").count() > 0
    batch = logs.new_records(spark.read.parquet(str(tmp_path / "in")), "value")
    assert spark.table("q_r").count() == batch.count()


def test_assignment_is_the_cheapest():
    from itertools import permutations

    from orrery.operators.tracking import assignment

    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (3, 3), (2, 5), (5, 2), (4, 4), (0, 3)):
        cost = rng.integers(0, 9, (n, m)).astype(float)
        got = assignment(cost)
        assert len(got) == min(n, m) and len({j for _, j in got}) == len(got)
        if n and m:
            wide = cost if n <= m else cost.T
            assert sum(cost[i, j] for i, j in got) == min(sum(wide[i, p[i]] for i in range(len(wide))) for p in permutations(range(wide.shape[1]), len(wide)))


def test_tracks_follow_moving_boxes(spark):
    from orrery.operators.tracking import tracks

    rows = [(0, f, n, 10.0 * f + 100 * n, 0.0, 10.0 * f + 100 * n + 20, 20.0) for f in range(6) for n in range(2) if (f, n) != (3, 1)] + [(1, 0, 9, 0.0, 0.0, 1.0, 1.0)]
    p = tracks(spark.createDataFrame(rows, "video_id int, frame int, n int, x1 double, y1 double, x2 double, y2 double")).toPandas()
    assert p[p.video_id == 0].groupby("n").track_id.nunique().tolist() == [1, 1] and p[p.video_id == 0].track_id.nunique() == 2
    assert not p[(p.frame < 2)].confirmed.any() and p[(p.frame == 5)].confirmed.all()


def test_label_store(spark):
    from orrery.operators import labels

    box = (0.0, 0.0, 1.0, 1.0, "d", True)
    store = spark.createDataFrame([(1, None), (2, []), (3, [box])], labels.LABELS)
    assert {r.dbidx: r.y for r in labels.binary(store).collect()} == {2: 0, 3: 1}
    new = labels.updated(store, spark.createDataFrame([(2, [box]), (4, [])], labels.LABELS))
    assert sorted(r.dbidx for r in labels.seen(new).collect()) == [2, 3, 4]
    assert labels.box_rows(new).count() == 2 and labels.box_rows(new, "other").count() == 0
    assert {r.dbidx: r.a for r in store.select("dbidx", labels.accepted("boxes").alias("a")).collect()} == {1: False, 2: False, 3: True}


def test_batches(spark):
    from orrery.functions import batches

    df = spark.createDataFrame([(1, "a"), (2, None), (3, "a")], "k int, t string")
    assert batches.map_batches(df, lambda p, n: p.loc[p.index.repeat(n)], "k int, t string", n=2).count() == 6
    assert batches.map_with_state(df, lambda: lambda p: p.head(1), "k int, t string").count() >= 1
    assert [r.x for r in df.select(batches.by_row(str.upper, "string")("t").alias("x")).collect()] == ["A", None, "A"]
    assert [r.vector for r in batches.embedded(df, "t", lambda t: [len(t)]).orderBy("k").collect()] == [[1.0], None, [1.0]]
    assert batches.aggregated(df, ["t"], lambda p: p.head(1), "k int, t string").count() == 2


def test_split_keeps_groups_together(spark):
    from orrery.plans import models

    df = spark.range(2000).selectExpr("id", "id div 5 as g", "id % 2 as s")
    p = models.split_by_group(df, "g", "s").toPandas()
    assert p.groupby(["g", "s"]).train.nunique().max() == 1 and 0.4 < p.train.mean() < 0.6


def test_pyramid_of_small_and_large_images(spark):
    from orrery.functions import grid

    images = spark.createDataFrame([(1, 672, 896), (2, 100, 200)], "k int, w int, h int")
    levels = grid.pyramid(images, "k", "w", "h")
    assert sorted((r.k, r.zoom_level, r.scaled_width, r.scaled_height) for r in levels.collect()) == [(1, 0, 672, 896), (1, 1, 336, 448), (2, 0, 224, 448)]
    plain = grid.tiles_of(levels.where("k = 1 and zoom_level = 0"), "k")
    assert plain.where("x1 % 224 = 0 and y1 % 224 = 0").count() == 12


def test_random_crop_holds_its_box(spark):
    from orrery.functions import grid

    df = spark.range(200).selectExpr("id", "double(id % 70) as x1", "double(id % 70 + 20) as x2")
    a, b = grid.random_crop(F.col("x1"), F.col("x2"), F.lit(30.0), F.lit(100.0), 1, F.col("id"))
    assert df.where(~((a <= F.col("x1")) & (b >= F.col("x2")) & (a >= 0) & (b <= 100))).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 97])
def test_global_ranks_and_parts(spark, n):
    from orrery.operators import ranks

    df = spark.range(n).selectExpr("id", "id % 3 as v", "id % 2 as y")
    got = ranks.running(df, [F.desc("v"), F.asc("id")], {"r": F.lit(1).cast("long"), "s": F.col("y")}).collect()
    order = sorted(range(n), key=lambda i: (-(i % 3), i))
    assert {(r.id, r.r, r.s) for r in got} == {(i, k, sum(j % 2 for j in order[:k])) for k, i in enumerate(order)}
    sizes = [0] * 7
    for r in ranks.parts(df, 7, ["id"]).orderBy("id").collect():
        sizes[r.part] += 1
    assert sizes == [n // 7 + (k < n % 7) for k in range(7)]


@pytest.mark.parametrize("method", ["logistic", "rank", "multi", "knn_prop", "lknn", "active", "pseudo"])
def test_every_method_searches(spark, sf, method):
    from orrery import catalog
    from orrery.sources.shared import cut

    e = spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 150")
    t = catalog.tiles(spark, sf).where("vec_id < 150")
    edges = cut(graph.exact_knn(e, 4))
    s = session.Session(t, catalog.embedding_of(spark, sf, 0), method, batch=4, graph=edges)
    r = session.simulated(s, catalog.annotations(spark, sf), 1, 50, 3)
    assert r["nseen"] == 12 == len(set(r["dbidxs"])) and r["nfound"] == len(r["hit_indices"])


def test_graph_methods_need_a_graph(spark, sf):
    from orrery import catalog

    with pytest.raises(ValueError):
        session.Session(catalog.tiles(spark, sf), [0.0], "lknn")


def test_rank_fit_and_expected_cost():
    rng = np.random.default_rng(0)
    x, q = rng.standard_normal((40, 6)), rng.standard_normal(6)
    y = (x[:, 0] + 0.1 * x[:, 1] > 0).astype(int)
    w = feedback.rank_refine(x, y, q, 0.01)
    assert np.abs(feedback.inversion_weights(y, x @ w)).sum() < np.abs(feedback.inversion_weights(y, x @ q)).sum()
    assert (feedback.rank_refine(x, np.ones(40), q) == q).all()
    soft = feedback.soft_refine(x, y * 0.8 + 0.1, np.ones(40), q, 0.1)
    assert np.corrcoef(x @ soft, y)[0, 1] > 0.6
    assert feedback.expected_cost(1, np.array([1.0, 0.5]), 2) == 1 and feedback.expected_cost(0, np.array([0.1]), 3) == 0


def test_report_formats_and_saved_sessions(spark, tmp_path):
    assert [reports.brief(v) for v in (0.5, -0.25, 1.234, None, float("nan"))] == [".50", "-.25", "1.23", "-", "-"]
    assert (reports.times(2), reports.short_count(999), reports.short_count(1234567)) == ("2.0x", "999", "1.2M")
    s = spark.createDataFrame([(1, 0, "q")], "session_id int, qkey int, query_string string")
    for _ in range(2):
        tables.write_sessions(s, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 2
    left = reports.with_parameters(spark.createDataFrame([("a",), ("b",)], "param_hash string"), spark.createDataFrame([("a", 1)], "param_hash string, k int"))
    assert sorted((r.param_hash, r.k) for r in left.collect()) == [("a", 1), ("b", None)]
