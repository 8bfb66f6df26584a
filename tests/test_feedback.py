"""Losses against golden values and finite differences, look-ups against brute force, intervals, streams, guards."""

import datetime
import json

import numpy as np
import pytest

from orrery.functions import text
from orrery.operators import graph, products, search
from orrery.plans import feedback, reports, session
from orrery.sources import shared
from orrery.streaming import log as stream

# Golden values: (target, scores, margin, signed inversions, most inversions, rank loss, half the gradient); 0 stands for zeros.
PAIRS = [
    ([1], [0.5], 1.0, 0, [0], 0, [0]),
    ([0, 1], [0.1, 0.2], 0.0, 0, [1, 1], 0, [0, 0]),
    ([0, 1], [0.09, 0.2], 0.1, 0, [1, 1], 0, [0, 0]),
    ([2, 1], [0.2, 0.09], 0.1, 0, [1, 1], 0, [0, 0]),
    ([0, 1], [0.11, 0.2], 0.1, [[0, -1], [1, 0]], [1, 1], [[0, 0.01], [0.01, 0]], [1, -1]),
    ([0, 1], [0.1, 0.2], 0.1, [[0, -1], [1, 0]], [1, 1], 0, [1, -1]),
    ([0, 1], [0.2, 0.1], 0.0, [[0, -1], [1, 0]], [1, 1], [[0, 0.1], [0.1, 0]], [1, -1]),
    ([1, 0], [0.1, 0.2], 0.0, [[0, 1], [-1, 0]], [1, 1], [[0, 0.1], [0.1, 0]], [-1, 1]),
    ([0, 1], [0.2, 0.1], 0.11, [[0, -1], [1, 0]], [1, 1], [[0, 0.21], [0.21, 0]], [1, -1]),
    ([1, 1], [0.1, 0.2], 0.11, 0, [0, 0], 0, [0, 0]),
    ([2, 2], [0.2, 0.1], 0.11, 0, [0, 0], 0, [0, 0]),
    ([1, 2], [0.1, 0.1], 0.0, [[0, -1], [1, 0]], [1, 1], 0, [1, -1]),
    ([1, 2, 3], [0.3, 0.2, 0.1], 0.0, [[0, -1, -1], [1, 0, -1], [1, 1, 0]], [2, 2, 2], [[0, 0.1, 0.2], [0.1, 0, 0.1], [0.2, 0.1, 0]], [2, 0, -2]),
    ([0, 0, 1, 1], [0, 0.2, 0.1, 0.3], 0.0, [[0, 0, 0, 0], [0, 0, -1, 0], [0, 1, 0, 0], [0, 0, 0, 0]], [2, 2, 2, 2], [[0, 0, 0, 0], [0, 0, 0.1, 0], [0, 0.1, 0, 0], [0, 0, 0, 0]], [0, 1, -1, 0]),
    (
        [0, 1, 1, 1, 2], [0.4, 0.1, 0.2, 0.3, 0.0], 0.0, [[0, -1, -1, -1, -1], [1, 0, 0, 0, -1], [1, 0, 0, 0, -1], [1, 0, 0, 0, -1], [1, 1, 1, 1, 0]], [4, 2, 2, 2, 4],
        [[0, 0.3, 0.2, 0.1, 0.4], [0.3, 0, 0, 0, 0.1], [0.2, 0, 0, 0, 0.2], [0.1, 0, 0, 0, 0.3], [0.4, 0.1, 0.2, 0.3, 0]], [4, 0, 0, 0, -4],
    ),
    ([0, 1, 2], [0, 0, 0], 0.0, [[0, -1, -1], [1, 0, -1], [1, 1, 0]], [2, 2, 2], 0, [2, 0, -2]),
]


@pytest.mark.parametrize("case", PAIRS)
def test_pairwise_losses(case):
    target, scores, margin, inversions, most, loss, gradient = case
    n = len(target)
    full = lambda m: np.zeros((n, n)) if isinstance(m, int) else np.array(m, float)
    assert (feedback.signed_inversions(target, scores, margin) == full(inversions)).all()
    assert np.allclose(feedback.pairwise_rank_loss(target, scores, margin), full(loss))
    assert feedback.pairwise_rank_gradient(target, scores, margin).tolist() == [2.0 * g for g in gradient]
    assert feedback.most_inversions(target).tolist() == most
    if margin == 0:
        assert feedback.fast_rank_gradient(target, scores).tolist() == [2.0 * g for g in gradient]


def test_empty_pairs_and_many_ties():
    assert feedback.signed_inversions([], []).shape == (0, 0) and feedback.most_inversions([]).tolist() == [] == feedback.fast_rank_gradient([], []).tolist()
    rng = np.random.default_rng(0)
    for _ in range(50):
        t, s = rng.integers(0, 4, 30), rng.integers(0, 6, 30) / 7
        assert feedback.fast_rank_gradient(t, s).tolist() == feedback.pairwise_rank_gradient(t, s).tolist()
    s = np.array([0.3, -1.0])
    assert feedback.pairwise_logistic_loss([1, 0], s)[0, 1] == pytest.approx(np.log(1 + np.exp(-1.3))) and feedback.pairwise_logistic_loss([1, 1], s).sum() == 0


def slopes_are_right(loss, at, tolerance=1e-5):
    value, g = loss(at)
    assert np.isfinite(value)
    for i in range(len(at)):
        e = np.eye(len(at))[i] * 1e-6
        assert (loss(at + e)[0] - loss(at - e)[0]) / 2e-6 == pytest.approx(g[i], abs=tolerance)


def marks():
    rng = np.random.default_rng(3)
    x, q = rng.standard_normal((30, 5)), rng.standard_normal(5)
    y = (x[:, 0] + 0.3 * rng.standard_normal(30) > 0.5).astype(float)
    a = rng.standard_normal((5, 5))
    return rng, x, y, rng.integers(1, 4, 30), q, a @ a.T / 20


@pytest.mark.parametrize("how", [{}, {"positive_weight": "balanced"}, {"positive_weight": 3.0}, {"loss": "pairwise_logistic_loss"}, {"loss": "pairwise_rank_loss", "margin": 0.3}])
def test_multi_loss(how):
    rng, x, y, n, q, spread = marks()
    loss = feedback.multi_loss(x, y, n, q, spread, norm_weight=0.7, query_weight=1.3, data_weight=2.0, **how)
    slopes_are_right(loss, rng.standard_normal(5))
    w = feedback.multi_refine(x, y, n, q, spread, **how)
    assert np.linalg.norm(w) == pytest.approx(1)
    unit = q / np.linalg.norm(q)
    scores = (x - x.mean(axis=0)) @ w
    assert np.abs(feedback.inversion_weights(y, scores)).sum() < np.abs(feedback.inversion_weights(y, x @ unit)).sum()


@pytest.mark.parametrize("scale", [0.1, 1.0, 20.0, 1e4, 1e20])
def test_moments_stand_for_all_pairs(scale):
    rng = np.random.default_rng(4)
    a, b, w = rng.standard_normal((150, 5)) + 0.2, rng.standard_normal((170, 5)), scale * rng.standard_normal(5)
    gap = (a @ w)[:, None] - (b @ w)[None, :]
    pull = -np.exp(-np.logaddexp(0, gap))
    for value, g in (feedback.moment_pairs(feedback.score_moments(a, w), feedback.score_moments(b, w)), [v * gap.size for v in feedback.all_pairs(a, b)(w)]):
        assert value == pytest.approx(np.logaddexp(0, -gap).sum(), rel=1e-12)
        assert np.allclose(g, a.T @ pull.sum(axis=1) - b.T @ pull.sum(axis=0), rtol=1e-9, atol=1e-6)


@pytest.mark.parametrize("kind", ["array<double>", "array<float>"])
def test_rank_fit_over_a_table(spark, kind):
    rng, x, y, _, q, _ = marks()
    x = (4 * x).astype(np.float32).astype(float)
    rows = [(v.tolist(), int(k)) for v, k in zip(x, y, strict=True)]
    odd = [(None, 1), ([float("nan")] * 5, 0), ([1.0, None, 0.0, 0.0, 0.0], 1), ([float("inf")] * 5, 0), ([9.0] * 5, None), ([9.0] * 5, 2)]
    table = lambda r: spark.createDataFrame(r, f"embedding {kind}, y int").repartition(3)
    want = feedback.rank_refine(x, y, q, 0.01)
    assert not np.allclose(want, q / np.linalg.norm(q), atol=0.01)
    assert np.allclose(feedback.rank_fitted(table(rows + odd), q, 0.01), want, atol=1e-7)
    assert feedback.rank_fitted(table(rows * 2), q, 0.01) == pytest.approx(want, abs=1e-7)
    assert feedback.rank_fitted(table([r for r in rows if r[1]] + odd[1:2]), q).tolist() == q.tolist()
    assert feedback.rank_fitted(table(rows).limit(0), q).tolist() == q.tolist()
    assert feedback.rank_fitted(table(rows), 0 * q).tolist() == [0] * 5 == feedback.rank_refine(x, y, 0 * q).tolist()
    with pytest.raises(Exception, match="vectors must have 5 components"):
        feedback.rank_fitted(table([*rows, ([1.0] * 4, 1), ([1.0] * 6, 0)]), q)


def test_rank_query_needs_no_memory_for_pairs(spark, tmp_path):
    """4,000 marked rows of two labels: a number for each pair would be 32 MB."""
    import tracemalloc

    from orrery import catalog

    vector = "transform(sequence(0, 7), c -> float(sin((id + 1) * (c + 1)) + 0.3 * (id div 4 % 2)))"
    spark.range(16000).selectExpr("id as vec_id", f"{vector} as embedding", "int(id div 4 % 2) as label").write.parquet(f"{tmp_path}/embeddings.parquet")
    marked = spark.read.parquet(f"{tmp_path}/embeddings.parquet").where("vec_id % 4 = 0").orderBy("vec_id").collect()
    x, y = np.array([r.embedding for r in marked], float), np.array([r.label for r in marked])
    peaks = []
    for fit in (lambda: catalog.QUERIES["rank_refine"](spark, str(tmp_path)).collect(), lambda: feedback.rank_refine(x, y, x[0])):
        tracemalloc.start()
        found = fit()
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        if len(peaks) == 1:
            got = found
    scores = np.array(spark.read.parquet(f"{tmp_path}/embeddings.parquet").orderBy("vec_id").toPandas()["embedding"].tolist(), float) @ found
    assert [r.vec_id for r in got] == np.argsort(-scores, kind="stable")[:10].tolist() and [r.score for r in got] == pytest.approx(np.sort(scores)[::-1][:10], abs=2e-6)
    assert max(peaks) < 16e6, peaks


def test_multi_loss_edges():
    _, x, _, n, q, spread = marks()
    for kind in ("pairwise_rank_loss", "pairwise_logistic_loss"):
        assert feedback.label_loss(kind, np.ones(3), np.ones(3), np.ones(3))[0] == 0
    with pytest.raises(ValueError):
        feedback.label_loss("other", np.ones(3), np.ones(3), np.ones(3))
    nothing = feedback.multi_refine(np.zeros((0, 5)), [], [], q)
    assert np.allclose(nothing, q / np.linalg.norm(q), atol=1e-4)


def test_two_way_loss():
    rng, x, y, n, q, _ = marks()
    other = ((x[:, 1] > 0.8) & (y == 0)).astype(float)
    slopes_are_right(feedback.two_way_loss(x, y, other, n, q, 0.7, 1.3), rng.standard_normal(10))
    a, b = feedback.two_way_refine(x, y, other, n, q)
    z = (x - x.mean(axis=0)) @ np.stack([a, b]).T
    assert np.linalg.norm(a) == pytest.approx(1) == pytest.approx(np.linalg.norm(b))
    assert z[y == 1, 0].mean() > z[y == 0, 0].mean() and z[other == 1, 1].mean() > z[other == 0, 1].mean() and z[other == 1, 1].mean() > z[other == 1, 0].mean()
    only, against = feedback.two_way_refine(x, y, np.zeros(30), n, q)
    assert only @ against < 0.99 and np.isfinite(feedback.two_way_loss(np.zeros((0, 5)), [], [], [], q)(np.ones(10))[0])


def test_promises_equal_the_look_ahead_by_brute_force(spark):
    rng = np.random.default_rng(1)
    n = 24
    edges = [(u, int(v)) for u in range(n) for v in rng.choice([x for x in range(n) if x != u], 3, replace=False)] + [(u, 0) for u in range(1, n)]  # 0 is a hub
    edges = sorted({(u, v) for u, v in edges})
    prior = rng.uniform(0.05, 0.6, n)
    labels = {3: 1, 7: 0}

    def probability(given):
        return np.array([given[u] if u in given else (prior[u] + sum(given[v] for a, v in edges if a == u and v in given)) / (1 + sum(a == u and v in given for a, v in edges)) for u in range(n)])

    e = spark.createDataFrame([(u, v, 0.5, 1) for u, v in edges], "src_vertex long, dst_vertex long, distance double, dst_rank int")
    p = probability(labels)
    scores = spark.createDataFrame([(u, float(p[u])) for u in range(n) if u not in labels], "vec_id long, score double")
    known = spark.createDataFrame([(u,) for u in labels], "vec_id long")
    for horizon in (1, 2, 4):
        got = {r.vec_id: r.promise for r in graph.promises(e, scores, known, horizon).collect()}
        for v in got:
            best = lambda y: np.sort([x for u, x in enumerate(probability({**labels, v: y})) if u not in labels and u != v])[::-1][: horizon - 1].sum()  # noqa: B023, E731
            assert got[v] == pytest.approx(p[v] * (1 + best(1)) + (1 - p[v]) * best(0)), (horizon, v)
    step = feedback.nonmyopic_step(probability, labels, 4)
    assert step[0] == max(got, key=lambda v: (round(got[v], 12), -v)) and step[1] == pytest.approx(max(got.values()))


@pytest.mark.parametrize(("tile", "meetings"), [(7, 1), (7, 2), (2048, 64)])
def test_products_equal_brute_force(spark, monkeypatch, tile, meetings):
    monkeypatch.setattr(products, "TILE", tile)
    monkeypatch.setattr(products, "MEETINGS", meetings)
    rng = np.random.default_rng(2)
    x = rng.integers(-3, 4, (40, 5)).astype(float)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.where("vec_id % 4 = 1").selectExpr("vec_id as query_id", "embedding as vector")
    for found, asked in ((search.many_queries(v, q, 3), range(1, 40, 4)), (search.many_queries(v, v.selectExpr("vec_id as query_id", "embedding as vector"), 3), range(40))):
        got = {(r.query_id, r["rank"]): r.vec_id for r in found.collect()}
        want = {(i, k + 1): j for i in asked for k, j in enumerate([j for j in sorted(range(40), key=lambda j: (-(x[i] @ x[j]), j)) if j != i][:3])}
        assert got == want
    edges = graph.exact_knn(v.selectExpr("vec_id", "transform(embedding, e -> e / 20) as embedding"), 3).where("dst_rank > 0").collect()
    assert {(r.src_vertex, r.dst_rank): r.dst_vertex for r in edges} == want and search.many_queries(v, q.where("false"), 3).count() == 0


def test_sessions_with_confusion_and_propagation(spark, sf):
    from orrery import catalog

    t = catalog.tiles(spark, sf).where("vec_id < 150")
    s = session.Session(t, catalog.embedding_of(spark, sf, 0), "multi_neg", batch=4, options={"discount": True})
    r = session.simulated(s, catalog.annotations(spark, sf), 1, 50, 3, confused=2)
    assert r["nseen"] == 12 == len(set(r["dbidxs"])) and s._contrast is not None and any(s.confused.values())
    edges = shared.cut(graph.exact_knn(spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id < 150"), 4))
    p = session.Session(t, catalog.embedding_of(spark, sf, 0), "knn_prop", batch=2, graph=edges, scoring="level_max", start_policy="from_start")
    first = p.next()
    p.give(first[0], [(-1.0, -1.0, 1000.0, 1000.0)])
    prior = {r.vertex: r.score for r in p._vertex_scores().collect()}
    assert len(set(prior.values())) > 20 and max(prior.values()) < 1  # all labels are positive: nothing spreads yet
    p.give(first[1], [])
    spread = {r.vertex: r.score for r in p._vertex_scores().collect()}
    assert {spread[i] for i in spread if i // 5 == first[1]} == {0.0} and not set(p.next()) & set(first)


def test_pair_classes(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(None, nan), (nan, 1.0), (1.0, None), (inf, inf), (inf, 1.0), (1.0, inf), (1.0, 1.5), (3.0, 1.0), (1.0, 3.0), (inf, nan)]
    got = reports.pair_classes(spark.createDataFrame(rows, "x double, y double"), "x", "y", 0.5).collect()
    assert [r["class"] for r in got] == ["both_undefined", "first_undefined", "second_undefined", "both_infinite", "first_larger", "first_smaller", "close", "first_larger", "first_smaller", "second_undefined"]
    assert [(r.first_only_infinite, r.second_only_infinite) for r in got] == [(i in (4, 9), i == 5) for i in range(10)]


def test_bias_corrected_intervals():
    rng = np.random.default_rng(0)
    even, skewed = rng.standard_normal(400), rng.exponential(1, 60)
    for statistic in ("mean", "median"):
        low, high, value = reports.resampled(even, statistic, 2000, 0.05, 1, "bca")
        plain = reports.resampled(even, statistic, 2000, 0.05, 1, "percentile")
        assert low < value < high and low == pytest.approx(plain[0], abs=0.03) and high == pytest.approx(plain[1], abs=0.03)
    # Skewed to the right: the corrected interval lies farther right, and covers the mean about as often as it says.
    plain, shifted = (reports.resampled(skewed, "mean", 4000, 0.05, 1, m) for m in ("percentile", "bca"))
    assert shifted[0] > plain[0] and shifted[1] > plain[1]
    hits = sum(low < 1 < high for low, high, _ in (reports.resampled(rng.exponential(1, 40), "mean", 400, 0.1, i, "bca") for i in range(200)))
    assert 165 <= hits <= 195
    assert np.isnan(reports.resampled(np.ones(5), "mean", 100, 0.05, 0, "bca")[0]) and np.isnan(reports.resampled(np.zeros(0), "mean", 100, 0.05, 0, "bca")[2])


def test_bootstrap_in_slices_equals_itself(spark):
    rows = spark.createDataFrame([("a", float(i % 17)) for i in range(300)] + [("b", None)], "g string, v double")
    got = {r.g: r for r in reports.bootstrap(rows, "v", ["g"], "mean", 500, method="bca").collect()}
    assert got["a"].low < got["a"].value < got["a"].high and got["b"].value is None


def test_dataset_queries(spark):
    rows = [("objectnet", "bills (money)", "money bills"), ("objectnet", "coffee/french press", "coffee or french press"), ("objectnet", "binder  (closed)", "closed binder"), ("lvis", "cap_(headwear)", "cap headwear"), ("lvispatch", "a_b", "a b"), ("dota", "small-vehicle", "small vehicle"), ("bdd", "rider", "bike rider"), ("bdd", "car", "car"), ("coco", "mouse", "computer mouse"), ("lvis", "mouse", "mouse"), ("none", "a_b (c)", "a_b (c)")]
    got = spark.createDataFrame(rows, "d string, c string, want string").select(text.dataset_query("d", "c").alias("q"), "want").collect()
    assert [r.q for r in got] == [r.want for r in got]


def test_records_wait_for_late_events_and_users_are_forgotten(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    day = lambda d: datetime.datetime(2024, 1, d)
    batches = [[(1, at(10), 1, "a", 5.0, ""), (2, at(12), 1, "a", 4.0, "")], [(3, at(11), 1, "a", 7.0, ""), (4, at(13), 1, "a", 6.0, "")], [(5, day(3), 2, "a", 1.0, "")], [(6, day(6), 2, "a", 2.0, "")], [(7, day(9), 3, "a", 0.0, "")]]
    for rows in batches:
        spark.createDataFrame(rows, stream.EVENTS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        log = stream.read_log(spark, str(tmp_path / "in"))
        q = stream.record_events(log).writeStream.format("parquet").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = sorted((r.user_id, r.ts, r.value) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got[:2] == [(1, at(10), 5.0), (1, at(11), 7.0)] and all(u != 1 for u, _, _ in got[2:])
    assert [v for u, _, v in got if u == 2] == [1.0, 2.0]


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda name, default: default)})
        sparkContext = type("S", (), {"master": "yarn"})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())
    Session.conf = type("C", (), {"get": staticmethod(lambda name, default: "hdfs://x/y/")})
    assert shared.shared_dir(Session()) == "hdfs://x/y"


def test_entry_reports_missing_dependencies(monkeypatch):
    import builtins

    import __spark_entry__ as e

    real = builtins.__import__

    def without(name):
        def imported(n, *args, **kw):
            if n == name or (name == "orrery.llm" and n == "orrery.llm"):
                raise ModuleNotFoundError(f"No module named {name!r}", name=name)
            return real(n, *args, **kw)

        return imported

    monkeypatch.setattr(builtins, "__import__", without("corpus_pipeline"))
    assert e._llm() == ({}, {})

    def broken(n, *args, **kw):
        if n == "corpus_pipeline":
            raise ModuleNotFoundError("No module named 'xxhash'", name="xxhash")
        return real(n, *args, **kw)

    monkeypatch.setattr(builtins, "__import__", broken)
    with pytest.raises(ModuleNotFoundError, match="xxhash"):
        e._llm()
    assert json.dumps(sorted(e.catalog.SQL))


def test_amendments_in_order_of_time_and_a_stale_cache(spark, tmp_path):
    import time

    from orrery.sources import tables

    base, folder, cache = (str(tmp_path / n) for n in ("base", "reviews", "cache"))
    schema = "dbidx long, category string, x1 double"
    spark.createDataFrame([(1, "a", 0.0), (2, "a", 0.0), (2, "b", 0.0)], schema).write.parquet(base)

    def read(f):
        new = spark.read.schema(schema).parquet(f + "/boxes")
        return new, spark.read.schema("category string, dbidx long").parquet(f + "/seen")

    got = lambda: sorted((r.dbidx, r.category, r.x1, r.origin) for r in tables.consolidated(spark, base, folder, cache, read).collect())
    assert [r[3] for r in got()] == ["base"] * 3
    for name, value in (("z_first", 1.0), ("a_second", 2.0)):
        spark.createDataFrame([(2, "a", value)], schema).write.parquet(f"{folder}/{name}/boxes")
        spark.createDataFrame([("a", 2), ("b", 2)] if value == 1 else [("a", 2)], "category string, dbidx long").write.parquet(f"{folder}/{name}/seen")
        time.sleep(1.1)
        assert tables.folders_by_time(spark, folder)[-1].endswith(name)
        assert got() == [(1, "a", 0.0, "base"), (2, "a", value, name)]
    before = (tmp_path / "cache" / "_SUCCESS").stat().st_mtime_ns
    assert len(got()) == 2 and (tmp_path / "cache" / "_SUCCESS").stat().st_mtime_ns == before  # not made again


def test_index_by_its_constructor_and_named_settings(spark, tmp_path):
    from orrery.sources import tables

    (tmp_path / "info.json").write_text('{"constructor": "coarse"}')
    assert tables.load_index(spark, str(tmp_path), {"coarse": lambda s, path, k: (path, k)}, k=3) == (str(tmp_path), 3)
    with pytest.raises(ValueError):
        tables.load_index(spark, str(tmp_path), {})
    text_ = "shared_session_params: {batch_size: 1, k: 5}\nvariants:\n- {name: a, method: plain}\n- {name: b, method: multi, k: {choose: [10]}}\n- {name: {choose: [c, d]}}\n"
    assert session.named_setting(text_, "b") == {"batch_size": 1, "k": 10, "name": "b", "method": "multi"} and session.named_setting(text_, "d")["batch_size"] == 1
    for wrong in ("none", "x"):
        with pytest.raises(ValueError):
            session.named_setting(text_, wrong)
