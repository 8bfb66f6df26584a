"""Golden values of column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from orrery.functions import boxes, metrics, text, vectors


def one(spark, *cols, **values):
    row = spark.range(1).select(*[F.expr(v).alias(k) for k, v in values.items()] or [F.lit(0).alias("_")])
    return row.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


@pytest.mark.parametrize(("hits", "n", "expected"), [("array(0,1,2)", 3, 1.0), ("cast(array() as array<int>)", 3, 0.0), ("array(0,1,2)", 10, 0.3), ("array(1,2,3)", 3, (1 / 2 + 2 / 3 + 3 / 4) / 3), ("array(2,0,1)", 3, 1.0)])
def test_average_precision(spark, hits, n, expected):
    assert one(spark, metrics.average_precision("h", "n"), h=hits, n=str(n))[0] == pytest.approx(expected)


def test_ndcg_and_dcg(spark):
    r = one(spark, metrics.ndcg("h", "n", "s"), metrics.ndcg("e", "n", "s"), metrics.dcg("z"), metrics.ndcg("h", "zero", "s"), h="array(0,1,2)", e="cast(array() as array<int>)", z="array(0)", n="3", s="10", zero="0")
    assert list(r) == [1.0, 0.0, 1.0, 0.0]


@pytest.mark.parametrize(("hits", "total", "k", "expected"), [("array(0)", 1, 1, 1), ("cast(array() as array<int>)", 1, 1, math.inf), ("array(0)", 2, 2, math.inf), ("array(1,2,3)", 3, 2, 3), ("array(1)", 1, 2, math.nan)])
def test_rank_of_kth(spark, hits, total, k, expected):
    got = one(spark, metrics.rank_of_kth("h", "n", k), h=hits, n=str(total))[0]
    assert got == expected or math.isnan(got) and math.isnan(expected)


def test_reciprocal_and_direction(spark):
    r = one(spark, metrics.reciprocal(F.col("a")), metrics.reciprocal(F.col("b")), metrics.reciprocal(F.col("c")), a="double('infinity')", b="4D", c="double('nan')")
    assert list(r) == [0.0, 0.25, None]
    assert metrics.higher_is_better("ndcg_score") and not metrics.higher_is_better("rank_first")
    with pytest.raises(ValueError):
        metrics.higher_is_better("speed")


@pytest.mark.parametrize(("b", "iou", "cont"), [((10, 10, 30, 30), 0.25, 1.0), ((20, 20, 30, 30), 0.0, 0.0), ((10, 10, 10, 20), 0.0, 0.0)])
def test_iou(spark, b, iou, cont):
    make = lambda v, n: spark.createDataFrame([tuple(map(float, v))], "x1 double, y1 double, x2 double, y2 double").alias(n)
    r = make((10, 10, 20, 20), "a").crossJoin(make(b, "b")).select(boxes.iou("a", "b"), boxes.containment("a", "b"), boxes.overlaps("a", "b")).first()
    assert (r[0], r[1]) == (iou, cont) and r[2] == (iou > 0)


@pytest.mark.parametrize(("box", "size", "side", "expected"), [((10, 10, 20, 30), (100, 50), 0, (5, 10, 25, 30)), ((10, 10, 30, 20), (50, 100), 0, (10, 5, 30, 25)), ((0, 0, 10, 10), (100, 50), 1000, (0, 0, 50, 50)), ((90, 10, 100, 40), (100, 50), 0, (70, 10, 100, 40))])
def test_square_box(spark, box, size, side, expected):
    row = spark.createDataFrame([(*map(float, box), *size)], "x1 double, y1 double, x2 double, y2 double, im_width int, im_height int")
    assert tuple(row.select(*boxes.square_box(side)).first()) == tuple(map(float, expected))


@pytest.mark.parametrize(("a", "b", "expected"), [((0, 10), (5, 15), (5, 10, 5)), ((0, 20), (5, 15), (5, 15, 10)), ((0, 5), (10, 15), (10, 5, 0))])
def test_segments(spark, a, b, expected):
    got = one(spark, *boxes.segment_overlap(*[F.lit(float(v)) for v in (*a, *b)]))
    assert tuple(got) == tuple(map(float, expected))


def test_vectors(spark):
    r = one(spark, vectors.dot("v", "w"), vectors.norm("v"), vectors.normalized("v"), vectors.dot("v", "n"), vectors.normalized("z", 1e-6), vectors.linear((2, "v"), (-1, "w")), vectors.squared_distance("v", "w"), v="array(3D, 4D)", w="array(1D, 0D)", n="cast(null as array<double>)", z="array(0D, 0D)")
    assert list(r) == [3.0, 5.0, [0.6, 0.8], None, [0.0, 0.0], [5.0, 8.0], 20.0]


def test_names_and_paths(spark):
    r = one(spark, text.category_text("a"), text.category_text("b"), text.query_text("c"), text.extension("p"), text.is_image("p"), text.is_image("q"), text.clean_path("u"), a="'bat_(animal)'", b="'tv/monitor'", c="'ping-pong_ball'", p="'x/y.JPG'", q="'x/y'", u="'a//b/./c/'")
    assert list(r) == ["animal bat", "tv or monitor", "a ping pong ball", "jpg", True, False, "a/b/c"]


def test_parameter_hash_ignores_order_and_dropped_keys():
    assert text.canonical_hash('{"a": 1, "b": 2, "index_spec": 5}') == text.canonical_hash('{"b": 2, "a": 1, "annotation_category": null}')
    assert text.canonical_hash("{") is None and text.canonical_hash(None) is None
