"""Near-duplicate and nearest vectors against brute force."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.llm import ann, neardup

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rep long"


def brute_links(rows, threshold=0.93):
    ok = {i: np.array(v, float) for i, v, _ in rows if v is not None and None not in v and np.isfinite(v).all() and np.any(v)}
    lab = {i: y for i, _, y in rows}
    cos = lambda a, b: float(ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]))
    near = {i: [j for j in ok if j != i and i in ok and lab[i] == lab[j] and lab[i] is not None and len(ok[i]) == len(ok[j]) and cos(i, j) >= threshold] for i in lab}
    comp = {i: i for i in lab}
    while any(comp[j] < comp[i] for i in lab for j in near[i]):
        comp = {i: min([comp[i], *(comp[j] for j in near[i])]) for i in lab}
    return {i: (len(near[i]), comp[i], comp[i] == i) for i in lab}


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], y, 0.5, 7) for i, v, y in rows], SCHEMA)


def test_near_duplicates_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)
    rng = np.random.default_rng(0)
    rows = []
    for c in range(12):
        centre = rng.standard_normal(16)
        rows += [(len(rows) + k, (centre + rng.standard_normal(16) * s).tolist(), c % 3) for k, s in enumerate((0, 0, 0.1, 0.25, 0.3, 0.35))]
    rows += [(100, None, 1), (101, [0.0] * 16, 1), (102, [float("nan")] + [1.0] * 15, 1), (103, [None] + [1.0] * 15, 1), (104, rows[0][1], None), (105, rows[0][1][:8], 0), (106, [float("inf")] * 16, 0), (107, rows[0][1], 0)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    exact = {i: [float(np.float32(x)) if x is not None else None for x in v] if v else v for i, v, _ in rows}
    assert got == brute_links([(i, exact[i], y) for i, _, y in rows])


def test_no_vectors(spark):
    empty = frame(spark, [(1, [1.0], 1)]).where("false")
    assert neardup.near_duplicates(empty).count() == 0
    assert ann.search(ann.build_index(empty), empty).count() == 0


def test_null_keys_and_repeats(spark):
    rows = spark.createDataFrame([(None, [1.0, 0.0], 1), (5, [1.0, 0.0], 1), (5, [1.0, 0.0], 1)], "vec_id long, embedding array<double>, label int")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(rows).collect()), key=str)
    assert got == [(5, 1, 5, True), (5, 1, 5, True), (None, 0, None, False)]


@settings(deadline=None, max_examples=40)
@given(st.integers(0, 2**32 - 1), st.integers(2, 70), st.floats(-0.95, 0.99))
def test_bounds_never_miss_a_pair_and_are_sure_of_none_below(seed, dim, threshold):
    rng = np.random.default_rng(seed)
    x = neardup.unit_rows(rng.standard_normal((30, dim)) * 10.0 ** rng.integers(-150, 150, (30, 1)))
    y = neardup.unit_rows(x[:20] + rng.standard_normal((20, dim)) * 0.1)
    i, j, sure = neardup.tile_bounds(neardup.quantised(x), neardup.quantised(y), threshold)
    near = set(zip(*(k.tolist() for k in np.nonzero(np.einsum("ij,kj->ik", x, y) >= threshold)), strict=True))
    assert near <= set(zip(i.tolist(), j.tolist(), strict=True)) and set(zip(i[sure].tolist(), j[sure].tolist(), strict=True)) <= near


@pytest.mark.parametrize(("pack", "meetings"), [(1, 1), (2, 2), (3, 64)])
def test_every_two_packs_meet_once(spark, monkeypatch, pack, meetings):
    monkeypatch.setattr(neardup, "TILE", 4)
    monkeypatch.setattr(neardup, "PACK", pack)
    monkeypatch.setattr(neardup, "MEETINGS", meetings)
    rng = np.random.default_rng(2)
    rows = [(i, (np.ones(8) + rng.standard_normal(8) * 0.28).tolist(), i % 7 // 4) for i in range(60)]  # all pairs of a label around the threshold
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute_links([(i, np.float32(v).tolist(), y) for i, v, y in rows]) and len({n for n, _, _ in got.values()}) > 3


def test_double_precision_crosses_only_where_in_doubt(spark, monkeypatch):
    """No plan between the codes' tables and their products carries units."""
    seen = []
    real = neardup.cut
    monkeypatch.setattr(neardup, "cut", lambda df: seen.append(df) or real(df))
    neardup.near_duplicates(frame(spark, [(i, [1.0, 0.1 * i], 0) for i in range(20)])).count()
    products = next(df for df in seen if "doubt" in df.columns)
    plan = products._jdf.queryExecution().optimizedPlan().toString()
    assert "codes" in plan and "units" not in plan


def test_keys_of_other_types_than_long(spark):
    rows = spark.createDataFrame([(3, [1.0, 0.0], "a"), (4, [1.0, 0.01], "a"), (5, [0.0, 1.0], None)], "vec_id int, embedding array<double>, label string")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(rows).collect())
    assert got == [(3, 1, 3, True), (4, 1, 3, False), (5, 0, 5, True)]


def brute_nearest(rows, queries, k=5):
    """{query: [(key, score)]}: all candidates by double-precision cosine, ties to the smaller key."""
    keys = np.array([i for i, _ in rows])
    x = neardup.unit_rows(np.array([v for _, v in rows], float)) + 0.0
    out = {}
    for q in queries:
        s = np.einsum("ij,ij->i", np.broadcast_to(x[keys == q][0], x.shape), x)
        out[q] = [(int(keys[i]), s[i]) for i in np.lexsort((keys, -s)) if keys[i] != q][:k]
    return out


def held_against_brute_force(got, rows, queries, k=5):
    """Recall; scores must be exact and in order, ranks gapless."""
    best, hits, total = brute_nearest(rows, queries, k), 0, 0
    every = {q: dict(brute_nearest(rows, [q], len(rows))[q]) for q in queries}
    for q in queries:
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(best[q]) + 1)) and q not in {r.vec_id for r in mine}
        assert all(abs(r.score - every[q][r.vec_id]) < 1e-12 for r in mine)
        assert [(r.vec_id) for r in mine] == [r.vec_id for r in sorted(mine, key=lambda r: (-r.score, r.vec_id))]
        hits, total = hits + len({r.vec_id for r in mine} & {i for i, _ in best[q]}), total + len(best[q])
    return hits / total


def table(spark, folder):
    v = spark.read.parquet(f"{folder}/embeddings.parquet")
    return v, [(r.vec_id, r.embedding) for r in v.collect()]


def test_recall_of_the_registered_query_at_its_settings(spark):
    v, rows = table(spark, "/root/testdata/sf0.1")
    got = ann.op3_nearest_neighbours(spark, "/root/testdata/sf0.1").collect()
    assert held_against_brute_force(got, rows, [i for i, _ in rows if i % 50 == 0]) >= 0.9


@pytest.mark.parametrize(("block", "run", "wide", "queries"), [(64, 2, 100, 4), (128, 1, 10_000, 64)])
def test_recall_over_many_blocks_runs_and_ranges(spark, sf, monkeypatch, block, run, wide, queries):
    for name, value in (("BLOCK", block), ("RUN", run), ("RANGE", wide), ("QUERIES", queries)):
        monkeypatch.setattr(ann, name, value)
    v, rows = table(spark, sf)
    asked = v.where("vec_id % 20 = 0")
    got = ann.search(ann.build_index(v), asked).collect()
    assert held_against_brute_force(got, rows, [i for i, _ in rows if i % 20 == 0]) >= 0.9


def test_little_is_scored_where_vectors_cluster(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((60, 32))
    rows = [(i, (centres[i % 60] + 0.1 * rng.standard_normal(32)).tolist()) for i in range(3000)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(ann.build_index(v), v.where("vec_id % 100 = 0")).collect()
    assert held_against_brute_force(got, rows, range(0, 3000, 100)) >= 0.9
    assert np.mean([r.scored for r in got]) < 0.2 * len(rows)


def test_more_neighbours_than_a_default_index_names(spark):
    rows = [(i, [1.0, float(i % 7)], 0) for i in range(30)]
    v = frame(spark, rows)
    with pytest.raises(ValueError):
        ann.search(ann.build_index(v), v, k=9)
    got = ann.search(ann.build_index(v, ids=10), v.where("vec_id in (0, 3)"), k=9).collect()
    assert held_against_brute_force(got, [(i, x) for i, x, _ in rows], [0, 3], 9) == 1


def test_copies_ties_and_few_candidates(spark):
    rows = [(i, [1.0, 0.0], 0) for i in range(40)] + [(90, [0.0, 1.0], 0), (91, [0.0, 0.0], 0), (92, None, 0)]
    v = frame(spark, rows)
    got = ann.search(ann.build_index(v), v.where("vec_id in (0, 50, 90, 92)")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, k, k) for k in range(1, 6)] + [(90, k, k - 1) for k in range(1, 6)]
    few = frame(spark, rows[:3])
    assert ann.search(ann.build_index(few), few.where("vec_id = 0")).count() == 2


def test_ties_between_vectors_of_different_length(spark):
    """Sixty parallel vectors, all with cosine one: the smallest ids win."""
    rng = np.random.default_rng(0)
    base = rng.integers(-9, 9, 16)
    rows = [(i, (base * (1 + (i * 37) % 60)).tolist(), 0) for i in range(60)]
    v = frame(spark, rows).unionByName(frame(spark, [(100 + i, rng.standard_normal(16).tolist(), 0) for i in range(50)]))
    got = ann.search(ann.build_index(v), v.where("vec_id in (0, 50)")).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got] == [1, 2, 3, 4, 5, 0, 1, 2, 3, 4] and {r.score for r in got} == {got[0].score}


def test_mirrored_vectors_tie_by_key(spark):
    rows = [(i, [1.0, (-1.0) ** i * 0.5, 0.0], 0) for i in range(2)] + [(7, [1.0, 0.0, 0.5], 0), (6, [1.0, 0.0, -0.5], 0), (50, [1.0, 0.0, 0.0], 0)]
    v = frame(spark, rows)
    got = ann.search(ann.build_index(v), v.where("vec_id = 50")).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 6, 7]


def test_index_of_repeated_rows_null_keys_and_clashing_columns(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], 3, "x"), (1, [1.0, 0.0], 3, "x"), (None, [1.0, 0.0], 3, "x"), (2, [float("nan"), 1.0], 3, "x"), (0, [0.5, 0.5], 3, "x")], "vec_id long, embedding array<double>, rank int, keys string")
    got = ann.search(ann.build_index(rows), rows).orderBy("query_id").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (1, 1, 0)]


@pytest.mark.parametrize("edges", [[], [(3, 1)], [(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 60)], [(5, 4), (4, 3), (9, 8), (8, 9), (3, 5)]])
def test_components(spark, edges):
    from orrery.llm.common import components

    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {n: n for e in edges for n in e}
    while any(want[a] != want[b] for a, b in edges):
        for a, b in edges:
            want[a] = want[b] = min(want[a], want[b])
    assert got == want
