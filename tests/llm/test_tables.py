"""Sharding, mixing and URL filters against SQL and by their laws; the pipeline against its stages' laws."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import mixing, registry, sharding, urls
from tests.conftest import DATA, duck, rows_of


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, name):
    assert rows_of(registry.QUERIES[name](spark, DATA).toPandas()) == rows_of(duck(DATA).sql(registry.SQL[name]).df())


def test_ten_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))


# --- sharding ---


@settings(deadline=None, max_examples=30)
@given(st.lists(st.integers(-(2**63), 2**63 - 1), min_size=1, max_size=200), st.integers(1, 60))
def test_jump_moves_rows_only_into_the_new_shard(keys, n):
    z = sharding.mixed(np.array(keys, np.int64))
    a, b = sharding.jump(z, n), sharding.jump(z, n + 1)
    assert ((a == b) | (b == n)).all() and a.min() >= 0 and a.max() < n


def test_shards_are_even():
    counts = np.bincount(sharding.jump(sharding.mixed(np.arange(48_000)), 24), minlength=24)
    assert counts.min() > 1800 and counts.max() < 2200


def test_slots_are_gapless_and_edges(spark):
    rows = [(i, "t" * (i % 5), 9, 9) for i in range(300)] + [(None, None, 9, 9), (7, "same", 9, 9), (7, "same", 9, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int, slot int")
    p = sharding.shard_rows(docs, 5, chunks=4).toPandas()
    assert len(p) == len(rows) and all(sorted(g.slot) == list(range(len(g))) for _, g in p.groupby("shard"))
    assert p[p.doc_id.isna()]["size"].tolist() == [8] and p[p.doc_id == 7].shard.nunique() == 1
    assert sharding.shard_rows(docs.where("false"), 5).count() == 0
    assert sharding.shard_rows(docs.selectExpr("cast(doc_id as string) as doc_id", "text"), 5).count() == len(rows)


def test_slots_where_keys_and_texts_repeat(spark):
    """A third null keys, a third one key, a third one text; some of each wholly alike."""
    rows = [(None, f"t{i % 50}") for i in range(300)] + [(5, f"u{i % 70}") for i in range(300)] + [(1000 + i, "same") for i in range(300)] + [(None, None)] * 40 + [(5, "x" * 3_000_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    p = sharding.shard_rows(docs, 4, chunks=4).toPandas()
    assert len(p) == len(rows) and all(sorted(g.slot) == list(range(len(g))) for _, g in p.groupby("shard"))
    assert p[p.doc_id == 5].shard.nunique() == 1 == p[p.doc_id.isna()].shard.nunique() and p["size"].max() == 3_000_008
    assert sharding.shard_rows(docs.repartition(9), 4, chunks=4).toPandas().sort_values(["shard", "slot"]).reset_index(drop=True).equals(p.sort_values(["shard", "slot"]).reset_index(drop=True))


def test_copies(spark):
    from orrery.llm.common import copies

    got = copies(spark.createDataFrame([("a", 1), ("b", 7), ("c", 4)], "k string, n long"), "n", "i", 3).collect()
    assert sorted((r.k, r.i) for r in got) == [("a", 0)] + [("b", i) for i in range(7)] + [("c", i) for i in range(4)]


# --- mixing ---


def brute_quotas(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats if sum(votes) else 0):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


@pytest.mark.parametrize(("votes", "seats"), [([5.0, 3.0, 1.0], 9), ([1.0, 1.0, 1.0], 2), ([0.0, 4.0], 3), ([1000.0, 1.0, 1.0, 1.0], 50), ([7.5] * 11, 25), ([3.0], 7), ([2.0, 1.0], 0)])
def test_apportion_is_the_highest_quotients(spark, votes, seats):
    df = spark.createDataFrame([(0, i, v, seats) for i, v in enumerate(votes)], "g int, k int, v double, s long")
    got = [r.q for r in mixing.apportion(df, ["g"], ["k"], "v", "s", "q").orderBy("k").collect()]
    assert got == brute_quotas(votes, seats)


def brute_targets(sizes):
    total, w = sum(sizes), [i % 3 + 1 for i in range(len(sizes))]
    full = set()
    while True:
        rest, share = total - sum(3 * sizes[i] for i in full), sum(w[i] for i in range(len(w)) if i not in full)
        over = {i for i in range(len(w)) if i not in full and w[i] * rest / max(share, 1) > 3 * sizes[i]}
        if not over:
            return [3 * sizes[i] if i in full else w[i] * rest / max(share, 1) for i in range(len(w))]
        full |= over


@pytest.mark.parametrize("sizes", [[100, 10, 400], [1, 1, 1, 1000], [5], [0, 0], [0, 7, 3], [10**6, 1, 2, 3, 10**6, 5]])
def test_targets_fill_up_to_their_caps(spark, sizes):
    df = spark.createDataFrame([(False, chr(97 + i), s) for i, s in enumerate(sizes)], "src_null boolean, src string, source_size long")
    got = [r.target for r in mixing.targets(df).orderBy("src").collect()]
    assert got == pytest.approx(brute_targets(sizes))


def mixed(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, target int, carried string")


def test_mix_comes_near_its_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (i % 37), ["a", "b", None][i % 3] if i % 5 else "hot", 1, 2, "x") for i in range(2000)] + [(None, None, "a", 1, 2, "x"), (3, "same words", "b", 1, 2, "x"), (3, "same words", "b", 1, 2, "x")]
    p = mixing.mix(mixed(spark, rows)).toPandas()
    assert len(p) == len(rows) and (p.taken <= 3 * p["size"]).all()
    for _, g in p.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= mixing.BLOCK * (mixing.SHARDS + 1) and g["size"].sum() == g.source_size.iloc[0]
    again = mixing.mix(mixed(spark, rows[::-1]).repartition(7)).toPandas()
    key = ["doc_id", "size", "taken"]
    assert p[key].sort_values(key).reset_index(drop=True).equals(again[key].sort_values(key).reset_index(drop=True))
    assert mixing.mix(mixed(spark, rows).where("false")).count() == 0


def test_mixed_documents_have_the_words_taken(spark):
    rows = [(i, " ".join(f"d{i}_{k}" for k in range(i % 23 + 1)), "ab"[i % 2], 1, 2, "x") for i in range(200)] + [(500, "twin words here", "a", 1, 2, "x")] * 2
    docs = mixed(spark, rows)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
    words = {}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        words.setdefault(r.doc_id, []).extend(r.text.split())
    assert {k: len(v) for k, v in words.items()} == {k: v for k, v in taken.items() if v}
    for i, got in words.items():
        own = set(next(t for d, t, *_ in rows if d == i).split())
        assert set(got) <= own and max(got.count(w) for w in own) <= 6


def test_mix_where_keys_and_rows_repeat(spark):
    rows = [(None, f"null key {i % 40}", "a", 1, 2, "x") for i in range(200)] + [(7, "one and the same row", "b", 1, 2, f"c{i % 3}") for i in range(200)] + [(i, "w " * 30, "c", 1, 2, "x") for i in range(100)] + [(9, "long " * 400_000, "d", 1, 2, "x")]
    docs = mixed(spark, rows)
    p = mixing.mix(docs).toPandas()
    assert len(p) == len(rows) and (p.taken <= 3 * p["size"]).all() and p["size"].max() == 400_000
    for _, g in p.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= mixing.BLOCK * (mixing.SHARDS + 1)
    out = mixing.mixed_documents(docs).toPandas()
    words = out.text.str.split().str.len().groupby(out.source).sum()
    assert words.to_dict() == {k: v for k, v in p.groupby("source").taken.sum().to_dict().items() if v}
    again = mixing.mixed_documents(docs.repartition(5)).toPandas()
    by = ["doc_id", "text", "source", "carried"]
    assert out[by].sort_values(by).reset_index(drop=True).equals(again[by].sort_values(by).reset_index(drop=True))


# --- URL filters ---


def brute_verdict(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    n = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:n])
    m = next((i for i, c in enumerate(rest[n:]) if c in "?#"), len(rest) - n)
    path = rest[n:][:m]
    fit = [(len(h + p), len(h), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("limit", [urls.BROADCAST_RULES, 0])
def test_verdicts_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
    rules = [*urls.RULES, ("allow", "net", "/"), ("block", "a.b.c", ""), ("allow", "b.c", "/p"), ("block", "x", "/é")]
    given_ = [None, "", "no scheme", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://example.net/en/1", "http://www.example.net/en", "https://example.com/de/?q", "http://exampleXnet/", "http://z.org/fr/a#f", "http://a.b.c", "http://q.a.b.c/p/1", "http://b.c/px", "http://..net/", "http://x/éa", "http://" + "a." * 3000 + "net/" + "p" * 9000, "ftp://u:p@net:80/a", "a://b://net/"]
    rows = [(i if i % 7 else None, u, "clash") for i, u in enumerate(given_ + given_[5:9])]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    got = urls.url_verdicts(pages, urls.rules_frame(spark, rules)).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, *brute_verdict(u, rules)) for i, u, _ in rows), key=str)
    assert urls.url_verdicts(pages.where("false"), urls.rules_frame(spark, rules)).count() == 0
    none = urls.url_verdicts(pages, urls.rules_frame(spark, rules).where("false"))
    assert {(r.rule, r.verdict) for r in none.collect()} == {(None, "allow")}


def test_half_of_all_pages_without_a_url_may_be_split(spark):
    pages = spark.range(4000).selectExpr("id as page_id", "if(id % 2 = 0, null, concat('http://h', id, '.net/x')) as url")
    judged = urls.url_verdicts(pages, urls.rules_frame(spark, urls.RULES))
    plan = judged._jdf.queryExecution().optimizedPlan().toString()
    assert "Relation" in plan.split("LeftOuter", 1)[1] and {(r.rule, r.verdict, r.n) for r in judged.groupBy("rule", "verdict").agg(F.count("*").alias("n")).collect()} == {(None, "allow", 2000), ("net/", "block", 2000)}


# --- pipeline ---


def test_pipeline_of_an_empty_table_and_of_edges(spark, tmp_path):
    import corpus_pipeline as p

    schema = spark.read.parquet(f"{DATA}/documents.parquet").schema
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert p.run(spark, str(tmp_path / "none")).count() == 0
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "", None, None, 0), (None, "the of and to " * 40_000, None, None, 5), (7, "Das ist der Text und die Sache", "de", None, None), (7, "Das ist der Text und die Sache", "de", None, None)], schema)
    rows = docs.unionByName(odd)
    for _, stage in p.STAGES[:-1]:
        names = rows.columns
        rows = spark.createDataFrame(stage(spark, rows, DATA).collect(), schema)
        assert rows.columns == names and rows.count() > 0
    assert p.STAGES[-1][1](spark, rows, DATA).count() >= rows.count()


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12345 !!", None, "src0", 8), (10**6 + 1, None, None, None, None), (10**6 + 2, "Write to anna.b@site.com about the thing and that of it", "en", "src0", 10)], docs.schema)
    docs = docs.unionByName(extra)
    columns = docs.columns
    before = {r.doc_id: r.text for r in docs.collect()}
    languages = p.STAGES[0][1](spark, docs, DATA)
    kept = {r.doc_id for r in languages.collect()}
    assert languages.columns == columns and before.keys() - kept == {i for i, t in before.items() if not t or not any(c.isalpha() for c in t)}
    once = p.STAGES[1][1](spark, languages, DATA)
    from orrery.llm.simhash import simhash_components

    groups = {r.doc_id: r.component_id for r in simhash_components(languages).collect()}
    assert once.columns == columns and sorted(r.doc_id for r in once.collect()) == sorted(set(groups.values()))
    clean = p.STAGES[2][1](spark, once, DATA)
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert clean.columns == columns and texts.keys() == set(groups.values()) and "anna.b@site.com" not in texts[10**6 + 2]
    mix = p.STAGES[3][1](spark, clean, DATA)
    assert mix.columns == columns and all(set(r.text.split()) <= set(texts[r.doc_id].split()) and r.n_chars == len(r.text) for r in mix.collect())
    packed = p.STAGES[4][1](spark, mix, DATA).toPandas()
    assert (packed["start"] == 0).sum() == mix.count() and packed.groupby("sequence_id")["length"].sum().max() <= 2048
    assert p.run(spark, DATA).count() > 0
