"""Mixing sources to target weights: Sainte-Laguë quotas of equal blocks, then seeded block selection. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, before, copies, cut

#: Most times a document may be taken, words a block, and shards that quotas are given for.
REPEATS, BLOCK, SHARDS = 3, 16, 8
#: Leading hexadecimal digits of a document's seeded hash that make its chunk: 16 ** 3 chunks a source.
CHUNK_DIGITS = 3


def apportion(votes: DataFrame, group: list[str], key: list[str], by: str, seats: str, out: str) -> DataFrame:
    """Sainte-Laguë: within each ``group``, ``seats`` go to the rows with the highest quotients votes / (2 s - 1), ties by ``key``.

    ``votes`` has a row for each (group, key). With V votes and n rows, the final divisor d satisfies K - n/2 <= V/d <= K + n/2,
    so each row's seats are known but for about 1 + n v / V of them; only those quotients are made and ranked, 3 n in all.
    """
    all_of = Window.partitionBy(*group)
    v = votes.select(*group, *key, F.col(by).cast("double").alias("_v"), F.col(seats).cast("long").alias("_k"))
    v = v.withColumn("_votes", F.sum("_v").over(all_of)).withColumn("_n", F.count("_v").over(all_of))
    sure = F.greatest(F.lit(0), F.floor(F.col("_v") / F.col("_votes") * (F.col("_k") - F.col("_n") / 2) + 0.5) - 1)
    most = F.floor(F.col("_v") / F.col("_votes") * (F.col("_k") + F.col("_n") / 2) + 0.5) + 1
    v = v.where("_v > 0 and _k > 0").withColumn("_sure", sure.cast("long")).withColumn("_most", F.least(F.col("_k"), most.cast("long")))
    left = v.withColumn("_left", F.col("_k") - F.sum("_sure").over(all_of))
    seat = left.where("_most > _sure").withColumn("_s", F.explode(F.sequence(F.col("_sure") + 1, F.col("_most"))))
    quotient = F.col("_v") / (2 * F.col("_s") - 1)
    order = Window.partitionBy(*group).orderBy(quotient.desc(), *key, "_s")
    won = seat.withColumn("_rank", F.row_number().over(order)).groupBy(*group, *key).agg(F.sum(F.expr("if(_rank <= _left, 1, 0)")).alias("_won"), F.first("_sure").alias("_base"))
    return votes.join(won, [*group, *key], "left").withColumn(out, F.coalesce(F.col("_base") + F.col("_won"), F.lit(0))).drop("_base", "_won")


def targets(sources: DataFrame) -> DataFrame:
    """Adds ``target`` to (src_null, src, source_size): weights 1, 2, 3, repeating, share all sizes; no target above REPEATS sizes.

    Filling to the caps has a closed form: a source is at its cap if, at the level where it would reach it, all sources together
    hold less than everything. One row a source takes part in these windows, not the documents.
    """
    order = Window.partitionBy("_all_sources").orderBy("src_null", "src")
    every = Window.partitionBy("_all_sources")
    s = sources.withColumn("_all_sources", F.lit(0)).withColumn("_w", (F.row_number().over(order) - 1) % 3 + 1).withColumn("_cap", F.col("source_size") * REPEATS)
    upto = Window.partitionBy("_all_sources").orderBy(F.col("_cap") / F.col("_w"))
    s = s.withColumn("_total", F.sum("source_size").over(every)).withColumn("_caps", F.sum("_cap").over(upto)).withColumn("_above", F.sum("_w").over(every) - F.sum("_w").over(upto))
    s = s.withColumn("_full", F.expr("_w * _caps + _cap * _above < _total * _w"))
    s = s.withColumn("_rest", F.col("_total") - F.sum(F.expr("if(_full, _cap, 0)")).over(every)).withColumn("_shared", F.sum(F.expr("if(_full, 0, _w)")).over(every))
    share = F.when(F.col("_full"), F.col("_cap").cast("double")).otherwise(F.col("_w").cast("double") * F.col("_rest") / F.greatest(F.col("_shared"), F.lit(1)))
    return s.select("src_null", "src", "source_size", F.least(share, F.col("_cap").cast("double")).alias("target"), F.col("_total").alias("total"))


def mix(docs: DataFrame, size: Column | None = None, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """How much of each document the mix takes: (key, size, source_size, target, taken, whole, part_from, part_to,
    head, source, text_hash), one row per input row.

    ``size`` is the number of words of the text (null: 0) unless given. Blocks of BLOCK words go to sources by Sainte-Laguë on
    their targets, then within a source to SHARDS shards by Sainte-Laguë on the shards' sizes. In a shard, the documents in
    order of a seeded hash make one row of words; the quota is taken from a seeded block boundary on, round and round. So a
    document is taken some whole number of times, or parts of it once more: ``taken`` words in all, at most REPEATS sizes.
    These are ``whole`` times the document, its words [part_from, part_to) and, where the row of words wraps, its first ``head``.

    Null sources form one source, last in order. The seeded hash is that of key and text, so null or repeated keys are spread like
    any others. Rows that agree in key, source and text are one row with a count until each gets its place, and documents of their
    own then: either may get the part. Very long texts are read whole. An empty table gives an empty result. Other columns are
    not looked at.
    """
    n = F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))) if size is None else size
    said = F.coalesce(F.md5(F.col(text).cast("binary")), F.lit(""))
    mark = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(":"), said).cast("binary"))
    rows = docs.select(
        F.col(key).alias("_key"), F.coalesce(F.col(source), F.lit("")).alias("src"), F.col(source).isNull().alias("src_null"),
        F.when(F.col(text).isNull(), 0).otherwise(n).cast("long").alias("size"), mark.alias("mark"),
        F.xxhash64(text).alias("text_hash"),
    ).withColumn("chunk", F.substring("mark", 1, CHUNK_DIGITS))
    rows = cut(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n")))  # narrow, and read twice
    by = ["src_null", "src"]
    chunks = rows.groupBy(*by, "chunk").agg(F.sum(F.col("size") * F.col("n")).alias("chunk_size"))
    shard = (F.conv("chunk", 16, 10).cast("long") % SHARDS).alias("shard")
    shards = chunks.groupBy(*by, shard).agg(F.sum("chunk_size").alias("shard_size"))
    sources = targets(shards.groupBy(*by).agg(F.sum("shard_size").alias("source_size")))
    quotas = apportion(sources.withColumn("_blocks", F.expr(f"(total + {BLOCK // 2}) div {BLOCK}")).withColumn("_all", F.lit(0)), ["_all"], by, "target", "_blocks", "quota").drop("_all")
    quotas = apportion(shards.join(quotas, by), by, ["shard"], "shard_size", "quota", "shard_quota")
    starts = chunks.withColumn("shard", shard)
    ordered = Window.partitionBy(*by, "shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.withColumn("chunk_start", F.coalesce(F.sum("chunk_size").over(ordered), F.lit(0))).join(quotas, [*by, "shard"])
    amount = F.least(F.col("shard_quota") * BLOCK, F.col("shard_size") * REPEATS)
    ring = F.greatest(F.col("shard_size"), F.lit(1))
    turn = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("src"), F.col("shard")).cast("binary")), 1, 12), 16, 10).cast("long")
    starts = starts.withColumn("whole", F.expr(f"least(shard_quota * {BLOCK}, shard_size * {REPEATS}) div greatest(shard_size, 1)"))
    starts = starts.withColumn("part", amount % ring).withColumn("begin", turn % F.expr(f"greatest((shard_size + {BLOCK - 1}) div {BLOCK}, 1)") * BLOCK)
    starts = starts.select(*by, "chunk", "chunk_start", "shard_size", "whole", "part", "begin", "source_size", "target")
    within = Window.partitionBy(*by, "chunk").orderBy("mark", "_key", "size", "text_hash").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_in", F.coalesce(F.sum(F.col("size") * F.col("n")).over(within), F.lit(0))).join(starts, [*by, "chunk"])
    placed = copies(placed, "n", "_i").withColumn("at", F.col("chunk_start") + F.col("_in") + F.col("_i") * F.col("size"))
    # The part covers [begin, begin + part) on a ring of shard_size words: from there to the ring's end, and on from its start.
    placed = placed.withColumn("part_from", F.greatest(F.col("begin") - F.col("at"), F.lit(0))).withColumn("part_to", F.expr("least(begin + part - at, size)"))
    placed = placed.withColumn("head", F.expr("greatest(0, least(begin + part - shard_size - at, size))"))
    placed = placed.withColumn("part_to", F.greatest("part_from", "part_to"))
    return placed.select(
        F.col("_key").alias(key), "size", "source_size", "target",
        (F.col("whole") * F.col("size") + F.col("part_to") - F.col("part_from") + F.col("head")).cast("long").alias("taken"),
        "whole", "part_from", "part_to", "head", F.expr("if(src_null, null, src)").alias("source"),
        "text_hash",
    )


def _numbered(rows: DataFrame, same: list[str], chunk: str, order: list[str]) -> DataFrame:
    """Adds ``_n``, a row's number from 0 among those that agree in ``same``, which may be null."""
    keys = {f"_g{i}": F.coalesce(F.col(c).cast("string"), F.lit("")) for i, c in enumerate(same)} | {f"_h{i}": F.col(c).isNull() for i, c in enumerate(same)}
    found = before(rows.withColumns(keys).withColumn("_one", F.lit(1)), list(keys), chunk, order, "_one", "_n")
    return found.drop(*keys, "_one", chunk, *order)


def mixed_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 0) -> DataFrame:
    """The mix as documents, with the columns of ``docs``: a row for each time a document is taken whole, and one for each part,
    its words joined by single spaces. Documents of which the mix takes nothing are left out.

    Null texts have no words and are never taken. Rows that agree in key, source and text are told apart by the hash of all their
    columns, the first of them getting the most; an empty table gives an empty result; other columns stay with their row.
    """
    names = docs.columns
    taken = mix(docs, key=key, text=text, source=source, seed=seed)
    taken = cut(taken.select(F.col(key).alias("_key"), F.col("source").alias("_source"), "text_hash", "whole", "part_from", "part_to", "head", "taken"))
    rows = docs.select(F.struct(*names).alias("_row"), F.col(key).alias("_key"), F.col(source).alias("_source"), F.xxhash64(text).alias("text_hash"))
    same = ["_key", "_source", "text_hash"]
    alike = taken.groupBy(*same).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if alike:
        rows = cut(rows.withColumn("_chunk", F.concat_ws("-", F.lpad(F.hex(F.xxhash64("_row")), 16, "0"), F.lpad(F.spark_partition_id().cast("string"), 8, "0"))).withColumn("_order", F.monotonically_increasing_id()))
        rows = _numbered(rows, same, "_chunk", ["_order"])
        # What equal rows get differs only around the ends of a part: few kinds a group, each with a count.
        kinds = taken.groupBy(*taken.columns).agg(F.count("*").alias("n"))
        order = Window.partitionBy(*same).orderBy(F.desc("taken"), "whole", "part_from", "part_to", "head").rowsBetween(Window.unboundedPreceding, -1)
        taken = copies(kinds.withColumn("_before", F.coalesce(F.sum("n").over(order), F.lit(0))), "n", "_i").withColumn("_n", F.col("_before") + F.col("_i"))
    else:
        rows, taken = rows.withColumn("_n", F.lit(0)), taken.withColumn("_n", F.lit(0))
    taken = taken.where("taken > 0")
    on = [rows[c].eqNullSafe(taken[c]) for c in [*same, "_n"]]
    met = rows.join(taken, on).select("_row", "whole", "part_from", "part_to", "head")
    words = F.regexp_extract_all(F.col(f"_row.{text}"), F.lit(WORD), F.lit(0))
    part = lambda start, n: F.when(n > 0, F.array(F.array_join(F.slice(words, start.cast("int") + 1, n.cast("int")), " "))).otherwise(F.array().cast("array<string>"))
    texts = F.concat(F.array_repeat(F.col(f"_row.{text}"), F.col("whole").cast("int")), part(F.col("part_from"), F.col("part_to") - F.col("part_from")), part(F.lit(0), F.col("head")))
    out = met.select("_row", F.explode(texts).alias("_text"))
    return out.select(*[F.col("_text").alias(n) if n == text else F.col(f"_row.{n}").alias(n) for n in names])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source")


OP9_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(source, '') AS src, source IS NULL AS src_null, md5('0:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), '')) AS mark,
    (CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END)::BIGINT AS size FROM documents),
p AS (SELECT *, ('0x' || substr(mark, 1, {CHUNK_DIGITS}))::BIGINT % {SHARDS} AS shard FROM d),
s AS (SELECT src_null, src, sum(size)::BIGINT AS source_size FROM d GROUP BY ALL),
w AS (
  SELECT *, (row_number() OVER (ORDER BY src_null, src) - 1) % 3 + 1 AS w, {REPEATS} * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM s),
u AS (SELECT *, (sum(cap) OVER (ORDER BY cap / w))::BIGINT AS caps, (sum(w) OVER () - sum(w) OVER (ORDER BY cap / w))::BIGINT AS above FROM w),
f AS (SELECT *, w * caps + cap * above < total * w AS is_full FROM u),
r AS (
  SELECT *, (total - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ())::BIGINT AS rest, (sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ())::BIGINT AS shared FROM f),
t AS (
  SELECT src_null, src, source_size, (total + {BLOCK // 2}) // {BLOCK} AS blocks,
    least(CASE WHEN is_full THEN cap::DOUBLE ELSE w::DOUBLE * rest::DOUBLE / greatest(shared, 1)::DOUBLE END, cap::DOUBLE) AS target FROM r),
a AS (SELECT *, unnest(range(1, blocks + 1)) AS k FROM t WHERE target > 0),
b AS (SELECT *, row_number() OVER (ORDER BY target / (2 * k - 1) DESC, src_null, src, k) AS place FROM a),
q AS (SELECT src_null, src, count(*) AS quota FROM b WHERE place <= blocks GROUP BY ALL),
h AS (SELECT src_null, src, shard, sum(size)::BIGINT AS shard_size FROM p GROUP BY ALL),
e AS (SELECT h.*, quota, unnest(range(1, quota + 1)) AS k FROM h JOIN q USING (src_null, src) WHERE shard_size > 0),
g AS (SELECT *, row_number() OVER (PARTITION BY src_null, src ORDER BY shard_size::DOUBLE / (2 * k - 1) DESC, shard, k) AS place FROM e),
i AS (SELECT src_null, src, shard, count(*) AS shard_quota FROM g WHERE place <= quota GROUP BY ALL),
n AS (SELECT h.*, least(coalesce(shard_quota, 0) * {BLOCK}, shard_size * {REPEATS}) AS amount FROM h LEFT JOIN i USING (src_null, src, shard)),
m AS (
  SELECT *, amount // greatest(shard_size, 1) AS whole, amount % greatest(shard_size, 1) AS part,
    ('0x' || substr(md5('0:' || src || ':' || shard), 1, 12))::BIGINT % greatest((shard_size + {BLOCK - 1}) // {BLOCK}, 1) * {BLOCK} AS first FROM n),
o AS (
  SELECT *, (coalesce(sum(size) OVER (PARTITION BY src_null, src, shard ORDER BY mark, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS pos FROM p)
SELECT doc_id, o.size, source_size, target, o.source,
  whole * o.size + greatest(0, least(first + part - pos, o.size) - greatest(first - pos, 0)) + greatest(0, least(first + part - shard_size - pos, o.size)) AS taken
FROM o JOIN m USING (src_null, src, shard) JOIN t USING (src_null, src)
"""
