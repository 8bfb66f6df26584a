"""Approximate nearest neighbours: a hash-prefix forest of sorted arrays, descended to the longest prefix and ascended in step."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from .common import batches_of, before, cut
from .neardup import SOUND, unit_rows

#: Trees, bits of a hash string.
TREES, BITS = 32, 48
#: Prefix lengths that the ascent stops at, all trees in step.
LEVELS = (48, 20, 12, 8, 6, 5, 4, 3, 2, 1, 0)
#: The ascent of a query ends when a vector as near as its present k-th would have been met with this probability.
FOUND = 0.9
#: Entries a block, blocks whose entries one run of a tree's range holds at most, entries a range of a tree has about, queries a block.
BLOCK, RUN, RANGE, QUERIES = 4096, 64, 65_536, 128
SEED = 7


class Forest(NamedTuple):
    """blocks: (_dim, _block, keys, units), the entries; runs: (_dim, _tree, _range, _part, strings, owners), the sorted arrays of all
    trees, cut into ranges by the strings' first ``range_bits`` bits; ids: keys an entry names at most."""

    blocks: DataFrame
    runs: DataFrame
    range_bits: int
    ids: int


def planes(dim: int) -> np.ndarray:
    """TREES x BITS random directions, the same everywhere."""
    return np.random.default_rng([SEED, dim]).standard_normal((TREES * BITS, dim)).astype(np.float32)


def hash_strings(units: np.ndarray) -> np.ndarray:
    """TREES x n hash strings: bit after bit, the side of a random plane that a vector lies on, first bit highest."""
    sides = units.astype(np.float32) @ planes(units.shape[1]).T > 0
    weights = (1 << np.arange(BITS - 1, -1, -1)).astype(np.int64)
    return (sides.reshape(len(units), TREES, BITS) @ weights).T.astype(np.int64)


def met_by(level: int, cosine: np.ndarray) -> np.ndarray:
    """With what probability a vector of that cosine shares a prefix of ``level`` bits in some tree."""
    agree = 1 - np.arccos(np.clip(cosine, -1, 1)) / np.pi
    return 1 - (1 - agree**level) ** TREES


def _directions(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(_key, _dim, unit, _hash) of the sound rows: vectors scaled to length one, and a digest. Parallel vectors have one direction."""

    def scaled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            sizes = p["_vec"].map(len)
            for dim, g in p.groupby(sizes):
                units = unit_rows(np.stack(g["_vec"].to_list()).astype(np.float64)) + 0.0  # no -0.0
                flat = [u.tobytes() for u in units]
                yield pd.DataFrame({"_key": g["_key"].to_numpy(), "_dim": dim, "unit": flat, "_hash": [blake2b(u, digest_size=16).hexdigest() for u in flat]})

    rows = vectors.select(F.col(key).cast("long").alias("_key"), F.col(vector).cast("array<double>").alias("_vec")).where(f"_key is not null and {SOUND}")
    return rows.mapInPandas(scaled, "_key long, _dim int, unit binary, _hash string")


def build_index(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", ids: int = 6) -> Forest:
    """The forest over every sound vector.

    Vectors of the same direction are one entry that names its ``ids`` smallest keys, so a group of copies of any size is one
    entry. Entries are numbered in order of the first byte of their first string, so that near ones often share a block. In each
    tree the entries are sorted by their strings and cut into ranges of equal prefixes, about RANGE entries each; a range in which
    many vectors fall is several runs, of RUN blocks' entries each. Null, zero and non-finite vectors and null keys are left out;
    repeated rows are one key. An empty table gives an empty forest. Other columns are not looked at, whatever their names.
    """
    batches_of(vectors.sparkSession, 10_000)
    rows = _directions(vectors, key, vector).dropDuplicates(["_dim", "_hash", "_key"])
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_dim", "_hash").orderBy("_key"))).where(F.col("_n") <= ids)
    entries = rows.groupBy("_dim", "_hash").agg(F.sort_array(F.collect_list("_key")).alias("keys"), F.first("unit").alias("unit"))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for dim, g in p.groupby("_dim"):
                units = np.frombuffer(b"".join(g["unit"]), np.float64).reshape(-1, dim)
                sides = units.astype(np.float32) @ planes(dim)[:8].T > 0
                yield g.assign(_chunk=np.packbits(sides, axis=1)[:, 0].astype(np.int32) * 256 + g["_hash"].str[:2].map(lambda h: int(h, 16)).to_numpy(np.int32))

    entries = cut(entries.mapInPandas(numbered, "_dim int, _hash string, keys array<long>, unit binary, _chunk int"))
    ranked = before(entries.withColumn("_one", F.lit(1)), ["_dim"], "_chunk", ["_hash"], "_one", "_rank")
    ranked = ranked.withColumn("_block", F.expr(f"cast(_rank div {BLOCK} as int)"))

    def blocked(p: pd.DataFrame) -> pd.DataFrame:
        keys = np.full((len(p), ids), np.iinfo(np.int64).max)
        for i, ks in enumerate(p["keys"]):
            keys[i, : len(ks)] = ks
        return pd.DataFrame({"_dim": p["_dim"].iloc[:1], "_block": p["_block"].iloc[:1], "keys": [keys.tobytes()], "units": [b"".join(p["unit"])]})

    blocks = ranked.select("_dim", "_block", "keys", "unit").groupBy("_dim", "_block").applyInPandas(blocked, "_dim int, _block int, keys binary, units binary")
    blocks = cut(blocks)
    bits = max(0, int(np.ceil(np.log2(max(1, entries.count()) / RANGE))))

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for dim, block, units in p.itertuples(index=False, name=None):
                strings = hash_strings(np.frombuffer(units, np.float64).reshape(-1, dim))
                for tree, s in enumerate(strings):
                    by = np.argsort(s, kind="stable")
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(s[by] >> (BITS - bits))) + 1, [len(by)]])
                    owners = block * BLOCK + by
                    yield pd.DataFrame({
                        "_dim": dim, "_tree": tree, "_range": s[by][cuts[:-1]] >> (BITS - bits), "_part": block // RUN,
                        "strings": [s[by[a:b]].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                        "owners": [owners[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)],
                    })

    def merged(p: pd.DataFrame) -> pd.DataFrame:
        strings, owners = (np.frombuffer(b"".join(p[c]), np.int64) for c in ("strings", "owners"))
        by = np.lexsort((owners, strings))
        return p.iloc[:1].assign(strings=[strings[by].tobytes()], owners=[owners[by].tobytes()])

    schema = "_dim int, _tree int, _range long, _part int, strings binary, owners binary"
    runs = blocks.select("_dim", "_block", "units").mapInPandas(spread, schema).groupBy("_dim", "_tree", "_range", "_part").applyInPandas(merged, schema)
    return Forest(blocks, cut(runs), bits, ids)


def _pairs(sorted_: np.ndarray) -> bytes:
    """Sorted numbers query * 2 ** 16 + entry of two blocks' pairs: by their differences, byte plane by byte plane."""
    steps = np.diff(sorted_, prepend=sorted_.dtype.type(0)).astype(np.uint32)
    return zstandard.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _flags(blobs: list[bytes]) -> np.ndarray:
    """Which entries of a block each query of a block meets."""
    flags = np.zeros((QUERIES, BLOCK), bool)
    for b in blobs:
        steps = np.ascontiguousarray(np.frombuffer(zstandard.decompress(b), np.uint8).reshape(4, -1).T).view(np.uint32)[:, 0]
        pairs = np.cumsum(steps, dtype=np.int64)
        flags[pairs >> 16, pairs & 0xFFFF] = True
    return flags


def candidates(forest: Forest, queries: DataFrame, level: int) -> DataFrame:
    """(_dim, _block, _qb, pairs): what the queries meet of each block at prefixes of ``level`` bits, in any tree.

    ``queries`` are blocks (_dim, _qb, alive, strings). Each tree's range that a query's prefix falls into, or those that it spans,
    are met by an equi-join; there the entries that share the prefix are one stretch of the sorted array, found by bisection.
    """
    bits = forest.range_bits

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for dim, qb, alive, strings in p.itertuples(index=False, name=None):
                alive = np.array(alive, np.int64)
                prefixes = np.frombuffer(strings, np.int64).reshape(TREES, -1)[:, alive] >> (BITS - level)
                for tree, prefix in enumerate(prefixes):
                    spans = 1 << max(0, bits - level)
                    first = prefix << (bits - level) if bits > level else prefix >> (level - bits)
                    ranges, q = np.repeat(first, spans) + np.tile(np.arange(spans), len(first)), np.repeat(np.arange(len(first)), spans)
                    by = np.argsort(ranges, kind="stable")
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(ranges[by])) + 1, [len(by)]]) if len(by) else np.zeros(1, np.int64)
                    groups = [q[by[a:b]] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                    yield pd.DataFrame({
                        "_dim": dim, "_tree": tree, "_range": ranges[by][cuts[:-1]], "_qb": qb,
                        "who": [alive[g].tobytes() for g in groups], "prefix": [prefix[g].tobytes() for g in groups],
                    })

    asked = queries.select("_dim", "_qb", "alive", "strings").mapInPandas(probes, "_dim int, _tree int, _range long, _qb int, who binary, prefix binary")
    met = asked.join(forest.runs, ["_dim", "_tree", "_range"]).select("_dim", "_qb", "who", "prefix", "strings", "owners")

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for dim, qb, who, prefix, strings, owners in p.itertuples(index=False, name=None):
                who, prefix, strings, owners = (np.frombuffer(b, np.int64) for b in (who, prefix, strings, owners))
                a, b = np.searchsorted(strings, prefix << (BITS - level)), np.searchsorted(strings, (prefix + 1) << (BITS - level))
                step = max(1, 2_000_000 // max(1, int((b - a).max())))
                for at in range(0, len(who), step):
                    size = (b - a)[at : at + step]
                    if not size.any():
                        continue
                    place = np.arange(size.sum()) + np.repeat(a[at : at + step] - (np.cumsum(size) - size), size)
                    owner = owners[place]
                    pairs = np.sort((owner // BLOCK << 32) + (np.repeat(who[at : at + step], size) << 16) + owner % BLOCK)
                    cuts = np.concatenate([[0], np.flatnonzero(np.diff(pairs >> 32)) + 1, [len(pairs)]])
                    yield pd.DataFrame({
                        "_dim": dim, "_block": (pairs[cuts[:-1]] >> 32).astype(np.int32), "_qb": qb,
                        "pairs": [_pairs(pairs[x:y] & 0xFFFFFFFF) for x, y in zip(cuts[:-1], cuts[1:], strict=True)],
                    })

    return met.mapInPandas(found, "_dim int, _block int, _qb int, pairs binary")


def scored(forest: Forest, queries: DataFrame, level: int, k: int) -> DataFrame:
    """(query_id, vec_id, score, n): of each block the k best rows for each query among those met at ``level``, other than its own,
    and, in a row without vec_id, how many entries of the block were scored."""
    met = candidates(forest, queries, level).groupBy("_dim", "_block", "_qb").agg(F.collect_list("pairs").alias("pairs"))
    met = met.join(queries.select("_dim", "_qb", F.col("keys").alias("q_keys"), F.col("units").alias("q_units")), ["_dim", "_qb"]).join(forest.blocks, ["_dim", "_block"])
    ids = forest.ids

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for dim, pairs, q_keys, q_units, keys, units in p.itertuples(index=False, name=None):
                wanted, units = (np.frombuffer(b, np.float64).reshape(-1, dim) for b in (q_units, units))
                q_keys, keys = np.frombuffer(q_keys, np.int64), np.frombuffer(keys, np.int64).reshape(-1, ids)
                q, i = np.nonzero(_flags(pairs))
                # In double precision; one row at a time gives equal directions equal scores.
                score = np.concatenate([np.einsum("ij,ij->i", wanted[q[s : s + 65536]], units[i[s : s + 65536]]) for s in range(0, len(q), 65536)])
                begin = np.searchsorted(q, np.arange(len(q_keys) + 1))
                by = np.lexsort((keys[i, 0], -score, q))  # ties by the smallest key, here as in the end
                by = by[np.arange(len(q)) - begin[q] <= k]  # one more than wanted: the query's own entry may be among them
                q, i, score = q[by], i[by], score[by]
                named = keys[i]
                good = (named != np.iinfo(np.int64).max) & (named != q_keys[q][:, None])
                at, which = np.nonzero(good)
                asked = np.flatnonzero(np.diff(begin))
                yield pd.DataFrame({"query_id": q_keys[q[at]], "vec_id": named[at, which], "score": score[at], "n": None})
                yield pd.DataFrame({"query_id": q_keys[asked], "vec_id": None, "score": None, "n": np.diff(begin)[asked]})

    rows = met.select("_dim", "pairs", "q_keys", "q_units", "keys", "units")
    return rows.mapInPandas(best, "query_id long, vec_id long, score double, n long")


def search(index: Forest, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, scored): the k nearest rows found for each query, other than those with the query's own key.

    A round scores what shares a prefix of one of LEVELS with the query in any tree, from the longest prefixes up, all trees in
    step. With a cosine c to the k-th found, a nearer vector shares x bits with the query in some tree with a known probability
    (``met_by``); once that is FOUND the query is done, and the others go on to shorter prefixes, which hold whatever the longer
    ones did. At length 0 everything is met, so no query ends with less than there is, and no number of candidates ends one.

    The score is the cosine in double precision; ties go to the smaller key, among all that were met; fewer rows come back only
    where the index has fewer. ``scored`` is how many entries were compared in the query's last round. Unsound queries and null keys
    get no rows; a repeated query key is one query; an empty table gives an empty result. Other columns are not looked at, whatever
    their names. The index must name k + 1 keys an entry: ``build_index(ids=k + 1)``.
    """
    if index.ids <= k:
        raise ValueError(f"the index names {index.ids} keys an entry, {k + 1} are needed")
    spark = queries.sparkSession
    batches_of(spark, 10_000)
    q = _directions(queries, key, vector).groupBy("_key").agg(F.min(F.struct("_dim", "_hash", "unit")).alias("_d")).select("_key", "_d.*")
    q = q.withColumn("_chunk", F.pmod(F.xxhash64("_key"), F.lit(1024))).withColumn("_one", F.lit(1))
    q = before(q, ["_dim"], "_chunk", ["_key"], "_one", "_rank").withColumn("_qb", F.expr(f"cast(_rank div {QUERIES} as int)"))

    def packed(p: pd.DataFrame) -> pd.DataFrame:
        dim, p = int(p["_dim"].iloc[0]), p.sort_values("_key")
        strings = hash_strings(np.frombuffer(b"".join(p["unit"]), np.float64).reshape(-1, dim))
        return pd.DataFrame({"_dim": [dim], "_qb": p["_qb"].iloc[:1].to_numpy(), "keys": [p["_key"].to_numpy(np.int64).tobytes()], "units": [b"".join(p["unit"])], "strings": [strings.tobytes()]})

    blocks = cut(q.select("_dim", "_qb", "_key", "unit").groupBy("_dim", "_qb").applyInPandas(packed, "_dim int, _qb int, keys binary, units binary, strings binary"))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for dim, qb, keys in p.itertuples(index=False, name=None):
                keys = np.frombuffer(keys, np.int64)
                yield pd.DataFrame({"_dim": dim, "_qb": qb, "_i": np.arange(len(keys)), "query_id": keys})

    alive = cut(blocks.select("_dim", "_qb", "keys").mapInPandas(listed, "_dim int, _qb int, _i long, query_id long"))
    answers = []
    for level in LEVELS:
        now = alive.groupBy("_dim", "_qb").agg(F.sort_array(F.collect_list("_i")).alias("alive")).join(blocks, ["_dim", "_qb"])
        near = cut(scored(index, now, level, k))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        top = near.where("vec_id is not null").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        state = alive.join(near.groupBy("query_id").agg(F.sum("n").alias("scored")), "query_id", "left")
        state = state.join(top.groupBy("query_id").agg(F.max("rank").alias("found"), F.min("score").alias("least")), "query_id", "left")
        agree = 1 - F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), "least"))) / np.pi
        met = 1 - F.pow(1 - F.pow(agree, F.lit(float(level))), F.lit(float(TREES)))
        done = F.lit(True) if level == 0 else F.coalesce((F.col("found") == k) & (met >= FOUND), F.lit(False))
        open_ = Observation()  # counted while the state is written
        state = state.select("_dim", "_qb", "_i", "query_id", "scored", done.alias("done"))
        state = cut(state.observe(open_, F.count_if(~F.col("done")).alias("n")))
        answers.append(top.join(state.where("done").select("query_id", "scored"), "query_id").select("query_id", "rank", "vec_id", "score", "scored"))
        if not open_.get["n"]:
            break
        alive = state.where("not done").select("_dim", "_qb", "_i", "query_id")
    return reduce(DataFrame.union, answers)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(build_index(vectors), vectors.where("vec_id % 50 = 0"))
