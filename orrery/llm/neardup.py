"""Embedding near-duplicates: int8 tile products with rigorous error bounds, full precision only where they leave doubt."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, before, components, cut, forest

#: Vectors a tile side, tiles that travel together, packs that meet another one in one task.
TILE, PACK, MEETINGS = 2048, 8, 64
#: Added to every bound, for the rounding of the few double-precision operations that the bound itself is made of.
SLACK = 1e-12


#: Of the column _vec: neither null nor zero, without null or non-finite components.
SOUND = "coalesce(forall(_vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(_vec, x -> x <> 0), false)"


def unit_rows(flat: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, by way of their largest component so that no square over- or underflows."""
    x = flat / np.abs(flat).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and error norms: unit = scale * code + error, with |error| known for each vector."""
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127
    codes = np.rint(unit / scale)
    return codes.astype(np.int8), scale[:, 0], np.sqrt(((unit - scale * codes) ** 2).sum(axis=1))


Quantised = tuple[np.ndarray, np.ndarray, np.ndarray]


def tile_bounds(a: Quantised, b: Quantised, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index pairs of two tiles whose cosine may reach ``threshold``, and whether it surely does.

    With x = s q + e and y = t r + f, |x . y - s t q . r| <= |e| |y| + |s q| |f| <= |e| + (1 + |e|) |f|. Products q . r of int8
    codes are whole numbers that float32 holds exactly (up to 1,040 components a product), so the matrix product is exact.
    """
    (q, s, e), (r, t, f) = a, b
    near = np.zeros((len(q), len(r)), np.float64)
    for at in range(0, q.shape[1], 1040):
        near += q[:, at : at + 1040].astype(np.float32) @ r[:, at : at + 1040].astype(np.float32).T
    near *= s[:, None]
    near *= t[None, :]
    i, j = np.nonzero(near + (e[:, None] + (1 + e[:, None]) * f[None, :]) >= threshold - SLACK)
    return i, j, near[i, j] - (e[i] + (1 + e[i]) * f[j]) >= threshold + SLACK


def _sums(ids: np.ndarray, n: np.ndarray, ids2: np.ndarray, n2: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    """Links (i, j) as rows: how many rows each end is linked to, and a spanning forest."""
    sums, sums2 = np.bincount(i, n2[j], len(ids)), np.bincount(j, n[i], len(ids2))
    x, y = forest(ids[i], ids2[j])
    at, at2 = np.flatnonzero(sums), np.flatnonzero(sums2)
    rep = np.concatenate([ids[at], ids2[at2], x])
    return pd.DataFrame({"rep": rep, "n": np.concatenate([sums[at], sums2[at2], np.zeros(len(x))]).astype(np.int64), "to": np.concatenate([ids[at], ids2[at2], y])})


def _unpacked(codes: bytes, scales: bytes, errors: bytes, ids: bytes, copies: bytes, dim: int) -> tuple:
    return np.frombuffer(codes, np.int8).reshape(-1, dim), *(np.frombuffer(b, np.float64) for b in (scales, errors)), *(np.frombuffer(b, np.int64) for b in (ids, copies))


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept), one row per input row.

    Two rows link if their labels are equal and not null and the cosine of their vectors, in double precision, is at least
    ``threshold``. n_links counts the rows linked directly, component_id is the smallest key reachable (itself included), kept is
    key = component_id. Rows with a null label, or whose vector is null, zero or holds null or non-finite components, or whose
    key is null, link with nothing (a null key has a null component_id and kept false). Vectors of different lengths never link.

    Rows with the same label and the same vector are one representative: copies are counted, not compared. Representatives are
    ranked within their label and dealt to tiles of TILE. Packs of PACK tiles meet as int8 codes, scales and error norms; a task
    multiplies tiles' codes, and the error bounds leave some pairs in doubt. Only these are computed in full precision: of the
    double-precision vectors only those of pairs in doubt go to where they are needed. What comes back are sums of links and a
    spanning forest, at most four rows a vector and pair of tiles, never the pairs. All pairs of a label are compared, so work
    grows with the square of a label. An empty table gives an empty result; other columns are not looked at.
    """
    batches_of(vectors.sparkSession, 10_000)
    given = vectors.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vec"), F.col(label).alias("_label"))
    given = given.withColumn("_sound", F.expr(f"_key is not null and _label is not null and {SOUND}"))
    rows = given.where("_sound")
    rows = cut(rows.select("_key", "_label", "_vec", F.size("_vec").alias("_dim"), F.expr("sha2(cast(array_join(_vec, ',') as binary), 256)").alias("_hash")))
    # As vectors are equal if and only if their printed doubles are (but for -0.0, which only costs a comparison).
    reps = rows.groupBy("_label", "_dim", "_hash").agg(F.min("_key").alias("rep"), F.count("*").alias("copies"), F.first("_vec").alias("_vec"))
    reps = reps.withColumn("_chunk", F.substring("_hash", 1, 2)).withColumn("_one", F.lit(1))
    reps = before(reps, ["_label", "_dim"], "_chunk", ["_hash"], "_one", "_rank")
    reps = cut(reps.withColumn("_tile", F.expr(f"cast(_rank div {TILE} as int)")))
    kind = vectors.schema[label].dataType.simpleString()
    tile = ["_label", "_dim", "_tile"]

    def exact(p: pd.DataFrame) -> pd.DataFrame:
        by = p.sort_values("rep")
        units = unit_rows(np.stack(by["_vec"].to_list()).astype(np.float64))
        return pd.DataFrame({**{c: p[c].iloc[:1].to_numpy() for c in tile}, "ids": [by["rep"].to_numpy(np.int64).tobytes()], "copies": [by["copies"].to_numpy(np.int64).tobytes()], "units": [units.tobytes()]})

    tiles = cut(reps.select(*tile, "rep", "copies", "_vec").groupBy(*tile).applyInPandas(exact, f"_label {kind}, _dim int, _tile int, ids binary, copies binary, units binary"))

    def coded(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("_tile")
        q, s, e = quantised(np.frombuffer(b"".join(p["units"]), np.float64).reshape(-1, p["_dim"].iloc[0]))
        return pd.DataFrame({
            **{c: p[c].iloc[:1].to_numpy() for c in ("_label", "_dim", "_pack")}, "ids": [b"".join(p["ids"])], "copies": [b"".join(p["copies"])],
            "codes": [q.tobytes()], "scales": [s.tobytes()], "errors": [e.tobytes()],
        })

    sides = ["ids", "copies", "codes", "scales", "errors"]
    packs = tiles.withColumn("_pack", F.expr(f"cast(_tile div {PACK} as int)")).groupBy("_label", "_dim", "_pack")
    packs = cut(packs.applyInPandas(coded, f"_label {kind}, _dim int, _pack int, " + ", ".join(f"{c} binary" for c in sides)))
    packs = packs.join(packs.groupBy("_label", "_dim").agg(F.max("_pack").alias("_last")), ["_label", "_dim"])
    # Of two packs either may be the one that travels; by turns, each does so half the time.
    to = F.expr("filter(sequence(0, _last), b -> (b >= _pack) = ((_pack + b) % 2 = 0))")
    left = packs.withColumn("_other", F.explode(to)).withColumn("_part", F.expr(f"_pack div {MEETINGS}"))
    right = packs.select("_label", "_dim", F.col("_pack").alias("_other"), F.explode(F.expr(f"sequence(0, _last div {MEETINGS})")).alias("_part"), *[F.col(c).alias(f"{c}2") for c in sides])
    pairs = left.join(right, ["_label", "_dim", "_other", "_part"]).select("_label", "_dim", "_pack", "_other", *sides, *[f"{c}2" for c in sides])

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for label, dim, pack, other, *blobs in p.itertuples(index=False, name=None):
                ids, copies, codes, scales, errors, *second = blobs
                q, s, e, ids, n = _unpacked(codes, scales, errors, ids, copies, dim)
                r, t, f, ids2, n2 = _unpacked(second[2], second[3], second[4], second[0], second[1], dim)
                for a in range(0, len(q), TILE):
                    for b in range(a if pack == other else 0, len(r), TILE):
                        at, to = slice(a, a + TILE), slice(b, b + TILE)
                        i, j, sure = tile_bounds((q[at], s[at], e[at]), (r[to], t[to], f[to]), threshold)
                        if pack == other and a == b:
                            i, j, sure = i[i < j], j[i < j], sure[i < j]
                        yield _sums(ids[at], n[at], ids2[to], n2[to], i[sure], j[sure]).assign(_label=None, _dim=None, _tile=None, _other=None, doubt=None)
                        if not sure.all():
                            doubt = np.stack([i[~sure], j[~sure]]).astype(np.int16)
                            yield pd.DataFrame({"rep": None, "n": None, "to": None, "_label": [label], "_dim": [dim], "_tile": [pack * PACK + a // TILE], "_other": [other * PACK + b // TILE], "doubt": [doubt.tobytes()]})

    links = "rep long, n long, to long"
    found = cut(pairs.mapInPandas(met, f"{links}, _label {kind}, _dim int, _tile int, _other int, doubt binary"))

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of a tile, just the vectors that are in doubt with another tile."""
        for p in batches:
            for label, dim, other, doubt, ids, copies, units in p.itertuples(index=False, name=None):
                i, j = np.frombuffer(doubt, np.int16).reshape(2, -1)
                used, i = np.unique(i, return_inverse=True)
                ids, copies = (np.frombuffer(b, np.int64)[used].tobytes() for b in (ids, copies))
                units = np.frombuffer(units, np.float64).reshape(-1, dim)[used].tobytes()
                yield pd.DataFrame({"_label": [label], "_dim": [dim], "_tile": [other], "doubt": [np.stack([i, j]).astype(np.int16).tobytes()], "ids2": [ids], "copies2": [copies], "units2": [units]})

    def computed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for dim, doubt, ids2, copies2, units2, ids, copies, units in p.itertuples(index=False, name=None):
                i, j = np.frombuffer(doubt, np.int16).reshape(2, -1).astype(np.int64)
                x, y = (np.frombuffer(b, np.float64).reshape(-1, dim) for b in (units2, units))
                good = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 65536]], y[j[k : k + 65536]]) for k in range(0, len(i), 65536)]) >= threshold
                yield _sums(*(np.frombuffer(b, np.int64) for b in (ids2, copies2, ids, copies)), i[good], j[good])

    doubts = found.where("doubt is not null").select(*tile, "_other", "doubt")
    doubts = doubts.join(tiles, tile).select("_label", "_dim", "_other", "doubt", "ids", "copies", "units")
    doubts = doubts.mapInPandas(taken, f"_label {kind}, _dim int, _tile int, doubt binary, ids2 binary, copies2 binary, units2 binary")
    doubts = doubts.join(tiles, tile).select("_dim", "doubt", "ids2", "copies2", "units2", "ids", "copies", "units")
    found = cut(found.where("doubt is null").select("rep", "n", "to").union(doubts.mapInPandas(computed, links)))
    links = components(found.where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")), spanning=True)
    counts = found.groupBy("rep").agg(F.sum("n").alias("others"))
    known = reps.select("_label", "_dim", "_hash", "rep", "copies").join(counts, "rep", "left").join(links, F.col("rep") == F.col("node"), "left")
    known = known.select("_label", "_dim", "_hash", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    placed = rows.select("_key", "_label", "_dim", "_hash").join(known, ["_label", "_dim", "_hash"]).select("_key", "n_links", "component_id")
    rest = given.where("not _sound").select("_key", F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"))
    return placed.union(rest).select(F.col("_key").alias(key), "n_links", "component_id", F.coalesce(F.col("_key") == F.col("component_id"), F.lit(False)).alias("kept"))


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP2_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY a)
SELECT embeddings.vec_id, coalesce(n_links, 0) AS n_links, component_id, embeddings.vec_id = component_id AS kept
FROM embeddings JOIN c ON embeddings.vec_id = c.vec_id LEFT JOIN n ON embeddings.vec_id = n.vec_id
"""
