"""Sharding by jump consistent hashing: stable keys to shards without a ring table, gapless slots within shards."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import before, copies, cut

_U = np.uint64
#: Ranges of crc within a range of keys.
CRCS = 16


def mixed(keys: np.ndarray) -> np.ndarray:
    """Spreads 64-bit keys evenly (a bijection, so distinct keys stay distinct)."""
    z = keys.astype(np.int64).view(_U) + _U(0x9E3779B97F4A7C15)
    z = (z ^ (z >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> _U(27))) * _U(0x94D049BB133111EB)
    return z ^ (z >> _U(31))


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each 64-bit key: a key jumps to ever later shards, and stays at the last one below ``shards``."""
    state, at, ahead = keys.astype(_U).copy(), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    open_ = np.ones(len(keys), bool)
    while open_.any():
        at[open_] = ahead[open_]
        state[open_] = state[open_] * _U(2862933555777941757) + _U(1)
        ahead[open_] = ((at[open_] + 1) * (float(1 << 31) / ((state[open_] >> _U(33)).astype(np.float64) + 1.0))).astype(np.int64)
        open_ &= ahead < shards
    return at.astype(np.int32)


def shard_rows(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", chunks: int = 1024) -> DataFrame:
    """Deals every row to a shard by its key alone: (key, size, text_crc32, law, shard, slot, grown_shard).

    The law is ``key``: key and shard count decide, and with one more shard rows move only into it (``grown_shard``). ``size`` is
    the text's UTF-8 bytes plus 8. A null text has size 8 and a null crc, so that it isn't taken for an empty one, whose crc is 0.
    ``slot`` is the rank within the shard by range of mixed keys, crc, mixed key and size, gapless from 0: ranks are taken within
    ``chunks`` key ranges a shard, each of CRCS ranges of crc, and shifted by the ranges' counts, so no task sorts a shard. Rows
    that agree in key, crc and size are one row with a count until they get their slots. So neither a key nor a text with a third
    of all rows makes a task larger. Null keys count as key -1. Keys of another type than an integer are hashed to 64 bits first.
    Repeated rows share a shard and have slots of their own; very long texts are read whole. An empty table gives an empty result.
    Other columns are not looked at.
    """
    kind = df.schema[key].dataType
    number = F.col(key).cast("long") if isinstance(kind, T.IntegralType) else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    bits = max(1, int(np.ceil(np.log2(chunks))))
    to = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("grown_shard", T.IntegerType()), T.StructField("chunk", T.IntegerType()), T.StructField("place", T.LongType())])

    @F.pandas_udf(to)
    def dealt(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in it:
            z = mixed(s.to_numpy(np.int64))
            place = (z ^ _U(1 << 63)).view(np.int64)  # signed order of these is unsigned order of z
            yield pd.DataFrame({"shard": jump(z, shards), "grown_shard": jump(z, shards + 1), "chunk": (z >> _U(64 - bits)).astype(np.int32), "place": place})

    rows = df.select(
        F.col(key).alias("_key"), F.coalesce(number, F.lit(-1)).alias("_number"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.col(text).cast("binary")).alias("text_crc32"),
    )
    alike = rows.groupBy("_key", "_number", "size", "text_crc32").agg(F.count(F.lit(1)).alias("_n"))
    alike = cut(alike.withColumn("_to", dealt("_number")).select("_key", "size", "text_crc32", "_n", "_to.*"))  # the texts are read once
    alike = alike.withColumn("chunk", F.col("chunk") * CRCS + F.expr(f"cast(coalesce(text_crc32, 0) * {CRCS} div {1 << 32} as int)"))
    ranked = before(alike, ["shard"], "chunk", ["text_crc32", "place", "size", "_key"], "_n", "slot")
    ranked = copies(ranked, "_n", "_i")
    return ranked.select(F.col("_key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("slot") + F.col("_i")).cast("long").alias("slot"), "grown_shard")


SHARDS = 24


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"), SHARDS)


def _times(x: str, c: str) -> str:
    return f"(({x}::UHUGEINT * {c}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"


OP6_SQL = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(octet_length(encode(text)), 0) + 8 AS size, text,
    ((CASE WHEN coalesce(doc_id, -1) < 0 THEN coalesce(doc_id, -1)::HUGEINT + 18446744073709551616::HUGEINT ELSE doc_id::HUGEINT END
      + 11400714819323198485::HUGEINT) % 18446744073709551616::HUGEINT)::UBIGINT AS z0 FROM documents),
m1 AS (SELECT *, {_times("xor(z0, z0 >> 30)", "13787848793156543929")} AS z1 FROM d),
m2 AS (SELECT *, {_times("xor(z1, z1 >> 27)", "10723151780598845931")} AS z2 FROM m1),
m AS (SELECT r, doc_id, size, text, xor(z2, z2 >> 31) AS z FROM m2),
j(r, state, b, j) AS (
  SELECT r, z, 0::BIGINT, 0::BIGINT FROM m
  UNION ALL
  SELECT r, s, j, floor((j + 1) * (2147483648.0::DOUBLE / ((s >> 33)::DOUBLE + 1.0)))::BIGINT
  FROM (SELECT r, j, (({_times("state", "2862933555777941757")})::UHUGEINT + 1)::UBIGINT AS s FROM j WHERE j < {SHARDS + 1})),
a AS (SELECT r, max(j) FILTER (j < {SHARDS}) AS shard, max(j) FILTER (j < {SHARDS + 1}) AS grown FROM j GROUP BY r),
bits AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]),
    lambda c, k: xor(c >> 1, (c & 1) * 3988292384::UBIGINT))) AS t),
crc AS (
  SELECT r, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::UBIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS crc
  FROM m, bits)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY z >> 54, crc NULLS FIRST, z, size, doc_id NULLS FIRST) - 1 AS slot, grown::INT AS grown_shard
FROM m JOIN a USING (r) JOIN crc USING (r)
"""
