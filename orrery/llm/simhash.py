"""SimHash near-duplicates: an inverted index on byte positions with count filtering, then verification."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, components, cut, forest, with_columns

SHINGLE, SEED, MOST_BITS = 3, 42, 2
#: Two fingerprints that differ in at most MOST_BITS bits share at least this many of their eight positional bytes.
LEAST_BYTES = 8 - MOST_BITS
#: Fingerprints a posting list is tallied with; longer lists are posted anew under more bytes.
LIST = 2048
_LANES = np.uint64(0x0101010101010101)
_RUN = 255  # sums of so many bits fit a byte


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of the whole text, as a signed 64-bit integer; zero for a text without words.

    A-Z are lower-cased, words are runs of non-white-space, shingles of ``shingle`` words count as often as they occur; a text of
    fewer words is one shingle. A bit is set if it is set in over half of the shingles' XXH64.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    flat, hashed = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = np.array([hashed(flat, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends[: -shingle + 1] if shingle > 1 else ends).copy()
        starts[1:], starts[0] = starts[:-1].copy(), 0
        h = np.fromiter([hashed(flat[a:b], SEED) for a, b in zip(starts.tolist(), (ends[shingle - 1 :] - 1).tolist(), strict=True)], np.uint64, len(starts))
    runs = np.zeros(-(-len(h) // _RUN) * _RUN, np.uint64)
    runs[: len(h)] = h
    runs = runs.reshape(-1, _RUN)
    counts = np.stack([((runs >> np.uint64(i)) & _LANES).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64) for i in range(8)], axis=1)
    bits = (2 * counts.reshape(-1) > len(h)).astype(np.uint8)  # byte by byte, low bit first
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint", shingle: int = SHINGLE) -> DataFrame:
    """Adds each row's fingerprint (long); a scan without a shuffle."""

    batches_of(docs.sparkSession, 1000)

    def make():
        return lambda texts: [pa.array([fingerprint(t, shingle) for t in texts.to_pylist()], pa.int64())]

    return with_columns(docs, [text], f"`{name}` long", make)


def _masks(choices: Iterable[Iterable[int]]) -> Column:
    """For each choice of byte positions a mask of just those bytes: an array of (at, mask)."""
    out = []
    for i, kept in enumerate(choices):
        m = sum(0xFF << (8 * k) for k in kept)
        out.append(F.struct(F.lit(i).alias("at"), F.lit(m - (1 << 64) if m >> 63 else m).alias("mask")))
    return F.array(*out)


#: The index: lists by the bytes at two of the four pairs of neighbouring positions. MOST_BITS bits spoil two pairs at most.
PAIRS = [a + b for a, b in combinations([(0, 1), (2, 3), (4, 5), (6, 7)], 2)]
#: The index of what stands in too long a list: by the bytes at LEAST_BYTES positions.
FINE = list(combinations(range(8), LEAST_BYTES))


def tally(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many positional bytes each pair of fingerprints shares."""
    return ((x ^ y)[..., None].view(np.uint8) == 0).sum(axis=-1, dtype=np.int8)


def _met(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs that met in a list, those whose tally reaches the guaranteed minimum and that then prove close, bit by bit."""
    often = tally(x, y) >= LEAST_BYTES
    x, y = x[often], y[often]
    near = np.bitwise_count((x ^ y).view(np.uint64)) <= MOST_BITS
    return x[near], y[near]


def tallied(lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within each row of a matrix of posting lists of one length."""
    n = lists.shape[1]
    rows, met = max(1, 500_000 // (n * len(lists))), []
    for at in range(0, n - 1, rows):  # so many rows of the pairs' triangle at a time
        i, j = np.nonzero(np.arange(at, min(n, at + rows))[:, None] < np.arange(n)[None, :])
        met.append(_met(lists[:, i + at].ravel(), lists[:, j].ravel()))
    x, y = zip(*met, strict=True)
    return np.concatenate(x), np.concatenate(y)


def _close_in_fine(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links within one list of the fine index: its pairs share LEAST_BYTES bytes, and each neighbour is one of 136 look-ups away."""
    free = np.bitwise_or.reduce(fps ^ fps[0]).view(np.uint64)
    at = [i for i in range(64) if (int(free) >> i) & 1]
    order = np.sort(fps.view(np.uint64))
    flips = [1 << i for i in at] + [(1 << i) | (1 << j) for i, j in combinations(at, 2)]
    xs, ys = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for f in flips:
        wanted = order ^ np.uint64(f)
        place = np.minimum(np.searchsorted(order, wanted), len(order) - 1)
        hit = (order[place] == wanted) & (order < wanted)
        xs.append(order[hit])
        ys.append(wanted[hit])
    return np.concatenate(xs).view(np.int64), np.concatenate(ys).view(np.int64)


def _links(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        lists = p["fps"].to_list()
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        met = []
        for n in np.unique(sizes).tolist():
            same = [lists[k] for k in np.flatnonzero(sizes == n)]
            if n > LIST:
                met += [_close_in_fine(np.asarray(x, np.int64)) for x in same]
                continue
            step = max(1, 500_000 // (n * n))
            met += [tallied(np.array(same[at : at + step], np.int64)) for at in range(0, len(same), step)]
        a, b = forest(*(np.concatenate(x) for x in zip(*met, strict=True))) if met else (np.zeros(0, np.int64),) * 2
        yield pd.DataFrame({"a": a, "b": b})


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct values of ``fps.fingerprint`` that differ in at most MOST_BITS bits, as a spanning set:
    whatever is connected by all links is connected by these.

    An inverted index on byte positions. A list for a single byte would hold 1/256 of all fingerprints, so lists stand for the bytes
    at four positions, two pairs of neighbouring ones: six postings a fingerprint, and a close pair meets in one of them at least,
    as two bits spoil two of the four pairs at most. Lists so hold about 2 ** -32 of all fingerprints. In a list the shared positional
    bytes of each pair are tallied; pairs with LEAST_BYTES of eight, the least that a close pair shares, are verified bit by bit.

    Families of fingerprints may fill one list. What stands in a list of more than LIST is posted anew under LEAST_BYTES bytes. Such
    lists leave two bytes free, hold at most 65,536 fingerprints whatever the corpus, and a pair of theirs has its tally by meeting.
    """
    spark = fps.sparkSession
    spread = cut(fps.select("fingerprint").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("fingerprint")))

    def posted(rows: DataFrame, choices: list) -> DataFrame:
        out = rows.select("fingerprint", F.explode(_masks(choices)).alias("p"))
        return out.select("fingerprint", "p.at", F.expr("fingerprint & p.mask").alias("bytes"))

    index = posted(spread, PAIRS)
    long_lists = cut(index.groupBy("at", "bytes").agg(F.count("*").alias("n")).where(F.col("n") > LIST).select("at", "bytes", F.lit(True).alias("long")))
    known = index.join(long_lists, ["at", "bytes"], "left")
    lists = known.where("long is null").groupBy("at", "bytes").agg(F.collect_list("fingerprint").alias("fps"))
    again = known.where("long").select("fingerprint").distinct()
    fine = posted(again, FINE).groupBy("at", "bytes").agg(F.collect_list("fingerprint").alias("fps"))
    return lists.union(fine).where("size(fps) > 1").select("fps").mapInPandas(_links, "a long, b long")


def simhash_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id, family, mark), one row per input row: component_id is the smallest key reachable over links.

    Rows link if their fingerprints differ in at most MOST_BITS bits. Null and empty texts have fingerprint zero and link like
    any other. Equal fingerprints are one node, so copies cost nothing beyond their own rows; null keys take part but are never
    the smallest (a component of null keys alone has a null id). Repeated rows are all returned. An empty table gives an empty
    result. Other columns are not looked at, whatever their names. ``family`` numbers the components also where keys repeat;
    ``mark`` is a hash of the text.
    """
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = cut(with_fingerprint(rows, "_text").select("_key", "fingerprint", F.xxhash64("_text").alias("mark")))
    nodes = rows.groupBy("fingerprint").agg(F.min("_key").alias("low"))
    linked = components(fingerprint_links(nodes.select("fingerprint")), spanning=True)
    placed = nodes.join(linked, nodes.fingerprint == linked.node, "left").select("fingerprint", "low", F.coalesce("component", "fingerprint").alias("family"))
    placed = cut(placed)
    lowest = placed.groupBy("family").agg(F.min("low").alias("component_id"))
    found = placed.join(lowest, "family").select("fingerprint", "component_id", "family")
    out = rows.join(found, "fingerprint")
    return out.select(F.col("_key").alias(key), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id", "family", "mark")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs``, as they are, that stay when one of each SimHash component does: the one with the smallest key.

    Of several rows with that key the one with the smallest text hash stays, and of rows that are equal in both, one.
    """
    found = cut(simhash_components(docs, key, text).select(F.col(key).alias("_key"), "family", "mark"))
    stay = found.groupBy("family").agg(F.min(F.struct(F.col("_key").isNull().alias("none"), "_key", "mark")).alias("best"))
    stay = stay.select(F.col("best._key").alias("_key"), F.col("best.mark").alias("_mark"))
    kept = docs.join(stay, docs[key].eqNullSafe(F.col("_key")) & (F.xxhash64(docs[text]) == F.col("_mark")), "left_semi")
    repeated = found.groupBy("_key", "mark").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    return kept.dropDuplicates([key, text]) if repeated else kept


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
