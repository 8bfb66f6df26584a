"""Substring dedup: prefix-partitioned suffix trees over words; deep internal nodes give the repeats.

Documents become chunks of some megabytes of numbered words, in a table bucketed by chunk, so that what is learnt about a chunk
comes back to it without moving the words again. Then

1. a filter drops most suffixes: of each window of words the smallest hash of its 7-word parts is kept, and a window goes on only
   if that value occurs in two documents, which holds for every window that occurs in two documents;
2. the suffixes left, cut at the window's length, are split by variable-length prefixes: the first prefix length at which no more
   than GROUP suffixes share the prefix's slot decides, so a frequent word or pair is split by what follows it;
3. each group is sorted; neighbours' common prefixes are the tree's internal nodes, and a node as deep as the window holds all
   documents that share it;
4. the smallest document of each deep node goes back to the chunks, which mark what the windows cover.
"""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, cut, slices, split_words

WINDOW, PART = 13, 7
#: Text bytes a chunk and a bucket of the chunk table, anchors a bucket of the filter, suffixes a group, prefix lengths tried, most
#: slots a prefix length has.
CHUNK_BYTES, TABLE_BYTES, BUCKET, GROUP, SLOTS = 8 << 20, 128 << 20, 1_000_000, 200_000, 1 << 22
DEPTHS = (1, 2, 3, 5, 8, WINDOW)

_MUL = np.uint64(0x9E3779B97F4A7C15)
#: Words are told apart by this.
DIGEST = xxhash.xxh3_128_digest


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _zip(a: np.ndarray | bytes, level: int = 1) -> bytes:
    return zstandard.compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes(), level)


def _unzip(b: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b), kind)


def _planes(a: np.ndarray) -> bytes:
    """Numbers byte plane by byte plane, so that the high bytes, which differ little, take little."""
    return _zip(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T)


def _unplaned(b: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(_unzip(b, "u1").reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def _steps(a: np.ndarray) -> bytes:
    """Sorted numbers, by their differences."""
    return _planes(np.diff(a, prepend=np.uint64(0)))


def _unstepped(b: bytes) -> np.ndarray:
    return np.cumsum(_unplaned(b, "<u8"), dtype=np.uint64)


def _drop(spark: SparkSession, name: str) -> None:
    if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
        spark.sql(f"drop table if exists {name}")


def chunk_table(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    """The words of all documents as chunks, in a table bucketed by chunk in the shared warehouse: (the table, its name)."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for a, b in slices(batch.column(1), CHUNK_BYTES):
                keys, texts = batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a)
                index, words, bounds = split_words(texts)
                flat = pc.binary_join(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), words.take(pa.array(index))), " ").cast(pa.binary())
                same = b"".join(xxhash.xxh3_128_digest(t) for t in flat.to_pylist())
                spelled = words.cast(pa.binary())
                ends = np.cumsum(pc.binary_length(spelled).to_numpy(zero_copy_only=False).astype(np.int64))
                known = keys.is_valid().to_numpy(zero_copy_only=False)
                cols = [[number], [b - a], [len(index)], [pc.fill_null(keys.cast(pa.int64()), 0).to_numpy().tobytes()], [known.tobytes()], [bounds.tobytes()], [same], [_planes(index.astype(np.uint32))], [_zip(b"".join(spelled.to_pylist()))], [_planes(ends)]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.binary()] * 7, strict=True)], names=["chunk", "n_docs", "n_words", "keys", "known", "bounds", "same", "words", "spelled", "ends"])
                number += 1

    spark = docs.sparkSession
    batches_of(spark, 10_000)  # a batch makes a chunk or more
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    made = rows.mapInArrow(chunked, "chunk long, n_docs long, n_words long, keys binary, known binary, bounds binary, same binary, words binary, spelled binary, ends binary")
    name = f"orrery_words_{uuid.uuid4().hex}"
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text))), F.lit(0))).first()[0]
    made.write.bucketBy(max(int(spark.conf.get("spark.sql.shuffle.partitions")), size // TABLE_BYTES), "chunk").saveAsTable(name)
    atexit.register(_drop, spark, name)
    place = spark._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/" + name)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.table(name), name


class Chunk:
    """One chunk in memory: the number of each word, the words, where documents begin and end."""

    def __init__(self, row):
        self.chunk, self.keys, self.known = row.chunk, np.frombuffer(row.keys, np.int64), np.frombuffer(row.known, bool)
        self.bounds, self.same = np.frombuffer(row.bounds, np.int64), row.same
        self.index = _unplaned(row.words, "<u4")
        self.spelled, self.ends = zstandard.decompress(row.spelled), _unplaned(row.ends, "<i8")

    def words(self) -> list[bytes]:
        ends = self.ends.tolist()
        return [self.spelled[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def digests(self) -> np.ndarray:
        """128-bit hashes of the distinct words, as two rows of 64 bits."""
        return np.frombuffer(b"".join(map(DIGEST, self.words())), ">u8").astype(np.uint64).reshape(-1, 2).T

    def hashes(self, digests: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word in place."""
        return digests[0][self.index] if digests.size else np.zeros(0, np.uint64)

    def windows(self, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(first word, document) of every window of documents with a key, but for those to ``skip``."""
        size = np.diff(self.bounds)
        n = np.where(self.known, np.maximum(size - WINDOW + 1, 0), 0)
        if skip is not None:
            n[skip] = 0
        doc = np.repeat(np.arange(len(n)), n)
        return np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + self.bounds[:-1][doc], doc

    def anchors(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Of each window, the smallest hash of its PART-word parts: the upper 48 bits, the last of these cleared."""
        if not len(first):
            return np.zeros(0, np.uint64)
        n = len(hashes) - PART + 1
        g = np.zeros(n, np.uint64)
        for k in range(PART):
            g = g * _MUL + hashes[k : k + n]
        g = _mixed(g)
        low = g[: len(g) - (WINDOW - PART)].copy()
        for k in range(1, WINDOW - PART + 1):
            np.minimum(low, g[k : k + len(low)], out=low)
        return low[first] >> np.uint64(16) & ~np.uint64(1)


def _anchors(buckets: int):
    def out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for row in p.itertuples(index=False):
                c = Chunk(row)
                first, doc = c.windows()
                a = c.anchors(c.hashes(c.digests()), first)
                if not len(a):
                    continue
                new = np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])])
                a, key = a[new], c.keys[doc[new]]
                by = np.argsort(a, kind="stable")
                a, key = a[by], key[by]
                at = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                several = np.minimum.reduceat(key, at) != np.maximum.reduceat(key, at)
                a = a[at] | several.astype(np.uint64)
                bucket = ((a >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(a)]])
                yield pd.DataFrame({"bucket": bucket[cuts[:-1]], "chunk": row.chunk, "anchors": [_steps(a[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]})

    return out


def _shared(p: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket's anchors, those of two or more documents, back to each chunk that has them."""
    parts = [_unstepped(b) for b in p["anchors"]]
    a, row = np.concatenate(parts), np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    value = a & ~np.uint64(1)
    by = np.argsort(value, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], value[by][1:] != value[by][:-1]]))
    size = np.diff(np.concatenate([at, [len(a)]]))
    # Chunks hold different documents, but a repeated key may stand in two: such an anchor is let through for nothing.
    good = (size > 1) | (np.bitwise_or.reduceat(a[by], at) & np.uint64(1)).astype(bool)
    kept = np.zeros(len(a), bool)
    kept[by] = np.repeat(good, size)
    value, row = value[kept], row[kept]
    cuts = np.searchsorted(row, np.arange(len(p) + 1))
    out = [(c, _steps(value[x:y])) for c, x, y in zip(p["chunk"], cuts[:-1], cuts[1:], strict=True) if y > x]
    return pd.DataFrame(out, columns=["chunk", "anchors"])


def _runs(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """The runs of a chunk's windows that passed the filter: their words by number, digests of these, documents and places."""
    none = pd.DataFrame({"chunk": [], "n": [], "words": [], "digests": [], "runs": []})
    if not len(left):
        return none
    c = Chunk(next(left.itertuples(index=False)))
    shared = [b for b in right["anchors"] if b is not None]
    copies = [b for b in right["copies"] if b is not None]
    skip = np.concatenate([np.frombuffer(b, np.int64) for b in copies]) if copies else None
    first, doc = c.windows(skip)
    digests = c.digests()
    a = c.anchors(c.hashes(digests), first)
    if not shared or not len(a):
        return none
    wanted = np.sort(np.concatenate([_unstepped(b) for b in shared]))
    new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    place = np.minimum(np.searchsorted(wanted, a[new]), len(wanted) - 1)
    hit = np.repeat(wanted[place] == a[new], np.diff(np.concatenate([new, [len(a)]])))
    first, doc = first[hit], doc[hit]
    if not len(first):
        return none
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(first) != 1) | (np.diff(doc) != 0)]))
    size = np.diff(np.concatenate([begin, [len(first)]]))
    n = size + WINDOW - 1
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[begin], n)
    used, words = np.unique(c.index[at], return_inverse=True)
    runs = np.stack([doc[begin], first[begin] - c.bounds[:-1][doc[begin]], size, c.keys[doc[begin]]])
    return pd.DataFrame({"chunk": [c.chunk], "n": [len(first)], "words": [_planes(words.astype(np.uint32))], "digests": [digests[:, used].tobytes()], "runs": [_zip(runs.astype(np.int64))]})


def _suffixes(row) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The windows of a chunk's runs: (codes of each different window, its check, its smallest key, window of each place, run table).

    A word's code are 16 bits of its digest; a window's check are 64 bits made of the digests' other halves, so windows that differ
    agree in both with probability 2 ** -80 at most."""
    words, runs = _unplaned(row.words, "<u4"), _unzip(row.runs, "<i8").reshape(4, -1)
    digests = np.frombuffer(row.digests, np.uint64).reshape(2, -1)
    n = runs[2]
    run = np.repeat(np.arange(len(n)), n)
    start = np.arange(len(run)) + run * (WINDOW - 1)
    other = digests[1][words]
    check = np.zeros(len(start), np.uint64)
    for k in range(WINDOW):
        check = check * _MUL + other[start + k]
    check = _mixed(check)
    codes = (digests[0] >> np.uint64(48)).astype(np.uint16)[words]
    _, first, which = np.unique(check, return_index=True, return_inverse=True)
    if any((codes[start + k] != codes[(start + k)[first]][which]).any() for k in range(WINDOW)):  # two windows share a check: go by all there is
        _, first, which = np.unique(np.column_stack([check, *(codes[start + k] for k in range(WINDOW))]), axis=0, return_index=True, return_inverse=True)
    order = np.argsort(first)  # numbered as they come, so that neighbours, much alike, are packed together
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    first, which = first[order], rank[which]
    low = np.full(len(first), np.iinfo(np.int64).max)
    np.minimum.at(low, which, runs[3][run])
    return np.stack([codes[start[first] + k] for k in range(WINDOW)], axis=1), check[first], low, which, runs


def _slots(suffixes: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each suffix's prefix at each of DEPTHS, numbered across depths."""
    h, out = np.zeros(len(suffixes), np.uint64), []
    for d in range(1, WINDOW + 1):
        h = h * _MUL + suffixes[:, d - 1].astype(np.uint64) + np.uint64(d)
        if d in DEPTHS:
            out.append((_mixed(h) % np.uint64(slots)).astype(np.int64) + len(out) * slots)
    return np.stack(out)


def _prefix_counts(slots: int):
    def out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for row in p.itertuples(index=False):
                slot, n = np.unique(_slots(_suffixes(row)[0], slots), return_counts=True)
                yield pd.DataFrame({"slot": slot, "n": n})

    return out


def _to_groups(slots: int, heavy):
    def out(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        full = np.zeros(-(-slots * len(DEPTHS) // 8) * 8, bool)
        full[: len(heavy.value) * 8] = np.unpackbits(heavy.value)
        full[slots * (len(DEPTHS) - 1) :] = False  # whole windows are not split further
        for p in batches:
            for row in p.itertuples(index=False):
                suffixes, check, low, _, _ = _suffixes(row)
                at = _slots(suffixes, slots)
                group = at[(~full[at]).argmax(axis=0), np.arange(len(suffixes))]
                by = np.argsort(group, kind="stable")
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(group[by])) + 1, [len(by)]])
                parts = [by[x:y] for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pd.DataFrame({
                    "group": group[by][cuts[:-1]], "chunk": row.chunk,
                    "suffixes": [_zip(suffixes[i], 3) for i in parts], "check": [check[i].tobytes() for i in parts], "low": [_planes(low[i]) for i in parts], "number": [_planes(i.astype(np.int32)) for i in parts],
                })

    return out


def common_prefixes(s: np.ndarray) -> np.ndarray:
    """Words that each row of a sorted matrix shares with the row before it: the depths of a suffix tree's internal nodes."""
    return np.concatenate([[0], np.logical_and.accumulate(s[1:] == s[:-1], axis=1).sum(axis=1)]) if len(s) else np.zeros(0, np.int64)


def _deep_nodes(p: pd.DataFrame) -> pd.DataFrame:
    """The subtree of one prefix group; for each chunk, the windows below a deep node and the node's smallest key, if that is another's."""
    parts = [_unzip(b, "<u2").reshape(-1, WINDOW) for b in p["suffixes"]]
    s = np.concatenate(parts)
    row = np.repeat(np.arange(len(parts)), [len(x) for x in parts])
    low, number = (np.concatenate([_unplaned(b, t) for b in p[c]]) for c, t in (("low", "<i8"), ("number", "<i4")))
    check = np.frombuffer(b"".join(p["check"]), np.uint64)
    wide = np.zeros((len(s), 4 * (-(-WINDOW // 4))), np.uint64)  # four codes a sort key
    wide[:, :WINDOW] = s
    keys = [wide[:, k] << np.uint64(48) | wide[:, k + 1] << np.uint64(32) | wide[:, k + 2] << np.uint64(16) | wide[:, k + 3] for k in range(0, wide.shape[1], 4)]
    by = np.lexsort([check, *keys[::-1]])
    node = np.cumsum((common_prefixes(s[by]) < WINDOW) | (np.diff(check[by], prepend=check[by[:1]]) != 0)) - 1
    least = np.full(node[-1] + 1 if len(node) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, node, low[by])
    of = np.empty(len(s), np.int64)
    of[by] = least[node]
    less = of < low
    at = np.searchsorted(row[less], np.arange(len(parts) + 1))
    number, of = number[less], of[less]
    out = [(c, _zip(number[x:y]), _zip(of[x:y])) for c, x, y in zip(p["chunk"], at[:-1], at[1:], strict=True) if y > x]
    return pd.DataFrame(out, columns=["chunk", "number", "least"])


def _covered(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Per chunk, the spans (document, first word, end) covered by windows that also start in a smaller document."""
    if not len(left):
        return pd.DataFrame({"chunk": [], "spans": []})
    row = next(left.itertuples(index=False))
    _, _, low, which, runs = _suffixes(row)
    least = low.copy()
    for number, of in zip(right["number"], right["least"], strict=True):
        i = _unzip(number, "<i4")
        least[i] = np.minimum(least[i], _unzip(of, "<i8"))
    run = np.repeat(np.arange(runs.shape[1]), runs[2])
    start = np.arange(len(run)) - np.repeat(np.cumsum(runs[2]) - runs[2], runs[2]) + runs[1][run]
    hit = least[which] < runs[3][run]
    doc, start = runs[0][run][hit], start[hit]
    if not len(doc):
        return pd.DataFrame({"chunk": [], "spans": []})
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(start) > WINDOW)])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(doc) - 1]])
    return pd.DataFrame({"chunk": [row.chunk], "spans": [_zip(np.stack([doc[new], start[new], start[last] + WINDOW]))]})


def _rest(k: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Per document what is left of it."""
    out = []
    for row in left.itertuples(index=False):
        c = Chunk(row)
        gone = np.zeros(len(c.index) + 1, np.int64)
        spans = [_unzip(b, "<i8").reshape(3, -1) for b in right["spans"] if b is not None]
        copies = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(b, np.int64) for b in right["copies"] if b is not None]]).astype(np.int64)
        doc, a, b = (np.concatenate([*[s[i] for s in spans], copies if i == 0 else np.zeros(len(copies), np.int64) if i == 1 else np.diff(c.bounds)[copies]]).astype(np.int64) for i in range(3))
        np.add.at(gone, c.bounds[doc] + a, 1)
        np.add.at(gone, c.bounds[doc] + b, -1)
        keep = np.cumsum(gone)[:-1] == 0
        kept = np.concatenate([[0], np.cumsum(keep)])[c.bounds]
        words = pa.array(c.words(), pa.binary()).take(pa.array(c.index[keep]))
        flat = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept, pa.int32()), words.cast(pa.string())), " ")
        by = np.lexsort((a, doc))
        doc, a, b = doc[by], a[by], b[by]
        at = np.searchsorted(doc, np.arange(len(c.keys) + 1))
        out.append(pd.DataFrame({
            "_key": pd.array(np.where(c.known, c.keys, 0), "Int64"), "n_words": np.diff(c.bounds), "n_removed": np.diff(c.bounds) - np.diff(kept),
            "kept": flat.to_pandas(), "removed": [[{"start": int(x), "end": int(y)} for x, y in zip(a[i:j], b[i:j], strict=True)] for i, j in zip(at[:-1], at[1:], strict=True)],
        }))
        out[-1].loc[~c.known, "_key"] = pd.NA
    return pd.concat(out) if out else pd.DataFrame({"_key": [], "n_words": [], "n_removed": [], "kept": [], "removed": []})


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept, removed), one row per input row.

    Words are runs of other characters than ASCII white space. A window is WINDOW consecutive words of one document; a word goes if
    a window that covers it has a word sequence that also starts in a document with a smaller key, in the input as it is. ``kept``
    is what is left, joined by single spaces; ``removed`` are the word ranges that went. Whole documents with the words of a smaller
    one go by a comparison of 128-bit digests, without entering the trees. Words are told apart by 128-bit digests: 64 bits in the
    filter, which only lets windows through, 16 in the trees, and the other 64 where a deep node is told from one that looks alike.
    Two windows are taken for equal by mistake with probability 2 ** -80 a pair at most.

    Null and empty texts have no words. Rows with a null key neither lose words nor make others lose any. Rows with the same key
    are one document in this: neither makes the other lose words. An empty table gives an empty result. Other columns are not
    looked at, whatever their names. Keys are whole numbers.
    """
    spark = docs.sparkSession
    chunks, _ = chunk_table(docs, key, text)
    total = chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    buckets = max(16, total // (4 * BUCKET))
    anchors = chunks.mapInPandas(_anchors(buckets), "bucket long, chunk long, anchors binary")
    shared = anchors.groupBy("bucket").applyInPandas(_shared, "chunk long, anchors binary")

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for row in p.itertuples(index=False):
                keys, size = np.frombuffer(row.keys, np.int64), np.diff(np.frombuffer(row.bounds, np.int64))
                good = np.flatnonzero((size >= WINDOW) & np.frombuffer(row.known, bool))
                yield pd.DataFrame({"chunk": row.chunk, "doc": good, "key": keys[good], "same": [row.same[16 * i : 16 * i + 16] for i in good.tolist()]})

    whole = cut(chunks.select("chunk", "keys", "known", "bounds", "same").mapInPandas(listed, "chunk long, doc long, key long, same binary"))
    lowest = cut(whole.groupBy("same").agg(F.min("key").alias("least"), F.count("*").alias("n")).where("n > 1"))  # so that Spark may split the join
    twins = whole.join(lowest, "same").where("least < key").select("chunk", "doc")

    def collected(p: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": p["chunk"].iloc[:1], "copies": [np.sort(p["doc"].to_numpy(np.int64)).tobytes()]})

    twins = cut(twins.groupBy("chunk").applyInPandas(collected, "chunk long, copies binary"))
    said = shared.unionByName(twins, allowMissingColumns=True)
    runs = cut(chunks.groupBy("chunk").cogroup(said.groupBy("chunk")).applyInPandas(_runs, "chunk long, n long, words binary, digests binary, runs binary"))

    left = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slots = min(SLOTS, 1 << max(4, int(2 * left // GROUP).bit_length()))  # groups less than half full on average
    counted = runs.mapInPandas(_prefix_counts(slots), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # At most left / GROUP slots of each prefix length are heavy; a bit for each slot is broadcast, three megabytes at the most.
    heavy = np.zeros(slots * len(DEPTHS), bool)
    heavy[counted.where(F.col("n") > GROUP).select("slot").toPandas()["slot"].to_numpy(np.int64)] = True
    heavy = spark.sparkContext.broadcast(np.packbits(heavy))
    grouped = runs.mapInPandas(_to_groups(slots, heavy), "group long, chunk long, suffixes binary, check binary, low binary, number binary")
    nodes = grouped.groupBy("group").applyInPandas(_deep_nodes, "chunk long, number binary, least binary")
    spans = runs.groupBy("chunk").cogroup(nodes.groupBy("chunk")).applyInPandas(_covered, "chunk long, spans binary")
    final = spans.unionByName(twins, allowMissingColumns=True)
    schema = "_key long, n_words long, n_removed long, kept string, removed array<struct<start:long,end:long>>"
    out = chunks.groupBy("chunk").cogroup(final.groupBy("chunk")).applyInPandas(_rest, schema)
    return out.withColumnRenamed("_key", key)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = without_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP5_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
s AS (SELECT *, list(word) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS s FROM x),
m AS (SELECT s, min(doc_id) AS low FROM s WHERE len(s) = {WINDOW} GROUP BY s),
h AS (SELECT s.r, i, word, coalesce(low < doc_id, false) AS hit FROM s LEFT JOIN m ON s.s = m.s),
g AS (SELECT *, bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS gone FROM h),
k AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS gone, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept FROM g GROUP BY r)
SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (r)
"""
