"""Best-fit packing: a configuration linear program over the length histogram, priced by knapsack dynamic programming, then rounded."""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from pathlib import Path
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches_of, before, copies, cut, per_process, slices, split_words, with_columns

CAPACITY, END_ID = 2048, 0
#: Words whose ids a task keeps; it forgets all and starts anew beyond.
KEPT_WORDS = 600_000
#: Pieces of one length that one window ranks, about.
CHUNK = 100_000
#: The program: rounds of pricing, steps of the weights a round and their force, gap to the bound that ends it.
PRICINGS, STEPS, FORCE, GAP = 60, 400, 0.3, 5e-4
#: How often a round raises prices that leave room before it takes the bound.
RAISES = 3
#: Pieces of a scaled histogram that best fit packs.
ITEMS = 50_000


def stems(words: pa.Array, special: str) -> tuple[pa.Array, pa.Array]:
    """Words cut in two where that can't change their ids, so that fewer are left: Latin-1 words lower-cased, a run of ASCII
    punctuation at the end apart. The tokenizer lower-cases, and it splits between a letter or digit and such a run. Words that
    match ``special`` stay as they are."""
    plain = pc.match_substring_regex(words, r"^[\x00-\x{FF}]*$")
    if special:
        plain = pc.and_not(plain, pc.match_substring_regex(words, special))
    low = pc.if_else(plain, pc.utf8_lower(words), words)
    stem = pc.utf8_rtrim(low, characters=string.punctuation)
    good = pc.and_(plain, pc.match_substring_regex(stem, r"[\p{L}\p{N}]$"))
    tail = pc.struct_field(pc.extract_regex(low, f"(?s)(?P<tail>[{re.escape(string.punctuation)}]*)$"), "tail")
    return pc.if_else(good, stem, low), pc.if_else(good, tail, "")


def _gathered(ids: np.ndarray, starts: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs [starts[i], starts[i + 1]) of ids for each i of ``at``, in a row, and where each ends."""
    sizes = starts[at + 1] - starts[at]
    ends = np.cumsum(sizes)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - (ends - sizes), sizes)], ends


class WordIds:
    """Token ids of white-space separated text by way of its distinct words.

    Exact for tokenizers whose pre-tokenizer drops white space and never spans it. Only the six ASCII kinds are split on here;
    any other is left to the tokenizer, inside the word. New words are encoded many at once, with a mark between them that is
    one token of its own; words that hold the mark are encoded alone.
    """

    MARK = "\x01"

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads here
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.mark = self._ids(self.MARK)
        self.special = "|".join(re.escape(t["content"]) for t in json.loads(definition).get("added_tokens", []))
        self.forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.starts = np.zeros(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        plain = [w for w in words if self.MARK not in w] if len(self.mark) == 1 else []
        joined = [f" {self.MARK} ".join(plain[i : i + 2048]) for i in range(0, len(plain), 2048)]
        got = [np.array(e.ids + self.mark, np.uint32) for e in self.tokenizer.encode_batch_fast(joined, add_special_tokens=False)]
        flat = np.concatenate([*got, np.zeros(0, np.uint32)])
        is_mark = flat == self.mark[0] if plain else np.zeros(0, bool)
        sizes = np.diff(np.flatnonzero(is_mark), prepend=-1) - 1
        alone = [self._ids(w) for w in words if len(self.mark) != 1 or self.MARK in w]
        self.ids = np.concatenate([self.ids, flat[~is_mark], np.fromiter((i for g in alone for i in g), np.uint32)])
        sizes = np.concatenate([sizes, np.fromiter(map(len, alone), np.int64, len(alone))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
        for w in plain + [w for w in words if len(self.mark) != 1 or self.MARK in w]:
            self.place[w] = len(self.place)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds of each text)."""
        index, distinct, bounds = split_words(texts)
        stem, tail = (x.dictionary_encode() for x in stems(distinct, self.special))
        if len(self.place) > KEPT_WORDS:
            self.forget()
        at = np.empty(2 * len(distinct), np.int64)  # stem and tail by turns
        for i, part in enumerate((stem, tail)):
            words = part.dictionary.to_pylist()
            if new := [w for w in words if w not in self.place]:
                self._learn(new)
            at[i::2] = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))[part.indices.to_numpy()]
        ids, ends = _gathered(self.ids, self.starts, at)
        flat, ends = _gathered(ids, np.concatenate([[0], ends[1::2]]), index)
        return flat, np.concatenate([[0], ends])[bounds]


def cut_pieces(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(key as ``_key``, piece, start, length, ids_crc32): each document's ids and END_ID, cut only where longer than ``capacity``.

    ``tokenizer`` is the path of a ``tokenizers`` file on the driver; its content travels to the executors.
    """
    batches_of(docs.sparkSession, 4000, 8)  # the more words at once, the fewer to encode
    definition = docs.sparkSession.sparkContext.broadcast(Path(tokenizer).read_text())

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = per_process(hashlib.sha256(definition.value.encode()).hexdigest(), lambda: WordIds(definition.value))
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for a, b in slices(texts, 4 << 20):
                flat, bounds = words.encode(texts.slice(a, b - a))
                owner, out = [], []
                for k in range(b - a):
                    ids = np.append(flat[bounds[k] : bounds[k + 1]], np.uint32(END_ID)).astype("<u4")
                    for i, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        owner.append(a + k)
                        out.append((i, start, len(part), zlib.crc32(part)))
                piece, start, length, crc = (np.array(c, np.int64) for c in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner)), pa.array(piece.astype(np.int32)), start, length, crc], names=["_key", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(pieces, f"_key {kind}, piece int, start long, length long, ids_crc32 long")


def _price(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best value of each capacity and the length to take there (-1: leave the last place empty)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if n := upto[c]:
            v = prices[:n] + best[c - lengths[:n]]
            i = int(v.argmax())
            if v[i] > best[c]:
                best[c], take[c] = v[i], i
    return best, take


Configs = list[tuple[list[int], int]]


def _count(configs: Configs) -> int:
    return sum(k for _, k in configs)


def _through(i: int | None, lengths: np.ndarray, take: np.ndarray, capacity: int) -> Counter:
    """The best configuration that a knapsack table gives, with length ``i`` in it: how often each length occurs."""
    config, c = Counter(), capacity
    if i is not None:
        config[i], c = 1, capacity - int(lengths[i])
    while c > 0:
        if (t := int(take[c])) < 0:
            c -= 1
        else:
            config[t] += 1
            c -= int(lengths[t])
    return config


Column = tuple[tuple[int, int], ...]


class Program(NamedTuple):
    """A solved configuration program: lengths, columns as (place among the lengths, how often), x of each, what x and the pieces it
    leaves uncovered cost, a lower bound of any solution, how often columns were priced."""

    lengths: list[int]
    columns: list[Column]
    x: np.ndarray
    cost: float
    bound: float
    pricings: int


def configurations(histogram: dict[int, int], capacity: int = CAPACITY) -> Configs:
    """Fillings of sequences, as (lengths, how many sequences alike), that hold just the pieces of ``histogram`` (length to count).

    The configuration program, least sum of x with every length covered, is solved by multiplicative weights with knapsack pricing
    (``fractional``), at any number of lengths, and rounded: columns are taken whole numbers of times, the most used first,
    x times, rounded down after a share of the gap, at most as what is left of their lengths allows. What that leaves, some pieces a
    column whatever the corpus, goes by best fit, decreasing. Work depends on ``capacity`` and on the logarithm of counts, not on the number of documents.
    """
    histogram = {n: k for n, k in histogram.items() if 0 < n <= capacity and k > 0}
    if not histogram:
        return []
    program = fractional(histogram, capacity)
    rest, out = dict(histogram), []
    for k in np.argsort(-program.x, kind="stable").tolist():
        column = [(program.lengths[i], n) for i, n in program.columns[k]]
        times = min(int(program.x[k] * (1 + 4 * GAP) + 1e-6), *(rest[length] // n for length, n in column))
        if times > 0:
            out.append(([length for length, n in column for _ in range(n)], times))
            for length, n in column:
                rest[length] -= n * times
    return out + _scaled_best_fit({n: k for n, k in rest.items() if k}, capacity)


def fractional(histogram: dict[int, int], capacity: int) -> Program:
    """Solves the configuration program by multiplicative weights, both sides: a length's price grows by a factor while it is not
    covered, a column's x grows by one while the prices of its pieces come to more than the one sequence it costs. Each step looks
    ahead (it is taken with the forces found where it would lead) and forces are cut to one, so that rare lengths don't drive it.

    A round moves the weights over the columns so far, a sparse matrix. Then a knapsack over the mean prices finds the best
    configuration through each length. Those worth more than a sequence become columns. A price divided by the worth of the best
    configuration through its length makes prices that no configuration beats, so they bound the program from below; lengths whose
    configurations leave room are raised, to bound it better. The rounds end as that bound is met but for GAP, or rounded up, or after PRICINGS. The first columns come from best fit, of the scaled histogram.
    """
    lengths = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[n] for n in lengths.tolist()], float)
    at = {n: i for i, n in enumerate(lengths.tolist())}
    found: dict[Column, float] = {((i, capacity // n),): 0.0 for n, i in at.items()}  # these cover every length
    for config, k in _scaled_best_fit(histogram, capacity):
        column = tuple(sorted(Counter(at[n] for n in config).items()))
        found[column] = found.get(column, 0.0) + k
    enough = lambda bound: max(bound * (1 + GAP), np.ceil(bound - 1e-9))  # noqa: E731  no filling has fewer sequences than the bound, rounded up
    y, dearest = lengths / capacity, 1 / (capacity // lengths)  # no length is worth more than its share of a sequence for itself
    bound, best = float(lengths @ demand) / capacity, None
    for pricing in range(1, PRICINGS + 1):
        columns, x = list(found), np.fromiter(found.values(), float, len(found))
        j = np.repeat(np.arange(len(columns)), [len(c) for c in columns])
        i, n = np.array([p for c in columns for p in c], np.int64).T
        covered = lambda x: np.bincount(i, n * x[j], len(lengths))  # noqa: B023, E731
        worth = lambda y: np.bincount(j, n * y[i], len(columns))  # noqa: B023, E731
        most = np.maximum.reduceat(demand[i] / n, np.flatnonzero(np.diff(j, prepend=-1)))
        x = np.maximum(x, 1e-3 * bound / len(columns))
        mean_x, mean_y, weight = np.zeros_like(x), np.zeros_like(y), 0.0
        for step in range(STEPS):
            force = FORCE / np.sqrt(1 + step / 20)
            grown = lambda v, by: v * np.exp(force * np.clip(by, -1, 1))  # noqa: B023, E731
            ahead_x, ahead_y = grown(x, worth(y) - 1), grown(y, 1 - covered(x) / demand)
            x = np.clip(grown(x, worth(ahead_y) - 1), 1e-6, most)
            y = np.clip(grown(y, 1 - covered(ahead_x) / demand), 1e-6, dearest)
            if step >= STEPS // 2:
                mean_x, mean_y, weight = mean_x + force * ahead_x, mean_y + force * ahead_y, weight + force
        mean_x, mean_y = mean_x / weight, mean_y / weight
        cost = float(mean_x.sum() + (np.maximum(0, demand - covered(mean_x)) / (capacity // lengths)).sum())
        value, take = _price(lengths, mean_y, capacity)
        for again in range(1 + RAISES):
            if again:
                room = np.maximum(0, 1 - fair - _price(lengths, fair, capacity)[0][capacity - lengths])
                raised = np.minimum(dearest, fair * (1 + room))
                fair = raised / np.maximum(1, raised + _price(lengths, raised, capacity)[0][capacity - lengths])
            else:
                fair = mean_y / np.maximum(1, mean_y + value[capacity - lengths])
            bound = max(bound, float(fair @ demand))
            if cost <= enough(bound):
                break
        if best is None or cost < best.cost:
            best = Program(lengths.tolist(), columns, mean_x, cost, bound, pricing)
        best = best._replace(bound=bound, pricings=pricing)
        if best.cost <= enough(bound):
            break
        keep = np.ones(len(columns), bool)
        if len(columns) > 6 * len(lengths):  # forget what is neither used nor near the prices; the program only needs a column for each length
            keep = (mean_x > 1e-6 * mean_x.max()) | (worth(mean_y) > 0.97) | (np.bincount(j) == 1)
        found = {c: v for c, v, k in zip(columns, mean_x.tolist(), keep.tolist(), strict=True) if k}
        for k in [None, *range(len(lengths))]:
            config = _through(k, lengths, take, capacity)
            if sum(mean_y[p] * times for p, times in config.items()) > 1 + GAP / 10:
                found.setdefault(tuple(sorted(config.items())), 0.0)
        y = fair
    return best


def _scaled_best_fit(histogram: dict[int, int], capacity: int) -> Configs:
    scale = max(1, sum(histogram.values()) // ITEMS)
    whole = {n: k // scale for n, k in histogram.items()}
    return [(c, k * scale) for c, k in _best_fit(whole, capacity)] + _best_fit({n: k - whole[n] * scale for n, k in histogram.items()}, capacity)


def _best_fit(histogram: dict[int, int], capacity: int) -> Configs:
    room: dict[int, list[list[int]]] = {}
    spaces: list[int] = []  # sorted keys of room
    for n in sorted(histogram, reverse=True):
        for _ in range(histogram[n]):
            i = bisect_left(spaces, n)
            if i < len(spaces):
                space = spaces[i]
                held = room[space].pop()
                if not room[space]:
                    del room[space], spaces[i]
            else:
                space, held = capacity, []
            held.append(n)
            space -= n
            if space not in room:
                room[space] = []
                spaces.insert(bisect_left(spaces, space), space)
            room[space].append(held)
    alike = Counter(tuple(h) for held in room.values() for h in held)
    return [(list(c), k) for c, k in alike.items()]


def _places(configs: Configs, capacity: int) -> dict[str, np.ndarray]:
    """The configurations as a table that maps the rank of a piece among those of its length to a sequence and an offset."""
    rows, used, sequence = [], Counter(), 0
    for config, times in configs:
        offset = 0
        for n, m in sorted(Counter(config).items(), reverse=True):
            rows.append((n, used[n], sequence, m, offset))
            used[n] += m * times
            offset += n * m
        sequence += times
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "sequence", "times", "offset"), cols, strict=True))


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Packs all documents into few sequences of at most ``capacity`` tokens, one row per piece: (key, piece, start, length,
    ids_crc32, sequence_id, offset).

    A document is its token ids and END_ID; null and empty texts are END_ID alone. Pieces lie in their sequence without gaps,
    from offset 0. Only the histogram of lengths, at most ``capacity`` numbers, reaches the driver, and the table of
    configurations that comes back does not grow with the corpus but for its logarithm. Null keys and repeated rows are packed
    like any others. An empty table gives an empty result. Other columns are not looked at, whatever their names.
    """
    pieces = cut(cut_pieces(docs, tokenizer, key, text, capacity))
    histogram = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(_places(configurations(histogram, capacity), capacity))

    def make():
        t = table.value
        starts = t["length"] * (1 << 44) + t["rank"]

        def placed(length: pa.Array, rank: pa.Array) -> list[pa.Array]:
            n, r = length.to_numpy(), rank.to_numpy()
            i = np.searchsorted(starts, n * (1 << 44) + r, side="right") - 1
            along = r - t["rank"][i]
            return [pa.array(t["sequence"][i] + along // t["times"][i]), pa.array(t["offset"][i] + along % t["times"][i] * n)]

        return placed

    chunk = F.pmod(F.xxhash64("_key", "piece", "ids_crc32"), F.lit(max(16, max(histogram.values(), default=0) // CHUNK)))
    alike = pieces.groupBy(*pieces.columns).agg(F.count(F.lit(1)).alias("_n")).withColumn("_chunk", chunk)  # repeated rows are one, with a count
    ranked = copies(before(alike, ["length"], "_chunk", ["_key", "piece", "ids_crc32", "start"], "_n", "_first"), "_n", "_i")
    ranked = ranked.select("_key", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.col("_i")).cast("long").alias("_rank"))
    out = with_columns(ranked, ["length", "_rank"], "sequence_id long, offset long", make)
    return out.select(F.col("_key").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
