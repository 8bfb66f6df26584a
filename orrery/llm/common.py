"""Building blocks shared by the operators: shared tables, gapless ranks without a hot window, connected components."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import cut, shared_dir

__all__ = ["WORD", "batches_of", "before", "components", "copies", "cut", "forest", "per_process", "shared_dir", "slices", "split_words", "with_columns"]

#: A word is a longest run of characters other than these; ``bytes.split()`` and Java's ``[\x20\x09-\x0D]`` agree on them.
WORD = r"[^\x20\x09-\x0D]+"


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The words of all texts of a batch, in order: (indices into the distinct words, the distinct words, bounds of each text).

    Words are split at the six ASCII kinds of white space, as by WORD. Null texts have none.
    """
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    bounds, flat = lists.offsets.to_numpy().astype(np.int64), lists.values
    there = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    if not there.all():  # the empty string before leading or behind trailing white space
        bounds = np.concatenate([[0], np.cumsum(there)])[bounds]
        flat = flat.filter(pa.array(there))
    encoded = flat.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary, bounds - bounds[0]


def per_process(key: str, make):
    """What ``make`` returned when this Python worker first asked for ``key``: workers outlive tasks, our modules there don't."""
    held = sys.modules.setdefault("_orrery_per_process", types.SimpleNamespace(held={})).held
    if key not in held:
        held[key] = make()
    return held[key]


def slices(texts: pa.Array, most_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold about ``most_bytes`` of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if held + n > most_bytes and i > start:
            yield start, i
            start, held = i, 0
        held += n
    if len(sizes):
        yield start, len(sizes)


def batches_of(spark: SparkSession, rows: int, megabytes: int = 16) -> None:
    """Sets how many rows, and megabytes, go to Python at once in this session. Texts are some kilobytes each and packed tiles or
    chunks some megabytes, and a batch lies in memory about four times: in the JVM's Arrow buffers both ways (outside the heap, and
    kept for later use) and in the worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def with_columns(df: DataFrame, inputs: Sequence[str], fields: str, make: Callable[[], Callable[..., list[pa.Array]]], most_bytes: int = 4 << 20) -> DataFrame:
    """``df`` with more columns (a DDL list), computed batch by batch: ``make()`` runs once a task and gives a function from the
    Arrow arrays of the ``inputs`` to those of the new columns. Batches are cut so that the first input holds about ``most_bytes``.

    A scan without a shuffle. Other columns pass through untouched, but for those called as new ones (case apart), which these
    replace; all operators of this kind share one pool of Python workers.
    """
    at = [df.columns.index(c) for c in inputs]
    new = T.StructType.fromDDL(fields)
    names = [f"c{i}" for i in range(len(df.columns) + len(new))]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in zip(names, [*df.schema, *new], strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fun = make()
        for batch in batches:
            first = batch.column(at[0])
            sized = slices(first, most_bytes) if pa.types.is_string(first.type) or pa.types.is_binary(first.type) else [(0, len(first))]
            for a, b in sized:
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, *fun(*[part.column(i) for i in at])], names=names)

    out = df.toDF(*names[: len(df.columns)]).mapInArrow(run, schema)
    taken = {n.lower() for n in new.names}
    kept = [(c, n) for c, n in zip(names, df.columns, strict=False) if n.lower() not in taken]
    return out.select(*[F.col(c).alias(n) for c, n in [*kept, *zip(names[len(df.columns) :], new.names, strict=True)]])


def before(df: DataFrame, group: Sequence[str], chunk: str, order: Sequence[str | Column], amount: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` over the rows of the same ``group`` that stand before, in order of (``chunk``, ``order``).

    ``chunk`` must be monotone in the wanted order and spread each group evenly, e.g. the leading bits of a hash that ``order``
    starts with. Then no task sorts more than one chunk of one group: a group with a third of all rows is as cheap as any other.
    Group and chunk columns must not be null.
    """
    keys = [*group, chunk]
    sums = df.groupBy(*keys).agg(F.sum(amount).alias("_sum"))
    prior = Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, F.coalesce(F.sum("_sum").over(prior), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inner = df.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return inner.join(starts, keys).withColumn(name, F.col("_start") + F.col("_within")).drop("_start", "_within")


def copies(df: DataFrame, count: str, name: str, step: int = 100_000) -> DataFrame:
    """``df`` with each row as often as ``count`` says, numbered from 0 in ``name``; no row holds more than ``step`` numbers at once."""
    runs = df.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1, F.lit(step).cast("long"))))
    return runs.withColumn(name, F.explode(F.sequence("_from", F.least(F.col("_from") + step, F.col(count)) - 1))).drop("_from")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b), each node linked to the smallest of its part: at most one link a node."""
    if not len(a):
        return a, b
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    low = np.arange(len(nodes))
    while True:  # hooking to the smaller label, then pointer jumping
        lx, ly = low[x], low[y]
        if (lx == ly).all():
            break
        m = np.minimum(lx, ly)
        np.minimum.at(low, lx, m)
        np.minimum.at(low, ly, m)
        while (low[low] != low).any():
            low = low[low]
    out = low != np.arange(len(nodes))
    return nodes[out], nodes[low[out]]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        a, b = forest(p["a"].to_numpy(), p["b"].to_numpy())
        yield pd.DataFrame({"a": a, "b": b})


def components(links: DataFrame, rounds: int = 60, spanning: bool = False) -> DataFrame:
    """Connected components of ``links(a, b)`` (long, not null): (node, component), component being the smallest node reachable.

    Alternates large-star and small-star steps until the links no longer change, as a count and a sum of hashes say. A step takes the smallest neighbour by an
    aggregate with partial sums and joins it back, so a hub never gathers its neighbours in one task, and nothing but two
    numbers a round reaches the driver. Nodes without links do not appear. Unless the links are ``spanning`` ones already, each
    task first reduces its own to a forest.
    """
    e = links.where("a <> b").select("a", "b")
    e = e if spanning else e.mapInPandas(_forests, "a long, b long")
    e = cut(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))
        low = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        moved = large.join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        digest = Observation()  # counted while the links are written
        e = cut(moved.where("a <> b").union(low.select("u", "m")).distinct().observe(digest, F.count("a").alias("n"), F.sum(F.xxhash64("a", "b") % (1 << 40)).alias("sum")))
        now = digest.get
        if now == seen:
            return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(
                e.groupBy(F.col("b").alias("node")).agg(F.min("b").alias("component"))
            )
        seen = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
