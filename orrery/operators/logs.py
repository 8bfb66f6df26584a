"""Windows over ordered event logs and session documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import running


def _run(group: str, order: list[str]):
    return Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def positions(log: DataFrame, group: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Adds ``pos``, counted from 0 within the group."""
    return log.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(*order)) - 1)


def running_counts(log: DataFrame, accepted: Column, group: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Adds ``accepted`` (so far, this row included) and ``seen``."""
    w = _run(group, list(order))
    return log.withColumn("accepted", F.sum(accepted.cast("int")).over(w)).withColumn("seen", F.count(F.lit(1)).over(w))


def new_records(log: DataFrame, value: str, group: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Rows whose value exceeds all before them in their group."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return log.withColumn("_most", F.max(value).over(before)).where((F.col("_most").isNull() & F.col(value).isNotNull()) | (F.col(value) > F.col("_most"))).drop("_most")


def reversals(log: DataFrame, accepted: Column, group: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """(group, reversed): whether something accepted follows something rejected."""
    before = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    flagged = log.select(group, *order, accepted.cast("int").alias("_a")).withColumn("_least", F.min("_a").over(before))
    return flagged.groupBy(group).agg(F.max((F.coalesce(F.col("_least"), F.lit(1)) == 0) & (F.col("_a") == 1)).alias("reversed"))


def first_time(log: DataFrame, message: Column, group: str = "user_id", time: str = "ts") -> DataFrame:
    """(group, first_time) of the rows where ``message`` holds; null where it never does."""
    return log.groupBy(group).agg(F.min(F.when(message, F.col(time))).alias("first_time"))


def latest(log: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """The last row of each group."""
    w = Window.partitionBy(*group).orderBy(*[F.desc(o) for o in order])
    return log.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def paired_spans(log: DataFrame, start: Column, end: Column, group: str = "user_id", time: str = "ts", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """(group, n_pairs, total_seconds): each end taken with the last start before it; starts without an end are left out."""
    marked = log.where(start | end).select(group, *order, start.alias("_start"), F.col(time).cast("timestamp").alias("_t"))
    before = Window.partitionBy(group).orderBy(*order)
    lagged = marked.withColumn("_from", F.lag(F.when(F.col("_start"), F.col("_t"))).over(before))
    pairs = lagged.where(~F.col("_start") & F.col("_from").isNotNull())
    seconds = F.unix_micros("_t") / 1e6 - F.unix_micros("_from") / 1e6
    return pairs.groupBy(group).agg(F.count(F.lit(1)).alias("n_pairs"), F.sum(seconds).alias("total_seconds"))


def within_task(log: DataFrame, started: Column, ended: Column, group: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """Rows from the first start of their group up to the first end after it."""
    w = _run(group, list(order))
    out = log.withColumn("_s", F.max(started.cast("int")).over(w))
    out = out.withColumn("_e", F.coalesce(F.max(F.when((F.col("_s") == 1) & ended, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return out.where("_s = 1 and _e = 0").drop("_s", "_e")


def first_at_limit(log: DataFrame, reached: Column, group: str = "user_id", order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The first row of each group where a limit is reached."""
    w = Window.partitionBy(group).orderBy(*order)
    return log.where(reached).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def gaps(hits: DataFrame, group: str, rank: str) -> DataFrame:
    """Adds ``reciprocal_gap``: 1 over the distance to the hit before (the first: to the start)."""
    w = Window.partitionBy(group).orderBy(rank)
    return hits.withColumn("reciprocal_gap", 1.0 / (F.col(rank) - F.coalesce(F.lag(rank).over(w), F.lit(0))))


def padded_timeline(accepts: DataFrame, group: str, limit: float, upto: int = 10) -> DataFrame:
    """(group, accepted, seconds): when each of 1 .. upto was reached, ``limit`` where it was not or later."""
    keys = accepts.select(group).distinct().withColumn("accepted", F.explode(F.sequence(F.lit(1), F.lit(upto))))
    first = accepts.groupBy(group, "accepted").agg(F.min("seconds").alias("seconds"))
    return keys.join(first, [group, "accepted"], "left").withColumn("seconds", F.least(F.coalesce("seconds", F.lit(float(limit))), F.lit(float(limit))))


def inversions(rows: DataFrame, score: str, label: str, key: str) -> DataFrame:
    """Adds ``inversions``: for a positive the negatives that score better, for a negative the positives that score worse.

    The ranking is over the whole table; one number, the count of positives, is joined back.
    """
    ranked = running(rows, [F.desc(score), F.asc(key)], {"_above": (1 - F.col(label)).cast("long"), "_found": F.col(label).cast("long")})
    total = rows.agg(F.coalesce(F.sum(label), F.lit(0)).alias("_total"))
    worse = F.when(F.col(label) == 1, F.col("_above")).otherwise(F.col("_total") - F.col("_found"))
    return ranked.join(F.broadcast(total)).withColumn("inversions", worse).drop("_above", "_found", "_total")


def timeline(sessions: DataFrame) -> DataFrame:
    """Rows (session columns, i, j, dbidx, start_s, end_s, accepted, total_accepted, total_seen) of nested session documents, by start.

    ``gdata`` is an array of batches of images {dbidx, boxes, timing}; an image has a row for the first time it was shown, if
    it was. Image j of batch i is accepted if any of its boxes is. Every session begins with a row (-1, -1, 0, 0, false).
    """
    kept = [c for c in sessions.columns if c != "gdata"]
    batches = sessions.select(*kept, F.posexplode("gdata").alias("i", "_b"))
    images = batches.select(*kept, "i", F.posexplode("_b").alias("j", "_m")).where("size(_m.timing) > 0").withColumn("_t", F.col("_m.timing")[0])
    rows = images.select(
        *kept, "i", "j", F.col("_m.dbidx").alias("dbidx"), (F.col("_t.start_ms") / 1000.0).alias("start_s"), (F.col("_t.end_ms") / 1000.0).alias("end_s"),
        F.coalesce(F.exists("_m.boxes", lambda b: F.coalesce(b["marked_accepted"], F.lit(False))), F.lit(False)).alias("accepted"),
    )
    none = sessions.select(*kept, F.lit(-1).alias("i"), F.lit(-1).alias("j"), F.lit(None).cast("long").alias("dbidx"), F.lit(0.0).alias("start_s"), F.lit(0.0).alias("end_s"), F.lit(False).alias("accepted"))
    w = Window.partitionBy(*kept).orderBy("start_s", "i", "j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.unionByName(none)
    return both.withColumn("total_accepted", F.sum(F.col("accepted").cast("int")).over(w)).withColumn("total_seen", F.sum((F.col("i") >= 0).cast("int")).over(w))
