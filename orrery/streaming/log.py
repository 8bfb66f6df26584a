"""An extension: the action log as a stream. The batch operators answer the same questions on a finished log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_log(spark: SparkSession, path: str, schema: str = EVENTS, files_per_trigger: int = 16, only: str = "*") -> DataFrame:
    """The files that come into a folder, ``only`` those of a name pattern."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", only).parquet(path)


def windowed_counts(log: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): events a window, late ones beyond the watermark left out."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = log.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def user_sessions(log: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(user_id, start, end, n): events of a user without a pause longer than ``gap``."""
    w = F.session_window("ts", gap)
    out = log.withWatermark("ts", late).groupBy("user_id", w.alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def without_duplicates(log: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    return log.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def record_events(log: DataFrame, late: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """(user_id, ts, value): events whose value exceeds all of the user's before.

    Events wait until the watermark has passed them and are then compared in order of their time, so events that come late, but within
    ``late``, count where they belong. The state of a user is one number and the events that wait; a user whom the watermark has
    left ``idle`` behind is forgotten.
    """
    pause = int(pd.Timedelta(idle).total_seconds() * 1000)

    def records(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        most, times, values = state.get if state.exists else (float("-inf"), [], [])
        times, values = list(times), list(values)
        for p in batches:
            times += (p["ts"].astype("int64") // 1000 if p["ts"].dtype == "datetime64[ns]" else p["ts"].astype("datetime64[us]").astype("int64")).tolist()
            values += p["value"].tolist()
        mark = state.getCurrentWatermarkMs() * 1000
        order = sorted(range(len(times)), key=lambda i: times[i])
        due = [i for i in order if times[i] <= mark]
        new = []
        for i in due:
            if values[i] > most:
                new.append(i)
                most = values[i]
        if due or not state.hasTimedOut:
            yield pd.DataFrame({"user_id": [key[0]] * len(new), "ts": pd.to_datetime([times[i] for i in new], unit="us"), "value": [values[i] for i in new]})
        wait = [i for i in order if times[i] > mark]
        if state.hasTimedOut and not wait and not due:
            state.remove()
            return
        state.update((most, [times[i] for i in wait], [values[i] for i in wait]))
        state.setTimeoutTimestamp(max(min((times[i] for i in wait), default=mark + pause * 1000) // 1000, state.getCurrentWatermarkMs() + 1))

    return log.withWatermark("ts", late).select("user_id", "ts", "value").groupBy("user_id").applyInPandasWithState(
        records, "user_id long, ts timestamp, value double", "most double, times array<long>, waiting array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )
