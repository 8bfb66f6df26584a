"""User functions over batches: rows to rows, rows to many rows, and models that are loaded once a worker."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def map_batches(df: DataFrame, fun: Callable[..., pd.DataFrame], schema: str, **arguments: Any) -> DataFrame:
    """``fun`` on each batch; it may return more or fewer rows than it was given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield fun(p, **arguments)

    return df.mapInPandas(run, schema)


def map_with_state(df: DataFrame, make: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """As map_batches, with a function that ``make`` builds once a task, say around a loaded model."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fun = make()
        for p in batches:
            yield fun(p)

    return df.mapInPandas(run, schema)


def by_row(fun: Callable[[Any], Any], kind: str) -> Callable[[Column | str], Column]:
    """A function of one value as a column function, run batch by batch. Built-in functions are faster wherever they do."""

    @F.pandas_udf(kind)
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield s.map(fun, na_action="ignore")

    return run


def aggregated(df: DataFrame, keys: list[str], fun: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """A user aggregate: ``fun`` on the rows of each group, which must fit into one task."""
    return df.groupBy(*keys).applyInPandas(fun, schema)


def embedded(df: DataFrame, text: str, embed: Callable[[str], list[float]], name: str = "vector") -> DataFrame:
    """Adds vectors of texts by an injected embedding; equal texts of a batch are embedded once."""

    @F.pandas_udf("array<double>")
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            known = {t: [float(x) for x in embed(t)] for t in s.dropna().unique()}
            yield s.map(known.get)

    return df.withColumn(name, run(text))


def decoded(df: DataFrame, column: str, decode: Callable[[Any], Any], kind: str, name: str = "decoded") -> DataFrame:
    """Adds what ``decode`` makes of a column's values; rows whose value is null or can't be decoded are dropped."""

    def attempt(value: Any) -> Any:
        try:
            return decode(value)
        except (ValueError, OSError):
            return None

    return df.withColumn(name, by_row(attempt, kind)(column)).where(F.col(name).isNotNull())
