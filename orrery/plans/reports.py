"""Comparison reports over method runs: one row per run, with its dataset, category (query), variant and metrics."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import higher_is_better

QUERY = ("dataset", "category")


def finite(c: Column | str) -> Column:
    """The value, or null where it is NaN: means skip it."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c), c)


def inverse(c: Column) -> Column:
    """1 / c as floats have it: infinity for 0, 0 for infinity."""
    return F.when(c == 0, F.expr("double('infinity')")).otherwise(1.0 / F.nullif(c, F.lit(0.0)))


def side_by_side(stats: DataFrame, baseline: str, metric: str, variant: str = "variant", query: tuple[str, ...] = QUERY) -> DataFrame:
    """Every run next to the baseline's of the same query (full outer): query, variant, metric, base, ratio and delta."""
    mine = stats.select(*query, F.col(variant).alias("variant"), F.col(metric).alias("metric"))
    base = stats.where(F.col(variant) == baseline).select(*query, F.col(metric).alias("base"))
    both = mine.join(base, list(query), "full_outer")
    return both.select(*query, "variant", "metric", "base", (F.col("metric") / F.nullif(F.col("base"), F.lit(0.0))).alias("ratio"), (F.col("metric") - F.col("base")).alias("delta"))


def compared(stats: DataFrame, variant_value: str, baseline: str, metrics: list[str], variant: str = "variant", query: tuple[str, ...] = QUERY) -> DataFrame:
    """Two variants on the queries that both ran, the baseline's columns suffixed."""
    a = stats.where(F.col(variant) == variant_value).select(*query, *metrics)
    b = stats.where(F.col(variant) == baseline).select(*query, *[F.col(m).alias(f"{m}_baseline") for m in metrics])
    return a.join(b, list(query))


def better_same_worse(sbs: DataFrame, metric: str, tolerance: float, relative: bool = False, by: str = "dataset") -> DataFrame:
    """(variant, by, better, same, worse, neither, n), with a ``total`` row a variant: counts of queries by how the metric compares.

    Absolute: the difference beyond ``tolerance``; relative: beyond the base times or divided by it. ``neither``: nulls and NaN.
    """
    m, b = F.col("metric"), F.col("base")
    if relative:
        up, down = m > b * tolerance, m < b / tolerance
    else:
        up, down = m - b > tolerance, b - m > tolerance
    known = m.isNotNull() & b.isNotNull() & ~F.isnan(m) & ~F.isnan(b)
    better, worse = (up, down) if higher_is_better(metric) else (down, up)
    flags = sbs.select("variant", by, (known & better).alias("better"), (known & ~up & ~down).alias("same"), (known & worse).alias("worse"), (~known).alias("neither"))
    sums = [F.sum(F.coalesce(F.col(c).cast("int"), F.lit(0))).alias(c) for c in ("better", "same", "worse", "neither")]
    out = flags.rollup("variant", by).agg(*sums, F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_level"))
    return out.where("_level < 3").select("variant", F.when(F.col("_level") == 1, "total").otherwise(F.col(by).cast("string")).alias(by), "better", "same", "worse", "neither", "n")


def pair_classes(pairs: DataFrame, a: str, b: str, epsilon: float) -> DataFrame:
    """Adds ``class``, one of seven, and ``first_only_infinite`` and ``second_only_infinite``: how two methods' values of a query compare.

    ``both_undefined``, ``first_undefined`` and ``second_undefined`` where a value is null or NaN; ``both_infinite``; else values are
    comparable: ``close`` within ``epsilon``, else ``first_larger`` or ``first_smaller``, a single infinity being larger than any number.
    """
    x, y = F.col(a), F.col(b)
    none, endless = (lambda c: c.isNull() | F.isnan(c)), (lambda c: F.coalesce(c == F.expr("double('infinity')"), F.lit(False)))
    name = (
        F.when(none(x) & none(y), "both_undefined").when(none(x), "first_undefined").when(none(y), "second_undefined").when(endless(x) & endless(y), "both_infinite")
        .when(F.abs(x - y) <= epsilon, "close").when(x > y, "first_larger").otherwise("first_smaller")
    )
    flags = {"first_only_infinite": endless(x) & ~endless(y), "second_only_infinite": endless(y) & ~endless(x)}
    return pairs.withColumn("class", name).withColumns(flags)


def summary_breakdown(sbs: DataFrame, bounds: tuple[float, float] = (0.1, 0.3), by: str = "dataset") -> DataFrame:
    """(variant, bucket, mean_metric, n): queries by how well the baseline does, the mean of the means of datasets, and counts."""
    low, high = bounds
    bucket = F.when(F.col("base") > high, "easy").when(F.col("base") > low, "medium").otherwise("hard")
    inner = sbs.where("base is not null").withColumn("bucket", bucket).groupBy("variant", "bucket", by).agg(F.avg(finite("metric")).alias("m"), F.count(F.lit(1)).alias("k"))
    return inner.groupBy("variant", "bucket").agg(F.avg("m").alias("mean_metric"), F.sum("k").alias("n"))


def mean_table(stats: DataFrame, metric: str, datasets: list, columns: tuple[str, ...] = ("variant",), by: str = "dataset") -> DataFrame:
    """One row for each combination of ``columns``: the metric's mean in each dataset (d_<name>) and ``average``, the mean of those."""
    wide = stats.groupBy(*columns).pivot(by, datasets).agg(F.avg(finite(metric)))
    named = [F.col(f"`{d}`").alias(f"d_{d}") for d in datasets]
    total = sum((F.coalesce(F.col(f"`{d}`"), F.lit(0.0)) for d in datasets), F.lit(0.0))
    there = sum((F.col(f"`{d}`").isNotNull().cast("int") for d in datasets), F.lit(0))
    return wide.select(*columns, *named, (total / F.nullif(there, F.lit(0))).alias("average"))


def means_with_average(stats: DataFrame, metric: str, by: str = "dataset", variant: str = "variant") -> DataFrame:
    """(variant, by, mean) in long form, with an ``Avg.`` row a variant: the mean of its datasets' means."""
    means = stats.groupBy(variant, F.col(by).cast("string").alias(by)).agg(F.avg(finite(metric)).alias("mean"))
    return means.unionByName(means.groupBy(variant).agg(F.avg("mean").alias("mean")).withColumn(by, F.lit("Avg.")))


def two_level_means(stats: DataFrame, metric: str, columns: list[str], by: str = "dataset") -> DataFrame:
    """(columns, mean): the mean of the datasets' means, so that each dataset counts alike."""
    return stats.groupBy(*columns, by).agg(F.avg(finite(metric)).alias("_m")).groupBy(*columns).agg(F.avg("_m").alias("mean"))


def with_difficulty(stats: DataFrame, metric: str, baseline: str, hard_below: float = 0.5, variant: str = "variant", query: tuple[str, ...] = QUERY) -> DataFrame:
    """Adds ``hard``: whether the baseline stays below a bound on this query; false where it did not run."""
    hard = stats.where((F.col(variant) == baseline) & (F.col(metric) < hard_below)).select(*query).distinct().withColumn("hard", F.lit(True))
    return stats.join(hard, list(query), "left").withColumn("hard", F.coalesce("hard", F.lit(False)))


def unsaturated(stats: DataFrame, metric: str, baseline: str, perfect: float = 1.0, variant: str = "variant", query: tuple[str, ...] = QUERY) -> DataFrame:
    """Runs of the queries on which the baseline is not perfect already."""
    open_ = stats.where((F.col(variant) == baseline) & (F.col(metric) < perfect)).select(*query).distinct()
    return stats.join(open_, list(query), "left_semi")


def differences(means: DataFrame, value: str, order: str, group: str | None = None) -> DataFrame:
    """Adds ``diff``: the change from the row before, as in an ablation."""
    w = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(order)
    return means.withColumn("diff", F.col(value) - F.lag(value).over(w))


def quantiles(rows: DataFrame, value: str, group: list[str], at: tuple[float, ...] = (0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0)) -> DataFrame:
    """(group, q, value): exact quantiles, linearly interpolated."""
    got = rows.where(finite(value).isNotNull()).groupBy(*group).agg(F.percentile(value, F.lit(list(at))).alias("_p"))
    return got.select(*group, F.posexplode("_p").alias("_i", "value")).select(*group, F.element_at(F.lit(list(at)), F.col("_i") + 1).alias("q"), "value")


def cumulative(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Adds ``ecdf``, the share of the group's rows at most as large."""
    return rows.withColumn("ecdf", F.cume_dist().over(Window.partitionBy(*group).orderBy(value)))


def mean_and_error(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """(group, mean, sem, n): sem is the sample deviation over the root of n; null for one row."""
    v = finite(value)
    return rows.groupBy(*group).agg(F.avg(v).alias("mean"), (F.stddev_samp(v) / F.sqrt(F.count(v).cast("double"))).alias("sem"), F.count(v).alias("n"))


def completion(rows: DataFrame, group: list[str], total: str, done: str) -> DataFrame:
    """(group, ratio): how much of ``total`` was completed; 0 where nothing was."""
    return rows.groupBy(*group).agg((F.sum(F.coalesce(F.col(done), F.lit(0)).cast("double")) / F.nullif(F.sum(total), F.lit(0))).alias("ratio"))


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once: empty if the table keeps its promise."""
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def bootstrap(
    rows: DataFrame, value: str, group: list[str], statistic: str = "median", samples: int = 1000, confidence: float = 0.95, tests: int = 1, seed: int = 0, method: str = "percentile",
) -> DataFrame:
    """(group, low, high, value): an interval of a statistic under seeded resampling; ``tests`` for Bonferroni.

    ``percentile`` takes the quantiles of the resamples' statistics; ``bca`` shifts them for bias (where the value itself stands among
    the resamples, ties half) and for skewness (of the statistic with each value left out). Resamples are drawn within a task from
    the values of one group, some at a time, so a group is a report's cell and not raw data.
    """
    alpha = (1 - confidence) / tests

    def interval(p: pd.DataFrame) -> pd.DataFrame:
        out = p[group].iloc[:1].copy()
        low, high, v = resampled(p[value].dropna().to_numpy(float), statistic, samples, alpha, seed, method)
        return out.assign(low=low, high=high, value=v)

    keys = ", ".join(f"{g} {rows.schema[g].dataType.simpleString()}" for g in group)
    return rows.groupBy(*group).applyInPandas(interval, f"{keys}, low double, high double, value double")


def resampled(values: np.ndarray, statistic: str, samples: int, alpha: float, seed: int, method: str) -> tuple[float, float, float]:
    """(low, high, value) of ``bootstrap`` for one group; NaN of nothing."""
    fun = {"median": np.median, "mean": np.mean}[statistic]
    v = np.sort(values)
    if not len(v):
        return np.nan, np.nan, np.nan
    rng, step = np.random.default_rng(seed), max(1, 4_000_000 // len(v))
    draws = np.concatenate([fun(rng.choice(v, (min(step, samples - at), len(v))), axis=1) for at in range(0, samples, step)])
    here, ends = float(fun(v)), np.array([alpha / 2, 1 - alpha / 2])
    if method == "bca":
        if len(v) < 2 or draws.min() == draws.max():
            return np.nan, np.nan, here
        normal = NormalDist()
        bias = normal.inv_cdf(min(max(((draws < here).mean() + (draws <= here).mean()) / 2, 1e-12), 1 - 1e-12))
        without = (v.sum() - v) / (len(v) - 1) if statistic == "mean" else np.array([np.median(np.delete(v, i)) for i in range(len(v))])
        off = without.mean() - without
        skew = float((off**3).sum() / (6 * (off @ off) ** 1.5)) if off.any() else 0.0
        z = np.array([bias + normal.inv_cdf(float(q)) for q in ends])
        ends = np.array([normal.cdf(float(bias + x / (1 - skew * x))) for x in z])
    elif method != "percentile":
        raise ValueError(f"unknown method {method!r}")
    low, high = np.quantile(draws, ends)
    return float(low), float(high), here


def with_parameters(rows: DataFrame, parameters: DataFrame, key: str = "param_hash") -> DataFrame:
    """Rows with the parameters that their hash stands for; rows of unknown hashes stay."""
    return rows.join(parameters, key, "left")


def method_matrix(stats: DataFrame, metric: str, variants: list, variant: str = "variant", query: tuple[str, ...] = QUERY) -> DataFrame:
    """One row a query, a column for each variant (v_<name>) and the difference of the last and the first (delta)."""
    wide = stats.groupBy(*query).pivot(variant, variants).agg(F.first(metric))
    named = [F.col(f"`{v}`").alias(f"v_{v}") for v in variants]
    return wide.select(*query, *named, (F.col(f"`{variants[-1]}`") - F.col(f"`{variants[0]}`")).alias("delta"))


def latency_means(rows: DataFrame, latencies: str = "latencies") -> DataFrame:
    """Adds latency_mean and latency_std (population) of each run's array of latencies; null for none."""
    a, n = F.col(latencies), F.size(latencies)
    mean = F.when(n > 0, F.aggregate(a, F.lit(0.0), lambda s, x: s + x) / n)
    rows = rows.withColumn("latency_mean", mean)
    spread = F.aggregate(F.transform(a, lambda x: (x - F.col("latency_mean")) * (x - F.col("latency_mean"))), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("latency_std", F.when(n > 0, F.sqrt(spread / n)))


def brief(value: float | None) -> str:
    """A number for a table: two digits after the point, without the zero before it."""
    if value is None or value != value:
        return "-"
    text = f"{value:.2f}"
    return text.replace("0.", ".", 1) if text.startswith(("0.", "-0.")) else text


def times(value: float) -> str:
    return f"{value:.1f}x"


def short_count(value: float) -> str:
    """1234567 as 1.2M."""
    for unit in ("", "K", "M", "B"):
        if abs(value) < 1000 or unit == "B":
            return f"{value:.0f}" if not unit else f"{value:.1f}{unit}"
        value /= 1000
    return str(value)


def with_group_least(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Adds ``least``, the smallest value of the row's facet."""
    least = rows.groupBy(*group).agg(F.min(finite(value)).alias("least"))
    return rows.join(least, group, "left")


def centres(rows: DataFrame, value: str, group: list[str]) -> DataFrame:
    """(group, median, mean, n) of the values that are numbers."""
    v = finite(value)
    return rows.groupBy(*group).agg(F.median(v).alias("median"), F.avg(v).alias("mean"), F.count(v).alias("n"))


def ratios(stats: DataFrame, metric: str, baseline, by: str = "dataset", variant: str = "variant") -> DataFrame:
    """(by, variant, mean, ratio): means of each dataset, and as multiples of the baseline's mean there; null where that is none or zero."""
    means = stats.groupBy(by, variant).agg(F.avg(finite(metric)).alias("mean"))
    base = means.where(F.col(variant) == baseline).select(by, F.col("mean").alias("_base"))
    return means.join(base, by).select(by, variant, "mean", (F.col("mean") / F.nullif("_base", F.lit(0.0))).alias("ratio"))


def with_sizes(rows: DataFrame, members: DataFrame, by: str) -> DataFrame:
    """Adds ``size``, how many ``members`` the row's dataset has."""
    return rows.join(members.groupBy(by).agg(F.count(F.lit(1)).alias("size")), by)
