"""Retrieval metrics over arrays of 0-based hit positions, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def _inf() -> Column:
    return F.expr("double('infinity')")


def _nan() -> Column:
    return F.expr("double('nan')")


def _ordered(hits: Column | str) -> Column:
    return F.array_sort(F.col(hits) if isinstance(hits, str) else hits)


def average_precision(hits: Column | str, positives: Column | str, max_results: Column | None = None) -> Column:
    """Mean over the first m = min(positives, max_results) hits of i / rank; hits that are missing count 0. Null without positives."""
    positives = F.col(positives) if isinstance(positives, str) else positives
    m = F.least(positives, max_results) if max_results is not None else positives
    first = F.slice(_ordered(hits), F.lit(1), F.greatest(m, F.lit(1)).cast("int"))
    terms = F.transform(first, lambda h, i: (i + 1).cast("double") / (h + 1).cast("double"))
    return F.when(m > 0, F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / m)


def dcg(hits: Column | str) -> Column:
    gains = F.transform(_ordered(hits), lambda h: F.lit(1.0) / F.log2(h + 2.0))
    return F.aggregate(gains, F.lit(0.0), lambda s, x: s + x)


def best_hits(positives: Column | str, seen: Column | str) -> Column:
    """The positions of a perfect ranking: 0 .. min(positives, seen) - 1."""
    n = F.least(F.col(positives) if isinstance(positives, str) else positives, F.col(seen) if isinstance(seen, str) else seen)
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))


def ndcg(hits: Column | str, positives: Column | str, seen: Column | str) -> Column:
    best = dcg(best_hits(positives, seen))
    return F.when(best > 0, dcg(hits) / best).otherwise(0.0)


def normalized_average_precision(hits: Column | str, positives: Column | str, seen: Column | str) -> Column:
    best = average_precision(best_hits(positives, seen), positives)
    return F.when(best > 0, average_precision(hits, positives) / best)


def rank_of_kth(hits: Column | str, total: Column | str, k: int) -> Column:
    """1-based rank of the k-th hit; infinity if it was not found, NaN if there are fewer than k to find."""
    total = F.col(total) if isinstance(total, str) else total
    found = F.size(F.col(hits) if isinstance(hits, str) else hits)
    return F.when(total < k, _nan()).when(found < k, _inf()).otherwise((F.get(_ordered(hits), F.lit(k - 1)) + 1).cast("double"))


def reciprocal(rank: Column) -> Column:
    """1 / rank; 0 for infinity, null for NaN and null."""
    return F.when(F.isnan(rank), None).when(rank == _inf(), 0.0).otherwise(1.0 / F.nullif(rank, F.lit(0.0)))


def run_metrics(hits: str = "hit_indices", seen: str = "nseen", total: str = "ntotal") -> dict[str, Column]:
    """The metrics of one run, by name. A run without ``seen`` has none."""
    first = rank_of_kth(hits, total, 1)
    out = {
        "nfound": F.size(hits),
        "ndcg_score": ndcg(hits, total, seen),
        "average_precision": average_precision(hits, total),
        "rank_first": first,
        "reciprocal_rank": reciprocal(first),
        "rank_second": rank_of_kth(hits, total, 2),
        "rank_third": rank_of_kth(hits, total, 3),
        "rank_tenth": rank_of_kth(hits, total, 10),
    }
    return {k: F.when(F.col(seen).isNotNull(), c) for k, c in out.items()}


#: Metrics of which more is better; of ranks less is.
HIGHER_IS_BETTER = ("average_precision", "ndcg_score", "nfound", "reciprocal_rank", "normalized_ap")


def higher_is_better(metric: str) -> bool:
    if metric in HIGHER_IS_BETTER:
        return True
    if metric.startswith("rank"):
        return False
    raise ValueError(f"unknown metric {metric!r}")


def ranking_quality(similarities: Column | str) -> Column:
    """Of similarities in ranked order: their sum weighted by the root of 1 / rank, over that of the best order."""
    s = F.col(similarities) if isinstance(similarities, str) else similarities
    weighted = lambda a: F.aggregate(F.transform(a, lambda x, i: x * F.sqrt(1.0 / (i + 1))), F.lit(0.0), lambda t, x: t + x)
    best = weighted(F.reverse(F.array_sort(s)))
    return F.when(best != 0, weighted(s) / best)


def zero_based_ranks(hits: Column | str, ks: tuple[int, ...] = (1, 2, 3, 10)) -> list[Column]:
    """0-based positions of the k-th hits; null if there are fewer."""
    return [F.get(_ordered(hits), F.lit(k - 1)).alias(f"position_{k}") for k in ks]
