"""Fits over whole tables, by Spark's own estimators."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import GaussianMixture
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mixture(vectors: DataFrame, k: int, column: str = "embedding", seed: int = 0, steps: int = 50) -> DataFrame:
    """Adds ``component`` and ``probabilities`` of a Gaussian mixture with full covariances."""
    rows = vectors.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    model = GaussianMixture(featuresCol="_v", predictionCol="component", probabilityCol="_p", k=k, seed=seed, maxIter=steps).fit(rows)
    return model.transform(rows).withColumn("probabilities", vector_to_array("_p")).drop("_v", "_p")


def calibration(scores: DataFrame, score: str = "score", label: str = "y") -> tuple[float, float]:
    """(slope, shift) of the sigmoid that turns scores into probabilities of the label: 1 / (1 + exp(-slope (score + shift)))."""
    rows = scores.select(array_to_vector(F.array(F.col(score).cast("double"))).alias("features"), F.col(label).cast("double").alias("label"))
    m = LogisticRegression(maxIter=100).fit(rows)
    slope = float(m.coefficients[0])
    return slope, float(m.intercept) / slope if slope else 0.0


def split_by_group(rows: DataFrame, group: str, stratum: str, share: float = 0.5, seed: int = 0) -> DataFrame:
    """Adds ``train``: whole groups are dealt by a seeded hash of stratum and group, so none is on both sides."""
    return rows.withColumn("train", F.pmod(F.xxhash64(F.lit(seed), F.col(stratum), F.col(group)), F.lit(1 << 20)) < int(share * (1 << 20)))
