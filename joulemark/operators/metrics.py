"""Errors of a prediction, by site."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEYS, TS


def cvrmse(y: Column, prediction: Column) -> Column:
    r = y - prediction
    return F.sqrt(F.avg(r * r)) / F.avg(y)


def nmbe(y: Column, prediction: Column) -> Column:
    return F.avg(y - prediction) / F.avg(y)


def mse(y: Column, prediction: Column) -> Column:
    r = y - prediction
    return F.avg(r * r)


def errors(labels: DataFrame, prediction: DataFrame, column: str = "consumption", keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """CVRMSE, NMBE and MSE by site over the times that both have; a time that only one has is an error."""
    a, b = labels.select(*keys, ts, F.col(column).alias("y")), prediction.select(*keys, ts, F.col(column).alias("p"))
    both = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), [*keys, ts], "full")
    alone = F.max(F.when(F.col("_a").isNull() | F.col("_b").isNull(), 1).otherwise(0))
    known = both.groupBy(*keys).agg(cvrmse(F.col("y"), F.col("p")).alias("CVRMSE"), nmbe(F.col("y"), F.col("p")).alias("NMBE"), mse(F.col("y"), F.col("p")).alias("MSE"), alone.alias("_alone"))
    checked = F.when(F.col("_alone") == 0, F.col("CVRMSE")).otherwise(F.raise_error(F.lit("labels and prediction have different times")).cast("double"))
    return known.select(*keys, checked.alias("CVRMSE"), "NMBE", "MSE")


def fit_sums(y: Column, prediction: Column) -> dict[str, Column]:
    """What likelihoods and priors need: the sum of squared errors, and the labels' least, largest and mean."""
    r = y - prediction
    return {"sse": F.sum(r * r), "log_likelihood": F.lit(-0.5) * F.sum(r * r), "y_min": F.min(y), "y_max": F.max(y), "y_mean": F.avg(y)}
