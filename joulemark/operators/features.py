"""Features: codes of categories, lags, scaling, and the split by time."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import calendar, categorical_columns, clip, lag_name
from .common import KEYS, TS, fill_backward, fill_forward, series

#: Categories of a column at most; a column with more is no category.
CATEGORIES = 10_000


@dataclass
class SafeOrdinalEncoder:
    """Categories as 0 to n - 1 in their order; unknown ones become unknown_value, or the most frequent code if it is None.

    remainder `passthrough` keeps other columns, in the original order; `drop` leaves them out.
    """

    features: Sequence[str] | None = None
    int_is_categorical: bool = False
    unknown_value: int | None = None
    remainder: str = "passthrough"
    codes: dict[str, dict] = field(default_factory=dict)
    frequent: dict[str, int] = field(default_factory=dict)

    def fit(self, df: DataFrame, keys: Sequence[str] = KEYS) -> SafeOrdinalEncoder:
        own = [c for c in categorical_columns(df, self.int_is_categorical) if c not in keys] if self.features is None else list(self.features)
        for c in own:
            if isinstance(df.schema[c].dataType, T.FractionalType):
                raise ValueError(f"{c} is not categorical")
            rows = df.groupBy(F.col(c).alias("v")).count().limit(CATEGORIES + 1).collect()
            if len(rows) > CATEGORIES:
                raise ValueError(f"{c} has more than {CATEGORIES} categories")
            if any(r["v"] is None for r in rows):
                raise ValueError(f"{c} has null categories")
            self.codes[c] = {v: k for k, v in enumerate(sorted(r["v"] for r in rows))}
            if rows:
                self.frequent[c] = min((-r["count"], self.codes[c][r["v"]]) for r in rows)[1]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        out = []
        for c in df.columns:
            if c in self.codes:
                other = self.frequent.get(c) if self.unknown_value is None else self.unknown_value
                known = F.create_map(*[F.lit(x) for pair in self.codes[c].items() for x in pair])[F.col(c)] if self.codes[c] else F.lit(None)
                out.append(F.coalesce(known, F.lit(other)).cast("short").alias(c))
            elif self.remainder == "passthrough":
                out.append(F.col(f"`{c}`"))
        return df.select(out)


def most_frequent(df: DataFrame, column: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """keys and the most frequent value of column; of several, the smallest."""
    counts = df.where(F.col(column).isNotNull()).groupBy(*keys, column).count()
    w = Window.partitionBy(*keys).orderBy(F.col("count").desc(), column)
    return counts.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*keys, column)


def create_lagged(df: DataFrame, lags: dict[str, Sequence[int]], keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Columns L{lag}.{feature}, by rows; features that df lacks are passed over."""
    w = series(keys, ts)
    return df.select("*", *(F.lag(f"`{f}`", k).over(w).alias(lag_name(f, k)) for f, ks in lags.items() if f in df.columns for k in ks))


def add_calendar(df: DataFrame, ts: str = TS) -> DataFrame:
    return df.withColumns(calendar(ts))


def difference(column: str, keys: Sequence[str] = KEYS, ts: str = TS) -> Column:
    return F.col(column) - F.lag(column).over(series(keys, ts))


def min_max(column: str, low: float = 0.0, high: float = 1.0, keys: Sequence[str] = KEYS) -> Column:
    """A site's values on [low, high]; where all are equal, low."""
    w = Window.partitionBy(*keys)
    a, b = F.min(column).over(w), F.max(column).over(w)
    return F.when(F.col(column).isNotNull(), F.when(b > a, F.lit(low) + (F.col(column) - a) / F.when(b > a, b - a) * F.lit(high - low)).otherwise(F.lit(low)))


def time_split(df: DataFrame, share: float = 0.2, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """df with validation: whether a row is among the last ceil(share x n) of its site."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("validation", F.row_number().over(series(keys, ts)) > n - F.ceil(F.round(n * share, 9)))


def hourly_fill(df: DataFrame, column: str, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Nulls take the value before within their date and hour, then the next value at all."""
    df = df.withColumn("_d", F.to_date(ts)).withColumn("_h", F.hour(ts))
    df = df.withColumn("_f", fill_forward(F.col(column), [*keys, "_d", "_h"], ts))
    return df.withColumn(column, F.coalesce("_f", fill_backward(F.col("_f"), keys, ts))).drop("_d", "_h", "_f")


def nonzero(labels: DataFrame, column: str = "consumption") -> DataFrame:
    """Labels of a building in use."""
    return labels.where(F.col(column) > 1e-5)


def in_use(df: DataFrame, activity: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Rows of df at times of full activity."""
    return df.join(activity.where("activity = 1").select(*keys, ts), [*keys, ts], "left_semi")


def mask_unused(smoothed: Column, consumption: Column) -> Column:
    return F.when(consumption <= 1e-5, 0.0).otherwise(smoothed)


def binned_activity(df: DataFrame, column: str = "consumption", by: Sequence[str] = ("hour",), low: float = 0.01, high: float = 0.99, scale: tuple[float, float] = (0.0, 1.0), keys: Sequence[str] = KEYS) -> DataFrame:
    """Activity from exact quantiles of each bin of by: (y - lower) / (upper - lower), on scale and clipped to it."""
    bins = df.groupBy(*keys, *by).agg(F.percentile(column, F.lit(low)).alias("lower"), F.percentile(column, F.lit(high)).alias("upper"))
    a, b = scale
    width = F.col("upper") - F.col("lower")
    value = F.when(width > 0, F.lit(b - a) * (F.col(column) - F.col("lower")) / F.when(width > 0, width) + F.lit(a)).otherwise(F.when(F.col(column).isNotNull(), F.lit(a)))
    return df.join(bins, [*keys, *by]).withColumn("activity", clip(value, a, b)).drop("lower", "upper")


