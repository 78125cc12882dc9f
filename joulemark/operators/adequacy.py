"""Implausible values, regular grids, and how complete a year's data are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import from_micros, micros, month_name
from .common import KEYS, TS, series

#: What counts as zero, and the (day, hour) cells of a month, whatever its length.
ZERO, CELLS, DAY = 1e-5, 720, 86_400_000_000


def filter_data(df: DataFrame, column: str, *, min_value: float | None = None, max_value: float | None = None, allow_zero: bool = True, allow_negative: bool = False) -> DataFrame:
    """Values that cannot be are set to null; no row is dropped."""
    x = F.col(column)
    bad = F.lit(False)
    if min_value is not None:
        bad = bad | (x < min_value)
    if max_value is not None:
        bad = bad | (x > max_value)
    if not allow_zero:
        bad = bad | (F.abs(x) <= ZERO)
    if not allow_negative:
        bad = bad | (x < 0)
    return df.withColumn(column, F.when(~bad, x))


def nulls_added(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """A row with the nulls of a column before and after, and whether any value is negative."""
    count = lambda df, name: df.agg(F.count_if(F.col(column).isNull()).alias(name), *([F.max(F.col(column) < 0).alias("any_negative")] if name == "nulls_before" else []))
    return count(before, "nulls_before").crossJoin(count(after, "nulls_after"))  # two rows of one each


def steps(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Microseconds since the row before, where not zero."""
    out = df.select(*keys, (micros(ts) - F.lag(micros(ts)).over(series(keys, ts))).alias("step"))
    return out.where("step <> 0")


def least_step(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    return steps(df, keys, ts).groupBy(*keys).agg(F.min("step").alias("step"))


def grid(spans: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Times from the first midnight to the one after the last day, that one left out; spans: keys, first, last, step (microseconds)."""
    start = (F.col("first") - F.pmod("first", F.lit(DAY))).cast("long")
    stop = (F.col("last") - F.pmod("last", F.lit(DAY)) + DAY - F.lit(1)).cast("long")
    return spans.select(*keys, F.explode(F.sequence(start, stop, F.col("step"))).alias("_t")).select(*keys, from_micros(F.col("_t")).alias(ts))


def expand_dates(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """df on a grid of its least step, from midnight to midnight; times off the grid are lost. Sites of daily data or
    coarser, or with a single time, stay as they are. A time that comes twice in a site is an error."""
    if not df.groupBy(*keys, ts).count().where("count > 1").isEmpty():
        raise ValueError("a time comes twice")
    spans = df.groupBy(*keys).agg(F.min(micros(ts)).alias("first"), F.max(micros(ts)).alias("last")).join(least_step(df, keys, ts), list(keys), "left")
    fine = spans.where(F.col("step") < DAY)
    dense = grid(fine, keys, ts).join(df, [*keys, ts], "left")
    coarse = df.join(spans.where(F.col("step").isNull() | (F.col("step") >= DAY)).select(*keys), list(keys), "left_semi")
    return dense.unionByName(coarse)


def mask_labels(features: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Labels, null where all features are null or no feature row is there."""
    values = [c for c in features.columns if c not in (*keys, ts)]
    any_ = F.coalesce(*(F.col(f"`{c}`").cast("string") for c in values)).isNotNull() if values else F.lit(False)
    known = features.select(*keys, ts, any_.alias("_any"))
    own = [c for c in labels.columns if c not in (*keys, ts)]
    return labels.join(known, [*keys, ts], "left").select(*keys, ts, *(F.when(F.col("_any"), F.col(f"`{c}`")).alias(c) for c in own))


def check_data_adequacy(features: DataFrame | None, labels: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS, column: str = "consumption") -> DataFrame:
    """keys, month (M1 to M12, years together) and missing_pct: (day, hour) cells without a label, out of 720."""
    masked = labels if features is None else mask_labels(features, labels, keys, ts)
    t = F.col(ts)
    cells = masked.groupBy(*keys, month_name(ts).alias("month"), F.dayofmonth(t).alias("d"), F.hour(t).alias("h")).agg(F.count(column).alias("n"))
    return cells.groupBy(*keys, "month").agg((F.count_if(F.col("n") == 0) / F.lit(float(CELLS))).alias("missing_pct"))


def inadequate_months(report: DataFrame, max_missing_pct: float = 0.1) -> DataFrame:
    return report.where(F.col("missing_pct") > max_missing_pct)


def hourly_sample(df: DataFrame, seed: int = 0, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """One row for each date and hour of a site, drawn by a hash of its time."""
    w = Window.partitionBy(*keys, F.to_date(ts), F.hour(ts)).orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ts).cast("string"))), ts)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
