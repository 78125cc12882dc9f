"""Series of different time steps on one index: exact, nearest, interpolated, cumulative and daily joins."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import micros
from .adequacy import DAY, steps
from .common import KEYS, TS, fill_backward, fill_forward, series, so_far
from .validation import validate_dataset

MINUTE = 60_000_000


def time_step(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """keys, step: the most frequent non-zero step (of several, the smallest), a day at most; microseconds."""
    counts = steps(df, keys, ts).groupBy(*keys, "step").count()
    best = counts.groupBy(*keys).agg(F.max(F.struct("count", (-F.col("step")).alias("least"))).alias("v"))
    return best.select(*keys, F.least(-F.col("v.least"), F.lit(DAY)).alias("step"))


def hourly_steps(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """The distinct steps below a day."""
    return steps(df, keys, ts).where(F.col("step") < DAY).distinct()


def gcd(values: Column) -> Column:
    """Greatest common divisor of an array of whole numbers."""
    one = lambda a, b: F.aggregate(
        F.sequence(F.lit(1), F.lit(64)), F.struct(a.alias("x"), b.alias("y")),
        lambda s, _: F.struct(F.when(s["y"] == 0, s["x"]).otherwise(s["y"]).alias("x"), F.when(s["y"] == 0, F.lit(0).cast("long")).otherwise(F.pmod(s["x"], F.when(s["y"] != 0, s["y"]))).alias("y")),
        lambda s: s["x"],
    )
    return F.aggregate(values, F.lit(0).cast("long"), lambda s, v: one(s, v))


def gcd_step(df: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """keys, minutes: the greatest common divisor of a site's steps below a day, in whole minutes."""
    minutes = F.expr(f"step div {MINUTE}")
    per = hourly_steps(df, keys, ts).groupBy(*keys).agg(F.array_sort(F.collect_set(minutes)).alias("m"))
    return per.select(*keys, gcd(F.col("m")).alias("minutes"))


def _around(left: DataFrame, right: DataFrame, values: Sequence[str], keys: Sequence[str], ts: str) -> DataFrame:
    """left's keys and ts with _before and _after: the rows of right (ts, values) at or before, and at or after.

    Both sides in one window, each way; the later row by the reversed order. Left rows that repeat stay apart."""
    row = F.struct(F.col(ts), *(F.col(f"`{v}`") for v in values))
    both = left.select(*keys, ts, F.lit(1).alias("_side")).withColumn("_row", F.lit(None).cast(right.select(row.alias("x")).schema["x"].dataType))
    both = both.unionByName(right.select(*keys, ts, F.lit(0).alias("_side"), row.alias("_row")))
    ahead = Window.partitionBy(*keys).orderBy(F.col(ts), "_side")
    back = Window.partitionBy(*keys).orderBy(F.col(ts).desc(), "_side")
    both = both.withColumn("_before", F.last("_row", True).over(so_far(ahead))).withColumn("_after", F.last("_row", True).over(so_far(back)))
    return both.where("_side = 1").drop("_side", "_row")


def asof_nearest(left: DataFrame, right: DataFrame, tolerance: float | None = None, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """left's keys and ts with the values of the nearest row of right, within tolerance seconds (inclusive); of two as
    near, the earlier."""
    values = [c for c in right.columns if c not in (*keys, ts)]
    met = _around(left.select(*keys, ts), right, values, keys, ts)
    before, after = micros(ts) - micros(F.col(f"_before.{ts}")), micros(F.col(f"_after.{ts}")) - micros(ts)
    best = F.when(F.col("_after").isNull() | (before <= after), F.col("_before")).otherwise(F.col("_after"))
    near = F.least(before, after) <= F.lit(int(tolerance * 1e6)) if tolerance is not None else F.lit(True)
    met = met.withColumn("_best", F.when(near, best))
    return met.select(*keys, ts, *(F.col(f"_best.`{v}`").alias(v) for v in values))


def exact(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    return left.select(*keys, ts).join(right, [*keys, ts], "left")


def align_by_value(left: DataFrame, right: DataFrame, tolerance: float, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """left's keys and ts with right's values interpolated linearly in time.

    Both indices lie on one grid, anchored at midnight, whose step is the greatest common divisor of both sides' steps
    in minutes. A gap is filled as many cells from each end as tolerance has whole steps; nothing is filled beyond the
    first and last value. Grid cells themselves are never built: a value follows from its known neighbours.
    """
    values = [c for c in right.columns if c not in (*keys, ts)]
    step = _common_step(left, right, keys, ts)
    out = left.select(*keys, ts)
    on_grid = lambda t: F.pmod(F.pmod(micros(t), F.lit(DAY)), F.col("_step")) == 0
    for v in values:
        known = right.select(*keys, ts, F.col(f"`{v}`").alias("_v")).where(F.col("_v").isNotNull()).join(step, list(keys)).where(on_grid(ts)).drop("_step")
        met = _around(left.select(*keys, ts), known, ["_v"], keys, ts).join(step, list(keys), "left")
        a, b, t = micros(F.col(f"_before.{ts}")), micros(F.col(f"_after.{ts}")), micros(ts)
        limit = F.floor(F.lit(tolerance * 1e6) / F.col("_step")) * F.col("_step")
        inside = F.col("_before").isNotNull() & F.col("_after").isNotNull() & on_grid(ts) & ((t - a <= limit) | (b - t <= limit))
        line = F.when(a == b, F.col("_before._v")).otherwise(F.col("_before._v") + (F.col("_after._v") - F.col("_before._v")) * (t - a) / F.when(a != b, b - a))
        out = out.join(met.select(*keys, ts, F.when(inside, line).alias(v)), [*keys, ts], "left")
    return out


def _common_step(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """keys, _step: the greatest common divisor of both sides' own steps, in microseconds; a minute at least."""
    both = hourly_steps(left, keys, ts).unionByName(hourly_steps(right, keys, ts)).distinct()
    per = both.groupBy(*keys).agg(F.array_sort(F.collect_set(F.expr(f"step div {MINUTE}"))).alias("m"))
    return per.select(*keys, (F.greatest(gcd(F.col("m")), F.lit(1)) * MINUTE).alias("_step"))


def align_daily(left: DataFrame, right: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Daily values on a finer index: within each day the value before, else the value after."""
    values = [c for c in right.columns if c not in (*keys, ts)]
    day = [*keys, "_day"]
    both = left.select(*keys, ts).unionByName(right.select(*keys, ts)).distinct().join(right, [*keys, ts], "left").withColumn("_day", F.to_date(ts))
    filled = both.select(*keys, ts, *(F.coalesce(fill_forward(F.col(f"`{v}`"), day, ts), fill_backward(F.col(f"`{v}`"), day, ts)).alias(v) for v in values))
    return left.select(*keys, ts).join(filled, [*keys, ts], "left")


def running_sum(df: DataFrame, column: str, keys: Sequence[str] = KEYS, ts: str = TS) -> Column:
    """Nulls are passed over and stay null."""
    return F.when(F.col(column).isNotNull(), F.sum(column).over(so_far(series(keys, ts))))


def align_cumulative(left: DataFrame, right: DataFrame, align: Callable[[DataFrame, DataFrame], DataFrame], keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Quantities as rates: their running sum is aligned, and its differences are divided by the minutes since the
    index's time before. The first is null."""
    values = [c for c in right.columns if c not in (*keys, ts)]
    sums = right.select(*keys, ts, *(running_sum(right, f"`{v}`", keys, ts).alias(v) for v in values))
    met = align(left, sums)
    w = series(keys, ts)
    minutes = (micros(ts) - F.lag(micros(ts)).over(w)) / F.lit(float(MINUTE))
    return met.select(*keys, ts, *(((F.col(f"`{v}`") - F.lag(f"`{v}`").over(w)) / minutes).alias(v) for v in values))


def of_column(setting, column: str):
    """What a setting, for all columns or a dict by column, says of one."""
    return setting.get(column) if isinstance(setting, dict) else setting


def align_to_index(
    data: DataFrame, index: DataFrame, mode: str | dict | None = None, tolerance: float | str | dict | None = None, cumulative: bool | dict = False, keys: Sequence[str] = KEYS, ts: str = TS,
) -> DataFrame:
    """index's keys and ts with data's values, joined as the two time steps ask for.

    Equal steps: exactly. Both below a day: numbers by mode (`value` or `distance`) within tolerance seconds, as rates
    if cumulative; other columns by distance; without mode or tolerance, exactly. Daily data on a finer index: filled
    within the day. Finer data on a daily index: an error. mode, tolerance and cumulative are for all columns, or dicts by
    column. Sites may differ; each kind of site is joined in its own way. A site without a step, as it has one time or
    none on either side, is joined exactly; all of index's rows stay.
    """
    values = [f for f in data.schema if f.name not in (*keys, ts)]
    if wrong := {m for f in values if (m := of_column(mode, f.name)) not in (None, "value", "distance")}:
        raise ValueError(f"mode is value or distance, not {', '.join(map(str, wrong))}")
    sites = index.select(*keys).distinct().join(time_step(data, keys, ts).withColumnRenamed("step", "d"), list(keys), "left").join(time_step(index, keys, ts).withColumnRenamed("step", "i"), list(keys), "left")
    # kinds of sites, not sites, decide the plan: four at most
    kind = F.when(F.col("d").isNull() | F.col("i").isNull() | (F.col("d") == F.col("i")), "same").when((F.col("d") < DAY) & (F.col("i") < DAY), "fine").when(F.col("d") >= DAY, "daily").otherwise("coarse")
    sites = sites.select(*keys, kind.alias("_kind"))
    kinds = {r["_kind"] for r in sites.select("_kind").distinct().collect()}
    if "coarse" in kinds:
        raise NotImplementedError("data finer than a daily index are not aligned")
    parts = []
    for k in sorted(kinds) or ["same"]:
        own = lambda df, k=k: df.join(sites.where(F.col("_kind") == k).select(*keys), list(keys), "left_semi") if len(kinds) > 1 else df
        x, at = own(data), own(index)
        if k == "daily":
            parts.append(align_daily(at, x, keys, ts))
        elif k == "same":
            parts.append(exact(at, x, keys, ts))
        else:
            parts.append(_align_fine(x, at, values, mode, tolerance, cumulative, keys, ts))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _align_fine(data: DataFrame, index: DataFrame, values: list, mode, tolerance, cumulative, keys: Sequence[str], ts: str) -> DataFrame:
    """Columns that go by the same mode, tolerance and kind are joined together."""
    ways: dict[tuple, list[str]] = {}
    for f in values:
        within = seconds(of_column(tolerance, f.name))
        how, floating = of_column(mode, f.name), isinstance(f.dataType, (T.DoubleType, T.FloatType))
        if not (how and within):
            way = ("exact", None, False)
        else:
            way = (how if floating else "distance", within, floating and bool(of_column(cumulative, f.name)))
        ways.setdefault(way, []).append(f.name)
    out = index.select(*keys, ts)
    for (how, within, rates), columns in ways.items():
        some = data.select(*keys, ts, *(f"`{c}`" for c in columns))
        if how == "exact":
            more = exact(index, some, keys, ts)
        else:
            join = (lambda a, b, w=within: align_by_value(a, b, w, keys, ts)) if how == "value" else (lambda a, b, w=within: asof_nearest(a, b, w, keys, ts))
            more = align_cumulative(index, some, join, keys, ts) if rates else join(index, some)
        out = out.join(more, [*keys, ts], "left")
    return out.select(*keys, ts, *(f"`{f.name}`" for f in values))


def concat_frames(frames: Sequence[DataFrame], keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Side by side, by an outer join on keys and ts."""
    out = frames[0]
    for df in frames[1:]:
        out = out.join(df, [*keys, ts], "full")
    return out


def merge_data_list(
    frames: Sequence[DataFrame], primary: DataFrame, mode: str | dict | None = None, tolerance: float | str | dict | None = None, cumulative: bool | dict = False, keys: Sequence[str] = KEYS, ts: str = TS,
) -> DataFrame:
    """All frames aligned to primary's index, side by side; settings for all columns, or by column."""
    out = primary.select(*keys, ts)
    for df in frames:
        out = out.join(align_to_index(df, primary, mode, tolerance, cumulative, keys, ts), [*keys, ts], "left")
    return out


def union_partitions(frames: Sequence[DataFrame], keys: Sequence[str] = KEYS, ts: str = TS) -> list[DataFrame]:
    """Frames with the same set of columns one below the other, for each set. A time that two of them have is an error; one
    that a frame repeats by itself is not, its rows all stay."""
    groups: dict[frozenset, list[DataFrame]] = {}
    for df in frames:
        groups.setdefault(frozenset(df.columns), []).append(df)
    out = []
    for own in groups.values():
        df = own[0]
        for more in own[1:]:
            df = df.unionByName(more)
        if len(own) > 1:
            times = reduce(DataFrame.union, (x.select(*keys, ts, F.lit(k).alias("_part")) for k, x in enumerate(own)))
            both = times.groupBy(*keys, ts).agg(F.min("_part").alias("_first"), F.max("_part").alias("_last")).where("_first < _last")
            if not both.isEmpty():
                raise ValueError("partitions overlap in time")
        out.append(df)
    return out


def validate_partitions(frames: Sequence[DataFrame], primary: DataFrame | None = None, mode: str | dict | None = None, tolerance: float | str | dict | None = None, cumulative: bool | dict = False, names: dict | None = None, date_format: str = "%Y-%m-%d %H:%M:%S", threshold: float = 0.25, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Every partition validated, then united by its columns and, if there are several sets of columns, aligned to primary."""
    groups = union_partitions([validate_dataset(df, names, date_format, threshold, keys, ts) for df in frames], keys, ts)
    if primary is None:
        if len(groups) > 1:
            raise ValueError("partitions with different columns need a primary index")
        return groups[0]
    return merge_data_list(groups, primary, mode, tolerance, cumulative, keys, ts)


def semi(features: DataFrame, labels: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    return features.join(labels.select(*keys, ts), [*keys, ts], "left_semi")


def with_activity(features: DataFrame, activity: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    return features.join(activity, [*keys, ts], "full")


def lookup_rows(values: DataFrame, at: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Rows of values at the times of at; a time that values lack is an error when the row is read."""
    out = at.select(*keys, ts).join(values.withColumn("_there", F.lit(True)), [*keys, ts], "left")
    there = F.when(F.col("_there"), F.col(ts)).otherwise(F.raise_error(F.concat(F.lit("no row at "), F.col(ts).cast("string"))))
    return out.withColumn(ts, there).drop("_there")


def impact(prediction: DataFrame, labels: DataFrame, column: str = "consumption", keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """prediction - labels by time; null where one is missing."""
    a, b = prediction.select(*keys, ts, F.col(column).alias("_p")), labels.select(*keys, ts, F.col(column).alias("_y"))
    return a.join(b, [*keys, ts], "full").select(*keys, ts, (F.col("_p") - F.col("_y")).alias(column))


def restore(values: DataFrame, labels: DataFrame, column: str = "activity", keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Values at all times of labels, 0 where there is none."""
    out = labels.select(*keys, ts).join(values, [*keys, ts], "left")
    return out.withColumn(column, F.coalesce(column, F.lit(0.0)))


def seconds(tolerance: str | float | None) -> float | None:
    """Seconds of a number, or of a number with a unit such as `15min`, `1h` or `2D`."""
    if tolerance is None or isinstance(tolerance, (int, float)):
        return tolerance
    import pandas as pd

    value = pd.Timedelta(tolerance).total_seconds()
    return None if math.isnan(value) else value
