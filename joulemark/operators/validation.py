"""Checks of a table, and the repair of names, timestamps and duplicates."""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.helpers import json_value
from ..functions.scalars import categorical_columns, strict_timestamp
from .common import KEYS, TS

NO_VALUE = "_novalue_"


@dataclass
class ValidationResult:
    """What a check found. Errors are kept as data."""

    success: bool | None = None
    result: dict = field(default_factory=dict)
    exception_info: dict = field(default_factory=lambda: {"raised_exception": False, "where": None, "why": None})

    def __bool__(self) -> bool:
        return bool(self.success)

    def to_json_dict(self) -> dict:
        return json_value(asdict(self))


def catch_exceptions(check: Callable[..., ValidationResult]) -> Callable[..., ValidationResult]:
    @functools.wraps(check)
    def run(*args, **kwargs) -> ValidationResult:
        try:
            return check(*args, **kwargs)
        except Exception as e:  # noqa: BLE001  a check reports whatever went wrong
            return ValidationResult(False, {}, {"raised_exception": True, "where": check.__name__, "why": str(e)})

    return run


@catch_exceptions
def check_column_exists(df: DataFrame, column: str, column_index: int | None = None) -> ValidationResult:
    fine = column in df.columns and (column_index is None or df.columns.index(column) == column_index)
    return ValidationResult(fine, {"columns": df.columns})


def unique_counts(df: DataFrame, column: str) -> DataFrame:
    """A row with element_count, missing_count and unexpected_count; a null is no value, so any null is unexpected."""
    return df.agg(F.count("*").alias("element_count"), F.count_if(F.col(column).isNull()).alias("missing_count"), (F.count("*") - F.count_distinct(column)).alias("unexpected_count"))


def not_null_counts(df: DataFrame, column: str) -> DataFrame:
    missing = F.count("*") - F.count(column)
    return df.agg(F.count("*").alias("element_count"), missing.alias("missing_count"), missing.alias("unexpected_count"))


def increasing_counts(df: DataFrame, column: str, order: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows whose value is below the one before, by the sequence column order. Nulls are passed over."""
    w = Window.partitionBy(*keys).orderBy(order)
    before = F.last(column, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    steps = df.select(F.col(column).alias("_c"), before.alias("_b"))
    return steps.agg(F.count("*").alias("element_count"), F.count_if(F.col("_c").isNull()).alias("missing_count"), F.count_if(F.col("_c") < F.col("_b")).alias("unexpected_count"))


def _checked(counts: DataFrame) -> ValidationResult:
    row = counts.first().asDict()
    return ValidationResult(row["unexpected_count"] == 0, row)


@catch_exceptions
def check_column_values_unique(df: DataFrame, column: str) -> ValidationResult:
    return _checked(unique_counts(df, column))


@catch_exceptions
def check_column_values_not_null(df: DataFrame, column: str) -> ValidationResult:
    return _checked(not_null_counts(df, column))


@catch_exceptions
def check_column_values_increasing(df: DataFrame, column: str, order: str, parse_as_datetimes: bool = False, keys: Sequence[str] = KEYS) -> ValidationResult:
    """A table has no order of its own, so order names the column that gives it."""
    if parse_as_datetimes:
        df = df.withColumn(column, F.to_timestamp_ntz(F.col(column).cast("string")))
    return _checked(increasing_counts(df, column, order, keys))


@catch_exceptions
def check_column_type_datetime(df: DataFrame, column: str) -> ValidationResult:
    kind = df.schema[column].dataType
    return ValidationResult(isinstance(kind, (T.TimestampType, T.TimestampNTZType)), {"observed_type": kind.simpleString()})


def rebind_names(df: DataFrame, names: dict[str, str | None] | None) -> DataFrame:
    """names: new -> old. Null and absent old names are skipped; a name given twice is an error."""
    names = {old: new for new, old in (names or {}).items() if old is not None and old in df.columns}
    after = [names.get(c, c) for c in df.columns]
    if twice := sorted({c for c in after if after.count(c) > 1}):
        raise ValueError(f"columns named twice: {', '.join(twice)}")
    return df.withColumnsRenamed(names)


def drop_unnamed(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if "Unnamed" in c])


def only_consumption(labels: DataFrame, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Of several label columns only consumption stays; a single one may have any name."""
    values = [c for c in labels.columns if c not in (*keys, ts)]
    if len(values) > 1:
        if "consumption" not in values:
            raise ValueError("labels have several columns and none is named consumption")
        return labels.select(*keys, ts, "consumption")
    return labels


def fill_categorical(df: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Null categories become a value of their own."""
    cats = [c for c in categorical_columns(df) if c not in keys]
    return df.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit(NO_VALUE)) for c in cats})


def same_columns(trained: Sequence[str], df: DataFrame) -> None:
    if list(trained) != list(df.columns):
        raise ValueError(f"columns {df.columns} are not those of the training data, {list(trained)}")


def remove_duplicate_dates(df: DataFrame, threshold: float = 0.25, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """One row for each time. Where a time came several times, a column has its mean if the values lie closer than
    threshold standard deviations (of the times that came once), else null. One aggregation; the spread is a row for each site."""
    values = [c for c in df.columns if c not in (*keys, ts)]
    if other := [f.name for f in df.schema if f.name in values and not isinstance(f.dataType, T.NumericType)]:
        raise TypeError(f"duplicate times can be merged in numeric columns only, not in {', '.join(other)}")
    q = lambda c: f"`{c}`"
    per = df.groupBy(*keys, ts).agg(F.count("*").alias("_n"), *(F.avg(q(c)).alias(f"_mean_{c}") for c in values), *((F.max(q(c)) - F.min(q(c))).alias(f"_range_{c}") for c in values))
    once = F.col("_n") == 1
    spread = per.groupBy(*keys).agg(F.lit(1).alias("_"), *(F.stddev_pop(F.when(once, F.col(q(f"_mean_{c}")))).alias(f"_std_{c}") for c in values)).drop("_")
    near = lambda c: F.col(q(f"_range_{c}")) < threshold * F.col(q(f"_std_{c}"))
    return per.join(spread, list(keys)).select(*keys, ts, *(F.when(once | near(c), F.col(q(f"_mean_{c}"))).alias(c) for c in values))


def validate_dataset(df: DataFrame, names: dict[str, str | None] | None = None, date_format: str = "%Y-%m-%d %H:%M:%S", threshold: float = 0.25, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """Names rebound, the timestamp column parsed and without nulls, duplicates merged, unnamed columns dropped. Text that
    does not fit date_format is an error.

    The column is called timestamp, or ts already. Rows are merged only if a site has a time twice, which a count shows."""
    df = drop_unnamed(rebind_names(df, names))
    if ts not in df.columns:
        if "timestamp" not in df.columns:
            raise ValueError("there is no column timestamp")
        df = df.withColumnRenamed("timestamp", ts)
    kind = df.schema[ts].dataType
    if isinstance(kind, T.StringType):
        df = df.withColumn(ts, strict_timestamp(ts, date_format))
    elif not isinstance(kind, T.TimestampNTZType):
        df = df.withColumn(ts, F.col(ts).cast("timestamp_ntz"))
    df = df.where(F.col(ts).isNotNull())
    if df.groupBy(*keys, ts).count().where("count > 1").isEmpty():
        return df
    return remove_duplicate_dates(df, threshold, keys, ts)
