"""Windows of a site's series. Every operator keeps sites apart, so that sites are worked on in parallel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Keys of a series, and its time.
KEYS, TS = ("site_id",), "ts"


def series(keys: Sequence[str] = KEYS, ts: str = TS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(ts)


def backwards(keys: Sequence[str] = KEYS, ts: str = TS) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.col(ts).desc())


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def fill_forward(c: Column, keys: Sequence[str] = KEYS, ts: str = TS) -> Column:
    return F.last(c, True).over(so_far(series(keys, ts)))


def fill_backward(c: Column, keys: Sequence[str] = KEYS, ts: str = TS) -> Column:
    """By the reversed order: a frame that reaches forward without bound would be read again for every row."""
    return F.last(c, True).over(so_far(backwards(keys, ts)))


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing; after this only null does."""
    return df.select([F.when(~F.isnan(c), F.col(f"`{c}`")).alias(c) if t in ("double", "float") else F.col(f"`{c}`") for c, t in df.dtypes])
