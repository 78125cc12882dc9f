"""Scalar expressions: time, calendar, clipping, bins, tensor products and the building's forward model."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Spark's datetime patterns call the strftime codes.
STRFTIME = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%I": "hh", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%p": "a", "%j": "DDD", "%b": "MMM", "%B": "MMMM", "%a": "E", "%A": "EEEE", "%z": "xx", "%Z": "z", "%%": "%"}
#: Air's specific heat (kJ/kg K) and density (kg/m3) in the forward model, and the activity from which a building counts as on.
CP, RHO, ON = 1.005, 1.2, 1e-5


def spark_pattern(strftime: str) -> str:
    """Spark's datetime pattern for a strftime format; other letters are quoted."""
    out = []
    for part in re.findall(r"%.|[A-Za-z]+|[^%A-Za-z]+", strftime):
        if part[0] == "%":
            if part not in STRFTIME:
                raise ValueError(f"no pattern for {part}")
            out.append(STRFTIME[part])
        else:
            out.append(f"'{part}'" if part.isalpha() else part)
    return "".join(out)


def parse_timestamp(c: str, date_format: str = "%Y-%m-%d %H:%M:%S") -> Column:
    """Null where the text does not fit the format."""
    return F.try_to_timestamp(F.col(c), F.lit(spark_pattern(date_format))).cast("timestamp_ntz")


def strict_timestamp(c: str, date_format: str = "%Y-%m-%d %H:%M:%S") -> Column:
    """Null where the text is null; text that does not fit the format is an error when the row is read."""
    parsed = parse_timestamp(c, date_format)
    wrong = F.raise_error(F.concat(F.lit(f"not in the format {date_format}: "), F.col(c)))
    return F.when(parsed.isNotNull() | F.col(c).isNull(), parsed).otherwise(wrong.cast("timestamp_ntz"))


def ntz(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without zone, by its own days, hours, minutes and seconds: the session's
    zone, in which an hour may be missing, has no part in it."""
    t = (F.col(c) if isinstance(c, str) else c).cast("timestamp_ntz")
    seconds = F.unix_date(t.cast("date")).cast("long") * 86400 + F.hour(t) * 3600 + F.minute(t) * 60
    return seconds * 1_000_000 + (F.extract(F.lit("SECOND"), t) * 1_000_000).cast("long")


def from_micros(c: Column) -> Column:
    return F.to_timestamp_ntz(F.lit("1970-01-01")) + F.make_dt_interval(secs=(c.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))


def minutes_between(a: Column, b: Column) -> Column:
    return (micros(b) - micros(a)) / F.lit(60e6)


def calendar(ts: str = "ts") -> dict[str, Column]:
    """hour, dayofweek (Monday 0) and ISO week."""
    t = F.col(ts)
    return {"hour": F.hour(t), "dayofweek": F.weekday(t), "week": F.weekofyear(t)}


def month_day_hour(ts: str = "ts") -> dict[str, Column]:
    t = F.col(ts)
    return {"month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t)}


def sigmoid(x: Column, c1, c2) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(c1) * (x - F.lit(c2))))


def round1(x: Column) -> Column:
    """To one decimal, halves upwards, alike in every engine."""
    return F.floor(x * 10 + 0.5) / F.lit(10.0)


def snap(x: Column, rounded: bool = False) -> Column:
    """Below 0.1 to 0 and above 0.9 to 1; else as it is, or to one decimal."""
    return F.when(x < 0.1, 0.0).when(x > 0.9, 1.0).otherwise(round1(x) if rounded else x)


def clip(x: Column, low=None, high=None) -> Column:
    """Null stays null."""
    out = x
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(x.isNotNull(), out)


def tensor_product(a: Column, b: Column, reshape: bool = True) -> Column:
    """Outer product of two arrays, row by row; flat, or an array for each element of a."""
    out = F.transform(a, lambda x: F.transform(b, lambda y: x * y))
    return F.flatten(out) if reshape else out


def uniform_bin(x: Column, low, high, bins: int) -> Column:
    """0 to bins - 1 by equal widths; low and high are the ends of the first and the last."""
    width = (F.lit(high) - F.lit(low)) / F.lit(float(bins))
    return clip(F.floor(F.when(width > 0, (x - F.lit(low)) / width).otherwise(0.0)), 0, bins - 1).cast("int")


def one_hot(x: Column, bins: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: (k == x).cast("double"))


def lag_name(feature: str, lag: int) -> str:
    return f"L{lag}.{feature}"


def month_name(ts: str = "ts") -> Column:
    return F.concat(F.lit("M"), F.month(F.col(ts)).cast("string"))


def categorical_columns(df: DataFrame, int_is_categorical: bool = False) -> list[str]:
    """Text and boolean columns, and whole numbers where they count as such; never datetimes."""
    kinds = (T.StringType, T.BooleanType) + ((T.IntegralType,) if int_is_categorical else ())
    return [f.name for f in df.schema if isinstance(f.dataType, kinds)]


def forward_model(theta: dict[str, float], temperature: Column, activity: Column, area: float, volume: float, cp: float = CP, rho: float = RHO) -> dict[str, Column]:
    """Loads of a building: conduction while on and while off, ventilation while on, and plugs. Null where an input is null.

    theta: u_value, set points T_sp_coo and T_sp_hea, set-back points T_sb_coo and T_sb_hea, heat recovery eta, air
    changes ach (an hour), plug load alpha x activity + beta.
    """
    p = {k: F.lit(float(v)) for k, v in theta.items()}
    outside = lambda heat, cool: F.greatest(temperature - cool, heat - temperature, F.lit(0.0))
    on, known = activity > ON, temperature.isNotNull() & activity.isNotNull()
    working, resting = outside(p["T_sp_hea"], p["T_sp_coo"]), outside(p["T_sb_hea"], p["T_sb_coo"])
    conduction = F.lit(float(area)) * p["u_value"]
    air = F.lit(cp * rho * float(volume) / 3600.0) * p["ach"] * (F.lit(1.0) - p["eta"])
    loads = {
        "cond_load_on": F.when(on, conduction * working).otherwise(0.0), "ven_load": F.when(on, air * working).otherwise(0.0),
        "cond_load_off": F.when(on, 0.0).otherwise(conduction * resting), "plug_load": p["alpha"] * activity + p["beta"],
    }
    return {k: F.when(known, v) for k, v in loads.items()}
