"""Plain Python helpers: lists, options given as text, nested settings, and values for JSON."""

from __future__ import annotations

import datetime as dt
import decimal
import json
import warnings
from pathlib import Path
from typing import Any

import numpy as np
import pandas as pd


def as_list(x: Any) -> list:
    """None is no element; text and single values are one; sequences and sets are their elements."""
    if x is None:
        return []
    if isinstance(x, (list, tuple, set, frozenset, range, np.ndarray, pd.Series, pd.Index)):
        return list(x)
    return [x]


def as_series(x: Any) -> pd.Series:
    """A series as it is, the only column of a frame, or a series of values."""
    if isinstance(x, pd.DataFrame):
        if x.shape[1] != 1:
            raise ValueError("a frame of one column is needed")
        return x.iloc[:, 0]
    return x if isinstance(x, pd.Series) else pd.Series(x)


def flatten_dict(nested: dict, separator: str = "/") -> dict[str, Any]:
    """Keys of nested dicts joined; an empty dict stays a value, and None becomes the text None."""
    out: dict[str, Any] = {}
    for key, value in nested.items():
        if isinstance(value, dict) and value:
            out |= {f"{key}{separator}{k}": v for k, v in flatten_dict(value, separator).items()}
        else:
            out[str(key)] = "None" if value is None else value
    return out


def split_options(text: str | None) -> list[str]:
    return [x.strip() for x in (text or "").split(",") if x.strip()]


def parse_options(pairs) -> dict[str, Any]:
    """key=value texts as a dict; only the first = splits, and values that are JSON are read as such."""
    out = {}
    for pair in as_list(pairs):
        key, found, value = pair.partition("=")
        if not found or not key.strip():
            raise ValueError(f"{pair!r} is not key=value")
        try:
            out[key.strip()] = json.loads(value)
        except ValueError:
            out[key.strip()] = value
    return out


def dotted(pairs: dict[str, Any]) -> dict:
    """a.b.c keys as nested dicts."""
    out: dict = {}
    for key, value in pairs.items():
        at, (*parents, last) = out, key.split(".")
        for p in parents:
            at = at.setdefault(p, {})
        at[last] = value
    return out


def feed_dict(parameters: dict) -> dict[str, Any]:
    """`parameters`, and `params:a.b` of every setting at every depth."""
    out: dict[str, Any] = {"parameters": parameters}

    def add(prefix: str, value: Any) -> None:
        out[f"params:{prefix}"] = value
        if isinstance(value, dict):
            for k, v in value.items():
                add(f"{prefix}.{k}", v)

    for k, v in parameters.items():
        add(k, v)
    return out


def uri_to_string(uri: Any) -> str | None:
    """A path or address as text; local paths are made absolute."""
    if uri is None:
        return None
    text = str(uri)
    return text if "://" in text else Path(text).expanduser().resolve().as_posix()


def json_value(x: Any) -> Any:
    """x in terms of JSON: numpy and pandas values, dates, decimals (with a warning where digits are lost), sets.

    Raises TypeError for what has no such form."""
    if x is None or isinstance(x, (str, bool, int)):
        return x
    if isinstance(x, float):
        return None if x != x else x
    if isinstance(x, dict):
        return {str(json_value(k)): json_value(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set, frozenset, pd.Index, np.ndarray)):
        return [json_value(v) for v in (sorted(x, key=str) if isinstance(x, (set, frozenset)) else x)]
    if isinstance(x, np.generic):
        return json_value(x.item())
    if x is pd.NaT or x is pd.NA:
        return None
    if isinstance(x, (dt.datetime, dt.date, dt.time)):
        return x.isoformat()
    if isinstance(x, (dt.timedelta, pd.Timedelta)):
        return x.total_seconds()
    if isinstance(x, decimal.Decimal):
        if decimal.Decimal(repr(float(x))) != x:
            warnings.warn(f"{x} loses digits as a float", stacklevel=2)
        return float(x)
    if isinstance(x, pd.Series):
        return [{"index": json_value(i), "value": json_value(v)} for i, v in x.items()]
    if isinstance(x, pd.DataFrame):
        return [json_value(r) for r in x.to_dict("records")]
    if isinstance(x, Path):
        return x.as_posix()
    raise TypeError(f"{type(x).__name__} has no JSON form")


def ensure_json(x: Any) -> None:
    """Raises TypeError if json_value has no form for x."""
    json_value(x)
