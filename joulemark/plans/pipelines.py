"""The engine's pipelines over a site's tables: preprocess, predict, evaluate, adjust."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..models.activity import estimate_activity
from ..models.baseline import UsagePredictor, adjust_activity
from ..operators.adequacy import check_data_adequacy, expand_dates, filter_data
from ..operators.alignment import impact, semi, validate_partitions, with_activity
from ..operators.features import in_use
from ..operators.metrics import errors
from ..operators.validation import fill_categorical, only_consumption


@dataclass
class Settings:
    """What the pipelines go by. alignment: mode, tolerance (seconds, or text such as 180min) and cumulative, each for all
    columns or by column. conditions are what the quantile regressions of activity see; _hour and _weekday may be among
    them. Names that a table lacks are passed over."""

    rebind_names: dict = field(default_factory=dict)
    date_format: str = "%Y-%m-%d %H:%M:%S"
    threshold: float = 0.25
    alignment: dict = field(default_factory=lambda: {"mode": {"temperature": "value"}, "tolerance": {"temperature": "180min"}, "cumulative": {"temperature": False, "consumption": True}})
    filter: dict = field(default_factory=dict)
    max_missing_pct: float = 0.1
    exog: str = "temperature"
    conditions: Sequence[str] = ("temperature",)
    cat_features: Sequence[str] = ("holiday",)
    lags: dict = field(default_factory=lambda: {"temperature": [1, 2, 24]})
    n_trials: int = 200
    n_trials_adjust: int = 500
    upper_bound: float = 2.0
    assume_hurdle: bool = False
    validation_size: float = 0.2
    iterations: int = 10_000


def validate_inputs(features: Sequence[DataFrame], labels: Sequence[DataFrame], s: Settings) -> tuple[DataFrame, DataFrame]:
    """Labels first; features are aligned to their times. Categories that miss become a value, labels that miss go."""
    y = only_consumption(validate_partitions(labels, names=s.rebind_names, date_format=s.date_format, threshold=s.threshold))
    a = s.alignment
    x = validate_partitions(features, y, a.get("mode"), a.get("tolerance"), a.get("cumulative") or False, s.rebind_names, s.date_format, s.threshold)
    y = y.dropna(subset=["consumption"])
    return semi(fill_categorical(x), y), y


def evaluate_inputs(features: DataFrame, labels: DataFrame, s: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Implausible labels taken out on a regular grid; with the adequacy report."""
    y = filter_data(expand_dates(labels), "consumption", **s.filter)
    report = check_data_adequacy(features, y)
    y = y.dropna(subset=["consumption"])
    return semi(features, y), y, report.withColumn("adequate", F.col("missing_pct") <= s.max_missing_pct)


def create_activity(features: DataFrame, labels: DataFrame, s: Settings, adjusted: DataFrame | None = None) -> DataFrame:
    """Activity of the labels' times; adjusted activity takes its place where there is one."""
    if adjusted is not None:
        return adjusted
    both = features.join(labels.select("site_id", "ts", "consumption"), ["site_id", "ts"])
    return estimate_activity(both, s.conditions, s.exog, n_trials=s.n_trials, assume_hurdle=s.assume_hurdle)


def predictor(s: Settings, skip_calendar: bool = False) -> UsagePredictor:
    return UsagePredictor(s.lags, s.cat_features, s.validation_size, skip_calendar, s.iterations)


def fit_predict(features: DataFrame, labels: DataFrame, s: Settings) -> tuple[UsagePredictor, DataFrame]:
    """The model and what it says of its own rows; in_sample has the errors."""
    model = predictor(s).fit(features, labels)
    return model, model.predict(features)


def fit_predict_autoenc(features: DataFrame, labels: DataFrame, activity: DataFrame, s: Settings) -> tuple[UsagePredictor, DataFrame]:
    """With activity: under a hurdle the model is of full activity and has a calendar; else activity is a feature."""
    if s.assume_hurdle:
        model = predictor(s).fit(in_use(features, activity), in_use(labels, activity))
        return model, model.predict(features)
    x = with_activity(features, activity)
    model = predictor(s, skip_calendar=True).fit(x, labels)
    return model, model.predict(x)


def in_sample(labels: DataFrame, prediction: DataFrame, activity: DataFrame | None = None, s: Settings | None = None) -> DataFrame:
    """CVRMSE and NMBE of a fitted model on its own rows; under a hurdle, of those in use."""
    return errors(labels, prediction) if activity is None else evaluate_on_test_autoenc(labels, prediction, activity, s)


def predict(model: UsagePredictor, features: DataFrame) -> DataFrame:
    return model.predict(features)


def predict_autoenc(model: UsagePredictor, features: DataFrame, activity: DataFrame, s: Settings) -> DataFrame:
    return model.predict(features if s.assume_hurdle else with_activity(features, activity))


def evaluate_on_test(labels: DataFrame, prediction: DataFrame) -> DataFrame:
    return errors(labels, prediction)


def evaluate_on_test_autoenc(labels: DataFrame, prediction: DataFrame, activity: DataFrame, s: Settings) -> DataFrame:
    if s.assume_hurdle:
        labels, prediction = in_use(labels, activity), in_use(prediction, activity)
    return errors(labels, prediction)


def evaluate_on_apply(labels: DataFrame, prediction: DataFrame) -> DataFrame:
    return impact(prediction, labels)


def evaluate_on_apply_autoenc(labels: DataFrame, prediction: DataFrame, activity: DataFrame, s: Settings) -> DataFrame:
    out = impact(prediction, labels)
    if not s.assume_hurdle:
        return out
    return out.join(activity, ["site_id", "ts"], "left").select("site_id", "ts", (F.col("consumption") * F.col("activity")).alias("consumption"))


def adjust_levels(features: DataFrame, labels: DataFrame, model: UsagePredictor, s: Settings) -> DataFrame:
    both = features.join(labels.select("site_id", "ts", "consumption"), ["site_id", "ts"])
    return adjust_activity(both, model, s.conditions, n_trials=s.n_trials_adjust, upper_bound=s.upper_bound, assume_hurdle=s.assume_hurdle)
