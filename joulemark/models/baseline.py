"""Baseline models of consumption: the usage predictor, and the physical explanation of a prediction."""

from __future__ import annotations

import pickle
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import CP, ON, RHO
from ..operators.common import KEYS, TS
from ..operators.features import SafeOrdinalEncoder, add_calendar, create_lagged
from ..operators.validation import same_columns
from ..sources.session import ship
from .activity import _matrix, adjust, raw_activity, with_time
from .boosting import train_boost

#: Parameters of the physical model and the boxes of their priors; alpha and beta go by the data.
THETA = ("u_value", "T_sp_coo", "T_sp_hea", "T_sb_coo", "T_sb_hea", "eta", "ach", "alpha", "beta")
PRIORS = {"u_value": (0.5, 5), "T_sp_coo": (24, 27), "T_sp_hea": (20, 24), "T_sb_coo": (24, 35), "T_sb_hea": (5, 20), "eta": (0, 1), "ach": (0.3, 5)}
#: Boxes around whose middle the walkers of the set-back points begin.
STARTS = {"T_sb_coo": (30, 35), "T_sb_hea": (5, 10)}


@dataclass
class UsagePredictor:
    """Encoded categories, lags and calendar, then a boosted model for each site. models: a row for each site."""

    lags: dict[str, Sequence[int]] = field(default_factory=dict)
    cat_features: Sequence[str] = ()
    validation_size: float = 0.2
    skip_calendar: bool = False
    iterations: int = 10_000
    keys: Sequence[str] = KEYS
    ts: str = TS
    encoder: SafeOrdinalEncoder | None = None
    columns: list[str] | None = None
    models: DataFrame | None = None

    def _prepared(self, x: DataFrame) -> DataFrame:
        x = self.encoder.transform(x)
        x = create_lagged(x, self.lags, self.keys, self.ts)
        x = x.toDF(*(c.replace(".", "_") for c in x.columns))  # grouped functions take no dots in names
        return x if self.skip_calendar else add_calendar(x, self.ts)

    def _inputs(self, x: DataFrame) -> list[str]:
        return [c for c in x.columns if c not in (*self.keys, self.ts, "consumption")]

    def fit(self, x: DataFrame, y: DataFrame) -> UsagePredictor:
        self.columns = list(x.columns)
        self.encoder = SafeOrdinalEncoder([c for c in self.cat_features if c in x.columns]).fit(x, self.keys)
        data = self._prepared(x).join(y.select(*self.keys, self.ts, "consumption"), [*self.keys, self.ts]).where("consumption is not null")
        inputs, ts, keys, size, most = self._inputs(data), self.ts, list(self.keys), self.validation_size, self.iterations
        ship(x.sparkSession)

        def run(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(ts)
            target = g["consumption"].to_numpy(float)
            model, scores = train_boost(_matrix(g, inputs), target, size, most)
            return g[keys].head(1).assign(model=[pickle.dumps(model)], negative=bool((target < 0).any()), learn=scores["learn"], validation=scores["validation"], CVRMSE=scores["CVRMSE"], rows=len(g))

        schema = ", ".join(f"{k} {data.schema[k].dataType.simpleString()}" for k in keys) + ", model binary, negative boolean, learn double, validation double, CVRMSE double, rows long"
        self.models = data.groupBy(*keys).applyInPandas(run, schema)
        return self

    def scores(self) -> DataFrame:
        return self.models.drop("model", "negative")

    def predict(self, x: DataFrame) -> DataFrame:
        """keys, ts and consumption; not below 0 unless a site's training labels were. Sites without a model are left out."""
        same_columns(self.columns, x)
        ship(x.sparkSession)
        data = self._prepared(x)
        inputs, ts, keys = self._inputs(data), self.ts, list(self.keys)

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if left.empty or right.empty:
                return pd.DataFrame({**{c: left[c].head(0) for c in (*keys, ts)}, "consumption": pd.Series(dtype=float)})
            p = pickle.loads(right["model"].iat[0]).predict(_matrix(left, inputs))
            return left[[*keys, ts]].assign(consumption=p if right["negative"].iat[0] else np.maximum(p, 0))

        schema = ", ".join(f"{c} {data.schema[c].dataType.simpleString()}" for c in (*keys, ts)) + ", consumption double"
        return data.groupBy(*keys).cogroup(self.models.groupBy(*keys)).applyInPandas(run, schema)

    def save(self, path: str) -> None:
        """The models as a table, and the settings beside them; both by Spark, wherever path lies."""
        self.models.write.mode("overwrite").parquet(f"{path}/models")
        settings = pickle.dumps({k: v for k, v in self.__dict__.items() if k != "models"})
        self.models.sparkSession.createDataFrame([(settings,)], "settings binary").coalesce(1).write.mode("overwrite").parquet(f"{path}/settings")

    @classmethod
    def load(cls, spark, path: str) -> UsagePredictor:
        settings = pickle.loads(spark.read.parquet(f"{path}/settings").first()[0])
        return cls(**settings, models=spark.read.parquet(f"{path}/models"))


def adjust_activity(df: DataFrame, predictor: UsagePredictor, conditions: Sequence[str] = ("temperature",), column: str = "consumption", n_trials: int = 500, upper_bound: float = 2.0, assume_hurdle: bool = False, seed: int = 0, keys: Sequence[str] = KEYS, ts: str = TS) -> DataFrame:
    """keys, ts and the activity under which each site's trained model tells its new consumption best.

    predictor was fitted to activity among other features, without lags of it; df has its features but activity, and
    consumption. Under a hurdle rows without consumption have raw activity 0."""
    if "activity" not in predictor.columns:
        raise ValueError("the predictor knows no activity")
    if "activity" in predictor.lags:
        raise ValueError("the predictor knows lags of activity")
    ship(df.sparkSession)
    data = predictor._prepared(df.withColumn("activity", F.lit(0.0)).select(*predictor.columns, column))
    order = predictor._inputs(data)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({**{c: left[c].head(0) for c in (*keys, ts)}, "activity": pd.Series(dtype=float)})
        x = with_time(left.sort_values(ts), ts).dropna(subset=[column])
        model, y = pickle.loads(right["model"].iat[0]), x[column].to_numpy(float)
        raw = raw_activity(x, y, conditions, assume_hurdle)
        act, _ = adjust(raw, y, lambda a: model.predict(_matrix(x.assign(activity=a), order)), n_trials, upper_bound, seed)
        return x[[*keys, ts]].assign(activity=act)

    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (*keys, ts)) + ", activity double"
    return data.groupBy(*keys).cogroup(predictor.models.groupBy(*keys)).applyInPandas(run, schema)


def boxes(y: np.ndarray, priors: dict | None = None) -> dict[str, tuple[float, float]]:
    return PRIORS | {"alpha": (0.0, float(y.max() - y.min())), "beta": (0.0, float(y.min()))} | (priors or {})


def loads(theta: np.ndarray, temperature: np.ndarray, activity: np.ndarray, area: float, volume: float) -> np.ndarray:
    """Total load by walker and row; theta (walkers, 9) in THETA's order."""
    u, coo, hea, sb_coo, sb_hea, eta, ach, alpha, beta = (theta[:, [k]] for k in range(9))
    on = activity > ON
    need = np.where(on, np.maximum(np.maximum(temperature - coo, hea - temperature), 0), np.maximum(np.maximum(temperature - sb_coo, sb_hea - temperature), 0))
    air = np.where(on, CP * RHO * volume / 3600 * ach * (1 - eta), 0)
    return (area * u + air) * need + alpha * activity + beta


def log_probability(theta: np.ndarray, temperature: np.ndarray, activity: np.ndarray, y: np.ndarray, area: float, volume: float, box: dict) -> np.ndarray:
    """Uniform within the boxes, with the order of set points and set-backs; half the squared error is taken off."""
    limits = np.array([box[k] for k in THETA])
    fine = ((theta >= limits[:, 0]) & (theta <= limits[:, 1])).all(1)
    _, coo, hea, sb_coo, sb_hea = theta[:, :5].T
    fine &= (coo >= hea) & (sb_coo >= sb_hea) & (coo <= sb_coo) & (hea >= sb_hea)
    out = np.full(len(theta), -np.inf)
    if fine.any():
        out[fine] = -0.5 * ((y - loads(theta[fine], temperature, activity, area, volume)) ** 2).sum(1)
    return out


def sample_posterior(log_p, start: np.ndarray, steps: int, burn: int = 100, thin: int = 15, seed: int = 0, stretch: float = 2.0) -> np.ndarray:
    """Affine-invariant stretch moves (Goodman and Weare, 2010): each half of the walkers moves along lines through the other."""
    r, x = np.random.default_rng(seed), start.copy()
    p, n, d = log_p(x), *start.shape
    kept = []
    for k in range(steps):
        for own, other in ((np.arange(0, n, 2), np.arange(1, n, 2)), (np.arange(1, n, 2), np.arange(0, n, 2))):
            z = ((stretch - 1) * r.random(len(own)) + 1) ** 2 / stretch
            partner = x[r.choice(other, len(own))]
            new = partner + z[:, None] * (x[own] - partner)
            q = log_p(new)
            with np.errstate(invalid="ignore"):
                gain = (d - 1) * np.log(z) + np.where(np.isfinite(q), q, -np.inf) - np.where(np.isfinite(p[own]), p[own], -1e300)
            take = np.log(r.random(len(own))) < gain
            x[own[take]], p[own[take]] = new[take], q[take]
        if k >= burn and (k - burn + 1) % thin == 0:
            kept.append(x.copy())
    return np.concatenate(kept) if kept else x


def explain(temperature: np.ndarray, activity: np.ndarray, y: np.ndarray, area: float, volume: float, walkers: int = 100, samples: int = 1000, priors: dict | None = None, seed: int = 0) -> dict[str, float]:
    """Posterior means of THETA."""
    box = boxes(y, priors)
    start = {k: (priors or {}).get(k, STARTS.get(k, box[k])) for k in THETA}
    middle = np.array([sum(start[k]) / 2 for k in THETA])
    x = middle + np.random.default_rng(seed).normal(size=(max(walkers, 20) // 2 * 2, len(THETA)))
    chain = sample_posterior(lambda t: log_probability(t, temperature, activity, y, area, volume, box), x, samples, min(100, samples // 2), seed=seed)
    good = np.isfinite(log_probability(chain, temperature, activity, y, area, volume, box))
    return dict(zip(THETA, (chain[good] if good.any() else chain).mean(0).tolist(), strict=True))


def explain_prediction(df: DataFrame, area: float, volume: float, n_walkers: int = 100, n_samples: int = 1000, priors: dict | None = None, seed: int = 0, keys: Sequence[str] = KEYS, ts: str = TS, column: str = "consumption") -> DataFrame:
    """df (temperature, activity, consumption) with the four loads of each site's posterior mean. Sampling runs by site;
    the loads are the forward model as expressions."""
    ship(df.sparkSession)

    def run(x: pd.DataFrame) -> pd.DataFrame:
        own = x.sort_values(ts).dropna(subset=["temperature", "activity", column])
        theta = explain(own["temperature"].to_numpy(float), own["activity"].to_numpy(float), own[column].to_numpy(float), area, volume, n_walkers, n_samples, priors, seed)
        return x[list(keys)].head(1).assign(**{f"_{k}": v for k, v in theta.items()})

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + "".join(f", _{k} double" for k in THETA)
    theta = df.groupBy(*keys).applyInPandas(run, schema)
    out = df.join(theta, list(keys))
    return out.withColumns(site_loads(area, volume)).drop(*(f"_{k}" for k in THETA))


def site_loads(area: float, volume: float) -> dict:
    """The forward model on parameters in columns _u_value and so on."""
    t, a = F.col("temperature"), F.col("activity")
    p = {k: F.col(f"_{k}") for k in THETA}
    out = lambda heat, cool: F.greatest(t - cool, heat - t, F.lit(0.0))
    on, known = a > ON, t.isNotNull() & a.isNotNull()
    work, rest = out(p["T_sp_hea"], p["T_sp_coo"]), out(p["T_sb_hea"], p["T_sb_coo"])
    loads_ = {
        "cond_load_on": F.when(on, area * p["u_value"] * work).otherwise(0.0), "ven_load": F.when(on, F.lit(CP * RHO * volume / 3600) * p["ach"] * (1 - p["eta"]) * work).otherwise(0.0),
        "cond_load_off": F.when(on, 0.0).otherwise(area * p["u_value"] * rest), "plug_load": p["alpha"] * a + p["beta"],
    }
    return {k: F.when(known, v) for k, v in loads_.items()}
