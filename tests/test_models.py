"""Models recover what was planted; helpers, catalog, command line and batches."""

import datetime as dt
import decimal

import numpy as np
import pandas as pd
import pytest

from joulemark.functions import helpers as H
from joulemark.models import activity as A
from joulemark.models import baseline as B
from joulemark.models.boosting import Booster, train_boost
from joulemark.models.splines import kalman_smooth, spline_basis
from joulemark.plans import cli, pipelines
from joulemark.sources.catalog import Catalog, RunLog, config, load_catalog
from joulemark.streaming.batches import score_batches


def building(days: int = 28, seed: int = 0) -> pd.DataFrame:
    r = np.random.default_rng(seed)
    t = pd.date_range("2024-01-01", periods=24 * days, freq="h")
    temperature = 15 + 10 * np.sin(np.arange(len(t)) * 2 * np.pi / 24) + r.normal(0, 1, len(t))
    busy = ((t.hour >= 8) & (t.hour < 18) & (t.dayofweek < 5)).astype(float)
    return pd.DataFrame({"site_id": "a", "ts": t, "temperature": temperature, "busy": busy, "consumption": 20 + 60 * busy + np.maximum(18 - temperature, 0) + r.normal(0, 1, len(t))})


@pytest.fixture(scope="module")
def tables(spark):
    df = spark.createDataFrame(building()).selectExpr("site_id", "cast(ts as timestamp_ntz) ts", "temperature", "consumption")
    return df.drop("consumption"), df.drop("temperature")


def test_splines_sum_to_one():
    b = spline_basis(np.linspace(0, 9, 50), 4)
    assert b.shape == (50, 6) and np.allclose(b.sum(1), 1) and spline_basis(np.ones(5), 3).shape == (5, 5)


def test_smoother_is_smoother_and_bridges_gaps():
    y = np.sin(np.arange(100) / 10) + np.random.default_rng(0).normal(0, 0.3, 100)
    s = kalman_smooth(y)
    assert np.abs(np.diff(s)).mean() < np.abs(np.diff(y)).mean() / 2
    y[40:50] = np.nan
    assert not np.isnan(kalman_smooth(y)).any() and np.isnan(kalman_smooth(np.full(3, np.nan))).all()


def test_boosting():
    r = np.random.default_rng(1)
    x = r.uniform(size=(600, 2))
    y = np.where(x[:, 0] > 0.5, 10, 0) + x[:, 1] + 5
    model, scores = train_boost(x, y, iterations=150)
    assert np.abs(model.predict(x) - y).mean() < 0.2 and scores["CVRMSE"] < 0.1 and len(model.trees) >= 100
    q = Booster(iterations=60, quantile=0.9)
    q.fit(np.zeros((600, 1)), y)
    assert np.mean(y <= q.predict(np.zeros((600, 1)))) == pytest.approx(0.9, abs=0.05)
    x[::7, 1] = np.nan
    Booster(iterations=5).fit(x, y)


def test_activity_finds_working_hours():
    x = A.with_time(building())
    act, found = A.estimate(x, x["consumption"].to_numpy(), exog="temperature", trials=20)
    assert act[x["busy"] == 1].mean() > 0.8 and act[x["busy"] == 0].mean() < 0.3 and 5 <= found["c1"] <= 100
    assert A.estimate(x.head(3), np.ones(3))[0].tolist() == [0, 0, 0]


def test_markov_finds_regimes():
    x = building()
    p = A.markov(x["consumption"].to_numpy(), x["temperature"].to_numpy())
    assert p[x["busy"] == 1].mean() > 0.95 and p[x["busy"] == 0].mean() < 0.05


def test_sampler_finds_planted_loads():
    r = np.random.default_rng(2)
    t, a = r.uniform(0, 38, 300), r.integers(0, 2, 300).astype(float)
    theta = dict(zip(B.THETA, (2.0, 25.5, 22.0, 32.0, 8.0, 0.5, 1.0, 30.0, 10.0), strict=True))
    y = B.loads(np.array([list(theta.values())]), t, a, 1, 10)[0]
    found = B.explain(t, a, y, 1, 10, walkers=40, samples=600)
    again = B.loads(np.array([list(found.values())]), t, a, 1, 10)[0]
    assert np.abs(again - y).mean() < 0.1 * y.mean()


def test_predictor_round_trip(spark, tables, tmp_path):
    x, y = tables
    s = pipelines.Settings(iterations=120, lags={"temperature": [1]})
    model, p = pipelines.fit_predict(x, y, s)
    r = pipelines.evaluate_on_test(y, p).first()
    assert r["CVRMSE"] < 0.1 and abs(r["NMBE"]) < 0.02
    model.save(f"{tmp_path}/m")
    again = B.UsagePredictor.load(spark, f"{tmp_path}/m")
    assert again.predict(x).exceptAll(p).isEmpty()
    with pytest.raises(ValueError):
        again.predict(x.drop("temperature"))
    diff = pipelines.evaluate_on_apply(y, p).agg({"consumption": "avg"}).first()[0]
    assert abs(diff) < 1


def test_adjusted_activity(tables):
    x, y = tables
    s = pipelines.Settings(n_trials=10, n_trials_adjust=30, iterations=120)
    activity = pipelines.create_activity(x, y, s).cache()
    model, p = pipelines.fit_predict_autoenc(x, y, activity, s)
    assert pipelines.evaluate_on_test_autoenc(y, p, activity, s).first()["CVRMSE"] < 0.2
    adjusted = pipelines.adjust_levels(x, y, model, s).toPandas()
    assert adjusted["activity"].between(0, 1).all() and len(adjusted) == y.count()


def test_batches(spark, tables, tmp_path):
    x, y = tables
    model, _ = pipelines.fit_predict(x, y, pipelines.Settings(iterations=100))
    both = x.join(y, ["site_id", "ts"])
    both.where("day(ts) < 10").coalesce(1).write.parquet(f"{tmp_path}/in/1")
    for part in ("day(ts) < 10", "day(ts) >= 10"):
        both.where(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/all")
    score_batches(spark, f"{tmp_path}/all", both.schema.simpleString()[7:-1].replace(":", " "), model, f"{tmp_path}/out", f"{tmp_path}/check", files=1).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == both.count()


def test_command_line(spark, tables, tmp_path):
    x, y = tables
    store = f"{tmp_path}/store"
    for ns in ("train", "test", "apply"):
        c = Catalog(store, "s", ns)
        x.drop("site_id").withColumnRenamed("ts", "timestamp").write.parquet(c.path("features"))
        y.drop("site_id").withColumnRenamed("ts", "timestamp").write.parquet(c.path("labels"))
        cli.main(["run", "all", "--store-uri", store, "--site", "s", "-ns", ns, "--param", "iterations=100"], spark)
    assert Catalog(store, "s", "test").load(spark, "metrics").first()["CVRMSE"] < 0.1
    assert set(load_catalog(spark, Catalog(store, "s", "apply"))) >= {"features", "labels", "prediction", "impact"}
    with pytest.raises(ValueError):
        Catalog(store, "s", "train", batch="b1")
    with pytest.raises(ValueError):
        cli.main(["run", "adjust", "--store-uri", store, "--site", "s"], spark)


def test_run_log(spark, tmp_path):
    log = RunLog(f"{tmp_path}/log")
    log.params(spark, "r1", {"a": {"b": 1}, "c": None})
    log.metrics(spark, "r1", {"CVRMSE": 0.1})
    assert {(r["kind"], r["key"], r["value"]) for r in log.read(spark).collect()} == {("param", "a/b", "1"), ("param", "c", '"None"'), ("metric", "CVRMSE", "0.1")}


def test_config(tmp_path):
    (tmp_path / "base").mkdir()
    (tmp_path / "env").mkdir()
    (tmp_path / "base/a.json").write_text('{"x": "${site}", "y": 1, "_hidden": 0}')
    (tmp_path / "env/a.json").write_text('{"y": 2}')
    assert config(tmp_path / "base", tmp_path / "env", {"site": "s"}) == {"x": "s", "y": 2}
    (tmp_path / "base/b.json").write_text('{"x": 1}')
    with pytest.raises(ValueError):
        config(tmp_path / "base")


def test_helpers():
    assert H.flatten_dict({"a": {"b": 1, "c": {}}, "d": None}) == {"a/b": 1, "a/c": {}, "d": "None"}
    assert H.parse_options(["a=1", "b=x=y", "c=[1,2]"]) == {"a": 1, "b": "x=y", "c": [1, 2]}
    assert H.dotted({"a.b": 1, "a.c": 2}) == {"a": {"b": 1, "c": 2}}
    assert H.feed_dict({"a": {"b": 1}})["params:a.b"] == 1
    assert H.as_list(None) == [] and H.as_list("ab") == ["ab"] and H.as_list((1, 2)) == [1, 2]
    assert H.as_series(pd.DataFrame({"a": [1]})).tolist() == [1]
    with pytest.warns(UserWarning):
        assert H.json_value({"a": np.int64(1), "d": decimal.Decimal("0.10000000000000000001"), "t": dt.date(2024, 1, 1), "s": {2, 1}, "n": float("nan")}) == {"a": 1, "d": 0.1, "t": "2024-01-01", "s": [1, 2], "n": None}
    with pytest.raises(TypeError):
        H.ensure_json(object())


def test_csv_columns_go_by_name(spark, tmp_path):
    folder = tmp_path / "s/01_raw/train/features"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("timestamp;temperature;humidity\n2024-01-01 00:00:00;1.5;50\n")
    (folder / "b.csv").write_text("timestamp;humidity;temperature\n2024-01-01 01:00:00;60.5;2\n")
    (folder / "c.csv").write_text("timestamp;holiday\n2024-01-01 00:00:00;yes\n")
    c = Catalog(str(tmp_path), "s", input_format={"features": "csv", "labels": "parquet"}, load_args={"features": {"sep": ";"}, "labels": {}})
    parts = {frozenset(df.columns): df for df in c.partitions(spark, "features")}
    both = parts[frozenset({"site_id", "timestamp", "temperature", "humidity"})]
    assert {(r["temperature"], r["humidity"]) for r in both.collect()} == {(1.5, 50.0), (2.0, 60.5)} and dict(both.dtypes)["temperature"] == "double"
    assert parts[frozenset({"site_id", "timestamp", "holiday"})].count() == 1


def test_runs_are_cut_by_nodes():
    names = lambda **k: [f.__name__ for f in cli.sliced(cli.PIPELINES["all"], **k)]
    assert names() == ["preprocess", "predict", "evaluate"] and names(nodes=["predict"]) == ["predict"]
    assert names(from_nodes=["predict"]) == names(from_inputs=["preprocessed"]) == ["predict", "evaluate"]
    assert names(to_nodes=["predict"]) == names(to_outputs=["model"]) == ["preprocess", "predict"]
    with pytest.raises(ValueError):
        names(nodes=["absent"])


def test_objectives_of_the_activity_search():
    """Against their definitions, written out."""
    r = np.random.default_rng(3)
    raw, exog = np.floor(r.uniform(size=80) * 10 + 0.5) / 10, r.uniform(0, 30, 80)
    y = 5 + 10 * raw + exog + r.normal(size=80)
    c1, c2 = 20, 0.4
    s = 1 / (1 + np.exp(-c1 * (raw - c2)))
    s = (s - s.min()) / (s.max() - s.min())
    plain = np.array([0 if v < 0.1 else 1 if v > 0.9 else v for v in s])
    assert np.allclose(A.trimmed(raw, c1, c2), plain)
    rounded = np.array([0 if v < 0.1 else 1 if v > 0.9 else np.floor(v * 10 + 0.5) / 10 for v in s])
    assert np.allclose(A.trimmed(raw, c1, c2, True), rounded)
    basis = spline_basis(exog, 4)

    def solved(b, w):
        return b @ np.linalg.pinv(b.T @ (b * w[:, None])) @ (b.T @ (w * y))

    expected = np.mean((y - plain * solved(basis, plain) - (1 - plain) * solved(basis, 1 - plain)) ** 2)
    assert A.weighted_error(plain, basis, y) == pytest.approx(expected, rel=1e-6)
    full = np.array([np.outer(a, b).ravel() for a, b in zip(spline_basis(rounded, 3), basis, strict=True)])
    p = solved(full, np.ones(80))
    smooth = kalman_smooth(y)
    cv = lambda v: np.sqrt(np.mean((v - p) ** 2)) / np.mean(v)
    assert A.overfit_proxy(rounded, exog, y, smooth) == pytest.approx(abs(cv(smooth) - cv(y)), rel=1e-4)


def test_hurdle():
    x = building()
    y = np.where(x["busy"] == 1, x["consumption"], 0.0)
    act, _ = A.estimate(A.with_time(x), y, trials=20, hurdle=True, trees={0.99: 60, 0.01: 40})
    assert (act[y == 0] == 0).all() and act[y > 0].mean() > 0.3
