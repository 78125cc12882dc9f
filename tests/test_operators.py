"""Hand-made cases for the traps of each operator."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from joulemark.functions import scalars as S
from joulemark.operators import adequacy, alignment, features, metrics, validation


def at(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(f"2024-01-01 {text}" if len(text) <= 8 else text)


def frame(spark, rows, column="value", kind="double", site="a"):
    return spark.createDataFrame([(site, at(t), v) for t, v in rows], f"site_id string, ts timestamp_ntz, `{column}` {kind}")


def values(df, column="value"):
    return [r[column] for r in df.orderBy("site_id", "ts").collect()]


def test_asof_tie_takes_the_earlier(spark):
    left, right = frame(spark, [("01:00:00", 1.0)]), frame(spark, [("00:50:00", "early"), ("01:10:00", "late")], kind="string")
    assert values(alignment.asof_nearest(left, right, 600)) == ["early"]
    assert values(alignment.asof_nearest(left, right, 599)) == [None]


def test_gap_limit_from_each_end(spark):
    given = [1.0, *[None] * 7, 9.0, None, None, 12.0, None]
    df = frame(spark, [(f"{h:02d}:00:00", v) for h, v in enumerate(given)])
    out = alignment.align_by_value(df, df, 7200)
    assert values(out) == [1, 2, 3, None, None, None, 7, 8, 9, 10, 11, 12, None]


@pytest.mark.parametrize(("rows", "expected"), [
    ([("00:00:00", 10.0), ("00:00:00", 10.1), ("01:00:00", 0.0), ("02:00:00", 20.0)], 10.05),
    ([("00:00:00", 5.0), ("00:00:00", 15.0), ("01:00:00", 0.0), ("02:00:00", 20.0)], None),
    ([("00:00:00", 3.0), ("00:00:00", 3.0), ("01:00:00", 4.0), ("02:00:00", 4.0)], None),
])
def test_duplicates(spark, rows, expected):
    out = values(validation.remove_duplicate_dates(frame(spark, rows)))
    assert len(out) == 3
    assert out[0] == pytest.approx(expected) if expected else out[0] is None


def test_duplicates_of_text_are_an_error(spark):
    with pytest.raises(TypeError):
        validation.remove_duplicate_dates(frame(spark, [("00:00:00", "x")], kind="string"))


def test_filter(spark):
    df = frame(spark, [("00:00:00", -1.0), ("01:00:00", 0.0), ("02:00:00", 0.5), ("03:00:00", 99.0)])
    assert values(adequacy.filter_data(df, "value", max_value=50)) == [None, 0, 0.5, None]
    assert values(adequacy.filter_data(df, "value", allow_zero=False, allow_negative=True)) == [-1, None, 0.5, 99]


def test_grid(spark):
    out = adequacy.expand_dates(frame(spark, [("01:00:00", 1.0), ("01:15:00", 2.0), ("01:45:00", 3.0)]))
    assert out.count() == 96
    assert values(out)[4:8] == [1, 2, None, 3]


def test_rows_off_the_grid_are_lost_and_repeats_are_errors(spark):
    out = adequacy.expand_dates(frame(spark, [("00:00:00", 1.0), ("00:10:00", 2.0), ("00:25:00", 3.0)]))
    assert [v for v in values(out) if v] == [1, 2]
    with pytest.raises(ValueError):
        adequacy.expand_dates(frame(spark, [("00:00:00", 1.0), ("00:00:00", 2.0)]))


def test_daily_data_keep_their_rows(spark):
    df = frame(spark, [("2024-01-01 00:00:00", 1.0), ("2024-01-02 00:00:00", 2.0)])
    assert adequacy.expand_dates(df).count() == 2


def test_time_step_tie(spark):
    df = frame(spark, [("00:00:00", 1.0), ("02:00:00", 1.0), ("03:00:00", 1.0), ("04:00:00", 1.0), ("06:00:00", 1.0)])
    assert alignment.time_step(df).first()["step"] == 3_600_000_000


def test_gcd(spark):
    assert spark.range(1).select(alignment.gcd(F.array(*[F.lit(x).cast("long") for x in (45, 30, 60)])).alias("g")).first()["g"] == 15


def test_equal_steps_of_other_phase_are_null(spark):
    a = frame(spark, [(f"{h:02d}:00:00", 1.0) for h in range(5)])
    b = frame(spark, [(f"{h:02d}:05:00", 1.0) for h in range(5)])
    assert values(alignment.align_to_index(b, a, "value", 3600)) == [None] * 5


def test_fine_on_daily_is_an_error(spark):
    day = frame(spark, [("2024-01-01 00:00:00", 1.0), ("2024-01-02 00:00:00", 2.0)])
    with pytest.raises(NotImplementedError):
        alignment.align_to_index(frame(spark, [(f"{h:02d}:00:00", 1.0) for h in range(5)]), day)


def test_zero_tolerance_joins_exactly(spark):
    a = frame(spark, [(f"{h:02d}:00:00", 1.0) for h in range(3)])
    b = frame(spark, [("00:00:00", 1.0), ("00:30:00", 2.0), ("01:01:00", 3.0), ("01:31:00", 4.0)])
    assert values(alignment.align_to_index(b, a, "distance", 0)) == [1, None, None]


def test_daily_fill(spark):
    hours = frame(spark, [("2024-01-01 00:00:00", 0.0), ("2024-01-01 12:00:00", 0.0), ("2024-01-02 01:00:00", 0.0), ("2024-01-03 01:00:00", 0.0)])
    daily = frame(spark, [("2024-01-01 06:00:00", 1.0), ("2024-01-02 00:00:00", 2.0)], "price")
    assert values(alignment.align_daily(hours, daily), "price") == [1, 1, 2, None]


def test_cumulative_rate(spark):
    index = frame(spark, [("00:00:00", 0.0), ("01:00:00", 0.0), ("02:00:00", 0.0)])
    data = frame(spark, [("00:00:00", 5.0), ("00:30:00", 30.0), ("01:00:00", 30.0), ("01:30:00", 60.0), ("02:00:00", 60.0)], "used")
    out = alignment.align_cumulative(index, data, lambda a, b: alignment.asof_nearest(a, b, 600))
    assert values(out, "used") == [None, 1.0, 2.0]


def test_adequacy_mask(spark):
    labels = frame(spark, [("00:00:00", 1.0), ("01:00:00", 2.0), ("02:00:00", 3.0)], "consumption")
    known = frame(spark, [("00:00:00", 7.0), ("01:00:00", None)])
    assert values(adequacy.mask_labels(known, labels), "consumption") == [1, None, None]
    assert adequacy.check_data_adequacy(known, labels).first().asDict() == {"site_id": "a", "month": "M1", "missing_pct": 2 / 720}


def test_encoder(spark):
    df = spark.createDataFrame([("x", "a"), ("x", "a"), ("x", "b")], "site_id string, c string")
    e = features.SafeOrdinalEncoder().fit(df)
    assert [r["c"] for r in e.transform(spark.createDataFrame([("x", "c"), ("x", "b")], "site_id string, c string")).collect()] == [0, 1]
    assert features.SafeOrdinalEncoder(unknown_value=0).fit(df).unknown_value == 0
    with pytest.raises(ValueError):
        features.SafeOrdinalEncoder(["v"]).fit(spark.createDataFrame([("x", 1.0)], "site_id string, v double"))
    with pytest.raises(ValueError):
        features.SafeOrdinalEncoder().fit(spark.createDataFrame([("x", None)], "site_id string, c string"))


def test_metrics_and_impact(spark):
    y, p = frame(spark, [("00:00:00", 10.0), ("01:00:00", 20.0)], "consumption"), frame(spark, [("00:00:00", 8.0), ("01:00:00", 22.0)], "consumption")
    r = metrics.errors(y, p).first()
    assert (r["CVRMSE"], r["NMBE"]) == (pytest.approx(0.133333, abs=1e-6), 0)
    assert values(alignment.impact(p, y), "consumption") == [-2, 2]
    with pytest.raises(Exception, match="different times"):
        metrics.errors(y, p.where("consumption > 10")).collect()


def test_forward_model_off(spark):
    theta = {"u_value": 1, "T_sp_coo": 25, "T_sp_hea": 21, "T_sb_coo": 30, "T_sb_hea": 10, "eta": 0.5, "ach": 1, "alpha": 2, "beta": 7}
    row = spark.range(1).select(*(c.alias(k) for k, c in S.forward_model(theta, F.lit(0.0), F.lit(0.0), 100, 300).items())).first().asDict()
    assert row == {"cond_load_on": 0, "ven_load": 0, "cond_load_off": 1000, "plug_load": 7}
    assert spark.range(1).select(S.forward_model(theta, F.lit(None).cast("double"), F.lit(0.0), 1, 1)["plug_load"].alias("x")).first()["x"] is None


def test_names(spark):
    df = frame(spark, [("00:00:00", 1.0)]).withColumn("Unnamed: 0", F.lit(1))
    assert validation.drop_unnamed(validation.rebind_names(df, {"temperature": "value", "x": None, "y": "absent"})).columns == ["site_id", "ts", "temperature"]
    with pytest.raises(ValueError):
        validation.rebind_names(df, {"ts": "value"})
    with pytest.raises(ValueError):
        validation.same_columns(["a"], df)


def test_checks_keep_errors_as_data(spark):
    df = frame(spark, [("00:00:00", 1.0), ("01:00:00", None), ("02:00:00", 3.0)])
    assert not validation.check_column_values_unique(df, "value")
    assert validation.check_column_values_increasing(df, "value", "ts")
    assert not validation.check_column_values_not_null(df, "value")
    bad = validation.check_column_values_unique(df, "absent")
    assert bad.exception_info["raised_exception"] and bad.to_json_dict()["success"] is False


def test_validate_parses_and_merges(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", None, 2.0), ("a", None, 3.0), ("a", "2024-01-01 01:00:00", 4.0)], "site_id string, timestamp string, value double")
    assert values(validation.validate_dataset(df)) == [1, 4]
    with pytest.raises(ValueError):
        validation.validate_dataset(df.drop("timestamp"))


def test_partitions(spark):
    a, b = frame(spark, [("00:00:00", 1.0)]), frame(spark, [("01:00:00", 2.0)])
    assert values(alignment.validate_partitions([a, b])) == [1, 2]
    with pytest.raises(ValueError):
        alignment.union_partitions([a, a])
    with pytest.raises(ValueError):
        alignment.validate_partitions([a, frame(spark, [("01:00:00", 2.0)], "other")])


def test_partitions_that_repeat_a_time_of_their_own(spark):
    a, b = frame(spark, [("00:00:00", 1.0), ("00:00:00", 2.0)]), frame(spark, [("01:00:00", 3.0)])
    assert sorted(values(alignment.union_partitions([a, b])[0])) == [1, 2, 3]
    with pytest.raises(ValueError):
        alignment.union_partitions([a, b, frame(spark, [("00:00:00", 4.0)])])


def test_split_and_rounding(spark):
    df = features.time_split(frame(spark, [(f"{h:02d}:00:00", 1.0) for h in range(11)]))
    assert sum(r["validation"] for r in df.collect()) == 3
    assert spark.range(1).select(S.round1(F.lit(0.25)).alias("x")).first()["x"] == 0.3
    assert S.spark_pattern("%d/%m/%YT%H:%M") == "dd/MM/yyyy'T'HH:mm"


def test_lookup_raises(spark):
    with pytest.raises(Exception, match="no row"):
        alignment.lookup_rows(frame(spark, [("00:00:00", 1.0)]), frame(spark, [("05:00:00", 1.0)])).collect()


def series(spark, rows, *columns):
    return spark.createDataFrame([(k, f"2024-01-{d:02d} {h}", *v) for k, d, h, *v in rows], "site_id string, time_text string" + "".join(f", {c} double" for c in columns)).selectExpr("site_id", "cast(time_text as timestamp_ntz) ts", *columns)


def test_align_to_index_keeps_all_sites(spark):
    """Sites of equal steps, of finer data, of daily data, with one row, and without data: no row of the index goes."""
    hours = [f"{h:02d}:00:00" for h in range(4)]
    index = series(spark, [(k, 1, h) for k in ("same", "fine", "daily", "none") for h in hours] + [("one", 1, "02:00:00")])
    data = [("same", 1, h, 1.0 + i) for i, h in enumerate(hours)] + [("fine", 1, f"0{h}:{m}:00", h + int(m) / 60) for h in range(4) for m in ("05", "35")] + [("daily", d, "00:00:00", 10.0 * d) for d in (1, 2, 3)]
    data = series(spark, [*data, ("one", 1, "02:00:00", 7.0), ("none", 1, "01:00:00", 8.0)], "x")
    out = {(r["site_id"], r["ts"].hour): r["x"] for r in alignment.align_to_index(data, index, "distance", "10min").collect()}
    assert len(out) == 17 and [out["same", h] for h in range(4)] == [1, 2, 3, 4] and [out["daily", h] for h in range(4)] == [10] * 4
    assert [round(out["fine", h], 3) for h in range(4)] == [round(h + 5 / 60, 3) for h in range(4)]
    assert out["one", 2] == 7 and [out["none", h] for h in range(4)] == [None, 8, None, None]
    only = alignment.align_to_index(data.where("site_id in ('same', 'one')"), index.where("site_id in ('same', 'one')"), "value", 600)
    assert only.count() == 5


def test_alignment_by_column(spark):
    index = series(spark, [("a", 1, f"{h:02d}:00:00") for h in range(4)])
    data = series(spark, [("a", 1, f"{h:02d}:{m:02d}:00", float(h * 60 + m), 1.0, float(h)) for h in range(4) for m in (15, 30, 45)], "t", "q", "z")
    out = alignment.align_to_index(data, index, {"t": "value", "q": "distance"}, {"t": "180min", "q": 900}, {"q": True}).orderBy("ts").collect()
    assert [r["t"] for r in out] == [None, 60, 120, 180] and [r["z"] for r in out] == [None] * 4
    assert [r["q"] for r in out] == [None, pytest.approx(2 / 60), pytest.approx(3 / 60), pytest.approx(3 / 60)]
    with pytest.raises(ValueError):
        alignment.align_to_index(data, index, {"t": "nearest"})


def test_text_that_is_no_time_is_an_error(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 1.0), ("a", None, 2.0)], "site_id string, timestamp string, x double")
    assert validation.validate_dataset(df).count() == 1
    with pytest.raises(Exception, match="not in the format"):
        validation.validate_dataset(df, date_format="%d.%m.%Y %H:%M").collect()


def test_hours_that_a_zone_lacks(spark):
    df = series(spark, [("a", 31, f"{h:02d}:00:00", float(h)) for h in range(6)], "x").selectExpr("site_id", "ts + interval '60' day as ts", "x")  # 31 March
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert adequacy.steps(df).count() == 5 and alignment.time_step(df).first()["step"] == 3_600_000_000
        assert adequacy.expand_dates(df).where("x is not null").count() == 6
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
