"""The registered queries of the engine and their SQL.

The tables hold no energy data, so other series stand in: hourly sums of event values are consumption, view events at
their own times a temperature, and users modulo 4 the sites. SQL_FOR turns each operator's contract into DuckDB's SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..models import activity as A
from ..models import baseline as B
from ..operators import adequacy, alignment, features, metrics, validation
from ..operators.common import fill_backward, fill_forward, series
from . import pipelines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SITES = 4


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql if sql.lstrip().startswith("WITH RECURSIVE") else f"WITH {BASE}\n{sql}"
        return f

    return add


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    return e.select("event_id", (F.col("user_id") % SITES).cast("string").alias("site_id"), "ts", "event_type", "value")


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    """Labels: consumption by site and hour, exact in hundredths."""
    e = events(spark, sf)
    return e.groupBy("site_id", S.ntz(F.date_trunc("hour", "ts")).alias("ts")).agg((F.sum(F.round(F.col("value") * 100).cast("long")) / 100.0).alias("consumption"))


def kind(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return events(spark, sf).where(F.col("event_type") == name)


def minute(spark: SparkSession, sf: str) -> DataFrame:
    """Readings whose times repeat: events by the half hour."""
    half = 1_800_000_000
    return events(spark, sf).select("site_id", S.from_micros(F.floor(S.micros("ts") / half) * half).alias("ts"), "value", "event_id")


def views(spark: SparkSession, sf: str) -> DataFrame:
    """A feature by the minute, once for each."""
    v = kind(spark, sf, "view")
    w = Window.partitionBy("site_id", F.date_trunc("minute", "ts")).orderBy("ts", "event_id")
    v = v.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    return v.select("site_id", S.ntz(F.date_trunc("minute", "ts")).alias("ts"), F.col("value").alias("temperature"))


BASE = f"""
ev AS (SELECT event_id, (user_id % {SITES})::VARCHAR AS site_id, ts, event_type, value FROM events),
hourly AS MATERIALIZED (SELECT site_id, date_trunc('hour', ts)::TIMESTAMP AS ts, sum(round(value * 100)::BIGINT) / 100.0 AS consumption FROM ev GROUP BY 1, 2),
readings AS MATERIALIZED (SELECT site_id, time_bucket(INTERVAL 30 MINUTE, ts)::TIMESTAMP AS ts, value, event_id FROM ev),
views AS MATERIALIZED (SELECT site_id, date_trunc('minute', ts)::TIMESTAMP AS ts, value AS temperature FROM ev WHERE event_type = 'view'
  QUALIFY row_number() OVER (PARTITION BY site_id, date_trunc('minute', ts) ORDER BY ts, event_id) = 1),
per AS MATERIALIZED (SELECT site_id, ts, count(*) AS n, avg(value) AS mean, max(value) - min(value) AS range FROM readings GROUP BY ALL),
spread AS (SELECT site_id, stddev_pop(CASE WHEN n = 1 THEN mean END) AS std FROM per GROUP BY 1),
clean AS MATERIALIZED (SELECT site_id, ts, CASE WHEN n = 1 OR range < 0.25 * std THEN mean END AS value FROM per JOIN spread USING (site_id)),
gaps AS (SELECT site_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY site_id ORDER BY ts) AS step FROM clean)"""


# ---- projection, predicates, checks

@query("SELECT event_id, CASE WHEN NOT (value < 5 OR value > 90 OR abs(value) <= 1e-5 OR value < 0) THEN value END AS value FROM events")
def filter_data(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "value")
    return adequacy.filter_data(e, "value", min_value=5, max_value=90, allow_zero=False)


@query("SELECT (SELECT count(*) FROM readings WHERE value IS NULL)::BIGINT AS nulls_before, (SELECT max(value < 0) FROM readings) AS any_negative, (SELECT count(*) FROM readings WHERE value > 90 OR value < 0)::BIGINT AS nulls_after")
def nulls_added(spark, sf):
    df = minute(spark, sf)
    return adequacy.nulls_added(df, adequacy.filter_data(df, "value", max_value=90), "value")


@query("SELECT count(*)::BIGINT AS element_count, count(*) FILTER (ts IS NULL)::BIGINT AS missing_count, (count(*) - count(DISTINCT ts))::BIGINT AS unexpected_count FROM readings")
def check_unique(spark, sf):
    return validation.unique_counts(minute(spark, sf), "ts")


@query("SELECT count(*)::BIGINT AS element_count, count(*) FILTER (value IS NULL)::BIGINT AS missing_count, count(*) FILTER (value IS NULL)::BIGINT AS unexpected_count FROM clean")
def check_not_null(spark, sf):
    return validation.not_null_counts(validation.remove_duplicate_dates(minute(spark, sf).drop("event_id")), "value")


@query("SELECT count(*)::BIGINT AS element_count, 0::BIGINT AS missing_count, count(*) FILTER (value < b)::BIGINT AS unexpected_count FROM (SELECT value, lag(value) OVER (PARTITION BY site_id ORDER BY event_id) AS b FROM ev)")
def check_increasing(spark, sf):
    return validation.increasing_counts(events(spark, sf), "value", "event_id")


@query("SELECT * FROM (VALUES ('exists', true), ('exists_at_0', false), ('absent', false), ('datetime', true), ('not_datetime', false)) t(name, success)")
def check_schema(spark, sf):
    e = events(spark, sf)
    found = {
        "exists": validation.check_column_exists(e, "ts"), "exists_at_0": validation.check_column_exists(e, "ts", 0), "absent": validation.check_column_exists(e, "x"),
        "datetime": validation.check_column_type_datetime(e, "ts"), "not_datetime": validation.check_column_type_datetime(e, "value"),
    }
    return spark.createDataFrame([(k, bool(v)) for k, v in found.items()], "name string, success boolean")


@query("SELECT event_id AS id, ts AS at, value AS consumption FROM events")
def rebind_names(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "value", F.col("user_id").alias("Unnamed: 0"))
    return validation.drop_unnamed(validation.rebind_names(e, {"id": "event_id", "at": "ts", "consumption": "value", "none": None, "other": "absent"}))


@query("SELECT event_id, CASE WHEN event_id % 5 > 0 THEN date_trunc('second', ts)::TIMESTAMP END AS ts FROM ev")
def parse_timestamps(spark, sf):
    text = F.when(F.col("event_id") % 5 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).otherwise("no time")
    e = events(spark, sf).select("event_id", text.alias("ts"))
    return e.withColumn("ts", S.parse_timestamp("ts"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '_novalue_' ELSE event_type END AS event_type, value FROM ev")
def fill_categorical(spark, sf):
    e = events(spark, sf).select("event_id", F.when(F.col("event_id") % 3 > 0, F.col("event_type")).alias("event_type"), "value")
    return validation.fill_categorical(e)


@query("SELECT site_id, ts, consumption FROM hourly WHERE consumption > 100")
def keep_consumption(spark, sf):
    h = hourly(spark, sf)
    own = validation.only_consumption(h.withColumn("other", F.col("consumption") * 2))
    return features.nonzero(own.withColumn("consumption", F.when(F.col("consumption") > 100, F.col("consumption"))))


# ---- duplicates, grids, adequacy

@query("SELECT site_id, ts, round(value, 6) AS value FROM clean")
def dedup_ts(spark, sf):
    return validation.remove_duplicate_dates(minute(spark, sf).drop("event_id")).select("site_id", "ts", r6(F.col("value"), "value"))


@query("SELECT site_id, least(mode(step ORDER BY step), 86400000000)::BIGINT AS step FROM gaps WHERE step <> 0 GROUP BY 1")
def time_step_mode(spark, sf):
    return alignment.time_step(minute(spark, sf).select("site_id", "ts").distinct())


@query("SELECT site_id, min(step)::BIGINT AS step FROM gaps WHERE step <> 0 GROUP BY 1")
def least_step(spark, sf):
    return adequacy.least_step(minute(spark, sf))


@query("SELECT DISTINCT site_id, step FROM gaps WHERE step <> 0 AND step < 86400000000")
def hourly_steps(spark, sf):
    return alignment.hourly_steps(minute(spark, sf).select("site_id", "ts").distinct())


@query("SELECT site_id, list_reduce(list(DISTINCT step // 60000000), lambda a, b: gcd(a, b))::BIGINT AS minutes FROM gaps WHERE step <> 0 AND step < 86400000000 GROUP BY 1")
def gcd_step(spark, sf):
    return alignment.gcd_step(minute(spark, sf).select("site_id", "ts").distinct())


GRID = """, spans AS (SELECT site_id, date_trunc('day', min(ts)) AS a, date_trunc('day', max(ts)) + INTERVAL 1 DAY AS b FROM clean GROUP BY 1),
least AS (SELECT site_id, min(step) AS step FROM gaps WHERE step <> 0 GROUP BY 1),
grid AS (SELECT site_id, unnest(range(a::TIMESTAMP, b::TIMESTAMP, to_microseconds(step))) AS ts FROM spans JOIN least USING (site_id))"""


@query(f"SELECT * FROM (WITH z AS (SELECT 1){GRID} SELECT g.site_id, g.ts, round(value, 6) AS value FROM grid g LEFT JOIN clean c ON g.site_id = c.site_id AND g.ts = c.ts)")
def expand_dates(spark, sf):
    out = adequacy.expand_dates(validation.remove_duplicate_dates(minute(spark, sf).drop("event_id")))
    return out.select("site_id", "ts", r6(F.col("value"), "value"))


@query("""SELECT site_id, 'M' || month(ts) AS month, round(count(*) FILTER (n = 0) / 720.0, 6) AS missing_pct FROM (
  SELECT h.site_id, min(h.ts) AS ts, month(h.ts) AS m, day(h.ts) AS d, hour(h.ts) AS hh, count(CASE WHEN v.value IS NOT NULL THEN h.consumption END) AS n
  FROM hourly h LEFT JOIN clean v ON h.site_id = v.site_id AND h.ts = v.ts GROUP BY h.site_id, m, d, hh) GROUP BY site_id, month(ts)""")
def adequacy_report(spark, sf):
    x = validation.remove_duplicate_dates(minute(spark, sf).drop("event_id"))
    return adequacy.check_data_adequacy(x, hourly(spark, sf)).select("site_id", "month", r6(F.col("missing_pct"), "missing_pct"))


@query("""SELECT 'all' AS site_id, 'M' || m AS month, round(count(*) FILTER (n = 0) / 720.0, 6) AS missing_pct FROM (
  SELECT month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h, count(CASE WHEN o_totalprice > 150000 THEN 1 END) AS n FROM orders GROUP BY ALL) GROUP BY m""")
def adequacy_years(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").select(F.lit("all").alias("site_id"), S.ntz(F.col("o_orderdate")).alias("ts"), F.when(F.col("o_totalprice") > 150000, F.col("o_totalprice")).alias("consumption"))
    return adequacy.check_data_adequacy(None, o).select("site_id", "month", r6(F.col("missing_pct"), "missing_pct"))


@query("SELECT event_id FROM ev QUALIFY row_number() OVER (PARTITION BY site_id, ts::DATE, hour(ts) ORDER BY md5('0:' || strftime(ts, '%Y-%m-%d %H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE rtrim('.' || lpad((epoch_us(ts) % 1000000)::VARCHAR, 6, '0'), '0') END), ts) = 1")
def hourly_sample(spark, sf):
    return adequacy.hourly_sample(events(spark, sf)).select("event_id")


# ---- joins and alignment

ERRORS = "l AS (SELECT site_id, ts, event_id FROM ev WHERE event_type = 'error')"
NEAR = f"""SELECT * FROM (WITH {ERRORS},
b AS (SELECT l.*, v.ts AS t, v.temperature AS x FROM l ASOF LEFT JOIN views v ON l.site_id = v.site_id AND l.ts >= v.ts),
a AS (SELECT l.event_id, v.ts AS t, v.temperature AS x FROM l ASOF LEFT JOIN views v ON l.site_id = v.site_id AND l.ts <= v.ts)
SELECT b.site_id, b.ts, CASE WHEN least(epoch_us(b.ts) - epoch_us(b.t), epoch_us(a.t) - epoch_us(b.ts)) <= 1200000000
  THEN CASE WHEN a.t IS NULL OR epoch_us(b.ts) - epoch_us(b.t) <= epoch_us(a.t) - epoch_us(b.ts) THEN b.x ELSE a.x END END AS temperature
FROM b JOIN a USING (event_id))"""


@query(NEAR)
def asof_nearest(spark, sf):
    return alignment.asof_nearest(kind(spark, sf, "error").select("site_id", "ts"), views(spark, sf), 1200)


@query("SELECT h.site_id, h.ts, round(c.value, 6) AS value FROM hourly h LEFT JOIN clean c ON h.site_id = c.site_id AND h.ts = c.ts")
def exact_join(spark, sf):
    x = validation.remove_duplicate_dates(minute(spark, sf).drop("event_id"))
    return alignment.exact(hourly(spark, sf), x).select("site_id", "ts", r6(F.col("value"), "value"))


INTERP = """SELECT site_id, ts, round(CASE WHEN bt IS NOT NULL AND at_ IS NOT NULL AND least(epoch_us(ts) - bt, at_ - epoch_us(ts)) <= 7200000000
  THEN CASE WHEN bt = at_ THEN bx ELSE bx + (ax - bx) * (epoch_us(ts) - bt) / (at_ - bt) END END, 6) AS value FROM (
  SELECT h.site_id, h.ts, last_value(CASE WHEN c.value IS NOT NULL THEN epoch_us(c.ts) END IGNORE NULLS) OVER b AS bt, last_value(c.value IGNORE NULLS) OVER b AS bx,
    first_value(CASE WHEN c.value IS NOT NULL THEN epoch_us(c.ts) END IGNORE NULLS) OVER a AS at_, first_value(c.value IGNORE NULLS) OVER a AS ax, h.own
  FROM (SELECT site_id, ts, bool_or(own) AS own FROM (SELECT site_id, ts, true AS own FROM hourly UNION ALL SELECT site_id, ts, false FROM clean) GROUP BY ALL) h
  LEFT JOIN clean c ON h.site_id = c.site_id AND h.ts = c.ts
  WINDOW b AS (PARTITION BY h.site_id ORDER BY h.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY h.site_id ORDER BY h.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE own"""


@query(INTERP)
def interp_linear(spark, sf):
    x = validation.remove_duplicate_dates(minute(spark, sf).drop("event_id"))
    return alignment.align_by_value(hourly(spark, sf), x, 7200).select("site_id", "ts", r6(F.col("value"), "value"))


@query(f"""SELECT site_id, ts, round((value - lag(value) OVER w) / ((epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 60000000.0), 9) AS value FROM (
WITH s AS (SELECT site_id, ts, CASE WHEN value IS NOT NULL THEN sum(value) OVER (PARTITION BY site_id ORDER BY ts) END AS value FROM clean)
{INTERP.replace("clean", "s").replace("round(CASE", "(CASE").replace("END END, 6)", "END END)")}) WINDOW w AS (PARTITION BY site_id ORDER BY ts)""")
def cumulative_rate(spark, sf):
    x = validation.remove_duplicate_dates(minute(spark, sf).drop("event_id"))
    h = hourly(spark, sf)
    return alignment.align_cumulative(h, x, lambda a, b: alignment.align_by_value(a, b, 7200)).select("site_id", "ts", F.round("value", 9).alias("value"))


def daily_prices(spark: SparkSession, sf: str) -> DataFrame:
    """By the day, as hours long: the days of 1995 lie on those of events."""
    o = spark.read.parquet(f"{sf}/orders.parquet")
    per = o.groupBy((F.col("o_custkey") % SITES).cast("string").alias("site_id"), S.ntz(F.date_trunc("day", "o_orderdate")).alias("ts"))
    per = per.agg((F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100.0).alias("price"))
    return per.select("site_id", S.from_micros(S.micros("ts") + 915_062_400_000_000 - 1_800_000_000 * (F.weekday("ts") % 2)).alias("ts"), "price")


@query("""SELECT h.site_id, h.ts, coalesce(last_value(d.price IGNORE NULLS) OVER b, first_value(d.price IGNORE NULLS) OVER a) AS price FROM (
  SELECT DISTINCT site_id, ts FROM (SELECT site_id, ts FROM hourly UNION ALL SELECT site_id, ts FROM dp)) h LEFT JOIN dp d ON h.site_id = d.site_id AND h.ts = d.ts
  WINDOW b AS (PARTITION BY h.site_id, h.ts::DATE ORDER BY h.ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY h.site_id, h.ts::DATE ORDER BY h.ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  QUALIFY (h.site_id, h.ts) IN (SELECT (site_id, ts) FROM hourly)""")
def daily_to_hourly(spark, sf):
    return alignment.align_daily(hourly(spark, sf), daily_prices(spark, sf))


SQL["daily_to_hourly"] = SQL["daily_to_hourly"].replace("\nSELECT h.site_id", """, dp AS MATERIALIZED (
  SELECT site_id, make_timestamp(epoch_us(ts) + 915062400000000 - 1800000000 * ((isodow(ts) - 1) % 2)) AS ts, price FROM (
  SELECT (o_custkey % 4)::VARCHAR AS site_id, date_trunc('day', o_orderdate)::TIMESTAMP AS ts, sum(round(o_totalprice * 100)::BIGINT) / 100.0 AS price FROM orders GROUP BY 1, 2))
SELECT h.site_id""", 1)


@query(NEAR.replace("<= 1200000000", "<= 3600000000").replace(ERRORS, "l AS (SELECT site_id, ts, row_number() OVER () AS event_id FROM hourly)"))
def align_to_index(spark, sf):
    """The dispatcher takes the nearest join: minutes on hours."""
    return alignment.align_to_index(views(spark, sf), hourly(spark, sf), "distance", 3600)


@query("SELECT h.site_id, h.ts, v.temperature, round(c.value, 6) AS value FROM hourly h LEFT JOIN views v ON h.site_id = v.site_id AND h.ts = v.ts LEFT JOIN clean c ON h.site_id = c.site_id AND h.ts = c.ts")
def merge_data_list(spark, sf):
    x = validation.remove_duplicate_dates(minute(spark, sf).drop("event_id"))
    out = alignment.merge_data_list([views(spark, sf), x], hourly(spark, sf))
    return out.select("site_id", "ts", "temperature", r6(F.col("value"), "value"))


NEAR_HOURS = NEAR.replace("<= 1200000000", "<= 3600000000").replace(ERRORS, "l AS (SELECT site_id, ts, row_number() OVER () AS event_id FROM hourly)")
STEP = "(SELECT site_id, least(mode(step ORDER BY step), 86400000000) AS step FROM (SELECT site_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY site_id ORDER BY ts) AS step FROM {}) WHERE step <> 0 GROUP BY 1)"


@query(f"""SELECT n.site_id, n.ts, CASE WHEN vs.step IS NULL OR hs.step IS NULL OR vs.step = hs.step THEN v.temperature ELSE n.temperature END AS temperature,
  CASE WHEN cs.step IS NULL OR hs.step IS NULL OR cs.step = hs.step THEN round(c.value, 6) ELSE i.value END AS value
FROM ({NEAR_HOURS}) n JOIN ({INTERP}) i ON i.site_id = n.site_id AND i.ts = n.ts LEFT JOIN clean c ON c.site_id = n.site_id AND c.ts = n.ts LEFT JOIN views v ON v.site_id = n.site_id AND v.ts = n.ts
LEFT JOIN {STEP.format("hourly")} hs ON hs.site_id = n.site_id LEFT JOIN {STEP.format("clean")} cs ON cs.site_id = n.site_id LEFT JOIN {STEP.format("views")} vs ON vs.site_id = n.site_id""")
def merge_by_column(spark, sf):
    """Two modes and tolerances in one call: temperature by the nearest, value by interpolation."""
    x = validation.remove_duplicate_dates(minute(spark, sf).drop("event_id"))
    out = alignment.merge_data_list([views(spark, sf), x], hourly(spark, sf), {"temperature": "distance", "value": "value"}, {"temperature": "60min", "value": 7200})
    return out.select("site_id", "ts", "temperature", r6(F.col("value"), "value"))


@query("SELECT v.* FROM views v SEMI JOIN hourly h ON v.site_id = h.site_id AND v.ts = h.ts")
def semi_join(spark, sf):
    return alignment.semi(views(spark, sf), hourly(spark, sf))


@query("SELECT coalesce(v.site_id, h.site_id) AS site_id, coalesce(v.ts, h.ts) AS ts, temperature, consumption FROM views v FULL JOIN hourly h ON v.site_id = h.site_id AND v.ts = h.ts")
def concat_outer(spark, sf):
    return alignment.concat_frames([views(spark, sf), hourly(spark, sf)])


@query("SELECT coalesce(p.site_id, h.site_id) AS site_id, coalesce(p.ts, h.ts) AS ts, round(p.v - h.consumption, 6) AS consumption FROM (SELECT site_id, ts + INTERVAL 24 HOUR AS ts, consumption AS v FROM hourly) p FULL JOIN hourly h ON p.site_id = h.site_id AND p.ts = h.ts")
def impact(spark, sf):
    h = hourly(spark, sf)
    day_later = h.withColumn("ts", S.from_micros(S.micros("ts") + adequacy.DAY))
    return alignment.impact(day_later, h).select("site_id", "ts", r6(F.col("consumption"), "consumption"))


@query("SELECT h.site_id, h.ts, coalesce(temperature, 0) AS activity FROM hourly h LEFT JOIN views v ON h.site_id = v.site_id AND h.ts = v.ts")
def hurdle_restore(spark, sf):
    return alignment.restore(views(spark, sf).withColumnRenamed("temperature", "activity"), hourly(spark, sf))


@query("SELECT h.site_id, h.ts, h.consumption FROM hourly h SEMI JOIN views v ON v.site_id = h.site_id AND v.ts = h.ts")
def lookup_rows(spark, sf):
    h = hourly(spark, sf)
    return alignment.lookup_rows(h, alignment.semi(views(spark, sf), h))


@query("SELECT site_id, ts, value FROM ev")
def union_partitions(spark, sf):
    e = events(spark, sf)
    part = F.coalesce(F.pmod(F.hour("ts"), F.lit(3)), F.lit(0))  # rows without a time stay too
    parts = [e.where(part == k).select(*c) for k, c in enumerate((("site_id", "ts", "value"), ("value", "ts", "site_id"), ("ts", "site_id", "value")))]
    return alignment.union_partitions(parts)[0]


@query("SELECT DISTINCT site_id, ts FROM (SELECT site_id, ts FROM hourly UNION ALL SELECT site_id, ts FROM views)")
def union_index(spark, sf):
    return hourly(spark, sf).select("site_id", "ts").union(views(spark, sf).select("site_id", "ts")).distinct()


@query("SELECT h.site_id, h.ts, h.consumption FROM hourly h SEMI JOIN (SELECT site_id, ts FROM hourly WHERE consumption > 200) a ON a.site_id = h.site_id AND a.ts = h.ts")
def regime_filter(spark, sf):
    h = hourly(spark, sf)
    return features.in_use(h, h.select("site_id", "ts", F.when(F.col("consumption") > 200, 1.0).otherwise(0.0).alias("activity")))


# ---- windows and sequences

@query("SELECT site_id, ts, round(consumption - lag(consumption) OVER w, 6) AS d FROM hourly WINDOW w AS (PARTITION BY site_id ORDER BY ts)")
def first_difference(spark, sf):
    return hourly(spark, sf).select("site_id", "ts", r6(features.difference("consumption"), "d"))


@query("SELECT site_id, ts, round(CASE WHEN value IS NOT NULL THEN sum(value) OVER (PARTITION BY site_id ORDER BY ts) END, 4) AS total FROM clean")
def running_sum(spark, sf):
    x = validation.remove_duplicate_dates(minute(spark, sf).drop("event_id"))
    return x.select("site_id", "ts", F.round(alignment.running_sum(x, "value"), 4).alias("total"))


@query('SELECT site_id, ts, consumption, lag(consumption, 1) OVER w AS "L1.consumption", lag(consumption, 24) OVER w AS "L24.consumption" FROM hourly WINDOW w AS (PARTITION BY site_id ORDER BY ts)')
def lags(spark, sf):
    return features.create_lagged(hourly(spark, sf), {"consumption": [1, 24], "absent": [1]})


@query("SELECT site_id, ts, row_number() OVER (PARTITION BY site_id ORDER BY ts) > n - ceil(round(n * 0.2, 9)) AS validation FROM (SELECT site_id, ts, count(*) OVER (PARTITION BY site_id) AS n FROM hourly)")
def split(spark, sf):
    return features.time_split(hourly(spark, sf)).select("site_id", "ts", "validation")


@query("""SELECT site_id, ts, round(coalesce(f, first_value(f IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS value FROM (
  SELECT site_id, ts, last_value(value IGNORE NULLS) OVER (PARTITION BY site_id, ts::DATE, hour(ts) ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS f FROM clean)""")
def hourly_fill(spark, sf):
    x = validation.remove_duplicate_dates(minute(spark, sf).drop("event_id"))
    return features.hourly_fill(x, "value").select("site_id", "ts", r6(F.col("value"), "value"))


@query("""SELECT site_id, ts, round(last_value(value IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS f,
  round(first_value(value IGNORE NULLS) OVER (PARTITION BY site_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS b FROM clean""")
def fills(spark, sf):
    x = validation.remove_duplicate_dates(minute(spark, sf).drop("event_id"))
    return x.select("site_id", "ts", r6(fill_forward(F.col("value")), "f"), r6(fill_backward(F.col("value")), "b"))


# ---- scalars

@query("SELECT event_id, hour(ts) AS hour, isodow(ts) - 1 AS dayofweek, weekofyear(ts) AS week, month(ts) AS month, day(ts) AS day, 'M' || month(ts) AS name FROM ev")
def calendar(spark, sf):
    e = events(spark, sf)
    keys = S.month_day_hour()
    return e.select("event_id", *(c.alias(k) for k, c in S.calendar().items()), keys["month"].alias("month"), keys["day"].alias("day"), S.month_name().alias("name"))


@query("SELECT event_id, round((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY site_id ORDER BY ts, event_id)) / 60000000.0, 4) AS minutes FROM ev")
def minutes(spark, sf):
    w = Window.partitionBy("site_id").orderBy("ts", "event_id")
    return events(spark, sf).select("event_id", F.round(S.minutes_between(F.lag("ts").over(w), F.col("ts")), 4).alias("minutes"))


@query("""SELECT event_id, round(1 / (1 + exp(-10 * (value / 100 - 0.5))), 6) AS s, CASE WHEN value / 100 < 0.1 THEN 0 WHEN value / 100 > 0.9 THEN 1 ELSE floor(value / 100 * 10 + 0.5) / 10 END AS snapped,
  least(greatest(value, 20), 60) AS clipped FROM ev""")
def sigmoid_snap_clip(spark, sf):
    x = F.col("value") / 100
    return events(spark, sf).select("event_id", r6(S.sigmoid(x, 10.0, 0.5), "s"), S.snap(x, True).alias("snapped"), S.clip(F.col("value"), 20.0, 60.0).alias("clipped"))


@query("SELECT site_id, ts, round((consumption - min(consumption) OVER w) / (max(consumption) OVER w - min(consumption) OVER w), 6) AS scaled FROM hourly WINDOW w AS (PARTITION BY site_id)")
def min_max(spark, sf):
    return hourly(spark, sf).select("site_id", "ts", r6(features.min_max("consumption"), "scaled"))


@query("SELECT event_id, round(value * 1, 6) AS p1, round(value * value, 6) AS p2, round(2 * value, 6) AS p3 FROM (SELECT event_id, value FROM ev)")
def tensor_product(spark, sf):
    out = S.tensor_product(F.array(F.col("value"), F.lit(2.0)), F.array(F.lit(1.0), F.col("value")))
    return events(spark, sf).select("event_id", r6(out[0], "p1"), r6(out[1], "p2"), r6(out[3], "p3"))


@query("SELECT event_id, least(4, greatest(0, floor(value / 20.0)))::INTEGER AS bin, (least(4, greatest(0, floor(value / 20.0))) = 2)::INTEGER::DOUBLE AS is_2 FROM ev")
def uniform_bins(spark, sf):
    b = S.uniform_bin(F.col("value"), 0.0, 100.0, 5)
    return events(spark, sf).select("event_id", b.alias("bin"), S.one_hot(b, 5)[2].alias("is_2"))


THETA = {"u_value": 2.0, "T_sp_coo": 26.0, "T_sp_hea": 21.0, "T_sb_coo": 32.0, "T_sb_hea": 8.0, "eta": 0.4, "ach": 1.5, "alpha": 3.0, "beta": 5.0}


@query("""SELECT event_id, round(CASE WHEN a > 1e-5 THEN 200 * greatest(t - 26, 21 - t, 0) ELSE 0 END, 9) AS cond_load_on,
  round(CASE WHEN a > 1e-5 THEN 1.005 * 1.2 * 500 / 3600 * 1.5 * 0.6 * greatest(t - 26, 21 - t, 0) ELSE 0 END, 9) AS ven_load,
  round(CASE WHEN a > 1e-5 THEN 0 ELSE 200 * greatest(t - 32, 8 - t, 0) END, 9) AS cond_load_off, round(3 * a + 5, 9) AS plug_load
FROM (SELECT event_id, value / 2 AS t, (event_id % 4) / 3.0 AS a FROM ev)""")
def forward_model(spark, sf):
    e = events(spark, sf).select("event_id", (F.col("value") / 2).alias("t"), ((F.col("event_id") % 4) / 3.0).alias("a"))
    return e.select("event_id", *(F.round(c, 9).alias(k) for k, c in S.forward_model(THETA, F.col("t"), F.col("a"), 100.0, 500.0).items()))


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN (SELECT code FROM (SELECT event_type, count(*) AS n FROM ev GROUP BY 1) JOIN codes USING (event_type) ORDER BY n DESC, code LIMIT 1) ELSE code END::SMALLINT AS event_type
FROM ev JOIN (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM ev)) USING (event_type)""")
def ordinal_encode(spark, sf):
    """Fitted to all events; a tenth of them is then of a type that was never seen."""
    e = events(spark, sf).select("event_id", "event_type")
    strange = e.withColumn("event_type", F.when(F.col("event_id") % 10 == 0, "never seen").otherwise(F.col("event_type")))
    return features.SafeOrdinalEncoder(["event_type"]).fit(e).transform(strange)


SQL["ordinal_encode"] = SQL["ordinal_encode"].replace("\nSELECT event_id", ", codes AS (SELECT event_type, dense_rank() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM ev))\nSELECT event_id", 1)


@query("SELECT site_id, mode(event_type ORDER BY event_type) AS event_type FROM ev GROUP BY 1")
def most_frequent(spark, sf):
    return features.most_frequent(events(spark, sf), "event_type")


# ---- metrics and quantiles

@query("""SELECT site_id, round(sqrt(avg(r * r)) / avg(y), 6) AS "CVRMSE", round(avg(r) / avg(y), 6) AS "NMBE", round(avg(r * r), 6) AS "MSE" FROM (
  SELECT h.site_id, h.consumption AS y, h.consumption - m.p AS r FROM hourly h JOIN (SELECT site_id, isodow(ts) AS d, hour(ts) AS hh, avg(consumption) * 1.1 AS p FROM hourly GROUP BY ALL) m
  ON h.site_id = m.site_id AND isodow(h.ts) = m.d AND hour(h.ts) = m.hh) GROUP BY 1""")
def cvrmse_nmbe(spark, sf):
    h = features.add_calendar(hourly(spark, sf))
    p = h.select("site_id", "ts", (F.avg("consumption").over(Window.partitionBy("site_id", "dayofweek", "hour")) * 1.1).alias("consumption"))
    return metrics.errors(h, p).select("site_id", *(r6(F.col(k), k) for k in ("CVRMSE", "NMBE", "MSE")))


@query("SELECT site_id, round(sum(r * r), 4) AS sse, round(-0.5 * sum(r * r), 4) AS log_likelihood, min(y) AS y_min, max(y) AS y_max, round(avg(y), 6) AS y_mean FROM (SELECT site_id, consumption AS y, consumption - lag(consumption) OVER (PARTITION BY site_id ORDER BY ts) AS r FROM hourly) GROUP BY 1")
def fit_sums(spark, sf):
    h = hourly(spark, sf).withColumn("before", F.lag("consumption").over(series()))
    own = metrics.fit_sums(F.col("consumption"), F.col("before"))
    return h.groupBy("site_id").agg(*(F.round(c, 4 if k in ("sse", "log_likelihood") else 6).alias(k) for k, c in own.items()))


@query("""SELECT h.site_id, h.ts, round(CASE WHEN u > l THEN least(1, greatest(0, (consumption - l) / (u - l))) ELSE 0 END, 6) AS activity FROM hourly h JOIN (
  SELECT site_id, hour(ts) AS hh, quantile_cont(consumption, 0.01) AS l, quantile_cont(consumption, 0.99) AS u FROM hourly GROUP BY ALL) q ON q.site_id = h.site_id AND q.hh = hour(h.ts)""")
def activity_quantile(spark, sf):
    h = features.add_calendar(hourly(spark, sf))
    return features.binned_activity(h).select("site_id", "ts", r6(F.col("activity"), "activity"))


@query("SELECT to_json({'n': count(*), 'kinds': count(DISTINCT event_type)})::VARCHAR AS report FROM ev")
def json_report(spark, sf):
    return events(spark, sf).agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds")).select(F.to_json(F.struct("n", "kinds")).alias("report"))


@query("SELECT site_id, round(avg(consumption), 6) AS mean FROM hourly GROUP BY 1 ORDER BY 1")
def sorted_report(spark, sf):
    return hourly(spark, sf).groupBy("site_id").agg(r6(F.avg("consumption"), "mean")).orderBy("site_id")


# ---- flagship

FLAGSHIP = """, x AS (NEARBY), cut AS (SELECT site_id, count(*) AS n FROM hourly GROUP BY 1),
rows_ AS (SELECT h.*, row_number() OVER (PARTITION BY h.site_id ORDER BY h.ts) AS r, n, isodow(h.ts) - 1 AS d, hour(h.ts) AS hh, x.temperature FROM hourly h JOIN cut USING (site_id) LEFT JOIN x ON x.site_id = h.site_id AND x.ts = h.ts),
mean AS (SELECT site_id, d, hh, avg(consumption) AS p FROM rows_ WHERE r <= n * 0.6 GROUP BY ALL),
scored AS (SELECT w.*, p FROM rows_ w JOIN mean USING (site_id, d, hh) WHERE r > n * 0.6)
SELECT site_id, count(*)::BIGINT AS hours, count(temperature)::BIGINT AS known, round(sqrt(avg((consumption - p) ** 2)) / avg(consumption), 6) AS "CVRMSE", round(avg(consumption - p) / avg(consumption), 6) AS "NMBE", round(sum(p - consumption), 4) AS impact FROM scored GROUP BY 1"""


@query("SELECT 1")
def flagship_mv(spark, sf):
    """Labels and an aligned feature, a baseline of means by weekday and hour on the first 60 %, and what it says of the rest."""
    h = hourly(spark, sf)
    x = alignment.asof_nearest(h, views(spark, sf), 3600)
    n = F.count("*").over(Window.partitionBy("site_id"))
    data = features.add_calendar(h.join(x, ["site_id", "ts"], "left")).withColumn("train", F.row_number().over(series()) <= n * 0.6)
    p = F.avg(F.when(F.col("train"), F.col("consumption"))).over(Window.partitionBy("site_id", "dayofweek", "hour"))
    scored = data.withColumn("p", p).where(~F.col("train") & F.col("p").isNotNull())
    y = F.col("consumption")
    return scored.groupBy("site_id").agg(
        F.count("*").alias("hours"), F.count("temperature").alias("known"), r6(metrics.cvrmse(y, F.col("p")), "CVRMSE"), r6(metrics.nmbe(y, F.col("p")), "NMBE"), F.round(F.sum(F.col("p") - y), 4).alias("impact"),
    )


SQL["flagship_mv"] = f"WITH {BASE}" + FLAGSHIP.replace("NEARBY", NEAR.replace("<= 1200000000", "<= 3600000000").replace(ERRORS, "l AS (SELECT site_id, ts, row_number() OVER () AS event_id FROM hourly)"))


# ---- models: rows only

def _site_data(spark: SparkSession, sf: str) -> DataFrame:
    """Consumption of whole sites with a feature; every row of the tables is in it."""
    h = hourly(spark, sf)
    return h.join(alignment.asof_nearest(h, views(spark, sf)), ["site_id", "ts"]).dropna()


@query(f"""WITH RECURSIVE {BASE},
s AS MATERIALIZED (SELECT site_id, ts, consumption AS y, row_number() OVER (PARTITION BY site_id ORDER BY ts) AS r, count(*) OVER (PARTITION BY site_id) AS n FROM hourly),
f AS (SELECT site_id, r, 10000.1::DOUBLE AS ahead, y::DOUBLE AS m, (1 - 10000.1 / 10001.1) * 10000.1::DOUBLE AS p FROM s WHERE r = 1
  UNION ALL SELECT s.site_id, s.r, f.p + 0.1, f.m + (f.p + 0.1) / (f.p + 1.1) * (s.y - f.m), (1 - (f.p + 0.1) / (f.p + 1.1)) * (f.p + 0.1) FROM f JOIN s ON s.site_id = f.site_id AND s.r = f.r + 1),
g AS MATERIALIZED (SELECT *, lead(ahead) OVER (PARTITION BY site_id ORDER BY r) AS later FROM f),
b AS (SELECT g.site_id, g.r, g.m FROM g JOIN s ON s.site_id = g.site_id AND s.r = g.r WHERE s.r = s.n
  UNION ALL SELECT g.site_id, g.r, g.m + g.p / g.later * (b.m - g.m) FROM b JOIN g ON g.site_id = b.site_id AND g.r = b.r - 1)
SELECT s.site_id, s.ts, round(CASE WHEN y <= 1e-5 THEN 0 ELSE b.m END, 6) AS smoothed FROM b JOIN s ON s.site_id = b.site_id AND s.r = b.r""")
def kalman_smoother(spark, sf):
    return A.smooth_consumption(hourly(spark, sf)).withColumn("smoothed", F.round("smoothed", 6))


@query()
def activity_estimate(spark, sf):
    return A.estimate_activity(_site_data(spark, sf))


@query()
def activity_markov(spark, sf):
    return A.estimate_activity_markov(_site_data(spark, sf))


@query()
def usage_predictor(spark, sf):
    data = _site_data(spark, sf)
    x = data.drop("consumption")
    model = pipelines.predictor(pipelines.Settings()).fit(x, data)
    return model.predict(x)


@query()
def activity_adjusted(spark, sf):
    data = _site_data(spark, sf)
    s = pipelines.Settings()
    x = data.drop("consumption")
    model, _ = pipelines.fit_predict_autoenc(x, data, pipelines.create_activity(x, data, s), s)
    return pipelines.adjust_levels(x, data, model, s)


@query()
def explain_prediction(spark, sf):
    act = F.when(F.hour("ts").between(8, 18), 1.0).otherwise(0.0)
    data = _site_data(spark, sf).withColumn("activity", act).withColumn("temperature", F.col("temperature") / 3)
    return B.explain_prediction(data, 100.0, 500.0)


@query()
def mv_pipeline(spark, sf):
    """Preprocess, fit, predict and evaluate, as a run of the engine does."""
    s = pipelines.Settings(filter={"max_value": 1e6})
    x, y = pipelines.validate_inputs([views(spark, sf)], [hourly(spark, sf)], s)
    x, y, _ = pipelines.evaluate_inputs(x, y, s)
    _, prediction = pipelines.fit_predict(x, y, s)
    return pipelines.evaluate_on_test(y, prediction)
