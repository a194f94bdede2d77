"""Queries of event-time features (over daily levels, monthly amounts and units)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrane.operators import timefeat as T
from terrane.plans.proxies import DAILY, MONTHLY, PIXELS, SPARSE, daily, monthly, pixels, read, sparse_daily, units
from terrane.plans.registry import Catalog

C = Catalog()
q = C.query
SPINE = """ends AS (SELECT station, min(date) AS lo, max(date) AS hi FROM daily GROUP BY station),
days AS (SELECT station, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM ends),
spine AS (SELECT d.station, d.date, level FROM days d LEFT JOIN daily l ON l.station = d.station AND l.date = d.date)"""
HELD = "held AS (SELECT *, last_value(level IGNORE NULLS) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS held FROM spine)"


@q(f"WITH {SPARSE}, {SPINE}, {HELD} SELECT station, date, level, held FROM held")
def bounded_ffill(spark, d):
    return T.bounded_hold(T.spine(sparse_daily(spark, d)))


@q(f"""WITH {SPARSE}, {SPINE} SELECT station, date, coalesce(last_value(level IGNORE NULLS) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  first_value(level IGNORE NULLS) OVER (PARTITION BY station ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled FROM spine""")
def unbounded_fill(spark, d):
    return T.full_fill(T.spine(sparse_daily(spark, d))).select("station", "date", "filled")


@q(f"""WITH {SPARSE}, {SPINE}, {HELD}, runs AS (SELECT station, level, row_number() OVER (PARTITION BY station ORDER BY date) - row_number() OVER (PARTITION BY station, level IS NULL ORDER BY date) AS run FROM spine),
gaps AS (SELECT station, max(n) AS g FROM (SELECT station, run, count(*) AS n FROM runs WHERE level IS NULL GROUP BY 1, 2) GROUP BY 1)
SELECT h.station, count(*) AS expected, count(level) AS observed, count(*) FILTER (level IS NULL AND held IS NOT NULL) AS held, count(*) FILTER (held IS NULL) AS missing, coalesce(max(g), 0) AS longest_gap
FROM held h LEFT JOIN gaps ON gaps.station = h.station GROUP BY h.station""")
def gap_audit(spark, d):
    return T.gap_audit(T.spine(sparse_daily(spark, d)))


@q(f"""WITH {MONTHLY}, ends AS (SELECT county, min(month) AS lo, max(month) AS hi FROM monthly GROUP BY 1), m AS (SELECT county, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM ends),
s AS (SELECT m.county, m.month, rain FROM m LEFT JOIN monthly r ON r.county = m.county AND r.month = m.month)
SELECT county, month, {", ".join(f"CASE WHEN count(rain) OVER w{k} = {k} THEN sum(rain) OVER w{k} END AS rain_{k}m" for k in (1, 3, 6))} FROM s
WINDOW {", ".join(f"w{k} AS (PARTITION BY county ORDER BY month ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)" for k in (1, 3, 6))}""")
def complete_rolling_sum(spark, d):
    m = monthly(spark, d)
    ends = m.groupBy("county").agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    s = ends.select("county", F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("month")).join(m, ["county", "month"], "left")
    w = Window.partitionBy("county").orderBy("month")
    return s.select("county", "month", *[T.complete_sum("rain", k, w).alias(f"rain_{k}m") for k in (1, 3, 6)])


YEARLY = "yearly AS (SELECT county, CAST(year(month) AS INTEGER) AS year, sum(rain) AS rain FROM monthly GROUP BY 1, 2)"


@q(f"""WITH {MONTHLY}, {YEARLY}, t AS (SELECT DISTINCT county, CAST(year(event_date) AS INTEGER) AS t FROM units),
a AS (SELECT t.county, t, count(*) FILTER (year >= t - 2) AS n, avg(rain) FILTER (year >= t - 2) AS mean2, max(rain) FILTER (year >= t - 2) AS max2, sum(rain) FILTER (year >= t - 2) AS sum2, avg(rain) AS mean_all FROM t JOIN yearly y ON y.county = t.county AND year < t GROUP BY 1, 2)
SELECT county, t, CASE WHEN n = 2 THEN mean2 END AS mean2, CASE WHEN n = 2 THEN max2 END AS max2, CASE WHEN n = 2 THEN sum2 END AS sum2, CASE WHEN n = 2 THEN round(mean2 - mean_all, 6) END AS departure FROM a""")
def two_year_frame(spark, d):
    y = monthly(spark, d).groupBy("county", F.year("month").alias("year")).agg(F.sum("rain").alias("rain"))
    return T.relative_years(units(spark, d).select("county", F.col("event_date").alias("cutoff")), y, "county", "rain").withColumn("departure", F.round("departure", 6))


@q(f"""WITH {MONTHLY}, {YEARLY}, s AS (SELECT county, year, rain / 1000 AS a, rain / 3000 AS b FROM yearly),
l AS (SELECT *, lag(year) OVER w = year - 1 AS there, lag(a) OVER w AS la, lag(b) OVER w AS lb FROM s WINDOW w AS (PARTITION BY county ORDER BY year))
SELECT county, year, round(CASE WHEN there THEN a - la END, 6) AS a_change, round(CASE WHEN there THEN b - lb END, 6) AS b_change, (abs(CASE WHEN there THEN a - la END) > 1 OR abs(CASE WHEN there THEN b - lb END) > 1) AS changed FROM l""")
def lag_change_flag(spark, d):
    y = monthly(spark, d).groupBy("county", F.year("month").alias("year")).agg(F.sum("rain").alias("rain"))
    y = y.select("county", "year", (F.col("rain") / 1000).alias("a"), (F.col("rain") / 3000).alias("b"))
    return T.lag_flag(y, "county", ["a", "b"], 1.0).select("county", "year", F.round("a_change", 6).alias("a_change"), F.round("b_change", 6).alias("b_change"), "changed")


@q(f"""WITH {DAILY}, l AS (SELECT station, level, lag(level) OVER (PARTITION BY station ORDER BY date) AS prev FROM daily)
SELECT station, e.elevation, count(*) FILTER (least(prev, level) < e.elevation AND e.elevation <= greatest(prev, level)) AS transitions, count(*) AS days
FROM l, (VALUES (50::DOUBLE), (100::DOUBLE), (200::DOUBLE), (300::DOUBLE)) e(elevation) WHERE prev IS NOT NULL AND level IS NOT NULL GROUP BY 1, 2""")
def transition_count(spark, d):
    return T.transitions(daily(spark, d), [50, 100, 200, 300])


@q(f"""WITH {PIXELS}, {DAILY}, st AS (SELECT station, row_number() OVER (ORDER BY station) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT station FROM daily)),
px AS (SELECT unit_id, st.station, round_even(elevation / 0.5, 0) * 0.5 / 10 AS elevation FROM pixels JOIN st ON unit_id % n = k),
u AS (SELECT DISTINCT station, elevation FROM px), w AS (SELECT u.station, u.elevation, count(*) FILTER (level >= u.elevation) AS wet, count(*) AS days FROM u JOIN daily d ON d.station = u.station GROUP BY 1, 2)
SELECT unit_id, count(*) AS pixels, round(avg(wet / days::DOUBLE), 6) AS fraction FROM px JOIN w ON w.station = px.station AND w.elevation = px.elevation GROUP BY unit_id""")
def inundation_fraction(spark, d):
    """Mean over pixels of the share of days whose level reaches the pixel's elevation, rounded to half units."""
    days = daily(spark, d)
    st = days.select("station").distinct().withColumns({"k": F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("station")) - 1, "n": F.count("*").over(Window.partitionBy(F.lit(1)))})
    px = pixels(spark, d).join(F.broadcast(st), F.col("unit_id") % F.col("n") == F.col("k")).select("unit_id", "station", (F.rint(F.col("elevation") / 0.5) * 0.5 / 10).alias("elevation"))
    return T.wet_counts(days, px, ["station"]).groupBy("unit_id").agg(F.count("*").alias("pixels"), F.round(F.avg(F.col("wet") / F.col("days")), 6).alias("fraction"))


@q(f"""WITH {PIXELS}, dl AS (SELECT (user_id % 5)::VARCHAR AS station, CAST(ts AS DATE) AS date, max(value) AS level FROM events GROUP BY 1, 2), ends AS (SELECT max(date) AS last FROM dl),
days AS (SELECT station, date, level FROM dl UNION ALL SELECT station, last + 1, level FROM dl, ends WHERE date = last AND last < last_day(last)),
px AS (SELECT unit_id, (unit_id % 5)::VARCHAR AS station, CAST(m AS DATE) AS month, elevation / 3 AS elevation FROM pixels, (VALUES ('2024-02-01'), ('2024-03-01')) v(m)),
full_months AS (SELECT station, CAST(date_trunc('month', date) + INTERVAL 1 MONTH AS DATE) AS month FROM days GROUP BY 1, 2 HAVING count(*) = max(day(last_day(date)))),
u AS (SELECT DISTINCT station, month, elevation FROM px), w AS (SELECT u.station, u.month, u.elevation, count(*) FILTER (level >= u.elevation) AS wet FROM u JOIN full_months USING (station, month) JOIN days d ON d.station = u.station AND date_trunc('month', date) + INTERVAL 1 MONTH = u.month GROUP BY 1, 2, 3)
SELECT px.month, px.station, count(*) AS pixels, count(wet) AS known, round(avg(wet), 6) AS wet_days FROM px LEFT JOIN w ON w.station = px.station AND w.month = px.month AND w.elevation = px.elevation GROUP BY 1, 2""")
def antecedent_inundated_days(spark, d):
    """Mean over pixels of the days of the month before a reference month whose level reaches the pixel's elevation; null unless all its days are there. The series' last level holds for one day more."""
    e = read(spark, d, "events")
    days = e.groupBy((F.col("user_id") % 5).cast("string").alias("station"), F.to_date("ts").alias("date")).agg(F.max("value").alias("level"))
    last = days.agg(F.max("date").alias("last"))
    held = days.join(F.broadcast(last), F.col("date") == F.col("last")).where("last < last_day(last)").select("station", F.date_add("last", 1).alias("date"), "level")
    px = pixels(spark, d).select("unit_id", (F.col("unit_id") % 5).cast("string").alias("station"), (F.col("elevation") / 3).alias("elevation"), F.explode(F.expr("array(date'2024-02-01', date'2024-03-01')")).alias("month"))
    wet = T.previous_month_wet_days(px, days.unionByName(held))
    return wet.groupBy("month", "station").agg(F.count("*").alias("pixels"), F.count("wet").alias("known"), F.round(F.avg("wet"), 6).alias("wet_days"))


@q(f"""WITH {DAILY}, m AS (SELECT station, date_trunc('week', date) AS period, avg(level) AS mean FROM daily GROUP BY 1, 2), l AS (SELECT station, abs(mean - lag(mean) OVER (PARTITION BY station ORDER BY period)) AS change FROM m)
SELECT station, round(max(change), 6) AS max_change FROM l GROUP BY 1""")
def period_mean_max_change(spark, d):
    return T.monthly_change(daily(spark, d)).withColumn("max_change", F.round("max_change", 6))


def cutoffs(spark, d):
    return daily(spark, d).select("station").distinct().withColumn("cutoff", F.explode(F.expr("array(date'2024-01-10', date'2024-01-15', date'2024-01-29', date'2024-02-10')")))


CUT = "cuts AS (SELECT station, CAST(c AS DATE) AS cutoff FROM (SELECT DISTINCT station FROM daily), (VALUES ('2024-01-10'), ('2024-01-15'), ('2024-01-29'), ('2024-02-10')) v(c))"


@q(f"""WITH {DAILY}, {CUT} SELECT c.station, c.cutoff, count(level) AS days, max(date) AS last_day, max_by(level, date) AS last_level, round(quantile_cont(level, 0.5), 6) AS median_level
FROM cuts c LEFT JOIN daily d ON d.station = c.station AND date >= DATE '2024-01-03' AND date < cutoff GROUP BY 1, 2""")
def asof_cutoff_profile(spark, d):
    return T.as_of_history(cutoffs(spark, d), daily(spark, d), "2024-01-03").withColumn("median_level", F.round("median_level", 6))


@q(f"""WITH {DAILY}, {CUT} SELECT c.station, c.cutoff, count(level) AS n, round(CASE WHEN count(level) = 7 THEN min_by(level, date) - max_by(level, date) END, 6) AS drawdown
FROM cuts c LEFT JOIN daily d ON d.station = c.station AND date >= cutoff - 7 AND date < cutoff GROUP BY 1, 2""")
def antecedent_drawdown(spark, d):
    return T.antecedent(cutoffs(spark, d), daily(spark, d), 7).withColumn("drawdown", F.round("drawdown", 6))


@q(f"""WITH {DAILY}, b AS (SELECT station, CAST(year(date) AS INTEGER) AS year, (dayofyear(date) - 1) // 7 AS bucket, sum(level) AS s FROM daily GROUP BY 1, 2, 3) SELECT station, year, round(max(s), 6) AS max_sum FROM b GROUP BY 1, 2""")
def tumbling_max(spark, d):
    return T.tumbling_max(daily(spark, d), 7).withColumn("max_sum", F.round("max_sum", 6))


@q(f"""WITH {DAILY}, {CUT},
a AS (SELECT c.station, c.cutoff, CASE WHEN count(level) >= 0.8 * 7 THEN avg(level) END AS before FROM cuts c LEFT JOIN daily d ON d.station = c.station AND date >= cutoff - 7 AND date < cutoff GROUP BY 1, 2),
b AS (SELECT c.station, c.cutoff, CASE WHEN count(level) >= 0.8 * 7 THEN avg(level) END AS control FROM cuts c LEFT JOIN daily d ON d.station = c.station AND date >= cutoff - 17 AND date < cutoff - 10 GROUP BY 1, 2)
SELECT station, cutoff, round(before, 6) AS before, round(control, 6) AS control FROM a JOIN b USING (station, cutoff)""")
def seasonal_self_control(spark, d):
    out = T.seasonal_control(cutoffs(spark, d), daily(spark, d), 7, 10)
    return out.select("station", "cutoff", F.round("before", 6).alias("before"), F.round("control", 6).alias("control"))


@q(f"""WITH {DAILY}, l AS (SELECT station, level, coalesce(level - lag(level, 1) OVER w, 0) AS d1, coalesce(level - lag(level, 7) OVER w, 0) AS d7 FROM daily WINDOW w AS (PARTITION BY station ORDER BY date))
SELECT station, e.elevation, count(*) AS days, round(avg(CAST(d1 < 0 AS DOUBLE)), 9) AS falling, round(avg(CAST(d1 > 0 AS DOUBLE)), 9) AS rising, round(avg(CAST(d7 < -0.5 AS DOUBLE)), 9) AS drops, round(avg(abs(d1)), 6) AS change
FROM l, (VALUES (50::DOUBLE), (100::DOUBLE), (200::DOUBLE)) e(elevation) WHERE level > e.elevation GROUP BY 1, 2""")
def water_operator(spark, d):
    out = T.filtered_exposure(daily(spark, d), [50, 100, 200])
    return out.select("station", "elevation", "days", *[F.round(c, 9).alias(c) for c in ("falling", "rising", "drops")], F.round("change", 6).alias("change"))


QS = (0.1, 0.2, 0.5, 0.8)


@q(f"""WITH {PIXELS}, {DAILY}, st AS (SELECT station, row_number() OVER (ORDER BY station) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT station FROM daily)),
e AS (SELECT unit_id, unnest(['mean', {", ".join(f"'p{round(x * 100)}'" for x in QS)}]) AS variant, unnest([avg(elevation), {", ".join(f"quantile_cont(elevation, {x})" for x in QS)}]) AS raw FROM pixels GROUP BY 1),
r AS (SELECT unit_id, variant, station, round_even(raw / 10 / 0.5, 0) * 0.5 AS elevation FROM e JOIN st ON unit_id % n = k), u AS (SELECT DISTINCT station, elevation FROM r),
w AS (SELECT u.station, u.elevation, count(*) FILTER (level >= u.elevation) AS wet, count(*) AS days FROM u JOIN daily d ON d.station = u.station GROUP BY 1, 2)
SELECT variant, count(*) AS units, round(avg(wet / days::DOUBLE), 6) AS fraction FROM r JOIN w ON w.station = r.station AND w.elevation = r.elevation GROUP BY 1""")
def inundation_variants(spark, d):
    """Mean inundated share by the reference elevation that stands for a unit: its mean or one of its quantiles."""
    days = daily(spark, d)
    one = Window.partitionBy(F.lit(1))
    st = days.select("station").distinct().withColumns({"k": F.row_number().over(one.orderBy("station")) - 1, "n": F.count("*").over(one)})
    stats = pixels(spark, d).groupBy("unit_id").agg(F.avg("elevation").alias("mean"), F.percentile("elevation", F.array(*[F.lit(x) for x in QS])).alias("q"))
    pairs = F.array(F.struct(F.lit("mean").alias("variant"), F.col("mean").alias("raw")), *[F.struct(F.lit(f"p{round(x * 100)}").alias("variant"), F.col("q")[i].alias("raw")) for i, x in enumerate(QS)])
    e = stats.select("unit_id", F.inline(pairs))
    r = e.join(F.broadcast(st), F.col("unit_id") % F.col("n") == F.col("k")).select("unit_id", "variant", "station", (F.rint(F.col("raw") / 10 / 0.5) * 0.5).alias("elevation"))
    return T.wet_counts(days, r, ["station"]).groupBy("variant").agg(F.count("*").alias("units"), F.round(F.avg(F.col("wet") / F.col("days")), 6).alias("fraction"))
