"""Event-time features: everything that a feature may see lies strictly before its cutoff.

Series are long tables of (station, date, level). Missing days stay missing unless a bounded hold fills them from the past; sums over fixed windows are null
unless every row of the window is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def spine(daily: DataFrame) -> DataFrame:
    """All days between the first and the last of each station, with level where there is one."""
    ends = daily.groupBy("station").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    days = ends.select("station", F.explode(F.sequence("lo", "hi")).alias("date"))
    return days.join(daily.groupBy("station", "date").agg(F.max("level").alias("level")), ["station", "date"], "left")


def by_day(*rows) -> Window:
    w = Window.partitionBy("station").orderBy("date")
    return w.rowsBetween(*rows) if rows else w


def bounded_hold(series: DataFrame, days: int = 3) -> DataFrame:
    """series with held: the last level of up to ``days`` days ago, never one of a later day."""
    return series.withColumn("held", F.last("level", ignorenulls=True).over(by_day(-days, 0)))


def full_fill(series: DataFrame) -> DataFrame:
    """series with filled: the last level before, else the first after."""
    before = F.last("level", ignorenulls=True).over(by_day(Window.unboundedPreceding, 0))
    after = F.first("level", ignorenulls=True).over(by_day(0, Window.unboundedFollowing))
    return series.withColumn("filled", F.coalesce(before, after))


def gap_audit(series: DataFrame, days: int = 3) -> DataFrame:
    """Expected, observed, held and missing days, and the longest run of days without a level."""
    s = bounded_hold(series, days)
    s = s.withColumn("rn", F.row_number().over(by_day()))
    run = F.col("rn") - F.row_number().over(Window.partitionBy("station", F.col("level").isNull()).orderBy("date"))
    gaps = s.withColumn("run", run).where("level IS NULL").groupBy("station", "run").count().groupBy("station").agg(F.max("count").alias("longest_gap"))
    counts = s.groupBy("station").agg(F.count("*").alias("expected"), F.count("level").alias("observed"), F.count_if(F.col("level").isNull() & F.col("held").isNotNull()).alias("held"), F.count_if(F.col("held").isNull()).alias("missing"))
    return counts.join(gaps, "station", "left").withColumn("longest_gap", F.coalesce("longest_gap", F.lit(0)).cast("long"))


def complete_sum(value: str, n: int, window: Window) -> Column:
    """Sum of the n rows before the current one; null unless there are n with a value."""
    w = window.rowsBetween(-n, -1)
    return F.when(F.count(value).over(w) == n, F.sum(value).over(w))


def lag_difference(value: str, n: int, window: Window) -> Column:
    """Difference to n rows before, 0 where there is none."""
    return F.coalesce(F.col(value) - F.lag(value, n).over(window), F.lit(0.0))


def transitions(series: DataFrame, elevations: list[float]) -> DataFrame:
    """Changes between wet (level >= elevation) and dry on adjacent days, for each station and elevation.

    A change at elevation e means lower < e <= higher of the two days' levels, so days and elevations meet through counts of levels alone.
    """
    s = series.withColumn("prev", F.lag("level").over(by_day())).where("prev IS NOT NULL AND level IS NOT NULL")
    s = s.select("station", F.least("prev", "level").alias("lo"), F.greatest("prev", "level").alias("hi"))
    s = s.withColumn("elevation", F.explode(F.array(*[F.lit(float(e)) for e in elevations])))
    return s.groupBy("station", "elevation").agg(F.count_if((F.col("lo") < F.col("elevation")) & (F.col("elevation") <= F.col("hi"))).alias("transitions"), F.count("*").alias("days"))


def wet_counts(levels: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, elevation) with wet: rows of levels (keys, level) at or above the elevation; and days, all of them.

    Both sides are first counted by value, then merged in one ordered pass of each key: no pair of a day and a point is formed.
    """
    a = levels.where("level IS NOT NULL").groupBy(*keys, F.col("level").alias("value")).agg(F.count("*").alias("n"))
    b = points.where("elevation IS NOT NULL").select(*keys, F.col("elevation").alias("value")).distinct()
    # At equal values the level counts as wet: the point's row comes after it in the order from the highest down.
    both = a.select(*keys, "value", "n", F.lit(0).alias("point")).unionByName(b.select(*keys, "value", F.lit(0).cast("long").alias("n"), F.lit(1).alias("point")))
    down = Window.partitionBy(*keys).orderBy(F.desc("value"), "point").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumns({"wet": F.sum("n").over(down), "days": F.sum("n").over(Window.partitionBy(*keys))}).where("point = 1 AND days > 0")
    return points.join(both.select(*keys, F.col("value").alias("elevation"), "wet", "days"), [*keys, "elevation"], "left")


def previous_month_wet_days(points: DataFrame, daily: DataFrame) -> DataFrame:
    """points (station, month, elevation) with wet, the days of the month before ``month`` whose level reaches the elevation (not rounded), and days; both null unless every day of it has a level."""
    levels = daily.where("level IS NOT NULL").select("station", F.add_months(F.trunc("date", "MM"), 1).alias("month"), "date", "level")
    whole = levels.groupBy("station", "month").agg(F.count_distinct("date").alias("n")).where(F.col("n") == F.dayofmonth(F.last_day(F.add_months("month", -1))))
    return wet_counts(levels.join(whole, ["station", "month"], "left_semi"), points, ["station", "month"])


def as_of_history(cutoffs: DataFrame, daily: DataFrame, start: str) -> DataFrame:
    """Statistics of each distinct (station, cutoff) over the days from start up to, but without, the cutoff."""
    pairs = cutoffs.select("station", "cutoff").distinct()
    h = pairs.join(daily, "station").where((F.col("date") >= F.lit(start).cast("date")) & (F.col("date") < F.col("cutoff")))
    stats = h.groupBy("station", "cutoff").agg(F.count("level").alias("days"), F.max("date").alias("last_day"), F.max_by("level", "date").alias("last_level"), F.percentile("level", F.lit(0.5)).alias("median_level"))
    return pairs.join(stats, ["station", "cutoff"], "left").withColumn("days", F.coalesce("days", F.lit(0)))


def antecedent(cutoffs: DataFrame, daily: DataFrame, days: int) -> DataFrame:
    """First minus last level of the days before each cutoff, null unless every day is there."""
    pairs = cutoffs.select("station", "cutoff").distinct()
    h = pairs.join(daily, "station").where((F.col("date") >= F.date_sub("cutoff", days)) & (F.col("date") < F.col("cutoff")))
    agg = h.groupBy("station", "cutoff").agg(F.count("level").alias("n"), (F.min_by("level", "date") - F.max_by("level", "date")).alias("fall"))
    return pairs.join(agg, ["station", "cutoff"], "left").select("station", "cutoff", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == days, F.col("fall")).alias("drawdown"))


def monthly_change(daily: DataFrame) -> DataFrame:
    """Largest absolute change between the means of adjacent months (here: weeks of a month) of a station."""
    m = daily.groupBy("station", F.trunc("date", "week").alias("period")).agg(F.avg("level").alias("mean"))
    m = m.withColumn("change", F.abs(F.col("mean") - F.lag("mean").over(Window.partitionBy("station").orderBy("period"))))
    return m.groupBy("station").agg(F.max("change").alias("max_change"))


def tumbling_max(daily: DataFrame, days: int) -> DataFrame:
    """Largest sum of a level over non-overlapping windows of days, counted from each year's first day; the year's last, shorter window counts too."""
    b = daily.groupBy("station", F.year("date").alias("year"), F.floor((F.dayofyear("date") - 1) / days).alias("bucket")).agg(F.sum("level").alias("s"))
    return b.groupBy("station", "year").agg(F.max("s").alias("max_sum"))


def relative_years(cutoffs: DataFrame, yearly: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, maximum and sum of the two full years before the cutoff's year, and their mean less that of all earlier years; null unless both years are there."""
    t = cutoffs.select(key, F.year("cutoff").alias("t")).distinct()
    h = t.join(yearly, key).where("year < t")
    near = F.col("year") >= F.col("t") - 2
    agg = h.groupBy(key, "t").agg(F.count_if(near & F.col(value).isNotNull()).alias("n"), F.avg(F.when(near, F.col(value))).alias("mean2"), F.max(F.when(near, F.col(value))).alias("max2"), F.sum(F.when(near, F.col(value))).alias("sum2"), F.avg(value).alias("mean_all"))
    ok = F.col("n") == 2
    return agg.select(key, "t", *[F.when(ok, F.col(c)).alias(c) for c in ("mean2", "max2", "sum2")], F.when(ok, F.col("mean2") - F.col("mean_all")).alias("departure"))


def lag_flag(yearly: DataFrame, key: str, values: list[str], limit: float) -> DataFrame:
    """Differences of a year to the year before, and whether any of them exceeds the limit; null unless the year before is there."""
    w = Window.partitionBy(key).orderBy("year")
    there = F.lag("year").over(w) == F.col("year") - 1
    d = yearly.withColumns({f"{v}_change": F.when(there, F.col(v) - F.lag(v).over(w)) for v in values})
    flag = F.lit(False)
    for v in values:
        flag = flag | (F.abs(F.col(f"{v}_change")) > limit)
    return d.withColumn("changed", flag)


def seasonal_control(events: DataFrame, daily: DataFrame, days: int, offset: int) -> DataFrame:
    """Mean level of the days before an event, and of the same stretch some days earlier; null where less than 80 % of the days are there."""
    pairs = events.select("station", "cutoff").distinct()
    out = pairs
    for name, shift in (("before", 0), ("control", offset)):
        hi = F.date_sub("cutoff", shift)
        h = pairs.join(daily, "station").where((F.col("date") >= F.date_sub(hi, days)) & (F.col("date") < hi))
        agg = h.groupBy("station", "cutoff").agg(F.when(F.count("level") >= 0.8 * days, F.avg("level")).alias(name))
        out = out.join(agg, ["station", "cutoff"], "left")
    return out


def filtered_exposure(series: DataFrame, elevations: list[float]) -> DataFrame:
    """Shares of falling, rising and 7-day-drop days, and the mean absolute daily change, over the days whose level is above each elevation."""
    w = Window.partitionBy("station").orderBy("date")
    s = series.where("level IS NOT NULL").withColumns({"d1": lag_difference("level", 1, w), "d7": lag_difference("level", 7, w)})
    s = s.withColumn("elevation", F.explode(F.array(*[F.lit(float(e)) for e in elevations]))).where("level > elevation")
    return s.groupBy("station", "elevation").agg(F.count("*").alias("days"), F.avg((F.col("d1") < 0).cast("double")).alias("falling"), F.avg((F.col("d1") > 0).cast("double")).alias("rising"), F.avg((F.col("d7") < -0.5).cast("double")).alias("drops"), F.avg(F.abs("d1")).alias("change"))
