"""The event-time rules as Structured Streaming: no window sees what lies at or after its cutoff, sums only of complete windows, bounded holding of the last value."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Parquet event files as they arrive."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files).parquet(folder)


def before_cutoff(stream: DataFrame, cutoff: str) -> DataFrame:
    return stream.where(F.col("ts") < F.lit(cutoff).cast("timestamp"))


def complete_windows(stream: DataFrame, width: str, expected: int, late: str = "1 day") -> DataFrame:
    """Sum of each type's tumbling windows, null unless at least the expected number of days is there."""
    days = F.size(F.collect_set(F.to_date("ts")))
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.sum("value").alias("s"), days.alias("days"))
    return w.select(F.col("w.start").alias("start"), "event_type", "days", F.when(F.col("days") >= expected, F.col("s")).alias("total"))


def tumbling_max(stream: DataFrame, width: str, late: str = "1 day") -> DataFrame:
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.max("value").alias("top"))
    return w.select(F.col("w.start").alias("start"), "event_type", "top")


def hold_last(days: int):
    """State function of (station, date, level) rows: level, or the last one of up to ``days`` days ago. State is one day and level for each station."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else (None, None)
        out = []
        rows = pd.concat(list(frames)).sort_values("date")
        for date, level in zip(rows["date"], rows["level"], strict=True):
            day = pd.Timestamp(date)
            if pd.notna(level):
                last = (day.value, float(level))
            held = last[1] if last[0] is not None and 0 <= (day.value - last[0]) // 86_400_000_000_000 <= days else None
            out.append((key[0], date, level, held))
        state.update(last)
        yield pd.DataFrame(out, columns=["station", "date", "level", "held"])

    return step


def bounded_hold(stream: DataFrame, days: int = 3) -> DataFrame:
    return stream.groupBy("station").applyInPandasWithState(hold_last(days), "station string, date date, level double, held double", "day long, level double", "append", GroupStateTimeout.NoTimeout)


def idempotent_append(stream: DataFrame, path: str, checkpoint: str):
    """Each micro-batch replaces its own folder, so a repeated one leaves no second copy."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
