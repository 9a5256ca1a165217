"""Hourly aggregates over a half-open UTC window."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.operators.layers import unpivoted
from tessellon.operators.serving import newest
from tessellon.registry import NAMES


def window(start: str, end: str) -> tuple[datetime, datetime]:
    """A half-open window of whole UTC hours from two ISO texts with offsets; ValueError names the bound that is none."""
    bounds = {text: datetime.fromisoformat(text) for text in (start, end)}
    hours = {text: t.tzinfo and t.astimezone(timezone.utc) for text, t in bounds.items()}
    odd = [text for text, t in hours.items() if not t or t.timestamp() % 3600]
    if odd or not hours[start] < hours[end]:
        raise ValueError(f"{odd[0]} is not a full hour with an offset" if odd else f"{start} is not before {end}")
    return hours[start], hours[end]


def previous_hour(now: datetime, grace_seconds: int = 60) -> tuple[datetime, datetime]:
    """The last full hour that ended at least the grace time ago."""
    end = (now.astimezone(timezone.utc) - timedelta(seconds=grace_seconds)).replace(minute=0, second=0, microsecond=0)
    return end - timedelta(hours=1), end


def in_window(rows: DataFrame, time: str, start, end) -> DataFrame:
    return rows.where((F.col(time) >= F.lit(start)) & (F.col(time) < F.lit(end)))


def computed(rows: DataFrame, now=None) -> DataFrame:
    """Hourly rows with the time of computation."""
    return rows.withColumn("computed_at", F.current_timestamp() if now is None else F.lit(now).cast("timestamp"))


def hourly(silver: DataFrame, start=None, end=None, metrics=NAMES) -> DataFrame:
    """sensor_id, hour_start, metric, event_count (readings), avg, min, max: last received copy of each event in the window."""
    rows = silver.where("event_id is not null and sensor_id is not null and event_time_utc is not null")
    if start is not None:
        rows = in_window(rows, "event_time_utc", start, end)
    rows = newest(rows, "event_id", ["received_at_utc", "kafka_partition", "kafka_offset"])
    readings = unpivoted(rows.withColumn("hour_start", F.date_trunc("hour", "event_time_utc")), ["sensor_id", "hour_start"], metrics)
    return readings.groupBy("sensor_id", "hour_start", "metric").agg(F.count("*").alias("event_count"), F.avg("value").alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
