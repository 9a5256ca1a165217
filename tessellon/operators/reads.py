"""Read queries over the serving tables, as the API answers them."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_ROWS = 500


def instant(text: str | None) -> datetime | None:
    """A query parameter: ISO, UTC if it has no offset."""
    if not text:
        return None
    t = datetime.fromisoformat(text)
    return t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)


def page(rows: DataFrame, order: list, limit: int, offset: int) -> DataFrame:
    """A page in a total order; limit from 1 to MOST_ROWS, offset 0 at least."""
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(limit, MOST_ROWS)))


def latest(table: DataFrame, sensor_id=None, limit: int = 100, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """The page by sensor and a one-row total."""
    own = table.where(F.col("sensor_id") == sensor_id) if sensor_id is not None else table
    return page(own, ["sensor_id"], limit, offset), own.agg(F.count("*").alias("total"))


def alerts(table: DataFrame, limit: int = 100, offset: int = 0) -> DataFrame:
    return page(table, [F.desc("created_at"), "event_id", "rule_id"], limit, offset)


def stats(gold: DataFrame, start: datetime | None = None, end: datetime | None = None, sensor_id=None, now: datetime | None = None) -> DataFrame:
    """Hourly rows in [start, end): the whole table if neither is given, else a day up to the end (now by default)."""
    rows = gold
    if start is not None or end is not None:
        end = end or now or datetime.now(timezone.utc)
        start = start or end - timedelta(hours=24)
        if start >= end:
            raise ValueError("start must be before end")
        rows = rows.where((F.col("hour_start") >= F.lit(start)) & (F.col("hour_start") < F.lit(end)))
    if sensor_id is not None:
        rows = rows.where(F.col("sensor_id") == sensor_id)
    return rows.orderBy("hour_start", "sensor_id", "metric")


def latest_duplicates(ledger: DataFrame, limit: int = 50) -> DataFrame:
    """Events that came more than once, the last repeated first."""
    return page(ledger.where("duplicate_count > 0").select("event_id", "duplicate_count", "first_processed_at", "last_duplicate_at"), [F.desc_nulls_last("last_duplicate_at"), "event_id"], limit, 0)


def serving_summary(ledger: DataFrame, counter: str = "duplicate_count") -> DataFrame:
    return ledger.agg(
        F.count("*").alias("events"), F.count_if(F.col(counter) > 0).alias("duplicated_events"), F.coalesce(F.sum(counter), F.lit(0)).alias("duplicate_occurrences"),
        F.max(counter).alias("most_duplicates"), F.max("first_processed_at").alias("last_processed_at"),
    )


def gold_summary(gold: DataFrame) -> DataFrame:
    return gold.agg(
        F.count("*").alias("gold_rows"), F.coalesce(F.sum("event_count"), F.lit(0)).alias("gold_readings"), F.count_distinct("sensor_id").alias("gold_sensors"), F.count_distinct("metric").alias("gold_metrics"),
        F.count_distinct("hour_start").alias("gold_hours"), F.min("hour_start").alias("gold_start"), F.max("hour_start").alias("gold_last_hour"), (F.max("hour_start") + F.expr("interval 1 hour")).alias("gold_end"),
        F.max("computed_at").alias("gold_computed_at"),
    )


def summary(ledger: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: what the serving tables and the hourly aggregates hold."""
    return serving_summary(ledger).crossJoin(gold_summary(gold))


class Cached:
    """The rows of a small query, asked again only when they are older than so many seconds. Callers at the same time share one run; a failed one isn't kept."""

    def __init__(self, make: Callable[[], DataFrame], seconds: float = 5.0, clock: Callable[[], float] = time.monotonic):
        self.make, self.seconds, self.clock = make, seconds, clock
        self._lock, self._rows, self._at = threading.Lock(), None, None

    def rows(self) -> list:
        with self._lock:
            if self._at is None or self.clock() - self._at >= self.seconds:
                self._rows = self.make().collect()
                self._at = self.clock()
            return self._rows


def progress(ledger: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One row: events, those repeated, when the last was processed, and a count per table."""
    own = ledger.agg(F.count("*").alias("events"), F.count_if(F.col("duplicate_count") > 0).alias("duplicates"), F.max("first_processed_at").alias("last_processed_at"))
    return own.crossJoin(table_counts(tables))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row with a count per table: one-row aggregates side by side."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count("*").alias(name))
        out = one if out is None else out.crossJoin(one)
    return out


def health(spark) -> dict:
    """ok if the session answers a query, else degraded."""
    try:
        return {"status": "ok" if spark.sql("select 1").first()[0] == 1 else "degraded"}
    except Exception as e:  # whatever keeps the session from answering is the answer
        return {"status": "degraded", "reason": str(e)[:200]}


def status_colour(rows: DataFrame, metric: str, rule) -> DataFrame:
    """Rows with alert (beyond the threshold), ok or none (no reading) for a metric."""
    v = F.col(metric)
    return rows.withColumn("status", F.when(v.isNull(), "none").when(v > rule.threshold if rule.direction == "high" else v < rule.threshold, "alert").otherwise("ok"))
