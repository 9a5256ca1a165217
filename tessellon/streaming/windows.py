"""Deduplication and event-time windows with state, and the accounts of what their watermarks leave out.

The functions are the same for a stream and for a table: over a table a watermark does nothing, so the batch result is what
the stream's would be if no row came late. That is what the accounts compare with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(rows: DataFrame, keys=("event_id",), time: str = "received_at_utc", horizon: str = "1 hour") -> DataFrame:
    """The first row of each key; its copies within the horizon are dropped by state that expires by watermark.

    Time is that of receipt, which Bronze stamps batch by batch, so no first row is late; state holds the keys of
    about one horizon. A copy that comes when its key's state is gone passes, and the ledger counts it (see duplicate_account).
    """
    own = rows.withWatermark(time, horizon)
    return own.dropDuplicatesWithinWatermark(list(keys)) if rows.isStreaming else own.dropDuplicates(list(keys))


def duplicate_account(progress: DataFrame, query: str, ledger: DataFrame, received: DataFrame) -> DataFrame:
    """One row: rows received, those that the query's state or watermark dropped (from its progress log), those in the ledger, and whether these make up all."""
    per_batch = progress.where(F.col("query") == query).groupBy("batch_id").agg(F.max("dropped_duplicates").alias("d"), F.max("dropped_late").alias("l"))
    dropped = per_batch.agg(F.coalesce(F.sum("d"), F.lit(0)).alias("dropped_in_state"), F.coalesce(F.sum("l"), F.lit(0)).alias("dropped_late"))
    known = ledger.agg(F.count("*").alias("events"), F.coalesce(F.sum("duplicate_count"), F.lit(0)).alias("counted_by_ledger"))
    every = received.agg(F.count("*").alias("received"))
    made = F.col("events") + F.col("counted_by_ledger") + F.col("dropped_in_state") + F.col("dropped_late")
    return every.crossJoin(dropped).crossJoin(known).withColumn("complete", F.col("received") == made)


def tumbling(rows: DataFrame, time: str = "event_time_utc", width: str = "10 minutes", late: str = "5 minutes", keys=("sensor_id",), aggregates=None) -> DataFrame:
    """window_start, window_end, keys and counts (or the aggregates given) of half-open windows."""
    return sliding(rows, time, width, width, late, keys, aggregates)


def sliding(rows: DataFrame, time: str = "event_time_utc", width: str = "10 minutes", slide: str = "5 minutes", late: str = "5 minutes", keys=("sensor_id",), aggregates=None) -> DataFrame:
    """As tumbling, for windows that begin every slide: a row counts in each that holds it."""
    return _grouped(rows, time, F.window(time, width, slide), late, keys, aggregates)


def sessions(rows: DataFrame, time: str = "event_time_utc", gap: str = "10 minutes", late: str = "5 minutes", keys=("sensor_id",), aggregates=None) -> DataFrame:
    """As tumbling, for runs of rows less than a gap apart; a row between two sessions merges their states. The end is the last row's time and the gap."""
    return _grouped(rows, time, F.session_window(time, gap), late, keys, aggregates)


def _grouped(rows, time, window, late, keys, aggregates):
    got = rows.withWatermark(time, late).groupBy(window.alias("_w"), *keys).agg(*(aggregates or [F.count("*").alias("n")]))
    return got.select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), *(c for c in got.columns if c != "_w"))


def window_account(counted: DataFrame, every: DataFrame, keys, n: str = "n") -> DataFrame:
    """Per key: rows that the stream's windows counted, all rows (the same windows over the whole table), and those the watermark dropped.

    Keys may hold the window's start for fixed windows; for sessions, whose bounds shift when a row is missing, they are the grouping
    keys alone. Windows that aren't published yet count as open, so take the account after a last batch, or up to a time.
    """
    total = lambda df, name: df.groupBy(*keys).agg(F.sum(n).alias(name))
    both = total(every, "n_all").join(total(counted, "n_counted"), list(keys), "full")
    both = both.select(*keys, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_all", "n_counted")))
    return both.withColumn("n_dropped", F.col("n_all") - F.col("n_counted"))
