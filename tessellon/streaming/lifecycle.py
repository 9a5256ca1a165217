"""Life of a windowed aggregate in the stream: PROVISIONAL, then FINAL, then CORRECTED where something came later.

Each (sensor, metric, window) publishes numbered versions. While the frontier (the latest event time seen, less the delay)
hasn't passed the window's end and a grace, every batch that changes the aggregate publishes a PROVISIONAL version. When
it has, an event-time timer publishes the FINAL one. A row that comes afterwards publishes a CORRECTED one that names the
version it replaces. State is kept until Spark's own watermark, which stands a horizon behind the latest event, has passed the
window's end; what comes even later never enters the stream's aggregate, and the batch pass below corrects the
published versions instead.

Readings are summed per key in each Arrow batch before the shuffle, so a key with a large share of the rows sends one
row a batch. Versions go to an append-only table; the last version of a key counts.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.operators.layers import unpivoted
from tessellon.operators.serving import newest
from tessellon.registry import NAMES

PROVISIONAL, FINAL, CORRECTED = "PROVISIONAL", "FINAL", "CORRECTED"
KEY = ["sensor_id", "metric", "window_start"]
VERSIONS = "sensor_id string, metric string, window_start timestamp, window_end timestamp, version int, status string, event_count bigint, avg_value double, min_value double, max_value double, previous_version int, frontier timestamp"
# in the state and what it gives, times are milliseconds, which no session's time zone changes
_PARTIAL = "sensor_id string, metric string, start_ms bigint, latest timestamp, n bigint, total double, lo double, hi double"
_GIVEN = "sensor_id string, metric string, start_ms bigint, end_ms bigint, version int, status string, event_count bigint, avg_value double, min_value double, max_value double, previous_version int, frontier_ms bigint"
_STATE = "n bigint, total double, lo double, hi double, version int, status string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _interval(t: timedelta):
    return F.make_dt_interval(secs=F.lit(t.total_seconds()))


def _ms(t: timedelta) -> int:
    return t // timedelta(milliseconds=1)


def partial_sums(silver: DataFrame, width: timedelta, metrics=NAMES, time: str = "event_time_utc") -> DataFrame:
    """Count, sum, least and largest reading of each key in each Arrow batch, with the latest event time among them."""
    start = F.floor(F.unix_millis(time) / _ms(width)) * _ms(width)
    rows = silver.where(F.col(time).isNotNull() & F.col("sensor_id").isNotNull()).withColumn("start_ms", start)
    readings = unpivoted(rows, ["sensor_id", "start_ms", time], metrics)
    key, parts = ["sensor_id", "metric", "start_ms"], ("count", "sum", "min", "max")

    def summed(batches):
        import pyarrow as pa

        for b in batches:
            got = pa.Table.from_batches([b]).group_by(key).aggregate([("latest", "max"), *(("value", f) for f in parts)])
            yield from got.select([*key, "latest_max", *(f"value_{f}" for f in parts)]).rename_columns(_names(_PARTIAL)).to_batches()

    return readings.select(*key, F.col(time).alias("latest"), "value").mapInArrow(summed, _PARTIAL)


def _step(width: int, delay: int, grace: int, horizon: int, floor: int | None):
    """What a batch, or a timer, makes of one key's state: the versions to publish. All times in milliseconds."""

    def step(key, batches, state):
        import pandas as pd

        sensor, metric, start = key[0], key[1], int(key[2])
        end, mark = start + width, state.getCurrentWatermarkMs()
        front = max((x for x in (mark + horizon - delay if mark > 0 else None, floor) if x is not None), default=None)
        over = front is not None and front >= end + grace
        n, total, lo, hi, version, status = state.get if state.exists else (0, 0.0, None, None, 0, "")
        out = []

        def publish(kind):
            nonlocal version, status
            version, status = version + 1, kind
            out.append((sensor, metric, start, end, version, kind, n, total / n, lo, hi, version - 1 if kind == CORRECTED else None, front))

        # a window whose time has come is final before the rows of this batch, which came too late, correct it
        if over and status == PROVISIONAL:
            publish(FINAL)
        if not state.hasTimedOut:
            for part in batches:
                n, total = n + int(part["n"].sum()), total + float(part["total"].sum())
                lo = min(x for x in (lo, float(part["lo"].min())) if x is not None)
                hi = max(x for x in (hi, float(part["hi"].max())) if x is not None)
            publish(CORRECTED if status in (FINAL, CORRECTED) else FINAL if over else PROVISIONAL)
        if state.hasTimedOut and mark > end:
            state.remove()
        else:
            state.update((n, total, lo, hi, version, status))
            due = end + grace - (horizon - delay) if status == PROVISIONAL else end
            state.setTimeoutTimestamp(max(due, mark + 1))
        if not out:
            return
        frame = pd.DataFrame(out, columns=_names(_GIVEN))
        yield frame.astype({"previous_version": "Int32", "frontier_ms": "Int64"})

    return step


def versions(silver: DataFrame, width: timedelta = timedelta(hours=1), delay: timedelta = timedelta(minutes=5), grace: timedelta = timedelta(minutes=1), horizon: timedelta = timedelta(hours=6), frontier: datetime | None = None, metrics=NAMES, time: str = "event_time_utc") -> DataFrame:
    """The stream of versions. frontier is a floor that an earlier run has reached: with a larger delay the frontier would else fall back."""
    if delay + grace > horizon:
        raise ValueError("a window must be final before its state goes: delay and grace exceed the horizon")
    floor = None if frontier is None else int(frontier.replace(tzinfo=frontier.tzinfo or timezone.utc).timestamp() * 1000)
    sums = partial_sums(silver, width, metrics, time).withWatermark("latest", f"{_ms(horizon)} milliseconds")
    given = sums.groupBy("sensor_id", "metric", "start_ms").applyInPandasWithState(_step(*map(_ms, (width, delay, grace, horizon)), floor), _GIVEN, _STATE, "append", "EventTimeTimeout")
    times = {"window_start": "start_ms", "window_end": "end_ms", "frontier": "frontier_ms"}
    return given.select(*(F.timestamp_millis(times[c]).alias(c) if c in times else F.col(c) for c in _names(VERSIONS)))


def current(published: DataFrame) -> DataFrame:
    """The version of each key that counts."""
    return newest(published, KEY, ["version"])


def settled(published: DataFrame) -> DataFrame:
    """Last versions of the windows that are final or corrected: what standard queries read."""
    return current(published).where(F.col("status") != PROVISIONAL)


def boundary(published: DataFrame, before: datetime, after: datetime, grace: timedelta = timedelta(minutes=1)) -> DataFrame:
    """Last versions of the windows that are over for one of two frontiers only: whether they are final hangs on the delay."""
    over = F.col("window_end") + _interval(grace)
    return current(published).where((over > F.lit(min(before, after))) & (over <= F.lit(max(before, after))))


def corrections(published: DataFrame, gold: DataFrame, until: datetime, width: timedelta = timedelta(hours=1), tolerance: float = 1e-6) -> DataFrame:
    """CORRECTED versions where the batch Gold (sensor_id, metric, hour_start, event_count, avg, min, max) differs from what is settled, or has a window that ended by ``until`` and was never published.

    Windows that are still PROVISIONAL are left to the stream. Once these rows are merged a second pass finds none.
    """
    fresh = gold.select("sensor_id", "metric", F.col("hour_start").cast("timestamp").alias("window_start"), *(F.col(c).alias(f"_{c}") for c in ("event_count", "avg_value", "min_value", "max_value")))
    fresh = fresh.where(F.col("window_start") + _interval(width) <= F.lit(until))
    both = fresh.join(current(published), KEY, "left")
    known = F.col("version").isNotNull()
    gap = F.greatest(*(F.abs(F.col(c) - F.col(f"_{c}")) for c in ("avg_value", "min_value", "max_value")))
    differs = ~known | ((F.col("status") != PROVISIONAL) & ((F.col("event_count") != F.col("_event_count")) | (gap > tolerance)))
    end = F.col("window_start") + _interval(width)
    return both.where(differs).select(
        *KEY, end.alias("window_end"), (F.coalesce("version", F.lit(0)) + 1).cast("int").alias("version"), F.lit(CORRECTED).alias("status"), F.col("_event_count").alias("event_count"),
        *(F.col(f"_{c}").alias(c) for c in ("avg_value", "min_value", "max_value")), F.col("version").alias("previous_version"), F.lit(until).cast("timestamp").alias("frontier"),
    ).select(*_names(VERSIONS))


def merged(published: DataFrame, more: DataFrame) -> DataFrame:
    """Both tables of versions, each (key, version) once: what is there already stays, so a repeated pass adds nothing."""
    new = more.dropDuplicates([*KEY, "version"]).join(published.select(*KEY, "version"), [*KEY, "version"], "left_anti")
    return published.unionByName(new.select(*published.columns))
