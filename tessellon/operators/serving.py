"""Keyed serving tables as functions from (stored, batch) to the next state.

Each function is a pure DataFrame plan with one shuffle on the key: union of stored and incoming rows and a
mergeable max_by, or a group and a full outer join. The snapshot store in streaming/ makes a batch's results visible at
once and ignores a batch that was applied before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessellon.functions.quality import any_present, differs
from tessellon.registry import ALERTABLE, NAMES


def newest(rows: DataFrame, key: str | list[str], order: list[str]) -> DataFrame:
    """The row of each key that is last by the order columns, nulls first. Spark drops losers before the shuffle."""
    w = Window.partitionBy(*([key] if isinstance(key, str) else key)).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def stamped(rows: DataFrame, column: str, wanted: list[str], now=None) -> DataFrame:
    """rows with the column set to now (by default the time of the query) if the wanted columns have it."""
    return rows.withColumn(column, F.current_timestamp() if now is None else F.lit(now).cast("timestamp")) if column in wanted else rows


def upsert_latest(stored: DataFrame, batch: DataFrame, key: str = "sensor_id", order=("event_time", "received_at", "event_id"), metrics=NAMES, now=None) -> DataFrame:
    """Latest state per key: a batch row replaces the stored row as a whole if it is strictly later; rows without any metric or with a null in key or order are passed over."""
    ready = batch.where(any_present(metrics) & reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in (key, *order))))
    ready = stamped(ready, "updated_at", stored.columns, now)
    both = stored.withColumn("_old", F.lit(1)).unionByName(ready.select(*stored.columns).withColumn("_old", F.lit(0)))
    return newest(both, key, [*order, "_old"]).drop("_old")


def alerts(batch: DataFrame, rules=ALERTABLE, ids=("event_id", "sensor_id", "event_time")) -> DataFrame:
    """One row per event and rule beyond its threshold; a null or a value at the threshold never fires."""
    legacy = F.col("temperature_c") if "temperature_c" in batch.columns else F.lit(None).cast("double")
    rows = batch.select(*ids, legacy.alias("_t"), *(m.name for m in rules)).unpivot([*ids, "_t"], [m.name for m in rules], "metric", "value")
    table = {m.name: m for m in rules}
    by = lambda f: F.create_map(*(F.lit(x) for n, m in table.items() for x in (n, f(m))))[F.col("metric")]
    fires = F.when(by(lambda m: m.direction) == "high", F.col("value") > by(lambda m: m.threshold)).otherwise(F.col("value") < by(lambda m: m.threshold))
    return rows.where(fires).select(ids[0], F.col("metric").alias("rule_id"), *ids[1:], "metric", by(lambda m: m.threshold).alias("threshold"), by(lambda m: m.direction).alias("direction"), "value", F.col("_t").alias("temperature_c"))


def insert_alerts(stored: DataFrame, batch: DataFrame, keys=("event_id", "rule_id"), now=None) -> DataFrame:
    """Stored alerts, or rows of any seeded table, and those new ones whose key isn't there yet."""
    batch = stamped(batch, "created_at", stored.columns, now)
    return stored.unionByName(batch.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti").select(*stored.columns))


def upsert_ledger(stored: DataFrame, batch: DataFrame, key: str = "event_id", order=("kafka_partition", "kafka_offset"), counter: str = "duplicate_count", now=None) -> DataFrame:
    """Duplicate ledger: a new key stores its first occurrence, when it was processed and n - 1 duplicates; a known one only counts n more and when."""
    times = {"first_processed_at", "last_duplicate_at"} & {*stored.columns}
    kept = [c for c in stored.columns if c not in (key, counter, *times)]
    place = F.struct(*(x for c in order for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))))
    seen = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"), F.min_by(F.struct(*kept), place).alias("_first"))
    joined = stored.withColumn("_known", F.lit(True)).join(seen, key, "full")
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    set_ = {"first_processed_at": F.when(F.col("_known"), F.col("first_processed_at")).otherwise(at) if times else None, "last_duplicate_at": F.when(F.col("_known") & F.col("_n").isNotNull(), at).otherwise(F.col("last_duplicate_at")) if "last_duplicate_at" in times else None}
    count = F.when(F.col("_known"), F.col(counter) + F.coalesce("_n", F.lit(0))).otherwise(F.col("_n") - 1)
    return joined.select(key, *(F.when(F.col("_known"), F.col(c)).otherwise(F.col(f"_first.{c}")).alias(c) for c in kept), *(set_[c].alias(c) for c in sorted(times)), count.alias(counter)).select(*stored.columns)


def payload_conflicts(ledger: DataFrame, batch: DataFrame, key: str = "event_id", columns=NAMES) -> DataFrame:
    """Batch rows whose vector differs from what the ledger (after the batch) holds for their key."""
    old = ledger.select(key, *(F.col(c).alias(f"_s_{c}") for c in columns))
    return batch.join(old, key).where(differs([(F.col(c), F.col(f"_s_{c}")) for c in columns])).select(*batch.columns)


def replace_keys(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Fresh rows, and stored rows whose key has none; keys that a rerun no longer makes stay."""
    return fresh.unionByName(stored.join(fresh.select(*keys), keys, "left_anti").select(*fresh.columns))


def replace_window(stored: DataFrame, fresh: DataFrame, time: str, start, end) -> DataFrame:
    """Fresh rows in place of everything stored in [start, end): stale keys go too."""
    return fresh.unionByName(stored.where((F.col(time) < F.lit(start)) | (F.col(time) >= F.lit(end))))
