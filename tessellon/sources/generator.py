"""Synthetic telemetry and faults as expressions over a row number, so any part of a stream can be made anew."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.registry import METRICS, STATIONS

# Faults and the share of events that get each, in per mille, in this order.
FAULTS = (("duplicate", 20), ("missing_field", 10), ("non_numeric", 10), ("bad_timestamp", 10), ("out_of_bounds", 10), ("late_30s", 5), ("late_5min", 5))
CYCLE = ("WEATHER", "AIR", "MULTI")


def uniform(n: Column, seed: int, salt: str) -> Column:
    """A number in [0, 1) that depends on the row, the seed and the salt alone."""
    return F.pmod(F.xxhash64(n, F.lit(seed), F.lit(salt)), F.lit(1 << 30)) / float(1 << 30)


def fault_of(draw: Column) -> Column:
    """The fault of a draw in [0, 1): cumulative bands, null for most events."""
    out, upper = None, 0
    for name, share in FAULTS:
        upper += share
        test = draw < upper / 1000
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def events(spark: SparkSession, n: int, zone: str = "zoneA", sensors: int = 3, seed: int = 42, rate: float = 2.0, start: str = "2026-01-01T00:00:00Z", spike_pct: float = 2.0, faults: bool = False) -> DataFrame:
    """n events: payload (JSON), mqtt_topic, fault. Stations cycle through the types; a spike puts one present metric beyond its threshold; duplicates repeat the event before."""
    row = spark.range(n).withColumn("fault", fault_of(uniform(F.col("id"), seed, "fault")) if faults else F.lit(None).cast("string"))
    row = row.withColumn("seq", F.when(F.col("fault") == "duplicate", F.greatest(F.col("id") - 1, F.lit(0))).otherwise(F.col("id")))
    k = F.col("seq") % sensors
    kind = F.element_at(F.array(*map(F.lit, CYCLE)), (k % 3 + 1).cast("int"))
    sensor = F.concat_ws("_", F.lit(zone), kind, F.lpad((k + 1).cast("string"), 2, "0"))
    seconds = F.col("seq") / rate - F.when(F.col("fault") == "late_30s", 30).when(F.col("fault") == "late_5min", 300).otherwise(0)
    at = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + (seconds * 1e6).cast("bigint"))
    iso = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    spiked = uniform(F.col("seq"), seed, "spike") < spike_pct / 100
    fields = []
    draw = F.xxhash64("seq", F.lit(seed))
    for m in METRICS:
        has = reduce(lambda a, b: a | b, (kind == t for t, names in STATIONS.items() if m.name in names))
        # an ordinary reading alerts nobody: it stays clear of the threshold on its good side
        lo, hi = (m.threshold, m.high) if m.direction == "low" else (m.low, m.threshold or m.high)
        share = uniform(F.col("seq"), seed, m.name)
        base = lo + (hi - lo) * (0.1 + 0.4 * share if m.direction == "low" else 0.5 + 0.4 * share)
        # one of the station's own metrics has the spike
        place = reduce(lambda out, item: out.when(kind == item[0], F.pmod(draw, F.lit(len(item[1]))) == item[1].index(m.name)), [(t, names) for t, names in STATIONS.items() if m.name in names], F.when(F.lit(False), False))
        chosen = F.coalesce(place, F.lit(False)) & spiked
        spike = F.lit(m.threshold * (1.1 if m.direction == "high" else 0.95)) if m.threshold else base
        text = F.round(F.when(chosen, spike).otherwise(base), 2).cast("string")
        text = F.when(F.col("fault") == "non_numeric", "hot").when(F.col("fault") == "out_of_bounds", str(10 * m.high)).otherwise(text)
        fields.append(F.when(has, text).alias(m.name))
    body = F.to_json(
        F.struct(
            F.concat_ws("-", F.lit(zone), F.lpad(F.col("seq").cast("string"), 6, "0")).alias("event_id"),
            F.when(F.coalesce(F.col("fault"), F.lit("")) != "missing_field", sensor).alias("sensor_id"),
            F.when(F.col("fault") == "bad_timestamp", "not-a-timestamp").otherwise(iso(at)).alias("event_time"),
            iso(F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + (F.col("seq") / rate * 1e6 + 120_000).cast("bigint"))).alias("ingest_time"),
            kind.alias("sensor_type"), F.lit("si").alias("unit"), F.lit(zone).alias("location"), F.col("seq").cast("string").alias("sequence_no"), *fields,
        )
    )
    return row.select("id", body.alias("payload"), F.concat(F.lit("sensors/"), sensor, F.lit("/telemetry")).alias("mqtt_topic"), "fault")


def as_kafka(rows: DataFrame, topic: str = "sensor_raw", partitions: int = 3) -> DataFrame:
    """Generated events in the shape of Kafka source rows."""
    header = F.array(F.struct(F.lit("mqtt_topic").alias("key"), F.encode("mqtt_topic", "UTF-8").alias("value")))
    return rows.select(
        F.encode(F.col("mqtt_topic"), "UTF-8").alias("key"), F.encode("payload", "UTF-8").alias("value"), F.lit(topic).alias("topic"), (F.col("id") % partitions).cast("int").alias("partition"),
        F.floor(F.col("id") / partitions).cast("bigint").alias("offset"), F.current_timestamp().alias("timestamp"), F.lit(0).alias("timestampType"), header.alias("headers"),
    )
