"""Adapters from the standard tables to the engine's shapes, and the query collector."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collector():
    """Two dicts and a decorator that fills them: query function by name, and its SQL."""
    queries, oracles = {}, {}

    def plan(sql: str | None = None):
        def put(f):
            queries[f.__name__] = f
            if sql:
                oracles[f.__name__] = sql
            return f

        return put

    return queries, oracles, plan


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The metric vector of lineitem rows (adapter V).
VECTOR = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def vector(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def payloads(spark, sf_dir: str, whole_ids: bool = False) -> DataFrame:
    """Bronze rows made of events, with faults by event_id mod 50 (adapter P).

    The SQL of quarantine and dq_ratios pads ids to six digits with lpad, which cuts longer ones; so from a million events on ids
    repeat there. whole_ids pads without cutting: each event keeps an id of its own, as the SQL of the aggregates has it.
    """
    e = table(spark, sf_dir, "events")
    b = F.col("event_id") % 50
    when = lambda k, x, y: F.when(b == k, x).otherwise(y)
    text = lambda c: c.cast("string")
    digits = text(F.col("event_id"))
    padded = F.lpad(digits, F.greatest(F.lit(6), F.length(digits)) if whole_ids else 6, "0")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    body = F.to_json(
        F.struct(
            when(1, F.lit(" "), F.concat(F.lit("zoneA-"), padded)).alias("event_id"),
            F.when(b != 2, F.concat(F.lit("zoneA_MULTI_"), text(F.col("user_id") % 10))).alias("sensor_id"),
            when(3, F.lit("not-a-timestamp"), at).alias("event_time"),
            F.when(b != 4, at).alias("ingest_time"),
            F.when(b == 5, F.lit("hot")).when(b == 6, F.lit("2000")).when(b != 8, text(F.floor(F.col("value") / 10))).alias("temperature_c"),
            F.when(b == 8, F.lit("21")).alias("value"),
            when(7, F.lit("-1"), text(F.floor(F.col("value")).cast("bigint") % 100)).alias("humidity_pct"),
        )
    )
    late = F.when(b == 10, 120).when(b == 11, 61).when(b == 12, 60).otherwise(1)
    ts = F.col("ts").cast("timestamp")
    return e.select(
        when(9, F.lit("{broken"), body).alias("raw_payload"), F.concat(F.lit("sensors/"), text(F.col("user_id")), F.lit("/telemetry")).alias("mqtt_topic"), F.lit("sensor_raw").alias("kafka_topic"),
        (F.col("event_id") % 3).cast("int").alias("kafka_partition"), F.col("event_id").alias("kafka_offset"), ts.alias("kafka_timestamp"), (F.date_trunc("second", ts) + F.make_dt_interval(secs=late)).alias("received_at_utc"),
    )


#: The class of each event under the faults of payloads(), written down directly.
P_SQL = """
p AS (
  SELECT event_id AS n, event_id % 50 AS b, user_id, date_trunc('second', ts) AS t, value,
         CASE WHEN event_id % 50 IN (3, 9) THEN 'missing_or_invalid_event_time' WHEN event_id % 50 = 4 THEN 'missing_or_invalid_ingest_time'
              WHEN event_id % 50 = 2 THEN 'missing_field:sensor_id' WHEN event_id % 50 = 1 THEN 'missing_field:event_id' END AS reason,
         CASE WHEN event_id % 50 IN (5, 6) THEN NULL WHEN event_id % 50 = 8 THEN 21.0 ELSE floor(value / 10) END AS temperature_c,
         CASE WHEN event_id % 50 = 7 THEN NULL ELSE CAST(CAST(floor(value) AS BIGINT) % 100 AS DOUBLE) END AS humidity_pct,
         CASE WHEN event_id % 50 = 5 THEN 'non_numeric:temperature_c' WHEN event_id % 50 = 6 THEN 'value_out_of_bounds:temperature_c' WHEN event_id % 50 = 7 THEN 'value_out_of_bounds:humidity_pct' END AS issues,
         event_id % 50 IN (10, 11) AS late
  FROM events
)"""
