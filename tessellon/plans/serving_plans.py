"""Hourly aggregates, serving tables and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellon.functions.quality import validated
from tessellon.operators import gold, layers, reconcile, serving
from tessellon.plans.common import P_SQL, VECTOR, collector, payloads, table, vector
from tessellon.registry import Metric

QUERIES, ORACLES, plan = collector()
V = ", ".join(VECTOR)
RULES = (Metric("l_quantity", 0, 0, 45.0, "high"), Metric("l_discount", 0, 0, 0.02, "low"), Metric("l_tax", 0, 0, 0.07, "high"))


def _hours(e):
    hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_start")
    return e.groupBy(F.col("user_id").alias("sensor_id"), hour, F.col("event_type").alias("metric")).agg(
        F.count("value").alias("event_count"), F.round(F.avg("value"), 6).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


HOURS_SQL = """SELECT user_id AS sensor_id, date_trunc('hour', ts) AS hour_start, event_type AS metric, count(value) AS event_count,
       round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value FROM events {} GROUP BY 1, 2, 3"""


@plan(HOURS_SQL.format(""))
def gold_hourly(spark, sf_dir):
    return _hours(table(spark, sf_dir, "events"))


@plan("""SELECT date_trunc('hour', ts) AS hour_start, count(*) AS n, round(sum(value), 4) AS total FROM events
WHERE ts >= (SELECT date_trunc('hour', min(ts)) + INTERVAL 2 HOUR FROM events) AND ts < (SELECT date_trunc('hour', min(ts)) + INTERVAL 26 HOUR FROM events) GROUP BY 1""")
def gold_window_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.date_trunc("hour", F.min("ts")).cast("timestamp_ntz").alias("t")).first()["t"]
    from datetime import timedelta

    rows = gold.in_window(e, "ts", first + timedelta(hours=2), first + timedelta(hours=26))
    return rows.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@plan(f"""WITH d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST) AS rn FROM lineitem),
u AS (SELECT * FROM (SELECT l_shipdate, {V} FROM d WHERE rn = 1) UNPIVOT (value FOR metric IN ({V})))
SELECT CAST(l_shipdate AS DATE) AS day, metric, count(*) AS event_count, round(avg(value), 8) AS avg_value, min(value) AS min_value, max(value) AS max_value FROM u GROUP BY 1, 2""")
def gold_vector_hourly(spark, sf_dir):
    rows = serving.newest(vector(spark, sf_dir), ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])
    rows = rows.select(F.col("l_shipdate").cast("date").alias("day"), *(F.col(c).cast("double").alias(c) for c in VECTOR))
    return layers.unpivoted(rows, ["day"], VECTOR).groupBy("day", "metric").agg(F.count("*").alias("event_count"), F.round(F.avg("value"), 8).alias("avg_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))


@plan(" UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS metric, CAST({c} AS DOUBLE) AS value FROM lineitem WHERE {c} IS NOT NULL" for c in VECTOR))
def unpivot_readings(spark, sf_dir):
    rows = vector(spark, sf_dir).select("l_orderkey", "l_linenumber", *(F.col(c).cast("double").alias(c) for c in VECTOR))
    return layers.unpivoted(rows, ["l_orderkey", "l_linenumber"], VECTOR)


@plan("""SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
ORDER BY l_shipdate DESC NULLS LAST, l_partkey DESC NULLS LAST, l_suppkey DESC NULLS LAST) AS rn FROM lineitem) WHERE rn = 1""")
def dedup_latest(spark, sf_dir):
    rows = vector(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey")
    return serving.newest(rows, ["l_orderkey", "l_linenumber"], ["l_shipdate", "l_partkey", "l_suppkey"])


@plan("""SELECT user_id, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC NULLS LAST) AS rn FROM events WHERE value IS NOT NULL) WHERE rn = 1""")
def latest_per_sensor(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("value is not null").select("user_id", "ts", "event_id", "value")
    return serving.newest(e, "user_id", ["ts", "event_id"])


@plan("""SELECT l_orderkey, l_partkey, l_suppkey, n - 1 AS duplicates FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber NULLS LAST, l_shipdate NULLS LAST, l_partkey NULLS LAST, l_suppkey NULLS LAST) AS rn,
count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) WHERE rn = 1""")
def first_occurrence_counts(spark, sf_dir):
    rows = vector(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_shipdate", "l_partkey", "l_suppkey", F.lit(0).cast("bigint").alias("duplicates"))
    return serving.upsert_ledger(rows.limit(0), rows, "l_orderkey", ("l_linenumber", "l_shipdate", "l_partkey", "l_suppkey"), "duplicates").select("l_orderkey", "l_partkey", "l_suppkey", "duplicates")


def _batches(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("sensor_id"), F.col("ts").alias("event_time"), F.col("ts").alias("received_at"), "event_id", "value")
    return e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")


@plan("""SELECT user_id AS sensor_id, ts AS event_time, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE value IS NOT NULL) WHERE rn = 1""")
def upsert_latest_two_batches(spark, sf_dir):
    a, b = _batches(spark, sf_dir)
    state = serving.upsert_latest(a.limit(0), a, metrics=["value"])
    return serving.upsert_latest(state, b, metrics=["value"]).select("sensor_id", "event_time", "event_id", "value")


def _alerts(rows):
    return serving.alerts(rows, RULES, ("l_orderkey", "l_linenumber", "l_shipdate")).select("l_orderkey", "rule_id", "l_linenumber", "threshold", "direction", F.col("value").cast("double").alias("value"))


ALERT_SQL = " UNION ALL ".join(f"SELECT l_orderkey, '{m.name}' AS rule_id, l_linenumber, CAST({m.threshold} AS DOUBLE) AS threshold, '{m.direction}' AS direction, CAST({m.name} AS DOUBLE) AS value FROM lineitem WHERE CAST({m.name} AS DOUBLE) {'>' if m.direction == 'high' else '<'} {m.threshold}" for m in RULES)


@plan(ALERT_SQL)
def alerts_by_rule(spark, sf_dir):
    return _alerts(vector(spark, sf_dir).withColumns({m.name: F.col(m.name).cast("double") for m in RULES}))


@plan(f"SELECT DISTINCT l_orderkey, l_linenumber, rule_id FROM ({ALERT_SQL})")
def alerts_insert_twice(spark, sf_dir):
    rows = _alerts(vector(spark, sf_dir).withColumns({m.name: F.col(m.name).cast("double") for m in RULES})).select("l_orderkey", "l_linenumber", "rule_id")
    keys = ("l_orderkey", "l_linenumber", "rule_id")
    once = serving.insert_alerts(rows.limit(0), rows, keys)
    return serving.insert_alerts(once, rows, keys)


@plan("""WITH a AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey % 2 = 0 GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_partkey % 2 = 1 GROUP BY 1)
SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, coalesce(a.n, 0) + coalesce(b.n, 0) - 1 AS duplicate_count FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey""")
def ledger_two_batches(spark, sf_dir):
    rows = vector(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.lit(0).cast("bigint").alias("duplicate_count"))
    order = ("l_linenumber", "l_partkey")
    state = serving.upsert_ledger(rows.limit(0), rows.where("l_partkey % 2 = 0"), "l_orderkey", order)
    return serving.upsert_ledger(state, rows.where("l_partkey % 2 = 1"), "l_orderkey", order).select("l_orderkey", "duplicate_count")


@plan("""WITH f AS (SELECT l_orderkey, min_by(l_discount, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS d, min_by(l_tax, (l_linenumber, l_partkey, l_suppkey, l_shipdate)) AS t FROM lineitem GROUP BY 1)
SELECT count(*) AS conflicts FROM lineitem l JOIN f ON l.l_orderkey = f.l_orderkey WHERE l.l_discount IS DISTINCT FROM f.d OR l.l_tax IS DISTINCT FROM f.t""")
def payload_conflicts(spark, sf_dir):
    rows = vector(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_discount", "l_tax")
    state = serving.upsert_ledger(rows.withColumn("duplicate_count", F.lit(0).cast("bigint")).limit(0), rows, "l_orderkey", ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))
    return serving.payload_conflicts(state, rows, "l_orderkey", ["l_discount", "l_tax"]).agg(F.count("*").alias("conflicts"))


@plan(f"""WITH old AS ({HOURS_SQL.format("")}), new AS ({HOURS_SQL.format("WHERE value > 150")})
SELECT coalesce(n.sensor_id, o.sensor_id) AS sensor_id, coalesce(n.hour_start, o.hour_start) AS hour_start, coalesce(n.metric, o.metric) AS metric, coalesce(n.event_count, o.event_count) AS event_count, coalesce(n.avg_value, o.avg_value) AS avg_value,
coalesce(n.min_value, o.min_value) AS min_value, coalesce(n.max_value, o.max_value) AS max_value FROM new n FULL JOIN old o ON n.sensor_id = o.sensor_id AND n.hour_start = o.hour_start AND n.metric = o.metric""")
def gold_upsert_replace(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return serving.replace_keys(_hours(e), _hours(e.where("value > 150")), ["sensor_id", "hour_start", "metric"])


@plan(f"WITH {P_SQL} SELECT coalesce(reason, 'valid') AS class, count(*) AS n FROM p GROUP BY 1")
def classify_identity(spark, sf_dir):
    return validated(payloads(spark, sf_dir)).groupBy(F.coalesce("error_reason", F.lit("valid")).alias("class")).agg(F.count("*").alias("n"))


@plan(f"WITH {P_SQL} SELECT n AS kafka_offset, temperature_c, humidity_pct, issues AS metric_issues FROM p WHERE reason IS NULL")
def quality_issues(spark, sf_dir):
    return layers.silver(payloads(spark, sf_dir)).select("kafka_offset", "temperature_c", "humidity_pct", "metric_issues")


@plan(f"WITH {P_SQL} SELECT n AS kafka_offset, late AS is_late, t AS event_time FROM p WHERE reason IS NULL")
def late_flag(spark, sf_dir):
    return layers.silver(payloads(spark, sf_dir)).select("kafka_offset", "is_late", F.col("event_time_utc").cast("timestamp_ntz").alias("event_time"))


@plan(f"""WITH {P_SQL} SELECT n AS kafka_offset, reason AS error_reason, CASE WHEN b = 1 THEN ' ' WHEN b = 9 THEN 'sensor_raw-' || (n % 3) || '-' || n ELSE 'zoneA-' || lpad(CAST(n AS VARCHAR), 6, '0') END AS record_key FROM p WHERE reason IS NOT NULL""")
def quarantine(spark, sf_dir):
    return layers.quarantine(payloads(spark, sf_dir)).select("kafka_offset", "error_reason", "record_key")


@plan(f"WITH {P_SQL} SELECT count(*) AS bronze, count(*) FILTER (WHERE reason IS NULL) AS silver, count(*) FILTER (WHERE reason IS NOT NULL) AS quarantine, count(*) = count(*) FILTER (WHERE reason IS NULL) + count(reason) AS accounted FROM p")
def layer_accounting(spark, sf_dir):
    rows = validated(payloads(spark, sf_dir))
    return rows.agg(F.count("*").alias("bronze"), F.count_if("is_valid").alias("silver"), F.count_if(~F.col("is_valid")).alias("quarantine")).withColumn("accounted", F.col("bronze") == F.col("silver") + F.col("quarantine"))


@plan(f"""WITH {P_SQL} SELECT 'zoneA_MULTI_' || (user_id % 10) AS sensor_id, date_trunc('hour', t) AS hour_start, m.metric, count(*) AS event_count, round(avg(m.value), 6) AS avg_value
FROM (SELECT user_id, t, 'temperature_c' AS metric, temperature_c AS value FROM p WHERE reason IS NULL UNION ALL SELECT user_id, t, 'humidity_pct', humidity_pct FROM p WHERE reason IS NULL) m WHERE m.value IS NOT NULL GROUP BY 1, 2, 3""")
def payload_to_gold(spark, sf_dir):
    out = gold.hourly(layers.silver(payloads(spark, sf_dir, whole_ids=True)))
    return out.select("sensor_id", F.col("hour_start").cast("timestamp_ntz").alias("hour_start"), "metric", "event_count", F.round("avg_value", 6).alias("avg_value"))


@plan("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@plan(f"""WITH {P_SQL} SELECT round(avg(CAST(late AS INT)) FILTER (WHERE reason IS NULL), 6) AS late_ratio, round(1.0 - count(*) FILTER (WHERE reason IS NULL) / count(*)::DOUBLE, 6) AS invalid_ratio,
round(count(*) FILTER (WHERE reason IS NULL AND contains(issues, 'temperature_c')) / (count(*) FILTER (WHERE reason IS NULL))::DOUBLE, 6) AS masked_temperature_ratio, round(1.0 - count(DISTINCT CASE WHEN reason IS NULL THEN 'zoneA-' || lpad(CAST(n AS VARCHAR), 6, '0') END) / (count(*) FILTER (WHERE reason IS NULL))::DOUBLE, 6) AS duplicate_ratio FROM p""")
def dq_ratios(spark, sf_dir):
    rows = validated(payloads(spark, sf_dir))
    ok = F.col("is_valid")
    n = F.count_if(ok)
    return rows.agg(
        F.round(F.count_if(ok & F.col("is_late")) / n, 6).alias("late_ratio"), F.round(F.count_if(~ok) / F.count("*"), 6).alias("invalid_ratio"),
        F.round(F.count_if(ok & F.contains("metric_issues", F.lit("temperature_c"))) / n, 6).alias("masked_temperature_ratio"), F.round((n - F.count_distinct(F.when(ok, F.col("p.event_id")))) / n, 6).alias("duplicate_ratio"),
    )


@plan("""WITH l AS (SELECT l_orderkey AS event_id, count(*) AS n FROM lineitem GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE c > 1) AS repeated_keys FROM (SELECT event_id, count(*) AS c FROM l GROUP BY 1)""")
def ledger_unique(spark, sf_dir):
    """One ledger row for each event after a batch and a replay of it."""
    rows = vector(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", F.lit(0).cast("bigint").alias("duplicate_count"))
    order = ("l_linenumber", "l_partkey")
    state = serving.upsert_ledger(serving.upsert_ledger(rows.limit(0), rows, "l_orderkey", order), rows, "l_orderkey", order)
    return reconcile.uniqueness(state, ["l_orderkey"])


@plan(f"""WITH g AS ({HOURS_SQL.format("")}) SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_keys, count(*) FILTER (WHERE c > 1) AS repeated_keys FROM (SELECT sensor_id, hour_start, metric, count(*) AS c FROM g GROUP BY 1, 2, 3)""")
def gold_unique(spark, sf_dir):
    """One Gold row for each sensor, hour and metric after a rerun that makes only some of them: the others stay."""
    e = table(spark, sf_dir, "events")
    keys = ["sensor_id", "hour_start", "metric"]
    return reconcile.uniqueness(serving.replace_keys(_hours(e), _hours(e.where("value > 150")), keys), keys)
