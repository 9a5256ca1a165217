"""Joins, audits, reads and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellon.functions.quality import any_present
from tessellon.operators import logs, ranges, reads, reconcile, serving
from tessellon.plans.common import P_SQL, VECTOR, collector, payloads, table, vector
from tessellon.plans.serving_plans import HOURS_SQL, _hours

QUERIES, ORACLES, plan = collector()
URGENT = "o_orderpriority = '1-URGENT' AND o_orderdate >= '1998-01-01'"


@plan(f"SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE {URGENT})")
def left_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey").join(table(spark, sf_dir, "orders").where(URGENT).select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@plan(f"SELECT c_custkey FROM customer LEFT JOIN (SELECT DISTINCT o_custkey FROM orders WHERE {URGENT}) ON c_custkey = o_custkey WHERE o_custkey IS NULL")
def left_null(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where(URGENT).select(F.col("o_custkey").alias("o_custkey_dh"))
    c = table(spark, sf_dir, "customer")
    return c.join(o, c.c_custkey == o.o_custkey_dh, "left").where("o_custkey_dh is null").select("c_custkey")


@plan(f"""WITH a AS ({HOURS_SQL.format("")}), b AS ({HOURS_SQL.format("WHERE event_id % 7 <> 0")})
SELECT count(*) AS groups, count(*) FILTER (WHERE a.event_count IS NULL) AS only_right, count(*) FILTER (WHERE b.event_count IS NULL) AS only_left,
count(*) FILTER (WHERE a.event_count <> b.event_count OR abs(a.avg_value - b.avg_value) > 0.000001) AS mismatched, round(max(abs(a.avg_value - b.avg_value)), 4) AS max_mean_diff
FROM a FULL JOIN b ON a.sensor_id = b.sensor_id AND a.hour_start = b.hour_start AND a.metric = b.metric""")
def full_outer_reconcile(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return reconcile.reconciled(_hours(e), _hours(e.where("event_id % 7 <> 0")), ["sensor_id", "hour_start", "metric"], "event_count", "avg_value").withColumn("max_mean_diff", F.round("max_mean_diff", 4))


@plan("SELECT s_suppkey, coalesce(n_name, 'unknown') AS zone FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON s_nationkey = n_nationkey")
def lookup_default(spark, sf_dir):
    zones = table(spark, sf_dir, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return table(spark, sf_dir, "supplier").join(zones, "s_nationkey", "left").select("s_suppkey", F.coalesce("n_name", F.lit("unknown")).alias("zone"))


@plan("SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM orders) AS orders, (SELECT count(*) FROM lineitem) AS lineitem, (SELECT count(*) FROM customer) AS customer")
def pipeline_summary(spark, sf_dir):
    return reads.table_counts({n: table(spark, sf_dir, n) for n in ("events", "orders", "lineitem", "customer")})


@plan("SELECT count(*) AS n, CAST(coalesce(sum(octet_length(encode(text))), 0) AS BIGINT) AS bytes, round(avg(octet_length(encode(text))), 6) AS avg_bytes, count(DISTINCT (doc_id, lang, source)) AS distinct_keys FROM documents WHERE source LIKE 'src1%'")
def bronze_summary(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.col("source").startswith("src1"))
    size = F.octet_length("text")
    return d.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.round(F.avg(size), 6).alias("avg_bytes"), F.count_distinct("doc_id", "lang", "source").alias("distinct_keys"))


@plan("SELECT count(DISTINCT (o_custkey, o_orderpriority)) AS pairs, count(DISTINCT o_custkey) AS customers FROM orders")
def multi_distinct(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.count_distinct("o_custkey", "o_orderpriority").alias("pairs"), F.count_distinct("o_custkey").alias("customers"))


LEDGER_SQL = "SELECT user_id AS event_id, count(*) - 1 AS duplicate_count, min(ts) AS first_processed_at, CASE WHEN count(*) > 1 THEN max(ts) END AS last_duplicate_at FROM events GROUP BY 1"


def _ledger(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("event_id"))
    return e.agg((F.count("*") - 1).alias("duplicate_count"), F.min("ts").alias("first_processed_at"), F.when(F.count("*") > 1, F.max("ts")).alias("last_duplicate_at"))


@plan(f"WITH l AS ({LEDGER_SQL}) SELECT count(*) AS events, count(*) FILTER (WHERE duplicate_count > 0) AS duplicated_events, CAST(coalesce(sum(duplicate_count), 0) AS BIGINT) AS duplicate_occurrences, max(duplicate_count) AS most_duplicates, max(first_processed_at) AS last_processed_at FROM l")
def ledger_stats(spark, sf_dir):
    return reads.serving_summary(_ledger(spark, sf_dir))


@plan(f"WITH l AS ({LEDGER_SQL}) SELECT count(*) AS events, count(*) FILTER (WHERE duplicate_count > 0) AS duplicates, max(first_processed_at) AS last_processed_at, (SELECT count(DISTINCT user_id) FROM events) AS sensors, (SELECT count(*) FROM events WHERE value > 300) AS alerts, (SELECT count(*) FROM ({HOURS_SQL.format('')})) AS sensor_hour_rows FROM l")
def progress_counters(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return reads.progress(_ledger(spark, sf_dir), {"sensors": e.select("user_id").distinct(), "alerts": e.where("value > 300"), "sensor_hour_rows": _hours(e)})


@plan(f"WITH l AS ({LEDGER_SQL}) SELECT event_id, duplicate_count, first_processed_at, last_duplicate_at FROM l WHERE duplicate_count > 0 ORDER BY last_duplicate_at DESC, event_id LIMIT 50")
def latest_duplicates(spark, sf_dir):
    return reads.latest_duplicates(_ledger(spark, sf_dir))


@plan(f"WITH g AS ({HOURS_SQL.format('')}) SELECT count(*) AS gold_rows, CAST(sum(event_count) AS BIGINT) AS gold_readings, count(DISTINCT sensor_id) AS gold_sensors, count(DISTINCT metric) AS gold_metrics, count(DISTINCT hour_start) AS gold_hours, min(hour_start) AS gold_start, max(hour_start) AS gold_last_hour, max(hour_start) + INTERVAL 1 HOUR AS gold_end, max(hour_start) + INTERVAL 2 HOUR AS gold_computed_at FROM g")
def gold_summary(spark, sf_dir):
    return reads.gold_summary(_hours(table(spark, sf_dir, "events")).withColumn("computed_at", F.col("hour_start") + F.expr("interval 2 hours")))


@plan(f"WITH g AS ({HOURS_SQL.format('')}) SELECT * FROM g ORDER BY hour_start, sensor_id, metric LIMIT 150")
def gold_first_rows(spark, sf_dir):
    return reads.stats(_hours(table(spark, sf_dir, "events"))).limit(150)


@plan("SELECT o_orderstatus, count(*) AS n, min(o_orderkey) AS lo, max(o_orderkey) AS hi, count(DISTINCT o_orderkey) AS distinct_offsets, max(o_orderkey) - min(o_orderkey) + 1 = count(*) AND count(*) = count(DISTINCT o_orderkey) AS contiguous FROM orders GROUP BY 1")
def offset_audit(spark, sf_dir):
    return reconcile.offset_audit(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_orderkey")


@plan("SELECT l_returnflag, count(*) AS n, count(DISTINCT l_suppkey) AS sensors, count(nullif(l_discount, 0)) AS with_discount, count(nullif(l_tax, 0)) AS with_tax FROM lineitem GROUP BY 1")
def presence_audit(spark, sf_dir):
    return vector(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("sensors"), F.count(F.nullif("l_discount", F.lit(0))).alias("with_discount"), F.count(F.nullif("l_tax", F.lit(0))).alias("with_tax"))


@plan(" UNION ALL ".join(f"SELECT '{c}' AS metric, count({c}) AS n, round(avg(CAST({c} AS DOUBLE)), 6) AS mean, min(CAST({c} AS DOUBLE)) AS lo, max(CAST({c} AS DOUBLE)) AS hi FROM lineitem" for c in VECTOR))
def reading_stats(spark, sf_dir):
    v = [F.col(c).cast("double").alias(c) for c in VECTOR]
    return vector(spark, sf_dir).select(*v).unpivot([], list(VECTOR), "metric", "value").where("value is not null").groupBy("metric").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@plan("SELECT count(*) AS keys, count(*) FILTER (WHERE b.k IS NULL) AS only_left, count(*) FILTER (WHERE a.k IS NULL) AS only_right FROM (SELECT DISTINCT o_orderkey AS k FROM orders) a FULL JOIN (SELECT DISTINCT l_orderkey AS k FROM lineitem) b ON a.k = b.k")
def set_equality(spark, sf_dir):
    o, l = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")), vector(spark, sf_dir).select(F.col("l_orderkey").alias("k"))
    return reconcile.key_difference(o, l, ["k"])


@plan(f"WITH {P_SQL} SELECT (SELECT count(*) FROM p WHERE reason IS NULL) AS silver_keys, (SELECT count(*) FROM p WHERE reason IS NOT NULL) AS quarantine_keys, (SELECT count(*) FROM (SELECT n FROM p WHERE reason IS NULL INTERSECT SELECT n FROM p WHERE reason IS NOT NULL)) AS in_both, (SELECT count(*) FROM (SELECT n FROM p EXCEPT (SELECT n FROM p WHERE reason IS NULL UNION SELECT n FROM p WHERE reason IS NOT NULL))) AS in_neither")
def layer_keys(spark, sf_dir):
    from tessellon.operators import layers

    b = payloads(spark, sf_dir)
    place = ["kafka_topic", "kafka_partition", "kafka_offset"]
    return reconcile.layer_keys(b, layers.silver(b), layers.quarantine(b), place)


@plan("SELECT CAST(r.k AS INTEGER) AS partition, count(c_custkey) AS n FROM range(7) r(k) LEFT JOIN customer ON c_custkey % 5 = r.k GROUP BY 1")
def key_partition_sizes(spark, sf_dir):
    return reconcile.partition_sizes(table(spark, sf_dir, "customer").select("c_custkey"), 7, (F.col("c_custkey") % 5).cast("int"))


@plan("SELECT user_id, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 ORDER BY user_id LIMIT 20 OFFSET 10")
def paged_latest(spark, sf_dir):
    rows = serving.newest(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"])
    return reads.page(rows, ["user_id"], 20, 10)


@plan("SELECT event_id, event_type AS rule_id, value, ts AS created_at FROM events WHERE value > 300 ORDER BY ts DESC, event_id, event_type LIMIT 25 OFFSET 5")
def paged_alerts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("value > 300").select("event_id", F.col("event_type").alias("rule_id"), "value", F.col("ts").alias("created_at"))
    return reads.alerts(rows, 25, 5)


@plan("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY 1")
def percentile_interp(spark, sf_dir):
    q = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    return ranges.quantiles(table(spark, sf_dir, "events"), ["event_type"], "value", q).withColumns({n: F.round(n, 6) for n in q})


@plan(f"WITH {P_SQL}, l AS (SELECT CASE b WHEN 10 THEN 120.0 WHEN 11 THEN 61.0 WHEN 12 THEN 60.0 ELSE 1.0 END AS s FROM p WHERE reason IS NULL) SELECT min(s)::DOUBLE AS lo, max(s)::DOUBLE AS hi, quantile_cont(s::DOUBLE, 0.5) AS p50, quantile_cont(s::DOUBLE, 0.99) AS p99 FROM l")
def dq_lateness(spark, sf_dir):
    from tessellon.operators import layers

    s = reconcile.lateness(None, "received_at_utc", "event_time_utc")
    rows = layers.silver(payloads(spark, sf_dir)).select(s.alias("s"))
    return ranges.joined(rows.agg(F.min("s").alias("lo"), F.max("s").alias("hi")), ranges.quantiles(rows, [], "s", {"p50": 0.5, "p99": 0.99}), [])


@plan("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE o) AS out_of_order FROM (SELECT event_type, coalesce(max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > value, false) AS o FROM events) GROUP BY 1")
def out_of_order(spark, sf_dir):
    return reconcile.out_of_order(table(spark, sf_dir, "events"), "user_id", "value", "ts", "event_id").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if("out_of_order").alias("out_of_order"))


@plan("SELECT count(*) AS records, count(*) FILTER (WHERE event_type <> 'error') AS published, CAST(coalesce(sum(octet_length(encode(props))), 0) AS BIGINT) AS payload_bytes, count(DISTINCT 'r-' || user_id) AS distinct_ids, min(CAST(ts AS VARCHAR)) AS first_ts, max(CAST(ts AS VARCHAR)) AS last_ts, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS records_per_second, round(count(*) FILTER (WHERE event_type <> 'error') / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS published_per_second, round(coalesce(sum(octet_length(encode(props))), 0)::DOUBLE / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS bytes_per_second FROM events WHERE user_id % 2 = 0")
def run_source_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.when(F.col("user_id") % 2 == 0, "r-").otherwise("x-"), F.col("user_id").cast("string")).alias("event_id"), (F.col("event_type") != "error").alias("published"), F.octet_length("props").alias("payload_bytes"), F.col("ts").cast("string").alias("ts"))
    return logs.source_rollup(e, "r-")


@plan("SELECT event_type AS query, count(*) AS batches, CAST(sum(user_id) AS BIGINT) AS num_input_rows, max(event_id) AS last_batch_id, round(quantile_cont(CASE WHEN value >= 100 THEN value - 100 END, 0.5), 6) AS p50_ms, round(quantile_cont(CASE WHEN value >= 100 THEN value - 100 END, 0.95), 6) AS p95_ms FROM events WHERE event_id % 11 = 0 OR (ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20') GROUP BY 1")
def run_progress_rollup(spark, sf_dir):
    when = F.when(F.col("event_id") % 11 == 0, "not a time").otherwise(F.col("ts").cast("string"))
    e = table(spark, sf_dir, "events").select(when.alias("ts"), F.col("event_type").alias("query"), F.col("event_id").alias("batch_id"), F.col("user_id").alias("num_input_rows"), (F.col("value") - 100).alias("duration_ms"))
    return logs.progress_rollup(e, start="2024-01-10", end="2024-01-20").withColumns({c: F.round(c, 6) for c in ("p50_ms", "p95_ms")})


@plan("SELECT event_type AS fault, count(*) AS n FROM events GROUP BY 1")
def run_fault_histogram(spark, sf_dir):
    return logs.fault_histogram(table(spark, sf_dir, "events").select(F.concat(F.lit("r-"), "event_id").alias("event_id"), F.col("event_type").alias("fault")), "r-")


@plan("SELECT event_type AS name, min_by(value, event_id) AS first_mem, max_by(value, event_id) AS last_mem, max(value) AS peak_mem, round(quantile_cont(value, 0.95), 6) AS p95_mem, max(CAST(user_id % 100 AS DOUBLE)) AS peak_cpu FROM events GROUP BY 1")
def resource_stats(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    line = F.concat_ws("\t", "event_type", F.lit("1MiB / 2GiB"), F.concat(F.col("value").cast("string"), F.lit("%")), F.concat((F.col("user_id") % 100).cast("string"), F.lit("%")))
    return logs.resource_stats(logs.container_stats(e.select("event_id", line.alias("value")), keep=["event_id"]), "event_id")


@plan("SELECT event_type, count(*) FILTER (WHERE value > 200) AS alerts, count(value) AS present, round(100.0 * count(*) FILTER (WHERE value > 200) / count(value)::DOUBLE, 6) AS per_100 FROM events GROUP BY 1")
def alert_rate_metric(spark, sf_dir):
    """Alerts for each hundred present readings of a metric."""
    fired = F.count_if(F.col("value") > 200)
    return table(spark, sf_dir, "events").groupBy("event_type").agg(fired.alias("alerts"), F.count("value").alias("present"), F.round(F.lit(100.0) * fired / F.count("value"), 6).alias("per_100"))


@plan(f"WITH {P_SQL}, l AS (SELECT epoch_us(date_trunc('second', e.ts)) / 1e6 + CASE b WHEN 10 THEN 120 WHEN 11 THEN 61 WHEN 12 THEN 60 ELSE 1 END - epoch_us(e.ts) / 1e6 AS s FROM p JOIN events e ON e.event_id = p.n) SELECT round(min(s), 3) AS lo, round(max(s), 3) AS hi, round(quantile_cont(s, 0.5), 4) AS p50, round(quantile_cont(s, 0.95), 4) AS p95, round(quantile_cont(s, 0.99), 4) AS p99 FROM l")
def receive_lag(spark, sf_dir):
    return reconcile.lag_quantiles(payloads(spark, sf_dir), "received_at_utc", "kafka_timestamp").withColumns({c: F.round(c, 3) for c in ("lo", "hi")})


@plan("SELECT count(*) AS delivered, CAST(coalesce(sum(octet_length(encode(props))), 0) AS BIGINT) AS bytes, count(DISTINCT user_id) AS distinct_ids, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 6) AS per_second FROM events WHERE user_id % 2 = 0")
def run_bridge_rollup(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.when(F.col("user_id") % 2 == 0, "r-").otherwise("x-"), F.col("user_id").cast("string")).alias("event_id"), F.octet_length("props").alias("payload_bytes"), F.col("ts").cast("string").alias("ts"))
    return logs.bridge_rollup(e, "r-")


@plan("SELECT max(n) AS most, min(n) AS least, round(max(n) / min(n)::DOUBLE, 4) AS ratio FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)")
def freq_spread(spark, sf_dir):
    return logs.spread(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")))


@plan("SELECT user_id, round(list_reduce(list(value ORDER BY event_id), lambda x, y: (x + y) / 2), 6) AS folded FROM events WHERE value IS NOT NULL GROUP BY 1")
def ordered_fold(spark, sf_dir):
    return logs.ordered_fold(table(spark, sf_dir, "events"), "user_id", "event_id", "value").withColumn("folded", F.round("folded", 6))


@plan("SELECT date_trunc('hour', ts) AS hour_start, count(*) AS n, round(100.0 * count(*) FILTER (WHERE value > 200) / count(*)::DOUBLE, 6) AS alerts_per_100 FROM events GROUP BY 1")
def alert_rate_hourly(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour_start")).agg(F.count("*").alias("n"), F.round(F.lit(100.0) * F.count_if(F.col("value") > 200) / F.count("*"), 6).alias("alerts_per_100"))


@plan("WITH l AS (SELECT max_by(event_id, ts) AS e FROM (SELECT event_id, (ts, event_id) AS ts FROM events)) SELECT e + 2 * e AS processed FROM l")
def drain_offsets(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    offset = F.to_json(F.create_map(F.lit("sensor_raw"), F.create_map(F.lit("0"), F.col("event_id"), F.lit("1"), 2 * F.col("event_id"))))
    return logs.drained(e.select(F.lit("q1").alias("query"), F.struct("ts", "event_id").alias("batch_id"), offset.alias("end_offset")))


@plan("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount IS NOT NULL OR l_tax IS NOT NULL GROUP BY 1")
def any_metric_present(spark, sf_dir):
    return vector(spark, sf_dir).where(any_present(["l_discount", "l_tax"])).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@plan(f"WITH {P_SQL}, l AS (SELECT date_trunc('hour', t) AS hour_start, CASE b WHEN 10 THEN 120.0 WHEN 11 THEN 61.0 WHEN 12 THEN 60.0 ELSE 1.0 END AS s FROM p WHERE reason IS NULL) SELECT hour_start, count(*) AS n, round(quantile_cont(s::DOUBLE, 0.95), 6) AS p95 FROM l GROUP BY 1")
def dq_lateness_hourly(spark, sf_dir):
    from tessellon.operators import layers

    s = reconcile.lateness(None, "received_at_utc", "event_time_utc")
    hour = F.date_trunc("hour", "event_time_utc").cast("timestamp_ntz").alias("hour_start")
    rows = layers.silver(payloads(spark, sf_dir)).select(hour, s.alias("s"))
    told = ranges.joined(rows.groupBy("hour_start").agg(F.count("*").alias("n")), ranges.quantiles(rows, ["hour_start"], "s", {"p95": 0.95}), ["hour_start"])
    return told.withColumn("p95", F.round("p95", 6))


@plan("SELECT event_type, count(*) AS n, sum(CASE WHEN dup > 1 THEN 1 ELSE 0 END)::BIGINT AS repeated FROM (SELECT event_type, count(*) OVER (PARTITION BY event_type, user_id) AS dup FROM events) GROUP BY 1")
def repeated_keys(spark, sf_dir):
    per = table(spark, sf_dir, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return per.groupBy("event_type").agg(F.sum("n").alias("total"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated")).select("event_type", F.col("total").alias("n"), "repeated")
