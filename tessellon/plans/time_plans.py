"""Queries over event time: windows, sessions, rolling lateness, the delay policy, the life of an aggregate, placement of keys."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tessellon.functions import placement, sketch
from tessellon.functions.quality import validated
from tessellon.operators import gold, logs, reconcile
from tessellon.plans.common import P_SQL, collector, payloads, table
from tessellon.registry import NAMES
from tessellon.streaming import lifecycle, policy, windows

QUERIES, ORACLES, plan = collector()


def _events(spark, sf_dir):
    """Events with their time as an instant (the table's is without a zone; sessions are in UTC)."""
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df, *names):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


@plan("SELECT s AS window_start, s + INTERVAL 2 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts) - k * INTERVAL 30 MINUTE for k in range(4)]) AS s FROM events) GROUP BY 1, 2, 3")
def sliding_windows(spark, sf_dir):
    got = windows.sliding(_events(spark, sf_dir), "ts", "2 hours", "30 minutes", "1 hour", ["event_type"], [F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")])
    return _plain(got, "window_start", "window_end")


@plan("""WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT min(ts) AS window_start, max(ts) + INTERVAL 6 HOUR AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def session_windows(spark, sf_dir):
    return _plain(windows.sessions(_events(spark, sf_dir), "ts", "6 hours", "1 hour", ["user_id"]), "window_start", "window_end")


#: The sketch of ROLLING_SQL: its base, and what a bucket stands for.
_G = sketch.base()
ROLLING_SQL = f"""
WITH e AS (SELECT date_trunc('minute', ts) AS m, value AS s FROM events WHERE value >= 0),
w AS (SELECT DISTINCT m + INTERVAL 1 MINUTE AS window_end FROM e),
x AS (SELECT window_end, s, CASE WHEN s > {sketch.LEAST!r} THEN 2.0::DOUBLE / ({_G!r}::DOUBLE + 1) * pow({_G!r}::DOUBLE, ceil(ln(s) / ln({_G!r}::DOUBLE))) ELSE 0 END AS v FROM w JOIN e ON m < window_end AND m >= window_end - INTERVAL 60 MINUTE),
q AS (SELECT window_end, count(*) AS n, quantile_cont(s, 0.95) AS exact, quantile_cont(v, 0.95) AS p95 FROM x GROUP BY 1)
SELECT window_end, n, round(p95, 6) AS p95, abs(p95 - exact) <= {sketch.ERROR} * exact + 1e-9 AS within_bound FROM q"""


@plan(ROLLING_SQL)
def dq_lateness_rolling(spark, sf_dir):
    """95th percentile of the last hour, each minute, from merged sketches of the minutes; within_bound compares it with the exact one."""
    e = _events(spark, sf_dir).select(F.date_trunc("minute", "ts").alias("pane"), F.col("value").alias("s")).where("s >= 0")
    # equal values of a minute are counted once, for the sketches and for the exact value, which reads the buckets that the sketches name
    counted = e.groupBy("pane", "s").agg(F.count("*").alias("n")).withColumn("bucket", sketch.bucket(F.col("s")))
    found = sketch.located(sketch.rolling(sketch.merged(counted, ["pane"]), "pane", 60, "1 minute"), ["window_end"], 0.95)
    both = sketch.exact_rolling(found, counted, "pane", "s", 60, "1 minute", "exact").withColumn("p95", sketch.between())
    return _plain(both.select("window_end", "n", F.round("p95", 6).alias("p95"), (F.abs(F.col("p95") - F.col("exact")) <= F.lit(sketch.ERROR) * F.col("exact") + 1e-9).alias("within_bound")), "window_end")


#: Thresholds of the policy query: a tenth of the hourly maximum of each kind of event stands for the normalised lateness.
_POLICY = policy.Policy(up=0.12, down=0.08, epochs=3)


@plan(f"""WITH h AS (SELECT event_type, date_trunc('hour', ts) AS epoch, round(avg(value) / max(value), 9) AS phi FROM events GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN count(phi) OVER w = 3 AND min(phi) OVER w >= {_POLICY.up} THEN 'CAUTIOUS' WHEN count(phi) OVER w = 3 AND max(phi) OVER w <= {_POLICY.down} THEN 'FAST' END AS signal FROM h WINDOW w AS (PARTITION BY event_type ORDER BY epoch ROWS 2 PRECEDING)),
t AS (SELECT event_type, epoch, phi, coalesce(last_value(signal IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY epoch ROWS UNBOUNDED PRECEDING), 'FAST') AS state FROM s)
SELECT event_type, epoch, phi, state, state <> lag(state, 1, 'FAST') OVER (PARTITION BY event_type ORDER BY epoch) AS switched FROM t""")
def policy_states(spark, sf_dir):
    """State after each hour, a kind of event a source."""
    epochs = _events(spark, sf_dir).groupBy("event_type", F.date_trunc("hour", "ts").alias("epoch")).agg(F.round(F.avg("value") / F.max("value"), 9).alias("phi"))
    return _plain(policy.states(epochs, "epoch", "phi", _POLICY, ["event_type"]), "epoch")


LIFE_UNTIL = datetime(2024, 1, 20)


@plan(f"""WITH {P_SQL}, r AS (SELECT * FROM p WHERE reason IS NULL),
g AS (SELECT 'zoneA_MULTI_' || (user_id % 10) AS sensor_id, date_trunc('hour', t) AS window_start, count(temperature_c) AS n, avg(temperature_c) AS mean, count(temperature_c) FILTER (WHERE n % 7 <> 0) AS n_first FROM r WHERE temperature_c IS NOT NULL GROUP BY 1, 2)
SELECT sensor_id, window_start, CASE WHEN n_first = 0 THEN 1 WHEN n_first <> n THEN 2 ELSE 1 END AS version, CASE WHEN n_first <> n THEN 'CORRECTED' ELSE 'FINAL' END AS status, n AS event_count, round(mean, 6) AS avg_value FROM g WHERE window_start + INTERVAL 1 HOUR <= TIMESTAMP '{LIFE_UNTIL}'""")
def lifecycle_corrections(spark, sf_dir):
    """What counts after a batch pass over published versions that had missed a seventh of the events."""
    from tessellon.operators import layers

    silver = layers.silver(payloads(spark, sf_dir, whole_ids=True))
    part = gold.hourly(silver.where("kafka_offset % 7 <> 0"), metrics=["temperature_c"])
    first = part.select("sensor_id", "metric", F.col("hour_start").alias("window_start"), (F.col("hour_start") + F.expr("interval 1 hour")).alias("window_end"), F.lit(1).alias("version"), F.lit(lifecycle.FINAL).alias("status"), "event_count", "avg_value", "min_value", "max_value", F.lit(None).cast("int").alias("previous_version"), F.lit(LIFE_UNTIL).cast("timestamp").alias("frontier"))
    published = first.where(F.col("window_end") <= F.lit(LIFE_UNTIL))
    more = lifecycle.corrections(published, gold.hourly(silver, metrics=["temperature_c"]), LIFE_UNTIL, timedelta(hours=1))
    now = lifecycle.current(lifecycle.merged(published, more))
    return _plain(now.select("sensor_id", "window_start", "version", "status", "event_count", F.round("avg_value", 6).alias("avg_value")), "window_start")


@plan("SELECT user_id % 3 AS partition, max(event_id) + 1 AS latest, max(event_id) FILTER (WHERE ts < TIMESTAMP '2024-01-15' AND user_id % 3 < 2) + 1 AS c, greatest(0, latest - coalesce(c, 0)) AS behind FROM events GROUP BY 1".replace("SELECT user_id % 3 AS partition", "SELECT 'sensor_raw' AS topic, CAST(partition AS VARCHAR) AS partition, latest, coalesce(c, 0) AS committed, behind FROM (SELECT user_id % 3 AS partition") + ")")
def drain_lag(spark, sf_dir):
    """How far a query that stopped half way is behind its source, by partition; of one partition it has never read."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 3).alias("partition"), (F.col("event_id") + 1).alias("next"), "ts")
    latest = e.groupBy("partition").agg(F.max("next").alias("latest")).withColumn("topic", F.lit("sensor_raw"))
    done = e.where("ts < timestamp'2024-01-15' and partition < 2").groupBy("partition").agg(F.max("next").alias("n"))
    offsets = done.agg(F.to_json(F.map_from_entries(F.array(F.struct(F.lit("sensor_raw"), F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col("partition").cast("string"), "n")))))))).alias("end_offset"))
    return logs.partition_lag(latest, offsets.select(F.lit("q1").alias("query"), F.lit(1).alias("batch_id"), "end_offset"))


# the hash over bytes, written out as list operations on unsigned numbers
_MUL = f"({{}} * {placement.TIMES}::BIGINT) & {placement.WORD}::BIGINT"
_WORD = "(('0x' || substr(h, 8 * i + 7, 2) || substr(h, 8 * i + 5, 2) || substr(h, 8 * i + 3, 2) || substr(h, 8 * i + 1, 2))::BIGINT)"
MURMUR_SQL = f"""
WITH k AS (SELECT c_name, hex(encode(c_name)) AS h, octet_length(encode(c_name)) AS n FROM customer),
w AS (SELECT c_name, h, n, [{_MUL.format(_WORD)} for i in range(n // 4)] AS ks FROM k),
m AS (SELECT c_name, h, n, list_reduce(list_prepend(xor({placement.SEED}::BIGINT, n::BIGINT), ks), lambda a, k: xor({_MUL.format('a')}, {_MUL.format('xor(k, k >> 24)')})) AS a, n % 4 AS r, n - n % 4 AS o FROM w),
t AS (SELECT c_name, CASE WHEN r = 0 THEN a ELSE {_MUL.format("xor(a, ('0x' || CASE WHEN r > 2 THEN substr(h, 2 * o + 5, 2) ELSE '' END || CASE WHEN r > 1 THEN substr(h, 2 * o + 3, 2) ELSE '' END || substr(h, 2 * o + 1, 2))::BIGINT)")} END AS a FROM m),
u AS (SELECT c_name, {_MUL.format('xor(a, a >> 13)')} AS a FROM t)
SELECT CAST((xor(a, a >> 15) & {placement.POSITIVE}) % 12 AS INTEGER) AS partition, count(*) AS keys FROM u GROUP BY 1"""


@plan(MURMUR_SQL)
def key_placement(spark, sf_dir):
    """Customers by the partition of 12 that the Java producer would put their names in."""
    return table(spark, sf_dir, "customer").groupBy(placement.murmur2_partition("c_name", 12).alias("partition")).agg(F.count("*").alias("keys"))


@plan(f"""WITH {P_SQL}, s AS (SELECT * FROM p WHERE reason IS NULL)
SELECT metric, masked, round(masked / total::DOUBLE, 6) AS masked_ratio FROM (SELECT unnest({list(NAMES)!r}) AS metric) m, LATERAL (SELECT count(*) FILTER (WHERE coalesce(list_contains(list_transform(string_split(issues, ';'), lambda x: string_split(x, ':')[2]), metric), false)) AS masked, count(*) AS total FROM s)""")
def dq_masked(spark, sf_dir):
    """For each of the six metrics, valid rows whose reading was masked, and their share."""
    return reconcile.masked_ratios(validated(payloads(spark, sf_dir)).where("is_valid"), NAMES)
