"""Text, log, mining and table-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellon.operators import logs, mining, tablelog
from tessellon.plans.common import collector, table, vector

QUERIES, ORACLES, plan = collector()
WORDS_SQL = r"SELECT unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda w: w <> '')) AS word FROM documents"


def _words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"\s+")).alias("word")).where("word <> ''")


@plan(f"SELECT word, count(*) AS n FROM ({WORDS_SQL}) GROUP BY 1")
def word_count(spark, sf_dir):
    return _words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n"))


@plan(f"SELECT word, count(*) AS n FROM ({WORDS_SQL}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_words(spark, sf_dir):
    return logs.top_by_count(_words(spark, sf_dir), "word", 5)


@plan(f"SELECT count(*) AS tokens, count(DISTINCT word) AS distinct_words FROM ({WORDS_SQL})")
def token_stats(spark, sf_dir):
    return _words(spark, sf_dir).groupBy("word").agg(F.count("*").alias("n")).agg(F.sum("n").alias("tokens"), F.count("*").alias("distinct_words"))


@plan("SELECT round(avg(m), 6) AS mean_of_means FROM (SELECT user_id, avg(value) AS m FROM events GROUP BY 1)")
def mean_of_means(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.avg("value").alias("m")).agg(F.round(F.avg("m"), 6).alias("mean_of_means"))


@plan("SELECT round(sum(value) / count(value), 6) AS global_mean FROM events")
def global_mean(spark, sf_dir):
    return table(spark, sf_dir, "events").agg(F.round(F.sum("value") / F.count("value"), 6).alias("global_mean"))


@plan("(SELECT user_id, count(*) AS n, 'top' AS side FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) UNION ALL (SELECT user_id, count(*) AS n, 'bottom' AS side FROM events GROUP BY 1 ORDER BY 2, 1 LIMIT 3)")
def extreme_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return logs.top_by_count(e, "user_id", 3).withColumn("side", F.lit("top")).unionByName(logs.top_by_count(e, "user_id", 3, False).withColumn("side", F.lit("bottom")))


@plan("SELECT event_type, count(*) AS n, round(100.0 * count(*)::DOUBLE / sum(count(*)) OVER ()::DOUBLE, 4) AS share_pct FROM events GROUP BY 1")
def freq_share(spark, sf_dir):
    return logs.with_share(table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n")))


@plan("SELECT event_type, min(value) AS lo, max(value) AS hi, round(avg(value), 2) AS mean FROM events GROUP BY 1")
def minmax_by_key(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.round(F.avg("value"), 2).alias("mean"))


@plan("SELECT user_id, count(*) AS errors, round(avg(value), 4) AS mean_value FROM events WHERE event_type = 'error' GROUP BY 1")
def error_mean_by_key(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors"), F.round(F.avg("value"), 4).alias("mean_value"))


@plan("SELECT count(*) AS n FROM (SELECT DISTINCT event_type, user_id FROM events WHERE event_type = 'error')")
def distinct_pairs(spark, sf_dir):
    return table(spark, sf_dir, "events").where("event_type = 'error'").select("event_type", "user_id").distinct().agg(F.count("*").alias("n"))


@plan("SELECT event_type, round(sum(value), 4) AS total FROM events GROUP BY 1")
def sum_by_key(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.round(F.sum("value"), 4).alias("total"))


@plan("SELECT split_part(o_clerk, '#', 1) AS domain, count(*) AS n FROM (SELECT o_orderpriority AS o_clerk FROM orders) GROUP BY 1")
def count_by_value(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.split_part("o_orderpriority", F.lit("#"), F.lit(1)).alias("domain")).agg(F.count("*").alias("n"))


@plan("SELECT event_id, substr(sha256('10.0.' || (user_id % 16) || '.' || (user_id % 256)), 1, 16) AS masked FROM events WHERE event_id % 9 <> 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 9 = 0")
def anonymise(spark, sf_dir):
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % 16).cast("string"), F.lit("."), (F.col("user_id") % 256).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", logs.anonymised(F.when(F.col("event_id") % 9 == 0, "10.0.x").otherwise(ip)).alias("masked"))


def _lines(spark, sf_dir):
    u, v = F.col("user_id"), F.col("value")
    return table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), F.concat(F.lit("10.0.0."), (u % 256).cast("string")), F.lit("GET"), F.concat(F.lit("/api/"), "event_type"), F.when(v > 400, "500").otherwise("200"), F.concat(F.floor(v).cast("string"), F.lit("ms"))).alias("value"))


@plan("SELECT '/api/' || event_type AS endpoint, CASE WHEN value > 400 THEN 500 ELSE 200 END AS status, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS latency FROM events WHERE floor(value) > 100 GROUP BY 1, 2")
def log_parse(spark, sf_dir):
    return logs.parsed(_lines(spark, sf_dir)).where("latency_ms > 100").groupBy("endpoint", "status").agg(F.count("*").alias("n"), F.sum("latency_ms").alias("latency"))


@plan("SELECT count(*) AS n FROM events WHERE event_type = 'error' AND value > 400")
def filter_chain(spark, sf_dir):
    lines = _lines(spark, sf_dir).where(F.col("value").startswith("ERROR") & F.contains("value", F.lit(" GET ")))
    return logs.parsed(lines).where("status >= 500").agg(F.count("*").alias("n"))


@plan("SELECT k % 7 AS k7, count(*) AS n, CAST(sum((user_id % 256 + 37 * k) % 256) AS BIGINT) AS octets, CAST(sum(greatest(1, CAST(floor(value) AS BIGINT) + (13 * k) % 41 - 20)) AS BIGINT) AS latency FROM events, generate_series(0, 19) t(k) GROUP BY 1")
def row_multiplier(spark, sf_dir):
    rows = logs.multiplied(logs.parsed(_lines(spark, sf_dir)), 20)
    return rows.groupBy((F.col("k") % 7).cast("bigint").alias("k7")).agg(F.count("*").alias("n"), F.sum(F.substring_index("ip", ".", -1).cast("bigint")).alias("octets"), F.sum("latency_ms").alias("latency"))


@plan(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '([\p{L}\p{N}_]{2,})', 1)) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
w AS (SELECT tf.doc_id, tf.term, tf * (ln((1.0 + (SELECT count(*) FROM documents)::DOUBLE) / (1.0 + df::DOUBLE)) + 1.0) AS w FROM tf JOIN df ON tf.term = df.term), n AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM w GROUP BY 1)
SELECT w.doc_id AS doc, w.term, round(w / norm, 5) AS weight FROM w JOIN n ON w.doc_id = n.doc_id""")
def tfidf(spark, sf_dir):
    return mining.tfidf(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 5))


PAIRS_SQL = "SELECT a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT a.l_orderkey) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2 HAVING count(DISTINCT a.l_orderkey) >= 2"


@plan(PAIRS_SQL)
def copairs(spark, sf_dir):
    return mining.copairs(vector(spark, sf_dir), "l_partkey", ["l_orderkey"], "l_orderkey")


@plan(f"""WITH p AS ({PAIRS_SQL}), r AS (SELECT a, b, n FROM p UNION ALL SELECT b, a, n FROM p), s AS (SELECT l_partkey, count(DISTINCT l_orderkey) AS na FROM lineitem GROUP BY 1)
SELECT a, b, n, round(n::DOUBLE / (SELECT count(DISTINCT l_orderkey) FROM lineitem)::DOUBLE, 8) AS support, round(n::DOUBLE / na::DOUBLE, 8) AS confidence FROM r JOIN s ON s.l_partkey = r.a""")
def association(spark, sf_dir):
    return mining.pair_rules(vector(spark, sf_dir), "l_orderkey", "l_partkey").withColumns({c: F.round(c, 8) for c in ("support", "confidence")})


@plan("SELECT round(regr_intercept(l_extendedprice::DOUBLE, l_quantity::DOUBLE), 4) AS intercept, round(regr_slope(l_extendedprice::DOUBLE, l_quantity::DOUBLE), 4) AS slope FROM lineitem")
def regression(spark, sf_dir):
    rows = vector(spark, sf_dir).select(F.col("l_extendedprice").cast("double").alias("y"), F.col("l_quantity").cast("double").alias("x"))
    return mining.line_fit(rows, "y", "x").select(F.round("intercept", 4).alias("intercept"), F.round("slope", 4).alias("slope"))


def _features(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    names = [f"f{i}" for i in range(vectors.agg(F.max(F.size("embedding"))).first()[0] or 0)]
    return vectors.select("vec_id", *(F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(names))), names


@plan()
def kmeans(spark, sf_dir):
    return mining.kmeans(*_features(spark, sf_dir), 3).groupBy("cluster").agg(F.count("*").alias("n"))


@plan()
def kmeans_raw(spark, sf_dir):
    return mining.kmeans(*_features(spark, sf_dir), 3, scaled=False).groupBy("cluster").agg(F.count("*").alias("n"))


@plan()
def decision_tree(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    words = F.size(F.split("text", r"\s+"))
    rows = d.select("doc_id", F.col("quality").cast("double").alias("quality"), words.cast("double").alias("words"), (F.col("n_chars") / words).alias("mean_word"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("double").alias("symbols"))
    return mining.decision_tree(rows, ["words", "mean_word", "symbols"], "quality", "doc_id").groupBy("quality", "predicted").agg(F.count("*").alias("n"))


@plan("SELECT terabytes, copies, (terabytes * copies)::DOUBLE AS replicated_tb, round(0.2 * terabytes * copies + 0.8 * terabytes * 1.5, 6)::DOUBLE AS hybrid_tb, round(100.0 * (terabytes * copies - (0.2 * terabytes * copies + 0.8 * terabytes * 1.5)) / (terabytes * copies), 4)::DOUBLE AS saving_pct FROM (SELECT DISTINCT p_size * 100 AS terabytes, p_size % 3 + 2 AS copies FROM part)")
def storage_cost(spark, sf_dir):
    return tablelog.storage_cost(table(spark, sf_dir, "part").select((F.col("p_size") * 100).alias("terabytes"), (F.col("p_size") % 3 + 2).alias("copies")).distinct())


def _log(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 5).alias("version"), F.col("event_id").alias("pos"), F.when(F.col("event_type") == "error", "remove").otherwise("add").alias("action"), F.concat(F.lit("f"), (F.col("user_id") % 40).cast("string")).alias("path"), F.lit("WRITE").alias("operation"))


REPLAY_SQL = "SELECT path FROM (SELECT 'f' || (user_id % 40) AS path, event_type, row_number() OVER (PARTITION BY user_id % 40 ORDER BY event_id % 5 DESC, event_id DESC) AS rn FROM events WHERE event_id % 5 <= {}) WHERE rn = 1 AND event_type <> 'error'"


@plan(REPLAY_SQL.format(4))
def log_replay(spark, sf_dir):
    return tablelog.live_files(_log(spark, sf_dir))


@plan(REPLAY_SQL.format(1))
def log_replay_v1(spark, sf_dir):
    return tablelog.live_files(_log(spark, sf_dir), 1)


@plan("SELECT event_id % 5 AS version, 'WRITE' AS operation, count(*) FILTER (WHERE event_type <> 'error') AS adds, count(*) FILTER (WHERE event_type = 'error') AS removes FROM events GROUP BY 1")
def commit_summary(spark, sf_dir):
    return tablelog.commit_summary(_log(spark, sf_dir))


@plan("""WITH r AS (SELECT l_orderkey AS block, l_linenumber AS replica, l_suppkey % 3 AS rack, l_suppkey % 8 AS node FROM lineitem),
k AS (SELECT block, rack, count(*) AS n, count(DISTINCT node) AS d FROM r GROUP BY 1, 2), s AS (SELECT block, max(n) AS most, sum(n) = sum(d) AS apart FROM k GROUP BY 1),
o AS (SELECT block, max(rack) FILTER (WHERE replica = 1) AS r1, max(rack) FILTER (WHERE replica = 2) AS r2, max(rack) FILTER (WHERE replica = 3) AS r3 FROM r GROUP BY 1)
SELECT s.block, most <= 2 AND apart AND (r2 IS NULL OR coalesce(r1 <> r2, false)) AND (r3 IS NULL OR coalesce(r2 = r3, false)) AS valid FROM s JOIN o ON o.block = s.block""")
def placement_valid(spark, sf_dir):
    rows = vector(spark, sf_dir).select(F.col("l_orderkey").alias("block"), F.col("l_linenumber").alias("replica"), (F.col("l_suppkey") % 3).alias("rack"), (F.col("l_suppkey") % 8).alias("node"))
    return tablelog.placement_valid(rows)
