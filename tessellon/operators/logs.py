"""Access-log parsing, masking and roll-ups of evidence logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.operators import ranges


def parsed(lines: DataFrame, line: str = "value") -> DataFrame:
    """level, ip, method, endpoint, status, latency_ms of lines such as ``ERROR 10.0.0.1 GET /api 500 123ms``."""
    part = F.split(F.trim(F.col(line)), r"\s+")
    return lines.select(*(F.get(part, i).alias(n) for i, n in enumerate(("level", "ip", "method", "endpoint"))), F.get(part, 4).try_cast("int").alias("status"), F.regexp_replace(F.get(part, 5), "ms$", "").try_cast("int").alias("latency_ms"))


def valid_ip(ip: Column) -> Column:
    return ip.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")


def anonymised(ip: Column) -> Column:
    """First 16 hexadecimal digits of the SHA-256 of a well-formed address, else null."""
    return F.when(valid_ip(ip), F.substring(F.sha2(ip, 256), 1, 16))


def multiplied(lines: DataFrame, times: int) -> DataFrame:
    """Each parsed row in so many variants: last octet (d + 37k) mod 256, latency at least 1 and moved by (13k) mod 41 - 20."""
    k = F.col("k")
    last = (F.substring_index("ip", ".", -1).try_cast("int") + 37 * k) % 256
    return lines.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(times - 1)))).withColumns({"ip": F.concat_ws(".", F.substring_index("ip", ".", 3), last.cast("string")), "latency_ms": F.greatest(F.lit(1), F.col("latency_ms") + (13 * k) % 41 - 20)})


def top_by_count(rows: DataFrame, key: str, n: int, descending: bool = True) -> DataFrame:
    counted = rows.groupBy(key).agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n") if descending else F.asc("n"), key).limit(n)


def with_share(counts: DataFrame, n: str = "n") -> DataFrame:
    """Each count's percentage of the whole; the total comes from one small aggregate, not from a window over all rows."""
    total = counts.agg(F.sum(n).alias("_total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share_pct", F.round(F.lit(100.0) * F.col(n) / F.col("_total"), 4)).drop("_total")


def spread(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row: the largest and the least count and how many times the one is the other."""
    return counts.agg(F.max(n).alias("most"), F.min(n).alias("least"), F.round(F.max(n) / F.min(n), 4).alias("ratio"))


def ordered_fold(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Per key the left fold (x + y) / 2 over its values in order: what a reduce gives that isn't associative, whatever the partitions. The i-th of n values counts 2 ** -(n - i + 1), the first as much as the second."""
    placed = ranges.places(rows.where(F.col(value).isNotNull()).select(key, order, value), [key], [order])
    weight = F.pow(F.lit(2.0), F.greatest(F.col("_place"), F.lit(2)) - F.col("_of") - 1)
    return placed.groupBy(key).agg(F.sum(F.col(value) * F.when(F.col("_of") == 1, 1.0).otherwise(weight)).alias("folded"))


def bridge_rollup(deliveries: DataFrame, prefix: str) -> DataFrame:
    """One row for a run's delivered records: counts, bytes, distinct ids and records a second."""
    at = F.col("ts").try_cast("timestamp")
    seconds = (F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))) / 1e6
    return deliveries.where(F.col("event_id").startswith(prefix)).agg(F.count("*").alias("delivered"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("bytes"), F.count_distinct("event_id").alias("distinct_ids"), F.round(F.count("*") / F.nullif(seconds, F.lit(0.0)), 6).alias("per_second"))


def resource_stats(stats: DataFrame, order: str) -> DataFrame:
    """Per container first, last, peak and 95th percentile of memory and peak CPU; stats: name, mem_pct, cpu_pct and an order column."""
    told = stats.groupBy("name").agg(F.min_by("mem_pct", order).alias("first_mem"), F.max_by("mem_pct", order).alias("last_mem"), F.max("mem_pct").alias("peak_mem"), F.max("cpu_pct").alias("peak_cpu"))
    return ranges.joined(told, ranges.quantiles(stats, ["name"], "mem_pct", {"p95_mem": 0.95}), ["name"]).withColumn("p95_mem", F.round("p95_mem", 6))


def source_rollup(manifest: DataFrame, prefix: str) -> DataFrame:
    """One row for a run's source records: counts, bytes, distinct ids, first and last time, and records, published records and bytes a second between these (null where they are one instant)."""
    own = manifest.where(F.col("event_id").startswith(prefix))
    told = own.agg(F.count("*").alias("records"), F.count_if("published").alias("published"), F.coalesce(F.sum("payload_bytes"), F.lit(0)).alias("payload_bytes"), F.count_distinct("event_id").alias("distinct_ids"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    seconds = F.nullif((F.unix_micros(F.col("last_ts").try_cast("timestamp")) - F.unix_micros(F.col("first_ts").try_cast("timestamp"))) / 1e6, F.lit(0.0))
    rates = {"records_per_second": "records", "published_per_second": "published", "bytes_per_second": "payload_bytes"}
    return told.withColumns({name: F.round(F.col(c) / seconds, 6) for name, c in rates.items()})


def fault_histogram(manifest: DataFrame, prefix: str) -> DataFrame:
    return manifest.where(F.col("event_id").startswith(prefix)).groupBy(F.coalesce("fault", F.lit("none")).alias("fault")).agg(F.count("*").alias("n"))


def progress_rollup(progress: DataFrame, start=None, end=None) -> DataFrame:
    """Per query: batches, rows, last batch, median and 95th percentile of durations; negative durations don't count, rows without a readable time stay."""
    at = F.col("ts").try_cast("timestamp")
    own = progress
    if start is not None:
        own = own.where(at.isNull() | (at >= F.lit(start)))
    if end is not None:
        own = own.where(at.isNull() | (at <= F.lit(end)))
    d = F.when(F.col("duration_ms") >= 0, F.col("duration_ms"))
    told = own.groupBy("query").agg(F.count("*").alias("batches"), F.sum("num_input_rows").alias("num_input_rows"), F.max("batch_id").alias("last_batch_id"))
    return ranges.joined(told, ranges.quantiles(own, ["query"], d, {"p50_ms": 0.5, "p95_ms": 0.95}), ["query"])


def container_stats(lines: DataFrame, line: str = "value", keep=()) -> DataFrame:
    """The kept columns, name, mem_usage, mem_pct, cpu_pct of tab-separated container statistics; short and empty lines are left out."""
    part = F.split(F.regexp_replace(F.col(line), r"\t+$", ""), "\t")
    pct = lambda i: F.regexp_replace(F.trim(F.get(part, i)), "%$", "").try_cast("double")
    return lines.where(F.size(part) >= 4).select(*keep, F.trim(F.get(part, 0)).alias("name"), F.trim(F.get(part, 1)).alias("mem_usage"), pct(2).alias("mem_pct"), pct(3).alias("cpu_pct")).where("name <> ''")


def drained(progress: DataFrame, query: str = "q1") -> DataFrame:
    """Sum of the end offsets in the query's last progress record (offsets are JSON: topic, partition, offset)."""
    last = progress.where(F.col("query") == query).agg(F.max_by("end_offset", "batch_id").alias("o"))
    offsets = F.flatten(F.transform(F.map_values(F.from_json("o", "map<string,map<string,bigint>>")), lambda m: F.map_values(m)))
    return last.select(F.aggregate(offsets, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("processed"))


def partition_lag(latest: DataFrame, progress: DataFrame, query: str = "q1") -> DataFrame:
    """Per topic and partition: the source's next offset, what the query's last progress record has committed (0 if it never named the partition), and the records between."""
    last = progress.where(F.col("query") == query).groupBy("query").agg(F.max_by("end_offset", "batch_id").alias("o"))
    topics = last.select(F.explode(F.from_json("o", "map<string,map<string,bigint>>")).alias("topic", "parts")).select("topic", F.explode("parts").alias("partition", "committed"))
    both = latest.select("topic", F.col("partition").cast("string").alias("partition"), "latest").join(topics, ["topic", "partition"], "left")
    done = F.coalesce("committed", F.lit(0))
    return both.select("topic", "partition", "latest", done.alias("committed"), F.greatest(F.lit(0), F.col("latest") - done).alias("behind"))
