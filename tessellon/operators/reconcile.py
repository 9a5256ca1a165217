"""Audits between layers and data-quality measures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.operators import ranges


def reconciled(a: DataFrame, b: DataFrame, keys: list[str], count: str, mean: str, tolerance: float = 1e-6) -> DataFrame:
    """One row: groups on one side only, groups that differ, largest difference of means."""
    x = a.select(*keys, F.col(count).alias("_ca"), F.col(mean).alias("_ma"))
    y = b.select(*keys, F.col(count).alias("_cb"), F.col(mean).alias("_mb"))
    gap = F.abs(F.col("_ma") - F.col("_mb"))
    return x.join(y, keys, "full").agg(
        F.count("*").alias("groups"), F.count_if(F.col("_ca").isNull()).alias("only_right"), F.count_if(F.col("_cb").isNull()).alias("only_left"),
        F.count_if((F.col("_ca") != F.col("_cb")) | (gap > tolerance)).alias("mismatched"), F.max(gap).alias("max_mean_diff"),
    )


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: distinct keys missing on either side. One shuffle per side, no sort of whole rows."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    return x.join(y, keys, "full").agg(F.count("*").alias("keys"), F.count_if(F.col("_b").isNull()).alias("only_left"), F.count_if(F.col("_a").isNull()).alias("only_right"))


def layer_keys(bronze: DataFrame, silver: DataFrame, quarantine: DataFrame, place: list[str]) -> DataFrame:
    """One row: Bronze rows whose key is in Silver, in Quarantine, in both and in neither; a row for each Silver and Quarantine row of its key.

    Keys are counted by layer in mergeable sums, so no layer is sorted or joined.
    """
    of = lambda rows, n: rows.select(*place, *(F.lit(int(i == n)).alias(c) for i, c in enumerate("bsq")))
    rows = of(bronze, 0).unionByName(of(silver, 1)).unionByName(of(quarantine, 2))
    per = rows.groupBy(*place).agg(*(F.sum(c).alias(c) for c in "bsq"))
    # a null in a key equals nothing, so such a Bronze row is in neither
    whole = reduce(lambda x, y: x & y, (F.col(c).isNotNull() for c in place))
    s, q = (F.when(whole, F.col(c)).otherwise(0) for c in "sq")
    made = F.col("b") * F.greatest(s, F.lit(1)) * F.greatest(q, F.lit(1))
    told = lambda when, name: F.coalesce(F.sum(F.when(when, made)), F.lit(0)).alias(name)
    return per.agg(told(s > 0, "silver_keys"), told(q > 0, "quarantine_keys"), told((s > 0) & (q > 0), "in_both"), told((s == 0) & (q == 0), "in_neither"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def offset_audit(rows: DataFrame, keys: list[str], offset: str) -> DataFrame:
    """Per key: rows, first, last and distinct offsets; contiguous if they leave no gap and repeat none."""
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min(offset).alias("lo"), F.max(offset).alias("hi"), F.count_distinct(offset).alias("distinct_offsets"))
    return out.withColumn("contiguous", (F.col("hi") - F.col("lo") + 1 == F.col("n")) & (F.col("n") == F.col("distinct_offsets")))


def lateness(rows: DataFrame, received: str, event: str):
    """Seconds from event to receipt, 0 at least."""
    return F.greatest(F.lit(0.0), (F.unix_micros(F.col(received)) - F.unix_micros(F.col(event))) / 1e6)


def out_of_order(rows: DataFrame, key: str, event: str, received: str, tie: str) -> DataFrame:
    """Rows received after one of their key that happened later; a key's rows are scanned range by range, so one sensor can have them all."""
    seen = ranges.running_max_before(rows, [key], [received, tie], event, "_latest")
    return seen.withColumn("out_of_order", F.coalesce(F.col("_latest") > F.col(event), F.lit(False))).drop("_latest")


def partition_sizes(rows: DataFrame, n: int, placed) -> DataFrame:
    """Rows in each of n exact partitions of an integer expression, empty ones included."""
    counts = rows.repartitionById(n, placed).groupBy(F.spark_partition_id().alias("partition")).agg(F.count("*").alias("n"))
    return rows.sparkSession.range(n).select(F.col("id").cast("int").alias("partition")).join(F.broadcast(counts), "partition", "left").select("partition", F.coalesce("n", F.lit(0)).alias("n"))


def uniqueness(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, keys, and keys that have more than one row."""
    per = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    return per.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys"), F.count_if(F.col("_n") > 1).alias("repeated_keys"))


def lag_quantiles(rows: DataFrame, received: str, sent: str) -> DataFrame:
    """One row: least, largest and quantiles of the seconds from sent to received."""
    s = (F.unix_micros(F.col(received)) - F.unix_micros(F.col(sent))) / 1e6
    q = ranges.quantiles(rows, [], s, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return ranges.joined(rows.agg(F.min(s).alias("lo"), F.max(s).alias("hi")), q, []).withColumns({c: F.round(c, 4) for c in ("p50", "p95", "p99")})


def masked_ratios(rows: DataFrame, metrics, issues: str = "metric_issues") -> DataFrame:
    """metric, masked, masked_ratio: rows whose issues name the metric, one aggregate for all metrics."""
    named = F.transform(F.split(issues, ";"), lambda x: F.substring_index(x, ":", -1))
    told = rows.agg(F.count("*").alias("_n"), *(F.count_if(F.coalesce(F.array_contains(named, m), F.lit(False))).alias(m) for m in metrics))
    return told.unpivot(["_n"], list(metrics), "metric", "masked").select("metric", "masked", F.round(F.col("masked") / F.col("_n"), 6).alias("masked_ratio"))
