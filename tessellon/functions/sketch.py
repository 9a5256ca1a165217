"""Mergeable quantile sketches with a bounded relative error, as counts of logarithmic buckets.

A value x above LEAST falls in bucket ceil(log_g x) with g = (1 + e) / (1 - e); every value of a bucket is within a relative
error e of 2 g^b / (g + 1). Counts of buckets add up, so a sketch is a small table (key, bucket, n), merging is a sum,
and sketches of many short spans make those of any longer span. A bucket number depends on the value alone, so results are
the same for any partitioning. A span has at most a few thousand buckets however many rows it has.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error, and the value up to which (and below which) everything counts as 0.
ERROR, LEAST = 0.01, 1e-9
#: The bucket of 0.
ZERO = -(1 << 31)


def base(error: float = ERROR) -> float:
    return (1 + error) / (1 - error)


def bucket(x: Column, error: float = ERROR) -> Column:
    return F.when(x > LEAST, F.ceil(F.log(x) / math.log(base(error)))).when(x.isNotNull(), ZERO).cast("int")


def value_of(b: Column, error: float = ERROR) -> Column:
    g = base(error)
    return F.when(b == ZERO, 0.0).otherwise(F.lit(2.0 / (g + 1)) * F.pow(F.lit(g), b))


def sketched(rows: DataFrame, by: list[str], x: Column, error: float = ERROR) -> DataFrame:
    """by, bucket, n of the values that aren't null or below 0."""
    return rows.where(x >= 0).groupBy(*by, bucket(x, error).alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def rolling(sketches: DataFrame, pane: str, panes: int, width: str, by=()) -> DataFrame:
    """Sketches of spans of ``panes`` panes: window_end is the end of each pane, and a span ends with every pane that it has a pane to end with.

    pane is a timestamp column, width the pane's length as an interval. A pane's few buckets are sent to the spans they
    count in, so the rows grow by at most ``panes`` and no span is gathered from raw rows.
    """
    step = F.expr(f"interval {width}")
    ends = F.transform(F.sequence(F.lit(1), F.lit(panes)), lambda i: F.col(pane) + step * i)
    spread = sketches.withColumn("window_end", F.explode(ends))
    last = sketches.select(*by, (F.col(pane) + step).alias("window_end")).distinct()
    return merged(spread.join(last, [*by, "window_end"], "left_semi"), [*by, "window_end"])


def located(sketches: DataFrame, by: list[str], q: float) -> DataFrame:
    """by, n, and of the ranks on either side of position (n - 1) q the bucket (_lo, _hi) and the place in it from 0 (_lo_at, _hi_at); _share is how far the position is between them."""
    w = Window.partitionBy(*by).orderBy("bucket")
    own = sketches.select(*by, "bucket", "n", F.sum("n").over(w).alias("_upto"), F.sum("n").over(Window.partitionBy(*by)).alias("_n"))
    at = (F.col("_n") - 1) * F.lit(q)
    first = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("bucket")))
    place = lambda rank: F.max(rank) - F.coalesce(F.max(F.when(F.col("_upto") <= rank, F.col("_upto"))), F.lit(0))
    ranks = {"_lo": F.floor(at), "_hi": F.ceil(at)}
    return own.groupBy(*by).agg(F.max("_n").alias("n"), *(first(r).alias(c) for c, r in ranks.items()), *(place(r).alias(f"{c}_at") for c, r in ranks.items()), F.max(at - F.floor(at)).alias("_share"))


def between(error: float = ERROR) -> Column:
    """The quantile that located() found, within the sketch's relative error."""
    lo, hi = value_of(F.col("_lo"), error), value_of(F.col("_hi"), error)
    return lo + (hi - lo) * F.col("_share")


def quantile(sketches: DataFrame, by: list[str], q: float, name: str, error: float = ERROR) -> DataFrame:
    """by, n and the quantile (position (n - 1) q, linear between neighbours) within the sketch's relative error."""
    return located(sketches, by, q).select(*by, "n", between(error).alias(name))


def exact_rolling(found: DataFrame, counted: DataFrame, pane: str, value: str, panes: int, width: str, name: str) -> DataFrame:
    """found (window_end and what located() gives) with the exact quantile: of a span only the values of the buckets that hold its two ranks are read.

    counted has pane, bucket, value and n. The spread side is ``panes`` times what Spark takes it for, so neither side may be broadcast.
    """
    step = F.expr(f"interval {width}")
    wanted = found.withColumn("bucket", F.explode(F.array_distinct(F.array("_lo", "_hi"))))
    spread = wanted.withColumn(pane, F.explode(F.transform(F.sequence(F.lit(1), F.lit(panes)), lambda i: F.col("window_end") - step * i)))
    held = spread.hint("merge").join(counted.select(pane, "bucket", F.col(value).alias("_v"), F.col("n").alias("_c")), [pane, "bucket"])
    held = held.groupBy(*found.columns, "bucket", "_v").agg(F.sum("_c").alias("_c"))
    upto = F.sum("_c").over(Window.partitionBy("window_end", "bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    held = held.withColumn("_upto", upto)
    side = lambda c: F.max(F.when((F.col("bucket") == F.col(c)) & (F.col(f"{c}_at") < F.col("_upto")) & (F.col(f"{c}_at") >= F.col("_upto") - F.col("_c")), F.col("_v")))
    told = held.groupBy(*found.columns).agg(side("_lo").alias("_a"), side("_hi").alias("_b"))
    return told.select(*found.columns, (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")).alias(name))
