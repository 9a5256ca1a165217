"""Order within keys of any size: a key's rows are cut into ranges, and what a row needs of the ranges before it is carried over.

A key whose rows all need one order (a running value, an exact rank) would else be one sorted task. Bounds are values of the key
itself, chosen by a hash of them, SPLITS for each key; so a range has about 1/SPLITS of a key, and which
rows it has depends on their values alone, not on partitions or on what a lost executor computes again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bounds that cut a key into ranges.
SPLITS = 64


def _key(by: list[str]) -> Column:
    """One column for all keys, in which nulls equal each other."""
    return F.struct(*(F.col(c).alias(f"k{i}") for i, c in enumerate(by))) if by else F.struct(F.lit(0).alias("k0"))


def ranged(rows: DataFrame, by: list[str], order: Column, splits: int = SPLITS) -> DataFrame:
    """rows with _key, and _range: a number that grows with the order column within a key; equal values share a range. Nulls come first.

    A key's bounds are its SPLITS values of least hash; each task hands on no more than so many a key.
    """
    own = rows.withColumns({"_key": _key(by), "_order": order})
    least = Window.partitionBy("_key").orderBy(F.xxhash64("_order"))
    some = own.select("_key", "_order").where(F.col("_order").isNotNull()).withColumn("_i", F.row_number().over(least)).where(F.col("_i") <= splits)
    bounds = some.groupBy("_key").agg(F.array_sort(F.collect_set("_order")).alias("_bounds"))
    own = own.join(bounds, "_key", "left")
    below = F.size(F.filter("_bounds", lambda b: b <= F.col("_order")))
    return own.withColumn("_range", F.when(F.col("_order").isNull(), -1).when(F.col("_bounds").isNull(), 0).otherwise(below)).drop("_bounds")


def running_max_before(rows: DataFrame, by: list[str], order: list[str], value: str, name: str, splits: int = SPLITS) -> DataFrame:
    """rows with the largest value of the rows before each in its key, null for the first: within the row's range, and of the ranges before."""
    own = ranged(rows, by, F.struct(*order), splits)
    parts = own.groupBy("_key", "_range").agg(F.max(value).alias("_most"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("_carried", F.max("_most").over(before)).drop("_most")
    inside = Window.partitionBy("_key", "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    both = own.join(carried, ["_key", "_range"]).withColumn(name, F.greatest(F.max(value).over(inside), F.col("_carried")))
    return both.select(*rows.columns, name)


def places(rows: DataFrame, by: list[str], order: list[str], splits: int = SPLITS) -> DataFrame:
    """rows with _place (from 1, in order) and _of (rows of the key)."""
    own = ranged(rows, by, F.struct(*order), splits)
    parts = own.groupBy("_key", "_range").agg(F.count("*").alias("_m"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.select("_key", "_range", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy("_key")).alias("_of"))
    inside = Window.partitionBy("_key", "_range").orderBy(*order)
    return own.join(carried, ["_key", "_range"]).withColumn("_place", F.col("_before") + F.row_number().over(inside)).select(*rows.columns, "_place", "_of")


def quantiles(rows: DataFrame, by: list[str], value: Column | str, qs: dict[str, float], splits: int = SPLITS) -> DataFrame:
    """by and, for each name in qs, the interpolated quantile of the values that aren't null: position (n - 1) q, linear between neighbours.

    Equal values are counted first. The ranks asked for are looked up among a key's counted ranges, and only the ranges that hold
    one are ordered; no task or buffer ever holds a key's distinct values. Keys without any value are left out.
    """
    v = F.col(value) if isinstance(value, str) else value
    counted = rows.select(*by, v.cast("double").alias("_v")).where("_v is not null").groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    own = ranged(counted, by, F.col("_v"), splits).select("_key", "_range", "_v", "_c")
    parts = own.groupBy("_key", "_range").agg(F.sum("_c").alias("_m"))
    before = Window.partitionBy("_key").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_key", "_range", "_m", F.coalesce(F.sum("_m").over(before), F.lit(0)).alias("_before"), F.sum("_m").over(Window.partitionBy("_key")).alias("_n"))
    at = {name: (F.col("_n") - 1) * F.lit(float(q)) for name, q in qs.items()}
    ranks = F.array(*(F.struct(F.lit(name).alias("q"), F.lit(up).alias("up"), (F.ceil(p) if up else F.floor(p)).alias("rank"), (p - F.floor(p)).alias("share")) for name, p in at.items() for up in (False, True)))
    held = parts.withColumn("_wanted", F.filter(ranks, lambda r: (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_m")))).where(F.size("_wanted") > 0)
    inside = own.join(held.select("_key", "_range", "_before", "_wanted"), ["_key", "_range"])
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy("_key", "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    found = inside.withColumn("_upto", upto).withColumn("_x", F.explode(F.filter("_wanted", lambda r: (r["rank"] < F.col("_upto")) & (r["rank"] >= F.col("_upto") - F.col("_c")))))
    side = lambda name, up: F.max(F.when((F.col("_x.q") == name) & (F.col("_x.up") == F.lit(up)), F.col("_v")))
    share = lambda name: F.max(F.when(F.col("_x.q") == name, F.col("_x.share")))
    between = lambda name: side(name, False) + (side(name, True) - side(name, False)) * share(name)
    told = found.groupBy("_key").agg(*(between(name).alias(name) for name in qs))
    return told.select(*(F.col(f"_key.k{i}").alias(c) for i, c in enumerate(by)), *qs)


def joined(summary: DataFrame, more: DataFrame, by: list[str]) -> DataFrame:
    """summary with more's other columns by key, nulls equal each other; keys that more lacks keep nulls."""
    other = more.select(_key(by).alias("_key"), *(c for c in more.columns if c not in by))
    return summary.withColumn("_key", _key(by)).join(other, "_key", "left").drop("_key")
