"""Transaction-log replay and storage arithmetic."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_files(actions: DataFrame, version: int | None = None) -> DataFrame:
    """Paths in force after a version: those whose last action (by version, then position) is an add."""
    own = actions if version is None else actions.where(F.col("version") <= version)
    return own.where("action in ('add', 'remove')").groupBy("path").agg(F.max_by("action", F.struct("version", "pos")).alias("last")).where("last = 'add'").select("path")


def commit_summary(actions: DataFrame) -> DataFrame:
    return actions.groupBy("version").agg(F.max("operation").alias("operation"), F.count_if(F.col("action") == "add").alias("adds"), F.count_if(F.col("action") == "remove").alias("removes"))


def read_log(spark, path: str) -> DataFrame:
    """version, pos, action, path, operation from a directory of JSON commits named by version; malformed lines are left out.

    pos orders the lines of a commit, also of one that is read in several splits: where the split begins in its file, then the line in it.
    """
    pos = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.regexp_extract("_metadata.file_name", r"(\d+)\.json$", 1).cast("bigint").alias("version"), pos.alias("pos"), "value")
    rows = lines.withColumn("j", F.from_json("value", "add struct<path:string>, remove struct<path:string>, commitInfo struct<operation:string>"))
    action = F.when(F.col("j.add").isNotNull(), "add").when(F.col("j.remove").isNotNull(), "remove").when(F.col("j.commitInfo").isNotNull(), "info")
    return rows.select("version", "pos", action.alias("action"), F.coalesce("j.add.path", "j.remove.path").alias("path"), "j.commitInfo.operation").where("action is not null")


def storage_cost(plans: DataFrame, hot: float = 0.2, parity: float = 1.5) -> DataFrame:
    """plans: terabytes, copies. Replicated volume, hybrid volume (hot share replicated, the rest erasure-coded) and the saving."""
    whole = F.col("terabytes") * F.col("copies")
    hybrid = F.lit(hot) * F.col("terabytes") * F.col("copies") + F.lit(1 - hot) * F.col("terabytes") * F.lit(parity)
    return plans.select("terabytes", "copies", whole.cast("double").alias("replicated_tb"), F.round(hybrid, 6).alias("hybrid_tb"), F.round(100.0 * (whole - hybrid) / whole, 4).alias("saving_pct"))


def placement_valid(replicas: DataFrame, most_per_rack: int = 2) -> DataFrame:
    """Per block (block, replica from 1, node, rack): whether replicas are on distinct nodes, at most so many in a rack, the second in another rack than the first, and the third in the second's rack."""
    of = lambda i, c: F.max(F.when(F.col("replica") == i, F.col(c)))
    per = replicas.groupBy("block", "rack").agg(F.count("*").alias("n"), F.count_distinct("node").alias("nodes"), *(of(i, "rack").alias(f"r{i}") for i in (1, 2, 3)))
    one = per.groupBy("block").agg(F.max("n").alias("most"), (F.sum("n") == F.sum("nodes")).alias("distinct"), *(F.max(f"r{i}").alias(f"r{i}") for i in (1, 2, 3)))
    second = F.coalesce(F.col("r2") != F.col("r1"), F.col("r2").isNull())
    third = F.coalesce(F.col("r3") == F.col("r2"), F.col("r3").isNull())
    return one.select("block", ((F.col("most") <= most_per_rack) & F.col("distinct") & second & third).alias("valid"))


def racks(topology: DataFrame, least: int = 2) -> int:
    """How many racks a topology (node, rack) has; an error if they are too few to place replicas in."""
    n = topology.agg(F.count_distinct("rack").alias("n")).first()["n"]
    if n < least:
        raise ValueError(f"{n} rack(s): replicas need {least} at least")
    return n


def write_commit(spark, path: str, version: int, actions: list[dict]) -> None:
    """One commit of a table log: a file named by its version with a JSON object a line; a version that is there is never overwritten."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    to = jvm.org.apache.hadoop.fs.Path(f"{path}/{version:020d}.json")
    out = to.getFileSystem(conf).create(to, False)
    try:
        out.write("".join(json.dumps(a) + "\n" for a in actions).encode())
    finally:
        out.close()
