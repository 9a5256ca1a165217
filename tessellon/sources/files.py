"""File, text and JSON sources and sinks, batch and stream."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessellon.schemas import BRONZE, EVIDENCE, SILVER

CORRUPT = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the path holds any data file, asked of whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return False
    files = fs.listFiles(p, True)
    while files.hasNext():
        if not files.next().getPath().getName().startswith(("_", ".")):
            return True
    return False


def parquet_or_none(spark: SparkSession, path: str) -> DataFrame | None:
    """The table, or None for a missing or empty directory."""
    return spark.read.parquet(path) if exists(spark, path) else None


def parquet_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bronze_stream(spark: SparkSession, path: str, files_per_trigger: int = 1000) -> DataFrame:
    return parquet_stream(spark, path, BRONZE, files_per_trigger)


def silver_stream(spark: SparkSession, path: str, files_per_trigger: int = 500) -> DataFrame:
    return parquet_stream(spark, path, SILVER, files_per_trigger)


def csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header line; without a schema the types are inferred in a pass of its own."""
    reader = spark.read.option("header", True)
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a bad-line column; good() and bad_count() split them."""
    return spark.read.schema(f"{schema}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def good(rows: DataFrame) -> DataFrame:
    return rows.where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def bad_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col(CORRUPT).isNotNull()).alias("bad"), F.count("*").alias("lines"))


def evidence(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """An evidence log: malformed lines and non-objects are left out; a missing file is empty."""
    if not exists(spark, path):
        return spark.createDataFrame([], EVIDENCE[kind])
    text = spark.read.text(path)
    return text.select(F.from_json("value", EVIDENCE[kind]).alias("r"), "value").where(F.trim("value").startswith("{") & F.expr("try_parse_json(value) is not null")).select("r.*")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def write_text(rows: DataFrame, column: str, path: str) -> None:
    rows.select(F.col(column).cast("string")).write.mode("overwrite").text(path)


def write_json_result(row: dict, path: str, spark: SparkSession) -> None:
    """One small result as a JSON line."""
    spark.createDataFrame([row]).coalesce(1).write.mode("overwrite").json(path)


def told_result(name: str, row: dict, path: str | None, spark: SparkSession) -> str:
    """The result as a line ``NAME={...}``, which its caller prints; it is also written if there is a path, but a write that fails only warns: the measurement is made."""
    if path is not None:
        try:
            write_json_result(row, path, spark)
        except Exception as e:  # whatever the file system has against it
            warnings.warn(f"{name} was not written to {path}: {str(e)[:200]}", RuntimeWarning, stacklevel=2)
    return f"{name}={json.dumps(row, sort_keys=True, default=str)}"


def narrowed(rows: DataFrame, condition, tasks: int) -> DataFrame:
    """The few rows that meet a condition in no more than so many tasks: a scan of many files would else write as many nearly empty ones. No shuffle."""
    return rows.where(condition).coalesce(tasks)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_log(rows: DataFrame, path: str) -> None:
    """A delivery log or source manifest: a JSON object a row, appended."""
    rows.write.mode("append").json(path)


def results(spark: SparkSession, path: str) -> DataFrame:
    """All results below a folder as one table, a row each, with the experiment's name (its folder)."""
    return spark.read.option("recursiveFileLookup", True).json(path).withColumn("experiment", F.element_at(F.split(F.input_file_name(), "/"), -2))


def compared(found: DataFrame, variant: str, seconds: str) -> DataFrame:
    """A row for each experiment of results(): its variants, the slowest and the quickest by their least time, these times, and how many times quicker the one is."""
    best = found.groupBy("experiment", variant).agg(F.min(seconds).alias("_s")).where("_s is not null")
    told = best.groupBy("experiment").agg(
        F.count("*").alias("variants"), F.max_by(variant, F.struct("_s", variant)).alias("slowest"), F.min_by(variant, F.struct("_s", variant)).alias("quickest"),
        F.max("_s").alias("slowest_seconds"), F.min("_s").alias("quickest_seconds"),
    )
    return told.withColumn("times", F.round(F.col("slowest_seconds") / F.nullif("quickest_seconds", F.lit(0.0)), 2))


def jdbc_append(rows: DataFrame, url: str, table: str, **options) -> None:
    """Append by column name in batches of 1000 under read-committed isolation."""
    base = {"url": url, "dbtable": table, "batchsize": "1000", "isolationLevel": "READ_COMMITTED"}
    rows.write.format("jdbc").options(**(base | options)).mode("append").save()


def jdbc_table(spark: SparkSession, url: str, table: str, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**({"url": url, "dbtable": table} | options)).load()
