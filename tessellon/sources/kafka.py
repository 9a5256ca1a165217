"""Kafka source and sink; they need Spark's Kafka connector on the class path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source_options(servers: str, topic: str, offsets_per_trigger: int = 20_000) -> dict[str, str]:
    """One topic from its beginning, headers too, at most so many offsets a batch; a gap in the log ends nothing."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "includeHeaders": "true", "maxOffsetsPerTrigger": str(offsets_per_trigger), "failOnDataLoss": "false"}


def sink_options(servers: str, topic: str) -> dict[str, str]:
    """Every replica acknowledges, a repeated send counts once, records are compressed and wait 20 ms for others."""
    return {"kafka.bootstrap.servers": servers, "topic": topic, "includeHeaders": "true", "kafka.acks": "all", "kafka.enable.idempotence": "true", "kafka.compression.type": "lz4", "kafka.linger.ms": "20"}


def source(spark: SparkSession, servers: str, topic: str, offsets_per_trigger: int = 20_000) -> DataFrame:
    return spark.readStream.format("kafka").options(**source_options(servers, topic, offsets_per_trigger)).load()


def record_key(payload, mqtt_topic):
    """The payload's sensor_id, else the topic's last part."""
    return F.coalesce(F.get_json_object(payload, "$.sensor_id"), F.substring_index(mqtt_topic, "/", -1))


def records(rows: DataFrame) -> DataFrame:
    """Rows (payload, mqtt_topic) as Kafka records with key, value and the topic header."""
    header = F.array(F.struct(F.lit("mqtt_topic").alias("key"), F.encode("mqtt_topic", "UTF-8").alias("value")))
    return rows.select(record_key(F.col("payload"), F.col("mqtt_topic")).alias("key"), F.col("payload").alias("value"), header.alias("headers"))


def sink(rows: DataFrame, servers: str, topic: str) -> None:
    records(rows).write.format("kafka").options(**sink_options(servers, topic)).save()
