"""Schemas of the layers, the serving tables and the payload."""

from __future__ import annotations

from tessellon.registry import NAMES

# Names and types of the columns of every layer and table.
_metrics = ", ".join(f"{m} double" for m in NAMES)
_kafka = "kafka_topic string, kafka_partition int, kafka_offset bigint"

PAYLOAD = "event_id string, sensor_id string, event_time string, ingest_time string, sensor_type string, unit string, location string, sequence_no string, value string, " + ", ".join(f"{m} string" for m in NAMES)
KAFKA = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int, headers array<struct<key:string,value:binary>>"
BRONZE = f"raw_payload string, mqtt_topic string, {_kafka}, kafka_timestamp timestamp, received_at_utc timestamp"
SILVER = f"event_id string, sensor_id string, event_time_utc timestamp, event_time_src string, {_metrics}, metric_issues string, ingest_time_utc timestamp, ingest_time_src string, sensor_type string, unit string, location string, sequence_no string, {_kafka}, kafka_timestamp timestamp, received_at_utc timestamp, is_late boolean"
QUARANTINE = f"record_key string, error_reason string, raw_payload string, mqtt_topic string, {_kafka}, kafka_timestamp timestamp, received_at_utc timestamp"
LATEST = f"sensor_id string, event_id string, event_time timestamp, {_metrics}, received_at timestamp, updated_at timestamp"
ALERTS = "event_id string, rule_id string, sensor_id string, event_time timestamp, metric string, threshold double, direction string, value double, temperature_c double, created_at timestamp"
LEDGER = f"event_id string, sensor_id string, event_time timestamp, {_metrics}, {_kafka}, first_processed_at timestamp, duplicate_count bigint, last_duplicate_at timestamp"
GOLD = "sensor_id string, hour_start timestamp, metric string, event_count bigint, avg_value double, min_value double, max_value double, computed_at timestamp"
EVIDENCE = {
    "source": "ts string, event_id string, sensor_id string, topic string, qos int, published boolean, fault string, event_time string, payload_bytes bigint, published_payload_bytes bigint",
    "bridge": "ts string, event_id string, kafka_topic string, partition int, offset bigint, payload_bytes bigint",
    "progress": "ts string, query string, batch_id bigint, num_input_rows bigint, duration_ms double, sink string",
}


def columns(schema: str) -> list[str]:
    """The names in a flat schema, in order."""
    return [field.split()[0] for field in schema.split(", ")]
