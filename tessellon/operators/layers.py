"""Bronze, Silver and Quarantine projections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessellon.functions.quality import header, validated
from tessellon.registry import NAMES
from tessellon.schemas import BRONZE, QUARANTINE, SILVER, columns


#: Where Bronze columns come from that are named otherwise in the source.
FROM_SOURCE = {"kafka_topic": "topic", "kafka_partition": "partition", "kafka_offset": "offset", "kafka_timestamp": "timestamp"}


def bronze(source: DataFrame) -> DataFrame:
    """The source's rows as they came, stamped with the time of receipt; nothing parsed, nothing dropped."""
    made = {"raw_payload": F.col("value").cast("string"), "mqtt_topic": header(F.col("headers"), "mqtt_topic"), "received_at_utc": F.current_timestamp()}
    return source.select(*((made[c] if c in made else F.col(FROM_SOURCE[c])).alias(c) for c in columns(BRONZE)))


def _shaped(rows: DataFrame, schema: str) -> DataFrame:
    """The columns of a layer: those that validation made, else the payload's own (of a ``_src`` column the field as it came)."""
    own = set(rows.columns)
    return rows.select(*(F.col(c if c in own else "p." + c.removesuffix("_src")).alias(c) for c in columns(schema)))


def silver(bronze_rows: DataFrame) -> DataFrame:
    """Rows whose identity is whole; metrics that fail are masked and named in metric_issues."""
    return _shaped(validated(bronze_rows).where("is_valid"), SILVER)


def quarantine(bronze_rows: DataFrame) -> DataFrame:
    """The other rows, whole, with the first rule they fail."""
    return _shaped(validated(bronze_rows).where("not is_valid"), QUARANTINE)


def unpivoted(rows: DataFrame, ids: list, names=NAMES) -> DataFrame:
    """One row per present reading: ids, metric, value."""
    if not names:
        raise ValueError("no metrics to unpivot")
    return rows.unpivot(ids, list(names), "metric", "value").where("value is not null")
