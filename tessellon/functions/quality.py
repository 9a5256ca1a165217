"""Validation of telemetry payloads as column expressions: one implementation for batch and stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessellon.registry import METRICS, Metric
from tessellon.schemas import PAYLOAD

LATE_SECONDS = 60
#: A timestamp begins with a full date and a time; bare years, months and times of day are refused.
ISO_SHAPE = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"
# The reasons of quarantine, in the order in which they are looked for.
REASONS = ("missing_or_invalid_event_time", "missing_or_invalid_ingest_time", "missing_field:sensor_id", "missing_field:event_id")


def instant(text: Column) -> Column:
    """A UTC instant from an ISO text, null if it isn't one; a text without an offset counts as UTC."""
    return F.when(F.trim(text).rlike(ISO_SHAPE), F.trim(text).try_cast("timestamp"))


def header(headers: Column, key: str) -> Column:
    """The first header of that key as text, null if there is none."""
    return F.get(F.filter(headers, lambda h: h.key == key), F.lit(0))["value"].cast("string")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def missing_reason(p: Column) -> Column:
    """The first failing identity rule, null if all hold."""
    tests = (instant(p.event_time).isNull(), instant(p.ingest_time).isNull(), blank_to_null(p.sensor_id).isNull(), blank_to_null(p.event_id).isNull())
    return F.coalesce(*(F.when(t, F.lit(r)) for r, t in zip(REASONS, tests)))


def raw_metric(p: Column, m: Metric) -> Column:
    """The metric's text: its own field, else its alias's."""
    own = blank_to_null(p[m.name])
    return F.coalesce(own, blank_to_null(p[m.alias])) if m.alias else own


def metric_value(raw: Column, m: Metric) -> Column:
    """The number if it is one within the bounds, else null (NaN sorts above all bounds)."""
    number = raw.try_cast("double")
    return F.when(number.between(m.low, m.high), number)


def metric_issue(raw: Column, m: Metric) -> Column:
    number = raw.try_cast("double")
    return F.when(raw.isNotNull() & number.isNull(), F.lit(f"non_numeric:{m.name}")).when(~number.between(m.low, m.high), F.lit(f"value_out_of_bounds:{m.name}"))


def is_late(received: Column, event: Column, seconds: int = LATE_SECONDS) -> Column:
    """Whole seconds between event and receipt above the limit; false if either is unknown."""
    return F.coalesce(F.unix_timestamp(received) - F.unix_timestamp(event) > seconds, F.lit(False))


def validated(bronze: DataFrame) -> DataFrame:
    """Bronze rows with everything that Silver and Quarantine need; is_valid tells which they belong to. The payload comes from a generator of one row, as Spark copies no generator: a plain column would be parsed anew for each filter and field."""
    rows = bronze.withColumn("p", F.explode(F.array(F.from_json("raw_payload", PAYLOAD))))
    p = F.col("p")
    raw = {m.name: raw_metric(p, m) for m in METRICS}
    event, reason = instant(p.event_time), missing_reason(p)
    issues = F.nullif(F.concat_ws(";", *(metric_issue(raw[m.name], m) for m in METRICS)), F.lit(""))
    place = F.concat_ws("-", "kafka_topic", F.col("kafka_partition").cast("string"), F.col("kafka_offset").cast("string"))
    return rows.withColumns(
        {m.name: metric_value(raw[m.name], m) for m in METRICS}
        | {
            "event_time_utc": event,
            "ingest_time_utc": instant(p.ingest_time),
            "metric_issues": issues,
            "is_late": is_late(F.col("received_at_utc"), event),
            "error_reason": reason,
            "record_key": F.coalesce(p.event_id, place),
            "is_valid": reason.isNull(),
        }
    )


def any_present(names) -> Column:
    return reduce(lambda a, b: a | b, (F.col(n).isNotNull() for n in names))


def differs(pairs) -> Column:
    """Whether any pair of columns is distinct, null counting as a value."""
    return reduce(lambda a, b: a | b, (~x.eqNullSafe(y) for x, y in pairs))
