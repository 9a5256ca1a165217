"""Generated telemetry: shares of faults, ranges of values, stations, and what validation makes of each fault."""

import json

import pytest
from pyspark.sql import functions as F

from tessellon.functions.quality import validated
from tessellon.operators import layers
from tessellon.registry import METRICS, STATIONS
from tessellon.sources import generator, kafka

N = 20_000


@pytest.fixture(scope="module")
def rows(spark):
    return generator.events(spark, N, faults=True, sensors=5).cache()


def test_shares_of_faults(rows):
    got = {r["fault"]: r["count"] for r in rows.groupBy("fault").count().collect()}
    for name, share in generator.FAULTS:
        want = N * share / 1000
        assert abs(got[name] - want) < 5 * want**0.5, name
    assert got[None] > 0.92 * N


def test_stations_values_and_spikes(rows):
    good = rows.where("fault is null").select("payload").collect()
    bounds, spikes, readings = {m.name: m for m in METRICS}, 0, 0
    for r in good:
        p = json.loads(r["payload"])
        assert set(STATIONS[p["sensor_type"]]) == {m for m in bounds if m in p}  # each kind has its own metrics, and no other
        for m in STATIONS[p["sensor_type"]]:
            v, k = float(p[m]), bounds[m]
            assert k.low <= v <= k.high and round(v, 2) == v
            readings += 1
            spikes += bool(k.threshold) and (v > k.threshold if k.direction == "high" else v < k.threshold)
        prefix, kind, number = p["sensor_id"].rsplit("_", 2)
        assert prefix == "zoneA" and kind == p["sensor_type"] and number.isdecimal() and len(number) == 2
    # two events in a hundred have a spike, of one metric in six, if the station has it
    assert 0 < spikes < 0.03 * len(good)


def test_sensors_cycle_through_the_kinds(spark):
    one = generator.events(spark, 12, sensors=4).select(F.get_json_object("payload", "$.sensor_id").alias("s")).collect()
    assert [r["s"] for r in one] == ["zoneA_WEATHER_01", "zoneA_AIR_02", "zoneA_MULTI_03", "zoneA_WEATHER_04"] * 3
    assert generator.events(spark, 500, spike_pct=0.0).select(F.count_if(F.get_json_object("payload", "$.humidity_pct").cast("double") > 80)).first()[0] == 0


def test_what_validation_makes_of_each_fault(spark, rows):
    bronze = layers.bronze(generator.as_kafka(rows))
    # the source keeps the row's number as partition and offset
    told = validated(bronze).withColumn("id", F.col("kafka_offset") * 3 + F.col("kafka_partition")).join(rows.select("id", "fault"), "id")
    got = {r["fault"]: r for r in told.groupBy("fault").agg(F.count_if("is_valid").alias("ok"), F.count("*").alias("n"), F.collect_set("error_reason").alias("why"), F.count_if(F.col("metric_issues").isNotNull()).alias("masked")).collect()}
    assert got[None]["ok"] == got[None]["n"] and got[None]["masked"] == 0
    assert got["missing_field"]["ok"] == 0 and got["missing_field"]["why"] == ["missing_field:sensor_id"]
    assert got["bad_timestamp"]["ok"] == 0 and got["bad_timestamp"]["why"] == ["missing_or_invalid_event_time"]
    for fault in ("non_numeric", "out_of_bounds"):
        assert got[fault]["ok"] == got[fault]["n"] == got[fault]["masked"]
    for fault in ("duplicate", "late_30s", "late_5min"):
        assert got[fault]["ok"] == got[fault]["n"]
    keys = rows.select(F.get_json_object("payload", "$.event_id").alias("e")).groupBy("e").count()
    assert keys.where("count > 1").count() > 0.8 * got["duplicate"]["n"]


def test_kafka_options():
    assert kafka.source_options("h:9092", "sensor_raw") == {"kafka.bootstrap.servers": "h:9092", "subscribe": "sensor_raw", "startingOffsets": "earliest", "includeHeaders": "true", "maxOffsetsPerTrigger": "20000", "failOnDataLoss": "false"}
    told = kafka.sink_options("h:9092", "sensor_raw")
    assert (told["kafka.acks"], told["kafka.enable.idempotence"], told["kafka.compression.type"], told["kafka.linger.ms"]) == ("all", "true", "lz4", "20")
