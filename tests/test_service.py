"""The topology as a service: supervision, draining, leases, counters on the side, key placement."""

import json
import os
import signal
import threading
import time
import zlib
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from tessellon.functions import placement
from tessellon.operators import gold
from tessellon.schemas import SILVER, columns
from tessellon.sources import counters, files
from tessellon.sources.folder import Folder
from tessellon.streaming import pipeline, service


def endless(spark, path, name, fail_on=None):
    spark.range(3).write.mode("append").parquet(f"{path}/{name}-in")

    def batch(df, i):
        if fail_on is not None and df.count() and i >= fail_on:
            raise RuntimeError("the sink is gone")

    stream = spark.readStream.schema("id bigint").parquet(f"{path}/{name}-in")
    return stream.writeStream.queryName(name).option("checkpointLocation", f"{path}/{name}-ck").foreachBatch(batch).trigger(processingTime="200 milliseconds").start()


def test_a_failing_query_stops_all_and_its_error_is_raised(spark, tmp_path):
    queries = [endless(spark, tmp_path, "good"), endless(spark, tmp_path, "bad", fail_on=0)]
    with pytest.raises(Exception, match="the sink is gone"):
        service.serve(spark, queries, f"{tmp_path}/beat", beat_seconds=0.1, poll_seconds=0.05)
    assert not any(q.isActive for q in queries) and json.loads((tmp_path / "beat").read_text())["active"] == []
    with pytest.raises(Exception, match="the sink is gone"):
        pipeline.supervise(spark, [endless(spark, tmp_path, "worse", fail_on=0)], poll_seconds=0.05)


def test_signals_stop_the_service_and_the_heartbeat_is_refreshed(spark, tmp_path):
    q, seen = endless(spark, tmp_path, "q"), []
    before = signal.getsignal(signal.SIGTERM)

    def watch():
        for _ in range(30):
            time.sleep(0.1)
            if (tmp_path / "beat").exists():
                seen.append((tmp_path / "beat").read_text())
        os.kill(os.getpid(), signal.SIGTERM)

    t = threading.Thread(target=watch)
    t.start()
    assert service.serve(spark, [q], f"{tmp_path}/beat", beat_seconds=0.3, poll_seconds=0.05) is None
    t.join()
    told = {json.loads(x)["ts"] for x in seen if x}
    assert len(told) >= 4 and any(json.loads(x)["active"] == ["q"] for x in seen if x)
    assert not q.isActive and signal.getsignal(signal.SIGTERM) is before
    q = endless(spark, tmp_path, "q2")
    threading.Timer(1.0, q.stop).start()
    assert service.serve(spark, [q], poll_seconds=0.05) == "q2"


def two_partitions():
    """A source of records in two partitions, of which a file tells how many there are; defined here so that it goes to workers by value."""

    class Reader(SimpleDataSourceStreamReader):
        def __init__(self, path):
            self.path = path

        def initialOffset(self):
            return {"sensor_raw": {"0": 0, "1": 0}}

        def read(self, start):
            there = json.load(open(self.path))
            # at most three of each partition a batch, so that the query lags
            end = {p: min(there[p], n + 3) for p, n in start["sensor_raw"].items()}
            return self.readBetweenOffsets(start, {"sensor_raw": end}), {"sensor_raw": end}

        def readBetweenOffsets(self, start, end):
            return iter([(int(p), i) for p, n in start["sensor_raw"].items() for i in range(n, end["sensor_raw"][p])])

    class TwoPartitions(DataSource):
        @classmethod
        def name(cls):
            return "two_partitions"

        def schema(self):
            return "partition int, offset bigint"

        def simpleStreamReader(self, schema):
            return Reader(self.options["path"])

    return TwoPartitions


def test_a_lagging_stream_drains_and_settles(spark, tmp_path):
    spark.dataSource.register(two_partitions())
    at = tmp_path / "there.json"
    at.write_text(json.dumps({"0": 7, "1": 2}))
    latest = lambda: {"sensor_raw": {k: int(v) for k, v in json.loads(at.read_text()).items()}}
    stream = spark.readStream.format("two_partitions").option("path", str(at)).load()
    q = stream.writeStream.queryName("two").format("memory").option("checkpointLocation", f"{tmp_path}/ck").trigger(processingTime="500 milliseconds").start()
    try:
        report = service.settle(latest, lambda: service.committed(q), lambda: spark.table("two").count(), quiet_seconds=1.0, timeout_seconds=60, poll_seconds=0.1)
        assert report["drained"] and report["settled"] and report["signature"] == 9 and report["lag"] == {} and report["drain_seconds"] > 0
        assert service.committed(q) == {"sensor_raw": {"0": 7, "1": 2}}
        q.stop()
        at.write_text(json.dumps({"0": 7, "1": 6}))
        report = service.settle(latest, lambda: service.committed(q), lambda: 0, quiet_seconds=0.2, timeout_seconds=0.5, poll_seconds=0.1)
        assert not report["drained"] and not report["settled"] and report["lag"] == {"sensor_raw-1": 4}
    finally:
        q.stop()


def test_settling_by_a_scripted_clock():
    now = [0.0]
    done = lambda: {"t": {"0": min(5, int(now[0])), "1": 3}}
    latest = lambda: {"t": {"0": 5, "1": 3 if now[0] < 20 else 4 if now[0] < 22 else 3}}
    sign = lambda: min(8, int(now[0]))
    report = service.settle(latest, done, sign, quiet_seconds=30, timeout_seconds=600, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    # drained at 5, the signature changes until 8, partition 1 is behind from 20 to 22
    assert (report["drain_seconds"], report["seconds"], report["signature"], report["settled"]) == (5.0, 52.0, 8, True)
    assert service.lag({"t": {"0": 5, "1": 2}, "u": {"0": 1}}, {"t": {"0": 9}}) == {("t", "0"): 0, ("t", "1"): 2, ("u", "0"): 1}


NOW = datetime(2026, 1, 1, 2, 5, tzinfo=timezone.utc)


def hour_rows(spark, value):
    rows = [{"event_id": f"e{i}", "sensor_id": "s", "event_time_utc": datetime(2026, 1, 1, 1, i), "received_at_utc": datetime(2026, 1, 1, 1, i), "temperature_c": value + i, "kafka_partition": 0, "kafka_offset": i} for i in range(4)]
    return spark.createDataFrame([tuple(r.get(c) for c in columns(SILVER)) for r in rows], SILVER)


def test_lease_grants_expire_renew_and_are_numbered(spark, tmp_path):
    lease = service.Lease(spark, f"file://{tmp_path}/lease")
    later = lambda s: NOW + timedelta(seconds=s)
    assert lease.acquire("a", 60, NOW) == 1 and lease.acquire("b", 60, later(59)) is None
    assert lease.holds(1, later(59)) and not lease.holds(1, later(61))
    assert lease.renew(1, 60, later(50)) and lease.acquire("b", 60, later(100)) is None and lease.renew(1, 60, later(105))
    assert lease.acquire("b", 60, later(166)) == 2 and not lease.holds(1, later(166)) and not lease.renew(1, 60, later(166))
    lease.release(2)
    lease.release(2)
    assert lease.acquire("a", 60, later(167)) == 3
    folder = Folder(spark, f"file://{tmp_path}/lease")
    with pytest.raises(FileExistsError):
        folder.put_once("grant-000000000003", {})
    assert folder.get("grant-000000000003")["owner"] == "a"


def test_two_runners_one_stale_one_result(spark, tmp_path):
    lease, store = service.Lease(spark, f"file://{tmp_path}/lease"), service.GoldStore(spark, f"file://{tmp_path}/gold")
    clock = [NOW]
    run = lambda owner, rows, **kw: service.run_hourly(rows, store, lease, owner, lambda: clock[0], seconds=60, **kw)
    assert store.read().count() == 0

    def slow(silver, start, end):
        """While the first runner computes, its grant expires and a second one does the whole hour."""
        clock[0] += timedelta(seconds=61)
        assert run("second", hour_rows(spark, 20.0))["status"] == "done"
        return gold.hourly(silver, start, end)

    told = run("first", hour_rows(spark, 1.0), compute=slow)
    assert told["status"] == "fenced" and told["fence"] == 1
    got = store.read().collect()
    assert [(r["sensor_id"], r["event_count"], r["avg_value"]) for r in got] == [("s", 4, 21.5)]

    def busy(silver, start, end):
        assert run("other", hour_rows(spark, 9.0)) == {"owner": "other", "start": "2026-01-01T01:00:00+00:00", "end": "2026-01-01T02:00:00+00:00", "fence": None, "status": "busy"}
        return gold.hourly(silver, start, end)

    assert run("third", hour_rows(spark, 20.0), compute=busy)["status"] == "done" and store.read().count() == 1
    # a marker that slips in behind a later grant's never counts
    store.markers.put_once("000000000009", {"fence": 1, "part": "v=nowhere"})
    assert store.read().count() == 1


def test_counters_are_made_in_the_pass_that_writes(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.jsonl").write_text("".join('{"a": %d}\n' % i for i in range(5)) + "broken\n" * k)
    lines = files.json_lines(spark, str(tmp_path / "in"), "a int")
    seen = counters.Counted(lines, "parse", counters.parse_metrics() | counters.call_metrics(even=F.col("a") % 2 == 0))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "one pass")
    seen.rows.write.json(str(tmp_path / "out"))
    jobs = tracker.getJobIdsForGroup("counted")
    spark.sparkContext.setJobGroup("", "")
    assert seen.counts == {"lines": 18, "bad": 3, "good": 15, "even": 9} and len(jobs) == 1
    assert tuple(files.bad_count(lines.cache()).first()) == (3, 18)


def test_counters_of_a_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    totals, log = counters.CounterTotals(), []
    listeners = [totals, pipeline.ProgressLog(log.append)]
    for x in listeners:
        spark.streams.addListener(x)
    for k in range(3):
        (tmp_path / "in" / f"{k}.txt").write_text("ok\n" * (k + 1) + "bad\n" * k)
    stream = spark.readStream.option("maxFilesPerTrigger", 1).text(str(tmp_path / "in"))
    rows = counters.counted_stream(stream, "lines", counters.call_metrics(bad=F.col("value") == "bad", ok=F.col("value") == "ok"))
    q = rows.writeStream.queryName("counted").format("noop").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    for x in listeners:
        spark.streams.removeListener(x)
    assert totals.totals("lines") == {"bad": 3, "ok": 6} and totals.totals("none") == {}
    assert sum(json.loads(x)["observed"].get("lines", {}).get("ok", 0) for x in log) == 6
    assert {json.loads(x)["query"] for x in log if "query" in json.loads(x)} == {"counted"}


#: Where 25 keys of a recorded run went, three partitions.
PLACED = [
    "A_WEATHER_01 A_WEATHER_04 B_WEATHER_01 C_WEATHER_04 D_AIR_05 D_MULTI_03 D_WEATHER_04 E_WEATHER_01 E_WEATHER_04",
    "A_AIR_02 A_AIR_05 A_MULTI_03 B_AIR_05 B_MULTI_03 C_AIR_05 D_AIR_02 E_AIR_02",
    "B_AIR_02 B_WEATHER_04 C_AIR_02 C_MULTI_03 C_WEATHER_01 D_WEATHER_01 E_AIR_05 E_MULTI_03",
]


def test_keys_go_where_the_recorded_run_put_them(spark):
    keys = [(f"load15-clean-20261002_{k}", p) for p, names in enumerate(PLACED) for k in names.split()]
    got = spark.createDataFrame(keys, "key string, p int").select("p", placement.crc32_partition("key", 3).alias("got")).collect()
    assert all(r["got"] == r["p"] for r in got) and [sum(r["got"] == p for r in got) for p in range(3)] == [9, 8, 8]


def by_hand(data: bytes) -> int:
    h = placement.SEED ^ len(data)
    for i in range(0, len(data) - 3, 4):
        k = int.from_bytes(data[i : i + 4], "little") * placement.TIMES & 0xFFFFFFFF
        k = (k ^ k >> 24) * placement.TIMES & 0xFFFFFFFF
        h = h * placement.TIMES & 0xFFFFFFFF ^ k
    if rest := data[len(data) // 4 * 4 :]:
        h = (h ^ int.from_bytes(rest, "little")) * placement.TIMES & 0xFFFFFFFF
    h = (h ^ h >> 13) * placement.TIMES & 0xFFFFFFFF
    return h ^ h >> 15


def test_murmur2(spark):
    # known values of the public Java client's tests, as signed numbers
    known = {"21": -973932308, "foobar": -790332482, "a-little-bit-long-string": -985981536, "a-little-bit-longer-string": -1486304829, "lkjh234lh9fiuh90y23oiuhsafujhadof229phr9h19h89h8": -58897971, "abc": 479470107}
    words = [*known, "", "a", "ab", "Zürich", "東京", "x" * 101]
    got = {r["k"]: (r["h"], r["p"], r["c"]) for r in spark.createDataFrame([(w,) for w in words], "k string").select("k", placement.murmur2("k").alias("h"), placement.murmur2_partition("k", 7).alias("p"), placement.crc32_partition("k", 7).alias("c")).collect()}
    assert {k: h - (1 << 32) * (h >> 31) for k, (h, _, _) in got.items() if k in known} == known
    assert got == {w: (by_hand(w.encode()), (by_hand(w.encode()) & 0x7FFFFFFF) % 7, zlib.crc32(w.encode()) % 7) for w in words}
    assert spark.createDataFrame([(None,)], "k string").select(placement.murmur2("k")).first()[0] is None


def test_a_batch_opens_the_files_alone_that_can_hold_its_keys(spark, tmp_path, monkeypatch):
    from tessellon.streaming.pipeline import SnapshotStore

    def batch(ids, minute):
        at = datetime(2026, 1, 1) + timedelta(minutes=minute)
        rows = [{"event_id": f"e{i:06d}", "sensor_id": f"s{i % 3}", "event_time_utc": at, "received_at_utc": at, "temperature_c": 50.0, "kafka_partition": 0, "kafka_offset": i} for i in ids]
        return spark.createDataFrame([tuple(r.get(c) for c in columns(SILVER)) for r in rows], SILVER)

    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        store.apply(0, batch(range(2000), 0), "q")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ranges = store._state(0)["ranges"]["0"]["processed_events"]
    assert len(ranges) >= 6 and all(a[2] < b[1] for a, b in zip(ranges, ranges[1:]))
    one = batch([5], 1).select("event_id")
    assert store._files("processed_events", store._state(0), one) == {"0": [ranges[0][0]]}
    assert len(store.read("processed_events", keys=one).inputFiles()) == 1
    assert store.read("processed_events", keys=batch([999999], 1).select("event_id")).count() == 0
    assert store.apply(1, batch([5, 5, 1999, 2000], 2), "q") == 0
    got = {r["event_id"]: r["duplicate_count"] for r in store.read("processed_events").where("duplicate_count > 0 or event_id = 'e002000'").collect()}
    assert got == {"e000005": 2, "e001999": 1, "e002000": 0} and store.read("processed_events").count() == 2001
    # a marker of before, without ranges, is read as a whole
    state = store._state(1)
    monkeypatch.setattr(SnapshotStore, "_state", lambda self, v, real=SnapshotStore._state: real(self, v) | {"ranges": {}})
    assert state["ranges"] and store.read("processed_events", keys=one).count() == 2001


def test_watermark_lag():
    assert pipeline.watermark_lag("2026-01-01T00:10:00.500Z", "2026-01-01T00:00:00.000Z") == {"watermark": "2026-01-01T00:00:00.000Z", "watermark_lag_s": 600.5}
    for none in (None, "1970-01-01T00:00:00.000Z"):
        assert pipeline.watermark_lag("2026-01-01T00:10:00.500Z", none) == {"watermark": None, "watermark_lag_s": None}
