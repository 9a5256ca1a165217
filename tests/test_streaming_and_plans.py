"""The topology end to end, sources, plan shapes, and every query against its SQL."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from tessellon import plans
from tessellon.operators import gold, layers
from tessellon.sources import files, generator, kafka
from tessellon.streaming import pipeline

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def source(spark, path, n=200, **kw):
    generator.as_kafka(generator.events(spark, n, faults=True, **kw)).coalesce(2).write.mode("append").parquet(path)
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def test_topology_accounts_for_every_event_and_survives_replay(spark, tmp_path):
    root = str(tmp_path / "run")
    stream = source(spark, str(tmp_path / "in"))
    store = pipeline.drain(spark, stream, root)
    bronze, silver, quarantine = (spark.read.parquet(f"{root}/{t}") for t in ("bronze", "silver", "quarantine"))
    assert bronze.count() == 200 == silver.count() + quarantine.count() and quarantine.count() > 0
    latest, alerts, ledger = (store.read(t) for t in pipeline.TABLES)
    assert latest.count() == 3 and alerts.count() > 0
    assert ledger.agg(F.sum(F.col("duplicate_count") + 1)).first()[0] == silver.count()
    before = sorted(map(tuple, ledger.select("event_id", "duplicate_count").collect()))
    assert [store.apply(b, silver, q) for q, b in store.applied().items()] == [None]  # a replayed batch
    assert sorted(map(tuple, store.read("processed_events").select("event_id", "duplicate_count").collect())) == before
    # a restart goes on where the checkpoints stand
    store = pipeline.drain(spark, source(spark, str(tmp_path / "in"), 50, zone="zoneB"), root)
    assert spark.read.parquet(f"{root}/bronze").count() == 250 and store.read("sensor_latest").count() == 6


def test_watermarked_windows_and_heartbeat(spark, tmp_path):
    from datetime import datetime, timedelta

    rows = [("s1", datetime(2026, 1, 1) + timedelta(minutes=m)) for m in (0, 3, 11, 60)]
    spark.createDataFrame(rows, "sensor_id string, event_time_utc timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("sensor_id string, event_time_utc timestamp").parquet(str(tmp_path / "in"))
    q = pipeline.windowed(stream).writeStream.format("memory").queryName("w").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("w").collect()) == [1, 2]
    pipeline.heartbeat(spark, str(tmp_path / "beat"), [q])
    assert '"active": []' in spark.read.text(str(tmp_path / "beat")).first()[0]


def test_generator_repeats_itself(spark):
    a, b = (generator.events(spark, 300, faults=True).orderBy("id").collect() for _ in range(2))
    assert a == b and {r["fault"] for r in a} >= {None, "duplicate", "missing_field"}
    assert generator.events(spark, 300).where("fault is not null").count() == 0


def test_sources(spark, tmp_path):
    assert files.parquet_or_none(spark, str(tmp_path / "none")) is None
    os.makedirs(tmp_path / "empty")
    assert files.parquet_or_none(spark, str(tmp_path / "empty")) is None
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nbroken\n{"a": 2}\n')
    rows = files.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").cache()
    assert sorted(r["a"] for r in files.good(rows).collect()) == [1, 2] and tuple(files.bad_count(rows).first()) == (1, 3)
    (tmp_path / "p.jsonl").write_text('{"query": "q1", "batch_id": 3}\n[1]\nnope {\n')
    assert [r["batch_id"] for r in files.evidence(spark, str(tmp_path / "p.jsonl"), "progress").collect()] == [3]
    assert files.evidence(spark, str(tmp_path / "no.jsonl"), "bridge").count() == 0
    (tmp_path / "c.csv").write_text("id,name\n1,x\n2,y\n")
    assert files.csv(spark, str(tmp_path / "c.csv")).dtypes == [("id", "int"), ("name", "string")]
    assert files.csv(spark, str(tmp_path / "c.csv"), "id bigint, name string").count() == 2
    files.write_text(spark.range(3), "id", str(tmp_path / "t"))
    assert files.text_lines(spark, str(tmp_path / "t")).count() == 3
    df = spark.createDataFrame([('{"sensor_id": "s1"}', "sensors/s9/telemetry"), ("{}", "sensors/s9/x")], "payload string, mqtt_topic string")
    assert [r["key"] for r in kafka.records(df).collect()] == ["s1", "x"]


def test_jdbc_round_trip(spark):
    url = "jdbc:derby:memory:tessellon;create=true"
    files.jdbc_append(spark.createDataFrame([(1, "a")], "id int, name string"), url, "t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert files.jdbc_table(spark, url, "t", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").count() == 1


def test_a_failure_between_steps_keeps_the_version_before(spark, tmp_path, monkeypatch):
    from tessellon.schemas import SILVER, columns
    from tessellon.streaming.pipeline import SnapshotStore

    def batch(*ids):
        from datetime import datetime

        rows = [{"event_id": i, "sensor_id": "s", "event_time_utc": datetime(2026, 1, 1), "received_at_utc": datetime(2026, 1, 1), "temperature_c": 40.0, "kafka_partition": 0, "kafka_offset": n} for n, i in enumerate(ids)]
        return spark.createDataFrame([tuple(r.get(c) for c in columns(SILVER)) for r in rows], SILVER)

    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    count = lambda: {r["event_id"]: r["duplicate_count"] for r in store.read("processed_events").collect()}
    assert count() == {} and store.apply(0, batch("a", "a"), "q") == 0
    for step in ("_mark", "read"):  # before the marker, and after the first table
        with monkeypatch.context() as m:
            real, calls = getattr(SnapshotStore, step), []
            m.setattr(SnapshotStore, step, lambda self, *a: calls.append(a) or (_ for _ in ()).throw(OSError("lost")) if step == "_mark" or len(calls) >= 2 else calls.append(a) or real(self, *a))
            with pytest.raises(OSError):
                store.apply(1, batch("a", "b"), "q")
        assert count() == {"a": 1}
    store.apply(1, batch("a", "b"), "q")
    assert store.apply(1, batch("a", "b"), "q") is None and count() == {"a": 2, "b": 0}
    assert store.apply(0, batch("c"), "after a new checkpoint") == 0 and count() == {"a": 2, "b": 0, "c": 0}
    assert SnapshotStore(spark, f"file://{tmp_path}/s").applied() == {"q": 1, "after a new checkpoint": 0}


def test_a_batch_writes_its_own_keys_and_parts_are_merged(spark, tmp_path, monkeypatch):
    from collections import Counter
    from datetime import datetime, timedelta

    from tessellon.schemas import SILVER, columns
    from tessellon.streaming.pipeline import SnapshotStore

    def batch(n, *ids):
        at = datetime(2026, 1, 1) + timedelta(minutes=n)
        rows = [{"event_id": i, "sensor_id": "s" + i[-1], "event_time_utc": at, "received_at_utc": at, "temperature_c": 99.0, "kafka_partition": 0, "kafka_offset": n} for i in ids]
        return spark.createDataFrame([tuple(r.get(c) for c in columns(SILVER)) for r in rows], SILVER)

    monkeypatch.setattr(SnapshotStore, "MOST_PARTS", 3)
    store = SnapshotStore(spark, f"file://{tmp_path}/s")
    batches = [[f"e{i}" for i in range(40)], ["e1", "e1"], ["e40", "e2"], ["e1", "e41"], ["e40"], ["e42", "e3"], ["e1"], []]
    seen, kinds = Counter(), set()
    for n, ids in enumerate(batches):
        assert store.apply(n, batch(n, *ids), "q") == 0
        seen.update(ids)
        assert {r["event_id"]: r["duplicate_count"] for r in store.read("processed_events").collect()} == {i: c - 1 for i, c in seen.items()}
        alerts = [r["event_id"] for r in store.read("alerts").select("event_id").collect()]
        assert sorted(alerts) == sorted(seen)
        parts = store._state(store.current())["parts"]
        kinds.update(("merged" if p.endswith("merged") else "own", i == 0) for i, p in enumerate(parts))
        assert len(parts) <= 3
        if not parts[-1].endswith("merged"):
            assert store._part("processed_events", parts[-1]).count() == len(set(ids))
    last = {f"s{k}": max(n for n, ids in enumerate(batches) for i in ids if i[-1] == str(k)) for k in range(10)}
    assert {r["sensor_id"]: r["event_time"].minute for r in store.read("sensor_latest").collect()} == last
    assert ("merged", True) in kinds or ("merged", False) in kinds
    used = {p for m in store._markers() for p in store._state(m)["parts"]}
    assert {f.name[2:] for f in (tmp_path / "s").iterdir() if f.name.startswith("v=")} >= used and len(store._markers()) == 2


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([], "event_id string, sensor_id string, event_time_utc timestamp, temperature_c double, received_at_utc timestamp, kafka_partition int, kafka_offset bigint, unused string").write.parquet(str(tmp_path / "s"))
    from datetime import datetime

    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    text = plan_of(gold.hourly(spark.read.parquet(str(tmp_path / "s")), datetime(2026, 1, 1), datetime(2026, 1, 2), ["temperature_c"]))
    assert "GreaterThanOrEqual(event_time_utc" in text and "LessThan(event_time_utc" in text and "unused" not in text
    assert "WindowGroupLimit" in text and "partial_avg" in text and "Python" not in text


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query_equals_its_sql(spark, name):
    df = plans.queries()[name](spark, SF)
    rows = df.collect()
    if name not in plans.oracle_sql():
        assert rows
        return
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = c.execute(plans.oracle_sql()[name])
    names, want = [d[0] for d in got.description], got.fetchall()
    assert sorted(names) == sorted(df.columns)
    key = lambda v: ("", "") if v is None else (type(v).__name__, str(v))
    assert sorted(tuple(key(r[n]) for n in sorted(names)) for r in rows) == sorted(tuple(key(r[names.index(n)]) for n in sorted(names)) for r in want)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())


def test_kmeans_uses_whole_vectors(spark, tmp_path):
    # the first 8 components say nothing of the three groups that the others make
    rows = [(i, [float(i % 5 == k) for k in range(8)] + [10.0 * (i % 10 in (0, 1)), 10.0 * (i % 10 in (2, 3, 4))] * 4) for i in range(100)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = plans.queries()["kmeans"](spark, str(tmp_path)).collect()
    assert sorted(r["n"] for r in got) == [20, 30, 50]
