"""Validation, serving tables, hourly aggregates, reads, logs, mining and table logs on small inputs."""

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessellon.functions import quality
from tessellon.operators import gold, layers, logs, mining, reads, reconcile, serving, tablelog
from tessellon.registry import ALERTABLE, NAMES, rule
from tessellon.schemas import ALERTS, BRONZE, GOLD, LATEST, LEDGER, SILVER

T0 = datetime(2026, 9, 18, 3, 0, 0)
GOOD = {"event_id": "zoneA-000001", "sensor_id": "zoneA_MULTI_01", "event_time": "2026-09-18T10:00:00+07:00", "ingest_time": "2026-09-18T03:00:00.120Z", "temperature_c": 30.5, "humidity_pct": 61.0, "co2_ppm": 612.0, "pressure_hpa": 1008.4, "pm25_ugm3": 18.6, "light_lux": 31200.0}


def bronze(spark, payloads, received=T0 + timedelta(seconds=1)):
    rows = [(p if isinstance(p, (str, type(None))) else json.dumps(p), "sensors/x/telemetry", "sensor_raw", 0, i, T0, received) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, BRONZE)


def changed(**fields):
    return {k: v for k, v in (GOOD | fields).items() if v is not ...}


def one(spark, payload, **kw):
    return quality.validated(bronze(spark, [payload], **kw)).first()


def test_good_event_is_silver(spark):
    row = layers.silver(bronze(spark, [GOOD])).first()
    assert [row[m] for m in NAMES] == [GOOD[m] for m in NAMES] and row["metric_issues"] is None
    assert row["event_time_utc"] == T0 and row["is_late"] is False
    assert layers.silver(bronze(spark, [GOOD])).dtypes == spark.createDataFrame([], SILVER).dtypes


def test_identity_rules_in_order(spark):
    cases = [
        (changed(event_time="not-a-timestamp", sensor_id=...), "event_time"), (changed(event_time=..., ingest_time=...), "event_time"), (changed(event_time="2026"), "event_time"), (changed(event_time="T12:00"), "event_time"),
        (changed(ingest_time=...), "ingest_time"), (changed(sensor_id="  ", event_id=""), "sensor_id"), (changed(event_id=""), "event_id"), ("{broken", "event_time"), ("", "event_time"), (None, "event_time"),
    ]
    got = quality.validated(bronze(spark, [p for p, _ in cases])).orderBy("kafka_offset").collect()
    assert [r["error_reason"] for r in got] == [f"missing_field:{x}" if x in ("sensor_id", "event_id") else f"missing_or_invalid_{x}" for _, x in cases]
    keys = [r["record_key"] for r in layers.quarantine(bronze(spark, [p for p, _ in cases])).orderBy("kafka_offset").collect()]
    assert keys[0] == GOOD["event_id"] and keys[6] == "" and keys[7] == "sensor_raw-0-7"


def test_metrics_are_masked_and_named(spark):
    r = one(spark, changed(temperature_c="hot", humidity_pct=101, co2_ppm=5000, pressure_hpa=300, pm25_ugm3="NaN", light_lux={"a": 1}))
    assert (r["temperature_c"], r["humidity_pct"], r["co2_ppm"], r["pressure_hpa"], r["pm25_ugm3"], r["light_lux"]) == (None, None, 5000.0, 300.0, None, None)
    assert r["metric_issues"] == "non_numeric:temperature_c;value_out_of_bounds:humidity_pct;value_out_of_bounds:pm25_ugm3;non_numeric:light_lux"
    assert one(spark, changed(temperature_c=..., value="21"))["temperature_c"] == 21.0
    assert one(spark, changed(temperature_c=" ", value="21"))["temperature_c"] == 21.0
    r = one(spark, changed(**{m: ... for m in NAMES}))
    assert r["is_valid"] and r["metric_issues"] is None


def test_late_is_above_sixty_seconds(spark):
    assert [one(spark, GOOD, received=T0 + timedelta(seconds=s))["is_late"] for s in (60, 60.9, 61)] == [False, False, True]


def test_headers(spark):
    df = spark.createDataFrame([([("a", b"x"), ("mqtt_topic", b"t1"), ("mqtt_topic", b"t2")],), ([],), (None,)], "headers array<struct<key:string,value:binary>>")
    assert [r[0] for r in df.select(quality.header(F.col("headers"), "mqtt_topic")).collect()] == ["t1", None, None]


def silver(spark, rows):
    """Rows (event_id, sensor, minute, received minute, metrics) as a serving batch."""
    out = []
    for i, (event, sensor, at, got, metrics) in enumerate(rows):
        out.append((event, sensor, T0 + timedelta(minutes=at), *(metrics.get(m) for m in NAMES), None if got is None else T0 + timedelta(minutes=got), "t", 0, i))
    return spark.createDataFrame(out, "event_id string, sensor_id string, event_time timestamp, " + ", ".join(f"{m} double" for m in NAMES) + ", received_at timestamp, kafka_topic string, kafka_partition int, kafka_offset bigint")


def empty(spark, schema):
    return spark.createDataFrame([], schema)


def test_latest_takes_strictly_later_whole_rows(spark):
    t = {"temperature_c": 20.0, "humidity_pct": 50.0}
    first = serving.upsert_latest(empty(spark, LATEST), silver(spark, [("e1", "s1", 5, 6, t), ("e2", "s2", 5, 6, t), ("e3", "s3", 5, 6, t), ("e4", "s4", 5, 6, t)]))
    batch = silver(spark, [("e5", "s1", 6, 7, {"co2_ppm": 1.0}), ("e6", "s2", 4, 9, t), ("e7", "s3", 5, 7, t), ("e0", "s4", 5, 6, {"co2_ppm": 9.0}), ("e8", "s1", 9, 9, {}), ("e9", "s5", 1, None, t), (None, "s6", 1, 1, t)])
    got = {r["sensor_id"]: r for r in serving.upsert_latest(first, batch).collect()}
    assert {s: r["event_id"] for s, r in got.items()} == {"s1": "e5", "s2": "e2", "s3": "e7", "s4": "e4"}
    assert got["s1"]["temperature_c"] is None and got["s1"]["co2_ppm"] == 1.0


def test_alerts_are_strict_and_inserted_once(spark):
    m = {"temperature_c": 35.0, "humidity_pct": 80.1, "pressure_hpa": 949.9, "co2_ppm": 1000.0, "light_lux": 1e5}
    a = serving.alerts(silver(spark, [("e1", "s1", 1, 1, m), ("e1", "s1", 1, 2, m)]))
    once = serving.insert_alerts(empty(spark, ALERTS), a)
    assert sorted((r["rule_id"], r["value"], r["temperature_c"]) for r in once.collect()) == [("humidity_pct", 80.1, 35.0), ("pressure_hpa", 949.9, 35.0)]
    assert serving.insert_alerts(once, a).count() == 2
    assert len(ALERTABLE) == 5 and rule("co2_ppm").threshold == 1000
    with pytest.raises(KeyError):
        rule("light_lux")


def test_ledger_counts_copies_and_conflicts(spark):
    t, u = {"temperature_c": 20.0}, {"temperature_c": 21.0}
    first = serving.upsert_ledger(empty(spark, LEDGER), silver(spark, [("e1", "s", 1, 1, t)] * 3 + [(None, "s", 1, 1, t)]))
    assert [(r["event_id"], r["duplicate_count"], r["kafka_offset"]) for r in first.collect()] == [("e1", 2, 0)]
    batch = silver(spark, [("e1", "s", 1, 1, u), ("e1", "s", 1, 1, t), ("e1", "s", 1, 1, u), ("e2", "s", 1, 1, t), ("e2", "s", 1, 1, u)])
    second = serving.upsert_ledger(first, batch)
    assert sorted((r["event_id"], r["duplicate_count"], r["temperature_c"]) for r in second.collect()) == [("e1", 5, 20.0), ("e2", 1, 20.0)]
    assert serving.payload_conflicts(second, batch).count() == 3


def test_gold_replaces_keys_and_windows(spark):
    h = [T0 + timedelta(hours=i) for i in range(3)]
    old = spark.createDataFrame([("s", h[0], "m", 1, 1.0, 1.0, 1.0, T0), ("s", h[1], "m", 2, 2.0, 2.0, 2.0, T0)], GOLD)
    new = spark.createDataFrame([("s", h[1], "m", 9, 9.0, 9.0, 9.0, T0)], GOLD)
    assert sorted(r["event_count"] for r in serving.replace_keys(old, new, ["sensor_id", "hour_start", "metric"]).collect()) == [1, 9]
    assert sorted(r["event_count"] for r in serving.replace_window(old, new, "hour_start", h[0], h[2]).collect()) == [9]


def test_gold_window_and_dedup(spark):
    rows = bronze(spark, [changed(event_id=f"e{i % 3}", event_time=f"2026-09-18T0{3 + i}:00:00Z") for i in range(4)])
    out = gold.hourly(layers.silver(rows), datetime(2026, 9, 18, 3), datetime(2026, 9, 18, 6), ["temperature_c"])
    assert [(r["event_count"], r["avg_value"]) for r in out.collect()] == [(1, 30.5)] * 3
    lo, hi = gold.window("2026-09-18T10:00:00+07:00", "2026-09-18T04:00:00Z")
    assert (lo.hour, hi.hour) == (3, 4)
    for bad in (("2026-09-18T10:00:00", "2026-09-18T11:00:00Z"), ("2026-09-18T10:30:00Z", "2026-09-18T11:00:00Z"), ("2026-09-18T11:00:00Z", "2026-09-18T11:00:00Z"), ("x", "y")):
        with pytest.raises(ValueError):
            gold.window(*bad)
    assert gold.previous_hour(datetime(2026, 1, 1, 3, 0, 30, tzinfo=timezone.utc))[1].hour == 2
    with pytest.raises(ValueError):
        layers.unpivoted(rows, ["mqtt_topic"], [])


def test_reads(spark):
    df = spark.createDataFrame([(f"s{i:02d}", i) for i in range(30)], "sensor_id string, n int")
    rows, total = reads.latest(df, limit=5, offset=10)
    assert [r["n"] for r in rows.collect()] == [10, 11, 12, 13, 14] and total.first()["total"] == 30
    assert reads.page(df, ["n"], 10_000, -5).count() == 30 and reads.page(df, ["n"], 0, 0).count() == 1
    g = spark.createDataFrame([("s", T0 + timedelta(hours=i), "m", 1, 1.0, 1.0, 1.0, T0) for i in range(30)], GOLD)
    assert reads.stats(g).count() == 30
    assert reads.stats(g, end=T0 + timedelta(hours=26)).count() == 24
    with pytest.raises(ValueError):
        reads.stats(g, T0, T0)
    assert reads.instant("2026-01-01T00:00:00").tzinfo is timezone.utc and reads.instant("") is None
    assert reads.health(spark) == {"status": "ok"}


def test_logs(spark):
    lines = spark.createDataFrame([("ERROR 10.0.0.250 GET /api/x 500 12ms",), ("INFO bad POST /y 200 300ms",), ("short",)], "value string")
    rows = logs.parsed(lines).collect()
    assert tuple(rows[0]) == ("ERROR", "10.0.0.250", "GET", "/api/x", 500, 12) and rows[2]["status"] is None
    many = logs.multiplied(logs.parsed(lines).limit(1), 3).orderBy("k").collect()
    assert [(r["ip"], r["latency_ms"]) for r in many] == [("10.0.0.250", 1), ("10.0.0.31", 5), ("10.0.0.68", 18)]
    p = spark.createDataFrame([("t", "q1", i, 10, d) for i, d in enumerate((100.0, 200.0, -1.0))], "ts string, query string, batch_id long, num_input_rows long, duration_ms double")
    r = logs.progress_rollup(p, start="2026-01-01").first()
    assert (r["batches"], r["num_input_rows"], r["last_batch_id"], r["p50_ms"], r["p95_ms"]) == (3, 30, 2, 150.0, 195.0)
    stats = spark.createDataFrame([("kafka\t10MiB / 1GiB\t1.5%\t20%\t",), ("",), ("x\ty",)], "value string")
    assert [tuple(r) for r in logs.container_stats(stats).collect()] == [("kafka", "10MiB / 1GiB", 1.5, 20.0)]


def test_reconcile(spark):
    a = spark.createDataFrame([(1, 2, 1.0), (2, 2, 1.0), (3, 1, 1.0)], "k int, n int, m double")
    b = spark.createDataFrame([(1, 2, 1.0), (2, 2, 1.1), (4, 1, 1.0)], "k int, n int, m double")
    r = reconcile.reconciled(a, b, ["k"], "n", "m").first()
    assert (r["groups"], r["only_left"], r["only_right"], r["mismatched"]) == (4, 1, 1, 1)
    assert not reconcile.same_rows(a, b) and reconcile.same_rows(a, a)
    sizes = reconcile.partition_sizes(spark.range(10).selectExpr("cast(id % 3 as int) as p"), 5, F.col("p")).collect()
    assert sorted((r["partition"], r["n"]) for r in sizes) == [(0, 4), (1, 3), (2, 3), (3, 0), (4, 0)]


def test_table_log(spark, tmp_path):
    commits = [[{"commitInfo": {"operation": "WRITE"}}, {"add": {"path": "p1"}}], [{"commitInfo": {"operation": "OVERWRITE"}}, {"remove": {"path": "p1"}}, {"add": {"path": "p7"}}], [{"commitInfo": {"operation": "DELETE"}}, {"remove": {"path": "p7"}}]]
    for v, rows in enumerate(commits):
        (tmp_path / f"{v:06d}.json").write_text("\n".join(map(json.dumps, rows)) + "\nnot json\n")
    log = tablelog.read_log(spark, str(tmp_path))
    assert [[r[0] for r in tablelog.live_files(log, v).collect()] for v in range(3)] == [["p1"], ["p7"], []]
    assert [tuple(r) for r in tablelog.commit_summary(log).orderBy("version").collect()] == [(0, "WRITE", 1, 0), (1, "OVERWRITE", 1, 1), (2, "DELETE", 0, 1)]


def test_mining(spark):
    docs = spark.createDataFrame([(0, "Spark is fast"), (1, "spark is big a"), (2, "data")], "doc_id int, text string")
    w = {(r["doc"], r["term"]): r["weight"] for r in mining.tfidf(docs).collect()}
    assert len(w) == 7 and abs(sum(v * v for (d, _), v in w.items() if d == 0) - 1) < 1e-9 and w[0, "fast"] > w[0, "spark"]
    baskets = spark.createDataFrame([(["Bim", "Bia", "Sua"],), (["Bim", "Bia"],), (["Sua", "Banh"],), (["Bim", "Bia", "Banh"],)], "items array<string>")
    assert tuple(mining.rule_of(baskets, "items", ["Bim"], ["Bia"]).first()) == (0.75, 1.0)
    assert tuple(mining.rule_of(baskets, "items", ["Banh"], ["Sua"]).first()) == (0.25, 0.5)
    points = spark.createDataFrame([(i, float(i // 3) + 0.01 * i, 100.0 * (i // 3) + i) for i in range(9)], "id int, x double, y double")
    groups = {r["id"]: r["cluster"] for r in mining.kmeans(points, ["x", "y"], 3).collect()}
    assert len(set(groups.values())) == 3 and all(groups[3 * g] == groups[3 * g + 1] == groups[3 * g + 2] for g in range(3))
    fit = mining.line_fit(spark.createDataFrame([(1.0, 31.0), (2.0, 41.0)], "x double, y double"), "y", "x").first()
    assert (fit["intercept"], fit["slope"]) == (21.0, 10.0)
    grown = spark.createDataFrame([(i, float(i % 10), float(i % 10 > 4)) for i in range(200)], "i int, h double, label double")
    tree = mining.decision_tree(grown, ["h"], "label", "i")
    assert tree.where("label <> predicted").count() == 0 and 20 < tree.count() < 80
    raw = {r["id"]: r["cluster"] for r in mining.kmeans(points.withColumn("x", F.col("x") * 0 + F.col("id") % 2), ["x", "y"], 3, scaled=False).collect()}
    assert all(raw[3 * g] == raw[3 * g + 1] == raw[3 * g + 2] for g in range(3))
    cost = tablelog.storage_cost(spark.createDataFrame([(500, 3), (2000, 2)], "terabytes int, copies int")).collect()
    assert [tuple(r)[2:] for r in cost] == [(1500.0, 900.0, 40.0), (4000.0, 3200.0, 20.0)]


def test_serving_rows_are_stamped(spark):
    """created_at, updated_at, first_processed_at, last_duplicate_at and computed_at, and the reads that order by them."""
    t = {"temperature_c": 40.0}
    at = [datetime(2026, 9, 18, 10 + i) for i in range(3)]
    first = silver(spark, [("e1", "s1", 5, 6, t), ("e2", "s2", 5, 6, t), ("e2", "s2", 5, 6, t)])
    again = silver(spark, [("e1", "s1", 5, 6, t), ("e3", "s1", 7, 8, t)])
    latest = serving.upsert_latest(serving.upsert_latest(empty(spark, LATEST), first, now=at[0]), again, now=at[1])
    assert {r["sensor_id"]: (r["event_id"], r["updated_at"]) for r in latest.collect()} == {"s1": ("e3", at[1]), "s2": ("e2", at[0])}
    made = serving.insert_alerts(serving.insert_alerts(empty(spark, ALERTS), serving.alerts(first), now=at[0]), serving.alerts(again), now=at[1])
    assert [(r["event_id"], r["created_at"]) for r in reads.alerts(made).collect()] == [("e3", at[1]), ("e1", at[0]), ("e2", at[0])]
    ledger = serving.upsert_ledger(serving.upsert_ledger(empty(spark, LEDGER), first, now=at[0]), again, now=at[1])
    assert {r["event_id"]: (r["first_processed_at"], r["duplicate_count"], r["last_duplicate_at"]) for r in ledger.collect()} == {"e1": (at[0], 1, at[1]), "e2": (at[0], 1, None), "e3": (at[1], 0, None)}
    assert [r["event_id"] for r in reads.latest_duplicates(ledger).collect()] == ["e1", "e2"]
    assert tuple(reads.serving_summary(ledger).first()) == (3, 2, 2, 1, at[1])
    assert tuple(reads.progress(ledger, {"alerts": made}).first()) == (3, 2, at[1], 3)
    gold_rows = gold.computed(spark.createDataFrame([("s", at[0], "m", 2, 1.0, 1.0, 1.0)], GOLD.rsplit(", ", 1)[0]), at[2])
    assert gold_rows.columns == spark.createDataFrame([], GOLD).columns
    assert reads.gold_summary(gold_rows).first()["gold_computed_at"] == at[2] and reads.gold_summary(gold_rows).first()["gold_last_hour"] == at[0]


def test_payloads_are_parsed_once(spark):
    for layer in (layers.silver, layers.quarantine):
        plan = layer(bronze(spark, [GOOD, "{broken"]).repartition(2))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1 and "Python" not in plan


def test_replica_order_and_racks(spark):
    rows = lambda block, *places: [(block, i + 1, n, r) for i, (n, r) in enumerate(places)]
    all_ = rows(1, ("a", 1), ("b", 2), ("c", 2)) + rows(2, ("a", 1), ("b", 1), ("c", 2)) + rows(3, ("a", 1), ("b", 2), ("c", 1)) + rows(4, ("a", 1), ("b", 2), ("b", 2)) + rows(5, ("a", 1)) + rows(6, ("a", 1), ("b", 2), ("c", 2), ("d", 1), ("e", 3)) + rows(7, ("a", 1), ("b", 2), ("c", 2), ("d", 2))
    df = spark.createDataFrame(all_, "block int, replica int, node string, rack int")
    assert {r["block"]: r["valid"] for r in tablelog.placement_valid(df).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True, 6: True, 7: False}
    assert tablelog.racks(df.select("node", "rack")) == 3
    with pytest.raises(ValueError, match="rack"):
        tablelog.racks(df.where("rack = 1").select("node", "rack"))


def test_written_logs_and_results(spark, tmp_path):
    from tessellon.sources import files

    path = f"file://{tmp_path}/log"
    tablelog.write_commit(spark, path, 0, [{"commitInfo": {"operation": "WRITE"}}, {"add": {"path": "p1"}}])
    tablelog.write_commit(spark, path, 1, [{"remove": {"path": "p1"}}, {"add": {"path": "p2"}}])
    with pytest.raises(Exception):
        tablelog.write_commit(spark, path, 1, [{"add": {"path": "p9"}}])
    assert [r["path"] for r in tablelog.live_files(tablelog.read_log(spark, path)).collect()] == ["p2"]
    files.write_csv(spark.range(3).selectExpr("id", "'a,b' as name"), str(tmp_path / "csv"))
    assert sorted(tuple(r) for r in files.csv(spark, str(tmp_path / "csv"), "id bigint, name string").collect()) == [(i, "a,b") for i in range(3)]
    for i in range(2):
        files.write_log(spark.createDataFrame([(f"e{i}", 10)], "event_id string, payload_bytes int"), str(tmp_path / "delivered"))
    assert spark.read.json(str(tmp_path / "delivered")).count() == 2
    for name, value in (("one", 1.5), ("two", 2.5)):
        files.write_json_result({"seconds": value}, str(tmp_path / "results" / name), spark)
    assert {(r["experiment"], r["seconds"]) for r in files.results(spark, str(tmp_path / "results")).collect()} == {("one", 1.5), ("two", 2.5)}


def test_ordered_fold_ignores_partitions(spark):
    rows = [(k, i, float((i * 7 + k) % 11)) for k in range(3) for i in range(k * 20 + 1)]
    want = {}
    for k, _, v in rows:
        want[k] = v if k not in want else (want[k] + v) / 2
    df = spark.createDataFrame(rows, "k int, i int, v double")
    for n in (1, 5):
        assert all(abs(r["folded"] - want[r["k"]]) < 1e-9 for r in logs.ordered_fold(df.repartition(n), "k", "i", "v").collect())
