"""Event time in the stream: the life of an aggregate, the delay policy, deduplication and windows with their accounts."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessellon.operators import gold
from tessellon.schemas import LEDGER, SILVER, columns
from tessellon.streaming import lifecycle, pipeline, policy, windows

T0 = datetime(2026, 1, 1)
H = timedelta(hours=1)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def silver(spark, rows):
    """Silver rows from (event_id, sensor, minute, temperature[, minute of receipt])."""
    made = [{"event_id": r[0], "sensor_id": r[1], "event_time_utc": at(r[2]), "received_at_utc": at(r[4] if len(r) > 4 else r[2]), "temperature_c": r[3], "kafka_partition": 0, "kafka_offset": n} for n, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.get(c) for c in columns(SILVER)) for r in made], SILVER)


class Feed:
    """A folder that a stream reads, a file a call."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)

    def put(self, *rows):
        silver(self.spark, rows).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self, files=1):
        return self.spark.readStream.schema(SILVER).option("maxFilesPerTrigger", files).parquet(self.path)

    def table(self):
        return self.spark.read.schema(SILVER).parquet(self.path)


def publish(feed, out, **kw):
    q = pipeline.append(lifecycle.versions(feed.stream(), metrics=["temperature_c"], **kw), f"{out}/versions", f"{out}/ck", "versions", availableNow=True)
    q.awaitTermination()
    return q


def published(spark, out):
    return spark.read.schema(lifecycle.VERSIONS).parquet(f"{out}/versions")


def story(df, sensor, minute):
    rows = df.where((F.col("sensor_id") == sensor) & (F.col("window_start") == F.lit(at(minute)))).orderBy("version").collect()
    assert [r["version"] for r in rows] == list(range(1, len(rows) + 1))
    return [(r["status"], r["event_count"], r["avg_value"], r["previous_version"]) for r in rows]


SHORT = {"delay": timedelta(minutes=5), "grace": timedelta(minutes=1), "horizon": timedelta(hours=3)}


def test_a_late_row_after_final_corrects_once_and_a_restart_repeats_nothing(spark, tmp_path):
    feed, out = Feed(spark, tmp_path / "in"), str(tmp_path)
    feed.put(("a", "s1", 0, 10.0), ("b", "s1", 50, 20.0), ("c", "s2", 30, 5.0))
    feed.put(("d", "s1", 59, 30.0))
    feed.put(("e", "s1", 70, 1.0))  # the frontier passes minute 61 now
    publish(feed, out, **SHORT)
    first = published(spark, out)
    assert story(first, "s1", 0) == [("PROVISIONAL", 2, 15.0, None), ("PROVISIONAL", 3, 20.0, None), ("FINAL", 3, 20.0, None)]
    assert story(first, "s2", 0) == [("PROVISIONAL", 1, 5.0, None), ("FINAL", 1, 5.0, None)]
    assert story(first, "s1", 60) == [("PROVISIONAL", 1, 1.0, None)]
    n = first.count()
    publish(feed, out, **SHORT)
    assert published(spark, out).count() == n  # a restart with nothing new
    feed.put(("f", "s1", 40, 40.0))  # late for its window, which is final
    publish(feed, out, **SHORT)
    assert story(published(spark, out), "s1", 0)[3:] == [("CORRECTED", 4, 25.0, 3)] and published(spark, out).count() == n + 1
    publish(feed, out, **SHORT)
    assert published(spark, out).count() == n + 1
    # the last version of each key is the batch result
    want = {(r["sensor_id"], r["hour_start"]): (r["event_count"], r["avg_value"], r["min_value"], r["max_value"]) for r in gold.hourly(feed.table(), metrics=["temperature_c"]).collect()}
    got = {(r["sensor_id"], r["window_start"]): (r["event_count"], r["avg_value"], r["min_value"], r["max_value"]) for r in lifecycle.current(published(spark, out)).collect()}
    assert got == want
    assert {r["sensor_id"] for r in lifecycle.settled(published(spark, out)).collect()} == {"s1", "s2"}


def test_state_goes_after_the_horizon_and_the_batch_pass_corrects(spark, tmp_path):
    feed, out = Feed(spark, tmp_path / "in"), str(tmp_path)
    feed.put(("a", "s1", 0, 10.0))
    feed.put(("b", "s1", 600, 1.0))
    feed.put(("c", "s1", 610, 1.0))
    q = publish(feed, out, **SHORT)
    assert story(published(spark, out), "s1", 0) == [("PROVISIONAL", 1, 10.0, None), ("FINAL", 1, 10.0, None)]
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # the window of minute 600; that of minute 0 is gone
    feed.put(("late", "s1", 1, 30.0), ("other", "s9", 2, 7.0))  # beyond the horizon: the stream leaves them out
    publish(feed, out, **SHORT)
    before = published(spark, out)
    assert len(story(before, "s1", 0)) == 2
    batch = gold.hourly(feed.table(), metrics=["temperature_c"])
    more = lifecycle.corrections(before, batch, at(600))
    after = lifecycle.merged(before, more)
    assert story(after, "s1", 0)[2:] == [("CORRECTED", 2, 20.0, 2)] and story(after, "s9", 0) == [("CORRECTED", 1, 7.0, None)]
    assert more.count() == 2 and lifecycle.corrections(after, batch, at(600)).count() == 0 == lifecycle.corrections(before, batch, at(59)).count()
    assert lifecycle.merged(after, more).count() == after.count()


def test_lifecycle_refuses_a_horizon_that_is_too_short(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    feed.put(("a", "s1", 0, 1.0))
    with pytest.raises(ValueError, match="horizon"):
        lifecycle.versions(feed.stream(), delay=H, grace=H, horizon=H)


def test_many_rows_of_one_key_are_summed_before_the_shuffle(spark, tmp_path):
    feed = Feed(spark, tmp_path / "in")
    feed.put(*[(f"e{i}", "hot", i % 60, float(i)) for i in range(500)], ("x", "cold", 1, 1.0))
    sums = lifecycle.partial_sums(feed.table().coalesce(1), H, ["temperature_c"]).collect()
    assert sorted((r["sensor_id"], r["n"], r["total"], r["lo"], r["hi"], r["latest"]) for r in sums) == [("cold", 1, 1.0, 1.0, 1.0, at(1)), ("hot", 500, 124750.0, 0.0, 499.0, at(59))]


P = policy.Policy(up=10.0, down=3.0, epochs=2, fast=timedelta(minutes=5), cautious=timedelta(minutes=90), most=timedelta(minutes=60))
SERIES = [1.0, 12.0, 2.0, 11.0, 15.0, 5.0, 2.0, 4.0, 1.0, 3.0, 20.0, None, 20.0, 10.0]
STATES = ["FAST"] * 4 + ["CAUTIOUS"] * 5 + ["FAST"] * 4 + ["CAUTIOUS"]


def test_hysteresis_and_bounds():
    now, seen = policy.Standing(), []
    for phi in SERIES:
        now = now.after(phi, P)
        seen.append(now.state)
    assert seen == STATES
    assert P.delay("FAST") == timedelta(minutes=5) and P.delay("CAUTIOUS") == timedelta(minutes=60)  # never above most
    assert policy.forced(now, "FAST") == policy.Standing(14, "FAST", 0, 0, None)
    for bad in ({"up": 1.0, "down": 1.0}, {"up": 2.0, "down": 1.0, "epochs": 0}, {"up": 2.0, "down": 1.0, "fast": -H}):
        with pytest.raises(ValueError):
            policy.Policy(**bad)
    with pytest.raises(ValueError):
        policy.forced(now, "SLOW")


def test_states_over_a_table_are_the_controllers(spark):
    df = spark.createDataFrame([(k, i, x) for k in ("a", "b") for i, x in enumerate(SERIES if k == "a" else SERIES[::-1])], "src string, i int, phi double").repartition(3)
    got = {(r["src"], r["i"]): (r["state"], r["switched"]) for r in policy.states(df, "i", "phi", P, ["src"]).collect()}
    assert [got["a", i][0] for i in range(len(SERIES))] == STATES
    assert [i for i in range(len(SERIES)) if got["a", i][1]] == [4, 9, 13]
    now = policy.Standing()
    for i, phi in enumerate(SERIES[::-1]):
        now = now.after(phi, P)
        assert got["b", i][0] == now.state


def test_controller_runs_epochs_over_a_stream(spark, tmp_path):
    """FAST, then CAUTIOUS after two bad epochs: the larger delay must not pull the frontier back, nor make a final window provisional again."""
    feed, out, horizon = Feed(spark, tmp_path / "in"), str(tmp_path), timedelta(hours=3)
    control = policy.Controller(spark, P, f"{out}/audit")
    pushed = {}

    def start(delay, floor):
        pushed.update(delay=delay, floor=floor)
        return publish(feed, out, delay=delay, grace=timedelta(0), horizon=horizon, frontier=floor)

    def boundary(a, b):
        return lifecycle.boundary(published(spark, out), a, b, timedelta(0)).count()

    step = lambda phi: control.run_epoch(start, lambda: phi, lambda q: policy.latest_event(q, horizon), boundary)
    feed.put(("a", "s1", 30, 1.0))
    assert step(12.0).state == "FAST"
    feed.put(("b", "s1", 66, 1.0))  # FAST: the window of minute 0 is final at 65
    now = step(12.0)
    assert now.state == "CAUTIOUS" and now.frontier == at(61) and [x[0] for x in story(published(spark, out), "s1", 0)] == ["PROVISIONAL", "FINAL"]
    feed.put(("c", "s1", 10, 3.0))
    now = step(5.0)
    assert pushed == {"delay": timedelta(minutes=60), "floor": at(61)} and now.frontier == at(61)  # 66 less 60 would be minute 6
    assert story(published(spark, out), "s1", 0)[2:] == [("CORRECTED", 2, 2.0, 2)]
    # another controller goes on where this one stood, and the audit has every epoch once
    again = policy.Controller(spark, P, f"{out}/audit")
    assert again.standing == control.standing == policy.Standing(3, "CAUTIOUS", 0, 0, at(61))
    with pytest.raises(FileExistsError):
        feed.put(("d", "s1", 67, 1.0))
        control.standing = policy.Standing(1, "FAST", 0, 0, None)
        step(1.0)
    told = control.records().orderBy("epoch").collect()
    assert [(r["state"], r["next_state"], r["delay_s"], r["next_delay_s"], r["boundary_windows"], r["regression"]) for r in told] == [("FAST", "FAST", 300.0, 300.0, 0, False), ("FAST", "CAUTIOUS", 300.0, 3600.0, 1, False), ("CAUTIOUS", "CAUTIOUS", 3600.0, 3600.0, 0, True)]
    assert tuple(policy.transitions(control.records()).first()) == (3, 1, 1, 1)


def test_copies_inside_the_horizon_go_in_state_and_later_ones_to_the_ledger(spark, tmp_path):
    feed, root = Feed(spark, tmp_path / "in"), str(tmp_path)
    copies = [("a", 0), ("b", 1), ("a", 10), ("a", 20), ("c", 100), ("x", 160), ("y", 170), ("a", 200), ("b", 205), ("a", 210), ("d", 400), ("z", 800), ("w", 900)]
    for i, (e, received) in enumerate(copies):
        feed.put((e, "s1", i, 1.0, received))
    log, store = [], pipeline.SnapshotStore(spark, f"{root}/serving")
    listener = pipeline.ProgressLog(log.append)
    spark.streams.addListener(listener)
    q = windows.deduplicated(feed.stream()).writeStream.queryName("dedup").option("checkpointLocation", f"{root}/ck").foreachBatch(lambda df, i: store.apply(i, df, "dedup")).trigger(availableNow=True).start()
    q.awaitTermination()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(listener)
    progress = spark.read.json(spark.sparkContext.parallelize(log))
    # within an hour of receipt: two copies of a after minute 0 and one after minute 200; those of minutes 200 and 205 come when the state is gone
    account = windows.duplicate_account(progress, "dedup", store.read("processed_events"), feed.table()).first().asDict()
    assert account == {"received": 13, "dropped_in_state": 3, "dropped_late": 0, "events": 8, "counted_by_ledger": 2, "complete": True}
    rows = [x["state_rows"] for x in map(json.loads, log) if x.get("num_input_rows")]
    assert max(rows) <= 6 and rows[-1] <= 2  # of eight keys those of about one horizon
    replay = windows.deduplicated(feed.stream()).writeStream.queryName("dedup").option("checkpointLocation", f"{root}/ck").foreachBatch(lambda df, i: store.apply(i, df, "dedup")).trigger(availableNow=True).start()
    replay.awaitTermination()
    assert {r["event_id"]: r["duplicate_count"] for r in store.read("processed_events").collect()} == {"a": 1, "b": 1, "c": 0, "d": 0, "w": 0, "x": 0, "y": 0, "z": 0}


def run_windows(spark, df, name, path):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


@pytest.mark.parametrize("kind", ["tumbling", "sliding", "sessions"])
def test_windows_equal_the_batch_and_account_for_what_they_drop(spark, tmp_path, kind):
    feed = Feed(spark, tmp_path / "in")
    make = {"tumbling": windows.tumbling, "sliding": windows.sliding, "sessions": lambda df: windows.sessions(df, gap="8 minutes")}[kind]
    feed.put(("a", "s1", 0, 1.0), ("b", "s1", 12, 1.0), ("c", "s2", 3, 1.0))
    feed.put(("d", "s1", 6, 1.0), ("e", "s1", 30, 1.0))  # d joins the sessions of a and b; e moves the watermark to 25
    feed.put(("f", "s2", 31, 1.0))  # Spark leaves out what is behind the watermark of the batch before
    feed.put(("late", "s1", 1, 1.0))
    feed.put(("end", "s3", 1000, 1.0))
    got = run_windows(spark, make(feed.stream()), f"w_{kind}", tmp_path).where("sensor_id <> 's3'")
    timely, every = (make(feed.table().where(F.col("sensor_id") != "s3").where(cond)) for cond in ("event_id <> 'late'", "true"))
    key = lambda df: sorted(map(tuple, df.select("window_start", "window_end", "sensor_id", "n").collect()))
    assert key(got) == key(timely)
    account = {r["sensor_id"]: tuple(r)[1:] for r in windows.window_account(got, every, ["sensor_id"]).collect()}
    times = 2 if kind == "sliding" else 1
    assert account == {"s1": (5 * times, 4 * times, times), "s2": (2 * times, 2 * times, 0)}


def test_sessions_merge(spark, tmp_path):
    rows = [("a", "s1", 0, 1.0), ("b", "s1", 12, 1.0), ("d", "s1", 6, 1.0), ("e", "s1", 30, 1.0)]
    got = windows.sessions(silver(spark, rows), gap="8 minutes").orderBy("window_start").collect()
    assert [(r["window_start"], r["window_end"], r["n"]) for r in got] == [(at(0), at(20), 3), (at(30), at(38), 1)]
    assert LEDGER
