"""The streaming topology: source to Bronze, Bronze to Silver and Quarantine, Silver to the serving tables."""

from __future__ import annotations

import json
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tessellon.operators import layers, serving
from tessellon.schemas import ALERTS, LATEST, LEDGER
from tessellon.sources.files import bronze_stream, silver_stream
from tessellon.streaming import service

TABLES = {"sensor_latest": LATEST, "alerts": ALERTS, "processed_events": LEDGER}
KEYS = {"sensor_latest": ["sensor_id"], "alerts": ["event_id", "rule_id"], "processed_events": ["event_id"]}


class SnapshotStore:
    """Serving tables as Parquet parts, and a marker for each version, written last under a new name, that lists the version's parts.

    A batch writes a part with the rows of its own keys only; of each key the row in the last part that has it counts. The
    first part, the base, is filtered by the keys of the batch or of the later parts, so it is neither shuffled nor
    written while those are small. After MOST_PARTS batches the later parts become one, together with the base
    when they have come to a share of its size, so what a batch writes doesn't grow with all events ever seen.

    A part's files are sorted by the table's first key column, each a range of its own, and the marker tells every file's
    range. A batch opens the files alone whose range holds one of its keys: where ids grow with time, few of the stored ones.

    The highest marker names the version that readers see, so a batch becomes visible as a whole or not at all, and a
    failure between any two steps leaves the version before it in force. A marker tells the streaming query and its batch;
    a batch that this query applied before is a no-op, so a replay after a failure neither doubles counters nor loses rows.
    A query with a new checkpoint is another one: its batches are applied from its own first.
    """

    #: Parts that a version has at most, and how many times larger than all others the base must be to stay out of a merge.
    MOST_PARTS, BASE_SHARE = 16, 4

    def __init__(self, spark: SparkSession, root: str, keep: int = 2):
        self.spark, self.root, self.keep = spark, root.rstrip("/"), keep
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _markers(self) -> list[int]:
        at = self._path(f"{self.root}/_versions")
        names = [x.getPath().getName() for x in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted(int(n) for n in names if n.isdecimal())

    def current(self) -> int:
        """The version in force, -1 before the first."""
        return max(self._markers(), default=-1)

    def _state(self, version: int) -> dict:
        """What a marker holds: the last batch of each query, the parts, base first, and the key range of each file of each part."""
        empty = {"applied": {}, "parts": [], "ranges": {}}
        return empty if version < 0 else empty | json.loads(self.spark.read.text(f"{self.root}/_versions/{version}", wholetext=True).first()[0])

    def applied(self) -> dict[str, int]:
        """The last batch of each query, as the version in force has it."""
        return self._state(self.current())["applied"]

    def read(self, table: str, version: int | None = None, keys: DataFrame | None = None) -> DataFrame:
        """The rows of a version; with keys (that have the table's first key column) those of the files that may hold one of them."""
        state = self._state(self.current() if version is None else version)
        return self._rows(table, state["parts"], None if keys is None else self._files(table, state, keys))

    def _part(self, table: str, part: str, files: list[str] | None = None) -> DataFrame:
        at = f"{self.root}/v={part}/{table}"
        if files is not None and not files:
            return self.spark.createDataFrame([], TABLES[table])
        return self.spark.read.schema(TABLES[table]).parquet(*([at] if files is None else [f"{at}/{f}" for f in files]))

    def _files(self, table: str, state: dict, keys: DataFrame) -> dict[str, list[str]]:
        """For each part whose ranges are known the files that can hold one of the keys: one small aggregate, a number a file at most."""
        known = {p: state["ranges"][p][table] for p in state["parts"] if table in state["ranges"].get(p, {})}
        key = F.col(KEYS[table][0])

        def hit(ranges):
            """The file, counted from 1, whose range the key falls in."""
            place = F.size(F.filter(F.lit([lo for _, lo, _ in ranges]), lambda lo: lo <= key))
            return F.when((place > 0) & (key <= F.get(F.lit([hi for _, _, hi in ranges]), place - 1)), place)

        asked = [F.collect_set(hit(r)).alias(f"f{i}") for i, r in enumerate(known.values()) if r]
        found = keys.agg(*asked).first().asDict() if asked else {}
        return {p: [r[n - 1][0] for n in sorted(found.get(f"f{i}", []))] for i, (p, r) in enumerate(known.items())}

    def _rows(self, table: str, parts: list[str], files: dict[str, list[str]] | None = None) -> DataFrame:
        """The row of each key in the last of the parts that has the key."""
        if not parts:
            return self.spark.createDataFrame([], TABLES[table])
        base, *others = [self._part(table, p, (files or {}).get(p)) for p in parts]
        if not others:
            return base
        later = reduce(DataFrame.unionByName, (x.withColumn("_part", F.lit(i)) for i, x in enumerate(others)))
        later = serving.newest(later, KEYS[table], ["_part"]).drop("_part")
        return base.join(later.select(*KEYS[table]), KEYS[table], "left_anti").select(*base.columns).unionByName(later)

    def _write(self, rows: DataFrame, table: str, part: str) -> list[list[str]]:
        """Write a table's rows of a part in ranges of the first key column; name, first and last key of each file, in order."""
        at, key = f"{self.root}/v={part}/{table}", KEYS[table][0]
        rows.repartitionByRange(key).sortWithinPartitions(key).write.mode("overwrite").parquet(at)
        told = self.spark.read.schema(TABLES[table]).parquet(at).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"))
        return sorted(([r["file"], r["lo"], r["hi"]] for r in told.collect() if r["lo"] is not None), key=lambda r: r[1].encode())

    def _merged(self, parts: list[str], name: str, ranges: dict) -> list[str]:
        """The parts of the same rows, fewer if there are more than MOST_PARTS; ranges gets those of a new part."""
        if len(parts) <= self.MOST_PARTS:
            return parts
        base, *others = [self._fs.getContentSummary(self._path(f"{self.root}/v={p}")).getLength() for p in parts]
        first = 1 if base > self.BASE_SHARE * sum(others) else 0
        ranges[name] = {table: self._write(self._rows(table, parts[first:]), table, name) for table in TABLES}
        return [*parts[:first], name]

    def _mark(self, version: int, state: dict) -> None:
        """Write a marker under another name and rename it, which makes the version the one in force."""
        made, to = self._path(f"{self.root}/_versions/.{version}"), self._path(f"{self.root}/_versions/{version}")
        out = self._fs.create(made, True)
        out.write(json.dumps(state).encode())
        out.close()
        if not self._fs.rename(made, to):
            raise RuntimeError(f"version {version} is there already: another writer uses {self.root}")

    def _forget(self) -> None:
        """Delete the versions before the last ``keep``, and the parts that no other version has."""
        markers = self._markers()
        old, last = markers[: -self.keep], markers[-self.keep :]
        used = {p for m in last for p in self._state(m)["parts"]}
        for m in old:
            for p in set(self._state(m)["parts"]) - used:
                self._fs.delete(self._path(f"{self.root}/v={p}"), True)
            self._fs.delete(self._path(f"{self.root}/_versions/{m}"), True)

    def apply(self, batch_id: int, silver: DataFrame, query_id: str = "") -> int | None:
        """Apply a Silver micro-batch: latest, then alerts, then the ledger, then the conflict count against the new ledger. Returns the conflicts, None for a replay."""
        now = self.current()
        state = self._state(now)
        if batch_id <= state["applied"].get(query_id, -1):
            return None
        batch = silver.withColumnsRenamed({"event_time_utc": "event_time", "received_at_utc": "received_at"}).persist()
        part = str(now + 1)

        def stored(table: str, fresh: DataFrame) -> DataFrame:
            """The stored rows of the keys in fresh."""
            return self.read(table, now, fresh).join(fresh.select(*KEYS[table]).distinct(), KEYS[table], "left_semi")

        try:
            fired, own = serving.alerts(batch), {}
            own["sensor_latest"] = self._write(serving.upsert_latest(stored("sensor_latest", batch), batch), "sensor_latest", part)
            own["alerts"] = self._write(serving.insert_alerts(stored("alerts", fired), fired), "alerts", part)
            own["processed_events"] = self._write(serving.upsert_ledger(stored("processed_events", batch), batch), "processed_events", part)
            conflicts = serving.payload_conflicts(self._part("processed_events", part), batch).count()
            ranges = state["ranges"] | {part: own}
            parts = self._merged([*state["parts"], part], f"{part}-merged", ranges)
            self._mark(now + 1, {"applied": state["applied"] | {query_id: batch_id}, "parts": parts, "ranges": {p: ranges[p] for p in parts if p in ranges}})
            self._forget()
            return conflicts
        finally:
            batch.unpersist()


def append(df: DataFrame, path: str, checkpoint: str, name: str, **trigger):
    return df.writeStream.format("parquet").outputMode("append").queryName(name).option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "5 seconds"})).start()


def start(spark: SparkSession, source: DataFrame, root: str, **trigger) -> list:
    """All four queries, each with a checkpoint of its own. With availableNow they must run one after another: see drain()."""
    return [f() for f in _stages(spark, source, root, trigger)]


def _stages(spark, source, root, trigger):
    ck = f"{root}/_checkpoints"
    store = SnapshotStore(spark, f"{root}/serving")
    yield lambda: append(layers.bronze(source), f"{root}/bronze", f"{ck}/q1", "q1", **trigger)
    yield lambda: append(layers.silver(bronze_stream(spark, f"{root}/bronze")), f"{root}/silver", f"{ck}/q2a", "q2a", **trigger)
    yield lambda: append(layers.quarantine(bronze_stream(spark, f"{root}/bronze")), f"{root}/quarantine", f"{ck}/q2b", "q2b", **trigger)
    yield lambda: (
        silver_stream(spark, f"{root}/silver").writeStream.queryName("q3").option("checkpointLocation", f"{ck}/q3")
        .foreachBatch(lambda df, i: store.apply(i, df, df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "")).trigger(**(trigger or {"processingTime": "5 seconds"})).start()
    )


def drain(spark: SparkSession, source: DataFrame, root: str) -> SnapshotStore:
    """Run the topology over all there is, layer by layer, and stop."""
    for stage in _stages(spark, source, root, {"availableNow": True}):
        stage().awaitTermination()
    return SnapshotStore(spark, f"{root}/serving")


def supervise(spark: SparkSession, queries: list, poll_seconds: float = 1.0) -> None:
    """Wait until any query ends, looking every poll_seconds, then stop all of them; raises what ended it."""
    service.serve(spark, queries, poll_seconds=poll_seconds)


stop = service.stop


def heartbeat(spark: SparkSession, path: str, queries: list) -> None:
    """A one-line file with the time and the queries that are active, written anew on each call; serve() refreshes it."""
    service.beat(spark, path, queries)


def watermark_lag(at: str, mark: str | None) -> dict:
    """A query's watermark, and how far it stands behind the clock: a lag that keeps growing says that the query doesn't keep up. Nulls where there is none yet."""
    if not mark or mark.startswith("1970-01-01T00:00:00"):
        return {"watermark": None, "watermark_lag_s": None}
    now, then = (datetime.fromisoformat(x.replace("Z", "+00:00")) for x in (at, mark))
    return {"watermark": mark, "watermark_lag_s": (now - then).total_seconds()}


class ProgressLog(StreamingQueryListener):
    """A record per micro-batch: time, query, batch, rows, duration, offsets, sink, state and what it dropped, observed counters. write gets each as a JSON line."""

    def __init__(self, write):
        self.write = write

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        record = {"ts": p.timestamp, "query": p.name, "batch_id": p.batchId, "num_input_rows": p.numInputRows, "duration_ms": p.durationMs.get("triggerExecution"), "sink": p.sink.description}
        record["sources"] = [{"description": s["description"], "start_offset": s.get("startOffset"), "end_offset": s.get("endOffset")} for s in json.loads(p.json)["sources"]]
        record["state_rows"] = sum(s.numRowsTotal for s in p.stateOperators)
        record["dropped_late"] = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        record["dropped_duplicates"] = sum(s.customMetrics.get("numDroppedDuplicateRows", 0) for s in p.stateOperators)
        record |= watermark_lag(p.timestamp, p.eventTime.get("watermark"))
        record["observed"] = {name: row.asDict() for name, row in p.observedMetrics.items()}
        self.write(json.dumps(record, default=str))

    def onQueryTerminated(self, event):
        if event.exception:
            self.write(json.dumps({"query": str(event.id), "error": event.exception[:500]}))


def windowed(events: DataFrame, time: str = "event_time_utc", width: str = "10 minutes", late: str = "5 minutes", keys=("sensor_id",)) -> DataFrame:
    """Counts per tumbling event-time window with a watermark; windows has sliding ones and sessions too."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
