"""The topology as a service: supervision with signals and a heartbeat, draining and settling, the hourly run under a lease."""

from __future__ import annotations

import json
import signal
import threading
import time
from collections.abc import Callable
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession

from tessellon.operators import gold, serving
from tessellon.schemas import GOLD
from tessellon.sources.folder import Folder


def stop(queries: list) -> None:
    for q in queries:
        if q.isActive:
            q.stop()


def beat(spark: SparkSession, path: str, queries: list, now: datetime | None = None) -> None:
    """A one-line file with the time and the names of the active queries; no Spark job is needed."""
    root, _, name = path.rpartition("/")
    Folder(spark, root).put(name, {"ts": (now or datetime.now(timezone.utc)).isoformat(), "active": [q.name for q in queries if q.isActive]})


def serve(spark: SparkSession, queries: list, heartbeat: str | None = None, beat_seconds: float = 10.0, poll_seconds: float = 1.0, stop_session: bool = False) -> str | None:
    """Watch endless queries until one ends or the process is asked to stop (SIGTERM, SIGINT); then all are stopped.

    Looks every poll_seconds, and refreshes the heartbeat every beat_seconds. Raises what a query failed with; returns the name
    of a query that ended by itself, None after a signal. Signals are taken in the main thread only, and given back.
    """
    asked, before = threading.Event(), {}
    if threading.current_thread() is threading.main_thread():
        before = {s: signal.signal(s, lambda *_: asked.set()) for s in (signal.SIGTERM, signal.SIGINT)}
    due = 0.0
    try:
        while not asked.is_set():
            for q in queries:
                if not q.isActive:
                    if (error := q.exception()) is not None:
                        raise error
                    return q.name
            if heartbeat is not None and time.monotonic() >= due:
                beat(spark, heartbeat, queries)
                due = time.monotonic() + beat_seconds
            asked.wait(poll_seconds)
        return None
    finally:
        for s, handler in before.items():
            signal.signal(s, handler)
        stop(queries)
        if heartbeat is not None:
            beat(spark, heartbeat, queries)
        if stop_session:
            spark.stop()


Offsets = dict[str, dict[str, int]]


def end_offsets(progress: str) -> Offsets:
    """Topic, partition and offset up to which a query has come, from the JSON of a progress record."""
    out: Offsets = {}
    for s in json.loads(progress).get("sources", []):
        end = s.get("endOffset")
        end = json.loads(end) if isinstance(end, str) else end
        for topic, parts in (end or {}).items():
            if isinstance(parts, dict):
                out.setdefault(topic, {}).update(parts)
    return out


def committed(query) -> Offsets:
    """As end_offsets, of the query's last progress; empty before the first."""
    return end_offsets(query.lastProgress.json) if query.lastProgress else {}


def lag(latest: Offsets, done: Offsets) -> dict[tuple[str, str], int]:
    """Records of each partition that are still to be read; a partition the query has never named is behind by all it has."""
    return {(t, p): max(0, n - done.get(t, {}).get(p, 0)) for t, parts in latest.items() for p, n in parts.items()}


def settle(latest: Callable[[], Offsets], done: Callable[[], Offsets], signature: Callable[[], object], quiet_seconds: float = 30.0, timeout_seconds: float = 600.0, poll_seconds: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> dict:
    """Wait until every partition is read up to what the source has, then until what lies downstream keeps its signature for quiet_seconds.

    The source may go on writing: its latest offsets are asked for each time, and a partition that falls behind again
    starts the quiet time anew. Returns a report: drained, settled, seconds of both, lag by partition, the signature and its changes.
    """
    began = clock()
    drained_at = quiet_from = seen = None
    changes = 0
    while True:
        now, behind = clock(), {k: v for k, v in lag(latest(), done()).items() if v}
        if behind:
            quiet_from = None
        else:
            drained_at = now if drained_at is None else drained_at
            found = signature()
            if quiet_from is None or found != seen:
                changes += seen is not None and found != seen
                quiet_from, seen = now, found
        quiet = quiet_from is not None and now - quiet_from >= quiet_seconds
        if quiet or now - began >= timeout_seconds:
            return {
                "drained": not behind, "settled": quiet, "drain_seconds": None if drained_at is None else drained_at - began, "seconds": now - began,
                "lag": {f"{t}-{p}": n for (t, p), n in sorted(behind.items())}, "signature": seen, "changes": changes,
            }
        sleep(poll_seconds)


class Lease:
    """The right to run, held by one owner for a time. Each grant has a fencing number above all before it, so a holder that was taken for dead can be told from its successor."""

    def __init__(self, spark: SparkSession, root: str):
        self.folder = Folder(spark, root)

    def _last(self) -> tuple[int, dict]:
        """Highest fencing number, and its record with the latest expiry and whether it was released."""
        names = self.folder.names()
        grants = [n for n in names if n.startswith("grant-")]
        if not grants:
            return 0, {}
        fence = int(grants[-1][6:])
        more = [n for n in names if n.startswith(f"more-{fence:012d}-")]
        record = self.folder.get(grants[-1])
        if more:
            record["until"] = self.folder.get(more[-1])["until"]
        return fence, record | {"released": f"freed-{fence:012d}" in names, "renewed": len(more)}

    def acquire(self, owner: str, seconds: float, now: datetime) -> int | None:
        """The fencing number of a new grant; None while another one is in force, or where another owner was quicker."""
        fence, last = self._last()
        if last and not last["released"] and datetime.fromisoformat(last["until"]) > now:
            return None
        try:
            self.folder.put_once(f"grant-{fence + 1:012d}", {"owner": owner, "until": (now + timedelta(seconds=seconds)).isoformat()})
        except FileExistsError:
            return None
        return fence + 1

    def holds(self, fence: int, now: datetime) -> bool:
        last, record = self._last()
        return last == fence and not record["released"] and datetime.fromisoformat(record["until"]) > now

    def renew(self, fence: int, seconds: float, now: datetime) -> bool:
        """Extend a grant that is still in force."""
        if not self.holds(fence, now):
            return False
        self.folder.put_once(f"more-{fence:012d}-{self._last()[1]['renewed'] + 1:06d}", {"until": (now + timedelta(seconds=seconds)).isoformat()})
        return True

    def release(self, fence: int) -> None:
        try:
            self.folder.put_once(f"freed-{fence:012d}", {})
        except FileExistsError:
            pass


class Fenced(RuntimeError):
    """A writer's grant is no longer the last one; nothing of its result is visible."""


class GoldStore:
    """Hourly aggregates as whole versions. A marker, written last and once, makes a version visible and carries the writer's fencing number; a version whose number is below an earlier one's never counts."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.markers = spark, root.rstrip("/"), Folder(spark, f"{root.rstrip('/')}/markers")

    def _current(self) -> tuple[int, dict | None]:
        """Number of the last marker, and the record of the version in force."""
        names, force = self.markers.names(), None
        for record in map(self.markers.get, names):
            if force is None or record["fence"] >= force["fence"]:
                force = record
        return int(names[-1]) if names else 0, force

    def read(self) -> DataFrame:
        force = self._current()[1]
        return self.spark.read.schema(GOLD).parquet(f"{self.root}/{force['part']}") if force else self.spark.createDataFrame([], GOLD)

    def commit(self, rows: DataFrame, fence: int, holds: Callable[[], bool]) -> int:
        """Write a version and make it visible if the grant still holds then. Raises Fenced otherwise."""
        last, force = self._current()
        part = f"v={last + 1}-{fence}"
        rows.select(*(c.split()[0] for c in GOLD.split(", "))).write.mode("overwrite").parquet(f"{self.root}/{part}")
        if not holds() or (force and force["fence"] > fence):
            raise Fenced(f"grant {fence} ended before its result was written")
        try:
            self.markers.put_once(f"{last + 1:012d}", {"fence": fence, "part": part})
        except FileExistsError as e:
            raise Fenced(f"another writer made version {last + 1}") from e
        return last + 1


def run_hourly(silver: DataFrame, store: GoldStore, lease: Lease, owner: str, now: Callable[[], datetime], seconds: float = 1800.0, grace_seconds: int = 60, compute: Callable[..., DataFrame] = gold.hourly) -> dict:
    """The last full hour's aggregates, once: skipped while another owner's grant is in force, fenced if it was given to another meanwhile."""
    start, end = gold.previous_hour(now(), grace_seconds)
    fence = lease.acquire(owner, seconds, now())
    told = {"owner": owner, "start": start.isoformat(), "end": end.isoformat(), "fence": fence}
    if fence is None:
        return told | {"status": "busy"}
    fresh = gold.computed(compute(silver, start, end), now())
    try:
        version = store.commit(serving.replace_keys(store.read(), fresh, ["sensor_id", "hour_start", "metric"]), fence, lambda: lease.holds(fence, now()))
    except Fenced as e:
        return told | {"status": "fenced", "reason": str(e)}
    lease.release(fence)
    return told | {"status": "done", "version": version}
