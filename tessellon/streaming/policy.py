"""A two-state policy for the watermark delay, decided between epochs of a query.

FAST publishes early with a small delay, CAUTIOUS waits longer. A metric of lateness decides after each epoch: CAUTIOUS after
``epochs`` epochs in a row at or above ``up``, FAST after as many at or below ``down``; anything between keeps the state, so
noise about a threshold doesn't make it flap. Hard bounds hold whatever the policy asks for: no delay above ``most``.

Between epochs the query ends and starts anew with the same checkpoint, so its state and Spark's watermark stay; the
frontier (what counts as complete) is handed on as a floor and never falls, though a larger delay alone would pull it back.
Windows that are over under one of the two delays only are compared with the batch result at each switch. Every epoch writes an
audit record under a name that can exist once, and a controller that is restarted goes on from the last one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessellon.sources.folder import Folder

FAST, CAUTIOUS = "FAST", "CAUTIOUS"
AUDIT = "epoch bigint, state string, next_state string, phi double, high_run bigint, low_run bigint, delay_s double, next_delay_s double, frontier_before timestamp, frontier_after timestamp, boundary_windows bigint, regression boolean"


@dataclass(frozen=True)
class Policy:
    """Thresholds of the metric, epochs in a row that a switch takes, the delays of the states, and the bound that none may exceed."""

    up: float
    down: float
    epochs: int = 3
    fast: timedelta = timedelta(minutes=5)
    cautious: timedelta = timedelta(minutes=30)
    most: timedelta = timedelta(hours=1)

    def __post_init__(self):
        if not self.down < self.up or self.epochs < 1 or self.fast < timedelta(0) or self.most < timedelta(0):
            raise ValueError("down must be below up, a switch takes an epoch at least, and delays aren't negative")

    def delay(self, state: str) -> timedelta:
        return min(self.cautious if state == CAUTIOUS else self.fast, self.most)


@dataclass(frozen=True)
class Standing:
    """What the controller knows before an epoch: its number, the state, how many epochs in a row were high or low, and the frontier."""

    epoch: int = 0
    state: str = FAST
    high: int = 0
    low: int = 0
    frontier: datetime | None = None

    def after(self, phi: float | None, policy: Policy, frontier: datetime | None = None) -> Standing:
        """The standing after an epoch with this metric. An epoch without a metric ends both runs; the frontier never falls."""
        high = self.high + 1 if phi is not None and phi >= policy.up else 0
        low = self.low + 1 if phi is not None and phi <= policy.down else 0
        state = CAUTIOUS if high >= policy.epochs else FAST if low >= policy.epochs else self.state
        reached = max((t for t in (self.frontier, frontier) if t is not None), default=None)
        return Standing(self.epoch + 1, state, high, low, reached)


def states(epochs: DataFrame, order: str, phi: str, policy: Policy, by=()) -> DataFrame:
    """epochs with the state that holds after each (column state) and whether it switched there: the same rule, as windows over a table."""
    w = Window.partitionBy(*by).orderBy(order)
    last = w.rowsBetween(1 - policy.epochs, 0)
    whole = F.count(phi).over(last) == policy.epochs
    signal = F.when(whole & (F.min(phi).over(last) >= policy.up), CAUTIOUS).when(whole & (F.max(phi).over(last) <= policy.down), FAST)
    rows = epochs.withColumn("_signal", signal)
    rows = rows.withColumn("state", F.coalesce(F.last("_signal", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(FAST))).drop("_signal")
    return rows.withColumn("switched", F.col("state") != F.lag("state", 1, FAST).over(w))


class Controller:
    """Runs a query in epochs and decides the delay of each."""

    def __init__(self, spark: SparkSession, policy: Policy, audit: str):
        self.spark, self.policy, self.folder = spark, policy, Folder(spark, audit)
        self.standing = self._resumed()

    def records(self) -> DataFrame:
        """The audit, an epoch a row."""
        return self.spark.read.schema(AUDIT).json(self.folder.root) if self.folder.names() else self.spark.createDataFrame([], AUDIT)

    def _resumed(self) -> Standing:
        names = self.folder.names()
        if not names:
            return Standing()
        last = self.folder.get(names[-1])
        front = last["frontier_after"] and datetime.fromisoformat(last["frontier_after"]).astimezone(timezone.utc).replace(tzinfo=None)
        return Standing(last["epoch"] + 1, last["next_state"], last["high_run"], last["low_run"], front)

    def run_epoch(self, start: Callable[[timedelta, datetime | None], object], measure: Callable[[], float | None], latest: Callable[[object], datetime | None], boundary: Callable[[datetime, datetime], int] | None = None) -> Standing:
        """One epoch, and the standing after it.

        start(delay, floor) starts the query, which ends by itself (availableNow) or is stopped; latest(query) is the latest
        event time it has seen; measure() is the epoch's metric; boundary(a, b) settles and counts the windows between two
        frontiers. Another controller that has noted the same epoch wins: this one raises FileExistsError.
        """
        before, policy = self.standing, self.policy
        delay = policy.delay(before.state)
        query = start(delay, before.frontier)
        query.awaitTermination()
        top, phi = latest(query), measure()
        front = None if top is None else top - delay
        after = before.after(phi, policy, front)
        following = policy.delay(after.state)
        switched = top is not None and following != delay
        windows = boundary(after.frontier, top - following) if switched and boundary is not None else 0
        text = lambda t: None if t is None else f"{t.isoformat(timespec='milliseconds')}+00:00"
        record = {"epoch": before.epoch, "state": before.state, "next_state": after.state, "phi": phi, "high_run": after.high, "low_run": after.low, "delay_s": delay.total_seconds(), "next_delay_s": following.total_seconds()}
        record |= {"frontier_before": text(before.frontier), "frontier_after": text(after.frontier), "boundary_windows": windows, "regression": before.frontier is not None and front is not None and front < before.frontier}
        self.folder.put_once(f"epoch-{before.epoch:09d}.json", record)
        self.standing = after
        return after


def latest_event(query, horizon: timedelta) -> datetime | None:
    """The latest event time that a query has seen, from the watermark in its last progress, which stands a horizon behind it."""
    marks = [p["eventTime"].get("watermark") for p in query.recentProgress]
    known = [datetime.fromisoformat(m.replace("Z", "+00:00")).astimezone(timezone.utc).replace(tzinfo=None) for m in marks if m and not m.startswith("1970-01-01T00:00:00")]
    return max(known) + horizon if known else None


def forced(standing: Standing, state: str) -> Standing:
    """An operator's own choice of state: both runs begin anew; bounds still hold."""
    if state not in (FAST, CAUTIOUS):
        raise ValueError(f"no state is called {state}")
    return replace(standing, state=state, high=0, low=0)


def transitions(audit: DataFrame) -> DataFrame:
    """One row: epochs, switches, switches to CAUTIOUS, and epochs in which Spark's watermark stood behind the frontier."""
    switched = F.col("state") != F.col("next_state")
    return audit.agg(F.count("*").alias("epochs"), F.count_if(switched).alias("switches"), F.count_if(switched & (F.col("next_state") == CAUTIOUS)).alias("to_cautious"), F.count_if("regression").alias("regressions"))
