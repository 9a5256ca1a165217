"""Counters that a pass makes on the side: metrics of rows that flow by, in the same job as the write they belong to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tessellon.sources.files import CORRUPT


def parse_metrics(corrupt: str = CORRUPT) -> dict[str, Column]:
    """Lines, those that couldn't be parsed, and those that could."""
    bad = F.col(corrupt).isNotNull()
    return {"lines": F.count(F.lit(1)), "bad": F.count_if(bad), "good": F.count_if(~bad)}


def call_metrics(**conditions: Column) -> dict[str, Column]:
    """How often a function of the rows is called for a result: rows for which each condition holds."""
    return {name: F.count_if(c) for name, c in conditions.items()}


class Counted:
    """Counters over a table: rows pass through ``rows`` unchanged, and ``counts`` has the sums once an action over them has ended.

    The counters are of one action, and of all its rows only if it reads them all (a limit above may stop early). What
    stands above must not filter below them: the metrics hold for the place in the plan where they were put.
    """

    def __init__(self, rows: DataFrame, name: str, metrics: dict[str, Column]):
        self._seen = Observation(name)
        self.rows = rows.observe(self._seen, *(c.alias(n) for n, c in metrics.items()))

    @property
    def counts(self) -> dict[str, int]:
        """Waits for the action."""
        return self._seen.get


def counted_stream(rows: DataFrame, name: str, metrics: dict[str, Column]) -> DataFrame:
    """Rows of a stream with counters that every batch's progress carries under the name."""
    return rows.observe(name, *(c.alias(n) for n, c in metrics.items()))


class CounterTotals(StreamingQueryListener):
    """Sums of the counters of all batches, by name; a batch that is told of twice counts once."""

    def __init__(self):
        self._batches: dict[tuple[str, int, str], dict[str, int]] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        p = event.progress
        for name, row in p.observedMetrics.items():
            self._batches[str(p.id), p.batchId, name] = row.asDict()

    def onQueryTerminated(self, event):
        pass

    def totals(self, name: str) -> dict[str, int]:
        out: dict[str, int] = {}
        for (_, _, n), row in self._batches.items():
            if n == name:
                for k, v in row.items():
                    out[k] = out.get(k, 0) + (v or 0)
        return out
