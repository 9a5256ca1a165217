"""Spark session with the settings the engine expects."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "false",  # malformed telemetry turns into nulls with a reason, not into failed jobs
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def get_spark(app: str = "tessellon", master: str | None = None, **settings) -> SparkSession:
    """A session in UTC with adaptive execution; the cluster's own settings stay unless named here."""
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | {k.replace("__", "."): str(v) for k, v in settings.items()})
    return (builder.master(master) if master else builder).getOrCreate()


def explained(df, mode: str = "formatted") -> str:
    """The plan of a DataFrame as text: after a run the one that adaptive execution chose."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()
