"""The metric registry: bounds, thresholds and directions of every sensor metric."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Metric:
    """Inclusive bounds, and the alert threshold with its direction (None: never alerts)."""

    name: str
    low: float
    high: float
    threshold: float | None = None
    direction: str | None = None
    alias: str | None = None


# Metrics, their inclusive bounds and their alert rules.
METRICS = (
    Metric("temperature_c", -50.0, 200.0, 35.0, "high", alias="value"),
    Metric("humidity_pct", 0.0, 100.0, 80.0, "high"),
    Metric("co2_ppm", 0.0, 5000.0, 1000.0, "high"),
    Metric("pressure_hpa", 300.0, 1100.0, 950.0, "low"),
    Metric("pm25_ugm3", 0.0, 1000.0, 35.0, "high"),
    Metric("light_lux", 0.0, 200000.0),
)
NAMES = tuple(m.name for m in METRICS)
ALERTABLE = tuple(m for m in METRICS if m.threshold is not None)
# Which metrics each station type reports.
STATIONS = {
    "WEATHER": ("temperature_c", "humidity_pct", "pressure_hpa", "light_lux"),
    "AIR": ("co2_ppm", "pm25_ugm3"),
    "MULTI": NAMES,
}


def rule(name: str) -> Metric:
    """The alert rule of a metric; KeyError for one that has none."""
    for m in ALERTABLE:
        if m.name == name:
            return m
    raise KeyError(f"{name} has no alert rule")
