"""Collects the named queries of the plan modules."""

from __future__ import annotations

from tessellon.plans import audit_plans, lab_plans, serving_plans, time_plans

MODULES = (serving_plans, audit_plans, lab_plans, time_plans)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
