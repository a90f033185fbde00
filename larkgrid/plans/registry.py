"""All queries that the package registers, gathered from the modules of this folder."""

from __future__ import annotations

from larkgrid.plans import basics, frames, links, models, points, scenes, series

FLAGSHIP = "telemetry_summary"
MODULES = (series, points, links, frames, scenes, models, basics)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
