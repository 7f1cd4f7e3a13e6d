"""Every registered query with its DuckDB equivalent, gathered from the plan modules."""

from __future__ import annotations

from . import files, index, jobs, library, media, scalars, search

MODULES = (search.PLANS, library.PLANS, media.PLANS, jobs.PLANS, scalars.PLANS, files.PLANS, index.PLANS)


def queries():
    return {k: f for m in MODULES for k, f in m.queries.items()}


def oracle_sql():
    return {k: s for m in MODULES for k, s in m.oracles.items()}
