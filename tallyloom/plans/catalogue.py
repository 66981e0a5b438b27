"""All queries over the driver's tables."""

from __future__ import annotations

from tallyloom.plans import aggregates, connectors, covenants, econometrics, normalization, relational, smoothers, sources, streams, systems, timeseries
from tallyloom.plans.registry import Query

PARTS = (aggregates, timeseries, econometrics, smoothers, systems, covenants, relational, normalization, sources, connectors, streams)


def queries() -> dict[str, Query]:
    return {name: f for p in PARTS for name, f in p.catalogue.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for p in PARTS for name, sql in p.catalogue.sql.items()}
