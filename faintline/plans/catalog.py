"""All registered queries with the SQL that checks them."""

from __future__ import annotations

from faintline.plans import edges, registry, relational, streams, text  # noqa: F401  importing registers

FLAGSHIP = "weak_signal_score"


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict:
    return dict(registry.SQL)
