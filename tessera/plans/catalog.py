"""All queries of the library on the driver tables, and their SQL."""

from __future__ import annotations

from tessera.plans import desk, knowledge, ledger, media, newsroom, routes, wires


def queries() -> dict:
    return media.QUERIES | knowledge.QUERIES | routes.QUERIES | newsroom.QUERIES | desk.QUERIES | wires.QUERIES | ledger.QUERIES


def oracle_sql() -> dict[str, str]:
    return media.SQL | knowledge.SQL | routes.SQL | newsroom.SQL | desk.SQL | wires.SQL | ledger.SQL
