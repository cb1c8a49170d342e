"""Registered queries of the premium analytics, each with its oracle SQL."""

from __future__ import annotations

from . import carry, cells, decisions, diagnostics, entities, folds, guards, landing, ledger, lending, notes, panel, payloads, persistence, records, risk, screens, trades, variants

_MODULES = (panel, diagnostics, guards, cells, notes, ledger, folds, decisions, landing, payloads, entities, records, risk, trades, carry, variants, persistence, lending, screens)


def queries() -> dict:
    return {name: f for m in _MODULES for name, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
