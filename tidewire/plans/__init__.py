"""The registered queries: name -> (callable, oracle SQL or None)."""

from __future__ import annotations

from tidewire.plans import activity, changes, entities, landing, texts, timestamps


def _modules():
    return (activity, entities, texts, changes, landing, timestamps)


def core_queries() -> dict:
    return {name: fn for m in _modules() for name, fn in m.QUERIES.items()}


def core_sql() -> dict:
    return {name: sql for m in _modules() for name, sql in m.SQL.items()}
