"""Registered queries of the library and their SQL."""

from __future__ import annotations

from . import explored, extra, more, screens, sequences, verified

_PARTS = (sequences, screens, more, extra, explored, verified)


def queries() -> dict:
    return {k: v for p in _PARTS for k, v in p.queries().items()}


def oracle_sql() -> dict:
    return {k: v for p in _PARTS for k, v in p.SQL.items()}
