"""Registered queries over the driver's tables, each with SQL that gives the same rows."""

from __future__ import annotations

from . import clicks, events, foreign, graph, history, matching, memory, people, shapes, tasks, validation, vectors

AREAS = (memory, history, vectors, events, graph, tasks, matching, clicks, shapes, validation, people, foreign)


def queries() -> dict:
    return {name: query for area in AREAS for name, query in area.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.SQL.items()}
