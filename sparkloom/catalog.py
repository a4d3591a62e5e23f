"""Registered queries of the library and the DuckDB SQL that each is held against."""

from __future__ import annotations

from .plans import audience, calm, chance, criteria, cuts, direct, doubles, evidence, learners, matching, records, relational, replays, rhythm, schemas, scoring, selections, series, states, texts, timelines, upkeep

_MODULES = (timelines, series, criteria, evidence, scoring, relational, texts, direct, matching, upkeep, replays, selections, audience, schemas, rhythm, chance, cuts, states, calm, learners, records, doubles)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
