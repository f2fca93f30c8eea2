"""Registered queries of the core library and their SQL."""

from __future__ import annotations

from sparkkb.operators import answers, build, chunking, context, imports, links, platform, problems, reading, retrieval, search, tree

MODULES = [problems, search, retrieval, tree, links, imports, build, context, chunking, reading, platform, answers]


def queries() -> dict:
    return {name: f for m in MODULES for name, f in m.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.oracle_sql().items()}
