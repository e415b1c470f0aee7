"""All registered queries and their SQL, outside the subpackage ``llm``."""

from __future__ import annotations

from tilefold.plans import log_queries, problem_queries, text_queries

MODULES = (problem_queries, text_queries, log_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}
