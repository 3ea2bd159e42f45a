"""Every query of the library by name, each with the DuckDB SQL that gives the same rows.

A query is declared beside the operators it shows: query(name, sql) registers a function (spark, sf_dir) -> DataFrame.
SQL may name the views of hubflow.adapters; those it uses are put before it as common table expressions.
"""

import importlib
import re

QUERIES: dict = {}
SQL: dict[str, str] = {}

MODULES = ("rollups", "windows", "dates", "formulas", "scores", "network", "ledgers", "audits", "routes", "ingest", "models")


def query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = with_views(sql)
        return f

    return register


def with_views(sql: str) -> str:
    """sql behind the definitions of the views that it uses, directly or through others."""
    from hubflow.adapters import VIEWS

    used: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                need(VIEWS[name])
                used.append(name)

    need(sql)
    views = ",\n".join(f"{n} AS MATERIALIZED ({VIEWS[n]})" for n in used)
    if not views:
        return sql
    body = sql.strip()
    start = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(w)), "")
    return f"{start}{views},\n{body[len(start) :]}" if start else f"WITH {views}\n{body}"


def load() -> None:
    """Import all modules that declare queries."""
    for name in MODULES:
        importlib.import_module(f"hubflow.plans.{name}")
