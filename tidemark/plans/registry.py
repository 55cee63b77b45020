"""Registry of queries and their ANSI-SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def query(name: str, sql: str | None = None, ctes: tuple[str, ...] = ()):
    """Register a query; ``sql`` is its oracle on top of the named common tables."""
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = with_ctes(sql, *ctes)
        return fn
    return register


def define_cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = (needs, body.strip())


def with_ctes(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the named common tables and whatever they need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for need in CTES[name][0]:
            visit(need)
        ordered.append(name)

    for name in names:
        visit(name)
    if not ordered:
        return sql.strip()
    parts = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in ordered)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {parts},\n{body[5:]}"
    return f"WITH {parts}\n{body}"


def values(rows, columns: str, alias: str = "v") -> str:
    """A SQL VALUES table from Python rows."""
    def lit(x) -> str:
        if isinstance(x, str):
            return "'" + x.replace("'", "''") + "'"
        return "NULL" if x is None else str(x)

    body = ", ".join("(" + ", ".join(lit(x) for x in r) + ")" for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS {alias}({columns})"


def rnd(expr: str, digits: int) -> str:
    """SQL twin of ``stable_round``."""
    scale = f"{10 ** digits}.0::DOUBLE"
    return f"(floor(({expr})::DOUBLE * {scale} + 0.5::DOUBLE) / {scale})"
