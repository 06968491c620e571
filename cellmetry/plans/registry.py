"""Registry of queries with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
CHECKS: dict[str, str] = {}

# Views shared by the check SQL, in order of use: name -> (needed views, text).
VIEWS: dict[str, tuple[list[str], str]] = {}


def view(name: str, needs: list[str], text: str) -> None:
    VIEWS[name] = (needs, text)


def _collect(names: list[str], seen: list[str]) -> list[str]:
    for n in names:
        _collect(VIEWS[n][0], seen)
        if n not in seen:
            seen.append(n)
    return seen


def check(needs: list[str], body: str, *extra: tuple[str, str]) -> str:
    """A WITH statement of the needed views, further named parts and the body."""
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in _collect(needs, [])]
    parts += [f"{n} AS ({text})" for n, text in extra]
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = sql
        return run

    return keep


def r6(column: Column | str) -> Column:
    return F.round(column, 6)


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: r6(c) for c in columns})


def sq(expression: str) -> str:
    """Six digits in the check SQL; adding zero drops the sign of a rounded -0."""
    return f"(round({expression}, 6) + 0.0)"
