"""A query for each operator over the test tables, with SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixtures import CTE, Fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, ctes: str = ""):
    """Register a function of ``Fixtures``; ``sql`` selects from the fixtures' common table expressions."""

    def add(f: Callable[[Fixtures], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Fixtures(spark, sf_dir))
        if sql is not None:
            SQL[name] = f"WITH RECURSIVE {CTE}{', ' + ctes if ctes else ''} {sql}"
        return f

    return add


def r6(c: str | Column = "x", name: str = "x") -> Column:
    """Rounded to 6 digits, without a negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(name)


def s6(expr: str, name: str = "x") -> str:
    return f"round({expr}, 6) + 0.0 AS {name}"


def replayed(*terms: str, seed: int) -> str:
    """The SQL of ``structure.replayable``."""
    out = str((seed * 48271 + 11) % 2147483647)
    for t in terms:
        x = f"((({out} + ({t})::BIGINT % 2147483647 + 1) * 16807) % 2147483647)"
        square = f"({x} * {x} % 2147483647)"
        out = f"({square} * {square} % 2147483647 * {x} % 2147483647)"
    return out


from . import algebra, graphs, logs, schedules, storage  # noqa: E402, F401
