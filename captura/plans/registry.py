"""Named queries with their checking SQL."""

from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``fn(spark, sf_dir)`` under a name, with the SQL that must give the same rows."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r(expr: str, digits: int = 4) -> str:
    """Half-even rounding in the checking engine."""
    scale = f"1e{digits}"
    return f"(round_even(({expr}) * {scale}, 0) / {scale})"


def clamp(expr: str) -> str:
    return f"greatest(0e0, least(1e0, {expr}))"
