"""Queries of this subpackage with their checking SQL."""

from collections.abc import Callable

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None) -> Callable:
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register
