"""All queries over the driver's tables, each with its DuckDB counterpart."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers fn(spark, sf_dir) -> DataFrame as query `name`, with the SQL of the same result."""

    def add(fn):
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


from . import accuracy, answers, estimators, grades, media, message_logs, records, reports, rewards, samples, sampling, streams, texts, training, validation, validity  # noqa: E402,F401  (they register their queries)
