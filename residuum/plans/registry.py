"""Registry of named queries and their SQL oracles.

Each query is ``fn(spark, sf_dir) -> DataFrame`` over the whole test
tables; ``oracle`` is the same result in ANSI SQL (DuckDB dialect) over the
same parquet tables, or ``None`` where SQL cannot express the operator (a
model fit, a stream, an iterative search) -- those are checked by
invariants in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    def wrap(fn):
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLES[key] = oracle
        return fn
    return wrap


def load_all() -> None:
    """Import every plan module so that its queries register."""
    from residuum.plans import (  # noqa: F401
        q_annotate,
        q_catalogue,
        q_curate,
        q_embed,
        q_io,
        q_ml,
        q_search,
        q_metrics,
    )
