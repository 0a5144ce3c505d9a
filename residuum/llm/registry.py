"""Registry of the queries of this subpackage (``opN_<name>``)."""

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
    import corpus_pipeline  # noqa: F401
    from residuum.llm import conversation_queries, license_queries, queries  # noqa: F401
