"""All registered queries of the library and their SQL."""

from __future__ import annotations

from collections.abc import Callable

#: name -> (query, SQL or None); modules add to it by ``query``.
REGISTRY: dict[str, tuple[Callable, str | None]] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its own name."""

    def add(f: Callable) -> Callable:
        REGISTRY[f.__name__] = (f, sql)
        return f

    return add


def _load() -> None:
    from stacklore import plans  # noqa: F401


def queries() -> dict[str, Callable]:
    _load()
    return {k: f for k, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return {k: s for k, (_, s) in REGISTRY.items() if s}
