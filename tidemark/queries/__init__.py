"""Named queries over the given tables, each with its SQL equivalent where one can be written."""

from __future__ import annotations

from importlib import import_module

MODULES = (
    "kernels", "features", "labels", "rules", "scores", "policy", "metrics", "drift", "composition", "loop", "streams",
    "sources",
)


def load() -> tuple[dict, dict]:
    from tidemark.queries.registry import QUERIES, SQL

    for m in MODULES:
        import_module(f"tidemark.queries.{m}")
    return dict(QUERIES), dict(SQL)
