"""Helpers for writing DuckDB oracle SQL over the derived views."""

from __future__ import annotations

from labelforge.sources.fixtures import with_views


def oracle(views: tuple[str, ...] | list[str], body: str) -> str:
    """Prefix ``body`` with the view CTEs; ``body`` may start with more CTEs
    (``name AS (...), ... SELECT``) or with a plain ``SELECT``."""
    head = with_views(*views)
    body = body.strip()
    if not head:
        return body if body.upper().startswith("SELECT") else "WITH " + body
    if body.upper().startswith("SELECT") or body.upper().startswith("("):
        return head + body
    return head + ", " + body
