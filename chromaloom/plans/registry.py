"""Named queries and, where SQL can say it, their reference SQL over the same tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ctes import CTES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _needed(text: str, found: dict[str, str]) -> None:
    for name, body in CTES.items():
        if name not in found and re.search(rf"\b{name}\b", text):
            _needed(body, found)
            found[name] = body


def with_tables(body: str) -> str:
    """Prefix the body with the model-table definitions it mentions.

    A body may bring its own CTEs by starting with `WITH`.
    """
    found: dict[str, str] = {}
    _needed(body, found)
    parts = [f"{n} AS ({b.strip()})" for n, b in found.items()]
    own = body.strip()
    opening = re.match(r"WITH (RECURSIVE )?", own)
    if opening:
        parts.append(own[opening.end():])
        return opening.group() + ",\n".join(parts)
    return "WITH " + ",\n".join(parts) + "\n" + own if parts else own


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_tables(sql)
        return fn
    return register
