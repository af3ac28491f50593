"""Queries of this subpackage and their SQL."""

from __future__ import annotations


def collect() -> tuple[dict, dict]:
    """(queries, SQL) of every query module here."""
    from postloom.llm import plans

    return plans.QUERIES, plans.SQL
