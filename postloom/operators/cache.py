"""Costly functions behind a cache table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from postloom.session import cut


def through(items: DataFrame, cache: DataFrame, keys: list[str], value: str, compute: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(all, fresh): ``(*keys, value)`` of every item, and those that had to be computed.

    Only items without a cached row reach ``compute``, which returns (*keys, value) for the ones
    it could do; what it leaves out stays uncached and is tried again next time. The computed rows
    are written once, so the function runs once per item however often they are read.
    """
    known = cache.select(*keys, value).dropDuplicates(keys)
    misses = items.join(known.select(*keys), keys, "left_anti")
    fresh = cut(compute(misses).select(*keys, value))
    hits = items.select(*keys).distinct().join(known, keys)
    return hits.unionByName(fresh), fresh
