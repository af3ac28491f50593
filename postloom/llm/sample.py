"""Bounded samples that do not depend on the order of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def sampled(rows: DataFrame, size: int) -> list[Row]:
    """The ``size`` different rows of least hash, in its order; copies count once."""
    keyed = rows.select(F.xxhash64(*rows.columns).alias("_h"), *rows.columns)
    # hashes alone are ordered, so no partition sends more than ``size`` numbers
    last = keyed.select("_h").distinct().orderBy("_h").limit(size).agg(F.max("_h")).first()[0]
    if last is None:
        return []
    picked = keyed.filter(F.col("_h") <= last).distinct().orderBy("_h", *rows.columns).limit(size)
    return picked.select(*rows.columns).collect()
