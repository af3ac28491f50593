"""Joins and running sums that hold when one key has a large share of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.session import cut, parallelism


def heavy_keys(df: DataFrame, key: str, share: float = 0.02) -> list:
    """Keys that may hold more than ``share`` of the rows; at most about 1/share of them.

    One pass without a shuffle (frequent-items counters of bounded size). Only the layout of a
    join depends on the answer, never its result.
    """
    found = df.select(F.col(key).alias("k")).stat.freqItems(["k"], share).first()
    return sorted(k for k in (found[0] or []) if k is not None)


def salted_lookup(left: DataFrame, right: DataFrame, key: str, how: str = "left", salts: int = 16) -> DataFrame:
    """Join ``left`` with ``right`` (one row per key at most) on ``key``; hot keys are spread.

    Rows of ``left`` whose key is hot get one of ``salts`` salts, and the matching right row is
    repeated once per salt. NULL keys match nothing and are spread as well instead of meeting in
    one partition. ``how`` is left, inner, left_semi or left_anti.
    """
    hot = heavy_keys(left, key)
    rowhash = F.xxhash64(*[F.col(c) for c in left.columns])
    salt = F.when(F.col(key).isNull() | F.col(key).isin(hot), F.pmod(rowhash, F.lit(salts)).cast("int")) if hot else F.when(F.col(key).isNull(), F.pmod(rowhash, F.lit(salts)).cast("int"))
    a = left.withColumn("_salt", F.coalesce(salt, F.lit(0)))
    zero = F.array(F.lit(0))
    many = F.sequence(F.lit(0), F.lit(salts - 1))
    b = right.withColumn("_salt", F.explode(F.when(F.col(key).isin(hot), many).otherwise(zero)) if hot else F.lit(0))
    return a.join(b, [key, "_salt"], how).drop("_salt")


def running_sum(df: DataFrame, group: list[str], order: list[Column], value: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of the group up to and including this one.

    Rows are range-partitioned by group and order, summed inside each partition, and shifted by
    the totals of the partitions before; a group of any size is spread over many tasks. ``order``
    must be total. The shifts are one row per partition boundary, hence the broadcast is bounded
    by the number of partitions.
    """
    n = parallelism(df.sparkSession)
    names = [F.col(g) for g in group]
    placed = cut(df.repartitionByRange(n, *names, *order).withColumn("_pid", F.spark_partition_id()))
    w = Window.partitionBy("_pid", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = placed.withColumn(out, F.sum(value).over(w))
    totals = placed.groupBy("_pid", *group).agg(F.sum(value).alias("_t"))
    g = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    shifts = (
        totals.withColumn("_n", F.count("*").over(g))
        .filter("_n > 1")
        .withColumn("_shift", F.sum("_t").over(g.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
        .select("_pid", *group, "_shift")
    )
    keys = ["_pid", *group]
    cond = None
    shifts = shifts.select(*[F.col(k).alias(f"_r{k}") for k in keys], "_shift")
    for k in keys:
        c = F.col(k).eqNullSafe(F.col(f"_r{k}"))
        cond = c if cond is None else cond & c
    joined = local.join(F.broadcast(shifts), cond, "left")
    return joined.withColumn(out, F.col(out) + F.coalesce(F.col("_shift"), F.lit(0))).drop("_pid", "_shift", *[f"_r{k}" for k in keys])
