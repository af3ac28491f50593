"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from postloom.session import cut, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)``: the smallest node of each component, for every node of an edge.

    Large-star / small-star rounds over the edge table: each round links a node's larger
    neighbours to its smallest one, then its smaller neighbours and itself to the smallest. The
    number of rounds is logarithmic in practice; a round is one window over the node, and edge
    tables are cut by a checkpoint. Self loops and repeated edges are harmless; NULL ends are
    ignored. The end is decided by the number of edges and two independent sums of 64-bit hashes of them.
    """
    e = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    first = cut(e.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct())

    def written(t: DataFrame) -> tuple[DataFrame, tuple]:
        watch = Observation()
        table = cut(t, watch, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("v", "u")).alias("x"))
        return table, (watch.get["n"], watch.get["h"], watch.get["x"])

    def near_least(t: DataFrame, both: bool) -> DataFrame:
        rows = t.select("u", "v")
        if both:
            rows = rows.unionByName(t.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # the least neighbour by a partial aggregate, not by gathering a hub's neighbours
        least = rows.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        return rows.join(least, "u")

    e, seen = first.filter("u <> v"), None
    nodes = first.select(F.col("u").alias("node")).unionByName(first.select(F.col("v").alias("node"))).distinct()
    while True:
        large = near_least(e, True).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = near_least(large, False)
        old, (e, now) = e, written(small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        release(old)
        if now == seen:
            break
        seen = now
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").withColumn("component", F.coalesce("component", "node"))
