"""Mixing sources to target shares by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.tokens import DEFAULT, token_count
from postloom.operators.skew import running_sum
from postloom.session import cut


def draw(documents: DataFrame, targets: DataFrame, budget: int | None = None, path: str = DEFAULT, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """(drawn, shares): documents with their repeats, and the shares reached.

    ``drawn`` is (doc_id, source, tokens, repeats); ``shares`` is (source, target_share, weight,
    tokens, actual_share, repeats_allowed, passes) for every target, also those without documents.

    Every pass over a source shuffles it anew by a hash of document and pass. A copy's virtual
    finish time is the source's cumulative tokens up to it over the source's weight; copies of all
    sources are range-sorted by it and cut where the total reaches ``budget``. The default budget
    is the most tokens for which no source needs more than its allowed repeats. Targets without
    documents get nothing and their share goes to the others in proportion (``weight``); sources
    without a target, and NULL sources, are not drawn. Repeated rows of a document count once,
    texts without tokens are not drawn, repeated targets take the first share in order.

    Cumulative sums run over range partitions with carried totals, so one source may hold most
    rows. Only the per-source totals (as many rows as there are targets) are broadcast.
    """
    t = targets.filter("source is not null and target_share > 0").groupBy("source").agg(F.min("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    sized = cut(
        documents.join(F.broadcast(t.select("source")), "source", "left_semi").select("doc_id", "source", token_count("text", path).alias("tokens")).groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens")).filter("tokens > 0")
    )
    have = sized.groupBy("source").agg(F.sum("tokens").alias("have"))
    plan = [r.asDict() for r in t.join(have, "source", "left").orderBy("source").collect()]  # one row per target
    usable = [r for r in plan if r["have"] and (r["max_repeats"] or 0) > 0]
    share = sum(r["target_share"] for r in usable)
    spark = documents.sparkSession
    for r in plan:
        r["weight"] = r["target_share"] / share if r in usable else 0.0
    most = min((r["have"] * r["max_repeats"] / r["weight"] for r in usable), default=0.0)
    total = int(min(most, budget) if budget is not None else most)
    rows = [(r["source"], float(r["target_share"]), float(r["weight"]), int(r["max_repeats"] or 0), int(min(r["max_repeats"], -(-total * r["weight"] // r["have"]) + 1)) if r["weight"] else 0) for r in plan]
    info = spark.createDataFrame(rows, "source string, target_share double, weight double, repeats_allowed int, passes int")
    copies = sized.join(F.broadcast(info.filter("weight > 0")), "source").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes")))).select("doc_id", "source", "tokens", "weight", "pass", F.xxhash64("doc_id", "pass", F.lit(seed)).alias("ord"))
    queued = running_sum(copies, ["source"], [F.asc("pass"), F.asc("ord"), F.asc("doc_id")], "tokens", "served")
    timed = queued.withColumn("finish", F.col("served") / F.col("weight"))
    lined = running_sum(timed, [], [F.asc("finish"), F.asc("source"), F.asc("doc_id"), F.asc("pass")], "tokens", "sent")
    taken = cut(lined.filter(F.col("sent") <= total).groupBy("doc_id", "source", "tokens").agg(F.count("*").cast("int").alias("repeats")))
    reached = taken.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("drawn"))
    all_drawn = taken.agg(F.sum(F.col("tokens") * F.col("repeats")).alias("all"))
    shares = info.join(F.broadcast(reached), "source", "left").crossJoin(F.broadcast(all_drawn)).select("source", "target_share", "weight", F.coalesce("drawn", F.lit(0)).alias("tokens"), (F.coalesce("drawn", F.lit(0)) / F.col("all")).alias("actual_share"), "repeats_allowed", "passes")
    return taken.select("doc_id", "source", "tokens", "repeats"), shares
