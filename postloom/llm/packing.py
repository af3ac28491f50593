"""Filling containers of fixed capacity by sum-of-squares packing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.llm.tokens import DEFAULT, token_count
from postloom.session import cut

BINS = "grp int, bin bigint, used bigint, items array<struct<doc_id:bigint,part:int,size:bigint>>"


def sum_of_squares(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions, each item placed where the sum of squares grows least.

    The sum runs over all gaps of the squared number of open containers with that gap. Sizes are
    from 0 to ``capacity``; items of size 0 join the first container. Ties go to the tightest
    container, and to an open one before a new one.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[list[int]] = []
    empty: list[int] = []
    for i, s in enumerate(sizes):
        if s == 0:
            empty.append(i)
            continue
        gap = -1
        best = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        live = np.flatnonzero(count[s:]) + s
        if len(live):
            delta = 2 - 2 * count[live] + 2 * count[live - s]
            if live[0] == s:  # a container filled to the brim leaves the count
                delta[0] = 1 - 2 * count[s]
            k = int(delta.argmin())
            if delta[k] <= best:
                gap = int(live[k])
        if gap < 0:
            bins.append([i])
            b, gap = len(bins) - 1, capacity
        else:
            b = open_at[gap].pop()
            count[gap] -= 1
            bins[b].append(i)
        if gap > s:
            open_at[gap - s].append(b)
            count[gap - s] += 1
    if empty:
        if bins:
            bins[0] += empty
        else:
            bins.append(empty)
    return bins


def _join_open(bins: list[list[int]], sizes: list[int], capacity: int) -> list[list[int]]:
    """Put whole containers together while any two fit (best fit, fullest first)."""
    from bisect import bisect_right, insort

    used = [sum(sizes[i] for i in b) for b in bins]
    order = sorted(range(len(bins)), key=lambda b: -used[b])
    gaps: list[tuple[int, int]] = []
    out: list[list[int]] = []
    for b in order:
        k = bisect_right(gaps, (used[b], -1))
        if k < len(gaps):
            g, at = gaps.pop(k)
            out[at] += bins[b]
            if g > used[b]:
                insort(gaps, (g - used[b], at))
        else:
            out.append(list(bins[b]))
            if used[b] < capacity:
                insort(gaps, (capacity - used[b], len(out) - 1))
    return out


def _pack_group(capacity: int):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ord", kind="stable")
        sizes, items = rows["size"].tolist(), rows["items"].tolist()
        bins = _join_open(sum_of_squares(sizes, capacity), sizes, capacity)
        return pd.DataFrame(
            {
                "grp": [int(key[0])] * len(bins),
                "bin": range(len(bins)),
                "used": [sum(sizes[i] for i in b) for b in bins],
                "items": [[x for i in b for x in items[i]] for b in bins],
            }
        )

    return run


def _passed_on(levels: list, groups: int, capacity: int, group_tokens: int) -> int:
    """The fill level up to which containers are packed again; -1 for none.

    ``levels`` are (used, count) of a round. Of ``groups`` groups each passes on four containers, or
    fewer where a group is small, so that the next round has half the tokens at most.
    """
    most = max(1, min(4, group_tokens // (2 * capacity))) * groups
    last, seen, least = -1, 0, min((r["used"] for r in levels), default=capacity)
    for used, n in sorted((r["used"], r["count"]) for r in levels):
        seen += n
        if used > capacity - least or (used * 2 > capacity and seen > most):
            break
        last = used
    return last


def pack(documents: DataFrame, capacity: int = 2048, path: str = DEFAULT, group_tokens: int = 12_000_000, group_rows: int = 100_000, empty_rows: int = 10_000) -> DataFrame:
    """``(container_id, doc_ids, parts, used, free)``: every document in containers of ``capacity``.

    A text is whole in one container unless it has more than ``capacity`` tokens; such a text
    fills containers of its own and only its rest is packed (``parts`` numbers the pieces beside
    ``doc_ids``). Texts without tokens (NULL, empty) have containers of their own, of about
    ``empty_rows`` texts each. Repeated rows of a document count once. NULL ids are left out.

    Documents are packed in groups of about ``group_tokens`` tokens and ``group_rows`` rows by a
    hash of their id, so a task holds a bounded number of (id, size) rows and never a text, whatever
    the sizes. After a round no two containers of a group fit together, so at most one of them is
    half empty. Those, and up to four per group of the emptiest others that one of them still may
    join, are packed again as items, in groups of the same bounds; all others are finished. A round thus
    passes on a bounded number of containers per group, until one group or nothing is left.
    """
    sized = cut(documents.filter("doc_id is not null").select("doc_id", token_count("text", path).alias("n")).groupBy("doc_id").agg(F.max("n").alias("n")))
    size = sized.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1)), F.count(F.when(F.col("n") == 0, 1))).first()
    tokens, rows, empty = (int(x or 0) for x in size)
    item = F.array(F.struct("doc_id", F.col("part").cast("int").alias("part"), F.col("size").cast("long").alias("size")))
    whole = F.floor((F.col("n") - 1) / capacity).cast("int")  # containers filled by a text alone
    pieces = sized.filter("n > 0").select("doc_id", F.explode(F.sequence(F.lit(0), whole)).alias("part"), "n").select("doc_id", "part", F.least(F.col("n") - F.col("part").cast("long") * capacity, F.lit(capacity).cast("long")).alias("size"))
    out = pieces.filter(F.col("size") == capacity).select(F.concat_ws("-", F.lit("w"), "doc_id", "part").alias("container_id"), F.lit(capacity).cast("long").alias("used"), item.alias("items"))
    if empty:
        none = sized.filter("n = 0").select("doc_id", F.lit(0).alias("part"), F.lit(0).alias("size"), F.pmod(F.xxhash64("doc_id"), F.lit(-(-empty // empty_rows))).alias("e"))
        out = out.unionByName(none.groupBy(F.concat_ws("-", F.lit("e"), "e").alias("container_id")).agg(F.flatten(F.collect_list(item)).alias("items")).withColumn("used", F.lit(0).cast("long")))
    todo = pieces.filter(F.col("size") < capacity).select(F.xxhash64("doc_id").alias("key"), F.xxhash64("doc_id", F.lit("order")).alias("ord"), "size", item.alias("items"))
    level = 0
    while rows:
        groups = max(1, -(-tokens // group_tokens), -(-rows // group_rows))
        packed = cut(todo.select(F.pmod("key", F.lit(groups)).cast("int").alias("g"), "ord", "size", "items").groupBy("g").applyInPandas(_pack_group(capacity), BINS))
        last = -1 if groups == 1 else _passed_on(packed.groupBy("used").count().collect(), groups, capacity, group_tokens)  # one row per fill level
        out = out.unionByName(packed.filter(F.col("used") > last).select(F.concat_ws("-", F.lit(f"c{level}"), "grp", "bin").alias("container_id"), "used", "items"))
        again = packed.filter(F.col("used") <= last)
        rows, tokens = (0, 0) if last < 0 else again.agg(F.count("*"), F.coalesce(F.sum("used"), F.lit(0))).first()
        level += 1
        todo = again.select(F.xxhash64("grp", "bin", F.lit(level)).alias("key"), F.xxhash64("grp", "bin").alias("ord"), F.col("used").alias("size"), "items")
    return out.select("container_id", F.transform("items", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("items", lambda x: x["part"]).alias("parts"), "used", (F.lit(capacity) - F.col("used")).alias("free"))


def covered(containers: DataFrame, capacity: int = 2048) -> DataFrame:
    """``(doc_id, parts, sound)``: where each document went, for checks.

    ``parts`` counts its pieces; ``sound`` says that they are numbered from 0 without a gap or a
    repeat and that every container it is in keeps to the capacity.
    """
    each = containers.select(F.explode(F.arrays_zip("doc_ids", "parts")).alias("x"), ((F.col("used") >= 0) & (F.col("free") >= 0) & (F.col("used") + F.col("free") == capacity)).alias("fits"))
    return each.groupBy(F.col("x.doc_ids").alias("doc_id")).agg(F.count("*").alias("parts"), (F.min("fits") & (F.min("x.parts") == 0) & (F.max("x.parts") == F.count("*") - 1) & (F.countDistinct("x.parts") == F.count("*"))).alias("sound"))
