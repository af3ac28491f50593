"""Threads from reply headers with a subject fallback."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.text import bare_subject, subject_key
from postloom.operators.components import components
from postloom.operators.skew import salted_lookup
from postloom.session import cut


def thread_id(root: Column) -> Column:
    return F.concat(F.lit("thr_"), F.substring(F.sha2(root, 256), 1, 16))


def containers(rows: Iterable[tuple[str, list[str], str | None]]) -> dict[str, str]:
    """Root container of each message: (message_id, references, in_reply_to) sorted by id.

    References chain their ids where the later has no parent yet; a message's own parent, the last
    reference or else in_reply_to, replaces any it was given. Links that would close a loop are
    refused. Ids without a message may be roots.
    """
    parent: dict[str, str | None] = {}
    ids = []

    def above(node: str, target: str) -> bool:
        p: str | None = target
        while p is not None:
            if p == node:
                return True
            p = parent.get(p)
        return False

    for mid, refs, irt in rows:
        ids.append(mid)
        prev = None
        for r in refs:
            parent.setdefault(r, None)
            if prev is not None and parent[r] is None and not above(r, prev):
                parent[r] = prev
            prev = r
        parent.setdefault(mid, None)
        own = refs[-1] if refs else irt if irt and irt != mid else None
        if own:
            parent.setdefault(own, None)
            if not above(mid, own):
                parent[mid] = own
    out = {}
    for mid in ids:
        p = mid
        while parent[p] is not None:
            p = parent[p]
        out[mid] = p
    return out


def _roots(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("message_id", key=lambda s: s.map(lambda x: x.encode("utf-16-be")))
    roots = containers((m, list(r), i) for m, r, i in zip(rows["message_id"], rows["refs"], rows["in_reply_to"]))
    return pd.DataFrame({"message_id": list(roots), "root": list(roots.values())})


def headers(messages: DataFrame) -> DataFrame:
    """(message_id, subject, sent_at, in_reply_to, refs): references without blanks and itself."""
    refs = F.filter(F.coalesce(F.from_json("references_json", "array<string>"), F.array().cast("array<string>")), lambda r: (r != "") & (r != F.col("message_id")))
    return messages.dropDuplicates(["message_id"]).select("message_id", F.coalesce("subject", F.lit("")).alias("subject"), "sent_at", "in_reply_to", refs.alias("refs"))


def group_roots(messages: DataFrame) -> DataFrame:
    """``(message_id, root, subject, sent_at, linked)`` by the container rules.

    Messages that share a link are gathered by connected components first, so each container pass
    sees one component's headers only -- ids, no bodies; messages without links never leave Spark.
    """
    h = headers(messages)
    linked = (F.size("refs") > 0) | (F.col("in_reply_to").isNotNull() & (F.col("in_reply_to") != F.col("message_id")))
    h = h.withColumn("linked", linked)
    near = h.filter("linked").select("message_id", F.explode(F.array_union("refs", F.filter(F.array("in_reply_to"), lambda x: x.isNotNull() & (x != "")))).alias("other"))
    comp = components(near, "message_id", "other")
    grouped = salted_lookup(h.select("message_id", "refs", "in_reply_to"), comp.withColumnRenamed("node", "message_id"), "message_id", "left")
    roots = grouped.filter("component is not null").groupBy("component").applyInPandas(_roots, "message_id string, root string")
    return h.join(roots, "message_id", "left").select("message_id", F.coalesce("root", "message_id").alias("root"), "subject", "sent_at", "linked")


def assign(messages: DataFrame) -> DataFrame:
    """``(message_id, root, thread_id)`` with the subject fallback.

    A message alone in its group and without links joins the group of equal subject with the
    smallest root; such messages with one subject and no group join each other under the earliest.
    Empty subjects never match.
    """
    g = group_roots(messages)
    when = F.struct(F.coalesce("sent_at", F.lit("￿")), F.col("message_id"))
    per = Window.partitionBy("root")
    g = g.withColumn("alone", (F.count("*").over(per) == 1) & ~F.col("linked") & (F.col("root") == F.col("message_id")))
    subj = F.coalesce(F.max(F.when(F.col("message_id") == F.col("root"), F.col("subject"))).over(per), F.min_by("subject", when).over(per))
    g = g.withColumn("key", subject_key(subj))
    anchors = g.filter("not alone and key <> ''").groupBy("key").agg(F.min("root").alias("anchor"))
    loners = g.filter("alone and key <> ''").groupBy("key").agg(F.min_by("message_id", when).alias("first"))
    found = g.join(anchors, "key", "left").join(loners, "key", "left")
    root = F.when(F.col("alone") & (F.col("key") != ""), F.coalesce("anchor", "first")).otherwise(F.col("root"))
    return found.select("message_id", root.alias("root"), thread_id(root).alias("thread_id"), "subject", "sent_at")


def affected(messages: DataFrame, fresh: DataFrame) -> DataFrame:
    """``(message_id,)``: the messages whose thread the messages ``fresh`` may change.

    The smallest set with them that is closed under shared links (an id of its own, a parent, a
    reference) and equal subjects: groups are made of links and joined by subjects only, so ``assign``
    over it gives what it would give over all messages. Grown from the fresh ones outwards, in as many rounds
    as the longest way through it.
    """
    h = headers(messages)
    ids = F.array_union(F.array_union(F.array("message_id"), "refs"), F.filter(F.array("in_reply_to"), lambda x: x.isNotNull() & (x != "")))
    key = subject_key("subject")
    tags = h.select("message_id", F.explode(F.concat(F.transform(ids, lambda x: F.concat(F.lit("i"), x)), F.when(key != "", F.array(F.concat(F.lit("s"), key))).otherwise(F.array().cast("array<string>")))).alias("tag"))
    tags = cut(tags)
    seen = cut(fresh.select("message_id").distinct())
    front = seen
    while True:
        reach = tags.join(front, "message_id", "left_semi").select("tag").distinct()
        front = cut(tags.join(reach, "tag", "left_semi").select("message_id").distinct().join(seen, "message_id", "left_anti"))
        if not front.limit(1).count():
            return seen
        seen = cut(seen.unionByName(front))


def thread_rows(assigned: DataFrame) -> DataFrame:
    """``(thread_id, subject, first_at, last_at, messages)`` of assigned messages."""
    when = F.struct(F.coalesce("sent_at", F.lit("￿")), F.col("message_id"))
    return assigned.groupBy("thread_id").agg(
        bare_subject(F.coalesce(F.max(F.when(F.col("message_id") == F.col("root"), F.col("subject"))), F.min_by("subject", when))).alias("subject"),
        F.min("sent_at").alias("first_at"),
        F.max("sent_at").alias("last_at"),
        F.count("*").alias("messages"),
    )
