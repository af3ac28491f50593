"""Facts proposed by a caller's completion, checked before they reach the ledger."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_PROMPT = 12_000
INSTRUCTION = "List the facts these messages state as a JSON array of objects with entity, relation, value, validFrom (ISO date) and sourceChunk (a chunk id given below). Relations have no spaces. Reply with the array only."
_PROPOSAL = "struct<entity:string,relation:string,value:string,validFrom:string,sourceChunk:string,shape:boolean,raw:string>"


def prompts(chunks: DataFrame, messages: DataFrame, cap: int = MAX_PROMPT) -> DataFrame:
    """``(thread_id, thread_hash, prompt)``: the instruction and each message's chunks, in order.

    Whole trailing messages are left out where the prompt would pass ``cap`` characters. The hash
    covers the ids and texts of all chunks, also of messages left out.
    """
    c = chunks.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", "text"))).alias("cs"))
    m = messages.filter("thread_id is not null").select("message_id", "thread_id", "from_address", "sent_at").join(c, "message_id")
    block = F.concat(F.lit("From "), F.coalesce("from_address", F.lit("")), F.lit(" on "), F.coalesce(F.substring("sent_at", 1, 10), F.lit("")), F.lit(":\n"), F.array_join(F.transform("cs", lambda x: F.concat(F.lit("[chunk "), x["chunk_id"], F.lit("] "), x["text"])), "\n"))
    w = Window.partitionBy("thread_id").orderBy("sent_at", "message_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = m.withColumn("block", block).withColumn("total", F.sum(F.length("block") + 2).over(w)).withColumn("ids", F.array_join(F.transform("cs", lambda x: F.concat(x["chunk_id"], x["text"])), ""))
    kept = F.collect_list(F.when((F.col("total") <= cap - len(INSTRUCTION) - 2) | (F.col("total") == F.length("block") + 2), F.struct("sent_at", "message_id", F.substring("block", 1, cap).alias("block"))))
    return sized.groupBy("thread_id").agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_at", "message_id", F.sha2("ids", 256).alias("h")))), lambda x: x["h"]), ","), 256).alias("thread_hash"),
        F.concat(F.lit(INSTRUCTION + "\n\n"), F.array_join(F.transform(F.array_sort(kept), lambda x: x["block"]), "\n\n")).alias("prompt"),
    )


def read_reply(reply: str | None) -> list[dict] | None:
    """Proposals in a reply, fences taken off; None where it is no JSON array."""
    t = (reply or "").strip()
    if t.startswith("```"):
        t = t.split("\n", 1)[-1].rsplit("```", 1)[0]
    try:
        v = json.loads(t)
    except ValueError:
        return None
    return v if isinstance(v, list) else None


def propose(asked: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """``(thread_id, thread_hash, bad_json, p)`` with one row per proposal; p is NULL for none."""
    keys = ("entity", "relation", "value", "validFrom", "sourceChunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for t, h, prompt in zip(b["thread_id"], b["thread_hash"], b["prompt"]):
                found = read_reply(complete(prompt))
                for p in found or [None]:
                    if p is None:
                        rows.append((t, h, found is None, None))
                        continue
                    good = isinstance(p, dict) and all(isinstance(p.get(k), str) and p[k].strip() for k in keys)
                    rows.append((t, h, False, {**{k: p.get(k) if isinstance(p, dict) and isinstance(p.get(k), str) else None for k in keys}, "shape": good, "raw": json.dumps(p)}))
            yield pd.DataFrame(rows, columns=["thread_id", "thread_hash", "bad_json", "p"])

    return asked.mapInPandas(run, f"thread_id string, thread_hash string, bad_json boolean, p {_PROPOSAL}")


def judge(proposals: DataFrame, chunks: DataFrame, messages: DataFrame, parties: DataFrame) -> DataFrame:
    """Proposals with the first rule each breaks in ``reason`` (NULL if it may be asserted).

    Rules in order: bad_json, bad_shape, bad_date, unknown_chunk, foreign_chunk,
    ungrounded_value, ungrounded_entity, bad_relation. Texts compare without case and with single
    blanks; an entity may be a known party or occur in the chunk or anywhere in the thread.
    """
    squeeze = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+", " ")
    cited = chunks.join(messages.select("message_id", F.col("thread_id").alias("c_thread")), "message_id").select(F.col("chunk_id").alias("cid"), "c_thread", squeeze(F.col("text")).alias("c_text"))
    whole = chunks.join(messages.select("message_id", "thread_id"), "message_id").groupBy("thread_id").agg(F.array_join(F.collect_list(squeeze(F.col("text"))), " ").alias("t_text"))
    known = parties.select(squeeze(F.col("party_id")).alias("pid")).distinct().withColumn("is_party", F.lit(True))
    j = proposals.withColumn("cid", F.col("p.sourceChunk")).withColumn("pid", squeeze(F.col("p.entity"))).join(cited, "cid", "left").join(whole, "thread_id", "left").join(known, "pid", "left")
    day = F.col("p.validFrom")
    reason = (
        F.when(F.col("bad_json"), "bad_json")
        .when(F.col("p").isNull(), "none")
        .when(~F.col("p.shape"), "bad_shape")
        .when(~day.rlike(r"^\d{4}-\d{2}-\d{2}$") | F.try_to_timestamp(day, F.lit("yyyy-MM-dd")).isNull(), "bad_date")
        .when(F.col("c_thread").isNull(), "unknown_chunk")
        .when(F.col("c_thread") != F.col("thread_id"), "foreign_chunk")
        .when(~F.contains(F.col("c_text"), squeeze(F.col("p.value"))), "ungrounded_value")
        .when(F.col("is_party").isNull() & ~F.contains(F.col("c_text"), F.col("pid")) & ~F.contains(F.col("t_text"), F.col("pid")), "ungrounded_entity")
        .when(F.col("p.relation").rlike(r"\s"), "bad_relation")
    )
    return j.select("thread_id", "thread_hash", "p", reason.alias("reason"))
