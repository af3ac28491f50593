"""Checked filters: search filters and the table filter of the public API."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.functions.text import mime_prefix

# Columns each table shows to callers.
EXPOSED = {
    "messages": ["message_id", "thread_id", "subject", "from_name", "from_address", "sent_at", "blob_hash"],
    "threads": ["thread_id", "subject", "first_at", "last_at"],
    "documents": ["doc_id", "kind", "root_id", "version", "supersedes", "party_id", "issued_date", "fields_json"],
    "facts": ["fact_id", "entity", "relation", "value_json", "valid_from", "valid_to", "created_at", "expired_at", "source_chunk", "source_message"],
    "attachments": ["message_id", "att_index", "filename", "mime", "blob_hash"],
    "parties": ["party_id", "name", "kind"],
    "ingest_errors": ["id", "at", "blob_hash", "reason", "detail"],
}
_OPS = {"=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "like": lambda c, v: F.lower(c).like(str(v).lower())}


def table_filter(df: DataFrame, table: str, where: list[dict] | None = None, order_by: dict | None = None, limit: int | None = 50) -> DataFrame:
    """Rows of an exposed table under AND-ed conditions ``{column, op, value}``.

    Unknown tables, columns and operators raise ValueError. ``limit`` is clamped to 1..500.
    """
    if table not in EXPOSED:
        raise ValueError(f"unknown table {table}")
    cols = EXPOSED[table]
    out = df
    for w in where or []:
        if w["column"] not in cols:
            raise ValueError(f"unknown column {w['column']}")
        if w["op"] not in _OPS:
            raise ValueError(f"unknown operator {w['op']}")
        out = out.filter(_OPS[w["op"]](F.col(w["column"]), w["value"]))
    out = out.select(*[c for c in cols if c in df.columns])
    if order_by:
        if order_by["column"] not in cols:
            raise ValueError(f"unknown column {order_by['column']}")
        c = F.col(order_by["column"])
        out = out.orderBy(c.desc() if order_by.get("dir") == "desc" else c.asc())
    return out if limit is None else out.limit(max(1, min(500, int(limit))))


def search_filter(chunks: DataFrame, messages: DataFrame, recipients: DataFrame | None = None, mappings: DataFrame | None = None, blobs: DataFrame | None = None, **f) -> DataFrame:
    """Chunk keys that pass: from_address, thread_id, after, before, source_kind, party_id, mime.

    ``after`` is inclusive, ``before`` exclusive, on ISO text; NULL dates fail both. A party owns
    its addresses whatever their window.
    """
    m = messages.dropDuplicates(["message_id"]).select("message_id", "from_address", "thread_id", "sent_at")
    c = chunks.join(m, "message_id", "left")
    if "from_address" in f:
        c = c.filter(F.col("from_address") == f["from_address"])
    if "thread_id" in f:
        c = c.filter(F.col("thread_id") == f["thread_id"])
    if "after" in f:
        c = c.filter(F.col("sent_at") >= f["after"])
    if "before" in f:
        c = c.filter(F.col("sent_at") < f["before"])
    if "source_kind" in f:
        c = c.filter(F.col("source_kind") == f["source_kind"])
    if "party_id" in f:
        own = mappings.filter(F.col("party_id") == f["party_id"]).select(F.lower("address").alias("address")).distinct()
        touched = m.select("message_id", F.lower("from_address").alias("address")).unionByName(recipients.select("message_id", F.lower("address").alias("address")))
        c = c.join(touched.join(own, "address", "left_semi").select("message_id").distinct(), "message_id", "left_semi")
    if "mime" in f:
        c = c.join(blobs.filter(mime_prefix(F.col("mime"), F.lit(f["mime"]))).select(F.col("hash").alias("blob_hash")), "blob_hash", "left_semi")
    return c.select("chunk_id")
