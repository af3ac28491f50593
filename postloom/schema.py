"""Static schemas of the stored tables and their migration steps."""

from __future__ import annotations

VERSION = 8

TABLES = {
    "blobs": "hash string, size bigint, mime string, created_at string, tombstoned boolean, content binary",
    "blob_sources": "hash string, message_id string, att_index int, kind string, filename string",
    "messages": "message_id string, blob_hash string, thread_id string, subject string, from_name string, from_address string, sent_at string, in_reply_to string, references_json string, body_text string",
    "message_recipients": "message_id string, name string, address string, kind string",
    "attachments": "message_id string, att_index int, filename string, mime string, blob_hash string",
    "threads": "thread_id string, subject string, first_at string, last_at string, messages bigint",
    "fragments": "fragment_id string, message_id string, kind string, span_start int, span_end int, text string",
    "documents": "doc_id string, kind string, root_id string, version int, supersedes string, party_id string, blob_hash string, issued_date string, fields_json string",
    "chunks": "chunk_id string, blob_hash string, chunk_index int, source_kind string, message_id string, span_start int, span_end int, text string, context string, meta_json string",
    "postings": "chunk_id string, gen string, col int, term string, positions array<int>",
    "lengths": "chunk_id string, gen string, message_id string, dl int",
    "embeddings": "chunk_id string, model string, dim int, vector array<double>",
    "facts": "seq bigint, entity string, relation string, value_json string, valid_from string, created_at string, source_chunk string, source_message string",
    "parties": "party_id string, name string, kind string, notes string",
    "party_addresses": "address string, party_id string, person string, from_date string, to_date string",
    "audit_log": "at string, action string, subject string, detail string",
    "ingest_errors": "at string, blob_hash string, reason string, detail string",
    "parse_cache": "blob_hash string, tool string, tool_version string, text string, meta_json string, created_at string",
    "context_cache": "chunk_id string, tool string, tool_version string, context string, created_at string",
    "fact_extract_runs": "thread_id string, tool_version string, thread_hash string, at string, proposed bigint, asserted bigint, rejected bigint",
    "fact_extract_rejects": "at string, thread_id string, tool_version string, reason string, payload_json string",
    "party_suggestion_decisions": "suggestion_id string, status string, decided_at string",
}
#: The column whose hash tells the bucket of a row.
BUCKET_KEYS = {
    "blobs": "hash", "blob_sources": "message_id", "messages": "message_id", "message_recipients": "message_id", "attachments": "message_id", "threads": "thread_id", "fragments": "message_id", "documents": "doc_id", "chunks": "message_id",
    "postings": "term", "lengths": "message_id", "embeddings": "chunk_id", "facts": "entity", "parties": "party_id", "party_addresses": "address", "audit_log": "subject", "ingest_errors": "blob_hash", "parse_cache": "blob_hash", "context_cache": "chunk_id",
    "fact_extract_runs": "thread_id", "fact_extract_rejects": "thread_id", "party_suggestion_decisions": "suggestion_id",
}
DERIVED = ["postings", "lengths", "embeddings", "chunks", "fragments", "threads", "context_cache"]

#: Steps from one schema version to the next; each adds tables; version 8 also fills its two from the chunks.
MIGRATIONS: dict[int, list[str]] = {2: ["ingest_errors"], 3: ["parse_cache"], 4: ["embeddings"], 5: ["context_cache"], 6: ["fact_extract_runs", "fact_extract_rejects"], 7: ["party_suggestion_decisions"], 8: ["postings", "lengths"]}
