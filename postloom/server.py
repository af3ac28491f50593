"""Tools over standard input and output, one JSON-RPC message per line.

``python -m postloom.server FOLDER [--write]`` serves the store in FOLDER: eight read tools, and
four that write if asked to.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from typing import IO

from postloom.api import Engine

_STR = {"type": "string"}
_SEARCH = ("from_address", "party_id", "thread_id", "after", "before", "source_kind", "mime")


def _plain(v):
    if hasattr(v, "asDict"):
        return {k: _plain(x) for k, x in v.asDict().items() if x is not None}
    if isinstance(v, (bytes, bytearray)):
        return {"bytes": len(v)}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def tools(e: Engine, write: bool = False) -> dict[str, tuple[str, dict, Callable]]:
    """name -> (description, properties, function of the arguments)."""

    def rows(df, none: str | None = None):
        out = [_plain(r) for r in df.collect()]
        return out if out or none is None else none

    def search(a: dict):
        q = e.spark.createDataFrame([("q", a["query"])], "query_id string, query string")
        hits = e.hybrid_search(q, a.get("k", 10), a.get("dedupe", True), a.get("expand") == "thread", **{k: a[k] for k in _SEARCH if k in a})
        return rows(hits.drop("query_id", "rrf", "overlap", "recency", "coherence").orderBy("rank"))

    def guarded(f: Callable) -> Callable:
        def run(a: dict):
            try:
                f(a["suggestion_id"])
                return {"ok": True, "suggestion_id": a["suggestion_id"]}
            except (KeyError, ValueError) as x:
                return f"error: {x}"

        return run

    def assert_fact(a: dict):
        if not a.get("source_chunk") and not a.get("source_message"):
            return "error: give source_chunk or source_message"
        e.assert_facts([{**a, "value_json": json.dumps(a["value"])}])
        return rows(e.fact_as_of(a["entity"], a["relation"], a["valid_from"]))

    def map_entity(a: dict):
        e.add_party(a["party_id"], a["name"], a.get("kind", "company"))
        e.map_address(a["address"], a["party_id"], a.get("person"), a.get("from_date"), a.get("to_date"))
        return {"ok": True, "party_id": a["party_id"], "address": a["address"]}

    text = lambda *names: {n: _STR for n in names}
    out = {
        "hybrid_search": ("Search chunks of mail; hits cite chunk ids.", {**text("query", "expand", *_SEARCH), "k": {"type": "integer"}, "dedupe": {"type": "boolean"}}, search),
        "sql_filter": ("Rows of a table under simple conditions.", {**text("table"), "where": {"type": "array"}, "order_by": {"type": "object"}, "limit": {"type": "integer"}}, lambda a: rows(e.sql_filter(a["table"], a.get("where"), a.get("order_by"), a.get("limit", 50)))),
        "get_thread": ("Messages of a thread with their new text.", text("thread_id"), lambda a: rows(e.get_thread(a["thread_id"]), "thread not found")),
        "get_source": ("Text and origin of a cited chunk.", text("chunk_id"), lambda a: rows(e.get_source(a["chunk_id"]), "source not found")),
        "get_entity_timeline": ("Facts, documents and messages of a party in order.", text("party_id", "after", "before"), lambda a: rows(e.timeline(a["party_id"], a.get("after"), a.get("before")))),
        "fact_as_of": ("Value believed for a day.", text("entity", "relation", "date"), lambda a: rows(e.fact_as_of(a["entity"], a["relation"], a["date"]), "no fact")),
        "fact_history": ("Every belief held, also given-up ones.", text("entity", "relation"), lambda a: rows(e.fact_history(a["entity"], a["relation"]))),
        "suggest_parties": ("Proposed parties, same persons and moves.", {"include_decided": {"type": "boolean"}}, lambda a: rows(e.suggest_parties(a.get("include_decided", False)))),
    }
    if write:
        out |= {
            "fact_assert": ("Assert a fact with its source.", text("entity", "relation", "value", "valid_from", "source_chunk", "source_message"), assert_fact),
            "entity_map": ("Add a party and map an address to it.", text("party_id", "name", "kind", "address", "person", "from_date", "to_date"), map_entity),
            "confirm_party_suggestion": ("Apply a suggestion.", text("suggestion_id"), guarded(e.confirm_suggestion)),
            "dismiss_party_suggestion": ("Put a suggestion aside.", text("suggestion_id"), guarded(e.dismiss_suggestion)),
        }
    return out


def serve(e: Engine, write: bool = False, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    """Answer requests until the input ends."""
    known = tools(e, write)
    for line in source:
        if not line.strip():
            continue
        try:
            ask = json.loads(line)
        except ValueError:
            print(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "no JSON"}}), file=sink, flush=True)
            continue
        method, params, answer = ask.get("method"), ask.get("params") or {}, {}
        if "id" not in ask:
            continue
        if method == "initialize":
            answer["result"] = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "postloom", "version": "0.1.0"}}
        elif method == "tools/list":
            answer["result"] = {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p}} for n, (d, p, _) in known.items()]}
        elif method == "tools/call" and params.get("name") in known:
            try:
                value = known[params["name"]][2](params.get("arguments") or {})
                answer["result"] = {"content": [{"type": "text", "text": value if isinstance(value, str) else json.dumps(value, default=str)}]}
            except Exception as x:  # noqa: BLE001
                answer["result"] = {"isError": True, "content": [{"type": "text", "text": f"error: {x}"}]}
        else:
            answer["error"] = {"code": -32601, "message": f"unknown {method} {params.get('name', '')}".strip()}
        print(json.dumps({"jsonrpc": "2.0", "id": ask["id"], **answer}), file=sink, flush=True)


if __name__ == "__main__":
    from postloom.functions.vectors import hash_embed
    from postloom.session import local_session

    serve(Engine(local_session(), sys.argv[1], readonly="--write" not in sys.argv, embed=hash_embed), "--write" in sys.argv)
