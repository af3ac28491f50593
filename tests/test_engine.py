"""The engine end to end over small mails."""

import json

import pytest

from postloom.api import Engine
from postloom.functions import vectors
from postloom.sources import mail
from postloom.store import ReadOnlyError

A = b"""Message-ID: <a@x.example>
From: Ann Smith <ann@acme.example>
To: Bob <bob@beta.example>, carl@beta.example
Date: Fri, 05 Jan 2024 10:00:00 +0000
Subject: Terms
Content-Type: text/plain; charset=utf-8

Our payment terms at Acme Corp are NET 30 for invoice INV-2024-0443.

Best regards,
Ann
"""
B = b"""Message-ID: <b@x.example>
From: Bob <bob@beta.example>
To: ann@acme.example
Date: Sat, 06 Jan 2024 10:00:00 +0000
In-Reply-To: <a@x.example>
References: <a@x.example>
Subject: Re: Terms
MIME-Version: 1.0
Content-Type: multipart/mixed; boundary="q"

--q
Content-Type: text/plain

Agreed, we will pay within thirty days.

On Fri, Ann wrote:
> Our payment terms
--q
Content-Type: text/plain; name="note.txt"
Content-Disposition: attachment; filename="note.txt"

Warehouse note about pallets
--q--
"""
C = b"""Message-ID: <c@x.example>
From: Carl <carl@beta.example>
To: ann@acme.example
Date: Sun, 07 Jan 2024 10:00:00 +0000
Subject: Lunch
Content-Type: text/html

<style>p{}</style><p>Lunch &amp; rent &#8364;5</p><br>today
"""


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, str(tmp_path_factory.mktemp("store")), embed=vectors.hash_embed, clock=lambda: "2024-02-01T00:00:00.000Z")
    assert e.eml_bytes(A, B, C, b"Subject: x\n\n  \n") == {"seen": 4, "fresh": 3, "errors": 1}
    return e


def test_reingest_changes_nothing(engine):
    before = engine.store.read("chunks").count()
    assert engine.eml_bytes(A, B)["fresh"] == 0
    assert engine.store.read("chunks").count() == before
    assert engine.sql_filter("ingest_errors").count() == 1


def test_threads_fragments_and_spans(engine):
    m = {r["message_id"]: r for r in engine.store.read("messages").collect()}
    assert m["a@x.example"]["thread_id"] == m["b@x.example"]["thread_id"] != m["c@x.example"]["thread_id"]
    assert m["c@x.example"]["body_text"] == "Lunch & rent €5\n\ntoday"
    for c in engine.store.read("chunks").filter("source_kind = 'message'").collect():
        assert m[c["message_id"]]["body_text"][c["span_start"] : c["span_end"]] == c["text"]
    view = engine.get_thread(m["a@x.example"]["thread_id"]).collect()
    assert [r["message_id"] for r in view] == ["a@x.example", "b@x.example"]
    assert view[1]["attachments"][0]["filename"] == "note.txt" and "payment terms" not in view[1]["new_text"]


def test_search_phrase_attachment_filter_and_source(engine, spark):
    q = spark.createDataFrame([("1", "INV-2024-0443"), ("2", "warehouse pallet"), ("3", "?!")], "query_id string, query string")
    hits = engine.hybrid_search(q, k=3, expand=True).collect()
    best = {r["query_id"]: r for r in sorted(hits, key=lambda r: -r["rank"])}
    top = engine.get_source(best["1"]["chunk_id"]).first()
    assert top["message_id"] == "a@x.example" and bytes(top["raw"]) == A
    assert "Warehouse" in engine.get_source(best["2"]["chunk_id"]).first()["text"]
    only = engine.hybrid_search(q, k=3, source_kind="attachment").collect()
    assert {r["query_id"] for r in only} <= {"1", "2"} and only


def test_facts_and_entities(engine):
    engine.backfill([{"entity": "acme", "relation": "terms", "value_json": '"NET 45"', "valid_from": "2024-03-01", "source_message": "a@x.example"}, {"entity": "acme", "relation": "terms", "value_json": '"NET 30"', "valid_from": "2024-01-05", "source_message": "a@x.example"}])
    assert engine.fact_as_of("acme", "terms", "2024-02-01").first()["value"] == '"NET 30"'
    assert engine.fact_as_of("acme", "terms", "2024-03-01").first()["valid_to"] is None
    told = engine.fact_history("acme", "terms").collect()
    assert len(told) == 3 and {r["source_message"] for r in told} == {"a@x.example"} and len({r["fact_id"] for r in told}) == 3
    assert engine.sql_filter("facts", [{"column": "source_message", "op": "=", "value": "a@x.example"}]).count() == 3
    with pytest.raises(ValueError):
        engine.assert_facts([{"entity": "x", "relation": "r", "value_json": "1", "valid_from": "2024-01-01"}])
    s = engine.suggest_parties().collect()
    assert [r["kind"] for r in s] == ["domain_party"]
    engine.confirm_suggestion(s[0]["suggestion_id"])
    assert engine.resolve("BOB@beta.example").first()["party_id"] == "party:beta.example"
    assert engine.suggest_parties(True).collect()[0]["status"] == "confirmed"
    with pytest.raises(ValueError):
        engine.dismiss_suggestion(s[0]["suggestion_id"])
    assert [r["type"] for r in engine.timeline("party:beta.example").collect()] == ["message"] * 3
    with pytest.raises(ValueError):
        engine.sql_filter("messages", [{"column": "body_text", "op": "=", "value": ""}])


def test_extraction_reasons(engine):
    chunk = engine.store.read("chunks").filter("message_id = 'a@x.example'").first()["chunk_id"]
    other = engine.store.read("chunks").filter("message_id = 'c@x.example'").first()["chunk_id"]
    good = {"entity": "Acme Corp", "relation": "payment_terms", "value": "NET 30", "validFrom": "2024-01-05", "sourceChunk": chunk}
    batch = [good | {"value": ""}, good | {"validFrom": "2024-02-30"}, good | {"sourceChunk": "chk_0"}, good | {"sourceChunk": other}, good | {"value": "NET 99"}, good | {"entity": "Zephyr"}, good | {"relation": "payment terms"}, good]
    reply = json.dumps(batch)
    complete = lambda p, r=reply: r if "payment terms" in p else "nonsense"
    out = engine.extract_facts(complete)
    assert out == {"threads": 2, "skipped": 0, "proposed": 8, "asserted": 1, "rejected": 8}
    reasons = sorted(r["reason"] for r in engine.store.read("fact_extract_rejects").collect())
    assert reasons == sorted(["bad_shape", "bad_date", "unknown_chunk", "foreign_chunk", "ungrounded_value", "ungrounded_entity", "bad_relation", "bad_json"])
    assert engine.extract_facts(complete) == {"threads": 0, "skipped": 2, "proposed": 0, "asserted": 0, "rejected": 0}


def test_reindex_readonly_and_tombstone(engine, spark):
    ids = {r[0] for r in engine.store.read("chunks").select("chunk_id").collect()}
    engine.reindex()
    assert {r[0] for r in engine.store.read("chunks").select("chunk_id").collect()} == ids
    assert engine.reembed() == 0
    ro = Engine(spark, engine.store.root, readonly=True)
    with pytest.raises(ReadOnlyError):
        ro.eml_bytes(A)
    h = engine.store.read("messages").filter("message_id = 'a@x.example'").first()["blob_hash"]
    engine.tombstone(h, "asked")
    assert engine.get_blob(h) is None and not engine.has_blob(h)
    kept = engine.put_blob(b"bytes")
    assert engine.has_blob(kept) and engine.get_blob(kept) == b"bytes" and engine.put_blob(b"bytes") == kept
    assert engine.store.read("chunks").filter(f"blob_hash = '{h}'").count() == 0
    assert engine.store.read("audit_log").count() == 1
    with pytest.raises(KeyError):
        engine.tombstone("nothing", "x")


def test_mbox_and_headers():
    two = b"From a@x Fri Jan  5 10:00:00 2024\nSubject: 1\n\nFrom here on\n>From there\n\nFrom b@x Sat Jan  6 10:00:00 2024\nSubject: 2\n\nx\n"
    parts = mail.split_mbox(two)
    assert len(parts) == 2 and b"From here on\nFrom there" in parts[0]
    assert mail.split_mbox(b"plain") == [b"plain"] and mail.split_mbox(b"") == []
    assert mail.id_list("<a@x> junk <b@x>") == ["a@x", "b@x"] and mail.id_list("a b") == ["a", "b"] and mail.id_list(None) == []
    assert mail.iso("Fri, 05 Jan 2024 10:00:00 +0100") == "2024-01-05T09:00:00.000Z" and mail.iso("x") is None


def test_streaming_folder_equals_batch(spark, tmp_path):
    from postloom.streaming.ingest import watch

    box = tmp_path / "in"
    box.mkdir()
    (box / "a.eml").write_bytes(A)
    (box / "c.EML").write_bytes(C)
    (box / "z.eml").write_bytes(b"Subject: x\n\n \n")
    steps, bad = [], []
    e = Engine(spark, str(tmp_path / "s"), on_progress=lambda *x: steps.append(x), on_error=bad.append)
    watch(e, str(box), str(tmp_path / "ck")).awaitTermination()
    f = Engine(spark, str(tmp_path / "t"))
    f.eml_dir(str(box))
    get = lambda x: sorted(tuple(r) for r in x.store.read("chunks").select("chunk_id", "text", "context").collect())
    assert get(e) == get(f) and len(get(e)) == 2
    assert steps == [("parsed", 3), ("stored", 2), ("threaded", 2), ("indexed", 2)] and [r["reason"] for r in bad] == ["degenerate"]


def test_caches_model_context_and_parsers(spark, tmp_path):
    import io

    from postloom.functions.remote import HttpEmbedder, ModelContext
    from postloom.server import serve

    pdf = b"%PDF-1.4\nstream\nBT (Invoice total) Tj (500) Tj ET\nendstream\n"
    mime = "application/pdf"
    mailed = b"Message-ID: <p@x>\nFrom: a@b.example\nDate: Fri, 05 Jan 2024 10:00:00 +0000\nMIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=q\n\n--q\nContent-Type: text/plain\n\nSee the file please.\n--q\nContent-Type: " + mime.encode() + b"\nContent-Disposition: attachment; filename=a.pdf\n\n" + pdf + b"\n--q--\n"
    calls = tmp_path / "calls"

    def complete(prompt):
        with calls.open("a") as f:
            f.write("x")
        return "  A   note about  a file. " if "See the file" in prompt else ""

    e = Engine(spark, str(tmp_path / "s"), context=ModelContext(complete))
    e.eml_bytes(mailed)
    got = {r["source_kind"]: r for r in e.store.read("chunks").collect()}
    assert got["message"]["context"] == "A note about a file."
    assert got["attachment"]["text"] == "Invoice total 500" and got["attachment"]["context"].startswith("Attachment a.pdf of email from a@b.example")
    assert e.store.read("parse_cache").count() == 1 and calls.read_text() == "xx"
    e.reindex()
    assert calls.read_text() == "xx" and e.store.read("chunks").count() == 2

    ask = [{"jsonrpc": "2.0", "id": 1, "method": "tools/list"}, {"jsonrpc": "2.0", "id": 2, "method": "tools/call", "params": {"name": "hybrid_search", "arguments": {"query": "invoice", "k": 2}}}, {"jsonrpc": "2.0", "id": 3, "method": "tools/call", "params": {"name": "fact_assert", "arguments": {}}}]
    out = io.StringIO()
    serve(e, False, io.StringIO("\n".join(map(json.dumps, ask)) + "\nnot json\n"), out)
    a = [json.loads(x) for x in out.getvalue().splitlines()]
    assert len(a[0]["result"]["tools"]) == 8 and "chk_" in a[1]["result"]["content"][0]["text"] and a[2]["error"]["code"] == -32601 and a[3]["error"]["code"] == -32700

    h = HttpEmbedder("http://127.0.0.1:9", "m", 3, retries=2, sleep=(waits := []).append)
    with pytest.raises(RuntimeError, match="3 attempts"):
        h.embed(["a"])
    assert waits == [0.25, 0.5] and h.wait(0, "7") == 7 and h.wait(20, None) == 30 and h.wait(1, "soon") == 0.5
