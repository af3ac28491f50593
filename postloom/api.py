"""Facade: ingest, index, search, ledger, entities over one store."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions import mail as rules
from postloom.functions import text, vectors
from postloom.functions.remote import context_prompt
from postloom.operators import cache, entities, extract, filters, ledger, search, threads
from postloom.operators.skew import running_sum
from postloom.session import cut, scratch
from postloom.sources import mail
from postloom.store import ReadOnlyError, Store


class Engine:
    """One store and the operators over it; every read returns a DataFrame.

    ``embed`` maps a text column to a vector column (``model`` names it), ``context`` maps a
    chunk frame to a context column or is a ``ModelContext``, ``parsers`` maps a mime type to a function from bytes to
    (text, meta). All are optional; without ``embed`` search is lexical and deterministic.
    ``on_progress`` hears the step of an ingest and its number of messages, ``on_error`` each file set
    aside, ``on_reject`` each proposal that is refused (rows come to the driver one partition at a time).
    """

    def __init__(self, spark: SparkSession, root: str, readonly: bool = False, embed: Callable | None = None, model: str = "hash-64", context: Callable | None = None, parsers: dict | None = None, clock: Callable[[], str] | None = None, on_progress: Callable[[str, int], None] | None = None, on_error: Callable[[dict], None] | None = None, on_reject: Callable[[dict], None] | None = None):
        self.spark, self.store, self.embed, self.model, self.context = spark, Store(spark, root, readonly), embed, model, context
        self.parsers = {"application/pdf": mail.pdf_text} | (parsers or {})
        self.on_progress, self.on_error, self.on_reject = on_progress, on_error, on_reject
        self.now = clock or (lambda: datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.000Z"))
        if not readonly and 0 < self.store.opened_as < 8:
            self._index_terms(self.store.read("chunks"))

    # ---- ingest -----------------------------------------------------------------------------
    def eml_bytes(self, *messages: bytes) -> dict:
        return self._ingest(self.spark.createDataFrame([(bytearray(m), f"{i:012d}", len(m)) for i, m in enumerate(messages)], "content binary, ord string, length bigint"))

    def eml_file(self, path: str) -> dict:
        return self._ingest(mail.single(self.spark, path))

    def eml_dir(self, path: str) -> dict:
        return self._ingest(mail.folder(self.spark, path))

    def mbox_file(self, path: str) -> dict:
        return self._ingest(mail.mbox(self.spark, path))

    def _tell(self, step: str, n: int) -> None:
        if self.on_progress:
            self.on_progress(step, n)

    def _ingest(self, raw: DataFrame) -> dict:
        """Store new messages, set bad ones aside, rethread and index; the same bytes change nothing."""
        if self.store.readonly:
            raise ReadOnlyError("the store is read-only")
        with scratch():
            return self._store_mail(raw)

    def _store_mail(self, raw: DataFrame) -> dict:
        at = self.now()
        p = cut(mail.parsed(raw))
        good, bad = p.filter("error is null"), p.filter("error is not null")
        self._tell("parsed", p.count())
        known = self.store.read("messages").select("message_id", "blob_hash")
        # of several versions of a message the last by path counts
        last = good.join(known, ["message_id", "blob_hash"], "left_anti").groupBy("message_id").agg(F.max("ord").alias("ord"))
        fresh = cut(good.join(last, ["message_id", "ord"], "left_semi").dropDuplicates(["message_id"]))
        n_fresh = fresh.count()
        body = F.when((F.col("body_text") == "") & F.col("html").isNotNull(), text.html_text("html")).otherwise(F.col("body_text"))
        if n_fresh:
            ids = fresh.select("message_id")
            atts = fresh.select("message_id", F.inline("attachments"))
            blobs = fresh.select(F.col("blob_hash").alias("hash"), "size", F.lit("message/rfc822").alias("mime"), "content").unionByName(atts.select(F.sha2("content", 256).alias("hash"), F.length("content").cast("bigint").alias("size"), "mime", "content"))
            self._put_blobs(blobs, at)
            self.store.merge("blob_sources", fresh.select(F.col("blob_hash").alias("hash"), "message_id", F.lit(-1).alias("att_index"), F.lit("message").alias("kind"), F.lit("").alias("filename")).unionByName(atts.select(F.sha2("content", 256).alias("hash"), "message_id", "att_index", F.lit("attachment").alias("kind"), "filename")), ["message_id", "att_index"])
            self.store.merge("messages", fresh.select("message_id", "blob_hash", F.lit(None).cast("string").alias("thread_id"), "subject", "from_name", "from_address", "sent_at", "in_reply_to", F.to_json("refs").alias("references_json"), body.alias("body_text")), ["message_id"])
            self._replace("message_recipients", fresh, fresh.select("message_id", F.inline("recipients")))
            self._replace("attachments", fresh, atts.select("message_id", "att_index", "filename", "mime", F.sha2("content", 256).alias("blob_hash")))
            self._tell("stored", n_fresh)
            self.rethread(ids)
            self._tell("threaded", n_fresh)
            self.index(ids)
            self._tell("indexed", n_fresh)
        errors = bad.select(F.lit(at).alias("at"), "blob_hash", F.col("error").alias("reason"), F.substring("detail", 1, 500).alias("detail"))
        once = errors.filter("blob_hash is not null").dropDuplicates(["blob_hash", "reason"]).join(self.store.read("ingest_errors").select("blob_hash", "reason"), ["blob_hash", "reason"], "left_anti")
        n_bad = bad.count()
        if n_bad:
            told = cut(once.unionByName(errors.filter("blob_hash is null")))
            self.store.append("ingest_errors", told)
            self._put_blobs(bad.filter("content is not null").select(F.col("blob_hash").alias("hash"), "size", F.lit("application/octet-stream").alias("mime"), "content"), at)
            for r in told.toLocalIterator() if self.on_error else ():
                self.on_error(r.asDict())
        return {"seen": p.count(), "fresh": n_fresh, "errors": n_bad}

    def _put_blobs(self, blobs: DataFrame, at: str) -> None:
        """Add the blobs whose hash is new."""
        new = blobs.dropDuplicates(["hash"]).withColumn("created_at", F.lit(at)).withColumn("tombstoned", F.lit(False))
        self.store.append("blobs", new.join(self.store.read("blobs").select("hash"), "hash", "left_anti"))

    def put_blob(self, data: bytes, mime: str = "application/octet-stream") -> str:
        """Store bytes under their SHA-256 and return it; known bytes change nothing."""
        if self.store.readonly:
            raise ReadOnlyError("the store is read-only")
        hash_ = hashlib.sha256(data).hexdigest()
        self._put_blobs(self.spark.createDataFrame([(hash_, len(data), mime, bytearray(data))], "hash string, size bigint, mime string, content binary"), self.now())
        return hash_

    def has_blob(self, hash_: str) -> bool:
        """True if the bytes are stored and not erased."""
        return bool(self.store.read("blobs").filter((F.col("hash") == hash_) & ~F.col("tombstoned")).select("hash").limit(1).count())

    def _replace(self, name: str, scope: DataFrame, rows: DataFrame) -> None:
        self.store.merge(name, rows, ["message_id"], scope)

    # ---- derived tables ---------------------------------------------------------------------
    def rethread(self, fresh: DataFrame | None = None) -> None:
        """Threads from the stored set; the result does not depend on the order of arrival.

        With ``fresh`` (column ``message_id``) only the messages those may touch are read and written,
        with the same result.
        """
        with scratch():
            m = self.store.read("messages")
            if fresh is not None:
                m = cut(m.join(threads.affected(m, fresh), "message_id", "left_semi"))
            a = cut(threads.assign(m))
            old = cut(m.select("thread_id").filter("thread_id is not null").unionByName(a.select("thread_id")).distinct())
            moved = m.join(a.select("message_id", F.col("thread_id").alias("_t")), "message_id").filter("not thread_id <=> _t").drop("thread_id").withColumnRenamed("_t", "thread_id")
            self.store.merge("messages", cut(moved), ["message_id"])
            if fresh is None:
                self.store.write("threads", threads.thread_rows(a))
            else:
                self.store.merge("threads", threads.thread_rows(a), ["thread_id"], old)

    def index(self, ids: DataFrame | None = None) -> None:
        """Fragments, chunks and vectors of the given messages (all by default)."""
        m = self.store.read("messages")
        scope = m.select("message_id") if ids is None else ids.select("message_id").distinct()
        todo = m.join(scope, "message_id", "left_semi")
        frg = todo.select("message_id", F.inline(rules.fragments_of("body_text"))).withColumn("fragment_id", F.concat(F.lit("frg_"), F.substring(F.sha2("message_id", 256), 1, 16), F.lit("_"), F.col("n").cast("string")))
        frg = cut(frg)
        self._replace("fragments", todo, frg)
        new = frg.filter("kind = 'new'").select("message_id", F.col("span_start").alias("base"), F.inline(rules.chunk_spans_of("text"))).select("message_id", (F.col("base") + F.col("span_start")).alias("a"), (F.col("base") + F.col("span_end")).alias("b"))
        n = F.row_number().over(Window.partitionBy("message_id").orderBy("a")) - 1
        order = F.when(F.col("kind") == "to", 0).when(F.col("kind") == "cc", 1).otherwise(2)
        to = self.store.read("message_recipients").groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(order.alias("o"), F.col("address").alias("a")))), lambda x: x["a"]), ", ").alias("rcpt"))
        head = todo.join(to, "message_id", "left").select("message_id", "blob_hash", "body_text", "subject", "from_address", "sent_at", "rcpt")
        c = new.join(head, "message_id").withColumn("chunk_index", n)
        c = c.select(F.concat_ws("_", F.lit("chk"), "blob_hash", "chunk_index").alias("chunk_id"), "blob_hash", "chunk_index", F.lit("message").alias("source_kind"), "message_id", F.col("a").alias("span_start"), F.col("b").alias("span_end"), F.col("body_text").substr(F.col("a") + 1, F.col("b") - F.col("a")).alias("text"), F.lit("").alias("filename"), "from_address", "rcpt", "sent_at", "subject")
        chunks = c.unionByName(self._attachment_chunks(todo, head))
        prefix = text.meta_prefix(F.col("source_kind"), F.col("from_address"), F.col("rcpt"), F.col("sent_at"), F.col("subject"), F.col("filename"))
        chunks = self._with_context(chunks, prefix).withColumn("meta_json", F.to_json(F.struct(F.col("from_address").alias("from"), F.col("rcpt").alias("to"), F.col("sent_at").alias("date"), "subject", "filename")))
        made = cut(chunks.select(*self.store.empty("chunks").columns))
        self._replace("chunks", todo, made)
        self._index_terms(made, todo)
        if self.embed:
            self.reembed()

    def _index_terms(self, chunks: DataFrame, scope: DataFrame | None = None) -> None:
        """Postings and lengths of chunks, which stand for all chunks of the messages in ``scope``.

        Postings are only ever added: a row counts while ``lengths`` names its run (``gen``).
        """
        gen = F.lit(uuid.uuid4().hex)
        posts, lengths = search.postings(chunks, "chunk_id", ["context", "text"], vectors.stemmed)
        self.store.append("postings", posts.withColumn("gen", gen))
        rows = lengths.join(chunks.select("chunk_id", "message_id"), "chunk_id").withColumn("gen", gen)
        self.store.merge("lengths", cut(rows), ["message_id"], chunks if scope is None else scope)

    def _terms(self, queries: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(postings, lengths) for the words of the queries."""
        lengths = self.store.read("lengths")
        asked = queries.select(F.explode(vectors.stemmed("query")).alias("term")).distinct()
        posts = self.store.read("postings").join(asked, "term", "left_semi").join(lengths.select("chunk_id", "gen"), ["chunk_id", "gen"], "left_semi")
        return posts.drop("gen"), lengths.select("chunk_id", "dl")

    def _with_context(self, chunks: DataFrame, prefix) -> DataFrame:
        """Contexts by the plain sentence, a column function, or a model behind the context cache."""
        if not hasattr(self.context, "answer"):
            return chunks.withColumn("context", self.context(chunks) if self.context else prefix)
        c = self.context
        meta = F.create_map(*[x for k, col in (("from", "from_address"), ("to", "rcpt"), ("date", "sent_at"), ("subject", "subject"), ("filename", "filename")) for x in (F.lit(k), F.col(col))])
        chunks = cut(chunks.withColumn("fallback", prefix).withColumn("prompt", context_prompt(meta, F.col("text"))))
        known = self.store.read("context_cache").filter((F.col("tool") == c.tool) & (F.col("tool_version") == c.version))
        told, fresh = cache.through(chunks, known, ["chunk_id"], "context", c.answer)
        told = cut(told)
        self.store.append("context_cache", fresh.select("chunk_id", F.lit(c.tool).alias("tool"), F.lit(c.version).alias("tool_version"), "context", F.lit(self.now()).alias("created_at")))
        return chunks.drop("prompt", "fallback").join(told, "chunk_id")

    def _attachment_chunks(self, todo: DataFrame, head: DataFrame) -> DataFrame:
        """Chunks of text attachments and of those a parser reads, through the parse cache.

        A parser is a function from bytes to (text, meta); its ``tool`` and ``version`` attributes
        key the cache. Empty texts are cached, failures are not. Erased blobs are never read.
        """
        parsers = {m: (f, getattr(f, "tool", getattr(f, "__name__", "parser")), getattr(f, "version", "1")) for m, f in self.parsers.items()}
        a = self.store.read("attachments").join(todo.select("message_id"), "message_id", "left_semi")
        live = a.join(self.store.read("blobs").filter("not tombstoned").select(F.col("hash").alias("blob_hash"), "content"), "blob_hash")
        plain = live.filter("mime like 'text/%'").select("message_id", "blob_hash", "filename", F.expr("try_validate_utf8(cast(content as string))").alias("good"), "content")
        lossy = F.pandas_udf(lambda v: v.map(lambda b: bytes(b).decode("utf-8", "replace")), "string")
        t = plain.select("message_id", "blob_hash", "filename", F.coalesce("good", lossy("content")).alias("text"))
        if parsers:
            tool = F.create_map(*[F.lit(x) for m, (_, n, v) in parsers.items() for x in (m, f"{n}\u0001{v}")])
            items = live.filter(~F.col("mime").like("text/%")).withColumn("_tv", tool[F.col("mime")]).filter("_tv is not null")
            items = items.withColumn("tool", F.split("_tv", "\u0001")[0]).withColumn("tool_version", F.split("_tv", "\u0001")[1])

            def read(batches):
                for b in batches:
                    done = []
                    for h, m, tool_, v, c in zip(b["blob_hash"], b["mime"], b["tool"], b["tool_version"], b["content"]):
                        try:
                            done.append((h, tool_, v, parsers[m][0](bytes(c))[0]))
                        except Exception:  # noqa: BLE001
                            continue
                    yield pd.DataFrame(done, columns=["blob_hash", "tool", "tool_version", "text"])

            keys = ["blob_hash", "tool", "tool_version"]
            compute = lambda miss: miss.dropDuplicates(keys).select("blob_hash", "mime", "tool", "tool_version", "content").mapInPandas(read, "blob_hash string, tool string, tool_version string, text string")
            texts, fresh = cache.through(items, self.store.read("parse_cache"), keys, "text", compute)
            texts = cut(texts)
            if fresh.limit(1).count():
                self.store.append("parse_cache", fresh.withColumn("created_at", F.lit(self.now())))
            t = t.unionByName(items.select("message_id", "filename", *keys).join(texts, keys).select("message_id", "blob_hash", "filename", "text"))
        t = t.filter("text <> ''")
        s = t.select("message_id", "blob_hash", "filename", "text", F.inline(rules.chunk_spans_of("text")))
        cid = F.concat_ws("_", F.lit("chk"), "blob_hash", F.concat(F.lit("m"), F.substring(F.sha2("message_id", 256), 1, 12)), "chunk_index")
        return s.join(head.select("message_id", "subject", "from_address", "sent_at", "rcpt"), "message_id").select(cid.alias("chunk_id"), "blob_hash", "chunk_index", F.lit("attachment").alias("source_kind"), "message_id", "span_start", "span_end", F.col("text").substr(F.col("span_start") + 1, F.col("span_end") - F.col("span_start")).alias("text"), "filename", "from_address", "rcpt", "sent_at", "subject")

    def reindex(self) -> None:
        """Rebuild every derived table from the evidence."""
        for name in ("fragments", "chunks", "embeddings", "threads", "postings", "lengths"):
            self.store.write(name, self.store.empty(name))
        self.rethread()
        self.index()

    def reembed(self) -> int:
        """Vectors for chunks that have none of this model; how many were added."""
        if not self.embed:
            raise RuntimeError("no embedder")
        have = self.store.read("embeddings").filter(F.col("model") == self.model).select("chunk_id")
        todo = self.store.read("chunks").join(have, "chunk_id", "left_anti")
        new = cut(todo.select("chunk_id", F.lit(self.model).alias("model"), self.embed(F.concat_ws("\n", "context", "text")).alias("vector")).withColumn("dim", F.size("vector")))
        n = new.count()
        if n:
            self.store.append("embeddings", new)
        return n

    def tombstone(self, hash_: str, reason: str) -> None:
        """Erase a blob and all that derives from it; the audit log keeps that it happened.

        The rows leave the current tables, and parts and manifests that held them are deleted.
        """
        blob = self.store.read("blobs").filter(F.col("hash") == hash_)
        if not blob.select("hash").limit(1).count():
            raise KeyError(hash_)
        with scratch():
            c = cut(self.store.read("chunks").filter(F.col("blob_hash") == hash_).select("chunk_id", "message_id"))
            for name in ("embeddings", "context_cache", "postings", "lengths"):
                self.store.merge(name, None, ["chunk_id"], c, erase=True)
            left = self.store.read("chunks").join(c.select("message_id").distinct(), "message_id", "left_semi").filter(F.col("blob_hash") != hash_)
            self.store.merge("chunks", cut(left), ["message_id"], c, erase=True)
            one = self.spark.createDataFrame([(hash_,)], "blob_hash string")
            self.store.merge("parse_cache", None, ["blob_hash"], one, erase=True)
            m = self.store.read("messages").filter(F.col("blob_hash") == hash_)
            self.store.merge("fragments", None, ["message_id"], m, erase=True)
            self.store.merge("messages", cut(m.withColumn("body_text", F.lit(""))), ["message_id"], erase=True)
            self.store.merge("blobs", cut(blob.withColumn("content", F.lit(None).cast("binary")).withColumn("tombstoned", F.lit(True))), ["hash"], erase=True)
            self.store.append("audit_log", self.spark.createDataFrame([(self.now(), "tombstone", hash_, reason)], "at string, action string, subject string, detail string"))

    def get_blob(self, hash_: str) -> bytes | None:
        r = self.store.read("blobs").filter((F.col("hash") == hash_) & ~F.col("tombstoned")).select("content").first()
        return bytes(r[0]) if r else None

    # ---- search -----------------------------------------------------------------------------
    def hybrid_search(self, queries: DataFrame, k: int = 10, dedupe: bool = True, expand: bool = False, **filter_) -> DataFrame:
        """``(query_id, chunk_id, score, rank, ...)`` for a frame (query_id, query)."""
        k = max(1, min(50, k))
        chunks, messages = self.store.read("chunks"), self.store.read("messages")
        allowed = filters.search_filter(chunks, messages, self.store.read("message_recipients"), self.store.read("party_addresses"), self.store.read("blobs"), **filter_) if filter_ else None
        posts, lengths = self._terms(queries)
        lists = [search.bm25(queries, posts, lengths, "chunk_id", allowed, tokenize=vectors.stemmed)]
        if self.embed:
            v = self.store.read("embeddings").filter(F.col("model") == self.model).select("chunk_id", "vector")
            v = v.join(allowed, "chunk_id", "left_semi") if allowed is not None else v
            lists.append(search.vector_topk(queries.select("query_id", self.embed("query").alias("vector")), v, "chunk_id"))
        rows = chunks.select("chunk_id", "message_id", "text", "context").join(messages.select("message_id", "sent_at", "thread_id"), "message_id", "left")
        final = cut(search.rerank(search.fuse(*lists, key="chunk_id"), queries, rows, "chunk_id", None if dedupe else k))
        hits = search.collapse(final.select("query_id", "chunk_id", "score"), rows, "chunk_id", k) if dedupe else final
        if expand:
            frg = self.store.read("fragments").filter("kind = 'new'").groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_start", "text"))), lambda x: x["text"]), "\n").alias("text"))
            near = search.neighbours(rows.select("message_id"), messages.select("message_id", "thread_id", "sent_at").join(frg, "message_id", "left"))
            hits = hits.join(rows.select("chunk_id", "message_id"), "chunk_id").join(near, "message_id", "left")
        return hits

    def sql_filter(self, table: str, where: list[dict] | None = None, order_by: dict | None = None, limit: int = 50) -> DataFrame:
        if table == "facts":
            return filters.table_filter(self._beliefs(), "facts", where, order_by, limit)
        if table not in filters.EXPOSED:
            raise ValueError(f"unknown table {table}")
        return filters.table_filter(self.store.read(table), table, where, order_by, limit)

    def get_thread(self, thread_id: str) -> DataFrame:
        """Messages of a thread in order, each with its new text and attachments."""
        m = self.store.read("messages").filter(F.col("thread_id") == thread_id)
        new = self.store.read("fragments").filter("kind = 'new'").groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span_start", "text"))), lambda x: x["text"]), "\n").alias("new_text"))
        att = self.store.read("attachments").groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("att_index", "filename", "mime"))).alias("attachments"))
        return m.join(new, "message_id", "left").join(att, "message_id", "left").select("message_id", "subject", "from_name", "from_address", "sent_at", "new_text", "attachments").orderBy("sent_at", "message_id")

    def get_source(self, chunk_id: str) -> DataFrame:
        """Span, text, mime and bytes behind a citation; no row once the source is tombstoned."""
        c = self.store.read("chunks").filter(F.col("chunk_id") == chunk_id)
        b = self.store.read("blobs").filter("not tombstoned").select(F.col("hash").alias("blob_hash"), "mime", "content")
        return c.join(b, "blob_hash").select("chunk_id", "message_id", "span_start", "span_end", "text", "mime", F.col("content").alias("raw"))

    # ---- ledger -----------------------------------------------------------------------------
    def assert_facts(self, facts: list[dict]) -> None:
        """Append assertions (entity, relation, value_json, valid_from, source_chunk or source_message)."""
        if any(not f.get("source_chunk") and not f.get("source_message") for f in facts):
            raise ValueError("a fact needs a source")
        old = self.store.read("facts")
        base = old.agg(F.max("seq")).first()[0] or 0
        rows = [(base + i + 1, f["entity"], f["relation"], f["value_json"], f["valid_from"], f.get("created_at") or self.now(), f.get("source_chunk"), f.get("source_message")) for i, f in enumerate(facts)]
        self.store.append("facts", self.spark.createDataFrame(rows, old.schema))

    def _append_facts(self, new: DataFrame) -> None:
        """Append assertions in order of their start, numbered over range partitions."""
        base = self.store.read("facts").agg(F.max("seq")).first()[0] or 0
        order = [F.asc("valid_from"), F.asc("entity"), F.asc("relation"), F.asc("value_json")]
        numbered = running_sum(new.withColumn("_one", F.lit(1).cast("long")), [], order, "_one", "seq").withColumn("seq", F.col("seq") + base)
        self.store.append("facts", numbered.withColumn("created_at", F.lit(self.now())).withColumn("source_message", F.lit(None).cast("string")))

    def backfill(self, facts: list[dict]) -> None:
        self.assert_facts(sorted(facts, key=lambda f: f["valid_from"]))

    def _log(self) -> DataFrame:
        return self.store.read("facts").withColumnRenamed("value_json", "value")

    def _beliefs(self, log: DataFrame | None = None) -> DataFrame:
        """Every belief with its id and where it comes from."""
        b = ledger.belief_history(self._log() if log is None else log, ["source_chunk", "source_message"]).withColumnRenamed("value", "value_json")
        return b.withColumn("fact_id", F.xxhash64(*b.columns))

    def fact_as_of(self, entity: str, relation: str, day: str) -> DataFrame:
        q = self.spark.createDataFrame([(entity, relation, day)], "entity string, relation string, day string")
        return ledger.as_of(q, ledger.current(self._log()))

    def fact_history(self, entity: str, relation: str) -> DataFrame:
        mine = self._log().filter((F.col("entity") == entity) & (F.col("relation") == relation))
        return self._beliefs(mine).withColumnRenamed("value_json", "value").orderBy("created_at", "valid_from")

    # ---- entities ---------------------------------------------------------------------------
    def add_party(self, party_id: str, name: str, kind: str, notes: str = "") -> None:
        self.store.merge("parties", self.spark.createDataFrame([(party_id, name, kind, notes)], "party_id string, name string, kind string, notes string"), ["party_id"])

    def map_address(self, address: str, party_id: str, person: str | None = None, from_date: str | None = None, to_date: str | None = None) -> None:
        row = self.spark.createDataFrame([(address.lower(), party_id, person, from_date, to_date)], "address string, party_id string, person string, from_date string, to_date string")
        self.store.merge("party_addresses", row, ["address", "party_id", "from_date"])

    def resolve(self, address: str, day: str | None = None) -> DataFrame:
        return entities.resolve(self.spark.createDataFrame([(address, day)], "address string, day string"), self.store.read("party_addresses"))

    def timeline(self, party_id: str, after: str | None = None, before: str | None = None) -> DataFrame:
        f = self._beliefs().withColumn("fact_id", F.col("fact_id").cast("string"))
        docs = self.store.read("documents")
        t = entities.timeline(f, docs, self.store.read("messages"), self.store.read("message_recipients"), self.store.read("party_addresses")).filter(F.col("party_id") == party_id)
        t = t.filter(F.col("at") >= after) if after else t
        t = t.filter(F.col("at") < before) if before else t
        rank = F.when(F.col("type") == "fact", 0).when(F.col("type") == "document", 1).otherwise(2)
        return t.orderBy("at", rank, "ref")

    def suggest_parties(self, include_decided: bool = False) -> DataFrame:
        s = entities.suggest(self.store.read("messages"), self.store.read("message_recipients"), self.store.read("parties"), self.store.read("party_addresses"), self.store.read("party_suggestion_decisions"))
        return (s if include_decided else s.filter("status = 'suggested'")).orderBy("kind", "suggestion_id")

    def _decide(self, suggestion_id: str, status: str):
        s = self.suggest_parties(True).filter(F.col("suggestion_id") == suggestion_id).first()
        if s is None:
            raise KeyError(suggestion_id)
        if s["status"] != "suggested":
            raise ValueError(f"already {s['status']}")
        return s, self.spark.createDataFrame([(suggestion_id, status, self.now())], "suggestion_id string, status string, decided_at string")

    def confirm_suggestion(self, suggestion_id: str) -> None:
        s, row = self._decide(suggestion_id, "confirmed")
        if s["new_party"]:
            self.add_party(s["new_party"]["partyId"], s["new_party"]["name"], s["new_party"]["kind"])
        for m in s["mappings"]:
            if not m["fromDate"] and not m["toDate"]:
                open_ones = self.store.read("party_addresses").filter(F.col("address") == m["address"])
                kept = cut(open_ones.filter(~((F.col("party_id") == m["partyId"]) & F.col("from_date").isNull())))
                self.store.merge("party_addresses", kept, ["address"], open_ones)
            self.map_address(m["address"], m["partyId"], m["person"], m["fromDate"], m["toDate"])
        self.store.append("party_suggestion_decisions", row)

    def dismiss_suggestion(self, suggestion_id: str) -> None:
        self.store.append("party_suggestion_decisions", self._decide(suggestion_id, "dismissed")[1])

    def add_document(self, **row) -> None:
        old = self.store.read("documents")
        if old.filter(F.col("doc_id") == row["doc_id"]).count():
            raise ValueError(f"document {row['doc_id']} exists")
        self.store.append("documents", self.spark.createDataFrame([tuple(row.get(f.name) for f in old.schema)], old.schema))

    def document_chain(self, root_id: str) -> DataFrame:
        return self.store.read("documents").filter(F.col("root_id") == root_id).orderBy("version")

    # ---- extraction -------------------------------------------------------------------------
    def extract_facts(self, complete: Callable[[str], str], version: str = "1") -> dict:
        """Ask the completion about changed threads and assert what holds; counts of what happened."""
        if self.store.readonly:
            raise ReadOnlyError("the store is read-only")
        chunks, messages = self.store.read("chunks"), self.store.read("messages")
        asked = cut(extract.prompts(chunks, messages))
        done = self.store.read("fact_extract_runs").filter(F.col("tool_version") == version).select("thread_id", "thread_hash")
        todo = asked.join(done, ["thread_id", "thread_hash"], "left_anti")
        judged = cut(extract.judge(cut(extract.propose(todo, complete)), chunks, messages, self.store.read("parties")))
        ok = judged.filter("reason is null").select("thread_id", F.col("p.entity").alias("entity"), F.col("p.relation").alias("relation"), F.to_json(F.struct(F.col("p.value").alias("v"))).alias("v"), F.col("p.validFrom").alias("valid_from"), F.col("p.sourceChunk").alias("source_chunk"))
        ok = ok.withColumn("value_json", F.regexp_extract("v", r'^\{"v":(.*)\}$', 1)).drop("v")
        new = cut(ok.join(self.store.read("facts").select("entity", "relation", "valid_from", "value_json"), ["entity", "relation", "valid_from", "value_json"], "left_anti").dropDuplicates(["entity", "relation", "valid_from", "value_json"]))
        self._append_facts(new)
        bad = judged.filter("reason is not null and reason <> 'none'")
        at = F.lit(self.now())
        for r in bad.select("thread_id", "reason", F.col("p.raw").alias("payload")).toLocalIterator() if self.on_reject else ():
            self.on_reject(r.asDict())
        self.store.append("fact_extract_rejects", bad.select(at.alias("at"), "thread_id", F.lit(version).alias("tool_version"), "reason", F.col("p.raw").alias("payload_json")))
        tally = judged.groupBy("thread_id", "thread_hash").agg(F.count("p").alias("proposed"), F.count(F.when(F.col("reason").isNotNull() & (F.col("reason") != "none"), 1)).alias("rejected"))
        tally = cut(tally.join(new.groupBy("thread_id").agg(F.count("*").alias("asserted")), "thread_id", "left").withColumn("asserted", F.coalesce("asserted", F.lit(0))).withColumn("tool_version", F.lit(version)).withColumn("at", at))
        self.store.append("fact_extract_runs", tally)
        t = tally.agg(F.count("*"), F.sum("proposed"), F.sum("asserted"), F.sum("rejected")).first()
        return {"threads": t[0], "skipped": asked.count() - t[0], "proposed": t[1] or 0, "asserted": t[2] or 0, "rejected": t[3] or 0}
