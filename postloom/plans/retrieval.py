"""Queries of the retrieval, threading, ledger, entity and store operators, with SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from postloom.functions import mail, text, vectors
from postloom.operators import entities, filters, ledger, search, threads
from postloom.operators.components import components
from postloom.operators.history import as_day, value_key
from postloom.operators.skew import running_sum
from postloom.sources.tables import table
from postloom.session import cut, tidy_shuffles, written


def _chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "chunks").dropDuplicates(["chunk_id"])


def _messages(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "messages").dropDuplicates(["message_id"])


def _people_addresses(s: SparkSession, d: str) -> DataFrame:
    p = table(s, d, "people").dropDuplicates(["person_id"])
    a = p.select(F.col("party_id"), F.col("name").alias("person"), F.explode("addresses").alias("a"))
    return a.select(F.lower("a.address").alias("address"), "party_id", "person", F.col("a.from_date").alias("from_date"), F.col("a.to_date").alias("to_date")).distinct()


def _party_queries(s: SparkSession, d: str) -> DataFrame:
    """One query per party: its name."""
    return table(s, d, "parties").select(F.col("party_id").alias("query_id"), F.col("name").alias("query")).distinct()


def _rows(s: SparkSession, d: str) -> DataFrame:
    m = _messages(s, d).select("message_id", "sent_at", "thread_id", "subject")
    return _chunks(s, d).select("chunk_id", "message_id", "text", "context").join(m, "message_id", "left")


_made: dict[tuple, tuple[DataFrame, ...]] = {}


def _once(s: SparkSession, d: str, what: str, make: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
    key = (s.sparkContext.applicationId, d, what)
    if key not in _made or not all(written(t) for t in _made[key]):
        with tidy_shuffles(s):
            _made[key] = tuple(cut(t) for t in make())
    return _made[key]


def _index(s: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """(postings, lengths) of the chunks of a folder: written once a session, sorted by term, and searched by every query."""

    def make() -> tuple[DataFrame, DataFrame]:
        posts, lengths = search.postings(_chunks(s, d), "chunk_id", ["context", "text"])
        return posts.repartition("term").sortWithinPartitions("term"), lengths

    return _once(s, d, "words", make)


def _vectors(s: SparkSession, d: str) -> DataFrame:
    """Hash vectors of the chunks of a folder, written once a session when a query first asks for them."""
    return _once(s, d, "vectors", lambda: (hash_embed(s, d),))[0]


def _bm25(s: SparkSession, d: str, limit: int = search.CANDIDATES, allowed: DataFrame | None = None) -> DataFrame:
    posts, lengths = _index(s, d)
    return search.bm25(_party_queries(s, d), posts, lengths, "chunk_id", allowed, limit)


_SCORED = lambda df: df.withColumn("score", F.round("score", 6))


def bm25_topk(s: SparkSession, d: str) -> DataFrame:
    """Ten best chunks for each party's name."""
    return _SCORED(_bm25(s, d, 10))


def bm25_filtered(s: SparkSession, d: str) -> DataFrame:
    """The same among chunks of messages sent in 2024; statistics stay those of all chunks."""
    ok = filters.search_filter(_chunks(s, d), table(s, d, "messages"), after="2024-01-01", before="2025-01-01", source_kind="message")
    return _SCORED(_bm25(s, d, 10, ok))


def _numbers(s: SparkSession, d: str, limit: int) -> DataFrame:
    q = table(s, d, "messages").select(F.explode(F.regexp_extract_all("subject", F.lit(r"(?:LEASE|PO|INV|CN|DN|Q)-\d{4}-\d{4}"), F.lit(0))).alias("query")).distinct().select(F.col("query").alias("query_id"), "query")
    posts, lengths = _index(s, d)
    return search.bm25(q, posts, lengths, "chunk_id", None, limit)


def bm25_phrase(s: SparkSession, d: str) -> DataFrame:
    """Ten best chunks for each document number named in a subject, as a phrase."""
    return _SCORED(_numbers(s, d, 10))


def bm25_porter(s: SparkSession, d: str) -> DataFrame:
    """Stemmed and accent-folded tokens on both sides."""
    posts, lengths = search.postings(_chunks(s, d), "chunk_id", ["context", "text"], vectors.stemmed)
    return _SCORED(search.bm25(_party_queries(s, d), posts, lengths, "chunk_id", None, 10, vectors.stemmed))


def vector_topk(s: SparkSession, d: str) -> DataFrame:
    """Ten nearest embeddings of every embedding whose id is divisible by 20."""
    e = table(s, d, "embeddings")
    q = e.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return search.vector_topk(q, e.select("vec_id", F.col("embedding").alias("vector")), "vec_id", 10).withColumn("score", F.round("score", 5))


def hash_embed(s: SparkSession, d: str) -> DataFrame:
    """Hash vectors of all chunks."""
    return _chunks(s, d).select("chunk_id", vectors.hash_embed(F.concat_ws("\n", "context", "text")).alias("vector"))


def _overlap_list(s: SparkSession, d: str) -> DataFrame:
    c = _rows(s, d).select("chunk_id", F.array_distinct(text.tokens(F.concat_ws(" ", F.coalesce("context", F.lit("")), "text"))).alias("w"))
    q = _party_queries(s, d).select("query_id", F.array_distinct(text.tokens("query")).alias("q"))
    n = q.select("query_id", F.size("q").alias("n"))
    hit = q.select("query_id", F.explode("q").alias("t")).join(c.select("chunk_id", F.explode("w").alias("t")), "t").groupBy("query_id", "chunk_id").agg(F.count("*").alias("k"))
    return search.ranked(hit.join(n, "query_id").select("query_id", "chunk_id", (F.col("k") / F.col("n")).alias("score")), "chunk_id", search.CANDIDATES)


def token_overlap(s: SparkSession, d: str) -> DataFrame:
    """Fifty chunks that share most of each query's tokens."""
    return _SCORED(_overlap_list(s, d))


def rrf_fusion(s: SparkSession, d: str) -> DataFrame:
    """Both ranked lists fused."""
    return _SCORED(search.fuse(_bm25(s, d), _overlap_list(s, d), key="chunk_id"))


def rerank_features(s: SparkSession, d: str) -> DataFrame:
    """Features and final score of the fused BM25 list, ten per query."""
    c = search.fuse(_bm25(s, d), key="chunk_id")
    out = search.rerank(c, _party_queries(s, d), _rows(s, d), "chunk_id", 10)
    return out.select("query_id", "chunk_id", "rank", *[F.round(x, 6).alias(x) for x in ("score", "rrf", "overlap", "recency", "coherence")])


def candidate_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Near copies among the fifty candidates for each document number."""
    return search.duplicate_pairs(_numbers(s, d, search.CANDIDATES), _rows(s, d), "chunk_id")


def hybrid_search(s: SparkSession, d: str) -> DataFrame:
    """BM25 and hash vectors fused, reranked, near copies folded, ten per query."""
    rows = _rows(s, d)
    q = _party_queries(s, d)
    near = search.vector_topk(q.select("query_id", vectors.hash_embed("query").alias("vector")), _vectors(s, d), "chunk_id")
    fused = search.fuse(_bm25(s, d), near, key="chunk_id")
    final = cut(search.rerank(fused, q, rows, "chunk_id", None))
    return _SCORED(search.collapse(final.select("query_id", "chunk_id", "score"), rows, "chunk_id", 10))


def exact_dups(s: SparkSession, d: str) -> DataFrame:
    """Documents with one content hash: first id and number of copies."""
    return table(s, d, "documents").filter("text is not null").groupBy(F.sha2("text", 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).filter("copies > 1")


def thread_view(s: SparkSession, d: str) -> DataFrame:
    """Messages of every thread in order."""
    m = _messages(s, d).filter("thread_id is not null")
    e = F.array_sort(F.collect_list(F.struct(F.coalesce("sent_at", F.lit("")).alias("at"), F.col("message_id").alias("id"))))
    return m.groupBy("thread_id").agg(F.array_join(F.transform(e, lambda x: x["id"]), " ").alias("messages"), F.count("*").alias("n"))


def thread_expand(s: SparkSession, d: str) -> DataFrame:
    """Two messages before and after each one in its thread."""
    m = _messages(s, d).withColumn("sent_at", F.coalesce("sent_at", F.lit(""))).withColumnRenamed("body_text", "text")
    near = search.neighbours(m, m)
    return near.select("message_id", F.array_join(F.transform("neighbours", lambda x: x["message_id"]), " ").alias("around"), F.aggregate("neighbours", F.lit(0), lambda a, x: a + F.length(x["text"])).alias("chars"))


def thread_bounds(s: SparkSession, d: str) -> DataFrame:
    """First and last date and the earliest subject of each thread."""
    m = _messages(s, d).filter("thread_id is not null")
    when = F.struct(F.coalesce("sent_at", F.lit("￿")), F.col("message_id"))
    return m.groupBy("thread_id").agg(F.min("sent_at").alias("first_at"), F.max("sent_at").alias("last_at"), text.bare_subject(F.min_by("subject", when)).alias("subject"))


def thread_coherence(s: SparkSession, d: str) -> DataFrame:
    """How many of a query's candidates lie in one thread."""
    c = _bm25(s, d).join(_rows(s, d).select("chunk_id", "thread_id"), "chunk_id").filter("thread_id is not null")
    return c.groupBy("query_id", "thread_id").agg(F.count("*").alias("candidates"))


def reply_components(s: SparkSession, d: str) -> DataFrame:
    """Messages connected by any reference, by the smallest id among them."""
    h = threads.headers(table(s, d, "messages"))
    e = h.select("message_id", F.explode(F.array_union("refs", F.filter(F.array("in_reply_to"), lambda x: x.isNotNull() & (x != "")))).alias("other"))
    return components(e, "message_id", "other").select(F.col("node").alias("id"), "component")


def jwz_threads(s: SparkSession, d: str) -> DataFrame:
    """Thread of every message by reply headers and subjects."""
    return threads.assign(table(s, d, "messages")).select("message_id", "root", "thread_id")


def jwz_thread_rows(s: SparkSession, d: str) -> DataFrame:
    """One row per thread so found."""
    return threads.thread_rows(threads.assign(table(s, d, "messages")))


def subject_norm(s: SparkSession, d: str) -> DataFrame:
    """Messages by subject without marks."""
    return _messages(s, d).groupBy(text.subject_key("subject").alias("subject")).agg(F.count("*").alias("n"))


def fragments(s: SparkSession, d: str) -> DataFrame:
    """New, quoted and signature runs of every body."""
    f = _messages(s, d).select("message_id", F.inline(mail.fragments_of("body_text")))
    return f.select(F.concat(F.lit("frg_"), F.substring(F.sha2("message_id", 256), 1, 16), F.lit("_"), "n").alias("fragment_id"), "message_id", "kind", "span_start", "span_end")


def fragments_cover(s: SparkSession, d: str) -> DataFrame:
    """Every body with text: fragments are numbered in order, point at their text and hold all its letters."""
    m = _messages(s, d).filter("body_text rlike '\\\\S'")
    f = m.select("message_id", "body_text", F.inline(mail.fragments_of("body_text")))
    exact = (F.col("text") == F.col("body_text").substr(F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))) & F.col("kind").isin("new", "quote", "signature")
    g = f.groupBy("message_id").agg(F.min(exact).alias("exact"), F.sum(F.length(F.regexp_replace("text", r"\s", ""))).alias("letters"), F.array_sort(F.collect_list(F.struct("n", "span_start", "span_end"))).alias("x"))
    in_order = F.forall(F.zip_with(F.slice("x", 1, F.size("x") - 1), F.slice("x", 2, F.size("x")), lambda a, b: (a["span_end"] <= b["span_start"]) & (b["n"] == a["n"] + 1)), lambda v: v)
    return g.select("message_id", (F.col("exact") & in_order).alias("sound"), "letters")


def chunks_cover(s: SparkSession, d: str) -> DataFrame:
    """Every body with text: chunks lie in its new fragments, keep to the limit and hold all their letters."""
    m = _messages(s, d).filter("body_text rlike '\\\\S'")
    f = m.select("message_id", F.explode(mail.fragments_of("body_text")).alias("f")).select("message_id", "f.text", "f.kind")
    letters = lambda c: F.length(F.regexp_replace(c, r"\s", ""))
    c = f.select("message_id", "kind", "text", mail.chunk_spans_of("text").alias("c"))
    pieces = F.transform("c", lambda x: F.col("text").substr(x["span_start"] + 1, x["span_end"] - x["span_start"]))
    whole = F.aggregate(F.transform(pieces, lambda p: letters(p)), F.lit(0), lambda a, x: a + x) == letters(F.col("text"))
    fits = F.forall("c", lambda x: (x["span_end"] - x["span_start"]).between(1, mail.CHUNK_CHARS))
    return c.groupBy("message_id").agg(F.min((F.col("kind") != "new") | (whole & fits)).alias("sound"))


def threads_cover(s: SparkSession, d: str) -> DataFrame:
    """Every message has one thread, and a parent that is here, and is no loop, shares it."""
    a = threads.assign(table(s, d, "messages"))
    h = threads.headers(table(s, d, "messages"))
    parent = F.when(F.size("refs") > 0, F.element_at("refs", -1)).otherwise(F.col("in_reply_to"))
    up = h.select("message_id", parent.alias("p"), "refs")
    of = a.select(F.col("message_id").alias("p"), F.col("thread_id").alias("t"), F.col("root").alias("r"))
    back = up.select(F.col("message_id").alias("p"), F.col("p").alias("pp"))
    # a link into a loop may be refused, so only parents whose own parent is another are held to it
    j = a.join(up, "message_id").join(of, "p", "left").join(back, "p", "left")
    right = F.col("t").isNull() | (F.col("thread_id") == F.col("t")) | (F.col("r") == F.col("message_id")) | (F.col("root") == F.col("message_id"))
    return j.groupBy("message_id").agg((F.min(right) & (F.count("*") == 1) & F.min(F.col("thread_id") == threads.thread_id(F.col("root")))).alias("sound"))


def chunk_spans(s: SparkSession, d: str) -> DataFrame:
    """Paragraph-aligned chunks of the new text of every message; spans point into the body."""
    f = _messages(s, d).select("message_id", "blob_hash", F.inline(mail.fragments_of("body_text"))).filter("kind = 'new'")
    c = f.select("message_id", "blob_hash", F.col("span_start").alias("base"), F.inline(mail.chunk_spans_of("text")))
    w = Window.partitionBy("message_id").orderBy("a")
    spans = c.select("message_id", "blob_hash", (F.col("base") + F.col("span_start")).alias("a"), (F.col("base") + F.col("span_end")).alias("b"))
    n = F.row_number().over(w) - 1
    return spans.withColumn("chunk_index", n).select(F.concat_ws("_", F.lit("chk"), "blob_hash", "chunk_index").alias("chunk_id"), "message_id", "chunk_index", F.col("a").alias("span_start"), F.col("b").alias("span_end"))


def context_prefix(s: SparkSession, d: str) -> DataFrame:
    """Sentence that introduces each message's chunks."""
    m = _messages(s, d)
    r = table(s, d, "message_recipients").distinct()
    order = F.when(F.col("kind") == "to", 0).when(F.col("kind") == "cc", 1).otherwise(2)
    to = r.groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set(F.struct(order.alias("o"), F.col("address").alias("a")))), lambda x: x["a"]), ", ").alias("rcpt"))
    j = m.join(to, "message_id", "left")
    return j.select("message_id", text.meta_prefix(F.lit("message"), F.col("from_address"), F.col("rcpt"), F.col("sent_at"), F.col("subject")).alias("context"))


def html_text(s: SparkSession, d: str) -> DataFrame:
    """Documents wrapped as HTML and read back."""
    h = F.concat(F.lit("<style>p{}</style><div>"), F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</div><!-- end -->"))
    return table(s, d, "documents").filter("text is not null").select("doc_id", text.html_text(h).alias("text"))


def _log(s: SparkSession, d: str) -> DataFrame:
    f = table(s, d, "facts").filter("expired_at is null").dropDuplicates(["fact_id"])
    return f.select(F.upper(F.trim("entity")).alias("entity"), "relation", value_key(F.col("value_json")).alias("value"), as_day(F.col("valid_from")).alias("valid_from"), "created_at", F.struct("created_at", "fact_id").alias("seq"))


def facts_current(s: SparkSession, d: str) -> DataFrame:
    """Interval chain of each entity and relation, the last statement of a day winning."""
    return ledger.current(_log(s, d)).drop("value")


def facts_as_of(s: SparkSession, d: str) -> DataFrame:
    """What was believed of every party on three days."""
    days = F.explode(F.array(F.lit("2023-07-01"), F.lit("2024-06-30"), F.lit("2025-03-15")))
    log = _log(s, d)
    q = log.select("entity", "relation").distinct().select("entity", "relation", days.alias("day"))
    return ledger.as_of(q, ledger.current(log)).select("entity", "relation", "day", "valid_from")


def facts_history(s: SparkSession, d: str) -> DataFrame:
    """All beliefs ever held, with the time each was given up."""
    log = _log(s, d).withColumn("seq", F.row_number().over(Window.partitionBy("entity", "relation").orderBy("seq")))
    return ledger.belief_history(log).drop("value")


def facts_backfill(s: SparkSession, d: str) -> DataFrame:
    """Current belief after a backfill in order of start equals the log's."""
    return ledger.current(ledger.backfill(_log(s, d))).drop("value")


def facts_json_value(s: SparkSession, d: str) -> DataFrame:
    """Facts by type of value."""
    f = table(s, d, "facts").dropDuplicates(["fact_id"])
    bare = F.regexp_replace("value_json", r"\s+", "")
    kind = F.when(bare.rlike('^"'), "string").when(bare.rlike(r"^-?[0-9.]+$"), "number").otherwise("other")
    return f.groupBy("relation", kind.alias("kind")).agg(F.count("*").alias("n"))


def resolve_windowed(s: SparkSession, d: str) -> DataFrame:
    """Party of each sender on the day of each message."""
    q = _messages(s, d).filter("sent_at is not null").select(F.lower("from_address").alias("address"), F.col("sent_at").alias("day")).distinct()
    return entities.resolve(q, _people_addresses(s, d)).select("address", "day", "party_id")


def timeline_merge(s: SparkSession, d: str) -> DataFrame:
    """Facts and messages of every party, counted by month and type."""
    t = entities.timeline(table(s, d, "facts").withColumn("entity", F.upper(F.trim("entity"))), None, table(s, d, "messages"), table(s, d, "message_recipients"), _people_addresses(s, d))
    return t.groupBy("party_id", "type", F.substring("at", 1, 7).alias("month")).agg(F.count("*").alias("n"), F.min("at").alias("first_at"))


def address_stats(s: SparkSession, d: str) -> DataFrame:
    """Activity and usual name of every address."""
    return entities.address_stats(entities.activity(table(s, d, "messages"), table(s, d, "message_recipients")))


def domain_groups(s: SparkSession, d: str) -> DataFrame:
    """Domains with two addresses or five messages, and their display names."""
    acts = entities.activity(table(s, d, "messages"), table(s, d, "message_recipients")).withColumn("domain", text.domain_of("address")).filter(~F.col("domain").isin(text.FREEMAIL))
    a = acts.select("domain", "address").distinct().groupBy("domain").agg(F.count("*").alias("addresses"))
    m = acts.select("domain", "message_id").distinct().groupBy("domain").agg(F.count("*").alias("messages"))
    return a.join(m, "domain").filter("addresses >= 2 or messages >= 5").withColumn("title", text.domain_title("domain"))


def mode_tiebreak(s: SparkSession, d: str) -> DataFrame:
    """Most frequent event type of each user, ties to the smallest."""
    n = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("n"), F.col("event_type").alias("t"))).alias("b")).select("user_id", F.col("b.t").alias("event_type"))


def person_move_pairs(s: SparkSession, d: str) -> DataFrame:
    """Names seen at addresses of several domains, as consecutive pairs by first activity."""
    acts = entities.activity(table(s, d, "messages"), table(s, d, "message_recipients"))
    named = acts.select(text.name_key("name").alias("norm"), "address", "sent_at").filter("length(norm) >= 6 and norm like '% %'")
    first = named.groupBy("norm", "address").agg(F.min("sent_at").alias("first_at"))
    w = Window.partitionBy("norm").orderBy(F.coalesce("first_at", F.lit("￿")), "address")
    return first.withColumn("earlier", F.lag("address").over(w)).filter("earlier is not null").filter(text.domain_of("earlier") != text.domain_of("address")).select("norm", "earlier", F.col("address").alias("later"))


def suggest_parties(s: SparkSession, d: str) -> DataFrame:
    """All proposals, with one address in three already mapped."""
    known = _people_addresses(s, d).filter("from_date is null")
    out = entities.suggest(table(s, d, "messages"), table(s, d, "message_recipients"), table(s, d, "parties"), known)
    return out.select("suggestion_id", "kind", "status", F.size("mappings").alias("addresses"), F.col("new_party.partyId").alias("new_party"))


def _filtered(where: list[dict], order: dict | None, limit: int | None):
    def run(s: SparkSession, d: str) -> DataFrame:
        return filters.table_filter(_messages(s, d), "messages", where, order, limit)

    return run


sql_filter_eq = _filtered([{"column": "from_address", "op": "=", "value": "notices@ledgerhub.example"}], None, None)
sql_filter_range = _filtered([{"column": "sent_at", "op": ">=", "value": "2024-03-01"}, {"column": "sent_at", "op": "<", "value": "2024-04-01"}, {"column": "thread_id", "op": "!=", "value": ""}], None, None)
sql_filter_like = _filtered([{"column": "subject", "op": "like", "value": "re: %NOTE%"}], None, None)
sql_filter_top = _filtered([{"column": "sent_at", "op": ">", "value": "2024-01-01"}], {"column": "message_id", "dir": "desc"}, 40)


def semi_party(s: SparkSession, d: str) -> DataFrame:
    """Messages from or to an address of the engine's own party."""
    me = table(s, d, "parties").filter("is_self").select("party_id").distinct()
    own = _people_addresses(s, d).join(me, "party_id", "left_semi").select("address").distinct()
    m = table(s, d, "messages").select("message_id", F.lower("from_address").alias("address")).unionByName(table(s, d, "message_recipients").select("message_id", F.lower("address").alias("address")))
    return m.join(own, "address", "left_semi").select("message_id").distinct()


def anti_missing_embedding(s: SparkSession, d: str) -> DataFrame:
    """Documents without a stored vector of their id."""
    return table(s, d, "documents").select("doc_id").join(table(s, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


def exists_mime(s: SparkSession, d: str) -> DataFrame:
    """Chunks whose stored sender domain matches a prefix without case."""
    j = _chunks(s, d).select("chunk_id", F.get_json_object("meta_json", "$.from").alias("sender"))
    return j.filter(text.mime_prefix(F.col("sender"), F.lit("Accounts@"))).select("chunk_id")


def union_senders_recipients(s: SparkSession, d: str) -> DataFrame:
    """Rows of senders and recipients by kind."""
    a = entities.activity(table(s, d, "messages"), table(s, d, "message_recipients"))
    return a.groupBy("address").agg(F.count("*").alias("n"), F.count("sent_at").alias("dated"))


def doc_chain(s: SparkSession, d: str) -> DataFrame:
    """Line items as versions of their order: each with the one it supersedes."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    return table(s, d, "lineitem").select(F.col("l_orderkey").alias("root_id"), F.col("l_linenumber").alias("version"), F.lag("l_linenumber").over(w).alias("supersedes"), F.row_number().over(w).alias("place"))


def quarantine_split(s: SparkSession, d: str) -> DataFrame:
    """Documents that ingest would refuse, by reason; one row per content and reason."""
    t = table(s, d, "documents")
    reason = F.when(F.length("text") > 20000, "oversize").when(F.trim(F.coalesce("text", F.lit(""))) == "", "degenerate")
    return t.withColumn("reason", reason).filter("reason is not null").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("blob_hash"), "reason").distinct()


def idempotent_reingest(s: SparkSession, d: str) -> DataFrame:
    """Repeated message rows: the first stored counts, later ones change nothing."""
    m = table(s, d, "messages")
    first = m.groupBy("message_id", "blob_hash").agg(F.min("ingested_at").alias("at"), F.count("*").alias("seen"))
    return first.select("message_id", "blob_hash", (F.col("seen") > 1).alias("repeated"))


def tombstone_purge(s: SparkSession, d: str) -> DataFrame:
    """Chunks left after messages of one sender are tombstoned."""
    gone = table(s, d, "messages").filter("from_address = 'notices@ledgerhub.example'").select("blob_hash").distinct()
    return _chunks(s, d).join(gone, "blob_hash", "left_anti").select("chunk_id")


def get_source(s: SparkSession, d: str) -> DataFrame:
    """Chunks whose text is exactly their span of the body."""
    j = _chunks(s, d).join(_messages(s, d).select("message_id", "body_text"), "message_id")
    return j.select("chunk_id", (F.col("text") == F.col("body_text").substr(F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))).alias("exact"))


def fact_grounding(s: SparkSession, d: str) -> DataFrame:
    """Facts whose value occurs in the message they cite, without case and white space."""
    f = table(s, d, "facts").dropDuplicates(["fact_id"]).filter("source_message is not null")
    j = f.join(_messages(s, d).select(F.col("message_id").alias("source_message"), "body_text"), "source_message")
    squeeze = lambda c: F.regexp_replace(F.lower(c), r"[\s\"]+", "")
    return j.select("fact_id", F.contains(squeeze(F.col("body_text")), squeeze(F.col("value_json"))).alias("grounded"))


def latency_percentiles(s: SparkSession, d: str) -> DataFrame:
    """Nearest-rank median and 95th percentile of event values by type."""
    e = table(s, d, "events").filter("value is not null").select("event_type", "value", "event_id", F.lit(1).cast("long").alias("one"))
    r = running_sum(e, ["event_type"], [F.asc("value"), F.asc("event_id")], "one", "r").join(e.groupBy("event_type").agg(F.count("*").alias("n")), "event_type")
    at = lambda p: F.max(F.when(F.col("r") == F.ceil(F.col("n") * p), F.col("value")))
    return r.groupBy("event_type").agg(at(0.5).alias("p50"), at(0.95).alias("p95"))


_NAMES = "bm25_topk bm25_filtered bm25_phrase bm25_porter vector_topk hash_embed token_overlap rrf_fusion rerank_features candidate_duplicates hybrid_search exact_dups thread_view thread_expand thread_bounds thread_coherence reply_components jwz_threads jwz_thread_rows subject_norm fragments fragments_cover chunk_spans chunks_cover threads_cover context_prefix html_text facts_current facts_as_of facts_history facts_backfill facts_json_value resolve_windowed timeline_merge address_stats domain_groups mode_tiebreak person_move_pairs suggest_parties sql_filter_eq sql_filter_range sql_filter_like sql_filter_top semi_party anti_missing_embedding exists_mime union_senders_recipients doc_chain quarantine_split idempotent_reingest tombstone_purge get_source fact_grounding latency_percentiles".split()
QUERIES = {n: globals()[n] for n in _NAMES}
