"""Batch retrieval: every stage is keyed by query, so many queries run in one job."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postloom.functions.text import dedupe_key, jaccard, shingles, tokens
from postloom.session import cut, tidy_shuffles

K1, B, CANDIDATES, RRF_K = 1.2, 0.75, 50, 60


def postings(chunks: DataFrame, key: str, columns: list[str], tokenize: Callable[[str], Column] = tokens) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths): (key, col, term, positions) and (key, dl) over all columns together.

    Positions count from 0 within a column. NULL text has no terms but the row still counts.
    """

    def numbered(n: int, c: str) -> Column:
        return F.transform(F.coalesce(tokenize(c), F.array().cast("array<string>")), lambda t, i: F.struct(F.lit(n).alias("col"), t.alias("term"), i.alias("pos")))

    words = [numbered(n, c) for n, c in enumerate(columns)]
    all_words = chunks.select(key, F.concat(*words).alias("w"))
    lengths = all_words.select(key, F.size("w").alias("dl"))
    posts = all_words.select(key, F.inline("w")).groupBy(key, "col", "term").agg(F.array_sort(F.collect_list("pos")).alias("positions"))
    return posts, lengths


def bm25(queries: DataFrame, posts: DataFrame, lengths: DataFrame, key: str, allowed: DataFrame | None = None, limit: int = CANDIDATES, tokenize: Callable[[str], Column] = tokens) -> DataFrame:
    """Top ``limit`` rows per query: ``(query_id, key, score, rank)``.

    ``queries`` is (query_id, query). Each blank-separated word is a phrase of its tokens, which
    must stand side by side in one column; a word typed twice counts twice. Statistics (row count,
    mean length, document frequency) are those of the whole index; ``allowed`` (query_id, key or
    key alone) restricts candidates before ranking. Ties go to the smaller key.

    Only the postings of terms in the queries are kept before anything is summed, and none meets
    the phrases one by one: work grows with the postings read, not with the number of phrases that share a term.
    """
    typed = queries.select("query_id", F.posexplode(F.filter(F.split("query", r"\s+"), lambda x: x != "")).alias("slot", "word"))
    phrases = typed.withColumn("terms", tokenize("word")).filter(F.size("terms") > 0).groupBy("query_id", "terms").agg(F.count("*").alias("times"))
    wanted = phrases.select("terms").distinct()
    # a row's own runs of terms are made and looked up, so a term in many phrases costs its postings only once
    begun = wanted.groupBy(F.get("terms", F.lit(0)).alias("term")).agg(F.collect_set(F.size("terms")).alias("lens"))
    used = wanted.select(F.explode("terms").alias("term")).distinct().join(begun, "term", "left")
    placed = posts.join(used, "term").select(key, "col", F.explode("positions").alias("pos"), "term", F.coalesce("lens", F.array().cast("array<int>")).alias("lens"))
    lines = placed.groupBy(key, "col").agg(F.array_sort(F.collect_list(F.struct("pos", "term", "lens"))).alias("w"))
    w = F.col("w")
    fits = lambda x, i, n: F.get(w, i + n - 1)["pos"] == x["pos"] + n - 1
    joined = lambda i, n: F.array_join(F.transform(F.slice(w, i + 1, n), lambda y: y["term"]), " ")
    runs = F.flatten(F.transform(w, lambda x, i: F.transform(F.filter(x["lens"], lambda n: fits(x, i, n)), lambda n: joined(i, n))))
    found = lines.select(key, F.explode(runs).alias("phrase")).groupBy("phrase", key).agg(F.count("*").alias("f"))
    hits = found.join(wanted.select(F.array_join("terms", " ").alias("phrase")), "phrase", "left_semi")
    with tidy_shuffles(posts.sparkSession):
        hits = cut(hits)  # of the queries' terms alone; read for the frequencies and for the scores
    stats = lengths.agg(F.count("*").alias("big_n"), F.avg("dl").alias("avgdl"))  # one row
    df = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    if allowed is not None and "query_id" not in allowed.columns:
        hits = hits.join(allowed.select(key), key, "left_semi")
    idf = F.greatest(F.log((F.col("big_n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = hits.join(df, "phrase").join(lengths, key).join(F.broadcast(stats)).withColumn("w", weight).select("phrase", key, "w")
    per_query = phrases.select("query_id", F.array_join("terms", " ").alias("phrase"), "times").join(scored, "phrase")
    if allowed is not None and "query_id" in allowed.columns:
        per_query = per_query.join(allowed.select("query_id", key), ["query_id", key], "left_semi")
    total = per_query.groupBy("query_id", key).agg(F.sum(F.col("w") * F.col("times")).alias("score"))
    return ranked(total, key, limit)


def ranked(scores: DataFrame, key: str, limit: int | None) -> DataFrame:
    """Rows with their rank per query by rounded score, ties by key; at most ``limit`` per query."""
    w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), key)
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= limit) if limit else out


def vector_topk(queries: DataFrame, rows: DataFrame, key: str, limit: int = CANDIDATES, blocks: int | None = None, row_block: int = 20_000, query_block: int = 2_000) -> DataFrame:
    """Exact cosine top ``limit``: ``(query_id, key, score, rank)``.

    ``queries`` is (query_id, vector), ``rows`` is (key, vector). Both sides are cut into blocks of
    bounded size; each pair of blocks is one matrix product that keeps its ``limit`` best per
    query. Neither side is broadcast. Zero vectors and NULLs score 0 and -- as queries -- find
    nothing.
    """
    n_rows, n_queries = rows.count(), queries.count()
    rb, qb = max(1, -(-n_rows // row_block)), max(1, -(-n_queries // query_block))
    if blocks:
        rb = max(rb, blocks)
    # both sides number their blocks with one type: groups of another type hash elsewhere
    left = rows.select(F.col(key).alias("k"), F.col("vector").alias("v"), F.pmod(F.xxhash64(key), F.lit(rb)).cast("int").alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(qb - 1))).alias("qb"))
    right = queries.select(F.col("query_id").alias("q"), F.col("vector").alias("u"), F.pmod(F.xxhash64("query_id"), F.lit(qb)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(rb - 1))).alias("rb"))
    kt, qt = dict(rows.dtypes)[key], dict(queries.dtypes)["query_id"]

    def unit(vs: list) -> np.ndarray:
        width = max((len(v) for v in vs if v is not None), default=0)
        m = np.zeros((len(vs), width))
        for i, v in enumerate(vs):
            if v is not None:
                m[i, : len(v)] = v
        norm = np.sqrt((m * m).sum(1, keepdims=True))
        return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "key": [], "score": []})
        if not len(a) or not len(b):
            return empty
        a = a.sort_values("k", kind="stable")
        m, u = unit(a["v"].tolist()), unit(b["u"].tolist())
        width = min(m.shape[1], u.shape[1])
        out = []
        keys = a["k"].to_numpy()
        live = np.flatnonzero((u * u).sum(1) > 0)
        for s in range(0, len(live), 256):
            at = live[s : s + 256]
            scores = np.round(u[at, :width] @ m[:, :width].T, 9)
            top = np.argsort(-scores, axis=1, kind="stable")[:, :limit]
            for i, row in zip(at, range(len(at))):
                out.append(pd.DataFrame({"query_id": [b["q"].iloc[i]] * len(top[row]), "key": keys[top[row]], "score": scores[row, top[row]]}))
        return pd.concat(out) if out else empty

    found = left.groupBy("rb", "qb").cogroup(right.groupBy("rb", "qb")).applyInPandas(best, f"query_id {qt}, key {kt}, score double")
    return ranked(found.withColumnRenamed("key", key), key, limit)


def fuse(*lists: DataFrame, key: str) -> DataFrame:
    """Reciprocal rank fusion of ranked lists: ``(query_id, key, score)``."""
    rows = None
    for one in lists:
        part = one.select("query_id", key, (1.0 / (RRF_K + F.col("rank"))).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("query_id", key).agg(F.sum("s").alias("score"))


def rerank(candidates: DataFrame, queries: DataFrame, rows: DataFrame, key: str, limit: int | None = 10) -> DataFrame:
    """Features, their min-max normalised mean, and rank.

    ``candidates`` is (query_id, key, score); ``rows`` is (key, text, context, sent_at,
    thread_id). Features: fused score, share of query tokens found in context and text, nearness
    in days to the newest candidate (NULL dates 0), share of other candidates in the same thread.
    """
    per_query = Window.partitionBy("query_id")
    c = candidates.join(rows, key).join(queries, "query_id")
    q = F.array_distinct(tokens("query"))
    overlap = F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, tokens(F.concat_ws(" ", F.coalesce("context", F.lit("")), "text")))) / F.size(q))
    ms = F.unix_millis(F.to_timestamp("sent_at"))
    c = c.withColumn("overlap", overlap).withColumn("_ms", ms).withColumn("_new", F.max("_ms").over(per_query)).withColumn("_n", F.count("*").over(per_query))
    c = c.withColumn("recency", F.when(F.col("_ms").isNull(), 0.0).otherwise(1.0 / (1.0 + (F.col("_new") - F.col("_ms")) / 86_400_000.0)))
    same = F.count("*").over(Window.partitionBy("query_id", "thread_id"))
    c = c.withColumn("coherence", F.when(F.col("thread_id").isNull(), 0.0).otherwise((same - 1) / F.col("_n"))).withColumnRenamed("score", "rrf")
    final = None
    for f in ("rrf", "overlap", "recency", "coherence"):
        lo, hi = F.min(f).over(per_query), F.max(f).over(per_query)
        part = F.when(hi > lo, (F.col(f) - lo) / (hi - lo)).otherwise(0.0) * 0.25
        final = part if final is None else final + part
    scored = c.withColumn("score", final)
    return ranked(scored, key, limit).select("query_id", key, "score", "rank", "rrf", "overlap", "recency", "coherence")


def _said(hits: DataFrame, rows: DataFrame, key: str, *more: str) -> DataFrame:
    """(key, ``more``, norm, sh): the words of every hit text as one hash, and the hashes of its shingles, which compare faster than strings."""
    wanted = rows.join(hits.select(key).distinct(), key, "left_semi")
    # the words are a column of their own: in place, each shingle would find them anew
    split = wanted.select(key, *more, "text", tokens("text").alias("_words"))
    return split.select(key, *more, F.xxhash64(dedupe_key("text")).alias("norm"), F.transform(shingles(F.col("_words")), lambda x: F.xxhash64(x)).alias("sh"))


def duplicate_pairs(hits: DataFrame, rows: DataFrame, key: str, threshold: float = 0.9) -> DataFrame:
    """``(query_id, a, b)`` of hits of one query that nearly say the same (a < b).

    Hits per query are bounded by the candidate lists, so pairs are compared within a query.
    """
    said = _said(hits, rows, key)
    t = cut(hits.select("query_id", key).join(said, key))
    a = t.select("query_id", F.col(key).alias("a"), F.col("norm").alias("na"), F.col("sh").alias("sa"))
    b = t.select("query_id", F.col(key).alias("b"), F.col("norm").alias("nb"), F.col("sh").alias("sb"))
    # sizes rule most pairs out before sets are compared
    sized = F.least(F.size("sa"), F.size("sb")) >= threshold * F.greatest(F.size("sa"), F.size("sb"))
    return a.join(b, "query_id").filter((F.col("a") < F.col("b")) & ((F.col("na") == F.col("nb")) | (sized & (jaccard(F.col("sa"), F.col("sb")) >= threshold)))).select("query_id", "a", "b")


def _fold(threshold: float) -> Callable:
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        # the earliest first: it stands for its cluster
        rows = rows.sort_values(["dated", "sent_at", "k"], ascending=[False, True, True], kind="stable")
        norm, sets, score, keys = rows["norm"].tolist(), [set(x) for x in rows["sh"]], rows["score"].tolist(), rows["k"].tolist()
        head = list(range(len(keys)))

        def find(i: int) -> int:
            while head[i] != i:
                head[i] = i = head[head[i]]
            return i

        for i in range(len(keys)):
            for j in range(i):
                a, b = len(sets[i]), len(sets[j])
                if norm[i] == norm[j] or (min(a, b) >= threshold * max(a, b) > 0 and (both := len(sets[i] & sets[j])) / (a + b - both) >= threshold):
                    x, y = find(i), find(j)
                    head[max(x, y)] = min(x, y)
        groups: dict[int, list[int]] = {}
        for i in range(len(keys)):
            groups.setdefault(find(i), []).append(i)
        return pd.DataFrame({"query_id": [key[0]] * len(groups), "k": [keys[g] for g in groups], "score": [max(score[i] for i in m) for m in groups.values()], "duplicates": [[keys[i] for i in m[1:]] for m in groups.values()]})

    return run


def collapse(hits: DataFrame, rows: DataFrame, key: str, limit: int = 10, threshold: float = 0.9) -> DataFrame:
    """Near copies folded: ``(query_id, key, score, rank, duplicates)``.

    ``hits`` is (query_id, key, score); ``rows`` also has sent_at. Clusters are transitive; the
    earliest sent (then the smallest key) stands for its cluster, takes the best score in it and
    lists the others in order. Folding comes before the cut to ``limit``. A query has no more hits than
    its candidate lists hold, so its clusters are made in one step, by the rule of ``duplicate_pairs``.
    """
    said = _said(hits, rows, key, "sent_at")
    h = hits.join(said, key).select("query_id", F.col(key).alias("k"), "score", F.col("sent_at").isNotNull().alias("dated"), F.coalesce("sent_at", F.lit("")).alias("sent_at"), "norm", "sh")
    kinds = dict(hits.dtypes)
    folded = h.groupBy("query_id").applyInPandas(_fold(threshold), f"query_id {kinds['query_id']}, k {kinds[key]}, score double, duplicates array<{kinds[key]}>")
    return ranked(folded.withColumnRenamed("k", key), key, limit).select("query_id", key, "score", "rank", "duplicates")


def neighbours(hits: DataFrame, messages: DataFrame, reach: int = 2, chars: int = 1200) -> DataFrame:
    """``(message_id, neighbours)``: the messages around each one in its thread.

    ``messages`` is (message_id, thread_id, sent_at, text). Up to ``reach`` on either side by
    (sent_at, message_id), texts cut to ``chars``. Hits without neighbours are left out. Ranks come
    from one sort per thread; the window never gathers more than 2*reach+1 rows.
    """
    w = Window.partitionBy("thread_id").orderBy("sent_at", "message_id")
    s = F.struct("message_id", F.substring("text", 1, chars).alias("text"))
    placed = messages.filter("thread_id is not null").withColumn("near", F.collect_list(s).over(w.rowsBetween(-reach, reach)))
    mine = placed.withColumn("neighbours", F.filter("near", lambda x: x["message_id"] != F.col("message_id")))
    return mine.filter(F.size("neighbours") > 0).join(hits.select("message_id").distinct(), "message_id", "left_semi").select("message_id", "neighbours")
