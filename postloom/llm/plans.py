"""Queries of the corpus operators over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.llm.fresh import fresh_text, quoted_lines
from postloom.llm.names import spelling_pairs
from postloom.llm.neardup import expand, groups, near_pairs
from postloom.llm import pii
from postloom.llm.mixing import draw
from postloom.llm.packing import covered, pack
from postloom.llm.pieces import covers, message_pieces
from postloom.session import cut


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Messages that the splitter cuts."""
    return message_pieces(_table(spark, d, "messages")).filter("chunk_index > 0").select("message_id").distinct()


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """Spans of the pieces of every message."""
    return message_pieces(_table(spark, d, "messages"))


def p1_cover(spark: SparkSession, d: str) -> DataFrame:
    """Messages with a body, and whether their pieces keep to the rules."""
    m = _table(spark, d, "messages")
    return covers(m, message_pieces(m)).select("message_id", "sound")


def p9_allowed(spark: SparkSession, d: str) -> DataFrame:
    """Drawn documents: whether each is one of its source and used no more than allowed."""
    drawn = draw(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[0]
    docs = _table(spark, d, "documents").select("doc_id", F.col("source").alias("own")).distinct()
    cap = _table(spark, d, "mix_targets").groupBy("source").agg(F.min("max_repeats").alias("cap"))
    seen = drawn.join(docs, "doc_id").join(cap, "source").withColumn("sound", (F.col("own") == F.col("source")) & F.col("repeats").between(1, F.col("cap")) & (F.col("tokens") > 0))
    return seen.groupBy("source").agg(F.min("sound").alias("sound"), (F.count("*") == F.countDistinct("doc_id")).alias("once"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines the sender of a message did not newly write."""
    return quoted_lines(_table(spark, d, "messages"))


def p2_fresh(spark: SparkSession, d: str) -> DataFrame:
    """The newly written text of every message."""
    return fresh_text(_table(spark, d, "messages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of spellings of one person or firm."""
    return spelling_pairs(_table(spark, d, "messages"), _table(spark, d, "message_recipients"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of chunks that share 0.6 of their three-word sequences."""
    pairs, members = near_pairs(_table(spark, d, "chunks"), "chunk_id", "text", size=3, threshold=0.6, min_words=50)
    out = expand(cut(pairs), cut(members), "chunk_id")
    return out.select(F.col("a").alias("chunk_a"), F.col("b").alias("chunk_b"))


def p7_groups(spark: SparkSession, d: str) -> DataFrame:
    """Class and number of links of every document (five words, 0.8)."""
    pairs, members = near_pairs(_table(spark, d, "documents"), "doc_id", "text", size=5, threshold=0.8)
    return groups(cut(pairs), members, "doc_id").select("doc_id", F.col("cluster").alias("class_id"), "links")


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Containers of 2,048 tokens with their documents and free space."""
    return pack(_table(spark, d, "documents"))


def p8_cover(spark: SparkSession, d: str) -> DataFrame:
    """Every document with whether its containers keep to the rules."""
    return covered(pack(_table(spark, d, "documents"))).select("doc_id", "sound")


def p9_drawn(spark: SparkSession, d: str) -> DataFrame:
    """Drawn documents with their repeats."""
    return draw(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return draw(_table(spark, d, "documents"), _table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Mentions of personal information in every document."""
    return pii.mentions(_table(spark, d, "documents"), given=_table(spark, d, "people").select("name"))


def p10_masked(spark: SparkSession, d: str) -> DataFrame:
    """Every document with typed placeholders."""
    return pii.masked(_table(spark, d, "documents"), given=_table(spark, d, "people").select("name")).select("doc_id", "text")


QUERIES = {f.__name__: f for f in (p1_found, p1_pieces, p1_cover, p2_found, p2_fresh, p5_found, p7_found, p7_groups, p8_containers, p8_cover, p9_drawn, p9_allowed, p9_shares, p10_found, p10_masked)}

SQL = {
    "p1_cover": "SELECT DISTINCT message_id, true AS sound FROM messages WHERE body_text <> ''",
    "p9_allowed": "SELECT DISTINCT source, true AS sound, true AS once FROM documents JOIN mix_targets USING (source) WHERE target_share > 0 AND max_repeats > 0 AND trim(text) <> ''",
    "p8_cover": "SELECT DISTINCT doc_id, true AS sound FROM documents WHERE doc_id IS NOT NULL",
    "p1_found": "SELECT DISTINCT message_id FROM messages WHERE length(body_text) > 1200",
    "p7_found": r"""
WITH d AS (SELECT DISTINCT chunk_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM chunks),
k AS (SELECT chunk_id, w FROM d WHERE len(w) >= 50),
s AS (SELECT DISTINCT chunk_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM (SELECT chunk_id, w, unnest(generate_series(1, len(w) - 2)) AS i FROM k)),
n AS (SELECT chunk_id, count(*) AS n FROM s GROUP BY chunk_id),
o AS (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT chunk_a, chunk_b FROM o JOIN n x ON x.chunk_id = chunk_a JOIN n y ON y.chunk_id = chunk_b WHERE o >= 0.6 * (x.n + y.n - o) - 1e-9
""",
    "p7_groups": r"""
WITH RECURSIVE d AS (SELECT DISTINCT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY w) AS rep FROM d WHERE len(w) >= 5),
s AS (SELECT DISTINCT rep, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT rep, w, unnest(generate_series(1, len(w) - 4)) AS i FROM k WHERE doc_id = rep)),
n AS (SELECT rep, count(*) AS n FROM s GROUP BY rep),
o AS (SELECT a.rep AS a, b.rep AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.rep < b.rep GROUP BY ALL),
p AS (SELECT a, b FROM o JOIN n x ON x.rep = a JOIN n y ON y.rep = b WHERE o >= 0.8 * (x.n + y.n - o) - 1e-9),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
walk AS (SELECT DISTINCT a AS id, a AS seen FROM e UNION SELECT walk.id, e.b FROM walk JOIN e ON walk.seen = e.a),
c AS (SELECT id, min(seen) AS component FROM walk GROUP BY id),
l AS (SELECT a AS id, count(*) AS links FROM e GROUP BY a)
SELECT doc_id, coalesce(component, rep) AS class_id, coalesce(links, 0) AS links FROM k LEFT JOIN c ON c.id = rep LEFT JOIN l ON l.id = rep
""",
}
