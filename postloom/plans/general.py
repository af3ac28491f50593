"""Queries of the history, as-of and hierarchy operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postloom.operators.asknown import senders_at
from postloom.operators.hierarchy import descendants, paths, reply_tree
from postloom.operators.history import fact_history
from postloom.session import cut
from postloom.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Versions of every entity and relation believed now."""
    return fact_history(table(spark, d, "facts")).select("entity", "relation", "valid_from", F.coalesce("valid_to", F.lit("")).alias("valid_to"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The person who held the sender's address when the message was sent."""
    return senders_at(table(spark, d, "messages"), table(spark, d, "people"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every message in its reply tree."""
    return reply_tree(table(spark, d, "messages")).select("message_id", F.col("root").alias("root_id"), F.col("depth").cast("int").alias("depth"))


def p6_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root and number of descendants of every message."""
    tree = cut(reply_tree(table(spark, d, "messages")))
    return tree.join(paths(tree), "id").select("message_id", F.array_join("path", " ").alias("path"), (F.coalesce("size", F.lit(1)) - 1).alias("n_descendants"))


def p6_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Every message with each message below it in its tree."""
    tree = cut(reply_tree(table(spark, d, "messages")))
    return descendants(tree)


QUERIES = {f.__name__: f for f in (p3_found, p4_found, p6_found, p6_paths, p6_descendants)}

_LINKS = r"""
m AS (SELECT DISTINCT message_id, in_reply_to, references_json FROM messages WHERE message_id IS NOT NULL),
b AS (SELECT message_id, regexp_replace(trim(message_id), '^<(.*)>$', '\1') AS id,
        regexp_replace(trim(in_reply_to), '^<(.*)>$', '\1') AS irt,
        CASE WHEN json_valid(references_json) THEN from_json(references_json, '["VARCHAR"]') END AS refs FROM m),
r AS (SELECT id, unnest(refs) AS ref, generate_subscripts(refs, 1) AS pos FROM b),
k AS (SELECT r.id, arg_max(p.id, r.pos) AS parent FROM r JOIN b p ON regexp_replace(trim(r.ref), '^<(.*)>$', '\1') = p.id GROUP BY r.id),
link AS (SELECT b.message_id, b.id, coalesce(p.id, k.parent) AS parent FROM b LEFT JOIN b p ON b.irt = p.id LEFT JOIN k ON k.id = b.id),
down AS (SELECT id, id AS root, 0 AS depth, id AS path FROM link WHERE parent IS NULL
   UNION ALL SELECT c.id, d.root, d.depth + 1, d.path || ' ' || c.id FROM link c JOIN down d ON c.parent = d.id)
"""

SQL = {
    "p3_found": r"""
WITH f AS (
  SELECT DISTINCT fact_id, created_at, upper(trim(entity)) AS entity, relation,
    substr(trim(valid_from), 1, 10) AS s, substr(trim(valid_to), 1, 10) AS e,
    regexp_replace(lower(regexp_replace(value_json, '\s', '', 'g')), '^"(.*)"$', '\1') AS t
  FROM facts WHERE expired_at IS NULL),
one AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY entity, relation, s ORDER BY created_at DESC, fact_id DESC) = 1),
span AS (SELECT entity, relation, s, coalesce(try_cast(t AS DOUBLE)::VARCHAR, t) AS v,
    least(e, lead(s) OVER (PARTITION BY entity, relation ORDER BY s)) AS e FROM one),
live AS (SELECT * FROM span WHERE e IS NULL OR e > s),
mark AS (SELECT *, CASE WHEN lag(e) OVER w = s AND lag(v) OVER w IS NOT DISTINCT FROM v THEN 0 ELSE 1 END AS fresh FROM live WINDOW w AS (PARTITION BY entity, relation ORDER BY s)),
run AS (SELECT *, sum(fresh) OVER (PARTITION BY entity, relation ORDER BY s) AS g FROM mark)
SELECT entity, relation, min(s) AS valid_from, coalesce(arg_max(coalesce(e, ''), s), '') AS valid_to FROM run GROUP BY entity, relation, g
""",
    "p4_found": r"""
WITH h AS (SELECT DISTINCT person_id, lower(trim(a.address)) AS address, try_cast(a.from_date AS TIMESTAMP) AS f, try_cast(a.to_date AS TIMESTAMP) AS t
  FROM (SELECT person_id, unnest(addresses) AS a FROM people)),
m AS (SELECT DISTINCT message_id, lower(trim(from_address)) AS address, try_cast(replace(sent_at, 'Z', '') AS TIMESTAMP) AS ts FROM messages WHERE sent_at IS NOT NULL)
SELECT message_id, person_id FROM m JOIN h ON m.address = h.address AND (f IS NULL OR f <= ts) AND (t IS NULL OR t > ts)
QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY f DESC NULLS LAST, person_id) = 1
""",
    "p6_found": f"""
WITH RECURSIVE {_LINKS},
up AS (SELECT id, parent AS cur FROM link WHERE id NOT IN (SELECT id FROM down)
   UNION SELECT up.id, link.parent FROM up JOIN link ON up.cur = link.id),
looped AS (SELECT up.id, min(up.cur) AS root FROM up JOIN up b ON b.id = up.cur AND b.cur = up.cur GROUP BY up.id)
SELECT link.message_id, coalesce(down.root, looped.root) AS root_id, coalesce(down.depth, -1) AS depth
FROM link LEFT JOIN down USING (id) LEFT JOIN looped USING (id)
""",
    "p6_paths": f"""
WITH RECURSIVE {_LINKS},
pairs AS (SELECT unnest(string_split(path, ' ')) AS anc FROM down),
cnt AS (SELECT anc AS id, count(*) - 1 AS n FROM pairs GROUP BY anc)
SELECT link.message_id, coalesce(down.path, '') AS path, coalesce(cnt.n, 0) AS n_descendants
FROM link LEFT JOIN down USING (id) LEFT JOIN cnt USING (id)
""",
    "p6_descendants": f"""
WITH RECURSIVE {_LINKS},
pairs AS (SELECT id, unnest(string_split(path, ' ')) AS ancestor FROM down)
SELECT ancestor, id FROM pairs WHERE ancestor <> id
""",
}
