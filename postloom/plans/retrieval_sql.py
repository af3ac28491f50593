"""SQL counterparts of the retrieval queries (DuckDB dialect)."""

from __future__ import annotations

_M = "m AS (SELECT DISTINCT ON (message_id) * FROM messages)"
_C = "c AS (SELECT DISTINCT ON (chunk_id) * FROM chunks)"
_R = "r AS (SELECT DISTINCT message_id, lower(address) AS address, name, kind FROM message_recipients)"
_ACT = f"""{_M}, {_R},
act AS (SELECT * FROM (SELECT lower(from_address) AS address, from_name AS name, message_id, sent_at FROM m
  UNION ALL SELECT r.address, r.name, m.message_id, m.sent_at FROM r JOIN m USING (message_id)) WHERE regexp_matches(address, '^.+@[^@]+$'))"""
_ADDR = "ad AS (SELECT DISTINCT lower(a.address) AS address, party_id, name AS person, a.from_date, a.to_date FROM (SELECT party_id, name, unnest(addresses) AS a FROM people))"
_TOK = "regexp_extract_all(lower({0}), '[a-z0-9]+')"
_BM25 = f"""{_M}, {_C},
q AS (SELECT DISTINCT party_id AS query_id, name AS query FROM parties),
w AS (SELECT chunk_id, unnest(list_concat({_TOK.format("coalesce(context, '')")}, {_TOK.format("coalesce(text, '')")})) AS term FROM c),
tf AS (SELECT chunk_id, term, count(*) AS f FROM w GROUP BY ALL),
dl AS (SELECT chunk_id, len({_TOK.format("coalesce(context, '')")}) + len({_TOK.format("coalesce(text, '')")}) AS dl FROM c),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
qt AS (SELECT query_id, unnest({_TOK.format("query")}) AS term FROM q),
sc AS (SELECT query_id, chunk_id, sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (chunk_id), st GROUP BY query_id, chunk_id)"""
_RANK = "row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id)"
_TOP50 = f"b AS (SELECT *, {_RANK} AS rank FROM sc QUALIFY rank <= 50)"
_OVER = f"""ov AS (SELECT query_id, chunk_id, count(*) / any_value(nq) AS score FROM
    (SELECT DISTINCT query_id, term, len(list_distinct({_TOK.format("query")})) AS nq FROM q, unnest({_TOK.format("query")}) AS t(term)) JOIN (SELECT DISTINCT chunk_id, term FROM w) USING (term) GROUP BY query_id, chunk_id),
o AS (SELECT *, {_RANK} AS rank FROM ov QUALIFY rank <= 50)"""
_PHRASE = f"""{_M}, {_C},
q AS (SELECT DISTINCT unnest(regexp_extract_all(subject, '(?:LEASE|PO|INV|CN|DN|Q)-\\d{{4}}-\\d{{4}}')) AS query_id FROM messages),
t AS (SELECT chunk_id, 0 AS col, {_TOK.format("coalesce(context, '')")} AS w FROM c UNION ALL SELECT chunk_id, 1, {_TOK.format("coalesce(text, '')")} FROM c),
pos AS (SELECT chunk_id, col, w, unnest(generate_series(1, len(w) - 2)) AS i FROM t WHERE len(w) > 2),
tri AS (SELECT chunk_id, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS phrase, count(*) AS f FROM pos GROUP BY ALL),
dl AS (SELECT chunk_id, sum(len(w)) AS dl FROM t GROUP BY chunk_id),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
h AS (SELECT query_id, chunk_id, f, count(*) OVER (PARTITION BY query_id) AS df FROM q JOIN tri ON lower(replace(query_id, '-', ' ')) = phrase),
sc AS (SELECT query_id, chunk_id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) AS score FROM h JOIN dl USING (chunk_id), st)"""
_FACT = r"""f AS (SELECT DISTINCT fact_id, created_at, upper(trim(entity)) AS entity, relation, substr(trim(valid_from), 1, 10) AS valid_from,
    regexp_replace(lower(regexp_replace(value_json, '\s', '', 'g')), '^"(.*)"$', '\1') AS t FROM facts WHERE expired_at IS NULL),
cur AS (SELECT entity, relation, valid_from, lead(valid_from) OVER (PARTITION BY entity, relation ORDER BY valid_from) AS valid_to FROM (SELECT DISTINCT entity, relation, valid_from FROM f))"""
_SUBJ = r"trim(regexp_replace(trim(subject), '^((re|fwd?|fw)\s*:\s*)+', '', 'i'))"
_EXPOSED = "message_id, thread_id, subject, from_name, from_address, sent_at, blob_hash"
_REFS = """e AS (SELECT message_id AS a, unnest(list_concat(CASE WHEN json_valid(references_json) THEN from_json(references_json, '["VARCHAR"]') ELSE [] END, [in_reply_to])) AS b FROM m),
g AS (SELECT a, b FROM e WHERE b IS NOT NULL AND b <> '' AND a <> b UNION SELECT b, a FROM e WHERE b IS NOT NULL AND b <> '' AND a <> b),
selfs AS (SELECT a FROM e WHERE b IS NOT NULL AND b <> '')"""

SQL = {
    "fragments_cover": "SELECT DISTINCT message_id, true AS sound, length(regexp_replace(body_text, '\\s', '', 'g')) AS letters FROM messages WHERE regexp_matches(body_text, '\\S')",
    "chunks_cover": "SELECT DISTINCT message_id, true AS sound FROM messages WHERE regexp_matches(body_text, '\\S')",
    "threads_cover": f"""WITH {_M}, kept AS (SELECT message_id FROM m) SELECT message_id, true AS sound FROM kept""",
    "bm25_topk": f"WITH {_BM25} SELECT query_id, chunk_id, round(score, 6) AS score, {_RANK} AS rank FROM sc QUALIFY rank <= 10",
    "bm25_filtered": f"""WITH {_BM25}, ok AS (SELECT chunk_id FROM c JOIN m USING (message_id) WHERE sent_at >= '2024-01-01' AND sent_at < '2025-01-01' AND source_kind = 'message')
SELECT query_id, chunk_id, round(score, 6) AS score, {_RANK} AS rank FROM sc WHERE chunk_id IN (SELECT chunk_id FROM ok) QUALIFY rank <= 10""",
    "bm25_phrase": f"""WITH {_PHRASE}
SELECT query_id, chunk_id, round(score, 6) AS score, {_RANK} AS rank FROM sc QUALIFY rank <= 10""",
    "vector_topk": """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_cosine_similarity(a.v, b.v) AS score FROM e a JOIN e b ON a.vec_id % 20 = 0)
SELECT query_id, vec_id, round(score, 5) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 10""",
    "token_overlap": f"WITH {_BM25}, {_OVER} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM o",
    "rrf_fusion": f"""WITH {_BM25}, {_TOP50}, {_OVER}
SELECT query_id, chunk_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, chunk_id, rank FROM b UNION ALL SELECT query_id, chunk_id, rank FROM o) GROUP BY query_id, chunk_id""",
    "rerank_features": f"""WITH {_BM25}, {_TOP50},
x AS (SELECT b.query_id, b.chunk_id, 1.0::DOUBLE / (60 + b.rank) AS rrf,
    len(list_intersect(list_distinct({_TOK.format("q.query")}), {_TOK.format("coalesce(c.context, '') || ' ' || c.text")})) / len(list_distinct({_TOK.format("q.query")})) AS overlap,
    epoch_ms(try_cast(replace(m.sent_at, 'Z', '') AS TIMESTAMP)) AS ms, m.thread_id FROM b JOIN q USING (query_id) JOIN c USING (chunk_id) LEFT JOIN m ON m.message_id = c.message_id),
y AS (SELECT *, CASE WHEN ms IS NULL THEN 0 ELSE 1 / (1 + (max(ms) OVER w - ms) / 86400000.0) END AS recency,
    CASE WHEN thread_id IS NULL THEN 0 ELSE (count(*) OVER (PARTITION BY query_id, thread_id) - 1) / count(*) OVER w END AS coherence FROM x WINDOW w AS (PARTITION BY query_id)),
z AS (SELECT *, {" + ".join(f"(CASE WHEN max({f}) OVER w > min({f}) OVER w THEN ({f} - min({f}) OVER w) / (max({f}) OVER w - min({f}) OVER w) ELSE 0 END) * 0.25" for f in ("rrf", "overlap", "recency", "coherence"))} AS score FROM y WINDOW w AS (PARTITION BY query_id))
SELECT query_id, chunk_id, {_RANK} AS rank, round(score, 6) AS score, round(rrf, 6) AS rrf, round(overlap, 6) AS overlap, round(recency, 6) AS recency, round(coherence, 6) AS coherence FROM z QUALIFY rank <= 10""",
    "candidate_duplicates": f"""WITH {_PHRASE}, {_TOP50},
n AS (SELECT chunk_id, {_TOK.format("text")} AS t FROM c WHERE chunk_id IN (SELECT chunk_id FROM b)),
sh AS (SELECT chunk_id, array_to_string(t, ' ') AS norm, CASE WHEN len(t) = 0 THEN [] WHEN len(t) < 5 THEN [array_to_string(t, ' ')] ELSE list_distinct(list_transform(generate_series(1, len(t) - 4), lambda i: array_to_string(t[i:i+4], ' '))) END AS s FROM n),
p AS (SELECT x.query_id, x.chunk_id AS a, y.chunk_id AS b FROM b x JOIN b y ON x.query_id = y.query_id AND x.chunk_id < y.chunk_id)
SELECT query_id, a, b FROM p JOIN sh u ON u.chunk_id = a JOIN sh v ON v.chunk_id = b
WHERE u.norm = v.norm OR (least(len(u.s), len(v.s)) >= 0.9 * greatest(len(u.s), len(v.s)) AND len(list_intersect(u.s, v.s)) / (len(u.s) + len(v.s) - len(list_intersect(u.s, v.s))) >= 0.9)""",
    "exact_dups": "SELECT sha256(text) AS hash, count(*) AS copies, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "thread_view": f"WITH {_M} SELECT thread_id, string_agg(message_id, ' ' ORDER BY coalesce(sent_at, ''), message_id) AS messages, count(*) AS n FROM m WHERE thread_id IS NOT NULL GROUP BY thread_id",
    "thread_expand": f"""WITH {_M}, p AS (SELECT thread_id, message_id, body_text, row_number() OVER (PARTITION BY thread_id ORDER BY coalesce(sent_at, ''), message_id) AS n FROM m WHERE thread_id IS NOT NULL)
SELECT a.message_id, string_agg(b.message_id, ' ' ORDER BY b.n) AS around, sum(least(length(b.body_text), 1200))::BIGINT AS chars FROM p a JOIN p b ON a.thread_id = b.thread_id AND b.n BETWEEN a.n - 2 AND a.n + 2 AND a.n <> b.n GROUP BY a.message_id""",
    "thread_bounds": f"WITH {_M} SELECT thread_id, min(sent_at) AS first_at, max(sent_at) AS last_at, arg_min({_SUBJ}, coalesce(sent_at, '￿') || ' ' || message_id) AS subject FROM m WHERE thread_id IS NOT NULL GROUP BY thread_id",
    "thread_coherence": f"WITH {_BM25}, {_TOP50} SELECT query_id, thread_id, count(*) AS candidates FROM b JOIN c USING (chunk_id) JOIN m ON m.message_id = c.message_id WHERE thread_id IS NOT NULL GROUP BY ALL",
    "reply_components": f"""WITH RECURSIVE {_M}, {_REFS},
walk AS (SELECT DISTINCT a AS id, a AS seen FROM (SELECT a FROM g UNION SELECT a FROM selfs) UNION SELECT walk.id, g.b FROM walk JOIN g ON walk.seen = g.a)
SELECT id, min(seen) AS component FROM walk GROUP BY id""",
    "subject_norm": f"WITH {_M} SELECT lower({_SUBJ}) AS subject, count(*) AS n FROM m GROUP BY 1",
    "context_prefix": f"""WITH {_M}, t AS (SELECT DISTINCT message_id, address, CASE kind WHEN 'to' THEN 0 WHEN 'cc' THEN 1 ELSE 2 END AS o FROM message_recipients),
rc AS (SELECT message_id, string_agg(address, ', ' ORDER BY o, address) AS rcpt FROM t GROUP BY message_id)
SELECT message_id, 'Email from ' || coalesce(from_address, '') || ' to ' || coalesce(rcpt, '') || ' on ' || coalesce(sent_at, '') || ', subject: ' || coalesce(subject, '') || '.' AS context FROM m LEFT JOIN rc USING (message_id)""",
    "facts_current": f"WITH {_FACT} SELECT entity, relation, valid_from, valid_to FROM cur",
    "facts_backfill": f"WITH {_FACT} SELECT entity, relation, valid_from, valid_to FROM cur",
    "facts_as_of": f"WITH {_FACT} SELECT entity, relation, day, valid_from FROM cur, unnest(['2023-07-01', '2024-06-30', '2025-03-15']) AS d(day) WHERE valid_from <= day AND (valid_to IS NULL OR day < valid_to)",
    "facts_history": f"""WITH {_FACT},
q AS (SELECT entity, relation, valid_from AS vf, created_at AS t, row_number() OVER (PARTITION BY entity, relation ORDER BY created_at, fact_id) AS i FROM f WHERE valid_from IS NOT NULL),
g AS (SELECT a.entity, a.relation, a.vf, a.i, min(b.i) AS gone FROM q a LEFT JOIN q b ON a.entity = b.entity AND a.relation = b.relation AND a.vf = b.vf AND b.i > a.i GROUP BY ALL),
p AS (SELECT a.*, b.i AS j, b.vf AS bvf, b.t AS bt, min(b.vf) OVER (PARTITION BY a.entity, a.relation, a.i ORDER BY b.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM g a JOIN q b ON a.entity = b.entity AND a.relation = b.relation AND b.vf > a.vf),
s0 AS (SELECT g.entity, g.relation, g.vf, g.i, g.gone, g.i AS at_, (SELECT min(p.bvf) FROM p WHERE p.entity = g.entity AND p.relation = g.relation AND p.i = g.i AND p.j < g.i) AS vt FROM g),
s1 AS (SELECT entity, relation, vf, i, gone, j AS at_, bvf AS vt FROM p WHERE j > i AND (gone IS NULL OR j < gone) AND (before IS NULL OR bvf < before)),
a AS (SELECT * FROM s0 UNION ALL SELECT * FROM s1),
n AS (SELECT *, coalesce(lead(at_) OVER (PARTITION BY entity, relation, i ORDER BY at_), gone) AS ends FROM a)
SELECT n.entity, n.relation, n.vf AS valid_from, n.vt AS valid_to, x.t AS created_at, y.t AS expired_at FROM n
JOIN q x ON x.entity = n.entity AND x.relation = n.relation AND x.i = n.at_ LEFT JOIN q y ON y.entity = n.entity AND y.relation = n.relation AND y.i = n.ends""",
    "facts_json_value": r"""SELECT relation, CASE WHEN v LIKE '"%' THEN 'string' WHEN regexp_matches(v, '^-?[0-9.]+$') THEN 'number' ELSE 'other' END AS kind, count(*) AS n
FROM (SELECT DISTINCT fact_id, relation, regexp_replace(value_json, '\s+', '', 'g') AS v FROM facts) GROUP BY ALL""",
    "resolve_windowed": f"""WITH {_M}, {_ADDR}, q AS (SELECT DISTINCT lower(from_address) AS address, sent_at AS day FROM m WHERE sent_at IS NOT NULL)
SELECT address, day, party_id FROM q JOIN ad USING (address) WHERE (from_date IS NULL OR from_date <= day) AND (to_date IS NULL OR day < to_date)
QUALIFY row_number() OVER (PARTITION BY address, day ORDER BY from_date DESC NULLS LAST, party_id) = 1""",
    "timeline_merge": f"""WITH {_M}, {_R}, {_ADDR}, own AS (SELECT DISTINCT address, party_id FROM ad),
x AS (SELECT DISTINCT message_id, lower(from_address) AS address FROM m UNION SELECT message_id, address FROM r),
msg AS (SELECT DISTINCT party_id, message_id FROM x JOIN own USING (address)),
ev AS (SELECT DISTINCT upper(trim(entity)) AS party_id, valid_from AS at_, 'fact' AS type, fact_id::VARCHAR AS ref FROM facts WHERE expired_at IS NULL
  UNION ALL SELECT party_id, sent_at, 'message', message_id FROM msg JOIN m USING (message_id) WHERE sent_at IS NOT NULL)
SELECT party_id, type, substr(at_, 1, 7) AS month, count(*) AS n, min(at_) AS first_at FROM ev GROUP BY ALL""",
    "address_stats": f"""WITH {_ACT},
k AS (SELECT address, name, count(*) AS k FROM act WHERE trim(name) <> '' GROUP BY ALL),
n AS (SELECT address, name FROM k QUALIFY row_number() OVER (PARTITION BY address ORDER BY k DESC, name) = 1)
SELECT act.address, regexp_extract(act.address, '^.+@([^@]+)$', 1) AS domain, count(DISTINCT message_id) AS messages, min(sent_at) AS min_at, max(sent_at) AS max_at, any_value(n.name) AS person FROM act LEFT JOIN n USING (address) GROUP BY act.address""",
    "domain_groups": f"""WITH {_ACT}, a AS (SELECT regexp_extract(address, '^.+@([^@]+)$', 1) AS domain, address, message_id FROM act)
SELECT domain, count(DISTINCT address) AS addresses, count(DISTINCT message_id) AS messages,
  array_to_string(list_transform(string_split(regexp_replace(domain, '^.*?([^.]+)\\.[^.]+$', '\\1'), '-'), lambda w: upper(w[1]) || w[2:]), ' ') AS title FROM a GROUP BY domain HAVING addresses >= 2 OR messages >= 5""",
    "mode_tiebreak": "SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1",
    "person_move_pairs": f"""WITH {_ACT},
x AS (SELECT regexp_replace(lower(trim(regexp_replace(regexp_replace(trim(name), '^["'']+', ''), '["'']+$', ''))), '\\s+', ' ', 'g') AS norm, address, sent_at FROM act),
f AS (SELECT norm, address, min(sent_at) AS first_at FROM x WHERE length(norm) >= 6 AND norm LIKE '% %' GROUP BY ALL),
l AS (SELECT norm, lag(address) OVER (PARTITION BY norm ORDER BY coalesce(first_at, '￿'), address) AS earlier, address AS later FROM f)
SELECT norm, earlier, later FROM l WHERE earlier IS NOT NULL AND regexp_extract(earlier, '@([^@]+)$', 1) <> regexp_extract(later, '@([^@]+)$', 1)""",
    "sql_filter_eq": f"WITH {_M} SELECT {_EXPOSED} FROM m WHERE from_address = 'notices@ledgerhub.example'",
    "sql_filter_range": f"WITH {_M} SELECT {_EXPOSED} FROM m WHERE sent_at >= '2024-03-01' AND sent_at < '2024-04-01' AND thread_id <> ''",
    "sql_filter_like": f"WITH {_M} SELECT {_EXPOSED} FROM m WHERE subject ILIKE 're: %NOTE%'",
    "sql_filter_top": f"WITH {_M} SELECT {_EXPOSED} FROM m WHERE sent_at > '2024-01-01' ORDER BY message_id DESC LIMIT 40",
    "semi_party": f"""WITH {_ADDR}, own AS (SELECT DISTINCT address FROM ad WHERE party_id IN (SELECT party_id FROM parties WHERE is_self))
SELECT DISTINCT message_id FROM (SELECT message_id, lower(from_address) AS address FROM messages UNION ALL SELECT message_id, lower(address) FROM message_recipients) WHERE address IN (SELECT address FROM own)""",
    "anti_missing_embedding": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "exists_mime": f"WITH {_C} SELECT chunk_id FROM c WHERE json_extract_string(meta_json, '$.from') ILIKE 'accounts@%'",
    "union_senders_recipients": f"WITH {_ACT} SELECT address, count(*) AS n, count(sent_at) AS dated FROM act GROUP BY address",
    "doc_chain": "SELECT l_orderkey AS root_id, l_linenumber AS version, lag(l_linenumber) OVER w AS supersedes, row_number() OVER w AS place FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)",
    "quarantine_split": """SELECT DISTINCT sha256(coalesce(text, '')) AS blob_hash, CASE WHEN length(text) > 20000 THEN 'oversize' ELSE 'degenerate' END AS reason
FROM documents WHERE length(text) > 20000 OR trim(coalesce(text, '')) = ''""",
    "idempotent_reingest": "SELECT message_id, blob_hash, count(*) > 1 AS repeated FROM messages GROUP BY ALL",
    "tombstone_purge": f"WITH {_C} SELECT chunk_id FROM c WHERE blob_hash NOT IN (SELECT blob_hash FROM messages WHERE from_address = 'notices@ledgerhub.example')",
    "get_source": f"WITH {_C}, {_M} SELECT chunk_id, text = substring(body_text, span_start + 1, span_end - span_start) AS exact FROM c JOIN m USING (message_id)",
    "fact_grounding": rf"""WITH {_M}, f AS (SELECT DISTINCT fact_id, value_json, source_message FROM facts WHERE source_message IS NOT NULL)
SELECT fact_id, contains(regexp_replace(lower(body_text), '[\s"]+', '', 'g'), regexp_replace(lower(value_json), '[\s"]+', '', 'g')) AS grounded FROM f JOIN m ON m.message_id = f.source_message""",
    "latency_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(CASE WHEN r = ceil(n * 0.5) THEN value END) AS p50, max(CASE WHEN r = ceil(n * 0.95) THEN value END) AS p95 FROM r GROUP BY event_type""",
    "html_text": r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[ \t ]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g'), ' ' || chr(10) || chr(13) || chr(9)) AS text FROM documents WHERE text IS NOT NULL""",
}
