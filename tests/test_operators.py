"""Core operators against small brute-force models and edge cases."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from postloom.functions import mail as rules
from postloom.functions import text, vectors
from postloom.operators import asknown, components, hierarchy, history, ledger, search, skew, threads

FACTS = "fact_id bigint, entity string, relation string, value_json string, valid_from string, valid_to string, created_at string, expired_at string, extra string"


def brute_history(rows):
    best = {}
    for f, e, r, v, s, t, c, x, _ in rows:
        if x is None and s is not None:
            k = ((e or "").strip().upper() if e is not None else None, r, s[:10])
            if k not in best or (c, f) > best[k][0]:
                best[k] = ((c, f), v.strip().lower().strip('"'), t[:10] if t else None)
    out = []
    for e, r in {(k[0], k[1]) for k in best}:
        days = sorted(k[2] for k in best if k[:2] == (e, r))
        spans = []
        for d, nxt in zip(days, [*days[1:], None]):
            _, v, t = best[(e, r, d)]
            end = min([x for x in (nxt, t) if x], default=None)
            if end is None or end > d:
                if spans and spans[-1][1] == d and spans[-1][2] == v:
                    spans[-1] = (spans[-1][0], end, v)
                else:
                    spans.append((d, end, v))
        out += [(e, r, a, b) for a, b, _ in spans]
    return sorted(out, key=str)


def test_fact_history_matches_model(rows):
    rnd = random.Random(1)
    data = []
    for i in range(400):
        day = f"2024-01-{rnd.randint(1, 28):02d}"
        end = f"2024-01-{rnd.randint(1, 28):02d}T10:00:00.000Z" if rnd.random() < 0.2 else None
        data.append((i, rnd.choice(["p1", " P1", "p2", None]), rnd.choice(["a", "b", None]), rnd.choice(['"X"', '"x"', '"y"']), day if rnd.random() < 0.9 else None, end, f"2024-02-{rnd.randint(1, 28):02d}", "2024-03-01" if rnd.random() < 0.1 else None, "z"))
    data += data[:40]  # repeated rows
    got = history.fact_history(rows(data, FACTS)).select("entity", "relation", "valid_from", "valid_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_history(data)
    assert history.fact_history(rows([], FACTS)).count() == 0


def test_values_compare_by_amount(rows):
    v = ["10", '"10.0"', " 1 0 ", '"NET 30"', '"net30 "', "010.50", "10.5", "-0", "0", "1e2", "100"]
    k = [r[0] for r in rows([(x,) for x in v], "v string").select(history.value_key(F.col("v"))).collect()]
    assert k[0] == k[1] == k[2] and k[3] == k[4] and k[5] == k[6] and k[7] == k[8] and k[9] == k[10] and k[0] != k[5]


def test_senders_never_see_later_holders(rows):
    people = rows(
        [("P1", [("A@x", None, "2024-03-10"), ("a@x", "2024-05-01", None)], 1), ("P2", [("a@x", "2024-03-10", "2024-04-01T12:00:00Z")], 1), ("P3", None, 1), ("P2", [("a@x", "2024-03-10", "2024-04-01T12:00:00Z")], 1)],
        "person_id string, addresses array<struct<address:string,from_date:string,to_date:string>>, key int",
    )
    sent = {"m1": "2020-01-01T00:00:00.000Z", "m2": "2024-03-09T23:59:59.999Z", "m3": "2024-03-10T00:00:00.000Z", "m4": "2024-04-01T11:59:59.999Z", "m5": "2024-04-01T12:00:00.000Z", "m6": "2024-06-01T00:00:00.000Z", "m7": None}
    m = rows([(k, "a@X", v, 3) for k, v in sent.items()] + [("m8", None, "2024-06-01T00:00:00.000Z", 3), ("m9", "b@x", "2024-06-01T00:00:00.000Z", 3)], "message_id string, from_address string, sent_at string, period int")
    got = {tuple(r) for r in asknown.senders_at(m, people).collect()}
    assert got == {("m1", "P1"), ("m2", "P1"), ("m3", "P2"), ("m4", "P2"), ("m6", "P1")}
    assert asknown.senders_at(m.limit(0), people).count() == 0 and asknown.senders_at(m, people.limit(0)).count() == 0


def test_attributes_keep_event_columns_whatever_their_names(rows):
    t = "timestamp'2024-01-10 00:00:00'"
    events = rows([("a", 1, 2, 3, 4)], "k string, period int, snapshot int, holder int, event int").selectExpr("*", f"{t} as at")
    held = rows([("a", "P")], "key string, holder string").selectExpr("*", "cast(null as timestamp) as valid_from", "cast(null as timestamp) as valid_to")
    got = asknown.attributes_at(events, held, "k", "at").first().asDict()
    assert (got["k"], got["period"], got["snapshot"], got["event"], got["holder"]) == ("a", 1, 2, 4, "P")


def brute_tree(parent):
    out = {}
    for v in parent:
        seen, p = [], v
        while p is not None and p not in seen:
            seen.append(p)
            p = parent[p]
        if p is None:
            out[v] = (seen[-1], len(seen) - 1, seen[::-1])
        else:
            out[v] = (min(seen[seen.index(p) :]), -1, [])
    return out


@pytest.mark.parametrize("seed,n,tree_rows", [(1, 60, 100_000), (2, 200, 100_000), (2, 200, 10)])
def test_hierarchy_matches_brute_force(rows, seed, n, tree_rows):
    rnd = random.Random(seed)
    ids = [f"n{i:03d}" for i in range(n)]
    parent = {v: (None if rnd.random() < 0.1 else ids[rnd.randrange(n if rnd.random() < 0.05 else max(1, i))] if rnd.random() < 0.6 else ids[max(0, i - 1)]) for i, v in enumerate(ids)}
    links = rows(list(parent.items()), "id string, parent string")
    tree = hierarchy.decompose(links, tree_rows).cache()
    want = brute_tree(parent)
    got = {r["id"]: r for r in tree.collect()}
    assert {k: (r["root"], r["depth"]) for k, r in got.items()} == {k: v[:2] for k, v in want.items()}
    assert {r["id"]: list(r["path"]) for r in hierarchy.paths(tree).collect()} == {k: v[2] for k, v in want.items()}
    below = {k: {x for x, v in want.items() if k in v[2][:-1]} for k in ids}
    for k, r in got.items():
        if r["depth"] >= 0:
            assert r["size"] == len(below[k]) + 1
            assert {x for x, s in got.items() if s["root"] == r["root"] and s["first"] is not None and r["first"] < s["first"] <= r["last"]} == below[k]
            assert len(r["segments"]) <= n.bit_length() + 1
    some = rows([(ids[0],), (ids[5],)], "id string")
    pairs = {(r["ancestor"], r["id"]) for r in hierarchy.descendants(tree, some).collect()}
    assert pairs == {(k, x) for k in (ids[0], ids[5]) if want[k][1] >= 0 for x in below[k]}


def test_reply_links_edge_cases(rows):
    schema = "message_id string, in_reply_to string, references_json string, id int"
    data = [("a", None, None, 1), ("b", " <a> ", "[]", 1), ("c", "gone", '["a","b","lost"]', 1), ("d", "", '["b","<c>"]', 1), ("e", "e", None, 1), ("f", "e", "not json", 1), ("b", " <a> ", "[]", 2), (None, "a", None, 1)]
    got = {r["id"]: r["parent"] for r in hierarchy.reply_links(rows(data, schema)).collect()}
    assert got == {"a": None, "b": "a", "c": "b", "d": "c", "e": "e", "f": "e"}
    tree = {r["id"]: (r["root"], r["depth"]) for r in hierarchy.reply_tree(rows(data, schema)).collect()}
    assert tree["d"] == ("a", 3) and tree["e"] == ("e", -1) and tree["f"] == ("e", -1)
    assert hierarchy.reply_tree(rows([], schema)).count() == 0


def test_components(rows):
    rnd = random.Random(3)
    edges = [(rnd.randrange(80), rnd.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        root[max(find(a), find(b))] = min(find(a), find(b))
    got = {r[0]: r[1] for r in components.components(rows([*edges, (None, 1)], "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}


def test_running_sum_over_a_hot_group(rows):
    data = [("hot", i, 1) for i in range(500)] + [(None, i, 2) for i in range(5)] + [("b", 0, 7)]
    got = {(r["g"], r["o"]): r["s"] for r in skew.running_sum(rows(data, "g string, o int, v int"), ["g"], [F.asc("o")], "v", "s").collect()}
    assert got == {(g, o): (o + 1) * v for g, o, v in data}
    left = rows([(k, i) for i, k in enumerate(["hot"] * 300 + ["x", None, None])], "k string, i int")
    right = rows([("hot", 1), ("y", 2)], "k string, v int")
    assert skew.salted_lookup(left, right, "k", "left").filter("v = 1").count() == 300
    assert skew.salted_lookup(left, right, "k", "left").count() == 303
    assert skew.salted_lookup(left, right, "k", "left_anti").count() == 3


def test_ledger_history_and_backfill(rows):
    log = [("e", "r", "A", "2024-01-01", "t1", 1), ("e", "r", "B", "2024-03-01", "t2", 2), ("e", "r", "C", "2024-02-01", "t3", 3), ("e", "r", "D", "2024-01-01", "t4", 4), ("e", "r", "X", None, "t5", 5)]
    df = rows(log, "entity string, relation string, value string, valid_from string, created_at string, seq bigint")
    h = sorted((tuple(r)[2:] for r in ledger.belief_history(df).collect()), key=str)
    assert h == sorted([("A", "2024-01-01", None, "t1", "t2"), ("A", "2024-01-01", "2024-03-01", "t2", "t3"), ("B", "2024-03-01", None, "t2", None), ("A", "2024-01-01", "2024-02-01", "t3", "t4"), ("C", "2024-02-01", "2024-03-01", "t3", None), ("D", "2024-01-01", "2024-02-01", "t4", None)], key=str)
    now = {tuple(r)[2:] for r in ledger.current(df).collect()}
    assert now == {x[:3] for x in h if x[4] is None}
    rnd = random.Random(4)
    shuffled = rows(rnd.sample(log[:3], 3), "entity string, relation string, value string, valid_from string, created_at string, seq bigint")
    assert {tuple(r)[2:] for r in ledger.current(ledger.backfill(shuffled)).collect()} == {tuple(r)[2:] for r in ledger.current(df.filter("seq <= 3")).collect()}


def test_threads_do_not_depend_on_order(rows):
    rnd = random.Random(5)
    data = []
    for i in range(60):
        refs = [f"m{rnd.randrange(80)}" for _ in range(rnd.randrange(3))] if rnd.random() < 0.5 else []
        data.append((f"m{i}", rnd.choice(["Re: x", "x", "", "FW: re: y", "z%d" % i]), f"2024-01-{rnd.randint(1, 28):02d}" if rnd.random() < 0.9 else None, f"m{rnd.randrange(80)}" if rnd.random() < 0.3 else None, str(refs).replace("'", '"')))
    schema = "message_id string, subject string, sent_at string, in_reply_to string, references_json string"
    model = threads.containers(sorted((m, [r for r in eval(x) if r and r != m], i) for m, _, _, i, x in data))
    one = {r["message_id"]: r["root"] for r in threads.assign(rows(data, schema)).collect()}
    rnd.shuffle(data)
    assert one == {r["message_id"]: r["root"] for r in threads.assign(rows(data, schema)).collect()}
    linked = {m for m, _, _, i, x in data if [r for r in eval(x) if r and r != m] or (i and i != m)}
    assert all(one[m] == model[m] for m in linked)
    assert threads.assign(rows([], schema)).count() == 0


def test_fragments_and_chunks():
    body = "Hello\n\nNew text\nOn Monday Bob wrote:\n> old\n>\n\nMore\n-- \nAnn\n"
    f = rules.fragments(body)
    assert [x[1] for x in f] == ["new", "quote", "new", "signature"]
    assert all(body[a:b] == t for _, _, a, b, t in f)
    assert rules.fragments("") == [] and rules.fragments(None) == [] and rules.fragments(" \n ") == []
    assert [x[1] for x in rules.fragments("text\n\nBest regards,\nAnn")] == ["new", "signature"]
    long = "word " * 600
    spans = rules.chunk_spans("short\n\n" + long + "\n\nend")
    assert all(b - a <= 1200 for a, b in spans) and spans[0] == (0, 5)
    assert rules.chunk_spans("x" * 2500) == [(0, 1200), (1200, 2400), (2400, 2500)]


def test_text_functions(rows):
    df = rows([("RE: fwd: Re:Hi ", "<p>a &lt;b&gt; &#x1F600;&#65;&bogus;</p><script>x</script>c", "a@b@acme-hq.example", '"Ann  Lee"')], "s string, h string, a string, n string")
    r = df.select(text.bare_subject("s"), text.html_text("h"), text.domain_of("a"), text.domain_title(text.domain_of("a")), text.name_key("n")).first()
    assert tuple(r) == ("Hi", "a <b> \U0001f600A&bogus;\nc", "acme-hq.example", "Acme Hq", "ann lee")
    assert [vectors.porter(w) for w in ("caresses", "ponies", "relational", "hopping", "sky", "happy", "conditional")] == ["caress", "poni", "relat", "hop", "sky", "happi", "condit"]
    assert vectors.fnv1a("") == 0x811C9DC5 and vectors.fnv1a("a") == 0xE40C292C
    assert vectors.hash_vector(None) == [0.0] * 64


def test_vector_topk_matches_brute_force(rows):
    rnd = random.Random(6)
    vs = [(i, [rnd.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(200, None), (201, [0.0] * 8)]
    df = rows(vs, "id int, vector array<double>")
    q = df.filter("id < 5 or id >= 200").withColumnRenamed("id", "query_id")
    got = {}
    for r in search.vector_topk(q, df, "id", 4, blocks=3).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["id"])

    def cos(a, b):
        dot = sum(x * y for x, y in zip(a, b))
        n = (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
        return dot / n if n else 0.0

    for i in range(5):
        assert got[i] == [k for _, k in sorted((-round(cos(vs[i][1], v), 9) if v else 0.0, k) for k, v in vs)][:4]
    assert set(got) == set(range(5))


def test_collapse_keeps_the_earliest(rows):
    long = " ".join(f"w{i}" for i in range(40))
    r = rows([("c1", long, "2024-02-01"), ("c2", long + " x", "2024-01-01"), ("c3", "other words entirely here now", None), ("c4", long.upper(), None)], "chunk_id string, text string, sent_at string")
    hits = rows([("q", "c1", 0.9), ("q", "c2", 0.1), ("q", "c3", 0.5), ("q", "c4", 0.2)], "query_id string, chunk_id string, score double")
    got = [(x["chunk_id"], x["score"], list(x["duplicates"])) for x in search.collapse(hits, r, "chunk_id").orderBy("rank").collect()]
    assert got == [("c2", 0.9, ["c1", "c4"]), ("c3", 0.5, [])]


def test_phrases_that_share_their_terms(rows, monkeypatch):
    # every number of a kind and year: each phrase shares two of its three terms with all others of its kind
    rnd = random.Random(9)
    numbers = [f"{kind}-{year}-{n}" for kind in ("po", "q") for year in (2023, 2024) for n in range(50)]
    texts = [(i, " ".join(rnd.choice([rnd.choice(numbers), "po", "2023", "17", "q 2024", "po-2023-2023"]) for _ in range(12)), rnd.choice(["", None, "po-2023", rnd.choice(numbers)])) for i in range(40)]
    asked = [(x, x) for x in numbers] + [("two", "q-2024-7 po q-2024-7"), ("twin", "po-2023-2023"), ("none", "po-2025-1 -"), ("long", "2023-17-po-2023")]
    posts, lengths = search.postings(rows(texts, "id int, text string, context string"), "id", ["context", "text"])
    read = []
    cut = search.cut
    monkeypatch.setattr(search, "cut", lambda df: read.append(df) or cut(df))
    got = {(r["query_id"], r["id"]): r["score"] for r in search.bm25(rows(asked, "query_id string, query string"), posts, lengths, "id", None, None).collect()}
    words = {i: [re.findall("[a-z0-9]+", x or "") for x in (c, t)] for i, t, c in texts}
    mean = sum(len(w) for two in words.values() for w in two) / len(texts)

    def count(i, p):
        return sum(w[j : j + len(p)] == p for w in words[i] for j in range(len(w)))

    want = {}
    for q, text_ in asked:
        for p in (re.findall("[a-z0-9]+", x) for x in text_.split()):
            f = {i: count(i, p) for i in words if p and count(i, p)}
            idf = max(math.log((len(texts) - len(f) + 0.5) / (len(f) + 0.5)), 1e-6)
            for i, n in f.items():
                want[q, i] = want.get((q, i), 0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * sum(map(len, words[i])) / mean))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    # a posting is met once however many phrases have its term
    run = read[0]._jdf.queryExecution()
    run.toRdd().count()

    def joined(node):
        mine = node.metrics().apply("numOutputRows").value() if "Join" in node.nodeName() else 0
        return max([mine, *(joined(node.children().apply(i)) for i in range(node.children().size()))])

    assert 0 < joined(run.executedPlan()) <= posts.count()


def test_words_of_a_text_are_found_once(rows, monkeypatch):
    text_ = "one two three four five six seven"
    r = rows([("c1", text_, "2024-01-01"), ("c2", text_.upper(), None), ("c3", "", None), ("c4", None, None)], "chunk_id string, text string, sent_at string")
    hits = rows([("q", f"c{i}") for i in range(1, 5)] + [("p", "c1")], "query_id string, chunk_id string")
    said = []
    cut = search.cut
    monkeypatch.setattr(search, "cut", lambda df: said.append(df) or cut(df))
    assert [tuple(x) for x in search.duplicate_pairs(hits, r, "chunk_id").collect()] == [("q", "c1", "c2")]
    # not once more for each shingle
    assert said[0]._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
