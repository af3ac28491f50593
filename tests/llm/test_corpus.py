"""Corpus operators against brute force, round trips and edge cases."""

import random
import re
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from postloom.llm import fresh, mixing, names, neardup, packing, pieces

# ---- splitting ---------------------------------------------------------------------------------


@pytest.mark.parametrize("seed", range(12))
def test_pieces_cover_and_keep_limits(seed):
    rnd = random.Random(seed)
    parts = ["word", "Sentence ends here.", "\n\n", "\n", "x" * rnd.choice([5, 3000]), "é́", "👍🏽", "a, b; c", "\r\n", " "]
    t = "".join(rnd.choice(parts) + rnd.choice([" ", "", "\n"]) for _ in range(rnd.choice([3, 200, 900])))
    for limit, overlap in ((1200, 120), (200, 20), (50, 0)):
        s = pieces.split(t, limit, overlap)
        if not t:
            assert s == []
            continue
        assert s[0][0] == 0 and s[-1][1] == len(t)
        assert all(0 < b - a <= limit for a, b in s)
        for (a, b), (c, d) in zip(s, s[1:]):
            assert a < c <= b < d and b - c <= overlap
        assert len(s) == 1 or len(t) > limit


def test_pieces_prefer_paragraphs_and_keep_characters_whole():
    para = "Some words that make a line. " * 8
    t = (para.strip() + "\n\n") * 15
    assert all(t[:b].endswith("\n\n") for _, b in pieces.split(t))
    e = "👍🏽" * 900
    assert all(a % 2 == 0 and b % 2 == 0 for a, b in pieces.split(e))
    assert pieces.split(None) == [] and pieces.split("x" * 1200) == [(0, 1200)]


def test_message_pieces_null_repeated_and_empty(rows):
    schema = "message_id string, body_text string, chunk_index string"
    df = rows([("a", None, "z"), ("b", "", "z"), ("c", "short", "z"), ("c", "short", "y"), ("d", "y " * 5000, "z")], schema)
    got = pieces.message_pieces(df).groupBy("message_id").count().collect()
    assert {r[0]: r[1] for r in got} == {"c": 1, "d": 10}
    assert pieces.message_pieces(rows([], schema)).count() == 0


# ---- new lines ---------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "body,gone",
    [
        ("Hi Ann,\n\nNew words go here today.\n\nBest regards,\nBob\n\n-- \nBob Ray\nsales, Acme Co\n+1 302 555 0174", [4, 5, 7, 8, 9, 10]),
        ("On 12 Aug 2024, H. Lee\nwrote:\n> old\n>> older\n\nMy answer is below the quoted text.", [0, 1, 2, 3]),
        ("Text first.\n\n-----Original Message-----\nFrom: A <a@x.example>\nSent: 2024-01-26 01:24\nTo: b@x.example\nSubject: x\n\nHello,\n\nold words", [2, 3, 4, 5, 6, 8, 10]),
        ("Best, if you ask me, would be a second quotation.\nThanks to the new scale we found the gap.\n-- that was the old rate, by the way --", []),
        ("Sent from the depot last night, so expect it on Friday.\nOn the delivery note the driver wrote: two pallets short.", []),
        ("One more remark for you all.\n\nSent from my phone", [2]),
        ("A remark for you.\r\n\r\nDiese Nachricht ist vertraulich. Sollten Sie nicht der Empfänger sein,\r\nlöschen Sie sie bitte.", [2, 3]),
        ("Reply on top of it.\n\n    Hi Bob,\n    old indented words\n\n    Ann", [2, 3, 5]),
        ("", []),
        (None, []),
        ("\n \n", []),
    ],
)
def test_lines_that_are_not_new(body, gone):
    assert fresh.not_new(body, "Bob Ray") == gone


def test_quoted_lines_frame(rows):
    schema = "message_id string, body_text string, from_name string, line_no string"
    df = rows([("a", "New words here.\n> old", None, "q"), ("a", "New words here.\n> old", None, "q"), ("b", None, "x", "q"), ("c", "> x\n" * 20000, "x", "q")], schema)
    got = fresh.quoted_lines(df)
    assert got.count() == 20001 and got.filter("message_id = 'a'").first()["line_no"] == 1
    assert fresh.quoted_lines(rows([], schema)).count() == 0
    assert {r[0]: r[1] for r in fresh.fresh_text(df).collect()}["a"] == "New words here."


def test_fit_keeps_shape():
    w = fresh.fit_lengths([("Hello there you.\n\nThanks,\nBob", "Bob")] * 5)
    assert set(w["len"]) == set(fresh.WEIGHTS["len"]) and fresh.not_new("Hello there you.\n\nThanks,\nBob", "Bob", w) == [2, 3]
    assert fresh.fit_lengths([])["len"]


def test_lengths_are_fitted_on_all_messages(rows, monkeypatch):
    # more messages than a sample would take, copies, and a body of more than 20,000 characters
    data = [(f"m{i}", f"Hello {i} there you.\n\nThanks,\nBob" + "\nsales" * (i % 3), "Bob") for i in range(2300)]
    data += [(f"c{i}", data[0][1], "Bob") for i in range(40)] + [("long", "Some words that make a line of text.\n" * 800 + "\nRegards,\nBob Ray", "Bob"), ("none", None, "Bob"), ("bare", "Words here.\n\nCheers", None)]
    fit, got = fresh.fit_lengths, []
    monkeypatch.setattr(fresh, "fit_lengths", lambda *a, **k: got.append(fit(*a, **k)) or got[-1])
    df = rows(data, "message_id string, body_text string, from_name string")
    fresh.quoted_lines(df)
    fresh.fresh_text(df.orderBy(F.rand(1)))
    want = fit(sorted({(b, n or "") for _, b, n in data if b}), rounds=1)
    assert [w["len"] for w in got] == [want["len"]] * 2 and want["len"] != fit(sorted({(b, n or "") for _, b, n in data if b})[:2000], rounds=1)["len"]


# ---- names -------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "a,b,near,want",
    [
        ("Anthony Kibrothon", "KIBROTHON Anthony", False, True),
        ("Anthony Kibrothon", "Kibrothen, Tony", True, True),
        ("Anthony Kibrothon", "Kibrothen, Tony", False, False),
        ("A. Kibrothon", "Anthony Kibrothon", True, True),
        ("A. Kibrothon", "Anthony Kibrothon", False, False),
        ("Ben Kibrothon", "Anthony Kibrothon", True, False),
        ("Inês J. Tithatru", "ines tithatru", False, True),
        ("Dr Olga Zubijon (Acme)", "'Olga Zubijon'", False, True),
        ("The Tekogal Packaging L.L.C.", "Tekogal Packaging LLC", False, True),
        ("Tekogal Pkg. LLC", "Tekogal Packaging LLC", True, True),
        ("Tekogal Packaging LLC", "Tekogal Timber LLC", True, False),
        ("accounts @ tekogal", "Tekogal Packaging LLC", True, True),
        ("Olga Tekogal", "Tekogal Packaging LLC", True, False),
    ],
)
def test_spellings(a, b, near, want):
    assert (names.compare(a, b, near) > 0) is want and (names.compare(b, a, near) > 0) is want


def spelled(rnd, kind, words):
    """A spelling of a name as people type it."""
    w = [x.lower() for x in words]
    slip = rnd.randrange(len(w))
    if kind == "slip" and len(w[slip]) > 4:
        k = rnd.randrange(1, len(w[slip]) - 1)
        w[slip] = w[slip][:k] + rnd.choice("aeiou") + w[slip][k + 1 :]
    out = [x.capitalize() for x in w]
    if kind == "turned":
        return f"{out[-1]}, {' '.join(out[:-1])}"
    return f"{out[0][0]}. {' '.join(out[1:])}" if kind == "initial" else " ".join(out)


def test_recall_by_class_on_names_that_stand_nowhere(rows):
    # persons with slips at their own and at other addresses, firms of trades that no list holds
    rnd = random.Random(11)
    syl = "bra kel mon tiv sor dal wex pun gri hol nav zet".split()
    word = lambda k: "".join(rnd.choice(syl) for _ in range(k))
    persons = [(word(2), word(3)) for _ in range(25)]
    trades = ["Bakery", "Brewing", "Dairies", "Orchards"]
    firms = [(word(2).capitalize(), rnd.choice(trades)) for _ in range(20)]
    data, same, far, firm = [], [], [], []
    pair = lambda a, b: (min(a, b), max(a, b))
    for i, p in enumerate(persons):
        full, slip, turned, other = spelled(rnd, "", p), spelled(rnd, "slip", p), spelled(rnd, "turned", p), spelled(rnd, "slip", p)
        data += [(full, f"p{i}@one{i}.example"), (slip, f"p{i}@one{i}.example"), (turned, f"q{i}@two{i}.example"), (other, f"r{i}@one{i}.example")]
        same += [pair(full, slip)] if full != slip else []
        far += [pair(full, turned)] + ([pair(full, other)] if full != other else [])
    for i, (core, trade) in enumerate(firms):
        a, b, c = f"{core} {trade} Ltd", f"{core} {trade}", f"{core.upper()} {trade[:4]}. Ltd"
        data += [(a, f"info@firm{i}.example"), (b, f"sales@firm{i}.example"), (c, f"post@firm{i}.example")]
        firm += [pair(a, b), pair(a, c)]
    got = {tuple(x) for x in names.spelling_pairs(rows(data, "from_name string, from_address string"), rows([], "name string, address string")).collect()}
    for want in (same, far, firm):
        assert sum(x in got for x in want) >= 0.9 * len(want), (len(want), [x for x in want if x not in got])
    all_true = {pair(a, b) for i in range(len(persons)) for a, _ in data[4 * i : 4 * i + 4] for b, _ in data[4 * i : 4 * i + 4]} | {pair(a, b) for i in range(len(firms)) for a, _ in data[100 + 3 * i : 103 + 3 * i] for b, _ in data[100 + 3 * i : 103 + 3 * i]}
    assert len(got - all_true) <= 0.05 * len(got)


def test_lcs_matches_dynamic_programming():
    rnd = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(9))) for _ in range(2))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1, j + 1] = t[i, j] + 1 if x == y else max(t[i, j + 1], t[i + 1, j])
        want = 2 * t[-1, -1] / (len(a) + len(b)) if a and b else float(a == b)
        assert names.lcs_ratio(a, b) == pytest.approx(want)


def test_spelling_pairs_do_not_join_people_through_initials(rows):
    m = rows([("m1", "Isadora Shijastil", "i@x"), ("m2", "I. Shijastil", "i@x"), ("m3", "Inês Shijastil", "j@x"), ("m4", "I. Shijastil", "j@x"), ("m5", None, "j@x"), ("m6", "", None), ("m1", "Isadora Shijastil", "i@x")], "message_id string, from_name string, from_address string")
    r = rows([("m1", "isadora shijastil", "I@x", "q"), ("m1", "Solo", "i@x", "q"), ("m2", "Olga", None, "q")], "message_id string, name string, address string, id string")
    got = {tuple(x) for x in names.spelling_pairs(m, r).collect()}
    assert got == {("I. Shijastil", "Isadora Shijastil"), ("I. Shijastil", "Inês Shijastil"), ("I. Shijastil", "isadora shijastil"), ("Isadora Shijastil", "isadora shijastil")}
    assert names.spelling_pairs(m.limit(0), r.limit(0)).count() == 0


# ---- near duplicates ---------------------------------------------------------------------------


@pytest.mark.parametrize("size,threshold", [(3, 0.6), (5, 0.8), (2, 1.0)])
def test_near_pairs_match_brute_force(rows, size, threshold):
    rnd = random.Random(7)
    base = [[f"w{rnd.randrange(300)}" for _ in range(rnd.choice([20, 60, 61]))] for _ in range(12)]
    data = []
    for i in range(90):
        w = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 3, 8])):
            w[rnd.randrange(len(w))] = f"v{rnd.randrange(40)}"
        data.append((i, " ".join(w)))
    data += [(200, None), (201, ""), (202, "too short"), (0, data[0][1])]
    pairs, members = neardup.near_pairs(rows(data, "k int, text string"), "k", "text", size, threshold, 10)
    got = {tuple(r) for r in neardup.expand(pairs, members, "k").collect()}
    sh = {}
    for k, t in data:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        if len(w) >= max(10, size):
            sh[k] = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
    want = {(a, b) for a in sh for b in sh if a < b and len(sh[a] & sh[b]) >= threshold * len(sh[a] | sh[b]) - 1e-9}
    assert got == want and want
    g = {r["k"]: r for r in neardup.groups(pairs, members, "k").collect()}
    assert set(g) == set(sh) and all(g[a]["cluster"] == g[b]["cluster"] for a, b in want)


def test_near_pairs_of_a_sequence_in_every_text(rows):
    # every text has the same long tail: its shingles are parted, and no pair is lost or counted twice
    rnd = random.Random(4)
    tail = " ".join(f"t{i}" for i in range(12))
    data = [(f"d{i:02d}", f"{' '.join(rnd.choice('abcdefgh') for _ in range(rnd.choice([3, 6, 9])))} {tail}") for i in range(40)]
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in data for w in [t.split()]}
    first: dict = {}
    for k, t in data:
        first.setdefault(t, k)
    reps = sorted(first.values())
    want = {(a, b, len(sets[a] & sets[b])) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b]) - 1e-9}
    for part in (4, 2_000):
        pairs, _ = neardup.near_pairs(rows(data, "k string, t string"), "k", "t", size=3, threshold=0.6, part=part)
        got = [(r["a"], r["b"], r["overlap"]) for r in pairs.collect()]
        assert len(got) == len(want) and set(got) == want


def test_near_pairs_in_rounds_and_passes(rows, monkeypatch):
    # parts make more copies of a row than one round takes; each pair comes out once
    rnd = random.Random(9)
    tail = " ".join(f"t{i}" for i in range(20))
    data = [(i, f"{' '.join(rnd.choice('abcdef') for _ in range(6))} {i} {tail}") for i in range(30)]
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in data for w in [t.split()]}
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]) - 1e-9}
    judged, rounds = neardup._judged, []
    monkeypatch.setattr(neardup, "_judged", lambda found, encoded, t, passes: rounds.append(found.count()) or judged(found, encoded, t, 2))
    pairs, _ = neardup.near_pairs(rows(data, "k int, t string"), "k", "t", size=3, threshold=0.5, part=2)
    got = [(r["a"], r["b"], r["overlap"]) for r in pairs.collect()]
    assert len(rounds) > 2 and len(got) == len(want) and set(got) == want and sum(rounds) <= 30 * 29 / 2


def test_near_pairs_leave_little_on_disk(spark, rows):
    # texts of common phrases that meet at many shingles: what a step shuffled or wrote is gone when the next has read it
    from postloom.session import shared_folder

    rnd = random.Random(6)
    phrases = [" ".join(f"w{rnd.randrange(500)}" for _ in range(12)) for _ in range(40)]
    data = [(i, " ".join(rnd.choice(phrases) for _ in range(8))) for i in range(400)]
    blocks = lambda: list(spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString(" ").split())
    tables = Path(shared_folder(spark).removeprefix("file:"), "postloom")
    held = lambda: {p: p.stat().st_size for p in [*map(Path, blocks()), *tables.rglob("*.parquet")] if p.exists()}
    spark.range(1).write.format("noop").mode("overwrite").save()
    before = held()
    pairs, _ = neardup.near_pairs(rows(data, "k int, t string"), "k", "t", size=3, threshold=0.4)
    for _ in range(50):  # files of a shuffle go beside the work
        left = sum(size for p, size in held().items() if p not in before)
        if left < 150_000:
            break
        time.sleep(0.1)
    assert left < 150_000 < sum(len(t) for _, t in data)
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in data for w in [t.split()]}
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.4 * len(sets[a] | sets[b]) - 1e-9}
    assert want == {(r["a"], r["b"], r["overlap"]) for r in pairs.collect()} and want


def test_maps_rule_out_most_candidates_and_no_pair(rows, monkeypatch):
    # texts of common phrases have rare sequences in common, and most of them little else
    rnd = random.Random(8)
    phrases = [" ".join(f"w{rnd.randrange(900)}" for _ in range(6)) for _ in range(120)]
    data = [(i, " ".join(rnd.choice(phrases) for _ in range(12))) for i in range(300)]
    data += [(i + 300, " ".join(rnd.choice("xyz") if rnd.random() < 0.03 else w for w in data[i][1].split()) + " z") for i in range(60)]
    judged, rounds = neardup._judged, []
    monkeypatch.setattr(neardup, "_judged", lambda found, *more: rounds.append(found.count()) or judged(found, *more))
    pairs, _ = neardup.near_pairs(rows(data, "k int, t string"), "k", "t", size=2, threshold=0.5)
    sets = {k: {tuple(w[i : i + 2]) for i in range(len(w) - 1)} for k, t in data for w in [t.split()]}
    want = {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]) - 1e-9}
    assert want == {(r["a"], r["b"], r["overlap"]) for r in pairs.collect()} and len(want) > 40
    assert sum(rounds) < 3 * len(want)


def test_near_pairs_of_nothing(rows):
    twice = rows([(1, "a b c d e f", 5), (2, "a b c d e f", 6), (1, "a b c d e f", 5)], "id int, w string, s int")
    p, m = neardup.near_pairs(twice, "id", "w")
    assert {tuple(r) for r in neardup.expand(p, m, "id").collect()} == {(1, 2)}
    p, m = neardup.near_pairs(rows([], "k int, text string"), "k", "text")
    assert p.count() == 0 and m.count() == 0


# ---- packing -----------------------------------------------------------------------------------


def test_sum_of_squares_places_where_the_sum_grows_least():
    rnd = random.Random(2)
    cap = 20
    sizes = [rnd.randint(0, cap) for _ in range(300)]
    bins = packing.sum_of_squares(sizes, cap)
    assert sorted(i for b in bins for i in b) == list(range(300))
    assert all(sum(sizes[i] for i in b) <= cap for b in bins)
    # replay: no other place would have had a smaller sum
    where = {i: k for k, b in enumerate(bins) for i in b}
    gaps: dict[int, int] = {}

    def cost(g):
        return sum(x * x for x in np.bincount([v for v in g.values() if 0 < v < cap], minlength=cap + 1))

    for i, s in enumerate(sizes):
        if s == 0:
            continue
        options = [cost(gaps | {k: v - s}) for k, v in gaps.items() if v >= s] + [cost(gaps | {-1: cap - s})]
        gaps[where[i]] = gaps.get(where[i], cap) - s
        assert cost(gaps) == min(options)


def test_pack_keeps_texts_whole(rows):
    rnd = random.Random(3)
    data = [(i, " ".join(["word"] * rnd.choice([1, 50, 300, 700])), "s") for i in range(120)] + [(500, "word " * 5000, "s"), (501, "", "s"), (502, None, "s"), (503, "   ", "s"), (0, None, "s")]
    for group in (12_000_000, 20_000):
        got = packing.pack(rows(data, "doc_id bigint, text string, used string"), group_tokens=group).collect()
        where: dict = {}
        for r in got:
            assert 0 <= r["used"] <= 2048 and r["used"] + r["free"] == 2048
            for d, p in zip(r["doc_ids"], r["parts"]):
                where.setdefault(d, []).append(p)
        assert set(where) == {d for d, _, _ in data}
        assert all(len(v) == 1 for d, v in where.items() if d != 500) and sorted(where[500]) == [0, 1, 2]
        filled = [r for r in got if r["used"]]  # texts without tokens have a container of their own
        assert sum(r["used"] for r in filled) / (2048 * len(filled)) > 0.85
    assert len({r["container_id"] for r in got}) == len(got)
    assert packing.pack(rows([], "doc_id bigint, text string")).count() == 0


def test_pack_of_texts_that_fill_nothing_stays_in_bounds(rows):
    # all sizes above half the capacity: every text is alone, and no task holds more than a group
    data = [(i, " ".join(["word"] * (1030 + i % 900))) for i in range(300)] + [(None, "word")] + [(1000 + i, "") for i in range(95)]
    got = packing.pack(rows(data, "doc_id bigint, text string"), group_tokens=40_000, empty_rows=20)
    done = got.collect()
    sizes: dict = {}
    for r in done:
        if r["used"]:
            assert r["container_id"].startswith("c0-") and len(r["doc_ids"]) == 1
            sizes[r["container_id"].split("-")[1]] = sizes.get(r["container_id"].split("-")[1], 0) + r["used"]
        else:
            assert len(r["doc_ids"]) <= 45
    assert max(sizes.values()) <= 80_000 and sum(len(r["doc_ids"]) for r in done if not r["used"]) == 95
    assert packing.covered(got).filter("sound").count() == 395


def test_pack_many_small_rows_are_parted_by_number(rows):
    data = [(i, "word") for i in range(3000)]
    got = packing.pack(rows(data, "doc_id bigint, text string"), capacity=64, group_rows=500).collect()
    assert sum(r["used"] for r in got) == 3000 and len(got) <= 3000 // 64 + 2
    assert any(r["container_id"].startswith("c1-") for r in got)


# ---- mixing ------------------------------------------------------------------------------------


def test_mixing_reaches_shares_within_repeats(rows):
    rnd = random.Random(4)
    docs = [(i, rnd.choice(["big"] * 8 + ["mid", "small"]), "word " * rnd.randint(1, 60)) for i in range(1500)] + [(9000, None, "x"), (9001, "other", "x"), (9002, "big", None), (9003, "big", "")]
    t = rows([("big", 0.5, 1), ("mid", 0.3, 3), ("small", 0.1, 6), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    drawn, shares = mixing.draw(rows(docs, "doc_id bigint, source string, text string"), t)
    s = {r["source"]: r for r in shares.collect()}
    assert s["none"]["tokens"] == 0 and abs(sum(r["actual_share"] for r in s.values()) - 1) < 1e-9
    for k in ("big", "mid", "small"):
        assert abs(s[k]["actual_share"] - s[k]["weight"]) < 0.01
    d = drawn.collect()
    cap = {"big": 1, "mid": 3, "small": 6}
    assert all(1 <= r["repeats"] <= cap[r["source"]] for r in d) and len({r["doc_id"] for r in d}) == len(d)
    assert {r["doc_id"] for r in d}.isdisjoint({9000, 9001, 9002, 9003})
    # one of the sources is used to its limit: no larger mix keeps the shares
    full = {k: sum(1 for x in docs if x[1] == k and x[2] and x[0] < 9000) for k in cap}
    used = {k: sum(r["repeats"] for r in d if r["source"] == k) for k in cap}
    assert max(used[k] / (full[k] * cap[k]) for k in cap) > 0.97
    few = mixing.draw(rows(docs, "doc_id bigint, source string, text string"), t, budget=1000)[0]
    assert 900 < few.agg(F.sum(F.col("tokens") * F.col("repeats"))).first()[0] <= 1000
    assert mixing.draw(rows([], "doc_id bigint, source string, text string"), t)[0].count() == 0


# ---- tokens and later cases ---------------------------------------------------------------------


def test_token_counts_agree_between_files():
    from postloom.llm import tokens

    texts = ["Hello there, it's 12 o'clock.\n\n  two  spaces", "", None, "über 👍🏽 <|endoftext|>", "x" * 5000]
    a, b = (tokens.count(texts, f"/opt/tokenizers/byte_bpe_50k.{kind}") for kind in ("tiktoken", "json"))
    assert a == b and a[1] == a[2] == 0
    assert tokens.count(["a b"], "/opt/tokenizers/piece_bpe_32k.model")[0] > 0


def test_spellings_meet_over_addresses(rows):
    given = ["Samantha Krufachen", "Daniel Fidripa", "Frederick Jutheze", "Isadora Shijastil", "Inês Shijastil"]
    m = [(n, f"box{i}@krufa.example") for i, n in enumerate(given)] + [("Sam Krufachen", "accounts@krufa.example"), ("D Fidripa", "accounts@krufa.example"), ("Fnederick Jutheze", "j@krufa.example"), ("I. Shijastil", "accounts@krufa.example"), ("Tony Zudazol", "t@krufa.example"), ("Zudazol, Anthony", None), ("Q. Zudazol", None)]
    # the family name is common: the domain has more spellings than a block holds
    m += [(f"{g} Korezu", f"k{i}@krufa.example") for i, g in enumerate("Abram Bodo Cyril Dunja Egon Fleur Gwen Hedda Ilka Jorge Kuno Lothar Moritz Nadja Otmar Pavel Quirin Rosa Silke Tilda Ulf Veit Wenzel Xenia Yann Zora Adele Bruno".split())] + [("Y. Korezu", "accounts@krufa.example")]
    got = {tuple(x) for x in names.spelling_pairs(rows(m, "from_name string, from_address string"), rows([], "name string, address string")).collect()}
    assert got == {("Sam Krufachen", "Samantha Krufachen"), ("D Fidripa", "Daniel Fidripa"), ("Fnederick Jutheze", "Frederick Jutheze"), ("Tony Zudazol", "Zudazol, Anthony"), ("Y. Korezu", "Yann Korezu")}


def test_firm_spellings_of_a_large_domain_meet_over_addresses(rows):
    # one firm without a hyphen in its domain: more spellings than a block holds, one at each address
    cores = ["Tekogal"] + ["Tekogal"[:i] + x + "Tekogal"[i + 1 :] for i in range(1, 7) for x in "xyzwq"]
    m = [(f"{c} Packaging LLC", f"b{i}@tekogal.example") for i, c in enumerate(cores)] + [("Tekogal Packaging, L.L.C.", "c@tekogal.example"), ("Vimanor Packaging LLC", "d@tekogal.example"), ("accounts @ tekogal", "e@tekogal.example"), ("sales @ tekogal", "f@tekogal.example")]
    got = {tuple(x) for x in names.spelling_pairs(rows(m, "from_name string, from_address string"), rows([], "name string, address string")).collect()}
    same = sorted({n for n, _ in m} - {"Vimanor Packaging LLC"})
    assert got == {(a, b) for a in same for b in same if a < b}


def test_long_spans_and_notices_in_other_words():
    gone = lambda b: fresh.not_new(b, None)
    top = "Hello,\nthe crates came.\n\n"
    assert gone(top + "If this reached you in error, kindly delete it and notify the writer.") == [3]
    assert gone(top + "-- \n" + "\n".join(f"Line {i} words" for i in range(15))) == list(range(3, 19))
    stars = top + "*****\n" + "\n\n".join(f"Paragraph {i} of it says that nothing here is binding for the writer." for i in range(30)) + "\n*****"
    assert len(gone(stars)) == 32
    assert gone(top + "Please delete the third line of the order and the crates of last week.") == []


def test_very_long_bodies_of_short_lines_are_decoded():
    assert fresh.not_new("\n".join(f"item {i}" for i in range(5000)), None) == []
    assert len(fresh.not_new("\n\n".join(f"tel +44 1632 960 {i:03d}" for i in range(600)), None)) >= 0


def test_fresh_text_keeps_what_quoted_lines_leave(rows, monkeypatch):
    body = "Hello there you.\n\nThanks,\nBob"
    used = []
    monkeypatch.setattr(fresh, "fit_lengths", lambda sample, **k: used.append(list(sample)) or fresh.WEIGHTS)
    df = rows([("a", body, "Bob")], "message_id string, body_text string, from_name string")
    gone = {r["line_no"] for r in fresh.quoted_lines(df).collect()}
    text = fresh.fresh_text(df).first()["text"]
    assert text == "\n".join(x for k, x in enumerate(body.split("\n")) if k not in gone).strip("\n")
    assert used == [[(body, "Bob")]] * 2
