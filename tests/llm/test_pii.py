"""Personal information: what is learnt, held-out texts, edge cases."""

import random

import numpy as np

from postloom.llm import pii

SCHEMA = "doc_id bigint, text string"
# Nothing of these names, streets, numbers and sentences occurs in the operator or in the corpus it is fitted on.
HELD = [
    ("Please book the room for Giulia Moretti, she arrives on Monday.", [("name", "Giulia Moretti")]),
    ("The parcel for Kenji Watanabe went to 14 Via Roma by mistake.", [("name", "Kenji Watanabe"), ("street_address", "14 Via Roma")]),
    ("We met Siobhan O'Brien at the conference and she sends her best.", [("name", "Siobhan O'Brien")]),
    ("My passport is 533401372 and it expires in May.", [("id_number", "533401372")]),
    ("His badge is B-20417, please let him in.", [("id_number", "B-20417")]),
    ("Die Steuer-ID 12 345 678 901 steht auf dem Formular.", [("id_number", "12 345 678 901")]),
    ("Our new flat is at 7 Calle Mayor, second floor.", [("street_address", "7 Calle Mayor")]),
    ("Bezorgen bij Kerkstraat 12B graag.", [("street_address", "Kerkstraat 12B")]),
    ("Le dossier de Mme Lefebvre est complet, son passeport 19KD48213 aussi.", [("name", "Lefebvre"), ("id_number", "19KD48213")]),
    ("Please forward this to Ottavia Brandstetter or write to o.brandstetter@nordhafen.example.", [("name", "Ottavia Brandstetter"), ("email", "o.brandstetter@nordhafen.example")]),
    ("Her mobile is +45 31 22 84 90, her desk 0221 4708 133.", [("phone", "+45 31 22 84 90"), ("phone", "0221 4708 133")]),
    ("Dear Mr Okonkwo,\n\nyour crates left this morning.", [("name", "Okonkwo")]),
    ("Hi Tadeusz,\n\nthe crates left this morning.", [("name", "Tadeusz")]),
    ("Patient id 4471-90233 belongs to Marisol Quintanilla.", [("id_number", "4471-90233"), ("name", "Marisol Quintanilla")]),
    ("Herr Dr. Vogelsang wohnt Am Lindenring 4.", [("name", "Vogelsang"), ("street_address", "Am Lindenring 4")]),
    ("Send the keys to 221 Abbotsford Crescent, not to the depot.", [("street_address", "221 Abbotsford Crescent")]),
    ("La señora Etxeberria llamó ayer, su DNI es 12345678Z.", [("name", "Etxeberria"), ("id_number", "12345678Z")]),
    ("Signed: R. Halvorsen, witness to the sale.", [("name", "R. Halvorsen")]),
    ("Social security 514-22-9081 was on the form of Deepak Raghunathan.", [("id_number", "514-22-9081"), ("name", "Deepak Raghunathan")]),
    ("Write to mila (at) fjordpost (dot) example before Friday.", [("email", "mila (at) fjordpost (dot) example")]),
    ("The courier asked for Ingeborg Thalmann at the gate.", [("name", "Ingeborg Thalmann")]),
    ("Invoice 88213047 and order 5510-2231 are still open.", []),
    ("Pallet 77120938 of the blue tiles weighs 1,204 kg.", []),
    ("Meeting moved to 2024-11-05 in the large hall.", []),
    ("The Westbrook Tooling Ltd offer is valid until June.", []),
    ("Serial no. 4A-99120-77 replaces the broken unit.", []),
    ("We paid EUR 12,450.00 on 03/04/2024 against the account 30112277.", []),
]


def corpus(n=400, seed=3):
    """Texts of invented persons: what stands in one sentence is drawn anew for each text."""
    rnd = random.Random(seed)
    given = "Anna Bruno Celia Dario Edith Fabio Greta Hugo Irma Jonas".split()
    syllables = "ka lo mi ru ta ve zo ni".split()
    family = lambda: "".join(rnd.choice(syllables) for _ in range(3)).capitalize() + rnd.choice("nrsl")
    digits = lambda k: "".join(rnd.choice("0123456789") for _ in range(k))
    out = []
    for i in range(n):
        g, f, h = rnd.choice(given), family(), rnd.choice(given)
        lines = [
            f"Please call {g} {f} about the goods, the number is +44 1632 960 {digits(3)}.",
            f"We spoke with {g} {f} and the carrier brought {rnd.randint(2, 90)} crates.",
            f"Attn: {g} {f}\nShip to: {rnd.randint(1, 99)} {family()} Close\nPassport: {digits(3)}-{digits(2)}-{digits(4)}",
            f"The badge {digits(3)}-{digits(2)}-{digits(4)} belongs to {g} {f}.",
            f"Part no. {digits(3)}-{digits(2)}-{digits(5)} and batch {digits(8)} go to the dock with invoice {digits(8)}.",
            f"Order {digits(4)}-{digits(4)} of the goods was paid, the account is {digits(8)}.",
            f"Write to {g.lower()}.{f.lower()}@office.example if the goods are late.",
            f"The tax number {digits(8)}{rnd.choice('ABCDEFG')} is in the file of {g} {f}.",
            f"Hi {h},\n\nthe goods are here.\n\nRegards,\n{g} {f}",
            f"{rnd.choice(['Celia', 'Hugo'])} racks hold the goods." if i % 3 else "The crates of the carrier are here.",
        ]
        out.append((i, "\n".join(rnd.sample(lines, 4))))
    return out


def test_held_out_names_numbers_and_streets(rows):
    lex, w, _ = pii.fitted(rows(corpus(), SCHEMA), 300)
    both = told = true = 0
    for text, want in HELD:
        got = {(k, text[a:b]) for k, a, b in pii.find(text, lex, w)}
        both, told, true = both + len(got & set(want)), told + len(got), true + len(want)
        masked = pii.replace(text, pii.find(text, lex, w))
        for k, a, b in pii.find(text, lex, w):  # an exact round trip: putting the spans back gives the text
            masked = masked.replace(f"[{k.upper()}]", text[a:b], 1)
        assert masked == text
    assert both >= 0.9 * true and both >= 0.9 * told, (both, told, true)


def test_given_names_are_learnt_and_places_tell(rows):
    data = corpus()
    lex, w, _ = pii.fitted(rows(data, SCHEMA), 300)
    assert {"anna", "bruno", "jonas"} <= lex.given and lex.given.isdisjoint({"please", "write", "goods", "attn", "racks"})
    assert {"goods", "the", "crates"} <= lex.common and "racks" in lex.common
    found = lambda t: [(k, t[a:b]) for k, a, b in pii.find(t, lex, w)]
    assert found("Hi Greta,\n\nthe goods came.") == [("name", "Greta")]
    assert found("Celia racks hold the goods.") == []
    assert pii.find(None, lex, w) == [] and pii.find("", lex, w) == [] and pii.replace(None, []) is None


def test_the_caller_names_persons(rows):
    # too few texts to learn from: the gazetteer comes from the caller
    data = [(1, "Otto Venkamir signed."), (2, "nothing here at all")]
    lex = pii.fitted(rows(data, SCHEMA), 10, rows([("Otto Balukan",), (None,), ("",), ("Single",)], "name string"))[0]
    assert lex.given == {"otto"}


def test_frequent_family_names_stay_candidates(rows):
    filler = ["The goods came today and the driver left. Rechnung folgt.", "Please send the goods again. Rechnung liegt bei."]
    data = [(i, "Please ask for Anna Kibrothon about the goods. Thanks.") for i in range(40)]  # copies
    data += [(100 + i, f"{filler[i % 2]} Line {i}. Attn: Mr Zudazol, room {i}; J. Zudazol and Karl Zudazol signed.") for i in range(60)]
    given = rows([("Anna X",), ("Karl Y",)], "name string")
    names, ordinary = pii.learnt(rows(data, SCHEMA), given=given)
    assert set(names) == {"anna", "karl"}
    assert {"goods", "the", "rechnung"} <= set(ordinary) and set(ordinary).isdisjoint({"kibrothon", "zudazol"})
    got = pii.mentions(rows(data, SCHEMA), given=given).filter("kind = 'name'").collect()
    found = {(r["doc_id"], dict(data)[r["doc_id"]][r["span_start"] : r["span_end"]]) for r in got}
    assert {(i, "Anna Kibrothon") for i in range(40)} <= found and {(100 + i, "Karl Zudazol") for i in range(60)} <= found


def test_phone_numbers_in_brackets():
    for text, want in (("Call us (030 1234567) now", "030 1234567"), ("Call us (555-123-4567) now", "555-123-4567"), ("Call us (030) 123-4567 now", "(030) 123-4567")):
        assert [text[a:b] for k, a, b, _ in pii.candidates(text, pii.Lexicon([], [])) if k == "phone"] == [want]


def test_no_ordinary_word_is_left_out(rows):
    words = {"".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(20_050)}
    got = pii.common_words(rows([(i, f"{' '.join(sorted(words))} {i}") for i in range(3)], SCHEMA))
    assert set(got) == words


def test_fits_do_not_depend_on_the_order_of_rows(rows):
    # sorted by kind: the first rows hold no e-mail
    data = [(i, f"Please ask for Anna Kibrothon in room {i}.") for i in range(40)] + [(100 + i, f"Write to bo{i}@office.example today.") for i in range(40)]
    one, two = (pii.fitted(rows(d, SCHEMA), 30) for d in (data, data[::-1]))
    assert one[1] == two[1] and one[0].contexts == two[0].contexts
    assert pii.mentions(rows(data, SCHEMA), 30).filter("kind = 'email'").count() == 40
    # a kind too rare for the sample still gets weights
    rare = data[:40] + [(i, f"Filler number one of {i} boxes, Anna Kibrothon signed.") for i in range(200, 900)] + data[40:41]
    assert pii.mentions(rows(rare, SCHEMA), 5).filter("kind = 'email'").count() == 1
    counted = pii.vote_patterns(one[2], one[0].contexts)
    assert sum(n for p, n in counted.items() if p[0] == "email") == 40


def test_reliabilities_find_the_noisy_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    flip = lambda p: np.where(rng.random(4000) < p, ~truth, truth) * 2 - 1
    v = np.stack([flip(0.05), flip(0.1), flip(0.5), flip(0.1), np.zeros(4000), np.zeros(4000)], 1).astype(int)
    tpr, fpr, _, post = pii.reliabilities(v)
    assert ((post > 0.5) == truth).mean() > 0.95
    assert tpr[0, 2] > 0.9 and abs(tpr[2, 2] - 0.5) < 0.1


def test_mentions_frame(rows):
    schema = "doc_id bigint, text string, kind string"
    texts = [t for _, t in corpus(40)]
    data = [(i, t, "mail") for i, t in enumerate(texts)] + [(900, None, "x"), (901, "", "x"), (902, " \n ", "x"), (903, "word " * 30_000, "x"), (0, texts[0], "mail")]
    df = rows(data, schema)
    got = pii.mentions(df)
    assert got.columns == ["doc_id", "kind", "span_start", "span_end"] and got.filter("doc_id >= 900").count() == 0
    assert got.count() == got.distinct().count() > 0
    assert pii.mentions(rows([], schema)).count() == 0
    out = {r["doc_id"]: r["text"] for r in pii.masked(df).collect()}
    assert out[900] is None and out[901] == "" and "@office.example" not in "".join(out[i] for i in range(40))
