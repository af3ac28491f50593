"""Linking the spellings of persons and firms by suffix blocking and common subsequences."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postloom.operators.components import components
from postloom.session import cut, release

# Short forms of given names that no prefix or letter rule explains.
NICKNAMES = {
    "abby": "abigail", "bea": "beatrice", "becky": "rebecca", "charlie": "charlotte", "lottie": "charlotte", "lina": "catalina", "thea": "dorothea", "pippa": "philippa", "pip": "philippa", "rik": "henrik", "hanna": "hanneke", "andy": "andrew", "bernie": "bernard", "beth": "elizabeth", "betty": "elizabeth", "bill": "william",
    "billy": "william", "bob": "robert", "bobby": "robert", "cathy": "catherine", "chuck": "charles", "dave": "david", "debbie": "deborah",
    "dick": "richard", "dolly": "dorothea", "dora": "dorothea", "dot": "dorothea", "drew": "andrew", "ed": "edmund", "eli": "elizabeth", "ellie": "eleanor", "nell": "eleanor",
    "fran": "francisco", "paco": "francisco", "pancho": "francisco", "fred": "frederick", "freddie": "frederick", "fritz": "frederick", "gabi": "gabriela", "gaby": "gabriela",
    "gene": "eugene", "hank": "henrik", "harry": "henry", "isa": "isadora", "jack": "john", "jenny": "jennifer", "jim": "james", "joe": "joseph",
    "josie": "josephine", "kate": "katherine", "kathy": "katherine", "katie": "katherine", "kit": "christopher", "larry": "lawrence", "liz": "elizabeth", "lisa": "elizabeth",
    "ludo": "ludovic", "maggie": "margaret", "manu": "emmanuel", "manny": "emmanuel", "matt": "matthias", "meg": "margaret", "mike": "michael", "mick": "michael",
    "molly": "mary", "nacho": "ignacio", "nan": "anne", "ned": "edmund", "nick": "nicholas", "nicky": "nicholas", "pat": "patricia", "patty": "patricia", "peggy": "margaret",
    "pepe": "jose", "polly": "mary", "rafa": "rafael", "rick": "richard", "rob": "robert", "sasha": "alexander", "sam": "samantha", "seun": "oluwaseun", "steph": "stephanie",
    "sue": "susan", "susie": "susan", "ted": "theodore", "teddy": "theodore", "theo": "theodore", "tina": "valentina", "tom": "tomas", "tony": "anthony", "tori": "victoria", "trish": "patricia",
    "tricia": "patricia", "uschi": "ursula", "vale": "valentina", "val": "valentina", "vicky": "victoria", "vik": "viktor", "will": "william", "wim": "william", "xavi": "xavier", "zoe": "zoe",
}
# Legal forms of firms, written without dots and blanks between initials.
LEGAL = frozenset("llc ltd inc co gmbh limited incorporated company corp corporation plc ag kg bv nv sa srl sarl spa mbh gesellschaft oy ab".split())
TITLES = frozenset("mr mrs ms miss dr prof sir herr frau monsieur madame mme mlle senor senora sr sra don dona ing dipl the".split())


def fold(s: str) -> str:
    """Lower case without accents."""
    s = s.replace("ø", "o").replace("Ø", "O").replace("ß", "ss").replace("æ", "ae").replace("ł", "l")
    return "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.combining(c)).lower()


@lru_cache(maxsize=100_000)
def lcs_ratio(a: str, b: str) -> float:
    """Twice the longest common subsequence over the total length (bit-parallel)."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return 2.0 * (len(a) - row.bit_count()) / (len(a) + len(b))


@lru_cache(maxsize=50_000)
def _is_trade(w: str, dotted: bool, first: bool, trades: frozenset[str]) -> bool:
    """True for a trade word; after the first word also for one with a slip or cut short by a dot."""
    if w in trades:
        return True
    if first or len(w) < 3:
        return False
    if dotted:
        return any(_short_of(w, t) for t in trades)
    return len(w) >= 5 and any(len(t) >= 5 and lcs_ratio(w, t) >= 0.88 for t in trades)


def _short_of(short: str, word: str) -> bool:
    """True if ``short`` is a subsequence of ``word`` with the same first letter."""
    if not short or short[0] != word[0] or len(short) > len(word):
        return False
    it = iter(word)
    return all(c in it for c in short)


@lru_cache(maxsize=200_000)
def parse(name: str, trades: frozenset[str] = frozenset()) -> tuple[str, tuple[str, ...], tuple[str, ...]]:
    """(kind, full words, initials) of a typed name; kind is person, firm or none.

    A legal form, or a word of ``trades`` after the first, makes a firm of it. Titles, quotes, remarks in brackets or after a dash, legal forms and case are left out.
    """
    s = re.sub(r"\([^)]*\)|\[[^\]]*\]", " ", name)
    box = re.fullmatch(r"\s*([\w .-]+?)\s+@\s+([\w-]+)\s*", s)
    if box:
        return "firm", (fold(box.group(2)),), ()
    if "@" in s:
        return "none", (), ()
    s = re.split(r"\s+[-–—|/]\s+", s.strip())[0]
    comma = "," in s
    s = re.sub(r"\b((?:[A-Za-z]\.){2,})", lambda m: m.group(1).replace(".", ""), s)
    words = [(fold(w).strip(".'’-"), w.rstrip(",").endswith(".")) for w in re.findall(r"[^\W\d_](?:[^\W\d_]|['’-](?=[^\W\d_]))*\.?", s)]
    words = [(w, d) for w, d in words if w]
    core = [(w, d) for w, d in words if w not in LEGAL]
    firm = len(core) < len(words) and len(words) > 1 and any(w in LEGAL and w not in ("co", "sa", "ab", "ag") or w == "co" and i == len(words) - 1 for i, (w, _) in enumerate(words) if i)
    core = [(w, d) for w, d in core if w not in TITLES or len(core) == 1]
    if firm or (len(core) > 1 and any(_is_trade(w, d, i == 0, trades) for i, (w, d) in enumerate(core))):
        # the word before a legal form is the trade where no known one is there
        trade = next((w for i, (w, d) in enumerate(core) if _is_trade(w, d, i == 0, trades)), core[-1][0] if len(core) > 1 else "")
        rest = tuple(w for w, _ in core if w != trade)
        return "firm", (*rest, *((trade,) if trade else ())), ("trade",) if trade else ()
    # without a legal form or trade: words of one letter are initials, a dotted short word an abbreviation
    full = tuple(w for w, _ in core if len(w) > 1)
    initials = tuple(w for w, _ in core if len(w) == 1)
    if len(full) == 1 and not comma and not initials:
        return "person", full, ()
    return "person", full, initials


def _given_fits(a: str, b: str) -> bool:
    if a == b or (len(a) == 1 and b.startswith(a)) or (len(b) == 1 and a.startswith(b)):
        return True
    if len(a) >= 2 and len(b) >= 2 and (a.startswith(b) or b.startswith(a)):
        return True
    x, y = NICKNAMES.get(a, a), NICKNAMES.get(b, b)
    if x == y or x == b or y == a:
        return True
    # a short form with a slip of the key, or a slip in a full name
    return min(len(a), len(b)) >= 3 and (lcs_ratio(a, b) >= 0.75 or lcs_ratio(x, y) >= 0.8)


def _same_person(a: tuple, b: tuple, near: bool) -> int:
    """2 if both are full names that fit, 1 if one is known by an initial only, 0 if not."""
    fa, ia, fb, ib = a[1], a[2], b[1], b[2]
    if not fa or not fb:
        return 0
    limit = 0.79 if near else 1.0
    strong = len(fa) >= 2 and len(fb) >= 2
    if strong:
        for g, f in ((0, -1), (-1, 0)):
            for h, k in ((0, -1), (-1, 0)):
                fam = lcs_ratio(fa[f], fb[k])
                if fam >= limit and (fa[g] == fb[h] if not near else _given_fits(fa[g], fb[h])):
                    if min(len(fa[f]), len(fb[k])) >= 4 and (fam == 1.0 or lcs_ratio(fa[g], fb[h]) >= 0.6 or NICKNAMES.get(fa[g], fa[g]) == NICKNAMES.get(fb[h], fb[h]) or _given_fits(fa[g], fb[h])):
                        return 2
        return 0
    if not near:
        return 0
    # one of them has a family name and initials (or nothing) only
    weak, other = ((fa, ia), (fb, ib)) if len(fa) < 2 else ((fb, ib), (fa, ia))
    if len(weak[0]) != 1 or len(weak[0][0]) < 3:
        return 0
    names = other[0]
    for k, fam in enumerate(names):
        if len(fam) >= 4 and lcs_ratio(weak[0][0], fam) >= limit:
            rest = [n[0] for i, n in enumerate(names) if i != k] + list(other[1])
            if not weak[1] or not rest:
                continue
            if weak[1][0] in rest or (len(weak[1]) > 1 and weak[1][-1] in rest):
                return 1
    return 0


def _same_firm(a: tuple, b: tuple, near: bool) -> int:
    ta, tb = bool(a[2]), bool(b[2])
    ca, cb = (a[1][:-1] if ta else a[1]), (b[1][:-1] if tb else b[1])
    if not ca or not cb:
        return 0
    if not near:
        return 2 if ta and tb and ca == cb and a[1][-1] == b[1][-1] else 0
    x, y = "".join(ca), "".join(cb)
    if lcs_ratio(x, y) < 0.79:
        return 0
    if ta and tb:
        p, q = a[1][-1], b[1][-1]
        return 2 if p == q or _short_of(p, q) or _short_of(q, p) or lcs_ratio(p, q) >= 0.8 else 0
    return 1


def compare(a: str, b: str, near: bool, trades: frozenset[str] = frozenset()) -> int:
    """How surely two spellings name the same: 2 both whole, 1 one is short, 0 not.

    ``near`` says that they were used with the same address (firms: the same domain); only then
    may they differ in more than order, case, accents and remarks.
    """
    p, q = parse(a, trades), parse(b, trades)
    if p[0] != q[0] or p[0] == "none":
        return 0
    return _same_person(p, q, near) if p[0] == "person" else _same_firm(p, q, near)


def compare_far(a: str, b: str, same: bool, trades: frozenset[str] = frozenset()) -> int:
    """``compare`` of persons used with different addresses, for callers that ask for a unique partner.

    Within a domain (``same``) the rule is that of one address; across domains (or without an
    address) family names are at least 0.9 alike, those of short forms equal, and given names
    at least 0.9 alike, equal or a nickname.
    """
    p, q = parse(a, trades), parse(b, trades)
    if p[0] != "person" or q[0] != "person":
        return 0
    grade = _same_person(p, q, True)
    return grade if not grade or same or _strict(p, q) else 0


def _strict(p: tuple, q: tuple) -> bool:
    if len(p[1]) < 2 or len(q[1]) < 2:
        return bool(set(p[1]) & set(q[1]))
    alike = lambda x, y: x == y or NICKNAMES.get(x, x) == NICKNAMES.get(y, y) or min(len(x), len(y)) >= 4 and lcs_ratio(x, y) >= 0.9
    return any(lcs_ratio(p[1][f], q[1][k]) >= 0.9 and alike(p[1][g], q[1][h]) for g, f in ((0, -1), (-1, 0)) for h, k in ((0, -1), (-1, 0)))


PROFILE = "struct<kind:string,words:array<string>,initials:array<string>,heads:array<array<string>>,whole:boolean,ident:string>"


def _profile(trades: frozenset[str]) -> Callable:
    def run(names: pd.Series) -> pd.DataFrame:
        rows = []
        for n in names:
            kind, words, initials = parse(n or "", trades)
            whole = len(words) >= 2 if kind == "person" else bool(initials) and len(words) >= 2
            # per word the first letters of the others, long and short forms alike
            heads = [sorted({y[0] for j, w in enumerate(words) if j != i for y in (w, NICKNAMES.get(w, w))} | {y[0] for y in initials}) for i in range(len(words))]
            rows.append((kind, list(words), list(initials), heads, whole, (kind + ":" + " ".join(sorted(words))) if whole else None))
        return pd.DataFrame(rows, columns=["kind", "words", "initials", "heads", "whole", "ident"])

    return F.pandas_udf(run, PROFILE)


def _judge(rule: Callable, trades: frozenset[str]) -> Callable:
    def run(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series([rule(x, y, bool(n), trades) for x, y, n in zip(a, b, c)], index=a.index, dtype="int32")

    return F.pandas_udf(run, "int")


def trade_words(used: DataFrame, share: float = 0.0001) -> frozenset[str]:
    """Words that name a trade, learnt from the firms among the spellings (columns ``name``, ``address``).

    Such a word stands directly before a legal form behind another word, or ends a hyphened domain, with two
    different words before it at least, and in a share of all firms, which bounds the list.
    """

    def run(names: pd.Series) -> pd.DataFrame:
        out = []
        for n in names:
            kind, words, _ = parse(n or "")
            out.append((" ".join(words[:-1]), words[-1]) if kind == "firm" and len(words) > 1 and "@" not in n else (None, None))
        return pd.DataFrame(out, columns=["head", "trade"])

    named = used.select("name").distinct().select(F.pandas_udf(run, "struct<head:string,trade:string>")("name").alias("x")).select("x.*")
    parts = r"@([a-z]{3,})-([a-z]{3,})\.[a-z.]+$"
    boxed = used.select("address").distinct().select(F.regexp_extract("address", parts, 1).alias("head"), F.regexp_extract("address", parts, 2).alias("trade"))
    rows = named.unionByName(boxed).filter("trade is not null and length(trade) > 3 and head <> ''").distinct()
    count = cut(rows.groupBy("trade").agg(F.count("*").alias("n")).filter("n > 1"))
    firms = count.agg(F.sum("n")).first()[0] or 0
    return frozenset(r[0] for r in count.filter(F.col("n") >= share * firms).select("trade").collect())


def mentions(messages: DataFrame, recipients: DataFrame) -> DataFrame:
    """``(name, address, real)``: each spelling with each address it was used with.

    Addresses add names of their own: local parts of two words a person, hyphened domains a firm
    (``real`` false). NULL and blank names or addresses add nothing.
    """
    used = (
        messages.select(F.col("from_name").alias("name"), F.col("from_address").alias("address"))
        .unionByName(recipients.select("name", "address"))
        .select("name", F.lower(F.trim("address")).alias("address"))
        .filter("name is not null and trim(name) <> ''")
        .distinct()
        .select("name", F.coalesce("address", F.lit("")).alias("address"))
    )
    local = F.regexp_extract("address", r"^([a-zà-ÿ]{2,}[._][a-zà-ÿ]{3,})@", 1)
    firm = F.regexp_extract("address", r"@([a-z]{3,}-[a-z]{3,})\.[a-z.]+$", 1)
    boxes = used.select("address").distinct()
    own = boxes.select("address", F.explode(F.array(F.regexp_replace(local, "[._]", " "), F.regexp_replace(firm, "-", " "))).alias("name")).filter("name <> ''")
    return used.withColumn("real", F.lit(True)).unionByName(own.select("name", "address", F.lit(False).alias("real"))).groupBy("name", "address").agg(F.max("real").alias("real"))


def blocks(rows: DataFrame, least: int, common: int) -> DataFrame:
    """``(block, id)``: suffixes of the words of each mention, refined where too common.

    Rows are (id, address, domain, kind, words, whole, initials). A suffix of at least ``least``
    letters that more than ``common`` mentions share is refined with the domain and, where that is
    still too common, with the address for persons, whose other addresses ``far_blocks`` covers; the
    last refinement is never discarded. Firms of a domain are judged whatever their address, so
    there the block of the domain is split into parts that are all joined, one mention for each
    reading of a whole name. Words also block by address and first letter (the empty suffix, refined at
    once), for slips of the key near the end of a word.
    """
    # hashes keep the shuffles small; should two keys collide, a block holds a few pairs more
    firm = (F.col("kind") == "firm") & (F.col("domain") != "")
    parts = rows.select("id", F.xxhash64("address").alias("address"), F.xxhash64("domain").alias("domain"), firm.alias("firm"), F.when(F.col("whole"), F.xxhash64("words", "initials")).otherwise(F.xxhash64("id")).alias("reading"), F.explode("words").alias("w"))
    n = F.length("w")
    tails = parts.select("id", "address", "domain", "firm", "reading", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n - (least - 1), F.lit(1))), lambda i: F.xxhash64(F.col("w").substr(i, n)))).alias("s"))
    by_s = tails.groupBy("s").agg((F.count("*") > common).alias("many_s"))
    by_d = tails.groupBy("s", "domain").agg((F.count("*") > common).alias("many_d"))
    marked = tails.join(by_s, "s").join(by_d, ["s", "domain"])
    block = F.when(~F.col("many_s"), F.col("s")).otherwise(F.xxhash64("s", "domain"))
    boxes = marked.filter("many_s and many_d").select(F.xxhash64("s", F.lit("a"), "address").alias("block"), "id")
    firms = marked.filter("firm and many_s and many_d").groupBy(F.xxhash64("s", "domain", F.lit("f")).alias("block"), "reading").agg(F.min("id").alias("id")).select("block", "id")
    first = parts.select(F.xxhash64(F.lit("i"), F.substring("w", 1, 1), "address").alias("block"), "id")
    small = marked.filter("not many_s or not many_d").select(block.alias("block"), "id")
    return small.unionByName(boxes).unionByName(first).unionByName(split(firms, common)).distinct()


def links(rows: DataFrame, least: int = 4, common: int = 24, trades: frozenset[str] = frozenset()) -> DataFrame:
    """``(a, b, grade)`` between mention ids that name the same, by comparing pairs within blocks."""
    # numbers of 8 bytes stand for the ids until the pairs are known
    b = cut(blocks(rows.drop("id").withColumnRenamed("n", "id"), least, common))  # joined with itself
    slim = rows.select(F.col("n").alias("id"), F.col("id").alias("key"), "name", "address", "domain", "kind", "ident", "whole")
    one, two = b.select("block", F.col("id").alias("a")), b.select("block", F.col("id").alias("b"))
    pairs = one.join(two, "block").filter("a < b").select("a", "b").distinct()
    left = slim.select(*[F.col(c).alias(f"{c}_a") for c in slim.columns]).withColumnRenamed("id_a", "a")
    right = slim.select(*[F.col(c).alias(f"{c}_b") for c in slim.columns]).withColumnRenamed("id_b", "b")
    near = ((F.col("address_a") == F.col("address_b")) & (F.col("address_a") != "")) | ((F.col("kind_a") == "firm") & (F.col("domain_a") == F.col("domain_b")) & (F.col("domain_a") != ""))
    told = pairs.join(left, "a").join(right, "b").withColumn("near", near).filter((F.col("kind_a") == F.col("kind_b")) & (F.col("near") | (F.col("ident_a") == F.col("ident_b"))))
    graded = told.withColumn("grade", _judge(compare, trades)("name_a", "name_b", "near")).filter("grade > 0")
    out = cut(graded.select(F.col("key_a").alias("a"), F.col("key_b").alias("b"), "grade", F.col("whole_a").alias("wa"), F.col("whole_b").alias("wb")))
    release(b)
    return out


def split(keyed: DataFrame, common: int) -> DataFrame:
    """``(block, id)``: blocks of more than ``common`` ids in parts, each joined with every other."""
    sized = keyed.join(keyed.groupBy("block").agg(F.ceil(F.count("*") / common).alias("k")), "block")
    own = F.pmod(F.xxhash64("id", F.lit("part")), F.col("k"))
    cut_up = sized.select("block", "id", own.alias("h"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("i"))
    return cut_up.select(F.xxhash64("block", F.least("h", "i"), F.greatest("h", "i")).alias("block"), "id")


def far_blocks(units: DataFrame, least: int, common: int) -> DataFrame:
    """``(block, id)`` of persons over all addresses: suffixes, refined by further letters.

    A suffix that more than ``common`` of the units share is refined by the first letter of another
    word (or an initial), and then, where still too common, by the domain; the last is split and
    its parts are joined, so that no pair of a domain is lost to the size of a block.
    """
    parts = units.select("id", F.xxhash64("domain").alias("d"), F.explode(F.arrays_zip("words", "heads")).alias("x")).select("id", "d", F.col("x.words").alias("w"), F.col("x.heads").alias("heads"))
    n = F.length("w")
    tails = parts.select("id", "d", "heads", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(n - (least - 1), F.lit(1))), lambda i: F.xxhash64(F.col("w").substr(i, n)))).alias("block"))
    marked = tails.join(tails.groupBy("block").agg((F.count("*") > common).alias("many")), "block")
    more = marked.filter("many").select("id", "d", "block", F.explode("heads").alias("l")).select("id", "d", F.xxhash64("block", "l").alias("block")).distinct()
    again = more.join(more.groupBy("block").agg((F.count("*") > common).alias("many")), "block")
    last = split(again.filter("many").select("id", F.xxhash64("block", "d").alias("block")).distinct(), common)
    return marked.filter("not many").select("block", "id").unionByName(again.filter("not many").select("block", "id")).unionByName(last).distinct()


def far_links(units: DataFrame, least: int = 4, common: int = 24, trades: frozenset[str] = frozenset()) -> DataFrame:
    """``(a, b, same)``: entities (or, for short forms, units) that name the same over addresses.

    Units are (id, name, words, heads, domain, entity), ``entity`` NULL for a short form, which comes
    as ``a``; ``same`` says that both are of one domain.
    """
    b = cut(far_blocks(units, least, common))  # joined with itself
    pairs = b.select("block", F.col("id").alias("a")).join(b.select("block", F.col("id").alias("b")), "block").filter("a < b").select("a", "b").distinct()
    slim = units.select("id", "name", "domain", "entity")
    left, right = (slim.select(*[F.col(c).alias(f"{c}_{x}") for c in slim.columns]).withColumnRenamed(f"id_{x}", x) for x in "ab")
    same = (F.col("domain_a") == F.col("domain_b")) & (F.col("domain_a") != "")
    told = pairs.join(left, "a").join(right, "b").filter("(entity_a is not null or entity_b is not null) and not entity_a <=> entity_b").withColumn("same", same)
    graded = told.withColumn("grade", _judge(compare_far, trades)("name_a", "name_b", "same"))
    whole = F.col("entity_a").isNotNull() & F.col("entity_b").isNotNull()
    kept = graded.filter((F.col("grade") > 0) & (~whole | (F.col("grade") == 2)))
    kept = kept.select(
        F.when(whole, F.col("entity_a")).when(F.col("entity_a").isNull(), F.col("a")).otherwise(F.col("b")).alias("a"),
        F.when(F.col("entity_b").isNull(), F.col("entity_a")).otherwise(F.col("entity_b")).alias("b"),
        whole.alias("whole"),
        "same",
    ).distinct()
    out = cut(kept)
    release(b)
    return out


def merged(edges: DataFrame) -> DataFrame:
    """``(entity, root)`` of entities joined with others: two that are near have the same neighbours.

    Closed neighbourhoods are equal only where everything one fits the other fits too, so a name
    that fits two different persons joins with neither. Being equal is an equivalence, so the
    least member is the root of its class.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    closed = both.unionByName(both.select("a", F.col("a").alias("b")).distinct())
    sign = closed.groupBy("a").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("b")).alias("x"))
    known = both.join(sign, "a").join(sign.select(F.col("a").alias("b"), F.col("n").alias("m"), F.col("x").alias("y")), "b").filter("n = m and x = y")
    return known.groupBy(F.col("a").alias("entity")).agg(F.min("b").alias("o")).select("entity", F.least("entity", "o").alias("root"))


def entities(messages: DataFrame, recipients: DataFrame) -> DataFrame:
    """``(name, entity)``: every spelling with the entities it names (a short form may name several).

    Whole names linked to each other form an entity (connected components); whole names equal
    but for order, case, accents and remarks are one entity wherever they occur, linked through
    their common key rather than pairwise. A short form (an initial, a firm without its trade)
    belongs to each entity it fits at its address, but joins none of them to another. Persons
    are compared over addresses too: whole names there join where each is the only partner of the
    other (``merged``), and a short form that fits none at its address belongs to the only entity
    it fits in its domain, or, fitting none there, anywhere.
    """
    said = cut(mentions(messages, recipients))
    trades = trade_words(said)
    rows = said.withColumn("p", _profile(trades)("name"))
    rows = cut(
        rows.select("name", "address", "real", F.regexp_extract("address", "@(.+)$", 1).alias("domain"), "p.*", F.unhex(F.md5(F.concat_ws("\u0001", "name", "address"))).alias("id")).filter("kind <> 'none' and size(words) > 0").withColumn("n", F.monotonically_increasing_id())
    )
    found = links(rows, trades=trades)
    keyed = rows.filter("ident is not null").select(F.col("id").alias("a"), F.unhex(F.md5("ident")).alias("b"))
    strong = found.filter("grade = 2 and wa and wb").select("a", "b").unionByName(keyed)
    comp = cut(components(strong))
    short = found.filter("not (wa and wb)")
    ways = short.select(F.col("a").alias("id"), F.col("b").alias("o"), F.col("wa").alias("w")).unionByName(short.select(F.col("b").alias("id"), F.col("a").alias("o"), F.col("wb").alias("w"))).filter("not w")
    fitted = ways.join(comp.withColumnRenamed("node", "o"), "o").select("id", F.col("component").alias("entity")).distinct()
    alone = ways.join(fitted, "id", "left_anti").select("id", F.greatest("id", "o").alias("x"), F.least("id", "o").alias("y"))
    lonely = components(alone, "x", "y").select(F.col("node").alias("id"), F.col("component").alias("entity"))
    # a unit stands for all mentions of the same words in one domain
    of = rows.filter("kind = 'person' and (whole or size(initials) > 0)").withColumn("unit", F.unhex(F.md5(F.concat_ws("\u0001", F.array_join("words", " "), F.array_join("initials", " "), "domain"))))
    of = of.join(comp.select(F.col("node").alias("id"), F.col("component").alias("entity")), "id", "left").join(fitted.select("id").distinct(), "id", "left_anti")
    units = cut(of.groupBy(F.col("unit").alias("id")).agg(*[F.min(c).alias(c) for c in ("name", "words", "heads", "domain", "entity")]))
    far = far_links(units, trades=trades)
    roots = cut(merged(far.filter("whole")))
    fits = far.filter("not whole").join(roots.withColumnRenamed("entity", "b"), "b", "left").select("a", F.coalesce("root", "b").alias("e"), "same")
    here = F.when(F.col("same"), F.col("e"))
    only = fits.groupBy(F.col("a").alias("unit")).agg(F.min(here).alias("h"), F.max(here).alias("i"), F.min("e").alias("e"), F.max("e").alias("f")).filter("h = i or (h is null and e = f)")
    distant = of.filter("entity is null").select("id", "unit").join(only.select("unit", F.coalesce("h", "e").alias("entity")), "unit").select("id", "entity")
    reached = comp.withColumnRenamed("node", "id").select("id", F.col("component").alias("entity")).unionByName(fitted)
    placed = reached.join(roots, "entity", "left").select("id", F.coalesce("root", "entity").alias("entity")).unionByName(distant)
    placed = placed.unionByName(lonely.join(fitted, "id", "left_anti"))
    return placed.join(rows.select("id", "name", "real"), "id").filter("real").select("name", "entity").distinct()


def spelling_pairs(messages: DataFrame, recipients: DataFrame) -> DataFrame:
    """``(name_a, name_b)``: different spellings of two or more words that name the same."""
    e = entities(messages, recipients).filter(F.size(F.filter(F.split("name", "[ ]+"), lambda w: w != "")) >= 2)
    return e.select("entity", F.col("name").alias("name_a")).join(e.select("entity", F.col("name").alias("name_b")), "entity").filter("name_a < name_b").select("name_a", "name_b").distinct()
