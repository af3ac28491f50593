"""Near-duplicate texts by a blocked sparse product of the text-by-shingle incidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postloom.operators.components import components
from postloom.session import cut, parallelism, release, tidy_shuffles


def words(c: Column) -> Column:
    """Runs of a-z and 0-9 after lower-casing."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9]+"), F.lit(0))


def shingles(w: Column, size: int) -> Column:
    """Hashes of the different word sequences of ``size`` words."""
    starts = F.sequence(F.lit(0), F.size(w) - size)
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(size)))))


def _hashed(side: DataFrame, rows: int) -> DataFrame:
    """``side`` of a join, ``rows`` at most and spread evenly by its key, to be hashed rather than sorted where a task's share is small."""
    return side.hint("shuffle_hash") if rows <= 1_000_000 * parallelism(side.sparkSession) else side


def _encoded(rows: DataFrame, cells: int, size: int, part: int) -> tuple[list[DataFrame], list[int]]:
    """(tables, steps) for ``rows`` (id, words) of about ``cells`` shingles: those that occur again, as numbers in one order from rarest to most common.

    The tables are (id, n, c): all different shingles of the text counted, and the numbers of those
    that other texts have too, ascending. ``steps[j]`` is the first number of a shingle in more
    than ``part`` * 2**j texts. Texts are encoded in up to four passes, so that the disk never
    holds more than a share of the occurrences.
    """
    texts = rows.select("id", F.split("words", " ").alias("w")).select("id", shingles(F.col("w"), size).alias("s"))
    # outer: else the planner adds a filter that computes the shingles once more (no text is without one)
    count = texts.select(F.explode_outer("s").alias("h")).groupBy("h").agg(F.count("*").alias("df"))
    # the place in the sorted table: the number of its part above 33 bits, of the row below
    order = cut(count.filter("df > 1").orderBy("df", "h").select("h", "df", F.monotonically_increasing_id().alias("at")))
    sizes = dict(order.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("rows")).collect())
    starts, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(k, 0)
    kind = "int" if total < 2**31 else "bigint"
    start = F.get(F.array(*map(F.lit, starts or [0])).cast("array<bigint>"), F.shiftright("at", 33).cast("int"))
    numbered = order.select("h", "df", (start + F.col("at").bitwiseAND(F.lit(2**33 - 1))).cast(kind).alias("c"))
    steps = [x for x in numbered.agg(*(F.min(F.when(F.col("df") > part * 2**j, F.col("c"))) for j in range(32))).first() if x is not None]
    codes = _hashed(numbered.select("h", "c"), cells)
    passes = min(4, 1 + cells // 2_000_000)
    tables = []
    for k in range(passes):
        mine = texts.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == k)
        found = mine.select("id", F.size("s").alias("n"), F.explode_outer("s").alias("h")).join(codes, "h")
        tables.append(cut(found.groupBy("id", "n").agg(F.array_sort(F.collect_list("c")).alias("c"))))
    release(order)
    return tables, steps


def near_pairs(texts: DataFrame, key: str, text: str, size: int = 5, threshold: float = 0.8, min_words: int = 1, part: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """(pairs, members) of near-duplicate texts.

    ``pairs`` is (a, b, overlap, similarity) between class representatives with a < b and Jaccard
    similarity of word shingles at or above ``threshold``; ``members`` is (key, rep) for every
    text long enough, rep being the smallest key with the same words. Exact copies thus never meet
    each other in the join, and no link between different texts is lost.

    The product is taken over shingles in blocks (shuffle partitions), rows being the texts and
    only those columns kept per row that a pair above the threshold must share: the
    n - ceil(t n) + 1 globally rarest, and of the shorter text the n - ceil(2 t n / (1 + t)) + 1
    rarest. The sizes of two texts ask for an overlap; the first shingle that they share, in the
    order of all, has at least so many of either text from it on. A meeting with fewer left is
    dropped before it is shuffled, so no pair is lost. Maps of 256 bits per text then tell most pairs that
    differ in too many shingles (never one that does not), and the overlap of the pairs left is counted
    from their two rows. Shingles that occur once never enter the product. The rows of a shingle that
    more than ``part`` texts share are parted, and the rows of shorter texts meet each part in a task of
    its own, so a sequence in every text holds no task up.

    Disk: shingles are stored as numbers of 4 bytes, work that needs more than its share is done in
    passes, and the shuffle files of a step go at its end. Candidates are made for some of the shorter
    texts at a time and only those above the threshold are kept, so their number takes time, not disk.

    NULL or short texts (fewer words than ``min_words`` or ``size``) take no part. Repeated rows
    of a key count once.
    """
    t = float(threshold)
    with tidy_shuffles(texts.sparkSession):
        docs = texts.filter(F.col(key).isNotNull()).select(F.col(key).alias("_key"), words(F.col(text)).alias("w"))
        # a filter on the words would find them twice: texts too short are written without any, and left out when read
        long = docs.select("_key", F.when(F.size("w") >= max(min_words, size), F.array_join("w", " ")).alias("words"))
        written = cut(long.select("_key", "words", F.unhex(F.md5("words")).alias("text")))
        hashed = written.filter("text is not null")
        # numbers of 8 bytes stand for the different texts until the pairs are known; writing fixes them
        watch = Observation()
        different = hashed.groupBy("text").agg(F.min("_key").alias("rep"), F.any_value("words").alias("words")).select(F.monotonically_increasing_id().alias("id"), "text", "rep", "words")
        rows = cut(different, watch, F.sum(F.size(F.split("words", " "))).alias("cells"))
        reps, keys = cut(rows.select("id", "text", "rep")), cut(hashed.select("_key", "text").distinct())
        release(written)
        encoded, steps = _encoded(rows, watch.get["cells"] or 0, size, part)
        release(rows)
        parts = _linked(reduce(DataFrame.unionByName, encoded), steps, t)
        for table in encoded:
            release(table)
    pairs = reduce(DataFrame.unionByName, parts)
    named = pairs.join(reps.select(F.col("id").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("id").alias("b"), F.col("rep").alias("rb")), "b")
    members = keys.join(reps.select("text", "rep"), "text").select(F.col("_key").alias(key), "rep")
    return named.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"), "overlap", "similarity"), members


def _linked(encoded: DataFrame, steps: list[int], t: float) -> list[DataFrame]:
    """Tables (a, b, overlap, similarity) of the encoded texts with a similarity of ``t`` or more; a is the shorter text, or the one of less id."""
    # a text's columns from rarest to most common; those that occur once come before all others
    single = F.col("n") - F.size("c")
    keep = F.col("n") - F.ceil(F.col("n") * t - 1e-8) + 1
    prefix = encoded.select("id", "n", F.posexplode(F.slice("c", 1, F.greatest(keep - single, F.lit(0)).cast("int"))).alias("p", "h"), single.alias("single")).select("h", "id", "n", (F.col("p") + F.col("single")).alias("p"))
    k = reduce(lambda c, s: c * F.when(F.col("h") >= s, 2).otherwise(1), steps, F.lit(1))
    place = F.pmod(F.xxhash64("id"), F.lit(_PLACES))
    left = prefix.filter(F.col("n") - F.col("p") >= F.ceil(2 * F.col("n") * (t / (1 + t)) - 1e-8)).select("h", F.col("id").alias("a"), F.col("n").alias("na"), F.col("p").alias("pa"), k.alias("k"), place.alias("place"))
    right = prefix.select("h", F.pmod(F.hash("id"), k).alias("part"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"))
    need = F.ceil((F.col("na") + F.col("nb")) * (t / (1 + t)) - 1e-9)
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    shorter = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    maps = cut(encoded.select("id", "n", single.alias("single"), *_map("c")))
    texts = max(maps.count(), 20_000)
    cells, copies = left.agg(F.count("*"), F.sum("k")).first()
    # shorter texts are taken in rounds: their copies for the parts, and the pairs they give, stay in proportion to the texts
    if not cells:
        release(maps)
        return [cut(encoded.sparkSession.createDataFrame([], "a bigint, b bigint, overlap int, similarity double"))]
    most = min(_PLACES, 2 * _PLACES * cells // copies)
    width, lo, tables = min(most, 100_000 * _PLACES // texts), 0, []
    while lo < _PLACES:
        hi = lo + max(width, 1)
        # a row of the shorter text meets each part of the others, which have one place each
        mine = left.filter(F.col("place").between(lo, hi - 1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        met = mine.join(_hashed(right, 2 * cells), ["h", "part"]).filter(shorter & (F.col("na") >= F.ceil(F.col("nb") * t - 1e-9)) & (room >= need))
        watch = Observation()
        found = cut(met.select("a", "b").distinct(), watch, F.count(F.lit(1)).alias("pairs"))
        pairs = watch.get["pairs"]
        watch = Observation()
        close = cut(_close(found, maps, texts, t), watch, F.count(F.lit(1)).alias("pairs"))
        release(found)
        # the pairs are narrow and the rows of texts wide: those go by unsorted
        tables += _judged(_hashed(close, texts), encoded, t, -(-watch.get["pairs"] // texts) or 1)
        release(close)
        if len(tables) > 32:
            old, tables = tables, [cut(reduce(DataFrame.unionByName, tables))]
            for table in old:
                release(table)
        width, lo = int(min(most, width * min(4, max(0.25, 20 * texts / (pairs or 1))))), hi
    release(maps)
    return tables


def _map(c: str) -> list[Column]:
    """256 bits in four columns: each tells whether an odd number of the shingles fall on it. Two maps differ in no more bits than their texts in shingles."""
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), x.bitwiseAND(F.lit(63)).cast("int"))
    mine = lambda k: F.filter(c, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(3)) == k)
    return [F.aggregate(mine(k), F.lit(0).cast("bigint"), lambda acc, x: acc.bitwiseXOR(bit(x))).alias(f"m{k}") for k in range(4)]


def _close(found: DataFrame, maps: DataFrame, texts: int, t: float) -> DataFrame:
    """The candidates whose maps, and shingles that no other text has, do not differ too much already."""
    a, b = (_hashed(maps.select(F.col("id").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in maps.columns[1:])), texts) for k in ("a", "b"))
    full = found.join(a, "a").join(b, "b")
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"m{k}_a").bitwiseXOR(F.col(f"m{k}_b"))) for k in range(4)), F.col("single_a") + F.col("single_b"))
    size = F.col("n_a") + F.col("n_b")
    return full.filter(differ <= size - 2 * F.ceil(size * (t / (1 + t)) - 1e-9)).select("a", "b")


# Fixed value: how finely the texts can be parted into rounds.
_PLACES = 1 << 20


def _judged(found: DataFrame, encoded: DataFrame, t: float, passes: int) -> list[DataFrame]:
    """Tables (a, b, overlap, similarity) of the candidates at or above the threshold, one for each pass over some of the shorter texts."""
    tables = []
    for i in range(passes):
        mine, first = (x.filter(F.pmod(F.xxhash64(k, F.lit("pass")), F.lit(passes)) == i) for x, k in ((found, "a"), (encoded, "id")))
        shorter = first.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca")).join(mine, "a")
        full = shorter.join(encoded.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb")), "b")
        overlap = full.select("a", "b", "na", "nb", F.size(F.array_intersect("ca", "cb")).alias("overlap"))
        union = F.col("na") + F.col("nb") - F.col("overlap")
        tables.append(cut(overlap.filter(F.col("overlap") >= F.ceil(union * t - 1e-9)).select("a", "b", "overlap", (F.col("overlap") / union).alias("similarity"))))
    return tables


def expand(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """``(a, b)``: all pairs of keys, from pairs of representatives and their members, a < b."""
    m = members.select(F.col("rep").alias("r"), F.col(key).alias("k"))
    x = pairs.select(F.col("a").alias("r"), F.col("b").alias("rb")).join(m, "r").select(F.col("k").alias("x"), F.col("rb").alias("r")).join(m, "r").select("x", F.col("k").alias("y"))
    copies = members.filter(F.col(key) != F.col("rep"))
    # exact copies: each with the copies before it
    same = copies.select(F.col("rep").alias("r"), F.col(key).alias("x")).join(m.withColumnRenamed("k", "y"), "r").filter("y < x").select("x", "y")
    return x.unionByName(same).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def groups(pairs: DataFrame, members: DataFrame, key: str) -> DataFrame:
    """``(key, rep, cluster, links)``: one row per text with its class and number of linked texts."""
    linked = components(pairs.select("a", "b"))
    degree = pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("links"))
    info = linked.select(F.col("node").alias("rep"), F.col("component").alias("cluster")).join(degree, "rep")
    return members.join(info, "rep", "left").select(key, "rep", F.coalesce("cluster", "rep").alias("cluster"), F.coalesce("links", F.lit(0)).alias("links"))
