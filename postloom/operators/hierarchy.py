"""Parent–child rows to full hierarchies by heavy-path decomposition."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from postloom.operators.skew import running_sum, salted_lookup
from postloom.session import cut, release

BLOCK = 256  # positions of a chain held in one array when paths are written out


def bare_id(c: Column) -> Column:
    """Header id without outer blanks, then without one pair of angle brackets."""
    t = F.trim(F.regexp_replace(c, r"[\t\r\n]", " "))
    return F.when(t.startswith("<") & t.endswith(">") & (F.length(t) >= 2), t.substr(F.lit(2), F.length(t) - 2)).otherwise(t)


def reply_links(messages: DataFrame) -> DataFrame:
    """``(id, message_id, parent)`` of each message, parent NULL for those that answer nothing here.

    The parent is in_reply_to if that message is in the table, else the last entry of
    references_json that is. Repeated rows count once. NULL, empty or unreadable references name
    no parent; NULL message ids have no row.
    """
    raw = messages.filter(F.col("message_id").isNotNull()).select("message_id", "in_reply_to", "references_json").dropDuplicates(["message_id"])
    rows = (
        raw.select(
            bare_id(F.col("message_id")).alias("id"),
            "message_id",
            F.when(bare_id(F.col("in_reply_to")) != "", bare_id(F.col("in_reply_to"))).alias("irt"),
            F.from_json("references_json", "array<string>").alias("refs"),
        )
        .groupBy("id")
        .agg(F.min(F.struct("message_id", "irt", "refs")).alias("r"))
        .select("id", "r.*")
    )
    rows = cut(rows)
    # every mention with its rank: the direct answer first, then references from the last one back
    mentions = rows.select("id", F.posexplode(F.concat(F.transform(F.coalesce("refs", F.array().cast("array<string>")), lambda x: bare_id(x)), F.array("irt"))).alias("pos", "ref")).filter("ref is not null and ref <> ''")
    known = salted_lookup(mentions, rows.select(F.col("id").alias("ref")), "ref", "left_semi")
    parent = known.groupBy("id").agg(F.max(F.struct("pos", "ref")).alias("m")).select("id", F.col("m.ref").alias("parent"))
    return rows.select("id", "message_id").join(parent, "id", "left")


def _climb(links: DataFrame, sizes: bool) -> DataFrame:
    """Pointer doubling over trees: (id, parent, anc, dist, done, size) after O(log depth) rounds.

    A round looks up the pointer of the pointer of rows that have not reached a root. Sizes add up
    the sizes of the rows exactly 2^k below.
    """
    t = links.select(
        "id",
        "parent",
        F.coalesce("parent", "id").alias("anc"),
        F.when(F.col("parent").isNull(), 0).otherwise(1).cast("long").alias("dist"),
        F.col("parent").isNull().alias("done"),
        F.lit(1).cast("long").alias("size"),
    )
    watch = Observation()
    t = cut(t, watch, F.count(F.when(~F.col("done"), 1)).alias("n"))
    open_rows, step = watch.get["n"], 1
    while open_rows:
        up = t.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("done").alias("done2"))
        moving = t.filter("not done").drop("done")
        jumped = moving.join(up, "anc").select("id", "parent", F.col("anc2").alias("anc"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"), "size")
        new = jumped.unionByName(t.filter("done").select("id", "parent", "anc", "dist", "done", "size"))
        if sizes:
            below = t.filter(F.col("dist") == step).groupBy(F.col("anc").alias("id")).agg(F.sum("size").alias("_more"))
            new = new.join(below, "id", "left").withColumn("size", F.col("size") + F.coalesce("_more", F.lit(0))).drop("_more")
        watch = Observation()
        old, t = t, cut(new, watch, F.count(F.when(~F.col("done"), 1)).alias("n"))
        release(old)
        open_rows = watch.get["n"]
        step *= 2
    return t


def _loops(hung: DataFrame) -> DataFrame:
    """``(id, root)`` for rows on or below a loop: the smallest id on it.

    Doubling goes on until the set of pointers stops shrinking; it then is the set of loop rows,
    because pointers of rows on a loop run around it and no other row is anybody's far ancestor.
    """
    u = cut(hung.select("id", "parent", "anc"))
    size = u.select("anc").distinct().count()
    while True:
        up = u.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"))
        u2 = cut(salted_lookup(u, up, "anc", "inner").select("id", "parent", F.col("anc2").alias("anc")))
        now = u2.select("anc").distinct().count()
        u = u2
        if now == size:
            break
        size = now
    on_loop = u.select(F.col("anc").alias("id")).distinct()
    ring = cut(on_loop.join(u.select("id", "parent"), "id").select("id", F.col("parent").alias("nxt"), F.col("id").alias("low")))
    while True:
        ahead = ring.select(F.col("id").alias("nxt"), F.col("nxt").alias("nxt2"), F.col("low").alias("low2"))
        turned = cut(ring.join(ahead, "nxt").select("id", F.col("nxt2").alias("nxt"), F.least("low", "low2").alias("low"), (F.col("low2") < F.col("low")).alias("_moved")))
        moved = turned.filter("_moved").limit(1).count()
        ring = turned.drop("_moved")
        if not moved:
            break
    return salted_lookup(u.select("id", "anc"), ring.select(F.col("id").alias("anc"), F.col("low").alias("root")), "anc", "inner").select("id", "root")


SEGMENTS = "array<struct<chain:string,upto:bigint>>"
LABELS = f"id string, parent string, size bigint, chain string, pos bigint, segments {SEGMENTS}, first bigint"
TREE_ROWS = 100_000


def _label_trees(_key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """Chains, segments and preorder numbers of whole trees that together have a bounded size."""
    ids = rows["id"].tolist()
    at = {x: i for i, x in enumerate(ids)}
    up = [at[p] if p is not None else -1 for p in rows["parent"].tolist()]
    below: list[list[int]] = [[] for _ in ids]
    order = []
    for i, p in enumerate(up):
        (order if p < 0 else below[p]).append(i)
    above: dict[int, list[tuple[str, int]]] = {i: [] for i in order}
    for i in order:
        order.extend(below[i])
    size = [1] * len(ids)
    for i in reversed(order):
        if up[i] >= 0:
            size[up[i]] += size[i]
    head, pos, first = list(range(len(ids))), [0] * len(ids), [0] * len(ids)
    for i in order:
        # the child with the largest subtree goes on the chain, the others head their own
        n = first[i] + 1
        for j, c in enumerate(sorted(below[i], key=lambda x: (size[x], ids[x]), reverse=True)):
            first[c] = n
            n += size[c]
            if j:
                above[c] = [*above[head[i]], (ids[head[i]], pos[i])]
            else:
                head[c], pos[c] = head[i], pos[i] + 1
    segments = [[{"chain": c, "upto": u} for c, u in (*above[head[i]], (ids[head[i]], pos[i]))] for i in range(len(ids))]
    return pd.DataFrame({"id": ids, "parent": rows["parent"], "size": size, "chain": [ids[h] for h in head], "pos": pos, "segments": segments, "first": first})


def _tops(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of trees with their topmost ``anc``, rows on or below a loop), after O(log depth) rounds.

    A round looks up the pointer of the pointer of rows that have not reached a root, narrow rows of
    two ids. Row counts decide the end: if a round settles no further row, whatever is left hangs
    on a loop, for an unsettled row of a tree would have an ancestor that this round had settled.
    """
    watch = Observation()
    t = cut(links.select("id", F.coalesce("parent", "id").alias("anc"), F.col("parent").isNull().alias("done")), watch, F.count(F.when(~F.col("done"), 1)).alias("n"))
    open_rows = watch.get["n"]
    while open_rows:
        up = t.select(F.col("id").alias("anc"), F.col("anc").alias("anc2"), F.col("done").alias("done2"))
        # two hops more where the pointer found is open itself
        far = up.select(F.col("anc").alias("anc2"), F.col("anc2").alias("anc3"), F.col("done2").alias("done3"))
        moved = t.filter("not done").join(up, "anc").join(far, "anc2").select("id", F.col("anc3").alias("anc"), F.col("done3").alias("done"))
        watch = Observation()
        old, t = t, cut(moved.unionByName(t.filter("done")), watch, F.count(F.when(~F.col("done"), 1)).alias("n"))
        release(old)
        left = watch.get["n"]
        if left == open_rows:
            break
        open_rows = left
    return t.filter("done").drop("done"), t.filter("not done").drop("done")


def decompose(links: DataFrame, tree_rows: int = TREE_ROWS) -> DataFrame:
    """Heavy-path labels of a forest given as ``(id, parent)`` (ids unique, parents present).

    Returns, for every row: ``root, depth`` (-1 and the smallest id of the loop for rows on or
    below a loop), ``size`` (of the subtree), ``chain`` (the topmost id of its heavy chain),
    ``pos`` (its place in it), ``segments`` (array<struct<chain,upto>>: whole ancestor path as
    chain prefixes from the root down, its own included; at most log2(n)+1 entries), and
    ``first, last``: the interval of preorder numbers within its tree, so the descendants of a row
    are exactly the rows of the same root with ``first`` in (its first, its last]. Root and depth are
    read off the segments: the first chain, and the rows of all prefixes. Loop rows have NULL in
    these. An empty table gives an empty result.

    Loops are separated first. Trees of up to ``tree_rows`` rows are labelled whole, in parts of some
    ``tree_rows`` rows; larger ones by doubling over all tasks, with the same labels.
    """
    tops, hung = _tops(links)
    watch = Observation()
    rows = cut(links.join(tops, "id").withColumnRenamed("anc", "top"), watch, F.count(F.lit(1)).alias("n"))
    large = cut(rows.groupBy("top").agg(F.count("*").alias("n")).filter(F.col("n") > tree_rows).select("top"))
    if large.limit(1).count():
        spread = _spread(salted_lookup(rows, large, "top", "left_semi").select("id", "parent"))
        small = salted_lookup(rows, large, "top", "left_anti")
    else:
        spread, small = None, rows
    n = watch.get["n"]
    labels = small.groupBy(F.pmod(F.xxhash64("top"), F.lit(max(1, -(-n // (tree_rows // 4 + 1))))).alias("part")).applyInPandas(_label_trees, LABELS)
    labels = labels if spread is None else labels.unionByName(spread)
    done = labels.withColumn("last", F.col("first") + F.col("size") - 1)
    done = done.withColumn("root", F.get("segments", F.lit(0))["chain"]).withColumn("depth", F.aggregate("segments", F.lit(-1).cast("long"), lambda s, x: s + x["upto"] + 1))
    if hung.limit(1).count():
        lost = _loops(links.join(hung, "id")).join(links, "id").select("id", "parent", "root", F.lit(-1).cast("long").alias("depth"))
        done = done.unionByName(lost, allowMissingColumns=True)
    return done.select("id", "parent", "root", "depth", "size", "chain", "pos", "segments", "first", "last")


def _spread(links: DataFrame) -> DataFrame:
    """Labels of trees of any size: subtree sizes, chains and chain offsets by doubling."""
    trees = _climb(links, sizes=True).select("id", "parent", "size")
    heavy = trees.filter("parent is not null").groupBy("parent").agg(F.max_by("id", F.struct("size", "id")).alias("heavy"), F.max("size").alias("heavy_size"))
    child = cut(
        salted_lookup(trees.withColumnRenamed("parent", "p"), heavy.withColumnRenamed("parent", "p"), "p", "left")
        .withColumn("is_head", F.col("p").isNull() | (F.col("heavy") != F.col("id")))
        .select("id", F.col("p").alias("parent"), "size", "is_head", "heavy_size")
    )
    # chain of each row: pointer doubling along heavy links only
    heads = child.select("id", F.when(F.col("is_head"), F.lit(None)).otherwise(F.col("parent")).alias("parent"))
    chained = _climb(heads, sizes=False)
    rows = cut(child.join(chained.select("id", F.col("anc").alias("chain"), F.col("dist").alias("pos")), "id"))
    # offset of a light child among its siblings: heavy child first, then by size and id
    light = rows.filter("is_head and parent is not null").select("id", "parent", "size", "heavy_size")
    order = [F.desc("size"), F.asc("id")]
    offset = running_sum(light, ["parent"], order, "size", "_sum").select(F.col("id").alias("chain"), "parent", (F.col("heavy_size") + F.col("_sum") - F.col("size") + 1).alias("off"))
    above = salted_lookup(offset, rows.select(F.col("id").alias("parent"), F.col("chain").alias("up"), F.col("pos").alias("upto")), "parent", "inner")
    # chains: doubling up the tree of chains, which is at most log2(n) deep
    chains = rows.filter("is_head").select(F.col("id").alias("chain")).join(above.drop("parent"), "chain", "left")
    chains = cut(
        chains.select(
            "chain",
            "up",
            F.when(F.col("up").isNull(), F.array().cast("array<struct<chain:string,upto:bigint>>")).otherwise(F.array(F.struct(F.col("up").alias("chain"), F.col("upto")))).alias("segs"),
            F.coalesce(F.col("off") + F.col("upto"), F.lit(0)).alias("first"),
        )
    )
    while chains.filter("up is not null").limit(1).count():
        nxt = chains.select(F.col("chain").alias("up"), F.col("up").alias("up2"), F.col("segs").alias("segs2"), F.col("first").alias("first2"))
        moved = salted_lookup(chains.filter("up is not null"), nxt, "up", "inner").select("chain", F.col("up2").alias("up"), F.concat("segs2", "segs").alias("segs"), (F.col("first") + F.col("first2")).alias("first"))
        chains = cut(moved.unionByName(chains.filter("up is null")))
    return salted_lookup(rows, chains.drop("up"), "chain", "inner").select("id", "parent", "size", "chain", "pos", F.concat("segs", F.array(F.struct("chain", F.col("pos").alias("upto")))).alias("segments"), (F.col("first") + F.col("pos")).alias("first"))


def paths(tree: DataFrame) -> DataFrame:
    """``(id, path)``: ids from the root to the row itself, from chain segments.

    Chains are stored in blocks of at most ``BLOCK`` ids, so no chain is gathered whole; a path
    takes whole blocks and the beginning of the last one of each segment. Loop rows have an empty
    path.
    """
    blocks = (
        tree.filter("chain is not null")
        .groupBy("chain", F.expr(f"pos div {BLOCK}").alias("blk"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]).alias("ids"))
    )
    need = (
        tree.filter("chain is not null")
        .select("id", F.posexplode("segments").alias("seg", "s"))
        .select("id", "seg", F.col("s.chain").alias("chain"), F.col("s.upto").alias("upto"))
        .withColumn("blk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"upto div {BLOCK}"))))
    )
    parts = need.join(blocks, ["chain", "blk"]).select("id", "seg", "blk", F.slice("ids", 1, F.least(F.lit(BLOCK), F.col("upto") - F.col("blk") * BLOCK + 1).cast("int")).alias("ids"))
    whole = parts.groupBy("id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seg", "blk", "ids"))), lambda x: x["ids"])).alias("path"))
    return whole.unionByName(tree.filter("chain is null").select("id", F.array().cast("array<string>").alias("path")))


def descendants(tree: DataFrame, of: DataFrame | None = None) -> DataFrame:
    """``(ancestor, id)``: all rows below each row of ``of`` (column ``id``; all rows by default), by interval.

    Preorder numbers are cut into blocks of ``BLOCK``; an interval meets the blocks it touches only,
    so the rows of a large tree are spread and no row is compared with a tree's other branches.
    """
    top = tree.filter("chain is not null and size > 1")
    top = top if of is None else top.join(of.select("id").distinct(), "id", "left_semi")
    low, high = (F.expr(f"{x} div {BLOCK}") for x in ("(first + 1)", "last"))
    top = top.select(F.col("id").alias("ancestor"), "root", F.col("first").alias("_f"), F.col("last").alias("_l"), F.explode(F.sequence(low, high)).alias("blk"))
    below = tree.filter("chain is not null").select("id", "root", "first", F.expr(f"first div {BLOCK}").alias("blk"))
    return below.join(top, ["root", "blk"]).filter("first > _f and first <= _l").select("ancestor", "id")


def reply_tree(messages: DataFrame) -> DataFrame:
    """Heavy-path labels of all messages by their reply links, with ``message_id``."""
    links = cut(reply_links(messages))
    return links.select("id", "message_id").join(decompose(links.select("id", "parent")), "id")
