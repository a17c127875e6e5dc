"""Euler tours of dependency trees, and what they tell: chunk models, linear clauses, highlight sets.

A tour numbers the tokens of a text's trees so that a subtree is a range: entry <= x < entry + size. Whether one token is above
another is a comparison then, and the ancestor of a token at a depth is the last token of that depth before it in tour
order, a window without a join. Tours are built by pointer doubling, so trees of any size and depth take a logarithm of
joins; a text's tokens meet in one task only where a window or a fold runs along the sentence.

Tokens on cycles, or hanging on one, are in no tree and have no row in any result. A null head, the token itself, and a
head that is no token make a root. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def euler(tokens: DataFrame, key: str = "doc") -> DataFrame:
    """(key, i, up, depth, entry, size, height, root): the head in the tree (null at roots), the place in the tour (trees and
    siblings in order), how many tokens the subtree has, and how far down it goes. tokens: (key, i, head).

    After k rounds a token knows its ancestor 2^k steps up, and how many tokens of its subtree lie within 2^k steps, which it
    hands to that ancestor. Rounds that finish no token leave those on cycles, which go. A second doubling adds up, from the
    root, what lies before a token: its earlier siblings' subtrees."""
    known = tokens.select(key, F.col("i").alias("head"), F.lit(True).alias("_there"))
    at = tokens.select(key, "i", "head").join(known, [key, "head"], "left").withColumn("up", F.when(F.col("_there") & (F.col("head") != F.col("i")), F.col("head")))
    at = at.select(key, "i", "up", F.col("up").alias("jump"), F.col("up").isNotNull().cast("int").alias("depth"), F.lit(1).cast("long").alias("size"), F.lit(0).alias("height")).checkpoint()
    span, open_ = 1, -1
    while open_ != (open_ := at.filter("jump is not null").count()) and open_:
        given = at.filter("jump is not null").groupBy(key, F.col("jump").alias("i")).agg(F.sum("size").alias("_s"), (F.max("height") + span).alias("_h"))
        above = at.select(key, F.col("i").alias("jump"), F.col("jump").alias("_j"), F.col("depth").alias("_d"))
        moved = at.join(given, [key, "i"], "left").join(above, [key, "jump"], "left")
        size, height = F.col("size") + F.coalesce("_s", F.lit(0)), F.greatest("height", F.coalesce("_h", F.lit(0)))
        at = moved.select(key, "i", "up", F.col("_j").alias("jump"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), size.alias("size"), height.alias("height")).checkpoint()
        span *= 2
    at = at.filter("jump is null")
    earlier = W.partitionBy(key, "up").orderBy("i").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("size").over(earlier), F.lit(0)) + F.col("up").isNotNull().cast("int")
    walk = at.select(key, "i", "up", "depth", "size", "height", F.col("up").alias("jump"), before.alias("entry"), F.col("i").alias("root")).checkpoint()
    while walk.filter("jump is not null").take(1):
        above = walk.select(key, F.col("i").alias("jump"), F.col("jump").alias("_j"), F.col("entry").alias("_e"), F.col("root").alias("_r"))
        moved = walk.join(above, [key, "jump"], "left")
        walk = moved.select(key, "i", "up", "depth", "size", "height", F.col("_j").alias("jump"), (F.col("entry") + F.coalesce("_e", F.lit(0))).alias("entry"), F.coalesce("_r", "root").alias("root")).checkpoint()
    return walk.select(key, "i", "up", "depth", "entry", "size", "height", "root")


def inside(entry: Column, top: Column, size: Column) -> Column:
    """Whether the token of an entry is in the subtree that begins at another one."""
    return (entry >= top) & (entry < top + size)


def attached(tour: DataFrame, key: str = "doc") -> DataFrame:
    """tour with leaf, whether the token has no children, and attached: whether a leaf stands beside its head, or beside other
    leaves of it that do. Leaves and their head are islands of neighbouring places."""
    t = tour.withColumn("leaf", F.col("size") == 1)
    leaves = t.filter("leaf and up is not null").select(key, F.col("up").alias("_h"), "i")
    family = leaves.unionByName(leaves.select(key, "_h", F.col("_h").alias("i")).distinct())
    island = F.col("i") - F.row_number().over(W.partitionBy(key, "_h").orderBy("i"))
    family = family.withColumn("_island", island)
    heads = family.filter("i = _h").select(key, "_h", F.col("_island").alias("_own"))
    beside = family.filter("i <> _h").join(heads, [key, "_h"]).select(key, "i", (F.col("_island") == F.col("_own")).alias("attached"))
    return t.join(beside, [key, "i"], "left").withColumn("attached", F.coalesce("attached", F.lit(False)))


def tops_within(tour: DataFrame, group: str, key: str = "doc") -> DataFrame:
    """tour with top: the last token that a token reaches by steps to its head within its group. A head comes before its children
    in tour order, so one fold along a text's tour gives all."""
    up = tour.select(key, F.col("i").alias("up"), F.col("entry").alias("_up_entry"))
    held = tour.join(up, [key, "up"], "left")
    rows = F.struct("entry", "i", F.col("_up_entry").alias("ue"), F.col(group).alias("g"), F.struct(*(F.col(c) for c in tour.columns)).alias("_row"))
    texts = held.groupBy(key).agg(F.array_sort(F.collect_list(rows), lambda a, b: (a["entry"] - b["entry"]).cast("int")).alias("t"))

    def step(s: Column, x: Column) -> Column:
        at = x["ue"].cast("int")
        same = F.coalesce(F.get(s["g"], at) == x["g"], F.lit(False))
        return F.struct(F.array_append(s["g"], x["g"]).alias("g"), F.array_append(s["top"], F.when(same, F.get(s["top"], at)).otherwise(x["i"])).alias("top"))

    kinds = dict(tour.dtypes)
    none = F.struct(F.expr(f"cast(array() as array<{kinds[group]}>)").alias("g"), F.expr(f"cast(array() as array<{kinds['i']}>)").alias("top"))
    tops = F.aggregate("t", none, step, lambda s: s["top"])
    return texts.select(F.explode(F.arrays_zip(F.col("t")["_row"].alias("row"), tops.alias("top"))).alias("x")).select("x.row.*", "x.top")


def split_heads(clauses: DataFrame, whole_numbers: bool, key: str = "doc") -> DataFrame:
    """clauses (a tour with clause and whether a token has_children) where a clause with several tops is split: if all its tops
    hang on one head outside, or are roots, each with all that is below it; else each top that has children, with those
    tokens below it that have children, and the others stay. The first keeps the clause's name. Clause 0 is none.

    whole_numbers: new clauses are numbered on after the greatest one, by clause and place; else they are named by their top
    alone, in a number that no clause has."""
    t = tops_within(clauses, "clause", key)
    w = W.partitionBy(key, "clause")
    is_top = F.col("i") == F.col("top")
    many = F.count_if(is_top).over(w)
    one_head = F.max(F.when(is_top, F.coalesce(F.col("up"), F.lit(-1)))).over(w) == F.min(F.when(is_top, F.coalesce(F.col("up"), F.lit(-1)))).over(w)
    t = t.withColumn("_all", (many > 1) & one_head)
    anchor = is_top & (F.col("_all") | F.col("has_children"))
    t = t.withColumn("_first", F.min(F.when(anchor, F.col("i"))).over(w)).withColumn("_anchor", anchor)
    moves = (F.col("clause") != 0) & (F.col("top") != F.col("_first")) & (F.col("_all") | F.col("has_children"))
    if whole_numbers:
        of_text = W.partitionBy(key)
        new = t.withColumn("_new", (F.col("clause") != 0) & F.col("_anchor") & (F.col("i") != F.col("_first")))
        order = F.sum(F.col("_new").cast("int")).over(of_text.orderBy("clause", "i"))
        new = new.withColumn("_number", F.when(F.col("_new"), F.max("clause").over(of_text) + order))
        given = new.withColumn("_given", F.max(F.when(F.col("_new"), F.col("_number"))).over(W.partitionBy(key, "clause", "top")))
    else:
        given = t.withColumn("_given", -(F.col("top").cast("long") + 1))
    return given.withColumn("clause", F.when(moves, F.col("_given")).otherwise(F.col("clause"))).select(*clauses.columns)


def clause_groups(tokens: DataFrame, branch: int = 1, drop: int = 3, key: str = "doc", tour: DataFrame | None = None) -> DataFrame:
    """(key, i, clause): clauses from left to right, numbered from 1; 0 is none. tokens: (key, i, head).

    Heads with `branch` (1 to 5) levels of heads below them are taken in order; a new clause begins where one is neither
    above nor below the one before it. All other tokens take the clause of the nearest such head above them. Along a clause,
    a token `drop` (0 to 10) or more levels deeper than the one before it begins another one. Then clauses with several
    tops are split, tokens without children follow their head, clauses become runs of neighbours, and those with several
    tops are split again. A text without such heads is one clause before it is split."""
    branch, drop = max(1, min(5, branch)), max(0, min(10, drop))
    t = (euler(tokens, key) if tour is None else tour).withColumn("has_children", F.col("size") > 1).withColumn("_branch", F.col("height") > branch)
    of_text = W.partitionBy(key)
    heads = t.filter("_branch")
    along = of_text.orderBy("i")
    entry, size = F.lag("entry").over(along), F.lag("size").over(along)
    line = inside(F.col("entry"), entry, size) | inside(entry, F.col("entry"), F.col("size"))
    heads = heads.withColumn("_n", F.sum(F.coalesce(~line, F.lit(True)).cast("int")).over(along)).select(key, "i", F.col("_n").cast("long").alias("_n"))
    t = t.join(heads, [key, "i"], "left").withColumn("_n", F.coalesce("_n", F.lit(0))).withColumn("_any", F.max("_branch").over(of_text))
    # Above such a head stand such heads only, so among the others the top of a token's run hangs on the nearest one.
    below = tops_within(t, "_branch", key)
    nearest = t.filter("_branch").select(key, F.col("i").alias("_h"), F.col("_n").alias("_hn"))
    tops = below.select(key, F.col("i").alias("top"), F.col("up").alias("_h"))
    named = below.join(tops, [key, "top"]).join(nearest, [key, "_h"], "left")
    clause = F.when(~F.col("_any"), F.lit(1)).when(F.col("_branch"), F.col("_n")).otherwise(F.coalesce("_hn", F.lit(0)))
    named = named.withColumn("clause", clause.cast("long"))
    run = W.partitionBy(key, "clause").orderBy("i")
    falls = F.col("_any") & (F.col("clause") != 0) & F.coalesce(F.col("depth") - F.lag("depth").over(run) >= drop, F.lit(False))
    parts = named.withColumn("_part", F.sum(falls.cast("int")).over(run))
    rank = F.dense_rank().over(of_text.orderBy("clause", "_part"))
    parts = parts.withColumn("clause", F.when(F.col("clause") == 0, F.lit(0)).otherwise(rank).cast("long")).select(key, "i", "up", "depth", "entry", "size", "has_children", "clause")
    split = split_heads(parts, False, key)
    # A name by a top is unique in a text: a top leads one new clause.
    parent = split.select(key, F.col("i").alias("up"), F.col("clause").alias("_uc"))
    split = split.join(parent, [key, "up"], "left").withColumn("clause", F.when(~F.col("has_children") & F.col("_uc").isNotNull(), F.col("_uc")).otherwise(F.col("clause"))).drop("_uc")
    named_before = F.last(F.when(F.col("clause") != 0, F.col("clause")), ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1))
    begins = (F.col("clause") != 0) & F.coalesce(F.col("clause") != named_before, F.lit(True))
    number = F.sum(begins.cast("int")).over(along)
    runs = split.withColumn("clause", F.when(F.col("clause") == 0, F.lit(0)).otherwise(number).cast("long"))
    return split_heads(runs.select(*split.columns), True, key).select(key, "i", "clause")


def placed_levels(tokens: DataFrame, most: int, clauses: DataFrame | None, key: str, tour: DataFrame | None) -> DataFrame:
    """A row for each token and each head above it, or itself, at depth 0 to `most`, that is of its clause (depth 0: that is its
    own head): (key, head, head_depth, head_pos, i, upos, kind), where kind is own, member or extra. At depth 0 only leaves
    belong to a root."""
    tour = attached(euler(tokens, key) if tour is None else tour, key).join(tokens.select(key, "i", F.coalesce("upos", F.lit("DEFAULT")).alias("upos")), [key, "i"])
    tour = tour.join(clauses.select(key, "i", "clause"), [key, "i"], "left") if clauses is not None else tour.withColumn("clause", F.lit(None).cast("long"))
    along = W.partitionBy(key).orderBy("entry").rowsBetween(W.unboundedPreceding, W.currentRow)
    head = F.struct("i", "depth", "upos", "clause", "leaf")
    levels = [F.when(F.col("depth") >= d, F.last(F.when(F.col("depth") == d, head), ignorenulls=True).over(along)) for d in range(most + 1)]
    held = tour.withColumn("_heads", F.array(*levels))
    rows = held.select(key, "i", "up", "upos", "leaf", "attached", F.col("clause").alias("_c"), F.explode(F.filter("_heads", lambda h: h.isNotNull() & ~h["leaf"])).alias("h"))
    own = F.col("h.i") == F.col("i")
    root = (F.col("h.depth") == 0) & (own | (F.col("leaf") & (F.col("up") == F.col("h.i"))))
    belongs = root | ((F.col("h.depth") > 0) & F.col("_c").eqNullSafe(F.col("h.clause")))
    kind = F.when(own, "own").when(~F.col("leaf") | F.col("attached"), "member").otherwise("extra")
    return rows.filter(belongs).select(key, F.col("h.i").alias("head"), F.col("h.depth").alias("head_depth"), F.col("h.upos").alias("head_pos"), "i", "upos", kind.alias("kind"))


def chunk_model(tokens: DataFrame, most: int = 4, clauses: DataFrame | None = None, key: str = "doc", tour: DataFrame | None = None) -> DataFrame:
    """(key, chunk_head, members, extras, depth, pos, singleton): the chunks down to a depth. tokens: (key, i, head, upos); clauses:
    (key, i, clause), as clause_groups gives them, or none; tour: what euler gives, where it is at hand.

    A root's chunk (pos ROOT) is the root and the leaves beside it; every other token with children, at depth 1 to `most`,
    heads a chunk of all of its subtree and clause, but for leaves that do not stand beside their head (attached): these
    are its extras, and each is a singleton chunk of the same depth."""
    rows = placed_levels(tokens, most, clauses, key, tour)
    chunks = rows.groupBy(key, F.col("head").alias("chunk_head"), F.col("head_depth").alias("depth"), "head_pos").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") != "extra", F.col("i")))).alias("members"), F.array_sort(F.collect_list(F.when(F.col("kind") == "extra", F.col("i")))).alias("extras")
    )
    pos = F.when(F.col("depth") == 0, "ROOT").otherwise(F.col("head_pos"))
    whole = chunks.select(key, "chunk_head", "members", "extras", "depth", pos.alias("pos"), F.lit(False).alias("singleton"))
    none = F.slice(F.array("i"), 1, 0)
    lone = rows.filter("kind = 'extra'").select(key, F.col("i").alias("chunk_head"), F.array("i").alias("members"), none.alias("extras"), F.col("head_depth").alias("depth"), F.col("upos").alias("pos"), F.lit(True).alias("singleton"))
    return whole.unionByName(lone)


def canonical_chunks(tokens: DataFrame, most: int = 4, clauses: DataFrame | None = None, key: str = "doc", tour: DataFrame | None = None) -> DataFrame:
    """(key, i, chunk_head, depth, pos): the deepest chunk of chunk_model that a token is a member of; one of none is its own, at
    depth -1."""
    tour = euler(tokens, key) if tour is None else tour
    rows = placed_levels(tokens, most, clauses, key, tour)
    lone = F.col("kind") == "extra"
    pos = F.when(lone, F.col("upos")).when(F.col("head_depth") == 0, "ROOT").otherwise(F.col("head_pos"))
    best = rows.groupBy(key, "i").agg(F.max_by(F.struct(F.when(lone, F.col("i")).otherwise(F.col("head")).alias("chunk_head"), F.col("head_depth").alias("depth"), pos.alias("pos")), "head_depth").alias("c"))
    all_ = tour.select(key, "i").join(tokens.select(key, "i", F.coalesce("upos", F.lit("DEFAULT")).alias("upos")), [key, "i"])
    return all_.join(best, [key, "i"], "left").select(key, "i", F.coalesce("c.chunk_head", "i").alias("chunk_head"), F.coalesce("c.depth", F.lit(-1)).alias("depth"), F.coalesce("c.pos", "upos").alias("pos"))


def highlights(tokens: DataFrame, roll: bool = False, key: str = "doc", tour: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """What to show around a token: (key, i, branch), and (key, branch, members, rolled) of each branch. tokens: (key, i, head,
    upos, dep).

    A token under a root shows its whole branch below that root; a root shows itself and the leaves beside it (attached). A
    branch of a single leaf is rolled into the root, so that it shows these, too; so is, with `roll`, any that is no
    relative clause (dep acl), and then it also shows all branches with children from the root on, to either side, up to
    the first relative clause that is a verb. It is not rolled where a clause stands between its top and the root: a token
    of a branch with children (with `roll`: of one that is a relative clause). As all of a branch has one set, there is a row
    for each branch and none for pairs of tokens; each set is connected by its tree's edges."""
    t = attached(euler(tokens, key) if tour is None else tour, key)
    named = tokens.select(key, "i", F.upper(F.coalesce("upos", F.lit(""))).alias("upos"), F.lower(F.coalesce("dep", F.lit(""))).alias("dep"))
    along = W.partitionBy(key).orderBy("entry").rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.join(named, [key, "i"]).withColumn("_acl", F.col("dep").isin("acl", "acl:relcl"))
    top = F.last(F.when(F.col("depth") == 1, F.struct("i", "leaf", "_acl")), ignorenulls=True).over(along)
    t = t.withColumn("_top", F.when(F.col("depth") > 0, top)).withColumn("branch", F.coalesce("_top.i", "i"))
    clause = F.coalesce(~F.col("_top.leaf") & (F.col("_top._acl") if roll else F.lit(True)), F.lit(False)).cast("int")
    t = t.withColumn("_clause", clause).withColumn("_upto", F.sum(clause).over(W.partitionBy(key, "root").orderBy("i")))
    roots = t.filter("depth = 0").select(key, F.col("i").alias("root"), F.col("_upto").alias("_root_upto"))
    tops = t.filter("depth = 1").join(roots, [key, "root"])
    right = F.col("i") > F.col("root")
    between = F.when(right, F.col("_upto") - F.col("_clause") - F.col("_root_upto")).otherwise(F.col("_root_upto") - F.col("_upto"))
    rolls = (F.col("leaf") | (F.lit(roll) & ~F.col("_acl"))) & (between == 0)
    outward = W.partitionBy(key, "root", right).orderBy(F.abs(F.col("i") - F.col("root")))
    stops = F.sum((~F.col("leaf") & F.col("_acl") & (F.col("upos") == "VERB")).cast("int")).over(outward)
    tops = tops.withColumn("rolled", rolls).withColumn("_reached", F.lit(roll) & ~F.col("leaf") & (stops == 0)).select(key, "root", F.col("i").alias("branch"), "rolled", "_reached")
    own = t.groupBy(key, "root", "branch").agg(F.array_sort(F.collect_list("i")).alias("members"), F.array_sort(F.collect_list(F.when((F.col("depth") == 0) | ((F.col("depth") == 1) & F.col("attached")), F.col("i")))).alias("_near"))
    placed = own.join(tops, [key, "root", "branch"], "left")
    shown = F.array_sort(F.flatten(F.collect_list("_near"))).alias("_near")
    further = F.flatten(F.collect_list(F.when(F.col("_reached"), F.col("members")))).alias("_further")
    of_root = placed.groupBy(key, "root").agg(shown, further)
    whole = placed.drop("_near").join(of_root, [key, "root"])
    members = F.when(F.col("rolled").isNull(), F.col("_near")).when(F.col("rolled"), F.array_sort(F.array_union("members", F.array_union("_near", "_further")))).otherwise(F.col("members"))
    return t.select(key, "i", "branch"), whole.select(key, "branch", members.alias("members"), F.coalesce("rolled", F.lit(False)).alias("rolled"))
