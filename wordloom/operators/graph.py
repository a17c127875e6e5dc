"""Questions to dependency trees and other head relations: edges (doc, child, head), roots have themselves or null as head."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _kept(df: DataFrame) -> DataFrame:
    """A table of the checkpoint folder, so that a loop's plan stays short and a lost executor costs one round."""
    return df.checkpoint()


def depths(tokens: DataFrame, key: str = "doc") -> DataFrame:
    """(key, i, head, depth): roots, and tokens whose head is missing, have depth 0. tokens: (key, i, head).

    Rounds of pointer doubling: after k rounds each token knows its ancestor 2^k steps up, so a tree of depth d takes
    log2(d) joins. Each round finishes tokens of a tree; tokens on a cycle, or hanging on one, never finish, so when a round
    finishes none they are left with a null depth."""
    known = tokens.select(key, F.col("i").alias("head"), F.lit(True).alias("_there"))
    jump = tokens.join(known, [key, "head"], "left").select(key, "i", "head", F.when(F.col("_there") & (F.col("head") != F.col("i")), F.col("head")).alias("up"))
    jump, open_ = _kept(jump.withColumn("steps", F.when(F.col("up").isNull(), 0).otherwise(1))), -1
    while open_ != (open_ := jump.filter("up is not null").count()) and open_:
        above = jump.select(key, F.col("i").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        jump = _kept(jump.join(above, [key, "up"], "left").select(key, "i", "head", F.col("_up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps")))
    return jump.select(key, "i", "head", F.when(F.col("up").isNull(), F.col("steps")).alias("depth"))


def closure(edges: DataFrame, most: int | None = None) -> DataFrame:
    """(ancestor, node, distance) of all pairs, by doubling; edges: (child, parent). most: only pairs so near. On a cycle a
    distance is the least one, so that doubling ends there too."""
    reach = _kept(edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("distance")).distinct())
    done, held = 1, reach.count()
    while most is None or done < most:
        further = reach.alias("a").join(reach.alias("b"), F.col("a.node") == F.col("b.ancestor")).select("a.ancestor", "b.node", (F.col("a.distance") + F.col("b.distance")).alias("distance"))
        reach = _kept(reach.unionByName(further).groupBy("ancestor", "node").agg(F.min("distance").alias("distance")))
        done, before, held = done * 2, held, reach.count()
        if held == before:
            break
    return reach if most is None else reach.filter(F.col("distance") <= most)


def k_hop(edges: DataFrame, seeds: DataFrame, k: int) -> DataFrame:
    """(seed, node, hops): nodes within k undirected steps, the seed included at 0. edges: (a, b); seeds: (seed)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    seen = seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hops"))
    for step in range(1, k + 1):
        edge = seen.filter(F.col("hops") == step - 1).join(both, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node"), F.lit(step).alias("hops"))
        seen = seen.unionByName(edge.distinct()).groupBy("seed", "node").agg(F.min("hops").alias("hops"))
    return seen


def components(edges: DataFrame) -> DataFrame:
    """(node, component): least node that each node reaches; edges: (a, b). Large-star and small-star rounds."""
    current, before = _kept(edges.filter("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct()), None
    while True:
        now = tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now[0] == 0 or now == before:
            return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now
        both = current.unionByName(current.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").selectExpr("b as a", "m as b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        current = _kept(large.join(least, "a").filter("b <> m").selectExpr("b as a", "m as b").unionByName(least.selectExpr("a", "m as b")).distinct())


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(seed, a, b): the edges between two nodes of a seed's neighbourhood (seed, node)."""
    own = nodes.select("seed", F.col("node").alias("a")).join(edges.select("a", "b").distinct(), "a")
    return own.join(nodes.select("seed", F.col("node").alias("b")), ["seed", "b"]).select("seed", "a", "b")


def context_windows(tokens: DataFrame, most: int, key: str = "doc") -> DataFrame:
    """(key, i, left, right): the largest tree-connected run of up to `most` tokens around each token; ties go to the
    more balanced run, then to the one further right. tokens: (key, i, head), head equal to i or null at a root.

    A run of a tree is connected if it holds one edge less than tokens. Edges are narrow intervals, so only those not
    longer than the run are spread over the runs that hold them."""
    base = tokens.select(key, "i", "head")
    last = base.groupBy(key).agg(F.max("i").alias("last"))
    runs = base.join(last, key).select(key, F.col("i").alias("left"), F.explode(F.sequence(F.col("i"), F.least(F.col("i") + most - 1, F.col("last")))).alias("right"))
    span = base.filter("head is not null and head <> i").select(key, F.least("i", "head").alias("lo"), F.greatest("i", "head").alias("hi")).filter(F.col("hi") - F.col("lo") < most)
    held = span.select(key, "hi", "lo", F.explode(F.sequence(F.greatest(F.col("hi") - (most - 1), F.lit(0)), F.col("lo"))).alias("left"))
    inside = held.select(key, "left", F.explode(F.sequence(F.col("hi"), F.col("left") + most - 1)).alias("right")).groupBy(key, "left", "right").agg(F.count("*").alias("edges"))
    ok = runs.join(inside, [key, "left", "right"], "left").filter(F.coalesce("edges", F.lit(0)) == F.col("right") - F.col("left"))
    around = ok.select(key, "left", "right", F.explode(F.sequence("left", "right")).alias("i"))
    order = W.partitionBy(key, "i").orderBy(F.desc(F.col("right") - F.col("left")), F.abs((F.col("i") - F.col("left")) - (F.col("right") - F.col("i"))), F.desc("right"))
    return around.withColumn("_n", F.row_number().over(order)).filter("_n = 1").select(key, "i", "left", "right")


def bottom_up(tokens: DataFrame, threshold: int = 5, key: str = "doc") -> DataFrame:
    """(key, i, chunk): tokens joined by head edges not longer than a threshold; a chunk is named by its first token.

    Labels are strings of key and place only to keep documents apart in one graph."""
    name = lambda c: F.struct(F.col(key).alias("d"), F.col(c).alias("i"))
    near = tokens.filter((F.col("head").isNotNull()) & (F.abs(F.col("head") - F.col("i")) <= threshold))
    found = components(near.select(name("i").alias("a"), name("head").alias("b")))
    labels = found.select(F.col("node.d").alias(key), F.col("node.i").alias("i"), F.col("component.i").alias("chunk"))
    return tokens.select(key, "i").join(labels, [key, "i"], "left").select(key, "i", F.coalesce("chunk", "i").alias("chunk"))


def tops(tokens: DataFrame, most_jump: int | None = None, key: str = "doc") -> DataFrame:
    """(key, i, top): the last ancestor that a token reaches by steps to its head, none of them longer than a jump.
    Pointer doubling, as in depths; a cycle ends after as many rounds as its tokens can need."""
    ok = F.col("head").isNotNull() & (F.col("head") != F.col("i"))
    if most_jump is not None:
        ok = ok & (F.abs(F.col("head") - F.col("i")) <= most_jump)
    at = _kept(tokens.select(key, "i", F.when(ok, F.col("head")).otherwise(F.col("i")).alias("top")))
    for _ in range(32):
        up = at.select(key, F.col("i").alias("top"), F.col("top").alias("_top"))
        new = _kept(at.join(up, [key, "top"], "left").select(key, "i", F.coalesce("_top", "top").alias("top"), (F.col("_top") != F.col("top")).alias("_moved")))
        if not new.filter("_moved").take(1):
            return new.select(key, "i", "top")
        at = new.drop("_moved")
    return at


def heights(tokens: DataFrame, key: str = "doc") -> DataFrame:
    """(key, i, height): steps from a token down to its farthest descendant; null on a cycle, and above one.

    Depths give each token its own level; pointer doubling then hands the deepest level below to all ancestors: after k
    rounds a token knows the deepest of its descendants within 2^k steps. Rows stay one a token, no pairs are made."""
    level = depths(tokens, key)
    at = level.withColumn("up", F.when((F.col("depth") > 0), F.col("head"))).select(key, "i", "depth", "up", F.col("depth").alias("deepest"))
    at = _kept(at)
    while at.filter("up is not null").take(1):
        given = at.filter("up is not null").groupBy(key, F.col("up").alias("i")).agg(F.max("deepest").alias("_d"))
        above = at.select(key, F.col("i").alias("up"), F.col("up").alias("_up"))
        moved = at.join(given, [key, "i"], "left").join(above, [key, "up"], "left")
        at = _kept(moved.select(key, "i", "depth", F.col("_up").alias("up"), F.greatest("deepest", F.coalesce("_d", "deepest")).alias("deepest")))
    return at.select(key, "i", (F.col("deepest") - F.col("depth")).cast("int").alias("height"))


def branch_chunks(tokens: DataFrame, threshold: int, key: str = "doc") -> DataFrame:
    """(key, i, chunk): a branch higher than the threshold is a chunk of its own, named by its top; lower ones stay with their
    head's chunk; roots name their own."""
    high = heights(tokens, key)
    own = tokens.join(high, [key, "i"]).withColumn("_head", F.when(F.col("head").isNull() | (F.col("head") == F.col("i")) | (F.col("height") > threshold), F.col("i")).otherwise(F.col("head")))
    return tops(own.select(key, "i", F.col("_head").alias("head")), key=key).select(key, "i", F.col("top").alias("chunk"))


def gap_components(tokens: DataFrame, shallow: int, boundary: str | None = None, key: str = "doc") -> DataFrame:
    """(key, i, component): tokens that edges join which cross only shallow tokens: those whose height is at most `shallow`, and,
    where a column tells whether a token stands at a boundary, any that do not. A component is named by its first token.

    Deep tokens are counted by a running sum, so an edge's gap is a difference of two sums and no range join."""
    high = tokens.join(heights(tokens, key), [key, "i"])
    blocks = (F.col("height") > shallow) & (F.col(boundary) if boundary else F.lit(True))
    sums = high.withColumn("_n", F.sum(blocks.cast("int")).over(W.partitionBy(key).orderBy("i"))).withColumn("_b", blocks.cast("int"))
    ends = sums.select(key, F.col("i").alias("head"), F.col("_n").alias("_hn"), F.col("_b").alias("_hb"))
    edges = sums.filter("head is not null and head <> i").join(ends, [key, "head"])
    inside = F.when(F.col("head") > F.col("i"), F.col("_hn") - F.col("_hb") - F.col("_n")).otherwise(F.col("_n") - F.col("_b") - F.col("_hn"))
    name = lambda c: F.struct(F.col(key).alias("d"), F.col(c).alias("i"))
    found = components(edges.filter(inside == 0).select(name("i").alias("a"), name("head").alias("b")))
    labels = found.select(F.col("node.d").alias(key), F.col("node.i").alias("i"), F.col("component.i").alias("component"))
    return tokens.select(key, "i").join(labels, [key, "i"], "left").select(key, "i", F.coalesce("component", "i").alias("component"))


def bottom_up_compressed(tokens: DataFrame, entities: DataFrame, threshold: int = 5, key: str = "doc") -> DataFrame:
    """(key, i, chunk): bottom_up with each entity (key, first, last) as one place: distances count entities once, edges inside
    one are left out, and all its tokens share a chunk."""
    inside = entities.select(key, "first", F.explode(F.sequence("first", "last")).alias("i"))
    placed = tokens.join(inside, [key, "i"], "left").withColumn("unit", F.coalesce("first", "i"))
    rank = F.dense_rank().over(W.partitionBy(key).orderBy("unit"))
    placed = placed.withColumn("p", rank - 1)
    ends = placed.select(key, F.col("i").alias("head"), F.col("p").alias("hp"))
    moved = placed.join(ends, [key, "head"], "left").filter("hp is not null and hp <> p")
    units = placed.select(key, F.col("p").alias("i")).distinct()
    edges = moved.select(key, F.col("p").alias("i"), F.col("hp").alias("head"))
    near = edges.filter(F.abs(F.col("head") - F.col("i")) <= threshold)
    name = lambda c: F.struct(F.col(key).alias("d"), F.col(c).alias("i"))
    found = components(near.select(name("i").alias("a"), name("head").alias("b"))).select(F.col("node.d").alias(key), F.col("node.i").alias("p"), F.col("component.i").alias("c"))
    labels = units.withColumnRenamed("i", "p").join(found, [key, "p"], "left").select(key, "p", F.coalesce("c", "p").alias("c"))
    first = placed.groupBy(key, "p").agg(F.min("i").alias("_i")).withColumnRenamed("p", "c")
    return placed.join(labels, [key, "p"]).join(first, [key, "c"]).select(key, "i", F.col("_i").alias("chunk"))


def group_edges(groups: DataFrame, places: DataFrame, edges: DataFrame, key: str = "doc") -> DataFrame:
    """groups (key, grp, first, last) with back (the last group before it that a head of its tokens lies in) and ahead (its first
    token whose head lies to the right of the whole group), null without such. places: (key, i, island); edges: (key, i,
    head); a key is one sentence."""
    at = places.join(groups.select(key, "grp", F.explode(F.sequence("first", "last")).alias("island")), [key, "island"]).select(key, "i", "grp")
    ends = at.withColumn("_last", F.max("i").over(W.partitionBy(key, "grp")))
    own = edges.filter("head is not null and head <> i").select(key, "i", "head").join(ends, [key, "i"])
    both = own.join(at.select(key, F.col("i").alias("head"), F.col("grp").alias("hg")), [key, "head"], "left")
    told = both.groupBy(key, "grp").agg(F.max(F.when(F.col("hg") < F.col("grp"), F.col("hg"))).alias("back"), F.min(F.when(F.col("head") > F.col("_last"), F.col("i"))).alias("ahead"))
    return groups.join(told, [key, "grp"], "left")


def absorbed(groups: DataFrame, key: str = "doc") -> DataFrame:
    """(key, grp, first, last): a group with no token ahead and an edge back into the group before it, as grown so far, joins
    that one; groups as group_edges gives them. A fold over a sentence's groups whose state is the grown group."""
    one = F.struct("grp", "first", "last", "back", "ahead")
    every = groups.groupBy(key).agg(F.array_sort(F.collect_list(one)).alias("g"))

    def step(done, x):
        grown = F.element_at(done, -1)
        joins = x["ahead"].isNull() & F.coalesce(x["back"] >= grown["grp"], F.lit(False)) & (x["first"] == grown["last"] + 1)
        own = F.struct(x["grp"].alias("grp"), x["first"].alias("first"), x["last"].alias("last"))
        longer = F.struct(grown["grp"].alias("grp"), grown["first"].alias("first"), x["last"].alias("last"))
        return F.when(joins, F.array_append(F.slice(done, 1, F.size(done) - 1), longer)).otherwise(F.array_append(done, own))

    first = F.transform(F.slice("g", 1, 1), lambda x: F.struct(x["grp"].alias("grp"), x["first"].alias("first"), x["last"].alias("last")))
    grown = F.aggregate(F.slice("g", 2, F.greatest(F.size("g") - 1, F.lit(0))), first, step)
    return every.select(key, F.posexplode(grown).alias("grp", "_g")).select(key, F.col("grp").cast("long").alias("grp"), "_g.first", "_g.last")


def acl_gated(groups: DataFrame, gates: DataFrame, key: str = "doc") -> DataFrame:
    """(key, grp, first, last): a group joins the one after it unless its token ahead is a gate (key, i: roots and verbs that are
    relative clauses) or it has none; groups as group_edges gives them for what absorbed leaves."""
    gate = gates.select(key, F.col("i").alias("ahead"), F.lit(True).alias("_gate")).distinct()
    held = groups.join(gate, [key, "ahead"], "left")
    ends = (F.col("ahead").isNull() | F.coalesce("_gate", F.lit(False))).cast("int")
    before = F.coalesce(F.sum(ends).over(W.partitionBy(key).orderBy("grp").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return held.withColumn("_g", before).groupBy(key, F.col("_g").alias("grp")).agg(F.min("first").alias("first"), F.max("last").alias("last"))


def root_paths(tokens: DataFrame, key: str = "doc", most: int = 1000) -> DataFrame:
    """(key, i, path): the heads of a token on its way up, nearest first, without the root; up to `most`."""
    name = lambda c: F.struct(F.col(key).alias("d"), F.col(c).alias("i"))
    pairs = closure(tokens.filter("head is not null and head <> i").select(name("i").alias("child"), name("head").alias("parent")), most)
    roots = tokens.filter("head is null or head = i").select(name("i").alias("ancestor"))
    inner = pairs.join(roots, "ancestor", "left_anti")
    path = inner.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("distance", F.col("ancestor.i").alias("a"))))["a"].alias("path"))
    return tokens.select(key, "i", name("i").alias("node")).join(path, "node", "left").select(key, "i", F.coalesce("path", F.expr("cast(array() as array<int>)")).alias("path"))


def island_groups(places: DataFrame, edges: DataFrame, key: str = "doc") -> DataFrame:
    """(key, grp, first, last): runs of neighbouring islands, each joined to the next by an edge. places: (key, i, island);
    edges: (key, i, head)."""
    at = lambda c: places.select(key, F.col("i").alias(c), F.col("island").alias(f"_{c}"))
    ends = edges.filter("head is not null and head <> i").join(at("i"), [key, "i"]).join(at("head"), [key, "head"])
    linked = ends.filter("abs(_i - _head) = 1").select(key, F.greatest("_i", "_head").alias("island"), F.lit(True).alias("_on")).distinct()
    runs = places.select(key, "island").distinct().join(linked, [key, "island"], "left")
    grp = F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(W.partitionBy(key).orderBy("island")) - 1
    return runs.withColumn("grp", grp).groupBy(key, "grp").agg(F.min("island").alias("first"), F.max("island").alias("last"))
