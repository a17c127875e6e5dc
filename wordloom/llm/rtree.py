"""Join of texts by the Jaccard similarity of their word shingles, over R-trees of count vectors.

Shingles are hashed into 64 groups; the counts of a set's shingles in these groups are a point. Two sets share at most the
sum of the lesser counts, and a set shares with all points below a node of the tree at most the sum over its own counts
and the node's greatest ones. Pairs that this bound, the sizes and the labels leave are verified on the whole sets.

A tree of all points could not be dealt out: the boxes of unlike texts overlap, as hashed counts are much alike. So the
hash groups also say which points can meet. Sets of sizes a <= b that are similar enough differ in at most d(a) = a (100 -
percent) / percent shingles. When shingles are dealt into more than d(a) groups, two such sets agree wholly in one group
at least. So each set is sent to a bucket for each of its groups, named by all shingles in it, and meets there all sets
that it may be linked with; none is lost. Groups of fewer than three shingles would bring together texts that share a
common passage; they are left out where the others suffice, that is, where there are fewer of them than groups that must
agree.

Members of a bucket meet its hub first (the member of the largest buckets), so many copies of one text cost a comparison
each. In buckets that the hub does not link as a whole, members of different components are joined over the R-tree. Large
buckets are dealt to tasks in blocks of members, so no task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import discard, list_array, slices, texts, written
from wordloom.llm.simhash import shingle_hashes
from wordloom.llm.similar import joined

#: Groups of the count vectors, members of a leaf and children of a node, members of a bucket that meet in a task.
GROUPS, FANOUT, BLOCK = 64, 16, 4096
#: Groups of fewer shingles than this are left out where the others suffice; sizes of a band differ by this factor at most.
STRONG, BAND = 3, 1.5
#: Members of a hub that meet its set in one task.
SHARE = 4096


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """Hashes of hashes: a bijection of 64 bits that scatters them, another one for each seed."""
    x = (x + np.uint64((seed * 0x9E3779B97F4A7C15) % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def bands(percent: int, upto: int) -> np.ndarray:
    """Least sizes of the bands, beginning with the least size at which unequal sets can be linked."""
    edges = [max(1, -(-percent // max(100 - percent, 1)))]
    while edges[-1] <= upto:
        edges.append(max(int(edges[-1] * BAND), edges[-1] + 1))
    return np.array(edges)


def differing(size: int, percent: int) -> int:
    """How many shingles two linked sets differ in at most, the lesser of this size."""
    return size * (100 - percent) // percent


def buckets(shingles: np.ndarray, percent: int) -> np.ndarray:
    """The names of a set's buckets (int64): for its band, and the one below if a set of that band can be linked with it."""
    n = len(shingles)
    edges, out = bands(percent, n), []
    own = int(np.searchsorted(edges, n, "right")) - 1
    for band in (own, own - 1):
        if band < 0 or -(-percent * n // 100) >= edges[band + 1]:
            continue
        most = differing(int(edges[band + 1]) - 1, percent)
        groups = max(most + 1, int(1.06 * (most + 1) + 0.999))
        group = (mixed(shingles, 2 * band + 1) % np.uint64(groups)).astype(np.int64)
        sizes = np.bincount(group, minlength=groups)
        names = np.zeros(groups, np.uint64)
        np.add.at(names, group, mixed(shingles, 2 * band + 2))  # sums of scattered hashes do not depend on the order
        names = mixed(names ^ mixed(np.arange(groups, dtype=np.uint64) + np.uint64(band << 32), 0), 3)
        weak = sizes < STRONG
        if weak.sum() < groups - min(differing(n, percent), most):
            names = names[~weak]
        out.append(names)
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def points(shingles: np.ndarray) -> np.ndarray:
    """How many of a set's shingles fall into each of the 64 groups."""
    return np.bincount((mixed(shingles, 0) % np.uint64(GROUPS)).astype(np.int64), minlength=GROUPS).astype(np.int32)


def marks(src: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, r1, r2, k1, k2, n, buckets) for each row of src (id, text, r1, r2); k1, k2: a hash of 128 bits of its n shingles."""

    def run(batches):
        for b in slices(batches, 1 << 22):
            sets = [np.unique(shingle_hashes(t, words)) for t in b.column(1).to_pylist()]
            key = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "<i8").reshape(-1, 2)
            named = [buckets(s, percent) for s in sets]
            listed = list_array(np.concatenate(named), np.array([len(x) for x in named]), pa.int64())
            own = [pa.array(key[:, 0].copy()), pa.array(key[:, 1].copy()), pa.array([len(s) for s in sets], pa.int64()), listed]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *own], ["id", "r1", "r2", "k1", "k2", "n", "buckets"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, r1 long, r2 long, k1 long, k2 long, n long, buckets array<long>")


def sets_of(src: DataFrame, words: int) -> DataFrame:
    """(node, shingles array<long>, point array<int>) of rows (node, text), one row for each node."""

    def run(batches):
        for b in slices(batches, 1 << 22):
            sets = [np.unique(shingle_hashes(t, words)) for t in b.column(1).to_pylist()]
            point = list_array(np.concatenate([points(s) for s in sets]), np.full(len(sets), GROUPS), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(np.concatenate(sets).view(np.int64), np.array([len(s) for s in sets]), pa.int64()), point], ["node", "shingles", "point"])

    return src.mapInArrow(run, "node long, shingles array<long>, point array<int>").dropDuplicates(["node"])


class Forest:
    """R-trees of points, one for each run of equal tree numbers, over rows that lie one after another.

    Rows of a tree are sorted by component, then cut in halves again and again at the median of the coordinate that spreads
    most, until 16 are left. Leaves of 16 rows, and nodes of 16 children, keep the greatest count of each group, the least
    and greatest size, and the component if it is one.
    """

    def __init__(self, tree: np.ndarray, point: np.ndarray, n: np.ndarray, root: np.ndarray):
        self.order = self._packed(tree, point, root)
        point, n, root, tree = point[self.order], n[self.order], root[self.order], tree[self.order]
        self.point, self.n, self.root, self.tree = point, n, root, tree
        self.levels = []
        high, low, top, one, many = point, n, n, root, np.zeros(len(n), bool)
        while not self.levels or (len(tree) > 1 and np.any(tree[1:] == tree[:-1])):
            starts = np.flatnonzero(np.concatenate([[True], tree[1:] != tree[:-1]]))
            sizes = np.diff(np.append(starts, len(tree)))
            within = np.arange(len(tree)) - np.repeat(starts, sizes)
            first = np.flatnonzero(within % FANOUT == 0)
            many = np.bitwise_or.reduceat(many, first) | (np.minimum.reduceat(one, first) != np.maximum.reduceat(one, first))
            high, low, top, one, tree = np.maximum.reduceat(high, first), np.minimum.reduceat(low, first), np.maximum.reduceat(top, first), one[first], tree[first]
            self.levels.append((first, np.append(first[1:], len(within)), high, low, top, one, many))
        self.root_of = {int(t): k for k, t in enumerate(tree)}

    @staticmethod
    def _packed(tree: np.ndarray, point: np.ndarray, root: np.ndarray) -> np.ndarray:
        order = np.lexsort((root, tree))
        run = np.stack([tree[order], root[order]])
        starts = np.flatnonzero(np.concatenate([[True], (run[:, 1:] != run[:, :-1]).any(axis=0)]))
        todo = [(a, b) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]) if b - a > FANOUT]
        while todo:
            a, b = todo.pop()
            part = point[order[a:b]]
            half = (b - a) // 2 // FANOUT * FANOUT or FANOUT
            order[a:b] = order[a:b][np.argpartition(part[:, np.argmax(part.std(axis=0))], half)]
            todo += [(x, y) for x, y in ((a, a + half), (a + half, b)) if y - x > FANOUT]
        return order

    def pairs(self, percent: int, chunk: int = 1 << 13):
        """Pairs of row numbers (of the rows as given) in one tree and of different components that may be linked."""
        need = lambda bound, q, other: (100 + percent) * bound >= percent * (self.n[q] + other)
        for lo in range(0, len(self.n), 1024):
            q = np.arange(lo, min(lo + 1024, len(self.n)))
            node = np.array([self.root_of[t] for t in self.tree[q].tolist()])
            for level in range(len(self.levels) - 1, -2, -1):
                kept = []
                for i in range(0, len(q), chunk):
                    a, b = q[i : i + chunk], node[i : i + chunk]
                    if level >= 0:
                        _, end, high, low, top, one, many = self.levels[level]
                        ok = (many[b] | (one[b] != self.root[a])) & (100 * top[b] >= percent * self.n[a]) & (100 * self.n[a] >= percent * low[b])
                        a, b = a[ok], b[ok]
                        ok = need(np.minimum(self.point[a], high[b]).sum(axis=1), a, low[b])
                    else:
                        ok = (a < b) & (self.root[a] != self.root[b]) & (percent * np.maximum(self.n[a], self.n[b]) <= 100 * np.minimum(self.n[a], self.n[b]))
                        a, b = a[ok], b[ok]
                        ok = need(np.minimum(self.point[a], self.point[b]).sum(axis=1), a, self.n[b])
                    kept.append((a[ok], b[ok]))
                q, node = (np.concatenate(x) for x in zip(*kept)) if kept else (np.zeros(0, np.int64),) * 2
                if level >= 0 and len(q):
                    first, end = self.levels[level][:2]
                    sizes = end[node] - first[node]
                    at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    q, node = np.repeat(q, sizes), np.repeat(first[node], sizes) + at
            yield self.order[q], self.order[node]


def overlapping(members: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(a, b): pairs of nodes of different roots in a bucket that the R-tree's bound leaves, each pair once. members: (bucket,
    size, node, root, n, point)."""

    def found(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        key = np.stack([held["bucket"], held["lo"], held["hi"]])
        tree = np.cumsum(np.concatenate([[0], (key[:, 1:] != key[:, :-1]).any(axis=0)]))
        out = []
        for a, b in Forest(tree, held["point"], held["n"], held["root"]).pairs(percent):
            across = (held["lo"][a] == held["hi"][a]) | (held["block"][a] != held["block"][b])
            a, b = held["node"][a[across]], held["node"][b[across]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
        a, b = np.concatenate(out, axis=1)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches):
        waiting, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
            now = {name: c[name].to_numpy() for name in ("bucket", "lo", "hi", "block", "node", "root", "n")}
            now["point"] = c["point"].flatten().to_numpy().reshape(-1, GROUPS)
            waiting.append(now)
            rows += batch.num_rows
            if rows < 4 * block:
                continue
            held = {k: np.concatenate([w[k] for w in waiting]) for k in now}
            last = (held["bucket"] == held["bucket"][-1]) & (held["lo"] == held["lo"][-1]) & (held["hi"] == held["hi"][-1])
            cut = int(last.argmax())  # the last run may go on
            if cut:
                yield found({k: v[:cut] for k, v in held.items()})
            waiting, rows = [{k: v[cut:] for k, v in held.items()}], len(last) - cut
        if rows:
            yield found({k: np.concatenate([w[k] for w in waiting]) for k in waiting[0]})

    blocks = F.ceil(F.col("size") / block)
    dealt = members.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_j"))
    dealt = dealt.select("bucket", F.least("block", "_j").alias("lo"), F.greatest("block", "_j").alias("hi"), "block", "node", "root", "n", "point")
    return dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(run, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, percent: int, share: int = SHARE) -> DataFrame:
    """Those of the pairs (a, b) whose sets (node, shingles) are similar enough. A node b of many pairs meets them in shares:
    its set is sent once for each."""
    often = pairs.groupBy("b").agg(F.ceil(F.count("*") / share).cast("int").alias("shares"))
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")).join(often, "b").select("b", "y", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    asked = pairs.join(often, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int").alias("share"))
    close = (100 + percent) * F.size(F.array_intersect("x", "y")) >= percent * (F.size("x") + F.size("y"))
    return asked.join(left, "a").join(right, ["b", "share"]).filter(close).select("a", "b")


def labelled(entries: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """(node, root): the least node that each node of the buckets (bucket, node, size) reaches over links. sets: (node,
    shingles, point, n)."""
    labels = entries.select("node").distinct().withColumn("root", F.col("node"))
    weight = entries.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = entries.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("b"))
    asked = written(entries.select("bucket", F.col("node").alias("a")).join(hubs, "bucket").filter("a <> b").select("a", "b").distinct(), "asked")
    labels = joined(written(labels, "labels"), verified(asked, sets, percent))
    open_ = entries.join(labels, "node").groupBy("bucket").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a < _b").select("bucket")
    members = entries.join(open_, "bucket").join(labels, "node").join(sets.select("node", "n", "point"), "node")
    found = written(overlapping(members, percent, block), "overlapping")
    out = joined(labels, verified(found, sets, percent))
    discard(asked, found)
    return out


def shared(nodes: DataFrame) -> DataFrame:
    """(bucket, node, size): the buckets of nodes (node, buckets) that hold several nodes; of buckets with the same members
    (near copies agree in most groups) one."""
    entries = nodes.select(F.explode("buckets").alias("bucket"), "node")
    members = [F.count("*").alias("size"), F.bit_xor(F.xxhash64("node")).alias("m1"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("m2")]
    several = entries.groupBy("bucket").agg(*members).filter("size > 1").groupBy("size", "m1", "m2").agg(F.min("bucket").alias("bucket"))
    return entries.join(several.select("bucket", "size"), "bucket")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90, block: int = BLOCK) -> DataFrame:
    """One row (id_col, n_shingles, component_id) for each row of df: the size of its set of shingles, and the least id that it
    reaches over links between texts that share so many percent of all their shingles.

    A text of fewer words is one shingle; one without words, an empty or a null one has none, is linked with nothing, and
    its component is its own id. Texts of equal sets are one node, so copies cost a count. Repeated rows give a row each.
    Rows with a null id get a row with a null id, and link others like any row; a class of such rows alone has a null
    component. An empty table gives none. Shingles and sets are compared by hashes of 64 and 128 bits.
    """
    src = texts(df, id_col, text_col).select("id", "text", F.xxhash64("id", "text").alias("r1"), F.xxhash64(F.lit(1), "id", "text").alias("r2"))
    marked = written(marks(src, words, percent), "marks")
    some = marked.filter("n > 0")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "r1", "r2")).alias("least")
    nodes = some.groupBy("k1", "k2").agg(least, F.count("*").alias("rows"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    entries = written(shared(nodes), "entries")
    wanted = entries.select("node").distinct().join(nodes.select("node", "least.r1", "least.r2", "n"), "node")
    sets = sets_of(src.select("text", "r1", "r2").join(wanted, ["r1", "r2"]).select("node", "text"), words)
    sets = written(sets.join(wanted.select("node", "n"), "node"), "sets")
    labels = labelled(entries, sets, percent, block)
    placed = nodes.select("node", F.col("least.id").alias("least"), "rows", "k1", "k2").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id")).join(placed.select("root", "k1", "k2", "rows"), "root").select("k1", "k2", "rows", "component_id")
    named = written(named, "named")
    discard(entries, sets, labels, nodes)
    # Sets of a thousandth of all rows or more, a thousand at most, are broadcast: their rows stay where they are.
    total = named.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    often = named.filter(F.col("rows") * 1000 >= total).select("k1", "k2", F.col("component_id").alias("_c"), F.lit(True).alias("_often"))
    at = some.select("id", "k1", "k2", "n").join(F.broadcast(often), ["k1", "k2"], "left")
    rest = at.filter("_often is null").select("id", "k1", "k2", "n").join(named.select("k1", "k2", "component_id"), ["k1", "k2"])
    rows = [at.filter("_often").select("id", "n", F.col("_c").alias("component_id")), rest.select("id", "n", "component_id"), marked.filter("n = 0").select("id", "n", F.col("id").alias("component_id"))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
