"""Exact top-k search by inner product with one KD-tree for each shard.

A shard is a cell of space: medians of a bounded sample, always along the widest side, cut space into cells, and a cell
with more rows than a shard holds is dealt to several shards. A shard's tree splits its vectors in the same way and keeps
tight boxes. The greatest product of a query with anything in a box is known from the box alone, so a search takes the
most promising box first and ends when none can still beat the k-th score. First each query searches the shard that it
lies in. Its k-th score is then held against the boxes of all other shards, in blocks, and the query is sent only to those
whose box can still beat it; their searches begin with that score.
"""

from __future__ import annotations

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import written

#: Vectors in a shard and in a leaf, about; vectors of the sample that cuts space, at most about; boxes and queries in a block.
SHARD, LEAF, SAMPLE, BOXES, BLOCK = 4096, 96, 16384, 512, 4096
LEAST = -(2**63)


@dataclass
class Tree:
    """Nodes as arrays; a leaf's vectors are rows first..last of the reordered vectors. left 0: a leaf."""

    ids: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    left: np.ndarray
    right: np.ndarray
    first: np.ndarray
    last: np.ndarray


def build(ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> Tree:
    order = np.argsort(ids, kind="stable")
    low, high, left, right, first, last = [], [], [], [], [], []
    todo = [(0, len(ids), -1, 0)]
    while todo:
        a, b, up, side = todo.pop()
        rows, k = vectors[order[a:b]], len(low)
        if up >= 0:
            (left, right)[side][up] = k
        lo, hi = rows.min(axis=0), rows.max(axis=0)
        for column, value in zip((low, high, left, right, first, last), (lo, hi, 0, 0, a, b)):
            column.append(value)
        wide = int(np.argmax(hi - lo))
        if b - a > leaf and hi[wide] > lo[wide]:
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows[:, wide], mid, kind="introselect")]
            todo += [(a, a + mid, k, 0), (a + mid, b, k, 1)]
    return Tree(ids[order], vectors[order], *map(np.array, (low, high, left, right, first, last)))


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T in whole numbers; through floats where these are exact."""
    top = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T) if top >= 2**63 else a @ b.T


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """For each query the (score, -id) of its k best in the tree, best first, of those that reach its bound."""
    reach = product(np.maximum(queries, 0), tree.high) + product(np.minimum(queries, 0), tree.low)
    left, right, first, last = (x.tolist() for x in (tree.left, tree.right, tree.first, tree.last))
    out = []
    for q, own, bound, row in zip(queries, query_ids.tolist(), bounds.tolist(), reach.tolist()):
        best: list[tuple[int, int]] = []
        queue = [(-row[0], 0)]
        while queue:
            up, node = heapq.heappop(queue)
            if -up < bound:
                break
            if left[node]:
                for child in (left[node], right[node]):
                    if row[child] >= bound:
                        heapq.heappush(queue, (-row[child], child))
                continue
            a, b = first[node], last[node]
            scores = product(q[None, :], tree.vectors[a:b])[0]
            for at in np.flatnonzero(scores >= bound).tolist():
                vec = int(tree.ids[a + at])
                if vec == own:
                    continue
                item = (int(scores[at]), -vec)
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k:
                bound = max(bound, best[0][0])
        out.append(sorted(best, reverse=True))
    return out


def integers(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec, v array<long>): the rows that take part, as whole numbers floor(scale * x)."""
    raw = df.select(F.col(f"`{id_col}`").cast("long").alias("vec"), F.col(f"`{vector_col}`").cast("array<double>").alias("x"))
    bad = lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    whole = raw.filter("vec is not null and x is not null and size(x) > 0").filter(~F.exists("x", bad))
    return whole.select("vec", F.transform("x", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v"))


def cuts(sample: np.ndarray, rows: int, shard_rows: int) -> list[tuple[int, int, int, int]]:
    """Splits (side, value, left, right) of a sample until a part stands for a shard's rows; a child -k-1 is the cell k."""
    out: list[tuple[int, int, int, int]] = []
    cells = 0

    def part(points: np.ndarray) -> int:
        nonlocal cells
        wide = int(np.argmax(points.max(axis=0) - points.min(axis=0))) if len(points) else 0
        middle = int(np.median(points[:, wide])) if len(points) else 0
        left = points[:, wide] < middle if len(points) else None
        if len(points) < 16 or len(points) * rows <= shard_rows * len(sample) or not left.any():
            cells += 1
            return -cells
        at = len(out)
        out.append((wide, middle, 0, 0))
        out[at] = (wide, middle, part(points[left]), part(points[~left]))
        return at

    part(sample)
    return out


def cells_of(vectors: np.ndarray, splits: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The cell of each vector."""
    at = np.zeros(len(vectors), np.int64) if splits else np.full(len(vectors), -1)
    while len(k := np.flatnonzero(at >= 0)):
        side, value, left, right = np.array([splits[i] for i in at[k].tolist()]).T
        at[k] = np.where(vectors[k, side] < value, left, right)
    return -at - 1


def top_k(df: DataFrame, every: int = 100, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every`, its k best among all others.

    Vectors that are null or hold null, NaN or infinite parts take no part, nor do rows with a null id. Ties go to the
    smaller id. A repeated id is one query; all its rows are candidates of others. Vectors of another length than the
    query's are no candidates. An empty table, or one without other candidates, gives none.

    The sample only cuts space; the result is exact. Equal or close vectors beyond a shard's rows are dealt to several
    shards by row number, so a task never holds more. A tree is sent once for each BLOCK queries that its box lets through.
    """
    rows = integers(df, id_col, vector_col, scale).withColumn("dim", F.size("v"))
    n = rows.count()
    taken = rows.filter(F.pmod(F.xxhash64("vec", "v"), F.lit(max(1, n // SAMPLE))) == 0).limit(2 * SAMPLE).select("dim", "v").collect()
    by_dim: dict[int, list] = {}
    for r in taken:
        by_dim.setdefault(r.dim, []).append(r.v)
    splits = {d: cuts(np.array(v, np.int64), n * len(v) // len(taken), shard_rows) for d, v in by_dim.items()}

    def placed(batches):
        for pdf in batches:
            pdf["cell"] = 0
            for d, part in pdf.groupby("dim"):
                pdf.loc[part.index, "cell"] = cells_of(np.array(part["v"].tolist(), np.int64), splits.get(d, []))
            yield pdf[["vec", "v", "dim", "cell"]]

    in_cells = written(rows.select("vec", "v", "dim").mapInPandas(placed, "vec long, v array<long>, dim int, cell long"), "cells")
    sizes = in_cells.groupBy("dim", "cell").agg(F.ceil(F.count("*") / shard_rows).alias("parts"))
    part = F.pmod(F.monotonically_increasing_id(), F.col("parts"))
    dealt = in_cells.join(F.broadcast(sizes), ["dim", "cell"]).select("vec", "v", "dim", F.xxhash64("dim", "cell", part).alias("shard"))

    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, vectors = pdf["vec"].to_numpy(np.int64), np.array(pdf["v"].tolist(), np.int64)
        tree = build(ids, vectors)
        asked = np.flatnonzero(ids % every == 0)
        asked = asked[np.unique(ids[asked], return_index=True)[1]]
        found = search(tree, ids[asked], vectors[asked], np.full(len(asked), LEAST), k)
        bounds = np.array([f[-1][0] if len(f) == k else LEAST for f in found], np.int64)
        hits = [(int(q), -i, s) for q, f in zip(ids[asked], found) for s, i in f]
        block = (ids[asked], vectors[asked], bounds)
        box = [[tree.low[0].tolist()], [tree.high[0].tolist()]]
        return pd.DataFrame({"dim": pdf["dim"].iloc[:1], "shard": pdf["shard"].iloc[:1], "low": box[0], "high": box[1], "tree": [pickle.dumps(tree)], "block": [pickle.dumps(block)], "asked": [len(asked)], "hits": [hits]})

    hit = "query_id long, vec_id long, score long"
    shape = f"dim int, shard long, low array<long>, high array<long>, tree binary, block binary, asked long, hits array<struct<{hit.replace(' long', ': long')}>>"
    built = written(dealt.groupBy("dim", "shard").applyInPandas(own, shape), "trees")
    near = built.select(F.explode("hits").alias("h")).select("h.*")
    groups = max(1, -(-built.count() // BOXES))
    boxes = built.select("dim", F.pmod(F.xxhash64("shard"), F.lit(groups)).alias("g"), F.struct("shard", "low", "high").alias("b")).groupBy("dim", "g").agg(F.collect_list("b").alias("boxes"))
    asking = built.filter("asked > 0").select("dim", "block", F.col("shard").alias("home"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("g"))

    def let_through(batches):
        """Which queries of a block can find something in which shard."""
        for pdf in batches:
            out = []
            for block, home, boxes in zip(pdf["block"], pdf["home"], pdf["boxes"]):
                ids, vectors, bounds = pickle.loads(block)
                low, high = (np.array([b[c].tolist() for b in boxes], np.int64) for c in ("low", "high"))
                reach = product(np.maximum(vectors, 0), high) + product(np.minimum(vectors, 0), low)
                for j, b in enumerate(boxes):
                    ok = np.flatnonzero((reach[:, j] >= bounds) & (b["shard"] != home))
                    if len(ok):
                        out.append((b["shard"], len(ok), home, pickle.dumps((ids[ok], vectors[ok], bounds[ok]))))
            yield pd.DataFrame(out, columns=["shard", "n", "home", "block"]).astype({"shard": "int64", "n": "int64", "home": "int64"})

    sent = written(asking.join(boxes, ["dim", "g"]).select("block", "home", "boxes").mapInPandas(let_through, "shard long, n long, home long, block binary"), "asked")
    blocks = sent.groupBy("shard").agg(F.ceil(F.sum("n") / BLOCK).alias("blocks"))
    visits = sent.join(blocks, "shard").select("shard", F.pmod(F.xxhash64("home"), F.col("blocks")).alias("nth"), "block")
    trees = built.select("shard", "tree").join(blocks, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("nth"), "tree")

    def others(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            tree = pickle.loads(left["tree"].iloc[0])
            for block in right["block"]:
                ids, vectors, bounds = pickle.loads(block)
                out += [(q, -i, s) for q, f in zip(ids.tolist(), search(tree, ids, vectors, bounds, k)) for s, i in f]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    far = trees.groupBy("shard", "nth").cogroup(visits.groupBy("shard", "nth")).applyInPandas(others, hit)
    ranked = near.unionByName(far).selectExpr("*", "row_number() over (partition by query_id order by score desc, vec_id) as rank")
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
