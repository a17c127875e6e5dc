"""Near-duplicates by word shingles: SimHash groups, completed to all pairs of a Jaccard similarity.

Texts at a similarity of 0.8 differ in about 10 of 64 SimHash bits, some in 18; parts of a fingerprint that cover such a
distance are too short to tell texts apart. So groups by fingerprints (anchors, as in simhash) are candidates, and so are
texts that share all four least hashes of one of 32 bands (at 0.8 a pair shares none with probability (1 - 0.8^4)^32, 5
in 10^8). Candidates lie in buckets, and each link is checked on the whole sets.

First the members of each bucket are compared with one of them, the hub, which lies in the largest buckets (a text with
many near copies does), so many copies of one text cost a comparison each. Buckets whose members are all linked are done.
In the others, members that are not linked yet are compared by sketches of 512 more least hashes inside a task, and only
pairs whose sketches agree enough (0.8 less four standard deviations) are checked. Large buckets are dealt to tasks in
blocks of members, so no task holds more than two blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import discard, lists, slices, written
from wordloom.llm.simhash import components, links, majority, row_hashes, rows_of, shingle_hashes

BANDS, ROWS = 32, 4
_RANDOM = np.random.default_rng(9).integers(0, 2**64, (2, BANDS * ROWS, 1), dtype=np.uint64)
FLIP, FACTOR = _RANDOM[0], _RANDOM[1] | np.uint64(1)
NUMBER = np.arange(BANDS, dtype=np.uint64)[:, None]
#: Hashes of a sketch, of which a byte each is kept, and members of a bucket that meet in a task.
SKETCH, BLOCK = 512, 4096
_SKETCH = np.random.default_rng(10).integers(0, 2**64, (2, SKETCH, 1), dtype=np.uint64)


def bands(shingles: np.ndarray) -> np.ndarray:
    """One number for each band: a hash of its four least hashes (of zeros without shingles)."""
    least = np.zeros(BANDS * ROWS, np.uint64) if not len(shingles) else np.min([((shingles[i : i + 4096][None, :] ^ FLIP) * FACTOR).min(axis=1) for i in range(0, len(shingles), 4096)], axis=0)
    rows = np.concatenate([NUMBER, least.reshape(BANDS, ROWS)], axis=1).astype("<u8")
    return np.array([xxhash.xxh64_intdigest(r.tobytes()) for r in rows], np.uint64).view(np.int64)


def marks(src: DataFrame, words: int) -> DataFrame:
    """(id, h1, h2, node, n, fp, bands) for each row of src (id, text, h1, h2); node: a hash of the set of its n shingles."""

    def run(batches):
        for b in slices(batches):
            hashes = [shingle_hashes(t, words) for t in b.column(1).to_pylist()]
            fp = np.array([majority(h) for h in hashes], np.uint64).view(np.int64)
            sets = [np.unique(h) for h in hashes]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
            own = [pa.array(node), pa.array([len(s) for s in sets], pa.int64()), pa.array(fp), lists([bands(s) for s in sets], pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), *own], ["id", "h1", "h2", "node", "n", "fp", "bands"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, h1 long, h2 long, node long, n long, fp long, bands array<long>")


def sketch(shingles: np.ndarray) -> bytes:
    """A byte of each least hash; two sets agree in a share of them that is their similarity (and a 256th by chance)."""
    if not len(shingles):
        return bytes(SKETCH)
    flip, factor = _SKETCH[0], _SKETCH[1] | np.uint64(1)
    least = np.min([((shingles[i : i + 1024][None, :] ^ flip) * factor).min(axis=1) for i in range(0, len(shingles), 1024)], axis=0)
    return ((least * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(56)).astype(np.uint8).tobytes()


def sets_of(src: DataFrame, words: int) -> DataFrame:
    """(node, shingles array<long>, sketch) of rows (node, text), one row for each node."""

    def run(batches):
        for b in slices(batches):
            sets = [np.unique(shingle_hashes(t, words)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), lists([s.view(np.int64) for s in sets], pa.int64()), pa.array([sketch(s) for s in sets], pa.binary())], ["node", "shingles", "sketch"])

    return src.mapInArrow(run, "node long, shingles array<long>, sketch binary").dropDuplicates(["node"])


def bucketed(nodes: DataFrame, bits: int) -> DataFrame:
    """nodes (node, fp, bands, ...) with their buckets: the bands, and last the group that anchors link the fingerprint to."""
    groups = components(links(nodes.select("fp").distinct(), bits)).select(F.col("node").alias("fp"), F.col("root").alias("_g"))
    group = F.xxhash64(F.lit("fingerprints"), F.coalesce("_g", "fp"))
    return nodes.join(groups, "fp", "left").withColumn("buckets", F.concat("bands", F.array(group))).drop("_g", "bands")


def shared(entries: DataFrame) -> DataFrame:
    """Those of (bucket, node) whose bucket holds another node, with its size."""
    several = entries.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    return entries.join(several, "bucket")


def agreeing(members: DataFrame, percent: int, size: int = BLOCK) -> DataFrame:
    """(a, b): pairs of different roots in a bucket whose sizes and sketches let them be so similar, each pair in the first
    bucket that both are in. members: (bucket, size, node, root, n, sketch, buckets)."""
    share = percent / 100
    least = SKETCH * (share - 4 * (share * (1 - share) / SKETCH) ** 0.5)

    def pairs(bucket, lo, hi, block, node, root, n, sk, buckets):
        first, second = (np.arange(len(node)),) * 2 if lo == hi else (np.flatnonzero(block == lo), np.flatnonzero(block == hi))
        for i in range(0, len(first), 64):
            p = first[i : i + 64]
            may = (root[p][:, None] != root[second]) & (percent * np.maximum(n[p][:, None], n[second]) <= 100 * np.minimum(n[p][:, None], n[second]))
            if lo == hi:
                may &= p[:, None] < second
            x, y = np.nonzero(may)
            for k in range(0, len(x), 8192):
                a, b = p[x[k : k + 8192]], second[y[k : k + 8192]]
                ok = np.count_nonzero(sk[a] == sk[b], axis=1) >= least
                a, b = a[ok], b[ok]
                same = buckets[a] == buckets[b]
                ok = buckets[a, same.argmax(axis=1)] == bucket if len(a) else np.zeros(0, bool)
                yield node[a[ok]], node[b[ok]]

    def run(batches):
        held = None
        for batch in _with_end(batches):
            if batch is not None:
                if not batch.num_rows:
                    continue
                c = {name: batch.column(k) for k, name in enumerate(batch.schema.names)}
                now = {name: c[name].to_numpy() for name in ("bucket", "lo", "hi", "block", "node", "root", "n")}
                now["sketch"] = np.frombuffer(b"".join(c["sketch"].to_pylist()), np.uint8).reshape(-1, SKETCH)
                now["buckets"] = c["buckets"].flatten().to_numpy().reshape(-1, BANDS + 1)
                held = now if held is None else {k: np.concatenate([held[k], now[k]]) for k in now}
            if held is None:
                continue
            new = np.flatnonzero((np.diff(held["bucket"]) != 0) | (np.diff(held["lo"]) != 0) | (np.diff(held["hi"]) != 0)) + 1
            ends = [*new.tolist(), *([len(held["bucket"])] if batch is None else [])]
            out, at = [], 0
            for end in ends:
                g = {k: v[at:end] for k, v in held.items()}
                out += pairs(g["bucket"][0], g["lo"][0], g["hi"][0], g["block"], g["node"], g["root"], g["n"], g["sketch"], g["buckets"])
                at = end
            held = {k: v[at:] for k, v in held.items()}
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["a", "b"])

    blocks = F.ceil(F.col("size") / size)
    own = F.pmod(F.xxhash64("node"), blocks)
    dealt = members.withColumn("block", own).select("*", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("_j"))
    dealt = dealt.select("bucket", F.least("block", "_j").alias("lo"), F.greatest("block", "_j").alias("hi"), "block", "node", "root", "n", "sketch", "buckets")
    return dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").mapInArrow(run, "a long, b long")


def _with_end(batches):
    yield from batches
    yield None


def compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets (node, shingles) are so similar."""
    left, right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    close = (100 + percent) * F.size(F.array_intersect("x", "y")) >= percent * (F.size("x") + F.size("y"))
    return pairs.join(left, "a").join(right, "b").filter(close).select("a", "b")


def joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """labels (node, root) after the links (a, b) between nodes."""
    at = lambda c: labels.select(F.col("node").alias(c), F.col("root").alias(f"_{c}"))
    between = written(found.join(at("a"), "a").join(at("b"), "b").filter("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "links")
    if not between.take(1):
        return labels
    step = components(between).select(F.col("node").alias("root"), F.col("root").alias("_root"))
    return written(labels.join(step, "root", "left").select("node", F.coalesce("_root", "root").alias("root")), "labels")


def labelled(entries: DataFrame, sets: DataFrame, percent: int, size: int = BLOCK) -> DataFrame:
    """(node, root): the least node that each node of the buckets (bucket, node, size) reaches over links between nodes
    whose sets are so similar. sets: (node, shingles, sketch, n, buckets)."""
    labels = entries.select("node").distinct().withColumn("root", F.col("node"))
    weight = entries.groupBy("node").agg(F.sum("size").alias("weight"))
    hubs = entries.join(weight, "node").groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("b"))
    asked = entries.select("bucket", F.col("node").alias("a")).join(hubs, "bucket").filter("a <> b").select("a", "b").distinct()
    labels = joined(written(labels, "labels"), compared(asked, sets, percent))
    open_ = entries.join(labels, "node").groupBy("bucket").agg(F.min("root").alias("_a"), F.max("root").alias("_b")).filter("_a < _b").select("bucket")
    members = entries.join(open_, "bucket").join(labels, "node").join(sets.select("node", F.size("shingles").cast("long").alias("n"), "sketch", "buckets"), "node")
    return joined(labels, compared(agreeing(members, percent, size), sets, percent))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, bits: int = 3, size: int = BLOCK) -> DataFrame:
    """df with one row of each group of texts linked by so many percent of shared shingles, the one with the least id (ids
    that are null come last; of rows with equal ids the one of least hash); its own columns. Null texts are empty; texts
    without words are one group. Repeated rows are copies. An empty table gives none. size: members of a bucket in a block."""
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *row_hashes(df))
    marked = written(marks(src, words), "marks")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2")).alias("least")
    first = written(marked.groupBy("node").agg(least, F.min("fp").alias("fp"), F.first("bands").alias("bands")), "nodes")
    nodes = written(bucketed(first, bits), "nodes")
    discard(marked, first)
    entries = written(shared(nodes.select(F.explode("buckets").alias("bucket"), "node")), "entries")
    wanted = nodes.join(entries.select("node").distinct(), "node", "left_semi").select("node", "buckets", F.col("least.h1").alias("h1"), F.col("least.h2").alias("h2"))
    sets = sets_of(src.select("text", "h1", "h2").join(wanted, ["h1", "h2"]).select("node", "text"), words).join(wanted.select("node", "buckets"), "node")
    sets = written(sets, "sets")
    labels = labelled(entries, sets, percent, size)
    kept = nodes.select("node", "least").join(labels, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("least").alias("least"))
    kept = written(kept.select("least.h1", "least.h2"), "kept")
    discard(nodes, entries, sets, labels)
    return rows_of(df, kept)
