"""SimHash near-duplicate groups by anchor-point covering.

Fingerprints within 3 bits agree up to 1 bit in one of their 32-bit halves. The anchors of a half are a covering code:
the perfect Hamming code of 31 bits, times the free 32nd bit. Every half lies within 1 bit of an anchor (its home), so
two halves 1 bit apart both lie within 1 + 1 bits of the first one's home. Each fingerprint is sent to all anchors within
2 bits of either half (up to 17 each) and compared there, with those whose home the anchor is, over all 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wordloom.llm.common import discard, slices, texts, written

U32, U64 = np.uint32, np.uint64


def _sets() -> tuple[np.ndarray, np.ndarray]:
    """By syndrome: masks to flip for the anchors within 2 bits that share the free bit (padded with the last), and for home."""
    near, home = np.zeros((32, 16), U32), np.zeros(32, U32)
    bit = lambda i: U32(1 << (i - 1)) if i else U32(0)  # noqa: E731  position i of 1..31
    for s in range(1, 32):
        home[s] = bit(s)
        near[s] = [bit(s), *(bit(i) | bit(i ^ s) for i in range(1, 32) if i < i ^ s)]
    return near, home


NEAR, HOME = _sets()


def syndrome(x: np.ndarray) -> np.ndarray:
    """Which of the positions 1..31 to flip for the code word within 1 bit (0: none)."""
    out = np.zeros(len(x), np.int64)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        out |= (np.bitwise_count(x & U32(mask)).astype(np.int64) & 1) << k
    return out


def anchors(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, index into fp, whether the anchor is a home of it); the two halves' anchors differ in bit 32."""
    out = []
    for half in (0, 1):
        x = (fp >> U64(32 * half)).astype(U32)
        s = syndrome(x)
        home = x ^ HOME[s]
        near = x[:, None] ^ NEAR[s]
        first = np.zeros(near.shape, bool)
        first[:, 0] = True
        use = (s[:, None] > 0) | first  # a code word has no other anchor within 2 bits
        row = np.repeat(np.arange(len(fp)), 17)
        a = np.concatenate([near, (home ^ U32(1 << 31))[:, None]], axis=1).ravel()
        is_home = np.concatenate([first, np.zeros((len(fp), 1), bool)], axis=1).ravel()
        keep = np.concatenate([use, np.ones((len(fp), 1), bool)], axis=1).ravel()
        out.append((a[keep].astype(np.int64) | half << 32, row[keep], is_home[keep]))
    return tuple(np.concatenate(c) for c in zip(*out))


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """The hashes of a text's word shingles in order; a text of fewer words is one shingle, one without words has none."""
    got = text.encode().lower().split()
    digest = xxhash.xxh64_intdigest
    if len(got) <= words:
        return np.array([digest(b" ".join(got), 42)] if got else [], "<u8")
    joined = b" ".join(got)
    ends = np.cumsum(np.fromiter(map(len, got), np.int64, len(got)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.array([digest(joined[a:b], 42) for a, b in zip(starts[: len(got) - words + 1].tolist(), ends[words - 1 :].tolist())], "<u8")


def fingerprint(text: str, words: int = 3) -> int:
    """The fingerprint of a text by its word shingles."""
    return majority(shingle_hashes(text, words))


def majority(h: np.ndarray) -> int:
    """Bit k is set if it is set in over half of the hashes; without hashes: 0."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 16):
        part = h[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp long) for each row; a null text counts as empty. No shuffle."""
    return _fingerprints(texts(df, id_col, text_col), words)


def _fingerprints(src: DataFrame, words: int) -> DataFrame:
    """src: (id, text, further columns); the text becomes fp."""

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], U64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64)), *b.columns[2:]], names)

    names = ["id", "fp", *src.columns[2:]]
    return src.mapInArrow(run, ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, [src.schema["id"], T.StructField("fp", T.LongType()), *src.schema.fields[2:]])))


def forest(rows: list[tuple[np.ndarray, np.ndarray]], n: int) -> np.ndarray:
    """The least member that each of n items reaches over links (i, j)."""
    label = np.arange(n)
    i, j = (np.concatenate(c) for c in zip(*rows)) if rows else (np.zeros(0, int),) * 2
    while len(i):
        least = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, least)
        np.minimum.at(label, j, least)
        label = label[label]
        if np.array_equal(before, label):
            break
    return label


def group_links(fp: np.ndarray, run: np.ndarray, home: np.ndarray, bits: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by anchor (run), homes first: links (row, least row reached in its run), enough to connect them all."""
    starts = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
    sizes = np.diff(np.append(starts, len(run)))
    rows, small = [], np.repeat(np.where(sizes <= 64, sizes, 0), sizes)
    at = np.arange(len(run)) - np.repeat(starts, sizes)
    for step in range(1, int(small.max(initial=0))):
        i = np.flatnonzero(home & (at + step < small))
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= bits]
        rows.append((i, i + step))
    for a, size in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist()):
        homes, part = int(home[a : a + size].sum()), fp[a : a + size]
        label = np.arange(size)
        for h in range(0, homes, block):
            for v in range(0, size, block):
                i, j = np.nonzero(np.bitwise_count(part[h : min(h + block, homes), None] ^ part[None, v : v + block]) <= bits)
                if len(i):
                    i, j = label[i + h], label[j + v]
                    pair = np.unique(np.minimum(i, j) * size + np.maximum(i, j))
                    label = forest([(pair // size, pair % size)], size)[label]
        k = np.flatnonzero(label != np.arange(size))
        rows.append((a + label[k], a + k))
    label = forest(rows, len(run))
    k = np.flatnonzero(label != np.arange(len(run)))
    return k, label[k]


def links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): pairs of fingerprints that connect all of distinct (a column fp) that lie within so many bits; at most one
    pair for each fingerprint and anchor. Sorted runs of an anchor stream through a task; it keeps the eight-byte
    fingerprints of one anchor at a time, which lie within 2 bits of each other's anchor in one half."""
    if bits > 3:
        raise ValueError("the anchors cover up to 3 bits")

    def spread(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(U64)
            for i in range(0, len(fp), 1 << 15):
                part = fp[i : i + (1 << 15)]
                a, row, home = anchors(part)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(~home), pa.array(part[row].view(np.int64))], ["anchor", "visits", "fp"])

    def meet(batches):
        held = [np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, U64)]

        def out(anchor, visits, fp):
            k, to = group_links(fp, anchor, ~visits, bits)
            return pa.RecordBatch.from_arrays([pa.array(fp[k].view(np.int64)), pa.array(fp[to].view(np.int64))], ["a", "b"])

        waiting = []
        for b in batches:
            waiting.append([b.column(0).to_numpy(), b.column(1).to_numpy(zero_copy_only=False), b.column(2).to_numpy().view(U64)])
            if sum(len(w[0]) for w in waiting) < 1 << 17 and b.num_rows:
                continue
            held = [np.concatenate(c) for c in zip(held, *waiting)]
            waiting = []
            if len(held[0]):
                cut = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on
                if cut:
                    yield out(*(c[:cut] for c in held))
                    held = [c[cut:] for c in held]
        held = [np.concatenate(c) for c in zip(held, *waiting)]
        if len(held[0]):
            yield out(*held)

    sent = distinct.select("fp").mapInArrow(spread, "anchor long, visits boolean, fp long")
    return sent.repartition("anchor").sortWithinPartitions("anchor", "visits", "fp").mapInArrow(meet, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the edges (a, b) reaches, itself included.

    Alternates large-star and small-star steps until the edges stay as they are. Each round is written to the shared
    folder, so the plan stays short and a lost executor costs one round at most.
    """
    current, before = written(edges.filter("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), "edges"), None
    while True:
        size = current.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if size.n == 0 or before == (size.n, size.h):
            break
        before, last = (size.n, size.h), current
        both = current.unionByName(current.selectExpr("b as a", "a as b"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").selectExpr("b as a", "m as b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").filter("b <> m").selectExpr("b as a", "m as b").unionByName(least.selectExpr("a", "m as b"))
        current = written(small.distinct(), "edges")
        discard(last)
    return current.selectExpr("a as node", "b as root")


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """One row (id, fingerprint: 16 hex digits, component_id: the least id reachable) for each row of df.

    Null and empty texts share the fingerprint zero and are linked like any other. Repeated rows give a row each. Rows
    with a null id get a row with a null id; a group of such rows alone has a null component. An empty table gives none.
    Equal fingerprints are one node of the graph, so a group of copies of any size costs a count before the shuffle.
    """
    marked = written(fingerprints(df, id_col, text_col, words), "fingerprints")
    nodes = written(marked.groupBy("fp").agg(F.min("id").alias("least_id"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes, bits))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least_id", "n", F.coalesce("root", "fp").alias("root"))
    placed = written(placed, "placed")
    names = placed.groupBy("root").agg(F.min("least_id").alias("component_id")).join(placed, "root").select("fp", "component_id", "n")
    # Fingerprints of a thousandth of all rows or more, a thousand at most, are broadcast: their rows stay where they are.
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = names.filter(F.col("n") * 1000 >= total).select("fp", F.col("component_id").alias("_c"), F.lit(True).alias("_often"))
    at = marked.join(F.broadcast(often), "fp", "left")
    rest = at.filter("_often is null").select("id", "fp").join(names.select("fp", "component_id"), "fp")
    all_ = at.filter("_often").select("id", "fp", F.col("_c").alias("component_id")).unionByName(rest)
    return all_.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def row_hashes(df: DataFrame) -> list:
    """Two hashes of a row (h1, h2) that tell rows apart, nulls by their columns too; rows that share both are equal. Spark hashes no
    maps, so columns that hold some are hashed as JSON: maps of equal entries in another order count as different."""
    plain = lambda f: F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`")
    parts = [c for f in df.schema.fields for c in (F.col(f"`{f.name}`").isNull(), plain(f))]
    return [F.xxhash64(*parts).alias("h1"), F.xxhash64(F.lit(1), *parts).alias("h2")]


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, bits: int = 3) -> DataFrame:
    """df with one row of each group, the one with the least id (of rows with equal ids the one of least hash); its own columns. Rows
    with a null id come last, so they stay only where a whole group has none; each such group keeps one. Rows are told
    apart by two hashes of all their columns: neither a null id nor one id of many texts makes rows one."""
    h1, h2 = row_hashes(df)
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), h1, h2)
    marked = written(_fingerprints(src, words), "fingerprints")
    least = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "h1", "h2")).alias("least")
    nodes = written(marked.groupBy("fp").agg(least), "nodes")
    roots = components(links(nodes, bits))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("root"), "least")
    kept = written(placed.groupBy("root").agg(F.min("least").alias("least")).select("least.h1", "least.h2"), "kept")
    return rows_of(df, kept)


def rows_of(df: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of df whose hashes are in kept (h1, h2), each once. The row is one column meanwhile, so no name can clash."""
    one = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *row_hashes(df))
    return one.join(kept, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]).select("row.*")
