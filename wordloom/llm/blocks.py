"""Token ids in patched frame-of-reference blocks.

A segment holds the ids of consecutive documents: a header, the documents' ids and lengths, an index of block starts,
and blocks of 128 ids. A block subtracts its minimum, packs the differences at the width that a chosen percentile of
them needs, and lists the others as exceptions (position and full difference).

    segment  := magic "PFB1" | docs u32 | tokens u64 | block size u32 | doc id i64 * docs | tokens u32 * docs
              | block start u32 * (blocks + 1) | block * blocks
    block    := minimum u32 | width u8 | exceptions u8 | packed width * size / 8 bytes | position u8 * n | difference u32 * n

Segments are rows of a table that Spark's own writer stores, so any store that Spark reaches will do and a lost
executor's task is simply run again.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import slices, texts, written
from wordloom.llm.tokens import word_tokenizer

MAGIC, SIZE, HEAD = b"PFB1", 128, struct.Struct("<4sIQI")
#: Ids in a segment, about: a document is never split, so a long one has a segment that is longer.
SEGMENT = 1 << 20


def pack(ids: np.ndarray, percentile: float = 90.0) -> tuple[np.ndarray, bytes]:
    """Block starts (one more than blocks) and the blocks' bytes."""
    blocks = -(-len(ids) // SIZE)
    if not blocks:
        return np.zeros(1, "<u4"), b""
    full = np.full(blocks * SIZE, ids[-1], np.uint32)
    full[: len(ids)] = ids
    rows = full.reshape(blocks, SIZE)
    least = rows.min(axis=1)
    diff = rows - least[:, None]
    cut = np.partition(diff, int((SIZE - 1) * percentile / 100), axis=1)[:, int((SIZE - 1) * percentile / 100)]
    width = np.frompyfunc(int.bit_length, 1, 1)(cut.astype(object)).astype(np.int64)
    over = (diff.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    n_over = over.sum(axis=1)
    starts = np.zeros(blocks + 1, np.int64)
    np.cumsum(6 + width * (SIZE // 8) + 5 * n_over, out=starts[1:])
    out = np.zeros(starts[-1], np.uint8)
    at = starts[:-1, None]
    out[at + np.arange(4)] = least.astype("<u4").view(np.uint8).reshape(-1, 4)
    out[starts[:-1] + 4], out[starts[:-1] + 5] = width, n_over
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        bits = ((diff[which][:, :, None] >> np.arange(w, dtype=np.uint32)) & 1).astype(np.uint8)
        out[at[which] + 6 + np.arange(w * SIZE // 8)] = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
    block, place = np.nonzero(over)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        base = starts[block] + 6 + width[block] * (SIZE // 8)
        out[base + nth] = place
        out[(base + n_over[block] + 4 * nth)[:, None] + np.arange(4)] = diff[block, place].astype("<u4").view(np.uint8).reshape(-1, 4)
    return starts.astype("<u4"), out.tobytes()


def unpack(starts: np.ndarray, data: np.ndarray, tokens: int) -> np.ndarray:
    """Ids of the blocks that start at the given bytes of data (all but the last of starts)."""
    starts = starts.astype(np.int64)
    blocks, at = len(starts) - 1, starts[:-1]
    if blocks <= 0:
        return np.zeros(0, np.uint32)
    least = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4").ravel()
    width, n_over = data[at + 4].astype(np.int64), data[at + 5].astype(np.int64)
    rows = np.zeros((blocks, SIZE), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        which = np.flatnonzero(width == w)
        bits = np.unpackbits(data[at[which][:, None] + 6 + np.arange(w * SIZE // 8)], axis=1, bitorder="little")
        rows[which] = bits.reshape(len(which), SIZE, w) @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    block = np.repeat(np.arange(blocks), n_over)
    if len(block):
        nth = np.arange(len(block)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        base = at[block] + 6 + width[block] * (SIZE // 8)
        values = np.ascontiguousarray(data[(base + n_over[block] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").ravel()
        rows[block, data[base + nth]] = values
    return (rows + least[:, None]).ravel()[:tokens]


def encode_segment(doc_ids: list[int], ids: list[np.ndarray], percentile: float = 90.0) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    starts, body = pack(flat, percentile)
    head = HEAD.pack(MAGIC, len(doc_ids), len(flat), SIZE)
    return head + np.array(doc_ids, "<i8").tobytes() + np.array([len(x) for x in ids], "<u4").tobytes() + starts.tobytes() + body


class Segment:
    """A segment's bytes, read by document without unpacking the blocks of others."""

    def __init__(self, data: bytes):
        magic, self.docs, self.tokens, size = HEAD.unpack_from(data)
        if magic != MAGIC or size != SIZE:
            raise ValueError("not a segment of this format")
        at = HEAD.size
        self.doc_ids = np.frombuffer(data, "<i8", self.docs, at)
        self.lengths = np.frombuffer(data, "<u4", self.docs, at + 8 * self.docs).astype(np.int64)
        at += 12 * self.docs
        blocks = -(-self.tokens // SIZE)
        self.starts = np.frombuffer(data, "<u4", blocks + 1, at)
        self.body = np.frombuffer(data, np.uint8, offset=at + 4 * (blocks + 1))
        self.first = np.cumsum(self.lengths) - self.lengths

    def all(self) -> np.ndarray:
        return unpack(self.starts, self.body, self.tokens)

    def document(self, k: int) -> np.ndarray:
        """Ids of the k-th document: only the blocks that hold them are read."""
        a, n = int(self.first[k]), int(self.lengths[k])
        if not n:
            return np.zeros(0, np.uint32)
        b0, b1 = a // SIZE, -(-(a + n) // SIZE)
        return unpack(self.starts[b0 : b1 + 1], self.body, (b1 - b0) * SIZE)[a - b0 * SIZE : a - b0 * SIZE + n]


def write_segments(df: DataFrame, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", percentile: float = 90.0) -> DataFrame:
    """Encodes all texts and writes their ids, ascending by document, as a table of segments; returns that table.

    Rows: part, seq (their order), first_doc, docs, tokens, before (ids of the same part before it), payload. Each document ends with end_id; a null or empty
    text is that id alone. Documents with a null id come first, and so do ids that are no numbers, which count as null; they
    are stored under the least long, which is read back as null. Repeated rows are stored each. Documents are sorted by
    range partitions of the id, and those of one id by a hash of their text, so that their order is always the same and no
    task holds more than its range, not even where many rows share an id; a range's documents stream through segments of
    about 2^20 ids.
    """

    def run(batches):
        tok, part, seq = word_tokenizer(path), TaskContext.get().partitionId(), 0
        tail = np.array([end_id], "<u4").tobytes()
        docs, ids, held, before = [], [], 0, 0

        def segment():
            row = [[part], [seq], [docs[0]], [len(docs)], [held], [before], [encode_segment(docs, ids, percentile)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names)

        for b in slices(batches):
            flat, lengths = tok.encode_all(b.column(1), tail)
            for d, own in zip(b.column(0).to_pylist(), np.split(flat, np.cumsum(lengths)[:-1])):
                docs.append(d)
                ids.append(own)
                held += len(ids[-1])
                if held >= SEGMENT:
                    yield segment()
                    docs, ids, held, seq, before = [], [], 0, seq + 1, before + held
        if docs:
            yield segment()

    names = ["part", "seq", "first_doc", "docs", "tokens", "before", "payload"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    src = texts(df, id_col, text_col).select(F.coalesce(F.col("id").try_cast("long"), F.lit(-(2**63))).alias("id"), "text", F.xxhash64("text").alias("h"))
    sorted_ = src.repartitionByRange("id", "h").sortWithinPartitions("id", "h")
    rows = sorted_.select("id", "text").mapInArrow(run, "part int, seq int, first_doc long, docs long, tokens long, before long, payload binary")
    return written(rows, "segments")


def read_documents(segments: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """From a table of segments, one row for each document: id, start (ids of all documents before it), n_tokens, ids_crc32.

    The ids before a segment are those of its part, which the segment knows, and those of the parts before, which the
    driver adds up: one number for each shuffle partition of the writer. An empty table gives none.
    """
    spark = segments.sparkSession
    parts = segments.groupBy("part").agg(F.sum("tokens").alias("n")).orderBy("part").collect()
    before = dict(zip([r.part for r in parts], np.cumsum([0, *(r.n for r in parts)]).tolist()))
    offsets = spark.createDataFrame(list(before.items()) or [(-1, 0)], "part int, part_start long")

    def run(batches):
        for b in batches:
            for start, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = Segment(payload)
                raw = memoryview(s.all().astype("<u4").tobytes())
                ends = (4 * np.cumsum(s.lengths)).tolist()
                crc = [zlib.crc32(raw[e - 4 * n : e]) for e, n in zip(ends, s.lengths.tolist())]
                out = [s.doc_ids, start + s.first, s.lengths, np.array(crc, np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["id", "start", "n_tokens", "ids_crc32"])

    placed = segments.select("part", "before", "payload").join(F.broadcast(offsets), "part")
    rows = placed.select((F.col("part_start") + F.col("before")).alias("start"), "payload").mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
    return rows.select(F.nullif("id", F.lit(-(2**63))).alias(id_col), "start", "n_tokens", "ids_crc32")
