"""Quality rules: counts over words and lines, and compression bands.

A text is repetitive if zstandard shrinks it more than prose of its length, and incompressible if it shrinks it less.
Both limits depend on the length, since short texts shrink less. The whole text and its fixed chunks are judged.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import slices, texts

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Bands:
    """Limits of length divided by compressed length, between the given lengths along the logarithm of the length.

    Set with room to both sides of what 3,300 labelled documents of good quality show; below 64 bytes, where there are
    none, by what the frame of a compressed text alone takes. What remains after the full chunks is judged like a text of
    its length.
    """

    log2_bytes: tuple[float, ...] = (0, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 17, 20)
    most: tuple[float, ...] = (1.0, 1.5, 1.6, 1.8, 1.98, 2.12, 2.25, 2.35, 2.45, 2.55, 2.65, 2.9, 3.2)
    least: tuple[float, ...] = (0.05, 0.45, 0.6, 0.9, 1.05, 1.15, 1.3, 1.45, 1.5, 1.5, 1.5, 1.5, 1.5)
    chunk_bytes: int = 1024
    chunk_most: float = 2.6
    chunk_least: float = 1.3
    #: How much further the limits of a rest lie, since a passage varies more than a text.
    rest_room: float = 0.15
    #: Rejected if chunks with more than this share of the bytes are outside their limits.
    chunk_share: float = 0.3
    level: int = 3


def repeated_words(words: list[bytes], width: int) -> int:
    """Words inside a window of so many words that the text holds twice or more (width: a power of two).

    Windows get exact numbers by doubling: two equal halves in a row number a window of twice the width.
    """
    n = len(words)
    if n <= width:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    span = 1
    while span < width:
        pair = ids[:-span] * n + ids[span:]
        _, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if counts.max() == 1:
            return 0
        span *= 2
    twice = np.flatnonzero(counts[ids] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return int(np.count_nonzero(np.cumsum(edge[:-1])))


def counts_of(text: str, width: int = 8) -> tuple[int, ...]:
    """COUNTS of one text; words are what ASCII white space separates, lines what \\n separates."""
    words = text.encode().split()
    chars = len(text) - sum(map(text.count, BLANKS))
    seen: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup, repeated_words(words, width)


class Press:
    """Compression figures of one text under given bands."""

    def __init__(self, bands: Bands):
        self.bands, self.zip = bands, zstandard.ZstdCompressor(level=bands.level).compress

    def ratio(self, data: bytes) -> float:
        return len(data) / len(self.zip(data))

    def limits(self, size: int) -> tuple[float, float]:
        b = self.bands
        return float(np.interp(np.log2(size), b.log2_bytes, b.least)), float(np.interp(np.log2(size), b.log2_bytes, b.most))

    def judge(self, data: bytes) -> tuple[float, float, bool]:
        """Ratio of the whole text, share of its bytes in chunks outside their limits, and whether it is within the bands."""
        b, n = self.bands, len(data)
        if not data:
            return 1.0, 0.0, True
        whole, (least, most) = self.ratio(data), self.limits(n)
        full = n - n % b.chunk_bytes
        outside = sum(b.chunk_bytes for i in range(0, full, b.chunk_bytes) if not b.chunk_least <= self.ratio(data[i : i + b.chunk_bytes]) <= b.chunk_most)
        if full and n > full:
            low, high = self.limits(n - full)
            if not low - b.rest_room <= self.ratio(data[full:]) <= high + b.rest_room:
                outside += n - full
        share = outside / n if full else 0.0  # a text shorter than a chunk is judged as a whole
        return whole, share, bool(least <= whole <= most and share <= b.chunk_share)


def assess(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: Bands = Bands(), keep: bool = False) -> DataFrame:
    """One row for each row of df: id, COUNTS, base_failed, zstd_ratio, bad_chunk_share, kept. No shuffle.

    A null text has no words and fails, as does an empty one. Repeated rows are judged each. keep: df itself with its
    own columns, without the rows that are rejected; the text is judged where it lies, so no join is needed.
    """

    def columns(batch_texts: list) -> list[pa.Array]:
        press = Press(bands)
        counts = [counts_of(t or "") for t in batch_texts]
        judged = [press.judge((t or "").encode()) for t in batch_texts]
        failed = [c[0] < 20 or 100 * c[4] > 30 * c[0] for c in counts]
        out = [pa.array([c[k] for c in counts], pa.int64()) for k in range(len(COUNTS))]
        out += [pa.array(failed, pa.bool_()), pa.array([j[0] for j in judged], pa.float64()), pa.array([j[1] for j in judged], pa.float64())]
        return [*out, pa.array([not f and j[2] for f, j in zip(failed, judged)], pa.bool_())]

    names = [*COUNTS, "base_failed", "zstd_ratio", "bad_chunk_share", "kept"]
    if keep:
        at = df.columns.index(text_col)

        def sift(batches):
            for b in slices(batches):
                yield b.filter(columns(b.column(at).to_pylist())[-1])

        return df.mapInArrow(sift, df.schema)

    def run(batches):
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), *columns(b.column(1).to_pylist())], ["id", *names])

    src = texts(df, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()
    types = [*("long" for _ in COUNTS), "boolean", "double", "double", "boolean"]
    out = src.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in zip(["id", *names], [kind, *types])))
    return out.select(F.col("id").alias(id_col), *names)
