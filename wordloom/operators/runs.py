"""Runs of neighbouring words, counted in their task as numbers and dealt out in packed blocks.

Nearly all longer runs of a corpus differ, so a sum before the shuffle finds little to add up, and a row for each place takes many times
the room of the text. A task therefore sorts its places, and what it sends to a part is one row: the words that the part's
places hold, once each, and the places as columns of small numbers, compressed. Parts are dealt by the first two words, so all
runs that begin with these meet in one part, where blocks are unpacked and summed, one part at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from wordloom.functions import text as tx

#: A task packs the places of so many bytes of words at once, and sends so many counted runs at once.
HELD, AT_ONCE = 1 << 25, 1 << 16
ZSTD = pa.Codec("zstd", compression_level=3)
#: Runs are dealt to so many parts at least, by their first two words, which are mixed by odd numbers.
PARTS, MIX = 256, (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def summed(columns: list[np.ndarray], counts: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows of non-negative numbers, given as columns, in order, equal ones once with the sum of their counts."""
    keys, room = [], 0
    for c in columns:
        bits = int(c.max(initial=0)).bit_length()
        if keys and room + bits < 64:
            keys[-1] = keys[-1] << bits | c
        else:
            keys, room = [*keys, c.astype(np.int64)], 0
        room += bits
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for key in keys:
        new[1:] |= np.diff(key[order]) != 0
    first = np.flatnonzero(new)
    return [c[order[first]] for c in columns], np.add.reduceat(counts[order], first) if len(first) else counts[:0]


def planes(numbers: np.ndarray) -> bytes:
    """Four-byte numbers, all first bytes before all second ones, so that empty bytes lie together."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def pack(words: pa.Array, columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Words and sorted rows: numbers of words from 1, 0 for none, and how often the row occurs."""
    at = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    first = np.diff(columns[0], prepend=0)
    data = words.buffers()[2]
    return ZSTD.compress(b"".join([*map(planes, [np.diff(at), first, *columns[1:], counts]), data[at[0] : at[-1]].to_pybytes() if data else b""]), asbytes=True)


def unpack(block: pa.Buffer, size: int, n_words: int, n_rows: int, most: int) -> tuple[pa.Array, list[np.ndarray], np.ndarray]:
    raw, at, parts = ZSTD.decompress(block, size), 0, []
    for n in (n_words, *[n_rows] * (most + 1)):
        parts.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, -1).T).view("<i4").ravel())
        at += 4 * n
    ends = np.cumsum([0, *parts[0]], dtype=np.int32)
    return pa.StringArray.from_buffers(n_words, pa.py_buffer(ends), raw.slice(at)), [np.cumsum(parts[1], dtype=np.int32), *parts[2:-1]], parts[-1]


def blocks(lists: list[pa.Array], least: int, most: int, parts: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """(part, bytes, words, rows, block) of all places of the lists of words at which so many words begin."""
    words = pa.chunked_array([x.flatten() for x in lists]).dictionary_encode()
    if not len(words):
        return
    codes, names = np.concatenate([c.indices.to_numpy() for c in words.chunks]), words.chunk(0).dictionary
    sizes = np.concatenate([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in lists])
    # Frequent words get small numbers, those of about one frequency in the order of their letters: both packs well.
    by_letters = pc.sort_indices(names).to_numpy()
    often = by_letters[np.argsort(-(np.log2(np.bincount(codes, minlength=len(names)))[by_letters] // 3).astype(np.int8), kind="stable")]
    rank = np.empty(len(names), dtype=np.int32)
    rank[often] = np.arange(1, len(names) + 1)
    names = names.take(pa.array(often))
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # words from a place to its list's end
    padded = np.concatenate([rank[codes], np.zeros(most, dtype=np.int32)])
    kept = left >= least
    columns = [np.where(left > k, padded[k : k + len(codes)], 0)[kept] for k in range(most)]
    if not len(columns[0]):
        return
    sums = np.array([0, *map(crc32, names.cast("binary").to_pylist())], dtype=np.uint64)
    mixed = sum(sums[c] * np.uint64(by) for c, by in zip(columns[:least], MIX))
    part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
    (part, *columns), counts = summed([part, *columns], np.ones(len(part), dtype=np.int64))
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
    for a, b in zip(cuts, cuts[1:]):
        own = [c[a:b] for c in columns]
        used = np.zeros(len(names) + 1, dtype=bool)
        for c in own:
            used[c] = True
        used[0] = False
        ids = np.flatnonzero(used)
        number = np.cumsum(used)
        number[0] = 0
        some = names.take(pa.array(ids - 1))
        yield int(part[a]), 4 * (len(ids) + (most + 1) * (b - a)) + pc.sum(pc.binary_length(some)).as_py(), len(ids), b - a, pack(some, [number[c] * (c > 0) for c in own], counts[a:b])


def counted(packed: list[tuple[pa.Array, list[np.ndarray], np.ndarray]], least: int, most: int) -> Iterator[pa.RecordBatch]:
    """Batches of (phrase, size, n) of unpacked blocks of one part."""
    words = pa.chunked_array([w for w, _, _ in packed]).dictionary_encode()
    names, new = words.chunk(0).dictionary, [np.concatenate([[0], c.indices.to_numpy() + 1]).astype(np.int32) for c in words.chunks]
    columns, counts = summed([np.concatenate([m[c[k]] for m, (_, c, _) in zip(new, packed)]) for k in range(most)], np.concatenate([n for *_, n in packed], dtype=np.int64))
    changed = np.zeros((most, len(counts)), dtype=bool)
    changed[:, :1] = True
    for k, c in enumerate(columns):
        changed[k, 1:] = changed[k - 1, 1:] | (np.diff(c) != 0) if k else np.diff(c) != 0
    found = []
    for k in range(least, most + 1):
        first = np.flatnonzero(changed[k - 1])
        full = columns[k - 1][first] > 0
        found.append((first[full], np.add.reduceat(counts, first)[full]))
    for i in range(0, len(counts), AT_ONCE):
        # Runs of a place lie together, shorter ones first, which files keep in less room.
        cut = [slice(*np.searchsorted(first, [i, i + AT_ONCE])) for first, _ in found]
        at = [first[x] for x, (first, _) in zip(cut, found)]
        order = pa.array(np.argsort(np.concatenate(at), kind="stable"))
        phrases = pa.chunked_array([pc.binary_join_element_wise(*(names.take(pa.array(c[x] - 1)) for c in columns[:k]), "_") for k, x in enumerate(at, least)])
        size, n = np.repeat(np.arange(least, most + 1, dtype=np.int32), [*map(len, at)]), np.concatenate([n[x] for x, (_, n) in zip(cut, found)])
        if len(order):
            yield pa.record_batch([phrases.combine_chunks().take(order), pa.array(size).take(order), pa.array(n).take(order)], ["phrase", "size", "n"])


def spans_of_texts(texts: DataFrame, letter: str, least: int, most: int) -> DataFrame:
    """(phrase, size, n): runs of least to most neighbours among the words, runs of letters (a class body without _), of the texts t."""
    parts = max(PARTS, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held: list[pa.Array]) -> Iterator[pa.RecordBatch]:
            for row in blocks(held, least, most, parts):
                yield pa.record_batch([pa.array([x]) for x in row], ["part", "bytes", "words", "rows", "block"])

        held, size = [], 0
        for b in batches:
            for x in tx.cut_words(b.column(0), letter):
                if held and size + x.nbytes > HELD:
                    yield from rows(held)
                    held, size = [], 0
                held.append(x)
                size += x.nbytes
        if held:
            yield from rows(held)

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = None, []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns[:4]]
            for p, size, n_words, n_rows, block in zip(*columns, b.column(4)):
                if p != part and held:
                    yield from counted(held, least, most)
                    held = []
                part = p
                held.append(unpack(block.as_buffer(), size, n_words, n_rows, most))
        if held:
            yield from counted(held, least, most)

    packed = texts.select("t").mapInArrow(dealt, "part long, bytes long, words long, rows long, block binary")
    return packed.repartition("part").sortWithinPartitions("part").mapInArrow(met, "phrase string, size int, n long")
