"""Order-preserving packing of token ids into sequences of at most a window's length.

The ids of a partition's documents form one stream. A sequence is what lies between two cuts. Cuts at document ends
cost nothing, cuts at sentence ends a little, others more; a sequence costs its padding. Over the possible cuts
p1 < p2 < ..., best(p) = cost(p) + min over q in [p - window, p) of best(q) + window - (p - q). Since best(q) + q does
not depend on p, a monotone queue holds the minimum of the sliding range, and the whole is linear in the cuts. A sequence
whose length is a power of two is not padded; the few cuts that lie such a distance before p are tried besides.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import slices, texts
from wordloom.llm.tokens import word_tokenizer

#: Ids that a task holds before it chooses cuts; the last two windows of them wait for what follows.
HOLD = 1 << 20


@dataclass(frozen=True)
class Costs:
    """In padding tokens: what a cut inside a document costs, at a sentence end or elsewhere."""

    window: int = 4096
    sentence: int = 24
    elsewhere: int = 400
    #: What a sequence costs that is not padded since its length is a smaller power of two: without it, such short ones
    #: would take the place of full ones.
    short: int = 16
    #: Where no other cut is possible, the stream may be cut after each so many ids.
    grid: int = 256


def choose(places: np.ndarray, costs: np.ndarray, window: int, short: int) -> np.ndarray:
    """The cheapest cuts of [0, places[-1]]; neighbouring places lie at most a window apart, and the last is a cut."""
    place, cost = [0, *places.tolist()], [0, *costs.tolist()]
    best, came = [0] * len(place), [0] * len(place)
    at, unpadded = np.array(place), {}
    for size in (1 << j for j in range((window - 1).bit_length())):
        before = np.searchsorted(at, at - size)
        for k in np.flatnonzero(at[before] == at - size).tolist():
            unpadded.setdefault(k, []).append(int(before[k]))
    queue: deque[tuple[int, int]] = deque()
    for k in range(1, len(place)):
        prior = best[k - 1] + place[k - 1]
        while queue and queue[-1][0] >= prior:
            queue.pop()
        queue.append((prior, k - 1))
        here = place[k]
        while place[queue[0][1]] < here - window:
            queue.popleft()
        least, came[k] = queue[0]
        least += window - here
        for q in unpadded.get(k, ()):
            if best[q] + short < least:
                least, came[k] = best[q] + short, q
        best[k] = least + cost[k]
    cuts, k = [], len(place) - 1
    while k:
        cuts.append(place[k])
        k = came[k]
    return np.array(cuts[::-1], np.int64)


def possible(ids: np.ndarray, doc_ends: np.ndarray, ends_sentence: np.ndarray, c: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Places where the stream may be cut, ascending, with their costs; the stream's end is one, at no cost."""
    n = len(ids)
    cost = np.full(n + 1, -1, np.int32)
    cost[c.grid :: c.grid] = c.elsewhere
    cost[np.flatnonzero(ends_sentence[ids]) + 1] = c.sentence
    cost[doc_ends] = 0
    cost[n], cost[0] = 0, -1
    places = np.flatnonzero(cost >= 0)
    return places, cost[places]


class Stream:
    """Packs the documents of one partition as they come; holds about HOLD ids and one document at most."""

    def __init__(self, ends_sentence: np.ndarray, costs: Costs, first_sequence: int):
        self.ends_sentence, self.costs, self.sequence = ends_sentence, costs, first_sequence
        self.docs: list[tuple] = []  # (document id, ids, ids of it before these, all its ids)
        self.held = 0

    def add(self, doc_id, ids: np.ndarray):
        self.docs.append((doc_id, ids, 0, len(ids)))
        self.held += len(ids)
        if self.held >= HOLD:
            yield from self.cut(last=False)

    def cut(self, last: bool):
        """Pieces (document id, start, ids, ids of the document, sequence, offset) of the sequences that are certain."""
        if not self.docs:
            return
        flat = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        cuts = choose(*possible(flat, ends, self.ends_sentence, self.costs), self.costs.window, self.costs.short)
        if not last:
            cuts = cuts[cuts <= len(flat) - 2 * self.costs.window]
        done, at, k, rest = 0, 0, 0, []
        for end in cuts.tolist():
            start = done
            while done < end:
                doc_id, ids, before, total = self.docs[k]
                first = done - at
                n = min(len(ids) - first, end - done)
                yield doc_id, before + first, ids[first : first + n], total, self.sequence, done - start
                done += n
                if first + n == len(ids):
                    at, k = at + len(ids), k + 1
            self.sequence += 1
        if k < len(self.docs):
            doc_id, ids, before, total = self.docs[k]
            rest = [(doc_id, ids[done - at :], before + done - at, total), *self.docs[k + 1 :]]
        self.docs, self.held = rest, len(flat) - done


def pack(df: DataFrame, path: str, end_id: int = 2, costs: Costs = Costs(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, start, length, ids (binary: little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Documents keep the order in which their partition holds them; a sequence's documents are neighbours there, so
    nothing is shuffled. sequence_id is the partition's number times 2^32 plus the sequence's number in it. Each
    document ends with end_id, so a null or empty text is one piece of one id. Null ids stay null, repeated rows are
    packed each, an empty table gives none.
    """
    names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    src = texts(df, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()

    def run(batches):
        tok = word_tokenizer(path)
        stream = Stream(tok.ends_sentence, costs, TaskContext.get().partitionId() << 32)
        tail, id_type = np.array([end_id], "<u4").tobytes(), None

        def rows(pieces):
            d, start, ids, total, seq, off = zip(*pieces)
            cols = [pa.array(d, id_type), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
            return pa.RecordBatch.from_arrays([*cols, *(pa.array(x, pa.int64()) for x in (total, seq, off))], names)

        for b in slices(batches):
            id_type = b.schema.field(0).type
            flat, lengths = tok.encode_all(b.column(1), tail)
            for doc_id, ids in zip(b.column(0).to_pylist(), np.split(flat, np.cumsum(lengths)[:-1])):
                if pieces := list(stream.add(doc_id, ids)):
                    yield rows(pieces)
        if pieces := list(stream.cut(last=True)):
            yield rows(pieces)

    out = src.mapInArrow(run, f"id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.select(F.col("id").alias(id_col), *names[1:])
