"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Of all tokenizations of a byte prefix exactly one is what BPE itself gives, and it is fixed by its last token. So one
token id for each prefix is enough: last[i] is the only token that ends at byte i, starts where another valid prefix
ends, and may stand after that prefix's last token. Bytes are appended by filling in the new prefixes; an edit keeps
all prefixes before it and drops the rest.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import gathered, list_array, slices, texts

#: White space as the rank files' own library understands it (Unicode White_Space).
SPACE = r"\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Chunks up to this many characters are remembered, in two generations of so many at most.
REMEMBER_CHARS, REMEMBER = 48, 150_000
#: Pairs of tokens whose verdict is remembered, about.
PAIRS = 300_000
#: One of these after letters is a piece of its own.
MARKS = frozenset(".,!?;:")


class Vocabulary:
    """Ranks with, for each token, the two tokens that its last merge joined, and an automaton that tells byte by byte
    which tokens end at a place."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {i: b for b, i in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.pairs: dict[tuple[int, int], int] = {}
        self.whole_only: set[int] = set()
        self.sizes = [0] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self.sizes[i] = len(token)
        self.met: dict[int, bool] = {}  # left << 32 | right -> whether they may stand side by side
        for token, i in ranks.items():
            parts = merged(token, ranks, i)
            if len(token) == 1:
                self.halves[i] = (i, i)
            elif len(parts) == 2:
                self.halves[i] = (ranks[parts[0]], ranks[parts[1]])
                self.pairs[self.halves[i]] = i
            else:  # no sequence of merges reaches it; it stands only for a piece that it equals
                self.whole_only.add(i)
        self.automaton()

    def automaton(self) -> None:
        """States are beginnings of tokens; a text's state is the longest one that it ends with. ending[state] holds the
        tokens (size, id) that a text in this state ends with, longest first."""
        self.next: dict[int, int] = {}  # state << 8 | byte -> state
        self.bound = 0
        self.shorter, self.ending, parents = [0], [()], [(0, 0)]
        own: list[int] = [-1]
        for token in sorted(self.ranks, key=len):
            state = 0
            for byte in token:
                after = self.next.get(state << 8 | byte)
                if after is None:
                    after = self.next[state << 8 | byte] = len(own)
                    own.append(-1)
                    parents.append((state, byte))
                state = after
            if self.ranks[token] not in self.whole_only:
                own[state] = self.ranks[token]
        depth = [0] * len(own)
        for k in range(1, len(own)):
            depth[k] = depth[parents[k][0]] + 1
        self.shorter, self.ending = [0] * len(own), [()] * len(own)
        for k in sorted(range(1, len(own)), key=depth.__getitem__):
            up, byte = parents[k]
            self.shorter[k] = self.step(self.shorter[up], byte) if up else 0
            rest = self.ending[self.shorter[k]]
            self.ending[k] = ((depth[k], own[k]), *rest) if own[k] >= 0 else rest
        self.bound = len(self.next) + 200_000  # jumps are remembered among the edges, up to so many in all

    def step(self, state: int, byte: int) -> int:
        at = state << 8 | byte
        while (after := self.next.get(state << 8 | byte)) is None and state:
            state = self.shorter[state]
        return self.jump(at, after or 0)

    def jump(self, at: int, after: int) -> int:
        if len(self.next) < self.bound:
            self.next[at] = after
        return after

    def fill(self, data: bytes, end: int, last: list[int], states: list[int]) -> None:
        """Appends, for each prefix of data longer than `end`, its last token and its state."""
        steps, ending, met, follows, state = self.next.get, self.ending, self.met, self.follows, states[-1]
        if len(met) > PAIRS:
            met.clear()
        known = met.get
        for byte in data[end:]:
            end += 1
            if (after := steps(state << 8 | byte)) is None:
                after = self.step(state, byte)
            state = after
            for size, token in ending[state]:  # only one may stand; long ones are the likely ones
                if size == end:
                    break
                left = last[end - size]
                if (ok := known(left << 32 | token)) is None:
                    ok = met[left << 32 | token] = follows(left, token)
                if ok:
                    break
            last.append(token)
            states.append(state)

    def back(self, data: bytes, last: list[int]) -> list[int]:
        """The ids of data, from the last token of each prefix."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        out, end, sizes = [], len(data), self.sizes
        while end:
            token = last[end]
            out.append(token)
            end -= sizes[token]
        out.reverse()
        return out


    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def follows(self, left: int, right: int) -> bool:
        """Whether BPE leaves these neighbours as they are: no merge across their border comes before their own merges."""
        bound, halves, pairs = 1 << 62, self.halves, self.pairs
        while True:
            joined = pairs.get((left, right))
            if joined is not None and joined < bound:
                return False
            if left > right:
                bound, left = left, halves[left][1]
                if left != bound:
                    continue
                bound, right = right + 1, halves[right][0]
                if right + 1 == bound:
                    return True
            else:
                bound, right = right + 1, halves[right][0]
                if right + 1 != bound:
                    continue
                bound, left = left, halves[left][1]
                if left == bound:
                    return True


def merged(piece: bytes, ranks: dict[bytes, int], below: int = 1 << 62) -> list[bytes]:
    """Plain BPE: join the neighbours of least rank, leftmost first, as long as that rank is under a bound."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        rank, at = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


class Prefixes:
    """The last token of each prefix of one piece. append() and edit() give exactly what encoding anew would give."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        self.vocabulary, self.data, self.last, self.states = vocabulary, b"", [-1], [0]
        self.append(data)

    def append(self, more: bytes) -> None:
        end, self.data = len(self.data), self.data + more
        self.vocabulary.fill(self.data, end, self.last, self.states)

    def edit(self, start: int, end: int, new: bytes) -> None:
        """Replace data[start:end]; the prefixes up to start stay."""
        self.become(start, self.data[:start] + new + self.data[end:])

    def become(self, same: int, data: bytes) -> None:
        """Other data that begins with the same so many bytes."""
        del self.last[same + 1 :], self.states[same + 1 :]
        self.data = data
        self.vocabulary.fill(data, same, self.last, self.states)

    def ids(self) -> list[int]:
        return self.vocabulary.back(self.data, self.last)


class Memory:
    """A bounded map of two generations: what was not asked for in the last one is forgotten."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value


class Encoder:
    """Encodes texts: cut by the pattern, each piece by its prefixes. Chunks between single spaces are independent of
    each other; each distinct one of a batch is looked at once, and they and the pieces are remembered."""

    def __init__(self, vocabulary: Vocabulary, pattern: str):
        self.vocabulary = vocabulary
        own = pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
        self.cut_known = regex.compile(own).findall
        newer = newer_characters()
        #: Characters that are letters or digits to this pattern library alone are cut as the rank library cuts them.
        self.newer = regex.compile(f"[{''.join(newer.values())}]").search if any(newer.values()) else lambda _: None
        for kind, characters in newer.items():
            own = own.replace(kind, f"[{kind}--[{characters}]]") if characters else own
        self.cut_newer = regex.compile(own, regex.V1).findall
        self.chunks, self.pieces = Memory(REMEMBER), Memory(50_000)

    def cut(self, text: str) -> list[str]:
        return self.cut_known(text) if text.isascii() or not self.newer(text) else self.cut_newer(text)

    def run(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers, of a text that the pattern can be applied to on its own."""
        return b"".join([self.pieces.get(p) or self.piece(p) for p in self.cut(text)])

    def ids(self, piece: str) -> bytes:
        return array("i", Prefixes(self.vocabulary, piece.encode()).ids()).tobytes()

    def piece(self, piece: str) -> bytes:
        ids = self.chunks.get(piece[1:]) if piece[0] == " " and piece[1:].isalpha() else None
        if ids is None:
            ids = self.ids(piece)
        if len(piece) <= REMEMBER_CHARS:
            self.pieces.put(piece, ids)
        return ids

    def learn(self, words: list[str]) -> None:
        """Remembers words of letters. Neighbours of the sorted list begin alike, and the prefixes they share are kept."""
        state, before = Prefixes(self.vocabulary), b""
        for word in sorted(words):
            data, same = (" " + word).encode(), 0
            for a, b in zip(before, data):
                if a != b:
                    break
                same += 1
            state.become(same, data)
            before = data
            if len(word) <= REMEMBER_CHARS:
                self.chunks.put(word, array("i", state.ids()).tobytes())

    def encode_all(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of a column of texts: all ids one after another, and how many each text has. A text is cut at single spaces
        between other characters: the pattern never matches across one but at its start."""
        split = pc.split_pattern(column, " ")
        sizes = np.asarray(pc.list_value_length(split), dtype=np.int64)
        marked = split.flatten().dictionary_encode()
        words, codes = marked.dictionary.to_pylist(), np.asarray(marked.indices, dtype=np.int64)
        first = np.cumsum(sizes) - sizes
        inner = np.ones(len(codes), bool)
        inner[first] = False
        used = np.flatnonzero(np.bincount(codes[inner], minlength=len(words)))
        stems = {c[:-1] if c[-1:] in MARKS else c for c in map(words.__getitem__, used.tolist())}
        held = (self.chunks.new, self.chunks.old)
        self.learn([s for s in stems if s.isalpha() and s not in held[0] and s not in held[1]])
        table, bound = [b""] * len(words), np.zeros(len(words), bool)
        for k, ids in zip(used.tolist(), map(self.chunks.new.get, map(words.__getitem__, used.tolist()))):
            if ids is None:
                bound[k] = not (ids := self.later(words[k]))
            table[k] = ids
        head = [words[k] for k in codes[first].tolist()]
        whole = np.array([not h or h[-1].isspace() for h in head], bool)
        row = np.repeat(np.arange(len(sizes)), sizes)
        whole[row[inner & bound[codes]]] = True
        for k in np.flatnonzero(whole).tolist():
            table.append(self.encode(column[k].as_py()))
        table.append(b"")
        table += [b"" if w else self.run(h) for h, w in zip(head, whole.tolist())]
        nothing = len(table) - len(head) - 1
        codes[inner & whole[row]] = nothing
        codes[first] = np.where(whole, len(words) + np.cumsum(whole) - 1, nothing + 1 + np.arange(len(head)))
        return gathered(table, codes, sizes, "<i4")

    def later(self, chunk: str) -> bytes:
        """Of a chunk with the space before it; nothing if it is not independent of its neighbours."""
        if not chunk or chunk[0].isspace() or chunk[-1].isspace():
            return b""
        if (ids := self.chunks.get(chunk)) is None:
            if chunk.isalpha():
                ids = self.ids(" " + chunk)
            elif chunk[-1] in MARKS and chunk[:-1].isalpha():  # put together again each time
                return self.later(chunk[:-1]) + (self.pieces.get(chunk[-1]) or self.piece(chunk[-1]))
            else:
                ids = self.run(" " + chunk)
            if len(chunk) <= REMEMBER_CHARS:
                self.chunks.put(chunk, ids)
        return ids

    def encode(self, text: str) -> bytes:
        """Of a text whose chunks depend on their neighbours: those that do are cut together with them."""
        if not text:
            return b""
        first, *chunks = text.split(" ")
        joined, blank = [[first]], not first or first[-1].isspace()
        for c in chunks:
            now = not c or c[0].isspace() or c[-1].isspace()
            joined[-1].append(c) if now or blank else joined.append([c])
            blank = now
        first, *chunks = map(" ".join, joined)
        return self.run(first) + b"".join([self.later(c) or self.run(" " + c) for c in chunks])


@lru_cache(maxsize=1)
def newer_characters() -> dict[str, str]:
    """By class, the characters that the pattern library counts in and the rank library, whose tables are older, does not."""
    ranks = {bytes([i]): i for i in range(256)}
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    out = {}
    for kind in (r"\p{L}", r"\p{N}"):
        known = tiktoken.Encoding("classes", pat_str=kind, mergeable_ranks=ranks, special_tokens={}).encode_ordinary(every)
        more, ranges = sorted(map(ord, set(regex.findall(kind, every)) - set(bytes(known).decode()))), []
        for c in more:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        out[kind] = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in ranges)
    return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(Vocabulary.read(path), pattern)


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id_col, ids array<int>) for each row of df, repeated rows included.

    A null or empty text has an empty list; a null id stays null; other columns of df are not read; an empty table
    gives an empty table. No shuffle: each task encodes the texts of its own partition.
    """

    def run(batches):
        e = encoder(path, pattern)
        for b in slices(batches, 1 << 22):
            yield pa.RecordBatch.from_arrays([b.column(0), list_array(*e.encode_all(b.column(1)), pa.int32())], ["id", "ids"])

    src = texts(df, id_col, text_col)
    kind = src.schema["id"].dataType.simpleString()
    return src.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df and the bytes that its ids stand for (a null list: null)."""

    @F.arrow_udf("binary")
    def run(column: pa.Array) -> pa.Array:
        # Taking tokens lays their bytes end to end, so a row's bytes lie between the ends of its first and last token.
        table, flat = token_bytes(path), column.flatten()
        taken = table.take(flat)
        ends = np.frombuffer(taken.buffers()[1], np.int32, len(flat) + 1, taken.offset * 4)
        sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0))
        at = ends[np.cumsum([0, *sizes], dtype=np.int64)].astype(np.int32)
        nulls = column.is_null().to_numpy(zero_copy_only=False)
        valid = pa.py_buffer(np.packbits(~nulls, bitorder="little").tobytes()) if nulls.any() else None
        return pa.Array.from_buffers(pa.binary(), len(column), [valid, pa.py_buffer(at), taken.buffers()[2]])

    return df.withColumn(out_col, run(F.col(ids_col)))


@lru_cache(maxsize=2)
def token_bytes(path: str) -> pa.BinaryArray:
    """The bytes of each id; ids without a token are null."""
    with open(path, "rb") as lines:
        of = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}
    return pa.array([of.get(i) for i in range(max(of) + 1)], pa.binary())
