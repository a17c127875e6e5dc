"""Token ids of whole texts by a vocabulary file of the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from wordloom.llm.common import taken

#: Words up to so many bytes are remembered; of so many at most the older half is forgotten.
WORD_BYTES, WORDS = 64, 500_000
#: Cut from the end of a word, these are tokens of their own after a letter.
MARKS = ",.!?;:"
#: Words that the normalizer leaves as they are and that are one piece: small letters of ASCII and Latin-1, all composed.
PLAIN = re.compile("[a-zß-öø-ÿ]+").fullmatch


def byte_characters() -> dict[int, str]:
    """The character by which byte-level vocabularies write each byte: printable ones themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(0x100 + k) for k, b in enumerate(hidden)}


class WordTokenizer:
    """For vocabularies whose tokens never cross white space (words are normalized, put in lower case and cut one by one).

    So a text's ids are its words' ids one after another. Each distinct word of a batch is looked up once, and goes
    through the library once as long as it is remembered. Words are cut at ASCII white space; other white space inside
    them is left to the library. A text that holds the string of a special token goes through the library as a whole,
    which gives that token's id there.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # a word in lower case may look like one that the text does not hold
        self.model = self.library.model
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.ends_sentence = np.zeros(max(self.library.get_vocab(with_added_tokens=True).values()) + 1, bool)
        self.ends_sentence[[i for t, i in vocab.items() if t.endswith("</w>") and t[:-4] and not t[:-4].strip(".!?")]] = True
        self.shown = byte_characters()
        self.words = pa.array([], pa.string())  # remembered, with their ids one after another and how many each has
        self.flat, self.lengths = np.zeros(0, "<u4"), np.zeros(0, np.int64)

    def ask(self, words: list[str]) -> dict[str, bytes]:
        """Plain words go to the library's model, which is what its steps before it leave of them; others take all steps."""
        cut, out, rest = self.model.tokenize, {}, []
        for w in words:
            if not PLAIN(w):
                rest.append(w)
                continue
            shown = w if w.isascii() else w.encode().decode("latin-1").translate(self.shown)
            out[w] = array("I", [t.id for t in cut(shown)]).tobytes()
        if rest:
            got = self.library.encode_batch_fast(rest, add_special_tokens=False)
            out.update((w, np.array(e.ids, "<u4").tobytes()) for w, e in zip(rest, got))
        return out

    def learn(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words that are not remembered, one after another, and how many each has. Words are remembered after it."""
        listed = words.to_pylist()
        stems = dict.fromkeys(x for w in listed for x in ((w[:-1], w[-1]) if len(w) > 1 and w[-1] in MARKS and PLAIN(w[-2]) else (w,)))
        found, ask = {}, []
        at = pc.index_in(pa.array(list(stems), pa.string()), value_set=self.words).to_pylist()
        ends = np.cumsum(self.lengths)
        for w, k in zip(stems, at):
            if k is None:
                ask.append(w)
            else:
                found[w] = self.flat[ends[k] - self.lengths[k] : ends[k]].tobytes()
        found.update(self.ask(ask))
        ids = [found[w] if w in found else found[w[:-1]] + found[w[-1]] for w in listed]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        return np.frombuffer(b"".join(ids), "<u4"), lengths

    def remember(self, words: pa.Array, flat: np.ndarray, lengths: np.ndarray) -> None:
        short = np.asarray(pc.less_equal(pc.binary_length(words), WORD_BYTES))
        if len(self.words) + len(words) > WORDS:
            half = len(self.words) // 2
            self.flat, self.words, self.lengths = self.flat[self.lengths[:half].sum() :], self.words[half:], self.lengths[half:]
        self.words = pa.concat_arrays([self.words, words.filter(pa.array(short))])
        self.flat, self.lengths = np.concatenate([self.flat, flat[np.repeat(short, lengths)]]), np.concatenate([self.lengths, lengths[short]])

    def encode_all(self, column: pa.Array, tail: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Of a column of texts: all ids one after another, and how many each text has; tail: ids at the end of each text."""
        split = pc.ascii_split_whitespace(pc.ascii_lower(column))
        sizes = np.asarray(pc.list_value_length(split), dtype=np.int64)
        marked = split.flatten().dictionary_encode()
        words, codes = marked.dictionary, np.asarray(marked.indices, dtype=np.int64)
        known = pc.index_in(words, value_set=self.words)
        missing = np.asarray(pc.is_null(known))
        new = words.filter(pa.array(missing))
        flat, lengths = self.learn(new)
        place = np.asarray(pc.fill_null(known, 0), dtype=np.int64)
        place[missing] = len(self.words) + np.arange(len(new))
        codes = place[codes]
        # Each text gets one more part, its tail; a text with special tokens has no other part than its ids and the tail.
        more = [tail, b""]
        last, nothing = np.full(len(sizes), len(self.words) + len(new)), len(self.words) + len(new) + 1
        held = np.zeros(len(column), bool)
        for s in self.special:
            held |= np.asarray(pc.match_substring(column, s))
        for k in np.flatnonzero(held).tolist():
            codes[int(sizes[:k].sum()) : int(sizes[: k + 1].sum())] = nothing
            last[k] = nothing - 1 + len(more)
            more.append(array("I", self.whole.encode(column[k].as_py(), add_special_tokens=False).ids).tobytes() + tail)
        every = np.concatenate([self.flat, flat, np.frombuffer(b"".join(more), "<u4")])
        counts = np.concatenate([self.lengths, lengths, [len(x) // 4 for x in more]])
        out = taken(every, counts, np.insert(codes, np.cumsum(sizes), last), sizes + 1)
        self.remember(new, flat, lengths)
        return out


@lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)
