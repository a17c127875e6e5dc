"""Rule syllables: where a text in Myanmar letters may break, by the classes of neighbouring characters.

A break between two characters depends on their classes alone, or, where the table says so, on the two characters after
them as well. So all breaks of some texts are looked up at once, from their bytes, without a string for each character.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes by code point ranges (others are X), and what stands between two classes, first one by row:
# 0 illegal, 1 no break, 2 syllable, 3 word, 4 punctuation, 5 by context. Rows and columns: X C M V T V39 V3A N S.
CLASSES = {
    "C": "\\u1000-\\u102A\\u103F\\u104C-\\u1055\\u105A-\\u105D\\u1061\\u1065-\\u1066\\u106E-\\u1070\\u1075-\\u1081\\u108E\\u109E-\\u109F\\uAA60-\\uAA6F\\uAA71-\\uAA7A",
    "M": "\\u103B-\\u103E\\u105E-\\u1060\\u1082",
    "V": "\\u102B-\\u1036\\u1056-\\u1059\\u1062-\\u1064\\u1067-\\u1068\\u1071-\\u1074\\u1083-\\u1086",
    "T": "\\u1037-\\u1038\\u1069-\\u106D\\u1087-\\u108D\\u108F\\uAA70\\uAA7B",
    "V39": "\\u1039",
    "V3A": "\\u103A",
    "N": "\\u1040-\\u1049\\u1090-\\u1099",
    "S": "\\u104A-\\u104B",
}
ORDER = ["X", "C", "M", "V", "T", "V39", "V3A", "N", "S"]
BETWEEN = [
    [1, 3, 1, 1, 1, 1, 1, 1, 1],
    [3, 5, 1, 1, 1, 1, 1, 2, 4],
    [3, 5, 1, 1, 1, 0, 1, 2, 4],
    [3, 5, 0, 1, 1, 0, 1, 2, 4],
    [3, 2, 0, 1, 1, 0, 1, 2, 4],
    [3, 1, 0, 0, 0, 0, 0, 0, 0],
    [3, 2, 1, 1, 1, 1, 0, 2, 4],
    [3, 2, 1, 1, 1, 0, 0, 1, 4],
    [3, 2, 0, 0, 0, 0, 0, 2, 0],
]
#: By context there is no break after the letter a, before great sa, nor before a letter that is stacked or killed (killed: by
#: its sign at once, or after a dot below).
NO_BREAK_AFTER, NO_BREAK_BEFORE, DOT, STACKED, KILLED = 0x1021, 0x103F, 0x1037, 0x1039, 0x103A
LEFT_WHOLE, BY_CONTEXT = 1, 5
#: So many texts are broken at a time, which bounds the arrays beside them.
AT_ONCE = 64


def _kinds() -> np.ndarray:
    """The class of each code point of up to three bytes, as its place in ORDER."""
    out = np.zeros(1 << 16, np.uint8)
    for name, ranges in CLASSES.items():
        for part in re.findall(r"\\u(\w{4})(?:-\\u(\w{4}))?", ranges):
            first, last = int(part[0], 16), int(part[1] or part[0], 16)
            out[first : last + 1] = ORDER.index(name)
    return out


KINDS, TABLE = _kinds(), np.array(BETWEEN, np.uint8)


def _broken(texts: pa.Array) -> pa.Array:
    """Arrays of syllables of UTF-8 texts: each syllable is a range of the bytes, which are not copied."""
    wide = pa.types.is_large_string(texts.type)
    ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]]
    at = np.flatnonzero((raw & 0xC0) != 0x80)
    three = np.pad(raw, (0, 2))
    b = three[at]
    codes = np.where(b >> 4 == 0xE, (b & 0xF).astype(np.int32) << 12 | (three[at + 1] & 0x3F).astype(np.int32) << 6 | three[at + 2] & 0x3F, 0)
    firsts = np.searchsorted(at, ends - ends[0])  # of the texts, by characters
    c1 = np.append(codes[1:], 0)[: len(codes)]
    c1[firsts[1:][firsts[1:] > 0] - 1] = 0
    c2 = np.append(c1[1:], 0)[: len(codes)]
    c3 = np.append(c2[1:], 0)[: len(codes)]
    state = TABLE[KINDS[codes], KINDS[c1]]
    tied = (c2 == STACKED) | (c2 == KILLED) | (c2 == DOT) & (c3 == KILLED)
    cut = np.where(state == BY_CONTEXT, (codes != NO_BREAK_AFTER) & (c1 != NO_BREAK_BEFORE) & ~tied, state != LEFT_WHOLE)
    begins = np.append(True, cut[:-1])[: len(codes)]
    begins[firsts[:-1][firsts[:-1] < len(codes)]] = True
    places = np.flatnonzero(begins)
    bounds = np.append(at[places], len(raw)).astype(ends.dtype) + ends[0]
    parts = pa.Array.from_buffers(texts.type, len(places), [None, pa.py_buffer(bounds), data])
    of = pa.array(np.searchsorted(places, firsts).astype(np.int32), mask=np.append(texts.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(of, parts)


def _all_broken(texts: pa.Array) -> pa.Array:
    few = (_broken(texts.slice(k, AT_ONCE)) for k in range(0, len(texts), AT_ONCE))
    return pa.concat_arrays([pa.array([], pa.list_(texts.type)), *few])


def syllables(text: Column) -> Column:
    """The array of a text's syllables, which joined give the text again; an empty text has none, null stays null."""
    return F.arrow_udf(_all_broken, "array<string>")(text)
