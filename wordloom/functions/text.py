"""Columns and tables of characters, clusters, tokens, islands, sentences and spans."""

from __future__ import annotations

import functools
import re
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordloom.functions.profile import ScriptProfile

#: So many bytes of texts are cut into words at once; a longer text is cut whole.
BLOCK = 1 << 20


def nfc(text: Column) -> Column:
    """Canonical composition. Spark has none, so texts go through an Arrow function, as Arrow's own arrays, of which a few texts at a
    time become objects of Python. (Arrow's own utf8_normalize does not compose.) Texts of Latin-1 alone are sent as null and kept."""

    @F.arrow_udf("string")
    def composed(s: pa.Array) -> pa.Array:
        few = (s.slice(k, 256).to_pylist() for k in range(0, len(s), 256))
        return pa.concat_arrays([s.slice(0, 0), *(pa.array([x and unicodedata.normalize("NFC", x) for x in part], s.type) for part in few)])

    wide = text.rlike(r"[^\x00-\xFF]")
    return F.when(wide, composed(F.when(wide, text))).otherwise(text)


def clean_html(text: Column) -> Column:
    """Tags out, the common character references decoded, white space collapsed."""
    plain = F.regexp_replace(text, r"<[^>]+>", "")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(plain, r"[ \t\n\r\f\x0B]+", " "))


def replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, in order."""
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def in_script_count(text: Column, profile: ScriptProfile) -> Column:
    return F.length(F.regexp_replace(text, f"[^{profile.letter}]", ""))


def clusters(text: Column, profile: ScriptProfile) -> Column:
    return F.regexp_extract_all(text, F.lit(profile.cluster), F.lit(0))


def starts_of(parts: Column) -> Column:
    """Where each of the consecutive parts of a text begins."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all"))
    step = lambda s, p: F.struct((s["at"] + F.length(p)).alias("at"), F.array_append(s["all"], s["at"]).alias("all"))
    return F.aggregate(parts, zero, step, lambda s: s["all"])


def cluster_of_char(parts: Column) -> Column:
    """For each character the number of the cluster that holds it."""
    return F.flatten(F.transform(parts, lambda p, i: F.array_repeat(i, F.length(p))))


def shape(token: Column, most: int = 12) -> Column:
    """Runs of letters as A, digits as D, Myanmar as M and others as P, character by character."""
    for pattern, mark in (("[0-9၀-၉]", "\u0001"), ("[က-႟]", "\u0002"), (r"\p{L}", "\u0003"), ("[^\u0001-\u0003]", "P")):
        token = F.regexp_replace(token, pattern, mark)
    return F.left(F.translate(token, "\u0001\u0002\u0003", "DMA"), F.lit(most))


def token_type(token: Column) -> Column:
    """One of seven classes."""
    return (
        F.when(token == "", "EMPTY").when(token.rlike(r"^[ါ-ှ]+$"), "BARE_MARK").when(token.rlike(r"^[0-9၀-၉]+$"), "DIGIT")
        .when(token.rlike(r"^[\p{P}\p{S}၊။]+$"), "PUNCT").when(token.rlike(r"[က-႟]"), "MY").when(token.rlike(r"^[\x21-\x7E]+$"), "ASCII").otherwise("OTHER")
    )


def strip_edges(token: Column) -> Column:
    """Punctuation, symbols and zero-width characters off both ends."""
    edge = r"[\p{P}\p{S}\s​-‍﻿]+"
    return F.regexp_replace(token, f"^{edge}|{edge}$", "")


def char_ngrams(token: Column, n: int) -> Column:
    return F.when(F.length(token) >= n, F.transform(F.sequence(F.lit(1), F.length(token) - n + 1), lambda i: F.substring(token, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def tokens(docs: DataFrame, profile: ScriptProfile, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, i, token): the script's words of each text in order; a text without words, or null, has no row. A narrow
    transformation; i is carried from the scan. (Outer explodes with a filter after them, here and below: of a plain one the
    optimizer makes a filter of its own on the array's size, which would compute the array twice.)"""
    found = F.regexp_extract_all(profile.norm(F.col(text_col)), F.lit(profile.word), F.lit(0))
    return docs.select(id_col, F.posexplode_outer(found).alias("i", "token")).filter("i is not null")


def token_arrays(docs: DataFrame, profile: ScriptProfile, id_col: str = "doc_id", text_col: str = "text", more: tuple[str, ...] = ()) -> DataFrame:
    """(id, more, t): the script's words of each text in order, in one array; a null text has none. What needs neighbours reads
    them there, so tokens are not shuffled to be put in order again."""
    found = F.regexp_extract_all(profile.norm(F.coalesce(F.col(text_col), F.lit(""))), F.lit(profile.word), F.lit(0))
    return docs.select(id_col, *more, found.alias("t"))


@functools.cache
def in_class(letter: str) -> np.ndarray:
    """For each code point, whether the class body holds it."""
    out = np.zeros(sys.maxunicode + 1, dtype=bool)
    for m in re.finditer(f"[{letter}]+", "".join(map(chr, range(len(out))))):
        out[m.start() : m.end()] = True
    return out


def cut_words(texts: pa.Array, letter: str) -> Iterator[pa.ListArray]:
    """The runs of letters (a class body) of each text in order, as the pattern [letter]+ finds them, in a list; a null text has
    none. Within a task, on the code points of many texts at once, so no word becomes an object."""
    blocks = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)) // BLOCK
    cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        some = [t or "" for t in texts.slice(a, b - a).to_pylist()]
        chars = np.frombuffer("".join(some).encode("utf-32-le"), np.uint32)
        starts = np.cumsum([0, *map(len, some)])
        inside = in_class(letter)[chars]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        heads = starts[starts < len(chars)]
        first[heads] = inside[heads]
        kept = chars[inside]
        ends = np.cumsum(1 + (kept > 0x7F) + (kept > 0x7FF) + (kept > 0xFFFF), dtype=np.int32)  # in bytes
        begins = np.concatenate([[0], ends])[np.append(np.flatnonzero(first[inside]), len(kept))].astype(np.int32)
        words = pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(begins), pa.py_buffer(kept.tobytes().decode("utf-32-le").encode()))
        yield pa.ListArray.from_arrays(pa.array(np.searchsorted(np.flatnonzero(first), starts), pa.int32()), words)


def distinct_runs(texts: DataFrame, letter: str, text_col: str = "text") -> DataFrame:
    """(token): the distinct runs of letters (a class body) of all texts. A task leaves out what it has found before among some 16 MB of
    words, so that few of them become rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for words in cut_words(b.column(0), letter):
                held.append(words.flatten())
                size += held[-1].nbytes
                if size > 16 * BLOCK:
                    yield pa.record_batch([pa.chunked_array(held).unique()], ["token"])
                    held, size = [], 0
        if held:
            yield pa.record_batch([pa.chunked_array(held).unique()], ["token"])

    return texts.select(text_col).mapInArrow(run, "token string").distinct()


def piece_arrays(docs: DataFrame, profile: ScriptProfile, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, p, is_word): as pieces, in two arrays."""
    found = F.regexp_extract_all(profile.norm(F.col(text_col)), F.lit(f"{profile.word}|[^\\s{profile.letter}]+"), F.lit(0))
    return docs.select(id_col, found.alias("p")).withColumn("is_word", F.transform("p", lambda x: x.rlike(f"^{profile.word}$")))


def bound(value: Column, body) -> Column:
    """body(value), where value is computed once, however often a lambda in body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def places(array: str | Column) -> Column:
    """0 .. size - 1; empty for an empty array."""
    n = F.size(array)
    return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() as array<int>)"))


def pieces(docs: DataFrame, profile: ScriptProfile, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, i, piece, is_word): words and what stands between them, without white space."""
    found = F.regexp_extract_all(profile.norm(F.col(text_col)), F.lit(f"{profile.word}|[^\\s{profile.letter}]+"), F.lit(0))
    return docs.select(id_col, F.posexplode_outer(found).alias("i", "piece")).filter("i is not null").withColumn("is_word", F.col("piece").rlike(f"^{profile.word}$"))


def numbered_runs(rows: DataFrame, breaks: Column, key: list[str], order: str) -> DataFrame:
    """run: how many breaks a row has had up to itself; equal for rows that no break parts."""
    return rows.withColumn("run", F.sum(breaks.cast("int")).over(W.partitionBy(*key).orderBy(order)))


def islands(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, island, first, last, n, text): maximal runs of words among piece_arrays, numbered from 0. A run begins at a word
    without one before it; all is read within the row."""
    word = lambda i: F.coalesce(F.get("is_word", i), F.lit(False))
    bounds = rows.withColumn("_all", places("p"))
    first = F.filter("_all", lambda i: word(i) & ~word(i - 1))
    last = F.filter("_all", lambda i: word(i) & ~word(i + 1))
    text = lambda p, a, b: F.array_join(F.slice(p, a + 1, b - a + 1), " ").alias("text")
    runs = bound(F.col("p"), lambda p: F.zip_with(first, last, lambda a, b: F.struct(a.alias("first"), b.alias("last"), text(p, a, b))))
    found = bounds.select(key, F.posexplode_outer(runs).alias("island", "r")).filter("island is not null")
    return found.select(key, "island", "r.first", "r.last", (F.col("r.last") - F.col("r.first") + 1).cast("long").alias("n"), "r.text")


def islands_by_offset(segments: DataFrame, key: str = "doc_id") -> DataFrame:
    """segments (key, i, start, end, is_word) with island: a run of words of which each begins where the one before ends;
    null for others."""
    w = W.partitionBy(key).orderBy("i")
    joined = F.lag("is_word").over(w) & (F.lag("end").over(w) == F.col("start"))
    opens = F.when(F.col("is_word") & ~F.coalesce(joined, F.lit(False)), 1).otherwise(0)
    return segments.withColumn("island", F.when(F.col("is_word"), F.sum(opens).over(w) - 1))


def script_runs(text: Column, profile: ScriptProfile) -> Column:
    """Array of (start, end, run): the runs of the script's word characters in a text."""
    words, between = F.regexp_extract_all(text, F.lit(profile.word), F.lit(0)), F.split(text, profile.word, -1)
    parts = F.filter(F.flatten(F.zip_with(between, words, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), lambda x: x.isNotNull())
    starts = starts_of(parts)
    return F.transform(words, lambda v, k: F.struct(F.get(starts, 2 * k + 1).alias("start"), (F.get(starts, 2 * k + 1) + F.length(v)).alias("end"), v.alias("run")))


def sentence_table(rows: DataFrame, enders: str, key: str = "doc_id") -> DataFrame:
    """(key, sentence, p, is_word): piece_arrays cut after each piece that holds an ender; sentences are numbered from 0. They
    are cut within a row, so that no row of a sentence carries its whole text."""
    ends = lambda i: F.coalesce(F.get("p", i).rlike(f"[{enders}]"), F.lit(False))
    starts = F.filter(places("p"), lambda i: (i == 0) | ends(i - 1))
    cut = rows.withColumn("_s", starts).withColumn("_e", F.concat(F.slice("_s", 2, F.greatest(F.size("_s") - 1, F.lit(0))), F.array(F.size("p"))))
    part = lambda c, a, b: F.slice(c, a + 1, b - a)
    arrays = F.struct("p", "is_word")
    spans = bound(arrays, lambda v: F.zip_with("_s", F.slice("_e", 1, F.size("_s")), lambda a, b: F.struct(part(v["p"], a, b).alias("p"), part(v["is_word"], a, b).alias("is_word"))))
    found = cut.select(key, F.posexplode_outer(spans).alias("sentence", "x")).filter("sentence is not null")
    return found.select(key, F.col("sentence").cast("long").alias("sentence"), "x.p", "x.is_word")


def sentences(rows: DataFrame, enders: str, key: str = "doc_id") -> DataFrame:
    """rows with their sentence: a new one begins after each piece that holds an ender."""
    ends = F.col("piece").rlike(f"[{enders}]").cast("int")
    before = F.coalesce(F.sum(ends).over(W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("sentence", before)


def offsets(text: Column, segments: Column) -> Column:
    """Spans of the segments found one after another; null as a whole if one is missing or empty."""
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {kind})").alias("out"))

    def step(state: Column, seg: Column) -> Column:
        at = F.position(seg, text, state["at"] + 1) - 1
        ok = state["out"].isNotNull() & (at >= 0) & (F.length(seg) > 0)
        span = F.struct(at.alias("start"), (at + F.length(seg)).alias("end"))
        return F.struct(F.when(ok, at + F.length(seg)).otherwise(state["at"]).alias("at"), F.when(ok, F.array_append(state["out"], span)).alias("out"))

    return F.aggregate(segments, zero, step, lambda s: s["out"])


def char_spans(text: Column, segments: Column) -> Column:
    """As offsets, but with a null for each segment that is missing, after which the search goes on."""
    kind = "array<struct<start:int,end:int>>"
    zero = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {kind})").alias("out"))

    def step(state: Column, seg: Column) -> Column:
        at = F.position(seg, text, state["at"] + 1) - 1
        ok = (at >= 0) & (F.length(seg) > 0)
        span = F.when(ok, F.struct(at.alias("start"), (at + F.length(seg)).alias("end")))
        return F.struct(F.when(ok, at + F.length(seg)).otherwise(state["at"]).alias("at"), F.array_append(state["out"], span).alias("out"))

    return F.aggregate(segments, zero, step, lambda s: s["out"])


def pages(docs: DataFrame, most: int = 3000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, page, text): whole lines packed up to so many characters; a longer line is a page of its own. Joining the
    pages with line ends restores the text."""
    lines = F.split(F.col(text_col), "\n", -1)

    def step(state: Column, line: Column) -> Column:
        fits = state["open"].isNotNull() & (F.length(state["open"]) + 1 + F.length(line) <= most)
        joined = F.struct(state["done"].alias("done"), F.concat(state["open"], F.lit("\n"), line).alias("open"))
        closed = F.struct(F.when(state["open"].isNull(), state["done"]).otherwise(F.array_append(state["done"], state["open"])).alias("done"), line.alias("open"))
        return F.when(fits, joined).otherwise(closed)

    zero = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("open"))
    packed = F.aggregate(lines, zero, step, lambda s: F.array_append(s["done"], s["open"]))
    return docs.select(id_col, F.posexplode(packed).alias("page", "text"))


def has_base_letter(text: Column) -> Column:
    """A Myanmar consonant or independent vowel that is not stacked below another."""
    return text.rlike(r"(?<!္)[က-ဪဿ]")


def has_marks(text: Column) -> Column:
    return text.rlike(r"[ါ-ှၖ-ၙႂ-ႍ]")


def is_garbage(token: Column) -> Column:
    """Numbers, punctuation and symbols, and non-Myanmar tokens of one or two characters."""
    return token.rlike(r"^[\p{N}\p{P}\p{S}]+$") | (~token.rlike(r"[က-႟]") & (F.length(token) <= 2))


def keeps_script(token: Column) -> Column:
    """What a treebank of the script keeps: tokens with a character of its three blocks, and its punctuation, which lies in them."""
    return token.rlike(r"[\u1000-\u109F\uA9E0-\uA9FF\uAA60-\uAA7F]")


def script_marks(text: Column) -> Column:
    """Array of (mark, start, end): the script's comma and full stop, each with its place."""
    at = F.filter(F.transform(F.split(text, ""), lambda c, k: F.struct(c.alias("mark"), k.alias("start"), (k + 1).alias("end"))), lambda x: x["mark"].isin("၊", "။"))
    return F.coalesce(at, F.slice(F.array(F.struct(F.lit("").alias("mark"), F.lit(0).alias("start"), F.lit(0).alias("end"))), 1, 0))


def separator_kind(token: Column) -> Column:
    """Why a token is noise between runs of the script: empty, number, short, symbol; null for others."""
    t = F.trim(F.coalesce(token, F.lit("")))
    return (
        F.when(t == "", "empty").when(t.rlike(r"^[\p{Nd}၊။.,\-/]+$"), "number").when(~keeps_script(t) & (F.length(t) <= 3), "short").when(t.rlike(r"^[\p{P}\p{S}\s]+$"), "symbol")
    )


def is_mixed(token: Column) -> Column:
    """Myanmar letters beside letters or digits of other scripts."""
    return token.rlike(r"[က-႟]") & token.rlike(r"[A-Za-z0-9]")


def bucket(value: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts a value has reached."""
    return sum((F.when(value >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def label_runs(rows: DataFrame, label: str, key: str, order: str) -> DataFrame:
    """(key, run, label, first, last, n): maximal runs of equal neighbouring labels."""
    w = W.partitionBy(key).orderBy(order)
    breaks = (~F.col(label).eqNullSafe(F.lag(label).over(w)) | F.lag(order).over(w).isNull()).cast("int")
    runs = rows.withColumn("_b", breaks).withColumn("run", F.sum("_b").over(w) - 1)
    return runs.groupBy(key, "run", label).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"))


def attached(rows: DataFrame, is_head: Column, key: str, order: str) -> DataFrame:
    """rows with head: the order of the last head row up to them; null before the first one."""
    last = F.last(F.when(is_head, F.col(order)), ignorenulls=True).over(W.partitionBy(key).orderBy(order))
    return rows.withColumn("head", last)


def bioes(words: DataFrame, size: int, tag: str = "ENT", word_col: str = "word") -> DataFrame:
    """words with one row for each part of up to so many characters (k, part, tag): S alone, else B, I and E."""
    n = F.ceil(F.length(word_col) / size).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substring(F.col(word_col), k * size + 1, F.lit(size)))
    out = words.withColumn("_n", n).select("*", F.posexplode(parts).alias("k", "part"))
    mark = F.when(F.col("_n") == 1, "S").when(F.col("k") == 0, "B").when(F.col("k") == F.col("_n") - 1, "E").otherwise("I")
    return out.withColumn("tag", F.concat(mark, F.lit("-" + tag))).drop("_n")


def followed_by_space(text: Column, segments: Column) -> Column:
    """For each segment but the last whether something stands between it and the next one; null if one is not found."""
    spans = offsets(text, segments)
    return F.transform(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), lambda s, k: F.get(spans, k + 1)["start"] > s["end"])


def marked(rows: DataFrame, ends: Column, key: str = "doc_id", marker: str = "<SENT_END>") -> DataFrame:
    """(key, text): the pieces of a text joined by spaces, with a marker after each that ends a sentence."""
    piece = F.when(ends, F.concat("piece", F.lit(f" {marker}"))).otherwise(F.col("piece"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", piece.alias("p")))).alias("all")).select(key, F.array_join("all.p", " ").alias("text"))


def code_points(text: Column) -> Column:
    """U+XXXX of each character."""
    digits = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c: F.hex(F.ascii(c)))
    return F.transform(digits, lambda d: F.concat(F.lit("U+"), F.repeat(F.lit("0"), F.greatest(4 - F.length(d), F.lit(0))), d))


def lines_by_height(words: DataFrame, key: str = "page") -> DataFrame:
    """words (key, nth, x, y, h, text) as lines (key, line, text): a new line begins where y moves by over half a height,
    taken from the line's first word's neighbour on the page; words of a line go by x."""
    w = W.partitionBy(key).orderBy("nth")
    step = F.abs(F.col("y") - F.lag("y").over(w)) > F.coalesce(F.when(F.col("h") > 0, F.col("h")), F.lit(12.0)) / 2
    lines = words.withColumn("line", F.sum(F.coalesce(step, F.lit(False)).cast("int")).over(w))
    return lines.groupBy(key, "line").agg(F.array_sort(F.collect_list(F.struct("x", "nth", "text"))).alias("all")).select(key, "line", F.array_join("all.text", " ").alias("text"))
