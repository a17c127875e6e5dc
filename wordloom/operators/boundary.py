"""Sentence-boundary features, labels, filters and scores."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordloom.functions.text import shape, strip_edges
from wordloom.operators.corpus import drawn, ranked


def context_features(tokens: DataFrame, width: int = 3, key: str = "doc_id") -> DataFrame:
    """tokens (key, i, token) with neighbours p1.. and n1.., BOS and EOS beyond the ends, shape, prefixes and suffixes."""
    w = W.partitionBy(key).orderBy("i")
    out = tokens.withColumn("shape", shape(F.col("token")))
    for k in range(1, width + 1):
        out = out.withColumn(f"p{k}", F.coalesce(F.lag("token", k).over(w), F.lit("BOS"))).withColumn(f"n{k}", F.coalesce(F.lead("token", k).over(w), F.lit("EOS")))
    for k in range(1, 4):
        out = out.withColumn(f"prefix{k}", F.left("token", F.lit(k))).withColumn(f"suffix{k}", F.right("token", F.lit(k)))
    return out


def carried_labels(tokens: DataFrame, kept: Column, key: str = "doc_id") -> DataFrame:
    """The kept tokens, each with the boundaries of the dropped tokens before it moved onto it; those after the last kept
    token move back onto it. tokens: (key, i, token, y)."""
    w = W.partitionBy(key).orderBy("i")
    t = tokens.withColumn("_k", kept.cast("int"))
    back = W.partitionBy(key).orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)  # (A frame up to the last row is quadratic.)
    t = t.withColumn("_to", F.last(F.when(F.col("_k") == 1, F.col("i")), ignorenulls=True).over(back))
    t = t.withColumn("_to", F.coalesce("_to", F.max(F.when(F.col("_k") == 1, F.col("i"))).over(W.partitionBy(key))))
    moved = t.groupBy(key, F.col("_to").alias("i")).agg(F.max("y").alias("y"))
    return t.filter("_k = 1").drop("_k", "_to", "y").join(moved, [key, "i"])


def line_stats(docs: DataFrame, word: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, n, med, mad, short): words of each line that has any; short: under 0.6 of the document's median."""
    lines = docs.select(id_col, F.posexplode(F.split(text_col, "\n", -1)).alias("line", "t")).select(id_col, "line", F.regexp_count("t", F.lit(word)).alias("n")).filter("n > 0")
    med = lines.groupBy(id_col).agg(F.median("n").alias("med"))
    both = lines.join(med, id_col)
    mad = both.groupBy(id_col).agg(F.median(F.abs(F.col("n") - F.col("med"))).alias("mad"))
    return both.join(mad, id_col).withColumn("short", F.col("n") < 0.6 * F.col("med"))


def post_filter(scored: DataFrame, threshold: float, gap: int, key: str = "doc_id") -> DataFrame:
    """(key, i) of boundaries at or above a threshold, those closer than a gap to the last kept one left out. What is kept
    depends on what was kept before, so it is a fold over a document's candidates."""
    c = scored.filter(F.col("p") >= threshold).groupBy(key).agg(F.array_sort(F.collect_list("i")).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda s, i: F.when((F.size(s) == 0) | (i - F.element_at(s, -1) >= gap), F.array_append(s, i)).otherwise(s) if gap else F.array_append(s, i))
    return c.select(key, F.explode(kept).alias("i"))


def scores(rows: DataFrame, gold: Column, guess: Column) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 of two boolean columns; 0 where nothing is to be divided by."""
    tp, fp, fn = (F.count_if(c) for c in (gold & guess, ~gold & guess, gold & ~guess))
    counted = rows.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    return _rates(counted)


def scores_by(rows: DataFrame, label: str, gold: Column, guess: Column) -> DataFrame:
    """As scores, for each label and, under the label null, for all rows: one aggregation with grouping sets."""
    g = rows.withColumns({"_g": gold, "_p": guess})
    tp, fp, fn = F.count_if(F.expr("_g and _p")), F.count_if(F.expr("not _g and _p")), F.count_if(F.expr("_g and not _p"))
    return _rates(g.rollup(label).agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn")))


def _rates(counted: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    out = counted.withColumns({"precision": p, "recall": r})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def end_words(sentences: DataFrame, key: list[str]) -> DataFrame:
    """(token, n): how often a token is a sentence's last one. sentences: (*key, i, token)."""
    last = sentences.groupBy(*key).agg(F.max_by("token", "i").alias("token"), F.max("i").alias("i"))
    return last.groupBy("token").agg(F.count("*").alias("n"))


def rank_bucket(rank: Column) -> Column:
    return F.when(rank <= 10, "10").when(rank <= 50, "50").when(rank <= 200, "200").otherwise("more")


# What makes a line short or header-like, and the cut points of the features.
SHORT_SHARE, SHORT_MADS, HEADER_SHARE, HEADER_ODD = 0.65, 1.5, 0.4, 2
TYPES = ("MY", "DIGIT", "PUNCT", "BARE_MARK", "ASCII")
LENGTHS, GAPS, LINES, BASE, MADS = (1, 2, 3, 5, 8, 12), (0, 1, 2, 3, 5, 8), (0, 1, 2, 3), (0, 1, 2, 3, 5, 8, 12), (0, 1, 2, 3)


def kind_of(token: Column, letter: str, mark: str | None = None) -> Column:
    """MY for a token with letters of the script, else BARE_MARK, PUNCT, DIGIT, ASCII or OTHER, in this order; EMPTY for none.
    mark: the class of the script's marks, if it has any."""
    kind = F.when(token == "", "EMPTY").when(token.rlike(f"[{letter}]"), "MY")
    if mark:
        kind = kind.when(token.rlike(mark) & token.rlike(rf"^(?:{mark}|[\p{{P}}\p{{S}}\p{{Nd}}])+$"), "BARE_MARK")
    return kind.when(token.rlike(r"[\p{P}\p{S}]"), "PUNCT").when(token.rlike(r"\p{Nd}"), "DIGIT").when(token.rlike("[A-Za-z]"), "ASCII").otherwise("OTHER")


def mixed_junk(token: Column, letter: str) -> Column:
    """A token of the script with punctuation, symbols, digits or Latin letters in it."""
    other = r"[\p{P}\p{S}\p{Nd}]" if letter.startswith("a-z") else r"[\p{P}\p{S}\p{Nd}A-Za-z]"
    return token.rlike(f"[{letter}]") & token.rlike(other)


def median_of(ordered: str) -> Column:
    """The median of a sorted array column of numbers; null of none."""
    n = F.size(ordered)
    middle = lambda k: F.get(ordered, F.floor(k / 2).cast("int"))
    return F.when(n > 0, (middle(n - 1) + middle(n)) / 2)


def gap_arrays(docs: DataFrame, letter: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, e, med, mad): what white space parts in a text, in order, as an array of (token, gap, line, kind, junk, my, share, short,
    header): with the white space after it, the number of line ends before it, and its line's shape. Body lines are those of
    which the script makes half or more (all with any, if there are none); a line is short below a share of their median
    (med), or some deviations (mad) under it. All is read within the row, line by line, so no token is shuffled."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"^\s+", "")
    token = lambda w: F.struct(w.alias("token"), kind_of(w, letter).alias("kind"), mixed_junk(w, letter).alias("junk"))
    lines = F.transform(F.split("_x", "\n", -1), lambda x, k: F.struct(k.cast("long").alias("line"), F.transform(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0)), token).alias("w")))
    among = lambda p, *kinds: F.size(F.filter(p["w"], lambda x: x["kind"].isin(*kinds)))
    counted = F.transform(F.filter(lines, lambda p: F.size(p["w"]) > 0), lambda p: F.struct(p["line"].alias("line"), p["w"].alias("w"), F.size(p["w"]).alias("total"), among(p, "MY").alias("my"), among(p, "DIGIT", "PUNCT", "ASCII").alias("odd")))
    rows = docs.select(id_col, text.alias("_x")).select(id_col, counted.alias("_c"), F.regexp_extract_all("_x", F.lit(r"\s+"), F.lit(0)).alias("_g"))
    mine = lambda good: F.transform(F.filter("_c", lambda p: (p["my"] > 0) & good(p)), lambda p: p["my"])
    rows = rows.withColumn("_b", mine(lambda p: p["my"] / p["total"] >= 0.5))
    rows = rows.withColumn("_u", F.array_sort(F.when(F.size("_b") > 0, F.col("_b")).otherwise(mine(lambda p: F.lit(True)))))
    rows = rows.withColumn("med", F.coalesce(median_of("_u"), F.lit(0.0)))
    rows = rows.withColumn("_d", F.array_sort(F.transform("_u", lambda x: F.abs(x - F.col("med"))))).withColumn("mad", F.coalesce(median_of("_d"), F.lit(0.0)))
    med, mad = F.col("med"), F.col("mad")
    share = lambda p: p["my"] / p["total"]
    short = lambda p: (med > 0) & ((p["my"] < SHORT_SHARE * med) | ((mad > 0) & (p["my"] < med - SHORT_MADS * mad)))
    shaped = F.transform("_c", lambda p: F.struct(p["w"].alias("w"), F.struct(p["line"].alias("line"), p["my"].alias("my"), share(p).alias("share"), short(p).alias("short"), ((share(p) < HEADER_SHARE) & (p["odd"] >= HEADER_ODD)).alias("header")).alias("l")))
    flat = F.flatten(F.transform(shaped, lambda p: F.transform(p["w"], lambda x: F.struct(x.alias("x"), p["l"].alias("l")))))
    item = lambda v, g: F.struct(v["x"]["token"].alias("token"), F.coalesce(g, F.lit("")).alias("gap"), v["l"]["line"].alias("line"), v["x"]["kind"].alias("kind"), v["x"]["junk"].alias("junk"), *(v["l"][c].alias(c) for c in ("my", "share", "short", "header")))
    return rows.select(id_col, F.zip_with(flat, "_g", item).alias("e"), "med", "mad")


def gaps(held: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, i, token, gap, line, kind, junk, ...): the items of gap_arrays as rows."""
    return held.select(key, F.posexplode_outer("e").alias("i", "e")).filter("i is not null").select(key, "i", "e.*")


def pair_array() -> Column:
    """Of gap_arrays, the array of neighbours (a, b): each item with the one after it."""
    n = F.greatest(F.size("e") - 1, F.lit(0))
    return F.zip_with(F.slice("e", 1, n), F.slice("e", 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def cut_at(value: Column, cuts: tuple) -> Column:
    """The first cut that a value does not exceed, as <= cut, or > the last one."""
    out = F.lit(f"> {cuts[-1]}")
    for c in reversed(cuts):
        out = F.when(value <= c, f"<= {c}").otherwise(out)
    return out


def share_band(share: Column) -> Column:
    out = F.lit("<0.3")
    for c in (0.3, 0.5, 0.7, 0.9):
        out = F.when(share >= c, f">={c}").otherwise(out)
    return out


def gap_features(held: DataFrame, names: list[str] | None = None, key: str = "doc_id") -> DataFrame:
    """(key, i, features map): 32 features (or those named) of each place between two tokens of gap_arrays that do not look at the
    words themselves: kinds, lengths and edges of both, the white space, and the shapes of their lines."""
    from wordloom.functions.clean import char_class

    each = held.select(key, "med", "mad", F.posexplode_outer(pair_array()).alias("i", "p")).filter("i is not null")
    line = lambda p, side: [F.col(f"p.{side}.{c}").alias(f"{p}{c}_") for c in ("my", "share", "short", "header")]
    r = each.select(key, "i", F.col("med").alias("med_"), F.col("mad").alias("mad_"), *(F.col(f"p.a.{c}") for c in ("token", "gap", "kind", "junk")), *(F.col(f"p.b.{c}").alias(f"next_{c}") for c in ("token", "kind", "junk")), *line("", "a"), *line("next_", "b"))
    flag = lambda c: F.when(c, "1").otherwise("0")
    times = lambda ch: F.length("gap") - F.length(F.replace("gap", F.lit(ch), F.lit("")))
    first, last = (lambda c: char_class(F.left(c, F.lit(1)))), (lambda c: char_class(F.right(c, F.lit(1))))
    f = {
        "prev_t": F.col("kind"), "next_t": F.col("next_kind"), "prev_mixed_junk": flag(F.col("junk")), "next_mixed_junk": flag(F.col("next_junk")),
        "prev_len_b": cut_at(F.length("token"), LENGTHS), "next_len_b": cut_at(F.length("next_token"), LENGTHS),
        "prev_first_c": first("token"), "prev_last_c": last("token"), "next_first_c": first("next_token"), "next_last_c": last("next_token"),
        "prev_ends_punct": flag(last("token") == "PUN"), "prev_ends_digit": flag(last("token") == "DIG"), "prev_ends_mark": flag(last("token") == "MY_M"),
        "gap_len_b": cut_at(F.length("gap"), GAPS), "gap_spaces_b": cut_at(times(" "), GAPS), "gap_tabs": flag(times("\t") > 0), "gap_nl_b": cut_at(times("\n"), LINES),
        "gap_has_newline": flag(times("\n") > 0), "gap_blankline": flag(F.contains("gap", F.lit("\n\n"))), "is_eol": flag(times("\n") > 0),
        "next_is_junk": flag(F.col("next_kind") != "MY"), "prev_is_my__next_is_junk": flag((F.col("kind") == "MY") & (F.col("next_kind") != "MY")),
        "prev_mixed_or_next_junk": flag(F.col("junk") | (F.col("next_kind") != "MY")),
        "cur_line_my": cut_at(F.col("my_"), GAPS), "cur_line_ratio": share_band(F.col("share_")), "cur_line_short": flag(F.col("short_")), "cur_line_headerish": flag(F.col("header_")),
        "next_line_ratio": share_band(F.col("next_share_")), "next_line_short": flag(F.col("next_short_")), "next_line_headerish": flag(F.col("next_header_")),
        "doc_line_med_b": cut_at(F.round("med_"), BASE), "doc_line_mad_b": cut_at(F.round("mad_"), MADS),
    }
    return r.select(key, "i", F.create_map(*(x for k, v in f.items() if names is None or k in names for x in (F.lit(k), v))).alias("features"))


def silver_labels(held: DataFrame, key: str = "doc_id", least: int = 5) -> DataFrame:
    """(key, i, label) of each place between two tokens of gap_arrays: PARA_END at a line end after a short or header-like line, or
    before a blank one; else SENT_END after a token of the script that junk is glued to or that another kind of token
    follows; else O. Texts of fewer than so many tokens, and those without any boundary, have no rows."""

    def label(p: Column) -> Column:
        a, b = p["a"], p["b"]
        para = F.contains(a["gap"], F.lit("\n")) & (a["short"] | a["header"] | F.contains(a["gap"], F.lit("\n\n")))
        return F.when(para, "PARA_END").when((a["kind"] == "MY") & (a["junk"] | (b["kind"] != "MY")), "SENT_END").otherwise("O")

    labelled = held.select(key, F.transform(pair_array(), label).alias("_l"))
    # (No filter: it would be pushed below the arrays, and all of them made again for it.)
    kept = F.when((F.size("_l") >= least - 1) & F.exists("_l", lambda x: x != "O"), F.col("_l"))
    return labelled.select(key, F.posexplode_outer(kept).alias("i", "label")).filter("i is not null")


def junk_pool(rows: DataFrame, most: int, longest: int = 8, key: str = "doc_id") -> DataFrame:
    """(key, token, first): distinct tokens of gaps that are short and not of the script, or mixed junk, in order of their first
    place; up to `most` for each text, which is what a pool is."""
    good = F.when(F.col("kind") == "MY", F.col("junk")).otherwise(F.length("token") <= longest)
    first = rows.filter(good).groupBy(key, "token").agg(F.min("i").alias("first"))
    return first.withColumn("_r", F.row_number().over(W.partitionBy(key).orderBy("first"))).filter(F.col("_r") <= most).drop("_r")


def keeps(token: Column, letter: str, foreign: bool = False) -> Column:
    """Whether a token stays in training data: not punctuation alone, and with the script's letters or digits (or any, if foreign
    ones may stay)."""
    bare = strip_edges(token)
    return (bare != "") & (bare.rlike(f"[{letter}]") | bare.rlike(r"\p{Nd}") | F.lit(foreign))


def word_features(tokens: DataFrame, finals: DataFrame, ends: dict[str, DataFrame], width: int = 2, key: str = "doc_id") -> DataFrame:
    """(key, i, features map) of tokens (key, i, token, upos, tag): the word without edges, its shape, affixes, tags, whether a
    grammar counts it as final (finals: token, kind), whether and in which rank band each list of sentence ends (name ->
    (token, rank)) has it, the same of its neighbours, and the pairs that it forms with them. Lists are joined, on distinct
    words; neighbours are read from the same rows by windows of one order."""
    t = tokens.withColumn("n", strip_edges(F.col("token")))
    words = t.select("n").distinct()
    kinds = finals.groupBy(F.col("token").alias("n")).agg(F.array_sort(F.collect_set("kind")).alias("_kinds"))
    words = words.join(kinds, "n", "left")
    for name, table in ends.items():
        words = words.join(table.select(F.col("token").alias("n"), F.col("rank").alias(f"_{name}")), "n", "left")
    t = t.join(words, "n")
    w = W.partitionBy(key).orderBy("i")
    text = lambda c: F.when(c, "True").otherwise("False")
    f = {
        "w": F.col("token"), "n": F.col("n"), "shape": shape(F.col("token"), 16), "len": F.least(F.length("token"), F.lit(12)).cast("string"), "upos": F.col("upos"), "tag": F.col("tag"),
        "has_digit": text(F.col("n").rlike(r"\p{Nd}")), **{f"suf{k}": F.right("n", F.lit(k)) for k in (1, 2, 3)}, **{f"pre{k}": F.left("n", F.lit(k)) for k in (1, 2)},
        "gram_final_any": text(F.col("_kinds").isNotNull()), "gram_final_stc": text(F.coalesce(F.array_contains("_kinds", "stc"), F.lit(False))), "gram_final_vn": text(F.coalesce(F.array_contains("_kinds", "vn"), F.lit(False))),
    }
    for name in ends:
        f[f"{name}_end"] = text(F.col(f"_{name}").isNotNull())
        f[f"{name}_rank_bucket"] = F.when(F.col(f"_{name}").isNotNull(), rank_bucket(F.col(f"_{name}")))
    for k in range(1, width + 1):
        for sign, move, edge in (("-", F.lag, "BOS"), ("+", F.lead, "EOS")):
            f[f"{sign}{k}:n"], f[f"{sign}{k}:upos"] = move("n", k).over(w), move("upos", k).over(w)
            f[f"{sign}{k}:gram_final"] = F.when(move("n", k).over(w).isNotNull(), text(move("_kinds", k).over(w).isNotNull()))
            f[f"{edge}{k}"] = F.when(move("n", k).over(w).isNull(), "True")
    f["upos_-1_0"], f["upos_0_+1"] = F.concat(F.lag("upos").over(w), F.lit("_"), "upos"), F.concat("upos", F.lit("_"), F.lead("upos").over(w))
    f["n_-1_0"], f["n_0_+1"] = F.concat(F.lag("n").over(w), F.lit("_"), "n"), F.concat("n", F.lit("_"), F.lead("n").over(w))
    every = F.map_filter(F.create_map(*(x for k, v in f.items() for x in (F.lit(k), v))), lambda _, v: v.isNotNull())
    return t.select(key, "i", every.alias("features"))


def ending_sentences(tokens: DataFrame, enders: DataFrame, forced: list[str], letter: str, suffixes: list[str] = [], key: str = "doc_id") -> DataFrame:
    """(key, sentence, i, token, y): the kept tokens, without edges, of sentences (tokens: key, i, token, y with 1 at their ends)
    whose last one is an allowed ender or ends in an allowed suffix. Inside them, forced words end a sentence too. What
    follows the last end is left out."""
    w = W.partitionBy(key).orderBy("i")
    s = tokens.withColumn("sentence", F.coalesce(F.sum("y").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    closed = s.groupBy(key, "sentence").agg(F.max("y").alias("_end")).filter("_end = 1").select(key, "sentence")
    kept = s.join(closed, [key, "sentence"], "left_semi").filter(keeps(F.col("token"), letter)).withColumn("token", strip_edges(F.col("token")))
    last = kept.groupBy(key, "sentence").agg(F.max_by("token", "i").alias("_last"), F.max("i").alias("_i"))
    ok = last.join(enders.select(F.col("token").alias("_last"), F.lit(True).alias("_ok")).distinct(), "_last", "left")
    good = F.coalesce("_ok", F.lit(False))
    for x in suffixes:
        good = good | F.col("_last").endswith(x)
    return kept.join(ok.filter(good).select(key, "sentence", "_i"), [key, "sentence"]).select(key, "sentence", "i", "token", ((F.col("i") == F.col("_i")) | F.col("token").isin(forced)).cast("int").alias("y"))


def merged_enders(tokens: DataFrame, ender: str, key: str = "doc_id") -> DataFrame:
    """(key, i, token, y) of texts in which a lone ender at a sentence's end is joined to the token before it, unless that ends a
    sentence itself; only the texts that change. A joined pair's end is where the next pair could not join, so the rule reads
    the labels as they were."""
    w = W.partitionBy(key).orderBy("i")
    joins = (F.col("token") == ender) & (F.col("y") == 1) & (F.lag("y").over(w) == 0)
    t = tokens.withColumn("_j", F.coalesce(joins, F.lit(False)))
    t = t.withColumn("_next", F.coalesce(F.lead("_j").over(w), F.lit(False)))
    changed = t.filter("_j").select(key).distinct()
    out = t.filter(~F.col("_j")).withColumn("token", F.when(F.col("_next"), F.concat("token", F.lit(ender))).otherwise(F.col("token"))).withColumn("y", F.when(F.col("_next"), 1).otherwise(F.col("y")))
    return out.join(changed, key, "left_semi").select(key, "i", "token", "y")


def concatenated(records: DataFrame, most: int, seed: int, key: str = "doc_id", least: int = 1, block: int = 1 << 16) -> DataFrame:
    """records with start: the number (from 0, in the order of key) of the first of the least to `most` neighbours that they are
    put together with. A size is drawn where a group starts, and the next one starts after it; the last may be short.

    A size depends on the seed and the place alone, so each block of places tells by itself, for each place at which its
    first group may start, where the last one begins and how far it reaches into the next block (pointer doubling within
    the block). Blocks are then put one after another: one short row for each block, the only step in one task."""
    placed = ranked(records, key).withColumnRenamed("nth", "_nth")
    total = placed.agg(F.coalesce(F.max("total"), F.lit(0)).alias("n")).first().n

    def ways(first: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each place of a block: the last group's first place on the way from it, and where the group after it starts."""
        place = np.arange(block, dtype=np.int64)
        after = place + drawn(first + place, least, most, seed)
        last, inside = place.copy(), after < block
        while inside.any():
            last[inside] = last[after[inside]]
            after[inside] = after[after[inside]]
            inside = after < block
        return last, after

    def transfers(batches):
        for b in batches:
            rows = [(int(n), *(x[:most].tolist() for x in ways(int(n) * block))) for n in b["id"]]
            yield pd.DataFrame(rows, columns=["block", "last", "after"])

    def entries(batches):
        at, begun = 0, 0  # where in the block the first group starts, and the place of the group before it
        for b in batches:
            out = []
            for n, last, after in zip(b["block"], b["last"], b["after"]):
                out.append((n, at, begun))
                begun, at = (n * block + last[at], after[at] - block) if at < block else (begun, at - block)
            yield pd.DataFrame(out, columns=["block", "at", "begun"])

    spark = records.sparkSession
    told = spark.range(-(-total // block)).mapInPandas(transfers, "block long, last array<long>, after array<long>")
    told = told.repartition(1).sortWithinPartitions("block").mapInPandas(entries, "block long, at long, begun long")

    def starts(batches):
        for b in batches:
            for n, at, begun in zip(b["block"], b["at"], b["begun"]):
                place = np.arange(block, dtype=np.int64)
                jump = place + drawn(n * block + place, least, most, seed)
                is_start = np.zeros(block + 1, bool)
                is_start[min(at, block)] = True
                while True:  # the places reached so far, and those that lie as many groups further
                    more = np.minimum(jump[np.flatnonzero(is_start[:block])], block)
                    if is_start[more].all():
                        break
                    is_start[more] = True
                    jump = np.where(jump < block, jump[np.minimum(jump, block - 1)], block)
                own = np.where(is_start[:block], place, -1)
                own = np.maximum.accumulate(own)
                yield pd.DataFrame({"_nth": n * block + place, "start": np.where(own < 0, begun, n * block + own)})

    marks = told.repartition("block").mapInPandas(starts, "_nth long, start long")
    return placed.join(marks, "_nth").drop("_nth", "total")


def marker_scores(raw: DataFrame, guess: DataFrame, ignored: list[str], letter: str, marker: str = "<SENT_END>", key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row: gold, predicted, missed, ignored. A marker's place is the kept token before it; markers whose next kept token is
    one of the ignored ones count apart. guess: (key, k), places among the kept tokens."""
    tokens = raw.select(key, F.posexplode_outer(F.filter(F.split(text_col, r"\s+"), lambda t: t != "")).alias("i", "token")).filter("i is not null")
    is_marker = F.col("token") == marker
    # Of the tokens only flags are shuffled. The next kept token is read in the opposite order: a frame that
    # ends with the last row is gone through again for each row, which is quadratic in a text's length.
    flags = tokens.select(key, "i", is_marker.alias("_m"), (~is_marker & keeps(F.col("token"), letter)).alias("_g"), strip_edges(F.col("token")).isin(ignored).alias("_x")).filter("_m or _g")
    w = W.partitionBy(key)
    t = flags.withColumn("_ig", F.coalesce(F.last(F.when(F.col("_g"), F.col("_x")), ignorenulls=True).over(w.orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, -1)), F.lit(False)))
    t = t.withColumn("_k", F.sum(F.col("_g").cast("int")).over(w.orderBy("i")))
    one = lambda c: F.when(c, 1).otherwise(0)
    marks = t.filter(F.col("_m") & (F.col("_k") > 0)).select(key, (F.col("_k") - 1).alias("k"), one(~F.col("_ig")).alias("gold"), F.lit(0).alias("guess"), one(F.col("_ig")).alias("ignored"))
    both = marks.unionByName(guess.select(key, F.col("k").cast("long").alias("k"), F.lit(0).alias("gold"), F.lit(1).alias("guess"), F.lit(0).alias("ignored")))
    places = both.groupBy(key, "k").agg(F.max("gold").alias("gold"), F.sum("guess").alias("guess"), F.sum("ignored").alias("ignored"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(name)
    return places.agg(total(F.col("gold"), "gold"), total(one((F.col("gold") == 1) & (F.col("guess") == 0)), "missed"), total(F.col("guess"), "predicted"), total(F.col("ignored"), "ignored"))


def particles(texts: DataFrame, sequences: list[str], key: str = "doc_id") -> DataFrame:
    """(key, k, chunk, ends): texts (key, c array of clusters) cut around sentence-final particles (joined clusters, longest first),
    found greedily from the left; a particle ends a sentence. A pattern over the joined clusters finds them: only its matches
    at cluster borders count, which a mark before each cluster makes sure of."""
    marked = F.concat(F.array_join(F.transform("c", lambda x: F.concat(F.lit("\u0001"), x)), ""), F.lit("\u0001"))
    clusters_ = [x if isinstance(x, list) else [x] for x in sorted(sequences, key=len, reverse=True)]
    one = "|".join("".join("\u0001" + re.escape(c) for c in x) for x in clusters_)
    found = F.regexp_extract_all(marked, F.lit(f"(?:{one})(?=\u0001)|(?:(?!(?:{one})\u0001)\u0001[^\u0001]+)+"), F.lit(0))
    rows = texts.select(key, F.posexplode_outer(found).alias("k", "p")).filter("k is not null")
    return rows.select(key, "k", F.replace("p", F.lit("\u0001"), F.lit("")).alias("chunk"), F.col("p").rlike(f"^(?:{one})$").alias("ends"))


def raw_lines(docs: DataFrame, word: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, k, token, last_in_line, short): tokens of each line; an empty line is one empty token; a line is short with fewer
    tokens than 0.6 of the median of the lines that have any."""
    lines = docs.select(id_col, F.posexplode_outer(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)).alias("line", "t"))
    found = F.regexp_extract_all("t", F.lit(word), F.lit(0))
    lines = lines.withColumn("w", found).withColumn("n", F.size("w"))
    med = lines.filter("n > 0").groupBy(id_col).agg(F.median("n").alias("med"))
    rows = lines.join(med, id_col, "left").withColumn("w", F.when(F.col("n") > 0, F.col("w")).otherwise(F.array(F.lit(""))))
    each = rows.select(id_col, "line", "n", "med", F.posexplode_outer("w").alias("k", "token"))
    return each.select(id_col, "line", "k", "token", (F.col("k") >= F.col("n") - 1).alias("last_in_line"), F.coalesce((F.col("n") > 0) & (F.col("n") < 0.6 * F.col("med")), F.lit(False)).alias("short"))
