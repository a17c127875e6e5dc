"""Word segmentation over a lattice of candidate words.

A lattice row is a candidate word: (key, i, j, word, cost), clusters i..j of its text. The cheapest path is found from
the right, one ordered fold over an island's candidates, and a pair's reward looks at the first word of the best path
that follows. Ties take the shortest first word. Texts are independent and bounded (an island, a word, a name), so the fold
is one group per text; equal texts are cut once by the caller. A text without clusters has no row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordloom.functions.profile import ScriptProfile
from wordloom.functions.text import bound, clusters
from wordloom.operators.lm import sent


@dataclass(frozen=True)
class Weights:
    """The deployed segmenter's weights."""

    known: float = 1.0
    unknown: float = 5.0
    unigram: float = 0.2
    discount: float = 1.0
    per_cluster: float = 10.0
    bigram: float = 0.1
    scale: float = 40.0
    most: int = 16
    default_cost: float = 15.0


def lattice(docs: DataFrame, profile: ScriptProfile, most: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n, i, j, piece, word): every run of up to `most` clusters, as it stands and as a lookup key."""
    parts = docs.select(key, clusters(profile.norm(F.col(text_col)), profile).alias("c")).withColumn("n", F.size("c")).filter("n > 0")
    begun = parts.select(key, "c", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
    ended = begun.select(key, "c", "n", "i", F.explode(F.sequence(F.col("i") + 1, F.least(F.col("n"), F.col("i") + most))).alias("j"))
    piece = F.array_join(F.slice("c", F.col("i") + 1, F.col("j") - F.col("i")), "")
    return ended.select(key, "n", "i", "j", piece.alias("piece")).withColumn("word", profile.headword(F.col("piece")))


def _known_cost(w: Weights) -> Column:
    """What a word of the lexicon (source) with a model's cost, or null, costs without a pair's reward."""
    lm = F.coalesce(F.least("cost", F.lit(w.default_cost)), F.when(F.col("source") == "user", w.default_cost), F.lit(w.default_cost * w.discount))
    return w.known + w.unigram * lm


def priced(candidates: DataFrame, lexicon: DataFrame, costs: DataFrame | None = None, w: Weights = Weights(), profile: ScriptProfile | None = None) -> DataFrame:
    """Adds base (cost without a pair's reward), in_dict and in_lm. lexicon: (word[, source]); costs: (token, cost).

    Distinct words are priced once and joined back. A word that only the model knows costs like an unknown one."""
    words = candidates.select("word").distinct()
    entries = lexicon.select("word", (F.col("source") if "source" in lexicon.columns else F.lit("dict")).alias("source")).dropDuplicates(["word"])
    got = words.join(entries, "word", "left")
    got = got.join(costs.select(F.col("token").alias("word"), "cost"), "word", "left") if costs is not None else got.withColumn("cost", F.lit(None).cast("double"))
    in_dict = F.col("source").isNotNull() & (F.col("word") != "")
    got = got.select("word", in_dict.alias("in_dict"), (F.col("cost").isNotNull() | (F.col("source") == "user")).alias("in_lm"), _known_cost(w).alias("known_cost"))
    # Text without the script's characters counts by its length.
    size = F.when(profile.in_script(F.col("piece")), F.col("j") - F.col("i")).otherwise(F.length("piece")) if profile else F.col("j") - F.col("i")
    other = w.unknown + w.unigram * w.default_cost + (size - 1) * w.per_cluster
    return candidates.join(got, "word").withColumn("base", F.when(F.col("in_dict"), F.col("known_cost")).otherwise(other)).drop("known_cost").withColumn("in_lm", F.coalesce("in_lm", F.lit(False)))


def best_paths(rows: DataFrame, pairs: DataFrame | None = None, w: Weights = Weights(), key: str = "doc_id") -> DataFrame:
    """(key, words, costs, nexts, firsts): the cheapest path of each text, and of each place the cost, the end of the first word
    and the first word of the best path from there on.

    rows: a priced lattice. pairs: (w1, w2, cost) of a word and the one after it; each text meets those that it can use in
    a join, so no table is sent whole. A pair's reward looks at the first word of the best path that follows. Ties take the
    shortest first word. A text's candidates are one fold from the right that appends one place a step."""
    able = F.col("in_dict") | F.col("in_lm") if "in_lm" in rows.columns else F.col("in_dict")
    if pairs is None:
        held = rows.withColumn("near", F.lit(None).cast("map<string,double>"))
    else:
        after = rows.select(key, F.col("i").alias("j"), F.col("word").alias("w2")).distinct()
        wanted = rows.filter(able).select(key, "j", F.col("word").alias("w1")).distinct().join(after, [key, "j"]).select(key, "w1", "w2").distinct()
        used = wanted.join(pairs.select("w1", "w2", "cost"), ["w1", "w2"])
        near = used.groupBy(key, F.col("w1").alias("word")).agg(F.map_from_entries(F.collect_list(F.struct("w2", "cost"))).alias("near"))
        held = rows.join(near, [key, "word"], "left").withColumn("near", F.when(able, F.col("near")))
    places = held.groupBy(key, "n", "i").agg(F.collect_list(F.struct("j", "base", "word", "piece", "near")).alias("c"))
    grouped = places.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct("i", "c")), lambda x, y: y["i"] - x["i"]).alias("all"))
    # Place i lies at n - i of the arrays, which grow towards the left end of the text.
    start = F.struct(F.array(F.lit(0.0)).alias("cost"), F.array(F.lit(0)).alias("to"), F.array(F.lit(None).cast("string")).alias("first"), F.array(F.lit("")).alias("piece"))

    def step(s: Column, p: Column) -> Column:
        def total(c: Column) -> Column:
            at = F.col("n") - c["j"]
            reward = w.bigram * w.scale / (F.try_element_at(c["near"], F.get(s["first"], at)) + 1e-9)
            cost = c["base"] + F.get(s["cost"], at) - F.coalesce(reward, F.lit(0.0))
            return F.struct(cost.alias("cost"), c["j"].cast("int").alias("j"), c["word"].alias("word"), c["piece"].alias("piece"))

        best = F.array_min(F.transform(p["c"], total))
        return F.struct(
            F.array_append(s["cost"], best["cost"]).alias("cost"), F.array_append(s["to"], best["j"]).alias("to"),
            F.array_append(s["first"], best["word"]).alias("first"), F.array_append(s["piece"], best["piece"]).alias("piece"),
        )

    done = grouped.select(key, "n", F.aggregate("all", start, step).alias("s"))
    place = lambda name, at: F.get(F.col(f"s.{name}"), F.col("n") - at)
    follow = F.aggregate(
        F.sequence(F.lit(1), F.col("n").cast("int")), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda s, _: F.when(s["at"] < F.col("n"), F.struct(place("to", s["at"]).alias("at"), F.array_append(s["out"], place("piece", s["at"])).alias("out"))).otherwise(s),
        lambda s: s["out"],
    )
    back = lambda name: F.reverse(F.col(f"s.{name}"))
    return done.select(key, follow.alias("words"), back("cost").alias("costs"), back("to").alias("nexts"), back("first").alias("firsts"))


def traced(rows: DataFrame, pairs: DataFrame | None = None, w: Weights = Weights(), key: str = "doc_id") -> DataFrame:
    """(key, i, j, piece, base, reward, total, before, rank, chosen): every candidate with the word that follows it on the best
    path, its pair's reward, its total cost, and its rank among those of its place."""
    paths = best_paths(rows, pairs, w, key)
    at = paths.select(key, F.posexplode_outer(F.arrays_zip("costs", "nexts", "firsts")).alias("p", "s")).select(key, "p", "s.*")
    ends = at.select(key, F.col("p").alias("j"), F.col("costs").alias("rest"), F.col("firsts").alias("before"))
    held = rows.join(ends, [key, "j"])
    if pairs is not None:
        held = held.join(pairs.select(F.col("w1").alias("word"), F.col("w2").alias("before"), F.col("cost").alias("_p")), ["word", "before"], "left")
    else:
        held = held.withColumn("_p", F.lit(None).cast("double"))
    able = F.col("in_dict") | F.col("in_lm")
    reward = F.when(able & F.col("_p").isNotNull(), w.bigram * w.scale / (F.col("_p") + 1e-9)).otherwise(0.0)
    held = held.withColumn("reward", reward).withColumn("total", F.col("base") - F.col("reward") + F.col("rest"))
    rank = F.row_number().over(W.partitionBy(key, "i").orderBy("total", "j"))
    return held.withColumn("rank", rank).select(key, "i", "j", "piece", "base", "reward", "total", "before", "rank", (F.col("rank") == 1).alias("chosen"))


def informed(paths: DataFrame, rows: DataFrame, pairs: DataFrame | None = None, w: Weights = Weights(), key: str = "doc_id") -> DataFrame:
    """(key, k, segment, i, in_dict, in_lm, cost): the words of the best paths with their place. A cost is the candidate's own
    with the reward of its pair with the word on its left, as it is reported to readers; the path's own cost looks right."""
    cut = paths.select(key, F.posexplode_outer("words").alias("k", "segment"), "nexts").filter("k is not null")
    step = W.partitionBy(key).orderBy("k")
    starts = paths.select(key, F.posexplode_outer(F.aggregate(
        F.sequence(F.lit(1), F.size("words")), F.array(F.lit(0)), lambda s, _: F.array_append(s, F.get("nexts", F.element_at(s, -1)))
    )).alias("k", "i"))
    placed = cut.drop("nexts").join(starts, [key, "k"]).withColumn("before", F.lag("segment").over(step))
    held = placed.join(rows.select(key, "i", F.col("piece").alias("segment"), "word", "base", "in_dict", "in_lm"), [key, "i", "segment"], "left")
    if pairs is not None:
        held = held.join(pairs.select(F.col("w1").alias("word"), F.col("w2").alias("before"), F.col("cost").alias("_p")), ["word", "before"], "left")
    else:
        held = held.withColumn("_p", F.lit(None).cast("double"))
    reward = F.coalesce(F.when(F.col("in_dict") | F.col("in_lm"), w.bigram * w.scale / (F.col("_p") + 1e-9)), F.lit(0.0))
    return held.select(key, "k", "segment", "i", "in_dict", "in_lm", (F.col("base") - reward).alias("cost"))


def max_match(rows: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, words): from the left, the longest lexicon word at each place, else one cluster."""
    hits = rows.join(lexicon.select("word").distinct(), "word", "left_semi").groupBy(key, "n", "i").agg(F.max_by(F.struct("j", "piece"), "j").alias("m"))
    single = rows.filter("j = i + 1").select(key, "n", "i", F.struct("j", "piece").alias("s"))
    at = single.join(hits, [key, "n", "i"], "left").select(key, "n", "i", F.coalesce("m", "s").alias("m"))
    ordered = at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("all"))
    walk = F.aggregate(
        "all", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")),
        lambda s, r: F.when(r["i"] == s["at"], F.struct(r["m"]["j"].alias("at"), F.array_append(s["out"], r["m"]["piece"]).alias("out"))).otherwise(s), lambda s: s["out"],
    )
    return ordered.select(key, walk.alias("words"))


def clustered(texts: DataFrame, profile: ScriptProfile, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, c): the clusters of each text."""
    return texts.select(key, clusters(profile.norm(F.col(text_col)), profile).alias("c")).filter(F.size("c") > 0)


def known_runs(parts: DataFrame, words: DataFrame, profile: ScriptProfile, most: int, key: str = "doc_id") -> DataFrame:
    """(key, i, size, and what else words has): the runs of up to `most` clusters c that words (word, ...) has as lookup keys. Of a
    run nothing but its place and its key is a row; a key is put together from those of its clusters."""
    bare = parts.select(key, F.transform("c", lambda x: F.regexp_replace(x, f"[^{profile.letter}]", "")).alias("h"))
    begun = bare.select(key, F.posexplode_outer(F.transform("h", lambda x, i: F.slice("h", i + 1, F.lit(most)))).alias("i", "h")).filter("i is not null")
    ended = begun.select(key, "i", F.posexplode_outer(F.transform("h", lambda x, k: F.trim(F.array_join(F.slice("h", F.lit(1), k + 1), "")))).alias("k", "word"))
    return ended.join(sent(words), "word").select(key, "i", (F.col("k") + 1).alias("size"), *(c for c in words.columns if c != "word"))


def cheapest(texts: DataFrame, lexicon: DataFrame, costs: DataFrame, profile: ScriptProfile, w: Weights = Weights(), key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, words): the same as best_paths(priced(lattice(...))) without pairs. Only candidates that the lexicon has become rows and
    go back to their text; an unknown one costs by its length alone, so it is met in the fold and nowhere else."""
    entries = lexicon.select("word", (F.col("source") if "source" in lexicon.columns else F.lit("dict")).alias("source")).filter("word <> ''").dropDuplicates(["word"])
    prices = entries.join(costs.select(F.col("token").alias("word"), "cost"), "word", "left").select("word", _known_cost(w).alias("base"))
    parts = clustered(texts, profile, key, text_col)
    code = F.col("i") * w.most + F.col("size")
    found = known_runs(parts, prices, profile, w.most, key).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(code.alias("at"), "base"))).alias("near"))
    n = F.size("c")

    def step(s: Column, i: Column) -> Column:
        def total(size: Column) -> Column:
            base = F.coalesce(F.try_element_at("near", i * w.most + size), (size - 1) * w.per_cluster + (w.unknown + w.unigram * w.default_cost))
            return F.struct((base + F.get(s, n - i - size)["cost"]).alias("cost"), size.alias("size"))

        return F.array_append(s, F.array_min(F.transform(F.sequence(F.lit(1), F.least(n - i, F.lit(w.most))), total)))

    # Place i lies at n - i, as in best_paths.
    best = F.aggregate(F.sequence(n - 1, F.lit(0), F.lit(-1)), F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("size"))), step)

    def follow(s: Column) -> Column:
        size = lambda at: F.get(s, n - at)["size"]
        word = lambda at: F.array_join(F.slice("c", at + 1, size(at)), "")
        start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
        one = lambda a, _: F.when(a["at"] < n, F.struct((a["at"] + size(a["at"])).alias("at"), F.array_append(a["out"], word(a["at"])).alias("out"))).otherwise(a)
        return F.aggregate(F.sequence(F.lit(1), n), start, one, lambda a: a["out"])

    return parts.join(found, key, "left").select(key, bound(best, follow).alias("words"))


def longest(texts: DataFrame, lexicon: DataFrame, profile: ScriptProfile, most: int = Weights.most, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, words): the same as max_match(lattice(...)); only candidates that the lexicon has become rows."""
    parts = clustered(texts, profile, key, text_col)
    at = known_runs(parts, lexicon.select("word").distinct(), profile, most, key).groupBy(key, "i").agg(F.max("size").alias("size"))
    found = at.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "size"))).alias("near"))
    size = lambda at: F.coalesce(F.try_element_at("near", at), F.lit(1))
    one = lambda a, _: F.when(a["at"] < F.size("c"), F.struct((a["at"] + size(a["at"])).alias("at"), F.array_append(a["out"], F.array_join(F.slice("c", a["at"] + 1, size(a["at"])), "")).alias("out"))).otherwise(a)
    walk = F.aggregate("c", F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out")), one, lambda a: a["out"])
    return parts.join(found, key, "left").select(key, walk.alias("words"))


def filled(rows: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, parts array<(part, known)>, mode): how a token is filled from a lexicon. exact: it is a head, and its own part;
    composite: it is none, but longest matches from the left cover it; else unknown, with its single clusters as unknown
    parts."""
    heads = lexicon.select("word").distinct()
    whole = rows.filter("i = 0 and j = n").join(heads, "word", "left_semi").select(key, F.lit(True).alias("_head"), F.col("piece").alias("_whole"))
    parts = _parts(rows, heads, key).join(whole, key, "left")
    covered = ~F.exists("parts", lambda p: ~p["known"])
    mode = F.when(F.col("_head"), "exact").when(covered, "composite").otherwise("unknown")
    own = F.array(F.struct(F.col("_whole").alias("part"), F.lit(True).alias("known")))
    return parts.select(key, F.when(F.col("_head"), own).otherwise(F.col("parts")).alias("parts"), mode.alias("mode"))


def subwords(rows: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, parts): longest matches from the left inside a head, the head itself left out; only where two parts or more are
    known."""
    inner = rows.filter("not (i = 0 and j = n)")
    parts = _parts(inner, lexicon.select("word").distinct(), key)
    return parts.filter(F.size(F.filter("parts", lambda p: p["known"])) >= 2)


def _parts(rows: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    hits = rows.join(heads, "word", "left_semi").groupBy(key, "i").agg(F.max_by(F.struct("j", "piece"), "j").alias("m"))
    single = rows.filter("j = i + 1").select(key, "i", F.struct("j", "piece").alias("s"))
    at = single.join(hits, [key, "i"], "left").select(key, "i", F.coalesce("m", "s").alias("m"), F.col("m").isNotNull().alias("known"))
    ordered = at.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "m", "known"))).alias("all"))
    none = F.expr("cast(array() as array<struct<part:string,known:boolean>>)")
    walk = F.aggregate(
        "all", F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, r: F.when(r["i"] == s["at"], F.struct(r["m"]["j"].cast("int").alias("at"), F.array_append(s["out"], F.struct(r["m"]["piece"].alias("part"), r["known"].alias("known"))).alias("out"))).otherwise(s), lambda s: s["out"],
    )
    return ordered.select(key, walk.alias("parts"))


def fewest(rows: DataFrame, lexicon: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, words): of all ways to cut a text into known words one with the fewest; ties take the shortest first word. Texts
    that cannot be cut so have no row."""
    known = rows.join(lexicon.select("word").distinct(), "word", "left_semi")
    every = rows.select(key, "n", "i", "j", "piece", "word").join(known.select(key, "i", "j", F.lit(1.0).alias("base")), [key, "i", "j"], "left")
    paths = best_paths(every.withColumn("base", F.coalesce("base", F.lit(1e9))).withColumn("in_dict", F.lit(True)), key=key)
    return paths.filter(F.get("costs", F.lit(0)) < 1e9).select(key, "words")


def merged_unknown(segments: DataFrame, candidates: DataFrame, most: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, i, j, text, word): runs of up to so many neighbouring unknown segments that together are near a candidate word,
    longest first from the left, none of them in two runs. segments: (key, i, segment, is_known); candidates: (query, word,
    distance), the best word of each query."""
    w = W.partitionBy(key).orderBy("i")
    runs = segments.withColumn("run", F.sum(F.col("is_known").cast("int")).over(w)).filter("not is_known")
    at = runs.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("i", "segment"))).alias("s"))
    spans = at.select(key, "run", "s", F.explode(F.sequence(F.lit(0), F.size("s") - 1)).alias("a")).select(key, "run", "s", "a", F.explode(F.sequence(F.lit(2), F.lit(most))).alias("size"))
    spans = spans.filter("a + size <= size(s)").select(key, "run", F.element_at("s", F.col("a") + 1)["i"].alias("i"), "size", F.array_join(F.slice("s.segment", F.col("a") + 1, F.col("size")), "").alias("query"))
    best = candidates.groupBy("query").agg(F.min_by("word", F.struct("distance", "word")).alias("word"))
    longest = spans.join(best, "query").groupBy(key, "run", "i").agg(F.max_by(F.struct("size", "query", "word"), "size").alias("m"))
    ordered = longest.groupBy(key, "run").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("all"))
    walk = F.aggregate(
        "all", F.struct(F.lit(-1).cast("long").alias("at"), F.slice("all", 1, 0).alias("out")),
        lambda s, r: F.when(r["i"] >= s["at"], F.struct((r["i"] + r["m"]["size"]).cast("long").alias("at"), F.array_append(s["out"], r).alias("out"))).otherwise(s), lambda s: s["out"],
    )
    taken = ordered.select(key, F.explode(walk).alias("r"))
    return taken.select(key, F.col("r.i").alias("i"), (F.col("r.i") + F.col("r.m.size")).alias("j"), F.col("r.m.query").alias("text"), "r.m.word")


def aligned_merges(tokens: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """tokens (key, i, start, end, token) with those merged that together are exactly a dictionary span (key, start, end); spans
    that cut a token change nothing. Of spans that share a token the longest wins, then the first."""
    first = tokens.select(key, F.col("start"), F.col("i").alias("a"))
    last = tokens.select(key, F.col("end"), F.col("i").alias("b"))
    fit = spans.select(key, "start", "end").distinct().join(first, [key, "start"]).join(last, [key, "end"]).filter("b > a")
    covered = fit.select(key, "a", "b", F.explode(F.sequence("a", "b")).alias("i"))
    best = covered.groupBy(key, "i").agg(F.max_by(F.struct("a", "b"), F.struct((F.col("b") - F.col("a")).alias("n"), (-F.col("a")).alias("s"))).alias("m"))
    kept = best.groupBy(key, "m").agg(F.count("*").alias("n")).filter("n = m.b - m.a + 1").select(key, F.col("m.a").alias("a"), F.col("m.b").alias("b"))
    inside = kept.select(key, "a", F.explode(F.sequence("a", "b")).alias("i"))
    grouped = tokens.join(inside, [key, "i"], "left").groupBy(key, F.coalesce("a", "i").alias("i"))
    return grouped.agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.array_sort(F.collect_list(F.struct("start", "token")))["token"], "").alias("token"))


def joined_pieces(paths: DataFrame, lexicon: DataFrame, profile: ScriptProfile, most: int = 16, key: str = "doc_id") -> DataFrame:
    """(key, words): a predicted segmentation (key, words) whose neighbouring pieces are joined from the left, each time the longest
    run of two to `most` that is in the lexicon; no piece is cut but at punctuation and symbols, which stay alone, as does
    what holds characters of another script.

    Runs of pieces are made within a row, distinct ones meet the lexicon, and what is found goes back to the text."""
    pieces = F.flatten(F.transform("words", lambda w: F.regexp_extract_all(w, F.lit(r"[\p{P}\p{S}]|[^\p{P}\p{S}]+"), F.lit(0))))
    held = paths.select(key, pieces.alias("p")).withColumn("_ok", F.transform("p", lambda x: x.rlike(f"^[{profile.letter}]+$") & ~x.rlike(r"[\p{P}\p{S}]")))
    size = F.size("p")
    upto = lambda k: F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), F.lit(0), lambda n, d: F.when((n == d) & F.coalesce(F.get("_ok", k + d), F.lit(False)), n + 1).otherwise(n))
    runs = F.transform(F.sequence(F.lit(0), size - 1), lambda k: F.filter(F.transform(F.sequence(F.lit(2), F.lit(most)), lambda n: F.when(n <= upto(k), F.struct(n.alias("n"), F.array_join(F.slice("p", k + 1, n), "").alias("text")))), lambda r: r.isNotNull()))
    held = held.withColumn("_r", F.when(size > 0, runs)).checkpoint()
    asked = held.select(key, F.explode(F.array_distinct(F.transform(F.flatten("_r"), lambda r: r["text"]))).alias("text")).withColumn("word", profile.headword(F.col("text")))
    found = asked.join(lexicon.select("word").distinct(), "word", "left_semi").groupBy(key).agg(F.collect_set("text").alias("_known"))
    held = held.join(found, key, "left").withColumn("_known", F.coalesce("_known", F.slice("p", 1, 0)))

    def step(s: Column, k: Column) -> Column:
        best = F.array_max(F.filter(F.get("_r", k), lambda r: F.array_contains("_known", r["text"])))
        after, text = k + F.coalesce(best["n"], F.lit(1)), F.coalesce(best["text"], F.get("p", k))
        return F.when(k < s["at"], s).otherwise(F.struct(after.alias("at"), F.array_append(s["out"], text).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    walk = F.aggregate(F.sequence(F.lit(0), size - 1), start, step, lambda s: s["out"])
    return held.select(key, F.when(size > 0, walk).otherwise(F.col("p")).alias("words"))


def bilu(words):
    """Tags of each word's clusters by its number of clusters: U, or BL, B I ... L."""
    tag = lambda w: F.when(F.length(w) == 1, F.array(F.lit("U"))).otherwise(F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.when(k == 1, "B").when(k == F.length(w), "L").otherwise("I")))
    return F.flatten(F.transform(words, tag))


def decode_bilu(parts, tags):
    """Words of clusters by their tags; also of tags that contradict each other: a word begins at a B or U, and after an L or U."""
    place = F.sequence(F.lit(1), F.size(tags))
    begins = F.filter(place, lambda k: (k == 1) | F.get(tags, k - 1).isin("B", "U") | F.get(tags, k - 2).isin("L", "U"))
    words = F.transform(begins, lambda a, k: F.array_join(F.slice(parts, a, F.coalesce(F.get(begins, k + 1), F.size(tags) + 1) - a), ""))
    return F.when(F.size(tags) > 0, words).otherwise(F.slice(parts, 1, 0))
