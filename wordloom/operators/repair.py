"""Segmentation of scanned text: unknown segments are corrected, texts that changed are cut again, and a second segmentation
decides what is still unknown.

A segment is known if the lexicon has it; it is open if it is unknown and of the script alone. Distinct segments meet the
lexicon and their candidates in joins, and what a text needs of them goes back to it as one map; the rest happens within a
text's array, in one fold. Texts are bounded, as in segment. A null text counts as empty and has no segments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordloom.functions.clean import script_nfc
from wordloom.functions.profile import ScriptProfile
from wordloom.operators import lm, search, segment

VIRAMA = "္"


def cleaned_token(token: Column) -> Column:
    """A token in canonical form, repeated viramas once, and none at its end unless it is all there is."""
    once = F.regexp_replace(script_nfc(token), f"{VIRAMA}+", VIRAMA)
    bare = F.regexp_replace(once, f"(?<=.){VIRAMA}$", "")
    return F.when(bare != "", bare).otherwise(token)


def known_in(texts: DataFrame, words: DataFrame, items: str, out: str, key: str) -> DataFrame:
    """texts with out: those of its items that words has. Each text asks once for each distinct item."""
    asked = texts.select(key, F.explode_outer(F.array_distinct(items)).alias("word")).join(lm.sent(words.select("word").distinct()), "word", "left_semi")
    found = asked.groupBy(key).agg(F.collect_set("word").alias(out))
    return texts.join(found, key, "left").withColumn(out, F.coalesce(out, F.slice(items, 1, 0)))


def best_of(found: DataFrame) -> DataFrame:
    """(query, word): the most similar word; ties take the shorter one, then the lesser."""
    return found.groupBy("query").agg(F.min_by("word", F.struct(-F.col("similarity"), F.length("word"), "word")).alias("word"))


def corrections(segments: DataFrame, runs: DataFrame, lexicon: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(query, word) of single segments (a column query), and of joined runs. A single one is cleaned, and if it is unknown still,
    becomes the most similar word of its first character, at most two edits and one character of length away, 0.6 similar;
    a run the like at three edits, two characters, 0.5. Words and queries of one character have none."""
    words = lexicon.select("word").distinct().filter(F.length("word") > 1)
    once = segments.select("query").distinct().withColumn("clean", cleaned_token(F.col("query"))).checkpoint()
    known = once.join(words.select(F.col("word").alias("clean")), "clean", "left_semi").select("query", F.col("clean").alias("word"))
    asked = once.join(known.select("query"), "query", "left_anti")
    near = search.within(asked.filter(F.length("clean") > 1).select(F.col("clean").alias("query")), words, 2)
    fits = (F.left("query", F.lit(1)) == F.left("word", F.lit(1))) & (F.abs(F.length("query") - F.length("word")) <= 1) & (F.col("similarity") >= 0.6)
    best = best_of(search.similar(near).filter(fits)).withColumnRenamed("query", "clean")
    single = known.unionByName(asked.join(best, "clean", "left").select("query", F.coalesce("word", "clean").alias("word"))).filter("query <> word")
    joined = best_of(search.blocked(runs.select("query").filter(F.length("query") > 1), words, 2, 3, 0.5))
    # A run that is a word as it stands is its own best candidate.
    whole = runs.select("query").distinct().join(words.withColumnRenamed("word", "query"), "query", "left_semi").select("query", F.col("query").alias("word"))
    return single, whole.unionByName(joined.join(whole, "query", "left_anti"))


def corrected(paths: DataFrame, lexicon: DataFrame, profile: ScriptProfile, most: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, pieces array<(text, original, method)>, changed): segments (key, words array) from the left, open ones corrected. Where
    another open one follows, up to `most` of them are tried as one word first (greedy_merge); else, or if there is none
    for them, the one segment is corrected (spell_correct). Others stay, with a null method; texts without an open one take no
    further part."""
    held = known_in(paths.select(key, "words"), lexicon, "words", "_known", key)
    script = lambda w: w.rlike(f"^[\\s{profile.letter}]+$") & w.rlike(f"[{profile.letter}]")
    is_open = F.transform("words", lambda w: script(w) & ~F.array_contains("_known", w))
    held = held.filter(F.size("words") > 0).withColumn("_open", is_open).drop("_known").checkpoint()
    piece = lambda text, original, method: F.struct(text.alias("text"), original.alias("original"), method.cast("string").alias("method"))
    none_open = ~F.exists("_open", lambda x: x)
    closed = held.filter(none_open).select(key, F.transform("words", lambda w: piece(w, w, F.lit(None))).alias("pieces"), F.lit(False).alias("changed"))
    held = held.filter(~none_open)

    def run(k: Column) -> Column:
        """How many open segments begin at place k (from 0), `most` at most."""
        return F.aggregate(F.sequence(F.lit(0), F.lit(most - 1)), F.lit(0), lambda n, d: F.when((n == d) & F.coalesce(F.get("_open", k + d), F.lit(False)), n + 1).otherwise(n))

    place = F.sequence(F.lit(0), F.size("words") - 1)
    runs = F.transform(place, lambda k: F.struct(run(k).alias("n"), F.array_join(F.slice("words", k + 1, F.greatest(run(k), F.lit(1))), "").alias("text")))
    held = held.withColumn("_runs", runs).checkpoint()
    singles = held.select(F.explode(F.filter("words", lambda w, k: F.get("_open", k))).alias("query"))
    joined = held.select(F.explode(F.filter("_runs", lambda r: r["n"] > 1)).alias("r")).select(F.col("r.text").alias("query"))
    one, several = corrections(singles, joined, lexicon)

    def given(answers: DataFrame, items: Column, name: str) -> DataFrame:
        asked = held.select(key, F.explode(F.array_distinct(items)).alias("query")).join(answers, "query")
        return asked.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("query", "word"))).alias(name))

    held = held.join(given(one, F.filter("words", lambda w, k: F.get("_open", k)), "_one"), key, "left")
    held = held.join(given(several, F.transform(F.filter("_runs", lambda r: r["n"] > 1), lambda r: r["text"]), "_several"), key, "left")
    none = F.expr("cast(map() as map<string,string>)")
    held = held.withColumn("_one", F.coalesce("_one", none)).withColumn("_several", F.coalesce("_several", none))

    def step(s: Column, k: Column) -> Column:
        word, r = F.get("words", k), F.get("_runs", k)
        merged = F.when(r["n"] > 1, F.try_element_at("_several", r["text"]))
        single = F.when(F.get("_open", k), F.try_element_at("_one", word))
        new = F.when(merged.isNotNull(), piece(merged, r["text"], F.lit("greedy_merge"))).when(single.isNotNull(), piece(single, word, F.lit("spell_correct"))).otherwise(piece(word, word, F.lit(None)))
        after = k + F.when(merged.isNotNull(), r["n"]).otherwise(1)
        return F.when(k < s["at"], s).otherwise(F.struct(after.alias("at"), F.array_append(s["out"], new).alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<text:string,original:string,method:string>>)").alias("out"))
    done = held.select(key, F.aggregate(place, start, step, lambda s: s["out"]).alias("pieces"))
    return done.withColumn("changed", F.exists("pieces", lambda p: p["method"].isNotNull())).unionByName(closed)


def repaired(paths: DataFrame, lexicon: DataFrame, cut, profile: ScriptProfile, most: int = 3, key: str = "doc_id") -> DataFrame:
    """(key, words, marks): texts after correction. Those that changed are cut again by cut((key, text)) -> (key, words); the others
    keep their segments. marks: (start, end, text, original, method) of each correction, by its place in the corrected text."""
    fixed = corrected(paths, lexicon, profile, most, key).checkpoint()
    again = cut(fixed.filter("changed").select(key, F.array_join("pieces.text", "").alias("text"))).select(key, F.col("words").alias("_again"))
    ends = F.aggregate("pieces", F.array(F.lit(0)), lambda s, p: F.array_append(s, F.element_at(s, -1) + F.length(p["text"])))
    mark = lambda p, k: F.struct(F.get("_ends", k).alias("start"), F.get("_ends", k + 1).alias("end"), p["text"].alias("text"), p["original"].alias("original"), p["method"].alias("method"))
    placed = fixed.withColumn("_ends", ends).withColumn("marks", F.filter(F.transform("pieces", mark), lambda m: m["method"].isNotNull()))
    return placed.join(again, key, "left").select(key, F.coalesce("_again", "pieces.text").alias("words"), "marks")


def is_unknown(word: Column, profile: ScriptProfile) -> Column:
    """Whether a word that holds a character of the script is not among _known."""
    return word.rlike(f"[{profile.letter}]") & ~F.array_contains("_known", word)


def placed_words(words: Column) -> Column:
    """words as (start, end, text)."""
    ends = F.aggregate(words, F.array(F.lit(0)), lambda s, w: F.array_append(s, F.element_at(s, -1) + F.length(w)))
    return F.transform(words, lambda w, k: F.struct(F.get(ends, k).alias("start"), F.get(ends, k + 1).alias("end"), w.alias("text")))


def arbitrated(first: DataFrame, second: DataFrame, lexicon: DataFrame, profile: ScriptProfile, least: int = 1, strict: bool = False, key: str = "doc_id") -> DataFrame:
    """(key, words): the first segmentation (key, words), but where a run of `least` or more unknown segments begins and ends at cuts
    of the second one, that one's words, if they hold as many known ones (strict: if they are one word). Segments without a
    character of the script are no unknown ones. A second segmentation of another text, or none, changes nothing.

    Both segmentations are intervals of one text; the ends that both share bound the cells in which one stands for the other,
    so a run asks two sorted arrays for its own ends, and the chosen intervals are put in order."""
    held = first.select(key, F.col("words").alias("_w1")).join(second.select(key, F.col("words").alias("_w2")), key, "left")
    same = F.coalesce(F.array_join("_w1", "") == F.array_join("_w2", ""), F.lit(False))
    held = held.withColumn("_w2", F.when(same, F.col("_w2")).otherwise(F.slice("_w1", 1, 0)))
    held = known_in(held.withColumn("_all", F.concat("_w1", "_w2")).checkpoint(), lexicon, "_all", "_known", key).withColumn("_a", placed_words(F.col("_w1"))).withColumn("_b", placed_words(F.col("_w2")))
    unknown = lambda t: is_unknown(t["text"], profile)
    run = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit(0).alias("n"))

    def step(s: Column, t: Column) -> Column:
        last = F.element_at(s, -1)
        longer = F.struct(last["start"].alias("start"), t["end"].alias("end"), (last["n"] + 1).alias("n"))
        own = F.struct(t["start"].alias("start"), t["end"].alias("end"), F.lit(1).alias("n"))
        grows = (last["n"] > 0) & (last["end"] == t["start"])
        return F.when(~unknown(t), s).when(grows, F.array_append(F.slice(s, 1, F.size(s) - 1), longer)).otherwise(F.array_append(s, own))

    runs = F.filter(F.aggregate("_a", F.array(run), step), lambda r: r["n"] >= F.greatest(F.lit(least), F.lit(1)))
    inside = lambda t, r: (t["start"] >= r["start"]) & (t["end"] <= r["end"])
    meets = lambda r: F.exists("_b", lambda t: t["start"] == r["start"]) & F.exists("_b", lambda t: t["end"] == r["end"])
    others = lambda r: F.filter("_b", lambda t: inside(t, r))
    taken = F.filter(runs, lambda r: meets(r) & (F.size(others(r)) == 1) if strict else meets(r))
    held = held.withColumn("_runs", taken)
    in_run = lambda t: F.exists("_runs", lambda r: inside(t, r))
    chosen = F.array_sort(F.concat(F.filter("_a", lambda t: ~in_run(t)), F.filter("_b", in_run)))
    return held.select(key, F.transform(chosen, lambda t: t["text"]).alias("words"))


def scanned(texts: DataFrame, lexicon: DataFrame, costs: DataFrame, profile: ScriptProfile, most: int = 3, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, words, marks): texts cut by the cheapest path, corrected, cut again where they changed, and arbitrated by longest
    matches, which only texts that still hold an unknown segment ask for. lexicon: (word); costs: (token, cost)."""
    cut = lambda t, c="text": segment.cheapest(t, lexicon, costs, profile, key=key, text_col=c)
    fixed = repaired(cut(texts, text_col).checkpoint(), lexicon, cut, profile, most, key).checkpoint()
    unsure = F.exists("words", lambda w: is_unknown(w, profile))
    held = known_in(fixed, lexicon, "words", "_known", key).select(key, "words", "marks", unsure.alias("_unsure")).checkpoint()
    asked, sure = held.filter("_unsure").drop("_unsure"), held.filter("not _unsure").drop("_unsure")
    matched = segment.longest(asked.select(key, F.array_join("words", "").alias("text")), lexicon, profile, key=key)
    return arbitrated(asked, matched, lexicon, profile, key=key).join(asked.select(key, "marks"), key).unionByName(sure)
