"""The whole analysis of a text: islands, segmentation of each, unknown runs merged, entries, offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordloom.functions.profile import ScriptProfile
from wordloom.functions.text import char_spans
from wordloom.operators.lexicon import lookup
from wordloom.operators.segment import Weights, best_paths, lattice, priced


def segments(docs: DataFrame, profile: ScriptProfile, lexicon: DataFrame, costs: DataFrame | None = None, w: Weights = Weights(), merge: bool = True, pairs: DataFrame | None = None, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, island, i, segment, is_known): script runs cut by the cheapest path, marks between them as they are.

    Equal runs are cut once, however often they occur. Neighbouring unknown segments of a run become one."""
    marks = f"[^\\s\\u200B-\\u200D\\uFEFF0-9A-Za-z{profile.letter}]|[{profile.enders}၊]"
    found = F.regexp_extract_all(profile.norm(F.col(text_col)), F.lit(f"{profile.word}|{marks}"), F.lit(0))
    runs = docs.select(key, F.posexplode(found).alias("island", "run")).withColumn("is_word", F.col("run").rlike(f"^{profile.word}$"))
    distinct = runs.filter("is_word").select(F.col("run").alias("text")).distinct()
    cut = best_paths(priced(lattice(distinct, profile, w.most, "text", "text"), lexicon, costs, w, profile), pairs, w, "text")
    parts = cut.select(F.col("text").alias("run"), F.posexplode("words").alias("k", "segment")).withColumn("word", profile.headword(F.col("segment")))
    words = lexicon.select("word", F.lit(True).alias("is_known")).distinct()
    parts = parts.join(words, "word", "left").select("run", "k", "segment", F.coalesce("is_known", F.lit(False)).alias("is_known"))
    if merge:
        order = W.partitionBy("run").orderBy("k")
        breaks = F.when(F.col("is_known") | F.coalesce(F.lag("is_known").over(order), F.lit(True)), 1).otherwise(0)
        parts = parts.withColumn("_b", breaks).withColumn("_g", F.sum("_b").over(order)).groupBy("run", "_g").agg(
            F.min("k").alias("k"), F.array_join(F.array_sort(F.collect_list(F.struct("k", "segment")))["segment"], "").alias("segment"), F.first("is_known").alias("is_known")
        ).drop("_g")
    whole = runs.join(parts, "run", "left").select(key, "island", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("segment", "run").alias("segment"), F.coalesce("is_known", F.lit(False)).alias("is_known"))
    return whole.withColumn("i", F.row_number().over(W.partitionBy(key).orderBy("island", "k")) - 1).select(key, "island", "i", "segment", "is_known")


def analysed(docs: DataFrame, profile: ScriptProfile, entries: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, island, i, segment, start, end, headword, layer, roman, pos, senses): segments with their spans in the text and
    the winning lexicon entry of each."""
    got = segments(docs, profile, entries.select(F.col("headword").alias("word"), F.col("layer").alias("source")), key=key, text_col=text_col)
    listed = got.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "segment"))).alias("s"))
    spans = docs.select(key, profile.norm(F.col(text_col)).alias("_t")).join(listed, key).select(key, F.posexplode(char_spans(F.col("_t"), F.col("s.segment"))).alias("i", "span"))
    placed = got.join(spans, [key, "i"]).withColumn("token", profile.headword(F.col("segment")))
    found = lookup(placed, entries)
    return found.select(key, "island", "i", "segment", F.col("span.start").alias("start"), F.col("span.end").alias("end"), "headword", "layer", "roman", "pos", "senses")


def laid_out(docs: DataFrame, profile: ScriptProfile, lexicon: DataFrame, costs: DataFrame | None = None, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, text): each text as it stands, with spaces between the words inside runs of the script. Line by line files are
    texts of one line each."""
    found = F.regexp_extract_all(profile.norm(F.col(text_col)), F.lit(f"{profile.word}|[^{profile.letter}]+|."), F.lit(0))
    runs = docs.select(key, F.posexplode_outer(found).alias("k", "run"))
    is_word = F.col("run").rlike(f"^{profile.word}$")
    distinct = runs.filter(is_word).select(F.col("run").alias("text")).distinct()
    cut = best_paths(priced(lattice(distinct, profile, Weights().most, "text", "text"), lexicon, costs, profile=profile), key="text")
    spaced = cut.select(F.col("text").alias("run"), F.array_join("words", " ").alias("spaced"))
    parts = runs.join(spaced, "run", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("k", F.coalesce("spaced", "run").alias("p")))).alias("all"))
    return parts.select(key, F.array_join("all.p", "").alias("text"))
