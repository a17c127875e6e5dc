"""Part-of-speech statistics and decoding, grammar links, entity spans."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordloom.functions.tags import allowed, upos_of

LEXICAL, TRANSITION, SMOOTH, FLOOR = 1.0, 0.7, 0.1, 1e-4


def logarithm(value: Column) -> Column:
    """The natural logarithm as C's library rounds it, which engines in C share. (Spark's is another last digit for one value in
    twenty; where sums of equal logarithms tie but for their order, that digit decides between paths.) For small tables of
    statistics: an Arrow function."""

    @F.pandas_udf("double")
    def log(x: pd.Series) -> pd.Series:
        return x.map(lambda v: math.log(v) if v > 0 else None)

    return log(value.cast("double"))


def tag_stats(tagged: DataFrame) -> DataFrame:
    """(word, tag, n, p): share of each tag among a word's uses."""
    counts = tagged.groupBy("word", "tag").agg(F.count("*").alias("n"))
    return counts.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("word")))


def transitions(tagged: DataFrame, chain: str, order: str) -> DataFrame:
    """(prev, tag, n, logp): smoothed logarithms of tag after prev within a chain; a null tag breaks the chain."""
    after = tagged.withColumn("prev", F.lag("tag").over(W.partitionBy(chain).orderBy(order)))
    pairs = after.filter("prev is not null and tag is not null").groupBy("prev", "tag").agg(F.count("*").alias("n"))
    uni = tagged.filter("tag is not null").groupBy("tag").agg(F.count("*").alias("total"))
    size = uni.agg(F.count("*").alias("tags"))
    joined = pairs.join(uni.withColumnRenamed("tag", "prev"), "prev").join(F.broadcast(size))
    return joined.select("prev", "tag", "n", logarithm((F.col("n") + SMOOTH) / (F.col("total") + SMOOTH * F.col("tags"))).alias("logp"))


def viterbi(tokens: DataFrame, moves: DataFrame, key: str = "doc") -> DataFrame:
    """(key, i, tag): best tag sequence. tokens: (key, i, candidates array<struct<tag, score>>); moves: (prev, tag, logp). A token
    without candidates gets a null tag and breaks nothing; ties take the candidate named first.

    Each text meets those moves that its own candidates can make in a join, so no table is sent whole; then a sentence, which
    is bounded, is one fold that keeps the best way to each candidate, and one fold back."""
    held = tokens.select(key, "i", F.expr("coalesce(candidates, slice(array(named_struct('tag', '', 'score', 0d)), 1, 0))").alias("c"))
    texts = held.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("t"))
    own = texts.select(key, F.array_distinct(F.flatten(F.transform("t", lambda x: x["c"]["tag"]))).alias("g"))
    pairs = own.select(key, "g", F.explode("g").alias("prev")).select(key, "prev", F.explode("g").alias("tag"))
    near = pairs.join(moves.select("prev", "tag", "logp"), ["prev", "tag"]).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "prev", "tag"), "logp"))).alias("near"))
    floor = F.lit(math.log(FLOOR))
    none = F.expr("cast(array() as array<struct<score:double,tag:string,from:string>>)")

    def step(s, x):
        def reached(c):
            ways = F.transform(s["at"], lambda p, k: F.struct((p["score"] + TRANSITION * F.coalesce(F.try_element_at("near", F.concat_ws("\u0001", p["tag"], c["tag"])), floor) + c["score"]).alias("score"), (-k).alias("k"), p["tag"].alias("from")))
            best = F.array_max(ways)
            return F.struct(F.coalesce(best["score"], c["score"].cast("double")).alias("score"), c["tag"].alias("tag"), best["from"].alias("from"))

        now = F.transform(x["c"], reached)
        return F.struct(F.when(F.size(now) > 0, now).otherwise(s["at"]).alias("at"), F.array_append(s["all"], now).alias("all"))

    best = F.aggregate("t", F.struct(none.alias("at"), F.slice(F.array(none), 1, 0).alias("all")), step)
    last = lambda s: F.array_max(F.transform(s["at"], lambda p, k: F.struct(p["score"], -k, p["tag"].alias("tag"))))["tag"]

    def back(s, x):
        chosen = F.get(F.filter(x, lambda c: c["tag"] == s["want"]), F.lit(0))
        return F.struct(F.when(F.size(x) > 0, chosen["from"]).otherwise(s["want"]).alias("want"), F.array_append(s["tags"], F.when(F.size(x) > 0, s["want"])).alias("tags"))

    done = texts.join(near, key, "left").withColumn("near", F.coalesce("near", F.expr("cast(map() as map<string,double>)"))).select(key, "t", best.alias("s"))
    start = F.struct(last(F.col("s")).alias("want"), F.expr("cast(array() as array<string>)").alias("tags"))
    tags = F.aggregate(F.reverse("s.all"), start, back, lambda s: F.reverse(s["tags"]))
    return done.select(key, F.explode(F.arrays_zip(F.col("t")["i"].alias("i"), tags.alias("tag"))).alias("x")).select(key, F.col("x.i").alias("i"), F.col("x.tag").alias("tag"))


def lexical_score(p, single, numeric, tag):
    """Local score of a tag: logarithm of its share for the word, a little for a single candidate and for numerals."""
    s = F.when(p.isNull(), 0.0).otherwise(LEXICAL * F.ln(F.greatest(p, F.lit(FLOOR)))) + F.when(single, 0.5).otherwise(0.0)
    return s + F.when(numeric & tag.isin("kjano", "n"), 0.5).when(numeric & tag.isin("v", "adj"), -0.5).otherwise(0.0)


def neighbour_links(tokens: DataFrame, rules: DataFrame, key: str = "doc") -> DataFrame:
    """(key, from, to, role): each function token linked to its first neighbour, in the rule's direction and distance,
    whose part of speech the rule wants. tokens: (key, i, type, pos array); rules: (type, role, direction, wanted array,
    distance). BOTH looks left before right. Rules join the few tokens that have a type; targets are an equi-join over the
    places within a rule's distance."""
    ruled = tokens.filter("type is not null").join(F.broadcast(rules.filter("direction <> 'NONE'")), "type")
    steps = F.flatten(F.transform(F.sequence(F.lit(1), F.col("distance")), lambda d: F.when(F.col("direction") == "LEFT", F.array(-d)).when(F.col("direction") == "RIGHT", F.array(d)).otherwise(F.array(-d, d))))
    looked = ruled.select(key, F.col("i").alias("from"), "type", "role", "wanted", F.posexplode(steps).alias("nth", "step")).withColumn("to", F.col("from") + F.col("step"))
    target = tokens.select(key, F.col("i").alias("to"), F.col("pos").alias("_pos"))
    hit = looked.join(target, [key, "to"]).filter(F.arrays_overlap("_pos", "wanted") | (F.array_contains("wanted", "NUM") & F.array_contains("_pos", "UNKNOWN")))
    return hit.groupBy(key, "from", "type", "role").agg(F.min_by("to", "nth").alias("to")).select(key, "from", "to", "type", "role")


def overlap(spans: DataFrame, segments: DataFrame, key: str = "doc", width: int = 64) -> DataFrame:
    """(key, span_id, first, last): segments that a span overlaps (s < end and e > start). Both sides are cut into bins of
    a width, so the range join is an equi-join on document and bin; a pair that shares several bins is counted once."""
    def cells(end):
        return F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.greatest(F.col(end), F.col("start") + 1) - 1) / width)))

    a = spans.select(key, "span_id", "start", "end", cells("end").alias("bin"))
    b = segments.select(key, F.col("seg_i"), "start", "end", cells("end").alias("bin")).withColumnsRenamed({"start": "s", "end": "e"})
    hit = a.join(b, [key, "bin"]).filter("s < end and e > start")
    return hit.groupBy(key, "span_id").agg(F.min("seg_i").alias("first"), F.max("seg_i").alias("last"))


def override(logits: DataFrame, permitted: DataFrame, key: str = "doc") -> DataFrame:
    """(key, i, tag, changed): the predicted tag if the dictionary allows it, else the allowed tag of the greatest logit.
    logits: (key, i, label, logit); permitted: (key, i, tags array), null or empty where nothing is known."""
    best = logits.groupBy(key, "i").agg(F.max_by("label", F.struct("logit", "label")).alias("guess"))
    ok = logits.join(permitted, [key, "i"], "left").filter(F.array_contains("tags", F.col("label"))).groupBy(key, "i").agg(F.max_by("label", F.struct("logit", "label")).alias("best"))
    both = best.join(ok, [key, "i"], "left")
    return both.select(key, "i", F.coalesce("best", "guess").alias("tag"), (F.coalesce("best", "guess") != F.col("guess")).alias("changed"))


def nearest_kept(tokens: DataFrame, kept, key: str = "doc") -> DataFrame:
    """(key, i, to): for each dropped token the nearest kept one, the left one if both are as near."""
    w = W.partitionBy(key).orderBy("i")
    place = F.when(kept, F.col("i"))
    t = tokens.withColumn("_l", F.last(place, ignorenulls=True).over(w)).withColumn("_r", F.last(place, ignorenulls=True).over(W.partitionBy(key).orderBy(F.desc("i")).rowsBetween(W.unboundedPreceding, 0)))
    to = F.when(F.col("_r").isNull() | (F.col("i") - F.col("_l") <= F.col("_r") - F.col("i")), F.coalesce("_l", "_r")).otherwise(F.col("_r"))
    return t.filter(~kept).select(key, "i", to.alias("to"))


def confidence(scores: DataFrame, key: list[str]) -> DataFrame:
    """(key, tag, confidence): the best tag, and how sure it is by its lead over the second one; 1 if it has no rival."""
    top = scores.groupBy(*key).agg(F.max_by("tag", F.struct("score", "tag")).alias("tag"), F.slice(F.sort_array(F.collect_list("score"), asc=False), 1, 2).alias("two"))
    lead = F.get("two", F.lit(0)) - F.get("two", F.lit(1))
    steps = F.when(lead.isNull() | (lead >= 4.0), 1.0).when(lead >= 2.0, 0.85).when(lead >= 1.0, 0.6).when(lead >= 0.5, 0.4).otherwise(0.25)
    return top.select(*key, "tag", steps.alias("confidence"))


def certainty_weight(certainty, low: float = 0.40, high: float = 0.85):
    """A predictor's weight against the dictionary's: half up to the low certainty, all from the high one, linear between."""
    return 0.5 + 0.5 * F.least(F.greatest((certainty - low) / (high - low), F.lit(0.0)), F.lit(1.0))


def decided(fills: DataFrame, key: str = "token") -> DataFrame:
    """(key, allowed, source): which universal tags the dictionary fills (key, label[, locked, has_unknown, mode]) of a token allow:
    none where it is locked (source locked), where a piece of it is unknown (has_unknown), where no fill has a tag (no_pos), or
    where some of several have none (partial); else all tags of its fills and those that count as equal (single, multi_fill).
    With a mode, how the fills came about, all but locked and no_pos are named after it (exact:single)."""
    tags_ = upos_of(F.col("label"))
    told_by = lambda c, none: F.col(c) if c in fills.columns else none
    locked = F.bool_or(F.coalesce(told_by("locked", F.lit(False)), F.lit(False)))
    unknown, mode = F.bool_or(F.coalesce(told_by("has_unknown", F.lit(False)), F.lit(False))), F.max(told_by("mode", F.lit(None).cast("string")))
    told = fills.withColumn("_t", tags_).groupBy(key).agg(
        F.array_distinct(F.flatten(F.collect_list("_t"))).alias("_u"), F.bool_and(F.size("_t") == 0).alias("_none"), F.bool_or(F.size("_t") == 0).alias("_some"), F.count("*").alias("_n"), locked.alias("_l"), unknown.alias("_k"), mode.alias("_m")
    )
    kind = F.when(F.col("_k"), "has_unknown").when((F.col("_n") > 1) & F.col("_some"), "partial").when(F.col("_n") > 1, "multi_fill").otherwise("single")
    source = F.when(F.col("_l"), "locked").when(~F.col("_k") & F.col("_none"), "no_pos").otherwise(F.concat(F.coalesce(F.concat("_m", F.lit(":")), F.lit("")), kind))
    free = F.col("_l") | F.col("_k") | F.col("_none") | ((F.col("_n") > 1) & F.col("_some"))
    return told.select(key, F.when(free, F.expr("cast(array() as array<string>)")).otherwise(allowed(F.col("_u"))).alias("allowed"), source.alias("source"))


def override_counts(guesses: DataFrame, counts: DataFrame, key: str = "doc") -> DataFrame:
    """(key, i, tag, changed): a guess (key, i, label) that is among the counted tags (key, i, label, n) stays; else the most
    frequent of them; without any it stays."""
    best = counts.groupBy(key, "i").agg(F.max_by("label", F.struct("n", "label")).alias("best"), F.collect_set("label").alias("_all"))
    g = guesses.join(best, [key, "i"], "left")
    keep = F.col("_all").isNull() | F.array_contains("_all", F.col("label"))
    return g.select(key, "i", F.when(keep, F.col("label")).otherwise(F.col("best")).alias("tag"), (~keep).alias("changed"))


def blended(logits: DataFrame, parts: DataFrame, key: str = "doc") -> DataFrame:
    """(key, i, tag, score): for compounds, of the tags that the parts allow (key, i, label, score) the best by half of the
    token's own score, which is its logit moved above 0 and scaled to 1 at most, and half of the parts', scaled so, too."""
    every = W.partitionBy(key, "i")
    own = logits.groupBy(key, "i", "label").agg(F.sum("logit").alias("v")).withColumn("v", F.col("v") - F.least(F.min("v").over(every), F.lit(0.0)))
    own = own.withColumn("own", F.coalesce(F.col("v") / F.nullif(F.max("v").over(every), F.lit(0.0)), F.lit(0.0))).select(key, "i", "label", "own")
    sub = parts.withColumn("sub", F.coalesce(F.col("score") / F.nullif(F.max("score").over(every), F.lit(0.0)), F.lit(0.0))).select(key, "i", "label", "sub")
    both = sub.join(own, [key, "i", "label"], "left").withColumn("score", 0.5 * F.coalesce("own", F.lit(0.0)) + 0.5 * F.col("sub"))
    rank = F.row_number().over(every.orderBy(F.desc("score"), "label"))
    return both.withColumn("_r", rank).filter("_r = 1").select(key, "i", F.col("label").alias("tag"), "score")


def subword_scores(parts: DataFrame, key: str = "doc") -> DataFrame:
    """(key, i, label, score): tag scores (key, i, part, label, logit) of a compound's parts put together: each part's are moved
    above 0 and made to add up to 1, averaged over the parts, and scaled to 1 at most."""
    one = W.partitionBy(key, "i", "part")
    s = parts.withColumn("v", F.col("logit") - F.least(F.min("logit").over(one), F.lit(0.0)))
    s = s.withColumn("v", F.coalesce(F.col("v") / F.nullif(F.sum("v").over(one), F.lit(0.0)), F.lit(0.0)))
    n = parts.groupBy(key, "i").agg(F.count_distinct("part").alias("_n"))
    mean = s.groupBy(key, "i", "label").agg(F.sum("v").alias("v")).join(n, [key, "i"]).withColumn("v", F.col("v") / F.col("_n"))
    return mean.select(key, "i", "label", F.coalesce(F.col("v") / F.nullif(F.max("v").over(W.partitionBy(key, "i")), F.lit(0.0)), F.lit(0.0)).alias("score"))


def grammar_overlay(tokens: DataFrame, entries: DataFrame, rules: DataFrame, key: str = "doc") -> DataFrame:
    """(key, i, category, type, gloss, active, target, direction): one row for each grammar entry (token, category, type, gloss) of
    a token (key, i, token, pos array); an entry is active where its type's rule finds a neighbour."""
    own = tokens.join(entries, "token").select(key, "i", "token", "category", "type", "gloss")
    typed = own.select(key, "i", "type").distinct().join(tokens.select(key, "i", "pos"), [key, "i"])
    rest = tokens.select(key, "i", "pos").join(typed.select(key, "i"), [key, "i"], "left_anti").withColumn("type", F.lit(None).cast("string"))
    links = neighbour_links(typed.select(key, "i", "type", "pos").unionByName(rest.select(key, "i", "type", "pos")).dropDuplicates([key, "i", "type"]), rules, key)
    hit = links.select(key, F.col("from").alias("i"), "type", F.col("to").alias("target"), "role")
    out = own.join(hit, [key, "i", "type"], "left")
    return out.select(key, "i", "category", "type", "gloss", F.col("target").isNotNull().alias("active"), "target", F.when(F.col("target") < F.col("i"), "left").when(F.col("target") > F.col("i"), "right").alias("direction"))


def off_last_islands(entities: DataFrame, islands: DataFrame, key: str = "doc") -> DataFrame:
    """entities (key, start, end, ...) without those that touch the last island of the sentence that they begin in; islands: (key,
    sentence, sent_start, sent_end, start, end)."""
    last = islands.groupBy(key, "sentence", "sent_start", "sent_end").agg(F.max_by(F.struct("start", "end"), "start").alias("_l"))
    l = last.select(F.col(key).alias("_k"), "sent_start", "sent_end", F.col("_l.start").alias("_s"), F.col("_l.end").alias("_e"))
    in_sentence = (F.col(key) == F.col("_k")) & (F.col("start") >= F.col("sent_start")) & (F.col("start") < F.col("sent_end"))
    return entities.join(l, in_sentence & (F.col("start") < F.col("_e")) & (F.col("end") > F.col("_s")), "left_anti")


def flagged_fills(fills: DataFrame, entities: DataFrame, key: str = "doc") -> DataFrame:
    """fills (key, i, ...) with ner_protected and ner_label anew: those of the last entity (key, start, end, label) over a segment."""
    inside = entities.filter("end > start").select(key, "start", "label", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"))
    flags = inside.groupBy(key, "i").agg(F.max_by("label", "start").alias("ner_label"))
    out = fills.drop("ner_protected", "ner_label").join(flags.withColumn("_f", F.lit(True)), [key, "i"], "left")
    return out.withColumn("ner_protected", F.coalesce("_f", F.lit(False))).drop("_f")


def collapsed(segments: DataFrame, runs: DataFrame, key: str = "doc") -> DataFrame:
    """(key, p, text, members, label): segments (key, i, segment) with each entity run (key, first, last, label) as one token, and
    the places that each stands for; runs do not overlap."""
    inside = runs.select(key, "first", "label", F.explode(F.sequence("first", "last")).alias("i"))
    at = segments.join(inside, [key, "i"], "left")
    one = at.groupBy(key, F.coalesce("first", "i").alias("_f")).agg(F.array_sort(F.collect_list(F.struct("i", "segment"))).alias("s"), F.first("label", ignorenulls=True).alias("label"))
    return one.select(key, (F.row_number().over(W.partitionBy(key).orderBy("_f")) - 1).alias("p"), F.array_join("s.segment", "").alias("text"), F.col("s.i").alias("members"), "label")


def expanded_overlay(overlay: DataFrame, key: str = "doc") -> DataFrame:
    """A parser's tokens (key, i, seg_span array or null, ...) as one row for each segment that they stand for."""
    return overlay.withColumn("segment", F.explode(F.coalesce("seg_span", F.array("i")))).filter("segment >= 0").drop("seg_span")
