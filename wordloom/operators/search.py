"""Approximate search by edit distance: an equi-join over what is left after deletions, then the exact distance.

Two words within d edits share a string that both reach by at most d deletions. So the deletion variants of both sides
are joined, with full recall, and the distance is computed for those pairs alone; no pair of unlike words ever meets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordloom.operators.lm import transition_costs


def deletions(word: Column, most: int) -> Column:
    """Distinct strings that up to `most` deletions make of a word, itself included."""
    one = lambda w: F.when(F.length(w) > 0, F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.substring(w, k + 1, F.length(w))))).otherwise(F.array(w))
    out = layer = F.array(word)
    for _ in range(most):
        layer = F.array_distinct(F.flatten(F.transform(layer, one)))
        out = F.concat(out, layer)
    return F.array_distinct(out)


def within(queries: DataFrame, words: DataFrame, most: int, query_col: str = "query", word_col: str = "word") -> DataFrame:
    """(query, word, distance) of all pairs of distinct values within `most` edits."""
    q = queries.select(F.col(query_col).alias("query")).distinct().select("query", F.explode(deletions(F.col("query"), most)).alias("_k"))
    w = words.select(F.col(word_col).alias("word")).distinct().select("word", F.explode(deletions(F.col("word"), most)).alias("_k"))
    pairs = q.join(w, "_k").select("query", "word").distinct()
    return pairs.withColumn("distance", F.levenshtein("query", "word", most)).filter("distance >= 0")


def closest(found: DataFrame, costs: DataFrame, k: int = 5) -> DataFrame:
    """Only the least distance of each query, then the cheapest words, then by name; rank from 1. costs: (word, cost)."""
    tier = W.partitionBy("query").orderBy("distance")
    kept = found.withColumn("_t", F.rank().over(tier)).filter("_t = 1").drop("_t").join(costs, "word", "left")
    order = W.partitionBy("query").orderBy(F.col("cost").asc_nulls_last(), "word")
    return kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def similar(found: DataFrame) -> DataFrame:
    """found with similarity, without the words that equal their query."""
    size = F.greatest(F.length("query"), F.length("word"))
    return found.filter("distance > 0").withColumn("similarity", 1 - F.col("distance") / size)


def reranked(found: DataFrame, costs: DataFrame, pool: int = 50, k: int = 5) -> DataFrame:
    """The pool of each query by distance and similarity, then by half the distance and half the model's cost; of the first
    k, score is the softmax of the negative totals. costs: (word, cost), or (query, word, cost) where the cost depends on
    the query's neighbours (in_context)."""
    first = W.partitionBy("query").orderBy("distance", F.desc("similarity"), "word")
    held = similar(found).withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= pool)
    held = held.join(costs, [c for c in ("query", "word") if c in costs.columns], "left")
    held = held.withColumn("total", 0.5 * F.col("distance") + 0.5 * F.coalesce("cost", F.lit(12.0)))
    every = W.partitionBy("query")
    rank = F.row_number().over(every.orderBy("total", "distance", F.desc("similarity"), "word"))
    kept = held.withColumn("rank", rank).filter(F.col("rank") <= k)
    kept = kept.withColumn("_e", F.exp(F.min("total").over(every) - F.col("total"))).withColumn("score", F.col("_e") / F.sum("_e").over(every))
    return kept.select("query", "word", "distance", "similarity", "total", "score", "rank")


def in_context(found: DataFrame, context: DataFrame, words: tuple, pairs: tuple) -> DataFrame:
    """(query, word, cost): the mean of the costs of the pairs with the words before and after the query (context: query,
    before, after; either may be null), or of the one there is; without both the word's own cost. words and pairs as in
    lm.transition_costs."""
    placed = found.filter("distance > 0").join(context, "query", "left")
    left = placed.filter("before is not null").select(F.col("before").alias("w1"), F.col("word").alias("w2"))
    right = placed.filter("after is not null").select(F.col("word").alias("w1"), F.col("after").alias("w2"))
    moves = transition_costs(left.unionByName(right).distinct(), words, pairs).select("w1", "w2", "cost")
    before = moves.select(F.col("w1").alias("before"), F.col("w2").alias("word"), F.col("cost").alias("_l"))
    after = moves.select(F.col("w1").alias("word"), F.col("w2").alias("after"), F.col("cost").alias("_r"))
    own = words[0].select(F.col("token").alias("word"), F.col("cost").alias("_own"))
    all_ = placed.join(before, ["before", "word"], "left").join(after, ["word", "after"], "left").join(own, "word", "left").join(F.broadcast(words[1]))
    both = F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), 0.5 * F.col("_l") + 0.5 * F.col("_r"))
    return all_.select("query", "word", F.coalesce(both, "_l", "_r", "_own", "default_cost").alias("cost"))


def pair_aware(found: DataFrame, context: DataFrame, words: tuple, pair_costs: DataFrame, k: int = 10) -> DataFrame:
    """(query, word, distance, has_pair, score, rank): the nearest words first; among them those that form a pair, in either
    order, with a context word (context: query, other); then by half of the best pair's cost and half of the word's own, or
    by its own alone."""
    asked = found.filter("distance > 0").join(words[0].select(F.col("token").alias("word"), "cost"), "word", "left").join(F.broadcast(words[1]))
    asked = asked.withColumn("own", F.coalesce("cost", "default_cost")).drop("cost", "default_cost")
    near = asked.select("query", "word").join(context, "query")
    ahead = near.join(pair_costs.select(F.col("w1").alias("other"), F.col("w2").alias("word"), "cost"), ["other", "word"])
    behind = near.join(pair_costs.select(F.col("w1").alias("word"), F.col("w2").alias("other"), "cost"), ["word", "other"])
    best = ahead.select("query", "word", "cost").unionByName(behind.select("query", "word", "cost")).groupBy("query", "word").agg(F.min("cost").alias("pair"))
    scored = asked.join(best, ["query", "word"], "left").withColumn("has_pair", F.col("pair").isNotNull())
    scored = scored.withColumn("score", F.when(F.col("has_pair"), 0.5 * F.col("pair") + 0.5 * F.col("own")).otherwise(F.col("own")))
    rank = F.row_number().over(W.partitionBy("query").orderBy("distance", F.desc("has_pair"), "score", "word"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k).select("query", "word", "distance", "has_pair", "score", "rank")


def unknown_run(tokens: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, target, first, last): the run of unknown tokens around each unknown target. tokens: (key, i, token, known)."""
    runs = tokens.withColumn("_b", F.sum(F.col("known").cast("int")).over(W.partitionBy(key).orderBy("i"))).filter("not known")
    bounds = runs.groupBy(key, "_b").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    placed = runs.select(key, F.col("i").alias("target"), "_b").join(targets.select(key, F.col("i").alias("target")), [key, "target"])
    return placed.join(bounds, [key, "_b"]).select(key, "target", "first", "last")


def expanded(tokens: DataFrame, targets: DataFrame, vocabulary: DataFrame, costs: DataFrame, k: int = 10, key: str = "doc_id") -> DataFrame:
    """(key, target, start, end, text, word, distance, rank): what an unknown target may have been. All spans that cover its
    run of unknown tokens are looked up at distance 1, and at 2 only if no span has a match at 1. (A span two letters longer
    than the longest word cannot match, so longer ones, in letters or in tokens, are not made.)
    A match begins with the known tokens before the run and ends with those after it, and more stands between them. Longer
    spans come first, then longer texts, then cheaper words; k in all for each target. tokens: (key, i, token, known) of one
    island each; vocabulary: (word); costs: (word, cost)."""
    run = unknown_run(tokens, targets, key)
    size = tokens.groupBy(key).agg(F.max("i").alias("_max"), F.array_sort(F.collect_list(F.struct("i", "token"))).alias("_t"))
    longest = vocabulary.agg((F.coalesce(F.max(F.length("word")), F.lit(0)) + 2).alias("_most"))
    held = run.join(size, key).join(F.broadcast(longest)).filter("last - first < _most")
    starts = held.select("*", F.explode(F.sequence(F.greatest(F.col("last") + 1 - F.col("_most"), F.lit(0)), F.col("first"))).alias("start"))
    ends = starts.select("*", F.explode(F.sequence(F.col("last"), F.least(F.col("start") + F.col("_most") - 1, F.col("_max")))).alias("end"))
    text = lambda a, b: F.array_join(F.slice("_t.token", a + 1, F.greatest(b - a, F.lit(0))), "")
    spans = ends.select(key, "target", "start", "end", text(F.col("start"), F.col("end") + 1).alias("text"), text(F.col("start"), F.col("first")).alias("left"), text(F.col("last") + 1, F.col("end") + 1).alias("right"), "_most")
    spans = spans.filter(F.length("text") <= F.col("_most")).drop("_most")
    found = within(spans.select(F.col("text").alias("query")), vocabulary, 2).filter("distance > 0").withColumnRenamed("query", "text")
    ok = F.startswith("word", F.col("left")) & F.endswith("word", F.col("right")) & (F.length("word") > F.length("left") + F.length("right"))
    hits = spans.join(found, "text").filter(ok)
    nearest = F.min("distance").over(W.partitionBy(key, "target"))
    hits = hits.withColumn("_d", nearest).filter("distance = _d").join(costs, "word", "left")
    order = W.partitionBy(key, "target").orderBy(F.desc(F.col("end") - F.col("start")), F.desc(F.length("text")), "start", F.col("cost").asc_nulls_last(), "word")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(key, "target", "start", "end", "text", "word", "distance", "rank")


def blocked(queries: DataFrame, words: DataFrame, slack: int = 1, most: int = 2, least: float = 0.6) -> DataFrame:
    """(query, word, distance, similarity): candidates with the query's first character whose length differs by up to slack, at
    most so many edits away and so similar. An equi-join on character and length."""
    lengths = F.explode(F.sequence(F.length("query") - slack, F.length("query") + slack))
    q = queries.select("query").distinct().filter("query <> ''").select("query", F.left("query", F.lit(1)).alias("_c"), lengths.alias("_n"))
    w = words.select("word").distinct().filter("word <> ''").select("word", F.left("word", F.lit(1)).alias("_c"), F.length("word").alias("_n"))
    near = q.join(w, ["_c", "_n"]).filter("query <> word").withColumn("distance", F.levenshtein("query", "word", most)).filter("distance >= 0")
    return similar(near.select("query", "word", "distance")).filter(F.col("similarity") >= least)


def covering_spans(tokens: DataFrame, targets: DataFrame, most: int = 4, key: str = "doc_id") -> DataFrame:
    """(key, target, start, end, text): all runs of up to `most` tokens that cover a target token (key, i)."""
    t = targets.select(key, F.col("i").alias("target"))
    starts = t.select(key, "target", F.explode(F.sequence(F.greatest(F.col("target") - (most - 1), F.lit(0)), F.col("target"))).alias("start"))
    ends = starts.select(key, "target", "start", F.explode(F.sequence(F.col("target") + 1, F.col("start") + most)).alias("end"))
    parts = ends.select(key, "target", "start", "end", F.explode(F.sequence("start", F.col("end") - 1)).alias("i")).join(tokens, [key, "i"])
    whole = parts.groupBy(key, "target", "start", "end").agg(F.array_sort(F.collect_list(F.struct("i", "token"))).alias("t")).filter(F.size("t") == F.col("end") - F.col("start"))
    return whole.select(key, "target", "start", "end", F.array_join("t.token", "").alias("text"))


def two_tier(found: DataFrame) -> DataFrame:
    """Matches at distance 1; those at distance 2 only for queries that have none at 1."""
    has = F.max(F.when(F.col("distance") == 1, 1).otherwise(0)).over(W.partitionBy("query"))
    return found.withColumn("_one", has).filter("distance = 1 or (distance = 2 and _one = 0)").drop("_one")


def budgeted(found: DataFrame, costs: DataFrame, k: int = 10) -> DataFrame:
    """The k suggestions to show over all queries: longer queries first, then cheaper words, then by name. costs: (word, cost)."""
    return found.join(costs, "word", "left").orderBy(F.desc(F.length("query")), F.col("cost").asc_nulls_last(), "word", "query").limit(k)
