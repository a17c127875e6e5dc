"""Counts and costs of words, pairs and spans, backing off from pairs to words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.operators.runs import spans_of_texts

# Smoothing, and the weights of words, pairs, phrases and pairs of phrases in a sequence's cost.
UNIGRAM_ALPHA, BIGRAM_ALPHA, BACKOFF = 1.0, 0.1, 0.5
GLOBAL_DEFAULT = 10.0
WORD, PAIR, PHRASE, PHRASE_PAIR = 0.05, 0.10, 0.02, 0.04
#: An inventory of up to so many phrases is sent to all tasks; a larger one is joined by shuffling.
SENT = 200_000
#: A task counts the pairs of so many bytes of words at once, and sends so many counted pairs at once.
HELD, AT_ONCE = 1 << 26, 1 << 16


def unigrams(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("token").agg(F.count("*").alias("n"))


def sent(small: DataFrame) -> DataFrame:
    """A table to join, sent to all tasks if it is small."""
    return F.broadcast(small) if small.limit(SENT + 1).count() <= SENT else small


def pair_counts(lists: list[pa.Array]) -> Iterator[pa.RecordBatch]:
    """Batches of (w1, w2, n): the pairs of neighbours in each of the lists. Words become numbers, so a pair is one number."""
    words = pa.chunked_array([x.flatten() for x in lists]).dictionary_encode("encode")
    if not len(words):
        return
    codes = np.concatenate([c.indices.to_numpy() for c in words.chunks])
    sizes = np.concatenate([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in lists])
    follows = np.ones(len(codes), dtype=bool)
    follows[np.cumsum(sizes)[sizes > 0] - 1] = False  # nothing follows the last word of a list
    pairs = (codes[:-1].astype(np.int64) << 32 | codes[1:])[follows[:-1]]
    pairs.sort()
    first = np.flatnonzero(np.diff(pairs, prepend=-1))
    counts, names = np.diff(first, append=len(pairs)), words.chunk(0).dictionary
    for i in range(0, len(first), AT_ONCE):
        p = pairs[first[i : i + AT_ONCE]]
        yield pa.record_batch([names.take(pa.array(p >> 32)), names.take(pa.array(p & 0xFFFFFFFF)), pa.array(counts[i : i + AT_ONCE])], ["w1", "w2", "n"])


def counted_pairs(lists: Iterator[pa.Array]) -> Iterator[pa.RecordBatch]:
    """The same of all lists of a task; a pair may come again for each HELD bytes."""
    held, size = [], 0
    for x in lists:
        if held and size + x.nbytes > HELD:
            yield from pair_counts(held)
            held, size = [], 0
        held.append(x)
        size += x.nbytes
    if held:
        yield from pair_counts(held)


def bigrams(rows: DataFrame, asked: DataFrame | None = None, letter: str | None = None) -> DataFrame:
    """(w1, w2, n) of neighbours in the arrays t of rows. Pairs are counted in their task, many rows at once, and then dealt out:
    a sum before the shuffle would find few pairs to add up. asked: (w1, w2), the only pairs that are wanted; others are left
    out before the shuffle. letter: t are texts, whose words are the runs of this class; they are cut where they are counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = (b.column(0) for b in batches)
        return counted_pairs(columns if letter is None else (x for c in columns for x in tx.cut_words(c, letter)))

    kind = rows.schema["t"].dataType.elementType.simpleString() if letter is None else "string"
    each = rows.select("t").mapInArrow(run, f"w1 {kind}, w2 {kind}, n long")
    if asked is not None:
        each = each.join(sent(asked.select("w1", "w2").distinct()), ["w1", "w2"], "left_semi")
    return each.repartition("w1", "w2").groupBy("w1", "w2").agg(F.sum("n").alias("n"))


def neighbours(rows: DataFrame) -> DataFrame:
    """(token, n, n_left, n_right): how often a word occurs in the arrays t, how often with one after it and with one before it."""
    last = F.size("t") - 1
    each = F.transform("t", lambda x, i: F.struct(x.alias("token"), (i < last).alias("left"), (i > 0).alias("right")))
    words = rows.select(F.explode_outer(each).alias("p")).filter("p is not null").select("p.*")
    return words.groupBy("token").agg(F.count("*").alias("n"), F.count_if("left").alias("n_left"), F.count_if("right").alias("n_right"))


def in_order(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, t): tokens (key, i, token) as one array for each key."""
    return tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "token"))).alias("_t")).select(key, F.col("_t.token").alias("t"))


def runs_of(least: int, most: int) -> Column:
    """Array of (i, size, phrase): all runs of least to most neighbours in the array t, joined by _."""

    def of(size: int) -> Column:
        last = F.size("t") - size
        all_ = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("cast(array() as array<int>)"))
        return F.transform(all_, lambda i: F.struct(i.alias("i"), F.lit(size).alias("size"), F.array_join(F.slice("t", i + 1, F.lit(size)), "_").alias("phrase")))

    return F.concat(*(of(n) for n in range(least, most + 1)))


def spans(rows: DataFrame, least: int = 2, most: int = 4, letter: str | None = None) -> DataFrame:
    """(phrase, size, n): runs of neighbours in the arrays t. A place is shuffled once, with its longest run, by what stands before
    that run's second _, which all runs of the place share; the shorter ones are cut from it after the shuffle. letter: t are
    texts, whose words are the runs of this class; their places are shuffled in packed blocks, unless words can hold a _."""
    if letter is not None:
        if not tx.in_class(letter)[ord("_")]:
            return spans_of_texts(rows, letter, least, most)
        rows = rows.select(F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(f"[{letter}]+"), F.lit(0)).alias("t"))

    def run(i: Column) -> Column:
        first = F.length(F.array_join(F.slice("t", i + 1, F.lit(least)), "_"))
        ends = [first]
        for k in range(least, most):
            ends.append(ends[-1] + 1 + F.length(F.get("t", i + k)))
        return F.struct(F.array_join(F.slice("t", i + 1, F.lit(most)), "_").alias("run"), *(e.alias(f"e{k}") for k, e in enumerate(ends)))

    last = F.size("t") - least
    all_ = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("cast(array() as array<int>)"))
    places = rows.select(F.explode_outer(F.transform(all_, run)).alias("p")).filter("p is not null").select("p.*")
    head = F.substring_index("run", "_", 2)
    dealt = places.withColumn("head", head).withColumn("tail", F.substr("run", F.length("head") + 1)).drop("run").repartition("head")
    cut = lambda k: F.struct(F.lit(least + k).alias("size"), F.left("tail", F.col(f"e{k}") - F.length("head")).alias("tail"))
    each = dealt.select("head", F.explode(F.array(*(cut(k) for k in range(most - least + 1)))).alias("x")).filter("x.tail is not null")
    counted = each.groupBy("head", "x.tail", "x.size").agg(F.count("*").alias("n"))
    return counted.select(F.concat("head", "tail").alias("phrase"), "size", "n")


def inventory(counts: DataFrame, least: int = 2, most: int = 4) -> DataFrame:
    """(phrase, size, n) of counted phrases (phrase, n) that occur so often and have 2 to most parts; of equal keys the
    highest count."""
    size = F.size(F.split("phrase", "_"))
    kept = counts.select("phrase", size.alias("size"), "n").filter((F.col("n") >= least) & F.col("size").between(2, most))
    return kept.groupBy("phrase", "size").agg(F.max("n").alias("n"))


def unigram_costs(counts: DataFrame, alpha: float = UNIGRAM_ALPHA) -> tuple[DataFrame, DataFrame]:
    """(token, n, cost) and the one row (default_cost) of words that were never seen."""
    total = counts.agg(F.sum("n").alias("total"), F.count("*").alias("v")).select((F.col("total") + alpha * F.col("v")).alias("mass"))
    costs = counts.join(F.broadcast(total)).select("token", "n", (-F.ln((F.col("n") + alpha) / F.col("mass"))).alias("cost"))
    return costs, total.select((-F.ln(F.lit(alpha) / F.col("mass"))).alias("default_cost"))


def bigram_costs(pairs: DataFrame, alpha: float = BIGRAM_ALPHA, words: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(w1, w2, n, cost), (w1, default_cost) and the one row (global_cost): the mean of the left words' defaults. words (neighbours
    of the same rows) spare another pass over all pairs; pairs may then be only those that are asked for."""
    if words is None:
        size = pairs.agg(F.greatest(F.count_distinct("w2"), F.lit(1)).alias("v"))
        sums = pairs.groupBy("w1").agg(F.sum("n").alias("left_n"))
    else:
        size = words.agg(F.greatest(F.count_if(F.col("n_right") > 0), F.lit(1)).alias("v"))
        sums = left_counts(words)
    left = sums.join(F.broadcast(size)).select("w1", (F.col("left_n") + alpha * F.col("v")).alias("mass"))
    costs = pairs.join(left if words is None else sent(left), "w1").select("w1", "w2", "n", (-F.ln((F.col("n") + alpha) / F.col("mass"))).alias("cost"))
    defaults = left.select("w1", (-F.ln(F.lit(alpha) / F.col("mass"))).alias("default_cost"))
    return costs, defaults, defaults.agg(F.coalesce(F.avg("default_cost"), F.lit(GLOBAL_DEFAULT)).alias("global_cost"))


def left_counts(words: DataFrame) -> DataFrame:
    return words.filter("n_left > 0").select(F.col("token").alias("w1"), F.col("n_left").alias("left_n"))


def transition_costs(asked: DataFrame, words: tuple[DataFrame, DataFrame], pairs: tuple[DataFrame, DataFrame, DataFrame]) -> DataFrame:
    """asked (w1, w2, ...) with cost and its source: the pair's own; else the left word's default, or the global one,
    plus half of the right word's cost."""
    (uni, uni_default), (bi, left, overall) = words, pairs
    joined = (
        asked.join(bi.select("w1", "w2", F.col("cost").alias("pair_cost")), ["w1", "w2"], "left")
        .join(left, "w1", "left")
        .join(uni.select(F.col("token").alias("w2"), F.col("cost").alias("word_cost")), "w2", "left")
        .join(F.broadcast(uni_default.withColumnRenamed("default_cost", "word_default")))
        .join(F.broadcast(overall))
    )
    backed = F.coalesce("default_cost", "global_cost") + BACKOFF * F.coalesce("word_cost", "word_default")
    source = F.when(F.col("pair_cost").isNotNull(), "pair").when(F.col("default_cost").isNotNull(), "left").otherwise("global")
    return joined.select(*asked.columns, F.coalesce("pair_cost", backed).alias("cost"), source.alias("source"))


def rarity(costs: DataFrame) -> DataFrame:
    """cost scaled to 0..1 between the least and the greatest; where all are equal, a logistic curve around 8."""
    bounds = costs.agg(F.min("cost").alias("lo"), F.max("cost").alias("hi"))
    scaled = (F.col("cost") - F.col("lo")) / F.when(F.col("hi") > F.col("lo"), F.col("hi") - F.col("lo"))
    curve = 1 / (1 + F.exp(-(F.col("cost") - 8.0) / 3.0))
    return costs.join(F.broadcast(bounds)).select("token", "cost", F.least(F.greatest(F.coalesce(scaled, curve), F.lit(0.0)), F.lit(1.0)).alias("rarity"))


def collocations(costs: DataFrame, least: float = 0.02) -> DataFrame:
    """(w1, w2, strength) of pairs: exp(-max(cost - 5, 0) / 3), above a least strength."""
    return costs.select("w1", "w2", F.exp(-F.greatest(F.col("cost") - 5.0, F.lit(0.0)) / 3.0).alias("strength")).filter(F.col("strength") > least)


def phrases(rows: DataFrame, inventory: DataFrame, most: int = 4, key: str = "doc_id") -> DataFrame:
    """(key, start, end, phrase, n): greedy longest matches, left to right, of the inventory (phrase, size, n) in the arrays t.

    A place whose first two words begin no phrase of an inventory that is sent to all tasks is left out before its runs are made:
    all runs of a place share what stands before their second _. The runs of other places meet the inventory in a join. Which of
    them the greedy walk takes is a fold over a row's matches, longer ones of a place first. t holds no nulls."""
    words = [f"w{k}" for k in range(most)]
    shifted = (F.slice("t", k + 1, F.greatest(F.size("t") - k, F.lit(0))).alias(w) for k, w in enumerate(words))
    places = rows.select(key, F.posexplode_outer(F.arrays_zip(*shifted)).alias("i", "p")).select(key, "i", "p.*").filter("w1 is not null")
    if inventory.limit(SENT + 1).count() <= SENT:
        heads = inventory.select(F.substring_index("phrase", "_", 2).alias("head")).distinct()
        places = places.join(F.broadcast(heads), F.substring_index(F.concat_ws("_", "w0", "w1"), "_", 2) == F.col("head"), "left_semi")
        inventory = F.broadcast(inventory)
    run = lambda k: F.when(F.col(words[k - 1]).isNotNull(), F.struct(F.lit(k).alias("size"), F.concat_ws("_", *words[:k]).alias("phrase")))
    candidates = places.select(key, "i", F.explode(F.array(*map(run, range(2, most + 1)))).alias("p")).filter("p is not null").select(key, "i", "p.*")
    matches = candidates.join(inventory, ["phrase", "size"]).select(key, F.struct("i", (-F.col("size")).alias("less"), "phrase", "n").alias("m"))
    ordered = matches.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("all"))
    ordered = ordered.select(key, F.transform("all", lambda m: F.struct(m["i"].alias("i"), (-m["less"]).alias("size"), m["phrase"].alias("phrase"), m["n"].alias("n"))).alias("all"))
    empty = F.expr("cast(array() as array<struct<i:int,size:int,phrase:string,n:bigint>>)")
    walk = F.aggregate("all", F.struct(F.lit(0).alias("at"), empty.alias("out")), lambda s, m: F.when(m["i"] >= s["at"], F.struct((m["i"] + m["size"]).alias("at"), F.array_append(s["out"], m).alias("out"))).otherwise(s), lambda s: s["out"])
    taken = ordered.select(key, F.explode(walk).alias("m"))
    return taken.select(key, F.col("m.i").alias("start"), (F.col("m.i") + F.col("m.size")).alias("end"), "m.phrase", "m.n")


def sequence_costs(pairs: DataFrame, key: str = "doc_id", word: float = WORD, pair: float = PAIR) -> DataFrame:
    """(key, n, cost): a token's cost is its own and that of its pair with the token before, each by its weight. pairs: (key,
    word_cost, pair_cost), pair_cost null at the start."""
    own = word * F.col("word_cost") + pair * F.coalesce("pair_cost", F.lit(0.0))
    return pairs.groupBy(key).agg(F.count("*").alias("n"), F.sum(own).alias("cost"))


def scored(rows: DataFrame, words: tuple[DataFrame, DataFrame], pairs: tuple[DataFrame, DataFrame, DataFrame], key: str, word: float = WORD, pair: float = PAIR) -> DataFrame:
    """sequence_costs of the arrays t by word and pair costs; distinct words and pairs are priced once."""
    each = rows.select(key, F.explode_outer(F.zip_with("t", F.concat(F.array(F.lit(None).cast("string")), F.slice("t", 1, F.greatest(F.size("t") - 1, F.lit(0)))), lambda w, b: F.struct(w.alias("token"), b.alias("before")))).alias("p")).select(key, "p.*").filter("token is not null")
    counted = each.groupBy(key, "token", "before").agg(F.count("*").alias("times"))
    asked = counted.filter("before is not null").select(F.col("before").alias("w1"), F.col("token").alias("w2")).distinct()
    moves = transition_costs(asked, words, pairs).select(F.col("w1").alias("before"), F.col("w2").alias("token"), F.col("cost").alias("pair_cost"))
    own = counted.join(words[0].select("token", "cost"), "token", "left").join(F.broadcast(words[1])).withColumn("word_cost", F.coalesce("cost", "default_cost"))
    both = own.join(moves, ["before", "token"], "left")
    cost = F.col("times") * (word * F.col("word_cost") + pair * F.coalesce("pair_cost", F.lit(0.0)))
    return both.groupBy(key).agg(F.sum("times").alias("n"), F.sum(cost).alias("cost"))


def overlay(tokens: DataFrame, costs: tuple[DataFrame, DataFrame], key: str = "doc_id") -> DataFrame:
    """tokens with cost, known and rarity by the model's least and greatest cost."""
    scaled = rarity(costs[0])
    return tokens.join(scaled, "token", "left").join(F.broadcast(costs[1])).select(
        key, "i", "token", F.coalesce("cost", "default_cost").alias("cost"), F.col("cost").isNotNull().alias("known"), F.coalesce("rarity", F.lit(1.0)).alias("rarity")
    )


def bigram_shares(pairs: DataFrame, words: DataFrame | None = None) -> DataFrame:
    """(w1, w2, n, p): unsmoothed share of w2 among the words after w1. Totals are summed apart, or taken from words (neighbours
    of the same rows), and joined, so a frequent left word is no window."""
    sums = pairs.groupBy("w1").agg(F.sum("n").alias("left_n")) if words is None else sent(left_counts(words))
    return pairs.join(sums, "w1").select("w1", "w2", "n", (F.col("n") / F.col("left_n")).alias("p"))


def units(rows: DataFrame, taken: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, t): the arrays t with each taken phrase (key, start, end, phrase) as one unit."""
    tokens = rows.select(key, F.posexplode("t").alias("i", "token"))
    inside = taken.select(key, "start", "phrase", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"))
    placed = tokens.join(inside, [key, "i"], "left").filter("start is null or start = i")
    return in_order(placed.select(key, "i", F.coalesce("phrase", "token").alias("token")), key)


def phrase_bigrams(rows: DataFrame, taken: DataFrame, key: str = "doc_id") -> DataFrame:
    """(w1, w2, n): neighbours in the sequence of units."""
    return bigrams(units(rows, taken, key))


def collocation_edges(rows: DataFrame, costs: DataFrame, pair_costs: DataFrame, key: str = "doc_id", least: float = 0.02) -> DataFrame:
    """(key, i, w1, w2, strength): neighbours in the arrays t that are collocations, both of them known words."""
    n = F.greatest(F.size("t") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("t", 1, n), F.slice("t", 2, n), lambda a, b: F.struct(a.alias("w1"), b.alias("w2")))
    each = rows.select(key, F.posexplode_outer(pairs).alias("i", "p")).filter("p is not null").select(key, "i", "p.*")
    known = costs.select("token")
    strong = collocations(pair_costs, least).join(known.withColumnRenamed("token", "w1"), "w1", "left_semi").join(known.withColumnRenamed("token", "w2"), "w2", "left_semi")
    return each.join(strong, ["w1", "w2"]).select(key, "i", "w1", "w2", "strength")
