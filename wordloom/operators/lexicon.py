"""Layered lexicons: merge, resolve by priority, look up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordloom.functions import text as tx
from wordloom.functions.profile import ScriptProfile

# Priorities of the layers; the least wins.
PRIORITIES = {"user": 1, "mmd": 2, "wiktionary": 3, "grammar": 4, "pali": 5, "chronicle": 99, "lm_vocab": 99}


def merge_entries(entries: DataFrame) -> DataFrame:
    """entries (layer, priority, headword, roman, pos, sense, pos_in_file) to one row for each layer and headword: the
    first romanization that is not empty, distinct parts of speech joined by |, distinct senses, all in file order."""
    e = entries.groupBy("layer", "priority", "headword").agg(F.array_sort(F.collect_list(F.struct("pos_in_file", "roman", "pos", "sense"))).alias("e"))
    filled = lambda name: F.filter(F.col(f"e.{name}"), lambda x: x != "")
    return e.select(
        "layer", "priority", "headword", F.coalesce(F.get(filled("roman"), F.lit(0)), F.lit("")).alias("roman"),
        F.array_join(F.array_distinct(filled("pos")), "|").alias("pos"), F.array_distinct(filled("sense")).alias("senses"),
    )


def resolve(entries: DataFrame) -> DataFrame:
    """The winning row of each headword: least priority, then layer name."""
    order = W.partitionBy("headword").orderBy("priority", "layer")
    return entries.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").drop("_rank")


def lookup(tokens: DataFrame, entries: DataFrame, token_col: str = "token") -> DataFrame:
    """tokens with the winning entry's columns, null where there is none."""
    return tokens.join(resolve(entries), F.col(token_col) == F.col("headword"), "left")


def lookup_all(tokens: DataFrame, entries: DataFrame, token_col: str = "token") -> DataFrame:
    """One row for each matching layer, with its rank among them."""
    order = W.partitionBy("headword").orderBy("priority", "layer")
    return tokens.join(entries.withColumn("rank", F.row_number().over(order)), F.col(token_col) == F.col("headword"))


def known(tokens: DataFrame, words: DataFrame, word_col: str = "word") -> DataFrame:
    return tokens.join(words, F.col("token") == F.col(word_col), "left_semi")


def unknown(tokens: DataFrame, words: DataFrame, word_col: str = "word") -> DataFrame:
    return tokens.join(words, F.col("token") == F.col(word_col), "left_anti")


def unknown_counts(tokens: DataFrame, words: DataFrame, most: int = 30, id_col: str = "doc_id") -> DataFrame:
    """(token, n, docs, first_i): unknown tokens up to so many characters. Counted before the lexicon is joined, so the
    join is over distinct tokens."""
    counts = tokens.groupBy("token").agg(F.count("*").alias("n"), F.count_distinct(id_col).alias("docs"), F.min("i").alias("first_i"))
    return unknown(counts, words).filter(F.length("token") <= most)


def merge_unknown_runs(docs: DataFrame, words: DataFrame, profile: ScriptProfile, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, first, n, token, is_known): of each text's words, neighbouring unknown ones become one; known ones stay. key is unique.

    Only the places of known words are grouped by key; they meet the text, which is cut into words again, and the runs are what
    lies between them. So no words are shuffled or put in order again."""
    known_at = known(tx.tokens(docs, profile, key, text_col), words).groupBy(key).agg(F.array_sort(F.collect_list("i")).alias("_known")).withColumnRenamed(key, "_key")
    both = docs.select(key, text_col).join(known_at, F.col(key).eqNullSafe(F.col("_key")), "left")
    rows = tx.token_arrays(both, profile, key, text_col, ("_known",))
    bounds = F.concat(F.array(F.lit(-1)), F.coalesce("_known", F.expr("cast(array() as array<int>)")), F.array(F.size("t")))

    def runs(v: Column) -> Column:
        t, at = v["t"], v["at"]
        gap = lambda a, b: F.struct((a + 1).alias("first"), (b - a - 1).cast("long").alias("n"), F.array_join(F.slice(t, a + 2, b - a - 1), "").alias("token"), F.lit(False).alias("is_known"))
        word = lambda b: F.struct(b.alias("first"), F.lit(1).cast("long").alias("n"), F.get(t, b).alias("token"), F.lit(True).alias("is_known"))
        pairs = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.array(F.when(b > a + 1, gap(a, b)), F.when(b < F.size(t), word(b))))
        return F.flatten(pairs)

    found = rows.select(key, F.explode_outer(tx.bound(F.struct("t", bounds.alias("at")), runs)).alias("r")).filter("r is not null")
    return found.select(key, "r.*")


def upsert(layer: DataFrame, changes: DataFrame) -> DataFrame:
    """Last write wins by ts; an empty note deletes. changes: (headword, note, ts)."""
    last = layer.unionByName(changes).groupBy("headword").agg(F.max_by("note", "ts").alias("note"), F.max("ts").alias("ts"))
    return last.filter(F.length(F.trim("note")) > 0)


def with_forms(entries: DataFrame, forms: DataFrame, layer: str, priority: int) -> DataFrame:
    """entries, and each form (headword, sense) that no layer holds as an entry of the given layer."""
    held = entries.select("headword").distinct()
    more = forms.join(held, "headword", "left_anti").groupBy("headword").agg(F.min("sense").alias("sense"))
    more = more.select("headword", F.lit(layer).alias("layer"), F.lit(priority).alias("priority"), F.array("sense").alias("senses"))
    return entries.unionByName(more, allowMissingColumns=True)


def all_words(layers: list[DataFrame], column: str = "headword") -> DataFrame:
    """Distinct headwords of all layers."""
    out = layers[0].select(column)
    for x in layers[1:]:
        out = out.unionByName(x.select(column))
    return out.distinct()


def duplicate_keys(rows: DataFrame, column: str) -> DataFrame:
    """(column, n) of keys that occur more than once; a disjoint union has none."""
    return rows.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def disjoint_union(parts: list[DataFrame], column: str) -> DataFrame:
    """All rows of the parts; an error if a key occurs twice."""
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    twice = duplicate_keys(out, column).take(1)
    if twice:
        raise ValueError(f"key occurs twice: {twice[0][0]}")
    return out


def overlaid(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Records of both sides by key, the right one's filled fields first: a merge of overlays that leans to the right."""
    shared = [c for c in left.columns if c in right.columns and c not in key]
    r = right.withColumnsRenamed({c: f"_r_{c}" for c in shared})
    both = left.join(r, key, "full_outer")
    return both.select(*key, *(F.coalesce(f"_r_{c}", c).alias(c) if c in shared else F.col(c) for c in [*left.columns, *(c for c in right.columns if c not in left.columns)] if c not in key))


def grouped_senses(entries: DataFrame) -> DataFrame:
    """(headword, groups array<(roman, groups array<(pos, senses)>)>): senses by romanization and part of speech, each in file order."""
    by_pos = entries.filter("sense <> ''").groupBy("headword", "roman", "pos").agg(F.min("pos_in_file").alias("k"), F.array_sort(F.collect_list(F.struct("pos_in_file", "sense"))).alias("s"))
    by_pos = by_pos.select("headword", "roman", F.struct("k", "pos", F.col("s.sense").alias("senses")).alias("p"))
    by_roman = by_pos.groupBy("headword", "roman").agg(F.array_sort(F.collect_list("p")).alias("p")).select("headword", F.struct(F.get("p", F.lit(0))["k"].alias("k"), "roman", F.transform("p", lambda x: F.struct(x["pos"].alias("pos"), x["senses"].alias("senses"))).alias("groups")).alias("r"))
    return by_roman.groupBy("headword").agg(F.array_sort(F.collect_list("r")).alias("r")).select("headword", F.transform("r", lambda x: F.struct(x["roman"].alias("roman"), x["groups"].alias("groups"))).alias("groups"))
