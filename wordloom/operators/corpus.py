"""Treebank and corpus preparation: sentence tables, repairs, windows, splits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordloom.functions import clean
from wordloom.functions.text import clusters


def repair_roots(tokens: DataFrame) -> DataFrame:
    """Exactly one root in each sentence: the first one whose relation says root, else the first. Further ones hang on it, but a
    case marker on its left neighbour and part of a compound on its right one, where that is no root itself and does not
    hang on them. A sentence without a root gets its first token whose relation says root, else its last. Relations stay.
    tokens: (sent_id, tok_id from 1, head, deprel, ...)."""
    w, every = W.partitionBy("sent_id").orderBy("tok_id"), W.partitionBy("sent_id")
    is_root, says = F.col("head") == 0, F.col("deprel") == "root"
    first = lambda c: F.min(F.when(c, F.col("tok_id"))).over(every)
    t = tokens.withColumn("_primary", F.coalesce(first(is_root & says), first(is_root))).withColumn("_new", F.coalesce(first(says), F.max("tok_id").over(every)))
    t = t.withColumn("_left", F.lag("head").over(w)).withColumn("_right", F.lead("head").over(w))
    free = lambda head: head.isNotNull() & (head != 0) & (head != F.col("tok_id"))
    near = F.when((F.col("deprel") == "case") & free(F.col("_left")), F.col("tok_id") - 1).when((F.col("deprel") == "compound") & free(F.col("_right")), F.col("tok_id") + 1)
    head = F.when(F.col("_primary").isNull() & (F.col("tok_id") == F.col("_new")), 0).when(is_root & (F.col("tok_id") != F.col("_primary")), F.coalesce(near, "_primary")).otherwise(F.col("head"))
    return t.withColumn("head", head).drop("_primary", "_new", "_left", "_right")


def drop_tokens(tokens: DataFrame, dropped: Column) -> DataFrame:
    """Without the given tokens: the others are numbered anew, heads follow, and a token whose head goes becomes a root."""
    kept = tokens.filter(~dropped).withColumn("_new", F.row_number().over(W.partitionBy("sent_id").orderBy("tok_id")).cast("int"))
    heads = kept.select("sent_id", F.col("tok_id").alias("head"), F.col("_new").alias("_head"))
    joined = kept.join(heads, ["sent_id", "head"], "left")
    lost = F.col("_head").isNull()
    return joined.select(
        *(F.col("_new").alias(c) if c == "tok_id" else F.coalesce("_head", F.lit(0)).alias(c) if c == "head" else F.when(lost, "root").otherwise(F.col(c)).alias(c) if c == "deprel" else F.col(c) for c in tokens.columns)
    )


def packed_windows(sentences: DataFrame, most: int, key: str = "doc_id") -> DataFrame:
    """(key, window, first, last, size): whole sentences packed up to so many tokens; a longer one is a window of its own.
    sentences: (key, sentence, size). Filling is sequential, so it is a fold over a document's sentence lengths."""
    ordered = sentences.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("sentence", "size"))).alias("s"))
    kind = "array<struct<first:bigint,last:bigint,size:bigint>>"
    zero = F.struct(F.expr(f"cast(array() as {kind})").alias("done"), F.expr("cast(null as struct<first:bigint,last:bigint,size:bigint>)").alias("open"))

    def step(state: Column, s: Column) -> Column:
        fits = state["open"].isNotNull() & (state["open"]["size"] + s["size"] <= most)
        more = F.struct(state["open"]["first"].alias("first"), s["sentence"].cast("bigint").alias("last"), (state["open"]["size"] + s["size"]).alias("size"))
        new = F.struct(s["sentence"].cast("bigint").alias("first"), s["sentence"].cast("bigint").alias("last"), s["size"].cast("bigint").alias("size"))
        done = F.when(state["open"].isNull(), state["done"]).otherwise(F.array_append(state["done"], state["open"]))
        return F.when(fits, F.struct(state["done"].alias("done"), more.alias("open"))).otherwise(F.struct(done.alias("done"), new.alias("open")))

    windows = F.aggregate("s", zero, step, lambda st: F.when(st["open"].isNull(), st["done"]).otherwise(F.array_append(st["done"], st["open"])))
    return ordered.select(key, F.posexplode(windows).alias("window", "w")).select(key, "window", "w.*")


def sliding_windows(docs: DataFrame, size: int = 400, stride: int = 200, least: int = 5, array_col: str = "tokens", key: str = "doc_id") -> DataFrame:
    """(key, start, tokens): from 0 on by a stride; the first window shorter than the least length ends a document."""
    n = F.size(array_col)
    starts = docs.select(key, array_col, F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))).alias("start"))
    return starts.filter(n - F.col("start") >= least).select(key, "start", F.slice(array_col, F.col("start") + 1, F.lit(size)).alias(array_col))


def ranked(rows: DataFrame, order: str) -> DataFrame:
    """rows with nth (from 0) and total over the whole table, without sorting it in one task: rows are sorted in ranges,
    and the counts of the ranges before (one number each) are added. The input is written once so that both passes see
    the same ranges."""
    ranged = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy("_p").agg(F.count("*").alias("_c"))
    before = counts.withColumn("_b", F.sum("_c").over(W.orderBy("_p")) - F.col("_c")).withColumn("total", F.sum("_c").over(W.partitionBy()))
    nth = F.row_number().over(W.partitionBy("_p").orderBy(order)) - 1
    return ranged.withColumn("_n", nth).join(F.broadcast(before.select("_p", "_b", "total")), "_p").withColumn("nth", F.col("_n") + F.col("_b")).drop("_p", "_n", "_b")


PRIME = 2**31 - 1


def drawn(place, least: int, most: int, seed: int):
    """A number from least to most for each place (numpy numbers or a column of them): a fifth power of the place, moved by the
    seed, modulo a prime, so that any place's draw can be made again anywhere."""
    x = (place % PRIME * 48271 + seed % PRIME) % PRIME
    square = x * x % PRIME
    x = square * square % PRIME * x % PRIME * (most - least + 1)
    return least + (x // PRIME if isinstance(place, np.ndarray) else F.floor(x / PRIME))


def contiguous_split(rows: DataFrame, order: str, train: float = 0.8, dev: float = 0.1) -> DataFrame:
    """split: the first 80 of a hundred train, the next 10 dev, the rest test, by order."""
    n = ranked(rows, order)
    a, b = F.floor(F.col("total") * train), F.floor(F.col("total") * train) + F.floor(F.col("total") * dev)
    return n.withColumn("split", F.when(F.col("nth") < a, "train").when(F.col("nth") < b, "dev").otherwise("test")).drop("nth", "total")


def every_nth(rows: DataFrame, order: str, n: int, offset: int = 0) -> DataFrame:
    r = ranked(rows, order)
    return r.filter(F.pmod(F.col("nth") - offset, F.lit(n)) == 0).drop("nth", "total")


def hashed_split(rows: DataFrame, id_col: str, seed: int, share: float) -> DataFrame:
    """dev: a share of the rows that depends on the id and the seed alone. A shuffle of a list would need all of it in one
    place and gives another permutation; membership here is stable when rows are added."""
    return rows.withColumn("dev", F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_000)) < F.lit(int(share * 1_000_000)))


def balanced_mix(parts: list[tuple[DataFrame, float]], order: str) -> DataFrame:
    """The largest union in which each part has its share, each part's first rows by order."""
    counts = [p.count() for p, _ in parts]
    total = min(int(c / s) for c, (_, s) in zip(counts, parts))
    out = None
    for k, (p, s) in enumerate(parts):
        taken = ranked(p, order).filter(F.col("nth") < int(total * s)).drop("nth", "total").withColumn("part", F.lit(k))
        out = taken if out is None else out.unionByName(taken)
    return out


def oversampled(rows: DataFrame, times: Column) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def majority(rows: DataFrame, form: str, value: str, order: str) -> DataFrame:
    """(form, value, n, share): the most frequent value of each form; ties go to the one seen first."""
    counts = rows.groupBy(form, value).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    w = W.partitionBy(form)
    best = counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "_first", value)))
    return best.filter("_r = 1").select(form, value, "n", "share")


def bracket_nodes(trees: DataFrame, key: str = "sent_id", text_col: str = "tree") -> DataFrame:
    """(key, node, label, depth, start, end, parent): a bracketed tree as nested sets, read within its row by a stack of open
    brackets. A node's number is the place of its bracket; one that is never closed makes no node."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"\([^\s()]*|\)|[^\s()]+"), F.lit(0))
    node = "struct<node:int,label:string,depth:bigint,start:bigint,end:bigint,parent:int>"
    empty = lambda kind: F.expr(f"cast(array() as array<{kind}>)")
    zero = F.struct(F.lit(0).alias("p"), F.lit(0).cast("long").alias("leaves"), empty("struct<node:int,label:string,start:bigint>").alias("open"), empty(node).alias("out"))

    def step(s: Column, t: Column) -> Column:
        many = F.size(s["open"])
        top, above = F.get(s["open"], many - 1), F.get(s["open"], many - 2)
        opened = F.array_append(s["open"], F.struct(s["p"].alias("node"), F.substr(t, F.lit(2)).alias("label"), s["leaves"].alias("start")))
        closed = F.struct(top["node"].alias("node"), top["label"].alias("label"), (many - 1).cast("long").alias("depth"), top["start"].alias("start"), s["leaves"].alias("end"), above["node"].alias("parent"))
        to = lambda leaves, open_, out: F.struct((s["p"] + 1).alias("p"), leaves.alias("leaves"), open_.alias("open"), out.alias("out"))
        is_end = (t == ")") & (many > 0)
        return (
            F.when(t.startswith("("), to(s["leaves"], opened, s["out"])).when(is_end, to(s["leaves"], F.slice(s["open"], 1, many - 1), F.array_append(s["out"], closed)))
            .otherwise(to(s["leaves"] + F.when(t == ")", 0).otherwise(1), s["open"], s["out"]))
        )

    read = F.aggregate(found, zero, step, lambda s: F.struct(s["out"].alias("out"), s["open"]["node"].alias("open")))
    rows = trees.select(key, read.alias("_r")).select(key, "_r.open", F.explode("_r.out").alias("n"))
    return rows.select(key, "n.node", "n.label", "n.depth", "n.start", "n.end", F.when(~F.array_contains("open", F.col("n.parent")), F.col("n.parent")).alias("parent"))


def base_chunks(spans: DataFrame, labels: list[str], key: str = "sent_id") -> DataFrame:
    """(key, label, start, end): spans of the given labels that hold no other one of the SAME label; of these, from the left by
    start, then by the order of the labels, then the shorter first, each that overlaps none taken before. What is taken
    depends on what was, so it is a fold over a sentence's minimal spans; equal spans count once. spans: (key, label, start, end)."""
    rank = F.create_map(*(F.lit(x) for k, v in enumerate(labels) for x in (v, k)))
    item = F.struct("start", rank[F.col("label")].alias("rank"), (F.col("end") - F.col("start")).alias("size"), "end", "label")
    held = spans.filter(F.col("label").isin(labels)).groupBy(key).agg(F.array_sort(F.array_distinct(F.collect_list(item))).alias("_s"))
    holds = lambda a, b: (a["label"] == b["label"]) & (a["start"] <= b["start"]) & (b["end"] <= a["end"]) & (b["size"] < a["size"])
    ordered = held.select(key, F.filter("_s", lambda a: ~F.exists("_s", lambda b: holds(a, b))).alias("all"))
    walk = F.aggregate(
        "all", F.struct(F.get("all", F.lit(0))["start"].alias("at"), F.slice("all", 1, 0).alias("out")),
        lambda st, x: F.when(x["start"] >= st["at"], F.struct(x["end"].alias("at"), F.array_append(st["out"], x).alias("out"))).otherwise(st), lambda st: st["out"],
    )
    return ordered.select(key, F.explode(walk).alias("x")).select(key, "x.label", "x.start", "x.end")


#: The chunk label of a token that no chunk covers, by its part of speech; NP for all others.
LONE = {"verb": "VP", "part": "VP", "adj": "ADJP", "adv": "ADVP"}


def bilou(leaves: DataFrame, chunks: DataFrame, key: str = "sent_id") -> DataFrame:
    """(key, i, tag): B-, I-, L- and U- tags of chunks (key, label, start, end) over leaves (key, i, pos, token). A token without
    a chunk, punctuation aside, extends the chunk before it, which then covers all up to it; one with none before it begins a
    chunk of its own, which the tokens after it extend; punctuation outside is O."""
    inside = chunks.select(key, "label", "start", F.explode(F.sequence("start", F.col("end") - 1)).alias("i"))
    at = leaves.join(inside, [key, "i"], "left")
    w = W.partitionBy(key).orderBy("i")
    own = F.when(F.col("start").isNotNull(), F.struct("start", "label"))
    lone = F.coalesce(F.create_map(*(F.lit(x) for kv in LONE.items() for x in kv))[F.col("pos")], F.lit("NP"))
    word = F.col("pos") != "punct"
    at = at.withColumn("_c", F.last(own, ignorenulls=True).over(w))
    # Without a chunk before them, the first word begins one.
    first = F.first(F.when(word & F.col("_c").isNull(), F.struct(F.col("i").cast(leaves.schema["i"].dataType).alias("start"), lone.alias("label"))), ignorenulls=True).over(W.partitionBy(key).orderBy("i"))
    at = at.withColumn("_c", F.coalesce("_c", F.when(first["start"] <= F.col("i"), first)))
    # A chunk ends at its last token that is covered, or a word that extends it; punctuation in between is in it.
    last = F.max(F.when(F.col("start").isNotNull() | word, F.col("i"))).over(W.partitionBy(key, F.col("_c.start")))
    at = at.withColumn("_end", F.when(F.col("_c").isNotNull(), last))
    mark = F.when(F.col("_c.start") == F.col("_end"), "U").when(F.col("i") == F.col("_c.start"), "B").when(F.col("i") == F.col("_end"), "L").otherwise("I")
    tag = F.when(F.col("_c").isNull() | (F.col("i") > F.col("_end")), "O").otherwise(F.concat(mark, F.lit("-"), F.col("_c.label")))
    return at.select(key, "i", tag.alias("tag"))


#: Function tags, and which child of a phrase is its head: the last one whose head has such a tag.
FUNCTION = ["ADP", "PART", "AUX", "CCONJ", "SCONJ", "PUNCT", "SYM"]
HEADED = {"root": ["VERB"], "verb": ["VERB"], "noun": ["NOUN", "PROPN", "PRON", "ADJ", "NUM"]}
RELATIONS = {
    "noun": {"NOUN": "compound", "PROPN": "compound", "PRON": "compound", "ADJ": "amod", "ADV": "advmod", "VERB": "acl", "": "compound"},
    "": {"VERB": "acl", "ADJ": "amod", "ADV": "advmod", "": "obl"},
}


def percolated(nodes: DataFrame, upos: DataFrame, key: str = "sent_id") -> DataFrame:
    """nodes (bracket_nodes) with head, the leaf (from 0) that heads each: bottom-up, a phrase takes the head of its last child
    whose head has a tag that the phrase's label asks for; a verb phrase then the last that is no function word; else the
    last child's. upos: (key, i, upos). A tree is one row: its nodes are gone through from the last to the first, so that
    children come before their parents, and those whose parent is still to come wait."""
    own = [c for c in nodes.columns if c != key]
    trees = nodes.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("node", *(c for c in own if c != "node"))), asc=False).alias("_n"))
    tags = upos.groupBy(key).agg(F.collect_list(F.struct("i", "upos")).alias("_t"))
    kind = nodes.schema["start"].dataType.simpleString()
    waiting = F.expr(f"cast(array() as array<struct<kid:int,head:{kind},upos:string,parent:int>>)")
    out = F.slice(F.transform("_n", lambda n: F.struct(n.alias("n"), n["start"].alias("head"))), 1, 0)

    def step(s: Column, n: Column) -> Column:
        low = F.lower(n["label"])
        kids = F.filter(s["wait"], lambda k: k["parent"] == n["node"])

        def fits(k: Column) -> Column:
            wanted = F.lit(False)
            for label, good in HEADED.items():
                wanted = F.when(low == label, k["upos"].isin(good)).otherwise(wanted)
            content = (low == "verb") & ~F.coalesce(k["upos"].isin(FUNCTION), F.lit(False))
            return F.struct(F.coalesce(wanted, F.lit(False)).alias("a"), content.alias("b"), k["kid"].alias("kid"), k["head"].alias("head"))

        head = F.coalesce(F.array_max(F.transform(kids, fits))["head"], n["start"])
        rest = F.filter(s["wait"], lambda k: ~k["parent"].eqNullSafe(n["node"]))
        return F.struct(rest.alias("wait"), F.array_append(s["out"], F.struct(n.alias("n"), head.alias("head"))).alias("out"))

    def then(s: Column, n: Column) -> Column:
        """The node that was just headed waits for its parent, with its head's tag."""
        last = F.get(s["out"], F.size(s["out"]) - 1)
        tag = F.get(F.filter("_t", lambda t: t["i"] == last["head"]), F.lit(0))["upos"]
        me = F.struct(n["node"].alias("kid"), last["head"].alias("head"), tag.alias("upos"), n["parent"].alias("parent"))
        return F.struct(F.when(n["parent"].isNull(), s["wait"]).otherwise(F.array_append(s["wait"], me)).alias("wait"), s["out"].alias("out"))

    headed = F.aggregate("_n", F.struct(waiting.alias("wait"), out.alias("out")), lambda s, n: F.aggregate(F.array(step(s, n)), s, lambda _, x: then(x, n)), lambda s: s["out"])
    return trees.join(tags, key, "left").select(key, F.explode(headed).alias("x")).select(key, *(F.col(f"x.n.{c}").alias(c) for c in own), F.col("x.head").alias("head"))


def arcs(headed: DataFrame, words: DataFrame, majority: DataFrame | None = None, key: str = "sent_id", marks: list[str] = []) -> DataFrame:
    """(key, i, head, deprel): dependencies of leaves (from 0; head -1 at the root). A child whose head differs from its phrase's
    depends on it; its relation is the most frequent one of its form for function words, else by its tag and the phrase's
    label. headed: percolated; words: (key, i, form, upos); majority: (form, deprel). A tree's nodes and words meet in one row."""
    nodes = headed.groupBy(key).agg(F.collect_list(F.struct("node", "parent", "head", F.lower("label").alias("phrase"), "depth")).alias("_h"))
    leaves = words.groupBy(key).agg(F.collect_list(F.struct("i", "form", "upos")).alias("_w"))
    up = lambda c: F.filter("_h", lambda u: (u["node"] == c["parent"]) & (u["head"] != c["head"]))
    links = F.flatten(F.transform("_h", lambda c: F.transform(up(c), lambda u: F.named_struct(F.lit("depth"), c["depth"], F.lit("i"), c["head"], F.lit("to"), u["head"], F.lit("phrase"), u["phrase"]))))
    roots = F.transform(F.filter("_h", lambda n: n["parent"].isNull()), lambda n: n["head"])
    trees = leaves.join(nodes, key).select(key, "_w", links.alias("_l"), F.explode(roots).alias("root"))
    at = trees.select(key, "_l", "root", F.explode("_w").alias("w")).select(key, "root", "w.*", F.array_min(F.filter("_l", lambda x: x["i"] == F.col("w.i"))).alias("l"))
    tag = F.col("upos")
    fixed = at.join(majority.select("form", F.col("deprel").alias("_m")), "form", "left") if majority is not None else at.withColumn("_m", F.lit(None).cast("string"))
    by = lambda table: F.coalesce(F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[tag], F.lit(table[""]))
    structural = F.when(F.col("l.phrase") == "noun", by(RELATIONS["noun"])).otherwise(by(RELATIONS[""]))
    function = tag.isin(FUNCTION)
    rel = (
        F.when(F.col("i") == F.col("root"), "root").when(F.col("l").isNull(), "obl").when(function & F.col("_m").isNotNull(), F.col("_m")).when(tag == "PUNCT", "punct")
        .when(tag == "NUM", "nummod").when(function, F.when(F.col("form").isin(marks), "mark").otherwise("case")).otherwise(structural)
    )
    head = F.when(F.col("i") == F.col("root"), -1).otherwise(F.coalesce("l.to", "root"))
    return fixed.select(key, "i", head.alias("head"), rel.alias("deprel"))


def records(sentences: DataFrame, size: int = 50, key: str = "sent_id", order: str = "sent_id") -> DataFrame:
    """(record, tokens, tags, sent_end_after): so many sentences (key, tokens array, tags array) by order in one record, with 1 at
    each sentence's last token."""
    batched = fixed_batches(sentences, order, size)
    ends = F.transform("tokens", lambda t, i: F.when(i == F.size("tokens") - 1, 1).otherwise(0))
    rows = batched.select("batch", F.struct(F.col(order).alias("o"), F.col("tokens").alias("t"), F.col("tags").alias("g"), ends.alias("e")).alias("s"))
    all_ = rows.groupBy(F.col("batch").alias("record")).agg(F.array_sort(F.collect_list("s")).alias("s"))
    return all_.select("record", *(F.flatten(F.col(f"s.{c}")).alias(n) for c, n in (("t", "tokens"), ("g", "tags"), ("e", "sent_end_after"))))


def repaired_entries(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries (k, headword, romanization, pos, definition) cleaned, and a report (k, change): headwords lose what follows the
    script, numerals get their own from what they mean, labels and definitions are cleaned; a row without a headword of the
    script continues the last one before it: a new romanization, a missing label and its definition go there. One with none
    before it, or without a definition, is dropped."""
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    own = rows.select("k", *(text(c).alias(c) for c in ("headword", "romanization", "pos", "definition")))
    own = own.withColumn("head", clean.strip_suffix(F.col("headword")))
    ascii_ = ~F.col("head").rlike(f"[{clean.SCRIPT}]")
    low = F.lower("definition")
    ten = low.rlike(r"^(7\s*)?ten\.$") & F.col("romanization").isin("hse", "hsei", "hce")
    four = low.contains("four.") & F.col("definition").contains("လေး") & F.col("romanization").isin("lei:", "le:")
    number = F.when(ascii_ & ten, "ဆယ်").when(ascii_ & four, "လေး").when(ascii_ & low.contains("hundred."), "ရာ")
    own = own.withColumn("number", number)
    pos = F.when(F.col("number").isNotNull() & ((F.col("pos") == "") | F.lower("pos").startswith("n")), "num").otherwise(F.col("pos"))
    good = pos.rlike(r"(?i)^(n|v|adj|adv|num|pron|aux|prep|postp|conj|interj|part|m|nm)\b")
    own = own.withColumn("pos", F.when(good, pos).otherwise("")).withColumn("plain", clean.clean_definition(F.col("definition"))).withColumn("head", F.coalesce("number", "head"))
    lemma = F.col("head").rlike(f"[{clean.SCRIPT}]")
    # The last lemma up to a row: within its block of places, else the last one of the blocks before (a row for 4,096 places).
    at = own.withColumn("is_lemma", lemma).withColumn("_b", F.floor(F.col("k") / 4096))
    inner = F.last(F.when(F.col("is_lemma"), F.col("k")), ignorenulls=True).over(W.partitionBy("_b").orderBy("k"))
    blocks = at.groupBy("_b").agg(F.max(F.when(F.col("is_lemma"), F.col("k"))).alias("_m"))
    before = blocks.select("_b", F.max("_m").over(W.orderBy("_b").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    at = at.withColumn("_in", inner).join(before, "_b").withColumn("lemma", F.coalesce("_in", "_before"))
    kept = at.filter(F.col("lemma").isNotNull() & (F.col("is_lemma") | (F.col("plain") != "")))
    parts = kept.groupBy("lemma").agg(F.array_sort(F.collect_list(F.struct("k", "head", "romanization", "pos", "plain"))).alias("p"))
    filled = lambda c: F.filter(F.col(f"p.{c}"), lambda x: x != "")
    entries = parts.select(
        F.col("lemma").alias("k"), F.get("p.head", F.lit(0)).alias("headword"), F.array_join(F.array_distinct(filled("romanization")), " / ").alias("romanization"),
        F.coalesce(F.get(filled("pos"), F.lit(0)), F.lit("")).alias("pos"), F.array_join(filled("plain"), " ").alias("definition"),
    )
    change = F.when(~F.col("is_lemma") & F.col("lemma").isNotNull() & (F.col("plain") != ""), "attached").when(~F.col("is_lemma"), "dropped")
    change = F.coalesce(change, F.when(F.col("number").isNotNull(), "numeric").when(F.col("head") != F.col("headword"), "suffix"))
    return entries, at.select("k", change.alias("change")).filter("change is not null")


def fixed_batches(rows: DataFrame, order: str, size: int = 50) -> DataFrame:
    """rows with the batch of so many consecutive ones that they are in."""
    return ranked(rows, order).withColumn("batch", F.floor(F.col("nth") / size)).drop("nth", "total")


def preferring_split(docs: DataFrame, least: int, most: int, key: str = "doc_id") -> DataFrame:
    """(key, start, end): pieces of a document's tokens, cut after the last boundary that leaves between least and most
    tokens, else after most. docs: (key, n, ends array<int>), the places after which a sentence ends, ascending."""
    zero = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int>>)").alias("out"))

    def step(s: Column, _: Column) -> Column:
        near = F.filter("ends", lambda e: (e >= s["at"] + least) & (e <= s["at"] + most))
        cut = F.least(F.coalesce(F.array_max(near), s["at"] + most), F.col("n"))
        cut = F.when(F.col("n") - s["at"] <= most, F.col("n")).otherwise(cut)
        return F.when(s["at"] >= F.col("n"), s).otherwise(F.struct(cut.alias("at"), F.array_append(s["out"], F.struct(s["at"].alias("start"), cut.alias("end"))).alias("out")))

    rounds = F.sequence(F.lit(1), F.greatest(F.ceil(F.col("n") / least).cast("int"), F.lit(1)))
    return docs.select(key, F.explode(F.aggregate(rounds, zero, step, lambda s: s["out"])).alias("p")).select(key, "p.*")


def threshold_majority(rows: DataFrame, form: str, value: str, order: str, least_n: int, least_share: float) -> DataFrame:
    """majority, of forms seen so often whose most frequent value has such a share."""
    counts = rows.groupBy(form).agg(F.count("*").alias("total"))
    return majority(rows, form, value, order).join(counts, form).filter((F.col("total") >= least_n) & (F.col("share") >= least_share))


def summary(docs: DataFrame, word: str, enders: str, text_col: str = "text") -> DataFrame:
    """One row: records, tokens, boundaries, and boundaries for each token."""
    text = F.lower(F.col(text_col))
    counted = docs.agg(F.count("*").alias("records"), F.sum(F.regexp_count(text, F.lit(word))).alias("tokens"), F.sum(F.regexp_count(text, F.lit(f"[{enders}]+"))).alias("boundaries"))
    return counted.withColumn("rate", F.col("boundaries") / F.nullif(F.col("tokens").cast("double"), F.lit(0.0)))


def distribution(rows: DataFrame, column: str) -> DataFrame:
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(counts.agg(F.sum("n").alias("_t")))).select(column, "n", (100 * F.col("n") / F.col("_t")).alias("percent"))


def agreed_boundaries(rows: DataFrame) -> DataFrame:
    """boundaries: those that both columns a and b hold, and all of forced; ascending."""
    return rows.withColumn("boundaries", F.array_sort(F.array_distinct(F.concat(F.array_intersect("a", "b"), "forced"))))


def bilu_dataset(sentences: DataFrame, profile, dev: int = 10, seed: int = 1234, key: str = "sent_id") -> DataFrame:
    """(key, split, tokens, tags): sentences (key, a whole number; words) as clusters of the script with the tags B, I, L and U of
    their words; so many of a hundred are dev, by a draw of the key. Words without clusters go, and sentences without words."""
    parts = F.filter(F.transform("words", lambda w: clusters(w, profile)), lambda c: F.size(c) > 0)
    tag = lambda c: F.when(F.size(c) == 1, F.array(F.lit("U"))).otherwise(F.transform(c, lambda _, k: F.when(k == 0, "B").when(k == F.size(c) - 1, "L").otherwise("I")))
    rows = sentences.select(key, parts.alias("_p")).filter(F.size("_p") > 0)
    split = F.when(drawn(F.col(key), 1, 100, seed) <= dev, "dev").otherwise("train")
    return rows.select(key, split.alias("split"), F.flatten("_p").alias("tokens"), F.flatten(F.transform("_p", tag)).alias("tags"))


def zipped(records: DataFrame, arrays: list[str], key: str = "doc_id") -> DataFrame:
    """(key, i, *arrays): arrays of a record joined by place, as many rows as the shortest has."""
    n = F.least(*(F.size(c) for c in arrays)) if len(arrays) > 1 else F.size(arrays[0])
    same = [F.slice(c, 1, F.greatest(n, F.lit(0))).alias(c) for c in arrays]
    return records.select(key, F.posexplode(F.arrays_zip(*same)).alias("i", "x")).select(key, "i", *(F.col(f"x.{c}").alias(c) for c in arrays))
