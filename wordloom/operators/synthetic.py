"""Synthetic documents for boundary models: sentences of a corpus as paragraphs with separators, headers and ragged lines.

Every choice is a draw of its own place (document, paragraph, sentence, purpose), so any partition can make its documents again
and the rows do not depend on how the work is dealt out. Sentences and junk are numbered tables that the draws meet in joins.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.operators.corpus import drawn, ranked

SLOTS, PURPOSES, HEADER = 64, 16, 63
MARKS = ["၊", "။"]


@dataclass(frozen=True)
class Layout:
    paragraphs: tuple[int, int] = (1, 4)
    sentences: tuple[int, int] = (2, 6)  # of a paragraph
    marks: float = 0.3  # share of separators that are the script's marks, not junk
    glued: float = 0.4  # share of separators glued to the word before them
    glued_end: float = 0.1  # share of paragraphs with one glued to their end
    header: float = 0.15  # share of paragraphs with a header before them
    line: int = 12  # words of the script in a line, one more or less
    short: int = 4  # at most so many in a paragraph's last line


def place(doc: Column, paragraph, sentence, purpose: int) -> Column:
    return ((doc * SLOTS + paragraph) * SLOTS + sentence) * PURPOSES + purpose


def line_ends(counts: np.ndarray, widths, short: int) -> list[int]:
    """After which words a paragraph's lines end, the last line apart: counts tells which words are the script's. A line ends at the
    word that fills its width, or sooner, so that more than the short last line's words are left; it has one word at least."""
    upto, out, at = np.cumsum(counts), [], 0
    total = int(upto[-1]) if len(upto) else 0
    while at < len(counts) and total - (int(upto[at - 1]) if at else 0) > short:
        before = int(upto[at - 1]) if at else 0
        full = min(int(np.searchsorted(upto, before + max(2, widths(len(out))))), len(counts) - 1)
        latest = int(np.searchsorted(upto, total - short)) - 1
        end = max(at, min(full, latest))
        out.append(end)
        at = end + 1
    return out


def documents(n: int, sentences: DataFrame, junk: DataFrame, letter: str, order: str = "id", s: Layout = Layout(), seed: int = 1) -> DataFrame:
    """(doc, tokens, gaps, labels): n documents of sentences (order, tokens array, not empty) and junk (token). labels: PARA_END after
    a paragraph's or header's last token, SENT_END after a sentence's, else O; none for the last token. gaps: what follows a
    token, a space or a line end. Without junk separators are the number sign; without sentences there are no rows."""
    spark = sentences.sparkSession
    if max(s.paragraphs) > SLOTS or max(s.sentences) >= HEADER:
        raise ValueError("too many paragraphs or sentences for the places of their draws")
    kept = sentences.select(order, "tokens").withColumn("_row", F.monotonically_increasing_id()).checkpoint().filter(F.size("tokens") > 0)  # cut once; only places are sorted
    source = ranked(kept.select(order, "_row"), order).select("nth", "_row", "total").checkpoint()
    pool = ranked(junk.select("token").distinct(), "token").select("nth", "token").checkpoint()
    total, many = source.agg(F.coalesce(F.max("total"), F.lit(0))).first()[0], pool.count()
    if not total:
        n = 0
    d, p, k = F.col("doc"), F.col("p"), F.col("k")
    some = lambda share, at: drawn(at, 1, 1000, seed) <= int(share * 1000)
    docs = spark.range(n).withColumnRenamed("id", "doc").withColumn("p", F.explode(F.sequence(F.lit(0), drawn(place(d, 0, 0, 0), *s.paragraphs, seed).cast("int") - 1)))
    paras = docs.withColumn("n", drawn(place(d, p, 0, 1), *s.sentences, seed).cast("int")).withColumn("has_header", some(s.header, place(d, p, 0, 2)))
    slots = F.concat(F.when(F.col("has_header"), F.array(F.lit(HEADER))).otherwise(F.expr("cast(array() as array<int>)")), F.sequence(F.lit(0), F.col("n") - 1))
    items = paras.withColumn("k", F.explode(slots))
    items = items.withColumn("s_nth", drawn(place(d, p, k, 3), 0, max(total - 1, 0), seed)).withColumn("j_nth", drawn(place(d, p, k, 6), 0, max(many - 1, 0), seed))
    items = items.join(source.select(F.col("nth").alias("s_nth"), "_row"), "s_nth").join(kept.select("_row", "tokens"), "_row").join(pool.select(F.col("nth").alias("j_nth"), "token"), "j_nth", "left")
    noise = F.coalesce("token", F.lit("#"))
    mark = F.get(F.array(*map(F.lit, MARKS)), drawn(place(d, p, k, 5), 0, 1, seed).cast("int"))
    sep = F.when(some(s.marks, place(d, p, k, 4)), mark).otherwise(noise)
    last = k == F.col("n") - 1
    glue = F.when(last, some(s.glued_end, place(d, p, k, 8))).otherwise(some(s.glued, place(d, p, k, 7)))
    items = items.withColumn("sep", sep).withColumn("glue", glue)
    word = lambda text, label: F.struct(text.alias("t"), label.alias("y"))
    size = F.size("tokens")
    body = F.transform("tokens", lambda t, i: word(F.when((i == size - 1) & F.col("glue"), F.concat(t, F.col("sep"))).otherwise(t), F.when(i < size - 1, "O").when(last, "PARA_END").otherwise("SENT_END")))
    after = F.when(~last & ~F.col("glue"), F.array(word(F.col("sep"), F.lit("O")))).otherwise(F.slice(body, 1, 0))
    title = F.transform(F.sequence(F.lit(0), drawn(place(d, p, HEADER, 13), 0, 2, seed).cast("int")), lambda i: F.get("tokens", F.pmod(drawn(place(d, p, i, 14), 0, 1 << 20, seed), size.cast("long")).cast("int")))
    number = lambda purpose: drawn(place(d, p, 0, purpose), 1, 999, seed).cast("string")
    head = F.concat(F.array(F.concat(number(9), F.lit("#")), number(10), F.coalesce("token", F.lit("/")), F.lit("(")), title, F.array(F.lit(")")))
    header = F.transform(head, lambda t, i: word(t, F.when(i == F.size(head) - 1, "PARA_END").otherwise("O")))
    is_header = k == HEADER
    parts = items.select(d, p, is_header.alias("header"), F.when(is_header, -1).otherwise(k).alias("k"), F.when(is_header, header).otherwise(F.concat(body, after)).alias("w"))
    whole = parts.groupBy("doc", "p", "header").agg(F.flatten(F.array_sort(F.collect_list(F.struct("k", "w")))["w"]).alias("w"))
    whole = whole.withColumn("script", F.transform("w", lambda x: x["t"].rlike(f"[{letter}]").cast("int")))

    def laid_out(batches):
        for b in batches:
            ends = []
            for doc, para, is_head, script in zip(b["doc"], b["p"], b["header"], b["script"]):
                width = lambda line: s.line + int(drawn(np.array([((doc * SLOTS + para) * SLOTS + min(line, SLOTS - 1)) * PURPOSES + 15]), -1, 1, seed)[0])  # noqa: B023, E731
                ends.append([] if is_head else line_ends(np.asarray(script), width, s.short))
            yield pd.DataFrame({"doc": b["doc"], "p": b["p"], "header": b["header"], "ends": ends})

    ends = whole.select("doc", "p", "header", "script").mapInPandas(laid_out, "doc long, p int, header boolean, ends array<int>")
    lines = whole.join(ends, ["doc", "p", "header"])
    full = F.transform("w", lambda x, i: F.struct(x["t"].alias("t"), F.when((i == F.size("w") - 1) | F.array_contains("ends", i), "\n").otherwise(" ").alias("g"), x["y"].alias("y")))
    order_ = F.struct("p", (~F.col("header")).alias("after"), full.alias("w"))
    out = lines.groupBy("doc").agg(F.flatten(F.array_sort(F.collect_list(order_))["w"]).alias("w"))
    pick = lambda name, to=None: F.transform(F.col("w") if to is None else F.slice("w", 1, to), lambda x: x[name])
    return out.select("doc", pick("t").alias("tokens"), pick("g").alias("gaps"), pick("y", F.size("w") - 1).alias("labels"))
