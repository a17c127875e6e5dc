"""Divergence between the sources of a language, term by term, in whole numbers.

Each (language, source) group gives every kept term a share p of 10^9, smoothed by 2; the divergence of two groups is the sum
of f(p, q) = floor((p - q)^2 / (p + q)) over all kept terms. Most terms occur in few groups, so a sum over all terms of all
pairs would mostly add up the value of terms that neither has. Terms split into heavy and light ones instead:

* A heavy term occurs in many groups of its language. These are laid out as dense numpy tiles, terms by sources, and added
  up over all pairs of two tiles.
* A light term adds f of the two smoothed bases for each pair, but for the groups that it occurs in. What it adds more in
  one group depends on its count there, so terms of equal count are added up at once; what it adds more in pairs that both
  have it comes from the pairs of its posting, which is short.

Both parts are whole numbers and their sum is the sum over all terms exactly.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import discard, slices, word_codes, written
from wordloom.llm.filters import flat_text

SCALE, SMOOTH = 1_000_000_000, 2
#: Terms in more groups of their language than this are heavy; sources and terms of a tile.
HEAVY, TILE, CHUNK = 8, 128, 512
#: Bytes that end a term (ASCII but letters) become spaces, A-Z become lower-case; all others are parts of terms.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def share(count: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (total + 2 kept)), digit group by digit group, so that no product leaves 64 bits."""
    below = total + SMOOTH * kept
    whole, rest = np.divmod(count + SMOOTH, below)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, below)
        whole = whole * 1000 + more
    return whole + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); shares are at most 10^9 + 1, so squares stay within 64 bits."""
    return (p - q) ** 2 // (p + q)


def share_column(count: str, total: str, kept: str) -> Column:
    """As share, of columns."""
    return F.expr(f"1 + (cast({count} + {SMOOTH} as decimal(28,0)) * {SCALE}) div ({total} + {SMOOTH} * {kept})")


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group of docs (text, lang, source); a row
    with a null term has the documents of the group. Counted within each batch before the shuffle."""

    def run(batches):
        for b in slices(batches, 1 << 22):
            flat, at = flat_text(b.column(0))
            text = pa.Array.from_buffers(pa.large_string(), len(at) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(flat.tobytes().translate(TERMS))])
            words, codes, sizes = word_codes(text, lower=False)
            lang, source = b.column(1).dictionary_encode(), b.column(2).dictionary_encode()
            group = np.asarray(lang.indices, np.int64) * len(source.dictionary) + np.asarray(source.indices, np.int64)
            named, group = np.unique(group, return_inverse=True)
            width = max(len(words), 1)
            in_text, n = np.unique(np.repeat(np.arange(len(sizes)), sizes) * width + codes, return_counts=True)
            cell, at = np.unique(group[in_text // width] * width + in_text % width, return_inverse=True)
            n, docs_ = np.bincount(at, n, len(cell)).astype(np.int64), np.bincount(at, minlength=len(cell))
            whole = np.bincount(group, minlength=len(named))
            of = named[np.concatenate([cell // width, np.arange(len(named))])]
            term = pa.concat_arrays([words.take(pa.array(cell % width)).cast(pa.string()), pa.nulls(len(named), pa.string())])
            take = lambda d, i: pc.take(d.dictionary, pa.array(i))
            yield pa.RecordBatch.from_arrays(
                [take(lang, of // len(source.dictionary)), take(source, of % len(source.dictionary)), term, pa.array(np.append(n, np.zeros(len(named), np.int64))), pa.array(np.append(docs_, whole))],
                ["lang", "source", "term", "n", "docs"],
            )

    partial = docs.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return partial.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def tile_sums(tiles: DataFrame) -> DataFrame:
    """(lang, a, b, value): for each pair of sources a < b of two tiles, what their terms add. tiles: (lang, ti, tj, chunk,
    tile, at, total, kept, many, terms, counts), a row for each source of either tile. With a chunk, terms and counts are
    the heavy terms of the chunk that it has, of many; without (-1), counts are the counts of its light terms and terms
    tells how many have each, of many light terms."""

    def heavy(rows: dict[str, list], first: list[int], second: list[int], base: np.ndarray) -> np.ndarray:
        lists = rows["terms"]
        names, place = np.unique(np.concatenate([*lists, np.zeros(0, np.int64)]), return_inverse=True)
        p = np.repeat(base[:, None], len(names), axis=1)
        source = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        n = np.concatenate([*rows["counts"], np.zeros(0, np.int64)])
        p[source, place] = share(n, rows["total"][source], rows["kept"][0])
        absent = rows["many"][0] - len(names)  # terms of the chunk that no source of the two tiles has
        return np.stack([divergence(p[i][None, :], p[second]).sum(axis=1) + absent * divergence(base[i], base[second]) for i in first])

    def light(rows: dict[str, list], first: list[int], second: list[int], base: np.ndarray) -> np.ndarray:
        none = divergence(base[:, None], base[None, :])
        more = np.zeros(none.shape, np.int64)  # [i, j]: what the light terms of i add more to a pair with j
        for i, (n, many) in enumerate(zip(rows["counts"], rows["terms"])):
            for k in range(0, len(n), 4096):
                p = share(n[k : k + 4096], rows["total"][i], rows["kept"][0])
                more[i] += ((divergence(p[:, None], base[None, :]) - none[i]) * many[k : k + 4096, None]).sum(axis=0)
        return (rows["many"][0] * none + more + more.T)[np.ix_(first, second)]

    def tile(key: tuple, table: pa.Table) -> pa.Table:
        lang, ti, tj, chunk = (k.as_py() for k in key)
        rows = {c: table[c].to_numpy() for c in ("tile", "at", "total", "kept", "many")}
        rows |= {c: [np.asarray(x, np.int64) for x in table[c].to_pylist()] for c in ("terms", "counts")}
        first, second = np.flatnonzero(rows["tile"] == ti), np.flatnonzero(rows["tile"] == tj)
        base = share(np.zeros(len(rows["at"]), np.int64), rows["total"], rows["kept"][0]) if rows["kept"][0] else np.ones(len(rows["at"]), np.int64)
        value = (light if chunk < 0 else heavy)(rows, first, second, base)
        a, b = np.repeat(rows["at"][first], len(second)), np.tile(rows["at"][second], len(first))
        use = a < b
        out = [pa.array([lang] * int(use.sum()), pa.string()), pa.array(a[use]), pa.array(b[use]), pa.array(value.ravel()[use])]
        return pa.Table.from_arrays(out, ["lang", "a", "b", "value"])

    return tiles.groupBy("lang", "ti", "tj", "chunk").applyInArrow(tile, "lang string, a long, b long, value long")


def posting_sums(postings: DataFrame, most: int = 1 << 18) -> DataFrame:
    """(lang, a, b, value): for each pair of sources a < b, what light terms that both have add more than each alone. postings:
    (lang, kept, sources, counts, totals), a row for each light term, its sources in order."""

    def added(lang: np.ndarray, names: list, sizes: np.ndarray, kept: np.ndarray, at: np.ndarray, n: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
        ends = np.cumsum(sizes)
        term = np.repeat(np.arange(len(sizes)), sizes)
        partners = ends[term] - 1 - np.arange(len(at))  # of an entry: those after it
        i = np.repeat(np.arange(len(at)), partners)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(partners) - partners, partners)
        k = kept[term]
        p, base = share(n, total, k), share(np.zeros_like(n), total, k)
        value = divergence(p[i], p[j]) - divergence(p[i], base[j]) - divergence(base[i], p[j]) + divergence(base[i], base[j])
        key = np.stack([lang[term[i]], at[i], at[j]])
        order = np.lexsort(key[::-1])
        key = key[:, order]
        first = np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(axis=0)])) if len(order) else np.zeros(0, np.int64)
        sums = np.add.reduceat(value[order], first) if len(order) else np.zeros(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(key[0, first])), pa.array(key[1, first]), pa.array(key[2, first]), pa.array(sums)], ["lang", "a", "b", "value"])

    def run(batches):
        for b in batches:
            for k in range(0, b.num_rows, most // 64):
                part = b.slice(k, most // 64)
                lang = part.column(0).dictionary_encode()
                flat = [part.column(c).flatten().to_numpy() for c in (2, 3, 4)]
                yield added(np.asarray(lang.indices, np.int64), lang.dictionary.to_pylist(), np.asarray(pc.list_value_length(part.column(2)), np.int64), part.column(1).to_numpy(), *flat)

    return postings.mapInArrow(run, "lang string, a long, b long, value long")


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = 10, top: int = 10, heavy: int = HEAVY, tile: int = TILE, chunk: int = CHUNK, most_sent: int = 100_000) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the language by divergence, part `term`
    the top terms that the group has more often than its language.

    Null texts, languages and sources are empty strings; a group of empty texts alone is a group still, without counts. A
    language keeps the terms of at least so many of its documents; without any, pairs have the value 0. Ties go to the
    lesser name in UTF-8. Repeated rows count each. An empty table gives none. What a task holds is bounded by the tile
    (sources) and the chunk (terms); the result has a row for each ordered pair of sources of a language. Up to most_sent languages, their
    totals are sent to all tasks; more are joined.
    """
    src = df.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    counted = written(counts(src), "counts")
    terms = counted.filter("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.count("*").alias("sources"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_docs)
    terms = written(terms.drop("docs"), "terms")
    used = written(counted.filter("term is not null").drop("docs").join(terms, ["lang", "term"]), "used")
    of_lang = terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("in_lang").alias("lang_total"), F.count_if(F.col("sources") <= heavy).alias("light"))
    totals = used.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    of_lang = written(of_lang, "langs")
    sent = F.broadcast if of_lang.count() <= most_sent else lambda df: df  # noqa: E731  a row for each language: else joined
    groups = counted.filter("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(sent(of_lang), "lang", "left")
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    groups = written(groups.select("lang", "source", *map(zero, ("total", "kept", "lang_total", "light"))).withColumn("at", place), "groups")
    used = used.join(groups, ["lang", "source"])

    p, q = share_column("n", "total", "kept"), share_column("in_lang", "lang_total", "kept")
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    f = F.expr("(p - q) * (p - q) div (p + q)")
    more = used.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).filter("p > q").select("lang", "source", F.lit("term").alias("part"), "item", f.alias("value"))
    more = more.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)

    chunks = F.ceil(F.col("heavy") / chunk).cast("int")
    in_chunk = terms.filter(F.col("sources") > heavy).join(sent(of_lang.select("lang", (F.col("kept") - F.col("light")).alias("heavy"))), "lang")
    in_chunk = in_chunk.select("lang", "term", F.pmod(F.xxhash64("term"), chunks).cast("int").alias("chunk"))
    own = lambda name: F.transform(F.sort_array(F.collect_list(F.struct("_1", "_2"))), lambda s: s[name])
    dense = used.join(in_chunk, ["lang", "term"]).select("lang", "at", "chunk", F.xxhash64(F.lit(1), "term").alias("_1"), F.col("n").alias("_2"))
    histogram = used.filter(F.col("sources") <= heavy).groupBy("lang", "at", F.col("n").alias("_2")).agg(F.count("*").alias("_1")).withColumn("chunk", F.lit(-1))
    lists = dense.unionByName(histogram).groupBy("lang", "at", "chunk").agg(own("_1").alias("terms"), own("_2").alias("counts"))
    grid = groups.drop("light").join(in_chunk.groupBy("lang", "chunk").agg(F.count("*").alias("many")), "lang").unionByName(groups.withColumnRenamed("light", "many").withColumn("chunk", F.lit(-1)))
    last = groups.groupBy("lang").agg(F.floor(F.max("at") / tile).alias("last"))
    none = F.expr("cast(array() as array<bigint>)")
    rows = grid.join(lists, ["lang", "at", "chunk"], "left").join(last, "lang").withColumn("tile", F.floor(F.col("at") / tile)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    rows = rows.select(
        "lang", F.least("tile", "other").alias("ti"), F.greatest("tile", "other").alias("tj"), "chunk", "tile", "at", "total", "kept", "many", F.coalesce("terms", none).alias("terms"), F.coalesce("counts", none).alias("counts")
    )
    entry = F.sort_array(F.collect_list(F.struct("at", "n", "total")))
    postings = used.filter((F.col("sources") <= heavy) & (F.col("sources") > 1)).groupBy("lang", "term").agg(F.first("kept").alias("kept"), entry.alias("e"))
    postings = postings.select("lang", "kept", F.col("e.at").alias("sources"), F.col("e.n").alias("counts"), F.col("e.total").alias("totals"))
    sums = written(tile_sums(rows).unionByName(posting_sums(postings)).groupBy("lang", "a", "b").agg(F.sum("value").alias("value")), "sums")
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = groups.select("lang", "at", "source")
    pairs = both.join(names.withColumnRenamed("at", "a"), ["lang", "a"]).join(names.select("lang", F.col("at").alias("b"), F.col("source").alias("item")), ["lang", "b"])
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(best).alias("rank"))
    discard(counted)
    return pairs.unionByName(more)
