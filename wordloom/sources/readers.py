"""Readers and writers of the formats that corpora and lexicons come in. All keep an explicit position from the scan on."""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordloom.functions.profile import MYANMAR, ScriptProfile


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, pos, line): lines of text files with ascending positions. The positions are the scan's own numbering, which
    follows the order within a file; they are not consecutive."""
    rows = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    return rows.select("file", F.monotonically_increasing_id().alias("pos"), F.regexp_replace("value", "^﻿", "").alias("line"))


def read_lexicon(spark: SparkSession, path: str, layer: str, priority: int, profile: ScriptProfile = MYANMAR, header: bool = True) -> DataFrame:
    """Tab-separated headword, romanization, part of speech and definition (missing columns are empty) as lexicon rows.
    Rows whose headword has no character of the script are left out; a definition's lines are senses of their own."""
    lines = numbered_lines(spark, path)
    parts = F.split("line", "\t", -1)
    part = lambda k: F.trim(F.coalesce(F.get(parts, F.lit(k)), F.lit("")))
    rows = lines.select("pos", part(0).alias("headword"), part(1).alias("roman"), F.lower(part(2)).alias("pos_tag"), part(3).alias("definition"))
    if header:
        rows = rows.filter(F.lower("headword") != "headword")
    kept = rows.filter(profile.in_script(F.col("headword")))
    senses = F.filter(F.transform(F.split("definition", r"\\n|\n"), lambda x: F.trim(x)), lambda s: s != "")
    out = kept.select("headword", "roman", F.col("pos_tag").alias("pos"), F.posexplode_outer(senses).alias("k", "sense"), F.col("pos").alias("_p"))
    return out.select(F.lit(layer).alias("layer"), F.lit(priority).alias("priority"), "headword", "roman", "pos", F.coalesce("sense", F.lit("")).alias("sense"), (F.col("_p") * 1000 + F.coalesce("k", F.lit(0))).alias("pos_in_file"))


def read_overrides(spark: SparkSession, path: str, profile: ScriptProfile = MYANMAR) -> DataFrame:
    parts = F.split("line", "\t", -1)
    rows = numbered_lines(spark, path).select("pos", F.get(parts, F.lit(0)).alias("raw"), F.get(parts, F.lit(1)).alias("normalized"))
    return rows.filter(profile.in_script(F.col("normalized")))


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(token, n) of lines word, tab or last blank, count; lines that do not parse are left out and repeats are added."""
    line = F.trim("line")
    rows = numbered_lines(spark, path).select(F.regexp_extract(line, r"^(.*\S)\s+(-?\d+)$", 1).alias("token"), F.expr(r"try_cast(regexp_extract(trim(line), '^(.*\\S)\\s+(-?\\d+)$', 2) as bigint)").alias("n"))
    return rows.filter("token <> '' and n is not null").groupBy("token").agg(F.sum("n").alias("n"))


def read_pair_counts(spark: SparkSession, path: str) -> DataFrame:
    """(w1, w2, n) of lines ('w1', 'w2'), tab, count, or of three columns."""
    tuple_ = r"""^\(\s*['"](.*?)['"]\s*,\s*['"](.*?)['"]\s*\)\s+(\d+)\s*$"""
    columns = r"^([^\t]+)\t([^\t]+)\t(\d+)\s*$"
    got = lambda k: F.coalesce(F.nullif(F.regexp_extract("line", tuple_, k), F.lit("")), F.nullif(F.regexp_extract("line", columns, k), F.lit("")))
    rows = numbered_lines(spark, path).select(got(1).alias("w1"), got(2).alias("w2"), got(3).cast("bigint").alias("n"))
    return rows.filter("w1 is not null and w2 is not null and n is not null").groupBy("w1", "w2").agg(F.sum("n").alias("n"))


def read_conllu(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, tok_id, form, lemma, upos, xpos, feats, head, deprel, deps, misc): comments, ranges and empty nodes are
    left out; an underscore as upos is X, as xpos the upos. A sentence is a record of the scan, split at blank lines."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).filter("trim(value) <> ''").select(F.monotonically_increasing_id().alias("sent_id"), F.col("value"))
    lines = blocks.select("sent_id", F.posexplode(F.split("value", "\r?\n")).alias("k", "line")).filter(r"line rlike '^[0-9]+\t'")
    c = F.split("line", "\t", -1)
    at = lambda k: F.coalesce(F.get(c, F.lit(k)), F.lit("_"))
    upos = F.when(at(3) == "_", "X").otherwise(at(3))
    return lines.select(
        "sent_id", at(0).cast("int").alias("tok_id"), at(1).alias("form"), at(2).alias("lemma"), upos.alias("upos"), F.when(at(4) == "_", upos).otherwise(at(4)).alias("xpos"),
        at(5).alias("feats"), F.coalesce(F.expr("try_cast(get(split(line, '\t', -1), 6) as int)"), F.lit(0)).alias("head"), at(7).alias("deprel"), at(8).alias("deps"), at(9).alias("misc"),
    )


def conllu_text(tokens: DataFrame) -> DataFrame:
    """(sent_id, value): sentences as ten tab-separated columns, ready to be written as text with blank lines between."""
    line = F.concat_ws("\t", F.col("tok_id").cast("string"), "form", "lemma", "upos", "xpos", "feats", F.col("head").cast("string"), "deprel", "deps", "misc")
    rows = tokens.select("sent_id", "tok_id", line.alias("line")).groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("tok_id", "line"))).alias("l"))
    return rows.select("sent_id", F.concat(F.array_join("l.line", "\n"), F.lit("\n")).alias("value"))


def read_tagged_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, i, word, tag) of lines word/tag word/tag|word/tag; the last slash splits, | parts compounds."""
    rows = numbered_lines(spark, path).filter("trim(line) <> '' and not startswith(line, '#')")
    each = rows.select(F.col("pos").alias("line"), F.posexplode(F.split(F.trim("line"), r"[\s|]+")).alias("i", "t")).filter("contains(t, '/')")
    return each.select("line", "i", F.substring_index("t", "/", -1).alias("tag"), F.expr("substring(t, 1, length(t) - length(substring_index(t, '/', -1)) - 1)").alias("word"))


def read_kaikki(spark: SparkSession, path: str, lang: str) -> DataFrame:
    """(headword, roman, pos, sense, pos_in_file) of a dictionary dump in JSON lines, one row for each sense."""
    schema = "word string, lang string, pos string, forms array<struct<form: string, tags: array<string>>>, senses array<struct<glosses: array<string>>>"
    rows = spark.read.schema(schema).json(path).filter(F.col("lang") == lang).withColumn("pos_in_file", F.monotonically_increasing_id())
    roman = F.get(F.filter("forms", lambda f: F.array_contains(f["tags"], "romanization")), F.lit(0))["form"]
    out = rows.select(F.col("word").alias("headword"), F.coalesce(roman, F.lit("")).alias("roman"), "pos", F.explode("senses").alias("s"), "pos_in_file")
    return out.select("headword", "roman", "pos", F.array_join("s.glosses", "; ").alias("sense"), "pos_in_file").filter("sense <> ''")


def read_rules(spark: SparkSession, path: str) -> list[tuple[str, str]]:
    """Rewrite rules (from, to) in the order of a JSON file of one array: a parameter, not a table, so they come to the driver."""
    rows = spark.read.schema("`from` string, `to` string").option("multiLine", True).json(path)
    return [(r["from"], r["to"]) for r in rows.collect()]


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """Boundary records in JSON lines: tokens, pos, sent_end_after, source."""
    return spark.read.schema("tokens array<string>, pos array<struct<i: int, tok: string, upos: string, tag: string>>, sent_end_after array<int>, source string").json(path)


def checked_windows(rows: DataFrame) -> DataFrame:
    """rows, or an error while they are read if arrays differ in length, positions do not count up, a label is neither 0
    nor 1, or a record has no boundary."""
    n = F.size("tokens")
    ok = (F.size("pos") == n) & (F.size("sent_end_after") == n) & F.forall("sent_end_after", lambda y: y.isin(0, 1)) & F.exists("sent_end_after", lambda y: y == 1)
    ok = ok & F.forall(F.transform("pos", lambda p, k: p["i"] == k), lambda x: x)
    return rows.filter(F.assert_true(F.coalesce(ok, F.lit(False)), "a window record is not aligned").isNull())


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    """(path, paragraph, text) of Word files: paragraphs that are not empty."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

    def run(batches):
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    root = ElementTree.fromstring(z.read("word/document.xml"))
                found = ("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))
                out += [(name, k, t) for k, t in enumerate(t for t in found if t.strip())]
            yield pd.DataFrame(out, columns=["path", "paragraph", "text"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, paragraph int, text string")


def reassembled(parts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(artifact, content): shards (path, content) checked against a manifest (artifact, position, path, sha256) and joined
    in order; a shard that is missing or altered is an error."""
    both = manifest.join(parts, "path", "left")
    ok = F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False))
    checked = both.filter(F.assert_true(ok, F.concat(F.lit("shard does not match: "), "path")).isNull())
    rows = checked.groupBy("artifact").agg(F.array_sort(F.collect_list(F.struct("position", "content"))).alias("s"))
    return rows.select("artifact", F.aggregate("s", F.lit(b""), lambda a, x: F.concat(a, x["content"])).alias("content"))


def write_counts(counts: DataFrame, path: str, name: str = "token") -> None:
    """Tab-separated, count descending, then by name ascending."""
    counts.orderBy(F.desc("n"), name).write.option("sep", "\t").csv(path)


def geometry_words(chars: DataFrame, gap: float = 0.25) -> DataFrame:
    """(page, line, word, text, x0, x1): characters (page, line, x0, x1, ch, size) merged while the gap to the one before is
    under a share of their size."""
    w = W.partitionBy("page", "line").orderBy("x0")
    breaks = F.coalesce((F.col("x0") - F.lag("x1").over(w)) > gap * F.col("size"), F.lit(False)).cast("int")
    runs = chars.withColumn("_b", breaks).withColumn("word", F.sum("_b").over(w))
    out = runs.groupBy("page", "line", "word").agg(F.array_sort(F.collect_list(F.struct("x0", "ch"))).alias("c"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))
    return out.select("page", "line", "word", F.array_join("c.ch", "").alias("text"), "x0", "x1")


def average_dims(pages: DataFrame, key: str = "doc") -> DataFrame:
    """(key, width, height): means over the pages (key, width, height) whose two sizes are finite and above 0; documents without such
    a page have no row."""
    good = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    return pages.filter(good("width") & good("height")).groupBy(key).agg(F.avg("width").alias("width"), F.avg("height").alias("height"))


def run_fonts(chars: DataFrame, key: list[str]) -> DataFrame:
    """(*key, font_size, font): of each run of characters (*key, i, size, font) the median size and the most frequent font, the one
    that comes first of equally frequent ones; characters without a size or font do not count for it."""
    sizes = chars.groupBy(*key).agg(F.median("size").alias("font_size"))
    fonts = chars.filter("font is not null").groupBy(*key, "font").agg(F.count("*").alias("n"), F.min("i").alias("first"))
    best = fonts.groupBy(*key).agg(F.min_by("font", F.struct(-F.col("n"), "first")).alias("font"))
    return sizes.join(best, key, "left")
