"""Readers of treebanks, grammars and marked texts, and the sinks that corpus jobs write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordloom.functions.profile import MYANMAR, ScriptProfile
from wordloom.operators import corpus, lm
from wordloom.sources.readers import numbered_lines, read_lexicon, write_counts

#: Labels that stand alone on a line of a definition and begin the senses of another part of speech.
SENSE_TAGS = ["n", "v", "adj", "adv", "pron", "part", "particle", "conj", "prep", "postp", "ppm", "interj", "aux", "num", "det", "prefix", "suffix", "m", "nm"]


def read_nested_lexicon(spark: SparkSession, path: str, layer: str, priority: int, profile: ScriptProfile = MYANMAR) -> DataFrame:
    """As readers.read_lexicon, without quoting; a definition's line that is a part of speech by itself gives the one of the lines
    after it. Senses without a part of speech are left out."""
    rows = read_lexicon(spark, path, layer, priority, profile)
    standalone = F.lower("sense").isin(SENSE_TAGS)
    entry = F.floor(F.col("pos_in_file") / 1000)
    w = W.partitionBy("_entry").orderBy("pos_in_file")
    placed = rows.withColumn("_entry", entry).withColumn("_s", standalone)
    placed = placed.withColumn("pos", F.coalesce(F.last(F.when(F.col("_s"), F.col("sense")), ignorenulls=True).over(w), "pos"))
    return placed.filter("not _s and pos <> '' and sense <> ''").drop("_entry", "_s")


def with_romanization(entries: DataFrame, roman) -> DataFrame:
    """entries whose empty romanization is derived from the headword by a column expression."""
    return entries.withColumn("roman", F.when(F.col("roman") == "", roman(F.col("headword"))).otherwise(F.col("roman")))


def read_grammar(spark: SparkSession, path: str, types: dict[str, str]) -> DataFrame:
    """(token, category, type, gloss) of tab-separated form, category and gloss; a category that has no type is UNKNOWN. A form may
    stand in several rows."""
    parts = F.split("line", "\t", -1)
    at = lambda k: F.trim(F.coalesce(F.get(parts, F.lit(k)), F.lit("")))
    rows = numbered_lines(spark, path).select(at(0).alias("token"), at(1).alias("category"), at(2).alias("gloss")).filter("token <> '' and category <> '' and lower(category) <> 'category'")
    table = F.create_map(*(F.lit(x) for kv in types.items() for x in kv)) if types else F.lit(None).cast("map<string,string>")
    return rows.select("token", "category", F.coalesce(table[F.col("category")], F.lit("UNKNOWN")).alias("type"), "gloss")


def read_pos_lookup(spark: SparkSession, path: str) -> DataFrame:
    """(head, upos array) of JSON lines; upos may be one label or a list; lines that do not parse or lack either are left out, and
    the last one of a head counts."""
    lines = numbered_lines(spark, path).filter("trim(line) <> ''")
    head = F.get_json_object("line", "$.head")
    listed = F.from_json(F.get_json_object("line", "$.upos"), "array<string>")
    upos = F.coalesce(listed, F.array(F.get_json_object("line", "$.upos")))
    rows = lines.select("pos", head.alias("head"), upos.alias("upos")).filter("head is not null and head <> '' and upos is not null and size(upos) > 0 and upos[0] is not null")
    return rows.groupBy("head").agg(F.max_by("upos", "pos").alias("upos"))


def read_phrases(spark: SparkSession, path: str, least: int = 2, most: int = 4) -> DataFrame:
    """(phrase, size, n): an inventory from lines of _-joined phrases and counts; of equal phrases the highest count."""
    parts = F.split("line", "\t", -1)
    rows = numbered_lines(spark, path).select(F.trim(F.get(parts, F.lit(0))).alias("phrase"), F.expr("try_cast(trim(get(split(line, '\t', -1), 1)) as bigint)").alias("n")).filter("n is not null")
    return lm.inventory(rows, least, most)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(file, sent_id, k, line, is_token): sentences with their comments and lines as they stand; blank lines part them."""
    blocks = spark.read.option("lineSep", "\n\n").text(path).filter("trim(value) <> ''").select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("sent_id"), "value")
    lines = blocks.select("file", "sent_id", F.posexplode(F.split(F.regexp_replace("value", r"\s+$", ""), "\r?\n")).alias("k", "line"))
    return lines.withColumn("is_token", F.col("line").rlike(r"^[0-9]+\t"))


def blocks_text(lines: DataFrame) -> DataFrame:
    """(sent_id, value): read_blocks put together again, to be written with blank lines between."""
    rows = lines.groupBy("sent_id").agg(F.array_sort(F.collect_list(F.struct("k", "line"))).alias("l"))
    return rows.select("sent_id", F.concat(F.array_join("l.line", "\n"), F.lit("\n")).alias("value"))


def sentence(tokens: DataFrame, n: int) -> DataFrame:
    """The tokens of the n-th sentence (from 0) by order of sent_id: ids are numbered by ranges, then one is filtered."""
    ids = corpus.ranked(tokens.select("sent_id").distinct(), "sent_id").filter(F.col("nth") == n)
    return tokens.join(F.broadcast(ids.select("sent_id")), "sent_id", "left_semi")


def globally_numbered(tokens: DataFrame) -> DataFrame:
    """tokens (sent_id, tok_id from 1, head, ...) with seg, the place among all tokens, and head_seg, that of the head (their own at
    a root). Sentences' sizes are summed over ranges, so no task sees all."""
    sizes = corpus.ranked(tokens.groupBy("sent_id").agg(F.count("*").alias("n")), "sent_id").checkpoint()
    blocks = sizes.groupBy(F.floor(F.col("nth") / 4096).alias("b")).agg(F.sum("n").alias("s"))
    before = blocks.select("b", (F.sum("s").over(W.orderBy("b")) - F.col("s")).alias("_b"))  # one row for 4,096 sentences
    inner = F.sum("n").over(W.partitionBy(F.floor(F.col("nth") / 4096)).orderBy("nth")) - F.col("n")
    start = sizes.withColumn("_i", inner).withColumn("b", F.floor(F.col("nth") / 4096)).join(before, "b").select("sent_id", (F.col("_b") + F.col("_i")).alias("_start"))
    placed = tokens.join(start, "sent_id").withColumn("seg", F.col("_start") + F.col("tok_id") - 1)
    return placed.withColumn("head_seg", F.when(F.col("head") > 0, F.col("_start") + F.col("head") - 1).otherwise(F.col("seg"))).drop("_start")


def read_bracketed(spark: SparkSession, path: str) -> DataFrame:
    """(sent_id, tree) of lines SNT.id, tab, bracketed tree; others are left out."""
    at = lambda k: F.regexp_extract("line", r"^(SNT\.\S+)\t\s*(\(.*\))\s*$", k)
    return numbered_lines(spark, path).select(at(1).alias("sent_id"), at(2).alias("tree")).filter("sent_id <> ''")


def leaves(trees: DataFrame, key: str = "sent_id", text_col: str = "tree") -> DataFrame:
    """(key, i, pos, token) of a tree's leaves (pos token), in order."""
    found = lambda k: F.regexp_extract_all(F.col(text_col), F.lit(r"\(([^\s()]+)\s+([^\s()]+)\)"), F.lit(k))
    rows = trees.select(key, F.posexplode_outer(F.arrays_zip(found(1).alias("pos"), found(2).alias("token"))).alias("i", "x")).filter("i is not null")
    return rows.select(key, "i", "x.pos", "x.token")


def sniffed(spark: SparkSession, path: str, most: int = 200) -> str:
    """conllu, bracketed or unknown, by the first lines of a file (what a look at its head is)."""
    head = [r.value for r in spark.read.text(path).limit(most).collect()]
    if any(line.count("\t") >= 9 and line.split("\t")[0].isdigit() for line in head):
        return "conllu"
    return "bracketed" if any(line.startswith("SNT.") and "\t(" in line for line in head) else "unknown"


def marked_sentences(texts: DataFrame, marker: str = "<SENT_END>", key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, k, sentence): texts cut at a literal marker, without empty pieces; null texts have none."""
    parts = F.filter(F.transform(F.split(F.col(text_col), rf"\Q{marker}\E"), lambda x: F.trim(x)), lambda x: x != "")
    return texts.select(key, F.posexplode_outer(parts).alias("k", "sentence")).filter("k is not null")


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files as texts; bytes that are no UTF-8 become replacement characters."""
    return spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def windows_of(leaf_rows: DataFrame, most: int, source: str, key: str = "sent_id") -> DataFrame:
    """Boundary records (tokens, pos, sent_end_after, source) of sentences (key, i, pos, token) packed up to so many tokens without
    being cut; a longer sentence is a record of its own."""
    sents = leaf_rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "token", "pos"))).alias("s")).withColumn("size", F.size("s").cast("long"))
    ordered = corpus.ranked(sents.select(key, "size"), key).select(F.col(key).alias("_k"), "nth", "size").checkpoint()
    block = F.floor(F.col("nth") / 1024)  # packing is sequential, so it starts anew every 1,024 sentences
    packed = corpus.packed_windows(ordered.select(block.alias("b"), F.col("nth").alias("sentence"), "size"), most, "b")
    member = packed.select("b", "window", F.explode(F.sequence("first", "last")).alias("nth")).join(ordered.select("_k", "nth"), "nth")
    rows = member.join(sents, member["_k"] == sents[key]).groupBy("b", "window").agg(F.array_sort(F.collect_list(F.struct("nth", "s"))).alias("w"))
    flat = F.flatten(F.col("w.s"))
    ends = F.flatten(F.transform("w", lambda x: F.transform(x["s"], lambda _, i: F.when(i == F.size(x["s"]) - 1, 1).otherwise(0))))
    pos = F.transform(flat, lambda x, i: F.struct(i.alias("i"), x["token"].alias("tok"), x["pos"].alias("upos"), x["pos"].alias("tag")))
    return rows.select(F.transform(flat, lambda x: x["token"]).alias("tokens"), pos.alias("pos"), ends.alias("sent_end_after"), F.lit(source).alias("source"))


def write_windows(rows: DataFrame, path: str) -> DataFrame:
    """Writes boundary records as JSON lines and gives one row of totals: records, tokens, boundaries."""
    rows.write.json(path)
    back = rows.sparkSession.read.schema(rows.schema).json(path)
    return back.agg(F.count("*").alias("records"), F.sum(F.size("tokens")).alias("tokens"), F.sum(F.size(F.filter("sent_end_after", lambda y: y == 1))).alias("boundaries"))


def write_training(tokens: DataFrame, path: str) -> None:
    """Parser training rows as Parquet, one for each token: its head as an offset (0 at a root) and whether it starts a sentence.
    Stands for the binary container of an external library, which is not here."""
    rows = tokens.withColumn("head_offset", F.when(F.col("head") > 0, F.col("head") - F.col("tok_id")).otherwise(0)).withColumn("sent_start", F.col("tok_id") == 1)
    rows.write.parquet(path)


def append_events(events: DataFrame, path: str, checkpoint: str):
    """A stream's records, appended as JSON lines; gives the running query."""
    return events.writeStream.format("json").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).start()


def islands_of(texts: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, island, text): texts cut at white space and the script's comma and full stop alone."""
    parts = F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[\s၊။]+"), lambda x: x != "")
    return texts.select(key, F.posexplode_outer(parts).alias("island", "text")).filter("island is not null")


def ngram_build(rows: DataFrame, known: DataFrame, path: str, most: int = 4, key: str = "doc_id") -> dict[str, DataFrame]:
    """The n-gram job over islands' tokens (key, i, token): words, pairs and phrases of known tokens, unknown ones apart; then, in a
    second pass over the greedy phrases, pairs of units. Four sorted files and the unknown words as JSON go to path."""
    vocabulary = known.select(F.col("word").alias("token")).distinct()
    unknown = rows.join(vocabulary, "token", "left_anti").groupBy("token").agg(F.count("*").alias("n"))
    arrays = lm.in_order(rows.join(vocabulary, "token", "left_semi"), key).checkpoint()
    words = arrays.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    phrases = lm.spans(arrays, 2, most)
    units = lm.units(arrays, lm.phrases(arrays, lm.inventory(phrases, 1, most), most, key), key)
    out = {"unigram": words, "bigram": lm.bigrams(arrays), "unigram-phrase": phrases.select("phrase", "n"), "bigram-phrase": lm.bigrams(units)}
    for name, counts in out.items():
        pair = "w1" in counts.columns
        rows_ = counts.select(F.concat(F.lit("('"), "w1", F.lit("', '"), "w2", F.lit("')")).alias("token"), "n") if pair else counts.select(F.col(counts.columns[0]).alias("token"), "n")
        write_counts(rows_, f"{path}/{name}")
    unknown.orderBy(F.desc("n"), "token").write.json(f"{path}/unknown")
    return out | {"unknown": unknown}


def joined_records(parts: DataFrame, manifest: DataFrame) -> DataFrame:
    """(artifact, key, value): JSON objects in shards (path, content) as one table, each shard checked against the manifest
    (artifact, path, sha256); a key that two shards of an artifact hold is an error."""
    both = manifest.join(parts, "path", "left")
    ok = F.coalesce(F.sha2("content", 256) == F.col("sha256"), F.lit(False))
    checked = both.filter(F.assert_true(ok, F.concat(F.lit("shard does not match: "), "path")).isNull())
    text = F.decode("content", "UTF-8")
    pairs = checked.select("artifact", F.explode(F.json_object_keys(text)).alias("key"), text.alias("t"))
    rows = pairs.select("artifact", "key", F.expr("get_json_object(t, concat(\"$['\", key, \"']\"))").alias("value"))
    n = F.count("*").over(W.partitionBy("artifact", "key"))
    return rows.withColumn("_n", n).filter(F.assert_true(F.col("_n") == 1, F.concat(F.lit("key occurs twice: "), "key")).isNull()).drop("_n")
