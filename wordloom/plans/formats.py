"""Registered queries of files, characters, fields, overlays and treebank repairs: each runs one operator over a whole table.

Queries of files write a table in a format into the session's shared folder, read it back by its reader, and compare that
with the table itself. What they wrote is deleted once it is read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordloom.functions import clean, markers, tags
from wordloom.functions import text as tx
from wordloom.functions import syllables as syl
from wordloom.functions.profile import LATIN, MYANMAR
from wordloom.operators import boundary, clauses, corpus, lexicon, lm, segment, synthetic, tagging
from wordloom.plans.analysis import DRAW, FROM, LBL, MY_SQL, TO, labelled_parts, script_docs
from wordloom.plans.oracle import BENCH, PWORDS, TREES, WORD, tok
from wordloom.plans.queries import OWN_FOLDER, bench_arrays, doc_tokens, part_words, table, trees
from wordloom.sources import readers, treebanks

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def read_back(spark, write, read) -> DataFrame:
    """What read(path) gives of what write(path) wrote to a folder of its own, which then goes."""
    path = f"{(spark.conf.get('spark.checkpoint.dir', None) or OWN_FOLDER).rstrip('/')}/files-{uuid.uuid4().hex}"
    write(path)
    out = read(path).checkpoint()
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
    return out


def parts(spark, sf) -> DataFrame:
    """The parts with two more fields, a maker and a box."""
    told = lambda word, n: F.concat(F.lit(word), (F.col("p_size") % n).cast("string"))
    return table(spark, sf, "part").withColumn("p_mfgr", told("maker ", 5)).withColumn("p_container", told("box ", 7))


def lines(df: DataFrame, line):
    return lambda path: df.select(line.alias("value")).write.text(path)


# Files.

@query("""SELECT 'part' AS layer, p_name AS headword, p_brand AS roman, lower(p_type) AS pos, unnest([p_container, p_mfgr]) AS sense FROM (SELECT *, 'maker ' || p_size % 5 AS p_mfgr, 'box ' || p_size % 7 AS p_container FROM part)""")
def lexicon_files(spark, sf):
    """The parts as a tab-separated lexicon: two senses each."""
    p = parts(spark, sf)
    line = F.concat_ws("\t", "p_name", "p_brand", "p_type", F.concat("p_container", F.lit("\\n"), "p_mfgr"))
    got = read_back(spark, lines(p, line), lambda path: readers.read_lexicon(spark, path, "part", 1, LATIN))
    return got.select("layer", "headword", "roman", "pos", "sense")


@query("""SELECT p_name AS headword, x.pos, x.sense FROM (SELECT p_name, unnest([{'pos': lower(p_type), 'sense': p_container}, {'pos': 'n', 'sense': p_mfgr}]) AS x FROM (SELECT *, 'maker ' || p_size % 5 AS p_mfgr, 'box ' || p_size % 7 AS p_container FROM part))""")
def nested_lexicon_files(spark, sf):
    """The parts as a lexicon whose second sense stands under a part of speech of its own."""
    p = parts(spark, sf)
    line = F.concat_ws("\t", "p_name", "p_brand", "p_type", F.concat("p_container", F.lit("\\nn\\n"), "p_mfgr"))
    got = read_back(spark, lines(p, line), lambda path: treebanks.read_nested_lexicon(spark, path, "part", 1, LATIN))
    return got.select("headword", "pos", "sense")


@query("SELECT lower(p_name) AS raw, p_name AS normalized, count(*) AS n FROM (SELECT *, 'maker ' || p_size % 5 AS p_mfgr, 'box ' || p_size % 7 AS p_container FROM part) WHERE p_size % 2 = 0 GROUP BY ALL")
def override_files(spark, sf):
    """Text overrides: those whose replacement has no letter of the script are left out."""
    p = parts(spark, sf)
    line = F.concat_ws("\t", F.lower("p_name"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.lit("12")))
    return read_back(spark, lines(p, line), lambda path: readers.read_overrides(spark, path, LATIN)).groupBy("raw", "normalized").agg(F.count("*").alias("n"))


@query("""SELECT p_name AS token, p_brand AS category, CASE p_brand WHEN 'Brand#11' THEN 'NOUN_MARKER' WHEN 'Brand#22' THEN 'VERB_MARKER' ELSE 'UNKNOWN' END AS type, p_mfgr AS gloss FROM (SELECT *, 'maker ' || p_size % 5 AS p_mfgr, 'box ' || p_size % 7 AS p_container FROM part)""")
def grammar_files(spark, sf):
    line = F.concat_ws("\t", "p_name", "p_brand", "p_mfgr")
    types = {"Brand#11": "NOUN_MARKER", "Brand#22": "VERB_MARKER"}
    return read_back(spark, lines(parts(spark, sf), line), lambda path: treebanks.read_grammar(spark, path, types))


@query(f"WITH {BENCH} SELECT token, count(*) AS n FROM btok GROUP BY 1")
def unigram_files(spark, sf):
    words = lm.unigrams(tx.tokens(table(spark, sf, "benchmark"), LATIN, "item_id"))
    return read_back(spark, lambda path: readers.write_counts(words.select("token", "n"), path), lambda path: readers.read_counts(spark, path))


@query(f"WITH {BENCH}, n AS (SELECT token AS w1, lead(token) OVER (PARTITION BY item_id ORDER BY i) AS w2 FROM btok) SELECT w1, w2, count(*) AS n FROM n WHERE w2 IS NOT NULL GROUP BY 1, 2")
def bigram_files(spark, sf):
    """Pairs as tuples and as columns, half of them each; equal pairs are added."""
    pairs = lm.bigrams(bench_arrays(spark, sf)).withColumn("_half", F.pmod(F.xxhash64("w1", "w2"), F.lit(2)))
    as_tuple = F.concat(F.lit("('"), "w1", F.lit("', '"), "w2", F.lit("')\t"), F.col("n").cast("string"))
    line = F.when(F.col("_half") == 0, as_tuple).otherwise(F.concat_ws("\t", "w1", "w2", F.col("n").cast("string")))
    return read_back(spark, lines(pairs, line), lambda path: readers.read_pair_counts(spark, path))


SPANS_SQL = f"""{BENCH}, bnx AS (SELECT token, lead(token, 1) OVER w AS t1, lead(token, 2) OVER w AS t2, lead(token, 3) OVER w AS t3 FROM btok WINDOW w AS (PARTITION BY item_id ORDER BY i)),
    spn AS (SELECT token || '_' || t1 AS phrase, 2 AS size FROM bnx WHERE t1 IS NOT NULL UNION ALL SELECT token || '_' || t1 || '_' || t2, 3 FROM bnx WHERE t2 IS NOT NULL UNION ALL SELECT token || '_' || t1 || '_' || t2 || '_' || t3, 4 FROM bnx WHERE t3 IS NOT NULL)"""


@query(f"WITH {SPANS_SQL} SELECT phrase, size, count(*) AS n FROM spn GROUP BY 1, 2 HAVING count(*) >= 2")
def phrase_files(spark, sf):
    """The passages' phrases as an inventory file."""
    s = lm.spans(bench_arrays(spark, sf)).select("phrase", "n")
    got = read_back(spark, lambda path: readers.write_counts(s.withColumnRenamed("phrase", "token"), path), lambda path: treebanks.read_phrases(spark, path, 2))
    return got.select("phrase", "size", "n")


def treebank(spark, sf) -> DataFrame:
    """The passages' trees as treebank rows."""
    t = tx.tokens(table(spark, sf, "benchmark"), LATIN, "item_id").select(F.col("item_id").alias("sent_id"), "i", F.col("token").alias("form"))
    heads = trees(spark, sf).select(F.col("doc").alias("sent_id"), "i", "head")
    none = F.lit("_")
    upos = F.when(F.length("form") % 3 == 0, "NOUN").otherwise("VERB")
    return t.join(heads, ["sent_id", "i"]).select(
        "sent_id", (F.col("i") + 1).alias("tok_id"), "form", none.alias("lemma"), upos.alias("upos"), none.alias("xpos"), none.alias("feats"), F.coalesce(F.col("head") + 1, F.lit(0)).alias("head"),
        F.when(F.col("head").isNull(), "root").otherwise("dep").alias("deprel"), none.alias("deps"), none.alias("misc"),
    )


BANK = f"""{TREES}, bnk AS (SELECT doc AS sent_id, t.i + 1 AS tok_id, token AS form, CASE WHEN length(token) % 3 = 0 THEN 'NOUN' ELSE 'VERB' END AS upos, coalesce(head + 1, 0) AS head, CASE WHEN head IS NULL THEN 'root' ELSE 'dep' END AS deprel
    FROM tre t JOIN btok b ON b.item_id = t.doc AND b.i = t.i)"""


def written_bank(spark, sf):
    return lambda path: readers.conllu_text(treebank(spark, sf)).select("value").write.text(path)


@query(f"WITH {BANK} SELECT tok_id, form, upos, upos AS xpos, head, deprel, count(*) AS n FROM bnk GROUP BY ALL")
def conllu_files(spark, sf):
    got = read_back(spark, written_bank(spark, sf), lambda path: readers.read_conllu(spark, path))
    return got.groupBy("tok_id", "form", "upos", "xpos", "head", "deprel").agg(F.count("*").alias("n"))


@query(f"WITH {BANK} SELECT md5(string_agg(tok_id || chr(9) || form || chr(9) || '_' || chr(9) || upos || chr(9) || '_' || chr(9) || '_' || chr(9) || head || chr(9) || deprel || chr(9) || '_' || chr(9) || '_', chr(10) ORDER BY tok_id) || chr(10)) AS block_md5, count(*) AS tokens FROM bnk GROUP BY sent_id")
def conllu_blocks(spark, sf):
    """Blocks of a treebank file, read line by line and put together again as they were."""
    got = read_back(spark, written_bank(spark, sf), lambda path: treebanks.read_blocks(spark, path))
    counts = got.groupBy("sent_id").agg(F.count_if("is_token").alias("tokens"))
    return treebanks.blocks_text(got).join(counts, "sent_id").select(F.md5("value").alias("block_md5"), "tokens")


@query(f"""WITH {BANK}, s AS (SELECT sent_id, count(*) AS n FROM bnk GROUP BY 1), b AS (SELECT sent_id, sum(n) OVER (ORDER BY sent_id) - n AS start FROM s)
    SELECT sent_id, tok_id, (start + tok_id - 1)::BIGINT AS seg, (start + CASE WHEN head > 0 THEN head ELSE tok_id END - 1)::BIGINT AS head_seg FROM bnk JOIN b USING (sent_id)""")
def numbered_treebank(spark, sf):
    """Places of tokens and heads among all tokens."""
    return treebanks.globally_numbered(treebank(spark, sf)).select("sent_id", "tok_id", "seg", "head_seg")


@query(f"WITH {BANK}, s AS (SELECT sent_id FROM bnk GROUP BY 1 ORDER BY 1 LIMIT 1 OFFSET 3) SELECT sent_id, tok_id, form FROM bnk SEMI JOIN s USING (sent_id)")
def fourth_sentence(spark, sf):
    return treebanks.sentence(treebank(spark, sf), 3).select("sent_id", "tok_id", "form")


@query(f"""WITH {BANK} SELECT sent_id, tok_id, form, CASE WHEN head > 0 THEN head - tok_id ELSE 0 END AS head_offset, tok_id = 1 AS sent_start FROM bnk""")
def training_files(spark, sf):
    """Parser training rows, written as Parquet and read again."""
    rows = treebank(spark, sf)
    got = read_back(spark, lambda path: treebanks.write_training(rows, path), lambda path: spark.read.parquet(path))
    return got.select("sent_id", "tok_id", "form", "head_offset", "sent_start")


@query(f"WITH {BENCH} SELECT i, token || CASE WHEN length(token) % 2 = 0 THEN '' ELSE '/v' END AS word, CASE WHEN length(token) % 2 = 0 THEN 'n' ELSE 'x' END AS tag, count(*) AS n FROM btok GROUP BY ALL")
def tagged_line_files(spark, sf):
    """Words with tags in lines, and in compounds; the last slash parts them."""
    b = bench_arrays(spark, sf)
    each = F.transform("t", lambda t: F.concat(t, F.when(F.length(t) % 2 == 0, "/n").otherwise("/v/x")))
    line = F.array_join(F.transform(each, lambda w, k: F.concat(w, F.when(k % 2 == 0, "|").otherwise(" "))), "")
    got = read_back(spark, lines(b, F.regexp_replace(line, r"[| ]$", "")), lambda path: readers.read_tagged_lines(spark, path))
    return got.groupBy("i", "word", "tag").agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT p_name, max(p_partkey) AS k FROM (SELECT *, 'maker ' || p_size % 5 AS p_mfgr, 'box ' || p_size % 7 AS p_container FROM part) GROUP BY 1) SELECT p_name AS head, CASE WHEN k % 2 = 0 THEN 'NOUN|VERB' ELSE 'ADJ' END AS upos FROM p""")
def pos_lookup_files(spark, sf):
    """Parts of speech in JSON lines, one label or a list; the last line of a head counts, broken lines do not."""
    p = parts(spark, sf).groupBy("p_name").agg(F.max("p_partkey").alias("k"))
    good = F.when(F.col("k") % 2 == 0, F.to_json(F.struct(F.col("p_name").alias("head"), F.array(F.lit("NOUN"), F.lit("VERB")).alias("upos")))).otherwise(F.to_json(F.struct(F.col("p_name").alias("head"), F.lit("ADJ").alias("upos"))))
    rows = p.select(good.alias("v"), F.lit("{broken").alias("b"), F.to_json(F.struct(F.lit("").alias("head"), F.lit("X").alias("upos"))).alias("e"))
    got = read_back(spark, lines(rows.select(F.explode(F.array("b", "e", "v")).alias("x")), F.col("x")), lambda path: treebanks.read_pos_lookup(spark, path))
    return got.select("head", F.array_join("upos", "|").alias("upos"))


@query("""SELECT p_name AS headword, p_brand AS roman, lower(p_type) AS pos, unnest([p_container || '; ' || p_mfgr, 'size ' || p_size]) AS sense FROM (SELECT *, 'maker ' || p_size % 5 AS p_mfgr, 'box ' || p_size % 7 AS p_container FROM part) WHERE p_size % 3 <> 0""")
def dictionary_dumps(spark, sf):
    """The parts as a dictionary dump in JSON lines; other languages are left out."""
    lang = F.when(F.col("p_size") % 3 == 0, "Latin").otherwise("Parts")
    forms = F.array(F.struct(F.lit("x").alias("form"), F.array(F.lit("plural")).alias("tags")), F.struct(F.col("p_brand").alias("form"), F.array(F.lit("romanization")).alias("tags")))
    senses = F.array(F.struct(F.array("p_container", "p_mfgr").alias("glosses")), F.struct(F.array(F.concat(F.lit("size "), F.col("p_size").cast("string"))).alias("glosses")))
    rows = parts(spark, sf).select(F.col("p_name").alias("word"), lang.alias("lang"), F.lower("p_type").alias("pos"), forms.alias("forms"), senses.alias("senses"))
    got = read_back(spark, lambda path: rows.write.json(path), lambda path: readers.read_kaikki(spark, path, "Parts"))
    return got.select("headword", "roman", "pos", "sense")


def phrase_lines(spark, sf) -> DataFrame:
    words = F.transform(F.split("p_name", " "), lambda w, k: F.concat(F.lit("("), F.when(k % 2 == 0, "N ").otherwise("V "), w, F.lit(")")))
    return parts(spark, sf).select(F.concat(F.lit("SNT."), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("sent_id"), F.concat(F.lit("(S (NP "), F.array_join(words, " "), F.lit("))")).alias("tree"))


@query("""WITH w AS (SELECT 'SNT.' || lpad(p_partkey::VARCHAR, 9, '0') AS sent_id, string_split(p_name, ' ') AS w FROM part) SELECT sent_id, unnest(range(len(w)))::INTEGER AS i, unnest(list_transform(w, lambda x, k: CASE WHEN k % 2 = 1 THEN 'N' ELSE 'V' END)) AS pos, unnest(w) AS token FROM w""")
def bracketed_files(spark, sf):
    """Leaves of bracketed trees; lines that are none are left out."""
    rows = phrase_lines(spark, sf).select(F.explode(F.array(F.concat_ws("\t", "sent_id", "tree"), F.lit("# a note"))).alias("x"))
    return treebanks.leaves(read_back(spark, lines(rows, F.col("x")), lambda path: treebanks.read_bracketed(spark, path)))


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part) SELECT 'SNT.' || lpad(p_partkey::VARCHAR, 9, '0') AS sent_id, 'NP' AS label, 0 AS start, len(w)::INTEGER AS "end" FROM w""")
def base_chunks(spark, sf):
    return corpus.base_chunks(corpus.bracket_nodes(phrase_lines(spark, sf)), ["NP"])


@query("""WITH w AS (SELECT sum(len(string_split(p_name, ' ')))::BIGINT AS tokens, count(*) AS boundaries FROM part) SELECT tokens, boundaries FROM w""")
def window_files(spark, sf):
    """Boundary records of the parts' words, written, counted, read again and checked."""
    found = treebanks.windows_of(treebanks.leaves(phrase_lines(spark, sf)), 40, "parts")

    def read(path):
        rows = readers.checked_windows(readers.read_windows(spark, path))
        return rows.agg(F.sum(F.size("tokens")).alias("tokens"), F.sum(F.size(F.filter("sent_end_after", lambda y: y == 1))).alias("boundaries"))

    return read_back(spark, lambda path: treebanks.write_windows(found, path), read)


@query("""WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(replace(coalesce(text, ''), '. ', '<SENT_END>'), '<SENT_END>'), lambda x: trim(x, ' ')), lambda x: x <> '') AS s FROM documents)
    SELECT doc_id, unnest(range(len(s)))::INTEGER AS k, md5(unnest(s)) AS sentence_md5 FROM s""")
def marked_sentences(spark, sf):
    """The documents cut at markers that stand for periods."""
    d = table(spark, sf, "documents").select("doc_id", F.replace(F.coalesce("text", F.lit("")), F.lit(". "), F.lit("<SENT_END>")).alias("text"))
    return treebanks.marked_sentences(d).select("doc_id", "k", F.md5("sentence").alias("sentence_md5"))


@query(f"""WITH s AS (SELECT doc_id, list_filter(string_split_regex({MY_SQL}, '[ \\t\\n\\x0B\\f\\r၊။]+'), lambda x: x <> '') AS s FROM documents) SELECT doc_id, unnest(range(len(s)))::INTEGER AS island, unnest(s) AS text FROM s""")
def script_islands(spark, sf):
    """The documents in Myanmar letters, cut at white space, comma and full stop."""
    return treebanks.islands_of(script_docs(spark, sf))


@query(f"""WITH {BENCH}, k AS (SELECT * FROM btok WHERE length(token) > 3), a AS (SELECT item_id, list(token ORDER BY i) AS t FROM k GROUP BY 1)
    SELECT 'unigram' AS kind, token, count(*) AS n FROM k GROUP BY 2 UNION ALL SELECT 'unknown', token, count(*) FROM btok WHERE length(token) <= 3 GROUP BY 2
    UNION ALL SELECT 'bigram', w1 || ' ' || w2, count(*) FROM (SELECT unnest(t[1:len(t) - 1]) AS w1, unnest(t[2:]) AS w2 FROM a WHERE len(t) > 1) GROUP BY 2""")
def ngram_files(spark, sf):
    """The n-gram job over the passages: words of over three letters are known; its files are read again."""
    t = tx.tokens(table(spark, sf, "benchmark"), LATIN, "item_id").withColumnRenamed("item_id", "doc_id")

    def read(path):
        words = readers.read_counts(spark, f"{path}/unigram").select(F.lit("unigram").alias("kind"), "token", "n")
        pairs = readers.read_pair_counts(spark, f"{path}/bigram").select(F.lit("bigram").alias("kind"), F.concat_ws(" ", "w1", "w2").alias("token"), "n")
        unknown = spark.read.schema("token string, n long").json(f"{path}/unknown").select(F.lit("unknown").alias("kind"), "token", "n")
        return words.unionByName(pairs).unionByName(unknown)

    return read_back(spark, lambda path: treebanks.ngram_build(t, t.filter(F.length("token") > 3).select(F.col("token").alias("word")), path), read)


# Characters and fields.

RAWS = f"""rw AS (SELECT DISTINCT CASE WHEN length(w) % 2 = 0 THEN translate(lower(w), '{FROM}', '{TO}') ELSE w END AS w FROM (SELECT unnest(string_split_regex(coalesce(text, ''), '[ \\t\\n\\x0B\\f\\r]+')) AS w FROM documents) WHERE w <> '')"""


def raw_words(spark, sf) -> DataFrame:
    """Distinct words of the documents as spaces part them, those of even length in Myanmar letters."""
    w = table(spark, sf, "documents").select(F.explode(F.array_distinct(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\x0B\f\r]+"))).alias("w")).filter("w <> ''")
    return w.select(F.when(F.length("w") % 2 == 0, F.translate(F.lower("w"), FROM, TO)).otherwise(F.col("w")).alias("w")).distinct()


@query(rf"""WITH {RAWS} SELECT w, regexp_matches(w, '[က-႟]') AS in_script, length(regexp_replace(w, '[^က-႟]', '', 'g'))::INTEGER AS n_script, regexp_matches(w, '(^|[^္])[က-ဪဿ]') AS base, regexp_matches(w, '[ါ-ှၖ-ၙႂ-ႍ]') AS marks,
    regexp_matches(w, '[က-႟]') AND regexp_matches(w, '[A-Za-z0-9]') AS mixed, regexp_matches(w, '^[\p{{N}}\p{{P}}\p{{S}}]+$') OR (NOT regexp_matches(w, '[က-႟]') AND length(w) <= 2) AS garbage,
    trim(regexp_replace(w, '[^က-႟]', '', 'g')) AS headword, CASE WHEN regexp_replace(w, '[^က-႟ꧠ-꧿ꩠ-ꩿ]+$', '') <> '' THEN regexp_replace(w, '[^က-႟ꧠ-꧿ꩠ-ꩿ]+$', '') ELSE w END AS stripped FROM rw""")
def script_predicates(spark, sf):
    w = F.col("w")
    return raw_words(spark, sf).select(
        "w", MYANMAR.in_script(w).alias("in_script"), tx.in_script_count(w, MYANMAR).alias("n_script"), tx.has_base_letter(w).alias("base"), tx.has_marks(w).alias("marks"), tx.is_mixed(w).alias("mixed"),
        tx.is_garbage(w).alias("garbage"), MYANMAR.headword(w).alias("headword"), clean.strip_suffix(w).alias("stripped"),
    )


@query(rf"""WITH {RAWS}, c AS (SELECT unnest(regexp_extract_all(w, '(?s).')) AS c FROM rw) SELECT c AS char, CASE WHEN regexp_matches(c, '[\p{{L}}]') AND regexp_matches(c, '[\x{{1000}}-\x{{109F}}\x{{A9E0}}-\x{{A9FF}}\x{{AA60}}-\x{{AA7F}}]') THEN 'MY_L'
    WHEN regexp_matches(c, '[\p{{M}}]') AND regexp_matches(c, '[\x{{1000}}-\x{{109F}}\x{{A9E0}}-\x{{A9FF}}\x{{AA60}}-\x{{AA7F}}]') THEN 'MY_M' WHEN regexp_matches(c, '\p{{Nd}}') THEN 'DIG' WHEN regexp_matches(c, '[\p{{P}}\p{{S}}]') THEN 'PUN' WHEN regexp_matches(c, '[A-Za-z]') THEN 'ASC' ELSE 'OTH' END AS class, count(*) AS n FROM c GROUP BY 1""")
def char_classes(spark, sf):
    c = raw_words(spark, sf).select(F.explode(F.split("w", "")).alias("char")).filter("char <> ''")
    return c.groupBy("char", clean.char_class(F.col("char")).alias("class")).agg(F.count("*").alias("n"))


CLUSTER_SQL = "'[က-ဿ၊-႟][ါ-ှၖ-ၙၞ-ၠၢ-ၤၧ-ၭၱ-ၴႂ-ႍႏ႔ႚ-ႝ]*|[^က-ဿ၊-႟][^က-႟]*'"


@query(f"""WITH {RAWS}, m AS (SELECT w, regexp_extract_all(w, {CLUSTER_SQL}) AS c FROM rw WHERE NOT contains(w, '္'))
    SELECT w, array_to_string(c, '|') AS clusters, array_to_string(flatten(list_transform(c, lambda x, k: list_transform(range(length(x)), lambda y: k - 1))), ',') AS of_char FROM m""")
def cluster_maps(spark, sf):
    """Clusters of words, and for each character the number of its cluster."""
    c = tx.clusters(F.col("w"), MYANMAR)
    return raw_words(spark, sf).filter(~F.contains("w", F.lit("္"))).select("w", F.array_join(c, "|").alias("clusters"), F.array_join(tx.cluster_of_char(c).cast("array<string>"), ",").alias("of_char"))


@query(f"""WITH {RAWS}, s AS (SELECT w AS text, regexp_extract_all(w, '{MYANMAR.word}') AS w, string_split_regex(w, '{MYANMAR.word}') AS b FROM rw), r AS (SELECT text, unnest(range(1, len(w) + 1)) AS k, w, b FROM s),
    p AS (SELECT text, k, w[k] AS run, sum(length(b[k]) + length(w[k])) OVER (PARTITION BY text ORDER BY k) AS e FROM r) SELECT text, (e - length(run))::INTEGER AS start, e::INTEGER AS "end", run FROM p""")
def script_spans(spark, sf):
    """Runs of the script in the words, with their places."""
    runs = tx.script_runs(F.col("w"), MYANMAR)
    return raw_words(spark, sf).select("w", F.explode_outer(runs).alias("r")).filter("r is not null").select(F.col("w").alias("text"), "r.*")


@query(f"""WITH w AS (SELECT item_id, lower(text) AS t, regexp_extract_all(lower(text), '{WORD}') AS w, string_split_regex(lower(text), '{WORD}') AS b FROM benchmark), r AS (SELECT item_id, w, b, unnest(range(1, len(w) + 1)) AS k FROM w),
    p AS (SELECT item_id, k, w[k] AS seg, sum(length(b[k]) + length(w[k])) OVER (PARTITION BY item_id ORDER BY k) AS e FROM r)
    SELECT item_id, (k - 1)::INTEGER AS i, (e - length(seg))::INTEGER AS start, e::INTEGER AS "end" FROM p""")
def aligned_tokens(spark, sf):
    """Words of the passages found again in their texts, one after another; one that is not there gets no place."""
    t = F.lower("text")
    words = F.regexp_extract_all(t, F.lit(LATIN.word), F.lit(0))
    with_lost = F.flatten(F.transform(words, lambda w: F.array(w, F.lit("#?"))))
    spans = table(spark, sf, "benchmark").select("item_id", F.filter(tx.char_spans(t, with_lost), lambda s: s.isNotNull()).alias("s"))
    return spans.select("item_id", F.posexplode("s").alias("i", "x")).select("item_id", "i", "x.start", "x.end")


@query(f"""WITH {BENCH}, o AS (SELECT item_id, i, token, i * 2 + CASE WHEN i % 5 = 0 THEN 1 ELSE 0 END AS s, i * 2 + 2 AS e, length(token) > 2 AS w FROM btok), l AS (SELECT *, lag(w) OVER x AS pw, lag(e) OVER x AS pe FROM o WINDOW x AS (PARTITION BY item_id ORDER BY i))
    SELECT item_id, i, CASE WHEN w THEN sum(CASE WHEN w AND NOT coalesce(pw AND pe = s, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY item_id ORDER BY i) - 1 END::BIGINT AS island FROM l""")
def offset_islands(spark, sf):
    """Words of over two letters joined where one begins as the other ends; every fifth begins later."""
    t = tx.tokens(table(spark, sf, "benchmark"), LATIN, "item_id")
    start = F.col("i") * 2 + F.when(F.col("i") % 5 == 0, 1).otherwise(0)
    s = t.select("item_id", "i", start.alias("start"), (F.col("i") * 2 + 2).alias("end"), (F.length("token") > 2).alias("is_word"))
    return tx.islands_by_offset(s, "item_id").select("item_id", "i", "island")


@query("""SELECT p_partkey, trim(regexp_replace(p_name || ' ' || p_mfgr, '\\s+', ' ', 'g')) AS definition, CASE WHEN p_size >= 40 THEN 3 WHEN p_size >= 20 THEN 2 WHEN p_size >= 5 THEN 1 ELSE 0 END AS bucket,
    CASE WHEN p_size % 4 = 0 THEN 7.0::DOUBLE ELSE round(p_retailprice::DOUBLE, 2) END AS price, CASE p_size % 3 WHEN 0 THEN 'NOUN' WHEN 1 THEN 'VERB' ELSE 'SCONJ' END AS pos FROM (SELECT *, 'maker ' || p_size % 5 AS p_mfgr, 'box ' || p_size % 7 AS p_container FROM part)""")
def cleaned_fields(spark, sf):
    """Definitions without notes, sense marks and pointers; sizes by cut points; values that are no numbers; labels' tags."""
    p = parts(spark, sf)
    raw = F.concat(F.lit(" 7:2 "), "p_name", F.lit(" [Pali note] "), "p_mfgr", F.lit(" See illus at "), "p_brand")
    price = F.when(F.col("p_size") % 8 == 0, F.lit(float("nan"))).when(F.col("p_size") % 4 == 0, F.lit(float("inf"))).otherwise(F.col("p_retailprice").cast("double"))
    label = F.when(F.col("p_size") % 3 == 0, "POS=NOUN|Number=Sing").when(F.col("p_size") % 3 == 1, "verb").otherwise("POS=CONJ")
    return p.select("p_partkey", clean.clean_definition(raw).alias("definition"), tx.bucket(F.col("p_size"), [5, 20, 40]).alias("bucket"), F.round(clean.finite(price, 7.0), 2).alias("price"), tags.label_pos(label).alias("pos"))


@query("""SELECT doc_id, md5(replace(replace(coalesce(text, ''), 'the', 'ze'), 'ze ', 'Z')) AS text_md5 FROM documents""")
def text_overrides(spark, sf):
    """Literal replacements in order, so that the second sees what the first has made."""
    return table(spark, sf, "documents").select("doc_id", F.md5(tx.replace_all(F.coalesce("text", F.lit("")), [("the", "ze"), ("ze ", "Z")])).alias("text_md5"))


def syllable_sql() -> str:
    """Classes and breaks as SQL: chars of a table sd (id, t) in order, and whether a break follows."""
    body = lambda x: "[" + __import__("re").sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", x) + "]"
    kind = "CASE " + " ".join(f"WHEN regexp_matches(c, '{body(v)}') THEN {k + 1}" for k, v in enumerate(syl.CLASSES.values())) + " ELSE 0 END"
    table_ = "[" + ", ".join(str(x) for row in syl.BETWEEN for x in row) + "]"
    return f"""cr AS (SELECT id, k, l[k] AS c, l[k + 1] AS c1, l[k + 2] AS c2, l[k + 3] AS c3 FROM (SELECT id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT id, regexp_extract_all(t, '(?s).') AS l FROM sd))),
    ck AS (SELECT DISTINCT c, {kind} AS kind FROM cr), cb AS (SELECT cr.*, {table_}[a.kind * 9 + b.kind + 1] AS st FROM cr JOIN ck a ON a.c = cr.c JOIN ck b ON b.c = cr.c1),
    sb AS (SELECT id, k, st IN (0, 2, 3, 4) OR (st = 5 AND c <> chr(4129) AND c1 <> chr(4159) AND NOT coalesce(c2 IN (chr(4153), chr(4154)), FALSE) AND NOT coalesce(c2 = chr(4151) AND c3 = chr(4154), FALSE)) AS cut FROM cb)"""


@query(f"""WITH sd AS (SELECT w AS id, w AS t FROM (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex({MY_SQL}, '[\\n]')) AS w FROM documents) WHERE w <> '')), {syllable_sql()}
    SELECT md5(cr.id) AS line_md5, md5(string_agg(cr.c || CASE WHEN coalesce(cut, FALSE) THEN '|' ELSE '' END, '' ORDER BY cr.k)) AS syllables_md5, (count(*) FILTER (WHERE cut) + 1)::INTEGER AS n FROM cr LEFT JOIN sb ON sb.id = cr.id AND sb.k = cr.k GROUP BY cr.id""")
def rule_syllables(spark, sf):
    """Distinct lines of the documents in Myanmar letters, broken into syllables by rules."""
    t = script_docs(spark, sf).select(F.explode(F.split("text", "\n")).alias("t")).filter("t <> ''").distinct()
    return t.withColumn("s", syl.syllables(F.col("t"))).select(F.md5("t").alias("line_md5"), F.md5(F.array_join("s", "|")).alias("syllables_md5"), F.size("s").alias("n"))


REWRITES = [("th", "z"), ("([aeiou])(n)?d", "\\2\\1"), ("z(?=e)", "Z"), ("Z", "$")]


@query("""SELECT doc_id, md5(replace(replace(regexp_replace(replace(lower(coalesce(text, '')), 'th', 'z'), '([aeiou])(n)?d', '\\2\\1', 'g'), 'ze', 'Ze'), 'Z', '$')) AS text_md5 FROM documents""")
def rewrite_cascades(spark, sf):
    """An ordered cascade of rewrites over the documents."""
    return table(spark, sf, "documents").select("doc_id", F.md5(clean.rewritten(F.lower(F.coalesce("text", F.lit(""))), REWRITES)).alias("text_md5"))


# Clauses.

FORMS = ["စာ", "သွား", "ဖတ်", "ဆို", "ဟု", "မယ်", "သည်", "ရင်", "မှု", "က", "သော", "၍", "တို့", "မည်", "ခဲ့", "ကြောင့်", "တာ", "မှာ", "ပြီး", "ကျမ", "လောက်", "အိမ်ရှေ့က"]
KINDS, RELATIONS = ["VERB", "NOUN", "PART", "SCONJ", "ADP", "PUNCT", "ADJ", "CCONJ"], ["acl", "root", "obj"]


def _listed(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _longest(words: list[str]) -> str:
    return _listed(sorted(words, key=lambda w: (-len(w), w)))


def clause_marks_sql() -> str:
    """Marker sequences of sentences of fifteen words of the documents, and what they are."""
    final, quotes = _listed(markers.FINAL), _listed(markers.QUOTES)
    return f"""{tok()}, tk0 AS (SELECT doc_id * 100000 + i // 15 AS doc, i % 15 AS i, {_listed(FORMS)}[(length(token) * 3 + ascii(token)) % {len(FORMS)} + 1] AS form, {_listed(KINDS)}[(length(token) + ascii(right(token, 1)) * 5) % 8 + 1] AS pos, {_listed(RELATIONS)}[length(token) % 3 + 1] AS deprel FROM tok),
    tk AS MATERIALIZED (SELECT *, coalesce(last_value(CASE WHEN pos <> 'PUNCT' THEN form END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
        coalesce(first_value(CASE WHEN pos <> 'PUNCT' THEN form END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after FROM tk0),
    sq AS (SELECT doc, i AS verb, i AS j, deprel, []::STRUCT(i BIGINT, form VARCHAR, pos VARCHAR)[] AS m FROM tk WHERE (pos = 'VERB' OR (pos = 'ADJ' AND deprel IN ('acl', 'root'))) AND NOT (form = '{markers.SAY}' AND pos = 'VERB' AND list_contains({quotes}, before))
        UNION ALL SELECT s.doc, s.verb, t.i, s.deprel, CASE WHEN t.pos = 'PUNCT' THEN m ELSE list_append(m, {{'i': t.i::BIGINT, 'form': t.form, 'pos': t.pos}}) END FROM sq s JOIN tk t ON t.doc = s.doc AND t.i = s.j + 1 AND t.i <= s.verb + 12
        WHERE t.pos IN ('PUNCT', 'PART', 'SCONJ', 'ADP', 'CCONJ') OR (t.form = '{markers.SAY}' AND len(m) > 0 AND ((list_contains({final}, m[-1].form) AND list_contains({_listed(markers.CONDITIONS)}, t.after)) OR (t.pos = 'VERB' AND list_contains({quotes}, m[-1].form) AND list_contains({final}, t.after))))),
    sm AS (SELECT doc, verb, deprel, arg_max(m, j) AS m FROM sq GROUP BY 1, 2, 3), sl AS (SELECT *, list_transform(m, lambda x: x.form) AS f, list_filter(m, lambda x: NOT list_contains({_listed(markers.AUXILIARIES)}, x.form)) AS a FROM sm WHERE len(m) > 0),
    sn AS (SELECT *, array_to_string(f, '') AS joined, m[-1].form AS z, list_filter(a, lambda x: list_contains({_listed(markers.NOMINALIZERS)}, x.form) AND x.pos IN ('PART', 'NOUN')) AS n FROM sl),
    ss AS (SELECT *, list_filter({_longest(markers.STRONG)}, lambda w: w = joined OR list_contains(f, w) OR (length(w) > 1 AND ends_with(joined, w)))[1] AS strong, list_filter({_longest(markers.MODERATE)}, lambda w: list_contains(f, w))[1] AS moderate, list_contains({final}, z) AS fin,
        len(n) > 0 AND n[1].i = a[1].i AND len(list_filter(a[2:], lambda x: NOT (list_contains({_listed(markers.NOMINAL_TAIL)}, x.form) OR x.pos IN ('ADP', 'SCONJ')))) = 0 AS phrase FROM sn),
    ck AS (SELECT doc, verb, m[-1].i AS ends, CASE WHEN phrase THEN {{'k': 'nominalizer', 't': a[1].form}} WHEN strong IS NOT NULL THEN {{'k': 'strong', 't': strong}} WHEN fin AND len(n) > 0 AND list_contains({_listed(markers.CASE_LIKE)}, z) THEN {{'k': 'nominalizer', 't': n[1].form}}
        WHEN fin AND deprel = 'acl' AND list_contains({_listed(markers.ADNOMINAL)}, z) THEN {{'k': 'relativizer', 't': z}} WHEN fin AND z = '{markers.TOPIC}' AND list_contains(f, '{markers.PLURAL}') THEN {{'k': 'none', 't': NULL}} WHEN fin AND (len(a) = 0 OR list_contains({final}, a[-1].form)) THEN {{'k': 'final', 't': z}}
        WHEN list_contains({_listed(markers.NOMINALIZERS)}, z) AND m[-1].pos IN ('PART', 'NOUN') THEN {{'k': 'nominalizer', 't': z}} WHEN list_contains({_listed(markers.RELATIVIZERS)}, z) THEN {{'k': 'relativizer', 't': z}} WHEN moderate IS NOT NULL THEN {{'k': 'moderate', 't': moderate}} ELSE {{'k': 'none', 't': NULL}} END AS c FROM ss)"""


def clause_tokens(spark, sf) -> DataFrame:
    """(doc, t): the documents' words as tokens in Burmese, in sentences of fifteen, which are cut within a text's array. The
    texts are dealt out first, so that a table in one file keeps all cores busy."""
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n % len(words) + 1).cast("int"))
    n = F.size("t")
    cut = F.transform(F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / 15).cast("int"))), lambda g: F.slice("t", g * 15 + 1, F.lit(15)))
    rows = tx.token_arrays(table(spark, sf, "documents").select("doc_id", "text").repartition("doc_id"), LATIN).select("doc_id", F.posexplode_outer(cut).alias("g", "w")).filter("w is not null")
    token = lambda w, k: F.struct(
        k.alias("i"), pick(FORMS, F.length(w) * 3 + F.ascii(w)).alias("form"), pick(KINDS, F.length(w) + F.ascii(F.right(w, F.lit(1))) * 5).alias("pos"), pick(RELATIONS, F.length(w)).alias("deprel"),
    )
    return rows.select((F.col("doc_id") * 100000 + F.col("g").cast("long")).alias("doc"), F.transform("w", token).alias("t"))


@query(f"WITH RECURSIVE {clause_marks_sql()} SELECT c.k AS kind, c.t AS trigger, count(*) AS n, sum(ends - verb)::BIGINT AS reach FROM ck GROUP BY 1, 2")
def clause_markers(spark, sf):
    """What the marker sequences after the verbs are, and how far they reach."""
    found = clauses.classified(clauses.marker_sequences(clause_tokens(spark, sf)))
    return found.groupBy("kind", "trigger").agg(F.count("*").alias("n"), F.sum(F.try_element_at("m", F.lit(-1))["i"] - F.col("verb")).cast("long").alias("reach"))


@query(f"WITH RECURSIVE {clause_marks_sql()} SELECT doc, verb, ends AS \"end\", c.k AS kind, c.t AS trigger FROM ck WHERE c.k NOT IN ('none', 'nominalizer')")
def clause_boundaries(spark, sf):
    return clauses.boundaries(clause_tokens(spark, sf))


@query(f"""WITH RECURSIVE {clause_marks_sql()}, cu AS (SELECT doc, ends, arg_min(c, verb) AS c FROM ck WHERE c.k IN ('strong', 'final', 'moderate') GROUP BY 1, 2), ln AS (SELECT doc, max(i) AS last FROM tk GROUP BY 1),
    al AS (SELECT doc, ends, c.k AS kind, c.t AS trigger FROM cu UNION ALL SELECT l.doc, l.last, CASE WHEN x.doc IS NULL THEN 'single' ELSE 'remainder' END, NULL FROM ln l LEFT JOIN (SELECT doc, max(ends) AS e FROM cu GROUP BY 1) x ON x.doc = l.doc WHERE x.e IS NULL OR x.e < l.last),
    sp AS (SELECT *, coalesce(lag(ends) OVER (PARTITION BY doc ORDER BY ends) + 1, 0) AS first FROM al), tx AS (SELECT s.doc, s.first, s.ends, s.kind, s.trigger, coalesce(string_agg(t.form, ' ' ORDER BY t.i) FILTER (WHERE t.pos <> 'PUNCT'), '') AS text FROM sp s JOIN tk t ON t.doc = s.doc AND t.i BETWEEN s.first AND s.ends GROUP BY ALL)
    SELECT doc, first, ends AS last, md5(text) AS text_md5, kind, trigger FROM tx WHERE text <> '' OR kind = 'single'""")
def clause_chunks(spark, sf):
    """Sentences of the documents' words cut at their clauses' ends."""
    return clauses.clause_chunks(clause_tokens(spark, sf)).select("doc", "first", "last", F.md5("text").alias("text_md5"), "kind", "trigger")


# Overlays and entities.

@query("""WITH e AS (SELECT user_id AS doc, event_id AS i, event_type = 'purchase' AS kept FROM events), l AS (SELECT *, max(CASE WHEN kept THEN i END) OVER (PARTITION BY doc ORDER BY i) AS l, min(CASE WHEN kept THEN i END) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS r FROM e)
    SELECT doc, i, CASE WHEN r IS NULL OR i - l <= r - i THEN coalesce(l, r) ELSE r END AS "to" FROM l WHERE NOT kept""")
def nearest_kept(spark, sf):
    """Each event that is no purchase with the nearest purchase of its user."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.col("event_id").alias("i"), "event_type")
    return tagging.nearest_kept(e, F.col("event_type") == "purchase")


@query("""WITH e AS (SELECT user_id AS doc, event_type AS label, count(*) AS n, sum(value) AS v FROM events GROUP BY 1, 2), g AS (SELECT doc, arg_max(label, {'v': v, 'l': label}) AS guess FROM e GROUP BY 1),
    a AS (SELECT doc, arg_max(label, {'n': n, 'l': label}) AS best, list(label) AS labels FROM e WHERE label IN ('view', 'click', 'signup') GROUP BY 1)
    SELECT doc, CASE WHEN labels IS NULL OR list_contains(labels, guess) THEN guess ELSE best END AS tag, coalesce(NOT list_contains(labels, guess), FALSE) AS changed FROM g LEFT JOIN a USING (doc)""")
def count_overrides(spark, sf):
    """A user's type of the greatest value, unless the counted ones among three types rule it out."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("doc"), F.col("event_type").alias("label")).agg(F.count("*").alias("n"), F.sum("value").alias("v")).withColumn("i", F.lit(0))
    guess = e.groupBy("doc", "i").agg(F.max_by("label", F.struct("v", "label")).alias("label"))
    return tagging.override_counts(guess, e.filter("label in ('view', 'click', 'signup')").select("doc", "i", "label", "n")).select("doc", "tag", "changed")


@query("""WITH e AS (SELECT user_id AS doc, event_type AS label, event_id % 3 AS part, sum(value) - 40 AS v FROM events GROUP BY 1, 2, 3), s AS (SELECT *, v - least(min(v) OVER (PARTITION BY doc, part), 0) AS u FROM e), t AS (SELECT *, coalesce(u / nullif(sum(u) OVER (PARTITION BY doc, part), 0), 0) AS w FROM s),
    n AS (SELECT doc, count(DISTINCT part) AS n FROM e GROUP BY 1), m AS (SELECT doc, label, sum(w) / any_value(n) AS x FROM t JOIN n USING (doc) GROUP BY 1, 2)
    SELECT doc, label, round(coalesce(x / nullif(max(x) OVER (PARTITION BY doc), 0), 0), 5) AS score FROM m""")
def subword_scores(spark, sf):
    """Types of a user's events as tags of a compound whose parts are the events by number modulo three."""
    e = table(spark, sf, "events").groupBy(F.col("user_id").alias("doc"), F.lit(0).alias("i"), (F.col("event_id") % 3).alias("part"), F.col("event_type").alias("label")).agg((F.sum("value") - 40).alias("logit"))
    return tagging.subword_scores(e).select("doc", "label", F.round("score", 5).alias("score"))


ENTS = f"""{BENCH}, ens AS (SELECT item_id AS doc, i AS start, i + 2 + i % 2 AS "end", CASE WHEN i % 2 = 0 THEN 'PER' ELSE 'LOC' END AS label FROM btok WHERE i % 7 = 3)"""


def entities(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Tokens of the passages, and entities of two or three tokens at every seventh place."""
    t = tx.tokens(table(spark, sf, "benchmark"), LATIN, "item_id").withColumnRenamed("item_id", "doc")
    e = t.filter("i % 7 = 3").select("doc", F.col("i").alias("start"), (F.col("i") + 2 + F.col("i") % 2).alias("end"), F.when(F.col("i") % 2 == 0, "PER").otherwise("LOC").alias("label"))
    return t, e


@query(f"""WITH {ENTS} SELECT b.item_id AS doc, b.i, e.label IS NOT NULL AS ner_protected, e.label AS ner_label FROM btok b LEFT JOIN ens e ON e.doc = b.item_id AND b.i >= e.start AND b.i < e."end" """)
def flagged_fills(spark, sf):
    t, e = entities(spark, sf)
    return tagging.flagged_fills(t, e).select("doc", "i", "ner_protected", "ner_label")


@query(f"""WITH {ENTS}, a AS (SELECT b.item_id AS doc, b.i, b.token, coalesce(e.start, b.i) AS f, e.label FROM btok b LEFT JOIN ens e ON e.doc = b.item_id AND b.i >= e.start AND b.i < e."end")
    SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY f) - 1 AS p, string_agg(token, '' ORDER BY i) AS text, string_agg(i::VARCHAR, ',' ORDER BY i) AS members, max(label) AS label FROM a GROUP BY doc, f""")
def collapsed_entities(spark, sf):
    """The passages with each entity as one token."""
    t, e = entities(spark, sf)
    runs = e.select("doc", F.col("start").alias("first"), (F.col("end") - 1).alias("last"), "label")
    done = tagging.collapsed(t.withColumnRenamed("token", "segment"), runs)
    return done.select("doc", F.col("p").cast("long").alias("p"), "text", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "label")


@query(f"""WITH {ENTS}, s AS (SELECT item_id AS doc, i // 10 AS sentence, min(i) AS ss, max(i) + 1 AS se FROM btok GROUP BY 1, 2), l AS (SELECT *, greatest(se - 3, ss) AS ls, se AS le FROM s)
    SELECT e.doc, e.start, e."end", e.label FROM ens e WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.doc = e.doc AND e.start >= ss AND e.start < se AND e.start < le AND e."end" > ls)""")
def entities_off_last_islands(spark, sf):
    """Entities that do not touch the last three tokens of their sentence of ten."""
    t, e = entities(spark, sf)
    s = t.groupBy("doc", F.floor(F.col("i") / 10).alias("sentence")).agg(F.min("i").alias("sent_start"), (F.max("i") + 1).alias("sent_end"))
    last = F.greatest(F.col("sent_end") - 3, F.col("sent_start"))
    spans = s.withColumn("start", last).withColumn("end", F.col("sent_end")).unionByName(s.filter(last > F.col("sent_start")).withColumn("start", F.col("sent_start")).withColumn("end", last))
    return tagging.off_last_islands(e, spans)


@query("""WITH l AS (SELECT DISTINCT p_name AS head, p_mfgr AS note FROM (SELECT p_name, min(p_mfgr) AS p_mfgr FROM (SELECT *, 'maker ' || p_size % 5 AS p_mfgr, 'box ' || p_size % 7 AS p_container FROM part) GROUP BY 1)), r AS (SELECT p_name AS head, CASE WHEN max(p_size) % 2 = 0 THEN max(p_brand) END AS note, max(p_size) AS extra FROM (SELECT *, 'maker ' || p_size % 5 AS p_mfgr, 'box ' || p_size % 7 AS p_container FROM part) WHERE p_size > 45 GROUP BY 1)
    SELECT head, coalesce(r.note, l.note) AS note, r.extra FROM l FULL JOIN r USING (head)""")
def overlaid_fields(spark, sf):
    """Two overlays of the parts' names; filled fields of the second one come first."""
    p = parts(spark, sf)
    left = p.groupBy(F.col("p_name").alias("head")).agg(F.min("p_mfgr").alias("note"))
    right = p.filter("p_size > 45").groupBy(F.col("p_name").alias("head")).agg(F.when(F.max("p_size") % 2 == 0, F.max("p_brand")).alias("note"), F.max("p_size").alias("extra"))
    return lexicon.overlaid(left, right, ["head"])


@query("""WITH c AS (SELECT p_name AS headword, CASE WHEN p_partkey % 5 = 0 THEN ' ' ELSE p_mfgr END AS note, p_partkey AS ts FROM (SELECT *, 'maker ' || p_size % 5 AS p_mfgr, 'box ' || p_size % 7 AS p_container FROM part)) SELECT headword, arg_max(note, ts) AS note, max(ts) AS ts FROM c GROUP BY 1 HAVING length(trim(arg_max(note, ts))) > 0""")
def upserted_notes(spark, sf):
    """Notes on the parts' names, the last one of each; an empty one deletes."""
    rows = parts(spark, sf).select(F.col("p_name").alias("headword"), F.when(F.col("p_partkey") % 5 == 0, " ").otherwise(F.col("p_mfgr")).alias("note"), F.col("p_partkey").alias("ts"))
    return lexicon.upsert(rows.filter("ts % 2 = 0"), rows.filter("ts % 2 = 1"))


@query("""WITH s AS (SELECT p_name AS headword, p_brand AS roman, p_type AS pos, list(p_container ORDER BY p_partkey) AS senses, min(p_partkey) AS k FROM (SELECT *, 'maker ' || p_size % 5 AS p_mfgr, 'box ' || p_size % 7 AS p_container FROM part) GROUP BY 1, 2, 3),
    r AS (SELECT headword, roman, min(k) AS k, string_agg(pos || ':' || array_to_string(senses, ','), ';' ORDER BY k) AS g FROM s GROUP BY 1, 2) SELECT headword, string_agg(roman || '=' || g, '|' ORDER BY k) AS groups FROM r GROUP BY 1""")
def grouped_senses(spark, sf):
    """Containers of the parts as senses of their names, by brand, then type, in the order of the keys."""
    e = parts(spark, sf).select(F.col("p_name").alias("headword"), F.col("p_brand").alias("roman"), F.col("p_type").alias("pos"), F.col("p_container").alias("sense"), F.col("p_partkey").alias("pos_in_file"))
    inner = lambda x: F.concat(x["pos"], F.lit(":"), F.array_join(x["senses"], ","))
    shown = F.array_join(F.transform("groups", lambda r: F.concat(r["roman"], F.lit("="), F.array_join(F.transform(r["groups"], inner), ";"))), "|")
    return lexicon.grouped_senses(e).select("headword", shown.alias("groups"))


# Treebank repairs, merges of segments.

@query(f"""WITH {BANK}, b AS (SELECT * REPLACE (CASE WHEN tok_id % 5 = 0 THEN 'case' WHEN tok_id % 5 = 1 THEN 'compound' ELSE deprel END AS deprel, CASE WHEN sent_id % 4 = 0 AND head = 0 THEN 1 ELSE head END AS head) FROM bnk),
    r AS (SELECT sent_id, coalesce(min(tok_id) FILTER (WHERE head = 0 AND deprel = 'root'), min(tok_id) FILTER (WHERE head = 0)) AS p, coalesce(min(tok_id) FILTER (WHERE deprel = 'root'), max(tok_id)) AS c FROM b GROUP BY 1),
    x AS (SELECT b.*, p, c, CASE deprel WHEN 'case' THEN tok_id - 1 WHEN 'compound' THEN tok_id + 1 ELSE p END AS near FROM b JOIN r USING (sent_id))
    SELECT x.sent_id, x.tok_id, CASE WHEN p IS NULL THEN CASE WHEN x.tok_id = c THEN 0 ELSE x.head END WHEN x.head = 0 AND x.tok_id <> p THEN CASE WHEN n.tok_id IS NULL OR n.head = 0 OR n.head = x.tok_id THEN p ELSE near END ELSE x.head END::INTEGER AS head, x.deprel
    FROM x LEFT JOIN b n ON n.sent_id = x.sent_id AND n.tok_id = x.near""")
def repaired_roots(spark, sf):
    """The passages' trees with one root each; some have none."""
    deprel = F.when(F.col("tok_id") % 5 == 0, "case").when(F.col("tok_id") % 5 == 1, "compound").otherwise(F.col("deprel"))
    t = treebank(spark, sf).withColumn("head", F.when((F.col("sent_id") % 4 == 0) & (F.col("head") == 0), 1).otherwise(F.col("head"))).withColumn("deprel", deprel)
    return corpus.repair_roots(t).select("sent_id", "tok_id", "head", "deprel")


@query(f"""WITH {BANK}, k AS (SELECT *, row_number() OVER (PARTITION BY sent_id ORDER BY tok_id)::INTEGER AS new FROM bnk WHERE length(form) > 3)
    SELECT k.sent_id, k.new AS tok_id, k.form, coalesce(h.new, 0) AS head, CASE WHEN h.new IS NULL THEN 'root' ELSE k.deprel END AS deprel FROM k LEFT JOIN k h ON h.sent_id = k.sent_id AND h.tok_id = k.head""")
def dropped_tokens(spark, sf):
    """The passages' trees without short words."""
    return corpus.drop_tokens(treebank(spark, sf), F.length("form") <= 3).select("sent_id", "tok_id", "form", "head", "deprel")


@query("""WITH w AS (SELECT p_partkey AS doc_id, string_split(p_name, ' ') AS w FROM part), s AS (SELECT doc_id, w, list_transform(range(len(w)), lambda k: length(array_to_string(w[1:k], ''))) AS s FROM w)
    SELECT doc_id, i, start, "end", token FROM (SELECT doc_id, 0 AS i, 0 AS start, length(w[1] || coalesce(w[2], ''))::INTEGER AS "end", w[1] || coalesce(w[2], '') AS token FROM s
        UNION ALL SELECT doc_id, k - 1, s[k], s[k] + length(w[k]), w[k] FROM (SELECT doc_id, w, s, unnest(range(3, len(w) + 1)) AS k FROM s))""")
def merged_spans(spark, sf):
    """Words of the parts' names with the first two merged, as a dictionary has them; a span that cuts a word changes nothing."""
    p = parts(spark, sf).select(F.col("p_partkey").alias("doc_id"), F.split("p_name", " ").alias("w"))
    ends = F.aggregate("w", F.array(F.lit(0)), lambda s, x: F.array_append(s, F.element_at(s, -1) + F.length(x)))
    t = p.withColumn("e", ends).select("doc_id", F.posexplode("w").alias("i", "token"), "e").select("doc_id", "i", F.get("e", F.col("i")).alias("start"), F.get("e", F.col("i") + 1).alias("end"), "token")
    two = p.filter(F.size("w") > 1).select("doc_id", F.lit(0).alias("start"), (F.length(F.get("w", F.lit(0))) + F.length(F.get("w", F.lit(1)))).alias("end"))
    cut = two.select("doc_id", F.lit(1).alias("start"), "end")
    return segment.aligned_merges(t, two.unionByName(cut)).select("doc_id", F.col("i").cast("int").alias("i"), "start", "end", "token")


@query(f"""WITH {BENCH}, l AS (SELECT item_id, token, i FROM btok), e AS (SELECT item_id, arg_max(token, i) AS t FROM l GROUP BY 1), c AS (SELECT t AS token, count(*) AS n FROM e GROUP BY 1), r AS (SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS k FROM c)
    SELECT token, n, CASE WHEN k <= 10 THEN '10' WHEN k <= 50 THEN '50' WHEN k <= 200 THEN '200' ELSE 'more' END AS bucket FROM r""")
def end_word_buckets(spark, sf):
    """Words that end passages, by rank."""
    ends = boundary.end_words(tx.tokens(table(spark, sf, "benchmark"), LATIN, "item_id"), ["item_id"])
    return ends.withColumn("k", F.row_number().over(W.orderBy(F.desc("n"), "token"))).select("token", "n", boundary.rank_bucket(F.col("k")).alias("bucket"))


# Labels, marks, pages, pieces.

PREFIX_SQL = "CASE " + " ".join("WHEN regexp_matches(lower(trim({c})), '^(" + "|".join(b) + ")')" + (f" OR lower(trim({{c}})) IN ({', '.join(repr(w) for w in whole)})" if whole else "") + f" THEN '{tag}'" for tag, b, whole in tags.PREFIXES) + " ELSE '' END"


@query(f"""WITH {LBL}, c AS (SELECT p_partkey, label, {PREFIX_SQL.format(c='label')} AS tag FROM lb)
    SELECT p_partkey, tag, array_to_string(list_sort(list_distinct(list_filter([tag, CASE WHEN p_partkey % 2 = 0 THEN 'v' ELSE '' END, CASE WHEN p_partkey % 3 = 0 THEN 'kjano' ELSE '' END], lambda x: x <> ''))), '|') AS candidates FROM c""")
def prefix_tags(spark, sf):
    """Labels as one of twelve tags, and an entry's candidates by its label and its sense lines."""
    p, c = labelled_parts(spark, sf), F.col("label")
    line = lambda n, tag: F.when(F.col("p_partkey") % n == 0, F.concat(F.lit("a\tb\t"), F.lit(tag))).otherwise("a\tb")
    return p.select("p_partkey", tags.prefix_pos(c).alias("tag"), F.array_join(tags.pos_candidates(c, F.array(line(2, "Verb/aux"), line(3, "tn"))), "|").alias("candidates"))


@query(rf"""WITH {RAWS} SELECT w, regexp_matches(w, '[\x{{1000}}-\x{{109F}}\x{{A9E0}}-\x{{A9FF}}\x{{AA60}}-\x{{AA7F}}]') AS keeps, CASE WHEN trim(w) = '' THEN 'empty' WHEN regexp_matches(w, '^[\p{{Nd}}၊။.,\-/]+$') THEN 'number'
    WHEN NOT regexp_matches(w, '[\x{{1000}}-\x{{109F}}\x{{A9E0}}-\x{{A9FF}}\x{{AA60}}-\x{{AA7F}}]') AND length(w) <= 3 THEN 'short' WHEN regexp_matches(w, '^[\p{{P}}\p{{S}}\s]+$') THEN 'symbol' END AS noise FROM rw""")
def kept_words(spark, sf):
    """Words that a treebank of the script keeps, and why others are noise between its runs."""
    return raw_words(spark, sf).select("w", tx.keeps_script(F.col("w")).alias("keeps"), tx.separator_kind(F.col("w")).alias("noise"))


@query(f"""WITH c AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS k FROM (SELECT doc_id, regexp_extract_all({MY_SQL}, '(?s).') AS l FROM documents)) SELECT doc_id, l[k] AS mark, (k - 1)::INTEGER AS start, k::INTEGER AS "end" FROM c WHERE l[k] IN ('၊', '။')""")
def script_marks(spark, sf):
    """Commas and full stops of the documents in Myanmar letters, with their places."""
    return script_docs(spark, sf).select("doc_id", F.explode(tx.script_marks(F.col("text"))).alias("x")).select("doc_id", "x.*")


@query("""SELECT p_size AS doc, round(avg(p_retailprice), 5) AS width, round(avg(p_partkey::DOUBLE), 5) AS height FROM part WHERE p_partkey % 5 NOT IN (0, 1, 2) GROUP BY 1""")
def page_dims(spark, sf):
    """Mean sizes of the parts as pages; some have none, no number, or an infinite one."""
    n = F.col("p_partkey") % 5
    width = F.when(n == 0, F.lit(float("nan"))).when(n == 1, F.lit(0.0)).otherwise(F.col("p_retailprice"))
    pages = table(spark, sf, "part").select(F.col("p_size").alias("doc"), width.alias("width"), F.when(n == 2, F.lit(float("inf"))).otherwise(F.col("p_partkey").cast("double")).alias("height"))
    return readers.average_dims(pages).select("doc", F.round("width", 5).alias("width"), F.round("height", 5).alias("height"))


@query("""WITH f AS (SELECT user_id, event_type AS font, count(*) AS n, min(event_id) AS f FROM events WHERE event_type <> 'error' GROUP BY 1, 2), b AS (SELECT user_id, arg_min(font, {'n': -n, 'f': f}) AS font FROM f GROUP BY 1), s AS (SELECT user_id, round(median(value), 5) AS font_size FROM events GROUP BY 1)
    SELECT user_id, font_size, font FROM s LEFT JOIN b USING (user_id)""")
def run_fonts(spark, sf):
    """A user's events as the characters of a run: values are sizes, types fonts."""
    chars = table(spark, sf, "events").select("user_id", F.col("event_id").alias("i"), F.col("value").alias("size"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("font"))
    return readers.run_fonts(chars, ["user_id"]).select("user_id", F.round("font_size", 5).alias("font_size"), "font")


@query(f"""WITH RECURSIVE {PWORDS}, n AS (SELECT DISTINCT p_name, replace(p_name, ' ', CASE WHEN length(p_name) % 2 = 0 THEN '' ELSE '.' END) AS t FROM part),
    q AS (SELECT p_name, flatten(list_transform(string_split(p_name, ' '), lambda w, k: list_concat(regexp_extract_all(w, '..?'), CASE WHEN length(p_name) % 2 = 1 AND k < len(string_split(p_name, ' ')) THEN ['.'] ELSE [] END))) AS p FROM n),
    w AS (SELECT p_name, 1 AS at_, []::VARCHAR[] AS out FROM q UNION ALL SELECT p_name, at_ + n, list_append(out, array_to_string(p[at_:at_ + n - 1], '')) FROM (
        SELECT w.p_name, w.at_, w.out, q.p, coalesce(list_max(list_filter(range(2, 17), lambda n: w.at_ + n - 1 <= len(q.p) AND NOT list_contains(q.p[w.at_:w.at_ + n - 1], '.') AND list_contains(v.words, array_to_string(q.p[w.at_:w.at_ + n - 1], '')))), 1) AS n
        FROM w JOIN q USING (p_name), (SELECT list(word) AS words FROM wrd) v WHERE w.at_ <= len(q.p)))
    SELECT w.p_name, array_to_string(out, '|') AS words FROM w JOIN q USING (p_name) WHERE at_ = len(q.p) + 1""")
def joined_pieces(spark, sf):
    """Part names predicted as pieces of two letters, joined to the longest words of the lexicon; points stay alone."""
    name = table(spark, sf, "part").select("p_name").distinct()
    pieces = F.flatten(F.transform(F.split("p_name", " "), lambda w: F.regexp_extract_all(w, F.lit("..?"), F.lit(0))))
    dotted = F.flatten(F.transform(F.split("p_name", " "), lambda w, k: F.concat(F.regexp_extract_all(w, F.lit("..?"), F.lit(0)), F.when(k < F.size(F.split("p_name", " ")) - 1, F.array(F.lit("."))).otherwise(F.expr("cast(array() as array<string>)")))))
    # A point glued to the piece before it is cut off again.
    glued = F.regexp_extract_all(F.array_join(dotted, "|"), F.lit(r"[a-z]+(?:\|\.)?"), F.lit(0))
    words = F.when(F.length("p_name") % 2 == 0, pieces).otherwise(F.transform(glued, lambda x: F.replace(x, F.lit("|"), F.lit(""))))
    done = segment.joined_pieces(name.select("p_name", words.alias("words")), part_words(spark, sf), LATIN, key="p_name")
    return done.select("p_name", F.array_join("words", "|").alias("words"))


@query(f"""WITH s AS (SELECT item_id, {DRAW.replace('* 4 //', '* 100 //')} AS d, regexp_extract_all(lower(text), '{WORD}') AS w FROM (SELECT *, (item_id % 2147483647 * 48271 + 1234) % 2147483647 AS x FROM benchmark))
    SELECT item_id, CASE WHEN d <= 10 THEN 'dev' ELSE 'train' END AS split, array_to_string(list_transform(w, lambda x: CASE WHEN length(x) = 1 THEN 'U' ELSE 'B' || repeat('I', length(x) - 2) || 'L' END), '') AS tags FROM s WHERE len(w) > 0""")
def bilu_datasets(spark, sf):
    """The passages as training data for a word splitter: a tenth is dev."""
    b = table(spark, sf, "benchmark").select("item_id", F.regexp_extract_all(F.lower("text"), F.lit(LATIN.word), F.lit(0)).alias("words"))
    return corpus.bilu_dataset(b, LATIN, key="item_id").select("item_id", "split", F.array_join("tags", "").alias("tags"))


@query("""WITH w AS (SELECT p_partkey AS doc_id, string_split(p_name, ' ') AS w, list_transform(range(p_size % 4), lambda k: k::INTEGER) AS y FROM part) SELECT doc_id, i::INTEGER AS i, w[i + 1] AS tokens, y[i + 1] AS labels FROM (SELECT *, unnest(range(least(len(w), len(y)))) AS i FROM w)""")
def zipped_records(spark, sf):
    """Words and labels of a record by place; the shorter list ends it."""
    labels = F.filter(F.sequence(F.lit(0), F.lit(3)), lambda k: k < F.col("p_size") % 4)
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("doc_id"), F.split("p_name", " ").alias("tokens"), labels.alias("labels"))
    return corpus.zipped(p, ["tokens", "labels"])


@query("""WITH e AS (SELECT user_id AS token, CASE event_type WHEN 'view' THEN 'n' WHEN 'click' THEN 'v' WHEN 'error' THEN '' ELSE 'adj' END AS label, event_id % 89 = 0 AS unk, event_id % 97 = 0 AS locked, CASE WHEN user_id % 2 = 0 THEN 'exact' ELSE 'composite' END AS mode FROM events),
    g AS (SELECT token, bool_or(locked) AS l, bool_or(unk) AS k, bool_and(label = '') AS none, bool_or(label = '') AS some_, count(*) AS n, any_value(mode) AS mode FROM e GROUP BY 1)
    SELECT token, CASE WHEN l THEN 'locked' WHEN NOT k AND none THEN 'no_pos' ELSE mode || ':' || CASE WHEN k THEN 'has_unknown' WHEN n > 1 AND some_ THEN 'partial' WHEN n > 1 THEN 'multi_fill' ELSE 'single' END END AS source FROM g""")
def fill_modes(spark, sf):
    """Users' events as the fills of a token, some with unknown pieces, some locked: why they allow what they allow."""
    t = F.col("event_type")
    label = F.when(t == "view", "n").when(t == "click", "v").when(t == "error", "").otherwise("adj")
    mode = F.when(F.col("user_id") % 2 == 0, "exact").otherwise("composite")
    fills = table(spark, sf, "events").select(F.col("user_id").alias("token"), label.alias("label"), (F.col("event_id") % 89 == 0).alias("has_unknown"), (F.col("event_id") % 97 == 0).alias("locked"), mode.alias("mode"))
    return tagging.decided(fills).select("token", "source")


@query()
def synthetic_documents(spark, sf):
    """A synthetic document for every tenth one, of the documents' sentences, with words of two letters as junk: their sizes and labels."""
    d = table(spark, sf, "documents")
    sents = tx.sentence_table(tx.piece_arrays(d, LATIN), LATIN.enders).select((F.col("doc_id") * 100000 + F.col("sentence")).alias("id"), F.filter("p", lambda w, i: F.get("is_word", i)).alias("tokens"))
    junk = doc_tokens(spark, sf).filter(F.length("token") == 2).select("token").distinct()
    docs = synthetic.documents(d.count() // 10, sents, junk, LATIN.letter)
    n = lambda y: F.size(F.filter("labels", lambda x: x == y))
    return docs.select("doc", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("tokens_md5"), n("SENT_END").alias("sentences"), n("PARA_END").alias("paragraphs"), F.size(F.filter("gaps", lambda g: g == "\n")).alias("lines"))
