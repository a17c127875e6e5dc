"""Goldens, exhaustive comparisons and invariants of the engine's own operators."""

import builtins
import importlib
import random
import sys

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.functions import text as tx
from wordloom.functions.profile import LATIN, MYANMAR
from wordloom.operators import boundary, corpus, graph, lexicon, lm, pipeline, review, search, segment, tagging, trees
from __spark_entry__ import OWN as QUERIES
from __spark_entry__ import OWN_SQL as ORACLE_SQL
from wordloom.sources import readers
from wordloom.streaming import streams

SF = "/root/testdata/sf0.001"
# (text, clusters, cheapest path, pipeline)
GOLDENS = [
    ("", [], [], []),
    ("စာ", ["စာ"], ["စာ"], ["စာ"]),
    ("မြန်မာစာဖတ်", ["မြ", "န်", "မာ", "စာ", "ဖ", "တ်"], ["မြန်မာ", "စာ", "ဖတ်"], ["မြန်မာ", "စာ", "ဖတ်"]),
    ("မင်္ဂလာပါ", ["မ", "င်္ဂ", "လာ", "ပါ"], ["မ", "င်္ဂ", "လာ", "ပါ"], ["မင်္ဂလာပါ"]),
    ("စာ​စာ", ["စာ", "​", "စာ"], ["စာ", "​စာ"], ["စာ", "စာ"]),
    ("စာ၊ ဖတ်။", ["စာ", "၊", " ", "ဖ", "တ်", "။"], ["စာ", "၊", " ဖတ်", "။"], ["စာ", "၊", "ဖတ်", "။"]),
    ("x မြန်မာ 42", ["x ", "မြ", "န်", "မာ", " 42"], ["x မြန်မာ 42"], ["မြန်မာ"]),
    ("က္က", ["က္က"], ["က္က"], ["က္က"]),
    ("ေကာင်း", ["ေ", "ကာ", "င်း"], ["ေ", "ကာ", "င်း"], ["ေကာင်း"]),
]
LEXICON = [("စာ", "user"), ("မြန်မာ", "wiktionary"), ("ဖတ်", "wiktionary")]


@pytest.fixture
def texts(spark):
    return spark.createDataFrame([(k, g[0]) for k, g in enumerate(GOLDENS)], "doc_id long, text string")


@pytest.fixture
def words(spark):
    return spark.createDataFrame(LEXICON, "word string, source string")


def test_clusters(texts):
    rows = {r.doc_id: r for r in texts.select("doc_id", "text", tx.clusters(F.col("text"), MYANMAR).alias("c")).withColumn("s", tx.starts_of(F.col("c"))).withColumn("m", tx.cluster_of_char(F.col("c"))).collect()}
    for k, g in enumerate(GOLDENS):
        assert list(rows[k].c) == g[1] and "".join(rows[k].c) == g[0] and len(rows[k].m) == len(g[0])
        assert all(g[0][s : s + len(c)] == c for s, c in zip(rows[k].s, g[1]))


def test_cheapest_paths(spark, texts, words):
    rows = segment.priced(segment.lattice(texts, MYANMAR, 16), words, profile=MYANMAR)
    got = {r.doc_id: list(r.words) for r in segment.best_paths(rows).collect()}
    for k, g in enumerate(GOLDENS[1:], 1):
        assert got[k] == g[2], g[0]


def test_pair_rewards_change_the_path(spark):
    docs = spark.createDataFrame([(1, "abab")], "doc_id long, text string")
    known = spark.createDataFrame([("ab",), ("a",), ("bab",)], "word string")
    rows = segment.priced(segment.lattice(docs, LATIN, 4), known)
    pairs = spark.createDataFrame([("ab", "ab", 0.5)], "w1 string, w2 string, cost double")
    assert [list(r.words) for r in segment.best_paths(rows).collect()] == [["a", "bab"]]
    assert [list(r.words) for r in segment.best_paths(rows, pairs).collect()] == [["ab", "ab"]]


def test_pipeline(texts, words):
    got = {}
    for r in pipeline.segments(texts, MYANMAR, words).orderBy("doc_id", "i").collect():
        got.setdefault(r.doc_id, []).append(r.segment)
    for k, g in enumerate(GOLDENS):
        assert got.get(k, []) == g[3], g[0]


def test_lookup_takes_the_user_layer(spark):
    rows = [("wiktionary", 3, "စာ", "", "n", "text", 1), ("mmd", 2, "စာ", "", "n", "letter", 2), ("user", 1, "စာ", "sa", "n", "custom text", 3), ("user", 1, "စာ", "", "v", "", 4)]
    merged = lexicon.merge_entries(spark.createDataFrame(rows, "layer string, priority int, headword string, roman string, pos string, sense string, pos_in_file long"))
    token = spark.createDataFrame([("စာ",), ("ဖတ်",)], "token string")
    got = {r.token: r for r in lexicon.lookup(token, merged).collect()}
    assert (got["စာ"].layer, got["စာ"].roman, got["စာ"].pos, list(got["စာ"].senses)) == ("user", "sa", "n|v", ["custom text"]) and got["ဖတ်"].layer is None
    assert [r.layer for r in lexicon.lookup_all(token, merged).orderBy("rank").collect()] == ["user", "mmd", "wiktionary"]
    docs = spark.createDataFrame([(1, "စာ၊ ဖတ်။")], "doc_id long, text string")
    spans = [(r.segment, r.start, r.end, r.layer) for r in pipeline.analysed(docs, MYANMAR, merged).orderBy("i").collect()]
    assert spans == [("စာ", 0, 2, "user"), ("၊", 2, 3, None), ("ဖတ်", 4, 7, None), ("။", 7, 8, None)]


def test_offsets(spark):
    df = spark.createDataFrame([("စာ၊ ဖတ်။", ["စာ", "၊", "ဖတ်", "။"]), ("မြန်မာစာ", ["မြန်မာ", "စာ"]), ("စာ", ["missing", "စာ"])], "text string, s array<string>")
    rows = df.select(tx.offsets(F.col("text"), F.col("s")).alias("o"), tx.char_spans(F.col("text"), F.col("s")).alias("c")).collect()
    assert [tuple(x) for x in rows[0].o] == [(0, 2), (2, 3), (4, 7), (7, 8)] and [tuple(x) for x in rows[1].c] == [(0, 6), (6, 8)]
    assert rows[2].o is None and [x and tuple(x) for x in rows[2].c] == [None, (0, 2)]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_search_equals_exhaustive(spark):
    rng = random.Random(1729)
    vocabulary = sorted({"".join(rng.choice("ကခဂငစဆညတနမယရလဝသ") for _ in range(rng.randint(2, 7))) for _ in range(160)} | {"", "မြန်မာ", "မန်မာ", "ကက", "က"})
    df = spark.createDataFrame([(w,) for w in vocabulary], "word string")
    for radius in (0, 1, 2):
        got = {(r.query, r.word): r.distance for r in search.within(df.withColumnRenamed("word", "query"), df, radius).collect()}
        assert got == {(a, b): d for a in vocabulary for b in vocabulary if (d := distance(a, b)) <= radius}
    pairs = [("", "", 0), ("", "မြန်မာ", 6), ("kitten", "sitting", 3), ("မြန်မာ", "မန်မာ", 1), ("က", "ခ", 1), ("ကက", "က", 1)]
    assert all(distance(a, b) == d for a, b, d in pairs)


def test_phrases_are_greedy(spark):
    rng = random.Random(7)
    docs = [[rng.choice("abc") for _ in range(rng.randint(0, 40))] for _ in range(30)]
    toks = spark.createDataFrame(list(enumerate(docs)), "doc_id long, t array<string>")
    inventory = {("a", "b"), ("b", "c"), ("a", "b", "c"), ("c", "c"), ("a", "a", "b", "b")}
    inv = spark.createDataFrame([("_".join(p), len(p), 5) for p in inventory], "phrase string, size int, n long")
    got = {(r.doc_id, r.start, r.end) for r in lm.phrases(toks, inv).collect()}
    slow = set()
    for d, ts in enumerate(docs):
        i = 0
        while i < len(ts):
            size = next((n for n in (4, 3, 2) if tuple(ts[i : i + n]) in inventory and i + n <= len(ts)), 0)
            if size:
                slow.add((d, i, i + size))
            i += size or 1
    assert got == slow


CONLLU = """# sent_id = 1
1-2\tသူဖတ်သည်\t_\t_\t_\t_\t_\t_\t_\t_
1\tသူ\t_\tPRON\t_\t_\t2\tnsubj\t_\t_
2\tဖတ်သည်\t_\tVERB\tVB\t_\t0\troot\t_\t_
2.1\tx\t_\tX\t_\t_\t_\t_\t_\t_

1\tစာ\t_\tNOUN\tNN\t_\t0\troot\t_\t_
2\t.\t_\tPUNCT\t_\t_\t0\troot\t_\t_
"""


def test_conllu(spark, tmp_path):
    (tmp_path / "a.conllu").write_text(CONLLU)
    t = readers.read_conllu(spark, str(tmp_path / "a.conllu"))
    rows = t.orderBy("sent_id", "tok_id").collect()
    assert [(r.form, r.xpos, r["head"]) for r in rows] == [("သူ", "PRON", 2), ("ဖတ်သည်", "VB", 0), ("စာ", "NN", 0), (".", "PUNCT", 0)]
    fixed = corpus.repair_roots(t).orderBy("sent_id", "tok_id").collect()
    assert [r["head"] for r in fixed] == [2, 0, 0, 1]
    kept = corpus.drop_tokens(t, F.col("upos") == "PRON").orderBy("sent_id", "tok_id").collect()
    assert [(r.tok_id, r.form, r["head"]) for r in kept] == [(1, "ဖတ်သည်", 0), (1, "စာ", 0), (2, ".", 0)]
    text = readers.conllu_text(t).orderBy("sent_id").collect()[0].value
    assert text.split("\n")[1].split("\t")[:5] == ["2", "ဖတ်သည်", "_", "VERB", "VB"]


def test_windows_and_checks(spark):
    s = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (1, 2, 9), (1, 3, 1)], "doc_id long, sentence long, size long")
    assert [(r.first, r.last, r["size"]) for r in corpus.packed_windows(s, 4).orderBy("window").collect()] == [(0, 1, 3), (2, 2, 9), (3, 3, 1)]
    good = [(["a", "b"], [(0, "a", "X", "X"), (1, "b", "X", "X")], [0, 1], "s")]
    kind = "tokens array<string>, pos array<struct<i: int, tok: string, upos: string, tag: string>>, sent_end_after array<int>, source string"
    assert readers.checked_windows(spark.createDataFrame(good, kind)).count() == 1
    for labels, pos in (([0, 2], good[0][1]), ([0, 0], good[0][1]), ([0, 1], [(0, "a", "X", "X"), (5, "b", "X", "X")])):
        with pytest.raises(Exception, match="not aligned"):
            readers.checked_windows(spark.createDataFrame([(["a", "b"], pos, labels, "s")], kind)).collect()


def test_ranked_needs_no_single_partition(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1009 as k")
    got = [r.nth for r in corpus.ranked(df, "k").orderBy("k").collect()]
    assert got == list(range(1000))
    s = corpus.contiguous_split(df, "k").groupBy("split").count().collect()
    assert {r.split: r["count"] for r in s} == {"train": 800, "dev": 100, "test": 100}


def test_brackets_and_chunks(spark):
    t = spark.createDataFrame([(1, "(S (NP (N a) (N b)) (VP (V c) (NP (N d))))"), (2, "(X y)")], "sent_id long, tree string")
    nodes = {(r.sent_id, r.label, r.start, r.end, r.depth) for r in corpus.bracket_nodes(t).collect()}
    assert nodes == {(1, "S", 0, 4, 0), (1, "NP", 0, 2, 1), (1, "N", 0, 1, 2), (1, "N", 1, 2, 2), (1, "VP", 2, 4, 1), (1, "V", 2, 3, 2), (1, "NP", 3, 4, 2), (1, "N", 3, 4, 3), (2, "X", 0, 1, 0)}
    chunks = {(r.label, r.start, r.end) for r in corpus.base_chunks(corpus.bracket_nodes(t), ["NP", "VP"]).collect()}
    assert chunks == {("NP", 0, 2), ("VP", 2, 4)}


def test_graph(spark):
    tokens = [(1, 0, 1, "NOUN", "obj"), (1, 1, 1, "VERB", "ROOT"), (2, 0, 2, "NOUN", "obj"), (2, 1, 2, "PART", "case"), (2, 2, 2, "VERB", "ROOT"), (2, 3, 2, "ADJ", "acl"), (2, 4, 3, "NOUN", "nsubj")]
    df = spark.createDataFrame(tokens, "doc long, i int, head int, upos string, dep string")
    got = {(r.doc, r.chunk_head): (sorted(r.members), r.depth, r.pos) for r in trees.chunk_model(df).collect()}
    assert got == {(1, 1): ([0, 1], 0, "ROOT"), (2, 2): ([0, 1, 2], 0, "ROOT"), (2, 3): ([3, 4], 1, "ADJ")}
    depth = {(r.doc, r.i): r.depth for r in graph.depths(df.select("doc", "i", "head")).collect()}
    assert depth == {(1, 0): 1, (1, 1): 0, (2, 0): 1, (2, 1): 1, (2, 2): 0, (2, 3): 1, (2, 4): 2}
    edges = spark.createDataFrame([(5, 4), (4, 9), (9, 2), (7, 8), (3, 3)], "a long, b long")
    assert {(r.node, r.component) for r in graph.components(edges).collect()} == {(4, 2), (5, 2), (9, 2), (8, 7)}
    cycle = spark.createDataFrame([(1, 0, 1), (1, 1, 0), (1, 2, 9)], "doc long, i int, head int")
    assert {r.i: r.depth for r in graph.depths(cycle).collect()} == {0: None, 1: None, 2: 0}


def test_deep_chains(spark):
    n = 1200
    chain = spark.range(n).select(F.lit(1).alias("doc"), F.col("id").cast("int").alias("i"), F.greatest(F.col("id") - 1, F.lit(0)).cast("int").alias("head"))
    assert chain.transform(graph.depths).filter("depth = i").count() == n
    assert graph.heights(chain).filter(F.col("height") == n - 1 - F.col("i")).count() == n
    near = spark.range(130).select((F.col("id") + 1).alias("child"), F.col("id").alias("parent"))
    assert graph.closure(near).count() == 130 * 131 // 2 and graph.closure(near, 7).agg(F.max("distance")).first()[0] == 7


def test_gaps_branches_and_groups(spark):
    rows = [(1, 0, 2), (1, 1, 4), (1, 2, 4), (1, 3, 4), (1, 4, 4), (1, 5, 4)]
    t = spark.createDataFrame(rows, "doc long, i int, head int")
    assert {(r.i, r.height) for r in graph.heights(t).collect()} == {(0, 0), (1, 0), (2, 1), (3, 0), (4, 2), (5, 0)}
    assert {(r.i, r.component) for r in graph.gap_components(t, 0).collect()} == {(0, 0), (1, 1), (2, 0), (3, 0), (4, 0), (5, 0)}
    assert {(r.i, r.component) for r in graph.gap_components(t, 1).collect()} == {(i, 0) for i in range(6)}
    assert {(r.i, r.chunk) for r in graph.branch_chunks(t, 0).collect()} == {(0, 2), (2, 2), (1, 4), (3, 4), (4, 4), (5, 4)}
    e = spark.createDataFrame([(1, 1, 3)], "doc long, first int, last int")
    assert {(r.i, r.chunk) for r in graph.bottom_up_compressed(t, e, 1).collect()} == {(i, 0) for i in range(6)}
    assert {(r.i, tuple(r.path)) for r in graph.root_paths(t).collect()} == {(0, (2,)), (1, ()), (2, ()), (3, ()), (4, ()), (5, ())}


def test_bilou_and_heads(spark):
    leaves = spark.createDataFrame([(1, k, p, "x") for k, p in enumerate(["adv", "n", "n", "punct", "part", "punct", "v"])], "sent_id long, i int, pos string, token string")
    chunks = spark.createDataFrame([(1, "NP", 1, 3), (1, "VP", 6, 7)], "sent_id long, label string, start int, end int")
    assert [r.tag for r in corpus.bilou(leaves, chunks).orderBy("i").collect()] == ["U-ADVP", "B-NP", "I-NP", "I-NP", "L-NP", "O", "U-VP"]
    tree = spark.createDataFrame([(1, "(ROOT (noun (a x) (n y)) (verb (v z) (p w)) (q .))")], "sent_id long, tree string")
    words = spark.createDataFrame([(1, 0, "x", "ADJ"), (1, 1, "y", "NOUN"), (1, 2, "z", "VERB"), (1, 3, "w", "PART"), (1, 4, ".", "PUNCT")], "sent_id long, i int, form string, upos string")
    headed = corpus.percolated(corpus.bracket_nodes(tree), words)
    got = {r.i: (r["head"], r.deprel) for r in corpus.arcs(headed, words).collect()}
    assert got == {0: (1, "amod"), 1: (2, "obl"), 2: (-1, "root"), 3: (2, "case"), 4: (2, "punct")}


def test_dictionary_repair(spark):
    rows = [(0, "x", "", "", "lost"), (1, "စာ12", "sa", "n", "[Pali] 7 text"), (2, "", "sar", "v", "more See illus at p"), (3, "2005", "hse", "", "ten."), (4, "", "", "", " ")]
    entries, report = corpus.repaired_entries(spark.createDataFrame(rows, "k int, headword string, romanization string, pos string, definition string"))
    assert sorted(tuple(r) for r in entries.collect()) == [(1, "စာ", "sa / sar", "n", "text more"), (3, "ဆယ်", "hse", "num", "ten.")]
    assert {r.k: r.change for r in report.collect()} == {0: "dropped", 1: "suffix", 2: "attached", 3: "numeric", 4: "dropped"}


def test_viterbi_and_links(spark):
    rows = [(1, 0, [("n", -1.0), ("v", -0.9)]), (1, 1, None), (1, 2, [("v", -1.0), ("n", -1.1)])]
    df = spark.createDataFrame(rows, "doc long, i int, candidates array<struct<tag: string, score: double>>")
    got = [(r.i, r.tag) for r in tagging.viterbi(df, spark.createDataFrame([("n", "v", -0.1)], "prev string, tag string, logp double")).orderBy("i").collect()]
    assert got == [(0, "n"), (1, None), (2, "v")]
    toks = spark.createDataFrame([(1, 0, None, ["N"]), (1, 1, "NOUN_MARKER", ["PART"]), (1, 2, "NEGATION_MARKER", ["PART"]), (1, 3, None, ["V"]), (1, 4, "SENTENCE_MARKER", ["PART"])], "doc long, i int, type string, pos array<string>")
    rules = spark.createDataFrame([("NOUN_MARKER", "case", "LEFT", ["N", "PRON"], 1), ("NEGATION_MARKER", "negation", "RIGHT", ["V"], 1), ("SENTENCE_MARKER", "end", "NONE", [], 0)], "type string, role string, direction string, wanted array<string>, distance int")
    assert {(r["from"], r.to, r.role) for r in tagging.neighbour_links(toks, rules).collect()} == {(1, 0, "case"), (2, 3, "negation")}
    kept = {(r.i, r.to) for r in tagging.nearest_kept(toks, F.col("type").isNull()).collect()}
    assert kept == {(1, 0), (2, 3), (4, 3)}
    logits = spark.createDataFrame([(1, 0, "NOUN", 2.0), (1, 0, "VERB", 1.0), (1, 0, "ADJ", 0.5), (1, 1, "ADV", 1.0)], "doc long, i int, label string, logit double")
    allowed = spark.createDataFrame([(1, 0, ["VERB", "ADJ"])], "doc long, i int, tags array<string>")
    assert {(r.i, r.tag, r.changed) for r in tagging.override(logits, allowed).collect()} == {(0, "VERB", True), (1, "ADV", False)}


def test_boundaries(spark):
    t = spark.createDataFrame([(1, k, w, y) for k, (w, y) in enumerate([("a", 0), (",", 1), ("b", 0), ("c", 0), (".", 1)])], "doc_id long, i int, token string, y int")
    assert [(r.token, r.y) for r in boundary.carried_labels(t, F.col("token").rlike("[a-z]")).orderBy("i").collect()] == [("a", 0), ("b", 1), ("c", 1)]
    p = spark.createDataFrame([(1, 0, 0.9), (1, 1, 0.9), (1, 3, 0.8), (1, 4, 0.1), (1, 9, 0.9)], "doc_id long, i int, p double")
    assert [r.i for r in boundary.post_filter(p, 0.5, 3).orderBy("i").collect()] == [0, 3, 9]
    g = spark.createDataFrame([("x", True, True), ("x", False, True), ("y", True, False)], "label string, g boolean, p boolean")
    s = {r.label: (r.tp, r.fp, r.fn, r.precision, r.f1) for r in boundary.scores_by(g, "label", F.col("g"), F.col("p")).collect()}
    assert s == {"x": (1, 1, 0, 0.5, 2 / 3), "y": (0, 0, 1, 0.0, 0.0), None: (1, 1, 1, 0.5, 0.5)}


def test_pages_rejoin(spark):
    text = "စာ\n" * 1100
    pages = tx.pages(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("page").collect()
    assert len(pages) > 1 and "\n".join(p.text for p in pages) == text


def test_reviews_fold_equals_stream(spark, tmp_path):
    seen = spark.createDataFrame([("စာ", "2024-01-01"), ("စာ", "2024-01-02"), ("ဖတ်", "2024-01-01")], "head string, ts string").withColumn("ts", F.to_timestamp("ts")).withColumn("form", F.col("head"))
    assert {r["head"]: r.total_seen for r in review.exposures(seen).collect()} == {"စာ": 2, "ဖတ်": 1}
    rng = random.Random(3)
    rows = [(f"h{rng.randint(0, 4)}", f"2024-01-{1 + k // 3:02d} 00:00:{k:02d}", k, rng.random() < 0.7) for k in range(50)]
    df = spark.createDataFrame(rows, "head string, ts string, tie long, knew boolean").withColumn("ts", F.to_timestamp("ts"))
    batch = {r["head"]: (r.repetitions, round(r.interval, 9), round(r.ease, 9), r.reviews) for r in review.review_states(df).collect()}
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = streams.review_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
        q = stream.writeStream.outputMode("update").format("memory").queryName("reviews").option("checkpointLocation", str(tmp_path / "c")).start()
        q.processAllAvailable()
        q.stop()
        got = {r["head"]: (r.repetitions, round(r.interval, 9), round(r.ease, 9), r.reviews) for r in spark.sql("select * from reviews").collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    assert got == batch


def test_event_windows_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    events.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in streams.tumbling(events, "6 hours").collect()}
    live = streams.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), "6 hours", late="1 day")
    q = live.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    rounded = lambda rows: {(a, b, n, round(t, 6)) for a, b, n, t in rows}
    assert rounded(tuple(r) for r in spark.sql("select * from windows").collect()) == rounded(batch)


def test_files(spark, tmp_path):
    (tmp_path / "u.txt").write_text("﻿စာ\t3\nစာ\t2\nဖတ် 4\nbad\nx\ty\n")
    assert {(r.token, r.n) for r in readers.read_counts(spark, str(tmp_path / "u.txt")).collect()} == {("စာ", 5), ("ဖတ်", 4)}
    (tmp_path / "b.txt").write_text("('a', 'b')\t3\na\tb\t2\nnope\n")
    assert {tuple(r) for r in readers.read_pair_counts(spark, str(tmp_path / "b.txt")).collect()} == {("a", "b", 5)}
    (tmp_path / "d.tsv").write_text("headword\tromanization\tpos\tdefinition\nစာ\tsa\tN\ttext\\nletter\nabc\t\tn\tno\n")
    rows = readers.read_lexicon(spark, str(tmp_path / "d.tsv"), "user", 1).orderBy("pos_in_file").collect()
    assert [(r.headword, r.roman, r.pos, r.sense) for r in rows] == [("စာ", "sa", "n", "text"), ("စာ", "sa", "n", "letter")]
    (tmp_path / "t.txt").write_text("သူ/pron စာ/n|အုပ်/n x\n# note/n\n")
    assert [(r.word, r.tag) for r in readers.read_tagged_lines(spark, str(tmp_path / "t.txt")).orderBy("i").collect()] == [("သူ", "pron"), ("စာ", "n"), ("အုပ်", "n")]


def test_scalars(spark):
    row = spark.sql("select 'ab12က.' as t, '«word».' as p").select(tx.shape(F.col("t")).alias("s"), tx.strip_edges(F.col("p")).alias("e"), tx.char_ngrams(F.col("t"), 5).alias("g"), tx.clean_html(F.lit("<b>a</b>&amp; b &lt;")).alias("h"), tx.nfc(F.lit("é")).alias("n")).first()
    assert (row.s, row.e, list(row.g), row.h, row.n) == ("AADDMP", "word", ["ab12က", "b12က."], "a& b <", "é")


SQL = sorted(k for k in QUERIES if k in ORACLE_SQL)


@pytest.mark.parametrize("name", SQL)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages benchmark labels conversations".split():
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    a, rel = QUERIES[name](spark, SF), con.sql(ORACLE_SQL[name])
    assert sorted(a.columns) == sorted(rel.columns)
    plain = lambda rows, cols: sorted((tuple(round(v, 5) if isinstance(v, float) else v for _, v in sorted(zip(cols, r))) for r in rows), key=str)
    assert plain([tuple(r) for r in a.collect()], a.columns) == plain(rel.fetchall(), rel.columns)


def test_entry_works_without_the_subpackage(monkeypatch):
    real = builtins.__import__

    def without(name, globals=None, locals=None, fromlist=(), level=0):
        if name.startswith(("wordloom.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name, name=name)
        return real(name, globals, locals, fromlist, level)

    gone = {k: sys.modules.pop(k) for k in list(sys.modules) if k.startswith(("wordloom.llm", "corpus_pipeline", "__spark_entry__"))}
    monkeypatch.setattr(builtins, "__import__", without)
    try:
        entry = importlib.import_module("__spark_entry__")
        assert set(entry.queries()) == set(QUERIES) and not any(k.startswith("op") and k[2].isdigit() for k in entry.oracle_sql())
    finally:
        monkeypatch.undo()
        sys.modules.pop("__spark_entry__", None)
        sys.modules.update(gone)


def test_bilu_decoding_tolerates_contradictions(spark):
    rows = [("abcd", "BLBL", ["ab", "cd"]), ("abcd", "IIUI", ["ab", "c", "d"]), ("abc", "LLL", ["a", "b", "c"]), ("abc", "BBB", ["a", "b", "c"]), ("", "", [])]
    df = spark.createDataFrame([(list(a), list(b), w) for a, b, w in rows], "parts array<string>, tags array<string>, words array<string>")
    for r in df.select("words", segment.decode_bilu(F.col("parts"), F.col("tags")).alias("got")).collect():
        assert r.got == r.words


def test_lines_by_height(spark):
    rows = [(1, 0, 50.0, 10.0, 8.0, "b"), (1, 1, 10.0, 12.0, 8.0, "a"), (1, 2, 10.0, 30.0, None, "c"), (1, 3, 20.0, 35.0, None, "d"), (2, 0, 1.0, 1.0, 0.0, "e")]
    df = spark.createDataFrame(rows, "page int, nth int, x double, y double, h double, text string")
    assert sorted((r.page, r.line, r.text) for r in tx.lines_by_height(df).collect()) == [(1, 0, "a b"), (1, 1, "c d"), (2, 0, "e")]


def test_space_boundaries_and_code_points(spark):
    df = spark.createDataFrame([("ab, c d", ["ab", ",", "c", "d"]), ("ab", ["ab"]), ("", []), ("ab", ["x"])], "t string, s array<string>")
    assert [r.b for r in df.select(tx.followed_by_space(F.col("t"), F.col("s")).alias("b")).collect()] == [[False, True, True], [], [], None]
    assert spark.createDataFrame([("aစ😀",), ("",)], "t string").select(tx.code_points(F.col("t")).alias("c")).collect() == [(["U+0061", "U+1005", "U+1F600"],), ([],)]


def test_confidence_by_lead(spark):
    rows = [("a", "n", -1.0), ("b", "n", -0.1), ("b", "v", -0.7), ("c", "n", 0.0), ("c", "v", 0.0), ("d", "n", -0.01), ("d", "v", -5.0)]
    got = tagging.confidence(spark.createDataFrame(rows, "word string, tag string, score double"), ["word"]).collect()
    assert {r.word: (r.tag, r.confidence) for r in got} == {"a": ("n", 1.0), "b": ("n", 0.4), "c": ("v", 0.25), "d": ("n", 1.0)}


def test_groups_of_islands_grow(spark):
    """The third group's only head lies in the first: it joins since the second has joined before it."""
    at = spark.createDataFrame([("d", i, i // 2) for i in range(6)], "doc string, i int, island int")
    heads = spark.createDataFrame([("d", 1, 0), ("d", 2, 1), ("d", 3, 2), ("d", 4, 1), ("d", 5, 4)], "doc string, i int, head int")
    alone = spark.createDataFrame([("d", k, k, k) for k in range(3)], "doc string, grp long, first int, last int")
    edges = graph.group_edges(alone, at, heads)
    assert {r.grp: (r.back, r.ahead) for r in edges.collect()} == {0: (None, None), 1: (0, None), 2: (0, None)}
    assert [tuple(r)[1:] for r in graph.absorbed(edges).collect()] == [(0, 0, 2)]
    # A group ends at its own first token with a head ahead, if that is a gate, whatever the head is.
    ahead = graph.group_edges(alone, at, spark.createDataFrame([("d", 0, 3), ("d", 1, 2), ("d", 3, 4)], "doc string, i int, head int"))
    assert {r.grp: r.ahead for r in ahead.collect()} == {0: 0, 1: 3, 2: None}
    gates = lambda *i: spark.createDataFrame([("d", x) for x in i], "doc string, i int")
    runs = lambda g: sorted((r["first"], r["last"]) for r in graph.acl_gated(ahead, g).collect())
    assert runs(gates(0)) == [(0, 0), (1, 2)] and runs(gates(4)) == [(0, 2)] and runs(gates(3)) == [(0, 1), (2, 2)]


def test_random_groups_are_a_renewal_process(spark):
    records = spark.range(5000).select((F.col("id") * 3).alias("doc_id"))
    whole = {r.doc_id // 3: r.start for r in boundary.concatenated(records, 5, 11, least=2).collect()}
    for block in (7, 64):
        assert {r.doc_id // 3: r.start for r in boundary.concatenated(records.repartition(3), 5, 11, least=2, block=block).collect()} == whole
    at, starts = 0, []
    while at < 5000:
        starts.append(at)
        at += int(boundary.drawn(np.array([at], dtype=np.int64), 2, 5, 11)[0])
    assert [i for i in range(5000) if whole[i] == i] == starts
    sizes = Counter(np.diff(starts).tolist())
    assert set(sizes) == {2, 3, 4, 5} and min(sizes.values()) > 0.8 * max(sizes.values())
    assert boundary.concatenated(records.limit(0), 5, 11).count() == 0
