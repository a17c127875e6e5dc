"""Readers, sinks and label operators on small files."""

import hashlib
import json

from pyspark.sql import functions as F

from wordloom.functions import clean, tags
from wordloom.functions import text as tx
from wordloom.functions.profile import MYANMAR
from wordloom.operators import boundary, lexicon, segment, tagging
from wordloom.sources import readers, treebanks


def test_lexicon_readers(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("headword\troman\tpos\tdef\nစာ\tsa\tpron\t1 a\\n2 b\\nv\\n1 c\nစ\t\t\tlost\n")
    rows = treebanks.read_nested_lexicon(spark, str(tmp_path / "m.tsv"), "mmd", 2).orderBy("pos_in_file").collect()
    assert [(r.headword, r.pos, r.sense) for r in rows] == [("စာ", "pron", "1 a"), ("စာ", "pron", "2 b"), ("စာ", "v", "1 c")]
    e = treebanks.with_romanization(spark.createDataFrame([("စာ", ""), ("မာ", "ma")], "headword string, roman string"), lambda c: F.concat(F.lit("r-"), c))
    assert {r.roman for r in e.collect()} == {"r-စာ", "ma"}
    (tmp_path / "g.tsv").write_text("burmese\tcategory\tgloss\nကို\tNouns\tobject\nကို\tOther\tx\n\tNouns\ty\n")
    assert {tuple(r) for r in treebanks.read_grammar(spark, str(tmp_path / "g.tsv"), {"Nouns": "NOUN_MARKER"}).collect()} == {("ကို", "Nouns", "NOUN_MARKER", "object"), ("ကို", "Other", "UNKNOWN", "x")}
    (tmp_path / "p.jsonl").write_text('{"head": "a", "upos": ["NOUN", "VERB"]}\nbad\n{"head": "b", "upos": "ADJ"}\n{"head": "", "upos": ["X"]}\n')
    assert {(r["head"], tuple(r.upos)) for r in treebanks.read_pos_lookup(spark, str(tmp_path / "p.jsonl")).collect()} == {("a", ("NOUN", "VERB")), ("b", ("ADJ",))}
    (tmp_path / "ph.txt").write_text("a_b\t3\na_b\t5\nc\t9\nd_e\t1\nx_y\tz\n")
    assert [tuple(r) for r in treebanks.read_phrases(spark, str(tmp_path / "ph.txt")).collect()] == [("a_b", 2, 5)]


def test_treebank_readers_and_sinks(spark, tmp_path):
    text = "# id 1\n1\ta\t_\tX\tX\t_\t2\tobj\t_\t_\n2\tb\t_\tX\tX\t_\t0\troot\t_\t_\n\n# id 2\n1\tc\t_\tX\tX\t_\t0\troot\t_\t_\n"
    (tmp_path / "a.conllu").write_text(text)
    blocks = treebanks.read_blocks(spark, str(tmp_path / "a.conllu"))
    assert "\n".join(r.value for r in treebanks.blocks_text(blocks).orderBy("sent_id").collect()) == text
    t = readers.read_conllu(spark, str(tmp_path / "a.conllu"))
    assert [r.form for r in treebanks.sentence(t, 1).collect()] == ["c"]
    assert sorted((r.seg, r.head_seg) for r in treebanks.globally_numbered(t).collect()) == [(0, 1), (1, 1), (2, 2)]
    assert treebanks.sniffed(spark, str(tmp_path / "a.conllu")) == "conllu"
    (tmp_path / "t.txt").write_text("SNT.1\t(S (n a) (v b))\nno\nSNT.2\t(S (n c))\n")
    trees = treebanks.read_bracketed(spark, str(tmp_path / "t.txt"))
    leaf = treebanks.leaves(trees)
    assert sorted((r.sent_id, r.i, r.pos, r.token) for r in leaf.collect()) == [("SNT.1", 0, "n", "a"), ("SNT.1", 1, "v", "b"), ("SNT.2", 0, "n", "c")]
    assert treebanks.sniffed(spark, str(tmp_path / "t.txt")) == "bracketed"
    w = treebanks.windows_of(leaf, 3, "alt")
    assert [(list(r.tokens), list(r.sent_end_after)) for r in readers.checked_windows(w).collect()] == [(["a", "b", "c"], [0, 1, 1])]
    assert tuple(treebanks.write_windows(w, str(tmp_path / "w")).first()) == (1, 3, 2)
    treebanks.write_training(t, str(tmp_path / "train"))
    assert sorted((r.form, r.head_offset, r.sent_start) for r in spark.read.parquet(str(tmp_path / "train")).collect()) == [("a", 1, True), ("b", 0, False), ("c", 0, True)]
    d = spark.createDataFrame([(1, "a b <SENT_END> c <SENT_END> "), (2, None)], "doc_id long, text string")
    assert [(r.k, r.sentence) for r in treebanks.marked_sentences(d).collect()] == [(0, "a b"), (1, "c")]
    assert [r.text for r in treebanks.islands_of(spark.createDataFrame([(1, "စာ၊ မာ။သာ")], "doc_id long, text string")).orderBy("island").collect()] == ["စာ", "မာ", "သာ"]


def test_ngram_build_and_artifacts(spark, tmp_path):
    rows = spark.createDataFrame([(1, k, t) for k, t in enumerate("a b x a b c".split())], "doc_id long, i int, token string")
    out = treebanks.ngram_build(rows, spark.createDataFrame([("a",), ("b",), ("c",)], "word string"), str(tmp_path / "n"))
    assert {(r.w1, r.w2): r.n for r in out["bigram"].collect()} == {("a", "b"): 2, ("b", "a"): 1, ("b", "c"): 1}
    assert {r.token: r.n for r in readers.read_counts(spark, str(tmp_path / "n" / "unigram")).collect()} == {"a": 2, "b": 2, "c": 1}
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "n" / "unknown")).collect()] == [{"token": "x", "n": 1}]
    shards = [("p", b'{"k1": 1}'), ("q", b'{"k2": [2]}')]
    parts = spark.createDataFrame(shards, "path string, content binary")
    man = spark.createDataFrame([("a", p, hashlib.sha256(c).hexdigest()) for p, c in shards], "artifact string, path string, sha256 string")
    assert {(r.key, r.value) for r in treebanks.joined_records(parts, man).collect()} == {("k1", "1"), ("k2", "[2]")}


def test_labels_and_cleaning(spark):
    row = spark.range(1).select(
        tags.allowed(F.array(F.lit("NUM"), F.lit("CONJ"))).alias("a"), tags.label_pos(F.lit("POS=NOUN|Number=Sing")).alias("l"), tags.coarse_of(F.lit("12"), F.lit(None).cast("string")).alias("c"),
        tags.same_set(F.array(F.lit("NOUN")), F.array(F.lit("PROPN"))).alias("s"), clean.finite(F.lit(float("nan")), 1.0).alias("f"), clean.ocr_clean(F.lit("စာာ x1")).alias("o"),
        clean.char_class(F.lit("ာ")).alias("m"), clean.decomposed_entities(F.lit("a&#65;&#x1000;&#9;b")).alias("e"), clean.strip_suffix(F.lit("စာ12")).alias("p"),
    ).first()
    assert (list(row.a), row.l, list(row.c), row.s, row.f, row.o, row.m, row.e, row.p) == (["CCONJ", "NOUN", "NUM", "PROPN", "SCONJ"], "NOUN", ["NUM"], True, 1.0, "စာ", "MY_M", "aAက&#9;b", "စာ")
    g = spark.createDataFrame([(1, 0, "NOUN"), (1, 1, "X")], "doc long, i int, label string")
    c = spark.createDataFrame([(1, 0, "VERB", 2), (1, 0, "ADJ", 1)], "doc long, i int, label string, n int")
    assert {(r.i, r.tag, r.changed) for r in tagging.override_counts(g, c).collect()} == {(0, "VERB", True), (1, "X", False)}
    p = spark.createDataFrame([(1, 0, 0, "N", 1.0), (1, 0, 0, "V", -1.0), (1, 0, 1, "V", 3.0)], "doc long, i int, part int, label string, logit double")
    assert {(r.label, r.score) for r in tagging.subword_scores(p).collect()} == {("N", 1.0), ("V", 1.0)}


def test_entities_and_overlays(spark):
    seg = spark.createDataFrame([(1, k, c) for k, c in enumerate("abcd")], "doc long, i int, segment string")
    runs = spark.createDataFrame([(1, 1, 2, "LOC")], "doc long, first int, last int, label string")
    assert [(r.p, r.text, list(r.members), r.label) for r in tagging.collapsed(seg, runs).orderBy("p").collect()] == [(0, "a", [0], None), (1, "bc", [1, 2], "LOC"), (2, "d", [3], None)]
    e = spark.createDataFrame([(1, 0, 1, "X"), (1, 2, 4, "Y")], "doc long, start int, end int, label string")
    isl = spark.createDataFrame([(1, 0, 0, 4, 0, 1), (1, 0, 0, 4, 2, 4)], "doc long, sentence int, sent_start int, sent_end int, start int, end int")
    assert [r.label for r in tagging.off_last_islands(e, isl).collect()] == ["X"]
    assert {(r.i, r.ner_label) for r in tagging.flagged_fills(seg, e).filter("ner_protected").collect()} == {(0, "X"), (2, "Y"), (3, "Y")}
    o = spark.createDataFrame([(1, 0, None, "N"), (1, 1, [1, 2], "V")], "doc long, i int, seg_span array<int>, upos string")
    assert {(r.segment, r.upos) for r in tagging.expanded_overlay(o).collect()} == {(0, "N"), (1, "V"), (2, "V")}
    left, right = spark.createDataFrame([(0, "a", None), (1, "b", "x")], "i int, u string, v string"), spark.createDataFrame([(1, "c"), (2, "d")], "i int, u string")
    assert {tuple(r) for r in lexicon.overlaid(left, right, ["i"]).collect()} == {(0, "a", None), (1, "c", "x"), (2, "d", None)}
    toks = spark.createDataFrame([(1, 0, "n1", ["N"]), (1, 1, "ko", ["PART"])], "doc long, i int, token string, pos array<string>")
    ent = spark.createDataFrame([("ko", "c", "NOUN_MARKER", "obj")], "token string, category string, type string, gloss string")
    rules = spark.createDataFrame([("NOUN_MARKER", "case", "LEFT", ["N"], 1)], "type string, role string, direction string, wanted array<string>, distance int")
    assert [(r.active, r.target, r.direction) for r in tagging.grammar_overlay(toks, ent, rules).collect()] == [(True, 0, "left")]


def test_segment_helpers(spark):
    s = spark.createDataFrame([(1, k, w, known) for k, (w, known) in enumerate([("x", True), ("a", False), ("b", False), ("c", False)])], "doc_id long, i int, segment string, is_known boolean")
    c = spark.createDataFrame([("ab", "abz", 1), ("abc", "abd", 1)], "query string, word string, distance int")
    assert [(r.i, r.j, r.text, r.word) for r in segment.merged_unknown(s, c).collect()] == [(1, 4, "abc", "abd")]
    t = spark.createDataFrame([(1, k, k, k + 1, w) for k, w in enumerate("abcd")], "doc_id long, i int, start int, end int, token string")
    spans = spark.createDataFrame([(1, 0, 2), (1, 1, 4)], "doc_id long, start int, end int")
    assert [r.token for r in segment.aligned_merges(t, spans).orderBy("start").collect()] == ["a", "bcd"]
    p = spark.createDataFrame([(1, ["x", "သ", "ည်", "y", "ပါ"])], "doc_id long, c array<string>")
    rows = boundary.particles(p, [["သ", "ည်"], ["ပါ"]]).orderBy("k").collect()
    assert [(r.chunk, r.ends) for r in rows] == [("x", False), ("သည်", True), ("y", False), ("ပါ", True)]
    r = spark.createDataFrame([("ab စာ ။ မာ",)], "t string").select(tx.script_runs(F.col("t"), MYANMAR).alias("r")).first().r
    assert [(x.start, x.end, x.run) for x in r] == [(3, 5, "စာ"), (8, 10, "မာ")]
    g = spark.createDataFrame([(1, 0, 0, 2, True), (1, 1, 2, 3, True), (1, 2, 4, 5, True), (1, 3, 5, 6, False)], "doc_id long, i int, start int, end int, is_word boolean")
    assert [x.island for x in tx.islands_by_offset(g).orderBy("i").collect()] == [0, 0, 1, None]
