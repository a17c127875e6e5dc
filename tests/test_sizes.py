"""What large tables need: steps that stay within a row, few and small shuffles."""

import contextlib
import io
import random
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import functions as F

from wordloom.functions import syllables as syl
from wordloom.functions import text as tx
from wordloom.functions.profile import LATIN, MYANMAR
from wordloom.functions import clean
from wordloom.operators import corpus, lexicon, lm, repair, runs, segment, synthetic
from wordloom.plans import analysis, queries

SMALL = "/root/testdata/sf0.001"


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


def shuffles(df) -> int:
    return plan(df).count("Exchange hashpartitioning")


def test_trees_are_read_within_their_rows(spark):
    label = "L" * 1200
    t = spark.createDataFrame([(1, f"({label} (noun (t a) (t b)) (v c))"), (2, "(a (b x)")], "sent_id long, tree string")
    nodes = corpus.bracket_nodes(t)
    assert shuffles(nodes) == 0
    assert {(r.sent_id, r.label, r.node, r.depth, r.start, r.end, r.parent) for r in nodes.collect()} == {
        (1, label, 0, 0, 0, 3, None), (1, "noun", 1, 1, 0, 2, 0), (1, "t", 2, 2, 0, 1, 1), (1, "t", 5, 2, 1, 2, 1), (1, "v", 9, 1, 2, 3, 0), (2, "b", 1, 1, 0, 1, None),
    }


def test_heads_need_no_rounds(spark):
    jobs = spark.sparkContext.statusTracker()
    t = spark.createDataFrame([(1, "(root (noun (t a) (t b)) (verb (v c) (p d)))")], "sent_id long, tree string")
    w = spark.createDataFrame([(1, 0, "a", "ADJ"), (1, 1, "b", "VERB"), (1, 2, "c", "VERB"), (1, 3, "d", "PART")], "sent_id long, i int, form string, upos string")
    spark.sparkContext.setJobGroup("heads", "heads")
    got = corpus.arcs(corpus.percolated(corpus.bracket_nodes(t), w), w)
    assert not jobs.getJobIdsForGroup("heads")
    spark.sparkContext.setJobGroup("rest", "rest")
    assert {(r.i, r["head"], r.deprel) for r in got.collect()} == {(0, 2, "amod"), (1, 0, "acl"), (2, -1, "root"), (3, 2, "case")}


def test_minimal_spans_meet_within_a_sentence(spark):
    s = spark.createDataFrame([(1, "NP", 0, 4), (1, "NP", 0, 2), (1, "NP", 0, 2), (1, "VP", 1, 3), (1, "NP", 3, 4)], "sent_id long, label string, start long, end long")
    got = corpus.base_chunks(s, ["NP", "VP"])
    assert shuffles(got) == 1
    assert {(r.label, r.start, r.end) for r in got.collect()} == {("NP", 0, 2), ("NP", 3, 4)}


def test_sentence_ends_are_not_shuffled(spark):
    assert shuffles(queries.sentence_ends(spark, SMALL)) == 0


def test_word_counts_stand_in_for_sums_over_pairs(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["b"]), (3, []), (4, ["c", "a", "b"])], "doc_id long, t array<string>")
    words = lm.neighbours(rows)
    assert {tuple(r) for r in words.collect()} == {("a", 3, 3, 2), ("b", 4, 1, 3), ("c", 1, 1, 0)}
    asked = spark.createDataFrame([("a", "b"), ("a", "b"), ("b", "c")], "w1 string, w2 string")
    few = lm.bigrams(rows, asked)
    assert {tuple(r) for r in few.collect()} == {("a", "b", 3)}
    plain, shared = lm.bigram_costs(lm.bigrams(rows)), lm.bigram_costs(lm.bigrams(rows), words=words)
    for x, y in zip(plain, shared):
        assert {tuple(r) for r in x.collect()} == {tuple(r) for r in y.collect()}
    assert [r.cost for r in lm.bigram_costs(few, words=words)[0].collect()] == [r.cost for r in plain[0].filter("w1 = 'a' and w2 = 'b'").collect()]
    assert {tuple(r) for r in lm.bigram_shares(lm.bigrams(rows), words).collect()} == {tuple(r) for r in lm.bigram_shares(lm.bigrams(rows)).collect()}


def test_pairs_are_counted_in_their_task_before_they_are_dealt_out(spark, monkeypatch):
    docs = {1: ["a", "b", "a", "b"], 2: None, 3: ["a b", None, "", "a b", None], 4: [], 5: ["b"], 6: ["a", "b"], 7: ["\u00e9", "_"]}
    want = Counter(p for t in docs.values() if t for p in zip(t, t[1:]))
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, t array<string>").coalesce(1)
    got = lm.bigrams(rows)
    below = plan(got).split("Exchange hashpartitioning(w1")[1]
    assert shuffles(got) == 1 and "Generate" not in below and "HashAggregate" not in below
    assert {(r.w1, r.w2): r.n for r in got.collect()} == want and got.count() == len(want)
    monkeypatch.setattr(lm, "HELD", 1)
    monkeypatch.setattr(lm, "AT_ONCE", 2)
    lists = [pa.array([t], pa.list_(pa.string())) for t in docs.values()]
    parts = [[tuple(x.values()) for x in b.to_pylist()] for b in lm.counted_pairs(iter(lists))]
    assert all(len(x) <= 2 for x in parts) and sum((Counter({(a, b): n}) for x in parts for a, b, n in x), Counter()) == want
    sliced = pa.array(list(docs.values()), pa.list_(pa.string())).slice(2, 3)
    assert {(x["w1"], x["w2"]): x["n"] for b in lm.pair_counts([sliced]) for x in b.to_pylist()} == {("a b", None): 2, (None, ""): 1, ("", "a b"): 1}


def test_words_are_cut_where_pairs_are_counted(spark, monkeypatch):
    r = random.Random(5)
    chars = [*"aaabZ  \n_-1\x00\u00e9\u00c9\u00df\u00f7\u00d7\u00ff\u0100\u0130\u0301\u212a\u1000\u103a\u1040\u104a\U0001f600\ud7ff\ue000"]
    texts = [None, "", "ab", " ab", "ab ", *("".join(r.choices(chars, k=r.choice([1, 2, 9, 60]))) for _ in range(300)), "", None]
    for p in (LATIN, MYANMAR):
        body = p.word[1:-2]  # the class alone
        want = [re.findall(p.word, t or "") for t in texts]
        for block in (1, 100, 1 << 20):
            monkeypatch.setattr(tx, "BLOCK", block)
            for kind in (pa.string(), pa.large_string()):
                assert [x for part in tx.cut_words(pa.array(texts, kind), body) for x in part.to_pylist()] == want
        assert [x for part in tx.cut_words(pa.array(texts).slice(7, 50), body) for x in part.to_pylist()] == want[7:57]
    assert [x for part in tx.cut_words(pa.array([], pa.string()), "a-z") for x in part.to_pylist()] == []
    assert LATIN.word == f"[{LATIN.letter}]+"
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = lm.bigrams(docs.select(LATIN.norm(F.col("text")).alias("t")), letter=LATIN.letter)
    assert "regexp_extract_all" not in plan(queries.bigrams(spark, SMALL))
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in lm.bigrams(tx.token_arrays(docs, LATIN)).collect()}


def test_runs_of_a_place_are_shuffled_as_one_row(spark):
    rows = spark.createDataFrame([(1, ["a", "b", "a", "b"]), (2, ["a_b", "a"]), (3, ["a"]), (4, [])], "doc_id long, t array<string>")
    got = lm.spans(rows)
    assert shuffles(got) == 1
    want = {("a_b", 2, 2), ("b_a", 2, 1), ("a_b_a", 3, 1), ("b_a_b", 3, 1), ("a_b_a_b", 4, 1), ("a_b_a", 2, 1)}
    assert {(r.phrase, r["size"], r.n) for r in got.collect()} == want


def test_composed_texts_stay_arrow_arrays(spark):
    rows = spark.createDataFrame([("e\u0301",), ("\u00e9 plain",), (None,), ("\u1026 n\u0303",)], "t string")
    got = rows.select("t", tx.nfc(F.col("t")).alias("c"))
    assert ", 250" in plan(got)  # a scalar function of Arrow arrays, not of pandas objects
    assert [r.c for r in got.collect()] == ["\u00e9", "\u00e9 plain", None, "\u1026 \u00f1"]


def syllables_slow(t):
    """Character by character."""
    kind = lambda c: next((k for k, n in enumerate(syl.ORDER) if n != "X" and re.match(f"[{syl.CLASSES[n]}]", c)), 0)
    out = []
    for i, c in enumerate(t):
        state = syl.BETWEEN[kind(t[i - 1])][kind(c)] if i else 0
        whole = state == 1 or state == 5 and (t[i - 1] == "\u1021" or c == "\u103f" or re.match("\u1037?\u103a|\u1039", t[i + 1 :]))
        out = [*out[:-1], out[-1] + c] if whole else [*out, c]
    return out


def test_syllables_are_looked_up_without_a_pattern(spark):
    r = random.Random(3)
    chars = [chr(c) for c in [*range(0x1000, 0x10A0), *range(0xAA60, 0xAA7C)]] + list("a |\n\u00e9\U0001f600") + ["\u1037\u103a", "\u1039", "\u103a", "\u1000", "\u1021", "\u103f"] * 20
    texts = [None, "", *("".join(r.choices(chars, k=r.choice([0, 1, 2, 3, 40]))) for _ in range(500)), "", None]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").repartition(3).select("k", "t", syl.syllables(F.col("t")).alias("s"))
    assert "ArrowEvalPython" in plan(got) and "split(" not in plan(got)
    assert {x.k: x.s for x in got.collect()} == {k: t if t is None else syllables_slow(t) for k, t in enumerate(texts)}


def test_places_that_begin_no_phrase_are_left_out_before_runs_are_made(spark):
    docs = {1: ["a", "b", "c", "d", "a", "b"], 2: ["a_b", "c", "x"], 3: ["a"], 4: [], 5: ["c", "d", "e", "f", "g"]}
    rows = spark.createDataFrame(list(docs.items()), "doc_id long, t array<string>")
    inv = spark.createDataFrame([("a_b", 2, 5), ("a_b_c", 3, 4), ("a_b_c", 2, 3), ("d_e_f_g", 4, 2), ("c_d", 2, 1)], "phrase string, size int, n long")
    got = lm.phrases(rows, inv)
    assert "LeftSemi" in plan(got) and plan(got).count("hashpartitioning(doc_id") == 1
    want = {(1, 0, 3, "a_b_c", 4), (1, 4, 6, "a_b", 5), (2, 0, 2, "a_b_c", 3), (5, 0, 2, "c_d", 1)}
    assert {tuple(r) for r in got.collect()} == want
    before, lm.SENT = lm.SENT, 2
    try:
        large = lm.phrases(rows, inv)
        assert "LeftSemi" not in plan(large) and {tuple(r) for r in large.collect()} == want
    finally:
        lm.SENT = before


def test_sentences_and_islands_do_not_carry_their_text(spark):
    rows = spark.createDataFrame([(1, "One two. Three ,, four! ."), (2, ""), (3, None), (4, "?? a b")], "doc_id long, text string")
    pieces = tx.piece_arrays(rows, LATIN)
    sents, isles = tx.sentence_table(pieces, "!.?"), tx.islands(pieces)
    for df in (sents, isles):
        kept = re.search(r"Generate posexplode\(.*\), \[([^\]]*)\], true", plan(df)).group(1)
        assert re.sub(r"#\d+L?", "", kept) == "doc_id"
    assert {(r.doc_id, r.sentence, tuple(r.p), tuple(r.is_word)) for r in sents.collect()} == {
        (1, 0, ("one", "two", "."), (True, True, False)), (1, 1, ("three", ",,", "four", "!"), (True, False, True, False)), (1, 2, (".",), (False,)), (4, 0, ("??",), (False,)), (4, 1, ("a", "b"), (True, True)),
    }
    assert {tuple(r) for r in isles.collect()} == {(1, 0, 0, 1, 2, "one two"), (1, 1, 3, 3, 1, "three"), (1, 2, 5, 5, 1, "four"), (4, 0, 1, 2, 2, "a b")}


def test_only_places_of_sentences_are_sorted(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(synthetic, "ranked", lambda rows, order: seen.append(rows.columns) or corpus.ranked(rows, order))
    sents = spark.createDataFrame([(7, ["a", "b"]), (7, ["c"]), (8, []), (9, ["d", "e"])], "id long, tokens array<string>")
    got = synthetic.documents(30, sents, spark.createDataFrame([("#",)], "token string"), "a-z").collect()
    assert all("tokens" not in columns for columns in seen)
    assert [r.doc for r in sorted(got)] == list(range(30)) and {t[0] for r in got for t in r.tokens} >= set("abcde")


def test_unknown_runs_shuffle_no_words(spark):
    docs = spark.createDataFrame([(1, "a xx yy b b zz"), (2, "xx yy"), (3, "a b"), (4, ""), (5, None), (None, "zz a"), (6, "1 ,")], "doc_id long, text string")
    words = spark.createDataFrame([("a",), ("b",)], "word string")
    got = lexicon.merge_unknown_runs(docs, words, LATIN)
    assert "Window" not in plan(got)
    assert {(r.doc_id, r["first"], r.n, r.token, r.is_known) for r in got.collect()} == {
        (1, 0, 1, "a", True), (1, 1, 2, "xxyy", False), (1, 3, 1, "b", True), (1, 4, 1, "b", True), (1, 5, 1, "zz", False),
        (2, 0, 2, "xxyy", False), (3, 0, 1, "a", True), (3, 1, 1, "b", True), (None, 0, 1, "zz", False), (None, 1, 1, "a", True),
    }


def test_candidates_that_are_no_words_are_no_rows(spark, monkeypatch):
    r = random.Random(11)
    letters = [*"ကခဂဃင", "ကာ", "ခိ", "က္ခ", "A", " "]
    pick = lambda k: "".join(r.choices(letters, k=k))
    words = sorted({pick(r.randint(1, 4)).replace("A", "").strip() for _ in range(60)} | {"ကခဂဃ", ""})
    texts = [(k, pick(r.choice([1, 2, 5, 9, 25]))) for k in range(200)] + [(-1, ""), (-2, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    lex = spark.createDataFrame([(w, r.choice(["user", "dict"])) for w in words], "word string, source string")
    costs = spark.createDataFrame([(w, r.choice([0.5, 3.0, 14.0, 40.0])) for w in words[::2]], "token string, cost double")
    rows = segment.lattice(docs, MYANMAR, 16).checkpoint()
    for lexicon_ in (lex, lex.select("word"), lex.filter("word = 'x'")):
        for most in (16, 2):
            w, some = segment.Weights(most=most), rows.filter(F.col("j") - F.col("i") <= most)
            want = {(x.doc_id, tuple(x.words)) for x in segment.best_paths(segment.priced(some, lexicon_, costs, w), w=w).collect()}
            assert {(x.doc_id, tuple(x.words)) for x in segment.cheapest(docs, lexicon_, costs, MYANMAR, w).collect()} == want and len(want) == 200
            want = {(x.doc_id, tuple(x.words)) for x in segment.max_match(some, lexicon_).collect()}
            assert {(x.doc_id, tuple(x.words)) for x in segment.longest(docs, lexicon_, MYANMAR, most).collect()} == want
    monkeypatch.setattr(segment, "lattice", None)
    asked, plain = [], segment.longest
    monkeypatch.setattr(segment, "longest", lambda t, *a, **b: asked.extend(x.text for x in t.collect()) or plain(t, *a, **b))
    got = repair.scanned(spark.createDataFrame([(1, "ကခဂဃကာ"), (2, "ဆဇ")], "doc_id long, text string"), spark.createDataFrame([("ကခဂဃ",), ("ကာ",)], "word string"), costs, MYANMAR)
    assert {(x.doc_id, tuple(x.words)) for x in got.collect()} == {(1, ("ကခဂဃ", "ကာ")), (2, ("ဆ", "ဇ"))}
    assert asked == ["ဆဇ"]


def test_scanned_words_are_cleaned_once_each(spark, monkeypatch):
    r = random.Random(13)
    chars = [*"aehdkwy0159.,  \n-A\u00b0\u00e9\u00a0\u3000\u1000\u1025\u102e\u1037\u1039\u103a\u108d\u1040\u104a\u104b\uaa61\u0130\u03a3"]
    texts = [None, "", " ", ".", *("".join(r.choices(chars, k=r.choice([1, 5, 60]))) for _ in range(600))] + ["ab ab"] * 50
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    whole = clean.ocr_clean(F.translate(F.lower(F.coalesce("text", F.lit(""))), analysis.FROM, analysis.TO))
    want = {x.w for x in docs.select(F.explode(F.split(whole, "[ ၊။]")).alias("w")).filter("w <> ''").collect()}
    for block in (10, 1 << 20):
        monkeypatch.setattr(tx, "BLOCK", block)
        got = [x.text for x in clean.ocr_distinct(docs, analysis.FROM, analysis.TO).collect()]
        assert sorted(got) == sorted(want)
    parts = [x.token for x in tx.distinct_runs(docs, "^ ").collect()]
    assert "Python" not in plan(clean.ocr_distinct(docs, analysis.FROM, analysis.TO)) and len(parts) == len(set(parts))


def test_places_of_runs_are_shuffled_in_packed_blocks(spark, monkeypatch):
    r = random.Random(17)
    texts = [None, "", "ab", "a b", *(" ".join(r.choices(["a", "b", "c", "\u00e9", "dd_e", "f1g", "zzz"], k=r.choice([1, 2, 3, 5, 40]))) for _ in range(200)), None]
    words = [re.findall(LATIN.word, t or "") for t in texts]
    count = lambda least, most: Counter(("_".join(w[i : i + k]), k) for w in words for k in range(least, most + 1) for i in range(len(w) - k + 1))
    docs = spark.createDataFrame([(t,) for t in texts], "t string").repartition(3)
    for least, most in ((2, 4), (1, 3), (3, 3), (2, 6)):
        got = lm.spans(docs, least, most, LATIN.letter)
        assert {(x.phrase, x["size"]): x.n for x in got.collect()} == count(least, most) and got.count() == len(count(least, most))
    assert got.dtypes == lm.spans(tx.token_arrays(docs.select(F.lit(1).alias("doc_id"), F.col("t").alias("text")), LATIN)).dtypes
    below = plan(queries.spans_2_4(spark, SMALL)).split("Exchange hashpartitioning(part")[1]
    assert "MapInArrow" in below and "Generate" not in below
    assert {(x.phrase, x["size"]): x.n for x in lm.spans(spark.createDataFrame([("a_b c", ), ("a b_c",)], "t string"), letter="a-z_").collect()} == {("a_b_c", 2): 2}
    # A block holds a part's words once, and its places take few bytes.
    names = ["".join(r.choices("abcdefgh", k=6)) for _ in range(500)]
    many = pa.array([r.choices(names, k=400) for _ in range(100)])
    monkeypatch.setattr(runs, "AT_ONCE", 7)
    packed, total = Counter(), 0
    for part, size, n_words, n_rows, block in runs.blocks([many, many.slice(3, 0), many.slice(90)], 2, 4, 5):
        total += len(block)
        names, columns, n = runs.unpack(pa.py_buffer(block), size, n_words, n_rows, 4)
        assert len(set(names.to_pylist())) == n_words and len(n) == n_rows
        batches = [b.to_pylist() for b in runs.counted([(names, columns, n)], 2, 4)]
        packed += Counter({(x["phrase"], x["size"]): x["n"] for b in batches for x in b})
    lists = many.to_pylist() + many.slice(90).to_pylist()
    assert packed == Counter(("_".join(w[i : i + k]), k) for w in lists for k in (2, 3, 4) for i in range(len(w) - k + 1))
    assert total < 10 * 400 * 100
    assert not [*runs.blocks([pa.array([["a"], None, []], pa.list_(pa.string()))], 2, 4, 5)]
