"""Gaps, their labels and marker scores: nothing is shuffled or read again that need not be."""

from pyspark.sql import functions as F

from wordloom.functions.profile import LATIN
from wordloom.operators import boundary


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gaps_are_worked_out_within_a_text(spark):
    docs = spark.createDataFrame([(1, " one two three four\nfive 5 - x7\n\nsix seven eight nine ten."), (2, None), (3, "  \n "), (4, "a b")], "doc_id long, text string")
    held = boundary.gap_arrays(docs, LATIN.letter)
    rows = {(r.doc_id, r.i): r for r in boundary.gaps(held).collect()}
    assert len(rows) == 15 and {k[0] for k in rows} == {1, 4}
    assert [rows[1, i].line for i in (0, 3, 4, 8)] == [0, 0, 1, 3] and rows[1, 7].gap == "\n\n" and rows[1, 12].gap == ""
    assert [rows[1, i].kind for i in (4, 5, 6, 7)] == ["MY", "DIGIT", "PUNCT", "MY"] and rows[1, 7].junk and rows[1, 12].junk
    assert {(r.doc_id, r.med, r.mad) for r in held.collect()} == {(1, 4.0, 1.0), (2, 0.0, 0.0), (3, 0.0, 0.0), (4, 2.0, 0.0)}
    labels = boundary.silver_labels(held)
    got = [r.label for r in labels.orderBy("i").collect()]
    assert got == ["O", "O", "O", "O", "SENT_END", "O", "O", "PARA_END", "O", "O", "O", "O"]
    few = boundary.gap_features(held, ["prev_t", "next_line_short"])
    assert {tuple(sorted(r.features)) for r in few.collect()} == {("next_line_short", "prev_t")}
    assert len(boundary.gap_features(held).first().features) == 32
    assert all("Exchange" not in plan(x) for x in (labels, few, boundary.gaps(held)))


def test_marker_scores_read_the_next_word_in_linear_time(spark):
    raw = spark.createDataFrame([(1, "<SENT_END> one two <SENT_END> - the three <SENT_END> four <SENT_END>"), (2, None)], "doc_id long, text string")
    guess = spark.createDataFrame([(1, 1), (1, 0)], "doc_id long, k int")
    out = boundary.marker_scores(raw, guess, ["the"], LATIN.letter)
    assert tuple(out.first()) == (2, 2, 2, 1)  # the first marker has no place, the second is ignored
    assert tuple(boundary.marker_scores(raw.limit(0), guess.limit(0), ["the"], LATIN.letter).first()) == (0, 0, 0, 0)
    carried = boundary.carried_labels(spark.createDataFrame([(1, 0, "a", 0), (1, 1, "-", 1)], "doc_id long, i int, token string, y int"), F.col("token") == "a")
    assert "unboundedfollowing" not in plan(out).lower() and "currentrow$(), unboundedfollowing" not in plan(carried).lower()


def test_logarithms_are_those_of_the_c_library(spark):
    import math

    from wordloom.operators import tagging

    values = [(a / b,) for b in range(1, 80) for a in range(1, b)]
    rows = spark.createDataFrame(values, "x double").select("x", tagging.logarithm(F.col("x")).alias("y")).collect()
    assert all(r.y == math.log(r.x) for r in rows)
    assert spark.createDataFrame([(None,), (0.0,)], "x double").filter(tagging.logarithm(F.col("x")).isNotNull()).count() == 0


def test_cleaning_splits_only_runs_that_repeat_a_mark(spark):
    from wordloom.functions import clean

    df = spark.createDataFrame([("ကာိာ ခုုိ",), ("ကှှ",), ("",), (None,)], "t string").select(clean.ocr_clean(F.col("t")).alias("o"))
    assert [r.o for r in df.collect()] == ["ကာိ ခုိ", "ကှှ", "", None]
    assert "array_position" not in plan(df)
