"""Correction of scanned text and arbitration, against small versions that walk one text at a time."""

import random
import unicodedata

from pyspark.sql import functions as F

from wordloom.functions import clean
from wordloom.functions.profile import MYANMAR
from wordloom.operators import lm, repair, segment

LETTERS = "ကခဂဃငစဆဇ"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def nearest(token, words, slack, most, least):
    found = []
    for w in words:
        if len(token) > 1 and len(w) > 1 and w[0] == token[0] and abs(len(w) - len(token)) <= slack and distance(token, w) <= most:
            similar = 1 - distance(token, w) / max(len(w), len(token))
            if similar >= least:
                found.append((-similar, len(w), w))
    return min(found)[2] if found else None


def corrected_slow(segments, words):
    is_open = [s not in words and all("က" <= c <= "႟" for c in s) for s in segments]
    out, i = [], 0
    while i < len(segments):
        n = 0
        while n < 3 and i + n < len(segments) and is_open[i + n]:
            n += 1
        whole = "".join(segments[i : i + n])
        if n > 1 and (whole if whole in words else nearest(whole, words, 2, 3, 0.5)):
            out.append((whole if whole in words else nearest(whole, words, 2, 3, 0.5), whole, "greedy_merge"))
            i += n
            continue
        s = segments[i]
        if is_open[i]:
            bare = s.replace("္္", "္").rstrip("္") or s
            new = bare if bare in words else nearest(bare, words, 1, 2, 0.6) or bare
            out.append((new, s, "spell_correct" if new != s else None))
        else:
            out.append((s, s, None))
        i += 1
    return out


def test_corrections_equal_a_walk(spark):
    r = random.Random(3)
    words = {"".join(r.choices(LETTERS, k=r.randint(1, 6))) for _ in range(40)} | {"ကခဂ", "စဆ"}
    texts = [(None, []), (-1, ["စဆ္္", "ab", "ကခဂ"]), (-2, ["္"]), (-3, ["ကခ", "ဂ"])]
    for k in range(120):
        n = r.randint(1, 9)
        texts.append((k, [r.choice([r.choice(sorted(words)), "".join(r.choices(LETTERS, k=r.randint(1, 3))), "".join(r.choices(LETTERS, k=2)) + "္", "x1"]) for _ in range(n)]))
    df = spark.createDataFrame(texts, "doc_id long, words array<string>").repartition(3)
    lexicon = spark.createDataFrame([(w,) for w in words], "word string")
    got = {x.doc_id: ([tuple(p) for p in x.pieces], x.changed) for x in repair.corrected(df, lexicon, MYANMAR).collect()}
    assert set(got) == {k for k, w in texts if w}
    for k, w in texts:
        if w:
            want = corrected_slow(w, words)
            assert got[k] == (want, any(m for *_, m in want)), w
    assert {m for p, _ in got.values() for *_, m in p} == {None, "greedy_merge", "spell_correct"}


def arbitrated_slow(first, second, words, least):
    cuts, ends, at = set(), {}, 0
    for w in second:
        ends[at] = w
        cuts.add(at)
        at += len(w)
    cuts.add(at)
    out, i, at = [], 0, 0
    unknown = lambda s: s not in words and any("က" <= c <= "႟" for c in s)
    while i < len(first):
        n = 0
        while i + n < len(first) and unknown(first[i + n]):
            n += 1
        size = len("".join(first[i : i + n]))
        if n >= least and n and "".join(first) == "".join(second) and at in cuts and at + size in cuts:
            place = at
            while place < at + size:
                out.append(ends[place])
                place += len(ends[place])
        else:
            size = len("".join(first[i : i + max(n, 1)]))
            out += first[i : i + max(n, 1)]
        i, at = i + max(n, 1), at + size
    return out


def test_arbitration_equals_a_walk(spark):
    r = random.Random(5)

    def cut(text):
        out = []
        while text:
            n = r.randint(1, 3)
            out, text = [*out, text[:n]], text[n:]
        return out

    rows = []
    for k in range(150):
        text = "".join(r.choices(LETTERS[:3] + "x", k=r.randint(1, 12)))
        rows.append((k, cut(text), cut(text) if k % 10 else cut(text + "က")))
    words = {"ကခ", "က", "ခဂ", "ဂဂ", "ဂ"}
    lexicon = spark.createDataFrame([(w,) for w in words], "word string")
    first, second = (spark.createDataFrame([(x[0], x[i]) for x in rows if i == 1 or x[0] % 9], "doc_id long, words array<string>") for i in (1, 2))
    for least in (1, 2):
        got = {x.doc_id: x.words for x in repair.arbitrated(first, second, lexicon, MYANMAR, least).collect()}
        for k, a, b in rows:
            assert got[k] == arbitrated_slow(a, b if k % 9 else [], words, least), (a, b)
    strict = {x.doc_id: x.words for x in repair.arbitrated(first, second, lexicon, MYANMAR, strict=True).collect()}
    assert all("".join(strict[k]) == "".join(a) for k, a, _ in rows)


def test_scanned_text(spark):
    """A misread word is one edit from a word of the lexicon; the text is cut again after it is mended."""
    words = spark.createDataFrame([("ကခဂဃ", 5), ("စဆဇ", 3), ("ငစ", 2)], "token string, n long")
    costs = lm.unigram_costs(words)[0]
    texts = spark.createDataFrame([(1, "ကခဂဃစဆဇ"), (2, "ကခဃစဆဇ"), (3, "abကခဂဃ"), (4, ""), (5, None)], "doc_id long, text string")
    got = {r.doc_id: (r.words, [tuple(m) for m in r.marks]) for r in repair.scanned(texts, words.select(F.col("token").alias("word")), costs, MYANMAR).collect()}
    assert got[1] == (["ကခဂဃ", "စဆဇ"], [])
    assert got[2] == (["ကခဂဃ", "စဆဇ"], [(0, 4, "ကခဂဃ", "ကခဃ", "greedy_merge")])
    assert got[3] == (["abကခဂဃ"], []) and not set(got) & {4, 5}
    assert segment.Weights().most == 16


def ocr_slow(text):
    """One character after another, with the marks of the last base."""
    out, base, used = [], False, set()
    for c in unicodedata.normalize("NFC", text.replace("၀", "ဝ").replace("°", "")):
        if c.isspace():
            out.append(" ")
            base = False
        elif 0xA9E0 <= ord(c) <= 0xA9FF or 0xAA60 <= ord(c) <= 0xAA7F or "က" <= c <= "႟":
            if 0x102B <= ord(c) <= 0x103E or 0x1056 <= ord(c) <= 0x1059:
                if base and not (c in "ါာိီုူဲံ့း်" and c in used):
                    out.append(c)
                    used.add(c)
            else:
                out.append(c)
                base, used = c not in "၊။", set()
    return " ".join("".join(out).split())


def test_ocr_cleaning_equals_a_state_machine(spark):
    r = random.Random(7)
    chars = "ကခဝ၀၁ါာိီုူဲံ့း်္ျြွှဦေ၊။ꩡꧠ ab°1​ \nႍၖ"
    texts = ["".join(r.choices(chars, k=r.randint(0, 30))) for _ in range(1500)] + ["", "ကA" + "ာ" * 5]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k long, t string")
    got = {x.k: x.o for x in df.select("k", clean.ocr_clean(F.col("t")).alias("o")).collect()}
    assert got.pop(-1) is None
    for k, o in got.items():
        assert o == ocr_slow(texts[k]), texts[k].encode("unicode_escape")
