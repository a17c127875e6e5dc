"""Clause markers and chunks against a walk over one sentence at a time."""

import random

from wordloom.functions import markers as m
from wordloom.operators import clauses

WORDS = ["စာ", "သွား", "ဖတ်", "ဆို", "ဟု", "မယ်", "သည်", "ရင်", "မှု", "က", "သော", "၍", "တို့", "မည်", "ခဲ့", "ကြောင့်", "တာ", "မှာ", "ပြီး", "ကျမ", "လောက်", "အိမ်ရှေ့က"]
TAGS = ["VERB", "NOUN", "PART", "SCONJ", "ADP", "PUNCT", "ADJ", "CCONJ"]


def sequence(sent, v, ahead):
    out = []
    beyond = lambda j: next((f for f, p, _ in sent[j + 1 :] if p != "PUNCT"), "")
    for j in range(v + 1, min(v + 1 + ahead, len(sent))):
        form, pos, _ = sent[j]
        if pos == "PUNCT":
            continue
        last = out[-1][1] if out else ""
        said = form == m.SAY and (last in m.FINAL and beyond(j) in m.CONDITIONS or pos == "VERB" and last in m.QUOTES and beyond(j) in m.FINAL)
        if not said and pos not in clauses.MARKING:
            break
        out.append((j, form, pos))
    return out


def classify(marks, deprel):
    forms, last = [f for _, f, _ in marks], marks[-1]
    joined = "".join(forms)
    main = [x for x in marks if x[1] not in m.AUXILIARIES]
    nominal = [x for x in main if x[1] in m.NOMINALIZERS and x[2] in ("PART", "NOUN")]
    if main and main[0] in nominal and all(f in m.NOMINAL_TAIL or p in ("ADP", "SCONJ") for _, f, p in main[1:]):
        return "nominalizer", main[0][1]
    strong = [w for w in m.STRONG if w in forms or len(w) > 1 and joined.endswith(w) or w == joined]
    if strong:
        return "strong", min(strong, key=lambda w: (-len(w), w))
    if last[1] in m.FINAL:
        if nominal and last[1] in m.CASE_LIKE:
            return "nominalizer", nominal[0][1]
        if deprel == "acl" and last[1] in m.ADNOMINAL:
            return "relativizer", last[1]
        if last[1] == m.TOPIC and m.PLURAL in forms:
            return "none", None
        if not main or main[-1][1] in m.FINAL:
            return "final", last[1]
    if last[1] in m.NOMINALIZERS and last[2] in ("PART", "NOUN"):
        return "nominalizer", last[1]
    if last[1] in m.RELATIVIZERS:
        return "relativizer", last[1]
    weak = [w for w in m.MODERATE if w in forms]
    return ("moderate", min(weak, key=lambda w: (-len(w), w))) if weak else ("none", None)


def walk(sent, ahead):
    out = []
    for v, (form, pos, deprel) in enumerate(sent):
        before = next((f for f, p, _ in reversed(sent[:v]) if p != "PUNCT"), "")
        if pos not in ("VERB", "ADJ") or pos == "ADJ" and deprel not in ("acl", "root", "advcl") or form == m.SAY and pos == "VERB" and before in m.QUOTES:
            continue
        marks = sequence(sent, v, ahead)
        if marks and (found := classify(marks, deprel))[0] not in ("none", "nominalizer"):
            out.append((v, marks[-1][0], *found))
    return out


def chunks(sent, found, moderate, relative):
    cuts = sorted((e, v, k, t) for v, e, k, t in found if k in ("strong", "final") or k == "moderate" and moderate or k == "relativizer" and relative)
    text = lambda a, b: " ".join(f for f, p, _ in sent[a : b + 1] if p != "PUNCT")
    if not cuts:
        return [(0, len(sent) - 1, text(0, len(sent)), "single", None)]
    out, at = [], 0
    for e, _, k, t in cuts:
        if e >= at:
            out.append((at, e, text(at, e), k, t))
            at = e + 1
    if at < len(sent):
        out.append((at, len(sent) - 1, text(at, len(sent)), "remainder", None))
    return [x for x in out if x[2].strip()]


def test_clauses_equal_a_walk(spark):
    r = random.Random(9)
    sents = {k: [(r.choice(WORDS), r.choice(TAGS), r.choice(["acl", "root", "obj"])) for _ in range(r.randint(1, 14))] for k in range(400)}
    sents[-1] = [("ဖတ်", "VERB", "root"), ("မယ်", "PART", "x"), ("။", "PUNCT", "x"), ("ဆို", "VERB", "x"), ("ရင်", "SCONJ", "x"), ("စာ", "NOUN", "obj")]
    sents[-2] = [("ဖတ်", "VERB", "root"), ("ဟု", "PART", "x"), ("ဆို", "VERB", "root"), ("သည်", "PART", "x")]
    rows = [(k, i, *t) for k, s in sents.items() for i, t in enumerate(s)]
    df = spark.createDataFrame(rows, "doc long, i int, form string, pos string, deprel string").repartition(3)
    for ahead in (12, 2):
        got = sorted(tuple(x) for x in clauses.boundaries(df, ahead).collect())
        assert got == sorted((k, *b) for k, s in sents.items() for b in walk(s, ahead))
    assert {x[3] for x in got} == {"strong", "moderate", "final", "relativizer"}
    for moderate, relative in ((True, False), (False, True)):
        pieces = sorted(tuple(x)[:1] + tuple(x)[2:] for x in clauses.clause_chunks(df, moderate, relative).collect())
        assert sorted(map(str, pieces)) == sorted(str((k, *c)) for k, s in sents.items() for c in chunks(s, walk(s, 12), moderate, relative))
    assert clauses.boundaries(df.limit(0)).count() == clauses.clause_chunks(df.limit(0)).count() == 0


def test_sentences_in_rows_are_not_shuffled(spark):
    r = random.Random(3)
    rows = [(k, i, r.choice(WORDS), r.choice(TAGS), r.choice(["acl", "root"])) for k in range(60) for i in range(r.randint(1, 15))]
    df = spark.createDataFrame(rows, "doc long, i int, form string, pos string, deprel string")
    held = clauses.gathered(df).checkpoint()
    for f in (clauses.boundaries, clauses.clause_chunks, lambda x: clauses.classified(clauses.marker_sequences(x))):
        out = f(held)
        assert sorted(map(str, out.collect())) == sorted(map(str, f(df).collect()))
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
