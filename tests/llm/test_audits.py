"""Filter audit, similarity classes and divergence, against brute-force versions."""

import re
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wordloom.llm import divergence, filters, rtree

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- filters ---


def audit_slow(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, text, part in docs:
        text = text or ""
        w = WORD.findall(text)
        f = set()
        f |= {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text) else set()
        f |= {"D"} if re.search("[#$%&*|]", text) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in docs) else set()
        fails.append((i, part or "", f))
    out = {}
    for part in {p for _, p, _ in fails}:
        own = [(i, f) for i, p, f in fails if p == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(i, f) for i, f in left if x in f]
                left = [(i, f) for i, f in left if x not in f]
                shapley[x] += len(gone)
                redundant = sum(x in f for _, f in own) - len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), redundant, sum(f == {x} for _, f in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filter_audit_odd_rows(spark):
    long_, many = " ".join(f"w{k}" for k in range(250)), " ".join(["same words again"] * 90)
    docs = [(1, long_, "en"), (2, long_, "de"), (2, long_, "de"), (3, many, "en"), (4, None, None), (5, "", ""), (None, long_, "en"), (None, "ABC $", "en"), (6, "ABC $", None), (7, "ABCÄ " + long_, "en")]
    docs += [(8, long_ + " #", "en"), (9, "$" + "x " * 200_000, "fr"), (1, "another text of id one", "en"), (10, many, "မ")]
    labels = [(1, 1, 0), (2, 0, 1), (2, None, None), (3, 1, 1), (3, 1, 0), (None, 1, 1), (99, 1, 1), (8, 0, 1)]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, lang string, fails int").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filters.audit(df, marks).collect()}
    assert got == audit_slow(docs, labels)
    assert filters.audit(df.limit(0), marks).count() == 0
    assert filters.audit(df, marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_filter_sums_are_sent_on_when_parts_are_many(spark):
    rows = spark.range(200).select((F.col("id") % 50).cast("string").alias("part"), (F.col("id") % 32).cast("int").alias("fails"), (F.col("id") % 4).cast("int").alias("label"))
    a, b = (sorted(map(tuple, filters.removals(rows, k).collect())) for k in (1024, 3))
    assert a == b and len(a) == 50 * 120 * 6


# --- similarity classes ---


def shingles_slow(text, words=3):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def classes_slow(docs, percent=90):
    sets = [shingles_slow(t) for _, t in docs]
    label = list(range(len(docs)))
    for i, j in combinations(range(len(docs)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) and label[i] != label[j]:
            old = label[j]
            label = [label[i] if x == old else x for x in label]
    least = defaultdict(list)
    for (d, _), c in zip(docs, label):
        least[c].append(d)
    return sorted(((d, len(s), min((x for x in least[c] if x is not None), default=None)) for (d, _), s, c in zip(docs, sets, label)), key=str)


def near_copies(seed, bases=12, copies=14):
    """Texts of many sizes with copies that differ in a few words, so that similarities lie about 0.9, also in chains."""
    random = np.random.default_rng(seed)
    out = []
    for size in [8, 11, 12, 14, 21, 40, 60, 90, 150, 300, 500, 700][:bases]:
        words = [f"w{x}" for x in random.integers(0, 5000, size)]
        for _ in range(copies):
            out.append(" ".join(words))
            for _ in range(int(random.integers(1, 2 + size // 60))):
                k = int(random.integers(0, len(words)))
                words = random.choice(["swap", "drop", "add"]) == "drop" and words[:k] + words[k + 1 :] or [*words[:k], f"n{random.integers(0, 10**6)}", *words[k + int(random.integers(0, 2)) :]]
    return out


@pytest.mark.parametrize("block", [4096, 8])
def test_classes_of_near_copies(spark, block):
    texts = near_copies(1)
    order = np.random.default_rng(2).permutation(len(texts)).tolist()
    docs = [(k, texts[i]) for k, i in enumerate(order)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in rtree.classes(df, block=block).collect()), key=str)
    assert got == classes_slow(docs)
    assert len({c for *_, c in got}) < len(docs) * 0.9


def test_classes_odd_rows(spark):
    base = " ".join(f"word{k}" for k in range(60))
    docs = [(5, base), (3, base.upper()), (3, base + " more"), (5, base), (7, None), (2, ""), (8, " \t\n"), (9, "one two"), (1, "ONE  two"), (None, base), (None, "alone here"), (None, "alone here"), (11, "x " * 100_000)]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, node long, bucket long")
    got = sorted((tuple(r) for r in rtree.classes(df).collect()), key=str)
    assert got == classes_slow(docs)
    assert rtree.classes(df.limit(0)).count() == 0


def test_linked_sets_share_a_bucket():
    random = np.random.default_rng(3)
    for n in [*range(8, 80), 200, 333, 1000, 2999]:
        a = random.integers(0, 2**63, n, dtype=np.uint64)
        for _ in range(20):
            out = int(random.integers(0, n // 9 + 1))
            b = np.concatenate([a[out:], random.integers(0, 2**63, max(0, n // 9 - out), dtype=np.uint64)])
            if 10 * len(np.intersect1d(a, b)) >= 9 * len(np.union1d(a, b)) and len(np.setxor1d(a, b)):
                assert len(np.intersect1d(rtree.buckets(np.sort(a), 90), rtree.buckets(np.sort(b), 90)))


def test_forest_keeps_all_pairs_that_the_bound_leaves():
    random = np.random.default_rng(4)
    tree = np.sort(random.integers(0, 4, 700))
    centre = random.integers(0, 9, (20, rtree.GROUPS))
    point = np.clip(centre[random.integers(0, 20, 700)] + random.integers(-1, 2, (700, rtree.GROUPS)) * (random.random((700, rtree.GROUPS)) < 0.2), 0, None).astype(np.int32)
    n, root = point.sum(axis=1).astype(np.int64), random.integers(0, 200, 700)
    got = set()
    for a, b in rtree.Forest(tree, point, n, root).pairs(90, chunk=100):
        got |= {tuple(sorted(p)) for p in zip(a.tolist(), b.tolist())}
    want = {
        (i, j) for i, j in combinations(range(700), 2)
        if tree[i] == tree[j] and root[i] != root[j] and 90 * max(n[i], n[j]) <= 100 * min(n[i], n[j]) and 190 * np.minimum(point[i], point[j]).sum() >= 90 * (n[i] + n[j])
    }
    assert got == want and len(got) > 1000


# --- divergence ---


def divergence_slow(docs, least_docs, top=10):
    count, docs_of, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in docs:
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups.add((lang or "", source or ""))
        count[lang or "", source or ""].update(terms)
        docs_of[lang or ""].update(set(terms))
    out = []
    for lang in {g for g, _ in groups}:
        kept = [t for t, n in docs_of[lang].items() if n >= least_docs]
        sources = [s for g, s in groups if g == lang]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        p = {s: share(count[lang, s]) for s in sources}
        q = share(sum((count[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(x, sum(f(p[s][t], p[x][t]) for t in kept)) for x in sources if x != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0].encode()))[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("heavy,tile,chunk", [(8, 128, 512), (2, 3, 4), (0, 2, 1000), (100, 5, 1)])
def test_divergence_splits_agree(spark, heavy, tile, chunk):
    random = np.random.default_rng(5)
    docs = []
    for k in range(160):
        words = [f"{'မéxyz'[int(w) % 5]}T{chr(97 + int(w) % 26)}{chr(97 + int(w) // 26)}" for w in random.zipf(1.3, int(random.integers(0, 40))).clip(0, 600)]
        docs.append(("-".join(words), ["en", "de", None][k % 3 if k < 150 else 0], None if k % 11 == 0 else f"s{int(random.zipf(1.5)) % 12}"))
    docs += [(None, "fr", "only"), ("", "xx", "a"), ("rare", "xx", "b"), ("rare", "xx", "b"), ("Rare " * 30_000, "xx", None)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "text string, lang string, source string, term int").repartition(4)
    got = sorted(tuple(r) for r in divergence.audit(df, least_docs=3, heavy=heavy, tile=tile, chunk=chunk).collect())
    assert got == divergence_slow(docs, 3)
    assert divergence.audit(df.limit(0)).count() == 0


def test_shares_of_large_counts_are_exact():
    n, total, kept = 10**14 + 7, 3 * 10**15 + 1, 12_345_678
    assert divergence.share(np.array([n]), np.array([total]), kept).tolist() == [1 + 10**9 * (n + 2) // (total + 2 * kept)]


def test_share_column_equals_share(spark):
    df = spark.createDataFrame([(10**14 + 7, 3 * 10**15 + 1, 12_345_678), (0, 0, 1), (5, 5, 3)], "n long, t long, k long")
    for n, t, k, x in df.select("*", divergence.share_column("n", "t", "k")).collect():
        assert x == divergence.share(np.array([n]), np.array([t]), k)[0]
