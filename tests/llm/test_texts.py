"""Operators that read texts, against brute-force versions and exact round trips."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from wordloom.llm import blocks, bpe, packing, pii, quality, queries
from wordloom.llm.tokens import WordTokenizer

SF = "/root/testdata/sf0.001"
ODD = [
    None, "", " ", "\n", "a", "The cat, sat.  On\n\nthe mat!\t12 34", "x" * 3000, "é" * 500 + " 中文 नमस्ते 😀", "a  b\n c d　e\x1cf",
    "it's we'll I'M don't", "<|endoftext|> <|im_end|>", "word " * 4000, "\x00\x7f ~~~", "tail space ", " lead",
]


def odd_docs(spark):
    """Nulls, empty and long texts, repeated rows, and extra columns whose names clash with the operators' own."""
    rows = [(k, t, "n", 7) for k, t in enumerate(ODD)] + [(5, ODD[5], "n", 7), (None, "no id here", "n", 7)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, kept int")


def plain(spark, sf=SF):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def tik():
    ranks = bpe.Vocabulary.read(queries.BYTE_RANKS)
    return ranks, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.ranks, special_tokens={})


def test_byte_bpe_is_the_librarys(spark):
    _, enc = tik()
    docs = plain(spark)
    for r in queries.op1_byte_bpe(spark, SF).collect():
        ids = enc.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
    out = bpe.decode(bpe.encode(odd_docs(spark), queries.BYTE_RANKS, public_tokenizers.PATTERN), queries.BYTE_RANKS).collect()
    assert len(out) == len(ODD) + 2
    for r in out:
        text = "no id here" if r.doc_id is None else ODD[r.doc_id] or ""
        assert list(r.ids) == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()


def test_prefixes_append_and_edit():
    vocabulary, enc = tik()
    rng = random.Random(3)
    for _ in range(60):
        word = "".join(rng.choice("aeinrstéß") for _ in range(rng.randint(1, 60))).encode()
        p = bpe.Prefixes(vocabulary)
        for i in range(0, len(word), 7):
            p.append(word[i : i + 7])
        assert p.ids() == bpe.Prefixes(vocabulary, word).ids()
        a = rng.randint(0, len(word))
        b = rng.randint(a, len(word))
        p.edit(a, b, b"ing")
        new = word[:a] + b"ing" + word[b:]
        assert bytes(p.data) == new and p.ids() == bpe.Prefixes(vocabulary, new).ids()
        merged = bpe.merged(new, vocabulary.ranks)
        assert [vocabulary.ranks[m] for m in merged] == p.ids()


def counts_slow(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    inside = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_quality_counts_and_bands(spark):
    docs = plain(spark, "/root/testdata/sf0.01")
    rows = queries.op2_quality_rules(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        slow = counts_slow(docs[r.doc_id])
        assert tuple(r[c] for c in quality.COUNTS) == slow
        assert r.base_failed == (slow[0] < 20 or 100 * slow[4] > 30 * slow[0])
        assert not (r.base_failed and r.kept)
    good = {r.doc_id for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1").collect()}
    assert all(r.kept for r in rows if r.doc_id in good and not r.base_failed)
    out = quality.assess(odd_docs(spark))
    assert out.count() == len(ODD) + 2 and out.filter("doc_id = 0 and n_words = 0 and base_failed and not kept").count() == 1
    kept = quality.assess(odd_docs(spark), keep=True)
    assert kept.columns == ["doc_id", "text", "ids", "kept"] and kept.count() == out.filter("kept").count()
    noise = "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/ ") for _ in range(9000))
    assert not quality.Press(quality.Bands()).judge(noise.encode())[2]
    assert not quality.Press(quality.Bands()).judge(b"all work and no play, " * 300)[2]


def spans_slow(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end(), "email"))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end(), "ip"))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        s = sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and s % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end(), "phone"))
    return sorted(out)


def test_pii_base_spans(spark):
    docs = plain(spark, "/root/testdata/sf0.01")
    rows = queries.op3_pii(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs) and sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows) > 20
    for r in rows:
        slow = spans_slow(docs[r.doc_id])
        base = ",".join(f"{k}:{a}:{b}" for a, _, b, k in slow)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in slow) for k in range(4)]
        assert set(filter(None, base.split(","))) <= set(r.spans.split(","))


def test_pii_hard_texts(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("a@.1 -+(2é😀%4") for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += ["4111 1111 1111 1111 x +1 (234) 567-8901 y 1.2.3.4.5.6.7.8 a@b.c.d@e.f a@b.c+d@e.f", "1" * 40000, "a." * 20000 + "@", "12-" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [(s.start, s.ord, s.end, s.kind) for s in r.spans if s.ord < 4] == spans_slow(texts[r.doc_id])


def test_pii_disclosing_terms(spark):
    told = [f"Unrelated {w} opening number {k}, then Zorblatt writes from zor@blatt.example.org as he often does {w}." for k, w in enumerate(["red", "blue", "green", "grey", "pink"])]
    rest = [f"Plain text number {k} he often does and then writes opening from as" for k in range(60)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(told + rest)] + [(99, None), (100, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.find(df).collect()}
    for k, t in enumerate(told):
        found = {(t[s.start : s.end], s.kind) for s in out[k].spans}
        assert ("zor@blatt.example.org", "email") in found and ("Zorblatt", "general") in found
        assert not {w for w, _ in found} & {"writes", "often", "from"}
    assert not out[70 - 10].spans and not out[99].spans and not out[100].spans
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert "Zorblatt" not in clean[0] and "[EMAIL]" in clean[0] and clean[99] is None and clean[10] == (told + rest)[10]
    copies = spark.createDataFrame([(k, told[0]) for k in range(9)], "doc_id long, text string")
    assert all(s.ord < 4 for r in pii.find(copies).collect() for s in r.spans)
    assert pii.find(df.limit(0)).count() == 0


def test_pii_terms_of_whole_texts(spark):
    """A name far from the entity counts if two texts hold both; one beside it counts at once; a rare word of one text does not."""
    pad = "plain words that every text holds " * 20
    told = [f"Quillfeather came. {pad} Then mail to lone@one.example.org {pad} said quillfeather oncein{k}" for k in ("a", "b")] + ["Both " + pad + " Brannoc x@y.example.org " + pad + " farword"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(told)] + [(10 + k, f"{pad} both came then mail said and to number {k}") for k in range(3000)], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in pii.find(df).collect()}
    cut = lambda k: [(told[k][s.start : s.end], s.kind) for s in spans[k] if s.ord > 3]
    assert cut(0) == cut(1) == [("Quillfeather", "general"), ("quillfeather", "general")] and cut(2) == [("Brannoc", "general")]
    assert not any(spans[10 + k] for k in range(3000))
    clean = {r.doc_id: r.text for r in pii.sanitised(df).collect()}
    assert clean[0].startswith("[NAME] came.") and clean[1].endswith("said [WORD] onceinb") and "[NAME] [EMAIL]" in clean[2]


def disclosed_slow(docs, settings):
    """(doc, term, kind) by the definition: every pair of an entity and a word, counted one text after another."""
    base = {d: spans_slow(t or "") for d, t in docs}
    own = lambda t: Counter(re.findall(r"(?<![^\W_])[^\W\d_]+(?![0-9])", t.lower()))
    entity = lambda d, s: (s[3], docs_text[d][s[0] : s[2]].lower())
    docs_text = {d: t or "" for d, t in docs}
    holds, beside, words, out = {}, {}, Counter(), set()
    for d, t in docs_text.items():
        words.update(set(re.split(r"[\W\d_]+", t.lower())))
        for s in base[d]:
            holds.setdefault(entity(d, s), set()).add(d)
            for m in re.finditer(r"[^\W_]+", t):
                if m[0].isalpha() and (s[0] - settings.window <= m.start() and m.end() <= s[0] or s[2] <= m.start() and m.end() <= s[2] + settings.window):
                    beside.setdefault((entity(d, s), m[0].lower()), set()).add(d)
    n = len(docs_text)
    for e, where in holds.items():
        ic = math.log2(n / len(where))
        for w in set().union(*(own(docs_text[d]) for d in where)):
            near = beside.get((e, w), set())
            both = {d for d in where if w in own(docs_text[d])}
            both = both if len({docs_text[d] for d in where}) >= settings.support else near
            if not both or not near and len({docs_text[d] for d in both}) < settings.support or not ic:
                continue
            p, of, z = len(both) / words[w], words[w], settings.z
            low = (p + z * z / (2 * of) - z * math.sqrt(p * (1 - p) / of + z * z / (4 * of * of))) / (1 + z * z / of)
            share = math.log2(low * n / len(where)) / ic
            if share >= settings.generalise and words[w] <= n ** (1 - settings.generalise) * len(where) ** settings.generalise * (1 + 1e-9):
                out |= {(d, w, "removed" if share >= settings.remove else "general") for d in both}
    best = {}
    for d, w, kind in out:
        best[d, w] = max(kind, best.get((d, w), ""))  # removed is more than general
    return {(d, w, k) for (d, w), k in best.items()}


def test_pii_disclosure_equals_brute_force(spark):
    rng = random.Random(11)
    common, names = [f"word{c}{d}" for c in "abcdefgh" for d in "klmnop"], ["Zorblatt", "Ullen", "Brannoc", "Peverel", "Okt"]
    docs = []
    for k in range(400):
        w = [rng.choice(common) for _ in range(rng.randint(5, 60))] + [f"rare{''.join(rng.choices('abcd', k=4))}" for _ in range(3)]
        if k % 4 == 0:
            name = rng.choice(names)
            at = rng.randint(0, len(w))
            w[at:at] = [name, f"{name.lower()}@mail.example.org"]
            w.insert(rng.randint(0, len(w)), rng.choice(names) if rng.random() < 0.3 else name)
        docs.append((k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for settings in (pii.Disclosure(), pii.Disclosure(z=0.5, remove=0.9), pii.Disclosure(window=15, generalise=0.6)):
        got = {(r.doc_id, docs[r.doc_id][1][s.start : s.end].lower(), s.kind) for r in pii.find(df, settings=settings).collect() for s in r.spans if s.ord > 3}
        assert got == disclosed_slow(docs, settings) and got


def word_ids(text, library=[]):
    if not library:
        library.append(Tokenizer.from_file(queries.WORD_BPE))
    return library[0].encode(text, add_special_tokens=False).ids


def test_word_tokenizer_is_the_librarys():
    own, rng = WordTokenizer(queries.WORD_BPE), random.Random(2)
    alphabet = "  \n\t'stre aAéÉßİΣ.,!?12٣中文　\xa0‍\x1c\x85😀 ́가각"
    special = ["hello <|endoftext|> world", "<|ENDOFTEXT|> x", "a<|endoftext|><|startoftext|>", "<|startoftext|>", "été über naïve ÿ ß÷ñ"]
    texts = ["", *(t for t in ODD if t), *special, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500))]
    for k in range(0, len(texts), 97):
        part = texts[k : k + 97]
        flat, lengths = own.encode_all(pa.array(part), np.array([2], "<u4").tobytes())
        for text, ids in zip(part, np.split(flat, np.cumsum(lengths)[:-1])):
            assert ids.tolist() == [*word_ids(text), 2]


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n, top in ((0, 9), (1, 9), (127, 49000), (128, 1), (5000, 300), (4000, 2**32)):
        ids = rng.integers(0, top, n, dtype=np.uint32)
        ids[: n // 50] = top - 1
        cut = np.sort(rng.integers(0, n + 1, 5))
        docs = np.split(ids, cut)
        s = blocks.Segment(blocks.encode_segment(list(range(6)), docs))
        assert np.array_equal(s.all(), ids)
        assert all(np.array_equal(s.document(k), d) for k, d in enumerate(docs))


def test_token_blocks_query(spark):
    docs, start = plain(spark), 0
    rows = {r.doc_id: r for r in queries.op7_token_blocks(spark, SF).collect()}
    for d in sorted(docs):
        ids = np.array([*word_ids(docs[d]), 2], "<u4")
        assert (rows[d].start, rows[d].n_tokens, rows[d].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    seg = blocks.write_segments(odd_docs(spark), queries.WORD_BPE)
    assert blocks.read_documents(seg).count() == len(ODD) + 2
    assert blocks.read_documents(blocks.write_segments(odd_docs(spark).limit(0), queries.WORD_BPE)).count() == 0


def test_token_blocks_of_odd_ids(spark):
    """Null ids stay null and come first; rows of one id always stand in the same order; ids that are no numbers count as null."""
    rows = [(None, "some text"), (None, None), *((3, f"text {k} of one id") for k in range(30)), (2, "x")]
    seen = set()
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = blocks.read_documents(blocks.write_segments(df, queries.WORD_BPE)).collect()
        seen.add(tuple(sorted((r.start, r.n_tokens, r.ids_crc32, str(r.doc_id)) for r in got)))
        assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows) and max(r.start for r in got if r.doc_id is None) < min(r.start for r in got if r.doc_id == 2)
    assert len(seen) == 1
    named = spark.createDataFrame([("12", "a"), ("x1", "b"), (None, "c")], "doc_id string, text string")
    assert Counter(r.doc_id for r in blocks.read_documents(blocks.write_segments(named, queries.WORD_BPE)).collect()) == Counter([12, None, None])


def test_packing_covers_every_id_once(spark):
    for docs, df in ((plain(spark), spark.read.parquet(f"{SF}/documents.parquet")), (dict(enumerate(t or "" for t in ODD)), odd_docs(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]))):
        rows = packing.pack(df, queries.WORD_BPE).collect()
        by_doc, by_seq = defaultdict(list), defaultdict(list)
        for r in rows:
            by_doc[r.doc_id].append(r)
            by_seq[r.sequence_id].append(r)
        assert set(by_doc) == set(docs)
        for d, pieces in by_doc.items():
            pieces.sort(key=lambda r: r.start)
            ids = np.array([*word_ids(docs[d]), 2], "<u4").tobytes()
            assert b"".join(r.ids for r in pieces) == ids and all(r.doc_tokens == len(ids) // 4 for r in pieces)
            assert [r.start for r in pieces] == np.cumsum([0, *(r.length for r in pieces)]).tolist()[:-1]
        for pieces in by_seq.values():
            pieces.sort(key=lambda r: r.offset)
            assert [r.offset for r in pieces] == np.cumsum([0, *(r.length for r in pieces)]).tolist()[:-1]
            assert sum(r.length for r in pieces) <= 4096
    assert packing.pack(odd_docs(spark).limit(0), queries.WORD_BPE).count() == 0


def test_packing_cuts_are_the_cheapest():
    filled = lambda n: min(20 - n, 2) if n.bit_count() == 1 else 20 - n
    rng = random.Random(4)
    for _ in range(200):
        places = np.array(sorted(rng.sample(range(1, 60), rng.randint(4, 12)) + [60, 12, 24, 36, 48]))
        places = np.unique(places)
        costs, window = np.array([rng.choice([0, 1, 3, 9]) for _ in places]), 20
        best = {0: 0}
        for p, c in zip(places.tolist(), costs.tolist()):
            best[p] = min(best[q] + filled(p - q) for q in best if p - q <= window) + c
        cuts = packing.choose(places, costs, window, 2).tolist()
        cost = dict(zip(places.tolist(), costs.tolist()))
        assert cuts[-1] == 60 and sum(filled(b - a) + cost[b] for a, b in zip([0, *cuts], cuts)) == best[60]


@pytest.mark.parametrize("n", [3, 40])
def test_repeated_words(n):
    words = [b"a", b"b", b"c", b"d"] * n
    assert quality.repeated_words(words, 8) == counts_slow(" ".join("abcd" * n))[4]
