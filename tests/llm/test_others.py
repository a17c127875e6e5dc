"""Groups, neighbours, models, pages and conversations, against brute-force versions."""

import hashlib
import math
import random
import zlib
from collections import Counter
from html import unescape

import corpus_pipeline
import duckdb
import numpy as np
import xxhash
from pyspark.sql import functions as F

from wordloom.llm import chat, common, html, lbl, neighbours, pii, quality, queries, simhash, similar

SF = "/root/testdata/sf0.001"


def fingerprint_slow(text):
    w = "".join(c.lower() if c.isascii() else c for c in text).replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")
    w = [x for x in w if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in h) > len(h))


def groups_slow(prints):
    """Least id reachable over pairs of at most 3 differing bits."""
    ids = sorted(prints)
    label = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i in ids:
            for j in ids:
                if (prints[i] ^ prints[j]).bit_count() <= 3 and label[i] < label[j]:
                    label[j], changed = label[i], True
    return label


def test_simhash_groups(spark):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    prints = {d: fingerprint_slow(t) for d, t in docs.items()}
    label = groups_slow(prints)
    for r in queries.op9_simhash(spark, SF).collect():
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", label[r.doc_id])


def test_simhash_odd_rows(spark):
    base = " ".join(f"word{k}" for k in range(300))
    rows = [(3, base, 1), (1, base, 2), (9, base + " more", 3), (3, base, 1), (7, None, 4), (6, "", 5), (8, "one two", 6), (None, "one two", 7), (None, "solitary text of six words here", 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    out = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.groups(df).collect()]
    assert len(out) == len(rows) and {c for d, _, c in out if d in (1, 3)} == {1} and {c for d, _, c in out if d in (6, 7)} == {6}
    assert [f for d, f, _ in out if d == 6] == ["0" * 16]
    kept = simhash.deduplicated(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[1] == 1 and ids[3] == 0 and ids[6] == 1 and ids[7] == 0 and ids[8] == 1 and ids[None] == 1
    assert simhash.groups(df.limit(0)).count() == 0


def test_deduplicated_keeps_one_row_of_each_group(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(200))
    rows = [(None, text(k)) for k in range(6)] + [(None, text(0)), (4, text(1)), (9, text(7)), (9, text(8)), (9, text(8)), (2, text(8))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in simhash.deduplicated(df).collect())
    assert got == Counter([(None, text(k)) for k in (0, 2, 3, 4, 5)] + [(4, text(1)), (9, text(7)), (2, text(8))])


def near_copies_slow(docs, percent=80):
    """Least id reachable over pairs of texts whose five-word shingles are so similar."""
    sets = {d: set(zip(*(t.lower().split()[k:] for k in range(5)))) or {tuple(t.lower().split())} for d, t in docs.items()}
    label, sharing, pairs = {d: d for d in sets}, {}, set()
    for d in sorted(sets):
        for s in sets[d]:
            pairs.update((o, d) for o in sharing.get(s, ()))
            sharing.setdefault(s, []).append(d)
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    changed = True
    while changed:
        changed = False
        for a, b in links:
            if label[a] != label[b]:
                label[a] = label[b] = min(label[a], label[b])
                changed = True
    return label


def test_near_duplicates_stage_links_similar_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(3)
    base = [f"v{k}" for k in range(400)]
    own = {}
    for k in range(60):  # one group whose members change in 1 to 60 places, and words of their own
        t = list(base)
        for at in rng.sample(range(400), rng.choice((1, 3, 8, 12, 20, 60))):
            t[at] = f"other{rng.randint(0, 999)}"
        own[-1 - k] = " ".join(t)
    own |= {-100: "A b c", -101: "a  B c", -102: "a b d"}
    more = spark.createDataFrame(list(own.items()), "doc_id long, text string")
    df = docs.select("doc_id", "text").unionByName(more)
    texts = {r.doc_id: r.text or "" for r in docs.collect()} | own
    expected = {d for d, least in near_copies_slow(texts).items() if d == least}
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    odd = spark.createDataFrame([(None, "one two"), (None, "six"), (3, "six"), (3, "seven"), (5, None), (4, " ")], "doc_id long, text string")
    assert Counter((r.doc_id, r.text) for r in similar.deduplicated(odd).collect()) == Counter([(None, "one two"), (3, "six"), (3, "seven"), (4, " ")])


def brute_components(fp, bits=3):
    parent = list(range(len(fp)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in zip(*np.nonzero(np.bitwise_count(fp[:, None] ^ fp[None, :]) <= bits)):
        i, j = find(i), find(j)
        parent[max(i, j)] = min(i, j)
    return [find(i) for i in range(len(fp))]


def test_anchor_covering_loses_no_link(spark):
    rng = np.random.default_rng(0)
    near = []
    for b in rng.integers(0, 2**63, 60, dtype=np.uint64):
        near.append(int(b))
        for _ in range(12):
            y = near[-1]
            for k in rng.choice(64, rng.integers(1, 4), replace=False):
                y ^= 1 << int(k)
            near.append(y)
    crowd = [near[0] ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(a)]  # one dense group, more than a block of an anchor
    fp = np.array(sorted({*near, *crowd, 0}), np.uint64)
    expected = brute_components(fp)
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    root = {r.node: r.root for r in simhash.components(simhash.links(df)).collect()}
    got = [root.get(int(x), int(x)) for x in fp.view(np.int64)]
    assert len(set(zip(expected, got))) == len(set(expected)) == len(set(got))


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(0, 0.3, (900, 12)), 1)
    x[100:140] = x[0]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    bad = [(1000, None), (1001, []), (1002, [None] * 12), (1100, [float("nan")] * 12), (1200, [float("inf")] * 12), (1300, [1.0, 2.0]), (None, rows[5][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    v = np.floor(1024 * x.astype(np.float32).astype(np.float64)).astype(np.int64)
    expected = set()
    for q in range(0, 900, 100):
        s = v @ v[q]
        best = sorted((-int(s[c]), c) for c in range(900) if c != q)[:10]
        expected |= {(q, k + 1, c, -t) for k, (t, c) in enumerate(best)}
    for size in (neighbours.SHARD, 130):
        out = {(r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.top_k(df, shard_rows=size).collect()}
        assert out == expected
    assert neighbours.top_k(df.limit(0)).count() == 0
    few = {(r.query_id, r.vec_id) for r in neighbours.top_k(df.filter("vec_id in (0, 3)")).collect()}
    assert few == {(0, 3)}


def test_lbl_base_scores_and_gain(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {d: zlib.crc32(str(d).encode()) % 5 == 1 for d in docs}
    got = {d: t.encode().lower().split() + [b""] for d, t in docs.items()}
    c = Counter(w for d, t in got.items() if not held[d] for w in t)
    n, v = sum(c.values()), len(c)
    small = lbl.Settings(known=2000)  # so that the join counts most of the words
    for settings in (lbl.Settings(), small):
        rows = lbl.scores(spark.read.parquet(f"{sf}/documents.parquet"), settings=settings).collect()
        assert len(rows) == len(docs)
        for r in rows:
            t = got[r.doc_id]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r.doc_id], len(t), sum(c[w] > 0 for w in t), n)
            base = sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
            assert abs(r.base_score - base) < 1e-6 * max(1, abs(base))
        assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


def test_lbl_is_normalized():
    s = lbl.Settings(words=6, classes=4, size=5)
    m = lbl.Model(np.arange(11, dtype=float), s)
    a, b = np.repeat(np.arange(11), 11), np.tile(np.arange(11), 11)
    total = sum(np.exp(m.log_probability([a, b], np.full(121, t))) for t in range(11))
    assert np.allclose(total, 1, atol=1e-5)


def test_lbl_learns_contexts():
    s = lbl.Settings(size=12, batch=256)
    rng = np.random.default_rng(1)
    one = rng.integers(0, 8, 40000)
    target = (one + 1) % 8
    two = rng.integers(0, 8, 40000)
    m = lbl.Model(np.bincount(target, minlength=8).astype(float), s)
    before = m.log_probability([two, one], target).mean()
    trainer = lbl.Trainer(m, s, 1)
    for _ in range(300):
        trainer.learn([two, one], target)
    assert m.log_probability([two, one], target).mean() > before + 1


def test_lbl_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "A b", "x"), (4, "a B c", "x"), (4, "a B c", "x")], "doc_id long, text string, held_out string")
    rows = lbl.scores(df).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 3, 4, 4] and all(np.isfinite(r.score) for r in rows)
    assert lbl.scores(df.limit(0)).count() == 0


PAGES = {
    "": "", "   ": "", "no tags at all": "no tags at all",
    "<html><body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One  <b>two</b>\nthree.<p>Four&nbsp;five<br>six.</article><footer>f</footer></body></html>": "T & U\n\nOne two three.\n\nFour\xa0five six.",
    "<body><div class='sidebar'><p>Side text that is not part of it.</p></div><div id=main-content><h2>Head</h2><p>First paragraph, long enough to count for more.</p><p>Second paragraph, also long enough to count.</p></div>"
    "<div class=comments><p>A reader says something quite long here, longer than all paragraphs together, and then some more of it.</p></div><form>Search <input></form></body>": "Head\n\nFirst paragraph, long enough to count for more.\n\nSecond paragraph, also long enough to count.",
    "<body><script>if (a < b) { document.write('<p>no</p>') }</script><style>p{}</style><p>Only this.</p><!-- <p>not this</p> --></body>": "Only this.",
}


def test_main_text(spark):
    for page, text in PAGES.items():
        assert html.extract(page) == text
    assert html.extract("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"
    df = spark.createDataFrame([(k, None, h, 1) for k, h in enumerate([*PAGES, None])], "page_id long, url string, html string, text int")
    rows = {r.page_id: r for r in html.main_text(df).collect()}
    for k, text in enumerate([*PAGES.values(), ""]):
        assert rows[k].text == text and rows[k].n_chars == len(text) and rows[k].url is None
    assert html.main_text(df.limit(0)).count() == 0


def test_main_text_of_tables(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in queries.op4_html_text(spark, SF).collect():
        assert r.n_chars > 0 and r.n_chars == len(r.text) and "track(" not in r.text and "middot" not in r.text and "&copy" not in r.text
        assert "<h1>" + html_escape(r.text.split("\n\n")[0])[:20] in pages[r.page_id]


def html_escape(text):
    return text.replace("&", "&amp;").replace('"', "&quot;")


def conversations_slow(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((t, role or "", text or "") for c, t, role, text in rows if c == conv)
        learnt = "".join(x for _, role, x in turns if role == "assistant")
        digest = hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in turns).encode()).hexdigest()
        out[conv] = (len(turns), digest, len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    slow = conversations_slow(rows + [(-1, 0, "user", queries.HOSTILE), (-1, 1, "assistant", queries.HOSTILE)])
    got = {r.conv_id: r for r in queries.op8_chat_windows(spark, "/root/testdata/sf0.01").collect()}
    assert set(got) == set(slow)
    for c, r in got.items():
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == slow[c] and r.formatted_chars > r.loss_chars


def test_chat_windows(spark):
    rng, pieces = random.Random(6), ["\\", "<|", "<\\|", "|>", "<|im_end|>\n", "word ", "\n", "é😀", "\\|", "<|nl|>", "a b c d "]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 14)):
            role = "system" if turn == 0 and conv % 2 else rng.choice(["user", "assistant", "to\nol", "<|x", None])
            rows.append((conv, turn, role, rng.choice([None, "", "".join(rng.choice(pieces) for _ in range(rng.randint(0, 90)))]), "clash"))
    rows += [(None, 1, "user", "x", "clash"), (70, None, "assistant", "first", "clash"), (70, 1, "user", "x", "clash"), (70, 1, "user", "x", "clash")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window string")
    budget = chat.Budget(60, 20, 4)
    windows = chat.windows(df, budget)
    listed = sorted(windows.collect(), key=lambda r: (r.conv_id or -5, r.window))
    assert all(w.tokens <= budget.window or w.formatted.count(chat.END) - w.repeated == 1 for w in listed)
    assert any(w.repeated > 1 for w in listed) and any(w.window > 1 for w in listed)
    back = {r.conv_id: r for r in chat.read_back(windows).collect()}
    for conv in {r[0] for r in rows}:
        turns = sorted(((t if t is not None else -1), role or "", text or "") for c, t, role, text, _ in rows if c == conv)
        assert [(t.role, t.text) for t in back[conv].turns] == [(role, x) for _, role, x in turns]
        assert list(back[conv].learnt) == [x for _, role, x in turns if role == "assistant"]
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r.doc_id for r in queries.op2_quality_rules(spark, SF).filter("kept").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id in kept}
    expected = {d for d, c in near_copies_slow(texts).items() if d == c}
    assert {r.doc_id for r in out} == expected
    assert len(corpus_pipeline.STAGES) == 4
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_oracle_sql_gives_the_same_rows(spark):
    for name, sql in queries.ORACLE_SQL.items():
        db = duckdb.connect()
        for t in ("embeddings", "conversations", "documents", "labels"):
            db.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        df = queries.QUERIES[name](spark, SF)
        columns = sorted(df.columns)
        ours = Counter(tuple(r[c] for c in columns) for r in df.collect())
        assert ours == Counter(db.execute(f"select {', '.join(columns)} from ({sql})").fetchall()), name


def test_stages_keep_columns_whose_names_could_clash(spark):
    text = " ".join(f"w{k}" for k in range(60)) + " a@b.org"
    names = ["_id", "_h", "_spans", "_nth", "row", "h", "h1", "h2", "sid", "sh", "spans", "node", "fp", "bucket", "bands"]
    row = dict.fromkeys(names, 5) | {"doc_id": 1, "text": text}
    df = spark.createDataFrame([row, row | {"_h": None, "doc_id": 2}], ", ".join(f"{n} {'string' if n == 'text' else 'long'}" for n in row))
    out = pii.sanitised(df)
    assert out.columns == df.columns and sorted(r["_h"] or 0 for r in out.collect()) == [0, 5] and all("a@b" not in r.text for r in out.collect())
    for kept in (simhash.deduplicated(df), similar.deduplicated(df), quality.assess(df, keep=True)):
        assert kept.columns == df.columns and all(r["_nth"] == 5 for r in kept.collect())
    assert [r.doc_id for r in similar.deduplicated(df).collect()] == [1]


def test_pipeline_stages_take_nulls_and_empty_tables(spark):
    long_ = " ".join(f"word{k * k % 997}" for k in range(400))
    df = spark.createDataFrame([(None, None, None), (1, "", "x"), (2, long_, None), (2, long_, None), (None, long_ + " tail end", "y")], "doc_id long, text string, source string")
    for docs in (df, df.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, "")
            assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), df.schema)
        assert corpus_pipeline.pack_sequences(spark, docs, "").count() == docs.count()


def test_rows_with_maps_and_buckets_of_many_blocks(spark):
    """Rows whose columns hold maps are told apart; buckets dealt to tasks in blocks link what one block would."""
    rng = np.random.default_rng(6)
    base = [f"w{k}" for k in rng.integers(0, 4000, 120)]
    texts = []
    for k in range(60):
        w = list(base if k % 2 else base[:60] + [f"x{j}" for j in range(60)])
        for _ in range(int(rng.integers(0, 9))):
            w[int(rng.integers(0, len(w)))] = f"n{rng.integers(0, 10**6)}"
        texts.append(" ".join(w))
    df = spark.createDataFrame([(k, t, {"a": k % 3}) for k, t in enumerate(texts)], "doc_id long, text string, tags map<string, int>")
    kept = [sorted(r.doc_id for r in similar.deduplicated(df, size=size).collect()) for size in (4096, 8)]
    assert kept[0] == kept[1] and 1 < len(kept[0]) < 60
    same = spark.createDataFrame([(1, base, {"a": 1}), (1, base, {"a": 1}), (2, base, None)], "doc_id long, words array<string>, tags map<string, int>").select("doc_id", F.array_join("words", " ").alias("text"), "tags")
    for out in (similar.deduplicated(same), simhash.deduplicated(same)):
        assert out.columns == same.columns and [(r.doc_id, r.tags) for r in out.collect()] == [(1, {"a": 1})]


def test_running_sums_in_blocks(spark):
    for n in (0, 1, 127, 128, 129, 1000):
        got = spark.range(1).select(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: x % 7).alias("v") if n else F.expr("cast(array() as array<int>)").alias("v")).select("v", common.running(F.col("v")).alias("s")).first()
        assert list(got.s) == np.cumsum(got.v).tolist()


def test_terms_at_the_edges_and_of_any_length(spark):
    rows = [(k, f"Zorblatt zz@ex.org was seen {k}") for k in range(5)] + [(9, "mail Xy qq@blatt.org"), (10, "was seen mail and more"), (11, "mail was more")]
    rows += [(100 + k, f"mail was seen {k}") for k in range(3000)]
    got = {r.doc_id: r.text for r in pii.sanitised(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Zorblatt" not in got[k] and "zz@" not in got[k] for k in range(5)) and "Xy" not in got[9] and got[11] == "mail was more"


def densest_slow(html_text):
    """The tag path of the core by its definition: densities node by node from their subtrees, without sums that are kept."""
    page = html.Page(html_text)
    n, tag, parent = len(page.tag), page.tag, page.parent
    out = [False] * n
    for k in range(1, n):
        words, role, hidden = html.marks(page.attrs[k])
        within = any(tag[a] in ("article", "main") for a in ancestors(parent, k))
        bad = tag[k] in html.DROPPED or tag[k] == "header" and not within or hidden or role in html.ROLES or bool(words & html.ASIDE)
        out[k] = out[parent[k]] or bad
    under = lambda k: [j for j in range(n) if not out[j] and (j == k or k in ancestors(parent, j))]
    size = lambda nodes, links: sum(len(unescape(t).strip()) for k, t in page.runs if k in nodes and (not links or any(tag[a] == "a" for a in (k, *ancestors(parent, k)))))
    body = tag.index("body") if "body" in tag else 0
    whole = set(under(body))
    share = size(whole, True) / max(size(whole, False), 1)

    def density(k):
        nodes = set(under(k))
        c, lc = size(nodes, False), size(nodes, True) or 1
        t, lt = len(nodes) - 1 or 1, sum(tag[j] == "a" for j in nodes if j != k) or 1
        if not c:
            return 0.0
        return c / t * math.log(max(c / lc * t / lt, 1.0)) / max(math.log(math.log(c * lc / max(c - lc, 1) + share * c + math.e)), 0.1)

    dense = [0.0 if out[k] else density(k) for k in range(n)]
    kids = lambda k: [j for j in range(1, n) if parent[j] == k and not out[j]]
    may = [k for k in range(body, n) if not out[k] and tag[k] not in html.PARAGRAPHS and any(tag[j] in html.BLOCK for j in kids(k))]
    core = max(may, key=lambda k: (round(sum(dense[j] for j in kids(k)), 9), k), default=body)
    path = [core, *(a for a in ancestors(parent, core) if a >= body)] if core != body else [core]
    threshold = min(dense[k] for k in path)
    textual = lambda k: any(tag[j] in html.TEXTUAL for j in under(k))
    near = [k for k in range(1, n) if not out[k] and parent[k] in path and k not in path and dense[k] >= threshold and textual(k) and 3 * size(set(under(k)), True) < size(set(under(k)), False)]
    beside = [k for k in kids(body) if core == body and dense[k] < threshold and 2 * size(set(under(k)), True) > size(set(under(k)), False)]
    taken = set().union(*(under(k) for k in (core, *near))).difference(*(under(k) for k in beside))
    blocks, line = [], ""
    for k, t in [*page.runs, (0, "")]:
        if not t:
            blocks.append(" ".join(line.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\f", " ").split(" ")))
            line = ""
        elif k in taken:
            line += unescape(t)
    return [" ".join(x for x in b.split(" ") if x) for b in blocks if b.strip(" ")]


def ancestors(parent, k):
    found = []
    while k:
        k = parent[k]
        found.append(k)
    return found


def test_main_text_is_the_densest_part(spark):
    for r in spark.read.parquet(f"{SF}/pages.parquet").orderBy("page_id").limit(25).collect():
        assert html.extract(r.html or "") == "\n\n".join(densest_slow(r.html or "")), r.page_id


def test_main_text_of_labelled_pages():
    """Precision and recall of blocks against what a reader marks as the article, on pages without <article>."""
    side = "<ul class='menu'><li><a href=1>Home</a></li><li><a href=2>News</a></li><li><a href=3>Contact us</a></li></ul>"
    text = [f"Paragraph {k} of the story tells at some length what happened on the {k}th day and why it mattered to them all." for k in range(6)]
    shapes = [
        lambda ps: f"<body>{side}<div id=x><div><h1>Title of it</h1>{ps}</div></div><div>{side}</div></body>",
        lambda ps: f"<body><table><tr><td>{side}<td><h1>Title of it</h1>{ps}</table></body>",
        lambda ps: f"<body><main><div class=comments><p>first! so good this story is, I read it twice</p></div><h1>Title of it</h1>{ps}<div class=ad><p>Buy now and save a lot of money today</p></div></main></body>",
        lambda ps: f"<body><h1>Title of it</h1>{ps}<div>{side}{side}</div></body>",
    ]
    found = wanted = right = 0
    for shape in shapes:
        got = html.extract(shape("".join(f"<p>{t} See <a href=9>more</a>.</p>" for t in text))).split("\n\n")
        gold = ["Title of it", *(f"{t} See more." for t in text)]
        found, wanted, right = found + len(got), wanted + len(gold), right + len(set(got) & set(gold))
    assert right / found >= 0.95 and right / wanted >= 0.95
