"""More registered queries: segmentation and its traces, search, trees, treebank conversion, boundaries, labels and script text.

Each query stands beside the SQL that gives the same rows, where SQL can say it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wordloom.functions import clean, tags
from wordloom.functions import text as tx
from wordloom.functions.profile import LATIN, MYANMAR
from wordloom.operators import boundary, corpus, graph, lexicon, lm, pipeline, repair, search, segment, tagging
from wordloom.operators import trees as tours
from wordloom.plans.oracle import BCOST, BENCH, LAYERS, NAMES, PWORDS, TREES, UCOST, VOC, WORD, tok
from wordloom.plans.queries import bench_arrays, doc_pairs, doc_tokens, doc_words, layers, misspelt, part_names, part_texts, part_words, r6, table, tagged, trees, vocabulary
from wordloom.functions.romanize import romanized

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


#: Latin letters as Myanmar ones: vowels as signs, y as the vowel killer, h as a medial, the others as consonants.
FROM, TO = "abcdefghijklmnopqrstuvwxyz.,0123456789", "ာဘစဒေဖဂှိဇကလမနုပခရသတူဝွဿ်ဇ။၊၀၁၂၃၄၅၆၇၈၉"
MY_SQL = f"translate(lower(coalesce(text, '')), '{FROM}', '{TO}')"


def script_docs(spark, sf, name: str = "documents", key: str = "doc_id") -> DataFrame:
    """Texts of a table in Myanmar letters, one for each Latin one."""
    return table(spark, sf, name).select(key, F.translate(F.lower(F.coalesce("text", F.lit(""))), FROM, TO).alias("text"))


# Words, costs and phrases.

GREEDY = f"""{BENCH}, bsp AS (SELECT a.item_id, a.i, a.token || '_' || b.token AS phrase, 2 AS size FROM btok a JOIN btok b ON b.item_id = a.item_id AND b.i = a.i + 1
        UNION ALL SELECT a.item_id, a.i, a.token || '_' || b.token || '_' || c.token, 3 FROM btok a JOIN btok b ON b.item_id = a.item_id AND b.i = a.i + 1 JOIN btok c ON c.item_id = a.item_id AND c.i = a.i + 2
        UNION ALL SELECT a.item_id, a.i, a.token || '_' || b.token || '_' || c.token || '_' || d.token, 4 FROM btok a JOIN btok b ON b.item_id = a.item_id AND b.i = a.i + 1 JOIN btok c ON c.item_id = a.item_id AND c.i = a.i + 2 JOIN btok d ON d.item_id = a.item_id AND d.i = a.i + 3),
    inv AS (SELECT phrase, size, count(*) AS n FROM bsp GROUP BY ALL HAVING count(*) >= 2),
    lng AS (SELECT item_id, i, max(size) AS size FROM bsp JOIN inv USING (phrase, size) GROUP BY ALL),
    nxp AS (SELECT item_id, 0::BIGINT AS at, -1 AS i, 0 AS size FROM (SELECT DISTINCT item_id FROM lng)
        UNION ALL SELECT item_id, i + size, i, size FROM (SELECT x.item_id, l.i, l.size, row_number() OVER (PARTITION BY x.item_id ORDER BY l.i) AS r FROM nxp x JOIN lng l ON l.item_id = x.item_id AND l.i >= x.at) WHERE r = 1),
    tkn AS (SELECT * FROM nxp WHERE size > 0)"""
UNITS = f"""{GREEDY}, unt AS (SELECT b.item_id, b.i, coalesce(s.phrase, b.token) AS unit FROM btok b LEFT JOIN tkn t ON t.item_id = b.item_id AND b.i >= t.i AND b.i < t.i + t.size
        LEFT JOIN bsp s ON s.item_id = t.item_id AND s.i = t.i AND s.size = t.size WHERE t.i IS NULL OR t.i = b.i)"""


@query(f"WITH RECURSIVE {GREEDY} SELECT t.item_id, t.i AS start, t.i + t.size AS \"end\", s.phrase, n FROM tkn t JOIN bsp s ON s.item_id = t.item_id AND s.i = t.i AND s.size = t.size JOIN inv USING (phrase)")
def phrases_of_passages(spark, sf):
    """Greedy longest phrases of the benchmark passages, of those that occur there twice."""
    b = bench_arrays(spark, sf)
    return lm.phrases(b, lm.inventory(lm.spans(b)), key="item_id")


@query(f"""WITH RECURSIVE {UNITS}, uu AS (SELECT unit, count(*) AS n FROM unt GROUP BY 1), um AS (SELECT sum(n) + count(*) AS m FROM uu), uc AS (SELECT unit, -ln((n + 1) / m) AS cost FROM uu, um),
    nx AS (SELECT item_id, i, unit, lag(unit) OVER (PARTITION BY item_id ORDER BY i) AS before FROM unt), ub AS (SELECT before AS w1, unit AS w2, count(*) AS n FROM nx WHERE before IS NOT NULL GROUP BY ALL),
    uv AS (SELECT greatest(count(DISTINCT w2), 1) AS v FROM ub), ul AS (SELECT w1, sum(n) + 0.1::DOUBLE * v AS m FROM ub, uv GROUP BY w1, v), bc AS (SELECT w1, w2, -ln((n + 0.1::DOUBLE) / m) AS cost FROM ub JOIN ul USING (w1))
    SELECT item_id, count(*) AS n, round(sum(0.02::DOUBLE * uc.cost + CASE WHEN before IS NULL THEN 0 ELSE 0.04::DOUBLE * bc.cost END), 4) AS cost
    FROM nx JOIN uc ON uc.unit = nx.unit LEFT JOIN bc ON bc.w1 = nx.before AND bc.w2 = nx.unit GROUP BY 1""")
def phrase_sequence_cost(spark, sf):
    """Costs of the passages as sequences of phrases and words."""
    b = bench_arrays(spark, sf)
    u = lm.units(b, lm.phrases(b, lm.inventory(lm.spans(b)), key="item_id"), "item_id").checkpoint()
    words = lm.unigram_costs(u.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n")))
    return lm.scored(u, words, lm.bigram_costs(lm.bigrams(u)), "item_id", lm.PHRASE, lm.PHRASE_PAIR).select("item_id", "n", F.round("cost", 4).alias("cost"))


@query(f"""WITH {tok()}, {UCOST}, {BCOST}, {BENCH}, q AS (SELECT item_id, i, token AS w1, lead(token) OVER (PARTITION BY item_id ORDER BY i) AS w2 FROM btok)
    SELECT item_id, i, w1, w2, round(exp(-greatest(cost - 5, 0) / 3), 6) AS strength FROM q JOIN bcost USING (w1, w2) WHERE exp(-greatest(cost - 5, 0) / 3) > 0.02::DOUBLE""")
def collocation_edges(spark, sf):
    words, rows = doc_words(spark, sf), bench_arrays(spark, sf)
    pairs = doc_pairs(spark, sf, lm.bigrams(rows))
    e = lm.collocation_edges(rows, lm.unigram_costs(words.select("token", "n"))[0], lm.bigram_costs(pairs, words=words)[0], "item_id")
    return e.select("item_id", "i", "w1", "w2", r6("strength").alias("strength"))


# Segmentation.

PPAIRS = """ppr AS (SELECT w[k] AS w1, w[k + 1] AS w2 FROM (SELECT w, unnest(range(1, len(w))) AS k FROM (SELECT string_split(p_name, ' ') AS w FROM part))), pbi AS (SELECT w1, w2, count(*) AS n FROM ppr GROUP BY ALL),
    pv AS (SELECT greatest(count(DISTINCT w2), 1) AS v FROM pbi), plf AS (SELECT w1, sum(n) + 0.1::DOUBLE * v AS m FROM pbi, pv GROUP BY w1, v), pbc AS (SELECT w1, w2, -ln((n + 0.1::DOUBLE) / m) AS cost FROM pbi JOIN plf USING (w1))"""
LATTICE = f"""{PWORDS}, wm AS (SELECT sum(n) + count(*) AS m FROM wrd), wc AS (SELECT word, 1 + 0.2::DOUBLE * least(-ln((n + 1) / m), 15) AS c FROM wrd, wm), {PPAIRS},
    t AS (SELECT DISTINCT replace(p_name, ' ', '') AS text FROM part), pl AS (SELECT text, unnest(range(length(text))) AS i FROM t), lat AS (SELECT text, i, unnest(range(i + 1, least(length(text), i + 16) + 1)) AS j FROM pl),
    pr AS (SELECT text, i, j, substring(text, i + 1, j - i) AS w, wc.word IS NOT NULL AS known, coalesce(c, 5 + 0.2::DOUBLE * 15 + (j - i - 1) * 10) AS c FROM lat LEFT JOIN wc ON word = substring(text, i + 1, j - i)),
    nr AS (SELECT a.text, a.i, a.j, b.w AS nw, 4 / (p.cost + 1e-9) AS rw FROM pr a JOIN pr b ON b.text = a.text AND b.i = a.j AND a.known JOIN pbc p ON p.w1 = a.w AND p.w2 = b.w),
    dp AS (SELECT text, length(text) AS i, MAP {{length(text): 0::DOUBLE}} AS best, MAP {{length(text): length(text)}} AS nxt, MAP {{length(text): ''}} AS fst FROM t
        UNION ALL SELECT text, i, map_concat(best, MAP {{i: x.cost}}), map_concat(nxt, MAP {{i: x.j}}), map_concat(fst, MAP {{i: x.w}}) FROM (
            SELECT text, i, any_value(best) AS best, any_value(nxt) AS nxt, any_value(fst) AS fst, min({{'cost': c, 'j': j, 'w': w}}) AS x FROM (
                SELECT d.text, p.i, d.best, d.nxt, d.fst, p.j, p.w, p.c + d.best[p.j] - coalesce(n.rw, 0) AS c
                FROM dp d JOIN pr p ON p.text = d.text AND p.i = d.i - 1 LEFT JOIN nr n ON n.text = p.text AND n.i = p.i AND n.j = p.j AND n.nw = d.fst[p.j]) GROUP BY text, i)),
    fin AS (SELECT * FROM dp WHERE i = 0)"""


def part_lattice(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A priced lattice of the part names without their spaces, and the costs of pairs of their words."""
    words = part_words(spark, sf)
    rows = segment.lattice(part_texts(spark, sf).select("text").distinct(), LATIN, 16, "text", "text")
    pairs = lm.bigram_costs(lm.bigrams(table(spark, sf, "part").select(F.split("p_name", " ").alias("t"))))[0]
    return segment.priced(rows, words, lm.unigram_costs(words.withColumnRenamed("word", "token"))[0]).checkpoint(), pairs


@query(f"""WITH RECURSIVE {LATTICE}, w AS (SELECT text, nxt, 0::BIGINT AS pos, '' AS done FROM fin UNION ALL
        SELECT text, nxt, nxt[pos], CASE WHEN done = '' THEN '' ELSE done || ' ' END || substring(text, pos + 1, nxt[pos] - pos) FROM w WHERE pos < length(text))
    SELECT text, done AS words FROM w WHERE pos = length(text)""")
def dp_segment_pairs(spark, sf):
    """Part names cut again by the cheapest path with rewards of pairs."""
    rows, pairs = part_lattice(spark, sf)
    return segment.best_paths(rows, pairs, key="text").select("text", F.array_join("words", " ").alias("words"))


@query(f"""WITH RECURSIVE {LATTICE}, c AS (SELECT p.text, p.i, p.j, p.w AS piece, p.c AS base, coalesce(n.rw, 0) AS reward, p.c - coalesce(n.rw, 0) + f.best[p.j] AS total
        FROM pr p JOIN fin f ON f.text = p.text LEFT JOIN nr n ON n.text = p.text AND n.i = p.i AND n.j = p.j AND n.nw = f.fst[p.j])
    SELECT text, i, j, piece, round(base, 5) AS base, round(reward, 5) AS reward, round(total, 4) AS total FROM c""")
def segment_trace(spark, sf):
    rows, pairs = part_lattice(spark, sf)
    t = segment.traced(rows, pairs, key="text")
    return t.select("text", "i", "j", "piece", F.round("base", 5).alias("base"), F.round("reward", 5).alias("reward"), F.round("total", 4).alias("total"))


@query(f"""WITH RECURSIVE {LATTICE}, w AS (SELECT text, nxt, 0::BIGINT AS pos, 0 AS k FROM fin UNION ALL SELECT text, nxt, nxt[pos], k + 1 FROM w WHERE pos < length(text)),
    s AS (SELECT text, k, pos AS i, substring(text, pos + 1, nxt[pos] - pos) AS segment FROM w WHERE pos < length(text)), l AS (SELECT *, lag(segment) OVER (PARTITION BY text ORDER BY k) AS before FROM s)
    SELECT l.text, k, l.segment, l.i, p.known AS in_dict, round(p.c - CASE WHEN p.known THEN coalesce(4 / (b.cost + 1e-9), 0) ELSE 0 END, 5) AS cost
    FROM l JOIN pr p ON p.text = l.text AND p.i = l.i AND p.w = l.segment LEFT JOIN pbc b ON b.w1 = p.w AND b.w2 = l.before""")
def segment_info(spark, sf):
    rows, pairs = part_lattice(spark, sf)
    s = segment.informed(segment.best_paths(rows, pairs, key="text"), rows, pairs, key="text")
    return s.select("text", "k", "segment", "i", "in_dict", F.round("cost", 5).alias("cost"))


HALVES = "hvs AS (SELECT DISTINCT w AS text FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part UNION ALL SELECT replace(p_name, ' ', '') FROM part))"


def part_heads(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Texts (part words and whole names), their lattice, and the part words as lexicon."""
    p = table(spark, sf, "part")
    texts = p.select(F.explode(F.split("p_name", " ")).alias("text")).unionByName(p.select(F.replace("p_name", F.lit(" "), F.lit("")).alias("text"))).distinct()
    return texts, segment.lattice(texts, LATIN, 64, "text", "text"), part_words(spark, sf)


WALK = """s AS (SELECT text, '' AS done, 0 AS p, 0 AS bad, 0 AS good FROM hvs UNION ALL
        SELECT text, CASE WHEN done = '' THEN x ELSE done || '|' || x END, p + length(x), bad + CASE WHEN k THEN 0 ELSE 1 END, good + CASE WHEN k THEN 1 ELSE 0 END FROM (
            SELECT s.text, s.done, s.p, s.bad, s.good, coalesce(m, substring(s.text, s.p + 1, 1)) AS x, m IS NOT NULL AS k FROM (
                SELECT s.*, (SELECT arg_max(word, length(word)) FROM wrd WHERE starts_with(substring(s.text, s.p + 1), word) {cond}) AS m FROM s WHERE s.p < length(s.text)) s)),
    f AS (SELECT * FROM s WHERE p = length(text))"""


@query(f"""WITH RECURSIVE {PWORDS}, {HALVES}, {WALK.format(cond='')}
    SELECT f.text, CASE WHEN w.word IS NOT NULL THEN f.text ELSE done END AS parts, CASE WHEN w.word IS NOT NULL THEN 'exact' WHEN bad = 0 THEN 'composite' ELSE 'unknown' END AS mode FROM f LEFT JOIN wrd w ON w.word = f.text""")
def token_fills(spark, sf):
    _, rows, words = part_heads(spark, sf)
    return segment.filled(rows, words, "text").select("text", F.array_join("parts.part", "|").alias("parts"), "mode")


@query(f"""WITH RECURSIVE {PWORDS}, {HALVES}, {WALK.format(cond='AND word <> s.text')} SELECT text, done AS parts FROM f WHERE good >= 2""")
def known_subwords(spark, sf):
    _, rows, words = part_heads(spark, sf)
    return segment.subwords(rows, words, "text").select("text", F.array_join("parts.part", "|").alias("parts"))


@query(f"""WITH RECURSIVE {PWORDS}, {HALVES}, f AS (SELECT text, 0 AS pos, 0 AS k FROM hvs UNION SELECT f.text, (pos + length(word))::INTEGER, k + 1 FROM f JOIN wrd ON starts_with(substring(f.text, pos + 1), word))
    SELECT text, min(k)::INTEGER AS n FROM f WHERE pos = length(text) GROUP BY 1""")
def fewest_words(spark, sf):
    _, rows, words = part_heads(spark, sf)
    return segment.fewest(rows, words, "text").select("text", F.size("words").alias("n"))


@query()
def analysis(spark, sf):
    """The whole analysis of the passages in Myanmar letters: islands, segments, entries, spans."""
    e = lexicon.merge_entries(layers(spark, sf)).withColumn("headword", F.translate("headword", FROM, TO))
    got = pipeline.analysed(script_docs(spark, sf, "benchmark", "item_id"), MYANMAR, lexicon.resolve(e), key="item_id")
    return got.select("item_id", "island", "i", "segment", "start", "end", "layer", "pos")


@query()
def layout_segments(spark, sf):
    """The passages in Myanmar letters with spaces between the words of each run."""
    v = vocabulary(spark, sf).select(F.translate("word", FROM, TO).alias("word"))
    return pipeline.laid_out(script_docs(spark, sf, "benchmark", "item_id"), MYANMAR, v, key="item_id").select("item_id", F.md5("text").alias("text_md5"))


def cut_sql(name: str, source: str, lexicon: str) -> str:
    """Cheapest paths as SQL: {name}s (text, k, seg, place) of the texts of a source, by a table of words with their costs (word, c)."""
    return f"""{name}l AS (SELECT text, i, unnest(range(i + 1, least(length(text), i + 16) + 1)) AS j FROM (SELECT text, unnest(range(length(text))) AS i FROM {source})),
    {name}r AS (SELECT text, i, j, substring(text, i + 1, j - i) AS w, coalesce(c, 5 + 0.2::DOUBLE * 15 + (j - i - 1) * 10) AS c FROM {name}l LEFT JOIN {lexicon} ON word = substring(text, i + 1, j - i)),
    {name}d AS (SELECT text, length(text) AS i, MAP {{length(text): 0::DOUBLE}} AS best, MAP {{length(text): length(text)}} AS nxt FROM {source}
        UNION ALL SELECT text, i, map_concat(best, MAP {{i: x.cost}}), map_concat(nxt, MAP {{i: x.j}}) FROM (SELECT d.text, p.i, any_value(d.best) AS best, any_value(d.nxt) AS nxt, min({{'cost': p.c + d.best[p.j], 'j': p.j}}) AS x
            FROM {name}d d JOIN {name}r p ON p.text = d.text AND p.i = d.i - 1 GROUP BY d.text, p.i)),
    {name}w AS (SELECT text, nxt, 0::BIGINT AS pos, 0 AS k FROM {name}d WHERE i = 0 UNION ALL SELECT text, nxt, nxt[pos], k + 1 FROM {name}w WHERE pos < length(text)),
    {name}s AS (SELECT text, k, substring(text, pos + 1, nxt[pos] - pos) AS seg, pos AS place FROM {name}w WHERE pos < length(text))"""


COSTED = f"""{PWORDS}, wm AS (SELECT sum(n) + count(*) AS m FROM wrd), wc AS (SELECT word, 1 + 0.2::DOUBLE * least(-ln((n + 1) / m), 15) AS c FROM wrd, wm)"""
MISREAD = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE WHEN length(w) <= 4 THEN left(w, 1) || substring(w, 3) ELSE w END), '')"
NEAREST = "row_number() OVER (PARTITION BY q ORDER BY 1 - levenshtein(q, word) / greatest(length(q), length(word)) DESC, length(word), word) AS r FROM {q}, wrd WHERE length(q) > 1 AND length(word) > 1 AND left(q, 1) = left(word, 1) AND abs(length(q) - length(word)) <= {slack} AND levenshtein(q, word) <= {most} AND 1 - levenshtein(q, word) / greatest(length(q), length(word)) >= {least}::DOUBLE"


@query(f"""WITH RECURSIVE {COSTED}, t AS (SELECT DISTINCT {MISREAD} AS text FROM part), {cut_sql('fa', 't', 'wc')},
    o AS (SELECT s.*, w.word IS NULL AS open FROM fas s LEFT JOIN wrd w ON w.word = seg),
    p AS (SELECT *, CASE WHEN NOT open THEN 0 WHEN NOT coalesce(lead(open) OVER x, FALSE) THEN 1 WHEN NOT coalesce(lead(open, 2) OVER x, FALSE) THEN 2 ELSE 3 END AS n, seg || coalesce(lead(seg) OVER x, '') AS s2, seg || coalesce(lead(seg) OVER x, '') || coalesce(lead(seg, 2) OVER x, '') AS s3 FROM o WINDOW x AS (PARTITION BY text ORDER BY k)),
    g AS (SELECT *, CASE n WHEN 2 THEN s2 WHEN 3 THEN s3 END AS run FROM p), q1 AS (SELECT DISTINCT seg AS q FROM g WHERE open), q2 AS (SELECT DISTINCT run AS q FROM g WHERE run IS NOT NULL),
    c1 AS (SELECT q, word FROM (SELECT q, word, {NEAREST.format(q='q1', slack=1, most=2, least=0.6)}) WHERE r = 1), c2 AS (SELECT q, word FROM (SELECT q, word, {NEAREST.format(q='q2', slack=2, most=3, least=0.5)}) WHERE r = 1),
    h AS (SELECT g.*, c2.word AS m, c1.word AS one FROM g LEFT JOIN c2 ON c2.q = run LEFT JOIN c1 ON c1.q = seg AND open),
    v AS (SELECT text, 0::BIGINT AS k, '' AS done, '' AS marks FROM t UNION ALL
        SELECT v.text, v.k + CASE WHEN m IS NOT NULL THEN n ELSE 1 END, done || coalesce(m, one, seg), marks || CASE WHEN m IS NOT NULL THEN length(done) || ':' || m || ':' || run || ':greedy_merge;' WHEN one IS NOT NULL THEN length(done) || ':' || one || ':' || seg || ':spell_correct;' ELSE '' END
        FROM v JOIN h ON h.text = v.text AND h.k = v.k),
    f AS (SELECT text, arg_max(done, k) AS done, arg_max(marks, k) AS marks FROM v GROUP BY 1), u AS (SELECT DISTINCT done AS text FROM f WHERE marks <> ''), {cut_sql('fb', 'u', 'wc')},
    sa AS (SELECT text, string_agg(seg, ' ' ORDER BY k) AS words FROM fas GROUP BY 1), sb AS (SELECT text, string_agg(seg, ' ' ORDER BY k) AS words FROM fbs GROUP BY 1)
    SELECT f.text, CASE WHEN marks = '' THEN sa.words ELSE sb.words END AS words, marks FROM f LEFT JOIN sa ON sa.text = f.text LEFT JOIN sb ON sb.text = f.done""")
def ocr_repaired(spark, sf):
    """Part names without spaces, their short words misread: cut, corrected, and cut again where they changed."""
    misread = F.transform(F.split("p_name", " "), lambda w: F.when(F.length(w) <= 4, F.concat(F.left(w, F.lit(1)), F.substring(w, 3, 100))).otherwise(w))
    texts = table(spark, sf, "part").select(F.array_join(misread, "").alias("text")).distinct().withColumn("name", F.col("text"))
    words = part_words(spark, sf).checkpoint()
    costs = lm.unigram_costs(words.withColumnRenamed("word", "token"))[0].checkpoint()
    cut = lambda t: segment.best_paths(segment.priced(segment.lattice(t, LATIN, 16, "name", "text"), words, costs), key="name").select("name", "words")
    done = repair.repaired(cut(texts), words, cut, LATIN, key="name")
    marks = F.array_join(F.transform("marks", lambda m: F.concat(m["start"].cast("string"), F.lit(":"), m["text"], F.lit(":"), m["original"], F.lit(":"), m["method"], F.lit(";"))), "")
    return done.select(F.col("name").alias("text"), F.array_join("words", " ").alias("words"), marks.alias("marks"))


@query(f"""WITH RECURSIVE {COSTED}, lw AS (SELECT * FROM wc WHERE length(word) >= 6), t AS (SELECT DISTINCT replace(p_name, ' ', '') AS text FROM part), {cut_sql('fa', 't', 'lw')},
    m AS (SELECT text, 0 AS place, '' AS seg FROM t UNION ALL SELECT text, place + length(seg), coalesce((SELECT arg_max(word, length(word)) FROM wrd WHERE starts_with(substring(r.text, r.place + length(r.seg) + 1), word)), substring(text, place + length(seg) + 1, 1)) FROM m r WHERE place + length(seg) < length(text)),
    b AS (SELECT text, place, place + length(seg) AS e, seg FROM m WHERE seg <> ''), a AS (SELECT s.text, place, place + length(seg) AS e, seg, w.word IS NULL AS open FROM fas s LEFT JOIN wrd w ON w.word = seg),
    r AS (SELECT *, sum(CASE WHEN open THEN 0 ELSE 1 END) OVER (PARTITION BY text ORDER BY place) AS run FROM a), n AS (SELECT text, run, min(place) AS s, max(e) AS e FROM r WHERE open GROUP BY ALL),
    x AS (SELECT n.* FROM n WHERE EXISTS (SELECT 1 FROM b WHERE b.text = n.text AND b.place = n.s) AND EXISTS (SELECT 1 FROM b WHERE b.text = n.text AND b.e = n.e)),
    y AS (SELECT text, place, seg FROM a WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.text = a.text AND a.place >= x.s AND a.e <= x.e) UNION ALL SELECT text, place, seg FROM b WHERE EXISTS (SELECT 1 FROM x WHERE x.text = b.text AND b.place >= x.s AND b.e <= x.e))
    SELECT text, string_agg(seg, ' ' ORDER BY place) AS words FROM y GROUP BY 1""")
def arbitrated_names(spark, sf):
    """Part names cut by words of six letters or more alone; longest matches of all words decide the unknown runs."""
    texts = part_texts(spark, sf).select("text").distinct()
    words = part_words(spark, sf).checkpoint()
    rows = segment.lattice(texts, LATIN, 16, "text", "text").checkpoint()
    costs = lm.unigram_costs(words.withColumnRenamed("word", "token"))[0]
    first = segment.best_paths(segment.priced(rows, words.filter(F.length("word") >= 6), costs.filter(F.length("token") >= 6)), key="text")
    return repair.arbitrated(first, segment.max_match(rows, words, "text"), words, LATIN, key="text").select("text", F.array_join("words", " ").alias("words"))


@query()
def ocr_words(spark, sf):
    """What spaces part in the documents in Myanmar letters, cleaned as scanned text, as words of the passages: cut, corrected,
    cut again, arbitrated. Equal words are cleaned and cut once."""
    texts = clean.ocr_distinct(table(spark, sf, "documents"), FROM, TO).withColumn("found", F.col("text")).checkpoint()
    words = lm.unigrams(tx.tokens(table(spark, sf, "benchmark"), LATIN, "item_id")).select(clean.ocr_clean(F.translate("token", FROM, TO)).alias("token"), "n")
    words = words.filter("token <> ''").groupBy("token").agg(F.sum("n").alias("n")).checkpoint()
    done = repair.scanned(texts, words.select(F.col("token").alias("word")), lm.unigram_costs(words)[0], MYANMAR, key="found")
    return done.select("found", F.array_join("words", " ").alias("words"), F.size("marks").alias("n_marks"))


# Search.

CTX = f"""{NAMES}, cw AS (SELECT DISTINCT query, left(query, 3) AS other FROM mis)"""


@query(f"""WITH {NAMES}, b AS (SELECT word AS w1, word AS w2, n FROM nam), cx AS (SELECT query, min(word) AS before FROM fnd WHERE distance = 1 GROUP BY 1),
    v AS (SELECT greatest(count(DISTINCT w2), 1) AS v FROM b), l AS (SELECT w1, sum(n) + 0.1::DOUBLE * v AS m FROM b, v GROUP BY w1, v), d AS (SELECT w1, -ln(0.1::DOUBLE / m) AS dc FROM l),
    g AS (SELECT avg(dc) AS gc FROM d), bc AS (SELECT w1, w2, -ln((n + 0.1::DOUBLE) / m) AS cost FROM b JOIN l USING (w1)),
    s AS (SELECT f.query, f.word, distance, 1 - distance / greatest(length(f.query), length(f.word)) AS sim, CASE WHEN before IS NULL THEN u.cost ELSE coalesce(bc.cost, coalesce(dc, gc) + 0.5::DOUBLE * u.cost) END AS cost
        FROM fnd f LEFT JOIN cx ON cx.query = f.query JOIN ncost u ON u.word = f.word LEFT JOIN bc ON bc.w1 = before AND bc.w2 = f.word LEFT JOIN d ON d.w1 = before, g WHERE distance > 0),
    p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, sim DESC, word) AS pos FROM s), t AS (SELECT *, 0.5::DOUBLE * distance + 0.5::DOUBLE * cost AS total FROM p WHERE pos <= 50),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY total, distance, sim DESC, word)::INTEGER AS rank FROM t), e AS (SELECT *, exp(min(total) OVER (PARTITION BY query) - total) AS e FROM r WHERE rank <= 5)
    SELECT query, word, distance, round(e / sum(e) OVER (PARTITION BY query), 6) AS score, rank FROM e""")
def spell_in_context(spark, sf):
    """Suggestions for misspelt part names after the first name that is one edit away, with each name as its own neighbour."""
    names = part_names(spark, sf)
    found = search.within(misspelt(spark, sf), names, 2).checkpoint()
    words = lm.unigram_costs(names.withColumnRenamed("word", "token"))
    pairs = lm.bigram_costs(names.select(F.col("word").alias("w1"), F.col("word").alias("w2"), "n"))
    context = found.filter("distance = 1").groupBy("query").agg(F.min("word").alias("before")).withColumn("after", F.lit(None).cast("string"))
    return search.reranked(found, search.in_context(found, context, words, pairs)).select("query", "word", "distance", r6("score").alias("score"), "rank")


@query(f"""WITH {NAMES}, cx AS (SELECT DISTINCT query, w.word AS other FROM fnd f JOIN nam w ON left(w.word, 4) = left(f.word, 4) WHERE f.distance = 1), b AS (SELECT a.word AS w1, c.word AS w2, count(*) AS n FROM nam a JOIN nam c ON right(a.word, 3) = right(c.word, 3) GROUP BY ALL),
    v AS (SELECT greatest(count(DISTINCT w2), 1) AS v FROM b), l AS (SELECT w1, sum(n) + 0.1::DOUBLE * v AS m FROM b, v GROUP BY w1, v), bc AS (SELECT w1, w2, -ln((n + 0.1::DOUBLE) / m) AS cost FROM b JOIN l USING (w1)),
    near AS (SELECT f.query, f.word, min(cost) AS pair FROM fnd f JOIN cx USING (query) JOIN bc ON (bc.w1 = other AND bc.w2 = f.word) OR (bc.w1 = f.word AND bc.w2 = other) GROUP BY ALL),
    s AS (SELECT f.query, f.word, distance, pair IS NOT NULL AS has_pair, CASE WHEN pair IS NULL THEN cost ELSE 0.5::DOUBLE * pair + 0.5::DOUBLE * cost END AS score FROM fnd f JOIN ncost USING (word) LEFT JOIN near n ON n.query = f.query AND n.word = f.word WHERE distance > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, has_pair DESC, score, word)::INTEGER AS rank FROM s) SELECT query, word, distance, has_pair, round(score, 6) AS score, rank FROM r WHERE rank <= 10""")
def spell_with_pairs(spark, sf):
    """Suggestions by pairs with context words: names that begin like a near one; pairs are names that end alike."""
    names = part_names(spark, sf)
    found = search.within(misspelt(spark, sf), names, 2).checkpoint()
    begin = names.select(F.col("word").alias("other"), F.left("word", F.lit(4)).alias("_b"))
    context = found.filter("distance = 1").withColumn("_b", F.left("word", F.lit(4))).join(begin, "_b").select("query", "other").distinct()
    end = names.select("word", F.right("word", F.lit(3)).alias("_e"))
    pairs = end.withColumnRenamed("word", "w1").join(end.withColumnRenamed("word", "w2"), "_e").groupBy("w1", "w2").agg(F.count("*").alias("n"))
    words = lm.unigram_costs(names.withColumnRenamed("word", "token"))
    return search.pair_aware(found, context, words, lm.bigram_costs(pairs)[0]).select("query", "word", "distance", "has_pair", r6("score").alias("score"), "rank")


@query(f"""WITH {PWORDS}, isl AS (SELECT DISTINCT p_name AS doc_id FROM part), tk AS (SELECT doc_id, unnest(range(len(w)))::INTEGER AS i, unnest(w) AS t0 FROM (SELECT doc_id, string_split(doc_id, ' ') AS w FROM isl)),
    bt AS (SELECT doc_id, i, CASE WHEN i = 1 THEN left(t0, length(t0) - 1) ELSE t0 END AS token FROM tk), k AS (SELECT bt.*, w.word IS NOT NULL AS known FROM bt LEFT JOIN wrd w ON w.word = bt.token),
    vc AS (SELECT word, n FROM wrd UNION ALL SELECT replace(doc_id, ' ', ''), 1 FROM isl WHERE replace(doc_id, ' ', '') NOT IN (SELECT word FROM wrd)), vm AS (SELECT sum(n) + count(*) AS m FROM vc), vcost AS (SELECT word, -ln((n + 1) / m) AS cost FROM vc, vm),
    rn AS (SELECT *, sum(known::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM k), bd AS (SELECT doc_id, b, min(i) AS f, max(i) AS l FROM rn WHERE NOT known GROUP BY ALL),
    tg AS (SELECT r.doc_id, r.i AS target, f, l FROM rn r JOIN bd USING (doc_id, b) WHERE NOT known AND r.i = 1), mx AS (SELECT doc_id, max(i) AS m FROM k GROUP BY 1),
    sp AS (SELECT doc_id, target, f, l, s, e FROM (SELECT *, unnest(range(0, f + 1))::INTEGER AS s FROM tg) JOIN (SELECT doc_id, target, unnest(range(l, m + 1))::INTEGER AS e FROM tg JOIN mx USING (doc_id)) USING (doc_id, target)),
    tx AS (SELECT sp.doc_id, target, s, e, string_agg(token, '' ORDER BY i) AS text, coalesce(string_agg(token, '' ORDER BY i) FILTER (WHERE i < f), '') AS lt, coalesce(string_agg(token, '' ORDER BY i) FILTER (WHERE i > l), '') AS rt FROM sp JOIN k ON k.doc_id = sp.doc_id AND i BETWEEN s AND e GROUP BY ALL),
    dt AS (SELECT DISTINCT text FROM tx), dd AS (SELECT text, word, levenshtein(text, word)::INTEGER AS distance FROM dt, vc WHERE abs(length(text) - length(word)) <= 2 AND levenshtein(text, word) BETWEEN 1 AND 2),
    h AS (SELECT tx.*, word, distance, min(distance) OVER (PARTITION BY doc_id, target) AS md FROM tx JOIN dd USING (text) WHERE starts_with(word, lt) AND ends_with(word, rt) AND length(word) > length(lt) + length(rt)),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, target ORDER BY e - s DESC, length(text) DESC, s, cost, word)::INTEGER AS rank FROM h JOIN vcost USING (word) WHERE distance = md)
    SELECT doc_id, target, s AS start, e AS "end", text, word, distance, rank FROM r WHERE rank <= 10""")
def fuzzy_spans(spark, sf):
    """Part names as islands, their second word without its last letter: what it may have been, alone or with its neighbours."""
    islands = table(spark, sf, "part").select(F.col("p_name").alias("doc_id")).distinct()
    t = islands.select("doc_id", F.posexplode(F.split("doc_id", " ")).alias("i", "token"))
    t = t.withColumn("token", F.when(F.col("i") == 1, F.expr("left(token, length(token) - 1)")).otherwise(F.col("token")))
    words = part_words(spark, sf)
    t = t.join(words.select(F.col("word").alias("token"), F.lit(True).alias("known")), "token", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    whole = islands.select(F.replace("doc_id", F.lit(" "), F.lit("")).alias("word")).distinct().join(words, "word", "left_anti").withColumn("n", F.lit(1).cast("long"))
    every = words.unionByName(whole).checkpoint()
    costs = lm.unigram_costs(every.withColumnRenamed("word", "token"))[0].select(F.col("token").alias("word"), "cost")
    return search.expanded(t.checkpoint(), t.filter("i = 1 and not known"), every.select("word"), costs)


@query(f"""WITH {NAMES} SELECT query, word, levenshtein(query, word)::INTEGER AS distance FROM mis, nam WHERE left(query, 1) = left(word, 1) AND abs(length(query) - length(word)) <= 1 AND query <> word AND levenshtein(query, word) <= 2
    AND 1 - levenshtein(query, word) / greatest(length(query), length(word)) >= 0.6::DOUBLE""")
def blocked_candidates(spark, sf):
    return search.blocked(misspelt(spark, sf), part_names(spark, sf)).select("query", "word", "distance")


# Trees.

HIGH = f"""{TREES}, dsc AS (SELECT doc, i AS a, i AS n, 0 AS d FROM tre UNION ALL SELECT c.doc, c.a, t.i, c.d + 1 FROM dsc c JOIN tre t ON t.doc = c.doc AND t.head = c.n), hgt AS (SELECT doc, a AS i, max(d) AS h FROM dsc GROUP BY ALL)"""


@query(f"""WITH RECURSIVE {HIGH}, e AS (SELECT t.doc, t.i AS a, t.head AS b FROM tre t WHERE head IS NOT NULL AND NOT EXISTS (SELECT 1 FROM hgt h WHERE h.doc = t.doc AND h.i > t.i AND h.i < t.head AND h.h > 1)),
    s AS (SELECT doc, a, b FROM e UNION SELECT doc, b, a FROM e), r AS (SELECT doc, i AS a, i AS b FROM tre UNION SELECT r.doc, r.a, s.b FROM r JOIN s ON s.doc = r.doc AND s.a = r.b)
    SELECT doc, a AS i, min(b) AS component FROM r GROUP BY ALL""")
def gap_components(spark, sf):
    return graph.gap_components(trees(spark, sf), 1)


@query(f"""WITH RECURSIVE {HIGH}, u AS (SELECT t.doc, t.i, CASE WHEN head IS NULL OR h > 1 THEN NULL ELSE head END AS up FROM tre t JOIN hgt USING (doc, i)),
    c AS (SELECT doc, i, i AS t FROM u UNION ALL SELECT c.doc, c.i, u.up FROM c JOIN u ON u.doc = c.doc AND u.i = c.t WHERE u.up IS NOT NULL) SELECT doc, i, max(t) AS chunk FROM c GROUP BY ALL""")
def branch_chunks(spark, sf):
    return graph.branch_chunks(trees(spark, sf), 1)


@query(f"""WITH RECURSIVE {TREES}, u AS (SELECT doc, i, head, CASE WHEN i % 7 IN (2, 3, 4) THEN i - i % 7 + 2 ELSE i END AS un FROM tre), p AS (SELECT *, dense_rank() OVER (PARTITION BY doc ORDER BY un) - 1 AS p FROM u),
    e AS (SELECT DISTINCT a.doc, a.p AS a, b.p AS b FROM p a JOIN p b ON b.doc = a.doc AND b.i = a.head WHERE a.p <> b.p AND abs(a.p - b.p) <= 2), s AS (SELECT doc, a, b FROM e UNION SELECT doc, b, a FROM e),
    r AS (SELECT DISTINCT doc, p AS a, p AS b FROM p UNION SELECT r.doc, r.a, s.b FROM r JOIN s ON s.doc = r.doc AND s.a = r.b), m AS (SELECT doc, a, min(b) AS c FROM r GROUP BY ALL), f AS (SELECT doc, p, min(i) AS fi FROM p GROUP BY ALL)
    SELECT p.doc, p.i, fi::INTEGER AS chunk FROM p JOIN m ON m.doc = p.doc AND m.a = p.p JOIN f ON f.doc = p.doc AND f.p = m.c""")
def compressed_chunks(spark, sf):
    """Chunks with every run of places 2 to 4 of seven as an entity."""
    t = trees(spark, sf)
    last = t.groupBy("doc").agg(F.max("i").alias("m"))
    e = t.filter("i % 7 = 2").join(last, "doc").select("doc", F.col("i").alias("first"), F.least(F.col("i") + 2, F.col("m")).alias("last"))
    return graph.bottom_up_compressed(t, e, 2)


IGR = f"""{TREES}, igl AS (SELECT DISTINCT doc, greatest(i // 5, head // 5) AS island FROM tre WHERE head IS NOT NULL AND abs(i // 5 - head // 5) = 1), igs AS (SELECT DISTINCT doc, i // 5 AS island FROM tre),
    igg AS (SELECT s.doc, s.island, sum(CASE WHEN l.island IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc ORDER BY s.island) - 1 AS grp FROM igs s LEFT JOIN igl l ON l.doc = s.doc AND l.island = s.island),
    grs AS (SELECT doc, grp, min(island) AS first, max(island) AS last FROM igg GROUP BY ALL), tg AS (SELECT t.doc, t.i, t.head, g.grp FROM tre t JOIN igg g ON g.doc = t.doc AND g.island = t.i // 5),
    gm AS (SELECT doc, grp, max(i) AS m FROM tg GROUP BY ALL),
    ge AS (SELECT a.doc, a.grp, max(b.grp) FILTER (WHERE b.grp < a.grp) AS back, min(a.i) FILTER (WHERE a.head > m) AS ahead FROM tg a JOIN gm USING (doc, grp) LEFT JOIN tg b ON b.doc = a.doc AND b.i = a.head GROUP BY ALL),
    gi AS (SELECT g.*, back, ahead FROM grs g LEFT JOIN ge USING (doc, grp)),
    ab AS (SELECT doc, grp, first, last, grp AS s FROM gi WHERE grp = 0
        UNION ALL SELECT n.doc, n.grp, n.first, n.last, CASE WHEN n.ahead IS NULL AND coalesce(n.back >= ab.s, FALSE) AND n.first = ab.last + 1 THEN ab.s ELSE n.grp END FROM ab JOIN gi n ON n.doc = ab.doc AND n.grp = ab.grp + 1),
    ar AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY s) - 1 AS grp, min(first) AS first, max(last) AS last FROM ab GROUP BY doc, s),
    at2 AS (SELECT t.doc, t.i, t.head, r.grp FROM tre t JOIN ar r ON r.doc = t.doc AND t.i // 5 BETWEEN r.first AND r.last), am AS (SELECT doc, grp, max(i) AS m FROM at2 GROUP BY ALL),
    ai AS (SELECT doc, grp, any_value(first) AS first, any_value(last) AS last, min(i) FILTER (WHERE head > m) AS ahead FROM at2 JOIN am USING (doc, grp) JOIN ar USING (doc, grp) GROUP BY ALL)"""


def island_edges(spark, sf) -> DataFrame:
    t = trees(spark, sf)
    places = t.select("doc", "i", F.floor(F.col("i") / 5).alias("island")).checkpoint()
    return graph.group_edges(graph.island_groups(places, t), places, t)


@query(f"WITH RECURSIVE {IGR} SELECT doc, grp, first, last FROM ar")
def absorbed_groups(spark, sf):
    return graph.absorbed(island_edges(spark, sf))


@query(f"""WITH RECURSIVE {IGR}, s AS (SELECT *, CASE WHEN ahead IS NULL OR ahead % 3 = 0 THEN 1 ELSE 0 END AS e FROM ai), n AS (SELECT *, coalesce(sum(e) OVER (PARTITION BY doc ORDER BY grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM s)
    SELECT doc, g AS grp, min(first) AS first, max(last) AS last FROM n GROUP BY ALL""")
def gated_groups(spark, sf):
    """Absorbed groups merged up to gates, here the tokens at places divisible by three."""
    t = trees(spark, sf)
    places = t.select("doc", "i", F.floor(F.col("i") / 5).alias("island")).checkpoint()
    grown = graph.absorbed(graph.group_edges(graph.island_groups(places, t), places, t))
    return graph.acl_gated(graph.group_edges(grown, places, t), t.filter("i % 3 = 0").select("doc", "i"))


@query(f"""WITH RECURSIVE {TREES}, c AS (SELECT doc, i, head AS a, 1 AS d FROM tre WHERE head IS NOT NULL UNION ALL SELECT c.doc, c.i, t.head, c.d + 1 FROM c JOIN tre t ON t.doc = c.doc AND t.i = c.a WHERE t.head IS NOT NULL),
    k AS (SELECT c.* FROM c JOIN tre t ON t.doc = c.doc AND t.i = c.a WHERE t.head IS NOT NULL) SELECT t.doc, t.i, coalesce(string_agg(a::VARCHAR, '>' ORDER BY d), '') AS path FROM tre t LEFT JOIN k ON k.doc = t.doc AND k.i = t.i GROUP BY ALL""")
def root_paths(spark, sf):
    return graph.root_paths(trees(spark, sf)).select("doc", "i", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def split_sql(name: str, source: str) -> str:
    """Clauses with several tops split, as SQL: {name} (doc, i, clause) of source (doc, i, clause); new ones are numbered on."""
    return f"""{name}b AS (SELECT a.doc, a.i, min(a.d) AS b FROM anc a JOIN {source} x ON x.doc = a.doc AND x.i = a.i JOIN {source} y ON y.doc = a.doc AND y.i = a.a WHERE x.clause <> y.clause GROUP BY 1, 2),
    {name}t AS (SELECT a.doc, a.i, arg_max(a.a, a.d) AS top FROM anc a LEFT JOIN {name}b b ON b.doc = a.doc AND b.i = a.i WHERE a.d < coalesce(b.b, 1000000) GROUP BY 1, 2),
    {name}o AS (SELECT s.doc, s.i, s.clause, t.top, n.up, n.kids FROM {source} s JOIN {name}t t ON t.doc = s.doc AND t.i = s.i JOIN tn n ON n.doc = s.doc AND n.i = s.i),
    {name}g AS (SELECT doc, clause, count(*) > 1 AND count(DISTINCT coalesce(up, -1)) = 1 AS whole, min(i) AS f0, min(i) FILTER (WHERE kids) AS f1 FROM {name}o WHERE i = top AND clause <> 0 GROUP BY 1, 2),
    {name}n AS (SELECT o.doc, o.clause, o.i AS top, (SELECT max(clause) FROM {source} m WHERE m.doc = o.doc) + row_number() OVER (PARTITION BY o.doc ORDER BY o.clause, o.i) AS new
        FROM {name}o o JOIN {name}g g ON g.doc = o.doc AND g.clause = o.clause WHERE o.i = o.top AND (whole OR o.kids) AND o.i <> CASE WHEN whole THEN f0 ELSE f1 END),
    {name} AS (SELECT o.doc, o.i, CASE WHEN n.new IS NOT NULL AND (g.whole OR o.kids) THEN n.new ELSE o.clause END AS clause FROM {name}o o LEFT JOIN {name}g g ON g.doc = o.doc AND g.clause = o.clause LEFT JOIN {name}n n ON n.doc = o.doc AND n.clause = o.clause AND n.top = o.top)"""


def clause_sql(branch: int = 1, drop: int = 3) -> str:
    """Linear clauses as SQL: cls (doc, i, clause) of tre (doc, i, head)."""
    return f"""anc AS (SELECT doc, i, i AS a, 0 AS d FROM tre UNION ALL SELECT c.doc, c.i, t.head, c.d + 1 FROM anc c JOIN tre t ON t.doc = c.doc AND t.i = c.a WHERE t.head IS NOT NULL),
    hg AS (SELECT doc, a AS i, max(d) AS h, count(*) AS size FROM anc GROUP BY 1, 2), dp AS (SELECT doc, i, max(d) AS depth FROM anc GROUP BY 1, 2),
    tn AS (SELECT t.doc, t.i, t.head AS up, depth, h > 0 AS kids, h > {branch} AS br FROM tre t JOIN hg USING (doc, i) JOIN dp USING (doc, i)),
    bh AS (SELECT doc, i, lag(i) OVER (PARTITION BY doc ORDER BY i) AS p FROM tn WHERE br), bl AS (SELECT b.doc, b.i, bool_or(a.i IS NOT NULL) AS line FROM bh b LEFT JOIN anc a ON a.doc = b.doc AND ((a.i = b.i AND a.a = b.p) OR (a.i = b.p AND a.a = b.i)) GROUP BY 1, 2),
    bg AS (SELECT doc, i, sum(CASE WHEN line THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY i)::BIGINT AS g FROM bl), nb AS (SELECT a.doc, a.i, arg_min(g, d) AS g FROM anc a JOIN bg ON bg.doc = a.doc AND bg.i = a.a GROUP BY 1, 2), ab AS (SELECT doc, bool_or(br) AS anybr FROM tn GROUP BY 1),
    c0 AS (SELECT t.doc, t.i, depth, anybr, CASE WHEN anybr THEN coalesce(g, 0) ELSE 1 END AS c FROM tn t JOIN ab USING (doc) LEFT JOIN nb USING (doc, i)), cf AS (SELECT *, anybr AND c <> 0 AND coalesce(depth - lag(depth) OVER (PARTITION BY doc, c ORDER BY i) >= {drop}, FALSE) AS falls FROM c0),
    cp AS (SELECT *, sum(falls::INTEGER) OVER (PARTITION BY doc, c ORDER BY i) AS part FROM cf), c1 AS (SELECT doc, i, CASE WHEN c = 0 THEN 0 ELSE dense_rank() OVER (PARTITION BY doc ORDER BY c, part) END AS clause FROM cp), {split_sql('s1', 'c1')},
    c2 AS (SELECT s.doc, s.i, CASE WHEN n.kids OR u.clause IS NULL THEN s.clause ELSE u.clause END AS clause FROM s1 s JOIN tn n USING (doc, i) LEFT JOIN s1 u ON u.doc = s.doc AND u.i = n.up),
    cb AS (SELECT *, last_value(nullif(clause, 0) IGNORE NULLS) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM c2),
    c3 AS (SELECT doc, i, CASE WHEN clause = 0 THEN 0 ELSE sum(CASE WHEN clause <> 0 AND clause IS DISTINCT FROM b THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY i) END AS clause FROM cb), {split_sql('s2', 'c3')}, cls AS (SELECT doc, i, clause::BIGINT AS clause FROM s2)"""


def chunk_sql(most: int = 4) -> str:
    """Chunk members as SQL: mem (doc, head, depth, i, kind) of the trees and clauses of clause_sql."""
    return f"""lf AS (SELECT doc, i, up FROM tn WHERE NOT kids AND up IS NOT NULL), bt AS (SELECT l.doc, l.i, count(m.i) = abs(l.i - l.up) - 1 AS beside FROM lf l LEFT JOIN lf m ON m.doc = l.doc AND m.up = l.up AND m.i > least(l.i, l.up) AND m.i < greatest(l.i, l.up) GROUP BY l.doc, l.i, l.up),
    mem AS (SELECT a.doc, a.a AS head, h.depth, a.i, CASE WHEN a.d = 0 THEN 'own' WHEN n.kids OR beside THEN 'member' ELSE 'extra' END AS kind FROM anc a JOIN tn h ON h.doc = a.doc AND h.i = a.a AND h.kids AND h.depth <= {most} JOIN tn n ON n.doc = a.doc AND n.i = a.i
        LEFT JOIN bt ON bt.doc = a.doc AND bt.i = a.i JOIN cls x ON x.doc = a.doc AND x.i = a.i JOIN cls y ON y.doc = a.doc AND y.i = a.a WHERE CASE WHEN h.depth = 0 THEN a.d = 0 OR (a.d = 1 AND NOT n.kids) ELSE x.clause = y.clause END)"""


UPOS_SQL = "CASE WHEN {i} % 3 = 0 THEN 'NOUN' ELSE 'VERB' END"


def tagged_trees(spark, sf) -> DataFrame:
    return trees(spark, sf).withColumn("upos", F.when(F.col("i") % 3 == 0, "NOUN").otherwise("VERB")).checkpoint()


@query(f"WITH RECURSIVE {TREES}, {clause_sql()} SELECT doc, i, clause FROM cls")
def linear_clauses(spark, sf):
    """Clauses of the passages' trees, from left to right."""
    return tours.clause_groups(trees(spark, sf))


@query(f"""WITH RECURSIVE {TREES}, {clause_sql()}, {chunk_sql()}, c AS (SELECT doc, head, depth, list_sort(list(i) FILTER (WHERE kind <> 'extra')) AS m, list_sort(coalesce(list(i) FILTER (WHERE kind = 'extra'), [])) AS x FROM mem GROUP BY 1, 2, 3)
    SELECT doc, head AS chunk_head, array_to_string(m, ',') AS members, array_to_string(x, ',') AS extras, depth::INTEGER AS depth, CASE WHEN depth = 0 THEN 'ROOT' ELSE {UPOS_SQL.format(i='head')} END AS pos, FALSE AS singleton FROM c
    UNION ALL SELECT doc, i, i::VARCHAR, '', depth, {UPOS_SQL.format(i='i')}, TRUE FROM mem WHERE kind = 'extra'""")
def chunk_models(spark, sf):
    """Chunks of the passages' trees, split at clauses."""
    t = tagged_trees(spark, sf)
    tour = tours.euler(t)
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return tours.chunk_model(t, clauses=tours.clause_groups(t, tour=tour), tour=tour).select("doc", "chunk_head", listed("members"), listed("extras"), "depth", "pos", "singleton")


@query(f"""WITH RECURSIVE {TREES}, {clause_sql()}, {chunk_sql()}, b AS (SELECT doc, i, arg_max({{'h': head, 'd': depth, 'k': kind}}, depth) AS c FROM mem GROUP BY 1, 2)
    SELECT t.doc, t.i, CASE WHEN c.k = 'extra' THEN t.i ELSE coalesce(c.h, t.i) END AS chunk_head, coalesce(c.d, -1)::INTEGER AS depth, CASE WHEN c IS NULL OR c.k = 'extra' THEN {UPOS_SQL.format(i='t.i')} WHEN c.d = 0 THEN 'ROOT' ELSE {UPOS_SQL.format(i='c.h')} END AS pos
    FROM tre t LEFT JOIN b ON b.doc = t.doc AND b.i = t.i""")
def canonical_chunks(spark, sf):
    t = tagged_trees(spark, sf)
    tour = tours.euler(t)
    return tours.canonical_chunks(t, clauses=tours.clause_groups(t, tour=tour), tour=tour)


@query(f"""WITH RECURSIVE {TREES}, w AS (SELECT doc, i, lpad(i::VARCHAR, 6, '0') AS path, 0 AS depth FROM tre WHERE head IS NULL UNION ALL SELECT t.doc, t.i, w.path || '/' || lpad(t.i::VARCHAR, 6, '0'), w.depth + 1 FROM w JOIN tre t ON t.doc = w.doc AND t.head = w.i),
    s AS (SELECT a.doc, a.i, count(*) AS size, max(b.depth) - a.depth AS height FROM w a JOIN w b ON b.doc = a.doc AND (b.path = a.path OR starts_with(b.path, a.path || '/')) GROUP BY a.doc, a.i, a.depth)
    SELECT w.doc, w.i, w.depth::INTEGER AS depth, row_number() OVER (PARTITION BY w.doc ORDER BY string_split(path, '/')) - 1 AS entry, size, height::INTEGER AS height, split_part(path, '/', 1)::INTEGER AS root FROM w JOIN s ON s.doc = w.doc AND s.i = w.i""")
def euler_tours(spark, sf):
    return tours.euler(trees(spark, sf)).select("doc", "i", "depth", "entry", "size", "height", "root")


def highlight_sql(roll: bool) -> str:
    """Highlight sets as SQL, from the trees alone."""
    acl, verb = "{i} % 5 = 0", "{i} % 3 <> 0"
    counts = acl.format(i="h.br") if roll else "TRUE"
    rolls = f"NOT x.kids OR NOT ({acl.format(i='x.br')})" if roll else "NOT x.kids"
    reach = f"""UNION SELECT m.doc, m.root, m.i FROM br m JOIN tk k ON k.doc = m.doc AND k.br = m.br WHERE m.i <> m.root AND k.kids AND NOT EXISTS (SELECT 1 FROM tk s WHERE s.doc = k.doc AND s.root = k.root AND s.kids AND {acl.format(i='s.br')} AND {verb.format(i='s.br')}
            AND sign(s.br - s.root) = sign(k.br - k.root) AND abs(s.br - s.root) <= abs(k.br - k.root))""" if roll else ""
    return f"""anc AS (SELECT doc, i, i AS a, 0 AS d FROM tre UNION ALL SELECT c.doc, c.i, t.head, c.d + 1 FROM anc c JOIN tre t ON t.doc = c.doc AND t.i = c.a WHERE t.head IS NOT NULL), kd AS (SELECT DISTINCT doc, head AS i FROM tre WHERE head IS NOT NULL),
    rt AS (SELECT doc, i, arg_max(a, d) AS root, max(d) AS depth FROM anc GROUP BY 1, 2), br AS (SELECT r.doc, r.i, r.root, coalesce(a.a, r.i) AS br FROM rt r LEFT JOIN anc a ON a.doc = r.doc AND a.i = r.i AND r.depth > 0 AND a.d = r.depth - 1),
    tk AS (SELECT b.doc, b.i AS br, b.root, k.i IS NOT NULL AS kids FROM br b LEFT JOIN kd k ON k.doc = b.doc AND k.i = b.i WHERE b.i = b.br AND b.i <> b.root),
    ps AS (SELECT b.doc, b.root, b.i FROM br b JOIN tk h ON h.doc = b.doc AND h.br = b.br AND h.kids AND {counts}),
    nr AS (SELECT doc, root, root AS i FROM rt WHERE depth = 0 UNION SELECT x.doc, x.root, x.br FROM tk x WHERE NOT x.kids AND abs(x.br - x.root) - 1 = (SELECT count(*) FROM tk y WHERE y.doc = x.doc AND y.root = x.root AND NOT y.kids AND y.br > least(x.br, x.root) AND y.br < greatest(x.br, x.root)) {reach}),
    nr0 AS (SELECT n.* FROM nr n JOIN br b ON b.doc = n.doc AND b.i = n.i LEFT JOIN tk t ON t.doc = b.doc AND t.br = b.br WHERE b.i = b.root OR (b.i = b.br AND NOT t.kids)),
    rl AS (SELECT x.doc, x.br, x.root, ({rolls}) AND NOT EXISTS (SELECT 1 FROM ps WHERE ps.doc = x.doc AND ps.root = x.root AND ps.i > least(x.br, x.root) AND ps.i < greatest(x.br, x.root)) AS rolled FROM tk x),
    mm AS (SELECT doc, br AS branch, i FROM br WHERE br <> root UNION SELECT l.doc, l.br, n.i FROM rl l JOIN nr n ON n.doc = l.doc AND n.root = l.root WHERE rolled UNION SELECT doc, root, i FROM nr0)
    SELECT mm.doc, branch, array_to_string(list_sort(list(mm.i)), ',') AS members, coalesce(any_value(rolled), FALSE) AS rolled FROM mm LEFT JOIN rl ON rl.doc = mm.doc AND rl.br = branch GROUP BY mm.doc, branch"""


def highlighted(spark, sf, roll: bool) -> DataFrame:
    t = tagged_trees(spark, sf).withColumn("dep", F.when(F.col("i") % 5 == 0, "acl").otherwise("obj"))
    sets = tours.highlights(t, roll)[1]
    return sets.select("doc", "branch", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), "rolled")


@query(f"WITH RECURSIVE {TREES}, {highlight_sql(False)}")
def highlight_sets(spark, sf):
    """What each branch of the passages' trees shows."""
    return highlighted(spark, sf, False)


@query(f"WITH RECURSIVE {TREES}, {highlight_sql(True)}")
def highlight_sets_rolled(spark, sf):
    return highlighted(spark, sf, True)


# Treebanks.

def phrase_trees(spark, sf) -> tuple[DataFrame, DataFrame]:
    """A tree for each part name (a noun phrase of its words, then a verb phrase of its brand and size) and its words' tags."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("sent_id"), F.split("p_name", " ").alias("w"))
    tag = F.transform("w", lambda x: F.when(F.length(x) % 3 == 0, "ADJ").when(F.length(x) % 3 == 1, "NOUN").otherwise("VERB"))
    p = p.withColumn("g", tag)
    noun = F.array_join(F.transform("w", lambda x, i: F.concat(F.lit("(t "), x, F.lit(")"))), " ")
    tree = F.concat(F.lit("(root (noun "), noun, F.lit(") (verb (v runs) (p on)))"))
    words = p.select("sent_id", F.concat("w", F.array(F.lit("runs"), F.lit("on"))).alias("w"), F.concat("g", F.array(F.lit("VERB"), F.lit("PART"))).alias("g"))
    at = words.select("sent_id", F.posexplode(F.arrays_zip("w", "g")).alias("i", "x")).select("sent_id", "i", F.col("x.w").alias("form"), F.col("x.g").alias("upos"))
    return p.select("sent_id", tree.alias("tree")), at


@query("""WITH p AS (SELECT p_partkey AS sent_id, string_split(p_name, ' ') AS w FROM part), t AS (SELECT sent_id, w, list_transform(w, lambda x: CASE length(x) % 3 WHEN 0 THEN 'ADJ' WHEN 1 THEN 'NOUN' ELSE 'VERB' END) AS g FROM p),
    h AS (SELECT sent_id, w, g, len(w) AS n, coalesce(list_max(list_filter(range(len(w)), lambda i: g[i + 1] IN ('ADJ', 'NOUN'))), len(w) - 1) AS nh FROM t),
    x AS (SELECT sent_id, unnest(range(n + 2))::INTEGER AS i, w, g, n, nh FROM h)
    SELECT sent_id, i, (CASE WHEN i = n THEN -1 WHEN i = n + 1 THEN n WHEN i = nh THEN n ELSE nh END)::INTEGER AS head,
        CASE WHEN i = n THEN 'root' WHEN i = n + 1 THEN 'case' WHEN i = nh THEN CASE g[i + 1] WHEN 'VERB' THEN 'acl' WHEN 'ADJ' THEN 'amod' ELSE 'obl' END ELSE CASE g[i + 1] WHEN 'VERB' THEN 'acl' WHEN 'ADJ' THEN 'amod' ELSE 'compound' END END AS deprel FROM x""")
def tree_arcs(spark, sf):
    """Dependencies of phrase trees: heads percolate up, children of other heads hang on them."""
    t, words = phrase_trees(spark, sf)
    return corpus.arcs(corpus.percolated(corpus.bracket_nodes(t), words), words).select("sent_id", "i", "head", "deprel")


@query("""WITH l AS (SELECT p_partkey AS sent_id, string_split(p_name, ' ') AS w, p_size FROM part), x AS (SELECT sent_id, unnest(range(len(w)))::INTEGER AS i, w, len(w) AS n, p_size FROM l)
    SELECT sent_id, i, CASE WHEN p_size % 2 = 0 THEN CASE WHEN n = 1 THEN 'U-NP' WHEN i = 0 THEN 'B-NP' WHEN i = n - 1 THEN 'L-NP' ELSE 'I-NP' END
        ELSE CASE WHEN n = 1 THEN 'U-NP' WHEN i = 0 THEN 'U-NP' WHEN n = 2 THEN 'U-VP' WHEN i = 1 THEN 'B-VP' WHEN i = n - 1 THEN 'L-VP' ELSE 'I-VP' END END AS tag FROM x""")
def chunk_tags(spark, sf):
    """BILOU tags of part names: even sizes have a noun chunk at their first word, odd ones a verb chunk at the second."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("sent_id"), F.split("p_name", " ").alias("w"), (F.col("p_size") % 2).alias("odd"))
    leaves = p.select("sent_id", F.posexplode("w").alias("i", "token")).withColumn("pos", F.lit("n"))
    chunks = p.filter("odd = 0").select("sent_id", F.lit("NP").alias("label"), F.lit(0).alias("start"), F.lit(1).alias("end")).unionByName(
        p.filter("odd = 1 and size(w) > 1").select("sent_id", F.lit("VP").alias("label"), F.lit(1).alias("start"), F.lit(2).alias("end")))
    return corpus.bilou(leaves, chunks)


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w, (row_number() OVER (ORDER BY p_partkey) - 1) // 50 AS record FROM part),
    r AS (SELECT record, string_agg(array_to_string(w, ' '), ' ' ORDER BY p_partkey) AS t, string_agg(repeat('0', len(w) - 1) || '1', '' ORDER BY p_partkey) AS e FROM p GROUP BY 1) SELECT record, md5(t) AS tokens_md5, e AS ends FROM r""")
def tagged_records(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("sent_id"), F.split("p_name", " ").alias("tokens")).withColumn("tags", F.transform("tokens", lambda t: F.lit("n")))
    return corpus.records(p).select("record", F.md5(F.array_join("tokens", " ")).alias("tokens_md5"), F.array_join(F.col("sent_end_after").cast("array<string>"), "").alias("ends"))


# Boundaries.

KIND = r"CASE WHEN regexp_matches({t}, '[a-zà-öø-ÿ]') THEN 'MY' WHEN regexp_matches({t}, '[\p{{P}}\p{{S}}]') THEN 'PUNCT' WHEN regexp_matches({t}, '\p{{Nd}}') THEN 'DIGIT' WHEN regexp_matches({t}, '[A-Za-z]') THEN 'ASCII' ELSE 'OTHER' END"
GAPS = rf"""gt AS (SELECT doc_id, regexp_extract_all(x, '[^ \t\n\x0b\f\r]+') AS t, regexp_extract_all(x, '[ \t\n\x0b\f\r]+') AS g FROM (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '^[ \t\n\x0b\f\r]+', '') AS x FROM documents)),
    gr AS (SELECT doc_id, k - 1 AS i, t[k] AS token, coalesce(g[k], '') AS gap FROM (SELECT doc_id, t, g, unnest(range(1, len(t) + 1)) AS k FROM gt)),
    ga AS MATERIALIZED (SELECT *, coalesce(sum(length(gap) - length(replace(gap, chr(10), ''))) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line, {KIND.format(t='token')} AS kind,
        regexp_matches(token, '[a-zà-öø-ÿ]') AND regexp_matches(token, '[\p{{P}}\p{{S}}\p{{Nd}}]') AS junk FROM gr),
    ln0 AS (SELECT doc_id, line, count(*) AS total, count(*) FILTER (WHERE kind = 'MY') AS my, count(*) FILTER (WHERE kind IN ('DIGIT', 'PUNCT', 'ASCII')) AS odd FROM ga GROUP BY ALL),
    md AS (SELECT doc_id, coalesce(median(my) FILTER (WHERE my > 0 AND my / total >= 0.5), median(my) FILTER (WHERE my > 0), 0)::DOUBLE AS med, count(*) FILTER (WHERE my > 0 AND my / total >= 0.5) AS nb FROM ln0 GROUP BY 1),
    mm AS (SELECT doc_id, coalesce(median(abs(my - med)) FILTER (WHERE my > 0 AND (my / total >= 0.5 OR nb = 0)), 0)::DOUBLE AS mad FROM ln0 JOIN md USING (doc_id) GROUP BY 1),
    ls AS MATERIALIZED (SELECT doc_id, line, my, my / total AS share, med, mad, med > 0 AND (my < 0.65::DOUBLE * med OR (mad > 0 AND my < med - 1.5::DOUBLE * mad)) AS short, my / total < 0.4::DOUBLE AND odd >= 2 AS header FROM ln0 JOIN md USING (doc_id) JOIN mm USING (doc_id)),
    gp AS (SELECT *, lead(token) OVER w AS nt, lead(kind) OVER w AS nk, lead(line) OVER w AS nl FROM ga WINDOW w AS (PARTITION BY doc_id ORDER BY i))"""


def doc_gaps(spark, sf) -> DataFrame:
    """Tokens and gaps of the documents, put in lower case. The texts are dealt out first, so that a table in one file keeps
    all cores busy."""
    d = table(spark, sf, "documents").select("doc_id", F.lower("text").alias("text")).repartition("doc_id")
    return boundary.gap_arrays(d, LATIN.letter)


@query(f"""WITH {GAPS}, f AS (SELECT p.doc_id, p.i, kind AS prev_t, nk AS next_t, CASE WHEN length(token) <= 1 THEN '<= 1' WHEN length(token) <= 2 THEN '<= 2' WHEN length(token) <= 3 THEN '<= 3' WHEN length(token) <= 5 THEN '<= 5' WHEN length(token) <= 8 THEN '<= 8' WHEN length(token) <= 12 THEN '<= 12' ELSE '> 12' END AS prev_len_b,
        CASE WHEN contains(gap, chr(10) || chr(10)) THEN '1' ELSE '0' END AS gap_blankline, CASE WHEN a.short THEN '1' ELSE '0' END AS cur_line_short, CASE WHEN b.header THEN '1' ELSE '0' END AS next_line_headerish,
        CASE WHEN b.share >= 0.9::DOUBLE THEN '>=0.9' WHEN b.share >= 0.7::DOUBLE THEN '>=0.7' WHEN b.share >= 0.5 THEN '>=0.5' WHEN b.share >= 0.3::DOUBLE THEN '>=0.3' ELSE '<0.3' END AS next_line_ratio
        FROM gp p JOIN ls a ON a.doc_id = p.doc_id AND a.line = p.line JOIN ls b ON b.doc_id = p.doc_id AND b.line = p.nl WHERE nt IS NOT NULL)
    SELECT prev_t, next_t, prev_len_b, gap_blankline, cur_line_short, next_line_headerish, next_line_ratio, count(*) AS n, sum(i)::BIGINT AS places FROM f GROUP BY ALL""")
def gap_feature_counts(spark, sf):
    """How often values of some gap features stand together in the documents, and the sum of the places where they do."""
    names = ["prev_t", "next_t", "prev_len_b", "gap_blankline", "cur_line_short", "next_line_headerish", "next_line_ratio"]
    f = boundary.gap_features(doc_gaps(spark, sf), names)
    return f.select("i", *(F.col("features")[n].alias(n) for n in names)).groupBy(*names).agg(F.count("*").alias("n"), F.sum("i").cast("long").alias("places"))


@query(f"""WITH {GAPS}, l AS (SELECT p.doc_id, p.i, CASE WHEN contains(gap, chr(10)) AND (a.short OR a.header OR contains(gap, chr(10) || chr(10))) THEN 'PARA_END' WHEN kind = 'MY' AND (junk OR nk <> 'MY') THEN 'SENT_END' ELSE 'O' END AS label
        FROM gp p JOIN ls a ON a.doc_id = p.doc_id AND a.line = p.line WHERE nt IS NOT NULL), k AS (SELECT doc_id FROM l GROUP BY 1 HAVING count(*) >= 4 AND count(*) FILTER (WHERE label <> 'O') > 0)
    SELECT doc_id, label, count(*) AS n, sum(i)::BIGINT AS places FROM l SEMI JOIN k USING (doc_id) GROUP BY ALL""")
def silver_labels(spark, sf):
    return boundary.silver_labels(doc_gaps(spark, sf)).groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.sum("i").cast("long").alias("places"))


@query(f"""WITH {GAPS}, f AS (SELECT doc_id, token, min(i) AS first FROM ga WHERE CASE WHEN kind = 'MY' THEN junk ELSE length(token) <= 8 END GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS r FROM f)
    SELECT doc_id, token, first::INTEGER AS first FROM r WHERE r <= 40""")
def junk_tokens(spark, sf):
    return boundary.junk_pool(boundary.gaps(doc_gaps(spark, sf)), 40).select("doc_id", "token", F.col("first").cast("int").alias("first"))


EDGE = r"[\p{P}\p{S}\s\x{200B}-\x{200D}\x{FEFF}]+"
TALKS = rf"""tw AS (SELECT conv_id * 1000 + turn AS id, string_split_regex(trim(lower(coalesce(text, '')), ' '), ' +') AS w FROM conversations), tt AS (SELECT id, k - 1 AS i, w[k] AS token, CASE WHEN regexp_matches(w[k], '[.!?]$') THEN 1 ELSE 0 END AS y FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS k FROM tw) WHERE w[k] <> ''),
    ty AS (SELECT *, regexp_replace(token, '^{EDGE}|{EDGE}$', '', 'g') AS n FROM tt)"""


def talk(spark, sf) -> DataFrame:
    """(id, i, token, y): what spaces part in the conversations, 1 where a token ends a sentence."""
    t = table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.split(F.trim(F.lower(F.coalesce("text", F.lit("")))), " +").alias("w"))
    return t.select("id", F.posexplode("w").alias("i", "token")).filter("token <> ''").withColumn("y", F.when(F.col("token").rlike("[.!?]$"), 1).otherwise(0))


@query(rf"""WITH {TALKS}, s AS (SELECT *, coalesce(sum(y) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM ty),
    c AS (SELECT id, sentence FROM s GROUP BY ALL HAVING max(y) = 1), k AS (SELECT s.* FROM s SEMI JOIN c USING (id, sentence) WHERE n <> '' AND (regexp_matches(n, '[a-zà-öø-ÿ]') OR regexp_matches(n, '\p{{Nd}}'))),
    l AS (SELECT id, sentence, arg_max(n, i) AS last, max(i) AS li FROM k GROUP BY ALL) SELECT k.id, k.sentence::BIGINT AS sentence, count(*) AS n, sum(CASE WHEN i = li OR n = 'the' THEN 1 ELSE 0 END)::BIGINT AS ends
    FROM k JOIN l ON l.id = k.id AND l.sentence = k.sentence WHERE ends_with(last, 'e') OR last IN ('and', 'of') GROUP BY ALL""")
def ending_sentences(spark, sf):
    """Sentences of the conversations that end in certain words; "the" ends one inside, too."""
    enders = spark.createDataFrame([("and",), ("of",)], "token string")
    s = boundary.ending_sentences(talk(spark, sf), enders, ["the"], LATIN.letter, ["e"], "id")
    return s.groupBy("id", "sentence").agg(F.count("*").alias("n"), F.sum("y").alias("ends"))


@query(f"""WITH {TALKS}, l AS (SELECT *, lag(y) OVER (PARTITION BY id ORDER BY i) AS py FROM (SELECT id, i, n AS token, y FROM ty)), j AS (SELECT *, coalesce(length(token) = 3 AND token = 'the' AND y = 1 AND py = 0, FALSE) AS j FROM l),
    k AS (SELECT *, coalesce(lead(j) OVER (PARTITION BY id ORDER BY i), FALSE) AS nj FROM j), c AS (SELECT DISTINCT id FROM k WHERE j)
    SELECT id, count(*) AS n, md5(string_agg(CASE WHEN nj THEN token || 'the' ELSE token END, ' ' ORDER BY i)) AS tokens_md5, sum(CASE WHEN nj THEN 1 ELSE y END)::BIGINT AS ends FROM k SEMI JOIN c USING (id) WHERE NOT j GROUP BY 1""")
def merged_enders(spark, sf):
    t = talk(spark, sf).withColumn("token", tx.strip_edges(F.col("token")))
    m = boundary.merged_enders(t, "the", "id")
    joined = F.array_join(F.array_sort(F.collect_list(F.struct("i", "token")))["token"], " ")
    return m.groupBy("id").agg(F.count("*").alias("n"), F.md5(joined).alias("tokens_md5"), F.sum("y").alias("ends"))


@query(rf"""WITH m AS (SELECT doc_id, string_split_regex(replace(lower(coalesce(text, '')), '. ', ' <SENT_END> '), '[ \t\n\x0b\f\r]+') AS w FROM documents), t AS (SELECT doc_id, k AS i, w[k] AS token FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM m) WHERE w[k] <> ''),
    g AS (SELECT *, token = '<SENT_END>' AS mk, regexp_replace(token, '^{EDGE}|{EDGE}$', '', 'g') AS n FROM t), k AS (SELECT *, NOT mk AND n <> '' AND (regexp_matches(n, '[a-zà-öø-ÿ]') OR regexp_matches(n, '\p{{Nd}}')) AS good FROM g),
    p AS (SELECT *, sum(good::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS c, first_value(CASE WHEN good THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nx FROM k),
    x AS (SELECT doc_id, c, coalesce(nx IN ('the', 'and'), FALSE) AS ig FROM p WHERE mk AND c > 0), gold AS (SELECT DISTINCT doc_id, c - 1 AS k FROM x WHERE NOT ig), guess AS (SELECT doc_id, c - 1 AS k FROM p WHERE good AND length(token) % 4 = 0)
    SELECT count(*) AS gold, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM guess WHERE guess.doc_id = gold.doc_id AND guess.k = gold.k)) AS missed, (SELECT count(*) FROM guess) AS predicted, (SELECT count(*) FROM x WHERE ig) AS ignored FROM gold""")
def marker_scores(spark, sf):
    """Markers for periods in the documents against a guess: kept tokens whose length is a multiple of four."""
    d = table(spark, sf, "documents").repartition("doc_id").select("doc_id", F.replace(F.lower(F.coalesce("text", F.lit(""))), F.lit(". "), F.lit(" <SENT_END> ")).alias("text"))
    t = d.select("doc_id", F.posexplode_outer(F.filter(F.split("text", r"[ \t\n\x0b\f\r]+"), lambda x: x != "")).alias("i", "token")).filter("i is not null")
    kept = t.filter((F.col("token") != "<SENT_END>") & boundary.keeps(F.col("token"), LATIN.letter))
    kept = kept.select("doc_id", "i", (F.length("token") % 4 == 0).alias("hit"))
    guess = kept.withColumn("k", F.row_number().over(W.partitionBy("doc_id").orderBy("i")) - 1).filter("hit")
    return boundary.marker_scores(d, guess, ["the", "and"], LATIN.letter)


@query(f"""WITH l AS (SELECT doc_id, k - 1 AS line, regexp_extract_all(s[k], '{WORD}') AS w FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS k FROM (SELECT doc_id, string_split(lower(coalesce(text, '')), chr(10)) AS s FROM documents))),
    m AS (SELECT doc_id, median(len(w)) AS med FROM l WHERE len(w) > 0 GROUP BY 1), r AS (SELECT l.doc_id, line, len(w) AS n, coalesce(len(w) > 0 AND len(w) < 0.6::DOUBLE * med, FALSE) AS short FROM l LEFT JOIN m USING (doc_id))
    SELECT doc_id, short, count(*) AS lines, sum(greatest(n, 1))::BIGINT AS tokens, sum(CASE WHEN n = 0 THEN 1 ELSE 0 END)::BIGINT AS blank FROM r GROUP BY ALL""")
def line_extras(spark, sf):
    """Lines of the documents by whether they are short, with their tokens; blank ones are one empty token."""
    t = boundary.raw_lines(table(spark, sf, "documents").withColumn("text", F.lower("text")), LATIN.word)
    return t.groupBy("doc_id", "short").agg(F.count_if("last_in_line").alias("lines"), F.count("*").alias("tokens"), F.count_if(F.col("token") == "").alias("blank"))


@query(f"""WITH {BENCH}, u AS (SELECT token, count(*) AS n FROM btok GROUP BY 1), r AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) AS rank FROM u), e AS (SELECT * FROM r WHERE rank <= 300), w AS (SELECT b.item_id, b.i, b.token AS n, e.rank FROM btok b LEFT JOIN e USING (token)),
    f AS (SELECT *, lag(n) OVER x AS p, lead(n) OVER x AS q, ends_with(n, 'e') AS fin FROM w WINDOW x AS (PARTITION BY item_id ORDER BY i))
    SELECT item_id, i, n, right(n, 2) AS suf2, CASE WHEN fin THEN 'True' ELSE 'False' END AS final, CASE WHEN rank IS NULL THEN NULL WHEN rank <= 10 THEN '10' WHEN rank <= 50 THEN '50' WHEN rank <= 200 THEN '200' ELSE 'more' END AS bucket, p || '_' || n AS before, n || '_' || q AS after FROM f""")
def word_features(spark, sf):
    """Features of the passages' words: words in -e are final, the 300 most frequent are the list of ends."""
    t = tx.tokens(table(spark, sf, "benchmark"), LATIN, "item_id").withColumn("upos", F.lit("X")).withColumn("tag", F.lit("X")).checkpoint()
    top = lm.unigrams(t).orderBy(F.desc("n"), "token").limit(300)
    ranks = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n"), "token")))
    finals = t.select("token").distinct().filter("token like '%e'").withColumn("kind", F.lit("stc"))
    f = F.col("features")
    out = boundary.word_features(t, finals, {"chron": ranks}, key="item_id")
    return out.select("item_id", "i", f["n"].alias("n"), f["suf2"].alias("suf2"), f["gram_final_any"].alias("final"), f["chron_rank_bucket"].alias("bucket"), f["n_-1_0"].alias("before"), f["n_0_+1"].alias("after"))


DRAW = "(1 + ((x * x % 2147483647) * (x * x % 2147483647) % 2147483647 * x % 2147483647) * 4 // 2147483647)"


@query(f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM documents), s AS (SELECT 0::BIGINT AS start UNION ALL SELECT start + {DRAW} FROM (SELECT start, (start % 2147483647 * 48271 + 7) % 2147483647 AS x FROM s), n WHERE start + {DRAW} < n),
    d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS nth FROM documents) SELECT doc_id, start FROM d ASOF JOIN s ON d.nth >= s.start""")
def random_groups(spark, sf):
    """The documents in groups of one to four neighbours."""
    return boundary.concatenated(table(spark, sf, "documents").select("doc_id"), 4, 7, block=256)


# Labels.

LABELS = ["n", "v|n", "noun, adj", "adv", "postp", "particle", "conj", "prefix", "x", "", "PROPN", "num+tn", "exp;int", "Unknown", "CONJ", "verb/aux"]


def labelled_parts(spark, sf) -> DataFrame:
    """Parts with a dictionary label each, in turn."""
    return table(spark, sf, "part").select("p_partkey", F.col("p_name").alias("name"), F.element_at(F.array(*map(F.lit, LABELS)), (F.col("p_partkey") % len(LABELS) + 1).cast("int")).alias("label"))


def _case(table_: dict[str, str], value: str) -> str:
    return "CASE " + value + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table_.items()) + " END"


LBL = "lb AS (SELECT p_partkey, [" + ", ".join(f"'{x}'" for x in LABELS) + f"][p_partkey % {len(LABELS)} + 1] AS label FROM part)"


@query(rf"""WITH {LBL}, a AS (SELECT *, list_filter(string_split_regex(label, '[,;+/ ]+'), lambda x: x <> '') AS c, list_filter(string_split_regex(lower(label), '[,;+/| ]+'), lambda x: x <> '') AS u FROM lb)
    SELECT p_partkey, CASE WHEN regexp_matches(label, '(?i)^(n|noun|v|verb|adj|adjective|adv|adverb|num|number|pron|pronoun|aux|auxiliary|prep|preposition|postp|postposition|conj|conjunction|interj|interjection|part|particle|det|determiner|prefix|suffix|m|nm)\b') THEN label ELSE '' END AS white,
        CASE WHEN regexp_matches(lower(label), '^(postp|prep)') THEN 'CASE' WHEN starts_with(lower(label), 'part') THEN 'VPART' WHEN regexp_matches(lower(label), '^(conj|det)') THEN 'LINK' WHEN regexp_matches(lower(label), '^(prefix|suffix)') THEN 'BOUND' ELSE '' END AS meta,
        CASE WHEN len(c) = 0 THEN 'UNKNOWN' ELSE array_to_string(list_sort(list_distinct(list_transform(c, lambda x: coalesce({_case(tags.COARSE, 'lower(x)')}, 'UNKNOWN')))), '|') END AS coarse,
        CASE WHEN lower(label) IN ('', 'unknown') THEN '' ELSE array_to_string(list_sort(list_distinct(list_filter(list_transform(u, lambda x: coalesce({_case(tags.TO_UPOS, 'x')}, CASE WHEN upper(x) IN ({', '.join(f"'{x}'" for x in tags.UPOS)}) THEN upper(x) END)), lambda x: x IS NOT NULL))), '|') END AS upos FROM a""")
def label_maps(spark, sf):
    p, c = labelled_parts(spark, sf), F.col("label")
    return p.select("p_partkey", tags.whitelisted(c).alias("white"), tags.meta_pos(c).alias("meta"), F.array_join(tags.coarse(c), "|").alias("coarse"), F.array_join(tags.upos_of(c), "|").alias("upos"))


@query(f"""WITH {LBL}, p AS (SELECT p_name AS token, p_partkey, label, lower(label) AS l FROM lb JOIN part USING (p_partkey)), f AS (SELECT *, CASE WHEN l IN ('', 'unknown') THEN [] ELSE list_filter(list_transform(string_split_regex(l, '[,;+/| ]+'), lambda x: coalesce({_case(tags.TO_UPOS, 'x')}, CASE WHEN upper(x) IN ({', '.join(f"'{x}'" for x in tags.UPOS)}) THEN upper(x) END)), lambda x: x IS NOT NULL) END AS t FROM p),
    g AS (SELECT token, list_distinct(flatten(list(t))) AS u, bool_or(len(t) = 0) AS some_none, bool_and(len(t) = 0) AS none, count(*) AS n FROM f GROUP BY 1),
    d AS (SELECT token, CASE WHEN none THEN 'no_pos' WHEN n > 1 AND some_none THEN 'partial' WHEN n > 1 THEN 'multi_fill' ELSE 'single' END AS source, CASE WHEN none OR (n > 1 AND some_none) THEN [] ELSE u END AS u FROM g)
    SELECT token, source, array_to_string(list_sort(list_distinct(list_concat(u, CASE WHEN len(list_intersect(u, ['NOUN', 'PROPN', 'NUM'])) > 0 THEN ['NOUN', 'PROPN', 'NUM'] ELSE [] END, CASE WHEN len(list_intersect(u, ['SCONJ', 'CCONJ'])) > 0 THEN ['SCONJ', 'CCONJ'] ELSE [] END))), '|') AS allowed FROM d""")
def allowed_decisions(spark, sf):
    """Parts of one name as the fills of a token: which tags they allow, and why."""
    fills = labelled_parts(spark, sf).select(F.col("name").alias("token"), F.col("p_partkey").alias("k"), "label")
    return tagging.decided(fills).select("token", "source", F.array_join("allowed", "|").alias("allowed"))


@query("""WITH e AS (SELECT user_id AS doc, event_id AS i, event_type AS t, value FROM events), s AS (SELECT doc, t, sum(value) AS v FROM e WHERE t <> 'error' GROUP BY ALL), lo AS (SELECT doc, least(min(v), 0) AS lo FROM s GROUP BY 1),
    h AS (SELECT doc, t, v - lo AS v FROM s JOIN lo USING (doc)), m AS (SELECT doc, max(v) AS m FROM h GROUP BY 1), a AS (SELECT doc, t, CASE WHEN m > 0 THEN v / m ELSE 0 END AS sc FROM h JOIN m USING (doc)),
    c AS (SELECT doc, t, count(*) AS n FROM e WHERE t IN ('view', 'click') GROUP BY ALL), cm AS (SELECT doc, max(n) AS m FROM c GROUP BY 1), b AS (SELECT c.doc, c.t, 0.5::DOUBLE * coalesce(sc, 0) + 0.5::DOUBLE * n / m AS bl FROM c JOIN cm USING (doc) LEFT JOIN a ON a.doc = c.doc AND a.t = c.t),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY bl DESC, t) AS r FROM b) SELECT doc, t AS tag, round(bl, 5) AS score FROM r WHERE r = 1""")
def blended_tags(spark, sf):
    """Event types of a user as a compound's tags: logits by value, parts' counts of the allowed ones, half of each."""
    e = table(spark, sf, "events").select(F.col("user_id").alias("doc"), F.lit(0).alias("i"), F.col("event_type").alias("label"), "value")
    logits = e.filter("label <> 'error'").groupBy("doc", "i", "label").agg(F.sum("value").alias("logit"))
    parts = e.filter("label in ('view', 'click')").groupBy("doc", "i", "label").agg(F.count("*").cast("double").alias("score"))
    return tagging.blended(logits, parts).select("doc", "tag", F.round("score", 5).alias("score"))


# Sets.

@query(f"WITH {LAYERS} SELECT DISTINCT headword FROM lay")
def layer_words(spark, sf):
    return lexicon.all_words([layers(spark, sf).filter(F.col("layer") == x) for x in ("user", "mmd", "wiktionary")])


@query(f"WITH {LAYERS}, d AS (SELECT DISTINCT layer, headword FROM lay) SELECT headword, count(*) AS n FROM d GROUP BY 1 HAVING count(*) > 1")
def shared_keys(spark, sf):
    """Headwords that more than one layer holds: what a disjoint union must not find."""
    return lexicon.duplicate_keys(layers(spark, sf).select("layer", "headword").distinct(), "headword")


# Text in the script.

@query(f"WITH c AS (SELECT unnest(regexp_extract_all({MY_SQL}, '[က-ဿ၊-႟][ါ-ှၖ-ၙၞ-ၠၢ-ၤၧ-ၭၱ-ၴႂ-ႍႏ႔ႚ-ႝ]*|[^က-ဿ၊-႟][^က-႟]*')) AS cluster FROM documents) SELECT cluster, count(*) AS n FROM c GROUP BY 1")
def script_clusters(spark, sf):
    """Grapheme clusters of the documents in Myanmar letters."""
    return script_docs(spark, sf).select(F.explode_outer(tx.clusters(F.col("text"), MYANMAR)).alias("cluster")).filter("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n"))


@query(f"""WITH w AS (SELECT unnest(string_split(regexp_replace({MY_SQL}, '[^\\n က-႟]', ' ', 'g'), ' ')) AS w FROM documents), o AS (SELECT regexp_extract(w, '[{clean.ONSETS}]') AS o FROM w WHERE w <> '')
    SELECT nullif(o, '') AS onset, count(*) AS n FROM o GROUP BY 1""")
def script_onsets(spark, sf):
    """First consonants of what spaces part in the documents in Myanmar letters."""
    w = script_docs(spark, sf).select(F.explode_outer(F.split(clean.keep_newlines(F.col("text"), "က-႟"), " ")).alias("w")).filter("w <> ''")
    return w.groupBy(clean.first_onset(F.col("w")).alias("onset")).agg(F.count("*").alias("n"))


@query(f"""WITH k AS (SELECT doc_id, regexp_replace(replace({MY_SQL}, chr(13), ''), '[^\\nက-႟ꧠ-꧿ꩠ-ꩿ]', ' ', 'g') AS t FROM documents),
    c AS (SELECT doc_id, regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t]+', ' ', 'g'))), chr(10)), '^[ \\n]+|[ \\n]+$', '', 'g') AS t FROM k) SELECT doc_id, length(t)::INTEGER AS n, md5(t) AS text_md5 FROM c""")
def script_lines(spark, sf):
    """The documents in Myanmar letters with all else as single spaces, line ends kept."""
    t = clean.collapse_spaces(clean.keep_newlines(F.col("text")))
    return script_docs(spark, sf).select("doc_id", t.alias("t")).select("doc_id", F.length("t").alias("n"), F.md5("t").alias("text_md5"))


FOLLOW, ONCE = r"\x{102B}-\x{103E}\x{1056}-\x{1059}", r"\x{102B}\x{102C}\x{102D}\x{102E}\x{102F}\x{1030}\x{1032}\x{1036}\x{1037}\x{1038}\x{103A}"


@query(rf"""WITH n AS (SELECT doc_id, nfc_normalize(replace(replace({MY_SQL}, chr(4160), chr(4125)), chr(176), '')) AS t FROM documents),
    k AS (SELECT doc_id, regexp_replace(regexp_replace(t, '[^ \t-\r\x{{1000}}-\x{{109F}}\x{{A9E0}}-\x{{A9FF}}\x{{AA60}}-\x{{AA7F}}]', '', 'g'), '[ \t-\r]+', ' ', 'g') AS t FROM n),
    c AS (SELECT doc_id, regexp_extract_all(regexp_replace(t, '(^|[ \x{{104A}}\x{{104B}}])[{FOLLOW}]+', '\1', 'g'), '[^{FOLLOW}][{FOLLOW}]*') AS c FROM k),
    o AS (SELECT doc_id, trim(regexp_replace(array_to_string(list_transform(c, lambda x: array_to_string(list_filter(regexp_extract_all(x, '(?s).'), lambda m, i: NOT regexp_matches(m, '^[{ONCE}]$') OR list_position(regexp_extract_all(x, '(?s).'), m) = i), '')), ''), ' +', ' ', 'g')) AS t FROM c)
    SELECT doc_id, length(t)::INTEGER AS n, md5(t) AS text_md5 FROM o""")
def script_ocr_cleaned(spark, sf):
    """The documents in Myanmar letters, cleaned as scanned text."""
    return script_docs(spark, sf).select("doc_id", clean.ocr_clean(F.col("text")).alias("t")).select("doc_id", F.length("t").alias("n"), F.md5("t").alias("text_md5"))


@query("WITH t AS (SELECT doc_id, nfc_normalize(replace(replace(coalesce(text, ''), 'é', 'e' || chr(769)), 'ñ', 'n' || chr(771))) AS t FROM documents) SELECT doc_id, length(t)::INTEGER AS n, md5(t) AS text_md5 FROM t")
def nfc_texts(spark, sf):
    """The documents with some letters taken apart, composed again."""
    apart = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("é"), F.lit("é")), F.lit("ñ"), F.lit("ñ"))
    return table(spark, sf, "documents").select("doc_id", tx.nfc(apart).alias("t")).select("doc_id", F.length("t").alias("n"), F.md5("t").alias("text_md5"))


@query()
def script_romanized(spark, sf):
    """Distinct words of the passages in Myanmar letters and in Latin ones again, by sound."""
    w = script_docs(spark, sf, "benchmark", "item_id").select(F.explode(F.regexp_extract_all("text", F.lit(MYANMAR.word), F.lit(0))).alias("word")).distinct()
    return w.select("word", romanized(F.col("word")).alias("roman"))


@query("""WITH RECURSIVE e AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, event_id, json_extract_string(props, '$.k') AS word, CASE WHEN event_type <> 'error' THEN event_type END AS tag FROM events),
    sn AS (SELECT word, tag, count(*) AS n FROM e WHERE tag IS NOT NULL GROUP BY 1, 2), st AS (SELECT word, tag, ln(n / sum(n) OVER (PARTITION BY word)) AS score FROM sn),
    un AS (SELECT tag, count(*) AS total FROM e WHERE tag IS NOT NULL GROUP BY 1), sz AS (SELECT count(*) AS tags FROM un), pr AS (SELECT tag, lag(tag) OVER (PARTITION BY doc ORDER BY i) AS prev FROM e),
    mv AS (SELECT prev, p.tag, ln((count(*) + 0.1::DOUBLE) / (any_value(total) + 0.1::DOUBLE * any_value(tags))) AS logp FROM pr p JOIN un u ON u.tag = p.prev, sz WHERE prev IS NOT NULL AND p.tag IS NOT NULL GROUP BY prev, p.tag),
    c AS (SELECT e.doc, dense_rank() OVER (PARTITION BY e.doc ORDER BY e.i) AS k, e.i, s.tag, s.score FROM e JOIN st s ON s.word = e.word), m AS (SELECT doc, max(k) AS m FROM c GROUP BY 1),
    v AS (SELECT doc, k, tag, score, [tag] AS path FROM c WHERE k = 1 UNION ALL SELECT doc, k, tag, -b.x, list_append(b.path, tag) FROM (
        SELECT n.doc, n.k, n.tag, min({'x': -(v.score + 0.7::DOUBLE * coalesce(mv.logp, ln(1e-4)) + n.score), 'p': v.tag, 'path': v.path}) AS b FROM v JOIN c n ON n.doc = v.doc AND n.k = v.k + 1 LEFT JOIN mv ON mv.prev = v.tag AND mv.tag = n.tag GROUP BY n.doc, n.k, n.tag)),
    w AS (SELECT doc, b.path AS path FROM (SELECT v.doc, min({'x': -score, 't': tag, 'path': path}) AS b FROM v JOIN m ON m.doc = v.doc AND k = m GROUP BY 1))
    SELECT e.doc, e.i::INTEGER AS i, path[c.k] AS tag FROM e LEFT JOIN (SELECT DISTINCT doc, i, k FROM c) c ON c.doc = e.doc AND c.i = e.i LEFT JOIN w ON w.doc = e.doc""")
def viterbi_events(spark, sf):
    """Best tag sequences of the users' events by the statistics of all."""
    e = tagged(spark, sf)
    stats = tagging.tag_stats(e.filter("tag is not null")).select("word", F.struct("tag", tagging.logarithm(F.col("p")).alias("score")).alias("c")).groupBy("word").agg(F.array_sort(F.collect_list("c")).alias("candidates"))
    rows = e.join(stats, "word", "left").select(F.col("user_id").alias("doc"), F.row_number().over(W.partitionBy("user_id").orderBy("event_id")).alias("i"), "candidates")
    return tagging.viterbi(rows, tagging.transitions(e, "user_id", "event_id").select("prev", "tag", "logp"))
