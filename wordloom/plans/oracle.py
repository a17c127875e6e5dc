"""DuckDB's counterparts of the queries, on views of the same tables."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}
WORD = "[a-zà-öø-ÿ]+"


def tok(name: str = "tok", table: str = "documents", key: str = "doc_id", id_expr: str | None = None) -> str:
    """A common table (key, i, token)."""
    return f"""{name} AS MATERIALIZED (SELECT {key}, unnest(range(len(w)))::INTEGER AS i, unnest(w) AS token
        FROM (SELECT {id_expr or key} AS {key}, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM {table}))"""


def pcs() -> str:
    """A common table of pieces (doc_id, i, piece, is_word)."""
    return f"""pcs AS (SELECT doc_id, unnest(range(len(w)))::INTEGER AS i, unnest(w) AS piece, regexp_full_match(unnest(w), '{WORD}') AS is_word
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}|[^\\sa-zà-öø-ÿ]+') AS w FROM documents))"""


BENCH = tok("btok", "benchmark", "item_id")
VOC = f"{BENCH}, voc AS (SELECT DISTINCT token AS word FROM btok)"
TALK = tok("ttok", "conversations", "id", "conv_id * 1000 + turn")
UNI = "uni AS (SELECT token, count(*) AS n FROM tok GROUP BY 1)"
UCOST = f"""{UNI}, mass AS (SELECT sum(n) + count(*) AS m FROM uni),
    ucost AS (SELECT token, n, -ln((n + 1) / m) AS cost, -ln(1 / m) AS default_cost FROM uni, mass)"""
#: Neighbours are a text's list zipped with its own tail; no window, and no order of all tokens.
BI = f"""wds AS (SELECT regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents), nxt AS (SELECT unnest(w[1:len(w) - 1]) AS w1, unnest(w[2:]) AS w2 FROM wds WHERE len(w) > 1),
    bi AS MATERIALIZED (SELECT w1, w2, count(*) AS n FROM nxt GROUP BY w1, w2)"""
BCOST = f"""{BI}, v AS (SELECT greatest(count(DISTINCT w2), 1) AS v FROM bi),
    lft AS (SELECT w1, sum(n) + 0.1::DOUBLE * v AS m FROM bi, v GROUP BY w1, v), dflt AS (SELECT w1, -ln(0.1::DOUBLE / m) AS default_cost FROM lft),
    gdef AS (SELECT avg(default_cost) AS global_cost FROM dflt),
    bcost AS MATERIALIZED (SELECT w1, w2, n, -ln((n + 0.1::DOUBLE) / m) AS cost FROM bi JOIN lft USING (w1))"""
def spans(tokens: str = "btok", key: str = "item_id") -> str:
    """A common table spn (phrase, size) of runs of two to four tokens."""
    return f"""bnx AS (SELECT token, lead(token, 1) OVER w AS t1, lead(token, 2) OVER w AS t2, lead(token, 3) OVER w AS t3 FROM {tokens} WINDOW w AS (PARTITION BY {key} ORDER BY i)),
    spn AS (SELECT token || '_' || t1 AS phrase, 2 AS size FROM bnx WHERE t1 IS NOT NULL UNION ALL SELECT token || '_' || t1 || '_' || t2, 3 FROM bnx WHERE t2 IS NOT NULL
        UNION ALL SELECT token || '_' || t1 || '_' || t2 || '_' || t3, 4 FROM bnx WHERE t3 IS NOT NULL)"""


SPANS = spans()
SENT = f"""{pcs()}, snt AS (SELECT *, coalesce(sum(CASE WHEN regexp_matches(piece, '[.!?]') THEN 1 ELSE 0 END)
        OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS sentence FROM pcs)"""
LAYERS = f"""lay AS (
        SELECT 'user' AS layer, 1 AS priority, unnest(list_distinct(regexp_extract_all(lower(p_name), '{WORD}'))) AS headword, p_brand AS roman, p_type AS pos, p_name AS sense, p_partkey AS k FROM part
        UNION ALL SELECT 'mmd', 2, unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))), '', 'n', 'item ' || item_id, item_id FROM benchmark
        UNION ALL SELECT 'wiktionary', 3, unnest(list_distinct(regexp_extract_all(lower(text), '{WORD}'))), '', role, 'said', conv_id * 1000 + turn FROM conversations),
    one AS (SELECT *, row_number() OVER (PARTITION BY layer, headword ORDER BY k, roman, pos, sense) AS r FROM lay),
    poss AS (SELECT layer, headword, string_agg(pos, '|' ORDER BY f) AS pos FROM (SELECT layer, headword, pos, min(r) AS f FROM one WHERE pos <> '' GROUP BY ALL) GROUP BY ALL),
    sens AS (SELECT layer, headword, string_agg(sense, ';' ORDER BY f) AS senses FROM (SELECT layer, headword, sense, min(r) AS f FROM one WHERE sense <> '' GROUP BY ALL) GROUP BY ALL),
    rom AS (SELECT layer, priority, headword, coalesce(arg_min(roman, r) FILTER (WHERE roman <> ''), '') AS roman FROM one GROUP BY ALL),
    ent AS (SELECT layer, priority, headword, roman, pos, senses, row_number() OVER (PARTITION BY headword ORDER BY priority, layer) AS rank
        FROM rom JOIN poss USING (layer, headword) JOIN sens USING (layer, headword))"""
PWORDS = """pw AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part), wrd AS (SELECT word, count(*) AS n FROM pw GROUP BY 1)"""
NAMES = """nam AS (SELECT p_name AS word, count(*) AS n FROM part GROUP BY 1), mis AS (SELECT DISTINCT left(p_name, 3) || substring(p_name, 5) AS query FROM part),
    fnd AS (SELECT query, word, levenshtein(query, word)::INTEGER AS distance FROM mis, nam WHERE levenshtein(query, word) <= 2),
    nm AS (SELECT sum(n) + count(*) AS m FROM nam), ncost AS (SELECT word, -ln((n + 1) / m) AS cost FROM nam, nm)"""
HIER = """hier AS (SELECT 'r' || r_regionkey AS child, NULL::VARCHAR AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
        UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"""
CLOS = f"""{HIER}, clos AS (SELECT parent AS ancestor, child AS node, 1 AS distance FROM hier WHERE parent IS NOT NULL
        UNION ALL SELECT h.parent, c.node, c.distance + 1 FROM clos c JOIN hier h ON h.child = c.ancestor WHERE h.parent IS NOT NULL)"""
TREES = f"""{BENCH}, tre AS (SELECT a.item_id AS doc, a.i, (SELECT min(b.i) FROM btok b WHERE b.item_id = a.item_id AND b.i > a.i AND length(b.token) > length(a.token)) AS head FROM btok a)"""
SEEN = """seen AS (SELECT json_extract_string(props, '$.k') AS head, ts, event_type AS form, event_id AS tie FROM events)"""
SM2 = f"""{SEEN}, rev AS (SELECT head, ts, tie, form = 'purchase' AS knew, row_number() OVER (PARTITION BY head ORDER BY ts, tie) AS k FROM seen WHERE form IN ('purchase', 'error')),
    fold AS (SELECT head, 0::BIGINT AS k, 0 AS repetitions, 0::DOUBLE AS interval_, 2.5::DOUBLE AS ease FROM (SELECT DISTINCT head FROM rev)
        UNION ALL SELECT f.head, r.k, CASE WHEN knew THEN repetitions + 1 ELSE 0 END,
            CASE WHEN NOT knew OR repetitions = 0 THEN 1 WHEN repetitions = 1 THEN 3 ELSE interval_ * ease END, greatest(1.3::DOUBLE, ease + d)
        FROM fold f JOIN (SELECT *, CASE WHEN knew THEN 0.1::DOUBLE - (0.08::DOUBLE + 0.02::DOUBLE) ELSE 0.1::DOUBLE - 3 * (0.08::DOUBLE + 3 * 0.02::DOUBLE) END AS d FROM rev) r ON r.head = f.head AND r.k = f.k + 1),
    fin AS (SELECT head, max(k) AS reviews, arg_max(repetitions, k) AS repetitions, arg_max(interval_, k) AS interval_, arg_max(ease, k) AS ease FROM fold GROUP BY 1),
    lst AS (SELECT head, max(ts) AS last FROM rev GROUP BY 1), sta AS (SELECT * FROM fin JOIN lst USING (head))"""
GRADED = f"""{tok()}, agn AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE same) AS again FROM (SELECT doc_id, token = lag(token) OVER (PARTITION BY doc_id ORDER BY i) AS same FROM tok) GROUP BY 1),
    grd AS (SELECT lang, quality = 1 AS gold, again * 20 < n AS guess FROM labels JOIN documents USING (doc_id) JOIN agn USING (doc_id)),
    cnt AS (SELECT lang, count(*) FILTER (WHERE gold AND guess) AS tp, count(*) FILTER (WHERE NOT gold AND guess) AS fp, count(*) FILTER (WHERE gold AND NOT guess) AS fn FROM grd GROUP BY GROUPING SETS ((lang), ()))"""
PRF = """tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
    round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1"""

ORACLE_SQL |= {
    "tokens_per_doc": f"WITH {tok()} SELECT doc_id, count(*) AS n_tokens, count(DISTINCT token) AS n_types FROM tok GROUP BY 1",
    "islands": f"""WITH {pcs()}, r AS (SELECT *, sum(CASE WHEN is_word THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM pcs),
        g AS (SELECT doc_id, run, min(i) AS first, max(i) AS last, count(*) AS n, string_agg(piece, ' ' ORDER BY i) AS t FROM r WHERE is_word GROUP BY ALL)
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first) - 1)::INTEGER AS island, first, last, n, md5(t) AS text_md5 FROM g""",
    "sentences": f"WITH {SENT} SELECT doc_id, sentence, count(*) FILTER (WHERE is_word) AS n_words, arg_min(piece, i) AS first_piece FROM snt GROUP BY ALL",
    "line_stats_mad": f"""WITH l AS (SELECT doc_id, unnest(range(len(s)))::INTEGER AS line, unnest(s) AS t FROM (SELECT doc_id, string_split(lower(text), chr(10)) AS s FROM documents)),
        c AS (SELECT doc_id, line, len(regexp_extract_all(t, '{WORD}'))::INTEGER AS n FROM l), k AS (SELECT * FROM c WHERE n > 0),
        m AS (SELECT doc_id, median(n)::DOUBLE AS med FROM k GROUP BY 1), b AS (SELECT * FROM k JOIN m USING (doc_id)),
        d AS (SELECT doc_id, median(abs(n - med))::DOUBLE AS mad FROM b GROUP BY 1)
        SELECT doc_id, line, n, med, mad, n < 0.6::DOUBLE * med AS short FROM b JOIN d USING (doc_id)""",
    "text_pages": """WITH RECURSIVE l AS (SELECT doc_id, unnest(range(len(s)))::INTEGER AS k, unnest(s) AS t, len(s) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS s FROM documents)),
        p AS (SELECT doc_id, k, 0 AS page, length(t)::BIGINT AS used FROM l WHERE k = 0
            UNION ALL SELECT l.doc_id, l.k, CASE WHEN p.used + 1 + length(l.t) <= 3000 THEN p.page ELSE p.page + 1 END, CASE WHEN p.used + 1 + length(l.t) <= 3000 THEN p.used + 1 + length(l.t) ELSE length(l.t) END
            FROM p JOIN l ON l.doc_id = p.doc_id AND l.k = p.k + 1),
        j AS (SELECT doc_id, page, string_agg(t, chr(10) ORDER BY k) AS text FROM p JOIN l USING (doc_id, k) GROUP BY ALL)
        SELECT doc_id, page, length(text)::INTEGER AS n_chars, md5(text) AS text_md5 FROM j""",
    "unigrams": f"WITH {tok()} SELECT token, count(*) AS n FROM tok GROUP BY 1",
    "bigrams": f"WITH {tok()}, {BI} SELECT w1, w2, n FROM bi",
    "spans_2_4": f"WITH {tok()}, {spans('tok', 'doc_id')} SELECT phrase, size, count(*) AS n FROM spn GROUP BY ALL",
    "unigram_cost": f"WITH {tok()}, {UCOST} SELECT token, n, round(cost, 6) AS cost, round(default_cost, 6) AS default_cost FROM ucost",
    "bigram_cost": f"""WITH {BCOST} SELECT w1, w2, n, round(cost, 6) AS cost, round(default_cost, 6) AS default_cost, round(global_cost, 6) AS global_cost
        FROM bcost JOIN dflt USING (w1), gdef""",
    "bigram_backoff": f"""WITH {tok()}, {UCOST}, {BCOST}, {BENCH}, q AS (SELECT token AS w1, lead(token) OVER (PARTITION BY item_id ORDER BY i) AS w2 FROM btok),
        a AS (SELECT DISTINCT w1, w2 FROM q WHERE w2 IS NOT NULL), un AS (SELECT any_value(default_cost) AS unseen FROM ucost)
        SELECT a.w1, a.w2, round(coalesce(b.cost, coalesce(d.default_cost, global_cost) + 0.5 * coalesce(u.cost, unseen)), 6) AS cost,
            CASE WHEN b.cost IS NOT NULL THEN 'pair' WHEN d.default_cost IS NOT NULL THEN 'left' ELSE 'global' END AS source
        FROM a LEFT JOIN bcost b ON a.w1 = b.w1 AND a.w2 = b.w2 LEFT JOIN dflt d ON d.w1 = a.w1 LEFT JOIN ucost u ON u.token = a.w2, gdef, un""",
    "rarity": f"""WITH {tok()}, {UCOST}, b AS (SELECT min(cost) AS lo, max(cost) AS hi FROM ucost)
        SELECT token, round(least(greatest(coalesce((cost - lo) / nullif(hi - lo, 0), 1 / (1 + exp(-(cost - 8) / 3))), 0), 1), 6) AS rarity FROM ucost, b""",
    "collocations": f"""WITH {BCOST}, s AS (SELECT w1, w2, exp(-greatest(cost - 5, 0) / 3) AS s FROM bcost) SELECT w1, w2, round(s, 6) AS strength FROM s WHERE s > 0.02::DOUBLE""",
    "lexicon_resolve": f"WITH {LAYERS} SELECT headword, layer, priority, roman, pos, senses FROM ent WHERE rank = 1",
    "lexicon_all": f"WITH {BENCH}, {LAYERS}, t AS (SELECT DISTINCT token FROM btok) SELECT token, layer, rank::INTEGER AS rank, pos FROM t JOIN ent ON token = headword",
    "known_tokens": f"WITH {tok()}, {VOC}, {UNI} SELECT token, n FROM uni WHERE token IN (SELECT word FROM voc)",
    "unknown_tokens": f"WITH {tok()}, {VOC} SELECT doc_id, count(*) AS n_unknown, min(i) AS first_i FROM tok WHERE NOT EXISTS (SELECT 1 FROM voc WHERE word = token) GROUP BY 1",
    "unknown_summary": f"""WITH {tok()}, {VOC} SELECT token, count(*) AS n, count(DISTINCT doc_id) AS docs, min(i) AS first_i FROM tok
        WHERE NOT EXISTS (SELECT 1 FROM voc WHERE word = token) AND length(token) <= 30 GROUP BY 1""",
    "unknown_runs": f"""WITH {tok()}, {VOC}, m AS (SELECT doc_id, i, token, word IS NOT NULL AS k FROM tok LEFT JOIN voc ON word = token),
        b AS (SELECT *, CASE WHEN k OR coalesce(lag(k) OVER (PARTITION BY doc_id ORDER BY i), TRUE) THEN 1 ELSE 0 END AS b FROM m),
        r AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b)
        SELECT doc_id, min(i) AS first, count(*) AS n, string_agg(token, '' ORDER BY i) AS token, any_value(k) AS is_known FROM r GROUP BY doc_id, run""",
    "max_match": f"""WITH RECURSIVE {PWORDS}, t AS (SELECT DISTINCT replace(p_name, ' ', '') AS text FROM part),
        s AS (SELECT text, '' AS done, 0 AS pos FROM t UNION ALL
            SELECT text, CASE WHEN done = '' THEN w ELSE done || ' ' || w END, pos + length(w) FROM (
                SELECT s.text, s.done, s.pos, coalesce((SELECT arg_max(word, length(word)) FROM wrd WHERE starts_with(substring(s.text, s.pos + 1), word)), substring(s.text, s.pos + 1, 1)) AS w FROM s WHERE s.pos < length(s.text))),
        f AS (SELECT text, done FROM s WHERE pos = length(text))
        SELECT p_partkey, done AS words FROM part JOIN f ON f.text = replace(p_name, ' ', '')""",
    "dp_segment": f"""WITH RECURSIVE {PWORDS}, wm AS (SELECT sum(n) + count(*) AS m FROM wrd), wc AS (SELECT word, 1 + 0.2::DOUBLE * least(-ln((n + 1) / m), 15) AS c FROM wrd, wm),
        t AS (SELECT DISTINCT replace(p_name, ' ', '') AS text FROM part),
        pl AS (SELECT text, unnest(range(length(text))) AS i FROM t), lat AS (SELECT text, i, unnest(range(i + 1, least(length(text), i + 16) + 1)) AS j FROM pl),
        pr AS (SELECT text, i, j, coalesce(c, 5 + 0.2::DOUBLE * 15 + (j - i - 1) * 10) AS c FROM lat LEFT JOIN wc ON word = substring(text, i + 1, j - i)),
        dp AS (SELECT text, length(text) AS i, MAP {{length(text): 0::DOUBLE}} AS best, MAP {{length(text): length(text)}} AS nxt FROM t
            UNION ALL SELECT text, i, map_concat(best, MAP {{i: x.cost}}), map_concat(nxt, MAP {{i: x.j}}) FROM (
                SELECT d.text, d.i - 1 AS i, d.best, d.nxt, (SELECT {{'cost': min(p.c + d.best[p.j]), 'j': arg_min(p.j, {{'c': p.c + d.best[p.j], 'j': p.j}})}} FROM pr p WHERE p.text = d.text AND p.i = d.i - 1) AS x
                FROM dp d WHERE d.i > 0)),
        w AS (SELECT text, nxt, 0::BIGINT AS pos, '' AS done FROM dp WHERE i = 0 UNION ALL
            SELECT text, nxt, nxt[pos], CASE WHEN done = '' THEN '' ELSE done || ' ' END || substring(text, pos + 1, nxt[pos] - pos) FROM w WHERE pos < length(text))
        SELECT p_partkey, done AS words FROM part JOIN w ON w.text = replace(p_name, ' ', '') WHERE pos = length(w.text)""",
    "fuzzy_equals_exhaustive": f"WITH {NAMES} SELECT query, word, distance FROM fnd",
    "fuzzy_two_tier": f"""WITH {NAMES} SELECT query, word, distance FROM fnd f WHERE distance = 1 OR (distance = 2 AND NOT EXISTS (SELECT 1 FROM fnd g WHERE g.query = f.query AND g.distance = 1))""",
    "spell_distance_first": f"""WITH {NAMES}, k AS (SELECT *, rank() OVER (PARTITION BY query ORDER BY distance) AS t FROM fnd),
        r AS (SELECT query, word, distance, row_number() OVER (PARTITION BY query ORDER BY cost, word)::INTEGER AS rank FROM k JOIN ncost USING (word) WHERE t = 1) SELECT * FROM r WHERE rank <= 5""",
    "spell_topk": f"""WITH {NAMES}, s AS (SELECT *, 1 - distance / greatest(length(query), length(word)) AS sim FROM fnd WHERE distance > 0),
        p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, sim DESC, word) AS pos FROM s),
        t AS (SELECT query, word, distance, sim, 0.5::DOUBLE * distance + 0.5::DOUBLE * cost AS total FROM p JOIN ncost USING (word) WHERE pos <= 50),
        r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY total, distance, sim DESC, word)::INTEGER AS rank FROM t),
        e AS (SELECT *, exp(min(total) OVER (PARTITION BY query) - total) AS e FROM r WHERE rank <= 5)
        SELECT query, word, distance, round(e / sum(e) OVER (PARTITION BY query), 6) AS score, rank FROM e""",
    "span_expansion": f"""WITH {BENCH}, n AS (SELECT item_id, max(i) AS last FROM btok GROUP BY 1), t AS (SELECT item_id, i AS target FROM btok WHERE length(token) >= 10),
        s AS (SELECT item_id, target, unnest(range(greatest(target - 3, 0), target + 1))::INTEGER AS start FROM t), e AS (SELECT item_id, target, start, unnest(range(target + 1, start + 5))::INTEGER AS "end" FROM s)
        SELECT e.item_id, target, start, "end", string_agg(token, '' ORDER BY i) AS text FROM e JOIN n ON n.item_id = e.item_id AND "end" <= last + 1
        JOIN btok b ON b.item_id = e.item_id AND i >= start AND i < "end" GROUP BY ALL""",
    "end_words_top": f"""WITH {SENT}, l AS (SELECT doc_id, sentence, arg_max(piece, i) AS token FROM snt WHERE is_word GROUP BY ALL)
        SELECT token, count(*) AS n FROM l GROUP BY 1 ORDER BY n DESC, token LIMIT 50""",
    "windows_sliding": f"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM documents), s AS (SELECT doc_id, w, unnest(range(0, len(w), 200))::INTEGER AS start FROM d)
        SELECT doc_id, start, least(len(w) - start, 400)::INTEGER AS n, w[start + 1] AS first_token, w[start + least(len(w) - start, 400)] AS last_token FROM s WHERE len(w) - start >= 5""",
    "windows_packed": f"""WITH RECURSIVE {SENT}, z AS (SELECT doc_id, sentence, count(*) AS size FROM snt GROUP BY ALL), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY sentence) AS k FROM z),
        p AS (SELECT doc_id, k, sentence, size, 0 AS w, size AS used FROM o WHERE k = 1
            UNION ALL SELECT o.doc_id, o.k, o.sentence, o.size, CASE WHEN p.used + o.size <= 128 THEN p.w ELSE p.w + 1 END, CASE WHEN p.used + o.size <= 128 THEN p.used + o.size ELSE o.size END
            FROM p JOIN o ON o.doc_id = p.doc_id AND o.k = p.k + 1)
        SELECT doc_id, w AS "window", min(sentence) AS first, max(sentence) AS last, sum(size)::BIGINT AS size FROM p GROUP BY ALL""",
    "split_contiguous": """WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS k, count(*) OVER () AS t FROM documents)
        SELECT doc_id, CASE WHEN k < floor(t * 0.8::DOUBLE) THEN 'train' WHEN k < floor(t * 0.8::DOUBLE) + floor(t * 0.1::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM n""",
    "every_nth": "WITH n AS (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) - 1 AS k FROM events) SELECT event_id, event_type FROM n WHERE ((k - 3) % 7 + 7) % 7 = 0",
    "mix_50_25_25": """WITH n AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY lang) AS c FROM documents),
        s AS (SELECT * FROM (VALUES ('en', 0.5::DOUBLE, 0), ('fr', 0.25::DOUBLE, 1), ('de', 0.25::DOUBLE, 2)) v(lang, share, part)),
        t AS (SELECT min(floor(c / share)) AS total FROM (SELECT DISTINCT lang, c FROM n) JOIN s USING (lang))
        SELECT doc_id, lang, part FROM n JOIN s USING (lang), t WHERE k <= floor(total * share)""",
    "oversample": "SELECT doc_id, quality, toxic, unnest(range(1, toxic * 2 + 2))::INTEGER AS copy FROM labels",
    "context_features": f"""WITH {TALK} SELECT id, i, token, {', '.join(f"coalesce(lag(token, {k}) OVER w, 'BOS') AS p{k}, coalesce(lead(token, {k}) OVER w, 'EOS') AS n{k}" for k in (1, 2, 3))},
        left(token, 3) AS prefix3, right(token, 3) AS suffix3 FROM ttok WINDOW w AS (PARTITION BY id ORDER BY i)""",
    "prf_quality": f"WITH {GRADED} SELECT {PRF} FROM cnt WHERE lang IS NULL",
    "prf_by_label": f"WITH {GRADED} SELECT coalesce(lang, 'all') AS lang, {PRF} FROM cnt",
    "majority_map": """WITH c AS (SELECT p_name, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL),
        r AS (SELECT *, n / sum(n) OVER (PARTITION BY p_name) AS share, row_number() OVER (PARTITION BY p_name ORDER BY n DESC, f, p_type) AS r FROM c)
        SELECT p_name, p_type, n, round(share, 6) AS share FROM r WHERE r = 1""",
    "tag_stats": """WITH c AS (SELECT json_extract_string(props, '$.k') AS word, event_type AS tag, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL)
        SELECT word, tag, n, round(n / sum(n) OVER (PARTITION BY word), 6) AS p FROM c""",
    "transition_logp": """WITH t AS (SELECT user_id, event_id, CASE WHEN event_type <> 'error' THEN event_type END AS tag FROM events),
        l AS (SELECT tag, lag(tag) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM t), p AS (SELECT prev, tag, count(*) AS n FROM l WHERE prev IS NOT NULL AND tag IS NOT NULL GROUP BY ALL),
        u AS (SELECT tag AS prev, count(*) AS total FROM t WHERE tag IS NOT NULL GROUP BY 1), k AS (SELECT count(*) AS tags FROM u)
        SELECT prev, tag, n, round(ln((n + 0.1::DOUBLE) / (total + 0.1::DOUBLE * tags)), 6) AS logp FROM p JOIN u USING (prev), k""",
    "entity_overlap": """WITH b AS (SELECT item_id AS doc, lower(text) AS text FROM benchmark),
        w AS (SELECT doc, regexp_extract_all(text, '[a-zà-öø-ÿ]{10,}') AS w, string_split_regex(text, '[a-zà-öø-ÿ]{10,}') AS s FROM b),
        e AS (SELECT doc, k::INTEGER AS span_id, list_sum(list_transform(s[:k + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(w[:k], lambda x: length(x))), 0) AS a, length(w[k + 1]) AS n
            FROM (SELECT doc, w, s, unnest(range(len(w))) AS k FROM w)),
        g AS (SELECT doc, k::INTEGER AS seg_i, coalesce(list_sum(list_transform(l[:k], lambda x: length(x) + 1)), 0) AS a, length(l[k + 1]) AS n FROM (SELECT doc, l, unnest(range(len(l))) AS k FROM (SELECT doc, string_split(text, ' ') AS l FROM b)))
        SELECT e.doc, span_id, min(seg_i) AS first, max(seg_i) AS last FROM e JOIN g ON e.doc = g.doc AND g.n > 0 AND g.a < e.a + e.n AND g.a + g.n > e.a GROUP BY ALL""",
    "neighbour_links": """WITH e AS (SELECT user_id AS doc, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS i, event_type AS t FROM events),
        c AS (SELECT a.doc, a.i AS f, b.i AS t, a.t AS type, abs(a.i - b.i) AS d FROM e a JOIN e b ON a.doc = b.doc
            AND ((a.t = 'purchase' AND b.t IN ('view', 'click') AND b.i BETWEEN a.i - 2 AND a.i - 1) OR (a.t = 'error' AND b.t = 'signup' AND b.i = a.i + 1)))
        SELECT doc, f AS "from", arg_min(t, d) AS "to", type, CASE WHEN type = 'purchase' THEN 'bought-after' ELSE 'fails-before' END AS role FROM c GROUP BY ALL""",
    "hierarchy_depth": f"""WITH RECURSIVE {HIER}, d AS (SELECT child AS node, 0 AS depth FROM hier WHERE parent IS NULL UNION ALL SELECT h.child, d.depth + 1 FROM d JOIN hier h ON h.parent = d.node) SELECT node, depth FROM d""",
    "path_to_root": f"WITH RECURSIVE {CLOS} SELECT node, string_agg(ancestor, '>' ORDER BY distance) AS path FROM clos WHERE starts_with(node, 'c') GROUP BY 1",
    "descendants": f"WITH RECURSIVE {CLOS} SELECT ancestor, count(*) AS n, max(distance) AS height FROM clos GROUP BY 1",
    "k_hop": f"""WITH RECURSIVE {HIER}, e AS (SELECT child AS a, parent AS b FROM hier WHERE parent IS NOT NULL UNION SELECT parent, child FROM hier WHERE parent IS NOT NULL),
        w AS (SELECT 'r' || r_regionkey AS seed, 'r' || r_regionkey AS node, 0 AS hops FROM region UNION SELECT w.seed, e.b, w.hops + 1 FROM w JOIN e ON e.a = w.node WHERE w.hops < 2)
        SELECT seed, node, min(hops) AS hops FROM w GROUP BY ALL""",
    "components_bottom_up": f"""WITH RECURSIVE {TREES}, e AS (SELECT doc, i AS a, head AS b FROM tre WHERE head - i <= 3), s AS (SELECT doc, a, b FROM e UNION SELECT doc, b, a FROM e),
        r AS (SELECT doc, i AS a, i AS b FROM tre UNION SELECT r.doc, r.a, s.b FROM r JOIN s ON s.doc = r.doc AND s.a = r.b)
        SELECT doc, a AS i, min(b) AS chunk FROM r GROUP BY ALL""",
    "context_window": f"""WITH {TREES}, m AS (SELECT doc, max(i) AS last FROM tre GROUP BY 1),
        r AS (SELECT doc, i AS l, unnest(range(i, least(i + 5, last) + 1))::INTEGER AS r FROM tre JOIN m USING (doc)),
        k AS (SELECT r.doc, l, r, count(t.i) AS edges FROM r LEFT JOIN tre t ON t.doc = r.doc AND t.i >= l AND t.head <= r GROUP BY ALL), o AS (SELECT doc, l, r FROM k WHERE edges = r - l),
        a AS (SELECT doc, l, r, unnest(range(l, r + 1))::INTEGER AS i FROM o), n AS (SELECT *, row_number() OVER (PARTITION BY doc, i ORDER BY r - l DESC, abs((i - l) - (r - i)), r DESC) AS n FROM a)
        SELECT doc, i, l AS "left", r AS "right" FROM n WHERE n = 1""",
    "html_text": r"""WITH t AS (SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(html, '<[^>]+>', '', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'),
        '[ \t\n\r\f\v]+', ' ', 'g')) AS t FROM pages) SELECT page_id, length(t)::INTEGER AS n_chars, md5(t) AS text_md5 FROM t""",
    "exposure_counters": f"""WITH {SEEN} SELECT head, count(*) AS total_seen, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(form, {{'ts': ts, 'form': form}}) AS last_form FROM seen GROUP BY 1""",
    "sm2_state": f"WITH RECURSIVE {SM2} SELECT head, repetitions, round(interval_, 6) AS \"interval\", round(ease, 6) AS ease, reviews, last FROM sta",
    "next_card": f"""WITH RECURSIVE {SM2}, x AS (SELECT head, count(*) AS total_seen, min(ts) AS first_seen FROM seen GROUP BY 1),
        c AS (SELECT head, total_seen, first_seen, coalesce(repetitions, 0) > 0 AS known, make_timestamp(epoch_us(last) + round(interval_ * 86400000000)::BIGINT) AS due FROM x LEFT JOIN sta USING (head)),
        k AS (SELECT head, CASE WHEN NOT known THEN 1 WHEN due <= TIMESTAMP '2024-01-25' THEN 0 ELSE 2 END AS bucket, total_seen, first_seen, due, CASE WHEN known THEN due END AS d FROM c)
        SELECT head, bucket, total_seen, strftime(due, '%Y-%m-%d %H:%M:%S') AS due FROM k ORDER BY bucket, d NULLS LAST, total_seen DESC, first_seen, head LIMIT 10""",
    "events_tumbling": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "events_sliding": """SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') - to_hours(6 * k) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events, range(4) r(k) GROUP BY ALL""",
    "events_session": """WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOURS THEN 0 ELSE 1 END AS b FROM events),
        s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM b) SELECT user_id, min(ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, s""",
}

RAW = "(SELECT {k}, unnest(range(len(w)))::INTEGER AS i, unnest(w) AS token FROM (SELECT {k}, regexp_extract_all(text, '[^ \\t\\n\\r\\f]+') AS w FROM {t}))"
GARBAGE = r"(regexp_full_match(token, '[\p{N}\p{P}\p{S}]+') OR (NOT regexp_matches(token, '[\x{1000}-\x{109F}]') AND length(token) <= 2))"
ENDS = f"""{pcs()}, ends AS (SELECT doc_id, count(*)::INTEGER AS n, list_sort(coalesce(list(i + 1) FILTER (WHERE regexp_matches(piece, '[.!?]')), [])) AS e FROM pcs GROUP BY 1)"""
OVER = f"""tok AS (SELECT unnest(regexp_extract_all(lower(coalesce(text, '')), '{WORD}')) AS token FROM documents), {UCOST}, {BENCH}, bnd AS (SELECT min(cost) AS lo, max(cost) AS hi, any_value(default_cost) AS unseen FROM ucost),
    own AS (SELECT item_id, i, b.token, coalesce(cost, unseen) AS cost, cost IS NOT NULL AS known,
        CASE WHEN cost IS NULL THEN 1 ELSE least(greatest(coalesce((cost - lo) / nullif(hi - lo, 0), 1 / (1 + exp(-(cost - 8) / 3))), 0), 1) END AS rarity FROM btok b LEFT JOIN ucost u ON u.token = b.token, bnd)"""

ORACLE_SQL |= {
    "token_classes": rf"""WITH t AS {RAW.format(k='doc_id', t='documents')}
        SELECT CASE WHEN token = '' THEN 'EMPTY' WHEN regexp_full_match(token, '[\x{{102B}}-\x{{103E}}]+') THEN 'BARE_MARK' WHEN regexp_full_match(token, '[0-9\x{{1040}}-\x{{1049}}]+') THEN 'DIGIT'
            WHEN regexp_full_match(token, '[\p{{P}}\p{{S}}]+') THEN 'PUNCT' WHEN regexp_matches(token, '[\x{{1000}}-\x{{109F}}]') THEN 'MY' WHEN regexp_full_match(token, '[\x21-\x7E]+') THEN 'ASCII' ELSE 'OTHER' END AS class,
            count(*) AS n, count(*) FILTER (WHERE {GARBAGE}) AS garbage FROM t GROUP BY 1""",
    "token_shapes": rf"""WITH t AS {RAW.format(k='item_id', t='benchmark')}
        SELECT left(translate(regexp_replace(regexp_replace(regexp_replace(token, '[0-9]', chr(1), 'g'), '\p{{L}}', chr(3), 'g'), '[^\x01-\x03]', 'P', 'g'), chr(1) || chr(3), 'DA'), 12) AS shape, count(*) AS n FROM t GROUP BY 1""",
    "char_trigrams": f"WITH {BENCH} SELECT unnest(list_transform(range(1, greatest(length(token) - 1, 1)), lambda k: substring(token, k, 3))) AS gram, count(*) AS n FROM btok GROUP BY 1",
    "corpus_summary": f"""WITH c AS (SELECT count(*) AS records, sum(len(regexp_extract_all(lower(text), '{WORD}')))::BIGINT AS tokens, sum(len(regexp_extract_all(lower(text), '[.!?]+')))::BIGINT AS boundaries FROM documents)
        SELECT *, round(boundaries / tokens, 6) AS rate FROM c""",
    "lang_distribution": "SELECT lang, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 6) AS percent FROM documents GROUP BY 1",
    "event_runs": """WITH b AS (SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER w AND lag(event_id) OVER w IS NOT NULL THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
        r AS (SELECT *, (sum(b) OVER (PARTITION BY user_id ORDER BY event_id) - 1)::BIGINT AS run FROM b) SELECT user_id, run, event_type, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM r GROUP BY ALL""",
    "fixed_batches": "WITH n AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 50 AS batch FROM documents) SELECT batch, count(*) AS n, min(doc_id) AS first, max(doc_id) AS last FROM n GROUP BY 1",
    "boundary_split": f"""WITH RECURSIVE {ENDS}, s AS (SELECT doc_id, n, e, 0 AS a, 0 AS b FROM ends UNION ALL
            SELECT doc_id, n, e, b, CASE WHEN n - b <= 200 THEN n ELSE least(coalesce(list_max(list_filter(e, lambda x: x >= b + 100 AND x <= b + 200)), b + 200), n) END FROM s WHERE b < n)
        SELECT doc_id, a AS start, b AS "end" FROM s WHERE b > a""",
    "agreed_boundaries": f"""WITH {ENDS}, x AS (SELECT doc_id, list_sort(list_distinct(list_concat(list_intersect(e, list_filter(e, lambda x: x % 2 = 0)), [n]))) AS b FROM ends)
        SELECT doc_id, len(b)::INTEGER AS n, array_to_string(b, ',') AS boundaries FROM x""",
    "bilu_tags": f"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '{WORD}') AS w FROM benchmark)
        SELECT item_id, array_to_string(list_transform(w, lambda x: CASE WHEN length(x) = 1 THEN 'U' ELSE 'B' || repeat('I', length(x) - 2) || 'L' END), '') AS tags FROM w""",
    "longest_match_fill": f"""WITH RECURSIVE {TALK}, {VOC}, v2 AS (SELECT word FROM voc WHERE length(word) >= 2), u AS (SELECT DISTINCT token FROM ttok WHERE token NOT IN (SELECT word FROM v2)),
        s AS (SELECT token, '' AS done, 0 AS p FROM u UNION ALL
            SELECT token, CASE WHEN done = '' THEN x ELSE done || '·' || x END, p + length(x) FROM (
                SELECT s.token, s.done, s.p, coalesce((SELECT arg_max(word, length(word)) FROM v2 WHERE length(word) <= 16 AND starts_with(substring(s.token, s.p + 1), word)), substring(s.token, s.p + 1, 1)) AS x FROM s WHERE s.p < length(s.token)))
        SELECT token, done AS parts FROM s WHERE p = length(token)""",
    "lm_overlay": f"WITH {OVER} SELECT item_id, i, token, round(cost, 6) AS cost, known, round(rarity, 6) AS rarity FROM own",
    "sequence_cost": f"""WITH {OVER}, {BCOST}, q AS (SELECT item_id, i, token, cost AS word_cost, lag(token) OVER (PARTITION BY item_id ORDER BY i) AS w1 FROM own),
        c AS (SELECT item_id, word_cost, CASE WHEN q.w1 IS NULL THEN 0 ELSE coalesce(b.cost, coalesce(d.default_cost, global_cost) + 0.5 * word_cost) END AS pair_cost
            FROM q LEFT JOIN bcost b ON b.w1 = q.w1 AND b.w2 = q.token LEFT JOIN dflt d ON d.w1 = q.w1, gdef)
        SELECT item_id, count(*) AS n, round(sum(0.05::DOUBLE * word_cost + 0.1::DOUBLE * pair_cost), 4) AS cost FROM c GROUP BY 1""",
    "climb_tops": f"""WITH RECURSIVE {TREES}, h AS (SELECT doc, i, CASE WHEN head - i <= 3 THEN head END AS up FROM tre), c AS (SELECT doc, i, i AS t FROM h UNION ALL SELECT c.doc, c.i, h.up FROM c JOIN h ON h.doc = c.doc AND h.i = c.t AND h.up IS NOT NULL)
        SELECT doc, i, max(t) AS top FROM c GROUP BY ALL""",
    "subtree_heights": f"""WITH RECURSIVE {TREES}, c AS (SELECT doc, i AS a, i AS n, 0 AS d FROM tre UNION ALL SELECT c.doc, c.a, t.i, c.d + 1 FROM c JOIN tre t ON t.doc = c.doc AND t.head = c.n)
        SELECT doc, a AS i, max(d) AS height FROM c GROUP BY ALL""",
    "relative_heads": f"WITH {TREES} SELECT doc, i, coalesce(head, i) - i AS \"offset\", i = 0 AS starts FROM tre",
    "attached_rows": """WITH h AS (SELECT user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS head FROM events)
        SELECT user_id, head, count(*) AS n FROM h GROUP BY ALL""",
    "bioes_split": f"""WITH {BENCH}, w AS (SELECT item_id, i, token, ceil(length(token) / 4)::INTEGER AS n FROM btok WHERE length(token) >= 8), p AS (SELECT *, unnest(range(n))::INTEGER AS k FROM w)
        SELECT item_id, i, k, substring(token, 4 * k + 1, 4) AS part, CASE WHEN n = 1 THEN 'S' WHEN k = 0 THEN 'B' WHEN k = n - 1 THEN 'E' ELSE 'I' END || '-ENT' AS tag FROM p""",
    "threshold_majority": """WITH c AS (SELECT p_name, p_type, count(*) AS n, min(p_partkey) AS f FROM part GROUP BY ALL),
        r AS (SELECT *, sum(n) OVER (PARTITION BY p_name) AS total, row_number() OVER (PARTITION BY p_name ORDER BY n DESC, f, p_type) AS r FROM c)
        SELECT p_name, p_type, n, total::BIGINT AS total FROM r WHERE r = 1 AND total >= 20 AND n / total >= 0.25::DOUBLE""",
    "carried_labels": """WITH e AS (SELECT user_id AS doc_id, event_id AS i, event_type AS token, CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END AS y, event_type <> 'error' AS k FROM events),
        t AS (SELECT *, coalesce(min(CASE WHEN k THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), max(CASE WHEN k THEN i END) OVER (PARTITION BY doc_id)) AS t FROM e),
        m AS (SELECT doc_id, t AS i, max(y) AS y FROM t GROUP BY ALL) SELECT e.doc_id, e.i, token, m.y FROM e JOIN m ON m.doc_id = e.doc_id AND m.i = e.i WHERE k""",
    "post_filter": """WITH RECURSIVE e AS (SELECT user_id AS doc_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1)::INTEGER AS i, value AS p FROM events), c AS (SELECT doc_id, i FROM e WHERE p >= 20),
        s AS (SELECT doc_id, min(i) AS i FROM c GROUP BY 1 UNION ALL SELECT doc_id, i FROM (SELECT s.doc_id, (SELECT min(c.i) FROM c WHERE c.doc_id = s.doc_id AND c.i >= s.i + 3) AS i FROM s) WHERE i IS NOT NULL)
        SELECT doc_id, i FROM s""",
    "unknown_log_counters": rf"""WITH {VOC}, t AS (SELECT regexp_replace(lower(token), '^[\p{{P}}\p{{S}}\s]+|[\p{{P}}\p{{S}}\s]+$', '', 'g') AS token FROM {RAW.format(k='conv_id', t='conversations')})
        SELECT CASE WHEN token = '' THEN 'empty' WHEN NOT regexp_full_match(token, '{WORD}') THEN 'foreign' WHEN length(token) > 12 THEN 'long' WHEN token IN (SELECT word FROM voc) THEN 'known' ELSE 'kept' END AS reason, count(*) AS n
        FROM t GROUP BY 1""",
    "allowed_tags": """WITH e AS (SELECT user_id, ts::DATE::VARCHAR AS day, CASE WHEN event_type <> 'error' THEN event_type END AS tag FROM events),
        g AS (SELECT user_id, day, coalesce(string_agg(DISTINCT tag, '|' ORDER BY tag), '') AS allowed, bool_and(tag IS NOT NULL) AS ok FROM e GROUP BY ALL) SELECT user_id, day, allowed, CASE WHEN ok THEN allowed END AS strict FROM g""",
}

ORACLE_SQL |= {
    "tag_confidence": """WITH c AS (SELECT json_extract_string(props, '$.k') AS word, event_type AS tag, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL),
        s AS (SELECT word, ln(n / sum(n) OVER (PARTITION BY word)) AS s FROM c), r AS (SELECT word, s - lead(s) OVER w AS d, row_number() OVER w AS r FROM s WINDOW w AS (PARTITION BY word ORDER BY s DESC))
        SELECT word, CASE WHEN d IS NULL OR d >= 4 THEN 1.0 WHEN d >= 2 THEN 0.85 WHEN d >= 1 THEN 0.6 WHEN d >= 0.5 THEN 0.4 ELSE 0.25 END::DOUBLE AS confidence FROM r WHERE r = 1""",
    "certainty_weights": """WITH c AS (SELECT p_name, p_type, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT p_name, max(n) / sum(n) AS s FROM c GROUP BY 1)
        SELECT p_name, round(0.5::DOUBLE + 0.5::DOUBLE * least(greatest((s - 0.4::DOUBLE) / (0.85::DOUBLE - 0.4::DOUBLE), 0), 1), 6) AS weight FROM m""",
    "bigram_mle": f"WITH {tok()}, {BI} SELECT w1, w2, n, round(n / sum(n) OVER (PARTITION BY w1), 6) AS p FROM bi",
    "phrase_bigrams": f"""WITH RECURSIVE {BENCH}, {SPANS}, inv AS (SELECT phrase FROM spn GROUP BY 1 HAVING count(*) >= 2),
        nx AS (SELECT item_id, i, token, lead(token, 1) OVER w AS t1, lead(token, 2) OVER w AS t2, lead(token, 3) OVER w AS t3 FROM btok WINDOW w AS (PARTITION BY item_id ORDER BY i)),
        best AS (SELECT item_id, i, token, CASE WHEN token || '_' || t1 || '_' || t2 || '_' || t3 IN (SELECT phrase FROM inv) THEN 4 WHEN token || '_' || t1 || '_' || t2 IN (SELECT phrase FROM inv) THEN 3
            WHEN token || '_' || t1 IN (SELECT phrase FROM inv) THEN 2 ELSE 1 END AS size, t1, t2, t3 FROM nx),
        walk AS (SELECT item_id, 0 AS i FROM best GROUP BY 1 UNION ALL SELECT w.item_id, w.i + b.size FROM walk w JOIN best b ON b.item_id = w.item_id AND b.i = w.i),
        u AS (SELECT item_id, i, CASE size WHEN 4 THEN token || '_' || t1 || '_' || t2 || '_' || t3 WHEN 3 THEN token || '_' || t1 || '_' || t2 WHEN 2 THEN token || '_' || t1 ELSE token END AS u FROM walk JOIN best USING (item_id, i)),
        p AS (SELECT u AS w1, lead(u) OVER (PARTITION BY item_id ORDER BY i) AS w2 FROM u) SELECT w1, w2, count(*) AS n FROM p WHERE w2 IS NOT NULL GROUP BY ALL""",
    "bilu_decoded": f"SELECT item_id, array_to_string(regexp_extract_all(lower(text), '{WORD}'), ' ') AS words FROM benchmark",
    "space_boundaries": r"SELECT item_id, len(regexp_extract_all(trim(text, chr(32) || chr(9) || chr(10) || chr(13)), '\S\s')) AS n FROM benchmark",
    "marked_text": f"""WITH p AS (SELECT item_id, unnest(range(len(w))) AS i, unnest(w) AS piece FROM (SELECT item_id, regexp_extract_all(lower(text), '{WORD}|[^\\sa-zà-öø-ÿ]+') AS w FROM benchmark))
        SELECT item_id, md5(string_agg(piece || CASE WHEN regexp_matches(piece, '[.!?]') THEN ' <SENT_END>' ELSE '' END, ' ' ORDER BY i)) AS text_md5 FROM p GROUP BY 1""",
    "code_points": f"WITH {BENCH} SELECT token, list_aggregate(list_transform(string_split(token, ''), lambda c: 'U+' || lpad(to_hex(unicode(c)), greatest(4, length(to_hex(unicode(c))))::INTEGER, '0')), 'string_agg', ' ') AS points FROM (SELECT DISTINCT token FROM btok)",
    "fuzzy_budget": f"WITH {NAMES} SELECT query, word, distance FROM fnd JOIN ncost USING (word) ORDER BY length(query) DESC, cost, word, query LIMIT 10",
    "lexicon_injected": f"""WITH {LAYERS}, e AS (SELECT DISTINCT layer, headword FROM lay), x AS (SELECT * FROM e UNION ALL SELECT DISTINCT 'grammar', lower(n_name) FROM nation WHERE lower(n_name) NOT IN (SELECT headword FROM e))
        SELECT layer, count(*) AS n, min(headword) AS first_head, max(headword) AS last_head FROM x GROUP BY 1""",
    "island_groups": f"""WITH {TREES}, l AS (SELECT DISTINCT doc, greatest(i // 5, head // 5) AS island FROM tre WHERE head IS NOT NULL AND abs(i // 5 - head // 5) = 1), s AS (SELECT DISTINCT doc, i // 5 AS island FROM tre),
        g AS (SELECT s.doc, s.island, (sum(CASE WHEN l.island IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY s.doc ORDER BY s.island) - 1)::BIGINT AS grp FROM s LEFT JOIN l ON l.doc = s.doc AND l.island = s.island)
        SELECT doc, grp, min(island)::BIGINT AS first, max(island)::BIGINT AS last FROM g GROUP BY ALL""",
}

#: Greedy phrases of the documents: each match knows the next one after its end, and a walk follows these.
ORACLE_SQL["phrases_greedy"] = f"""WITH RECURSIVE {BENCH}, {SPANS}, inv AS (SELECT phrase, size, count(*) AS n FROM spn GROUP BY 1, 2), wds AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS w FROM documents),
    at4 AS (SELECT doc_id, unnest(range(len(w))) AS i, unnest(w) AS t0, unnest(w[2:]) AS t1, unnest(w[3:]) AS t2, unnest(w[4:]) AS t3 FROM wds),
    cnd AS (SELECT doc_id, i, 2 AS size, t0 || '_' || t1 AS phrase FROM at4 WHERE t1 IS NOT NULL UNION ALL SELECT doc_id, i, 3, t0 || '_' || t1 || '_' || t2 FROM at4 WHERE t2 IS NOT NULL UNION ALL SELECT doc_id, i, 4, t0 || '_' || t1 || '_' || t2 || '_' || t3 FROM at4 WHERE t3 IS NOT NULL),
    hit AS MATERIALIZED (SELECT doc_id, i, max(size) AS size, arg_max(phrase, c.size) AS phrase, arg_max(n, c.size) AS n FROM cnd c JOIN inv USING (phrase, size) GROUP BY 1, 2),
    nxt AS MATERIALIZED (SELECT h.doc_id, h.i, h.size, h.phrase, h.n, x.i AS after FROM hit h ASOF LEFT JOIN hit x ON x.doc_id = h.doc_id AND h.i + h.size <= x.i),
    wlk AS (SELECT n.* FROM nxt n JOIN (SELECT doc_id, min(i) AS i FROM hit GROUP BY 1) f ON f.doc_id = n.doc_id AND f.i = n.i UNION ALL SELECT n.* FROM wlk w JOIN nxt n ON n.doc_id = w.doc_id AND n.i = w.after)
    SELECT doc_id, i::INTEGER AS start, (i + size)::INTEGER AS "end", phrase, n FROM wlk"""
