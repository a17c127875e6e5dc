"""Personal data: spans by pattern, and the terms around them that give the same data away.

A term discloses an entity (an address, a number) if knowing the term tells most of what knowing the entity would:
PMI(entity; term) / IC(entity), with probabilities over the documents of the corpus. From generalise on a term is
replaced by its class, from remove on it goes. All words of the texts that hold the entity are its terms. Any word of a text
stands with its entities once, which tells nothing, so a word counts if it does so in another text, too, or if it stands
within a window around the entity. How often it does is an estimate, so its lower confidence bound counts: a word that
was seen once tells about two bits less than it seems to; in a small corpus it stays, in a large one it is generalised.

DataFrame functions only. Possessive quantifiers and the guard before each pattern keep matching linear in the text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import let, running, texts, written

# The patterns. A match that starts inside a run of its first class would have started earlier, unless the
# last match ended there (\G); looking only at run starts avoids quadratic time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:(?<![0-9])|\G)[0-9](?:[ -]?[0-9]){13,}+"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
TERM = r"(?<![\p{L}\p{M}\p{N}])\p{L}[\p{L}\p{M}]*+(?!\p{N})"
WORDS = r"[^\p{L}\p{M}]+"
KINDS = ("email", "ip", "card", "phone")
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "removed": ""}
#: Classes of a generalised term: a pattern of it and its mask, the first that fits.
CLASSES = ((r"^\p{Lu}\p{M}*\p{Lu}[\p{Lu}\p{M}]*$", "[ACRONYM]"), (r"^\p{Lu}", "[NAME]"), ("", "[WORD]"))


@dataclass(frozen=True)
class Disclosure:
    support: int = 2  # different texts in which a term must stand with the entity, unless it stands beside it
    window: int = 80  # code points on either side of the entity that are beside it
    z: float = 1.645  # of the lower confidence bound (95 % on one side)
    generalise: float = 0.8  # share of the entity's information
    remove: float = 0.95


def lower_bound(hits: Column, of: Column, z: float) -> Column:
    """Wilson's lower bound of a share."""
    p, zz = hits / of, z * z
    return (p + zz / (2 * of) - z * F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / of + zz / (4 * of * of))) / (1 + zz / of)


def around(text: Column, spans: Column, window: int) -> Column:
    """Array of (entity, word): the lower-cased terms within so many code points of each span; words that the window cuts are out."""
    def terms(b: Column) -> Column:
        begin = F.greatest(b["start"] - window, F.lit(0))
        before, after = F.substring(text, begin + 1, b["start"] - begin), F.substring(text, b["end"] + 1, F.lit(window))
        before = F.when(begin > 0, F.regexp_replace(before, r"^[\p{L}\p{M}\p{N}]++", "")).otherwise(before)
        after = F.when(b["end"] + window < F.length(text), F.regexp_replace(after, r"[\p{L}\p{M}\p{N}]++$", "")).otherwise(after)
        found = F.regexp_extract_all(F.concat(before, F.lit(" "), after), F.lit(TERM), F.lit(0))
        return F.transform(F.array_distinct(F.transform(found, lambda w: F.lower(w))), lambda w: F.struct(b["entity"].alias("entity"), w.alias("word")))

    return F.array_distinct(F.flatten(F.transform(spans, terms)))


def luhn(digits: Column) -> Column:
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def matches(text: Column, pattern: str) -> Column:
    """Array of (start, end, value): all matches in order, in code points.

    split gives the text between the matches, so running sums of lengths are positions."""
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("v"), F.split(text, pattern, -1).alias("l"))
    span = lambda v, end: F.struct((end - F.length(v)).alias("start"), end.alias("end"), v.alias("value"))
    sizes = lambda m: F.transform(m["v"], lambda v, i: F.length(F.get(m["l"], i)) + F.length(v))
    return let(found, lambda m: F.zip_with(m["v"], running(sizes(m)), span))


def of_kind(k: int, kind: str, entity):
    def span(m: Column) -> Column:
        name = F.concat(F.lit(kind + ":"), entity(m))
        return F.struct(m["start"].alias("start"), F.lit(k).alias("ord"), m["end"].alias("end"), F.lit(kind).alias("kind"), name.alias("entity"))

    return span


def base_spans(text: Column) -> Column:
    """Array of (start, ord, end, kind, entity), by start, then kind: what the four patterns and their
    checks find. A text without the character that a kind needs is not searched for it."""
    digits = lambda m: F.regexp_replace(m["value"], "[^0-9]", "")
    checks = {
        "email": (EMAIL, F.contains(text, F.lit("@")), lambda m: F.lit(True), lambda m: F.lower(m["value"])),
        "ip": (IP, text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"), lambda m: m["value"].rlike(rf"^{PART}(?:\.{PART}){{3}}$"), lambda m: m["value"]),
        "card": (CARD, text.rlike(r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]"), lambda m: (F.length(digits(m)) <= 19) & luhn(digits(m)), digits),
        "phone": (PHONE, F.contains(text, F.lit("+")), lambda m: F.length(digits(m)).between(10, 15), digits),
    }
    kind_type = "array<struct<start:int,ord:int,end:int,kind:string,entity:string>>"
    parts = []
    for k, kind in enumerate(KINDS):
        pattern, may, valid, entity = checks[kind]
        good = F.filter(matches(text, pattern), valid)
        spans = F.transform(good, of_kind(k, kind, entity))
        parts.append(F.when(may, spans).otherwise(F.expr(f"cast(array() as {kind_type})")))
    return F.array_sort(F.concat(*parts))


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Disclosure = Disclosure()) -> DataFrame:
    """One row for each row of df: id, h (hash of the text), spans array<(start, ord, end, kind)> by start, then kind.

    kind is one of email, ip, card, phone, general, removed; the last two are terms that the corpus shows to disclose
    an entity of the text and that overlap no other span; all their places in the text are marked. Null texts are empty and have no spans; rows with a null id
    are searched like others; repeated rows each get their spans. An empty table gives none.

    The patterns run once; what they find is written, and so is each different text that holds an entity. Copies of a text
    count as often as they occur. A pair of an entity and a word near it needs the word's count only where the word is rare
    enough to disclose that entity: a share of g asks for n_word <= n_docs^(1 - g) * n_entity^g, whatever the pair's own
    count. The risky words' places are then looked up in the texts.
    """
    return _find(texts(df, id_col, text_col), settings).withColumnRenamed("id", id_col)


def _find(docs: DataFrame, settings: Disclosure) -> DataFrame:
    """(id, h, spans) of rows (id, text)."""
    s, g = settings, settings.generalise
    spans = docs.withColumn("base", base_spans(F.col("text")))
    found = written(spans.select("id", F.xxhash64("text").alias("h"), "base", F.when(F.size("base") > 0, F.col("text")).alias("text")), "spans")
    held = written(found.filter("text is not null").groupBy("h").agg(F.count("*").alias("n"), F.first("base").alias("base"), F.first("text").alias("text")), "held")
    entities = held.select("h", "n", F.explode_outer(F.array_distinct("base.entity")).alias("entity"))
    per_entity = written(entities.groupBy("entity").agg(F.sum("n").alias("n_entity"), F.count("*").alias("texts")), "per_entity")
    total = found.count()
    rare = lambda n: F.pow(F.lit(float(total)), 1 - g) * F.pow(n.cast("double"), g) * (1 + 1e-9)
    words = docs.select(F.explode_outer(F.array_distinct(F.split(F.lower("text"), WORDS))).alias("word"))
    most = per_entity.agg(rare(F.max("n_entity")).alias("m")).first().m or 0.0
    per_word = written(words.groupBy("word").agg(F.count("*").alias("n_word")).filter(F.col("n_word") <= most), "words")
    beside = held.select("h", "n", F.explode_outer(around(F.col("text"), F.col("base"), s.window)).alias("x")).filter("x is not null").select("h", "n", "x.entity", "x.word", F.lit(1).alias("near"))
    # Only entities of several texts can meet a word in several: their texts' rare words, each below the entity's own bound.
    again = entities.join(per_entity.filter(F.col("texts") >= s.support), "entity").select("h", "n", "entity", rare(F.col("n_entity")).alias("bound"))
    terms = F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), lambda t: F.lower(t)))
    own = held.join(again.groupBy("h").agg(F.max("bound").alias("bound")), "h").select("h", "bound", F.explode_outer(terms).alias("word")).filter("word is not null")
    own = own.join(per_word, "word").filter("n_word <= bound").select("h", "word", "n_word")
    anywhere = again.join(own, "h").filter("n_word <= bound").select("h", "n", "entity", "word", F.lit(0).alias("near"))
    near = written(beside.unionByName(anywhere).groupBy("h", "entity", "word").agg(F.max("n").alias("n"), F.max("near").alias("near")), "near")
    pairs = near.groupBy("entity", "word").agg(F.sum("n").alias("n_both"), F.count("*").alias("together"), F.max("near").alias("near")).filter((F.col("together") >= s.support) | (F.col("near") == 1))
    pairs = pairs.join(per_entity, "entity").join(per_word, "word").filter(F.col("n_word") <= rare(F.col("n_entity")))
    ic = F.log2(F.lit(float(total)) / F.col("n_entity"))
    seen = F.greatest(F.col("n_word"), F.col("n_both"))  # a word that digits touch counts elsewhere only
    pmi = F.log2(lower_bound(F.col("n_both"), seen, s.z) * F.lit(float(total)) / F.col("n_entity"))
    risky = pairs.select("entity", "word", (pmi / F.when(ic > 0, ic)).alias("share")).filter(F.col("share") >= g)
    level = F.when(F.max("share") >= s.remove, "removed").otherwise("general")
    marked = near.join(risky, ["entity", "word"]).groupBy("h", "word").agg(level.alias("kind"))
    kinds = marked.groupBy("h").agg(F.map_from_entries(F.collect_list(F.struct("word", "kind"))).alias("kinds"))
    kind = lambda m: F.try_element_at(F.col("kinds"), F.lower(m["value"]))
    span = lambda m: F.struct(m["start"].alias("start"), F.when(kind(m) == "general", 4).otherwise(5).alias("ord"), m["end"].alias("end"), kind(m).alias("kind"))
    placed = held.select("h", "text").join(kinds, "h").select("h", "kinds", matches(F.col("text"), TERM).alias("m"))
    added = placed.select("h", F.transform(F.filter("m", lambda m: kind(m).isNotNull()), span).alias("added"))
    slim = F.transform("base", lambda b: F.struct(b["start"].alias("start"), b["ord"].alias("ord"), b["end"].alias("end"), b["kind"].alias("kind")))
    both = found.select("id", "h", slim.alias("base")).join(added, "h", "left")
    free = F.filter(F.coalesce("added", F.slice("base", 1, 0)), lambda a: ~F.exists("base", lambda b: (a["start"] < b["end"]) & (b["start"] < a["end"])))
    return both.select("id", "h", F.array_sort(F.concat("base", free)).alias("spans"))


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its mask, a generalised term by its class; of overlapping spans the first one's mask
    stands for all."""

    def mask(span: Column) -> Column:
        term, of_class = F.substring(text, span["start"] + 1, span["end"] - span["start"]), None
        for pattern, name in CLASSES:
            of_class = F.when(term.rlike(pattern), name) if of_class is None else of_class.when(term.rlike(pattern), name)
        return F.when(span["kind"] == "general", of_class).otherwise(kinds[span["kind"]])

    kinds = F.create_map(*(F.lit(x) for pair in MASKS.items() for x in pair))

    def piece(s: Column, done: Column) -> Column:
        """What stands between what is done and a span, and the span's mask."""
        return F.concat(F.substring(text, done + 1, F.greatest(s["start"] - done, F.lit(0))), F.when(s["start"] >= done, mask(s)).otherwise(""))

    def put(upto: Column) -> Column:
        done = F.slice(F.concat(F.array(F.lit(0)), upto), 1, F.size(upto))
        last = F.coalesce(F.get(upto, F.size(upto) - 1), F.lit(0))
        return F.concat(F.array_join(F.zip_with(spans, done, piece), ""), F.substring(text, last + 1, F.length(text)))

    return let(running(F.transform(spans, lambda s: s["end"]), op=lambda a, b: F.greatest(a, b)), put)


def sanitised(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Disclosure = Disclosure()) -> DataFrame:
    """df with its own columns and all spans of its texts masked; null texts stay null. Only texts that have spans meet
    them in a join; equal rows get equal spans, so it does not matter which of them a span came from. A row is one column
    meanwhile, so that no name can clash. Null ids, repeated rows and empty tables are treated as find does."""
    spans = _find(texts(df, id_col, text_col), settings).filter(F.size("spans") > 0).dropDuplicates(["id", "h"])
    spans = spans.select(F.col("id").alias("sid"), F.col("h").alias("sh"), "spans")
    text = F.col(f"`{text_col}`")
    own = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))).alias("h"), text.alias("text"))
    joined = own.join(spans, F.col("id").eqNullSafe(F.col("sid")) & (F.col("h") == F.col("sh")), "left")
    new = F.when(F.col("spans").isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col("spans")))
    done = joined.select("row", new.alias("masked"))
    return done.select(*((F.col("masked") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in df.columns))
