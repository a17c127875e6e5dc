"""Part-of-speech labels of dictionaries, taggers and entity models, and the maps between them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label sets and maps.
UPOS = ["ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X"]
WHITELIST = (
    r"(?i)^(n|noun|v|verb|adj|adjective|adv|adverb|num|number|pron|pronoun|aux|auxiliary|prep|preposition|postp|postposition|conj|conjunction"
    r"|interj|interjection|part|particle|det|determiner|prefix|suffix|m|nm)\b"
)
COARSE = {"n": "N", "pron": "PRON", "v": "V", "adj": "ADJ", "adv": "ADV", "ppm": "POSTP", "conj": "CONJ", "part": "PART", "exp": "PART", "int": "PART", "kjano": "PART"}
TO_UPOS = {
    "n": "NOUN", "noun": "NOUN", "v": "VERB", "verb": "VERB", "adj": "ADJ", "adjective": "ADJ", "adv": "ADV", "adverb": "ADV", "pron": "PRON",
    "pronoun": "PRON", "conj": "SCONJ", "conjunction": "SCONJ", "ppm": "ADP", "postposition": "ADP", "postp": "ADP", "part": "PART",
    "particle": "PART", "num": "NUM", "number": "NUM", "numeral": "NUM", "tn": "NOUN", "fw": "X", "punc": "PUNCT", "punctuation": "PUNCT",
    "int": "INTJ", "interjection": "INTJ", "intj": "INTJ", "name": "PROPN", "prop": "PROPN", "det": "DET", "determiner": "DET", "aux": "AUX",
    "classifier": "NOUN", "prep": "ADP", "prefix": "PART", "symbol": "SYM", "character": "SYM", "phrase": "X", "proverb": "X", "exp": "X",
}
PREFIXES = [
    ("adj", ["adj"], []), ("adv", ["adv"], []), ("pron", ["pron"], []), ("conj", ["conj"], []), ("exp", ["exp"], []), ("int", ["int", "interj"], []), ("pos", ["pos"], []),
    ("kjano", ["kjano", "num"], ["m", "nm", "tn"]), ("ppm", ["ppm", "postp", "prep"], []), ("part", ["part", "particle"], []), ("n", ["n"], []), ("v", ["v", "aux"], []),
]
EQUIVALENT = [["NOUN", "PROPN", "NUM"], ["SCONJ", "CCONJ"]]
ALIASES = {"CONJ": "SCONJ"}
NER_UPOS = {"PNAME": "PROPN", "LOC": "PROPN", "ORG": "PROPN", "RACE": "PROPN", "TIME": "NOUN", "NUM": "NUM", "NE": "PROPN"}


def mapped(value: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[value]


def whitelisted(pos: Column) -> Column:
    """The label as it stands, or nothing if it does not begin with a known one; null is nothing."""
    trimmed = F.trim(F.coalesce(pos, F.lit("")))
    return F.when(trimmed.rlike(WHITELIST), trimmed).otherwise("")


def meta_pos(pos: Column) -> Column:
    """CASE, VPART, LINK or BOUND for function words by the beginning of their label, else nothing."""
    p = F.lower(F.coalesce(pos, F.lit("")))
    begins = lambda *words: p.rlike("^(" + "|".join(words) + ")")
    return F.when(begins("postp", "prep"), "CASE").when(begins("part"), "VPART").when(begins("conj", "det"), "LINK").when(begins("prefix", "suffix"), "BOUND").otherwise("")


def atoms(pos: Column) -> Column:
    """The parts of a dictionary's label; a bar does not part them."""
    return F.filter(F.split(F.coalesce(pos, F.lit("")), r"[,;+/\s]+"), lambda x: x != "")


def coarse(pos: Column) -> Column:
    """Sorted coarse labels of a dictionary label; UNKNOWN for what is not in the table or for none at all."""
    found = F.transform(atoms(pos), lambda x: F.coalesce(mapped(F.lower(x), COARSE), F.lit("UNKNOWN")))
    return F.when(F.size(found) > 0, F.array_sort(F.array_distinct(found))).otherwise(F.array(F.lit("UNKNOWN")))


def prefix_pos(pos: Column) -> Column:
    """One of twelve coarse tags by the beginning of a label, the first rule that fits; nothing for others."""
    p = F.lower(F.trim(F.coalesce(pos, F.lit(""))))
    found = F.lit(None).cast("string")
    for tag, begins, whole in reversed(PREFIXES):
        fits = p.rlike("^(" + "|".join(begins) + ")")
        found = F.when(fits | p.isin(whole) if whole else fits, tag).otherwise(found)
    return F.coalesce(found, F.lit(""))


def pos_candidates(pos: Column, senses: Column) -> Column:
    """Sorted coarse tags of an entry: its own label's, and those in the third column of its tab-separated sense lines."""
    inside = F.transform(F.coalesce(senses, F.array().cast("array<string>")), lambda x: F.coalesce(F.get(F.split(x, "\t", -1), F.lit(2)), F.lit("")))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(F.array(F.coalesce(pos, F.lit(""))), inside), prefix_pos), lambda x: x != "")))


def coarse_of(token: Column, pos: Column) -> Column:
    """coarse of an entry's label; without an entry (pos null) NUM for digits, else UNKNOWN."""
    return F.when(pos.isNotNull(), coarse(pos)).when(token.rlike("^[0-9၀-၉]+$"), F.array(F.lit("NUM"))).otherwise(F.array(F.lit("UNKNOWN")))


def normal(tag: Column) -> Column:
    up = F.upper(tag)
    return F.coalesce(mapped(up, ALIASES), up)


def upos_of(pos: Column) -> Column:
    """Sorted universal tags that a dictionary's label stands for: by the table, or as they stand if they are such tags."""
    one = lambda x: F.coalesce(mapped(F.lower(x), TO_UPOS), F.when(F.upper(x).isin(UPOS), F.upper(x)))
    found = F.filter(F.transform(F.split(F.lower(F.coalesce(pos, F.lit(""))), r"[,;+/|\s]+"), one), lambda x: x.isNotNull())
    return F.when(F.lower(F.coalesce(pos, F.lit(""))).isin("", "unknown"), F.slice(found, 1, 0)).otherwise(F.array_sort(F.array_distinct(found)))


def label_pos(label: Column) -> Column:
    """The tag in a tagger's label (POS=NOUN|Number=Sing), or the label itself."""
    inside = F.regexp_extract(label, r"\bPOS=([A-Za-z]+)", 1)
    return normal(F.when(inside != "", inside).otherwise(label))


def allowed(tags: Column) -> Column:
    """Sorted tags with all those that count as equal to one of them."""
    own = F.transform(F.coalesce(tags, F.array().cast("array<string>")), normal)
    more = [F.when(F.arrays_overlap(own, F.array(*map(F.lit, g))), F.array(*map(F.lit, g))).otherwise(F.array().cast("array<string>")) for g in EQUIVALENT]
    return F.array_sort(F.array_distinct(F.concat(own, *more)))


def same_set(a: Column, b: Column) -> Column:
    """Whether two lists of tags allow the same."""
    return allowed(a) == allowed(b)


def ner_upos(label: Column) -> Column:
    return mapped(label, NER_UPOS)
