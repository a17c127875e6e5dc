"""Cleaning of characters, lines and dictionary fields, as column expressions. Null stays null unless stated."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import distinct_runs

# Consonants and independent vowels that begin a Myanmar word, and trails of dictionary definitions.
ONSETS = "ကခဂဃငစဆဇဈဉဋဌဍဎဏတထဒဓနပဖဗဘမယရလဝသဟဠအဣဤဥဦဧဩဪ"
SCRIPT = "က-႟ꧠ-꧿ꩠ-ꩿ"
MY_MARK = "[\\u1000-\\u109F\\uA9E0-\\uA9FF\\uAA60-\\uAA7F&&[\\p{M}]]"
MY_LETTER = "[\\u1000-\\u109F\\uA9E0-\\uA9FF\\uAA60-\\uAA7F&&[\\p{L}]]"


def char_class(char: Column) -> Column:
    """MY_L, MY_M, DIG, PUN, ASC or OTH of a character; EMPTY of none."""
    return (
        F.when(char == "", "EMPTY").when(char.rlike(f"^{MY_LETTER}"), "MY_L").when(char.rlike(f"^{MY_MARK}"), "MY_M").when(char.rlike(r"^\p{Nd}"), "DIG")
        .when(char.rlike(r"^[\p{P}\p{S}]"), "PUN").when(char.rlike("^[A-Za-z]"), "ASC").otherwise("OTH")
    )


def keep_newlines(text: Column, letters: str = SCRIPT) -> Column:
    """Carriage returns out; all but line ends and the script's characters becomes a space."""
    return F.regexp_replace(F.replace(text, F.lit("\r"), F.lit("")), f"[^\n{letters}]", " ")


def collapse_spaces(text: Column) -> Column:
    """Each line with its spaces collapsed and trimmed; empty lines at both ends out."""
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), r"^\s+|\s+$", ""))
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def first_onset(text: Column) -> Column:
    """The first consonant or independent vowel, or null."""
    found = F.regexp_extract(text, f"[{ONSETS}]", 0)
    return F.when(found != "", found)


def strip_suffix(head: Column, letters: str = SCRIPT) -> Column:
    """A headword without what follows its last character of the script; one without such characters stays."""
    cut = F.regexp_replace(head, f"[^{letters}]+$", "")
    return F.when(cut != "", cut).otherwise(head)


def clean_definition(text: Column) -> Column:
    """Bracketed notes, a leading sense mark 7 and a trailing pointer to an illustration out, white space collapsed; null: nothing."""
    s = F.regexp_replace(F.coalesce(text, F.lit("")), r"\[[^\]]*\]", " ")
    s = F.regexp_replace(s, r"^\s*7[#0-9:]*\s*", " ")
    s = F.regexp_replace(s, r"(?i)\bSee illus at.*$", " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


def script_nfc(text: Column) -> Column:
    """Canonical composition as far as it concerns the script: the one pair that composes, and marks of a class in order."""
    composed = F.replace(text, F.lit("\u1025\u102E"), F.lit("\u1026"))
    ordered = F.regexp_replace(composed, "(\u108D+)([\u1037\u1039\u103A]+)", "$2$1")
    return F.regexp_replace(ordered, "([\u1039\u103A]+)(\u1037+)", "$2$1")


# Marks that follow a base character, those of them that stand once on a base, and what counts as a space.
FOLLOWING = "\u102B-\u103E\u1056-\u1059"
ONCE = "\u102B\u102C\u102D\u102E\u102F\u1030\u1032\u1036\u1037\u1038\u103A"
SPACES = "\u0009-\u000D\u001C-\u0020\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"


def ocr_clean(text: Column) -> Column:
    """For scanned text: the digit zero is the letter wa, characters of other scripts go without a trace (so marks meet the base
    before them), a mark without a base before it goes, and each mark stands once on a base but for those that may repeat.
    White space is one space, none at the ends. Null stays null."""
    s = script_nfc(F.replace(F.replace(text, F.lit("\u1040"), F.lit("\u101D")), F.lit("\u00B0"), F.lit("")))
    s = F.regexp_replace(F.regexp_replace(s, f"[^{SPACES}\u1000-\u109F\uA9E0-\uA9FF\uAA60-\uAA7F]", ""), f"[{SPACES}]+", " ")
    s = F.regexp_replace(s, f"(^|[ \u104A\u104B])[{FOLLOWING}]+", "$1")

    def once(marks: Column) -> Column:
        """A run of marks; only one that repeats a mark is gone through character by character."""
        step = lambda done, c: F.when(c.rlike(f"^[{ONCE}]$") & F.contains(done, c), done).otherwise(F.concat(done, c))
        return F.when(marks.rlike(f"([{ONCE}])[{FOLLOWING}]*\\1"), F.aggregate(F.split(marks, ""), F.lit(""), step)).otherwise(marks)

    runs = F.regexp_extract_all(s, F.lit(f"[{FOLLOWING}]+|[^{FOLLOWING}]+"), F.lit(0))
    return F.trim(F.regexp_replace(F.array_join(F.transform(runs, once), ""), " +", " "))


def ocr_distinct(docs: DataFrame, old: str, new: str, text_col: str = "text") -> DataFrame:
    """(text): the distinct parts between spaces and the script's marks ၊ and ။ of texts whose letters, in lower case, are rewritten from old
    to new and that are cleaned as scanned text. No step of the cleaning looks over a space or a mark, so texts are parted
    first, as they stand, and each distinct part is rewritten and cleaned once, in the task that it was dealt to. (Parts are
    written, as the optimizer would leave out a distinct() below another one and clean each part wherever it occurs.)"""
    marks = "၊။" + "".join(a for a, b in zip(old, new) if b in "၊။")
    lower = docs.select(F.lower(F.col(text_col)).alias("text"))
    parts = distinct_runs(lower, f"^{SPACES}{re.escape(marks)}").checkpoint()
    return parts.select(ocr_clean(F.translate("token", old, new)).alias("text")).filter("text <> ''").distinct()


def rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    """An ordered cascade of rewrites, as converters between encodings of a script are: each rule's pattern is replaced all over
    what the rules before it have made; \\1 and the like stand for its groups, nothing for groups that took no part."""
    for pattern, new in rules:
        text = F.regexp_replace(text, pattern, re.sub(r"\\(\d)", r"$\1", new.replace("$", "\\$")))
    return text


def finite(value: Column, default: float = 0.0) -> Column:
    """value, or the default where it is null, NaN or infinite."""
    v = value.cast("double")
    return F.when(v.isNull() | F.isnan(v) | v.isin(float("inf"), float("-inf")), F.lit(default)).otherwise(v)


def decomposed_entities(text: Column) -> Column:
    """Numeric character references decoded; those of no character stay."""
    parts = F.regexp_extract_all(text, F.lit(r"&#x?[0-9A-Fa-f]+;|[^&]+|&"), F.lit(0))

    def one(p: Column) -> Column:
        digits = F.regexp_extract(p, r"^&#x?([0-9A-Fa-f]+);$", 1)
        code = F.when(p.startswith("&#x"), F.conv(digits, 16, 10).cast("int")).otherwise(F.try_to_number(digits, F.lit("9999999")).cast("int"))
        return F.when((digits != "") & code.between(32, 0xD7FF), F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")).otherwise(p)

    return F.array_join(F.transform(parts, one), "")
