"""What an operator needs to know about a script: which characters make words, sentences and clusters."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unicode ranges of Myanmar vowel signs, medials, tone marks and the like, which follow a base character.
MYANMAR_MARKS = (
    r"ါ-ှၖ-ၙၞ-ၠၢ-ၤၧ-ၭၱ-ၴႂ-ႍႏ႔ႚ-ႝ"
)
MYANMAR_BASES = r"က-ဿ၊-႟"


@dataclass(frozen=True)
class ScriptProfile:
    """Patterns are in the syntax that Java shares with other engines wherever an oracle must agree."""

    name: str
    letter: str  # class body of the characters of the script
    word: str  # pattern of a token, applied to the text (after lower-casing, if cased)
    cluster: str  # pattern of a grapheme cluster
    enders: str  # class body of sentence enders
    cased: bool

    def norm(self, text: Column) -> Column:
        return F.lower(text) if self.cased else text

    def headword(self, text: Column) -> Column:
        """Characters of the script alone, punctuation of its block included, as lookup keys have them."""
        return F.trim(F.regexp_replace(self.norm(text), f"[^{self.letter}]", ""))

    def in_script(self, text: Column) -> Column:
        return text.rlike(f"[{self.letter}]")


MYANMAR = ScriptProfile(
    "myanmar",
    r"က-႟",
    r"[က-၉၌-႟ꩠ-ꩿꧠ-꧿]+",
    f"[{MYANMAR_BASES}][{MYANMAR_MARKS}]*(?:(?<=\\u1039)[\\u1000-\\u1021][{MYANMAR_MARKS}]*)*|[^{MYANMAR_BASES}][^\\u1000-\\u109F]*",
    r"။",
    False,
)
LATIN = ScriptProfile("latin", "a-zà-öø-ÿ", "[a-zà-öø-ÿ]+", "[a-zà-öø-ÿ]", ".!?", True)
