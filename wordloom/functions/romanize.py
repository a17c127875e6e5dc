"""Romanization of Myanmar syllables as column expressions: one pattern cuts a text, lookups and cases read each syllable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Sounds of letters at the beginning and at the end of a syllable, of medials and of signs that stand alone.
ONSETS = {
    "က": "k", "ခ": "kh", "ဂ": "g", "ဃ": "gh", "င": "ng", "စ": "s", "ဆ": "hs", "ဇ": "z", "ဈ": "zh", "ဉ": "ny", "ည": "ny", "ဋ": "t", "ဌ": "ht", "ဍ": "d",
    "ဎ": "dh", "ဏ": "n", "တ": "t", "ထ": "ht", "ဒ": "d", "ဓ": "dh", "န": "n", "ပ": "p", "ဖ": "hp", "ဗ": "b", "ဘ": "bh", "မ": "m", "ယ": "y", "ရ": "y",
    "လ": "l", "ဝ": "w", "သ": "th", "ဟ": "h", "ဠ": "l", "အ": "",
}
CODAS = {
    "က": "k", "ခ": "k", "ဂ": "k", "ဃ": "k", "စ": "t", "ဆ": "t", "ဇ": "t", "ဈ": "t", "ဋ": "t", "ဌ": "t", "ဍ": "t", "ဎ": "t", "တ": "t", "ထ": "t",
    "ဒ": "t", "ဓ": "t", "ပ": "p", "ဖ": "p", "ဗ": "p", "ဘ": "p", "င": "ng", "ဏ": "n", "ည": "ny", "န": "n", "မ": "m", "ယ": "y", "ရ": "y", "လ": "l",
    "ဝ": "w", "သ": "th", "ဿ": "th",
}
VOWEL_LETTERS = {
    "ဣ": "i", "ဤ": "i", "ဥ": "u", "ဦ": "u", "ဧ": "e", "ဩ": "aw", "ဪ": "aw",
}
ALONE = {
    "၌": "ywe", "၍": "hnaik", "၎": "lanykaung", "၏": "i", "၎င်း": "lanykaung", "၀": "0", "၁": "1", "၂": "2", "၃": "3", "၄": "4", "၅": "5", "၆": "6", "၇": "7", "၈": "8",
    "၉": "9", "၊": ",", "။": ".", "ဿ": "ss",
}
PALATAL = {
    "က": "c", "ခ": "ch", "ဂ": "j", "ဃ": "j", "င": "ny",
}
STOPS = "ကခဂဃစဆဇဈဋဌဍဎတထဒဓပဖဗဘ"
SILENT_AFTER_O = "ယရလဝဟဠ"
SHIFTED_BY_WA = "ကတပနငမ"
BREATHY = "ငဉညနဏမလဝဠ"
# What a vowel and the letter that ends the syllable become together, by vowel and letter: vowel and end.
RHYMES = {
    "a": {"က": ("e", "k"), "ခ": ("e", "k"), "ဂ": ("e", "k"), "ဃ": ("e", "k"), "င": ("i", "n"), "ဉ": ("i", ""), "ည": ("i", "n"), "န": ("a", "n"), "ဏ": ("a", "n"), "မ": ("a", "n"), "စ": ("i", "t")},
    "i": {"က": ("ei", "k"), "တ": ("ei", "t"), "ပ": ("ei", "p"), "စ": ("ei", "t"), "ဆ": ("ei", "p"), "န": ("ei", "n"), "ည": ("ei", "n"), "င": ("ei", "n")},
    "u": {"က": ("ou", "k"), "တ": ("ou", "t"), "ပ": ("ou", "p"), "စ": ("ou", "t"), "ဆ": ("ou", "p"), "န": ("ou", "n"), "င": ("ou", "n")},
    "o": {"က": ("ai", "k"), "န": ("ai", "n"), "င": ("o", "n")},
    "aw": {"က": ("au", "k"), "င": ("au", "n")},
    "ei": {"က": ("ei", "k"), "င": ("ei", "n")},
}
LETTER, OWN = "က-ဈဉညဋ-အ", "ဣဤဥဦဧဩဪ"
MARK = "ါ-ဲံ-်ျ-ှ"
SYLLABLE = (
    f"၎င်း|[၌-၏၀-၉၊။]|ေ*[{LETTER}{OWN}](?:္[{LETTER}]|[{MARK}ဿ္]|[{LETTER}](?=[ံ့း]*်))*|ေ+[{MARK}]*|[^က-႟]|[\\s\\S]"
)


def _map(table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in table.items() for x in pair))


def syllables(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SYLLABLE), F.lit(0))


def analysed(syllable: Column) -> Column:
    """(orth, roman, onset, vowel, coda, tone, is_minor) of one syllable; what is not Myanmar stands for itself."""
    get = lambda pattern, k=1: F.regexp_extract(syllable, pattern, k)
    head = rf"^ေ*([{LETTER}{OWN}])((?:္[{LETTER}])*)([ျြွှ]*)"
    base, stack, medials, rest = get(head, 1), get(head, 2), get(head, 3), F.regexp_replace(syllable, head, "")
    has = lambda where, chars: where.rlike(f"[{chars}]")
    coda = F.regexp_extract(rest, rf"([{LETTER}ဿ])[^{LETTER}ဿ]*$", 1)
    signs = F.concat(F.regexp_extract(syllable, "^(ေ*)", 1), F.regexp_replace(rest, "[^ါ-ဲ]", ""))
    ya, ra, wa, ha = (has(medials, c) for c in "ျြွှ")
    glide = (ya | ra) & ~wa
    palatal = glide & base.isin(list(PALATAL))
    sh = ha & ((base.isin("ယ", "ရ") & ~ya) | (base.isin("သ", "လ") & ya & ~wa))
    sh_eats_ya = sh & base.isin("သ", "လ")
    breathy = ha & ~sh & base.isin(list(BREATHY))
    shift = (wa | (base == "ဝ")) & coda.isin(list(SHIFTED_BY_WA))
    stacked = F.array_join(F.transform(F.split(F.replace(stack, F.lit("္"), F.lit("")), ""), lambda c: F.coalesce(_map(ONSETS)[c], F.lit(""))), "")
    letter = F.coalesce(_map(ONSETS)[base], _map(VOWEL_LETTERS)[base], F.lit(""))
    first = F.when(sh, "sh").when(palatal, _map(PALATAL)[base]).when(breathy, F.concat(F.lit("h"), letter)).otherwise(letter)
    # Of two glides one is eaten by wa, by the palatal or by sh; what is left is written in the order of the medials.
    ya_left, ra_left = ya & ~wa & ~(palatal & ya) & ~sh_eats_ya, ra & ~wa & ~(palatal & ~ya)
    glides = F.concat(F.when(ya_left, "y").otherwise(""), F.when(ra_left, "y").otherwise(""), F.when(wa & ~(wa & shift), "w").otherwise(""), F.when(ha & ~sh & ~breathy, "h").otherwise(""))
    onset = F.concat(stacked, first, glides)
    e, a, i, u, ai = (has(signs, c) for c in ("ေ", "ါာ", "ိီ", "ုူ", "ဲ"))
    plain = F.when(shift, "u").when(e & a, "aw").when(e & ai, "e").when(e, "ei").when(i & u, "o").when(i, "i").when(u, "u").when(ai, "e").otherwise("a")
    rhymes = F.create_map(*(x for v, ends in RHYMES.items() for c, pair in ends.items() for x in (F.lit(v + c), F.array(*map(F.lit, pair)))))
    rhyme = rhymes[F.concat(plain, coda)]
    mutates = ~shift & (coda != "") & rhyme.isNotNull() & (coda != "ဿ")
    vowel = F.when(mutates, F.get(rhyme, F.lit(0))).otherwise(plain)
    end = F.when(coda == "", "").when((plain == "o") & coda.isin(list(SILENT_AFTER_O)), "").when(mutates, F.get(rhyme, F.lit(1))).otherwise(F.coalesce(_map(CODAS)[coda], F.lit("")))
    nasal, high, creaky = has(rest, "ံ"), has(rest, "း"), has(rest, "့")
    coda_roman = F.concat(end, F.when(nasal, "n").otherwise(""))
    minor = (base != "") & ~base.isin(list(OWN)) & ~has(rest, "ါ-ဲ") & ~nasal & (coda == "") & ~high & ~creaky
    tone = F.when(coda.isin(list(STOPS)), "checked").when(high, "high").when(creaky, "creaky").when(has(signs, "ါာီူေဲ"), "low").otherwise("creaky")
    roman = F.when(minor, F.concat(onset, F.lit("ə"))).otherwise(F.concat(onset, vowel, coda_roman))
    alone, mine = _map(ALONE)[syllable], has(syllable, "က-႟")
    none = F.lit(None).cast("string")
    return F.struct(
        syllable.alias("orth"), F.when(~mine, syllable).otherwise(F.coalesce(alone, roman)).alias("roman"),
        *(F.when(mine & alone.isNull(), c).otherwise(none).alias(n) for n, c in (("onset", onset), ("vowel", F.when(minor, "ə").otherwise(vowel)), ("coda", coda_roman), ("tone", tone))),
        (mine & alone.isNull() & minor).alias("is_minor"),
    )


def g2p(text: Column) -> Column:
    """Array of analysed syllables."""
    return F.transform(syllables(text), analysed)


def romanized(text: Column, separator: str = "-") -> Column:
    """The syllables' sounds, blank ones left out."""
    return F.array_join(F.filter(F.transform(syllables(text), lambda s: analysed(s)["roman"]), lambda r: F.trim(r) != ""), separator)
