"""Clauses by the marker words that follow verbs: sequences, their classes, and the pieces that they end.

A sentence is one bounded row of tokens, and all about it is worked out within the row: for each verb the markers after it
are gathered by one fold with a look-ahead, and classified by what is in them. Tokens: (key, i from 0 without gaps, form,
pos, deprel), or rows (key, t) that hold a sentence's tokens in order, as gathered gives them. Null fields count as
empty; a sentence without tokens has no rows.

Steps are chained as transforms of one array. (What a lambda names besides its own item may be computed again for each
item, so it is a column of a row that several expressions read.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions import markers as m

MARKING = ["PART", "SCONJ", "ADP", "CCONJ"]


def _isin(form: Column, words: list[str]) -> Column:
    return form.isin(*words)


#: The longest word that a joined sequence may end in.
LONGEST = max(map(len, m.STRONG))


def gathered(tokens: DataFrame, key: str = "doc") -> DataFrame:
    """(key, t): a sentence's tokens in order; of rows that are so already, the same."""
    if "t" in tokens.columns:
        return tokens
    field = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    return tokens.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", field("form"), field("pos"), field("deprel")))).alias("t"))


def sequences(ahead: int) -> Column:
    """Of gathered rows, the array of (verb, form, deprel, m) that marker_sequences has as rows. Neighbours that are no
    punctuation are looked for only beside the verb of saying, and sequences only where one can begin."""
    none = F.expr("cast(array() as array<struct<i:int,form:string,pos:string>>)")
    words = lambda first, n: F.filter(F.slice("t", first, n), lambda x: x["pos"] != "PUNCT")
    after = lambda i: F.coalesce(F.get(words(i + 2, F.size("t")), F.lit(0))["form"], F.lit(""))
    before = lambda k: F.try_element_at(words(F.lit(1), k), F.lit(-1))["form"]

    def said(s: Column, x: Column) -> Column:
        last, beyond = F.coalesce(F.try_element_at(s["m"], F.lit(-1))["form"], F.lit("")), after(x["i"].cast("int"))
        return _isin(last, m.FINAL) & _isin(beyond, m.CONDITIONS) | (x["pos"] == "VERB") & _isin(last, m.QUOTES) & _isin(beyond, m.FINAL)

    def step(s: Column, x: Column) -> Column:
        marks = _isin(x["pos"], MARKING) | (x["form"] == m.SAY) & said(s, x)
        more = F.struct(F.lit(True).alias("open"), F.array_append(s["m"], F.struct(x["i"].cast("int").alias("i"), x["form"].alias("form"), x["pos"].alias("pos"))).alias("m"))
        return F.when(~s["open"] | (x["pos"] == "PUNCT"), s).when(marks, more).otherwise(F.struct(F.lit(False).alias("open"), s["m"].alias("m")))

    start = F.struct(F.lit(True).alias("open"), none.alias("m"))
    heads = lambda x: (x["pos"] == "VERB") | (x["pos"] == "ADJ") & x["deprel"].isin("acl", "root", "advcl")
    begins = lambda k: F.get("t", k + 1)["pos"].isin("PUNCT", *MARKING)
    quoted = lambda x, k: (x["form"] == m.SAY) & (x["pos"] == "VERB") & F.coalesce(_isin(before(k), m.QUOTES), F.lit(False))
    found = lambda x, k: F.struct(x["i"].alias("verb"), x["form"].alias("form"), x["deprel"].alias("deprel"), F.aggregate(F.slice("t", k + 2, F.lit(ahead)), start, step, lambda s: s["m"]).alias("m"))
    each = F.transform("t", lambda x, k: F.when(heads(x) & begins(k) & ~quoted(x, k), found(x, k)))
    return F.filter(each, lambda s: F.size(s["m"]) > 0)


def marker_sequences(tokens: DataFrame, ahead: int = 12, key: str = "doc") -> DataFrame:
    """(key, verb, form, deprel, m array<(i, form, pos)>): for each verb, and each adjective that heads a clause, the markers that
    follow it, up to so many tokens on; punctuation among them is passed over. The verb of saying counts as a marker
    between a sentence's end and a condition, and between a quotation and a sentence's end; there it starts no clause."""
    texts = gathered(tokens, key)
    return texts.select(key, F.explode_outer(sequences(ahead)).alias("x")).filter("x is not null").select(key, "x.*")


def longest_of(words: Column) -> Column:
    """The longest of the words, of equally long ones the least; null of none."""
    return F.array_min(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))["w"]


def kinds_of(found: Column) -> Column:
    """The array of sequences (structs with deprel and m), each with its kind and trigger, in steps that read the one before."""
    more = lambda fields: lambda s: F.struct(s.alias("s"), *(c.alias(n) for n, c in fields(s).items()))
    nominal = lambda x: _isin(x["form"], m.NOMINALIZERS) & x["pos"].isin("PART", "NOUN")
    parts = F.transform(found, more(lambda s: {
        "f": F.transform(s["m"], lambda x: x["form"]), "main": F.filter(s["m"], lambda x: ~_isin(x["form"], m.AUXILIARIES)), "last": F.try_element_at(s["m"], F.lit(-1)),
    }))
    read = F.transform(parts, more(lambda s: {
        "all": F.array_join(s["f"], ""), "first": F.get(s["main"], F.lit(0)), "nominal": F.get(F.filter(s["main"], nominal), F.lit(0))["form"], "before": F.try_element_at(s["main"], F.lit(-1))["form"],
        "moderate": longest_of(F.filter(s["f"], lambda w: _isin(w, m.MODERATE))),
    }))

    def strong(s: Column) -> Column:
        """A strong marker among the forms, or of two letters or more at the end of all joined, or all of them."""
        n = F.length(s["all"])
        ends = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.least(n, F.lit(LONGEST))), lambda k: F.when((k > 1) | (k == n), F.right(s["all"], k))))
        among = F.filter(s["s"]["f"], lambda w: _isin(w, m.STRONG))
        return longest_of(F.concat(among, F.coalesce(F.filter(ends, lambda w: _isin(w, m.STRONG)), F.expr("cast(array() as array<string>)"))))

    told = F.transform(read, more(lambda s: {
        "strong": strong(s),
        "phrase": F.coalesce(nominal(s["first"]), F.lit(False)) & F.forall(F.slice(s["s"]["main"], 2, F.greatest(F.size(s["s"]["main"]) - 1, F.lit(0))), lambda x: _isin(x["form"], m.NOMINAL_TAIL) | x["pos"].isin("ADP", "SCONJ")),
    }))

    def kind(x: Column) -> Column:
        r, p = x["s"], x["s"]["s"]
        form = p["last"]["form"]
        end = _isin(form, m.FINAL)
        of = lambda name, word: F.struct(F.lit(name).alias("kind"), word.cast("string").alias("trigger"))
        named = (
            F.when(x["phrase"], of("nominalizer", r["first"]["form"]))
            .when(x["strong"].isNotNull(), of("strong", x["strong"]))
            .when(end & r["nominal"].isNotNull() & _isin(form, m.CASE_LIKE), of("nominalizer", r["nominal"]))
            .when(end & (p["s"]["deprel"] == "acl") & _isin(form, m.ADNOMINAL), of("relativizer", form))
            .when(end & (form == m.TOPIC) & F.array_contains(p["f"], F.lit(m.PLURAL)), of("none", F.lit(None)))
            .when(end & (r["before"].isNull() | _isin(r["before"], m.FINAL)), of("final", form))
            .when(_isin(form, m.NOMINALIZERS) & p["last"]["pos"].isin("PART", "NOUN"), of("nominalizer", form))
            .when(_isin(form, m.RELATIVIZERS), of("relativizer", form))
            .when(r["moderate"].isNotNull(), of("moderate", r["moderate"]))
            .otherwise(of("none", F.lit(None)))
        )
        return F.struct(p["s"].alias("s"), named.alias("k"))

    flat = lambda x: F.struct(*(x["s"][c].alias(c) for c in ("verb", "form", "deprel", "m")), x["k"]["kind"].alias("kind"), x["k"]["trigger"].alias("trigger"))
    return F.transform(F.transform(told, kind), flat)


def classified(sequences: DataFrame) -> DataFrame:
    """sequences with kind (strong, moderate, final, nominalizer, relativizer, none) and trigger, the marker that makes it so.

    In this order: a nominalizer with nothing but case after it; a strong marker in the sequence, or at the end of its
    joined forms; a sentence's end as the last one, which after a nominalizer is case, in a relative clause an adnominal,
    after a plural the topic, and else final if auxiliaries alone, or another end, stand before it; a nominalizer or a
    relativizer as the last one; a moderate marker anywhere. Of several words the longest is the trigger."""
    one = F.array(F.struct("verb", "form", "deprel", "m"))
    told = sequences.withColumn("_k", F.get(kinds_of(one), F.lit(0)))
    return told.select(*sequences.columns, "_k.kind", "_k.trigger")


def ended(tokens: DataFrame, kinds: list[str], ahead: int, key: str) -> DataFrame:
    """(key, t, e): sentences with the array of the (end, verb, kind, trigger) of some kinds, in this order."""
    texts = gathered(tokens, key)
    found = F.filter(kinds_of(sequences(ahead)), lambda s: s["kind"].isin(kinds))
    ends = F.transform(found, lambda s: F.struct(F.try_element_at(s["m"], F.lit(-1))["i"].alias("end"), s["verb"].alias("verb"), s["kind"].alias("kind"), s["trigger"].alias("trigger")))
    return texts.select(key, "t", F.array_sort(ends).alias("e"))


def boundaries(tokens: DataFrame, ahead: int = 12, key: str = "doc") -> DataFrame:
    """(key, verb, end, kind, trigger): clause ends, after the last marker of each sequence; nominalized ones are none."""
    found = ended(tokens, ["strong", "moderate", "final", "relativizer"], ahead, key)
    return found.select(key, F.explode_outer("e").alias("x")).filter("x is not null").select(key, "x.verb", "x.end", "x.kind", "x.trigger")


def clause_chunks(tokens: DataFrame, moderate: bool = True, relative: bool = False, ahead: int = 12, key: str = "doc") -> DataFrame:
    """(key, k, first, last, text, kind, trigger): sentences cut after strong, final and, as asked, moderate and relative ends; the rest
    of one is a remainder, one without cuts single. Of two ends at one place the first verb's counts. Punctuation is left
    out of the texts; pieces of nothing else go."""
    kinds = ["strong", "final", *(["moderate"] if moderate else []), *(["relativizer"] if relative else [])]
    found = ended(tokens, kinds, ahead, key)
    first = F.filter("e", lambda x, k: (k == 0) | (F.get("e", k - 1)["end"] != x["end"]))
    texts = found.select(key, "t", F.transform(first, lambda x: F.struct(x["end"].alias("end"), F.struct(x["kind"].alias("kind"), x["trigger"].alias("trigger")).alias("b"))).alias("c"))
    last = F.size("t") - 1
    upto = F.concat(F.transform("c", lambda x: x["end"].cast("int")), F.filter(F.array(last), lambda n: F.coalesce(F.try_element_at("c", F.lit(-1))["end"] < n, F.lit(True))))

    def piece(end: Column, k: Column) -> Column:
        begin = F.when(k > 0, F.get("_upto", k - 1) + 1).otherwise(0)
        words = F.transform(F.filter(F.slice("t", begin + 1, F.greatest(end - begin + 1, F.lit(0))), lambda x: x["pos"] != "PUNCT"), lambda x: x["form"])
        own = F.get("c", k)["b"]
        kind = F.when(own.isNotNull(), own["kind"]).when(F.size("c") > 0, "remainder").otherwise("single")
        return F.struct(begin.alias("first"), end.alias("last"), F.array_join(words, " ").alias("text"), kind.alias("kind"), own["trigger"].alias("trigger"))

    pieces = F.filter(F.transform("_upto", piece), lambda p: (F.trim(p["text"]) != "") | (p["kind"] == "single"))
    rows = texts.withColumn("_upto", upto).select(key, F.posexplode_outer(pieces).alias("k", "p")).filter("p is not null")
    return rows.select(key, "k", "p.*")
