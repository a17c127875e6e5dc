"""Chat formatting in windows of a token budget.

A conversation becomes windows of whole turns. Each window begins with the system turn and as many of the turns before
it as fit a history budget; these are repeated, and their text is not under the loss mask. New turns follow as long as
prefix sums of the turns' tokens stay within the budget. So each turn is new in one window, and each assistant text is
learnt once. DataFrame functions only.

A turn is <|im_start|>role, line end, text, <|im_end|>, line end. Inside texts and roles, \\ is written \\\\ and <| is
written <\\|, so no text can end its turn; a role's line end is written <|nl|>.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.common import running

START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"


@dataclass(frozen=True)
class Budget:
    """Tokens are counted as words that white space separates, plus `turn` for a turn's marks."""

    window: int = 400
    history: int = 100
    turn: int = 4


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def turns_of(df: DataFrame, budget: Budget, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turns array<(turn, role, text, cost)>): each conversation's rows by turn, ties by role and text."""
    text, role = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), role.alias("role"), text.alias("text"))
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = rows.withColumn("cost", (words + budget.turn).cast("long"))
    return rows.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "cost"))).alias("turns"))


def windows(df: DataFrame, budget: Budget = Budget(), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each window: conv, window (from 0), formatted, loss array<(start, length)> in code points, repeated
    (turns at the beginning that are no new ones), tokens.

    A turn that alone exceeds the budget is a window's only new turn, uncut. Null texts and roles are empty; rows with a
    null conversation are one conversation of their own; a null turn comes first; repeated rows are turns each. An empty
    table gives none. A conversation's turns meet in one task, since its digest and its windows depend on their order.
    """
    b = budget
    conv = turns_of(df, b, conv_col, turn_col, role_col, text_col)
    system = F.when(F.get("turns", F.lit(0))["role"] == "system", 1).otherwise(0)
    conv = conv.withColumn("system", system).withColumn("system_cost", F.when(F.col("system") == 1, F.get("turns", F.lit(0))["cost"]).otherwise(F.lit(0).cast("long")))
    # Prefix sums: sums[i] is the cost of the first i turns.
    costs = F.transform("turns", lambda t: t["cost"])
    conv = conv.withColumn("sums", F.concat(F.array(F.lit(0).cast("long")), running(costs, "bigint"))).withColumn("n", F.size("turns"))
    sums = lambda i: F.get("sums", i)

    def begin(at: Column) -> Column:
        """First repeated turn of the history of a window whose new turns begin at `at`; the system turn is no history. A
        turn costs b.turn at least, so only so many before `at` can fit."""
        least = F.greatest(F.col("system"), at - (b.history // b.turn + 1))
        fits = F.filter(F.sequence(least, F.greatest(at, least)), lambda i: (i <= at) & (sums(at) - sums(i) <= b.history))
        return F.coalesce(F.get(fits, F.lit(0)), at)

    def step(state: Column, i: Column) -> Column:
        """state: starts of windows, and the cost of the current one's repeated turns."""
        at = F.element_at(state["starts"], -1)
        full = (state["repeated"] + sums(i + 1) - sums(at) > b.window) & (i > at)
        return F.when(full, F.struct(F.array_append(state["starts"], i).alias("starts"), (F.col("system_cost") + sums(i) - sums(begin(i))).alias("repeated"))).otherwise(state)

    first = F.struct(F.array(F.lit(0)).alias("starts"), F.lit(0).cast("long").alias("repeated"))
    starts = F.aggregate(F.sequence(F.lit(0), F.col("n") - 1), first, step, lambda s: s["starts"])
    head = lambda at: F.when((F.col("system") == 1) & (at > 0), F.slice("turns", 1, 1)).otherwise(F.slice("turns", 1, 0))

    def window(at: Column, k: Column) -> Column:
        """A window with the turns that it shows, so that a row carries these and not the whole conversation."""
        end = F.coalesce(F.get("starts", k + 1), F.col("n"))
        shown = F.concat(head(at), F.slice("turns", begin(at) + 1, end - begin(at)))
        return F.struct(k.alias("window"), shown.alias("shown"), (F.size(head(at)) + at - begin(at)).alias("repeated"))

    rows = conv.withColumn("starts", starts).select("conv", F.explode_outer(F.transform("starts", window)).alias("w")).filter("w is not null").select("conv", "w.*")
    lead = lambda t: F.concat(F.lit(START), F.replace(escaped(t["role"]), F.lit("\n"), F.lit(LINE)), F.lit("\n"))
    rows = rows.withColumn("parts", F.transform("shown", lambda t: F.struct(lead(t).alias("lead"), escaped(t["text"]).alias("body"), (t["role"] == "assistant").alias("target"))))
    empty = F.expr("cast(array() as array<struct<start:int,length:int>>)")

    def lay(state: Column, p: Column) -> Column:
        start, size = state["at"] + F.length(p["lead"]), F.length(p["body"])
        learnt = p["target"] & (state["k"] >= F.col("repeated"))
        loss = F.when(learnt, F.array_append(state["loss"], F.struct(start.alias("start"), size.alias("length")))).otherwise(state["loss"])
        return F.struct((start + size + len(END)).alias("at"), (state["k"] + 1).alias("k"), loss.alias("loss"))

    loss = F.aggregate("parts", F.struct(F.lit(0).alias("at"), F.lit(0).alias("k"), empty.alias("loss")), lay, lambda s: s["loss"])
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["lead"], p["body"], F.lit(END))), "")
    tokens = F.aggregate("shown", F.lit(0).cast("long"), lambda a, t: a + t["cost"])
    return rows.select(F.col("conv").alias(conv_col), "window", text.alias("formatted"), loss.alias("loss"), "repeated", tokens.alias("tokens"))


def read_back(formatted: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv, turns array<(role, text)>, learnt array<string>, formatted_chars): conversations from their windows alone."""
    turn = F.transform(
        F.filter(F.split("formatted", r"<\|im_end\|>\n", -1), lambda t: t != ""),
        lambda t: F.struct(
            unescaped(F.replace(F.substring_index(F.substr(t, F.lit(len(START) + 1)), "\n", 1), F.lit(LINE), F.lit("\n"))).alias("role"),
            unescaped(F.substr(t, F.position(F.lit("\n"), t) + 1)).alias("text"),
        ),
    )
    new = F.slice(turn, F.col("repeated") + 1, F.greatest(F.size(turn) - F.col("repeated"), F.lit(0)))
    learnt = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"])))
    one = formatted.select(F.col(f"`{conv_col}`").alias("conv"), F.struct("window", new.alias("new"), learnt.alias("learnt"), F.length("formatted").cast("long").alias("chars")).alias("w"))
    all_ = one.groupBy("conv").agg(F.array_sort(F.collect_list("w")).alias("ws"))
    return all_.select(
        F.col("conv").alias(conv_col), F.flatten(F.transform("ws", lambda w: w["new"])).alias("turns"), F.flatten(F.transform("ws", lambda w: w["learnt"])).alias("learnt"),
        F.aggregate("ws", F.lit(0).cast("long"), lambda a, w: a + w["chars"]).alias("formatted_chars"),
    )
