"""Spaced repetition: exposure counts, review state, and what is due."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Intervals in days, easiness and its bounds, grades.
FIRST, SECOND, EASE, LEAST, KNEW, DID_NOT = 1.0, 3.0, 2.5, 1.3, 4, 2


def exposures(seen: DataFrame, head: str = "head", ts: str = "ts", form: str = "form") -> DataFrame:
    return seen.groupBy(head).agg(F.count("*").alias("total_seen"), F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.max_by(form, F.struct(ts, form)).alias("last_form"))


def eased(ease, quality):
    """The easiness after an answer of a quality, before its lower bound; of columns and of numbers."""
    return ease + (0.1 - (5 - quality) * (0.08 + (5 - quality) * 0.02))


def graded(state: Column, knew: Column) -> Column:
    """The state (repetitions, interval in days, ease) after one review; intervals are not rounded."""
    q = F.when(knew, KNEW).otherwise(DID_NOT)
    ease = F.greatest(F.lit(LEAST), eased(state["ease"], q))
    reps = F.when(knew, state["repetitions"] + 1).otherwise(0)
    days = F.when(~knew | (state["repetitions"] == 0), FIRST).when(state["repetitions"] == 1, SECOND).otherwise(state["interval"] * state["ease"])
    return F.struct(reps.alias("repetitions"), days.alias("interval"), ease.alias("ease"))


def review_states(reviews: DataFrame, head: str = "head", ts: str = "ts") -> DataFrame:
    """(head, repetitions, interval, ease, reviews, last): each head's reviews (head, ts, knew, tie) folded in time order."""
    ordered = reviews.groupBy(head).agg(F.array_sort(F.collect_list(F.struct(ts, "tie", "knew"))).alias("r"))
    zero = F.struct(F.lit(0).alias("repetitions"), F.lit(0.0).alias("interval"), F.lit(EASE).alias("ease"))
    state = F.aggregate("r", zero, lambda s, x: graded(s, x["knew"]))
    return ordered.select(head, state.alias("s"), F.size("r").cast("long").alias("reviews"), F.element_at("r", -1)[ts].alias("last")).select(head, "s.*", "reviews", "last")


def due_after(last: Column, days: Column) -> Column:
    """The time so many days, which need not be whole, after another one."""
    return F.timestamp_micros(F.unix_micros(last.cast("timestamp")) + F.round(days * 86_400_000_000).cast("long"))


def next_cards(cards: DataFrame, now: Column, k: int = 1) -> DataFrame:
    """Due cards first, the longest due before the others, then by exposure; then new ones by exposure and first sight; then
    the earliest future one. A card with 0 repetitions, also after a failure, is new. cards: (head, repetitions, due,
    total_seen, first_seen)."""
    reviewed = (F.coalesce("repetitions", F.lit(0)) > 0) & F.col("due").isNotNull()
    bucket = F.when(~reviewed, 1).when(F.col("due") <= now, 0).otherwise(2)
    due = F.when(reviewed, F.col("due"))
    return cards.withColumn("bucket", bucket).orderBy("bucket", due.asc_nulls_last(), F.desc("total_seen"), "first_seen", "head").limit(k)
