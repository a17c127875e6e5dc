"""Streams: exposure counts, review state, unknown-word logs, and event-time windows with late data."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wordloom.operators.review import DID_NOT, EASE, eased, exposures, FIRST, KNEW, LEAST, SECOND


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of JSON lines as a stream; lines that do not parse are left out."""
    rows = spark.readStream.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)
    return rows.filter("_corrupt_record is null").drop("_corrupt_record")


def exposure_stream(seen: DataFrame, late: str = "1 hour") -> DataFrame:
    return exposures(seen.withWatermark("ts", late))


def tumbling(events: DataFrame, size: str, late: str | None = None, keys: tuple[str, ...] = ("event_type",), slide: str | None = None) -> DataFrame:
    """Counts and sums by window; with late given, a stream forgets windows that are so far behind."""
    e = events.withWatermark("ts", late) if late else events
    window = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = e.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("w.start").alias("start"), *keys, "n", "total")


def sessions(events: DataFrame, gap: str, key: str = "user_id", late: str | None = None) -> DataFrame:
    """Runs of a key's events that lie less than a gap apart."""
    e = events.withWatermark("ts", late) if late else events
    g = e.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return g.select(key, F.col("w.start").alias("start"), "n", "total")


class ReviewState(StatefulProcessor):
    """(repetitions, interval, ease) of each head, moved on by its reviews in the order of their times."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("review", "repetitions int, interval double, ease double, reviews long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        reps, days, ease, n = self.state.get() if self.state.exists() else (0, 0.0, EASE, 0)
        batch = pd.concat(list(rows)).sort_values(["ts", "tie"])
        for knew in batch["knew"]:
            days = FIRST if not knew or reps == 0 else SECOND if reps == 1 else days * ease
            ease = max(LEAST, eased(ease, KNEW if knew else DID_NOT))
            reps, n = (reps + 1 if knew else 0), n + 1
        self.state.update((reps, days, ease, n))
        yield pd.DataFrame({"head": [key[0]], "repetitions": [reps], "interval": [days], "ease": [ease], "reviews": [n]})

    def close(self) -> None:
        pass


def review_stream(reviews: DataFrame) -> DataFrame:
    """reviews (head, ts, tie, knew) to the state of each head that a batch touches (update mode, RocksDB state store)."""
    return reviews.groupBy("head").transformWithStateInPandas(ReviewState(), "head string, repetitions int, interval double, ease double, reviews long", "Update", "None")


def unknown_log(log: DataFrame, most: int = 30, script: str = "[က-႟]") -> DataFrame:
    """Counts of unknown segments in a stream of log records (time, q, segment, token, kind); null, foreign and overlong ones
    are left out."""
    word = F.coalesce(F.nullif(F.trim("segment"), F.lit("")), F.trim("token"))
    kept = log.withColumn("token", word).filter(F.col("token").rlike(script) & (F.length("token") <= most))
    return kept.groupBy("token").agg(F.count("*").alias("n"))
