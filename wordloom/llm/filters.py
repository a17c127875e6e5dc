"""Interaction audit of five text filters over all orders in which they may be applied.

The five failures of a text are five bits. A table, computed once, holds for each of the 32 sets of failures and each of
the 120 orders the step that removes the text. Tasks count texts by part, set and label, look their steps up in the table,
and the partial arrays are summed. All else follows from these sums: a filter that comes first removes all that fail it,
one that comes last all that fail nothing else.
"""

from __future__ import annotations

import hashlib
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.llm.common import slices, word_codes, written

FILTERS = "ABCDE"
ORDERS = list(permutations(range(len(FILTERS))))
NEVER = len(FILTERS)  # the place after the last step: kept to the end


def _first_failures() -> np.ndarray:
    """32 by 120: the place in the order (from 0) of the first filter that a set of failures fails; NEVER if there is none."""
    sets = np.arange(1 << len(FILTERS))
    fails = (sets[:, None, None] >> np.array(ORDERS)[None]) & 1
    return np.where(fails.any(axis=2), fails.argmax(axis=2), NEVER)


FIRST = _first_failures()
#: For each set of failures, label and order: the cell of (order, place, label).
CELLS = (np.arange(len(ORDERS))[None, None, :] * (NEVER + 1) + FIRST[:, None, :]) * 4 + np.arange(4)[None, :, None]
SYMBOL = np.isin(np.arange(256), np.frombuffer(b"#$%&*|", np.uint8))


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts without nulls, and the n + 1 places among them where texts begin and end."""
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    at = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, at - at[0]


def counted(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many flags are set between each two places."""
    out, some = np.zeros(len(at) - 1, np.int64), np.diff(at) > 0
    if some.any():
        out[some] = np.add.reduceat(flags.view(np.uint8), at[:-1][some], dtype=np.int64)
    return out


def failures(column: pa.Array) -> np.ndarray:
    """Bits A to D of each text: few words, few distinct words, many capitals, symbols."""
    words, codes, sizes = word_codes(column, lower=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    distinct = np.bincount(np.unique(row * max(len(words), 1) + codes) // max(len(words), 1), minlength=len(sizes))
    flat, at = flat_text(column)
    capitals, points, symbols = (counted(f, at) for f in ((flat >= 65) & (flat <= 90), (flat & 0xC0) != 0x80, SYMBOL[flat]))
    return (sizes < 200) * 1 + (100 * distinct < 50 * sizes) * 2 + (100 * capitals > 3 * points) * 4 + (symbols > 0) * 8


def marks(docs: DataFrame) -> DataFrame:
    """(id, part, fails, h1, h2) of rows (id, text, part); h1 and h2 are 128 bits of the text's SHA-256. No shuffle."""

    def run(batches):
        for b in slices(batches, 1 << 22):
            flat, at = flat_text(b.column(1))
            data = memoryview(flat)
            digest = b"".join(hashlib.sha256(data[x:y]).digest()[:16] for x, y in zip(at[:-1].tolist(), at[1:].tolist()))
            h = np.frombuffer(digest, "<i8").reshape(-1, 2)
            fails = pa.array(failures(b.column(1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), fails, pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy())], ["id", "part", "fails", "h1", "h2"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, part string, fails int, h1 long, h2 long")


def removals(rows: DataFrame, most_parts: int = 1024) -> DataFrame:
    """(part, ord, place, removed, good, toxic): sums over rows (part, fails, label) for each order and place, where place
    5 means never. A task holds 128 counts for each part it has met, and sends them on when these are many."""

    def sent(held: dict[str, np.ndarray]) -> pa.RecordBatch:
        sums = np.stack([np.bincount(CELLS.ravel(), np.repeat(c, len(ORDERS)), len(ORDERS) * (NEVER + 1) * 4) for c in held.values()]).astype(np.int64).reshape(-1, 4)
        order, place = np.divmod(np.arange(len(ORDERS) * (NEVER + 1), dtype=np.int32), np.int32(NEVER + 1))
        parts = pa.array(list(held)).take(pa.array(np.repeat(np.arange(len(held)), len(order))))
        repeat = lambda x: pa.array(np.tile(x, len(held)))
        return pa.RecordBatch.from_arrays(
            [parts, repeat(order), repeat(place), pa.array(sums.sum(axis=1)), pa.array(sums[:, 1] + sums[:, 3]), pa.array(sums[:, 2] + sums[:, 3])], ["part", "ord", "place", "removed", "good", "toxic"]
        )

    def run(batches):
        held: dict[str, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            named = b.column(0).dictionary_encode()
            cell = (np.asarray(named.indices, np.int64) * 32 + b.column(1).to_numpy()) * 4 + b.column(2).to_numpy()
            for part, c in zip(named.dictionary.to_pylist(), np.bincount(cell, minlength=len(named.dictionary) * 128).reshape(-1, 128)):
                held[part] = held[part] + c if part in held else c
                if len(held) >= most_parts:
                    yield sent(held)
                    held = {}
        if held:
            yield sent(held)

    partial = rows.select("part", "fails", "label").mapInArrow(run, "part string, ord int, place int, removed long, good long, toxic long")
    return partial.groupBy("part", "ord", "place").agg(*(F.sum(c).alias(c) for c in ("removed", "good", "toxic")))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for each part, order
    of the filters and step. labels: (id_col, quality, toxic).

    Filters: A under 200 words; B under half of the words distinct; C over 3 % capitals; D holds any of #$%&*|; E equal
    to the text of a smaller id, in any part. A null text is empty and a null part is the empty string. A row with a null
    id never fails E, nor makes another fail, and has no labels; rows of equal id and text do not fail E by each other. Of
    several labels of one id each counts that any of them gives; null labels give none. Repeated rows count each. An empty
    table gives no rows. Only (id, hash, failures) are shuffled, by id: copies of one text do not meet in a task.
    """
    src = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part")
    )
    rows = written(marks(src), "failures")
    first = rows.filter("id is not null").groupBy("h1", "h2").agg(F.min("id").alias("id")).withColumn("is_first", F.lit(True))
    label = labels.filter(F.col(f"`{id_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("id"))
    label = label.agg((F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int")) + 2 * F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("int"))).alias("label"))
    named = rows.filter("id is not null").join(first, ["id", "h1", "h2"], "left").join(label, "id", "left")
    fails = F.when(F.col("is_first"), F.col("fails")).otherwise(F.col("fails") + 16)
    every = named.select("part", fails.alias("fails"), F.coalesce("label", F.lit(0)).alias("label")).unionByName(rows.filter("id is null").select("part", "fails", F.lit(0).alias("label")))
    sums = removals(every).repartition("part")
    steps = Window.partitionBy("part", "ord").orderBy("place")
    rest = F.sum("removed").over(steps.rowsBetween(1, Window.unboundedFollowing))
    orders = F.array(*(F.lit("".join(FILTERS[f] for f in o)) for o in ORDERS))
    named_step = sums.select("*", F.element_at(orders, F.col("ord") + 1).alias("filter_order"), rest.alias("kept")).filter(F.col("place") < NEVER)
    named_step = named_step.withColumn("filter", F.expr("substring(filter_order, place + 1, 1)"))
    one = Window.partitionBy("part", "filter")
    at = lambda place: F.max(F.when(F.col("place") == place, F.col("removed"))).over(one)
    return named_step.select(
        "part", "filter_order", (F.col("place") + 1).cast("int").alias("step"), "kept", "removed", (at(0) - F.col("removed")).alias("redundant"), at(NEVER - 1).alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), F.sum("removed").over(one).alias("shapley"),
    )
