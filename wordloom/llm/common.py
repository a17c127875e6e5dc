"""Small helpers that the operators share."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only on one machine, and only where the session names no shared folder.
OWN_FOLDER = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session. A local session without one
    gets one of our own; a cluster without one is an error, since a machine's own folder would lose parts of tables."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = OWN_FOLDER
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: a table that outlives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that written() made. Only for those that no later plan reads: each round of a loop its last one's."""
    for t in tables:
        if path := getattr(t, "written_path", None):
            place = t.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, renamed, so that no other column can clash; null texts are empty."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from one numpy array a row, without Python objects for the items."""
    ends = np.cumsum([0, *map(len, values)], dtype=np.int64)
    flat = np.concatenate(values) if len(values) else np.zeros(0)
    if ends[-1] < 2**31:
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, type=kind))
    return pa.LargeListArray.from_arrays(pa.array(ends), pa.array(flat, type=kind))


def slices(batches, max_bytes: int = 1 << 24):
    """Arrow batches cut by the size of their text, so that a batch of long documents never fills the memory."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        rows = max(1, int(batch.num_rows * max_bytes / max(batch.nbytes, 1)))
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def gathered(table: list[bytes], codes: np.ndarray, sizes: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows put together from parts: codes name the parts (entries of table, numbers of a four-byte kind), sizes[r] of them
    for row r. Gives all numbers one after another, and how many each row has."""
    lengths = np.fromiter(map(len, table), np.int64, len(table)) // 4
    return taken(np.frombuffer(b"".join(table), kind), lengths, codes, sizes)


def taken(flat: np.ndarray, lengths: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As gathered, of parts whose numbers lie one after another, so many for each."""
    first = np.cumsum(lengths) - lengths
    n = lengths[codes]
    ends = np.cumsum(n)
    at = np.repeat(first[codes] - (ends - n), n)
    at += np.arange(len(at))
    upto = np.concatenate([[0], ends])
    last = np.cumsum(sizes)
    return flat[at], upto[last] - upto[last - sizes]


def word_codes(column: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of a column of texts, lower-cased in A-Z and cut at ASCII white space: the distinct words, the number of each word of
    the texts one after another among them, and how many words each text has."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(column) if lower else column)
    sizes = np.asarray(pc.list_value_length(split), dtype=np.int64)
    marked = split.flatten().dictionary_encode()
    words, codes = marked.dictionary, np.asarray(marked.indices, dtype=np.int64)
    empty = pc.index(words, pa.scalar("", words.type)).as_py()  # before white space at the edges
    if empty >= 0:
        none = codes == empty
        upto = np.concatenate([[0], np.cumsum(none)])
        last = np.cumsum(sizes)
        sizes = sizes - (upto[last] - upto[last - sizes])
        codes = codes[~none]
    return words, codes, sizes


def list_array(flat: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """An Arrow list column from its numbers one after another and how many each row has."""
    ends = np.concatenate([[0], np.cumsum(lengths)])
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat, type=kind))


def let(value: Column, use) -> Column:
    """use(value), with value computed once. (A column that a lambda names is computed again at each of its calls.)"""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column, kind: str = "int", op=lambda a, b: a + b, block: int = 128) -> Column:
    """Running sums (or another associative op with neutral element 0) of an array, each value included. Appending copies
    an array, so values are added up in blocks, and each block gets what the blocks before it have."""
    zero, none = F.lit(0).cast(kind), F.expr(f"cast(array() as array<{kind}>)")

    def scan(items: Column) -> Column:
        step = lambda s, x: F.struct(op(s["at"], x).alias("at"), F.array_append(s["all"], op(s["at"], x)).alias("all"))
        return F.aggregate(items, F.struct(zero.alias("at"), none.alias("all")), step, lambda s: s["all"])

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.greatest(F.size(v) - 1, F.lit(0)) / block).cast("int")), lambda g: F.slice(v, g * block + 1, F.lit(block)))
    last = lambda s: F.coalesce(F.get(s, F.size(s) - 1), zero)
    before = lambda parts: F.concat(F.array(zero), scan(F.transform(parts, last)))
    put = lambda s, b: F.transform(s, lambda x: op(x, b))
    whole = lambda parts: F.flatten(F.zip_with(parts, F.slice(before(parts), 1, F.size(parts)), put))
    return let(F.transform(let(values, cut), scan), whole)
