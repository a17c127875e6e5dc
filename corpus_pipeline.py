"""A corpus pipeline of the operators: quality rules, near-duplicates, personal data, packing.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next one's docs. All but the last return the columns of documents, whatever these are named.

In all stages a null text counts as empty and stays null where its row stays; rows with a null id are rows like others;
repeated rows are judged each, and are copies to the second stage; texts of any length are whole; an empty table gives an
empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import packing, pii, quality, similar
from wordloom.llm.common import discard, shared_folder, written
from wordloom.llm.queries import END_ID, WORD_BPE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the compression bands reject go; texts without words, and null ones, are among them."""
    return quality.assess(docs, keep=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that share 0.8 of their five-word shingles stays, the one with the least id; a null id
    comes last, and of equal ids the row of least hash stays."""
    return similar.deduplicated(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans are masked in the texts, and n_chars, where there is such a column, follows them."""
    clean = pii.sanitised(docs)
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4,096 ids; a null or empty text is one piece, its end."""
    pieces = packing.pack(docs, WORD_BPE, END_ID)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", pack_sequences)]

#: Compression, XXH64 and tokens cannot be expressed in SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over documents; each result is a table in the shared folder, which goes when the next one is
    written. The last one stays, as the rows are read from it."""
    shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        done = written(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
