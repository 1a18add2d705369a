"""A training corpus in five stages: language ID, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet
and read again as the next one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumweave.llm import decontaminate, line_windows, near_copies, packing, zstd_langid
from sumweave.llm._common import cut, documents, small_batches
from sumweave.llm.queries import held_out, tokenizer_path
from sumweave.plans import scratch


def _with_text(found: DataFrame, docs: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs``, carried in ``row``, with another text and its length."""
    new = F.col(text)
    own = {"text": new.alias("text"), "n_chars": F.length(new).cast("long").alias("n_chars")}
    return found.select(*(own.get(c, F.col("row").getField(c).alias(c)) for c in docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or between two languages, go."""
    small_batches(spark)
    names = tuple(f"r{i}_{uuid.uuid4().hex}" for i in range(3))  # no document has such a column
    found = zstd_langid.identify(docs, zstd_langid.fit(docs.filter(~held_out())), names=names)
    return found.filter(~F.col(names[2])).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows go; documents of which nothing is left go."""
    found = line_windows.remove_later_windows(docs)
    left = found.filter((F.col("n_removed") == 0) | (F.trim(F.translate("kept", "\n\t\r", "   ")) != ""))
    return _with_text(left, docs, "kept")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word Jaccard of 0.8 or more) one document stays: the smallest doc_id (then text hash), once."""
    small_batches(spark)
    return near_copies.keep_first(docs, near_copies.near_copies(docs)).select(*docs.columns)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; from others the words of benchmark windows go."""
    found = decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _with_text(found.filter(~F.col("contaminated")), docs, "cleaned")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their token ids, in training sequences (``packing.sequences`` joins them).

    Groups are smaller than those of pieces without ids, as a task holds a group: at most 64 MB of ids.
    """
    small_batches(spark)
    return packing.pack(packing.pieces(docs, tokenizer_path(), with_ids=True), group=8_000)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

#: Compression, near-duplicates and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage's intermediate tables go once its output is written, and that once the next one's is."""
    docs = documents(spark, sf_dir)
    before = scratch.held(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            made = scratch.held(spark)
            docs = cut(docs, f"pipeline-{name}")
            scratch.remove(spark, made - before)
    return docs
