"""Line deduplication by overlapping three-line windows; DataFrame functions only.

A window is ``size`` consecutive lines of one document (lines end at ``\\n``).
Windows are compared by the MD5 of their lines.  Of equal windows the one with the
smallest (doc_id, key, position) is the first, ``key`` being the hash of doc_id and text; every line that a later window covers goes.
The first window of each hash is found by a count and a minimum that combine
before they are shuffled, so a window that a third of all documents share costs a
row a task; the join back has unique hashes on one side.

Edges: null text stays null and has no lines; a document of fewer than ``size``
lines has no window and stays whole; windows with no character but blanks are no
windows; of repeated rows (equal doc_id and text) the later place is removed in
neither, since both carry the same place; rows with a null doc_id are left out; other columns
are carried along in ``row`` under whatever names they have; ill-formed UTF-8 is compared as it is;
an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import content_key, cut, fixed


def _lines(text):
    return F.split(text, "\n", -1)


def windows(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, at (from 0), h for every window that isn't blank."""
    own = docs.filter(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(id_col).alias("doc_id"), content_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")
    )
    own = fixed(own, lines=_lines(F.col("text"))).select("doc_id", "key", "lines")
    at = F.sequence(F.lit(0), F.size("lines") - size)
    return (
        own.filter(F.size("lines") >= size)
        .select(
            "doc_id",
            "key",
            F.explode(
                F.transform(at, lambda i: F.struct(i.alias("at"), F.array_join(F.slice("lines", i + 1, size), "\n").alias("w")))
            ).alias("x"),
        )
        .filter(F.trim(F.translate("x.w", "\n\t\r", "   ")) != "")
        .select("doc_id", "key", F.col("x.at").alias("at"), F.unhex(F.md5(F.col("x.w").cast("binary"))).alias("h"))
    )


def remove_later_windows(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a document's columns but the text), doc_id, key, n_lines, n_removed, kept (text without the removed lines) of every document."""
    found = windows(docs, size, id_col, text_col)
    # Written, so that the join has plain exchanges on both sides, whose hot hashes adaptive execution splits.
    first = cut(
        found.groupBy("h")
        .agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "key", "at")).alias("first"))
        .filter("n > 1")
        .select("h", F.col("first.doc_id").alias("first_doc"), F.col("first.key").alias("first_key"), F.col("first.at").alias("first_at")),
        "first-windows",
    )
    later = (
        found.join(first, "h")
        .filter((F.col("doc_id") != F.col("first_doc")) | (F.col("key") != F.col("first_key")) | (F.col("at") != F.col("first_at")))
        .groupBy("doc_id", "key")
        .agg(F.collect_set("at").alias("ats"))
    )
    others = [F.col(c) for c in docs.columns if c != text_col]
    all_docs = docs.filter(F.col(id_col).isNotNull()).select(
        F.struct(*others).alias("row"), F.col(id_col).alias("doc_id"), content_key(id_col, text_col).alias("key"), F.col(text_col).alias("text")
    )
    covered = F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (size - 1)))))
    met = fixed(all_docs.join(later, ["doc_id", "key"], "left"), lines=_lines(F.col("text")), covered=F.coalesce(covered, F.array().cast("array<int>")))
    # A difference of sets: linear in the lines, whatever number of them goes.
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("covered"))
    kept = F.transform(left, lambda i: F.get("lines", i))
    return met.select(
        "row",
        "doc_id",
        "key",
        F.when(F.col("text").isNull(), 0).otherwise(F.size("lines")).cast("long").alias("n_lines"),
        F.size("covered").cast("long").alias("n_removed"),
        F.when(F.size("covered") == 0, F.col("text")).otherwise(F.array_join(kept, "\n")).alias("kept"),
    )
