"""Benchmark decontamination; DataFrame functions only.

Test items and documents are cut into lower-case words (``ALNUM``).  The items'
n-grams (an item of fewer words is one n-gram) are numbered: a table of hash, words and number, and one of
number and item.  Where the n-grams are at most ``broadcast_rows`` and ``broadcast_bytes`` (both measured
first) they are broadcast as a hash set; beyond, the same join is shuffled.  Every
token window of every document probes it by a 64-bit hash; hits are verified by
comparing the words themselves.  Hits carry the n-gram's number; items meet the verified numbers of a
document once, however many of its windows hit.

What is found is written and, within the same bounds, broadcast back, so that no text is shuffled; beyond, the join
back is shuffled.

Edges: null or blank texts have no words; documents shorter than an n-gram have no
window of that length; equal n-grams of several items count for each; repeated rows
each get the same result; rows with a null doc_id or item_id are left out; an empty
benchmark leaves all documents clean; other columns are carried along in ``row`` under whatever names they have;
ill-formed UTF-8 is compared as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import content_key, cut, fixed

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text):
    """Words of a text: A-Z lowered, split where ASCII is neither letter nor digit."""
    cut_up = F.split(F.translate(text, _UPPER, _LOWER), _GAPS, -1)
    return F.filter(F.coalesce(cut_up, F.array().cast("array<string>")), lambda w: w != "")


def _grams(words, length):
    """The windows of ``length`` words, as arrays of words."""
    last = F.size(words) - length
    return F.when(last >= 0, F.transform(F.sequence(F.lit(1), last + 1), lambda i: F.slice(words, i, length))).otherwise(
        F.array().cast("array<array<string>>")
    )


def benchmark_grams(benchmark: DataFrame, n: int = 13) -> tuple[DataFrame, DataFrame]:
    """h, gram (words), length, g (number) of every distinct n-gram of the items; g, item_id."""
    words = fixed(benchmark.filter(F.col("item_id").isNotNull()).select("item_id", "text"), words=_words(F.col("text"))).drop("text")
    long, short = _grams(F.col("words"), F.lit(n)), F.array("words")
    held = cut(
        words.filter(F.size("words") > 0).select("item_id", F.explode(F.when(F.size("words") >= n, long).otherwise(short)).alias("gram")).distinct(), "benchmark-windows"
    )
    grams = held.select("gram").distinct().select(
        F.xxhash64(F.transform("gram", lambda w: F.xxhash64(w))).alias("h"), "gram", F.size("gram").alias("length"), F.monotonically_increasing_id().alias("g")
    )
    grams = cut(grams, "benchmark-grams")
    return grams, cut(held.join(grams, "gram").select("g", "item_id"), "benchmark-items")


def _bounded(df: DataFrame, size, rows: int, most_bytes: int) -> DataFrame:
    """``df``, marked for broadcast if it has at most so many rows and bytes (``size``: of a row)."""
    told = df.agg(F.count(F.lit(1)).alias("n"), F.sum(size.cast("long")).alias("b")).first()
    return F.broadcast(df) if told["n"] <= rows and (told["b"] or 0) <= most_bytes else df


def _text_bytes(words):
    return F.aggregate(words, F.lit(0), lambda total, w: total + F.octet_length(w) + 24)


def find_hits(docs: DataFrame, benchmark: DataFrame, n: int = 13, broadcast_rows: int = 100_000, broadcast_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """doc_id, key, hits (array of at, length, g; words compared) of the documents that have some; g, item_id."""
    grams, items = benchmark_grams(benchmark, n)
    lengths = sorted(r["length"] for r in grams.select("length").distinct().collect())  # at most n numbers
    own = docs.filter(F.col("doc_id").isNotNull()).select("doc_id", content_key("doc_id", "text").alias("key"), "text")
    hashes = fixed(own, ws=F.transform(_words(F.col("text")), lambda w: F.xxhash64(w))).select("doc_id", "key", "ws")

    def probes(length: int):
        """at and hash of every window of ``length`` words."""
        places = F.when(F.size("ws") >= length, F.sequence(F.lit(0), F.size("ws") - length)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("at"), F.xxhash64(F.slice("ws", i + 1, length)).alias("h")))

    wins = [probes(length) for length in lengths]
    every = F.concat(*wins) if len(wins) > 1 else wins[0] if wins else F.array().cast("array<struct<at:int,h:bigint>>")
    probe = hashes.select("doc_id", "key", F.explode(every).alias("x")).select("doc_id", "key", F.col("x.at").alias("at"), F.col("x.h").alias("h"))
    # The words wait for the verification.
    index = _bounded(grams, _text_bytes(F.col("gram")) + 48, broadcast_rows, broadcast_bytes).select("h", "length", "g", "gram")
    found = cut(probe.join(index, "h").groupBy("doc_id", "key").agg(F.collect_set(F.struct("at", "length", "g", "gram")).alias("found")), "benchmark-found")
    size = F.aggregate("found", F.lit(0), lambda total, x: total + 48 + 24 * x["length"]) + 32
    met = own.join(_bounded(found, size, broadcast_rows, broadcast_bytes), ["doc_id", "key"])
    true = F.filter("found", lambda x: F.slice("words", x["at"] + 1, x["length"]) == x["gram"])
    hits = F.transform(true, lambda x: F.struct(x["at"].alias("at"), x["length"].alias("length"), x["g"].alias("g")))
    checked = fixed(met, words=_words(F.col("text"))).select("doc_id", "key", hits.alias("hits")).filter(F.size("hits") > 0)
    return cut(checked.dropDuplicates(["doc_id", "key"]), "benchmark-hits"), items


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, broadcast_rows: int = 100_000, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """Per document: row (its columns but the text), doc_id, key, n_words, n_hit, items, contaminated, cleaned.

    contaminated: n_hit > 0 and share * n_hit >= n_words.  cleaned: the text without
    the hit words and the gaps before them (null text stays null).
    """
    hits, items = find_hits(docs, benchmark, n, broadcast_rows, broadcast_bytes)
    none = F.array().cast("array<int>")
    met = hits.select("doc_id", "key", F.explode(F.array_distinct(F.transform("hits", lambda x: x["g"]))).alias("g")).join(items, "g")
    by_doc = met.groupBy("doc_id", "key").agg(F.collect_set("item_id").alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("hits", lambda x: F.sequence(x["at"], x["at"] + x["length"] - 1))))
    marks = cut(hits.select("doc_id", "key", covered.alias("covered")).join(by_doc, ["doc_id", "key"]), "benchmark-marks")
    marks = _bounded(marks, 8 * (F.size("covered") + F.size("items")) + 64, broadcast_rows, broadcast_bytes)
    others = [F.col(c) for c in docs.columns if c not in ("text",)]
    own = docs.filter(F.col("doc_id").isNotNull()).select(F.struct(*others).alias("row"), "doc_id", content_key("doc_id", "text").alias("key"), "text")
    found = own.join(marks, ["doc_id", "key"], "left")
    pieces = F.regexp_extract_all("text", F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), 0)
    # A difference of sets: linear in the words, whatever number of them is hit.
    left = F.array_except(F.sequence(F.lit(0), F.size("pieces") - 1), F.col("covered"))
    kept = F.transform(left, lambda i: F.get("pieces", i))
    return (
        fixed(found, n_words=F.size(_words(F.col("text"))).cast("long"), pieces=F.when(F.col("covered").isNotNull(), pieces))
        .withColumn("covered", F.coalesce("covered", none))
        .withColumn("n_hit", F.size("covered").cast("long"))
        .select(
            "row",
            "doc_id",
            "key",
            "n_words",
            "n_hit",
            F.coalesce("items", F.array().cast(items.select(F.collect_set("item_id").alias("i")).schema["i"].dataType)).alias("items"),
            ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
            F.when(F.col("n_hit") == 0, F.col("text")).otherwise(F.array_join(kept, "")).alias("cleaned"),
        )
    )
