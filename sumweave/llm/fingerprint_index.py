"""Substring deduplication over a log-structured fingerprint index.

The index is a list of immutable runs.  A run is a table bucketed and sorted by
fingerprint that holds every fingerprint of one batch of documents once, with its
number of occurrences, so runs and batches are merge-joined bucket by bucket
without a shuffle.  When more than ``fanout`` runs exist they are compacted into
one by the same join.

What is indexed are *anchors*.  A window has ``window`` words; it is seen as the
run of all its grams of ``gram = window // 2 + 1`` words, and its anchor is the
least gram hash.  Equal windows have equal anchors, so a window can repeat only
if its anchor does; about one word in nine starts an anchor, which keeps the index
and its shuffles far smaller than the text.  Windows with a repeated anchor are
then verified: 80 bits of the XXH3 hash of the whole window's bytes are counted over all
documents, and only windows whose own count is above one go.  Among 10**13 different windows some 40 pairs would
share them by chance; more bits cost disk for every window in question.

Runs are tables in the shared scratch folder.

Counts combine before they are shuffled, so a passage that a third of all
documents share costs one row a task; the joins that find its places have unique
keys on one side, which adaptive execution splits.

Edges: null or blank texts have no words and lose none; texts shorter than the
window have no window; repeated rows are copies of each other; rows with a null
``doc_id`` are left out; words are bytes, so ill-formed UTF-8 stays as it is; very long texts are
hashed in overlapping parts; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import folder, remove
from ._common import content_key, cut, frugal, PrefixHash, sliding, word_bounds

#: Words handled at once; longer texts are taken in overlapping parts.
PART = 200_000


def _parts(words: list[bytes], window: int, part: int = PART) -> Iterator[tuple[int, list[bytes]]]:
    """Parts such that each window lies in exactly one of them."""
    n = len(words) - window + 1
    for at in range(0, max(n, 0), part):
        yield at, words[at : min(at + part, n) + window - 1]


def _anchors(words: list[bytes], window: int, hasher: PrefixHash) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """The anchor of each window of ``words``; all gram hashes, the joined bytes, the words' bounds."""
    joined = b" ".join(words)
    data, starts, ends = word_bounds(joined)
    gram = window // 2 + 1
    h = hasher.ranges(data, starts[: len(words) - gram + 1], ends[gram - 1 :])
    return sliding(h, window - gram + 1, least=True).view(np.int64), h.view(np.int64), joined, starts, ends


def anchors(docs: DataFrame, window: int, id_col: str = "doc_id", text_col: str = "text", part: int = PART) -> DataFrame:
    """Distinct anchors of every document: fp, key, twice (repeated in this document)."""

    def run(batches):
        hasher = PrefixHash()
        for batch in batches:
            fps, keys, twice = [], [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = (text or b"").split()
                own = [_anchors(p, window, hasher)[:2] for _, p in _parts(words, window, part)]
                if not own:
                    continue
                grams, times = np.unique(np.concatenate([x[1] for x in own]), return_counts=True)
                fps.append(np.unique(np.concatenate([x[0] for x in own])))
                keys.append(np.full(len(fps[-1]), key, np.int64))
                twice.append(times[np.searchsorted(grams, fps[-1])] > 1)
            if fps:
                yield pa.record_batch(
                    [pa.array(np.concatenate(fps)), pa.array(np.concatenate(keys)), pa.array(np.concatenate(twice))],
                    names=["fp", "key", "twice"],
                )

    return (
        docs.filter(F.col(id_col).isNotNull())
        .select(content_key(id_col, text_col).alias("key"), F.col(text_col).cast("binary").alias("text"))
        .mapInArrow(frugal(run), "fp long, key long, twice boolean")
    )


class FingerprintIndex:
    """Sorted immutable runs of fingerprints, joined with each new batch and compacted."""

    def __init__(self, spark: SparkSession, window: int = 35, buckets: int | None = None, fanout: int = 4, part: int = PART) -> None:
        self.spark, self.window, self.fanout, self.part = spark, window, fanout, part
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.name = f"fingerprints_{uuid.uuid4().hex}"
        #: table -> its folder
        self.runs: dict[str, str] = {}
        self._made = 0

    def _write(self, df: DataFrame) -> dict[str, str]:
        table, path = f"{self.name}_{self._made}", folder(self.spark, "fingerprints")
        self._made += 1
        df.write.bucketBy(self.buckets, "fp").sortBy("fp").format("parquet").option("path", path).saveAsTable(table)
        return {table: path}

    def ingest(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add one batch as a new run; compacts when there are more than ``fanout`` runs."""
        counted = (
            anchors(batch, self.window, id_col, text_col, self.part)
            .groupBy("fp")
            .agg(F.sum(F.when(F.col("twice"), 2).otherwise(1)).alias("n"))
        )
        self.runs |= self._write(counted.repartition(self.buckets, "fp"))
        if len(self.runs) > self.fanout:
            self.compact()

    def merged(self) -> DataFrame:
        """fp, n over all runs: a merge join of sorted runs."""
        out = None
        for run in self.runs:
            df = self.spark.table(run)
            if out is None:
                out = df
            else:
                new = df.select("fp", F.col("n").alias("m"))
                total = F.coalesce(F.col("n"), F.lit(0)) + F.coalesce(F.col("m"), F.lit(0))
                out = out.join(new.hint("merge"), "fp", "full").select("fp", total.alias("n"))
        if out is None:
            return self.spark.createDataFrame([], "fp long, n long")
        return out

    def compact(self) -> None:
        """Replace all runs by one; the old runs are dropped once the new one is written."""
        old, self.runs = self.runs, self._write(self.merged())
        self._remove(old)

    def known(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Incremental use: anchors of ``batch`` that the runs already hold (fp, key)."""
        found = anchors(batch, self.window, id_col, text_col, self.part)
        return found.join(self.merged().select("fp"), "fp", "left_semi").select("fp", "key")

    def drop(self) -> None:
        self._remove(self.runs)
        self.runs = {}

    def _remove(self, runs: dict[str, str]) -> None:
        for run in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        remove(self.spark, set(runs.values()))


def _pack(words: list[bytes], press: zstandard.ZstdCompressor) -> bytes:
    return press.compress(b" ".join(words))


def remove_repeats(
    docs: DataFrame, window: int = 35, batches: int = 2, fanout: int = 4, id_col: str = "doc_id", text_col: str = "text", part: int = PART
) -> DataFrame:
    """Words of every document without those covered by a repeated window.

    Returns doc_id, n_words, n_removed, kept (the kept words joined by one space)
    and kept_sha256.  The documents enter the index in ``batches`` batches.
    """
    spark = docs.sparkSession
    docs = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    index = FingerprintIndex(spark, window, fanout=fanout, part=part)
    for i in range(batches):
        index.ingest(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == i))
    # Where the index knows an anchor more than once; one row for a document and anchor.
    repeated = cut(index.merged().filter("n > 1").select("fp"), "repeated-anchors")
    index.drop()
    hits = (
        anchors(docs, window, part=part).select("fp", "key").join(repeated, "fp").groupBy("key").agg(F.collect_set("fp").alias("fps"))
    )

    def pack(batches_in):
        press = zstandard.ZstdCompressor(level=3)
        for b in batches_in:
            packed = [_pack((t or b"").split(), press) for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(packed, pa.binary())], names=["doc_id", "key", "packed"])

    packed = docs.select("doc_id", content_key("doc_id", "text").alias("key"), F.col("text").cast("binary").alias("text"))
    id_type = docs.schema["doc_id"].dataType.simpleString()
    packed = packed.mapInArrow(frugal(pack), f"doc_id {id_type}, key long, packed binary")
    met = cut(packed.join(hits, "key", "left"), "texts-with-anchors")

    def verify(batches_in):
        hasher, unpress = PrefixHash(), zstandard.ZstdDecompressor()
        for b in batches_in:
            hs, keys, ats = [], [], []
            for key, blob, fps in zip(*(b.column(i).to_pylist() for i in range(3))):
                marked = np.array(fps, np.int64)
                for at, own_words in _parts(unpress.decompress(blob).split(), window, part):
                    own, _, joined, starts, ends = _anchors(own_words, window, hasher)
                    pos = np.flatnonzero(np.isin(own, marked))
                    if not len(pos):
                        continue
                    whole = zip(starts[pos].tolist(), ends[pos + window - 1].tolist())
                    hs.append(np.frombuffer(b"".join(xxhash.xxh3_128_digest(joined[s:e]) for s, e in whole), np.int64).reshape(-1, 2))
                    keys.append(np.full(len(pos), key, np.int64))
                    ats.append((pos + at).astype(np.int32))
            if hs:
                h = np.concatenate(hs)
                yield pa.record_batch([pa.array(x) for x in (h[:, 0].copy(), h[:, 1].astype(np.int16), np.concatenate(keys), np.concatenate(ats))], names=["h", "g", "key", "at"])

    def found() -> DataFrame:
        """Hashed again for each use: written, the windows would take about twice the input."""
        held = met.filter(F.col("fps").isNotNull()).select("key", "packed", "fps")
        return held.mapInArrow(frugal(verify), "h long, g short, key long, at int")

    # Written, so that the join has plain exchanges on both sides, whose hot hashes adaptive execution splits.
    twice = cut(found().groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "g"), "repeated-windows")
    places = found().join(twice, ["h", "g"]).groupBy("key").agg(F.collect_set("at").alias("at"))

    def keep(batches_in):
        unpress = zstandard.ZstdDecompressor()
        for b in batches_in:
            n_words, n_removed, kept_texts, digests = [], [], [], []
            for blob, at in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                words = unpress.decompress(blob).split()
                gone = np.zeros(len(words) + 1, np.int64)
                if at:
                    places_at = np.array(at, np.int64)
                    np.add.at(gone, places_at, 1)
                    np.add.at(gone, places_at + window, -1)
                    gone = np.cumsum(gone)
                    words_kept = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    words_kept = words
                text = b" ".join(words_kept)
                n_words.append(len(words))
                n_removed.append(len(words) - len(words_kept))
                kept_texts.append(text)
                digests.append(hashlib.sha256(text).hexdigest())
            yield pa.record_batch(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept_texts, pa.binary()), pa.array(digests, pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return (
        met.select("doc_id", "key", "packed")
        .join(places, "key", "left")
        .select("doc_id", "packed", "at")
        .mapInArrow(frugal(keep), f"doc_id {id_type}, n_words long, n_removed long, kept binary, kept_sha256 string")
        .withColumn("kept", F.col("kept").cast("string"))
    )
