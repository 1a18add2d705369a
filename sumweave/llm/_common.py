"""Helpers shared by the training-data operators.

Every operator leaves out rows whose identifier is null (such a row cannot be
reported) and reads only the columns it names, so extra columns never clash.  Texts that
are no well-formed UTF-8 stop none of them: operators on words keep such bytes as they
are, those on characters read them as U+FFFD.
"""

from __future__ import annotations

import ctypes
import functools
import gc
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.scratch import cut as cut  # noqa: PLC0414  intermediate tables of all operators go there

#: Word patterns of the operators' contracts (fixed values).
BLANK_SEPARATED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Byte table: A-Z to lower case, ASCII that is neither letter nor digit to a space.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


#: Bytes of rows that go to a Python task at once.
BATCH = 4 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def content_key(*columns: str):
    """64 bits over identifier and text: equal rows share it, so repeated rows get equal results."""
    return F.xxhash64(*columns)


def texts_of(column: pa.Array) -> list[str | None]:
    """The texts of a string column; bytes that are no UTF-8 are read as U+FFFD."""
    return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def frugal(run):
    """``run`` over batches, and what it held given back to the machine: idle Python workers stay small."""

    @functools.wraps(run)
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def small_batches(spark: SparkSession) -> None:
    """From now on the session's rows go to Python tasks in batches of ``BATCH`` bytes at most, or fewer if it says so.

    Batches are made when a frame is run, so this holds for the session.  Spark's own bound is 64 MB: each task then
    holds such a batch twice, in Python and outside the heap in buffers that grow by doubling, and much of it isn't given back.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < now <= BATCH:
        spark.conf.set(key, str(BATCH))


def fixed(df: DataFrame, **columns) -> DataFrame:
    """``df`` with columns that are computed once a row.

    A projection would be merged into later expressions, and a lambda there would compute
    the column again for each element; a generator of one row isn't merged.
    """
    own = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select("*", F.explode(F.array(own)).alias("_fixed")).select("*", *(F.col(f"_fixed.{n}").alias(n) for n in columns)).drop("_fixed")


class PrefixHash:
    """Hashes of byte ranges by one running sum.

    h(s, e) = sum(b[i] * p**i, s <= i < e) * p**-s modulo 2**64, then mixed; equal
    bytes give equal values wherever they stand.
    """

    def __init__(self, multiplier: int = 0x9E3779B97F4A7C15) -> None:
        self.multiplier = multiplier | 1
        self._grow(1 << 16)

    def _grow(self, n: int) -> None:
        inverse = pow(self.multiplier, -1, 1 << 64)
        one = np.ones(1, np.uint64)
        self.up = np.cumprod(np.concatenate([one, np.full(n - 1, self.multiplier, np.uint64)]))
        self.down = np.cumprod(np.concatenate([one, np.full(n - 1, inverse, np.uint64)]))

    def ranges(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) >= len(self.up):
            self._grow(2 * len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * self.up[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * self.down[starts]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(29)
        return h


def word_bounds(joined: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and ends of the words of a text joined by single spaces."""
    data = np.frombuffer(joined, np.uint8)
    if not len(data):
        none = np.zeros(0, np.int64)
        return data, none, none
    gaps = np.flatnonzero(data == 32)
    return data, np.concatenate([[0], gaps + 1]), np.concatenate([gaps, [len(data)]])


def sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` consecutive values, by doubling."""
    f = np.minimum if least else np.maximum
    span, out = 1, values
    while span * 2 <= width:
        out = f(out[:-span], out[span:])
        span *= 2
    if span < width:
        more = width - span
        out = f(out[: len(out) - more], out[more:])
    return out
