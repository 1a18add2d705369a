"""Packing documents into training sequences by best-fit decreasing.

Each text is tokenized whole, an end token is put after it, and documents longer than a
window are first cut into full windows.  What is left of each is packed: longest piece
first, into the open window with the least capacity that still holds it.  A segment tree
over the remaining capacities finds that window.  The pieces are written, and each task packs those it reads in groups
of about ``group``, whatever document they belong to, so no token moves between
machines; each group is packed by itself and wastes at most a window or so more than one packing of everything.

Edges: a null text counts as empty; an empty text is its end token; repeated rows are
packed each; rows with a null doc_id are left out; ill-formed UTF-8 is read as U+FFFD; an empty
table gives no sequence.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, frugal, texts_of

#: Words whose ids a task keeps at most.
CACHE = 250_000
#: Words of a text handled at once.
PART = 100_000


#: Latin letters; the vocabulary cuts between them and punctuation.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+")


def _merges(tokenizer):
    """The vocabulary as byte ranks with a zero byte for the word's end; which ids end a word."""
    import tiktoken

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    ranks, last = {b"\0": 1 << 20}, np.zeros(tokenizer.get_vocab_size(), bool)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        ends = token.endswith("</w>")
        last[i] = ends
        ranks.setdefault(bytes(byte[c] for c in token.removesuffix("</w>")) + b"\0" * ends, i)
    return tiktoken.Encoding("words", pat_str=r"[^\x00]*\x00", mergeable_ranks=ranks, special_tokens={}), last


class WordTokenizer:
    """Ids of a text (little-endian 32-bit), word by word with a cache.

    The vocabulary drops white space and joins nothing across it, so a text's ids are its
    words' ids; only texts with the first letters of a special token are encoded whole.
    Case is not told apart, and letters and punctuation are separate pieces, so unknown
    words are looked up without either where they are plain Latin.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters, self.last = _merges(self.tokenizer)
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn_letters(self, words: list[str]) -> None:
        """Words of letters in one call: the same merges over bytes, each word ended by a zero byte."""
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            ids = np.array(self.letters.encode_ordinary("\0".join(part) + "\0"), "<u4")
            data, ends = ids.tobytes(), 4 * (np.flatnonzero(self.last[ids]) + 1)
            starts = np.concatenate([[0], ends[:-1]])
            self.known.update(zip(part, (data[s:e] for s, e in zip(starts.tolist(), ends.tolist()))))

    def _learn(self, words: set[str]) -> None:
        known = self.known
        if len(known) + 2 * len(words) > CACHE:
            known.clear()
        plain, letters, rest = [], set(), set()
        for w in words:
            x = w.rstrip(".,!?;:")
            if x.isalpha() and (x.isascii() or _LATIN.fullmatch(x)):
                y = w[len(x) :]
                x = x.lower()
                plain.append((w, x, y))
                letters.add(x)
                rest.add(y)
            else:
                rest.add(w)
        self._learn_letters(list(letters.difference(known)))
        for w in rest.difference(known):
            known[w] = self.whole(w)
        for w, x, y in plain:
            known[w] = known[x] + known[y] if y else known[x]

    def __call__(self, texts: list[str | None]) -> Iterator[bytes]:
        for text in texts:
            if not text:
                yield b""
            elif "<|" in text:
                yield self.whole(text)
            else:
                # only ASCII blanks and line ends part words here: any other white space stays within
                words = text.replace("\n", " ").split(" ")
                yield b"".join(self._ids(words[at : at + PART]) for at in range(0, len(words), PART))

    def _ids(self, words: list[str]) -> bytes:
        distinct = set(words)
        for _ in range(2):  # a second time if the cache was cleared for the new words
            if new := distinct.difference(self.known):
                self._learn(new)
        return b"".join(map(self.known.__getitem__, words))


def pieces(docs: DataFrame, tokenizer: str, window: int = 2048, end: int = 1, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (, ids: little-endian 32-bit) of every piece."""

    def run(batches):
        ids_of, last = WordTokenizer(tokenizer), end.to_bytes(4, "little")
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                rows = []
                for doc, ids in zip(part.column(0).to_pylist(), ids_of(texts_of(part.column(1)))):
                    data = ids + last
                    total = len(data) // 4
                    for start in range(0, total, window):
                        own = data[4 * start : 4 * (start + window)]
                        rows.append((doc, start, len(own) // 4, zlib.crc32(own), total, own))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows), (part.column(0).type, *[pa.int64()] * 4, pa.binary()))]
                yield pa.record_batch(columns[: 5 + with_ids], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][: 5 + with_ids])

    own = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = own.schema["doc_id"].dataType.simpleString()
    return own.mapInArrow(frugal(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)


def padded_length(used, window: int = 2048):
    """How long a sequence of ``used`` tokens is once padded: the window, or as it is at a power of two."""
    return F.when(F.bit_count(used) == 1, used).otherwise(F.lit(window))


def sequences(packed: DataFrame, window: int = 2048, pad: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids (little-endian 32-bit, padded with ``pad``) of packed pieces with their ids.

    A sequence gathers at most ``window`` tokens.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda acc, p: F.concat(acc, p["ids"]))
    size = (4 * padded_length(F.col("n_tokens"), window)).cast("int")
    return joined.select("sequence_id", "n_tokens", F.rpad(ids, size, F.lit(pad.to_bytes(4, "little"))).alias("ids"))


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence (from 0) and offset of each piece."""
    leaves = 1
    while leaves <= window:
        leaves *= 2
    tree = [0] * (2 * leaves)  # how many open windows lie below; leaf: remaining capacity
    open_at: list[list[int]] = [[] for _ in range(window + 1)]

    def change(capacity: int, by: int) -> None:
        node = capacity + leaves
        while node:
            tree[node] += by
            node //= 2

    def tightest(least: int) -> int:
        """Smallest capacity of an open window of at least ``least``; -1 if none."""
        node = least + leaves
        if tree[node]:
            return least
        while node > 1:
            if node % 2 == 0 and tree[node + 1]:
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - leaves
            node //= 2
        return -1

    sequence, offset, made = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = int(lengths[i])
        capacity = tightest(length)
        if capacity < 0:
            at, capacity, made = made, window, made + 1
        else:
            at = open_at[capacity].pop()
            change(capacity, -1)
        sequence[i], offset[i] = at, window - capacity
        if capacity > length:
            open_at[capacity - length].append(at)
            change(capacity - length, 1)
    return sequence, offset


def pack(found: DataFrame, window: int = 2048, group: int = 50_000) -> DataFrame:
    """The pieces with sequence_id and offset."""
    found = cut(found, "packing-pieces")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in found.schema.fields) + ", sequence_id long, offset long"

    def run(batches):
        held, rows, number = [], 0, 0

        def packed(table: pa.Table, number: int) -> pa.RecordBatch:
            # 2**24 groups of a task, 2**19 sequences of a group, 2**20 tasks
            first = (table.column("__task")[0].as_py() << 43) + (number << 19)
            sequence, offset = best_fit_decreasing(table.column("length").to_numpy(), window)
            out = table.drop_columns(["__task"]).append_column("sequence_id", pa.array(sequence + first)).append_column("offset", pa.array(offset))
            return out.to_batches()  # as they came: no copy of a group, no batch of its size

        for b in batches:
            for at in range(0, b.num_rows, group):
                part = b.slice(at, group)
                if rows and rows + part.num_rows > group:
                    yield from packed(pa.Table.from_batches(held), number)
                    held, rows, number = [], 0, number + 1
                held.append(part)
                rows += part.num_rows
        if rows:
            yield from packed(pa.Table.from_batches(held), number)

    return found.withColumn("__task", F.spark_partition_id()).mapInArrow(frugal(run), schema)
