"""Near copies: SimHash tiles find candidates, exact Jaccard similarity of word shingles decides.

A vertex is a distinct sequence of lower-cased words.  Two vertices are candidates if their
64-bit SimHash fingerprints differ in at most ``radius`` bits and their 64 one-bit minima
(MinHash) in at most ``sketch_radius``.  At similarity 0.8 one expects 9.7 and 6.4 bits of
difference; the second test keeps unrelated texts, of which many are within the wide radius by
chance, from linking.  Candidates come as spanning forests (``simhash_tiles.link``).  Within each
connected group of candidates all pairs are then compared exactly, in blocks of ``block``
vertices, so no verdict rests on a sketch and no link depends on which forest was chosen.

Edges: fewer words than a shingle are one shingle; null and blank texts have none and are copies
of each other; repeated rows are copies; groups are connected by links, so two texts of one group
may be less similar than the threshold; rows with a null doc_id are left out; extra columns are not read, and
``keep_first`` keeps them; ill-formed UTF-8 is compared as it is; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import content_key, cut, frugal
from .components import components
from .simhash_tiles import link, majority, shingle_hashes

#: Odd multipliers of the 64 minima.
_FACTORS = np.random.default_rng(8).integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes | None, words: int) -> np.ndarray:
    """Distinct hashes of the word shingles, sorted."""
    return np.unique(shingle_hashes((text or b"").lower().split(), words))


def sketch(own: np.ndarray) -> int:
    """One bit of each of 64 minima of a set of hashes."""
    if not len(own):
        return 0
    low = np.array([(own * f).min() for f in _FACTORS])
    return int.from_bytes(np.packbits((low >> np.uint64(20)).astype(np.uint8) & 1).tobytes(), "big")


def same_groups(sets: list[np.ndarray], group: np.ndarray, least: float, first: int = 0) -> list[tuple[int, int]]:
    """Links (i, j) that connect sets of similarity ``least`` at least; ``group`` (labels) is joined on the way.

    With ``first``, only sets before it are compared with sets from it on.
    """
    sizes, out = np.array([len(s) for s in sets]), []
    for i in range(first or len(sets)):
        other = np.arange(first or i + 1, len(sets))
        small, large = np.minimum(sizes[other], sizes[i]), np.maximum(sizes[other], sizes[i])
        other = other[(group[other] != group[i]) & (small > 0) & (small >= least * large)]
        if not len(other):
            continue
        values = np.concatenate([sets[j] for j in other])
        at = np.minimum(np.searchsorted(sets[i], values), sizes[i] - 1)
        ends = np.cumsum(sizes[other])
        shared = np.add.reduceat((sets[i][at] == values).astype(np.int64), ends - sizes[other])
        other = other[shared >= least * (sizes[other] + sizes[i] - shared) - 1e-9]
        if len(other):
            groups, one = np.unique(group[other], return_index=True)
            out += [(i, int(j)) for j in other[one]]
            group[np.isin(group, groups)] = group[i]
    return out


def _marks(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, key, fp, sketch, node (hash of the lower-cased words) of every document."""

    def run(batches):
        for b in batches:
            rows = np.zeros((3, b.num_rows), np.uint64)
            for i, t in enumerate(b.column(2).to_pylist()):
                own = (t or b"").lower().split()
                h = shingle_hashes(own, words)  # the slow part: once for fingerprint and sketch
                rows[:, i] = majority(h), sketch(np.unique(h)), xxhash.xxh64_intdigest(b" ".join(own), 7)
            yield pa.record_batch([b.column(0), b.column(1), *(pa.array(x.view(np.int64)) for x in rows)], names=["doc_id", "key", "fp", "sketch", "node"])

    own = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), content_key(id_col, text_col).alias("key"), F.col(text_col).cast("binary").alias("text")
    )
    return own.mapInArrow(frugal(run), "doc_id long, key long, fp long, sketch long, node long")


def verified(members: DataFrame, least: float, words: int, block: int) -> DataFrame:
    """Links (a, b) of ``members`` (node, component, text) that hold, within each component."""
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block)
    # A row for each component of more than one block.
    several = F.broadcast(sizes.select("component", F.ceil(F.col("n") / block).alias("blocks")))
    dealt = members.join(several, "component", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))

    def packed(key: tuple, df: pd.DataFrame) -> pd.DataFrame:
        sets = [shingles(t, words) for t in df["text"]]
        nodes, group = df["node"].to_numpy(np.int64), np.arange(len(df))
        links = same_groups(sets, group, least)
        a, b = (nodes[[x[k] for x in links]].tolist() if links else [] for k in (0, 1))
        row = (key[0], key[1], int(df["blocks"].iloc[0]), nodes.tobytes(), group.tobytes(), np.array([len(s) for s in sets]).tobytes(), np.concatenate(sets).tobytes(), a, b)
        if row[2] == 1:
            row = (*row[:3], None, None, None, None, a, b)
        return pd.DataFrame([row], columns=["component", "block", "blocks", "nodes", "grp", "sizes", "sets", "a", "b"])

    schema = "component long, block long, blocks long, nodes binary, grp binary, sizes binary, sets binary, a array<long>, b array<long>"
    rows = cut(dealt.groupBy("component", "block").applyInPandas(packed, schema), "near-copies-blocks")
    within = rows.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b")
    data = ["nodes", "grp", "sizes", "sets"]
    many = rows.filter("blocks > 1")
    # Each pair of blocks has a key of its own.
    pair = lambda df, mine, to: df.withColumn("other", F.explode(to)).select("component", *mine, *data)
    left = pair(many.filter("block < blocks - 1"), [F.col("block").alias("x"), F.col("other").alias("y")], F.sequence(F.col("block") + 1, F.col("blocks") - 1))
    right = pair(many.filter("block > 0"), [F.col("other").alias("x"), F.col("block").alias("y")], F.sequence(F.lit(0).cast("long"), F.col("block") - 1))
    met = left.join(right.select("component", "x", "y", *(F.col(c).alias(f"{c}_y") for c in data)), ["component", "x", "y"])

    def across(batches):
        for b in batches:
            for r in b.to_pylist():
                sides = []
                for end in ("", "_y"):
                    nodes, group, n = (np.frombuffer(r[c + end], np.int64) for c in ("nodes", "grp", "sizes"))
                    sides.append((nodes, group, np.split(np.frombuffer(r["sets" + end], np.uint64), np.cumsum(n)[:-1])))
                (na, ga, sa), (nb, gb, sb) = sides
                nodes = np.concatenate([na, nb])
                links = same_groups([*sa, *sb], np.concatenate([ga, gb + len(na)]), least, len(na))
                if links:
                    i, j = (np.array(x) for x in zip(*links))
                    yield pa.record_batch([pa.array(nodes[i]), pa.array(nodes[j])], names=["a", "b"])

    return within.unionByName(met.mapInArrow(frugal(across), "a long, b long"))


def near_copies(docs: DataFrame, least: float = 0.8, words: int = 5, radius: int = 18, sketch_radius: int = 16, block: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, component_id (smallest doc_id of the group), first of every document.

    first marks each group's one text that stays: the least (doc_id, key); repeated rows are marked alike.
    """
    found = cut(_marks(docs, words, id_col, text_col), "near-copies-marks")
    vertices = cut(found.groupBy("node").agg(F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min(F.struct("doc_id", "key")).alias("first")), "near-copies-vertices")
    near = cut(components(link(vertices, radius, sketch_radius=sketch_radius)), "near-copies-candidates")
    wanted = vertices.join(near, "node").select("first.doc_id", "first.key", "node", "component")
    texts = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), content_key(id_col, text_col).alias("key"), F.col(text_col).cast("binary").alias("text")
    )
    members = cut(texts.join(wanted, ["doc_id", "key"]).dropDuplicates(["node"]).select("node", "component", "text"), "near-copies-members")
    groups = components(verified(members, least, words, block))
    named = vertices.join(groups, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy("component").agg(F.min("first").alias("least"))
    return found.join(named.join(smallest, "component").select("node", "least"), "node").select(
        "doc_id", "key", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "key") == F.col("least")).alias("first")
    )


def keep_first(docs: DataFrame, marks: DataFrame, broadcast_rows: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``near_copies`` marks first, of repeated rows one; all their columns.

    The texts stay where they are as long as the rows that go, and those that repeat, are at most ``broadcast_rows``
    (counted; two numbers each); beyond, the same joins are shuffled.
    """
    each = cut(marks.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("n"), F.first("first").alias("first")), "near-copies-kept")
    named = lambda df: df.select(F.col("doc_id").alias("__doc"), F.col("key").alias("__key"))
    few = lambda df: F.broadcast(df) if df.limit(broadcast_rows + 1).count() <= broadcast_rows else df
    gone, twice = few(named(each.filter("NOT first"))), few(named(each.filter("first AND n > 1")))
    own = docs.filter(F.col(id_col).isNotNull()).withColumns({"__id": F.col(id_col).cast("long"), "__hash": content_key(id_col, text_col)})
    on = (F.col("__id") == F.col("__doc")) & (F.col("__hash") == F.col("__key"))
    left = own.join(gone, on, "left_anti")
    once = left.join(twice, on, "left_anti").unionByName(left.join(twice, on, "left_semi").dropDuplicates(["__id", "__hash"]))
    return once.drop("__id", "__hash")
