"""SimHash near-duplicates by tiled exact comparison.

Every whole text gets a 64-bit fingerprint: the bit-wise majority of the XXH64 (seed
42) of its word shingles.  Equal fingerprints are one vertex.  Distinct fingerprints are
sorted by population count, then by the counts of their four 16-bit quarters, and cut
into tiles; a tile holds one population count only.  Tile pairs are joined on equal or
near population counts: those that differ beyond the radius are never formed, and a
pair is also skipped when the quarters' count ranges are further apart.  A pair is
compared by numpy exclusive-or and bit counts, all against all, and answers with a
spanning forest of its links, never with the links themselves.  A tile is compared with
itself when it is cut, and carries the groups found; two tiles then answer with one link
for two groups at most, so large groups stay linear.  Components come from ``components``.

Edges: null and blank texts have no shingle and fingerprint zero, which links like any
other; fewer words than a shingle are one shingle; repeated rows are copies; rows with
a null doc_id are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import content_key, cut, frugal, word_bounds
from .components import components

TILE = 4096
_SHINGLES_AT_ONCE = 100_000


def shingle_hashes(own: list[bytes], words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every shingle, repeats included."""
    if not own:
        return np.zeros(0, np.uint64)
    joined = b" ".join(own)
    _, starts, ends = word_bounds(joined)
    width = min(words, len(own))
    starts, ends = starts[: len(own) - width + 1], ends[width - 1 :]
    hash64 = xxhash.xxh64_intdigest
    return np.fromiter((hash64(joined[s:e], seed) for s, e in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def majority(h: np.ndarray) -> int:
    """64 bits: those set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), _SHINGLES_AT_ONCE):
        part = h[at : at + _SHINGLES_AT_ONCE].astype(">u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprint(text: bytes | None, words: int = 4, seed: int = 42) -> int:
    return majority(shingle_hashes((text or b"").lower().split(), words, seed))


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key (hash of doc_id and text), fp (the fingerprint's 64 bits as a signed long) of every document."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, words) for t in b.column(2).to_pylist()], np.uint64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fps.view(np.int64))], names=["doc_id", "key", "fp"])

    own = docs.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("doc_id"), content_key(id_col, text_col).alias("key"), F.col(text_col).cast("binary").alias("text")
    )
    return own.mapInArrow(frugal(run), "doc_id long, key long, fp long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count((fp >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (0, 16, 32, 48)], 1).astype(np.int64)


def tile_links(a: np.ndarray, b: np.ndarray, radius: int, sketches: tuple | None = None, group: np.ndarray | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between two tiles (positions in a, in b); a is b for a tile with itself.

    sketches: 64 more bits of a's and b's rows and how many of them may differ.
    group: labels of a's rows, then b's, that are connected already; they are joined on the way.
    """
    shift = 0 if a is b else len(a)
    group = np.arange(shift + len(b)) if group is None else group
    out = []
    for at in range(0, len(a), 64):
        near = np.bitwise_count(a[at : at + 64, None] ^ b[None, :]) <= radius
        if sketches:
            x, y = np.nonzero(near)
            near[x, y] = np.bitwise_count(sketches[0][at + x] ^ sketches[1][y]) <= sketches[2]
        for i in np.flatnonzero(near.any(axis=1)).tolist():
            other = np.flatnonzero(near[i]) + shift
            other = other[group[other] != group[at + i]]
            if len(other):
                groups, first = np.unique(group[other], return_index=True)
                out += [(at + i, int(j) - shift) for j in other[first]]
                group[np.isin(group, groups)] = group[at + i]
    return out


def link(vertices: DataFrame, radius: int = 4, tile: int = TILE, per_slice: int = 16, sketch_radius: int | None = None) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` within ``radius`` bits.

    With ``sketch_radius`` the vertices are distinct ``node``s, of which some may share a
    fingerprint; linked nodes differ in at most so many bits of ``sketch``, too.

    The tiles of each population count are dealt to slices of about ``per_slice`` tiles, as many as their
    number asks for; a pair of slices is one key, so common counts are compared by many tasks of
    bounded size, and a tile is repeated once for each slice that it meets.
    """
    if tile > 1 << 16:
        raise ValueError("a tile's groups are numbers of 16 bits")
    marks = [] if sketch_radius is None else ["node", "sketch"]
    keyed = vertices.withColumn("ones", F.bit_count("fp").cast("int"))
    quarters = [F.bit_count(F.shiftrightunsigned("fp", s).bitwiseAND(F.lit(0xFFFF))) for s in (0, 16, 32, 48)]
    keyed = keyed.withColumn("cell", sum((q.cast("long") * 32**k for k, q in enumerate(quarters)), F.lit(0)))
    # Tiles of one population count: vertices dealt by range of (ones, cell, fp), then cut in each partition.
    parts = max(1, vertices.count() // (4 * tile))
    dealt = keyed.repartitionByRange(parts, "ones", "cell", "fp", *marks).sortWithinPartitions("ones", "cell", "fp", *marks)

    def cut_tiles(frames):
        held: list[pd.DataFrame] = []

        def packed(df: pd.DataFrame) -> pd.DataFrame:
            rows = []
            for at in range(0, len(df), tile):
                part = df.iloc[at : at + tile]
                fp = part["fp"].to_numpy(np.int64)
                q = _quarters(fp.view(np.uint64))
                more = [part[c].to_numpy(np.int64) for c in marks]
                nodes, group, own = more[0] if more else fp, np.arange(len(fp)), fp.view(np.uint64)
                sketches = (*[more[1].view(np.uint64)] * 2, sketch_radius) if more else None
                found = tile_links(own, own, radius, sketches, group)
                a, b = (nodes[[x[k] for x in found]].tolist() if found else [] for k in (0, 1))
                bits = (fp.tobytes(), group.astype(np.uint16).tobytes())
                rows.append((int(part["ones"].iloc[0]), int(nodes[0]), *bits, q.min(0).tolist(), q.max(0).tolist(), a, b, *(m.tobytes() for m in more)))
            return pd.DataFrame(rows, columns=["ones", "tile", "fps", "grp", "low", "high", "a", "b", *marks])

        for frame in frames:
            held.append(frame)
            have = pd.concat(held, ignore_index=True)
            last = have["ones"].iloc[-1] if len(have) else None
            done = have[have["ones"] != last]
            for _, part in done.groupby("ones", sort=True):
                yield packed(part)
            rest = have[have["ones"] == last]
            whole = len(rest) // tile * tile
            if whole:
                yield packed(rest.iloc[:whole])
            held = [rest.iloc[whole:]]
        have = pd.concat(held, ignore_index=True) if held else pd.DataFrame({"ones": []})
        if len(have):
            yield packed(have)

    schema = "ones int, tile long, fps binary, grp binary, low array<int>, high array<int>, a array<long>, b array<long>"
    made = cut(dealt.select("ones", "fp", *marks).mapInPandas(frugal(cut_tiles), schema + "".join(f", {c} binary" for c in marks)), "simhash-tiles")
    within = made.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select("x.a", "x.b")
    tiles = made.drop("a", "b")
    # A row for each population count: at most 65.
    counts = tiles.groupBy("ones").agg(F.ceil(F.count(F.lit(1)) / per_slice).alias("slices"))
    theirs = lambda name: F.broadcast(counts.select(F.col("ones").alias(name), F.col("slices").alias(f"{name}_slices")))
    dealt_to = lambda df: df.join(theirs("ones_a"), "ones_a").join(theirs("ones"), "ones")
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n).cast("int") - 1))
    left = dealt_to(tiles.select(*(F.col(c).alias(f"{c}_a") for c in tiles.columns)).withColumn("ones", F.explode(F.sequence(F.col("ones_a"), F.col("ones_a") + radius))))
    left = left.withColumn("slice_a", own("tile_a", "ones_a_slices")).withColumn("slice", each("ones_slices")).drop("ones_slices", "ones_a_slices")
    right = dealt_to(tiles.withColumn("ones_a", F.explode(F.sequence(F.col("ones") - radius, F.col("ones")))))
    right = right.withColumn("slice", own("tile", "ones_slices")).withColumn("slice_a", each("ones_a_slices")).drop("ones_slices", "ones_a_slices")
    apart = F.aggregate(
        F.zip_with(
            F.zip_with("low", "high_a", lambda x, y: x - y), F.zip_with("low_a", "high", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0))
        ),
        F.lit(0),
        lambda s, x: s + x,
    )
    pairs = left.join(right, ["ones_a", "ones", "slice_a", "slice"]).filter(
        ((F.col("ones") > F.col("ones_a")) | (F.col("tile") > F.col("tile_a"))) & (apart <= radius)
    )

    def compare(batches):
        for b in batches:
            xs, ys = [], []
            columns = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            for k in range(b.num_rows):
                fa, fb = (np.frombuffer(columns[c][k], np.uint64) for c in ("fps_a", "fps"))
                ga, gb = (np.frombuffer(columns[c][k], np.uint16).astype(np.int64) for c in ("grp_a", "grp"))
                na, nb, more = fa, fb, None
                if marks:
                    na, sa, nb, sb = (np.frombuffer(columns[c][k], np.uint64) for c in ("node_a", "sketch_a", "node", "sketch"))
                    more = (sa, sb, sketch_radius)
                found = tile_links(fa, fb, radius, more, np.concatenate([ga, gb + len(fa)]))
                if found:
                    i, j = (np.array(x) for x in zip(*found))
                    xs.append(na[i].view(np.int64))
                    ys.append(nb[j].view(np.int64))
            if xs:
                yield pa.record_batch([pa.array(np.concatenate(xs)), pa.array(np.concatenate(ys))], names=["a", "b"])

    more = [c + end for end in ("_a", "") for c in marks]
    across = pairs.select("fps_a", "grp_a", "fps", "grp", *more).mapInArrow(frugal(compare), "a long, b long")
    return within.unionByName(across)


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, key, fp, component_id (smallest doc_id reachable over links), first of every document.

    first marks each component's one text that stays: the least (doc_id, key).  Equal doc_ids
    with other texts are documents of their own; repeated rows are marked alike.
    """
    found = cut(fingerprints(docs, words, id_col, text_col), "simhash-fingerprints")
    vertices = cut(found.groupBy("fp").agg(F.min(F.struct("doc_id", "key")).alias("first")), "simhash-vertices")
    named = vertices.join(components(link(vertices, radius)).withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("least"))
    return found.join(named.join(smallest, "component").select("fp", "least"), "fp").select(
        "doc_id", "key", "fp", F.col("least.doc_id").alias("component_id"), (F.struct("doc_id", "key") == F.col("least")).alias("first")
    )
