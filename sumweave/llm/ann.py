"""Nearest neighbours over learned partitions.

Fitting (driver, on at most ``fit_rows`` distinct vectors, taken by the smallest hashes
of their ids, so the sample follows all data): a graph of each sampled vector's nearest
neighbours is cut into balanced parts by label moves under a size bound; a softmax
classifier then learns each vector's part from its direction.  An eighth of the sample is kept from the
classifier: the number of parts to probe is the least that finds ``recall`` of these vectors' sampled neighbours, so
it is small where vectors cluster and large where they don't.  Indexing: every vector
goes to its most probable part.  Searching: each query goes to its most probable parts and is reranked
there by exact cosine in double precision.

The number of parts grows with the square root of the table, up to what the sample can teach.  Vectors and queries of a
part are packed into blocks of bounded size, so a part that holds a third of all rows is searched by many tasks:
a slice of a part's vector blocks is one key, no vector is copied, and each query block is copied once a slice.  A task
keeps the best ``k`` of each query over its slice; these are merged, again ``k`` at a time.

Edges: vectors that are null, of another length than most, zero, or hold null or
non-finite components take no part; fewer vectors than parts give fewer parts; equal
scores go to the smaller id; of repeated ids each row is a candidate but a query never
finds its own id; rows with a null id are left out; exact repeats of a query row (id and vector)
are one query; equal query ids with other vectors are queries of their own, each with
its ranks 1 to k under the shared id; extra columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, frugal

#: Vector blocks of one key.
SLICE = 16


def usable(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, vec (doubles) of the vectors that take part."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (
        vectors.filter(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), vec.alias("vec"), finite.alias("finite"))
        .filter(F.col("finite") & F.exists("vec", lambda x: x != 0))
        .select("id", "vec")
    )


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """For unit rows x: the k nearest other rows of each row."""
    out = np.empty((len(x), k), np.int64)
    for at in range(0, len(x), 1024):
        s = x[at : at + 1024] @ x.T
        s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
        out[at : at + 1024] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def balanced_parts(x: np.ndarray, near: np.ndarray, parts: int, slack: float = 1.2, rounds: int = 20, seed: int = 7) -> np.ndarray:
    """Part of each row: few graph edges cross parts and none exceeds ``slack`` times the mean size.

    Starts from halving along principal directions; then rows move, best gain first, to
    the part that most of their neighbours (either way) have, while it has room.
    """
    rng = np.random.default_rng(seed)
    part = np.zeros(len(x), np.int64)
    groups = [np.arange(len(x))]
    while len(groups) < parts:
        groups.sort(key=len)
        big = groups.pop()
        y = x[big] - x[big].mean(0)
        direction = rng.normal(size=x.shape[1])
        for _ in range(12):
            direction = y.T @ (y @ direction)
            direction /= max(np.linalg.norm(direction), 1e-12)
        order = big[np.argsort(y @ direction, kind="stable")]
        groups += [order[: len(order) // 2], order[len(order) // 2 :]]
    for p, rows in enumerate(groups):
        part[rows] = p
    bound = int(np.ceil(slack * len(x) / parts))
    src = np.repeat(np.arange(len(x)), near.shape[1])
    a, b = np.concatenate([src, near.ravel()]), np.concatenate([near.ravel(), src])
    for _ in range(rounds):
        votes = np.zeros((len(x), parts), np.int32)
        np.add.at(votes, (a, part[b]), 1)
        best = votes.argmax(1)
        gain = votes[np.arange(len(x)), best] - votes[np.arange(len(x)), part]
        size, moved = np.bincount(part, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable")[: int((gain > 0).sum())]:
            if rng.random() < 0.7 and size[best[i]] < bound:
                size[best[i]] += 1
                size[part[i]] -= 1
                part[i] = best[i]
                moved += 1
        if not moved:
            break
    return part


def train_router(x: np.ndarray, part: np.ndarray, parts: int, epochs: int = 30, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Softmax regression by Adam on unit rows: weights, bias."""
    rng = np.random.default_rng(seed)
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros((x1.shape[1], parts))
    for p in range(parts):
        if (part == p).any():
            w[:-1, p] = 4 * x[part == p].mean(0)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(epochs):
        order = rng.permutation(len(x1))
        for at in range(0, len(order), 512):
            rows = order[at : at + 512]
            z = x1[rows] @ w
            z = np.exp(z - z.max(1, keepdims=True))
            z /= z.sum(1, keepdims=True)
            z[np.arange(len(rows)), part[rows]] -= 1
            g = x1[rows].T @ z / len(rows) + 1e-5 * w
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], w[-1]


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def needed_probes(x: np.ndarray, near: np.ndarray, held: np.ndarray, w: np.ndarray, bias: np.ndarray, recall: float) -> int:
    """How many parts hold ``recall`` of the held rows' neighbours, if each row lies in its most probable part."""
    odds = x @ w + bias
    order = np.argsort(-odds, axis=1, kind="stable")
    place = np.argsort(order[held], axis=1, kind="stable")  # of each part in a held row's order
    at = np.take_along_axis(place, order[:, 0][near[held]], axis=1)
    found = np.cumsum(np.bincount(at.ravel(), minlength=w.shape[1])) / at.size
    return int(np.searchsorted(found, recall - 1e-12)) + 1


def fit(
    vectors: DataFrame, parts: int | None = None, probes: int | None = None, recall: float = 0.97, fit_rows: int = 8192, neighbours: int = 10
) -> tuple[np.ndarray, np.ndarray, int, int] | None:
    """Router (weights, bias), the vectors' length and the number of parts to probe; None if no vector takes part.

    parts: if not given, the square root of the number of vectors over 14, from 16 to a 64th of the sample.
    """
    sample = vectors.select("vec", F.xxhash64("id").alias("h")).orderBy("h").limit(fit_rows).collect()
    if not sample:
        return None
    if parts is None:
        parts = min(max(16, int(vectors.count() ** 0.5 / 14)), max(16, fit_rows // 64))
    length = pd.Series([len(r["vec"]) for r in sample]).mode()[0]
    x = unit_rows(np.unique(np.array([r["vec"] for r in sample if len(r["vec"]) == length]), axis=0))
    parts = max(1, min(parts, len(x) // 8))
    if parts == 1:
        return np.zeros((length, 1)), np.zeros(1), int(length), 1
    near = neighbour_graph(x, min(neighbours, len(x) - 1))
    part = balanced_parts(x, near, parts)
    held = np.zeros(len(x), bool)
    held[np.random.default_rng(7).permutation(len(x))[: len(x) // 8]] = True
    w, bias = train_router(x[~held], part[~held], parts)
    return w, bias, int(length), probes or needed_probes(x, near, np.flatnonzero(held), w, bias, recall)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise cosine in double precision; the same rows give the same bits anywhere."""
    a, b = a / np.abs(a).max(1, keepdims=True), b / np.abs(b).max(1, keepdims=True)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def search_block(ids: np.ndarray, x: np.ndarray, query_ids: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest of each query in one block, ties to the smaller id: the query's row, vec_id, score."""
    xu, qu = unit_rows(x), unit_rows(q)
    rows, found, scores = [], [], []
    for at in range(0, len(q), 256):
        s = qu[at : at + 256] @ xu.T
        s[query_ids[at : at + 256, None] == ids[None, :]] = -np.inf
        last = max(0, s.shape[1] - k)
        floor = np.partition(s, last, axis=1)[:, last]
        # The product's last bits depend on a row's place: all near the k-th are scored anew.
        r, c = np.nonzero((s >= floor[:, None] - 1e-9) & (s > -np.inf))
        score = cosine(q[at + r], x[c])
        order = np.lexsort((ids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        rows.append(at + r[keep])
        found.append(ids[c[keep]])
        scores.append(score[keep])
    return np.concatenate(rows), np.concatenate(found), np.concatenate(scores)


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each row."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[keep], ids[keep], scores[keep]


def blocks(routed: DataFrame, block: int, label: str) -> DataFrame:
    """part, number, ids, keys, vecs (of about ``block`` rows, packed) of rows id, key, vec, part."""
    placed = cut(routed, label)
    # A row for each part.  By place in the written table: equal rows spread as well as others.
    counts = F.broadcast(placed.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks")))
    dealt = placed.withColumn("at", F.monotonically_increasing_id()).join(counts, "part").withColumn("number", F.pmod(F.xxhash64("at"), F.col("blocks")))

    def packed(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        own = (f["id"].to_numpy(np.int64).tobytes(), f["key"].to_numpy(np.int64).tobytes(), np.array(f["vec"].tolist(), np.float64).tobytes())
        return pd.DataFrame([(*key, *own)], columns=["part", "number", "ids", "keys", "vecs"])

    rows = dealt.select("id", "key", "vec", "part", "number").groupBy("part", "number").applyInPandas(packed, "part int, number long, ids binary, keys binary, vecs binary")
    return cut(rows, f"{label}-blocks")


def search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, parts: int | None = None, probes: int | None = None, recall: float = 0.97, fit_rows: int = 8192, block: int = 4096
) -> DataFrame:
    """query_id, rank, vec_id, score for each distinct query row's k nearest; both inputs: id, vec."""
    spark = vectors.sparkSession
    model = fit(vectors, parts, probes, recall, fit_rows)
    schema = "query_id long, rank int, vec_id long, score double"
    if model is None:
        return spark.createDataFrame([], schema)
    w, bias, length, probes = model

    def route(probes: int):
        def run(frames):
            for f in frames:
                f = f[f["vec"].map(len) == length]
                if len(f):
                    best = np.argsort(-(unit_rows(np.array(f["vec"].tolist())) @ w + bias), axis=1, kind="stable")[:, :probes]
                    yield pd.DataFrame({"id": f["id"].to_numpy(), "key": f["key"].to_numpy(), "vec": f["vec"].to_numpy(), "parts": best.astype(np.int32).tolist()})

        return run

    def routed(df: DataFrame, probes: int) -> DataFrame:
        keyed = df.select("id", F.xxhash64("vec").alias("key"), "vec")
        return keyed.mapInPandas(route(probes), "id long, key long, vec array<double>, parts array<int>").select("id", "key", "vec", F.explode("parts").alias("part"))

    held = blocks(routed(vectors, 1), block, "ann-index")
    asked = blocks(routed(queries.dropDuplicates(["id", "vec"]), probes), block, "ann-queries")
    slices = held.groupBy("part").agg(F.floor(F.max("number") / SLICE).alias("last"))  # a row a part
    left = asked.join(F.broadcast(slices), "part").select("part", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("slice"), "number", "ids", "keys", "vecs")
    right = held.select("part", F.floor(F.col("number") / SLICE).alias("slice"), F.col("ids").alias("x_ids"), F.col("vecs").alias("x_vecs"))
    pairs = left.join(right.hint("merge"), ["part", "slice"]).select("part", "slice", "number", "ids", "keys", "vecs", "x_ids", "x_vecs")

    def compare(batches):
        now, held_ids, held_keys, kept = None, None, None, None

        def told():
            rows, ids, scores = kept
            return pa.record_batch([pa.array(held_ids[rows]), pa.array(held_keys[rows]), pa.array(ids), pa.array(scores)], names=["query_id", "query_key", "vec_id", "score"])

        for b in batches:
            for r in range(b.num_rows):
                part, at, number = (b.column(i)[r].as_py() for i in range(3))
                ids, keys, vecs, x_ids, x_vecs = (np.frombuffer(b.column(i)[r].as_buffer(), t) for i, t in zip(range(3, 8), (np.int64, np.int64, np.float64, np.int64, np.float64)))
                found = search_block(x_ids, x_vecs.reshape(-1, length), ids, vecs.reshape(-1, length), k)
                if now != (part, at, number):
                    if now is not None:
                        yield told()
                    now, held_ids, held_keys, kept = (part, at, number), ids.copy(), keys.copy(), found
                else:
                    kept = _best(*(np.concatenate(x) for x in zip(kept, found)), k)
        if now is not None:
            yield told()

    found = pairs.mapInArrow(frugal(compare), "query_id long, query_key long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
