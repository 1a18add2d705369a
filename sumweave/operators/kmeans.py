"""k-means over the join by a weighted grid (coreset).

Each attribute is clustered by itself: continuous ones optimally in one dimension,
categorical ones into single values and one rest.  The join is then counted by the
attributes' clusters; Lloyd's iterations run on these weighted cells.

All values of a rest always stand together, so a centroid has one number for them: its
share of the rest.  The rest's values and weights stay in a table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.schema import JoinTree
from ..plans.scratch import cut
from .moments import histogram, histograms, running_counts

#: A centroid's name for its share of a categorical attribute's rest.
REST = None


def optimal_1d(values: np.ndarray, weights: np.ndarray, k: int) -> list[int]:
    """First positions of the k intervals of sorted values with least weighted squared error.

    Dynamic programming over prefix sums.  The best cut moves to the right with the last value, so each
    row is filled by halving: the middles of all halves of one depth are searched at once, each between
    the cuts of its neighbours.
    """
    n = len(values)
    if n <= k:
        return list(range(n))
    shift = values - values.mean()
    w, wx, wxx = (np.concatenate([[0.0], np.cumsum(weights * shift**p)]) for p in range(3))

    def sse(i, j):  # of values i..j inclusive
        s, t = w[j + 1] - w[i], wx[j + 1] - wx[i]
        return np.maximum(wxx[j + 1] - wxx[i] - t * t / s, 0.0)

    cost = sse(np.zeros(n, int), np.arange(n))
    cuts = []
    for c in range(1, k):
        new, cut_at = np.full(n, np.inf), np.zeros(n, int)
        lo, hi = np.array([c]), np.array([n - 1])
        first, last = np.array([c]), np.array([n - 1])
        while len(lo):
            mid = (lo + hi) // 2
            begin, end = np.maximum(first, c), np.minimum(last, mid)
            size = end - begin + 1
            starts = np.cumsum(size) - size
            own = np.repeat(np.arange(len(mid)), size)
            at = np.arange(size.sum()) - starts[own] + begin[own]
            total = cost[at - 1] + sse(at, mid[own])
            least = np.minimum.reduceat(total, starts)
            # the first place of each middle's least
            hit = np.flatnonzero(total == least[own])
            best = at[hit[np.unique(own[hit], return_index=True)[1]]]
            new[mid], cut_at[mid] = least, best
            lo, hi, first, last = (
                np.concatenate(x) for x in ((lo, mid + 1), (mid - 1, hi), (first, best), (best, last))
            )
            some = lo <= hi
            lo, hi, first, last = lo[some], hi[some], first[some], last[some]
        cost = new
        cuts.append(cut_at)
    out, end = [], n - 1
    for cut_at in reversed(cuts):
        out.append(int(cut_at[end]))
        end = cut_at[end] - 1
    return [0, *reversed(out)]


@dataclass
class Continuous:
    name: str
    firsts: list[float]
    means: list[float]

    def cluster(self) -> Column:
        out = F.lit(len(self.firsts) - 1)
        for i in reversed(range(len(self.firsts) - 1)):
            out = F.when(F.col(self.name) < F.lit(self.firsts[i + 1]), i).otherwise(out)
        return out


@dataclass
class Categorical:
    """own: values with a cluster each; the rest share the last id.

    rest: value, p (relative weight) of the other values; square: the sum of p * p.
    """

    name: str
    own: list[str]
    rest: DataFrame | None = None
    square: float = 0.0

    def cluster(self) -> Column:
        out = F.lit(len(self.own))
        for i, v in enumerate(self.own):
            out = F.when(F.col(self.name).cast("string") == v, i).otherwise(out)
        return out


def cluster_continuous(tree: JoinTree, name: str, k: int, bins: int | None = None, driver_values: int = 20_000_000) -> Continuous:
    """Optimal intervals over all of the attribute's distinct values.

    The driver holds these (a few dozen bytes each) and refuses more than ``driver_values``.  Only if asked for, the
    histogram is binned to ``bins`` quantiles first: cuts then fall on bin borders; the bins' sums stay exact.
    """
    h = histograms(tree, [name])
    if bins is not None:
        h = running_counts(cut(h, "histograms")).groupBy(F.expr(f"(upto - n) * {int(bins)} div total").alias("bin")).agg(
            F.min("x").alias("x"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("m"), F.sum("n").alias("n")
        )
    else:
        h = cut(h.withColumn("m", F.col("x")), "histograms")
        if h.count() > driver_values:
            raise ValueError(f"{name} has more than {driver_values} distinct values; ask for bins")
    rows = h.select("x", "m", F.col("n").cast("double").alias("n")).toPandas().sort_values("x")
    if not len(rows):
        raise ValueError(f"{name} has no value")
    x, m, n = (rows[c].to_numpy() for c in ("x", "m", "n"))
    starts = optimal_1d(m, n, k)
    ends = [*starts[1:], len(x)]
    return Continuous(name, [float(x[s]) for s in starts], [float((m[s:e] * n[s:e]).sum() / n[s:e].sum()) for s, e in zip(starts, ends)])


def categories(tree: JoinTree, name: str) -> DataFrame:
    """value (as text), n."""
    return histogram(tree, name).filter(F.col(name).isNotNull()).select(F.col(name).cast("string").alias("value"), "n")


def own_categories(counted: DataFrame, k: int, heavy_first: bool = False) -> list[str]:
    """The k-1 values with clusters of their own: rarest first (heaviest with ``heavy_first``), ties by value."""
    order = F.desc("n") if heavy_first else F.asc("n")
    return [r["value"] for r in counted.orderBy(order, "value").limit(k - 1).collect()]


def category_clusters(tree: JoinTree, name: str, k: int, heavy_first: bool = False) -> DataFrame:
    """value, cluster, n of every value."""
    counted = cut(categories(tree, name), "categories")
    return counted.select(F.col("value").alias(name), "n").select(
        F.col(name).alias("value"), Categorical(name, own_categories(counted, k, heavy_first)).cluster().alias("cluster"), "n"
    )


def cluster_categorical(tree: JoinTree, name: str, k: int, heavy_first: bool = False) -> Categorical:
    """The first k-1 values get clusters of their own; of the others the driver sees two sums."""
    counted = cut(categories(tree, name), "categories")
    own = own_categories(counted, k, heavy_first)
    others = counted.filter(~F.col("value").isin(own)) if own else counted
    sums = others.agg(F.sum("n").alias("n"), F.sum(F.col("n").cast("double") * F.col("n")).alias("q")).first()
    total = float(sums["n"] or 0)
    if not total:
        return Categorical(name, own)
    return Categorical(name, own, others.select("value", (F.col("n") / total).alias("p")), sums["q"] / total / total)


def grid(tree: JoinTree, clusters: list[Continuous | Categorical]) -> DataFrame:
    """Cluster of each attribute and the cell's weight: at most k**attributes rows."""
    df = tree.join([c.name for c in clusters])
    return df.groupBy(*(c.cluster().alias(f"cluster_{c.name}") for c in clusters)).agg(F.count(F.lit(1)).alias("weight"))


@dataclass
class Clustering:
    """centroids: of each, attribute -> mean, or value -> share (``REST``: of the rest)."""

    clusters: list[Continuous | Categorical]
    centroids: list[dict]

    def distance(self, centroid: dict) -> Column:
        """Squared distance of a row of the join, with the weights ``__p`` of its categories' values, to a centroid."""
        out = F.lit(0.0)
        for i, c in enumerate(self.clusters):
            m = centroid[c.name]
            if isinstance(c, Continuous):
                d = F.col(c.name).cast("double") - F.lit(m)
                out = out + d * d
            else:
                share = F.lit(m[REST]) * F.col(f"__p{i}")
                for v in c.own:
                    share = F.when(F.col(c.name).cast("string") == v, m[v]).otherwise(share)
                square = sum(m[v] ** 2 for v in c.own) + m[REST] ** 2 * c.square
                out = out + F.lit(1.0 + square) - F.lit(2.0) * share
        return out

    def assign(self, df: DataFrame) -> DataFrame:
        """``df`` with cost (squared distance) and cluster of its nearest centroid."""
        columns = df.columns
        for i, c in enumerate(self.clusters):
            if isinstance(c, Categorical):
                if c.rest is None:
                    df = df.withColumn(f"__p{i}", F.lit(0.0))
                else:
                    weights = c.rest.select(F.col("value").alias(f"__v{i}"), F.col("p").alias(f"__q{i}"))
                    df = df.join(weights, F.col(c.name).cast("string") == F.col(f"__v{i}"), "left").withColumn(f"__p{i}", F.coalesce(f"__q{i}", F.lit(0.0)))
        distances = F.array(*(self.distance(c) for c in self.centroids))
        return df.withColumn("__d", distances).select(*columns, F.array_min("__d").alias("cost"), (F.array_position("__d", F.array_min("__d")) - 1).alias("cluster"))

    def evaluate(self, df: DataFrame) -> float:
        return self.assign(df).agg(F.sum("cost").alias("c")).first()["c"]


def _vectors(clusters: list) -> tuple[list[np.ndarray], np.ndarray]:
    """For each attribute a vector a cluster (mean; shares of own values and of the rest), and the weight of every coordinate in distances."""
    tables, weights = [], []
    for c in clusters:
        if isinstance(c, Continuous):
            tables.append(np.array(c.means)[:, None])
            weights.append([1.0])
        else:
            tables.append(np.eye(len(c.own) + 1))
            weights.append([1.0] * len(c.own) + [c.square])
    return tables, np.concatenate(weights)


class _Local:
    """The grid on the driver."""

    def __init__(self, cells: np.ndarray, w: np.ndarray, draws: np.ndarray, tables: list[np.ndarray], scale: np.ndarray) -> None:
        self.x, self.w, self.draws, self.scale = np.hstack([t[cells[:, i]] for i, t in enumerate(tables)]), w, draws, scale

    def _distances(self, centers: np.ndarray) -> np.ndarray:
        return np.stack([((self.x - c) ** 2 * self.scale).sum(1) for c in centers], 1)

    def draw(self, j: int, centers: list[np.ndarray]) -> np.ndarray | None:
        """A cell's vector, drawn by weight and distance from the centers."""
        p = self.w * self._distances(np.array(centers)).min(1) if centers else self.w
        if not (p > 0).any():
            return None
        keys = np.where(p > 0, -np.log(self.draws[:, j]) / np.where(p > 0, p, 1), np.inf)
        return self.x[keys.argmin()]

    def means(self, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the cells nearest to each center: their weight and mean."""
        at = self._distances(centers).argmin(1)
        weight = np.bincount(at, self.w, len(centers))
        sums = np.stack([np.bincount(at, self.w * self.x[:, d], len(centers)) for d in range(self.x.shape[1])], 1)
        return weight, sums / np.maximum(weight, 1e-300)[:, None]


class _Spread:
    """The same over a grid that stays in Spark: rows of cluster ids, weight and draws; the driver gets a row a center."""

    def __init__(self, cells: DataFrame, names: list[str], tables: list[np.ndarray], scale: np.ndarray) -> None:
        self.cells, self.scale = cells, scale
        self.x = [F.element_at(F.array(*(F.lit(float(v)) for v in t[:, d])), F.col(n) + 1) for n, t in zip(names, tables) for d in range(t.shape[1])]

    def _distance(self, center: np.ndarray) -> Column:
        return sum((F.lit(float(s)) * (x - F.lit(float(c))) * (x - F.lit(float(c))) for x, c, s in zip(self.x, center, self.scale)), F.lit(0.0))

    def draw(self, j: int, centers: list[np.ndarray]) -> np.ndarray | None:
        p = F.col("weight") * (F.least(*map(self._distance, centers), F.lit(float("inf"))) if centers else F.lit(1.0))
        drawn = self.cells.select(*(x.alias(f"x{d}") for d, x in enumerate(self.x)), p.alias("p"), F.col("draws")[j].alias("u")).filter("p > 0")
        best = drawn.agg(F.min_by(F.array(*(f"x{d}" for d in range(len(self.x)))), -F.log("u") / F.col("p")).alias("x")).first()["x"]
        return None if best is None else np.array(best)

    def means(self, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = F.array(*(self._distance(c) for c in centers))
        placed = self.cells.select("weight", F.array_position(d, F.array_min(d)).alias("at"), *(x.alias(f"x{i}") for i, x in enumerate(self.x)))
        sums = placed.groupBy("at").agg(F.sum("weight").alias("w"), *(F.sum(F.col("weight") * F.col(f"x{i}")).alias(f"s{i}") for i in range(len(self.x))))
        weight, mean = np.zeros(len(centers)), np.zeros(centers.shape)
        for r in sums.collect():
            weight[r["at"] - 1], mean[r["at"] - 1] = r["w"], [r[f"s{i}"] / r["w"] for i in range(len(self.x))]
        return weight, mean


def fit(
    tree: JoinTree, continuous: list[str], categorical: list[str], k: int = 5, kappa: int | None = None, seed: int = 0, start: list | None = None,
    heavy_first: bool = False, max_iterations: int = 1000, bins: int | None = None, driver_cells: int = 1_000_000,
) -> Clustering | None:
    """Lloyd's iterations on the weighted grid until nothing moves; None for an empty join.

    start: explicit centroids as vectors (a mean; shares of own values and of the rest); otherwise k-means++, drawn by hashes of the cells.
    An empty cluster keeps its centroid.  A grid of up to ``driver_cells`` cells is held by the driver, a larger one by
    Spark; both take the same steps.
    """
    kappa = kappa or k
    if tree.join([*continuous, *categorical]).isEmpty():
        return None
    clusters = [*(cluster_continuous(tree, c, kappa, bins) for c in continuous), *(cluster_categorical(tree, c, kappa, heavy_first) for c in categorical)]
    names = [f"cluster_{c.name}" for c in clusters]
    uniform = lambda j: (F.pmod(F.xxhash64(*names, F.lit(seed), F.lit(j)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    cells = cut(grid(tree, clusters).withColumn("draws", F.array(*map(uniform, range(k)))), "kmeans-grid")
    tables, scale = _vectors(clusters)
    if cells.count() <= driver_cells:
        rows = cells.orderBy(*names).toPandas()
        held = _Local(rows[names].to_numpy(int), rows["weight"].to_numpy(float), np.stack(rows["draws"].to_list()), tables, scale)
    else:
        held = _Spread(cells, names, tables, scale)
    if start is not None:
        centers = np.array(start, float)
    else:
        drawn: list[np.ndarray] = []
        while len(drawn) < k and (x := held.draw(len(drawn), drawn)) is not None:
            drawn.append(x)
        centers = np.array(drawn)
    for _ in range(max_iterations):
        weight, mean = held.means(centers)
        new = np.where(weight[:, None] > 0, mean, centers)
        if np.allclose(new, centers, rtol=1e-12, atol=1e-12):
            break
        centers = new
    out = []
    for c in centers:
        at, named = 0, {}
        for cl, t in zip(clusters, tables):
            own = c[at : at + t.shape[1]].tolist()
            named[cl.name] = own[0] if isinstance(cl, Continuous) else dict(zip([*cl.own, REST], own))
            at += t.shape[1]
        out.append(named)
    return Clustering(clusters, out)
