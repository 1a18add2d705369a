"""Counts, second moments, data cubes, mutual information, percentiles and gradients."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as f
from ..plans.batch import SET, Aggregate, AggregateBatch, Query, Shared, agg, count
from ..plans.schema import JoinTree
from ..plans.scratch import cut


def count_join(tree: JoinTree, strategy: str = "views") -> DataFrame:
    """One row: n, the size of the join."""
    return AggregateBatch(tree).add(Query([], [count()])).execute(strategy)[0]


def covar_batch(tree: JoinTree, continuous: list[str], categorical: list[str], roots: dict[str, str] | None = None) -> AggregateBatch:
    """The second moments: scalars, one query a categorical attribute, one a pair of these."""
    roots = roots or {}
    batch = AggregateBatch(tree)
    pairs = [(a, b) for i, a in enumerate(continuous) for b in continuous[i:]]
    batch.add(Query([], [count(), *(agg(f"s_{c}", f.x(c)) for c in continuous), *(agg(f"m_{a}_{b}", (f.x(a), f.x(b))) for a, b in pairs)], name="scalars"))
    for c in categorical:
        batch.add(Query([c], [count(), *(agg(f"s_{x}", f.x(x)) for x in continuous)], roots.get(c), c))
    for i, a in enumerate(categorical):
        for b in categorical[i + 1 :]:
            batch.add(Query([a, b], [count()], roots.get(b), f"{a},{b}"))
    return batch


def cell(a: str, a_value: str | None, b: str, b_value: str | None, value: Column) -> Column:
    """One row of a result: features a and b, their values (columns, as text) and a number."""
    text = lambda v: F.lit(None).cast("string") if v is None else F.col(v).cast("string")
    return F.struct(F.lit(a).alias("feature_i"), text(a_value).alias("value_i"), F.lit(b).alias("feature_j"), text(b_value).alias("value_j"), value.alias("v"))


def unpivot(shared: Shared, cells: list[list[Column]]) -> DataFrame:
    """The cells of each query, from every row of its set: the shared aggregation is read once."""
    by_set: dict[int, list[Column]] = {}
    for (k, _), own in zip(shared.places, cells):
        by_set.setdefault(k, []).extend(own)
    rows = None
    for k, own in by_set.items():
        rows = F.when(F.col(SET) == k, F.array(*own)) if rows is None else rows.when(F.col(SET) == k, F.array(*own))
    return shared.df.select(F.explode(rows).alias("c")).select("c.*")


def covariance(tree: JoinTree, continuous: list[str], categorical: list[str], strategy: str = "flat") -> DataFrame:
    """The matrix of second moments as rows feature_i, value_i, feature_j, value_j, agg ("1": the constant)."""
    batch = covar_batch(tree, continuous, categorical)
    shared = batch.shared(strategy)
    column = {(q.name, a.name): F.col(n).cast("double") for q, (_, names) in zip(batch.queries, shared.places) for a, n in zip(q.aggregates, names)}
    pairs = [(a, b) for i, a in enumerate(continuous) for b in continuous[i:]]
    cells = [
        [cell("1", None, "1", None, column["scalars", "n"])]
        + [cell("1", None, c, None, column["scalars", f"s_{c}"]) for c in continuous]
        + [cell(a, None, b, None, column["scalars", f"m_{a}_{b}"]) for a, b in pairs]
    ]
    for c in categorical:
        cells.append([cell(c, c, "1", None, column[c, "n"]), *(cell(c, c, x, None, column[c, f"s_{x}"]) for x in continuous)])
    for i, a in enumerate(categorical):
        cells += [[cell(a, a, b, b, column[f"{a},{b}", "n"])] for b in categorical[i + 1 :]]
    return unpivot(shared, cells).withColumnRenamed("v", "agg")


def cube(tree: JoinTree, dimensions: list[str], measures: list[str]) -> DataFrame:
    """Counts and sums by all subsets of the dimensions; ``gid`` tells "all" from null."""
    df = tree.join([*dimensions, *measures])
    return df.cube(*dimensions).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), *(F.sum(m).cast("double").alias(f"s_{m}") for m in measures))


def rollup(tree: JoinTree, dimensions: list[str], measures: list[str]) -> DataFrame:
    df = tree.join([*dimensions, *measures])
    return df.rollup(*dimensions).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), *(F.sum(m).cast("double").alias(f"s_{m}") for m in measures))


def grouping_sets(tree: JoinTree, sets: list[list[str]], measures: list[str]) -> DataFrame:
    """One pass over the join for several group-bys."""
    names = list(dict.fromkeys(c for s in sets for c in s))
    df = tree.join([*names, *measures])
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"), *(F.sum(m).cast("double").alias(f"s_{m}") for m in measures))


def pair_counts(tree: JoinTree, categorical: list[str], strategy: str = "flat") -> DataFrame:
    """Counts of single values (feature_j null) and of pairs, as rows."""
    batch = AggregateBatch(tree)
    pairs = [(a, b) for i, a in enumerate(categorical) for b in categorical[i + 1 :]]
    for c in categorical:
        batch.add(Query([c], [count()]))
    for a, b in pairs:
        batch.add(Query([a, b], [count()]))
    shared = batch.shared(strategy)
    n = [F.col(names[0]) for _, names in shared.places]
    cells = [[cell(c, c, "", None, x)] for c, x in zip(categorical, n)] + [[cell(a, a, b, b, x)] for (a, b), x in zip(pairs, n[len(categorical) :])]
    return unpivot(shared, cells).select("feature_i", "value_i", F.nullif("feature_j", F.lit("")).alias("feature_j"), "value_j", F.col("v").alias("n"))


def mutual_information(tree: JoinTree, categorical: list[str], digits: int = 6, strategy: str = "flat") -> DataFrame:
    """feature_i, feature_j, mi (nats) of all pairs; null is a value like others.

    With h the sum of n ln n over a table's counts and t the number of rows, the mutual
    information is (h(a, b) - h(a) - h(b)) / t + ln t: every count adds its share to the pairs it
    belongs to, and only one row a pair is left.
    """
    pairs = [(a, b) for i, a in enumerate(categorical) for b in categorical[i + 1 :]]
    if not pairs:
        raise ValueError("mutual information needs two categorical attributes")
    counts = pair_counts(tree, categorical, strategy)
    x = F.col("n") * F.log(F.col("n").cast("double"))
    share = lambda a, b, h, t: F.struct(F.lit(a).alias("feature_i"), F.lit(b).alias("feature_j"), h.alias("h"), t.alias("t"))
    rows = F.when(F.col("feature_j").isNotNull(), F.array(F.struct("feature_i", "feature_j", x.alias("h"), F.col("n").alias("t"))))
    for c in categorical:
        rows = rows.when(F.col("feature_i") == c, F.array(*(share(a, b, -x, F.lit(0).cast("long")) for a, b in pairs if c in (a, b))))
    sums = counts.select(F.explode(rows).alias("r")).groupBy("r.feature_i", "r.feature_j").agg(F.sum("r.h").alias("h"), F.sum("r.t").alias("t"))
    # adding zero makes a rounded -0.0 a plain zero
    return sums.select("feature_i", "feature_j", (F.round(F.col("h") / F.col("t") + F.log("t"), digits) + F.lit(0.0)).alias("mi"))


def histogram(tree: JoinTree, attribute: str, strategy: str = "flat") -> DataFrame:
    return AggregateBatch(tree).add(Query([attribute], [count()])).execute(strategy)[0]


def histograms(tree: JoinTree, attributes: list[str]) -> DataFrame:
    """feature (its place in ``attributes``), x (double), n: how often each value stands in the join, of all attributes in one pass; no nulls."""
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("feature"), F.col(a).cast("double").alias("x")) for i, a in enumerate(attributes)))).alias("v")
    return tree.join(attributes).select(values).select("v.*").filter("x IS NOT NULL").groupBy("feature", "x").agg(F.count(F.lit(1)).alias("n"))


def running_counts(histogram: DataFrame, blocks: int = 64) -> DataFrame:
    """feature, x, n, upto (cumulative count), total of histograms (feature, x double, n).

    Each feature's values are cut into blocks at approximate quantiles; a running sum in each block and
    one over the blocks' totals give the cumulative count without sorting a feature in one task.
    """
    bounds = histogram.groupBy("feature").agg(F.percentile_approx("x", [i / blocks for i in range(1, blocks)], 1000).alias("bounds"))
    block = F.size(F.filter("bounds", lambda b: b < F.col("x")))
    placed = histogram.join(F.broadcast(bounds), "feature").select("feature", "x", "n", block.alias("block"))  # a row a feature
    every = Window.partitionBy("feature")  # one row a block
    sums = placed.groupBy("feature", "block").agg(F.sum("n").alias("bn"))
    sums = sums.select("feature", "block", (F.sum("bn").over(every.orderBy("block")) - F.col("bn")).alias("before"), F.sum("bn").over(every).alias("total"))
    inside = F.sum("n").over(Window.partitionBy("feature", "block").orderBy("x"))
    return placed.withColumn("inside", inside).join(F.broadcast(sums), ["feature", "block"]).select("feature", "x", "n", (F.col("before") + F.col("inside")).alias("upto"), "total")


def percentiles(tree: JoinTree, attributes: list[str], parts: int = 20) -> DataFrame:
    """feature, i, cut: the smallest value whose cumulative count times ``parts`` is at least i * N.

    The histograms are written, as they are read for block bounds, block sums and running sums; the join runs once.
    """
    counted = running_counts(cut(histograms(tree, attributes), "histograms"))
    first = F.expr(f"(upto - n) * {parts} div total") + 1
    last = F.least(F.expr(f"upto * {parts} div total"), F.lit(parts - 1).cast("long"))
    cuts = counted.withColumns({"first": first, "last": last}).filter("first <= last")
    name = F.get(F.array(*(F.lit(a) for a in attributes)), F.col("feature"))
    return cuts.select(name.alias("feature"), F.explode(F.sequence(F.col("first").cast("int"), F.col("last").cast("int"))).alias("i"), F.col("x").alias("cut"))


def gradient_batch(tree: JoinTree, continuous: list[str], categorical: list[str], theta: dict, strategy: str = "flat") -> DataFrame:
    """feature, value, gradient: sums over the join of x_i times the linear score under ``theta``.

    theta: attribute -> number (continuous) or value -> number (categorical); "1": intercept.
    A sum of products a feature; categorical features are grouped by their value.
    """
    def terms(*head):
        products = [(*head, f.theta_cont(c, theta[c])) for c in continuous if c in theta]
        products += [(*head, f.theta_cat(c, theta[c])) for c in categorical if c in theta]
        if "1" in theta:
            anchor = (continuous or categorical)[0]
            products.append((*head, f.custom(f"const{theta['1']!r}", [anchor], lambda _: F.lit(theta["1"]), repr(theta["1"]))))
        return products

    batch = AggregateBatch(tree).add(Query([], [Aggregate(tuple(terms()), "g_1"), *(Aggregate(tuple(terms(f.x(c))), f"g_{c}") for c in continuous)]))
    for c in categorical:
        batch.add(Query([c], [Aggregate(tuple(terms()), "g")]))
    shared = batch.shared(strategy)
    n = [[F.col(c) for c in names] for _, names in shared.places]
    cells = [[cell(c, None, "", None, x) for c, x in zip(["1", *continuous], n[0])]] + [[cell(c, c, "", None, x[0])] for c, x in zip(categorical, n[1:])]
    return unpivot(shared, cells).select(F.col("feature_i").alias("feature"), F.col("value_i").alias("value"), F.col("v").alias("gradient"))


def monomials(names: list[str], degree: int) -> list[tuple[str, ...]]:
    """Sorted tuples of up to ``degree`` names, () first."""
    return [m for d in range(degree + 1) for m in combinations_with_replacement(sorted(names), d)]


def monomial_name(m: tuple[str, ...]) -> str:
    return "m_" + "_".join(f"{n}{m.count(n)}" for n in dict.fromkeys(m)) if m else "n"


def degree_two_batch(tree: JoinTree, continuous: list[str], label: str | None = None) -> Query:
    """All monomials of degree up to 4 of the continuous attributes; with a label also up to degree 2 times it, and its square."""
    wanted = monomials(continuous, 4)
    if label is not None:
        wanted += [tuple(sorted((*m, label))) for m in monomials(continuous, 2)] + [(label, label)]
    power = lambda m: tuple(f.power(n, m.count(n)) for n in dict.fromkeys(m))
    return Query([], [count(), *(agg(monomial_name(m), power(m)) for m in wanted[1:])])
