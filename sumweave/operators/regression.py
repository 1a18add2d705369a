"""Ridge regression trained on second moments; the join is aggregated once, never one-hot encoded."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.batch import AggregateBatch
from ..plans.schema import JoinTree
from ..plans.scratch import cut
from .moments import covariance, degree_two_batch, monomial_name, monomials


@dataclass
class Model:
    """names: of each parameter the attribute ("1": intercept; "a*b": a product) and the category's value as text."""

    label: str
    continuous: list[str]
    categorical: list[str]
    names: list[tuple[str, str | None]]
    theta: np.ndarray

    def predict(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``; categories without a parameter count for nothing.

        Each categorical attribute meets the table of its parameters, which ``fit`` bounds.
        """
        columns = df.columns
        out = F.lit(float(self.theta[0]))
        for (name, value), t in zip(self.names[1:], self.theta[1:]):
            if value is None and name not in self.categorical:
                term = F.lit(float(t))
                for part in name.split("*"):
                    term = term * F.col(part).cast("double")
                out = out + term
        for i, c in enumerate(self.categorical):
            rows = [(v, float(t)) for (n, v), t in zip(self.names, self.theta) if n == c]
            if rows:
                table = df.sparkSession.createDataFrame(rows, f"__v{i} string, __t{i} double")
                df = df.join(F.broadcast(table), F.col(c).cast("string") == F.col(f"__v{i}"), "left")
                out = out + F.coalesce(f"__t{i}", F.lit(0.0))
        return df.select(*columns, out.alias("prediction"))

    def rmse(self, df: DataFrame) -> float | None:
        error = F.col(self.label).cast("double") - F.col("prediction")
        return self.predict(df).agg(F.sqrt(F.avg(error * error)).alias("e")).first()["e"]


def moments(tree: JoinTree, label: str, continuous: list[str], categorical: list[str], strategy: str = "flat", max_parameters: int = 4000):
    """names, XtX, Xty, yty, N.  The driver holds the matrix: more than ``max_parameters`` parameters are refused before it gets any."""
    rows = cut(covariance(tree, [*continuous, label], categorical, strategy), "moments")
    size = 1 + len(continuous) + rows.filter(F.col("value_i").isNotNull() & (F.col("feature_j") == "1")).count()
    if size > max_parameters:
        raise ValueError(f"{size} parameters; the driver's matrix is bounded to {max_parameters}")
    cells = {}
    for r in rows.toPandas().itertuples(index=False):
        a, b = (r.feature_i, r.value_i), (r.feature_j, r.value_j)
        a, b = (("1", None) if a[0] == "1" else a), (("1", None) if b[0] == "1" else b)
        cells[a, b] = cells[b, a] = 0.0 if r.agg is None or np.isnan(r.agg) else r.agg
    names = [("1", None), *((c, None) for c in continuous)]
    names += sorted({a for a, b in cells if a[0] in categorical and b == ("1", None) and a[1] is not None})
    at = {n: i for i, n in enumerate(names)}
    gram, target = np.zeros((len(names), len(names))), np.zeros(len(names))
    for (a, b), v in cells.items():
        if a in at and b in at:
            gram[at[a], at[b]] = v
        if a in at and b == (label, None):
            target[at[a]] = v
    for n, i in at.items():
        if n[0] in categorical:
            gram[i, i] = cells[n, ("1", None)]
    total = cells.get((("1", None), ("1", None)), 0.0)
    return names, gram, target, cells.get(((label, None), (label, None)), 0.0), total


def descend(a: np.ndarray, b: np.ndarray, square: float, penalty: np.ndarray, seed: int = 0, tolerance: float = 1e-5, max_iterations: int = 1000) -> np.ndarray:
    """Gradient descent on half the mean squared error plus half the penalty, from random parameters in [-4, 4).

    A step starts at 0.1 and later at the Barzilai-Borwein length (the short one if it is more than half of
    the long one, else the long one less half the short one; as before if either is negative); it is halved, 500 times at
    most, until the loss falls by half the step times the squared gradient.  Ends when the gradient's
    norm is below ``tolerance`` of the first one's (plus 0.001).
    """
    theta = np.random.default_rng(seed).uniform(-4, 4, len(b))
    loss = lambda t: 0.5 * (t @ a @ t + square + penalty @ (t * t)) - b @ t
    gradient = lambda t: a @ t - b
    step, error, g = 0.1, loss(theta), gradient(theta)
    first = np.linalg.norm(g + penalty * theta)
    for _ in range(max_iterations):
        down = g + penalty * theta
        size = float(down @ down)
        for _ in range(501):
            new = theta - step * down
            if not loss(new) > error - step / 2 * size:
                break
            step /= 2
        error, moved, bent = loss(new), new - theta, gradient(new) - g
        theta, g = new, g + bent
        if np.sqrt(size) / (first + 0.001) < tolerance:
            break
        along, curve = moved @ bent, bent @ bent
        if along > 0 and curve > 0:
            long, short = moved @ moved / along, along / curve
            step = short if short > 0.5 * long else long - 0.5 * short
    return theta


def fit(
    tree: JoinTree, label: str, continuous: list[str], categorical: list[str] = (), ridge: float = 0.1, solver: str = "normal", strategy: str = "flat",
    seed: int = 0, tolerance: float = 1e-5, max_iterations: int = 1000, max_parameters: int = 4000,
) -> Model | None:
    """theta with (XtX/N + ridge without intercept) theta = Xty/N; None for an empty join.

    solver "bgd": towards the same fixed point by ``descend``.
    """
    names, gram, target, square, total = moments(tree, label, list(continuous), list(categorical), strategy, max_parameters)
    if not total:
        return None
    penalty = np.full(len(names), ridge)
    penalty[0] = 0.0
    if solver == "normal":
        theta = np.linalg.lstsq(gram / total + np.diag(penalty), target / total, rcond=None)[0]
    else:
        theta = descend(gram / total, target / total, square / total, penalty, seed, tolerance, max_iterations)
    return Model(label, list(continuous), list(categorical), names, theta)


def fit_degree_two(tree: JoinTree, label: str, continuous: list[str], ridge: float = 0.1, strategy: str = "flat") -> Model | None:
    """Ridge over the attributes and their pairwise products, from the moments of degree up to 4: one row of sums."""
    batch = AggregateBatch(tree).add(degree_two_batch(tree, continuous, label))
    sums = batch.execute(strategy)[0].first()
    if not sums["n"]:
        return None
    features = monomials(continuous, 2)
    value = lambda *m: float(sums[monomial_name(tuple(sorted(m)))] or 0.0) / sums["n"]
    gram = np.array([[value(*x, *y) for y in features] for x in features])
    penalty = np.diag([0.0] + [ridge] * (len(features) - 1))
    theta = np.linalg.lstsq(gram + penalty, np.array([value(*x, label) for x in features]), rcond=None)[0]
    return Model(label, list(continuous), [], [("*".join(m) or "1", None) for m in features], theta)
