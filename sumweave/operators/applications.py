"""The applications behind one interface: what label each takes, its batch, its run, its evaluation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .. import sources
from ..plans.batch import AggregateBatch, Query, count
from ..plans.schema import JoinTree
from . import kmeans, moments, regression, trees


@dataclass
class Task:
    """One run: the join tree, its features (the label first) and options."""

    spark: SparkSession
    tree: JoinTree
    features: list[sources.Feature] = field(default_factory=list)
    strategy: str = "flat"
    clusters: int = 5
    kappa: int | None = None
    depth: int = 1

    @property
    def label(self) -> str:
        return self.features[0].name

    def of(self, kind: int) -> list[str]:
        return [f.name for f in self.features[1:] if f.kind == kind]

    @property
    def continuous(self) -> list[str]:
        return self.of(sources.CONTINUOUS)

    @property
    def categorical(self) -> list[str]:
        return self.of(sources.CATEGORICAL)


@dataclass(frozen=True)
class Application:
    """run gives the result; evaluate (where there is a model) the name and value of its error on held-out rows.

    label: the kind that the first feature must have (None: any).
    """

    name: str
    label: str | None
    run: Callable[[Task], DataFrame]
    batch: Callable[[Task], AggregateBatch] | None = None
    evaluate: Callable[[Task, DataFrame], tuple[str, float | None]] | None = None

    def check(self, task: Task) -> None:
        if self.name != "count":
            sources.check_label(task.features, self.label)


def _covar_batch(t: Task) -> AggregateBatch:
    return moments.covar_batch(t.tree, [t.label, *t.continuous], t.categorical)


def _count_batch(t: Task) -> AggregateBatch:
    return AggregateBatch(t.tree).add(Query([], [count()], name="count"))


def _pairs_batch(t: Task) -> AggregateBatch:
    batch = AggregateBatch(t.tree)
    for i, a in enumerate(t.categorical):
        batch.add(Query([a], [count()], name=a))
        for b in t.categorical[i + 1 :]:
            batch.add(Query([a, b], [count()], name=f"{a},{b}"))
    return batch


def _thresholds(t: Task) -> dict[str, list]:
    cuts: dict[str, list] = {c: [] for c in t.continuous}
    for r in moments.percentiles(t.tree, t.continuous).collect() if t.continuous else []:  # 19 a feature
        if r["cut"] not in cuts[r["feature"]]:
            cuts[r["feature"]].append(r["cut"])
    return {c: sorted(v) for c, v in cuts.items()}


def _regress(t: Task) -> DataFrame:
    m = regression.fit(t.tree, t.label, t.continuous, t.categorical, strategy=t.strategy)
    return t.spark.createDataFrame([(n, v, float(x)) for (n, v), x in zip(m.names, m.theta)] if m else [], "feature string, value string, theta double")


def _regression_error(t: Task, rows: DataFrame) -> tuple[str, float | None]:
    m = regression.fit(t.tree, t.label, t.continuous, t.categorical, strategy=t.strategy)
    return "RMSE", m.rmse(rows) if m else None


def _split(classify: bool) -> Callable[[Task], DataFrame]:
    return lambda t: trees.best_split(t.tree, t.label, _thresholds(t), t.categorical, classify=classify)


def _tree_error(classify: bool) -> Callable[[Task, DataFrame], tuple[str, float | None]]:
    def run(t: Task, rows: DataFrame) -> tuple[str, float | None]:
        top = trees.grow(t.tree, t.label, _thresholds(t), t.categorical, depth=t.depth, classify=classify)
        return "error rate" if classify else "RMSE", trees.evaluate(top, rows, t.label, classify) if top else None

    return run


def _clustering(t: Task) -> kmeans.Clustering | None:
    own = t.features[0].kind == sources.CATEGORICAL
    return kmeans.fit(t.tree, t.continuous if own else [t.label, *t.continuous], t.categorical + [t.label] * own, t.clusters, t.kappa)


def _cluster(t: Task) -> DataFrame:
    m = _clustering(t)
    rows = [(i, name, str(x)) for i, c in enumerate(m.centroids if m else []) for name, x in c.items()]
    return t.spark.createDataFrame(rows, "cluster int, feature string, centroid string")


def _cluster_cost(t: Task, rows: DataFrame) -> tuple[str, float | None]:
    m = _clustering(t)
    return "cost", m.evaluate(rows) if m else None


APPLICATIONS = {
    a.name: a
    for a in (
        Application("count", None, lambda t: moments.count_join(t.tree, t.strategy), _count_batch),
        Application("covar", "continuous", lambda t: moments.covariance(t.tree, [t.label, *t.continuous], t.categorical, t.strategy), _covar_batch),
        Application("reg", "continuous", _regress, _covar_batch, _regression_error),
        Application("rtree", "continuous", _split(False), None, _tree_error(False)),
        Application("ctree", "categorical", _split(True), None, _tree_error(True)),
        Application("cube", "continuous", lambda t: moments.cube(t.tree, t.categorical, [t.label, *t.of(sources.MEASURE)])),
        Application("mi", "continuous", lambda t: moments.mutual_information(t.tree, t.categorical), _pairs_batch),
        Application("perc", "continuous", lambda t: moments.percentiles(t.tree, [t.label, *t.continuous])),
        Application("kmeans", None, _cluster, None, _cluster_cost),
    )
}
