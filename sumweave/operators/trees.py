"""Regression and classification trees from aggregates.

Candidate splits of all nodes of one level come from one aggregation by (node, feature, value or
bin): each row counts for every feature, by its value or by its threshold bin.  Only that small table
is read for the splits: each bin adds to the thresholds above it.  A tree is grown from one pass over
the join, whatever its depth: rows that no split can tell apart are summed (``cells``), and all levels read these sums.

Nulls: rows without a label are left out; a null feature is on the right side of every split of it
(and no split of its own).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.schema import JoinTree
from ..plans.scratch import cut, held, release

_OPS = {"<=": lambda c, v: c <= v, ">": lambda c, v: c > v, "==": lambda c, v: c == v, "!=": lambda c, v: c != v}


@dataclass(frozen=True)
class Condition:
    """attribute op value; a path is a conjunction of these."""

    attribute: str
    op: str
    value: object

    def column(self) -> Column:
        return _OPS[self.op](F.col(self.attribute), F.lit(self.value))


def under(tree: JoinTree, path: list[Condition]) -> JoinTree:
    """The tree under a path: each condition filters the relation that owns its attribute."""
    for c in path:
        owner = tree.owner(c.attribute)
        tree = tree.replace(owner, tree.frame(owner).filter(c.column()))
    return tree


def _flat(tree: JoinTree, label: str, features: list[str], path: list[Condition]) -> DataFrame:
    return under(tree, path).join(list(dict.fromkeys([label, *features]))).withColumn("__node", F.lit(0))


def _bins(feature: str, thresholds: list) -> Column:
    """Position of the first threshold that is >= x; len(thresholds) beyond the last."""
    out = F.lit(len(thresholds))
    for i in reversed(range(len(thresholds))):
        out = F.when(F.col(feature) <= F.lit(thresholds[i]), i).otherwise(out)
    return out


def _histograms(df: DataFrame, thresholds: dict[str, list], categorical: list[str], by: list[str], sums: list[Column]) -> DataFrame:
    """node, ord, bin (of a continuous feature), value (of a categorical one, as text), ``by`` and sums, for all features in one pass."""
    none, text = F.lit(None).cast("int"), F.lit(None).cast("string")
    keys = [F.struct(F.lit(i).alias("ord"), _bins(c, t).cast("int").alias("bin"), text.alias("value")) for i, (c, t) in enumerate(thresholds.items())]
    keys += [F.struct(F.lit(len(thresholds) + i).alias("ord"), none.alias("bin"), F.col(c).cast("string").alias("value")) for i, c in enumerate(categorical)]
    own = [F.col(c).alias(c[2:]) for c in df.columns if c in ("__node", "__y", "__n", "__s", "__q")]  # no attribute's name
    return df.select(*own, F.explode(F.array(*keys)).alias("k")).groupBy("node", "k.ord", "k.bin", "k.value", *by).agg(*sums)


def _splits(h: DataFrame, thresholds: dict[str, list], categorical: list[str], by: list[str], sums: str) -> DataFrame:
    """node, ord, split, ``by``, and for each letter c of ``sums`` lc (left of the split) and tc (all, of thresholds only).

    A bin counts for all thresholds of its feature, on the left of those above it; a value for itself.
    """
    entry = lambda at, split, left: F.struct(at.alias("at"), split.alias("split"), left.alias("left"))
    lists = [F.array(*(entry(F.lit(i), F.lit(str(v)), F.col("bin") <= i) for i, v in enumerate(t))) for t in thresholds.values()]
    own = F.array(entry(F.lit(0), F.col("value"), F.lit(True)))
    which = own
    for i, (t, entries) in enumerate(zip(thresholds.values(), lists)):
        which = F.when(F.col("ord") == i, entries if t else F.lit(None)).otherwise(which)
    each = h.select("*", F.explode(which).alias("e")).select("*", "e.at", "e.split", "e.left")
    return each.groupBy("node", "ord", "at", "split", *by).agg(
        *(F.coalesce(F.sum(F.when(F.col("left"), F.col(c))), F.lit(0)).alias(f"l{c}") for c in sums), *(F.sum(c).alias(f"t{c}") for c in sums)
    )


def _named(df: DataFrame, thresholds: dict[str, list], categorical: list[str]) -> list[Column]:
    names = F.array(*(F.lit(c) for c in [*thresholds, *categorical]))
    return ["node", "ord", F.get(names, F.col("ord")).alias("feature"), (F.col("ord") >= len(thresholds)).alias("categorical"), "split"]


def _sse(n, s, q):
    return q - s * s / n


def _rows(df: DataFrame, label: str, classify: bool) -> DataFrame:
    """Each row that has a label as a cell of its own."""
    own = df.withColumn("__y", F.col(label).cast("string" if classify else "double")).filter("__y IS NOT NULL").withColumn("__n", F.lit(1).cast("long"))
    return own if classify else own.withColumns({"__s": F.col("__y"), "__q": F.col("__y") * F.col("__y")}).drop("__y")


def cells(tree: JoinTree, label: str, thresholds: dict[str, list], categorical: list[str], classify: bool = False) -> DataFrame:
    """The join, read once, with the rows that no split can tell apart as one; written to the shared folder.

    The features under their names, __rows, __n (those of them with a label) and __s, __q (sums of the label and its square)
    or __y (the class, one of what tells rows apart).  A continuous feature has its least value in the bin: no threshold lies between that
    and another of the bin, so conditions hold for the cell as for its rows (null and beyond the last are one bin, on the right of all).
    As many cells as combinations of bins and values at most, and never more than rows.
    """
    df = tree.join(list(dict.fromkeys([label, *thresholds, *categorical])), nested=True)
    y = F.col(label).cast("string" if classify else "double")
    continuous = [c for c in thresholds if c not in categorical]
    bins = {f"__bin{i}": _bins(c, sorted(thresholds[c])) for i, c in enumerate(continuous)}
    own = df.select(*categorical, *(F.col(c).alias(f"__x{i}") for i, c in enumerate(continuous)), *(b.alias(k) for k, b in bins.items()), y.alias("__y"))
    sums = [F.count(F.lit(1)).alias("__rows"), F.count("__y").alias("__n"), *(F.min(f"__x{i}").alias(c) for i, c in enumerate(continuous))]
    if not classify:
        sums += [F.sum("__y").alias("__s"), F.sum(F.col("__y") * F.col("__y")).alias("__q")]
    return cut(own.groupBy(*categorical, *bins, *(["__y"] if classify else [])).agg(*sums).drop(*bins), "tree-cells")


def regression_candidates(df: DataFrame, label: str, thresholds: dict[str, list], categorical: list[str]) -> DataFrame:
    """node, ord, feature, categorical, split (text), n_left, n_right, cost, pred_left, pred_right.

    cost: sum of squared errors of both sides; infinite (null here) if a side is empty.
    """
    return _regression(_rows(df, label, False), thresholds, categorical)


def _regression(own: DataFrame, thresholds: dict[str, list], categorical: list[str]) -> DataFrame:
    h = _histograms(own, thresholds, categorical, [], [F.sum(c).alias(c) for c in "nsq"])
    out = _splits(h, thresholds, categorical, [], "nsq")
    if categorical:
        whole = Window.partitionBy("node", "ord")  # a row a value or threshold
        value = F.col("ord") >= len(thresholds)
        out = out.withColumns({f"t{c}": F.when(value, F.sum(f"l{c}").over(whole)).otherwise(F.col(f"t{c}")) for c in "nsq"}).filter("split IS NOT NULL")
    rn, rs, rq = (F.col(f"t{c}") - F.col(f"l{c}") for c in "nsq")
    good = (F.col("ln") > 0) & (rn > 0)
    safe = F.when(good, rn)
    return out.select(
        *_named(out, thresholds, categorical),
        F.col("ln").alias("n_left"),
        rn.alias("n_right"),
        (_sse(F.when(good, F.col("ln")), F.col("ls"), F.col("lq")) + _sse(safe, rs, rq)).alias("cost"),
        (F.col("ls") / F.when(F.col("ln") > 0, F.col("ln"))).alias("pred_left"),
        (rs / safe).alias("pred_right"),
    )


def classification_candidates(df: DataFrame, label: str, thresholds: dict[str, list], categorical: list[str]) -> DataFrame:
    """As above with weighted Gini cost and majority classes (ties: the smaller class)."""
    return _classification(_rows(df, label, True), thresholds, categorical)


def _classification(own: DataFrame, thresholds: dict[str, list], categorical: list[str]) -> DataFrame:
    h = _histograms(own, thresholds, categorical, ["y"], [F.sum("n").alias("n")])
    each = _splits(h, thresholds, categorical, ["y"], "n")
    own = F.collect_list(F.struct("y", F.col("ln").alias("l"), (F.col("tn") - F.col("ln")).alias("r")))
    if not categorical:
        out = each.groupBy("node", "ord", "at", "split").agg(own.alias("sides"))
    else:
        # a side has a number for each class of its node, also of those that no row of a value has
        value = F.col("ord") >= len(thresholds)
        each = each.withColumn("tn", F.when(value, F.sum("ln").over(Window.partitionBy("node", "ord", "y"))).otherwise(F.col("tn")))
        each = each.withColumn("classes", F.collect_set(F.struct("y", F.col("tn").alias("t"))).over(Window.partitionBy("node", "ord")))
        found = each.filter("split IS NOT NULL").groupBy("node", "ord", "at", "split").agg(
            own.alias("own"), F.map_from_entries(F.collect_list(F.struct("y", "ln"))).alias("left"), F.first("classes").alias("classes")
        )

        def side(c):
            left = F.coalesce(F.element_at("left", c["y"]), F.lit(0).cast("long"))
            return F.struct(c["y"].alias("y"), left.alias("l"), (c["t"] - left).alias("r"))

        out = found.select("node", "ord", "split", F.when(value, F.transform("classes", side)).otherwise(F.col("own")).alias("sides"))
    zero = F.lit(0).cast("long")
    total = lambda c, f: F.aggregate(F.transform("sides", lambda x: f(x[c])), f(zero), lambda a, b: a + b)
    square = lambda v: v.cast("double") * v
    most = lambda c: F.array_min(F.transform("sides", lambda x: F.struct((-x[c]).alias("k"), x["y"].alias("y"))))["y"]
    out = out.withColumns({"n_left": total("l", lambda v: v), "n_right": total("r", lambda v: v), "ql": total("l", square), "qr": total("r", square), "pred_left": most("l"), "pred_right": most("r")})
    good = (F.col("n_left") > 0) & (F.col("n_right") > 0)
    rows = F.col("n_left") + F.col("n_right")
    gini = lambda n, q: F.when(good, (F.lit(1.0) - F.col(q) / square(F.col(n))) * F.col(n) / rows)
    return out.select(*_named(out, thresholds, categorical), "n_left", "n_right", (gini("n_left", "ql") + gini("n_right", "qr")).alias("cost"), "pred_left", "pred_right")


def candidates(tree: JoinTree, label: str, thresholds: dict[str, list], categorical: list[str], path: list[Condition] = (), classify: bool = False) -> DataFrame:
    df = _flat(tree, label, [*thresholds, *categorical], list(path))
    return (classification_candidates if classify else regression_candidates)(df, label, thresholds, categorical).drop("node")


def best_split(tree: JoinTree, label: str, thresholds: dict[str, list], categorical: list[str], path: list[Condition] = (), classify: bool = False, digits: int = 6) -> DataFrame:
    """The cheapest candidate; ties (to ``digits``) go to the first feature, then the smaller split."""
    found = candidates(tree, label, thresholds, categorical, path, classify).filter("cost IS NOT NULL")
    place = F.when(F.col("categorical"), F.lit(0.0)).otherwise(F.expr("try_cast(split AS double)"))
    return found.orderBy(F.round("cost", digits), "ord", place, "split").limit(1)


@dataclass
class Node:
    id: int
    n: int
    prediction: object
    condition: Condition | None = None
    left: Node | None = None
    right: Node | None = None


def grow(tree: JoinTree, label: str, thresholds: dict[str, list], categorical: list[str], depth: int = 3, min_rows: int = 1, classify: bool = False, made: DataFrame | None = None) -> Node | None:
    """A tree grown level by level, all from one pass over the join; None for an empty join.

    The driver keeps the nodes (at most 2**depth) and the best split of each.  made: the join's ``cells``, where they are there already.
    """
    if made is None:
        spark = tree.frame(tree.root).sparkSession
        before = held(spark)
        try:
            return grow(tree, label, thresholds, categorical, depth, min_rows, classify, cells(tree, label, thresholds, categorical, classify))
        finally:
            release(spark, before)
    features = [*thresholds, *categorical]
    base = made.filter("__n > 0")
    if classify:
        top = base.groupBy(F.col("__y").alias("y")).agg(F.sum("__n").alias("n")).agg(F.sum("n").alias("n"), F.min(F.struct((-F.col("n")).alias("k"), "y"))["y"].alias("p")).first()
    else:
        top = base.agg(F.sum("__n").alias("n"), (F.sum("__s") / F.sum("__n")).alias("p")).first()
    if not top["n"]:
        return None
    root = Node(1, top["n"], top["p"])
    frontier = [root]
    kinds = dict(base.dtypes)
    for _ in range(depth):
        if not frontier or not features:
            break
        level = base.withColumn("__node", _leaf(root, {n.id for n in frontier})).filter("__node > 0")
        found = (_classification if classify else _regression)(level, thresholds, categorical)
        order = F.struct(F.round("cost", 9), "ord", F.when(F.col("categorical"), 0.0).otherwise(F.expr("try_cast(split AS double)")), "split")
        best = found.filter(f"cost IS NOT NULL AND n_left >= {min_rows} AND n_right >= {min_rows}").groupBy("node").agg(F.min_by(F.struct("*"), order).alias("b")).select("b.*").collect()
        by_id, frontier = {n.id: n for n in frontier}, []
        for r in best:
            n = by_id[r["node"]]
            value = r["split"] if r["categorical"] and kinds[r["feature"]] == "string" else next(t for t in thresholds[r["feature"]] if str(t) == r["split"]) if not r["categorical"] else type_of(kinds[r["feature"]])(r["split"])
            n.condition = Condition(r["feature"], "==" if r["categorical"] else "<=", value)
            n.left, n.right = Node(2 * n.id, r["n_left"], r["pred_left"]), Node(2 * n.id + 1, r["n_right"], r["pred_right"])
            frontier += [n.left, n.right]
    return root


def type_of(kind: str):
    return float if kind in ("double", "float") or kind.startswith("decimal") else int


def _leaf(node: Node, wanted: set[int]) -> Column:
    """The id of the row's leaf, 0 for those that aren't wanted."""
    if node.condition is None:
        return F.lit(node.id if node.id in wanted else 0)
    return F.when(node.condition.column(), _leaf(node.left, wanted)).otherwise(_leaf(node.right, wanted))


def leaf(node: Node) -> Column:
    """The id of the row's leaf, also where leaves have one prediction."""
    if node.condition is None:
        return F.lit(node.id)
    return F.when(node.condition.column(), leaf(node.left)).otherwise(leaf(node.right))


def prediction(node: Node) -> Column:
    if node.condition is None:
        return F.lit(node.prediction)
    return F.when(node.condition.column(), prediction(node.left)).otherwise(prediction(node.right))


def evaluate(node: Node, df: DataFrame, label: str, classify: bool = False) -> float | None:
    """RMSE, or the share of wrong classes."""
    if classify:
        return df.agg(F.avg(F.when(prediction(node) == F.col(label).cast("string"), 0.0).otherwise(1.0)).alias("e")).first()["e"]
    error = F.col(label).cast("double") - prediction(node)
    return df.agg(F.sqrt(F.avg(error * error)).alias("e")).first()["e"]
