"""Registered queries over the star schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as f
from .operators import kmeans, moments, regression, trees
from .plans.batch import Aggregate, AggregateBatch, Query, agg, count
from .plans.sqlgen import join_sql, query_sql
from .plans.testdata import shape, star, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _one(name: str, group_by: list[str], aggregates: list[Aggregate], strategy: str = "flat", events: bool = False) -> None:
    """A query of one group-by, with the SQL of its plain join."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return AggregateBatch(star(spark, sf_dir, events)).add(Query(group_by, aggregates)).execute(strategy)[0]

    QUERIES[name] = run
    tree = shape(events)
    SQL[name] = query_sql(tree, group_by, aggregates, tables())


X = f.x
_one("join_count", [], [count()], "auto")
_one("join_count_views", [], [count()], "views")
_one("sum_product_cross", [], [agg("s", (X("quantity"), X("totalprice")))])
_one("sum_of_products", [], [agg("s", (X("quantity"), X("p_size")), (X("discount"), X("acctbal")))])
_one("sum_of_products_views", ["mktsegment"], [agg("s", (X("quantity"), X("p_size")), (X("quantity"), X("acctbal")))], "views")
_one("group_one", ["mktsegment"], [count(), agg("s", (X("quantity"), X("totalprice")))])
_one("group_two_rel", ["returnflag", "mktsegment"], [count(), agg("s", (X("extendedprice"), X("discount")))])
_one("group_three_rel", ["r_name", "p_brand", "orderstatus"], [count(), agg("s", X("quantity"))])
_one("powers", ["p_type"], [agg(f"p{n}", f.power("p_size", n), type="long") for n in (1, 2, 3, 4)])
_one("indicator_eq", ["linestatus"], [agg("s", (f.eq("returnflag", "R"), X("quantity")))])
_one("indicator_neq", ["linestatus"], [agg("s", (f.neq("orderpriority", "1-URGENT"), X("quantity")))])
_one("indicator_le", ["linestatus"], [agg("s", (f.le("p_size", 20), X("extendedprice")))])
_one("indicator_gt", ["linestatus"], [agg("s", (f.gt("p_size", 20), X("extendedprice")))])
_DISCOUNTED = f.custom("discounted", ["discount", "tax"], lambda d, t: (1 - d) * (1 + t), "(1 - {0}) * (1 + {1})")
_one("dynamic_fn", ["returnflag"], [agg("s", _DISCOUNTED)])
_DEAR = f.custom("dear", ["quantity", "extendedprice", "totalprice"], lambda q, e, t: F.when(q * e > t, 1).otherwise(0), "CASE WHEN {0} * {1} > {2} THEN 1 ELSE 0 END")
_one("forced_local", ["mktsegment"], [agg("n", _DEAR, type="long")])
_one("forced_local_views", ["mktsegment"], [agg("n", _DEAR, type="long"), count("rows_all")], "views")
_one("views_plan_group", ["returnflag", "mktsegment"], [count(), agg("s", (X("extendedprice"), X("discount")))], "views")
_one("hist_by_value", ["p_size"], [count()])
_one("exponential_product", ["returnflag"], [agg("s", f.product("quantity", "discount"))])
_one("fanout_count", [], [count()], "views", True)
_one("fanout_group", ["mktsegment", "event_type"], [count(), agg("s", (X("quantity"), X("value")))], "views", True)
_one("fanout_group_flat", ["mktsegment", "event_type"], [count(), agg("s", (X("quantity"), X("value")))], "flat", True)
_one("fanout_group_auto", ["mktsegment", "event_type"], [count(), agg("s", (X("quantity"), X("value")))], "auto", True)


_NULLS = {"returnflag": "nullif(returnflag, 'R')", "discount": "nullif(discount, 0.05)", "orderkey": "nullif(orderkey, 1)"}


def _with_nulls(name: str, group_by: list[str], aggregates: list[Aggregate]) -> None:
    """By views, over a fact table with nulls in a key, a group-by attribute and a factor."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tree = star(spark, sf_dir)
        tree = tree.replace("lineitem_r", tree.frame("lineitem_r").withColumns({c: F.expr(e) for c, e in _NULLS.items()}))
        # a null key has no match, so nothing is known to be complete
        tree.complete = frozenset()
        return AggregateBatch(tree).add(Query(group_by, aggregates)).execute("views")[0]

    QUERIES[name] = run
    own = tables()
    own["lineitem_r"] = f"(SELECT * REPLACE ({', '.join(f'{e} AS {c}' for c, e in _NULLS.items())}) FROM {own['lineitem_r']})"
    SQL[name] = query_sql(shape(), group_by, aggregates, own)


_with_nulls("views_null_group", ["returnflag", "mktsegment"], [count(), agg("s", (X("quantity"), X("p_size"))), agg("d", X("discount"))])
_with_nulls("sum_of_products_nulls", ["mktsegment"], [agg("s", (X("discount"), X("p_size")), (X("quantity"), X("acctbal"))), count()])


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return register


def base(*columns: str, events: bool = False) -> str:
    """SQL of the star join with these columns."""
    return f"({join_sql(shape(events), columns, tables())})"


@query(f"SELECT returnflag, round(sum(exp(CAST(discount AS DOUBLE)) * CAST(quantity AS DOUBLE)), 2) AS s FROM {base('returnflag', 'discount', 'quantity')} GROUP BY returnflag")
def exponential(spark, sf_dir):
    df = AggregateBatch(star(spark, sf_dir)).add(Query(["returnflag"], [agg("s", (f.exponential("discount"), X("quantity")))])).execute()[0]
    return df.withColumn("s", F.round("s", 2))


FLAT = ["orderkey", "quantity", "totalprice", "mktsegment", "n_name", "p_brand"]
CONT, CAT = ["quantity", "p_size", "acctbal"], ["returnflag", "mktsegment", "orderstatus"]


@query(f"SELECT orderkey, CAST(quantity AS DOUBLE) AS quantity, CAST(totalprice AS DOUBLE) AS totalprice, mktsegment, n_name, p_brand FROM {base(*FLAT)}")
def join_flat(spark, sf_dir):
    df = star(spark, sf_dir).join(FLAT).select(*FLAT)
    return df.withColumns({c: F.col(c).cast("double") for c in ("quantity", "totalprice")})


def _covar_sql() -> str:
    out = [("1", "NULL", "1", "NULL", "count(*)", None)]
    out += [("1", "NULL", c, "NULL", f"sum({c})", None) for c in CONT]
    out += [(a, "NULL", b, "NULL", f"sum({a} * {b})", None) for i, a in enumerate(CONT) for b in CONT[i:]]
    for c in CAT:
        out += [(c, c, "1", "NULL", "count(*)", c)] + [(c, c, x, "NULL", f"sum({x})", c) for x in CONT]
    out += [(a, a, b, b, "count(*)", f"{a}, {b}") for i, a in enumerate(CAT) for b in CAT[i + 1 :]]
    parts = [
        f"SELECT '{a}' AS feature_i, CAST({v} AS VARCHAR) AS value_i, '{b}' AS feature_j, CAST({w} AS VARCHAR) AS value_j, CAST({x} AS DOUBLE) AS agg FROM j" + (f" GROUP BY {g}" if g else "")
        for a, v, b, w, x, g in out
    ]
    return f"WITH j AS {base(*CONT, *CAT)} " + " UNION ALL ".join(parts)


@query(_covar_sql())
def covar_batch(spark, sf_dir):
    return moments.covariance(star(spark, sf_dir), CONT, CAT)


@query(_covar_sql())
def covar_batch_views(spark, sf_dir):
    return moments.covariance(star(spark, sf_dir), CONT, CAT, "views")


@query(f"SELECT round(covar_pop(CAST(quantity AS DOUBLE), CAST(totalprice AS DOUBLE)), 2) AS covariance FROM {base('quantity', 'totalprice')}")
def covar_centered(spark, sf_dir):
    sums = [count(), agg("sx", X("quantity")), agg("sy", X("totalprice")), agg("sxy", (X("quantity"), X("totalprice")))]
    m = AggregateBatch(star(spark, sf_dir)).add(Query([], sums)).execute()[0]
    return m.select(F.round(F.col("sxy") / F.col("n") - F.col("sx") / F.col("n") * F.col("sy") / F.col("n"), 2).alias("covariance"))


_DIMS = ["returnflag", "mktsegment", "orderstatus"]
_SETS = "SELECT {d}, CAST(GROUPING({d}) AS BIGINT) AS gid, count(*) AS n, CAST(sum(quantity) AS DOUBLE) AS s_quantity FROM " + base(*_DIMS, "quantity") + " GROUP BY {g}"


@query(_SETS.format(d=", ".join(_DIMS), g=f"CUBE ({', '.join(_DIMS)})"))
def cube3(spark, sf_dir):
    return moments.cube(star(spark, sf_dir), _DIMS, ["quantity"])


@query(_SETS.format(d="returnflag, mktsegment", g="ROLLUP (returnflag, mktsegment)"))
def rollup2(spark, sf_dir):
    return moments.rollup(star(spark, sf_dir), ["returnflag", "mktsegment"], ["quantity"])


@query(_SETS.format(d=", ".join(_DIMS), g="GROUPING SETS ((returnflag), (mktsegment, orderstatus), ())"))
def grouping_sets(spark, sf_dir):
    return moments.grouping_sets(star(spark, sf_dir), [["returnflag"], ["mktsegment", "orderstatus"], []], ["quantity"])


_MI = ["returnflag", "linestatus", "orderstatus", "orderpriority"]
_MI_PAIRS = [(a, b) for i, a in enumerate(_MI) for b in _MI[i + 1 :]]


@query(
    f"WITH j AS {base(*_MI)} "
    + " UNION ALL ".join(
        [f"SELECT '{c}' AS feature_i, {c} AS value_i, CAST(NULL AS VARCHAR) AS feature_j, CAST(NULL AS VARCHAR) AS value_j, count(*) AS n FROM j GROUP BY {c}" for c in _MI]
        + [f"SELECT '{a}', {a}, '{b}', {b}, count(*) FROM j GROUP BY {a}, {b}" for a, b in _MI_PAIRS]
    )
)
def mi_counts(spark, sf_dir):
    return moments.pair_counts(star(spark, sf_dir), _MI)


@query(
    f"WITH j AS {base(*_MI)} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS feature_i, '{b}' AS feature_j, round(sum(n / t * ln(n * t / (na * nb))), 6) + 0.0 AS mi FROM (SELECT CAST(n AS DOUBLE) AS n, CAST(sum(n) OVER (PARTITION BY {a}) AS DOUBLE) AS na, "
        f"CAST(sum(n) OVER (PARTITION BY {b}) AS DOUBLE) AS nb, CAST(sum(n) OVER () AS DOUBLE) AS t FROM (SELECT {a}, {b}, count(*) AS n FROM j GROUP BY {a}, {b}))"
        for a, b in _MI_PAIRS
    )
)
def mi_pairwise(spark, sf_dir):
    return moments.mutual_information(star(spark, sf_dir), _MI)


_PERC = ["quantity", "extendedprice", "totalprice", "p_size"]


@query(
    f"WITH j AS {base(*_PERC)} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST(i AS INTEGER) AS i, min(x) AS cut FROM (SELECT CAST({c} AS DOUBLE) AS x, sum(count(*)) OVER (ORDER BY {c}) AS upto, sum(count(*)) OVER () AS total FROM j GROUP BY {c}), range(1, 20) r(i) WHERE upto * 20 >= i * total GROUP BY i"
        for c in _PERC
    )
)
def percentiles20(spark, sf_dir):
    return moments.percentiles(star(spark, sf_dir), _PERC)


_THETA = {"1": 2.0, "quantity": 0.5, "p_size": -0.25, "returnflag": {"A": 1.0, "N": -1.0, "R": 0.5}}
_SCORE = "(2.0 + 0.5 * CAST(quantity AS DOUBLE) - 0.25 * p_size + CASE returnflag WHEN 'A' THEN 1.0 WHEN 'N' THEN -1.0 WHEN 'R' THEN 0.5 ELSE 0.0 END)"


@query(
    f"WITH j AS (SELECT *, CAST({_SCORE} AS DOUBLE) AS g FROM {base('quantity', 'p_size', 'returnflag')}) "
    "SELECT '1' AS feature, CAST(NULL AS VARCHAR) AS value, round(sum(g), 2) AS gradient FROM j UNION ALL SELECT 'quantity', NULL, round(sum(quantity * g), 2) FROM j "
    "UNION ALL SELECT 'p_size', NULL, round(sum(p_size * g), 2) FROM j UNION ALL SELECT 'returnflag', returnflag, round(sum(g), 2) FROM j GROUP BY returnflag"
)
def reg_gradient(spark, sf_dir):
    out = moments.gradient_batch(star(spark, sf_dir), ["quantity", "p_size"], ["returnflag"], _THETA)
    return out.withColumn("gradient", F.round("gradient", 2))


_FIXED = regression.Model("extendedprice", ["quantity"], ["returnflag"], [("1", None), ("quantity", None), ("returnflag", "A"), ("returnflag", "N")], [100.0, 1500.0, 10.0, -10.0])


@query(f"SELECT round(sqrt(avg(pow(CAST(extendedprice AS DOUBLE) - (100.0 + 1500.0 * CAST(quantity AS DOUBLE) + CASE returnflag WHEN 'A' THEN 10.0 WHEN 'N' THEN -10.0 ELSE 0.0 END), 2))), 4) AS rmse FROM {base('extendedprice', 'quantity', 'returnflag')}")
def reg_predict_rmse(spark, sf_dir):
    df = star(spark, sf_dir).join(["extendedprice", "quantity", "returnflag"])
    error = F.col("extendedprice").cast("double") - F.col("prediction")
    return _FIXED.predict(df).agg(F.round(F.sqrt(F.avg(error * error)), 4).alias("rmse"))


_D2 = ["p_size", "quantity"]


def _d2() -> Query:
    q = moments.degree_two_batch(shape(), _D2)
    return Query([], [Aggregate(a.products, a.name, "long" if a.name == "n" else "double") for a in q.aggregates])


def _d2_sql() -> str:
    inner = base(*_D2).replace("CAST(l_quantity AS DECIMAL(12,2))", "CAST(l_quantity AS BIGINT)")
    sums = ", ".join(f"CAST(sum({' * '.join(p.to_sql() for p in a.products[0]) or '1'}) AS {'BIGINT' if a.type == 'long' else 'DOUBLE'}) AS {a.name}" for a in _d2().aggregates)
    return f"SELECT {sums} FROM {inner}"


@query(_d2_sql())
def degree2_moments(spark, sf_dir):
    tree = star(spark, sf_dir)
    tree = tree.replace("lineitem_r", tree.frame("lineitem_r").withColumn("quantity", F.col("quantity").cast("long")))
    return AggregateBatch(tree).add(_d2()).execute()[0]


@query()
def linreg_fit(spark, sf_dir):
    model = regression.fit(star(spark, sf_dir), "extendedprice", ["quantity", "p_size", "retailprice"], ["returnflag", "mktsegment"])
    rows = [(n, v, float(t)) for (n, v), t in zip(model.names, model.theta)] if model else []
    return spark.createDataFrame(rows, "feature string, value string, theta double")


@query(
    f"WITH m AS (SELECT count(*) AS n, avg(CAST(quantity AS DOUBLE)) AS x, avg(CAST(extendedprice AS DOUBLE)) AS y, avg(CAST(quantity * quantity AS DOUBLE)) AS xx, avg(CAST(quantity * extendedprice AS DOUBLE)) AS xy FROM {base('quantity', 'extendedprice')}), "
    "t AS (SELECT *, (xy - x * y) / (xx - x * x + 0.1) AS b FROM m) SELECT round(y - b * x, 4) AS intercept, round(b, 4) AS slope FROM t"
)
def linreg_one(spark, sf_dir):
    """One attribute, where the ridge solution has a closed form."""
    model = regression.fit(star(spark, sf_dir), "extendedprice", ["quantity"])
    return spark.createDataFrame([tuple(float(t) for t in model.theta)], "a double, b double").select(F.round("a", 4).alias("intercept"), F.round("b", 4).alias("slope"))


_TH = {"quantity": [10.0, 20.0, 30.0, 40.0], "p_size": [10, 25, 40]}
_RT_CAT = ["returnflag", "mktsegment"]


def _rtree_sql(where: str = "") -> str:
    names, parts = [*_TH, *_RT_CAT], []
    for i, c in enumerate(names):
        tests = [(str(t), f"{c} <= {t}") for t in _TH[c]] if c in _TH else [(None, None)]
        for split, test in tests:
            if test:
                src = f"SELECT '{split}' AS split, {test} AS l, y FROM j"
                body = f"SELECT split, count(*) FILTER (l) AS ln, sum(y) FILTER (l) AS ls, sum(y * y) FILTER (l) AS lq, count(*) AS tn, sum(y) AS ts, sum(y * y) AS tq FROM ({src}) GROUP BY split"
            else:
                body = f"SELECT {c} AS split, count(*) AS ln, sum(y) AS ls, sum(y * y) AS lq, sum(count(*)) OVER () AS tn, sum(sum(y)) OVER () AS ts, sum(sum(y * y)) OVER () AS tq FROM j GROUP BY {c}"
            parts.append(f"SELECT {i} AS ord, '{c}' AS feature, {str(test is None).lower()} AS categorical, * FROM ({body})")
    return (
        f"WITH j AS (SELECT *, CAST(totalprice AS DOUBLE) AS y FROM {base('totalprice', *names)}{where}), h AS ({' UNION ALL '.join(parts)}), c AS ("
        "SELECT CAST(ord AS INTEGER) AS ord, feature, categorical, split, ln AS n_left, CAST(tn - ln AS BIGINT) AS n_right, "
        "CASE WHEN ln > 0 AND tn > ln THEN lq - ls * ls / ln + (tq - lq) - (ts - ls) * (ts - ls) / (tn - ln) END AS cost0, ls / ln AS pl0, CASE WHEN tn > ln THEN (ts - ls) / (tn - ln) END AS pr0 FROM h) "
        "SELECT ord, feature, categorical, split, n_left, n_right, round(cost0 / 1e6, 2) AS cost, round(pl0, 4) AS pred_left, round(pr0, 4) AS pred_right FROM c"
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({"cost": F.round(F.col("cost") / 1e6, 2), "pred_left": F.round("pred_left", 4), "pred_right": F.round("pred_right", 4)})


@query(_rtree_sql())
def rtree_candidates(spark, sf_dir):
    return _rounded(trees.candidates(star(spark, sf_dir), "totalprice", _TH, _RT_CAT))


@query(_rtree_sql() + " WHERE cost0 IS NOT NULL ORDER BY cost0, ord, split LIMIT 1")
def rtree_best_split(spark, sf_dir):
    return _rounded(trees.best_split(star(spark, sf_dir), "totalprice", _TH, _RT_CAT))


_PATH = [trees.Condition("quantity", "<=", 30.0), trees.Condition("mktsegment", "!=", "BUILDING")]


@query(_rtree_sql(" WHERE quantity <= 30 AND mktsegment <> 'BUILDING'"))
def rtree_path_split(spark, sf_dir):
    return _rounded(trees.candidates(star(spark, sf_dir), "totalprice", _TH, _RT_CAT, _PATH))


_CT_CAT = ["linestatus", "mktsegment"]


def _ctree_sql() -> str:
    names, parts = [*_TH, *_CT_CAT], []
    for i, c in enumerate(names):
        for split, test in ([(f"'{t}'", f"{c} <= {t}") for t in _TH[c]] if c in _TH else [(c, None)]):
            if test:
                body = f"SELECT {split} AS split, y, count(*) FILTER ({test}) AS l, count(*) AS t FROM j GROUP BY y"
            else:
                body = f"SELECT v.split AS split, a.y AS y, coalesce(b.l, 0) AS l, a.t AS t FROM (SELECT DISTINCT {c} AS split FROM j) v CROSS JOIN (SELECT y, count(*) AS t FROM j GROUP BY y) a LEFT JOIN (SELECT {c} AS split, y, count(*) AS l FROM j GROUP BY ALL) b ON v.split = b.split AND a.y = b.y"
            parts.append(f"SELECT {i} AS ord, '{c}' AS feature, {str(test is None).lower()} AS categorical, * FROM ({body})")
    return (
        f"WITH j AS (SELECT *, returnflag AS y FROM {base('returnflag', *names)}), s AS ({' UNION ALL '.join(parts)}), c AS ("
        "SELECT CAST(ord AS INTEGER) AS ord, feature, categorical, split, CAST(sum(l) AS BIGINT) AS n_left, CAST(sum(t - l) AS BIGINT) AS n_right, CAST(sum(l * l) AS DOUBLE) AS ql, CAST(sum((t - l) * (t - l)) AS DOUBLE) AS qr, "
        "arg_min(y, (-l, y)) AS pred_left, arg_min(y, (l - t, y)) AS pred_right FROM s GROUP BY ALL) "
        "SELECT ord, feature, categorical, split, n_left, n_right, round(CASE WHEN n_left > 0 AND n_right > 0 THEN (1 - ql / n_left / n_left) * n_left / (n_left + n_right) + (1 - qr / n_right / n_right) * n_right / (n_left + n_right) END, 6) AS cost, pred_left, pred_right FROM c"
    )


@query(_ctree_sql())
def ctree_candidates(spark, sf_dir):
    return trees.candidates(star(spark, sf_dir), "returnflag", _TH, _CT_CAT, classify=True).withColumn("cost", F.round("cost", 6))


@query(_ctree_sql() + " WHERE n_left > 0 AND n_right > 0 ORDER BY cost, ord, split LIMIT 1")
def ctree_best_split(spark, sf_dir):
    return trees.best_split(star(spark, sf_dir), "returnflag", _TH, _CT_CAT, classify=True).withColumn("cost", F.round("cost", 6))


def _grown_sql(depth: int = 3) -> str:
    """Rows find their leaf level by level: the cheapest split of each node, ties to the first feature, then the smaller split."""
    names = [*_TH, *_RT_CAT]
    parts = [f"SELECT 1 AS node, CAST(totalprice AS DOUBLE) AS y, {', '.join(names)} FROM {base('totalprice', *names)}"]
    out = f"WITH j0 AS ({parts[0]})"
    for d in range(depth):
        candidates = []
        for i, c in enumerate(names):
            if c in _TH:
                body = f"SELECT node, t AS place, CAST(t AS VARCHAR) AS split, count(*) FILTER ({c} <= t) AS n, sum(y) FILTER ({c} <= t) AS s, sum(y * y) FILTER ({c} <= t) AS q FROM j{d}, (SELECT unnest({[float(t) for t in _TH[c]]}) AS t) GROUP BY node, t"
            else:
                body = f"SELECT node, 0.0 AS place, {c} AS split, count(*) AS n, sum(y) AS s, sum(y * y) AS q FROM j{d} GROUP BY node, {c}"
            candidates.append(f"SELECT {i} AS ord, * FROM ({body})")
        out += (
            f", c{d} AS ({' UNION ALL '.join(candidates)}), t{d} AS (SELECT node, count(*) AS tn, sum(y) AS ts, sum(y * y) AS tq FROM j{d} GROUP BY node)"
            f", b{d} AS (SELECT node, arg_min({{'ord': ord, 'place': place, 'split': split}}, (round(q - s * s / n + (tq - q) - (ts - s) * (ts - s) / (tn - n), 9), ord, place, split)) AS b FROM c{d} JOIN t{d} USING (node) WHERE n > 0 AND tn > n GROUP BY node)"
            f", j{d + 1} AS (SELECT CASE WHEN b IS NULL THEN node WHEN CASE b.ord {' '.join(f'WHEN {i} THEN {c} <= b.place' if c in _TH else f'WHEN {i} THEN {c} = b.split' for i, c in enumerate(names))} END THEN 2 * node ELSE 2 * node + 1 END AS node, y, {', '.join(names)} FROM j{d} LEFT JOIN b{d} USING (node))"
        )
    return f"{out} SELECT round(avg(y), 4) AS prediction, count(*) AS n, round(avg(y), 4) AS mean FROM j{depth} GROUP BY node"


@query(_grown_sql())
def tree_fit_predict(spark, sf_dir):
    """Rows of one cell have one prediction, so the predictions are counted over cells: the join runs once."""
    tree = star(spark, sf_dir)
    made = trees.cells(tree, "totalprice", _TH, _RT_CAT)
    model = trees.grow(tree, "totalprice", _TH, _RT_CAT, depth=3, made=made)
    leaf, told = (trees.leaf(model), trees.prediction(model)) if model else (F.lit(1), F.lit(None).cast("double"))
    found = made.groupBy(leaf.alias("leaf"), told.alias("prediction")).agg(F.sum("__rows").alias("n"), F.try_divide(F.sum("__s"), F.sum("__n")).alias("mean"))
    return found.select(F.round("prediction", 4).alias("prediction"), "n", F.round("mean", 4).alias("mean"))


def _intervals_sql(k: int = 5) -> str:
    """Dynamic programming over all intervals of the distinct values: the least error of c intervals up to each value."""
    out = []
    for c in ("quantity", "p_size"):
        levels = "l1 AS (SELECT j, v AS cost, [i] AS firsts FROM s WHERE i = 1)"
        for n in range(2, k + 1):
            levels += f", l{n} AS (SELECT s.j AS j, min(cost + v) AS cost, arg_min(list_append(firsts, s.i), cost + v) AS firsts FROM l{n - 1} l JOIN s ON s.i = l.j + 1 GROUP BY s.j)"
        out.append(
            f"SELECT * FROM (WITH h AS (SELECT x, count(*) AS n, row_number() OVER (ORDER BY x) AS r FROM (SELECT CAST({c} AS DOUBLE) AS x FROM {base(c)}) GROUP BY x), "
            "s AS (SELECT a.r AS i, b.r AS j, sum(z.n * z.x * z.x) - sum(z.n * z.x) * sum(z.n * z.x) / sum(z.n) AS v FROM h a JOIN h b ON a.r <= b.r JOIN h z ON z.r BETWEEN a.r AND b.r GROUP BY a.r, b.r), "
            f"{levels}, best AS (SELECT firsts FROM l{k} WHERE j = (SELECT max(r) FROM h)), f AS (SELECT unnest(firsts) AS r, unnest(range(0, {k})) AS cluster FROM best), "
            "ends AS (SELECT cluster, r, coalesce(lead(r) OVER (ORDER BY r) - 1, (SELECT max(r) FROM h)) AS last FROM f) "
            f"SELECT '{c}' AS feature, CAST(cluster AS INTEGER) AS cluster, min(x) AS first, round(sum(x * n) / sum(n), 6) AS mean FROM ends JOIN h ON h.r BETWEEN ends.r AND ends.last GROUP BY cluster)"
        )
    return " UNION ALL ".join(out)


@query(_intervals_sql())
def kmeans_1d(spark, sf_dir):
    tree = star(spark, sf_dir)
    rows = [(c, i, a, m) for c in ("quantity", "p_size") for k in [kmeans.cluster_continuous(tree, c, 5)] for i, (a, m) in enumerate(zip(k.firsts, k.means))]
    return spark.createDataFrame(rows, "feature string, cluster int, first double, mean double").withColumn("mean", F.round("mean", 6))


@query(
    f"SELECT orderpriority AS value, CAST(CASE WHEN rank <= 2 THEN rank - 1 ELSE 2 END AS INTEGER) AS cluster, n FROM (SELECT orderpriority, count(*) AS n, row_number() OVER (ORDER BY count(*), orderpriority) AS rank FROM {base('orderpriority')} GROUP BY orderpriority)"
)
def kmeans_cat_clusters(spark, sf_dir):
    return kmeans.category_clusters(star(spark, sf_dir), "orderpriority", 3)


_GRID = [kmeans.Continuous("quantity", [1.0, 20.0, 40.0], [10.0, 30.0, 45.0]), kmeans.Continuous("p_size", [1.0, 25.0], [12.0, 37.0]), kmeans.Categorical("returnflag", ["A"])]


@query(
    "SELECT CAST(CASE WHEN quantity < 20 THEN 0 WHEN quantity < 40 THEN 1 ELSE 2 END AS INTEGER) AS cluster_quantity, CAST(CASE WHEN p_size < 25 THEN 0 ELSE 1 END AS INTEGER) AS cluster_p_size, "
    f"CAST(CASE WHEN returnflag = 'A' THEN 0 ELSE 1 END AS INTEGER) AS cluster_returnflag, count(*) AS weight FROM {base('quantity', 'p_size', 'returnflag')} GROUP BY ALL"
)
def kmeans_grid(spark, sf_dir):
    return kmeans.grid(star(spark, sf_dir), _GRID)


_CENTERS = [{"quantity": 10.0, "p_size": 12.0}, {"quantity": 30.0, "p_size": 37.0}, {"quantity": 45.0, "p_size": 20.0}]


def _assign_sql() -> str:
    d = [f"pow(CAST(quantity AS DOUBLE) - {c['quantity']}, 2) + pow(p_size - {c['p_size']}, 2)" for c in _CENTERS]
    return f"SELECT CAST(list_position(d, list_min(d)) - 1 AS BIGINT) AS cluster, count(*) AS n, CAST(sum(list_min(d)) AS DOUBLE) AS cost FROM (SELECT [{', '.join(d)}] AS d FROM {base('quantity', 'p_size')}) GROUP BY 1"


@query(_assign_sql())
def kmeans_assign(spark, sf_dir):
    model = kmeans.Clustering(_GRID[:2], _CENTERS)
    return model.assign(star(spark, sf_dir).join(["quantity", "p_size"])).groupBy(F.col("cluster").cast("long").alias("cluster")).agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost"))


@query()
def kmeans_fit(spark, sf_dir):
    model = kmeans.fit(star(spark, sf_dir), ["quantity", "p_size"], ["returnflag"], k=4)
    return spark.createDataFrame([(i, c["quantity"], c["p_size"]) for i, c in enumerate(model.centroids)], "cluster int, quantity double, p_size double")


@query(
    # by hand: 1 + 3 + 3 queries; 10 scalars, 4 for each of 3 attributes, 3 pairs; a view for each of 7 group-bys and
    # for orders, customer and part (nation, region and supplier are left out); one pass
    "SELECT * FROM (VALUES ('queries', 7), ('aggregates', 25), ('views', 10), ('groups', 4), ('passes', 1)) t(name, value)"
)
def batch_stats(spark, sf_dir):
    stats = moments.covar_batch(star(spark, sf_dir), CONT, CAT).stats()
    rows = [(k, stats[k]) for k in ("queries", "aggregates", "views", "groups", "passes")]
    return spark.createDataFrame(rows, "name string, value int")


@query(
    f"SELECT round(sqrt(avg(pow(y - p, 2))), 3) AS rmse FROM (SELECT CAST(extendedprice AS DOUBLE) AS y, regr_intercept(CAST(extendedprice AS DOUBLE), CAST(quantity AS DOUBLE)) OVER () + "
    f"regr_slope(CAST(extendedprice AS DOUBLE), CAST(quantity AS DOUBLE)) OVER () * CAST(quantity AS DOUBLE) AS p FROM {base('extendedprice', 'quantity')})"
)
def linreg_rmse(spark, sf_dir):
    """One attribute without penalty, predicted back over the join: SQL's own regression."""
    tree = star(spark, sf_dir)
    model = regression.fit(tree, "extendedprice", ["quantity"], ridge=0.0)
    return spark.createDataFrame([(model.rmse(tree.join(["extendedprice", "quantity"])),)], "rmse double").select(F.round("rmse", 3).alias("rmse"))


@query(
    f"WITH j AS {base('returnflag', 'quantity')} SELECT returnflag, count(*) AS n, CAST(sum(quantity) AS DOUBLE) AS s FROM j GROUP BY returnflag"
)
def incremental_merge(spark, sf_dir):
    """Partial aggregates of two halves of the fact table, added up."""
    from .streaming import merge

    tree, q = star(spark, sf_dir), Query(["returnflag"], [count(), agg("s", X("quantity"))])
    parts = [tree.replace("lineitem_r", tree.frame("lineitem_r").filter(f"orderkey % 2 = {i}")) for i in (0, 1)]
    return merge([AggregateBatch(t).add(q).execute()[0] for t in parts], q)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["group_one"](spark, sf_dir)
