"""The aggregate engine: golden values of a small example, plans against each other and brute force."""

import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from sumweave import functions as f
from sumweave import sources, streaming
from sumweave.__main__ import main, run
from sumweave.operators import kmeans, moments, regression, trees
from sumweave.plans.batch import AggregateBatch, Query, agg, count
from sumweave.plans.schema import JoinTree, Relation
from sumweave.queries import QUERIES, SQL

TD = """# attributes
6 4 3
0 A int
1 B int
2 C int

3 D int
4 E int
5 F other
# relations
0 R:C,B,A
1 S:A,B,D
2 T:A,E
3 U:E,F
R-S
R-T 
T-U
R 0
S 0
T 1
U 0
"""
FEATURES = "6, 0, 0\nB:0:R\nA:0:R\nC:0:R\nD:0:S\nE:0:T\nF:0:U\nA*C\n"
ROWS = {"R": "1|1|1\n1|2|2\n2|1|2\n2|2|1", "S": "1|1|1\n1|1|2\n1|2|1\n2|1|1", "T": "1|2\n2|1\n2|2", "U": "1|1\n2|1\n2|2"}


@pytest.fixture(scope="module")
def example(tmp_path_factory, spark):
    d = tmp_path_factory.mktemp("example")
    (d / "treedecomposition.conf").write_text(TD)
    (d / "features.conf").write_text(FEATURES)
    for name, rows in ROWS.items():
        (d / f"{name}.tbl").write_text(rows)
    return str(d), sources.load(spark, str(d), sources.read_tree(f"{d}/treedecomposition.conf"))


def test_golden_values(example):
    path, tree = example
    assert tree.columns() == ["A", "B", "C", "D", "E", "F"]
    rows = sorted("".join(map(str, r)) for r in tree.join(list("ABCDEF")).collect())
    assert rows == "111121 111122 111221 111222 122121 122122 212111 212121 212122".split()
    for strategy in ("flat", "views", "auto"):
        assert moments.count_join(tree, strategy).first().n == 9
        cells = {(r.feature_i, r.feature_j): r["agg"] for r in moments.covariance(tree, list("ABCDEF"), [], strategy).collect()}
        assert [cells["1", c] for c in "ABCDEF"] == [12, 11, 14, 11, 17, 13]
        assert [cells[a, b] for a, b in itertools.combinations_with_replacement("ABCDEF", 2)] == [18, 14, 20, 14, 22, 17, 15, 18, 13, 21, 16, 24, 16, 26, 20, 15, 21, 16, 33, 25, 21]
        q = AggregateBatch(tree).add(Query(["A", "C"], [count(), agg("s", f.x("B"))])).execute(strategy)[0]
        assert sorted(map(tuple, q.collect())) == [(1, 1, 4, 4.0), (1, 2, 2, 4.0), (2, 2, 3, 3.0)]
    assert moments.cube(tree, ["A", "C", "D"], ["B"]).count() == 20


def test_golden_regression(example):
    _, tree = example
    want = [1.069972, -0.439688, 0.447268, -0.105932, 0.081505, 0.012647]
    for solver in ("bgd", "normal"):
        m = regression.fit(tree, "B", list("ACDEF"), solver=solver, tolerance=1e-9, max_iterations=20_000)
        assert np.allclose(m.theta, want, atol=2e-5), solver
    assert abs(m.rmse(tree.join(list("ABCDEF"))) - 0.218073) < 1e-4
    wide = regression.fit(tree, "B", ["A", "D"], ["C"])
    df = tree.join(list("ABCD")).toPandas()
    x = np.column_stack([np.ones(9), df.A, df.D, df.C == 1, df.C == 2]).astype(float)
    assert np.allclose(wide.theta, np.linalg.solve(x.T @ x / 9 + np.diag([0, 0.1, 0.1, 0.1, 0.1]), x.T @ df.B / 9))
    with pytest.raises(ValueError):
        regression.fit(tree, "B", ["A", "D"], ["C"], max_parameters=4)
    two = regression.fit_degree_two(tree, "B", ["A", "D"])
    x = np.column_stack([np.ones(9), df.A, df.D, df.A * df.A, df.A * df.D, df.D * df.D]).astype(float)
    assert [n for n, _ in two.names] == ["1", "A", "D", "A*A", "A*D", "D*D"]
    assert np.allclose(two.theta, np.linalg.lstsq(x.T @ x / 9 + np.diag([0] + [0.1] * 5), x.T @ df.B / 9, rcond=None)[0])
    assert two.rmse(tree.join(list("ABCD"))) == pytest.approx(float(np.sqrt(np.mean((df.B - x @ two.theta) ** 2))))
    assert wide.rmse(tree.join(list("ABCD"))) == pytest.approx(float(np.sqrt(np.mean((df.B - np.column_stack([np.ones(9), df.A, df.D, df.C == 1, df.C == 2]) @ wide.theta) ** 2))))
    empty = tree.replace("U", tree.frame("U").limit(0))
    assert regression.fit(empty, "B", ["A"]) is None and trees.grow(empty, "B", {"A": [1]}, []) is None and kmeans.fit(empty, ["A"], []) is None
    assert moments.count_join(empty).first().n in (None, 0)


def test_golden_splits_and_information(example):
    _, tree = example
    got = {(r.feature, r.split): r for r in trees.candidates(tree, "B", {c: [1, 2] for c in "ACDEF"}, []).collect()}
    want = {"A": (6, 3, 1.333333), "C": (4, 5, 1.2), "D": (7, 2, 1.428571), "E": (1, 8, 1.5), "F": (5, 4, 1.55)}
    for c, (left, right, cost) in want.items():
        r = got[c, "1"]
        assert (r.n_left, r.n_right, round(r.cost, 6)) == (left, right, cost)
        assert got[c, "2"].cost is None and got[c, "2"].n_right == 0
    best = trees.best_split(tree, "B", {c: [1, 2] for c in "ACDEF"}, []).first()
    assert (best.feature, best.split) == ("C", "1")
    mi = {r.feature_i + r.feature_j: r.mi for r in moments.mutual_information(tree, list("ACDEF")).collect()}
    assert mi == pytest.approx(dict(AC=0.262619, AD=0.105363, AE=0.136661, AF=0.012692, CD=0.221641, CE=0.070831, CF=0.005001, DE=0.029853, DF=0.001778, EF=0.070831), abs=2e-6)


def test_conf_errors(tmp_path, example):
    _, tree = example
    bad = {"0 A int": "1 A int", "0 R:C,B,A": "0 R:C,B,Z", "R-S": "R-X", "T-U": "R-S", "U 0": "V 0", "3 U:E,F": "3 U:E,F,D"}
    for old, new in bad.items():
        p = tmp_path / "td.conf"
        p.write_text(TD.replace(old, new, 1))
        with pytest.raises(ValueError):
            sources.read_tree(str(p))
    for text, label in (("1, 0\nZ:0:R\n", None), ("1, 0\nA:0:Z\n", None), ("2, 0\nA:0:R\n", None), ("1, 0\nA:1:R\n", "continuous"), ("1, 0\nA:0:R\n", "categorical")):
        p = tmp_path / "f.conf"
        p.write_text(text)
        with pytest.raises(ValueError):
            sources.read_features(str(p), tree, label)
    with pytest.raises(ValueError):
        AggregateBatch(tree).add(Query(["nope"], [count()]))


def random_tree(spark, rng, nulls):
    """A random tree of up to four relations with random small tables; repeated rows, dangling keys and nulls in any column included."""
    n, attribute = rng.randint(1, 4), 0
    columns, edges = {}, []
    for i in range(n):
        own = []
        if i:
            parent = rng.choice(list(columns))
            own = rng.sample(columns[parent], rng.randint(1, min(2, len(columns[parent]))))
            edges.append((parent, f"r{i}"))
        for _ in range(rng.randint(1, 2)):
            own.append(f"x{attribute}")
            attribute += 1
        columns[f"r{i}"] = own
    relations = {}
    for name, own in columns.items():
        rows = [tuple(rng.choice([0, 1, 2, 2, None]) if nulls else rng.randint(0, 2) for _ in own) for _ in range(rng.randint(3, 9))]
        relations[name] = Relation(name, own, spark.createDataFrame(rows, ", ".join(f"{c} long" for c in own)))
    return JoinTree(relations, edges)


@pytest.mark.parametrize("seed", range(12))
def test_plans_agree(spark, seed, tmp_path):
    rng = random.Random(seed)
    tree = random_tree(spark, rng, seed % 2)
    names = tree.columns()
    batch = AggregateBatch(tree)
    for _ in range(2):
        def factor():
            a, b = rng.choice(names), rng.choice(names)
            return rng.choice([f.x(a), f.power(a, 2), f.le(a, 1), f.neq(a, 0), f.custom("far", [a, b], lambda p, q: p + 2 * q, "{0} + 2 * {1}")])

        sums = [agg(f"a{i}", *[tuple(factor() for _ in range(rng.randint(0, 3))) for _ in range(rng.randint(1, 3))]) for i in range(3)]
        batch.add(Query(rng.sample(names, rng.randint(0, min(2, len(names)))), [count(), *sums], rng.choice([None, *tree.relations])))
    con = duckdb.connect()
    for name in tree.relations:
        own = tree.frame(name).toArrow()  # noqa: F841
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM own")
    by_sql = [con.execute(s).fetchall() for s in batch.to_sql("flat")]
    rows = lambda r: sorted([tuple(None if v is None else float(v) for v in x) for x in r], key=str)
    for s in batch.to_sql("views"):
        con.execute(s)
    by_views = [con.execute(f"SELECT {', '.join([*q.group_by, *names])} FROM view_{v}").fetchall() for q, (v, names) in zip(batch.queries, batch.plan().results)]
    written = batch.execute("views", folder=str(tmp_path / "out"))
    for q, flat, views, once, by_view, want in zip(batch.queries, batch.execute("flat"), batch.execute("views"), written, by_views, by_sql):
        flat, views, once = (rows(map(tuple, x.collect())) for x in (flat, views, once))
        if q.group_by or want[0][0]:
            assert flat == views == once == rows(want) == rows(by_view)
    stats = batch.stats()
    assert stats["queries"] == 2 and stats["views"] >= len(tree.relations)


def test_views_share_and_push_down(spark):
    from sumweave.plans.testdata import UNIQUE, star

    tree = star(spark, "/root/testdata/sf0.001", events=True)
    batch = AggregateBatch(tree).add(Query([], [count()])).add(Query([], [count("m"), agg("s", f.x("value"))]))
    assert batch.stats()["shared"] > 0 and batch.strategy(UNIQUE) == "views" and AggregateBatch(star(spark, "/root/testdata/sf0.001")).strategy(UNIQUE) == "flat"
    plan = AggregateBatch(tree).add(Query(["mktsegment"], [agg("s", (f.x("quantity"), f.x("value")))])).execute("views")[0]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in text and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in text and "p_size" not in text
    filtered = trees.under(tree, [trees.Condition("p_size", "<=", 5)]).join(["p_size"])
    assert "PushedFilters" in filtered._jdf.queryExecution().executedPlan().toString()


def test_dynamic_programming_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n, k = int(rng.integers(3, 10)), int(rng.integers(1, 5))
        v, w = np.sort(rng.choice(50, n, replace=False)).astype(float), rng.integers(1, 9, n).astype(float)

        def cost(starts):
            return sum((w[a:b] * (v[a:b] - np.average(v[a:b], weights=w[a:b])) ** 2).sum() for a, b in zip(starts, [*starts[1:], n]))

        best = min(cost([0, *c]) for c in itertools.combinations(range(1, n), min(k, n) - 1))
        assert cost(kmeans.optimal_1d(v, w, k)) == pytest.approx(best)


def test_kmeans_on_grid(spark):
    rows = [(i % 3 * 10.0 + (i % 2) * 0.5, "abcd"[i % 4], i) for i in range(60)] + [(None, "a", 99)]
    tree = JoinTree({"r": Relation("r", ["x", "c", "i"], spark.createDataFrame(rows[:-1], "x double, c string, i long"))}, [])
    m = kmeans.fit(tree, ["x"], ["c"], k=3, kappa=3, seed=1)
    spread = kmeans.fit(tree, ["x"], ["c"], k=3, kappa=3, seed=1, driver_cells=0)
    for a, b in zip(m.centroids, spread.centroids):
        assert a["x"] == pytest.approx(b["x"]) and a["c"] == pytest.approx(b["c"])
    assert len(m.centroids) == 3 and all(abs(sum(c["c"].values()) - 1) < 1e-9 for c in m.centroids)
    df = tree.join(["x", "c"])
    assert m.evaluate(df) == pytest.approx(sum(r.cost for r in m.assign(df).collect()))
    assert kmeans.grid(tree, m.clusters).agg(F.sum("weight")).first()[0] == 60
    # by hand: one-hot values against shares, the rest's by their weights
    own, weights = m.clusters[1].own, {r.value: r.p for r in m.clusters[1].rest.collect()}
    for r in m.assign(df).collect():
        costs = []
        for c in m.centroids:
            full = {v: c["c"][v] for v in own} | {v: c["c"][kmeans.REST] * p for v, p in weights.items()}
            costs.append((r.x - c["x"]) ** 2 + sum(((v == r.c) - p) ** 2 for v, p in full.items()))
        assert r.cost == pytest.approx(min(costs)) and costs[r.cluster] == pytest.approx(min(costs))


def test_intervals_over_many_values_are_exact(spark):
    rng = np.random.default_rng(4)
    x = np.unique(np.round(rng.gamma(2.0, 5000.0, 30_000), 2))
    w = rng.integers(1, 4, len(x)).astype(float)

    def cost(starts):
        return sum((w[a:b] * (x[a:b] - np.average(x[a:b], weights=w[a:b])) ** 2).sum() for a, b in zip(starts, [*starts[1:], len(x)]))

    # the plain recurrence, row by row
    k, s = 3, [np.concatenate([[0.0], np.cumsum(w * (x - x.mean()) ** p)]) for p in range(3)]
    sse = lambda i, j: s[2][j + 1] - s[2][i] - (s[1][j + 1] - s[1][i]) ** 2 / (s[0][j + 1] - s[0][i])
    row = sse(np.zeros(len(x), int), np.arange(len(x)))
    for c in range(1, k):
        row = np.array([(row[c - 1 : j] + sse(np.arange(c, j + 1), j)).min() if j >= c else np.inf for j in range(len(x))])
    got = kmeans.optimal_1d(x, w, k)
    assert cost(got) == pytest.approx(row[-1])
    rows = [(float(a), int(n)) for a, n in zip(x, w) for _ in range(1)]
    tree = JoinTree({"r": Relation("r", ["v", "n"], spark.createDataFrame(rows, "v double, n int").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n")))))}, [])
    exact, binned = kmeans.cluster_continuous(tree, "v", k), kmeans.cluster_continuous(tree, "v", k, bins=500)
    assert exact.firsts == x[got].tolist()
    at = lambda c: np.searchsorted(x, c.firsts).tolist()
    assert cost(got) <= cost(at(binned)) < 1.001 * cost(got)
    with pytest.raises(ValueError):
        kmeans.cluster_continuous(tree, "v", k, driver_values=10)


def test_one_scan_of_the_fact_table(spark):
    """Also of every other relation: whatever a batch asks for, it reads each once."""
    from sumweave.plans.testdata import star

    tree = star(spark, "/root/testdata/sf0.001")
    cont, cat = ["quantity", "p_size", "acctbal"], ["returnflag", "mktsegment", "orderstatus"]
    th = {"quantity": [10.0, 20.0], "p_size": [10]}
    frames = [moments.covariance(tree, cont, cat, s) for s in ("flat", "views")]
    frames += [moments.pair_counts(tree, cat), moments.mutual_information(tree, cat), moments.histograms(tree, cont)]
    frames += [trees.candidates(tree, "totalprice", th, cat), trees.candidates(tree, "returnflag", th, cat[1:], classify=True)]
    for df in frames:
        df.collect()
        text = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        scans = re.findall(r"FileScan parquet \[(\w)_", text)
        assert scans and max(scans.count(c) for c in scans) == 1 and "NestedLoop" not in text and "CartesianProduct" not in text


def test_declared_keys_leave_relations_out(spark):
    from sumweave.plans.testdata import star

    tree = star(spark, "/root/testdata/sf0.001")
    text = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text(tree.join(["quantity"])) and text(tree.join(["n_name"])).count("Join ") == 3
    few = tree.replace("nation_r", tree.frame("nation_r").filter("nationkey < 5"))
    n = moments.count_join(few, "flat").first().n
    assert 0 < n == moments.count_join(few, "views").first().n < moments.count_join(tree).first().n
    assert n == few.join(["quantity", "n_name"]).count()


@pytest.mark.parametrize("seed", range(3))
def test_nested_joins_have_the_same_rows(spark, seed):
    tree = random_tree(spark, random.Random(seed), True)
    tree.unique = frozenset(list(tree.relations)[seed % 2 :]) - {tree.root}
    rows = lambda nested: sorted(map(str, tree.join(tree.columns(), nested).collect()))
    assert rows(True) == rows(False)


def test_cells_move_the_fact_table_by_keys_of_its_own(spark):
    """Orders meet customers before lines meet orders, so no line is shuffled by a customer's key."""
    from sumweave.plans.testdata import star

    columns = ["quantity", "totalprice", "mktsegment", "p_size"]
    with_both = lambda nested: [x for x in str(star(spark, "/root/testdata/sf0.001").join(columns, nested)._jdf.queryExecution().optimizedPlan()).split("\n") if "custkey" in x and "quantity" in x]
    assert with_both(False) and not with_both(True)


def test_grow_fits_a_step(spark):
    rows = [(float(x), "ab"[x % 2], 10.0 * (x > 5) + (x % 2)) for x in range(12)]
    tree = JoinTree({"r": Relation("r", ["x", "c", "y"], spark.createDataFrame(rows, "x double, c string, y double"))}, [])
    top = trees.grow(tree, "y", {"x": [2.0, 5.0, 8.0]}, ["c"], depth=2)
    assert top.condition == trees.Condition("x", "<=", 5.0) and trees.evaluate(top, tree.join(["x", "c", "y"]), "y") == pytest.approx(0)
    top = trees.grow(tree, "c", {"x": [2.0]}, ["y"], depth=1, classify=True)
    assert top.n == 12 and trees.evaluate(top, tree.join(["x", "c", "y"]), "c", True) < 0.5


@pytest.mark.parametrize("classify", [False, True])
def test_grow_reads_the_join_once(spark, classify):
    """Whatever the depth: its levels and the predictions come from cells, as those of single rows do."""
    from sumweave.plans import scratch

    rng = random.Random(7)
    rows = [(rng.choice([None, float("nan"), *range(12)]), rng.choice([None, 1, 5, 9]), rng.choice(["a", "b", "c", None]), rng.choice([None, 1.0, 2.0, 5.0, 5.0])) for _ in range(400)]
    rows = [(x if x is None else float(x), *r) for x, *r in rows]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    df = spark.createDataFrame(rows, "x double, k long, c string, y double")
    tree = JoinTree({"r": Relation("r", ["x", "k", "c", "y"], df.mapInPandas(counted, df.schema))}, [])
    th, before = {"x": [2.0, 5.0, 8.0], "k": [1, 5]}, scratch.held(spark)
    top = trees.grow(tree, "y", th, ["c"], depth=3, classify=classify)
    assert read.value == len(rows) and scratch.held(spark) == before
    made = trees.cells(tree, "y", th, ["c"], classify)
    assert read.value == 2 * len(rows)
    by_row = df.groupBy(trees.leaf(top).alias("leaf")).agg(F.count(F.lit(1)).alias("rows"), F.count("y").alias("n")).sort("leaf").collect()
    by_cell = made.groupBy(trees.leaf(top).alias("leaf")).agg(F.sum("__rows").alias("rows"), F.sum("__n").alias("n")).sort("leaf").collect()
    assert by_row == by_cell and len(by_row) > 4 and sum(r.rows for r in by_row) == len(rows) and made.count() < len(rows)

    def nodes(n):
        return [n] if n.condition is None else [*nodes(n.left), *nodes(n.right)]

    assert {n.id: n.n for n in nodes(top)} == {r.leaf: r.n for r in by_row}
    again = trees.grow(tree, "y", th, ["c"], depth=3, classify=classify, made=made)
    assert again == top and read.value == 2 * len(rows)


@pytest.mark.parametrize("orders", ["SELECT *", "SELECT * REPLACE (7.0::DOUBLE AS o_totalprice)", None])
def test_predictions_of_a_tree_from_cells(spark, tmp_path, orders):
    """One join for the tree and its predictions; leaves with equal predictions stay apart, an empty join has none."""
    sf, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in "lineitem orders customer nation region part supplier".split():
        own = f"{orders or 'SELECT *'} FROM '{sf}/{t}.parquet'{'' if orders else ' LIMIT 0'}" if t == "orders" else f"FROM '{sf}/{t}.parquet'"
        con.execute(f"COPY ({own}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    got = QUERIES["tree_fit_predict"](spark, str(tmp_path))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, got.select("prediction", "n", "mean").collect())) == sorted(con.execute(SQL["tree_fit_predict"]).fetchall())


def test_command_line(example, tmp_path, spark, capsys, monkeypatch):
    path, tree = example
    monkeypatch.setattr(spark.__class__, "stop", lambda self: None)
    main(["--path", path, "--model", "count", "--out", str(tmp_path / "o")])
    assert spark.read.csv(str(tmp_path / "o"), sep="|", header=True).first().n == "9"
    main(["--path", path, "--model", "covar", "--explain"])
    assert "view 0" in capsys.readouterr().out
    features = sources.read_features(f"{path}/features.conf", tree)
    for model in ("covar", "reg", "rtree", "cube", "perc", "kmeans"):
        assert run(spark, model, tree, features).count() > 0
    cats = [sources.Feature("B", 0, "R"), sources.Feature("A", 1, "R"), sources.Feature("C", 1, "R")]
    assert run(spark, "mi", tree, cats).count() == 1
    assert run(spark, "ctree", tree, [sources.Feature("B", 1, "R"), sources.Feature("A", 1, "R"), sources.Feature("D", 0, "S")]).count() == 1
    with pytest.raises(ValueError):
        run(spark, "ctree", tree, features)
    capsys.readouterr()
    main(["--info"])
    assert "Spark" in capsys.readouterr().out
    held_out = tmp_path / "test_data.tbl"
    held_out.write_text("1|1|1|1|2|1\n2|1|2|1|1|1\n")
    main(["--path", path, "--model", "reg", "--test", str(held_out), "--times", str(tmp_path / "times.txt")])
    fitted = regression.fit(tree, "B", list("ACDEF"))
    x = np.array([[1, 1, 1, 1, 2, 1], [1, 2, 2, 1, 1, 1]]) @ fitted.theta
    told = float(re.search(r"RMSE: (\S+)", capsys.readouterr().out)[1])
    assert told == pytest.approx(float(np.sqrt(np.mean((x - 1) ** 2))))
    assert re.fullmatch(r"load=\d+\trun=\d+\tevaluate=\d+\n", (tmp_path / "times.txt").read_text())
    for model in ("rtree", "kmeans"):
        main(["--path", path, "--model", model, "--test", str(held_out)])
        assert re.search(r"(RMSE|cost): [0-9.]+", capsys.readouterr().out)
    main(["--path", path, "--dump", str(tmp_path / "d"), "--decimals", "2", "--sql", str(tmp_path / "sql"), "--mo", "0", "--parallel", "task", "--compress", "0"])
    assert "scalars" in capsys.readouterr().out
    from sumweave.plans import batch

    batch.COMPRESS = True
    assert spark.read.text(str(tmp_path / "d/query_0.header")).first().value == "0 28"
    line = spark.read.text(str(tmp_path / "d/query_0.tbl")).first().value.split("|")
    assert line[:3] == ["9.00", "11.00", "12.00"]
    assert (tmp_path / "sql/load_data.sql").read_text().startswith("DROP TABLE") and "ORDER BY" not in (tmp_path / "sql/output.sql").read_text()
    con = duckdb.connect()
    for name, own in ROWS.items():
        con.execute(f"CREATE TABLE {name} ({', '.join(f'{c} int' for c in tree.relations[name].columns)})")
        con.execute(f"INSERT INTO {name} VALUES {', '.join('(' + r.replace('|', ',') + ')' for r in own.split())}")
    con.execute((tmp_path / "sql/views.sql").read_text())
    main(["--path", path, "--bench_individual"])
    assert " ms" in capsys.readouterr().out


def test_dump_is_ordered(spark, example, tmp_path):
    _, tree = example
    batch = AggregateBatch(tree).add(Query(["A", "C"], [count(), agg("s", f.x("B"))])).add(Query([], [count()]))
    sources.dump(batch, str(tmp_path), "views", 2)
    assert [r.value for r in spark.read.text(f"{tmp_path}/query_0.tbl").collect()] == ["1|1|4.00|4.00", "1|2|2.00|4.00", "2|2|3.00|3.00"]
    assert spark.read.text(f"{tmp_path}/query_0.header").first().value == "2 2"


def test_stream_of_rows(spark, example, tmp_path):
    _, tree = example
    tree.frame("S").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(tree.frame("S").schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = Query(["A"], [count(), agg("s", f.x("B"))])
    streaming.maintain(stream, tree, "S", q, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = sorted(map(tuple, streaming.totals(spark, q, str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, AggregateBatch(tree).add(q).execute()[0].collect()))


@pytest.mark.parametrize("name", sorted(SQL))
def test_queries_agree_with_sql(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in "lineitem orders customer nation region part supplier events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want, got = con.execute(SQL[name]), QUERIES[name](spark, sf)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    flat = lambda rows: sorted([tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows], key=str)
    assert flat(map(tuple, got.select(*names).collect())) == flat(want.fetchall())
