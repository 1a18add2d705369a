"""Command line: load a join tree and its tables, run one model, print or write the result."""

from __future__ import annotations

import argparse
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor

import pyspark
from pyspark.sql import SparkSession

from . import sources
from .operators.applications import APPLICATIONS, Task
from .plans import batch as batches
from .plans.batch import AggregateBatch
from .plans.sqlgen import scripts


def run(spark: SparkSession, model: str, tree, features, strategy: str = "flat", k: int = 5, kappa: int | None = None):
    """The model's result as a DataFrame."""
    task = Task(spark, tree, features, strategy, k, kappa)
    APPLICATIONS[model].check(task)
    return APPLICATIONS[model].run(task)


def run_batch(batch: AggregateBatch, strategy: str, shared: bool, concurrent: bool) -> dict[str, float]:
    """Runs the batch into a sink that drops the rows: seconds of each query, or of the one pass for all."""
    spent: dict[str, float] = {}

    def one(name: str, df) -> None:
        began = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        spent[name] = time.perf_counter() - began

    if shared:
        one("all", batch.shared(strategy).df)
        return spent
    with ThreadPoolExecutor(8 if concurrent else 1) as pool:
        list(pool.map(one, [q.name or str(i) for i, q in enumerate(batch.queries)], batch.execute(strategy)))
    return spent


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="sumweave", description=__doc__)
    p.add_argument("--info", action="store_true", help="print versions and stop")
    p.add_argument("-p", "--path", help="folder of the tables and configuration")
    p.add_argument("-f", "--files", help="folder of the configuration, if another")
    p.add_argument("--td", default="treedecomposition.conf")
    p.add_argument("--feat", default="features.conf")
    p.add_argument("-m", "--model", choices=APPLICATIONS, default="covar")
    p.add_argument("--strategy", choices=("flat", "views", "auto"), default="flat")
    p.add_argument("-o", "--out", help="folder to write the result to")
    p.add_argument("--format", default="csv")
    p.add_argument("-k", "--clusters", type=int, default=5)
    p.add_argument("--kappa", type=int)
    p.add_argument("--depth", type=int, default=3, help="levels of the tree that --test evaluates")
    p.add_argument("--test", help="rows of the join (a file with all attributes) to evaluate the model on")
    p.add_argument("--times", help="local file that gets a line with the milliseconds of each step")
    p.add_argument("--mo", type=int, choices=(0, 1), default=1, help="1: one pass for all queries of the batch; 0: a pass each")
    p.add_argument("--compress", type=int, choices=(0, 1), default=1, help="1: products that differ below one edge are added there; 0: each by itself")
    p.add_argument("--parallel", choices=("none", "task", "domain", "both"), default="both", help="task, both: with --mo 0, queries run at the same time (Spark splits the data anyway)")
    p.add_argument("--bench_individual", action="store_true", help="time the batch query by query and stop")
    p.add_argument("--microbench", action="store_true", help="print the formatted plan of the batch before it runs")
    p.add_argument("--dump", help="folder for the batch's results as lines, each with a header of counts")
    p.add_argument("--decimals", type=int, help="of dumped aggregates, in order of the group-by attributes")
    p.add_argument("--explain", action="store_true", help="print the view plan of the batch and stop")
    p.add_argument("--sql", nargs="?", const="-", help="print the SQL of the batch's views, or write all scripts to this folder, and stop")
    o = p.parse_args(args)
    if o.info:
        print(f"sumweave on Spark {pyspark.__version__}, Python {sys.version.split()[0]}; models: {', '.join(APPLICATIONS)}")
        return
    if not o.path:
        p.error("--path is required")
    began = time.perf_counter()
    conf, times = o.files or o.path, {}
    batches.COMPRESS = bool(o.compress)
    spark = SparkSession.builder.appName("sumweave").getOrCreate()
    tree = sources.load(spark, o.path, sources.read_tree(os.path.join(conf, o.td)))
    features = sources.read_features(os.path.join(conf, o.feat), tree) if o.model != "count" else []
    task = Task(spark, tree, features, o.strategy, o.clusters, o.kappa, o.depth)
    application = APPLICATIONS[o.model]
    application.check(task)
    times["load"] = time.perf_counter() - began

    if o.explain or o.sql or o.dump or o.bench_individual or o.microbench or not o.mo:
        if application.batch is None:
            p.error(f"{o.model} has no batch of its own")
        batch = application.batch(task)
        if o.explain:
            print(batch.explain())
            print(batch.stats())
        if o.sql == "-":
            print("\n".join(batch.to_sql("views")))
        elif o.sql:
            os.makedirs(o.sql, exist_ok=True)
            for name, text in scripts(batch, o.path, o.sql).items():
                with open(os.path.join(o.sql, name), "w", encoding="utf-8") as f:
                    f.write(text + "\n")
        if o.dump:
            sources.dump(batch, o.dump, o.strategy, o.decimals)
        if o.microbench:
            batch.shared(o.strategy).df.explain("formatted")
        if o.bench_individual or not o.mo or o.microbench:
            spent = run_batch(batch, o.strategy, bool(o.mo) and not o.bench_individual, o.parallel in ("task", "both") and not o.bench_individual)
            print("\n".join(f"{k}\t{v * 1000:.0f} ms" for k, v in spent.items()))
            times |= spent
    else:
        began = time.perf_counter()
        out = application.run(task)
        if o.out:
            sources.write_table(out, o.out, o.format)
        else:
            out.show(1000, truncate=False)
        times["run"] = time.perf_counter() - began
        if o.test:
            if application.evaluate is None:
                p.error(f"{o.model} has no model to evaluate")
            began = time.perf_counter()
            name, value = application.evaluate(task, sources.read_joined(spark, o.test, tree))
            print(f"{name}: {value}")
            times["evaluate"] = time.perf_counter() - began
    if o.times:
        sources.append_times(o.times, times)


if __name__ == "__main__":
    main()
