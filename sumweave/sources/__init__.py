"""Configuration files, ``|``-separated tables, Parquet, and sinks."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans import scratch
from ..plans.schema import TYPES, Attribute, JoinTree, Relation

CONTINUOUS, CATEGORICAL, MEASURE = 0, 1, 2


@dataclass(frozen=True)
class Feature:
    name: str
    kind: int
    relation: str


def _records(path: str) -> list[str]:
    with open(path, encoding="utf-8") as f:
        return [line.strip() for line in f if line.strip() and not line.startswith("#")]


def read_tree(path: str) -> JoinTree:
    """A join tree file: counts; ``id name type``; ``id relation:columns``; ``a-b`` edges; ``relation threads``."""
    lines = iter(_records(path))
    n_attributes, n_relations, n_edges = (int(v) for v in next(lines).split()[:3])
    attributes, relations, edges = {}, {}, []
    for i in range(n_attributes):
        number, name, kind = next(lines).split()[:3]
        if int(number) != i:
            raise ValueError(f"attribute {name}: id {number}, expected {i}")
        attributes[name] = Attribute(i, name, kind if kind in TYPES else "int")
    for i in range(n_relations):
        number, rest = next(lines).split(None, 1)
        if int(number) != i:
            raise ValueError(f"relation {rest}: id {number}, expected {i}")
        name, columns = rest.split(":", 1)
        names = [c.strip() for c in columns.split(",") if c.strip()]
        for c in names:
            if c not in attributes:
                raise ValueError(f"relation {name}: unknown attribute {c!r}")
        # files hold the columns by attribute id, however the list is ordered
        relations[name.strip()] = Relation(name.strip(), sorted(names, key=lambda c: attributes[c].id))
    for _ in range(n_edges):
        a, b = next(lines).split("-")
        edges.append((a.strip(), b.strip()))
    for line in lines:
        name, threads = line.split()[:2]
        if name not in relations:
            raise ValueError(f"unknown relation {name!r}")
        relations[name].threads = int(threads)
    return JoinTree(relations, edges, None, attributes)


def read_features(path: str, tree: JoinTree, label: str | None = None) -> list[Feature]:
    """A feature file: ``n, degree``; n times ``attribute:type:relation``, the label first.

    label: "continuous" or "categorical" if the application asks for one.
    """
    lines = _records(path)
    n = int(lines[0].split(",")[0])
    out = []
    for line in lines[1 : n + 1]:
        name, kind, relation = (v.strip() for v in line.split(":")[:3])
        if name not in tree.columns():
            raise ValueError(f"unknown attribute {name!r}")
        if relation not in tree.relations:
            raise ValueError(f"unknown relation {relation!r}")
        out.append(Feature(name, int(kind), relation))
    if len(out) != n:
        raise ValueError(f"{n} features announced, {len(out)} found")
    check_label(out, label)
    return out


def check_label(features: list[Feature], label: str | None) -> None:
    if label == "continuous" and features[0].kind == CATEGORICAL:
        raise ValueError("the label must be continuous")
    if label == "categorical" and features[0].kind != CATEGORICAL:
        raise ValueError("the label must be categorical")


def read_centroids(path: str) -> list[list[float]]:
    """Explicit first centroids: one a line, numbers by commas, braces allowed."""
    return [[float(v) for v in line.strip("{};, ").split(",")] for line in _records(path)]


def read_table(spark: SparkSession, path: str, columns: list[str], attributes: dict[str, Attribute]) -> DataFrame:
    """A ``|``-separated file without header, or Parquet; constants are added."""
    stored = [c for c in columns if attributes.get(c) is None or attributes[c].constant is None]
    if path.endswith(".parquet"):
        df = spark.read.parquet(path).select(*stored)
    else:
        schema = T.StructType([T.StructField(c, TYPES[attributes[c].type]) for c in stored])
        df = spark.read.csv(path, sep="|", header=False, schema=schema)
    return df.select(*(F.col(c) if c in stored else F.lit(attributes[c].constant).alias(c) for c in columns))


def load(spark: SparkSession, path: str, tree: JoinTree) -> JoinTree:
    """The tree with each relation's table (``<name>.tbl`` or ``<name>.parquet``) as its data."""
    for r in tree.relations.values():
        names = [f"{path}/{r.name}.tbl", f"{path}/{r.name}.parquet"]
        found = next((n for n in names if os.path.exists(n)), names[0])  # other stores: Spark says if it is missing
        r.df = read_table(spark, found, r.columns, tree.attributes)
    return tree


def read_joined(spark: SparkSession, path: str, tree: JoinTree) -> DataFrame:
    """Rows of the join from a file (``|``-separated, all attributes by their ids, or Parquet): held-out data for a model."""
    return read_table(spark, path, tree.columns() if path.endswith(".parquet") else sorted(tree.attributes, key=lambda a: tree.attributes[a].id), tree.attributes)


def write_table(df: DataFrame, path: str, format: str = "csv") -> None:
    """A result as ``|``-separated files or Parquet."""
    writer = df.write.mode("overwrite")
    if format == "csv":
        writer.csv(path, sep="|", header=True)
    else:
        writer.format(format).save(path)


def dump(batch, folder: str, strategy: str = "flat", decimals: int | None = None) -> None:
    """Each query's rows as ``|``-separated lines in ``query_<i>.tbl``, from one pass over the join.

    ``query_<i>.header`` has one line: the numbers of group-by attributes and of aggregates.  With ``decimals``
    aggregates are written with so many, rows in the order of their group-by attributes.
    """
    spark = batch.tree.frame(batch.tree.root).sparkSession
    for i, (q, df) in enumerate(zip(batch.queries, batch.execute(strategy, folder=scratch.folder(spark, "dump")))):
        if decimals is not None:
            df = df.select(*q.group_by, *(F.col(a.name).cast(f"decimal(38,{decimals})").alias(a.name) for a in q.aggregates))
            df = df.orderBy(*q.group_by) if q.group_by else df
        line = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns))
        df.select(line.alias("value")).write.mode("overwrite").text(f"{folder}/query_{i}.tbl")
        spark.range(1).select(F.lit(f"{len(q.group_by)} {len(q.aggregates)}").alias("value")).write.mode("overwrite").text(f"{folder}/query_{i}.header")


def append_times(path: str, times: dict[str, float]) -> None:
    """One line of a local file: name and milliseconds of each step, tab-separated."""
    with open(path, "a", encoding="utf-8") as f:
        f.write("\t".join(f"{k}={v * 1000:.0f}" for k, v in times.items()) + "\n")
