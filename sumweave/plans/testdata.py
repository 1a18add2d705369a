"""The join tree over the star schema tables, and the SQL of its relations.

Money is read as DECIMAL(12,2): sums of products are then exact on any plan.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .schema import JoinTree, Relation

#: relation: (table, ((attribute, expression) ...)); fixed values.
RELATIONS = {
    "lineitem_r": ("lineitem", (("orderkey", "l_orderkey"), ("partkey", "l_partkey"), ("suppkey", "l_suppkey"), ("quantity", "CAST(l_quantity AS DECIMAL(12,2))"), ("extendedprice", "CAST(l_extendedprice AS DECIMAL(12,2))"), ("discount", "CAST(l_discount AS DECIMAL(12,2))"), ("tax", "CAST(l_tax AS DECIMAL(12,2))"), ("returnflag", "l_returnflag"), ("linestatus", "l_linestatus"))),
    "orders_r": ("orders", (("orderkey", "o_orderkey"), ("custkey", "o_custkey"), ("orderstatus", "o_orderstatus"), ("totalprice", "CAST(o_totalprice AS DECIMAL(12,2))"), ("orderpriority", "o_orderpriority"))),
    "customer_r": ("customer", (("custkey", "c_custkey"), ("nationkey", "c_nationkey"), ("acctbal", "CAST(c_acctbal AS DECIMAL(12,2))"), ("mktsegment", "c_mktsegment"))),
    "nation_r": ("nation", (("nationkey", "n_nationkey"), ("n_name", "n_name"), ("regionkey", "n_regionkey"))),
    "region_r": ("region", (("regionkey", "r_regionkey"), ("r_name", "r_name"))),
    "part_r": ("part", (("partkey", "p_partkey"), ("p_brand", "p_brand"), ("p_type", "p_type"), ("p_size", "CAST(p_size AS BIGINT)"), ("retailprice", "CAST(p_retailprice AS DECIMAL(12,2))"))),
    "supplier_r": ("supplier", (("suppkey", "s_suppkey"), ("s_nationkey", "s_nationkey"), ("s_acctbal", "CAST(s_acctbal AS DECIMAL(12,2))"))),
    "events_r": ("events", (("custkey", "user_id"), ("event_type", "event_type"), ("value", "CAST(value AS DECIMAL(12,2))"))),
}
EDGES = [("lineitem_r", "orders_r"), ("orders_r", "customer_r"), ("customer_r", "nation_r"), ("nation_r", "region_r"), ("lineitem_r", "part_r"), ("lineitem_r", "supplier_r")]
#: Relations whose columns shared with their parent are a key with a match for each of its rows (the oracle SQL joins them all, so it tests that).
UNIQUE = {"orders_r", "customer_r", "nation_r", "region_r", "part_r", "supplier_r"}

#: How many values these attributes have at most, null included (fixed values).
DOMAINS = {"returnflag": 4, "linestatus": 3, "orderstatus": 4, "orderpriority": 6, "mktsegment": 6, "event_type": 10, "n_name": 26, "r_name": 6, "p_brand": 30, "p_size": 51}


def star(spark: SparkSession, sf_dir: str, events: bool = False) -> JoinTree:
    edges = EDGES + ([("customer_r", "events_r")] if events else [])
    names = {n for e in edges for n in e}
    relations = {}
    for name, (table, columns) in RELATIONS.items():
        if name in names:
            df = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*(f"{e} AS {c}" for c, e in columns))
            relations[name] = Relation(name, [c for c, _ in columns], df)
    return JoinTree(relations, edges, "lineitem_r", unique=frozenset(UNIQUE), complete=frozenset(UNIQUE), domains=DOMAINS)


def tables() -> dict[str, str]:
    """SQL of each relation."""
    return {n: f"(SELECT {', '.join(f'{e} AS {c}' for c, e in columns)} FROM {t})" for n, (t, columns) in RELATIONS.items()}


def shape(events: bool = False) -> JoinTree:
    """The tree without data, for SQL."""
    edges = EDGES + ([("customer_r", "events_r")] if events else [])
    names = {n for e in edges for n in e}
    return JoinTree({n: Relation(n, [c for c, _ in cols]) for n, (_, cols) in RELATIONS.items() if n in names}, edges, "lineitem_r", unique=frozenset(UNIQUE), complete=frozenset(UNIQUE), domains=DOMAINS)
