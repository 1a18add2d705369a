"""Additive aggregates kept up to date from a stream of rows.

The sums of a batch are additive over rows of one relation: each micro-batch is
aggregated with the other relations and added to a state table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.batch import AggregateBatch, Query
from ..plans.schema import JoinTree


def maintain(stream: DataFrame, tree: JoinTree, relation: str, query: Query, path: str, checkpoint: str) -> StreamingQuery:
    """Starts a query that writes each micro-batch's partial sums under ``path``/batch=<id>.

    A repeated batch overwrites its own part, so restarts count nothing twice; read the
    totals with ``totals``.
    """

    def add(rows: DataFrame, batch_id: int) -> None:
        part = AggregateBatch(tree.replace(relation, rows)).add(query).execute("flat")[0]
        part.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark, query: Query, path: str) -> DataFrame:
    parts = spark.read.parquet(path)
    return parts.groupBy(*query.group_by).agg(*(F.sum(a.name).alias(a.name) for a in query.aggregates))


def merge(frames: list[DataFrame], query: Query) -> DataFrame:
    """Totals of partial results, for incremental batches without a stream."""
    every = reduce(DataFrame.unionByName, frames)
    return every.groupBy(*query.group_by).agg(*(F.sum(a.name).alias(a.name) for a in query.aggregates))
