"""Connected components of a link table, by alternating stars.

Each round hangs all larger neighbours of a vertex on its least one, then all
smaller ones; both keep the components and the number of links falls to one for each
vertex.  Neighbourhoods are reduced to their minimum before they are shuffled and
joined back, so no neighbourhood is collected; the minima are written first, so the join
has plain exchanges on both sides, whose hot vertices adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut


def _star(links: DataFrame) -> DataFrame:
    """links: (v, u), u a neighbour of v.  Gives (u, least of v and its neighbours)."""
    least = cut(links.groupBy("v").agg(F.min("u").alias("m")), "least")
    return links.join(least, "v").select("v", "u", F.least("m", "v").alias("m"))


def components(links: DataFrame) -> DataFrame:
    """links: a long, b long.  Gives node, component (least node reachable) for every linked node."""
    now = cut(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    last = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == last:
            break
        last = state
        both = now.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(now.select(F.col("b").alias("v"), F.col("a").alias("u")))
        large = _star(both).filter("u > v").select(F.col("u").alias("a"), F.col("m").alias("b")).filter("a != b").distinct()
        down = large.select(F.col("a").alias("v"), F.col("b").alias("u"))
        star = _star(cut(down, "links"))
        small = star.select(F.col("u").alias("a"), F.col("m").alias("b")).unionByName(star.select(F.col("v").alias("a"), F.col("m").alias("b")))
        now = cut(small.filter("a != b").distinct(), "links")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
