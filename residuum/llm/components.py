"""Connected components of an edge table, by alternating large-star and small-star.

Every round is two joins on aggregated minima, in which hubs are joined apart; the edge table is cut loose from
its lineage with a reliable checkpoint, and rounds end when it no longer changes.
Nothing but a row count and a checksum reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


HUB_ROWS, HUBS = 4096, 5000


def _with_low(edges: DataFrame, low: DataFrame, hub: int) -> DataFrame:
    """``edges`` with the ``m`` of their ``u``. Nodes of more than ``hub`` edges, of which
    there are few by that bound, are broadcast and their edges joined where they are; the
    others are joined by a shuffle, in which no node is a large share of the edges."""
    hubs = F.broadcast(low.filter(F.col("n") > hub).drop("n"))
    rest = edges.join(hubs.select("u"), "u", "left_anti").join(low.filter(F.col("n") <= hub).drop("n"), "u")
    return edges.join(hubs, "u").unionByName(rest)


def _stars(e: DataFrame, total: int) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    hub = HUB_ROWS + 2 * total // HUBS  # so there are fewer than HUBS hubs
    low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")) \
        .select("u", F.least("u", "m").alias("m"), "n").checkpoint()
    large = _with_low(both, low, hub).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    large = large.distinct().checkpoint()
    low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).checkpoint()
    small = _with_low(large, low, hub).filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, comp)`` for every node of ``edges`` (two columns of one orderable
    type); ``comp`` is the smallest node. Nulls and self-links are left out."""
    a, b = (F.col(f"`{c}`") for c in edges.columns)
    e = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)) \
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct().checkpoint()
    state = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state, e = now, _stars(e, now[0]).checkpoint()
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")) \
        .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
