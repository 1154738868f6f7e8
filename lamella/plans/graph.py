"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamella.session import cut, settled


#: Edges up to which the least neighbours (at most two rows of 16 bytes an edge) are broadcast.
BROADCAST_EDGES = 200_000


def _near(edges: DataFrame, small: bool) -> DataFrame:
    """The least neighbour of each node, to be joined with the edges.

    A hub's edges all meet one row of it. Few rows are broadcast. Many are cut off from their aggregation first, so
    that both sides of the join are exchanges of its own and adaptive execution can split a hub's partition.
    """
    least = edges.groupBy("src").agg(F.min("dst").alias("near"))
    return F.broadcast(least) if small else cut(least)


def _large_star(edges: DataFrame, small: bool) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return (
        both.join(_near(both, small), "src")
        .where("dst > src")
        .select(F.col("dst").alias("src"), F.least("src", "near").alias("dst"))
        .distinct()
    )


def _small_star(edges: DataFrame, small: bool) -> DataFrame:
    least = _near(edges, small)
    moved = edges.join(least, "src").where("dst != near").select(F.col("dst").alias("src"), F.col("near").alias("dst"))
    return moved.unionByName(least.select("src", F.col("near").alias("dst"))).distinct()


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node id that is reachable; every node of an edge appears once.

    Null ends and loops are dropped: a node that has a loop only does not appear. Every step is an aggregation
    with map-side combine or an equi-join that is broadcast or split at a hub, so that a node with very many
    neighbours is never gathered in one task; each round is cut by a checkpoint in the shared folder.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a != b")
    now = cut(ends.select(F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")).distinct())
    mark = _mark(now)
    for _ in range(max_rounds):
        small = mark[0] <= BROADCAST_EDGES
        now = _large_star(now, small)
        now = settled(_small_star(now if small else cut(now), small))
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    roots = now.select(F.col("dst").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(roots)
