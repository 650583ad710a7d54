"""Connected components of a link table, without bringing links or components to one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.storage import cut_lineage


#: edges, of 16 bytes each, that make a task of their own
EDGES = 1 << 20


def _stars(edges: DataFrame, larger_only: bool, tasks: int) -> DataFrame:
    """Tie every node's neighbours to the smallest of them and itself.

    With ``larger_only`` each node counts all neighbours and moves the larger
    ones (large star), else it counts and moves smaller ones and itself (small star).
    """
    if larger_only:
        seen = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    # the minimum of a node is combined map-side; the join back is an equi-join that can be split where a node is hot
    least = seen.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    joined = seen.join(least, "a")
    moved = joined.where("b > a") if larger_only else joined.unionByName(least.select("a", F.col("a").alias("b"), "m"))
    tied = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    # every task writes a file for each shuffle: few edges are no work for many tasks
    return tied.coalesce(tasks).distinct().coalesce(tasks)


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node reachable, of all nodes in ``links`` (``a``, ``b``).

    Alternates large and small stars until nothing changes; the number of rounds
    grows with the logarithm of the nodes. Each round is written to the shared folder, by as many tasks
    as its edges need, whatever the number of shuffle partitions.
    """
    edges = cut_lineage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, rows = None, edges.count()
    while True:
        tasks = max(edges.sparkSession.sparkContext.defaultParallelism, -(-rows // EDGES))
        edges = cut_lineage(_stars(_stars(edges.coalesce(tasks), True, tasks), False, tasks))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before, rows = now, now[0]
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
