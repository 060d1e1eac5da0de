"""Connected components of a graph that only Spark holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import checkpointed as reliable


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is tied to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    tied = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its neighbours below it are tied to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return tied.union(own).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(u long, v long)``; the root is the least node.

    Alternates the two star steps until nothing changes, which takes about the logarithm of the
    longest path. Self-loops and repeated edges do no harm, an edge with a null end is left out, and a
    table without edges gives no rows.
    """
    live = reliable(edges.where("u is not null and v is not null and u != v").select("u", "v").distinct())
    mark = _mark(live)
    while mark[0]:
        live = reliable(_small_star(_large_star(live)))
        new = _mark(live)
        if new == mark:
            break
        mark = new
    roots = live.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return live.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
