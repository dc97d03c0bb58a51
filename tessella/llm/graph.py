"""Connected components of a large undirected graph, by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, settle


#: Edges of one node from which its least neighbour is written before it is joined. The join then has exchanges
#: of its own, so that Spark can split the node's rows; where no node has as many, a shared exchange is cheaper.
HEAVY = 100_000


def _least(rows: DataFrame, heavy: bool) -> DataFrame:
    return settle(rows) if heavy else rows


def _large_star(edges: DataFrame, heavy: bool) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    low = _least(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), heavy)
    return settle(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())


def _small_star(edges: DataFrame, heavy: bool) -> DataFrame:
    low = _least(edges.groupBy("u").agg(F.min("v").alias("m")), heavy)
    moved = edges.join(low, "u")
    # a row (u, m) comes with those of u's other neighbours
    both = F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v"))))
    return settle(moved.select(both.alias("e")).select("e.*").where("u != v").distinct())


def _state(edges: DataFrame) -> tuple[bool, bool]:
    """Whether every edge (u, v) hangs a node u on a root v, and whether a node has very many edges."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    each = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    stars, most = each.agg(F.coalesce(F.every((F.col("up") == 0) | ((F.col("up") == 1) & (F.col("down") == 0))), F.lit(True)), F.max(F.col("up") + F.col("down"))).first()
    return stars, (most or 0) >= HEAVY


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long): root is the least node of its component."""
    current = settle(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    while True:
        stars, heavy = _state(current)
        if stars:
            break
        large = _large_star(current, heavy)
        small = _small_star(large, heavy)
        discard(current, large)
        current = small
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select("node", F.col("node").alias("root")))
