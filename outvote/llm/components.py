"""Connected components of an undirected graph by alternating large-star and small-star
rounds, each a minimum per node and a join. Nothing is collected but counts, and each round
is a written table, so lost executors cost the tasks they ran."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outvote.staging import stage

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    """Edges and a sum over them that changes when any of them does."""
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))).alias("s")).first()
    return r["n"], r["s"]


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges with their node's least neighbour m. The key is an expression, so both sides
    shuffle for the join alone and Spark can split the edges of a node that has very many."""
    keyed = least.select((F.col("a") + F.lit(0)).alias("__k"), "m")
    return edges.join(keyed.hint("merge"), F.col("a") == F.col("__k")).drop("__k")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return _with_least(both.filter("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them. Edges have a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = _with_least(edges, least).filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). Returns node, component: the least node that each node with an
    edge to another is linked to. Loops and repeated edges are allowed."""
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = stage(ordered.filter("a != b").distinct(), "edges")
    state = _state(current)
    for _ in range(MAX_ROUNDS):
        current = stage(_small_star(_large_star(current)), "stars")
        now = _state(current)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components have not settled after {MAX_ROUNDS} rounds")
    # every edge now joins a node to the least of its component
    least = current.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(least)
