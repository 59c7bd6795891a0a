"""Connected components of a distributed edge table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.session import discard, materialise


def _to_minimum(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Every node's neighbours pointed at the least of node and neighbours (one row per neighbour)."""
    least = edges.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
    moved = edges.join(least, "a")
    if larger_only:
        return moved.filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b"))
    return (moved.select(F.col("b").alias("a"), F.col("least").alias("b"))
            .unionByName(least.select("a", F.col("least").alias("b"))))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for all nodes of the (a, b) edges; the component is its least node.

    Alternates the large-star and small-star steps: minima are combined before the shuffle, no neighbour list is
    ever gathered, and a hot node is only a hot join key, which AQE splits. Every round is a table in the shared
    folder. Ends when a round changes nothing, after a number of rounds that grows with the logarithm of the
    longest path; null ends are ignored, an edge from a node to itself only names the node.
    """
    edges = edges.select("a", "b").filter("a is not null and b is not null")
    nodes = materialise(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    edges = materialise(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_minimum(both, larger_only=True).filter("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        before, edges = edges, materialise(_to_minimum(down, larger_only=False).filter("a <> b").distinct())
        discard(before)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            least = edges.groupBy("a").agg(F.min("b").alias("component"))
            return nodes.join(least, nodes["node"] == least["a"], "left").select(
                "node", F.coalesce("component", "node").alias("component"))
        seen = state
    raise RuntimeError(f"components did not settle in {rounds} rounds")
