"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from copyledger.llm.common import settled
from copyledger.operators.keyed import join_on_groups


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least of u and its neighbours. A vertex of
    very many edges sends one row per task to the minimum, and its joined
    partition can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return join_on_groups(edges, least, ["u"])


def large_star(edges: DataFrame) -> DataFrame:
    """Joins every larger neighbour of a vertex to the least of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """Joins a vertex and its smaller neighbours to the least of them."""
    linked = _with_least(edges)
    pairs = F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))
    return linked.select(F.explode(pairs).alias("p")).select("p.*").where("u <> v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) of every vertex of ``edges`` (u, v); ``component`` is the
    smallest vertex that can be reached.

    Vertices are longs. Edges with a null end and loops are left out, repeated
    ones count once. Every round is written to the shared folder; rounds
    grow with the logarithm of the component size. Raises if ``max_rounds`` do
    not settle it.
    """
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state = settled(links.distinct())
    seen = None
    for _ in range(max_rounds):
        mark = tuple(
            state.agg(
                F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
            ).first()
        )
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        state = settled(small_star(large_star(state)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("v").alias("id")).distinct()
    return state.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        roots.select("id", F.col("id").alias("component"))
    )
