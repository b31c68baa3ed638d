"""Connected components of an edge table by alternating large-star and small-star steps.

Each step groups edges by a node (minimum of its neighbours, combined map-side) and joins the minimum back; both
sides of that join are plain shuffles, so AQE may split a node with very many neighbours. After every round the
edges are written to the shared folder, which keeps lineage short and survives lost executors. Joins are merge joins
by hint: Spark's threshold for broadcasts is in compressed bytes, of which ids take few, so that the driver would hold
tables many times as large. Only a count and a checksum of the edges come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnengine.llm.common import drop_materialized, materialize


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").bitwiseAND(F.lit((1 << 40) - 1))).alias("h")).first()
    return row["n"], row["h"] or 0


def _named(edges: DataFrame) -> DataFrame:
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    found._turnengine_path = edges._turnengine_path  # the caller may drop it once it has read it
    return found


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of edges (u, v; integers): the smallest node it reaches.

    Loops and repeated edges are allowed; rows with a null end are no edges; no edges give no rows.
    """
    edges = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = materialize(edges, "edges")
    before = _state(edges)
    if not before[0]:
        return _named(edges)
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the smallest node of u's neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).distinct()
        after_edges = materialize(small, "edges")
        drop_materialized(edges)
        edges, after = after_edges, _state(after_edges)
        if after == before:
            return _named(edges)
        before = after
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
