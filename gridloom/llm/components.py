"""Connected components over an edge table by contraction; nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import table


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component): component is the smallest node id reachable over the undirected edges.

    Each round points every node at its smallest neighbour, compresses the pointers until they reach local
    minima (doubling, so a chain of length n takes log n joins), and contracts the edges to those; at least
    half of the nodes with edges go each round. Every round is written to the shared folder, so a lost executor
    repeats one stage, not the history, in as many files as its edges need. Loops and repeated edges are fine; null ends
    are ignored; no edge, no row.
    """
    live = table(edges.select(F.least(src, dst).cast("long").alias("a"), F.greatest(src, dst).cast("long").alias("b"))
                 .where("a < b").distinct())
    found: DataFrame | None = None
    n_edges = every = live.count()  # from the files' footers, as below; a round's nodes are twice as many at most
    while n_edges:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = table(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("p")), rows=2 * n_edges)
        while True:
            step = point.select(F.col("a").alias("p"), F.col("p").alias("q"))
            jumped = table(point.join(step, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.coalesce(F.col("q") != F.col("p"), F.lit(False)).alias("moved")), rows=2 * n_edges)
            more = not jumped.where("moved").isEmpty()
            point = jumped.drop("moved")
            if not more:
                break
        to_a = point.select("a", F.col("p").alias("pa"))
        to_b = point.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        merged = live.join(to_a, "a").join(to_b, "b").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        live = table(merged.where("a < b").distinct(), rows=n_edges)
        n_edges = live.count()
        if found is None:
            found = point.select(F.col("a").alias("node"), F.col("p").alias("component"))
        else:
            found = table(found.join(point.select(F.col("a").alias("component"), F.col("p").alias("q")), "component", "left")
                          .select("node", F.coalesce("q", "component").alias("component")), rows=2 * every)
    if found is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return found
