"""Connected components of a graph given by its links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import durable, release


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component``, the smallest node that links lead to, for every node of a link.

    Alternates two steps until nothing changes. In the large step each node gives its larger neighbours to the smallest
    node it knows; in the small step it gives its smaller ones. The number of rounds grows with the logarithm of the
    longest path. The smallest neighbour is a partial aggregate, so a node with very many links is reduced before it is
    shuffled, and no group is ever gathered. Each round is written to the shared folder, and the one before it removed.
    If ``most_rounds`` don't suffice, an error is raised: no unfinished components come out.

    Links may come in either direction, repeatedly, or from a node to itself; null ends are left out. No links give no
    rows.
    """
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x is not null and y is not null")
    nodes = edges.select("x").union(edges.select("y")).distinct()
    edges = durable(edges.filter("x <> y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    for _ in range(most_rounds):
        both = edges.union(edges.select("y", "x"))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y").union(low.select("x", "m")).distinct()
        following = durable(small)
        same = following.count() == edges.count() and following.join(edges, ["x", "y"], "left_anti").isEmpty()
        release(edges)
        edges = following
        if same:
            break
    else:
        raise RuntimeError(f"components are not found after {most_rounds} rounds")
    named = edges.groupBy("x").agg(F.min("y").alias("component"))
    return nodes.join(named, "x", "left").select(F.col("x").alias("node"), F.coalesce("component", F.col("x")).alias("component"))
