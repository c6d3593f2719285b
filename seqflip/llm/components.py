"""Connected components of a link table by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node in ``links`` (a, b: long); a component is named by its smallest node.

    Each round hooks every node to its smallest neighbour and contracts the links to the hooked nodes; rounds are
    stored, so nothing is replayed, and every step is a summed aggregation or an equi-join (no group is gathered).
    The number of rounds grows with the logarithm of the links."""
    edges = stored(links.select("a", "b").filter("a <> b").distinct(), "edges")
    rounds: list[DataFrame] = []
    while edges.take(1):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("parent")), "hooks")
        # A hook may point at a node that is hooked itself; following it twice shortens the chains.
        step = hooks.alias("x").join(hooks.alias("y"), F.col("x.parent") == F.col("y.node")).select("x.node", F.col("y.parent").alias("parent"))
        step = stored(step, "step")
        rounds.append(step)
        a, b = step.select(F.col("node").alias("a"), F.col("parent").alias("pa")), step.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        old, edges = edges, stored(edges.join(a, "a").join(b, "b").filter("pa <> pb")
                                   .select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct(), "edges")
        forget(old)
        forget(hooks)
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    # Compose the rounds: a node's component is where the last round that knows its place has put it.
    out = rounds[0].select("node", F.col("parent").alias("component"))
    for later in rounds[1:]:
        out = (out.join(later.select(F.col("node").alias("component"), F.col("parent").alias("_p")), "component", "left")
               .select("node", F.coalesce("_p", "component").alias("component")))
    return out
