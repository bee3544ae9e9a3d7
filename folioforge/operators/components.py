"""Connected components by repeated contraction.

In each round every node hooks onto the first among itself and its neighbours, and both ends of every edge are rewritten
to that. Stars and cliques are done after one or two rounds in the order of ids, and then their root is the least id already.
What is left is hooked in a new random order in every round: only nodes that others hook onto are left, a share
of them whatever the shape, chains in the order of their ids too; so rounds grow with the logarithm of the number
of nodes. A round is one partial aggregation and two equi-joins on narrow rows; hubs are
pre-aggregated by the first and split by adaptive skew handling in the second.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from folioforge.plans.storage import cut, drop

#: Rounds in the order of ids; and rounds after which labels become a table, so that no plan joins more of them.
_BY_ID, _ROUNDS = 2, 4


def _counted(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``rows`` as a table, and how many there are."""
    seen = Observation()
    table = cut(rows.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return table, seen.get["n"]


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(node, root)`` for every node of ``edges``; ``root`` is the least node it can reach.

    Edges are undirected and may repeat; edges with a null end are dropped; a self-loop keeps its
    node as a component of one. An empty input gives an empty result.
    """
    links = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    links, many = _counted(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels, hops, number = None, [], 0
    while many or labels is None:
        order = (lambda c: F.xxhash64(c, F.lit(number))) if number >= _BY_ID else F.col  # noqa: B023
        ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
        first = ends.groupBy("node").agg((F.min("other") if number < _BY_ID else F.min_by("other", order("other"))).alias("other"))
        hop = cut(first.select("node", F.when(order("other") < order("node"), F.col("other")).otherwise(F.col("node")).alias("root")), "hooks")
        hops.append(hop)
        if labels is None:
            labels = hop
        else:
            labels = labels.join(hop.select(F.col("node").alias("root"), F.col("root").alias("next")), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        turned = links.join(hop.select(F.col("node").alias("a"), F.col("root").alias("x")), "a").join(hop.select(F.col("node").alias("b"), F.col("root").alias("y")), "b").where("x <> y")
        before = links
        links, many = _counted(turned.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "edges")
        drop(before)
        number += 1
        if number % _ROUNDS == 0 and many:
            labels = cut(labels, "labels")
            for table in hops:
                drop(table)
            hops = [labels]
    if number > _BY_ID:
        least = labels.groupBy("root").agg(F.min("node").alias("least"))
        labels = labels.join(least, "root").select("node", F.col("least").alias("root"))
    out = cut(labels, "components") if number > 1 else labels
    for table in (*hops, links):
        if table is not out:
            drop(table)
    return out
