"""Connected components by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlift.session import stage


def components(links: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``links`` (a, b); a component is named by its smallest node.

    Each round points every node at its smallest neighbour, follows the pointer once more and contracts
    the links, so stars and short chains are gone at once and the number of links falls quickly.  A node
    with very many neighbours is a minimum, added up before the shuffle, and a join that Spark can split.
    """
    links = stage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    whole = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = stage(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("up")), "near")
        next_up = near.select(F.col("a").alias("up"), F.col("up").alias("upper"))
        near = stage(near.join(next_up, "up").select("a", F.col("upper").alias("up")), "nearer")
        if whole is None:
            whole = near.select(F.col("a").alias("node"), F.col("up").alias("component"))
        else:
            moved = near.select(F.col("a").alias("component"), "up")
            whole = whole.join(moved, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
        whole = stage(whole, "components")
        ends = links.join(near, "a").select("b", F.col("up").alias("x")).join(near.select(F.col("a").alias("b"), F.col("up").alias("y")), "b")
        links = stage(ends.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        if links.isEmpty():
            return whole
