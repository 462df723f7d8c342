"""Connected components of a table of links, as joins and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.llm.common import persisted, removed


def _stars(edges: DataFrame) -> bool:
    """Whether no node of the edges (u, v < u) has two neighbours below it, or one below and one above."""
    ends = F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("below"), F.lit(0).alias("above")), F.struct(F.col("v").alias("id"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    nodes = edges.select(F.explode(ends).alias("x")).groupBy("x.id").agg((F.sum("x.below") + F.max("x.above")).alias("most"))
    return (nodes.agg(F.max("most")).head()[0] or 0) <= 1


def components(links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (id, root): each linked node and the smallest id of its component.

    Alternates two star steps on the edge list: neighbours above a node are linked to its smallest
    neighbour, then the node and its neighbours below it likewise; edges become stars around the roots
    in about log of the size rounds. A node's minimum is a sum before the shuffle, and the join back
    to the edges may be split where a hub has many. Every round is written to the shared folder. Stars are
    known by their nodes' neighbours, so that no round runs to find that nothing changes."""
    edges = persisted(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges"
    )
    while not _stars(edges):
        # both ends in one scan: the driver sends out a setting for each scan and keeps each stage's tasks
        both = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.*")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # a row for each edge at most, so equal ones may wait for the distinct below
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
            .select("x.*").where("u <> v").distinct()
        )
        after = persisted(small, "edges")
        removed(edges)
        edges = after
    # stars: each u has one v, the root
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()
    )
