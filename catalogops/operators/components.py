"""Connected components by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogops.plans.staging import discard, written


def _stars(edges: DataFrame, centre: DataFrame) -> DataFrame:
    return edges.join(centre.hint("merge"), "u")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Rows ``(node, component)`` for every node of ``edges``; component = smallest reachable node.

    Alternates the large-star and small-star steps, each a grouped minimum
    joined back to the edge list, until every node hangs on one centre.  Only
    minima are aggregated, so a node with very many neighbours is combined
    map-side and never gathered.  Every round is written to the shared folder.
    Null ends and self loops give no edge; a node seen only in self loops is its
    own component.  An empty edge list gives no rows.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).dropna()
    nodes = written(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    now = nodes.where("u != v")
    while not _only_stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # One exchange by u serves the distinct, the minimum and the join.
        large = _stars(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).repartition("u").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            _stars(large, low)
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u != v")
            .distinct()
        )
        after = written(small, "small-star")
        discard(now)
        now = after
    alone = nodes.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    return alone.join(now.select(F.col("u").alias("node"), F.col("v").alias("component")).hint("merge"), "node", "left").select(
        "node", F.coalesce("component", "node").alias("component")
    )


def _only_stars(edges: DataFrame) -> bool:
    """Whether every node is the larger end of one edge at most, and then of no edge the smaller end."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.max("e.down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()
