"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelkit.sources.io import materialize


def components(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes of the links (a, b): the component is its smallest node.

    Alternates large-star and small-star steps until neither changes a link. A step is a grouped
    minimum and a join, so a node with very many links needs no task of its own; a dozen steps do
    for paths of thousands. Links may repeat and point either way."""
    edges = materialize(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    )
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct()
        )
        edges = materialize(small)
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen:
            break
        seen = tuple(state)
    star = edges.groupBy("u").agg(F.min("v").alias("component"))
    return star.select(F.col("u").alias("node"), "component").unionByName(
        star.select(F.col("component").alias("node"), "component").distinct()
    )
