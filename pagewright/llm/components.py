"""Connected components of a table of links, by hooking and shortcutting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 100) -> DataFrame:
    """node, component for every node in links (a, b of the same type); component is the smallest node that it reaches.

    Each round replaces the links by large-star and small-star links: a node's larger neighbours, then its smaller ones,
    are linked to the smallest node around it. After some logarithm of the nodes all links lead to the smallest node of
    their component. Links and nodes stay in Spark; minima are pre-aggregated, so that a node with very many links needs
    no more than a row a task. Rounds are cut by checkpoint(). A link's nodes may be equal or null (left out).
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct()
    pairs = checkpoint(pairs)
    before = None
    for _ in range(most_rounds):
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        pairs = checkpoint(small)
        now = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components didn't settle")
    return pairs.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node").unionByName(pairs.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component")))
