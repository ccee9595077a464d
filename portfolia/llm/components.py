"""Connected components of a graph whose links stay distributed.

Large-star and small-star rounds (Kiveris et al., "Connected Components in
MapReduce and Beyond") turn every component into a star around its smallest
node.  Each round is joins and partial aggregations; its links are written to
the shared folder, so lineage stays short and a lost executor costs a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from portfolia.llm.common import stage


def connected_components(links: DataFrame) -> DataFrame:
    """``links`` has columns a and b, two nodes each; returns node and root.

    ``root`` is the smallest node of the node's component.  Nodes without a
    link to another node, and links with a null end, give no row.
    """
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = stage(links, "links"), None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
        before = state
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stage(small.union(low).distinct(), "links")
