"""Connected components of an edge table by alternating large and small stars."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import discard, saved


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) but the roots; the root is the smallest node reachable.

    Each round rewrites the edges as tables in the work folder, until a round changes none.
    """
    e = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        kept = saved(large, "large-star")
        small = kept.groupBy("u").agg(F.min("v").alias("m"))
        moved = kept.join(small, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = saved(moved.union(small.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        discard(e, kept)
        e = after
