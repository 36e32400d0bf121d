"""Connected components of a link table, as DataFrame joins with stored rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pointloom.llm.common import discard, skewed_join, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every node in ``links(a, b)``; root is the component's smallest node.

    Alternates two steps until no link changes: every node's larger neighbours are hung on the
    smallest node among it and its neighbours (large star), then every node and its smaller
    neighbours on the smallest of those (small star).  The number of rounds grows with the
    logarithm of the nodes.  A hub with very many neighbours is aggregated with partial sums, and the
    joins deal its rows over many tasks; it is never gathered in one.
    Each round is stored in the shared folder, and the round before it deleted.

    Loops, repeated links and links with a null end count for nothing; a node without links is in no row; other
    columns are not read; an empty table gives an empty result.
    """
    edges = written(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    signature = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__rows")).select("u", F.least("u", "m").alias("m"), "__rows")
        large = skewed_join(both, least.drop("__rows"), ["u"], "inner", F.xxhash64("v"), least.select("u", "__rows")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "links")
        # small star: all links point down now (u > v)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("__rows"))
        joined = skewed_join(large, low.select("u", "m"), ["u"], "inner", F.xxhash64("v"), low.select("u", "__rows"))
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        before, edges = edges, written(small, "links")
        discard(before)
        discard(large)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == signature:
            break
        signature = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
