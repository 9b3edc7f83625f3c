"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SharedTable


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link to another; root is the smallest node reachable.

    Alternates two steps until nothing changes: every node's larger neighbours are hung on its smallest neighbour, then its
    smaller ones. Both are a minimum per node (combined before the shuffle) and a join with it; each round is written to the
    shared folder, and only the numbers of links and a checksum come to the driver. The number of rounds grows with the
    logarithm of the longest path.
    """
    now = SharedTable(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "links")
    seen = None
    while True:
        e = now.df
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, F.col("u") == F.col("k")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = SharedTable(small.union(low.select("u", "m")).distinct(), "links")
        now.drop()
        now = after
        mark = now.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen:
            return now.df.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
