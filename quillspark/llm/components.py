"""Connected components of a link table by alternating stars, all in Spark.

Kiveris et al., "Connected components in MapReduce and beyond" (2014).  Each round is aggregated with partial
aggregation and joined back; nothing is collected, and each round's links are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import materialise


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that is in a link; root is the least node of its component.

    Links of a node to itself and links with a null end are ignored; repeated links count once.
    """
    x, y = F.col(a), F.col(b)
    e = links.filter(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct()
    e = materialise(e, "links")
    before = None
    while True:
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
        both = e.select(F.col("u").alias("p"), F.col("v").alias("q")).unionByName(e.select(F.col("v").alias("p"), F.col("u").alias("q")))
        least = both.groupBy("p").agg(F.least(F.min("q"), F.first("p")).alias("m"))
        large = both.filter("q > p").join(least, "p").select(F.col("q").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.withColumn("root", F.col("node")))
