"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a join and an aggregation with map-side combine; no neighbourhood is gathered in one
place, and each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestor.llm.work import stored


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges (a, b), longs, to (node, root): root is the smallest node that can be reached.

    Loops, repeated and reversed edges are allowed; rows with a null are ignored. Nodes without an
    edge to another node aren't returned.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), name)
    print_of = F.struct(F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("hi", "lo")), F.lit(0)))
    before = now.agg(print_of.alias("p")).first().p
    while before[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        least = stored(least, name)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").distinct()
        large = stored(large, name)
        down = stored(large.groupBy("hi").agg(F.min("lo").alias("m")), name)
        small = large.join(down, "hi").select(F.explode(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct("hi", F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi <> lo").distinct()
        now = stored(small, name)
        after = now.agg(print_of.alias("p")).first().p
        if after == before:
            break
        before = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(now.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
