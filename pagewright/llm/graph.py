"""Connected components of a link table, by alternating star contractions.

Every round is two aggregations and two joins over the links that are left, so
neither a component, a hub nor the whole graph has to fit into one task or the driver.
Ids may be of any orderable type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hot


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """Return (node, component) for every node that has a link to another node.

    ``component`` is the smallest id that links reach from the node. Null ids and
    links of a node to itself are left out; an empty table gives an empty result.
    """
    edges = cut(
        links.where(F.col(left) != F.col(right))
        .select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
        .distinct()
    )
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        later = both.where("v > u")
        least = both.groupBy("u").agg(F.least(F.first("u"), F.min("v")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n"))
        large = cut(join_hot(later, cut(least), ["u"], "n").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        parent = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
        edges = cut(
            join_hot(large, parent, ["u"], "n")
            .select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        seen = edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == before or seen[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = seen
