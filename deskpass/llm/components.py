"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a map-side combined minimum per node and an equi-join, so a node
with a third of all links costs each task one partial row (and its join rows are
split by AQE); no component is ever held in one task or on the driver. Steps are
written to the shared folder, so the lineage stays one step long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deskpass.llm.common import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): for every node of ``links``, the smallest node reachable from it.

    Links may repeat, point either way or to themselves; rows with a null end are
    ignored. A node whose only links are to itself does not appear. No links, no rows."""
    e = (links.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
         .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    e = stage(e, "components")
    while not _is_star_forest(e):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(low, "u").where(F.col("v") > F.col("u"))
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = stage(large, "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(
            F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                              F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*")
        e = stage(small.where(F.col("u") != F.col("v")).distinct(), "components")
    ends = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return ends.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _is_star_forest(e: DataFrame) -> bool:
    """Every node points to one smaller node, which points nowhere."""
    many = e.groupBy("u").count().where("count > 1").limit(1).count()
    if many:
        return False
    return not e.join(e.select(F.col("u").alias("w")).distinct(), F.col("v") == F.col("w"), "left_semi").limit(1).count()
