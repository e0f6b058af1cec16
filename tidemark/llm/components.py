"""Connected components of a link table, in DataFrame steps that end their lineage in the shared folder."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import materialise


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (smallest node reachable) for every node that has a link.

    Each step lets a node take the smallest label among its neighbours and then its label's own label, so the
    number of steps grows with the logarithm of the longest path. Hot nodes are pre-aggregated by min().
    """
    one = links.select(F.col(a).alias("node"), F.col(b).alias("other"))
    both = materialise(one.unionByName(one.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = materialise(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        hooked = labels.join(near, "node").select("node", F.least("component", "near").alias("to"), F.col("component").alias("was"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("next"))
        after = materialise(hooked.join(jump, "to", "left").select("node", F.coalesce(F.least("to", "next"), "to").alias("component"), "was"), labels)
        if not after.where("component <> was").limit(1).count():
            return after.select("node", "component")
        labels = after
