"""Connected components by alternating large-star and small-star rounds.

Every round is a pair of aggregate-and-join steps on the edge table, so no
neighbourhood, component or link list is ever gathered in one task or on the
driver.  The rounds needed grow with the logarithm of the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of longs -> (node, root), root the smallest node reachable.

    Nodes that are their own root do not appear.  Null ends, self links and
    repeated links are ignored; no links give no rows.
    """
    e = materialize(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
        "links",
    )
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, materialize(small.unionByName(near.select("u", F.col("m").alias("v"))).distinct(), "links")
        # a round that changes nothing is the last: compared row by row, as both are distinct
        same = e.join(last, ["u", "v"], "left_anti").isEmpty() and last.join(e, ["u", "v"], "left_anti").isEmpty()
        discard(last)
        if same:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
