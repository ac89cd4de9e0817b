"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skeinspark.shared import materialize


def components(links: DataFrame) -> DataFrame:
    """links: a, b. Gives node, root: the smallest node that can be reached, for every node that has a link.

    Each round takes the smallest root among the neighbours, then the root's own root. A round is written to the shared folder,
    so that lost executors cost one round at most. Aggregation of a node's neighbours starts map-side, and the joins leave
    skewed sides to adaptive execution.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct())
    now = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("root")))
    while True:
        near = both.join(now, F.col("b") == F.col("node")).groupBy("a").agg(F.min("root").alias("near"))
        new = now.join(near, F.col("node") == F.col("a"), "left").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        up = now.select(F.col("node").alias("above"), F.col("root").alias("top"))
        new = materialize(new.join(up, F.col("root") == F.col("above"), "left").select("node", "old", F.least("root", "top").alias("root")))
        done = new.filter("old <> root").isEmpty()
        now = new.select("node", "root")
        if done:
            return now
