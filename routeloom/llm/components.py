"""Connected components of an edge table, by repeated exchange of least labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_root


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for each end of the undirected `edges` (a, b): root is the least id that can be reached.

    Each round a node takes the least label around it, then the label of that label, so the rounds grow with the
    logarithm of a component's diameter.  Sums, not rows, come to the driver.
    """
    checkpoint_root(edges.sparkSession)
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct().checkpoint()
    least = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least"))
    labels = least.select("id", F.least("id", "least").alias("root")).checkpoint()
    while True:
        around = both.join(labels, both.b == labels.id).groupBy(F.col("a").alias("id")).agg(F.min("root").alias("near"))
        stepped = labels.join(around, "id").select("id", "root", F.least("root", "near").alias("next"))
        jump = labels.select(F.col("id").alias("next"), F.col("root").alias("far"))
        moved = stepped.join(jump, "next").select("id", "root", F.least("next", "far").alias("now")).checkpoint()
        changed = moved.where(F.col("now") < F.col("root")).limit(1).count()
        labels = moved.select("id", F.col("now").alias("root"))
        if not changed:
            return labels
