"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.runtime import materialize


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node that occurs in a link; the component is its least node.

    Minimum labels travel over the links and every round also jumps to the label's own label,
    so the rounds grow with the logarithm of the longest chain. Minima combine before the
    shuffle, so a node with very many links costs no task more than others. Links with a null
    end are ignored; repeated links and loops change nothing; no links, no rows.
    """
    both = links.select(F.col(a).alias("src"), F.col(b).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL")
    both = materialize(both.unionByName(both.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "links")
    labels = materialize(both.groupBy(F.col("src").alias("node")).agg(F.least(F.col("node"), F.min("dst")).alias("label")), "labels")
    for _ in range(max_rounds):
        heard = both.join(labels.withColumnRenamed("node", "dst"), "dst").groupBy("src").agg(F.min("label").alias("heard"))
        closer = labels.join(heard, labels["node"] == heard["src"]).select("node", F.least("label", "heard").alias("near"), F.col("label").alias("old"))
        target = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        jumped = materialize(closer.join(target, "near").select("node", F.least("near", "far").alias("label"), "old"), "labels")
        labels = jumped.select("node", "label")
        if jumped.where("label <> old").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components not settled after {max_rounds} rounds")
