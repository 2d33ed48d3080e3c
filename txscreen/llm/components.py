"""Connected components of a table of links."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txscreen.sources import materialize


def connected(links: DataFrame) -> DataFrame:
    """node and component, the smallest node it is connected with, for linked nodes.

    ``links`` has the columns a and b, neither null. Labels move along links to
    the smaller one and then jump to their own label, so the number of rounds
    grows with the logarithm of the longest path. Each round is stored; a node
    with many links is summed up map-side, and its join is one Spark can split.
    """
    # A loop at every node keeps its own label in the running.
    ends = [("a", "b"), ("b", "a"), ("a", "a"), ("b", "b")]
    pairs = [F.struct(F.col(x).alias("node"), F.col(y).alias("other")) for x, y in ends]
    both = links.select(F.explode(F.array(*pairs)).alias("end")).select("end.*").distinct()
    edges = materialize(both, "edges")
    labels = materialize(
        edges.groupBy("node").agg(F.min("other").alias("component")), "labels"
    )
    while True:
        known = labels.select(F.col("node").alias("other"), "component")
        near = edges.join(known, "other").groupBy("node").agg(F.min("component").alias("near"))
        jump = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        moved = near.join(jump, "near", "left").join(labels, "node")
        moved = moved.select(
            "node",
            F.least("near", "far").alias("component"),
            (F.least("near", "far") < F.col("component")).alias("moved"),
        )
        moved = materialize(moved, "labels")
        labels = moved.select("node", "component")
        if moved.filter("moved").isEmpty():
            return labels
