"""Connected components of an edge table, by labels that spread to neighbours and jump to their label's label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def connected_components(edges: DataFrame) -> DataFrame:
    """edges(a, b) -> (node, label): the smallest node reachable from each node.

    Each round is written to the scratch folder, and the loop ends when a round changes nothing. Labels are taken over by
    joins on a node and on a label, and by minima: of a hub's edges, and of a large component's nodes, which have the same
    key there, the joins are split by adaptive execution, and the minima are aggregated before they are shuffled. Rows
    with a null are left out; an empty table gives an empty result.
    """
    edges = edges.select(F.col("a"), F.col("b")).where("a is not null and b is not null")
    both = written(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("label").alias("then"))
        new = written(spread.join(jump, "to").select("node", F.least("to", "then").alias("label"), (F.least("to", "then") < F.col("was")).alias("moved")), "labels")
        labels = new.select("node", "label")
        if not new.where("moved").head(1):
            return labels
