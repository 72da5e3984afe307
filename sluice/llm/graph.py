"""Connected components of an edge table, without leaving the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """``edges``: (x, y) of any orderable type.  Returns (node, label), label
    being the smallest node of the component, for every node of an edge.

    Each turn takes the smallest label among a node's neighbours and then the
    label of that label, so stars are done in one turn and chains in
    logarithmically many.  Labels only fall; the turn that changes none ends.
    """
    both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    both = materialize(both, "cc-edges")
    labels = materialize(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.min("x")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("near"))
        new = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        up = labels.select(F.col("node").alias("new"), F.col("label").alias("up"))
        new = materialize(new.join(up, "new").select("node", "label", F.least("new", "up").alias("new")), "cc-labels")
        changed = new.where(F.col("new") < F.col("label")).limit(1).count()
        labels = new.select("node", F.col("new").alias("label"))
        if not changed:
            return labels
