"""Connected components of a graph given by its edges, without gathering anything at the driver or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import materialize, release


def components(edges: DataFrame) -> DataFrame:
    """(id, label): for every node of edges (a long, b long), the smallest node that it is connected to.

    Rounds of taking the smallest neighbouring label and then the label's label, so chains shorten by halves. Each round is
    written to the shared folder. The aggregates combine before they shuffle, so a node with very many edges is no bottleneck.
    No edges: an empty result.
    """
    both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
    both = materialize(both.where("a <> b").distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("label").alias("near"))
        own = labels.join(near, labels["id"] == near["a"]).select("id", "label", F.least("label", "near").alias("low"))
        up = labels.select(F.col("id").alias("up"), F.col("label").alias("upper"))
        new = own.join(up, own["low"] == up["up"]).select("id", F.least("low", "upper").alias("label"), (F.least("low", "upper") < F.col("label")).alias("moved"))
        new = materialize(new, "labels")
        moved = new.where("moved").limit(1).count()
        release(labels.sparkSession, labels)
        labels = new.select("id", "label")
        if not moved:
            return labels
