"""Connected components of an edge table, by minimum labels with pointer jumping.

Labels are written to the shared folder after each round, so lineage stays
short; no edge, label or component reaches the driver. A vertex with very many
edges meets its label in an inner join that adaptive execution splits, and the
least label of its neighbours comes from a combining aggregation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import remove, write_table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(v, root) for every vertex of ``edges``: root is the smallest vertex of its component. Rounds grow with the logarithm of the longest chain."""
    spark = edges.sparkSession
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where(F.col("a") != F.col("b"))
    both, _ = write_table(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, path = write_table(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("root")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["v"]).groupBy("a").agg(F.min("root").alias("m"))
        lower = labels.join(near, labels["v"] == near["a"]).select("v", F.col("root").alias("was"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("v").alias("u"), F.col("root").alias("up"))
        jumped = lower.join(up, lower["root"] == up["u"], "left").select("v", "was", F.least("root", F.coalesce("up", "root")).alias("root"))
        fresh, fresh_path = write_table(jumped, "labels")
        remove(spark, path)
        labels, path = fresh.select("v", "root"), fresh_path
        if fresh.where("was <> root").isEmpty():
            return labels
