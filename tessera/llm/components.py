"""Connected components of an edge table, by repeated contraction.  Nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import durable, hand_on, release, scope


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes without an edge do not appear.

    Each round, every node points to the neighbour of the least hashed id (or stays), and edges are
    contracted along the pointers.  Hashed order makes long sorted chains shrink by a constant factor,
    so the number of rounds follows the logarithm of the number of nodes.  Round tables go to the shared
    folder, and a hub costs one row per neighbour, summed before the shuffle.  Null ends and loops are dropped.
    What a round has read is released after it, so that neither disk nor the driver keeps all rounds.
    """
    spark = edges.sparkSession
    e = edges.select(F.least(a, b).cast("long").alias("u"), F.greatest(a, b).cast("long").alias("v")).where("u < v").distinct()
    with scope() as last:
        e = durable(e, "edges")
    labels = None
    while not e.isEmpty():
        with scope() as made:
            labels, e = _contracted(labels, e)
        release(spark, last + made[:-2])
        last = made[-2:]  # labels and edges
    hand_on(last)
    if labels is None:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    least = labels.groupBy("label").agg(F.min("node").alias("component"))
    return labels.join(least, "label").select("node", "component")


def _contracted(labels: DataFrame | None, e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A round: labels (node, label) moved along the pointers, and the contracted edges; these are the last two tables written."""
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    near = both.withColumn("h", F.xxhash64("v")).groupBy("u").agg(F.min("h").alias("h"), F.min_by("v", "h").alias("m"))
    step = durable(near.select(F.col("u").alias("from"), F.when(F.col("h") < F.xxhash64("u"), F.col("m")).otherwise(F.col("u")).alias("to")), "pointers")
    far = step.select(F.col("from").alias("to"), F.col("to").alias("to2"))
    step = step.join(far, "to", "left").select("from", F.coalesce("to2", "to").alias("to"))
    step = durable(step, "pointers")
    if labels is None:
        labels = step.select(F.col("from").alias("node"), F.col("to").alias("label"))
    else:
        labels = labels.join(step, F.col("label") == F.col("from"), "left").select("node", F.coalesce("to", "label").alias("label"))
    labels = durable(labels, "labels")
    to = step.select(F.col("from").alias("v"), F.col("to").alias("v2"))
    e = e.join(step.withColumnRenamed("from", "u"), "u").select("v", F.col("to").alias("u2")).join(to, "v")
    return labels, durable(e.select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).where("u < v").distinct(), "edges")
