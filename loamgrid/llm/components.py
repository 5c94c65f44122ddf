"""Connected components of an edge table, without collecting it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges: (a long, b long). Rows (node, label) for every node of an edge; label
    is a node of its component, the same for all.

    Each round every node hangs on its neighbour of the least hash, or on itself, and
    the graph is contracted to what nodes hang on; hashes are a random order, so a
    path of any names loses a part of its nodes each round. When no edge is left the
    labels are taken back through the rounds. Minima are combined before the shuffle,
    so a node of many edges costs one row per task."""
    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    levels = []
    for _ in range(rounds):
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("near")), F.struct(F.col("b").alias("node"), F.col("a").alias("near")))).alias("x")).select("x.node", "x.near")
        near = ends.groupBy("node").agg(F.min_by("near", F.xxhash64("near")).alias("near"))
        hung = checkpointed(near.select("node", F.when(F.xxhash64("near") < F.xxhash64("node"), F.col("near")).otherwise(F.col("node")).alias("up")))
        levels.append(hung)
        side = lambda c: hung.select(F.col("node").alias(c), F.col("up").alias(f"up_{c}"))
        left = edges.join(side("a"), "a").join(side("b"), "b").filter("up_a <> up_b")
        edges = checkpointed(left.select(F.greatest("up_a", "up_b").alias("a"), F.least("up_a", "up_b").alias("b")).distinct())
        if not edges.count():
            break
    else:
        raise RuntimeError("components didn't settle")
    labels = levels.pop().select("node", F.col("up").alias("label"))
    for hung in reversed(levels):
        known = labels.select(F.col("node").alias("up"), "label")
        labels = hung.join(known, "up", "left").select("node", F.coalesce("label", "up").alias("label"))
    return checkpointed(labels)
