"""Four-connected components of mask cells.

Runs of cells along rows come first (one window), so that a component is a graph of
runs; labels then spread between runs of rows next to each other, and each round
halves the way by following labels. Lineage is cut by checkpoints.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ensure_checkpoints(spark) -> None:
    """Checkpoints go to the folder of the session; to a temporary one where none is
    set and the executors are threads of this machine."""
    if spark.sparkContext.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(shared or tempfile.mkdtemp(prefix="loamgrid-"))


def labelled(mask: DataFrame, width: int, rounds: int = 200) -> DataFrame:
    """mask: cells (r, c). Adds label: the least r * width + c of the component."""
    ensure_checkpoints(mask.sparkSession)
    line = Window.partitionBy("r").orderBy("c")
    runs = mask.select("r", "c").withColumn("new", (F.col("c") - F.coalesce(F.lag("c").over(line), F.lit(-2)) > 1).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(line))
    cells = runs.withColumn("node", F.min(F.col("r") * width + F.col("c")).over(Window.partitionBy("r", "run"))).select("r", "c", "node").checkpoint()
    above = cells.select((F.col("r") + 1).alias("r"), "c", F.col("node").alias("other"))
    touch = cells.join(above, ["r", "c"]).select("node", "other").distinct()
    edges = touch.union(touch.select("other", "node")).checkpoint()
    labels = cells.select("node").distinct().withColumn("label", F.col("node")).checkpoint()
    for _ in range(rounds):
        near = edges.join(labels.select(F.col("node").alias("other"), "label"), "other").groupBy("node").agg(F.min("label").alias("near"))
        lower = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = lower.join(up, "label").select("node", "old", F.least("label", "next").alias("label")).checkpoint()
        labels = new.select("node", "label")
        if not new.filter("label <> old").limit(1).count():
            return cells.join(labels, "node").select("r", "c", "label")
    raise RuntimeError("components didn't settle")
