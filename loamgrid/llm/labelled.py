"""A bounded sample of labelled documents, for the two classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label_col: str, keep_id, limit: int, seed: int = 11) -> DataFrame:
    """Rows (id, text, label) of at most limit documents: those with the lowest
    hash of their id among the labelled ones for which keep_id(id column) holds.

    The sample doesn't depend on partitions. Null ids and null labels are left
    out; of several labels the highest holds; of equal texts with one label only
    one stays, so that a group of copies weighs as one document."""
    known = labels.select(F.col("doc_id").alias("id"), F.col(label_col).cast("int").alias("label")).filter("id IS NOT NULL AND label IS NOT NULL")
    known = known.filter(keep_id(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    known = known.withColumn("draw", F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)))
    n = known.count()
    if n > 2 * limit:  # thin before the sort; the limit then holds exactly
        known = known.filter(F.col("draw") < int((1 << 40) * 2 * limit / n))
    chosen = known.orderBy("draw", "id").limit(limit).select("id", "label")
    text = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.join(F.broadcast(chosen), "id").dropDuplicates(["text", "label"])
