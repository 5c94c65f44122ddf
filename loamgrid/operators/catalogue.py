"""Segmentation of a text catalogue into blocks, and name resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """One row per line: (key, n, line)."""
    return docs.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("n", "line")).withColumn("n", F.col("n").cast("long"))


def carried(rows: DataFrame, key: str, order: str, header: Column, name: str) -> DataFrame:
    """The last header so far on every row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(header, ignorenulls=True).over(w))


def blocks(rows: DataFrame, key: str, order: str, starts: Column) -> DataFrame:
    """Adds block: the number of the block that a row belongs to (0: before the first)."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("block", F.sum(F.when(starts, 1).otherwise(0)).over(w))


def resolve(entries: DataFrame, candidates: DataFrame, steps: list[tuple[str, Column]], n: str | None = None) -> DataFrame:
    """Names to places: (entry, place, how).

    entries (entry, ...), candidates (entry, place, ...): those of equal name. No
    candidate: not_found; one: unique. Else each step narrows the candidates to those
    that meet its condition, unless none does; the step that leaves one gives `how`.
    What is left: ambiguous, the first place. A row of candidates may stand for `n` of
    them that meet the same conditions, with the first place of these."""
    per = Window.partitionBy("entry")
    one = F.sum(F.lit(1) if n is None else F.col(n)).over(per) == 1
    left = candidates.withColumn("how", F.when(one, "unique"))
    for name, condition in steps:
        ok = F.coalesce(condition, F.lit(False))
        left = left.withColumn("ok", ok).withColumn("any", F.max("ok").over(per))
        left = left.filter(F.col("how").isNotNull() | F.col("ok") | ~F.col("any")).drop("ok", "any")
        left = left.withColumn("how", F.coalesce("how", F.when(one, name)))
    first = left.groupBy("entry").agg(F.min(F.struct("place", "how")).alias("m")).select("entry", "m.place", F.coalesce("m.how", F.lit("ambiguous")).alias("how"))
    return entries.select("entry").join(first, "entry", "left").withColumn("how", F.coalesce("how", F.lit("not_found")))
