"""Exact Euclidean distances to feature cells, up to a cap.

Along columns the nearest feature above and below is carried on; along rows each
cell that has one within the cap tells the cells that it can reach. The least is
taken per cell, combined before the shuffle. Work per cell is bounded by the cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .focal import banded


def nearest(cells: DataFrame, feature: str, cap: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """cells (r, c, ..., feature boolean) with d2 (squared distance in cells; NULL
    beyond the cap), and nr, nc and the carried columns of the nearest feature;
    ties go to the least (d2, nr, nc)."""
    slim = cells.select("r", "c", F.when(F.col(feature), F.struct(F.col("r").alias("nr"), *carry)).alias("own"))
    copies, _ = banded(slim, "c", "r", cap)
    line = Window.partitionBy("c", "band").orderBy("r")
    above = F.last("own", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    below = F.first("own", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    both = copies.withColumn("above", above).withColumn("below", below).filter("home")
    told = both.select("r", F.col("c").alias("nc"), F.explode(F.array("above", "below")).alias("near")).filter("near IS NOT NULL")
    told = told.withColumn("g", (F.col("r") - F.col("near.nr")) * (F.col("r") - F.col("near.nr"))).filter(F.col("g") <= cap * cap)
    reach = F.floor(F.sqrt(F.lit(cap * cap) - F.col("g"))).cast("long")
    told = told.withColumn("c", F.explode(F.sequence(F.col("nc") - reach, F.col("nc") + reach)))
    key = F.struct(((F.col("c") - F.col("nc")) * (F.col("c") - F.col("nc")) + F.col("g")).alias("d2"), F.col("near.nr").alias("nr"), F.col("nc"), *[F.col(f"near.{x}").alias(x) for x in carry])
    least = told.groupBy("r", "c").agg(F.min(key).alias("near"))
    found = least.select("r", "c", "near.d2", "near.nr", "near.nc", *[F.col(f"near.{x}").alias(f"near_{x}") for x in carry])
    return cells.join(found, ["r", "c"], "left")
