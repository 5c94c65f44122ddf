"""Masked compositing of scene stacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reflectance(dn: Column) -> Column:
    """(dn - 1000) / 10000; 0 means no data."""
    return F.when(dn != 0, (dn - 1000) / 10000.0)


def index(a: Column, b: Column) -> Column:
    """(a - b) / (a + b); NULL where the sum is 0."""
    return F.try_divide(a - b, a + b)


def bare(ndvi: Column, nbr2: Column, ndvi_cap: float, nbr2_cap: float) -> Column:
    """Open limits below the caps; NULL is not bare."""
    return F.coalesce((ndvi > -0.05) & (ndvi < ndvi_cap) & (nbr2 > -0.15) & (nbr2 < nbr2_cap), F.lit(False))


STRICT, LOOSE = (0.25, 0.10), (0.35, 0.20)
CLEAR = (2, 4, 5, 7)


def composite(obs: DataFrame, pixel: list[str], valid: Column, least: int, *bands: str) -> DataFrame:
    """Per pixel the medians of the bands over valid observations, NULL under `least`
    of them, and their number n."""
    g = obs.withColumn("ok", valid).groupBy(*pixel).agg(F.count_if("ok").alias("n"), *[F.median(F.when(F.col("ok"), F.col(b))).alias(b) for b in bands])
    return g.select(*pixel, "n", *[F.when(F.col("n") >= least, F.col(b)).alias(b) for b in bands])
