"""Scene queries: reflectance, masks, medians over dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scenes as O
from ..sources.tables import SQL_SCENES as S
from ..sources.tables import scenes

Q: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


REF = f"WITH {S}, ref AS (SELECT pixel, scene, event_id, scl, (red - 1000) / 10000.0 AS red, (nir - 1000) / 10000.0 AS nir, (swir1 - 1000) / 10000.0 AS swir1, (swir2 - 1000) / 10000.0 AS swir2 FROM obs), " """
idx AS (SELECT *, CASE WHEN nir + red <> 0 THEN (nir - red) / (nir + red) END AS ndvi, CASE WHEN swir1 + swir2 <> 0 THEN (swir1 - swir2) / (swir1 + swir2) END AS nbr2 FROM ref),
m AS (SELECT *, coalesce(ndvi > -0.05 AND ndvi < 0.25 AND nbr2 > -0.15 AND nbr2 < 0.10, false) AS strict, coalesce(ndvi > -0.05 AND ndvi < 0.35 AND nbr2 > -0.15 AND nbr2 < 0.20, false) AS loose FROM idx)"""


def indexed(spark, d):
    o = scenes(spark, d)
    for b in ("red", "nir", "swir1", "swir2"):
        o = o.withColumn(b, O.reflectance(F.col(b)))
    o = o.withColumn("ndvi", O.index(F.col("nir"), F.col("red"))).withColumn("nbr2", O.index(F.col("swir1"), F.col("swir2")))
    return o.withColumn("strict", O.bare(F.col("ndvi"), F.col("nbr2"), *O.STRICT)).withColumn("loose", O.bare(F.col("ndvi"), F.col("nbr2"), *O.LOOSE))


@register("reflectance", REF + " SELECT event_id, round(red, 6) AS red, round(nir, 6) AS nir FROM ref")
def reflectance(spark, d):
    return indexed(spark, d).select("event_id", F.round("red", 6).alias("red"), F.round("nir", 6).alias("nir"))


@register("indices_masks", REF + " SELECT event_id, round(ndvi, 6) AS ndvi, round(nbr2, 6) AS nbr2, strict, loose FROM m")
def indices_masks(spark, d):
    return indexed(spark, d).select("event_id", F.round("ndvi", 6).alias("ndvi"), F.round("nbr2", 6).alias("nbr2"), "strict", "loose")


@register("clear_mask", REF + " SELECT a.event_id FROM m a WHERE a.scl IN (2, 4, 5, 7) AND NOT EXISTS (SELECT 1 FROM m b WHERE b.scene = a.scene AND b.scl IN (3, 8, 9, 10) AND abs(b.pixel - a.pixel) <= 1)")
def clear_mask(spark, d):
    """Kept classes that no cloud of the same scene lies next to."""
    o = indexed(spark, d)
    cloud = o.filter(F.col("scl").isin(3, 8, 9, 10)).select("scene", F.explode(F.sequence(F.col("pixel") - 1, F.col("pixel") + 1)).alias("pixel")).distinct()
    return o.filter(F.col("scl").isin(*O.CLEAR)).join(cloud, ["scene", "pixel"], "left_anti").select("event_id")


@register("scene_medians", REF + " SELECT strftime(scene, '%Y-%m-%d') AS scene, round(quantile_cont(red, 0.5), 6) AS vis_median, CAST(count(*) AS BIGINT) AS strict_px FROM m WHERE strict GROUP BY scene HAVING count(*) > 10")
def scene_medians(spark, d):
    g = indexed(spark, d).filter("strict").groupBy("scene").agg(F.round(F.median("red"), 6).alias("vis_median"), F.count(F.lit(1)).alias("strict_px"))
    return g.filter("strict_px > 10").select(F.date_format("scene", "yyyy-MM-dd").alias("scene"), "vis_median", "strict_px")


@register("masked_median_composite", REF + " SELECT pixel, CAST(count(*) FILTER (loose AND scl <> 9) AS BIGINT) AS n, CASE WHEN count(*) FILTER (loose AND scl <> 9) >= 3 THEN round(quantile_cont(red, 0.5) FILTER (loose AND scl <> 9), 6) END AS red, CASE WHEN count(*) FILTER (loose AND scl <> 9) >= 3 THEN round(quantile_cont(nir, 0.5) FILTER (loose AND scl <> 9), 6) END AS nir FROM m GROUP BY pixel")
def masked_median_composite(spark, d):
    out = O.composite(indexed(spark, d), ["pixel"], F.col("loose") & (F.col("scl") != 9), 3, "red", "nir")
    return out.select("pixel", "n", F.round("red", 6).alias("red"), F.round("nir", 6).alias("nir"))


@register("vis_norm", REF + ", sm AS (SELECT scene, quantile_cont(red, 0.5) AS med FROM m WHERE strict GROUP BY scene HAVING count(*) > 10) SELECT pixel, round(quantile_cont(red / med, 0.5), 6) AS vis_norm, CAST(count(*) AS BIGINT) AS n FROM m JOIN sm USING (scene) WHERE loose AND med <> 0 GROUP BY pixel HAVING count(*) >= 3")
def vis_norm(spark, d):
    """Brightness over the scene's own median, then the median over dates."""
    o = indexed(spark, d)
    med = o.filter("strict").groupBy("scene").agg(F.median("red").alias("med"), F.count(F.lit(1)).alias("k")).filter("k > 10 AND med <> 0").select("scene", "med")
    g = o.filter("loose").join(med, "scene").groupBy("pixel").agg(F.round(F.median(F.col("red") / F.col("med")), 6).alias("vis_norm"), F.count(F.lit(1)).alias("n"))
    return g.filter("n >= 3")


@register("scene_filter", REF + ", k AS (SELECT scene FROM m WHERE strict GROUP BY scene HAVING count(*) > 20) SELECT event_id FROM m WHERE loose AND scene IN (SELECT scene FROM k)")
def scene_filter(spark, d):
    """Observations of scenes with enough bare pixels."""
    o = indexed(spark, d)
    good = o.filter("strict").groupBy("scene").count().filter("count > 20").select("scene")
    return o.filter("loose").join(good, "scene", "left_semi").select("event_id")
