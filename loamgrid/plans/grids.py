"""Grid queries: focal filters, distances, components, terrain, flow."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import components, distance, focal, raster
from ..sources import tables as S
from ..sources.tables import SQL_GRID as G
from ..sources.tables import WIDTH

Q: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def shape(spark, d) -> tuple[int, int]:
    return S.rows_of_grid(spark, d), WIDTH


#: A box around a cell in SQL; %s: reach in rows and columns.
def around(k: int, j: int | None = None) -> str:
    j = k if j is None else j
    return f"b.r BETWEEN a.r - {k} AND a.r + {k} AND b.c BETWEEN a.c - {j} AND a.c + {j}"


def offsets(k: int, j: int) -> str:
    return f"(SELECT unnest(range(-{k}, {k} + 1)) AS dr) o1, (SELECT unnest(range(-{j}, {j} + 1)) AS dc) o2"


REFLECT = "CASE WHEN {x} < 0 THEN -({x}) - 1 WHEN {x} >= {n} THEN 2 * {n} - 1 - ({x}) ELSE {x} END"


@register(
    "grid_bounds_snap",
    f"""WITH {S.SQL_POINTS} SELECT CAST(floor(min(x) / 200.0) * 200 AS BIGINT) AS x0, CAST(floor(min(y) / 200.0) * 200 AS BIGINT) AS y0,
    CAST((floor(max(x) / 200.0) + 1) * 200 AS BIGINT) AS x1, CAST((floor(max(y) / 200.0) + 1) * 200 AS BIGINT) AS y1 FROM places""",
)
def grid_bounds_snap(spark, d):
    low = lambda v: (F.floor(F.min(v) / 200) * 200).cast("long")
    high = lambda v: ((F.floor(F.max(v) / 200) + 1) * 200).cast("long")
    return S.points(spark, d).agg(low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))


@register("focal_mean_null_aware", f"WITH {G} SELECT a.r, a.c, round(sum(b.v) / count(b.v), 6) AS mean FROM cells a JOIN cells b ON {around(8)} WHERE b.v IS NOT NULL GROUP BY a.r, a.c")
def focal_mean_null_aware(spark, d):
    g = focal.box(S.grid(spark, d), "v", 8, 8)
    return g.filter("count > 0").select("r", "c", F.round(F.col("total") / F.col("count"), 6).alias("mean"))


@register(
    "focal_mean_constant_edge",
    f"""WITH {G} SELECT a.r, a.c, round(sum(b.v) / count(b.v), 6) AS mean, round(count(b.v) / 121.0, 6) AS cover FROM cells a JOIN cells b ON {around(5)} WHERE b.v IS NOT NULL
    GROUP BY a.r, a.c HAVING count(b.v) / 121.0 >= 0.3""",
)
def focal_mean_constant_edge(spark, d):
    cover = F.col("count") / 121.0
    return focal.box(S.grid(spark, d), "v", 5, 5).filter(cover >= 0.3).select("r", "c", F.round(F.col("total") / F.col("count"), 6).alias("mean"), F.round(cover, 6).alias("cover"))


@register(
    "focal_mean_reflect",
    f"""WITH {G}, w AS (SELECT r, c, z, r + dr AS y, c + dc AS x FROM cells, {offsets(4, 4)})
    SELECT w.r, w.c, round(any_value(w.z) - avg(b.z), 6) AS tpi FROM w, dims, cells b WHERE b.r = {REFLECT.format(x="w.y", n="dims.nr")} AND b.c = {REFLECT.format(x="w.x", n="dims.nc")} GROUP BY w.r, w.c""",
)
def focal_mean_reflect(spark, d):
    """Height above the mean of its surroundings."""
    g = focal.box(S.frame(spark, d), "z", 4, 4, shape(spark, d), "reflect")
    return g.select("r", "c", F.round(F.col("z") - F.col("total") / F.col("count"), 6).alias("tpi"))


@register(
    "focal_zone_nearest_edge",
    f"""WITH {G}, w AS (SELECT r, c, r + dr AS y, c + dc AS x FROM cells, {offsets(2, 4)})
    SELECT w.r, w.c, round(sum(b.v) / count(b.v), 6) AS mean FROM w, dims, cells b WHERE b.r = least(greatest(w.y, 0), dims.nr - 1) AND b.c = least(greatest(w.x, 0), dims.nc - 1)
    GROUP BY w.r, w.c HAVING count(b.v) / 45.0 > 0.2""",
)
def focal_zone_nearest_edge(spark, d):
    """Resource-zone mean on cells twice as high as wide."""
    g = focal.box(S.grid(spark, d), "v", 2, 4, shape(spark, d), "nearest")
    return g.filter(F.col("count") / 45.0 > 0.2).select("r", "c", F.round(F.col("total") / F.col("count"), 6).alias("mean"))


@register("focal_min", f"WITH {G} SELECT a.r, a.c, min(b.v) AS low FROM cells a JOIN cells b ON {around(8)} WHERE b.v IS NOT NULL GROUP BY a.r, a.c")
def focal_min(spark, d):
    return focal.extreme(S.grid(spark, d), "v", 8, "min").filter("extreme IS NOT NULL").select("r", "c", F.col("extreme").alias("low"))


@register("focal_max", f"WITH {G} SELECT a.r, a.c, max(b.v) AS high FROM cells a JOIN cells b ON {around(8)} WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY a.r, a.c")
def focal_max(spark, d):
    """Greatest value around cells that have one themselves."""
    return focal.extreme(S.grid(spark, d), "v", 8, "max").filter("v IS NOT NULL").select("r", "c", F.col("extreme").alias("high"))


@register("disk_min", f"WITH {G} SELECT a.r, a.c, a.z - min(b.z) AS relative FROM cells a JOIN cells b ON {around(4)} AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 16 GROUP BY a.r, a.c, a.z")
def disk_min(spark, d):
    """Height above the lowest cell of a disk: rows of the disk are windows of their
    own half-width."""
    cells = S.frame(spark, d)
    out = None
    for dr in range(-4, 5):
        half = int((16 - dr * dr) ** 0.5)
        line = focal.along(cells.select("r", "c", "z"), "r", "c", half, low=F.min("z")).select((F.col("r") - dr).alias("r"), "c", "low")
        out = line if out is None else out.unionByName(line)
    low = out.groupBy("r", "c").agg(F.min("low").alias("low"))
    return cells.join(low, ["r", "c"]).select("r", "c", (F.col("z") - F.col("low")).alias("relative"))


@register(
    "majority_smooth",
    f"""WITH {G}, w AS (SELECT r, c, r + dr AS y, c + dc AS x FROM cells, {offsets(1, 1)})
    SELECT w.r, w.c FROM w, dims, cells b WHERE b.r = least(greatest(w.y, 0), dims.nr - 1) AND b.c = least(greatest(w.x, 0), dims.nc - 1)
    GROUP BY w.r, w.c HAVING avg(CASE WHEN b.v > 40 THEN 1 ELSE 0 END) > 0.25""",
)
def majority_smooth(spark, d):
    g = S.grid(spark, d).withColumn("m", F.when(F.col("v") > 40, 1).otherwise(0))
    return focal.box(g, "m", 1, 1, shape(spark, d), "nearest").filter(F.col("total") / F.col("count") > 0.25).select("r", "c")


@register(
    "median5x5",
    f"""WITH {G}, w AS (SELECT r, c, r + dr AS y, c + dc AS x FROM cells, {offsets(2, 2)})
    SELECT w.r, w.c, CAST(quantile_cont(b.z, 0.5) AS DOUBLE) AS med FROM w, dims, cells b WHERE b.r = {REFLECT.format(x="w.y", n="dims.nr")} AND b.c = {REFLECT.format(x="w.x", n="dims.nc")} GROUP BY w.r, w.c""",
)
def median5x5(spark, d):
    return focal.window_median(S.frame(spark, d), "z", 2, shape(spark, d)).select("r", "c", F.col("median").alias("med"))


@register("dilate_l1", f"WITH {G} SELECT a.r, a.c FROM cells a WHERE EXISTS (SELECT 1 FROM cells b WHERE b.v > 150 AND abs(a.r - b.r) + abs(a.c - b.c) <= 5)")
def dilate_l1(spark, d):
    g = S.grid(spark, d)
    return focal.dilated(g.filter("v > 150"), 5).join(g.select("r", "c"), ["r", "c"], "left_semi")


@register(
    "anomaly_small_large",
    f"""WITH {G}, s AS (SELECT a.r, a.c, sum(b.v) / count(b.v) AS m FROM cells a JOIN cells b ON {around(3)} WHERE b.v IS NOT NULL GROUP BY a.r, a.c HAVING count(b.v) / 49.0 >= 0.3),
    l AS (SELECT a.r, a.c, sum(b.v) / count(b.v) AS m FROM cells a JOIN cells b ON {around(9)} WHERE b.v IS NOT NULL GROUP BY a.r, a.c HAVING count(b.v) / 361.0 >= 0.2)
    SELECT s.r, s.c, round(s.m - l.m, 6) AS anomaly FROM s JOIN l ON s.r = l.r AND s.c = l.c""",
)
def anomaly_small_large(spark, d):
    g = S.grid(spark, d)

    def mean(reach, share, name):
        return focal.box(g, "v", reach, reach).filter(F.col("count") / float((2 * reach + 1) ** 2) >= share).select("r", "c", (F.col("total") / F.col("count")).alias(name))

    return mean(3, 0.3, "s").join(mean(9, 0.2, "l"), ["r", "c"]).select("r", "c", F.round(F.col("s") - F.col("l"), 6).alias("anomaly"))


@register(
    "edt_distance",
    f"""WITH {G} SELECT a.r, a.c, min((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) AS d2 FROM cells a, cells b WHERE b.v > 200
    AND b.r BETWEEN a.r - 20 AND a.r + 20 AND b.c BETWEEN a.c - 20 AND a.c + 20 AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 400 GROUP BY a.r, a.c""",
)
def edt_distance(spark, d):
    g = S.grid(spark, d).withColumn("on", F.coalesce(F.col("v") > 200, F.lit(False)))
    return distance.nearest(g, "on", 20).filter("d2 IS NOT NULL").select("r", "c", "d2")


@register(
    "edt_nearest_value",
    f"""WITH {G} SELECT r, c, hand FROM (SELECT a.r, a.c, a.z - b.z AS hand, row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c), b.r, b.c) AS k
    FROM cells a, cells b WHERE b.v > 200 AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 225) WHERE k = 1""",
)
def edt_nearest_value(spark, d):
    """Height above the nearest feature cell."""
    g = S.grid(spark, d).withColumn("on", F.coalesce(F.col("v") > 200, F.lit(False)))
    return distance.nearest(g, "on", 15, ("z",)).filter("d2 IS NOT NULL").select("r", "c", (F.col("z") - F.col("near_z")).alias("hand"))


@register(
    "edt_capped",
    f"""WITH {G} SELECT a.r, a.c, round(coalesce(least(min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) * 30, 300.0), 300.0), 6) AS dist
    FROM cells a LEFT JOIN (SELECT * FROM cells WHERE v > 200) b ON {around(10)} GROUP BY a.r, a.c""",
)
def edt_capped(spark, d):
    g = S.grid(spark, d).withColumn("on", F.coalesce(F.col("v") > 200, F.lit(False)))
    return distance.nearest(g, "on", 10).select("r", "c", F.round(F.coalesce(F.least(F.sqrt("d2") * 30, F.lit(300.0)), F.lit(300.0)), 6).alias("dist"))


FAR = 51


@register(
    "far_zone_counts",
    f"""WITH {G}, s AS (SELECT r, c FROM cells WHERE v > 200 OR (r // 10 * 10 + c // 10 * 10) % 170 = 160),
    n AS (SELECT a.r, a.c, min((a.r - s.r) * (a.r - s.r) + (a.c - s.c) * (a.c - s.c)) AS d2 FROM cells a, s WHERE (a.r - 75) * (a.r - 75) + (a.c - 100) * (a.c - 100) <= 10000 GROUP BY a.r, a.c)
    SELECT CAST(km AS BIGINT) AS km, CAST(count(*) AS BIGINT) AS cells, round(count(*) * 0.04, 6) AS km2 FROM n, (SELECT unnest(range(1, 11)) AS km) k WHERE d2 > km * km * 4 GROUP BY km""",
)
def far_zone_counts(spark, d):
    """Area of a country farther than so many km from the edge of any settlement, in
    one pass for all distances: cells of 500 m, settlements from points and blocks."""
    country = (F.col("r") - 75) * (F.col("r") - 75) + (F.col("c") - 100) * (F.col("c") - 100) <= 10000
    built = F.expr("pmod(r div 10 * 10 + c div 10 * 10, 170) = 160")
    g = S.grid(spark, d).withColumn("on", F.coalesce(F.col("v") > 200, F.lit(False)) | built)
    # no zone needs to know more than that a cell is beyond the farthest
    far = distance.nearest(g, "on", 21).filter(country).withColumn("d2", F.coalesce("d2", F.lit(1 << 40)))
    zones = far.select(F.explode(F.sequence(F.lit(1), F.least(F.lit(10), F.ceil(F.sqrt("d2") / 2).cast("int") + 1))).alias("km"), "d2").filter(F.col("d2") > F.col("km") * F.col("km") * 4)
    return zones.groupBy(F.col("km").cast("long").alias("km")).agg(F.count(F.lit(1)).alias("cells")).withColumn("km2", F.round(F.col("cells") * 0.04, 6))


GRADIENT = f"""WITH {G}, dg AS MATERIALIZED (SELECT a.r, a.c, (h.z - l.z) / (CASE WHEN a.r = 0 OR a.r = nr - 1 THEN 1.0 ELSE 2.0 END * 30.0) AS dr, (e.z - w.z) / (CASE WHEN a.c = 0 OR a.c = nc - 1 THEN 1.0 ELSE 2.0 END * 30.0) AS dc
  FROM cells a, dims, cells h, cells l, cells e, cells w WHERE h.c = a.c AND h.r = least(a.r + 1, nr - 1) AND l.c = a.c AND l.r = greatest(a.r - 1, 0) AND e.r = a.r AND e.c = least(a.c + 1, nc - 1) AND w.r = a.r AND w.c = greatest(a.c - 1, 0)),
  sl AS (SELECT r, c, dr, dc, degrees(atan(sqrt(dr * dr + dc * dc))) AS slope FROM dg)"""


def slopes(spark, d):
    g = focal.gradient(S.frame(spark, d), "z", 30.0, shape(spark, d))
    return g.withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("d_r") * F.col("d_r") + F.col("d_c") * F.col("d_c")))))


def aspect():
    """Degrees clockwise from north that a slope faces; rows grow southward."""
    angle = F.degrees(F.atan2(-F.col("d_c"), F.col("d_r")))
    return F.when(F.col("slope") < 0.5, F.lit(-1.0)).otherwise(F.when(angle < 0, angle + 360).otherwise(angle))


ASPECT = "CASE WHEN slope < 0.5 THEN -1.0 WHEN atan2(-dc, dr) < 0 THEN degrees(atan2(-dc, dr)) + 360 ELSE degrees(atan2(-dc, dr)) END"


@register("gradient_slope_aspect", f"{GRADIENT} SELECT r, c, round(slope, 6) AS slope, round({ASPECT}, 6) AS aspect FROM sl")
def gradient_slope_aspect(spark, d):
    return slopes(spark, d).select("r", "c", F.round("slope", 6).alias("slope"), F.round(aspect(), 6).alias("aspect"))


@register("northness_eastness", f"{GRADIENT} SELECT r, c, round(cos(radians({ASPECT})) * sin(radians(slope)), 6) AS northness, round(sin(radians({ASPECT})) * sin(radians(slope)), 6) AS eastness FROM sl")
def northness_eastness(spark, d):
    """The flat mark of -1 is used as an angle, as the products do."""
    s = F.sin(F.radians("slope"))
    return slopes(spark, d).select("r", "c", F.round(F.cos(F.radians(aspect())) * s, 6).alias("northness"), F.round(F.sin(F.radians(aspect())) * s, 6).alias("eastness"))


@register(
    "hillshade",
    f"{GRADIENT} SELECT r, c, round(greatest((sin(radians(45)) + cos(radians(45)) * (dc * 3 * sin(radians(315 - 180)) - dr * 3 * cos(radians(315 - 180)))) / sqrt(1 + 9 * (dr * dr + dc * dc)), 0), 5) AS shade FROM sl",
)
def hillshade(spark, d):
    """Light from 315 degrees at 45 degrees, heights threefold."""
    lit = F.sin(F.radians(F.lit(45))) + F.cos(F.radians(F.lit(45))) * (F.col("d_c") * 3 * F.sin(F.radians(F.lit(135))) - F.col("d_r") * 3 * F.cos(F.radians(F.lit(135))))
    shade = lit / F.sqrt(1 + 9 * (F.col("d_r") * F.col("d_r") + F.col("d_c") * F.col("d_c")))
    return slopes(spark, d).select("r", "c", F.round(F.greatest(shade, F.lit(0.0)), 5).alias("shade"))


CHANNEL = "b.acc >= 195"


@register(
    "sunny_side",
    f"""WITH {G} SELECT r, c, round(CASE WHEN d2 = 0 THEN 0 ELSE (br - r) / sqrt(d2) END, 6) AS sun FROM (SELECT a.r, a.c, b.r AS br, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS d2,
    row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c), b.r, b.c) AS k FROM cells a JOIN cells b ON {around(12)} AND {CHANNEL}
    AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 144) WHERE k = 1""",
)
def sunny_side(spark, d):
    """1 straight north of the channel, -1 south of it, 0 on it."""
    g = S.frame(spark, d).withColumn("on", F.col("acc") >= 195)
    n = distance.nearest(g, "on", 12).filter("d2 IS NOT NULL")
    return n.select("r", "c", F.round(F.when(F.col("d2") == 0, 0.0).otherwise((F.col("nr") - F.col("r")) / F.sqrt("d2")), 6).alias("sun"))


HAND = f"""near AS MATERIALIZED (SELECT r, c, z, d2, z - bz AS hand FROM (SELECT a.r, a.c, a.z, b.z AS bz, (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) AS d2,
  row_number() OVER (PARTITION BY a.r, a.c ORDER BY (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c), b.r, b.c) AS k FROM cells a JOIN cells b ON {around(14)} AND {CHANNEL}
  AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 196) WHERE k = 1)"""


@register(
    "terrace_share",
    f"""{GRADIENT}, {HAND}, m AS (SELECT sl.r, sl.c, CASE WHEN sl.slope BETWEEN 1 AND 6 AND sqrt(near.d2) * 30 BETWEEN 50 AND 400 AND near.hand BETWEEN 3 AND 20 THEN 1 ELSE 0 END AS terrace,
    CASE WHEN sl.slope < 1.5 AND near.hand < 2.5 THEN 1 ELSE 0 END AS flood FROM sl LEFT JOIN near ON near.r = sl.r AND near.c = sl.c)
    SELECT a.r, a.c, round(sum(b.terrace) / count(*), 6) AS terrace_share, round(sum(b.flood) / count(*), 6) AS floodplain_share FROM m a JOIN m b ON {around(8)} GROUP BY a.r, a.c""",
)
def terrace_share(spark, d):
    """Shares of terrace and floodplain cells around each cell."""
    g = S.frame(spark, d).withColumn("on", F.col("acc") >= 195)
    n = distance.nearest(g, "on", 14, ("z",)).select("r", "c", "d2", (F.col("z") - F.col("near_z")).alias("hand"))
    m = slopes(spark, d).join(n, ["r", "c"])
    terrace = F.col("slope").between(1, 6) & (F.sqrt("d2") * 30).between(50, 400) & F.col("hand").between(3, 20)
    flood = (F.col("slope") < 1.5) & (F.col("hand") < 2.5)
    m = m.select("r", "c", F.when(terrace, 1).otherwise(0).alias("t"), F.when(flood, 1).otherwise(0).alias("f"))
    a = focal.box(m, "t", 8, 8).select("r", "c", F.round(F.col("total") / F.col("count"), 6).alias("terrace_share"))
    return a.join(focal.box(m, "f", 8, 8).select("r", "c", F.round(F.col("total") / F.col("count"), 6).alias("floodplain_share")), ["r", "c"])


@register("block_mean", f"WITH {G} SELECT r // 5 AS br, c // 5 AS bc, round(sum(v) / count(v), 6) AS mean FROM cells, dims WHERE r < nr // 5 * 5 GROUP BY 1, 2 HAVING count(v) >= 0.3 * 25")
def block_mean(spark, d):
    return raster.block_mean(S.grid(spark, d), "v", 5, 0.3, shape(spark, d)).select("br", "bc", F.round("mean", 6).alias("mean"))


@register("thin_grid", f"WITH {G} SELECT r, c, z, acc FROM cells WHERE r % 5 = 0 AND c % 5 = 0")
def thin_grid(spark, d):
    return S.frame(spark, d).filter("r % 5 = 0 AND c % 5 = 0")


@register("overlay_max", f"WITH {G} SELECT r, c, CAST(greatest(CASE WHEN v > 100 THEN 3 ELSE 0 END, CASE WHEN acc >= 190 THEN 2 ELSE 0 END, CASE WHEN z % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS code FROM cells")
def overlay_max(spark, d):
    code = F.greatest(F.when(F.col("v") > 100, 3).otherwise(0), F.when(F.col("acc") >= 190, 2).otherwise(0), F.when(F.col("z") % 5 == 0, 1).otherwise(0))
    return S.grid(spark, d).select("r", "c", code.cast("long").alias("code"))


@register("mask_write", f"WITH {G} SELECT r, c, CASE WHEN (r + c) % 3 <> 0 THEN z END AS v FROM cells")
def mask_write(spark, d):
    return S.frame(spark, d).select("r", "c", F.when((F.col("r") + F.col("c")) % 3 != 0, F.col("z")).alias("v"))


COMPONENTS = f"""WITH RECURSIVE {G}, m AS MATERIALIZED (SELECT r, c FROM cells WHERE {{mask}}),
  reach(r, c, lab) AS (SELECT r, c, r * 200 + c FROM m UNION SELECT m.r, m.c, reach.lab FROM reach JOIN m ON abs(m.r - reach.r) + abs(m.c - reach.c) = 1),
  comp AS (SELECT r, c, min(lab) AS label FROM reach GROUP BY r, c)"""
#: A mask of middling patches, so that the recursive SQL stays small.
PATCHES = "(r * 7 + c * c) % 11 < 5"


def patches(spark, d):
    return S.frame(spark, d).filter(PATCHES).select("r", "c")


@register("components4", COMPONENTS.format(mask=PATCHES) + " SELECT r, c, label FROM comp")
def components4(spark, d):
    return components.labelled(patches(spark, d), WIDTH)


@register("patch_area_filter", COMPONENTS.format(mask=PATCHES) + " SELECT label, CAST(count(*) AS BIGINT) AS area FROM comp GROUP BY label HAVING count(*) >= 10")
def patch_area_filter(spark, d):
    return components.labelled(patches(spark, d), WIDTH).groupBy("label").agg(F.count(F.lit(1)).alias("area")).filter("area >= 10")


@register(
    "hole_fill",
    COMPONENTS.format(mask="(r * 7 + c * c) % 11 >= 8")
    + " SELECT r, c FROM comp JOIN (SELECT label FROM comp, dims GROUP BY label HAVING count(*) < 6 AND min(r) > 0 AND max(r) < any_value(nr) - 1 AND min(c) > 0 AND max(c) < any_value(nc) - 1) USING (label)",
)
def hole_fill(spark, d):
    """Holes of under 6 cells: components of the complement that don't meet the border."""
    n, w = shape(spark, d)
    out = components.labelled(S.frame(spark, d).filter("(r * 7 + c * c) % 11 >= 8").select("r", "c"), WIDTH)
    inside = out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("r0"), F.max("r").alias("r1"), F.min("c").alias("c0"), F.max("c").alias("c1"))
    small = inside.filter((F.col("n") < 6) & (F.col("r0") > 0) & (F.col("r1") < n - 1) & (F.col("c0") > 0) & (F.col("c1") < w - 1)).select("label")
    return out.join(small, "label", "left_semi").select("r", "c")


@register(
    "boundary_edges",
    COMPONENTS.format(mask=PATCHES)
    + """ SELECT label, CAST(sum(4 - (SELECT count(*) FROM comp b WHERE b.label = a.label AND abs(a.r - b.r) + abs(a.c - b.c) = 1)) AS BIGINT) AS edges FROM comp a GROUP BY label""",
)
def boundary_edges(spark, d):
    """Length of each patch's outline, in cell sides."""
    return raster.boundary_edges(components.labelled(patches(spark, d), WIDTH)).groupBy("label").agg(F.count(F.lit(1)).alias("edges"))


@register(
    "field_residual",
    COMPONENTS.format(mask=PATCHES)
    + """, f AS (SELECT label, quantile_cont(z, 0.5) AS med FROM comp JOIN cells USING (r, c) GROUP BY label HAVING count(*) >= 8)
    SELECT r, c, round(z - med, 6) AS residual FROM comp JOIN f USING (label) JOIN cells USING (r, c)""",
)
def field_residual(spark, d):
    """Value less the median of its own field, fields of 8 cells or more."""
    cells = components.labelled(patches(spark, d), WIDTH).join(S.frame(spark, d), ["r", "c"])
    med = cells.groupBy("label").agg(F.median("z").alias("med"), F.count(F.lit(1)).alias("n")).filter("n >= 8")
    return cells.join(med, "label").select("r", "c", F.round(F.col("z") - F.col("med"), 6).alias("residual"))


@register(
    "junctions",
    f"""WITH {G} SELECT a.r, a.c, CAST(count(*) AS BIGINT) AS feeders FROM cells a JOIN cells b ON {around(1)} AND (a.r <> b.r OR a.c <> b.c) AND b.acc >= 150 AND b.acc < a.acc WHERE a.acc >= 150 GROUP BY a.r, a.c HAVING count(*) >= 2""",
)
def junctions(spark, d):
    wet = S.frame(spark, d).filter("acc >= 150").select("r", "c", "acc")
    sent = focal.spread(wet, raster.NEIGHBOURS).withColumnRenamed("acc", "other")
    return wet.join(sent, ["r", "c"]).filter("other < acc").groupBy("r", "c").agg(F.count(F.lit(1)).alias("feeders")).filter("feeders >= 2")


@register(
    "near_junction",
    f"""WITH {G}, j AS (SELECT a.r, a.c FROM cells a JOIN cells b ON {around(1)} AND (a.r <> b.r OR a.c <> b.c) AND b.acc >= 190 AND b.acc < a.acc WHERE a.acc >= 190 GROUP BY a.r, a.c HAVING count(*) >= 2)
    SELECT DISTINCT a.r, a.c FROM cells a JOIN j b ON {around(10)} WHERE sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c)) * 30 <= 300""",
)
def near_junction(spark, d):
    g = S.frame(spark, d)
    wet = g.filter("acc >= 190").select("r", "c", "acc")
    j = wet.join(focal.spread(wet, raster.NEIGHBOURS).withColumnRenamed("acc", "other"), ["r", "c"]).filter("other < acc").groupBy("r", "c").count().filter("count >= 2").select("r", "c", F.lit(True).alias("j"))
    marked = g.join(j, ["r", "c"], "left").withColumn("j", F.coalesce("j", F.lit(False)))
    return distance.nearest(marked, "j", 10).filter("sqrt(d2) * 30 <= 300").select("r", "c")


FLOW = f"""flow AS MATERIALIZED (SELECT r, c, br AS tr, bc AS tc FROM (SELECT a.r, a.c, b.r AS br, b.c AS bc, row_number() OVER (PARTITION BY a.r, a.c ORDER BY
  (a.z - b.z) * (a.z - b.z) * 2 / (CASE WHEN a.r <> b.r AND a.c <> b.c THEN 2 ELSE 1 END) DESC, b.r, b.c) AS k FROM cells a JOIN cells b ON {around(1)} AND b.z < a.z) WHERE k = 1)"""


@register("flow_d8", f"WITH {G}, {FLOW} SELECT * FROM flow")
def flow_d8(spark, d):
    return raster.flow_direction(S.frame(spark, d), "z").filter("tr IS NOT NULL").select("r", "c", "tr", "tc")


@register(
    "flow_accumulation",
    f"""WITH RECURSIVE {G}, {FLOW}, path(sr, sc, r, c) AS (SELECT r, c, r, c FROM cells UNION ALL SELECT sr, sc, tr, tc FROM path JOIN flow USING (r, c))
    SELECT r, c, CAST(count(*) AS BIGINT) AS n FROM path GROUP BY r, c""",
)
def flow_accumulation(spark, d):
    return raster.accumulation(raster.flow_direction(S.frame(spark, d), "z"))


@register("depression_fill", None)
def depression_fill(spark, d):
    """Spill levels, by tiles of 64 rows."""
    g = S.frame(spark, d).withColumn("tile", F.expr("r div 64"))
    return raster.filled(g, "z", "tile").join(g, ["r", "c"]).select("r", "c", F.col("filled").alias("level"), (F.col("filled") - F.col("z")).alias("depth"))


@register(
    "flow_vector",
    f"""WITH {G}, n AS (SELECT a.r, a.c, b.r AS br, b.c AS bc, b.acc FROM cells a JOIN cells b ON {around(4)} AND b.acc BETWEEN a.acc / 2.0 AND a.acc * 2 WHERE a.acc >= 195 AND b.acc >= 150),
    e AS (SELECT r, c, arg_min(struct_pack(y := br, x := bc), (acc, br, bc)) AS lo, arg_max(struct_pack(y := br, x := bc), (acc, br, bc)) AS hi, count(*) AS n FROM n GROUP BY r, c)
    SELECT r, c, round((hi.x - lo.x) / sqrt((hi.x - lo.x) ** 2 + (hi.y - lo.y) ** 2), 6) AS vx, round((lo.y - hi.y) / sqrt((hi.x - lo.x) ** 2 + (hi.y - lo.y) ** 2), 6) AS vy FROM e WHERE n >= 2 AND (hi.x <> lo.x OR hi.y <> lo.y)""",
)
def flow_vector(spark, d):
    """From the lowest to the highest catchment among like channel cells around."""
    g = S.frame(spark, d)
    near = focal.spread(g.filter("acc >= 195").select("r", "c", F.col("r").alias("sr"), F.col("c").alias("sc"), F.col("acc").alias("own")), [(i, j) for i in range(-4, 5) for j in range(-4, 5)])
    like = near.join(g.filter("acc >= 150").select("r", "c", "acc"), ["r", "c"]).filter("acc >= own / 2 AND acc <= own * 2")
    key = F.struct("acc", "r", "c")
    e = like.groupBy("sr", "sc").agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n"))
    e = e.select(F.col("sr").alias("r"), F.col("sc").alias("c"), (F.col("hi.c") - F.col("lo.c")).alias("x"), (F.col("lo.r") - F.col("hi.r")).alias("y"), "n").filter("n >= 2 AND (x <> 0 OR y <> 0)")
    norm = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    return e.select("r", "c", F.round(F.col("x") / norm, 6).alias("vx"), F.round(F.col("y") / norm, 6).alias("vy"))


@register(
    "valley_walk",
    f"""WITH {G}, s AS (SELECT a.r * 200 + a.c AS id, a.r, a.c, a.z AS z0 FROM cells a WHERE a.acc >= 205), w AS (SELECT s.id, k, max(greatest(coalesce(b.z - s.z0, 0), 0)) OVER (PARTITION BY s.id ORDER BY k) AS rise
      FROM s CROSS JOIN (SELECT unnest(range(1, 16)) AS k) o LEFT JOIN cells b ON b.r = s.r AND b.c = s.c + k),
    t AS (SELECT id, max(rise) AS top FROM w GROUP BY id)
    SELECT w.id, any_value(top) AS top, coalesce(min(CASE WHEN rise >= 3 AND k BETWEEN 2 AND 8 THEN k * 30 END), 120) AS terrace,
      CASE WHEN any_value(top) >= 4 THEN coalesce(min(CASE WHEN rise >= 0.5 * top AND k BETWEEN 3 AND 12 THEN k * 30 END), 150) ELSE 150 END AS slope FROM w JOIN t USING (id) GROUP BY w.id""",
)
def valley_walk(spark, d):
    """Distance of the terrace and of the slope from the channel, by the profile."""
    g = S.frame(spark, d)
    starts = g.filter("acc >= 205").select((F.col("r") * WIDTH + F.col("c")).alias("id"), "r", "c", F.col("z").alias("z0"), F.lit(0).alias("dr"), F.lit(1).alias("dc"))
    w = raster.walk(starts, g, "id", "dr", "dc", 15, "z").withColumn("top", F.max("rise").over(Window.partitionBy("id")))
    m = F.col("step") * 30
    out = w.groupBy("id").agg(
        F.first("top").alias("top"),
        F.coalesce(F.min(F.when((F.col("rise") >= 3) & F.col("step").between(2, 8), m)), F.lit(120)).alias("terrace"),
        F.coalesce(F.min(F.when((F.col("rise") >= 0.5 * F.col("top")) & F.col("step").between(3, 12), m)), F.lit(150)).alias("slope"),
    )
    return out.withColumn("slope", F.when(F.col("top") >= 4, F.col("slope")).otherwise(F.lit(150)))


@register(
    "channel_head",
    f"""WITH {G}, n AS (SELECT a.r, a.c, least(min(sqrt((a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c))) * 30, 300) AS dist FROM cells a JOIN cells b ON {around(10)} AND b.acc BETWEEN 100 AND 103 GROUP BY a.r, a.c),
    f AS (SELECT cells.r, cells.c, coalesce(n.dist, 300.0) AS dist FROM cells LEFT JOIN n USING (r, c)) SELECT a.r, a.c, round(min(b.dist), 6) AS dist_head FROM f a JOIN f b ON {around(2)} GROUP BY a.r, a.c""",
)
def channel_head(spark, d):
    g = S.frame(spark, d).withColumn("head", F.col("acc").between(100, 103))
    dist = distance.nearest(g, "head", 10).select("r", "c", F.coalesce(F.least(F.sqrt("d2") * 30, F.lit(300.0)), F.lit(300.0)).alias("dist"))
    return focal.extreme(dist, "dist", 2, "min").select("r", "c", F.round("extreme", 6).alias("dist_head"))


@register("raster_window", f"WITH {G} SELECT r, c, v FROM cells WHERE r BETWEEN 10 AND 59 AND c BETWEEN 20 AND 79")
def raster_window(spark, d):
    return S.raster_window(S.grid(spark, d), 10, 59, 20, 79).select("r", "c", "v")


@register("nodata_to_null", f"WITH {G} SELECT r, c, CASE WHEN z <> 40 THEN z END AS z FROM cells")
def nodata_to_null(spark, d):
    return S.without_nodata(S.frame(spark, d), 40, "z").select("r", "c", "z")


@register("tile_enumeration", "SELECT CAST(lat AS BIGINT) AS lat, CAST(lon AS BIGINT) AS lon, 'N' || lat || 'E' || lon AS name FROM (SELECT unnest(range(47, 52)) AS lat), (SELECT unnest(range(23, 41, 3)) AS lon)")
def tile_enumeration(spark, d):
    """Names of the tiles that cover bounds: 1 degree of latitude by 3 of longitude."""
    one = spark.range(1).select(F.explode(F.sequence(F.lit(47), F.lit(51))).alias("lat"))
    t = one.withColumn("lon", F.explode(F.sequence(F.lit(23), F.lit(40), F.lit(3))))
    return t.select(F.col("lat").cast("long").alias("lat"), F.col("lon").cast("long").alias("lon"), F.concat(F.lit("N"), "lat", F.lit("E"), "lon").alias("name"))


@register("resample_average", f"WITH {G} SELECT r // 4 AS tr, c // 4 AS tc, round(avg(v), 6) AS value FROM cells WHERE v IS NOT NULL GROUP BY 1, 2")
def resample_average(spark, d):
    return raster.resample(S.grid(spark, d), "v", 4, "average").select("tr", "tc", F.round("value", 6).alias("value"))


@register("resample_max", f"WITH {G} SELECT r // 4 AS tr, c // 4 AS tc, max(v) AS value FROM cells WHERE v IS NOT NULL GROUP BY 1, 2")
def resample_max(spark, d):
    return raster.resample(S.grid(spark, d), "v", 4, "max")


@register("resample_mode", f"WITH {G} SELECT tr, tc, m AS value FROM (SELECT r // 4 AS tr, c // 4 AS tc, z % 5 AS m, row_number() OVER (PARTITION BY r // 4, c // 4 ORDER BY count(*) DESC, z % 5) AS k FROM cells GROUP BY 1, 2, 3) WHERE k = 1")
def resample_mode(spark, d):
    return raster.resample(S.frame(spark, d).withColumn("m", F.col("z") % 5), "m", 4, "mode")


@register("resample_nearest", f"WITH {G} SELECT r // 4 AS tr, c // 4 AS tc, z AS value FROM cells WHERE r % 4 = 2 AND c % 4 = 2")
def resample_nearest(spark, d):
    return raster.resample(S.frame(spark, d), "z", 4, "nearest")


@register(
    "resample_bilinear",
    f"""WITH {G}, t AS (SELECT i, j, i * 1.5 + 0.25 AS y, j * 1.5 + 0.25 AS x FROM (SELECT unnest(range(0, 60)) AS i), (SELECT unnest(range(0, 120)) AS j)),
    f AS (SELECT *, CAST(floor(y) AS BIGINT) AS fy, CAST(floor(x) AS BIGINT) AS fx FROM t),
    k AS (SELECT i, j, fy + a AS r, fx + b AS c, (CASE a WHEN 1 THEN y - fy ELSE 1 - y + fy END) * (CASE b WHEN 1 THEN x - fx ELSE 1 - x + fx END) AS w FROM f, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS b))
    SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, round(sum(v * w) / sum(w), 6) AS value FROM k JOIN cells USING (r, c) WHERE v IS NOT NULL AND w > 0 GROUP BY i, j""",
)
def resample_bilinear(spark, d):
    t = spark.range(60 * 120).select(F.expr("id div 120").alias("i"), (F.col("id") % 120).alias("j"))
    out = raster.bilinear(t, S.grid(spark, d), "v", F.col("i") * 1.5 + 0.25, F.col("j") * 1.5 + 0.25, ["i", "j"])
    return out.select("i", "j", F.round("value", 6).alias("value"))


@register("mosaic_first", "WITH e AS (SELECT CAST(user_id AS BIGINT) AS r, CAST(event_id % 20 AS BIGINT) AS c, event_id, CAST(floor(value) AS BIGINT) AS v FROM events) SELECT r, c, arg_min(v, event_id) AS first_v, arg_max(v, event_id) FILTER (v > 0) AS last_v FROM e GROUP BY r, c")
def mosaic_first(spark, d):
    e = S.table(spark, d, "events", ["event_id", "user_id", "value"]).select(F.col("user_id").cast("long").alias("r"), (F.col("event_id") % 20).cast("long").alias("c"), "event_id", F.floor("value").cast("long").alias("v"))
    return raster.mosaic(e, "event_id", "v").withColumnRenamed("v", "first_v").join(raster.mosaic(e, "event_id", "v", last=True).withColumnRenamed("v", "last_v"), ["r", "c"], "left")


@register(
    "mosaic_calibrated",
    f"""WITH {G}, a AS (SELECT r, c, CAST(z + 10 AS DOUBLE) AS v FROM cells WHERE c < 120), b AS (SELECT r, c, z * 2.0 + 5 AS v FROM cells WHERE c >= 80),
    k AS (SELECT quantile_cont(a.v / b.v, 0.5) AS ratio FROM a JOIN b USING (r, c))
    SELECT r, c, round(avg(v), 6) AS v, CAST(count(*) AS BIGINT) AS n FROM (SELECT r, c, v FROM a UNION ALL SELECT r, c, v * ratio FROM b, k) GROUP BY r, c""",
)
def mosaic_calibrated(spark, d):
    g = S.frame(spark, d)
    tiles = [g.filter("c < 120").select("r", "c", (F.col("z") + 10).cast("double").alias("v")), g.filter("c >= 80").select("r", "c", (F.col("z") * 2.0 + 5).alias("v"))]
    return raster.calibrated_mosaic(tiles, "v", 500)[0].select("r", "c", F.round("v", 6).alias("v"), "n")


@register(
    "darkness_classes",
    f"""WITH {G}, m AS (SELECT r // 5 AS br, c // 5 AS bc, sum(v) / count(v) AS mean FROM cells, dims WHERE r < nr // 5 * 5 GROUP BY 1, 2 HAVING count(v) >= 0.3 * 25),
    q AS (SELECT quantile_cont(mean, 0.10) AS a, quantile_cont(mean, 0.25) AS b, quantile_cont(mean, 0.45) AS c, quantile_cont(mean, 0.65) AS d, quantile_cont(mean, 0.82) AS e, quantile_cont(mean, 0.92) AS f FROM m)
    SELECT CAST(1 + (round(mean, 3) >= round(a, 3))::INT + (round(mean, 3) >= round(b, 3))::INT + (round(mean, 3) >= round(q.c, 3))::INT + (round(mean, 3) >= round(d, 3))::INT + (round(mean, 3) >= round(e, 3))::INT + (round(mean, 3) >= round(f, 3))::INT AS BIGINT) AS class,
      CAST(count(*) AS BIGINT) AS blocks FROM m, q GROUP BY 1""",
)
def darkness_classes(spark, d):
    """Blocks by class between the quantiles of all block means."""
    m = raster.block_mean(S.grid(spark, d), "v", 5, 0.3, shape(spark, d))
    breaks = m.agg(F.percentile("mean", F.array(*[F.lit(x) for x in (0.10, 0.25, 0.45, 0.65, 0.82, 0.92)])).alias("q")).select(F.transform("q", lambda x: F.round(x, 3)).alias("q"))
    n = m.join(F.broadcast(breaks)).select((F.size(F.filter("q", lambda x: x <= F.round("mean", 3))) + 1).cast("long").alias("class"))
    return n.groupBy("class").agg(F.count(F.lit(1)).alias("blocks"))
