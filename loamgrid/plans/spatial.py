"""Spatial queries: points in polygons, neighbours, lines, placing rules."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as M
from ..operators import raster, spatial
from ..sources import tables as S
from ..sources.tables import SQL_GRID as G
from ..sources.tables import SQL_POINTS as P

Q: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


def polygons(spark, d):
    """Kites around the sites, wider with the district."""
    x, y, h = F.col("x"), F.col("y"), 1500 + F.col("district") * 100
    return S.sites(spark, d).select(F.col("id").alias("poly_id"), M.ring((x - h, y), (x, y + 2 * h), (x + h, y), (x, y - h)).alias("ring"))


#: Side of the squares in which points and polygons meet: less than a kite's width, so
#: that most points dealt to it lie in its bounds.
SQUARE = 2000.0

#: The same as edges, by polygon.
EDGES = f"""WITH {P}, k AS (SELECT id AS poly_id, x * 1.0 AS x, y * 1.0 AS y, 1500.0 + district * 100 AS h, x * 1.0 AS cx, y * 1.0 AS cy FROM sites),
e AS (SELECT poly_id, x - h AS ax, y AS ay, x AS bx, y + 2 * h AS qy FROM k UNION ALL SELECT poly_id, x, y + 2 * h, x + h, y FROM k
  UNION ALL SELECT poly_id, x + h, y, x, y - h FROM k UNION ALL SELECT poly_id, x, y - h, x - h, y FROM k),
inside AS (SELECT p.id, e.poly_id FROM places p, e WHERE (e.ay > p.y) <> (e.qy > p.y) AND p.x < (e.bx - e.ax) * (p.y - e.ay) / (e.qy - e.ay) + e.ax
  GROUP BY p.id, e.poly_id HAVING count(*) % 2 = 1)"""


@register("points_in_polygons", EDGES + " SELECT id, poly_id FROM inside")
def points_in_polygons(spark, d):
    return spatial.in_polygons(S.points(spark, d).select("id", "x", "y"), polygons(spark, d), SQUARE).select("id", "poly_id")


@register("pip_left_anti", EDGES + " SELECT id, x, y, kind FROM places WHERE id NOT IN (SELECT id FROM inside)")
def pip_left_anti(spark, d):
    """Points that no polygon covers."""
    p = S.points(spark, d)
    covered = spatial.in_rings(p.select("x", "y").distinct(), polygons(spark, d), SQUARE).select("x", "y").distinct()
    return p.join(covered, ["x", "y"], "left_anti").select("id", "x", "y", "kind")


@register(
    "polygon_area",
    EDGES + " SELECT poly_id, round(abs(sum(ax * qy - bx * ay)) / 2 / 1000000, 4) AS km2, round(sum((ax + bx) * (ax * qy - bx * ay)) / (3 * sum(ax * qy - bx * ay)), 3) AS cx, round(sum((ay + qy) * (ax * qy - bx * ay)) / (3 * sum(ax * qy - bx * ay)), 3) AS cy FROM e GROUP BY poly_id",
)
def polygon_area(spark, d):
    c = M.centroid(F.col("ring"))
    return polygons(spark, d).select("poly_id", F.round(M.area(F.col("ring")) / 1e6, 4).alias("km2"), F.round(c["x"], 3).alias("cx"), F.round(c["y"], 3).alias("cy"))


@register("cell_label_join", f"WITH {P}, l AS (SELECT DISTINCT x // 2000 AS ix, y // 2000 AS iy FROM sites) SELECT p.id, CASE WHEN l.ix IS NULL THEN 'outside' ELSE 'cell' END AS label FROM places p LEFT JOIN l ON p.x // 2000 = l.ix AND p.y // 2000 = l.iy")
def cell_label_join(spark, d):
    cell = lambda df: df.withColumn("ix", F.floor(F.col("x") / 2000)).withColumn("iy", F.floor(F.col("y") / 2000))
    labels = cell(S.sites(spark, d)).select("ix", "iy").distinct().withColumn("label", F.lit("cell"))
    return cell(S.points(spark, d)).join(labels, ["ix", "iy"], "left").select("id", F.coalesce("label", F.lit("outside")).alias("label"))


@register("nn1_distance", f"WITH {P} SELECT id, oid, d2 FROM (SELECT p.id, s.id AS oid, (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) AS d2, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), s.id) AS k FROM places p, sites s) WHERE k = 1")
def nn1_distance(spark, d):
    return spatial.nearest(S.points(spark, d), S.sites(spark, d), 8000.0).select("id", "oid", F.col("d2").cast("long").alias("d2"))


def self_nearest(spark, d):
    p = S.points(spark, d)
    return spatial.nearest(p, p, 500.0, own=False)


@register("nn1_self", f"WITH {P} SELECT a.id, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d2 FROM places a JOIN places b ON a.id <> b.id GROUP BY a.id HAVING min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 144000000")
def nn1_self(spark, d):
    """Distance to the nearest other place, where it is 12 km at most."""
    return self_nearest(spark, d).filter("d2 <= 144000000").select("id", F.col("d2").cast("long").alias("d2"))


@register(
    "clark_evans",
    f"""WITH {P}, n AS (SELECT a.id, sqrt(min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) AS d FROM places a JOIN places b ON a.id <> b.id GROUP BY a.id)
    SELECT CAST(count(*) AS BIGINT) AS n, round(avg(d) / (0.5 / sqrt(count(*) / 1e10)), 6) AS r, round(quantile_cont(d, 0.5), 6) AS median FROM n""",
)
def clark_evans(spark, d):
    n = self_nearest(spark, d).select(F.sqrt("d2").alias("d"))
    return n.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d") / (0.5 / F.sqrt(F.count(F.lit(1)) / 1e10)), 6).alias("r"), F.round(F.median("d"), 6).alias("median"))


@register("within_gap", f"WITH {P} SELECT id, x, y FROM places p WHERE NOT EXISTS (SELECT 1 FROM sites s WHERE (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 9000000)")
def within_gap(spark, d):
    """Candidates more than 3 km from every site."""
    p = S.points(spark, d)
    return p.join(spatial.within(p, S.sites(spark, d), 3000.0).select("id").distinct(), "id", "left_anti").select("id", "x", "y")


@register(
    "voronoi_assign",
    f"""WITH {P}, n AS (SELECT oid FROM (SELECT p.id, s.id AS oid, row_number() OVER (PARTITION BY p.id ORDER BY (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), s.id) AS k FROM places p, sites s) WHERE k = 1)
    SELECT oid, CAST(count(*) AS BIGINT) AS members FROM n GROUP BY oid""",
)
def voronoi_assign(spark, d):
    """Members of each site's own region: the nearest site is the region's definition."""
    return spatial.nearest(S.points(spark, d), S.sites(spark, d), 8000.0).groupBy("oid").agg(F.count(F.lit(1)).alias("members"))


@register(
    "nearest_namesake",
    f"""WITH {P} SELECT id, oid FROM (SELECT s.id, p.id AS oid, row_number() OVER (PARTITION BY s.id ORDER BY (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y), p.id) AS k FROM sites s JOIN places p ON s.district = p.district
    WHERE (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 144000000) WHERE k = 1""",
)
def nearest_namesake(spark, d):
    """Nearest place of the same name (here: district) within 12 km."""
    near = spatial.within(S.sites(spark, d), S.points(spark, d), 12000.0)
    same = near.join(S.points(spark, d).select(F.col("id").alias("oid"), F.col("district").alias("other")), "oid").filter("district = other")
    return same.groupBy("id").agg(F.min(F.struct("d2", "oid"))["oid"].alias("oid"))


def lines(spark, d):
    """A river per district: sites of it joined in order of id."""
    w = Window.partitionBy("district").orderBy("id")
    s = S.sites(spark, d).withColumn("bx", F.lead("x").over(w)).withColumn("by", F.lead("y").over(w)).filter("bx IS NOT NULL")
    return s.select(F.col("district").alias("line"), *[F.col(a).cast("double").alias(b) for a, b in (("x", "ax"), ("y", "ay"), ("bx", "bx"), ("by", "by"))])


LINES = f"""WITH {P}, seg AS (SELECT * FROM (SELECT district AS line, x * 1.0 AS ax, y * 1.0 AS ay, lead(x) OVER w * 1.0 AS bx, lead(y) OVER w * 1.0 AS qy FROM sites WINDOW w AS (PARTITION BY district ORDER BY id)) WHERE bx IS NOT NULL),
t AS (SELECT p.id, p.district, line, p.x - ax AS px, p.y - ay AS py, bx - ax AS dx, qy - ay AS dy FROM places p, seg),
d AS (SELECT id, district, line, px, py, dx, dy, greatest(0.0, least(1.0, (px * dx + py * dy) / (dx * dx + dy * dy))) AS t FROM t),
near AS (SELECT id, district, line, min((px - t * dx) * (px - t * dx) + (py - t * dy) * (py - t * dy)) AS d2 FROM d GROUP BY id, district, line)"""


@register("nearest_line", LINES + " SELECT id, arg_min(line, (d2, line)) AS line, round(sqrt(min(d2)), 4) AS dist FROM near WHERE d2 <= 9000000 GROUP BY id")
def nearest_line(spark, d):
    return spatial.nearest_lines(S.points(spark, d), lines(spark, d), 3000.0).select("id", "line", F.round(F.sqrt("d2"), 4).alias("dist"))


@register("named_line_filter", LINES + " SELECT id, line FROM near WHERE line = district AND d2 <= 25000000")
def named_line_filter(spark, d):
    """Points within 5 km of the line of their own name."""
    return spatial.to_lines(S.points(spark, d), lines(spark, d), 5000.0).filter("line = district").select("id", "line").distinct()


@register(
    "knn5_zscore_match",
    """WITH f AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS v, label < 2 AS site FROM embeddings),
    m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM f WHERE NOT site),
    z AS (SELECT vec_id, round((a - ma) / sa, 9) AS a, round((b - mb) / sb, 9) AS b, v, site FROM f, m),
    k AS (SELECT s.vec_id, s.v, o.v AS ov, row_number() OVER (PARTITION BY s.vec_id ORDER BY (s.a - o.a) * (s.a - o.a) + (s.b - o.b) * (s.b - o.b), o.vec_id) AS k FROM z s JOIN z o ON s.site AND NOT o.site)
    SELECT vec_id AS id, round(any_value(v) - avg(ov), 6) AS diff FROM k WHERE k <= 5 GROUP BY vec_id""",
)
def knn5_zscore_match(spark, d):
    """Difference of each site from its five nearest background rows."""
    e = S.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("abv")], (F.col("label") < 2).alias("site"))
    m = e.filter("NOT site").agg(*[f(c).alias(n + c) for c in "ab" for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = e.join(F.broadcast(m)).select("id", "v", "site", *[F.round((F.col(c) - F.col("m" + c)) / F.col("s" + c), 9).alias(c) for c in "ab"])
    back = z.filter("NOT site").withColumnRenamed("id", "oid")
    near = spatial.k_nearest(z.filter("site"), back, ["a", "b"], 5).join(back.select("oid", F.col("v").alias("ov")), "oid")
    return near.groupBy("id").agg(F.avg("ov").alias("ov")).join(z.select("id", "v"), "id").select("id", F.round(F.col("v") - F.col("ov"), 6).alias("diff"))


def at_cells(spark, d):
    """Sites at grid cells."""
    return S.sites(spark, d).withColumn("r", (F.floor(F.col("y") / 700) % 150).cast("long")).withColumn("c", (F.floor(F.col("x") / 500) % 210).cast("long"))


AT = f"{G}, {P}, pt AS (SELECT id, y // 700 % 150 AS r, x // 500 % 210 AS c FROM sites)"


@register("point_sample", f"WITH {AT} SELECT id, z, v FROM pt LEFT JOIN cells USING (r, c)")
def point_sample(spark, d):
    return raster.sample(at_cells(spark, d).select("id", "r", "c"), S.grid(spark, d), F.col("r"), F.col("c"), "z", "v").select("id", "z", "v")


@register(
    "disk_sample_stats",
    f"""WITH {AT} SELECT id, min(z) AS low, max(z) AS high, round(avg(z), 6) AS mean, round(log10(greatest(max(acc) / 10.0, 0.001)), 6) AS catchment,
    round(count(*) FILTER (z > 100 AND z % 2 = 0) / greatest(count(*) FILTER (z > 100), 1), 6) AS south FROM pt p JOIN cells b ON b.r BETWEEN p.r - 6 AND p.r + 6 AND b.c BETWEEN p.c - 6 AND p.c + 6 AND (p.r - b.r) * (p.r - b.r) + (p.c - b.c) * (p.c - b.c) <= 36 GROUP BY id""",
)
def disk_sample_stats(spark, d):
    steep = F.col("z") > 100
    return raster.disk_sample(
        at_cells(spark, d), S.frame(spark, d), "id", 6,
        low=F.min("z"), high=F.max("z"), mean=F.round(F.avg("z"), 6),
        catchment=F.round(F.log10(F.greatest(F.max("acc") / 10.0, F.lit(0.001))), 6),
        south=F.round(F.count_if(steep & (F.col("z") % 2 == 0)) / F.greatest(F.count_if(steep), F.lit(1)), 6),
    )


@register("disk_p90", f"WITH {AT} SELECT id, round(quantile_cont(v, 0.9), 6) AS p90 FROM pt p JOIN cells b ON b.r BETWEEN p.r - 6 AND p.r + 6 AND b.c BETWEEN p.c - 6 AND p.c + 6 AND (p.r - b.r) * (p.r - b.r) + (p.c - b.c) * (p.c - b.c) <= 36 WHERE v IS NOT NULL GROUP BY id")
def disk_p90(spark, d):
    return raster.disk_sample(at_cells(spark, d), S.grid(spark, d).filter("v IS NOT NULL"), "id", 6, p90=F.round(F.percentile("v", 0.9), 6))


@register(
    "sector_window",
    f"""WITH {P}, w AS (SELECT s.id, p.id AS oid, atan2(p.x - s.x, p.y - s.y) - radians((s.id % 8) * 45) AS a FROM sites s, places p WHERE (p.x - s.x) * (p.x - s.x) + (p.y - s.y) * (p.y - s.y) <= 225000000)
    SELECT id, oid FROM w WHERE abs(atan2(sin(a), cos(a))) <= radians(67.5)""",
)
def sector_window(spark, d):
    """Points within 15 km and 67.5 degrees of a bearing."""
    turn = F.radians((F.col("id") % 8) * 45)
    sites = S.sites(spark, d).select("id", "x", "y", F.sin(turn).alias("ux"), F.cos(turn).alias("uy"))
    near = spatial.near_places(sites, spatial.gathered(S.points(spark, d).select(F.col("id").alias("oid"), "x", "y")), 15000.0, 3750.0)
    dx, dy = F.col("ox") - F.col("x"), F.col("oy") - F.col("y")
    a = F.atan2(dx, dy) - turn
    exact = F.abs(F.atan2(F.sin(a), F.cos(a))) <= F.radians(F.lit(67.5))
    # the angle itself is told only where its cosine is close to the limit's
    over = dx * F.col("ux") + dy * F.col("uy") - F.sqrt("d2") * math.cos(math.radians(67.5))
    close = 1e-6 * (F.sqrt("d2") + 1)
    sector = near.filter(F.when(over > close, True).when(over < -close, False).otherwise(exact))
    return spatial.spread(sector, "id").select("id", "oid")


@register("rasterize_center", EDGES + """, g AS (SELECT i, j, i * 1000 + 500.0 AS y, j * 1000 + 500.0 AS x FROM (SELECT unnest(range(0, 101)) AS i), (SELECT unnest(range(0, 101)) AS j))
    SELECT DISTINCT CAST(i AS BIGINT) AS r, CAST(j AS BIGINT) AS c FROM (SELECT i, j, poly_id FROM g, e WHERE (e.ay > g.y) <> (e.qy > g.y) AND g.x < (e.bx - e.ax) * (g.y - e.ay) / (e.qy - e.ay) + e.ax GROUP BY i, j, poly_id HAVING count(*) % 2 = 1)""")
def rasterize_center(spark, d):
    """Cells of 1 km whose centre lies in a polygon: each polygon tells its own cells."""
    cell = lambda v, f: F.floor(f(F.transform("ring", lambda p: p[v])) / 1000).cast("long")
    cells = polygons(spark, d).withColumn("r", F.explode(F.sequence(cell("y", F.array_min), cell("y", F.array_max)))).withColumn("c", F.explode(F.sequence(cell("x", F.array_min), cell("x", F.array_max))))
    inside = M.contains(F.col("ring"), F.col("c") * 1000 + 500.0, F.col("r") * 1000 + 500.0)
    return cells.filter(inside & F.col("r").between(0, 100) & F.col("c").between(0, 100)).select("r", "c").distinct()


@register("rasterize_touched", LINES + """ SELECT DISTINCT CAST(i AS BIGINT) AS r, CAST(j AS BIGINT) AS c FROM seg, (SELECT unnest(range(0, 101)) AS i), (SELECT unnest(range(0, 101)) AS j)
    WHERE greatest(ax, bx) >= j * 1000 AND least(ax, bx) <= j * 1000 + 1000 AND greatest(ay, qy) >= i * 1000 AND least(ay, qy) <= i * 1000 + 1000
    AND abs((bx - ax) * (i * 1000 + 500.0 - ay) - (qy - ay) * (j * 1000 + 500.0 - ax)) <= 500 * (abs(bx - ax) + abs(qy - ay))""")
def rasterize_touched(spark, d):
    """Cells of 1 km that a segment touches: bounds overlap, and the line passes no
    farther from the centre than a corner lies."""
    cell = lambda f, a, b, by: F.floor((f(a, b) + by) / 1000).cast("long")
    s = lines(spark, d)
    s = s.withColumn("r", F.explode(F.sequence(cell(F.least, "ay", "by", -1000), cell(F.greatest, "ay", "by", 0)))).withColumn("c", F.explode(F.sequence(cell(F.least, "ax", "bx", -1000), cell(F.greatest, "ax", "bx", 0))))
    x0, y0 = F.col("c") * 1000, F.col("r") * 1000
    box = (F.greatest("ax", "bx") >= x0) & (F.least("ax", "bx") <= x0 + 1000) & (F.greatest("ay", "by") >= y0) & (F.least("ay", "by") <= y0 + 1000)
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    near = F.abs(dx * (y0 + 500.0 - F.col("ay")) - dy * (x0 + 500.0 - F.col("ax"))) <= 500 * (F.abs(dx) + F.abs(dy))
    return s.filter(box & near & F.col("r").between(0, 100) & F.col("c").between(0, 100)).select("r", "c").distinct()


@register(
    "ray_edge_distance",
    EDGES + """, q AS (SELECT poly_id, cx AS x, cy AS y, (poly_id % 8) * 45.0 AS deg FROM k), h AS (SELECT q.poly_id, sin(radians(deg)) AS ux, cos(radians(deg)) AS uy, e.ax - q.x AS rx, e.ay - q.y AS ry, e.bx - e.ax AS ex, e.qy - e.ay AS ey FROM q JOIN e USING (poly_id)),
    t AS (SELECT poly_id, (rx * -ey + ry * ex) / (ux * -ey + uy * ex) AS t, (ux * ry - uy * rx) / (ux * -ey + uy * ex) AS s FROM h WHERE abs(ux * -ey + uy * ex) >= 1e-9)
    SELECT k.poly_id, round(coalesce(max(t) FILTER (t >= 0 AND t <= 20000 AND s >= 0 AND s <= 1), 0), 4) AS edge FROM k LEFT JOIN t USING (poly_id) GROUP BY k.poly_id""",
)
def ray_edge_distance(spark, d):
    p = polygons(spark, d).join(S.sites(spark, d).select(F.col("id").alias("poly_id"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "poly_id")
    return p.select("poly_id", F.round(M.ray_reach(F.col("ring"), F.col("x"), F.col("y"), (F.col("poly_id") % 8) * 45.0, 20000.0), 4).alias("edge"))


def pairs_of_sites(spark, d):
    s = S.sites(spark, d).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), ((F.col("id") % 8) * 45.0).alias("deg"))
    t = s.select((F.col("id") - 1).alias("id"), F.col("x").alias("x2"), F.col("y").alias("y2"), ((F.col("id") * 4 % 8) * 45.0).alias("deg2"))
    return s.join(t, "id")


PAIRS = f"""WITH {P}, q AS (SELECT a.id, a.x * 1.0 AS ax, a.y * 1.0 AS ay, (a.id % 8) * 45.0 AS da, b.x * 1.0 AS bx, b.y * 1.0 AS qy, (b.id * 4 % 8) * 45.0 AS db FROM sites a JOIN sites b ON b.id = a.id + 1)"""


@register(
    "two_rays",
    PAIRS + """, w AS (SELECT *, sin(radians(da)) AS ux, cos(radians(da)) AS uy, sin(radians(db)) AS vx, cos(radians(db)) AS vy FROM q), t AS (SELECT *, ux * -vy + uy * vx AS det FROM w),
    s AS (SELECT *, ((bx - ax) * -vy + (qy - ay) * vx) / det AS t, (ux * (qy - ay) - uy * (bx - ax)) / det AS u, 1.2 * sqrt((bx - ax) * (bx - ax) + (qy - ay) * (qy - ay)) + 500 AS reach FROM t WHERE abs(det) >= 1e-9)
    SELECT id, round(ax + t * ux, 3) AS x, round(ay + t * uy, 3) AS y FROM s WHERE t > 0 AND u > 0 AND t <= reach AND u <= reach""",
)
def two_rays(spark, d):
    c = M.crossing(*[F.col(n) for n in ("x", "y", "deg", "x2", "y2", "deg2")])
    return pairs_of_sites(spark, d).withColumn("p", c).filter("p IS NOT NULL").select("id", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y"))


@register("between_midpoint", PAIRS + " SELECT id, (ax + bx) / 2 AS x, (ay + qy) / 2 AS y FROM q WHERE abs(da - db) = 180")
def between_midpoint(spark, d):
    """Midpoints where the two bearings are opposite."""
    p = pairs_of_sites(spark, d).filter("abs(deg - deg2) = 180")
    return p.select("id", ((F.col("x") + F.col("x2")) / 2).alias("x"), ((F.col("y") + F.col("y2")) / 2).alias("y"))


def place(direction, position, distance, has_area, edge):
    """Distance from the node by the placing rules; NULL: at the node itself."""
    far = F.when(position == "inside", 225.0).when(position == "outskirts", 450.0).otherwise(750.0)
    stated = distance.isNotNull() & (distance != 0)
    built = F.when(stated, edge + distance).when(position == "inside", 0.6 * edge).when(position == "outskirts", edge).otherwise(edge + 300)
    return F.when(M.bearing(direction).isNull(), F.lit(None)).when(~has_area & distance.isNotNull(), 450 + distance).when(~has_area, far).otherwise(built)


@register(
    "place_rules",
    f"""WITH {P}, q AS (SELECT id, x, y, CASE id % 9 WHEN 0 THEN 'N' WHEN 1 THEN 'NE' WHEN 2 THEN 'E' WHEN 3 THEN 'SE' WHEN 4 THEN 'S' WHEN 5 THEN 'SW' WHEN 6 THEN 'W' WHEN 7 THEN 'NW' ELSE '?' END AS dir,
    CASE id % 4 WHEN 0 THEN 'inside' WHEN 1 THEN 'outskirts' WHEN 2 THEN 'beyond' ELSE 'near' END AS pos, CASE WHEN id % 5 = 0 THEN (id % 7) * 100.0 END AS dist, id % 3 <> 0 AS area, 300.0 + district * 50 AS edge FROM places),
    r AS (SELECT *, CASE WHEN dir = '?' THEN NULL WHEN NOT area AND dist IS NOT NULL THEN 450 + dist WHEN NOT area THEN CASE pos WHEN 'inside' THEN 225.0 WHEN 'outskirts' THEN 450.0 ELSE 750.0 END
      WHEN dist IS NOT NULL AND dist <> 0 THEN edge + dist WHEN pos = 'inside' THEN 0.6 * edge WHEN pos = 'outskirts' THEN edge ELSE edge + 300 END AS m, radians((id % 9) * 45.0) AS a FROM q)
    SELECT id, round(x + coalesce(m, 0) * sin(a), 3) AS px, round(y + coalesce(m, 0) * cos(a), 3) AS py, CASE WHEN m IS NULL THEN 'C' ELSE 'A' END AS accuracy FROM r""",
)
def place_rules(spark, d):
    k = F.col("id")
    names = F.array(*[F.lit(v) for v in (*M.DIRECTIONS, "?")])
    q = S.points(spark, d).select("id", "x", "y", F.get(names, (k % 9).cast("int")).alias("dir"), F.get(F.array(*[F.lit(v) for v in ("inside", "outskirts", "beyond", "near")]), (k % 4).cast("int")).alias("pos"),
        F.when(k % 5 == 0, (k % 7) * 100.0).alias("dist"), (k % 3 != 0).alias("area"), (300.0 + F.col("district") * 50).alias("edge"))
    q = q.withColumn("m", place(F.col("dir"), F.col("pos"), F.col("dist"), F.col("area"), F.col("edge")))
    ux, uy = M.unit(F.coalesce(M.bearing(F.col("dir")), F.lit(0.0)))
    move = lambda v, u: F.round(F.col(v) + F.coalesce("m", F.lit(0.0)) * u, 3)
    return q.select("id", move("x", ux).alias("px"), move("y", uy).alias("py"), F.when(F.col("m").isNull(), "C").otherwise("A").alias("accuracy"))


@register(
    "wedge_part",
    EDGES + """, q AS (SELECT poly_id, cx AS x, cy AS y, (poly_id % 8) * 45.0 AS deg FROM k), i AS (SELECT q.*, p.id, p.x AS px, p.y AS py, atan2(p.x - q.x, p.y - q.y) - radians(deg) AS a FROM q JOIN inside USING (poly_id) JOIN places p ON p.id = inside.id)
    SELECT poly_id, round(avg(px), 4) AS wx, round(avg(py), 4) AS wy FROM i WHERE abs(atan2(sin(a), cos(a))) <= radians(45.0001) GROUP BY poly_id""",
)
def wedge_part(spark, d):
    """Centre of the points of a polygon in a wedge of 90 degrees from its site."""
    site = S.sites(spark, d).select(F.col("id").alias("poly_id"), F.col("x").alias("px"), F.col("y").alias("py"))
    places = S.points(spark, d).groupBy("x", "y").agg(F.count("id").alias("n"))
    i = spatial.in_rings(places, polygons(spark, d).join(site, "poly_id"), SQUARE)
    a = F.atan2(F.col("x") - F.col("px"), F.col("y") - F.col("py")) - F.radians((F.col("poly_id") % 8) * 45.0)
    mean = lambda v: F.round(F.sum(F.col(v) * F.col("n")) / F.sum("n"), 4)
    return i.filter(F.abs(F.atan2(F.sin(a), F.cos(a))) <= F.radians(F.lit(45.0001))).groupBy("poly_id").agg(mean("x").alias("wx"), mean("y").alias("wy"))


@register("simplify_dp", None)
def simplify_dp(spark, d):
    """Profiles of the grid's rows as lines, simplified: (r, before, after)."""
    line = F.transform(F.array_sort(F.collect_list(F.struct("c", "z"))), lambda p: F.struct(p["c"].cast("double").alias("x"), p["z"].cast("double").alias("y")))
    rows = S.frame(spark, d).groupBy("r").agg(line.alias("line"))
    return rows.withColumn("s", M.simplify(3.0)("line")).select("r", F.size("line").cast("long").alias("before"), F.size("s").cast("long").alias("after"))


@register("ring_filter", EDGES + " SELECT poly_id FROM e GROUP BY poly_id HAVING abs(sum(ax * qy - bx * ay)) / 2 >= 10000000")
def ring_filter(spark, d):
    return polygons(spark, d).filter(M.area(F.col("ring")) >= 1e7).select("poly_id")


@register("cell_set_algebra", f"WITH {G}, a AS (SELECT r, c FROM cells WHERE v > 30), b AS (SELECT r, c FROM cells WHERE acc > 100) SELECT 'intersection' AS op, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'difference', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'union', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b)")
def cell_set_algebra(spark, d):
    """Clip, difference and union of areas given as cells."""
    g = S.grid(spark, d)
    a, b = g.filter("v > 30").select("r", "c"), g.filter("acc > 100").select("r", "c")
    count = lambda df, op: df.agg(F.lit(op).alias("op"), F.count(F.lit(1)).alias("n"))
    return count(a.intersect(b), "intersection").unionByName(count(a.subtract(b), "difference")).unionByName(count(a.union(b).distinct(), "union"))


@register("mercator_points", f"WITH {P} SELECT id, round(radians(23 + x / 10000.0) * 6378137, 3) AS mx, round(ln(tan(pi() / 4 + radians(47 + y / 25000.0) / 2)) * 6378137, 3) AS my FROM sites")
def mercator_points(spark, d):
    mx, my = M.mercator(23 + F.col("x") / 10000.0, 47 + F.col("y") / 25000.0)
    return S.sites(spark, d).select("id", F.round(mx, 3).alias("mx"), F.round(my, 3).alias("my"))


@register("polygon_hash_draw", EDGES + " SELECT poly_id, id FROM (SELECT poly_id, id, row_number() OVER (PARTITION BY poly_id ORDER BY (id * 1103515245 + 12345) % 2147483648, id) AS k FROM inside) WHERE k <= 2")
def polygon_hash_draw(spark, d):
    """Two points per polygon, drawn by a hash of their ids."""
    draw = (F.col("id") * 1103515245 + 12345) % 2147483648
    first = lambda df, *by: df.withColumn("k", F.row_number().over(Window.partitionBy(*by).orderBy("draw", "id"))).filter("k <= 2").drop("k")
    # a polygon holds whole places, so no more than the first two of a place are drawn
    p = first(S.points(spark, d).select("id", "x", "y", draw.alias("draw")), "x", "y")
    i = spatial.in_polygons(p, polygons(spark, d), SQUARE).select("poly_id", "draw", "id")
    return first(i, "poly_id").select("poly_id", "id")
