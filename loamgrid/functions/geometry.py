"""Geometry as column expressions: rings are arrays of struct<x, y>, not closed."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def ring(*points: tuple) -> Column:
    """A ring of corner columns or numbers."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.array(*[F.struct(as_column(x).cast("double").alias("x"), as_column(y).cast("double").alias("y")) for x, y in points])


def edges(r: Column) -> Column:
    """Pairs of neighbouring corners, the last with the first."""
    return F.zip_with(r, F.concat(F.slice(r, F.lit(2), F.size(r)), F.slice(r, F.lit(1), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def contains(r: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a ring: odd number of edges crossed to the right."""
    crossed = F.filter(
        edges(r),
        lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / F.when(e["b"]["y"] == e["a"]["y"], F.lit(None)).otherwise(e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]),
    )
    return F.size(crossed) % 2 == 1


def area(r: Column) -> Column:
    """Twice the signed sum of cross products, halved and made positive."""
    total = F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"])
    return F.abs(total) / 2


def centroid(r: Column) -> Column:
    """Mean of the corners weighted by the triangles with the origin."""
    cross = lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]
    total = F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + cross(e))
    x = F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + (e["a"]["x"] + e["b"]["x"]) * cross(e))
    y = F.aggregate(edges(r), F.lit(0.0), lambda s, e: s + (e["a"]["y"] + e["b"]["y"]) * cross(e))
    return F.struct((x / (3 * total)).alias("x"), (y / (3 * total)).alias("y"))


def segment_distance2(px, py, ax, ay, bx, by) -> Column:
    """Squared distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.coalesce(F.try_divide((px - ax) * dx + (py - ay) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return (px - ax - t * dx) * (px - ax - t * dx) + (py - ay - t * dy) * (py - ay - t * dy)


DIRECTIONS = {"N": 0, "NE": 45, "E": 90, "SE": 135, "S": 180, "SW": 225, "W": 270, "NW": 315}


def bearing(direction: Column) -> Column:
    """Degrees clockwise from north; NULL for other texts."""
    return F.create_map(*[F.lit(v) for kv in DIRECTIONS.items() for v in kv])[direction].cast("double")


def unit(degrees: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def ray_reach(r: Column, x: Column, y: Column, degrees: Column, limit: float) -> Column:
    """Distance of the farthest crossing of a ray with a ring within a limit; 0 if none."""
    ux, uy = unit(degrees)

    def hit(e):
        ex, ey = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        det = ux * -ey + uy * ex
        rx, ry = e["a"]["x"] - x, e["a"]["y"] - y
        t = F.try_divide(rx * -ey + ry * ex, F.when(F.abs(det) < 1e-9, F.lit(None)).otherwise(det))
        s = F.try_divide(ux * ry - uy * rx, F.when(F.abs(det) < 1e-9, F.lit(None)).otherwise(det))
        return F.when((t >= 0) & (t <= limit) & (s >= 0) & (s <= 1), t)

    return F.coalesce(F.array_max(F.transform(edges(r), hit)), F.lit(0.0))


def crossing(ax, ay, da, bx, by, db) -> Column:
    """Where two rays meet, as struct<x, y>; NULL if parallel, behind either start, or
    farther than 1.2 times the starts' distance and 500."""
    ux, uy = unit(da)
    vx, vy = unit(db)
    det = ux * -vy + uy * vx
    wx, wy = bx - ax, by - ay
    safe = F.when(F.abs(det) >= 1e-9, det)
    t, u = (wx * -vy + wy * vx) / safe, (ux * wy - uy * wx) / safe
    reach = 1.2 * F.sqrt(wx * wx + wy * wy) + 500
    return F.when((t > 0) & (u > 0) & (t <= reach) & (u <= reach), F.struct((ax + t * ux).alias("x"), (ay + t * uy).alias("y")))


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Web Mercator metres of degrees."""
    radius = 6378137.0
    return F.radians(lon) * radius, F.log(F.tan(F.lit(np.pi / 4) + F.radians(lat) / 2)) * radius


def simplified(points: list, tolerance: float) -> list:
    """A line without the points that lie nearer than the tolerance to the chords of
    those kept (farthest point first); the ends stay."""
    p = np.array([(q["x"], q["y"]) for q in points], float)
    keep = np.zeros(len(p), bool)
    if len(p):
        keep[[0, -1]] = True
    todo = [(0, len(p) - 1)]
    while todo:
        i, j = todo.pop()
        if j - i < 2:
            continue
        a, d = p[i], p[j] - p[i]
        rel = p[i + 1 : j] - a
        norm = float(d @ d)
        t = np.clip(rel @ d / norm, 0, 1) if norm else np.zeros(len(rel))
        far = np.hypot(*(rel - t[:, None] * d).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return [points[i] for i in np.flatnonzero(keep)]


def simplify(tolerance: float):
    """A pandas UDF: the recursion has no column form."""

    @F.pandas_udf("array<struct<x: double, y: double>>")
    def run(lines: pd.Series) -> pd.Series:
        return lines.map(lambda line: simplified(list(line), tolerance))

    return run
