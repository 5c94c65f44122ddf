"""Cell-table operators beyond plain windows: blocks, resampling, sampling at
points, mosaics, polygons to cells, flow over heights."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .focal import spread

NEIGHBOURS = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i, j) != (0, 0)]


def block_mean(df: DataFrame, value: str, k: int, share: float, shape: tuple[int, int]) -> DataFrame:
    """Means of k by k blocks with at least a share of values; a part of a block at
    the far borders is left out. Rows (br, bc, mean)."""
    whole = df.filter((F.col("r") < shape[0] // k * k) & (F.col("c") < shape[1] // k * k))
    g = whole.groupBy(F.expr(f"r div {k}").alias("br"), F.expr(f"c div {k}").alias("bc")).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    return g.filter(F.col("n") >= share * k * k).select("br", "bc", (F.col("s") / F.col("n")).alias("mean"))


def sample(points: DataFrame, cells: DataFrame, r: Column, c: Column, *values: str) -> DataFrame:
    """Cell values at points; outside the grid NULL."""
    at = points.withColumn("r", r.cast("long")).withColumn("c", c.cast("long"))
    return at.join(cells.select("r", "c", *values), ["r", "c"], "left").drop("r", "c")


def disk_sample(points: DataFrame, cells: DataFrame, key: str, radius: int, **aggregates: Column) -> DataFrame:
    """Aggregates over the cells of the disk around each point (key, r, c)."""
    from .focal import disk

    around = spread(points.select(key, "r", "c"), disk(radius))
    return around.join(cells, ["r", "c"]).groupBy(key).agg(*[a.alias(n) for n, a in aggregates.items()])


def bilinear(targets: DataFrame, cells: DataFrame, value: str, y: Column, x: Column, key: list[str]) -> DataFrame:
    """Values at fractional cell positions: weights of the four cells around; cells
    without a value don't count, and the weights left are scaled up."""
    t = targets.withColumn("y", y).withColumn("x", x)
    t = t.withColumn("fy", F.floor("y").cast("long")).withColumn("fx", F.floor("x").cast("long"))
    corner = lambda i, j: F.struct((F.col("fy") + i).alias("r"), (F.col("fx") + j).alias("c"), ((F.col("y") - F.col("fy") if i else 1 - F.col("y") + F.col("fy")) * (F.col("x") - F.col("fx") if j else 1 - F.col("x") + F.col("fx"))).alias("w"))
    four = t.select(*key, F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("k")).select(*key, "k.r", "k.c", "k.w")
    got = four.filter("w > 0").join(cells.select("r", "c", F.col(value).alias("own")).filter("own IS NOT NULL"), ["r", "c"])
    return got.groupBy(*key).agg((F.sum(F.col("own") * F.col("w")) / F.sum("w")).alias("value"))


def resample(cells: DataFrame, value: str, k: int, how: str) -> DataFrame:
    """Coarser cells of k by k: average, mode (ties to the smaller), max or nearest
    (the value of the cell that holds the centre)."""
    key = [F.expr(f"r div {k}").alias("tr"), F.expr(f"c div {k}").alias("tc")]
    some = cells.filter(F.col(value).isNotNull())
    if how == "average":
        return some.groupBy(*key).agg(F.avg(value).alias("value"))
    if how == "max":
        return some.groupBy(*key).agg(F.max(value).alias("value"))
    if how == "mode":
        n = some.groupBy(*key, F.col(value).alias("own")).agg(F.count(F.lit(1)).alias("n"))
        return n.groupBy("tr", "tc").agg(F.min(F.struct((-F.col("n")).alias("n"), "own"))["own"].alias("value"))
    if how == "nearest":
        return cells.filter((F.col("r") % k == k // 2) & (F.col("c") % k == k // 2)).select(*key, F.col(value).alias("value"))
    raise ValueError(how)


def mosaic(cells: DataFrame, order: str, value: str, last: bool = False) -> DataFrame:
    """One value per cell of several sources: the first in order that has one, or
    the last that isn't zero."""
    if last:
        return cells.filter(F.col(value) > 0).groupBy("r", "c").agg(F.max_by(value, order).alias(value))
    return cells.filter(F.col(value).isNotNull()).groupBy("r", "c").agg(F.min_by(value, order).alias(value))


def calibrated_mosaic(tiles: list[DataFrame], value: str, least: int) -> tuple[DataFrame, list[dict]]:
    """Tiles in order; a new one is scaled by the median of have / new over the cells
    that both hold, where these are more than `least`; then the mean per cell. The
    loop is over tiles; each costs one aggregate. Returns cells and seam figures."""
    have, seams = None, []
    for i, tile in enumerate(tiles):
        new = tile.select("r", "c", F.col(value).cast("double").alias("new")).filter("new IS NOT NULL")
        if have is None:
            have = new.select("r", "c", F.col("new").alias("total"), F.lit(1).alias("n"))
            continue
        seam = have.join(new, ["r", "c"]).agg(F.count(F.lit(1)).alias("k"), F.median(F.try_divide(F.col("total") / F.col("n"), "new")).alias("ratio")).first()
        ratio = float(seam.ratio) if seam.k > least and seam.ratio is not None else 1.0
        seams.append({"tile": i, "cells": seam.k, "ratio": ratio})
        scaled = new.withColumn("new", F.col("new") * ratio)
        have = have.join(scaled, ["r", "c"], "full").select("r", "c", (F.coalesce("total", F.lit(0.0)) + F.coalesce("new", F.lit(0.0))).alias("total"), (F.coalesce("n", F.lit(0)) + F.col("new").isNotNull().cast("int")).alias("n"))
    return have.select("r", "c", (F.col("total") / F.col("n")).alias(value), F.col("n").cast("long").alias("n")), seams


def flow_direction(cells: DataFrame, height: str) -> DataFrame:
    """Adds tr, tc: the lowest lower neighbour (least drop distance first: straight
    ones weigh their drop fully, diagonal ones by 1/sqrt 2); NULL in pits."""
    drop = spread(cells.select("r", "c", F.col("r").alias("sr"), F.col("c").alias("sc"), F.col(height).alias("from")), NEIGHBOURS)
    steps = drop.join(cells.select("r", "c", F.col(height).alias("to")), ["r", "c"])
    far = F.when((F.col("r") != F.col("sr")) & (F.col("c") != F.col("sc")), F.lit(2)).otherwise(F.lit(1))
    # drop / distance in squares keeps the order and stays in whole numbers
    steep = -(F.col("from") - F.col("to")) * (F.col("from") - F.col("to")) * F.lit(2) / far
    best = steps.filter(F.col("to") < F.col("from")).groupBy("sr", "sc").agg(F.min(F.struct(steep.alias("s"), F.col("r").alias("tr"), F.col("c").alias("tc"))).alias("m"))
    return cells.join(best.select(F.col("sr").alias("r"), F.col("sc").alias("c"), "m.tr", "m.tc"), ["r", "c"], "left")


def accumulation(flow: DataFrame, rounds: int = 40) -> DataFrame:
    """Cells (r, c, tr, tc) with n: how many cells drain through each, itself
    included. Path doubling: each round doubles the length of the paths followed."""
    from .components import ensure_checkpoints

    ensure_checkpoints(flow.sparkSession)
    jumps = flow.select("r", "c", "tr", "tc").checkpoint()
    n = jumps.select("r", "c", F.lit(1).cast("long").alias("n")).checkpoint()
    for _ in range(rounds):
        if not jumps.filter("tr IS NOT NULL").limit(1).count():
            return n
        sent = jumps.filter("tr IS NOT NULL").join(n, ["r", "c"]).groupBy(F.col("tr").alias("r"), F.col("tc").alias("c")).agg(F.sum("n").alias("more"))
        n = n.join(sent, ["r", "c"], "left").select("r", "c", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")).checkpoint()
        on = jumps.select(F.col("r").alias("tr"), F.col("c").alias("tc"), F.col("tr").alias("r2"), F.col("tc").alias("c2"))
        jumps = jumps.join(on, ["tr", "tc"], "left").select("r", "c", F.col("r2").alias("tr"), F.col("c2").alias("tc")).checkpoint()
    raise RuntimeError("flow paths don't end")


def filled(cells: DataFrame, height: str, tile: str) -> DataFrame:
    """Heights with depressions filled to their spill level, tile by tile (column
    `tile`): a priority flood from a tile's border, which has to be sequential."""

    def flood(pdf: pd.DataFrame) -> pd.DataFrame:
        z = {(r, c): h for r, c, h in zip(pdf["r"], pdf["c"], pdf[height])}
        out, queue = {}, []
        for (r, c), h in z.items():
            if any((r + i, c + j) not in z for i, j in NEIGHBOURS):
                out[r, c] = h
                heapq.heappush(queue, (h, r, c))
        while queue:
            h, r, c = heapq.heappop(queue)
            for i, j in NEIGHBOURS:
                k = (r + i, c + j)
                if k in z and k not in out:
                    out[k] = max(h, z[k])
                    heapq.heappush(queue, (out[k], *k))
        return pd.DataFrame({"r": [k[0] for k in out], "c": [k[1] for k in out], "filled": list(out.values())})

    kind = dict(cells.dtypes)[height]
    return cells.select(tile, "r", "c", height).groupBy(tile).applyInPandas(flood, f"r long, c long, filled {kind}")


def boundary_edges(labels: DataFrame) -> DataFrame:
    """Sides of labelled cells that face another label or none: (label, r, c, side);
    the rings of a polygon of cells."""
    sides = F.array(*[F.struct(F.lit(n).alias("side"), F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for n, i, j in (("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("e", 0, 1))])
    faces = labels.withColumn("f", F.explode(sides)).select("label", "r", "c", "f.side", (F.col("r") + F.col("f.i")).alias("r2"), (F.col("c") + F.col("f.j")).alias("c2"))
    other = labels.select(F.col("r").alias("r2"), F.col("c").alias("c2"), F.col("label").alias("beyond"))
    return faces.join(other, ["r2", "c2"], "left").filter(~F.col("label").eqNullSafe(F.col("beyond"))).select("label", "r", "c", "side")


def percentile_breaks(values: np.ndarray, shares: list[float]) -> list[float]:
    return [float(x) for x in np.percentile(values, [100 * s for s in shares])]


def classify(value: Column, breaks: list[float]) -> Column:
    """1 + how many breaks a value reaches; 0 without a value."""
    n = sum((F.when(value >= b, 1).otherwise(0) for b in breaks), F.lit(0))
    return F.when(value.isNull(), F.lit(0)).otherwise(n + 1)


def walk(starts: DataFrame, cells: DataFrame, key: str, step_r: str, step_c: str, steps: int, height: str) -> DataFrame:
    """Heights along a walk from each start by unit steps, as a running maximum above
    the start: (key, step, rise); missing heights count as 0 rise."""
    s = starts.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    at = s.withColumn("r", F.col("r") + F.col("step") * F.col(step_r)).withColumn("c", F.col("c") + F.col("step") * F.col(step_c))
    seen = at.join(cells.select("r", "c", F.col(height).alias("h")), ["r", "c"], "left")
    rise = F.greatest(F.coalesce(F.col("h") - F.col("z0"), F.lit(0)), F.lit(0))
    return seen.withColumn("rise", F.max(rise).over(Window.partitionBy(key).orderBy("step"))).select(key, F.col("step").cast("long").alias("step"), F.col("rise").cast("long").alias("rise"))
