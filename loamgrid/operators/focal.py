"""Neighbourhood operators on cell tables (r, c, value columns).

Windows run along lines of the grid. A line is cut into bands with copies of the
cells within reach of a band's ends, so that no window partition grows with the
grid. Frames are by index, so missing cells are simply absent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BAND = 1024


def banded(df: DataFrame, line: str, place: str, reach: int):
    """df with band copies, and the window of `reach` places to either side; rows
    with home = true are the originals."""
    first, last = F.expr(f"(`{place}` - {reach} - pmod(`{place}` - {reach}, {BAND})) div {BAND}"), F.expr(f"(`{place}` + {reach} - pmod(`{place}` + {reach}, {BAND})) div {BAND}")
    home = F.expr(f"(`{place}` - pmod(`{place}`, {BAND})) div {BAND}")
    copies = df.withColumn("band", F.explode(F.sequence(first, last))).withColumn("home", F.col("band") == home)
    return copies, Window.partitionBy(line, "band").orderBy(place).rangeBetween(-reach, reach)


def along(df: DataFrame, line: str, place: str, reach: int, **columns: Column) -> DataFrame:
    """Adds aggregates over the `reach` places to either side on a line."""
    copies, window = banded(df, line, place, reach)
    for name, aggregate in columns.items():
        copies = copies.withColumn(name, aggregate.over(window))
    return copies.filter("home").drop("band", "home")


def padded(df: DataFrame, place: str, n: int, reach: int, mode: str) -> DataFrame:
    """Rows beyond both ends of an axis of n places: `reflect` mirrors the border
    (…b a | a b…), `nearest` repeats the outermost place."""
    i = F.col(place)
    if mode == "reflect":
        spots = F.array_compact(F.array(i, F.when(i < reach, -i - 1), F.when(i >= n - reach, 2 * n - 1 - i)))
    elif mode == "nearest":
        low = F.when(i == 0, F.sequence(F.lit(-reach).cast("long"), F.lit(-1).cast("long")))
        high = F.when(i == n - 1, F.sequence(F.lit(n).cast("long"), F.lit(n - 1 + reach).cast("long")))
        none = F.array().cast("array<long>")
        spots = F.concat(F.array(i.cast("long")), F.coalesce(low, none), F.coalesce(high, none))
    else:
        raise ValueError(mode)
    return df.withColumn(place, F.explode(spots))


def box(df: DataFrame, value: str, reach_r: int, reach_c: int, shape: tuple[int, int] | None = None, mode: str = "none") -> DataFrame:
    """Adds total and count of a value over the box around each cell; NULLs don't
    count. mode: `none` (cells outside don't exist), `reflect` or `nearest`."""
    part = df.select("r", "c", F.col(value).alias("own"))
    if mode != "none":
        part = padded(part, "r", shape[0], reach_r, mode)
        part = padded(part, "c", shape[1], reach_c, mode)
    part = along(part, "c", "r", reach_r, s=F.sum("own"), k=F.count("own"))
    part = along(part, "r", "c", reach_c, total=F.sum("s"), count=F.sum("k"))
    return df.join(part.select("r", "c", "total", "count"), ["r", "c"])


def extreme(df: DataFrame, value: str, reach: int, kind: str) -> DataFrame:
    """Adds the least or greatest value of the box around each cell, as `extreme`."""
    f = {"min": F.min, "max": F.max}[kind]
    part = along(df.select("r", "c", F.col(value).alias("own")), "c", "r", reach, s=f("own"))
    return df.join(along(part, "r", "c", reach, extreme=f("s")).select("r", "c", "extreme"), ["r", "c"])


def spread(df: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Each row once per offset, moved by it: an aggregate by (r, c) is then one over
    the neighbourhood, combined before the shuffle."""
    moves = F.array(*[F.struct(F.lit(dr).cast("long").alias("dr"), F.lit(dc).cast("long").alias("dc")) for dr, dc in offsets])
    return df.withColumn("move", F.explode(moves)).withColumn("r", F.col("r") + F.col("move.dr")).withColumn("c", F.col("c") + F.col("move.dc")).drop("move")


def disk(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if i * i + j * j <= radius * radius]


def diamond(radius: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-radius, radius + 1) for j in range(-radius, radius + 1) if abs(i) + abs(j) <= radius]


def dilated(mask: DataFrame, radius: int) -> DataFrame:
    """Cells (r, c) within `radius` steps, up, down, left or right, of a mask's cells."""
    return spread(mask.select("r", "c"), diamond(radius)).distinct()


def window_median(df: DataFrame, value: str, reach: int, shape: tuple[int, int]) -> DataFrame:
    """Adds the median over the box around each cell, borders reflected."""
    part = padded(padded(df.select("r", "c", F.col(value).alias("own")), "r", shape[0], reach, "reflect"), "c", shape[1], reach, "reflect")
    part = along(part, "c", "r", reach, some=F.collect_list("own"))
    part = along(part, "r", "c", reach, all=F.collect_list("some"))
    m = part.select("r", "c", F.sort_array(F.flatten("all")).alias("s")).withColumn("n", F.size("s"))
    mid = (F.get("s", F.expr("(n - 1) div 2").cast("int")) + F.get("s", F.expr("n div 2").cast("int"))) / 2.0
    return df.join(m.select("r", "c", mid.alias("median")), ["r", "c"])


def gradient(df: DataFrame, value: str, cell: float, shape: tuple[int, int]) -> DataFrame:
    """Adds d_r and d_c: central differences, one-sided at the borders."""
    wanted = df.select("r", "c", F.col(value).alias("own"))
    for line, place, n, name in (("c", "r", shape[0], "d_r"), ("r", "c", shape[1], "d_c")):
        copies, _ = banded(wanted, line, place, 1)
        w = Window.partitionBy(line, "band").orderBy(place)
        low, high = F.coalesce(F.lag("own").over(w), F.col("own")), F.coalesce(F.lead("own").over(w), F.col("own"))
        steps = F.when((F.col(place) == 0) | (F.col(place) == n - 1), 1.0).otherwise(2.0)
        wanted = copies.withColumn(name, (high - low) / (steps * cell)).filter("home").drop("band", "home")
    return df.join(wanted.drop("own"), ["r", "c"])
