"""Points snapped to the bank of a nearby channel.

Cells are squares of side `cell`, centres at (c + 0.5, r + 0.5) times it. A point's
window is RADIUS around it, narrowed to SECTOR degrees on either side of a bearing, seen
from the anchor (ax, ay), where one is given. The water class sets the least catchment; a river falls back to
a stream. The nearest cell gives the foot; the flow there, from the lowest to the
highest catchment among like cells around, tells left from right; the new point lies
OFFSET to the side of the bank named, else to the side where the point was.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RADIUS, SECTOR, OFFSET = 1500.0, 67.5, 150.0
LEAST = {"river": 10.0, "stream": 1.0, "ravine": 0.3}


def snapped(points: DataFrame, cells: DataFrame, cell: float) -> DataFrame:
    """points (id, x, y, water, bank, ax, ay, bearing); cells (r, c, acc). Rows (id, nx, ny,
    how, side, shift_m); points without a channel nearby are left out."""
    size = F.lit(RADIUS)
    wet = cells.filter(F.col("acc") >= min(LEAST.values())).select("r", "c", "acc", ((F.col("c") + 0.5) * cell).alias("cx"), ((F.col("r") + 0.5) * cell).alias("cy"))
    square = lambda v: F.floor(v / size).cast("long")
    dealt = wet.withColumn("sx", square(F.col("cx"))).withColumn("sy", square(F.col("cy")))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    p = points.withColumn("i", F.explode(around)).withColumn("j", F.explode(around)).withColumn("sx", square(F.col("x")) + F.col("i")).withColumn("sy", square(F.col("y")) + F.col("j")).drop("i", "j")
    dx, dy = F.col("cx") - F.col("x"), F.col("cy") - F.col("y")
    near = p.join(dealt, ["sx", "sy"]).withColumn("d2", dx * dx + dy * dy).filter(F.col("d2") <= RADIUS * RADIUS)
    turn = F.atan2(F.col("cx") - F.col("ax"), F.col("cy") - F.col("ay")) - F.radians("bearing")
    near = near.filter(F.col("bearing").isNull() | (F.abs(F.atan2(F.sin(turn), F.cos(turn))) <= F.radians(F.lit(SECTOR))))
    tier = F.when((F.col("water") == "river") & (F.col("acc") >= LEAST["river"]), F.lit(0)).when(F.col("water").isin("river", "stream") & (F.col("acc") >= LEAST["stream"]), F.lit(1)).when(F.col("water") == "ravine", F.lit(1))
    near = near.withColumn("tier", tier).filter("tier IS NOT NULL")
    foot = near.groupBy("id", "x", "y", "water", "bank").agg(F.min(F.struct("tier", "d2", "r", "c", "acc", "cx", "cy")).alias("f")).select("id", "x", "y", "water", "bank", "f.*")

    # flow at the foot: like cells within four steps
    steps = F.sequence(F.lit(-4).cast("long"), F.lit(4).cast("long"))
    feet = foot.select("id", F.col("acc").alias("own"), F.col("r").alias("fr"), F.col("c").alias("fc"))
    spots = feet.withColumn("i", F.explode(steps)).withColumn("j", F.explode(steps)).select("id", "own", (F.col("fr") + F.col("i")).alias("r"), (F.col("fc") + F.col("j")).alias("c"))
    like = spots.join(wet.select("r", "c", "acc"), ["r", "c"]).filter("acc >= own / 2 AND acc <= own * 2")
    key = F.struct("acc", "r", "c")
    v = like.groupBy("id").agg(F.min(key).alias("lo"), F.max(key).alias("hi")).select("id", (F.col("hi.c") - F.col("lo.c")).cast("double").alias("vx"), (F.col("hi.r") - F.col("lo.r")).cast("double").alias("vy"))
    out = foot.join(v, "id", "left").withColumn("len", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
    flows = F.coalesce(F.col("len") > 0, F.lit(False))
    px, py = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    cross = F.col("vx") * py - F.col("vy") * px
    side = F.when(~flows, "point").when(F.col("bank").isin("left", "right"), F.col("bank")).when(cross > 0, "left(side)").otherwise("right(side)")
    sign = F.when(F.col("side").startswith("left"), 1.0).otherwise(-1.0)
    back = F.sqrt(F.col("d2"))
    out = out.withColumn("side", side)
    ux = F.when(F.col("side") == "point", F.coalesce(F.try_divide(px, back), F.lit(0.0))).otherwise(-sign * F.col("vy") / F.col("len"))
    uy = F.when(F.col("side") == "point", F.coalesce(F.try_divide(py, back), F.lit(0.0))).otherwise(sign * F.col("vx") / F.col("len"))
    out = out.withColumn("nx", F.col("cx") + OFFSET * ux).withColumn("ny", F.col("cy") + OFFSET * uy)
    how = F.when((F.col("water") == "river") & (F.col("tier") == 1), "river->stream").otherwise(F.col("water"))
    moved = F.sqrt((F.col("nx") - F.col("x")) * (F.col("nx") - F.col("x")) + (F.col("ny") - F.col("y")) * (F.col("ny") - F.col("y")))
    return out.select("id", "nx", "ny", how.alias("how"), "side", moved.alias("shift_m"))


def landform(flags: dict[str, str]):
    """The landform by priority of its flags: floodplain, terrace, slope, plateau or cape."""
    return F.when(F.col(flags["floodplain"]) == 1, "floodplain").when(F.col(flags["terrace"]) == 1, "terrace").when(F.col(flags["slope"]) == 1, "slope").when((F.col(flags["plateau"]) == 1) | (F.col(flags["cape"]) == 1), "plateau").otherwise("other")


def water_class():
    """The water a point belongs to by its flags: river, stream or pond, ravine, else a
    stream if a bank is named."""
    return F.when(F.col("w_river") == 1, "river").when((F.col("w_stream") == 1) | (F.col("w_pond") == 1), "stream").when(F.col("w_ravine_water") == 1, "ravine").when(F.col("bank").isNotNull(), "stream")


