"""Readers: plain tables, layers, vector files, catalogues, scene lists and grids.

The grid adapters lay the event table out as a raster: row = user, column = event
modulo WIDTH, value = the largest whole value there; cells without events have no
value. Heights and catchments are closed forms of row and column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 200


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A layer, read with the columns asked for only."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def in_box(df: DataFrame, x0, y0, x1, y1, x: str = "x", y: str = "y") -> DataFrame:
    """Rows whose point lies in a box: plain comparisons, which reach the scan."""
    return df.filter(F.col(x).between(x0, x1) & F.col(y).between(y0, y1))


def geojson(spark: SparkSession, path: str, properties: dict[str, str]) -> DataFrame:
    """Features of a collection: the named properties, geometry type, coordinates as
    JSON text. Features without geometry are dropped."""
    fields = [T.StructField(k, T._parse_datatype_string(v)) for k, v in properties.items()]
    feature = T.StructType(
        [
            T.StructField("properties", T.StructType(fields)),
            T.StructField("geometry", T.StructType([T.StructField("type", T.StringType()), T.StructField("coordinates", T.StringType())])),
        ]
    )
    schema = T.StructType([T.StructField("features", T.ArrayType(feature))])
    rows = spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return rows.filter("f.geometry IS NOT NULL").select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("coordinates"))


def catalogue_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A headed CSV under a given schema; types aren't inferred, and an empty text
    stays apart from a missing one."""
    return spark.read.schema(schema).option("header", True).option("emptyValue", "").option("nullValue", "\\N").csv(path)


def raster_window(cells: DataFrame, r0: int, r1: int, c0: int, c1: int) -> DataFrame:
    """Cells of rows r0 to r1 and columns c0 to c1, limits included."""
    return cells.filter(F.col("r").between(r0, r1) & F.col("c").between(c0, c1))


def without_nodata(cells: DataFrame, nodata, value: str = "v") -> DataFrame:
    """No-data numbers and NaN become NULL, so that no comparison is true of them."""
    v = F.col(value)
    return cells.withColumn(value, F.when((v != F.lit(nodata)) & ~F.isnan(v.cast("double")), v))


def rows_of_grid(spark: SparkSession, sf_dir: str) -> int:
    """Number of grid rows: one scalar, told from the scan's statistics."""
    return int(table(spark, sf_dir, "events", ["user_id"]).agg(F.max("user_id")).first()[0] or 0) + 1


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with events: r, c, v (largest whole value), n (events)."""
    e = table(spark, sf_dir, "events", ["event_id", "user_id", "value"])
    return e.groupBy(F.col("user_id").cast("long").alias("r"), (F.col("event_id") % WIDTH).cast("long").alias("c")).agg(
        F.max(F.floor("value").cast("long")).alias("v"), F.count(F.lit(1)).alias("n")
    )


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells: r, c, z (height), acc (catchment)."""
    n = rows_of_grid(spark, sf_dir)
    cells = spark.range(0, n * WIDTH).select(F.expr(f"id div {WIDTH}").alias("r"), (F.col("id") % WIDTH).alias("c"))
    return cells.select("r", "c", height().alias("z"), catchment().alias("acc"))


def height(r="r", c="c"):
    """A valley along column 100 with rough slopes."""
    r, c = F.col(r), F.col(c)
    return 2 * F.abs(c - 100) + (r * 13 + c * 29) % 7


def catchment(r="r", c="c"):
    """Largest along the valley floor."""
    r, c = F.col(r), F.col(c)
    return 200 - 2 * F.abs(c - 100) + (r * 17 + c * 31) % 11


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All cells: r, c, z, acc and v (NULL where there are no events)."""
    return frame(spark, sf_dir).join(observed(spark, sf_dir).select("r", "c", "v"), ["r", "c"], "left")


#: The same grids for SQL, as common table expressions `ev` and `cells`.
SQL_GRID = """
ev AS MATERIALIZED (SELECT CAST(user_id AS BIGINT) AS r, CAST(event_id % 200 AS BIGINT) AS c, max(CAST(floor(value) AS BIGINT)) AS v, count(*) AS n
  FROM events GROUP BY 1, 2),
cells AS MATERIALIZED (SELECT f.r, f.c, 2 * abs(f.c - 100) + (f.r * 13 + f.c * 29) % 7 AS z, 200 - 2 * abs(f.c - 100) + (f.r * 17 + f.c * 31) % 11 AS acc, ev.v
  FROM (SELECT a.r, b.c FROM (SELECT unnest(range(0, (SELECT max(user_id) + 1 FROM events))) AS r) a, (SELECT unnest(range(0, 200)) AS c) b) f
  LEFT JOIN ev ON ev.r = f.r AND ev.c = f.c),
dims AS MATERIALIZED (SELECT max(r) + 1 AS nr, 200 AS nc FROM cells)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places: customers at hashed whole coordinates, kind = segment."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment", "c_nationkey"]).select(
        k.alias("id"), ((k * 7919) % 100003).alias("x"), ((k * 104729) % 100003).alias("y"), F.col("c_mktsegment").alias("kind"), F.col("c_nationkey").cast("long").alias("district")
    )


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites: suppliers at hashed whole coordinates."""
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"]).select(
        k.alias("id"), ((k * 15485863) % 100003).alias("x"), ((k * 32452843) % 100003).alias("y"), F.col("s_nationkey").cast("long").alias("district")
    )


SQL_POINTS = """
places AS (SELECT c_custkey AS id, (c_custkey * 7919) % 100003 AS x, (c_custkey * 104729) % 100003 AS y, c_mktsegment AS kind, CAST(c_nationkey AS BIGINT) AS district FROM customer),
sites AS (SELECT s_suppkey AS id, (s_suppkey * 15485863) % 100003 AS x, (s_suppkey * 32452843) % 100003 AS y, CAST(s_nationkey AS BIGINT) AS district FROM supplier)
"""


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations of a scene stack: pixel = user, scene = day; bands from value
    and props, cloud = error events."""
    e = table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type", "value", "props"])
    k = F.get_json_object("props", "$.k").cast("long")
    whole = F.floor(F.col("value") * 20).cast("long")
    return e.select(
        F.col("user_id").cast("long").alias("pixel"), F.to_date("ts").alias("scene"), "event_id",
        (1000 + whole).alias("red"), (1000 + whole + k * 10).alias("nir"), (1000 + whole + k * 7).alias("swir1"), (1000 + whole + (k % 30) * 10).alias("swir2"),
        F.when(F.col("event_type") == "error", 9).when(F.col("event_type") == "signup", 4).otherwise(5).cast("long").alias("scl"),
    )


SQL_SCENES = """
obs AS (SELECT CAST(user_id AS BIGINT) AS pixel, CAST(ts AS DATE) AS scene, event_id,
  1000 + CAST(floor(value * 20) AS BIGINT) AS red,
  1000 + CAST(floor(value * 20) AS BIGINT) + CAST(json_extract_string(props, '$.k') AS BIGINT) * 10 AS nir,
  1000 + CAST(floor(value * 20) AS BIGINT) + CAST(json_extract_string(props, '$.k') AS BIGINT) * 7 AS swir1,
  1000 + CAST(floor(value * 20) AS BIGINT) + (CAST(json_extract_string(props, '$.k') AS BIGINT) % 30) * 10 AS swir2,
  CAST(CASE event_type WHEN 'error' THEN 9 WHEN 'signup' THEN 4 ELSE 5 END AS BIGINT) AS scl FROM events)
"""
