"""Published layers: features, contracts, colours, fans, sealed payloads."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import publish as U
from ..sources import tables as S
from ..sources.tables import SQL_POINTS as P
from ..sources.tables import table

Q: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


@register("geojson_features", f"""WITH {P} SELECT id, '{{"type":"Feature","properties":{{"id":' || id || ',"kind":"' || kind || '"}},"geometry":{{"type":"Point","coordinates":[' || x || ',' || y || ']}}}}' AS feature FROM places""")
def geojson_features(spark, d):
    return S.points(spark, d).select("id", U.point_feature(F.col("x"), F.col("y"), 0, id=F.col("id"), kind=F.col("kind")).alias("feature"))


@register("public_contract", "SELECT n_name AS district, CAST(count(*) FILTER (c_mktsegment = 'BUILDING') AS BIGINT) AS settlements, CAST(count(*) FILTER (c_mktsegment = 'MACHINERY') AS BIGINT) AS burials, round(avg(c_acctbal), 4) AS point FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def public_contract(spark, d):
    c = table(spark, d, "customer", ["c_nationkey", "c_mktsegment", "c_acctbal"]).join(table(spark, d, "nation", ["n_nationkey", "n_name"]), F.col("c_nationkey") == F.col("n_nationkey"))
    g = c.groupBy(F.col("n_name").alias("district")).agg(F.count_if(F.col("c_mktsegment") == "BUILDING").alias("settlements"), F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("burials"), F.round(F.avg("c_acctbal"), 4).alias("point"))
    return U.contract(g, ("district", "settlements", "burials", "point"))


@register("class_colours", "SELECT p_partkey, ['#00000000', '#f7f3e8d7', '#e6d8b8d7', '#cfb48ad7', '#b08a5fd7', '#8a623fd7', '#5f4029d7', '#352216d7'][p_size % 8 + 1] AS rgba FROM part")
def class_colours(spark, d):
    return table(spark, d, "part", ["p_partkey", "p_size"]).select("p_partkey", U.rgba(F.col("p_size") % 8).alias("rgba"))


@register("fan_out", """SELECT c_custkey AS id, round(CASE WHEN n = 1 THEN 0 ELSE 70 * cos(2 * pi() * k / n) END, 4) AS dx, round(CASE WHEN n = 1 THEN 0 ELSE 70 * sin(2 * pi() * k / n) END, 4) AS dy
    FROM (SELECT c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)""")
def fan_out(spark, d):
    """Points at one place, spread on a circle of 70 m."""
    w = Window.partitionBy("c_nationkey")
    c = table(spark, d, "customer", ["c_custkey", "c_nationkey"]).withColumn("k", F.row_number().over(w.orderBy("c_custkey")) - 1).withColumn("n", F.count(F.lit(1)).over(w))
    angle = F.lit(2 * math.pi) * F.col("k") / F.col("n")
    move = lambda f: F.round(F.when(F.col("n") == 1, 0.0).otherwise(70 * f(angle)), 4)
    return c.select(F.col("c_custkey").alias("id"), move(F.cos).alias("dx"), move(F.sin).alias("dy"))


@register("role_union", f"WITH {P} SELECT 'before' AS role, id, x, y FROM sites UNION ALL SELECT 'after', id, x + 150, y FROM sites WHERE id % 3 <> 0 UNION ALL SELECT 'candidate', id, x, y FROM places WHERE id % 50 = 0")
def role_union(spark, d):
    s = S.sites(spark, d).select("id", "x", "y")
    role = lambda df, name: df.select(F.lit(name).alias("role"), "id", "x", "y")
    after = s.filter("id % 3 <> 0").withColumn("x", F.col("x") + 150)
    return role(s, "before").unionByName(role(after, "after")).unionByName(role(S.points(spark, d).filter("id % 50 = 0"), "candidate"))


@register("visibility_filter", f"WITH {P} SELECT id, kind FROM places WHERE kind IN ('BUILDING', 'FURNITURE') AND NOT (district > 12 AND id % 2 = 0)")
def visibility_filter(spark, d):
    return S.points(spark, d).filter(F.col("kind").isin("BUILDING", "FURNITURE") & ~((F.col("district") > 12) & (F.col("id") % 2 == 0))).select("id", "kind")


@register("accuracy_classes", "SELECT o_orderkey AS id, c AS class, CAST(CASE c WHEN 'A' THEN 150 WHEN 'B' THEN 300 WHEN 'C' THEN 750 ELSE 1500 END AS INTEGER) AS radius FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'A' WHEN o_orderstatus = 'O' THEN 'B' WHEN o_orderpriority <> '5-LOW' THEN 'C' ELSE 'D' END AS c FROM orders)")
def accuracy_classes(spark, d):
    o = table(spark, d, "orders", ["o_orderkey", "o_orderstatus", "o_orderpriority"])
    snap = F.when(F.col("o_orderstatus") == "F", "named").when(F.col("o_orderstatus") == "O", "dem").otherwise("")
    placed = F.when(F.col("o_orderpriority") == "5-LOW", "node").otherwise("rules")
    c = o.select(F.col("o_orderkey").alias("id"), U.accuracy(snap, placed).alias("class"))
    return c.withColumn("radius", F.create_map(*[F.lit(v) for kv in U.RADIUS.items() for v in kv])[F.col("class")])


@register("stats_document", None)
def stats_document(spark, d):
    """Figures of a layer as one JSON document."""
    p = S.points(spark, d)
    kinds = p.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("kinds"))
    total = p.agg(F.count(F.lit(1)).alias("places"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    return total.join(F.broadcast(kinds)).select(F.to_json(F.struct("places", F.struct("x0", "x1").alias("bounds"), "kinds")).alias("document"))


@register("sealed_payload", None)
def sealed_payload(spark, d):
    """Features of all sites, sealed by chunks of 1000 ids. Salt and iv are fixed here
    so that reruns agree."""
    rows = S.sites(spark, d).select(F.floor((F.col("id") - 1) / 1000).cast("long").alias("chunk"), U.point_feature(F.col("x"), F.col("y"), 0, id=F.col("id")).alias("f"))
    return U.sealed_chunks(rows, "chunk", "f", "a phrase of many words", bytes(range(16)), bytes(range(12)))
