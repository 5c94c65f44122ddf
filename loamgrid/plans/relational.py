"""Relational queries: gates, mappings, joins, aggregates, sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import SQL_POINTS, points, table

Q: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None):
    def put(f):
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


@register("gate_projection", "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal IS NOT NULL AND c_mktsegment IN ('BUILDING', 'MACHINERY')")
def gate_projection(spark, d):
    c = table(spark, d, "customer")
    kept = R.keep_columns(c, ["c_custkey", "c_name", "c_mktsegment", "not_there"], also=["c_acctbal"])
    return R.gate(kept, "c_acctbal", "c_mktsegment", ("BUILDING", "MACHINERY")).drop("c_acctbal")


@register(
    "class_case_map",
    """SELECT layer, CAST(count(*) AS BIGINT) AS parts FROM (SELECT CASE WHEN p_type = 'STANDARD' THEN 'chernozem'
    WHEN p_brand IN ('Brand#1', 'Brand#2') THEN 'grey_forest' WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'podzolized' END AS layer FROM part)
    WHERE layer IS NOT NULL GROUP BY layer""",
)
def class_case_map(spark, d):
    p = table(spark, d, "part", ["p_type", "p_brand"])
    layer = R.first_case([(F.col("p_type") == "STANDARD", "chernozem"), (F.col("p_brand").isin("Brand#1", "Brand#2"), "grey_forest"), (F.col("p_type").isin("PROMO", "ECONOMY"), "podzolized")])
    return p.select(layer.alias("layer")).filter("layer IS NOT NULL").groupBy("layer").agg(F.count(F.lit(1)).alias("parts"))


@register("unknown_categories", "SELECT p_type AS category, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_type NOT IN ('STANDARD', 'PROMO', 'LARGE') GROUP BY p_type")
def unknown_categories(spark, d):
    return R.unknown(table(spark, d, "part", ["p_type"]), "p_type", ("STANDARD", "PROMO", "LARGE"))


@register("count_by_type", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def count_by_type(spark, d):
    return table(spark, d, "events", ["event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@register(
    "village_rollup",
    """SELECT CAST(c_nationkey AS BIGINT) AS district, arg_min(c_name, c_custkey) AS first_name,
    CAST(count(*) FILTER (c_mktsegment = 'BUILDING') AS BIGINT) AS settlements, CAST(count(*) FILTER (c_mktsegment = 'MACHINERY') AS BIGINT) AS burials,
    string_agg(CAST(c_custkey AS VARCHAR), ', ' ORDER BY c_custkey) AS numbers FROM customer GROUP BY c_nationkey""",
)
def village_rollup(spark, d):
    c = table(spark, d, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"])
    return c.groupBy(F.col("c_nationkey").cast("long").alias("district")).agg(
        F.min_by("c_name", "c_custkey").alias("first_name"),
        F.count_if(F.col("c_mktsegment") == "BUILDING").alias("settlements"),
        F.count_if(F.col("c_mktsegment") == "MACHINERY").alias("burials"),
        F.array_join(F.transform(F.sort_array(F.collect_list("c_custkey")), lambda x: x.cast("string")), ", ").alias("numbers"),
    )


@register(
    "dominant_component",
    """SELECT l_partkey AS unit, l_returnflag || l_linestatus AS soil, l_quantity AS share FROM (SELECT *, row_number() OVER
    (PARTITION BY l_partkey ORDER BY l_quantity DESC, l_orderkey, l_linenumber, l_returnflag || l_linestatus) AS k FROM lineitem) WHERE k = 1""",
)
def dominant_component(spark, d):
    l = table(spark, d, "lineitem", ["l_partkey", "l_quantity", "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus"])  # noqa: E741
    return R.dominant(
        l.select(F.col("l_partkey").alias("unit"), F.concat("l_returnflag", "l_linestatus").alias("soil"), F.col("l_quantity").alias("share"), "l_orderkey", "l_linenumber"),
        "unit", "soil", "share", ["l_orderkey", "l_linenumber"],
    )


@register(
    "vote_district_code",
    """WITH lone AS (SELECT p_name FROM part GROUP BY p_name, p_type HAVING count(*) = 1),
    votes AS (SELECT p_type AS old_district, p_brand AS code, count(*) AS n, min(p_partkey) AS first FROM part
      WHERE (p_name, p_type) IN (SELECT p_name, p_type FROM part GROUP BY p_name, p_type HAVING count(*) <= 5) GROUP BY 1, 2)
    SELECT old_district, code, CAST(n AS BIGINT) AS votes FROM (SELECT *, row_number() OVER (PARTITION BY old_district ORDER BY n DESC, first) AS k FROM votes) WHERE k = 1""",
)
def vote_district_code(spark, d):
    p = table(spark, d, "part", ["p_partkey", "p_name", "p_type", "p_brand"])
    clear = p.groupBy("p_name", "p_type").agg(F.count(F.lit(1)).alias("n")).filter("n <= 5").select("p_name", "p_type")
    rows = p.join(clear, ["p_name", "p_type"], "left_semi").select(F.col("p_type").alias("old_district"), F.col("p_brand").alias("code"), "p_partkey")
    return R.vote(rows, "old_district", "code", "p_partkey")


@register("value_shares", "SELECT o_orderstatus AS kind, CAST(count(*) AS BIGINT) AS n, round(count(*) / (SELECT count(*) FROM orders), 6) AS share FROM orders GROUP BY o_orderstatus")
def value_shares(spark, d):
    return R.shares(table(spark, d, "orders", ["o_orderstatus"]).withColumnRenamed("o_orderstatus", "kind"), "kind")


@register(
    "crosstab_fill",
    """SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS f, CAST(count(*) FILTER (o_orderstatus = 'O') AS BIGINT) AS o,
    CAST(count(*) FILTER (o_orderstatus = 'P') AS BIGINT) AS p, CAST(count(*) FILTER (o_orderstatus IS NULL) AS BIGINT) AS none FROM orders GROUP BY o_orderpriority""",
)
def crosstab_fill(spark, d):
    o = table(spark, d, "orders", ["o_orderpriority", "o_orderstatus"]).withColumn("o_orderstatus", F.coalesce(F.lower("o_orderstatus"), F.lit("none")))
    return o.groupBy("o_orderpriority").pivot("o_orderstatus", ["f", "o", "p", "none"]).count().na.fill(0)


@register(
    "group_shares_pivot",
    """SELECT p_type, round(count(*) FILTER (p_size <= 10) / count(*), 6) AS small, round(count(*) FILTER (p_size > 10 AND p_size <= 30) / count(*), 6) AS medium,
    round(count(*) FILTER (p_size > 30) / count(*), 6) AS large FROM part GROUP BY p_type""",
)
def group_shares_pivot(spark, d):
    p = table(spark, d, "part", ["p_type", "p_size"]).withColumn("size", R.first_case([(F.col("p_size") <= 10, "small"), (F.col("p_size") <= 30, "medium")], "large"))
    wide = p.groupBy("p_type").pivot("size", ["small", "medium", "large"]).count().na.fill(0)
    total = F.col("small") + F.col("medium") + F.col("large")
    return wide.select("p_type", *[F.round(F.col(x) / total, 6).alias(x) for x in ("small", "medium", "large")])


@register("id_gaps", "SELECT CAST(i AS BIGINT) AS missing FROM (SELECT unnest(range(1, (SELECT max(l_orderkey) + 1 FROM lineitem))) AS i) WHERE i NOT IN (SELECT l_orderkey FROM lineitem)")
def id_gaps(spark, d):
    return R.missing_ids(table(spark, d, "lineitem", ["l_orderkey"]), "l_orderkey")


@register("id_duplicates", "SELECT o_custkey AS id, CAST(count(*) AS BIGINT) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def id_duplicates(spark, d):
    return table(spark, d, "orders", ["o_custkey"]).groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@register(
    "union_groups",
    """SELECT grp, CAST(count(*) AS BIGINT) AS n, round(avg(bal), 6) AS mean FROM (SELECT 'site' AS grp, s_acctbal AS bal FROM supplier UNION ALL SELECT 'village', c_acctbal FROM customer) GROUP BY grp""",
)
def union_groups(spark, d):
    s = table(spark, d, "supplier", ["s_acctbal"]).select(F.lit("site").alias("grp"), F.col("s_acctbal").alias("bal"))
    c = table(spark, d, "customer", ["c_acctbal"]).select(F.lit("village").alias("grp"), F.col("c_acctbal").alias("bal"))
    return s.unionByName(c).groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("bal"), 6).alias("mean"))


@register("key_difference", "SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity >= 49")
def key_difference(spark, d):
    return table(spark, d, "part", ["p_partkey"]).select(F.col("p_partkey").alias("id")).subtract(table(spark, d, "lineitem", ["l_partkey", "l_quantity"]).filter("l_quantity >= 49").select("l_partkey"))


@register("key_intersection", "SELECT user_id AS id FROM events INTERSECT SELECT c_custkey FROM customer")
def key_intersection(spark, d):
    return table(spark, d, "events", ["user_id"]).select(F.col("user_id").alias("id")).intersect(table(spark, d, "customer", ["c_custkey"]))


@register("distinct_names", "SELECT DISTINCT p_name, p_type FROM part")
def distinct_names(spark, d):
    return table(spark, d, "part", ["p_name", "p_type"]).distinct()


@register(
    "lookup_join",
    """SELECT n_name, r_name, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE c_mktsegment WHEN 'BUILDING' THEN 2000 WHEN 'MACHINERY' THEN 1000 WHEN 'FURNITURE' THEN 300 ELSE 100 END) AS BIGINT) AS radius
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""",
)
def lookup_join(spark, d):
    radius = F.coalesce(F.create_map(*[F.lit(x) for x in ("BUILDING", 2000, "MACHINERY", 1000, "FURNITURE", 300)])[F.col("c_mktsegment")], F.lit(100))
    c = table(spark, d, "customer", ["c_nationkey", "c_mktsegment"]).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum(radius).alias("radius"))
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name", "r_name").agg(F.sum("n").alias("n"), F.sum("radius").alias("radius"))


@register("semi_raster_ids", "SELECT p_partkey, p_type FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def semi_raster_ids(spark, d):
    l = table(spark, d, "lineitem", ["l_partkey", "l_quantity"]).filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))  # noqa: E741
    return table(spark, d, "part", ["p_partkey", "p_type"]).join(l, "p_partkey", "left_semi")


@register("anti_index", "SELECT p_partkey, p_type FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def anti_index(spark, d):
    l = table(spark, d, "lineitem", ["l_partkey", "l_quantity"]).filter("l_quantity = 50").select(F.col("l_partkey").alias("p_partkey"))  # noqa: E741
    return table(spark, d, "part", ["p_partkey", "p_type"]).join(l, "p_partkey", "left_anti")


@register("top_dark_sites", "SELECT s_suppkey, s_name, s_acctbal FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 24")
def top_dark_sites(spark, d):
    return table(spark, d, "supplier", ["s_suppkey", "s_name", "s_acctbal"]).orderBy("s_acctbal", "s_suppkey").limit(24)


@register("every_nth", "SELECT o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i FROM orders) WHERE i % 10 = 0 AND i < 500")
def every_nth(spark, d):
    return R.every_nth(table(spark, d, "orders", ["o_orderkey", "o_orderdate"]), ["o_orderdate", "o_orderkey"], 10, 50)


@register(
    "na_fill_median",
    """WITH m AS (SELECT quantile_cont(value, 0.5) AS med FROM events WHERE event_type <> 'error')
    SELECT event_id, round(CASE WHEN event_type = 'error' THEN med ELSE value END, 6) AS value FROM events, m""",
)
def na_fill_median(spark, d):
    e = table(spark, d, "events", ["event_id", "event_type", "value"]).withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return R.fill_median(e, "value").select("event_id", F.round("value", 6).alias("value"))


@register("complete_cases", "SELECT CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type <> 'error' AND value < 100")
def complete_cases(spark, d):
    e = table(spark, d, "events", ["event_type", "value"])
    e = e.select(F.when(F.col("event_type") != "error", F.col("value")).alias("a"), F.when(F.col("value") < 100, F.col("value")).alias("b"))
    return e.dropna(subset=["a", "b"]).agg(F.count(F.lit(1)).alias("n"))


@register(
    "unless_empty",
    """SELECT p_name, p_partkey FROM (SELECT p_name, p_partkey, p_type = 'PROMO' AS ok, max(CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END) OVER (PARTITION BY p_name) AS has FROM part) WHERE ok OR has = 0""",
)
def unless_empty(spark, d):
    return R.unless_empty(table(spark, d, "part", ["p_name", "p_partkey", "p_type"]), ["p_name"], F.col("p_type") == "PROMO").select("p_name", "p_partkey")


@register("zip_check", "SELECT c_custkey AS id, c_acctbal AS bal, CAST(count(*) AS BIGINT) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1, 2")
def zip_check(spark, d):
    o = table(spark, d, "orders", ["o_custkey"]).groupBy(F.col("o_custkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    c = table(spark, d, "customer", ["c_custkey", "c_acctbal"]).select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"))
    return R.zipped(o, c.join(o, "id", "left_semi"), "id").select("id", "bal", "n")


@register(
    "codes_under_mask",
    """SELECT l_returnflag AS zone, string_agg(code, ',' ORDER BY code) AS codes FROM (SELECT DISTINCT l_returnflag, p_brand AS code FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 49) GROUP BY 1""",
)
def codes_under_mask(spark, d):
    l = table(spark, d, "lineitem", ["l_partkey", "l_returnflag", "l_quantity"]).filter("l_quantity >= 49")  # noqa: E741
    j = l.join(table(spark, d, "part", ["p_partkey", "p_brand"]), F.col("l_partkey") == F.col("p_partkey"))
    return j.groupBy(F.col("l_returnflag").alias("zone")).agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ",").alias("codes"))


@register(
    "group_transform",
    """SELECT o_orderkey, round(o_totalprice - med, 6) AS residual, CAST(n AS BIGINT) AS n FROM orders JOIN (SELECT o_custkey, quantile_cont(o_totalprice, 0.5) AS med, count(*) AS n FROM orders GROUP BY o_custkey) USING (o_custkey)""",
)
def group_transform(spark, d):
    o = table(spark, d, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    return R.with_group(o, ["o_custkey"], med=F.median("o_totalprice"), n=F.count(F.lit(1))).select("o_orderkey", F.round(F.col("o_totalprice") - F.col("med"), 6).alias("residual"), "n")


@register(
    "map_agreement_join",
    """WITH a AS (SELECT o_orderkey % 150 AS ix, o_custkey % 40 AS iy, avg(o_totalprice) AS s FROM orders GROUP BY 1, 2),
    b AS (SELECT l_orderkey % 150 AS ix, l_partkey % 40 AS iy, avg(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2)
    SELECT CAST(count(*) AS BIGINT) AS cells, CAST(count(*) FILTER (a.s >= 250000 AND b.s >= 50000) AS BIGINT) AS both_high, CAST(count(*) FILTER (a.s >= 250000) AS BIGINT) AS high FROM a JOIN b USING (ix, iy)""",
)
def map_agreement_join(spark, d):
    cell = lambda t, cols, a, b, v: table(spark, d, t, cols).groupBy((F.col(a) % 150).alias("ix"), (F.col(b) % 40).alias("iy")).agg(F.avg(v).alias(f"s_{t}"))
    j = cell("orders", ["o_orderkey", "o_custkey", "o_totalprice"], "o_orderkey", "o_custkey", "o_totalprice").join(cell("lineitem", ["l_orderkey", "l_partkey", "l_extendedprice"], "l_orderkey", "l_partkey", "l_extendedprice"), ["ix", "iy"])
    high = F.col("s_orders") >= 250000
    return j.agg(F.count(F.lit(1)).alias("cells"), F.count_if(high & (F.col("s_lineitem") >= 50000)).alias("both_high"), F.count_if(high).alias("high"))


@register("bbox_scan", f"WITH {SQL_POINTS} SELECT id, x, y FROM places WHERE x BETWEEN 20000 AND 60000 AND y BETWEEN 10000 AND 50000")
def bbox_scan(spark, d):
    from ..sources.tables import in_box

    return in_box(points(spark, d), 20000, 10000, 60000, 50000).select("id", "x", "y")


@register(
    "z_parameters",
    """SELECT c_mktsegment AS grp, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS sd FROM customer GROUP BY 1""",
)
def z_parameters(spark, d):
    return table(spark, d, "customer", ["c_mktsegment", "c_acctbal"]).groupBy(F.col("c_mktsegment").alias("grp")).agg(F.round(F.avg("c_acctbal"), 6).alias("mean"), F.round(F.stddev_pop("c_acctbal"), 6).alias("sd"))


@register(
    "scene_search_dedup",
    """SELECT id, ts, k FROM (SELECT 'S' || CAST(event_id % 5000 AS VARCHAR) AS id, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, row_number() OVER (PARTITION BY event_id % 5000 ORDER BY ts, event_id) AS n FROM events
    WHERE year(ts) = 2024 AND day(ts) BETWEEN 5 AND 20) WHERE n = 1""",
)
def scene_search_dedup(spark, d):
    e = table(spark, d, "events", ["event_id", "ts", "props"]).filter((F.year("ts") == 2024) & F.dayofmonth("ts").between(5, 20))
    e = e.select(F.concat(F.lit("S"), (F.col("event_id") % 5000).cast("string")).alias("id"), "ts", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return R.first_of(e, ["id"], ["ts", "event_id"]).select("id", "ts", "k")


@register("sort_by_date", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey")
def sort_by_date(spark, d):
    return table(spark, d, "orders", ["o_orderkey", "o_orderdate"]).orderBy("o_orderdate", "o_orderkey")


@register("nested_properties", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts FROM events")
def nested_properties(spark, d):
    e = table(spark, d, "events", ["event_id", "ts", "props"])
    return e.select("event_id", F.from_json("props", "k long")["k"].alias("k"), "ts")
