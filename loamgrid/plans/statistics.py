"""Statistics, spatial designs, models and map cells."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import stats as T
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


def rank_sql(rows: str, value: str, by: str = "") -> str:
    part = f"PARTITION BY {by}" if by else ""
    return f"SELECT *, rank() OVER ({part} ORDER BY {value}) + (count(*) OVER (PARTITION BY {by + ', ' if by else ''}{value}) - 1) / 2.0 AS rk FROM {rows}"


@register("auc_groups", f"WITH r AS ({rank_sql('orders', 'o_totalprice', 'o_orderpriority')}) SELECT o_orderpriority, CAST(count(*) FILTER (o_orderstatus = 'F') AS BIGINT) AS n1, round((sum(rk) FILTER (o_orderstatus = 'F') - count(*) FILTER (o_orderstatus = 'F') * (count(*) FILTER (o_orderstatus = 'F') + 1) / 2.0) / (count(*) FILTER (o_orderstatus = 'F') * count(*) FILTER (o_orderstatus <> 'F')), 6) AS auc FROM r GROUP BY 1")
def auc_groups(spark, d):
    o = table(spark, d, "orders", ["o_orderpriority", "o_totalprice", "o_orderstatus"]).withColumn("site", F.col("o_orderstatus") == "F")
    return T.auc(o, "o_totalprice", "site", "o_orderpriority").select("o_orderpriority", "n1", F.round("auc", 6).alias("auc"))


@register("mannwhitney_u", f"WITH r AS ({rank_sql('lineitem', 'l_quantity')}) SELECT CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS n1, CAST(count(*) FILTER (l_returnflag <> 'R') AS BIGINT) AS n0, round(sum(rk) FILTER (l_returnflag = 'R') - count(*) FILTER (l_returnflag = 'R') * (count(*) FILTER (l_returnflag = 'R') + 1) / 2.0, 3) AS u FROM r")
def mannwhitney_u(spark, d):
    out = T.mann_whitney(table(spark, d, "lineitem", ["l_quantity", "l_returnflag"]).withColumn("g", F.col("l_returnflag") == "R"), "l_quantity", "g")
    return spark.createDataFrame([(out["n1"], out["n0"], round(out["u"], 3))], "n1 long, n0 long, u double")


@register("mannwhitney_p", None)
def mannwhitney_p(spark, d):
    out = T.mann_whitney(table(spark, d, "lineitem", ["l_quantity", "l_returnflag"]).withColumn("g", F.col("l_returnflag") == "R"), "l_quantity", "g")
    return spark.createDataFrame([(out["n1"], out["n0"], out["u"], out["p"])], "n1 long, n0 long, u double, p double")


@register("wilcoxon", None)
def wilcoxon(spark, d):
    out = T.wilcoxon(table(spark, d, "customer", ["c_acctbal"]).withColumn("diff", F.col("c_acctbal") - 4500), "diff")
    return spark.createDataFrame([(out["n"], out["w"], out["p"])], "n long, w double, p double")


@register("spearman", f"WITH a AS ({rank_sql('part', 'p_size')}), b AS (SELECT rk AS ra, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS rb FROM a) SELECT CAST(count(*) AS BIGINT) AS n, round(corr(ra, rb), 6) AS rho FROM b")
def spearman(spark, d):
    return T.spearman(table(spark, d, "part", ["p_size", "p_retailprice"]), "p_size", "p_retailprice").select("n", F.round("rho", 6).alias("rho"))


@register("quartiles_by_group", "SELECT event_type, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS q2, round(quantile_cont(value, 0.75), 6) AS q3, round(pow(10, quantile_cont(log10(greatest(value, 0.001)), 0.5)), 6) AS back FROM events GROUP BY event_type")
def quartiles_by_group(spark, d):
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = table(spark, d, "events", ["event_type", "value"]).groupBy("event_type").agg(q.alias("q"), F.pow(F.lit(10.0), F.median(F.log10(F.greatest("value", F.lit(0.001))))).alias("back"))
    return g.select("event_type", *[F.round(F.get("q", F.lit(i)), 6).alias(f"q{i + 1}") for i in range(3)], F.round("back", 6).alias("back"))


@register("ecdf", "SELECT p_type, p_size, round(max(k), 6) AS share FROM (SELECT p_type, p_size, cume_dist() OVER (PARTITION BY p_type ORDER BY p_size) AS k FROM part) GROUP BY 1, 2")
def ecdf(spark, d):
    n = table(spark, d, "part", ["p_type", "p_size"]).groupBy("p_type", "p_size").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("p_type")
    return n.select("p_type", "p_size", F.round(F.sum("n").over(w.orderBy("p_size").rowsBetween(Window.unboundedPreceding, 0)) / F.sum("n").over(w), 6).alias("share"))


@register("histogram_bins", "SELECT CAST((value >= 0)::INT + (value >= 1)::INT + (value >= 100)::INT + (value >= 200)::INT + (value >= 300)::INT AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1")
def histogram_bins(spark, d):
    return T.histogram(table(spark, d, "events", ["value"]), "value", [0, 1, 100, 200, 300])


BOYCE = "p AS (SELECT o_totalprice AS s, o_orderstatus = 'F' AS site FROM orders), e AS (" + " UNION ALL ".join(f"SELECT quantile_cont(s, {i / 10}) AS e FROM p WHERE NOT site" for i in range(1, 10)) + ")"


@register("boyce_bins", f"WITH {BOYCE} SELECT CAST(bin AS BIGINT) AS bin, CAST(count(*) AS BIGINT) AS n FROM (SELECT (SELECT count(*) FROM e WHERE round(e, 4) <= p.s) AS bin FROM p WHERE site) GROUP BY bin")
def boyce_bins(spark, d):
    """Sites by decile of the background."""
    o = table(spark, d, "orders", ["o_totalprice", "o_orderstatus"])
    back = o.filter("o_orderstatus <> 'F'").agg(F.percentile("o_totalprice", F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("e"))
    sites = o.filter("o_orderstatus = 'F'").join(F.broadcast(back))
    return sites.groupBy(F.size(F.filter("e", lambda x: F.round(x, 4) <= F.col("o_totalprice"))).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register("top_share", "WITH q AS (SELECT quantile_cont(o_totalprice, 0.9) AS q9, quantile_cont(o_totalprice, 0.8) AS q8 FROM orders WHERE o_orderstatus <> 'F') SELECT round(avg((o_totalprice >= q9)::INT), 6) AS top10, round(avg((o_totalprice >= q8)::INT), 6) AS top20 FROM orders, q WHERE o_orderstatus = 'F'")
def top_share(spark, d):
    o = table(spark, d, "orders", ["o_totalprice", "o_orderstatus"])
    q = o.filter("o_orderstatus <> 'F'").agg(F.percentile("o_totalprice", 0.9).alias("q9"), F.percentile("o_totalprice", 0.8).alias("q8"))
    s = o.filter("o_orderstatus = 'F'").join(F.broadcast(q))
    return s.agg(*[F.round(F.avg((F.col("o_totalprice") >= F.col(c)).cast("int")), 6).alias(n) for c, n in (("q9", "top10"), ("q8", "top20"))])


@register("capture_curve", "WITH q AS (SELECT i / 20.0 AS area, quantile_cont(o_totalprice, 1 - i / 20.0) AS q FROM orders, (SELECT unnest(range(0, 21)) AS i) WHERE o_orderstatus <> 'F' GROUP BY i) SELECT CAST(area AS DOUBLE) AS area, round(avg((o_totalprice >= round(q, 4))::INT), 6) AS captured FROM orders, q WHERE o_orderstatus = 'F' GROUP BY area".replace("quantile_cont(o_totalprice, 1 - i / 20.0)", "list_extract(any_value((SELECT list(v ORDER BY k) FROM (" + " UNION ALL ".join(f"SELECT {i} AS k, quantile_cont(o_totalprice, {1 - i / 20}) AS v FROM orders WHERE o_orderstatus <> 'F'" for i in range(21)) + "))), CAST(i + 1 AS BIGINT))"))
def capture_curve(spark, d):
    """Share of sites above each area share's threshold of the background."""
    o = table(spark, d, "orders", ["o_totalprice", "o_orderstatus"])
    q = o.filter("o_orderstatus <> 'F'").agg(F.percentile("o_totalprice", F.array(*[F.lit(1 - i / 20) for i in range(21)])).alias("q")).select(F.posexplode("q").alias("i", "q"))
    s = o.filter("o_orderstatus = 'F'").join(F.broadcast(q))
    return s.groupBy((F.col("i") / 20.0).alias("area")).agg(F.round(F.avg((F.col("o_totalprice") >= F.round("q", 4)).cast("int")), 6).alias("captured"))


@register(
    "spatial_folds",
    f"""WITH {P}, b AS (SELECT id, x // 25000 AS bx, y // 25000 AS iy FROM places), f AS (SELECT id, bx, iy, ((bx * 92821 + iy * 68917) * 1103515245 + 12345) % 2147483648 % 1009 % 5 AS fold FROM b)
    SELECT id, bx, iy, fold FROM f""",
)
def spatial_folds(spark, d):
    return T.folds(S.points(spark, d), "x", "y", 25000, 5).select("id", "bx", F.col("by").alias("iy"), "fold")


@register(
    "background_match",
    """WITH p AS (SELECT event_id, value, (value >= 10)::INT + (value >= 50)::INT + (value >= 100)::INT AS bin, event_type = 'error' AS site FROM events),
    w AS (SELECT bin, count(*) FILTER (site) / count(*) FILTER (NOT site) AS w FROM p GROUP BY bin HAVING count(*) FILTER (site) > 0),
    k AS (SELECT event_id, -ln((((event_id * 48271 + 11) * 1103515245 + 12345) % 2147483648 + 0.5) / 2147483648.0) / w AS draw FROM p JOIN w USING (bin) WHERE NOT site)
    SELECT event_id FROM k ORDER BY draw, event_id LIMIT 500""",
)
def background_match(spark, d):
    e = table(spark, d, "events", ["event_id", "event_type", "value"])
    return T.background(e.filter("event_type = 'error'"), e.filter("event_type <> 'error'"), "value", [10, 50, 100], "event_id", 500).select("event_id")


@register("percentile_rank_bg", "WITH b AS (SELECT c_acctbal AS s FROM customer) SELECT s_suppkey AS id, round(100.0 * (SELECT count(*) FROM b WHERE b.s < s_acctbal) / (SELECT count(*) FROM b), 6) AS rank FROM supplier")
def percentile_rank_bg(spark, d):
    s = table(spark, d, "supplier", ["s_suppkey", "s_acctbal"]).select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("score"))
    return T.percentile_rank(s, table(spark, d, "customer", ["c_acctbal"]).select(F.col("c_acctbal").alias("score")), "score").select("id", F.round("rank", 6).alias("rank"))


CELLS = f"""{P}, c AS (SELECT x // 8000 AS ix, y // 8000 AS iy, quantile_cont(CASE WHEN id % 9 <> 0 THEN id % 100 END, 0.9) AS score, count(*) AS n FROM places GROUP BY 1, 2 HAVING count(*) >= 5)"""


def map_cells(spark, d):
    p = S.points(spark, d).withColumn("score", F.when(F.col("id") % 9 != 0, F.col("id") % 100))
    g = p.groupBy(F.floor(F.col("x") / 8000).alias("ix"), F.floor(F.col("y") / 8000).alias("iy")).agg(F.percentile("score", 0.9).alias("score"), F.count(F.lit(1)).alias("n"))
    return g.filter("n >= 5 AND score IS NOT NULL")


@register("cells_p90", f"WITH {CELLS} SELECT ix, iy, round(score, 6) AS score, CAST(n AS BIGINT) AS n FROM c WHERE score IS NOT NULL")
def cells_p90(spark, d):
    return map_cells(spark, d).select("ix", "iy", F.round("score", 6).alias("score"), "n")


@register("cell_classes", f"WITH {CELLS}, q AS (SELECT quantile_cont(score, 0.9) AS a, quantile_cont(score, 0.75) AS b FROM c) SELECT ix, iy, CASE WHEN round(score, 6) >= round(a, 6) THEN 'high' WHEN round(score, 6) >= round(b, 6) THEN 'elevated' ELSE '' END AS class FROM c, q WHERE score IS NOT NULL")
def cell_classes(spark, d):
    c = map_cells(spark, d)
    q = c.agg(F.percentile("score", 0.9).alias("a"), F.percentile("score", 0.75).alias("b"))
    s = F.round("score", 6)
    return c.join(F.broadcast(q)).select("ix", "iy", F.when(s >= F.round("a", 6), "high").when(s >= F.round("b", 6), "elevated").otherwise("").alias("class"))


@register("candidate_cells", f"WITH {CELLS}, q AS (SELECT quantile_cont(score, 0.75) AS b FROM c) SELECT ix, iy FROM c, q WHERE round(score, 6) >= round(b, 6) AND NOT EXISTS (SELECT 1 FROM sites s WHERE (s.x - ix * 8000 - 4000) ** 2 + (s.y - iy * 8000 - 4000) ** 2 <= 25000000)")
def candidate_cells(spark, d):
    """High cells whose centre lies more than 5 km from every site."""
    from ..operators.spatial import within

    c = map_cells(spark, d)
    q = c.agg(F.percentile("score", 0.75).alias("b"))
    high = c.join(F.broadcast(q)).filter(F.round("score", 6) >= F.round("b", 6)).select("ix", "iy", (F.col("ix") * 1000 + F.col("iy")).alias("id"), (F.col("ix") * 8000 + 4000).alias("x"), (F.col("iy") * 8000 + 4000).alias("y"))
    near = within(high, S.sites(spark, d), 5000.0).select("id").distinct()
    return high.join(near, "id", "left_anti").select("ix", "iy")


@register("fold_summary", "WITH f AS (SELECT o_custkey % 5 AS fold, o_orderpriority AS set, avg(o_totalprice) AS s FROM orders GROUP BY 1, 2), b AS (SELECT fold, s AS base FROM f WHERE set = '1-URGENT') SELECT set, round(avg(s), 4) AS mean, round(stddev_pop(s), 4) AS sd, round(avg(s - base), 4) AS gain, CAST(count(*) FILTER (s > base) AS BIGINT) AS better, CAST(count(*) AS BIGINT) AS folds FROM f JOIN b USING (fold) GROUP BY set")
def fold_summary(spark, d):
    """Mean and spread over folds, and the paired gain on a base set."""
    f = table(spark, d, "orders", ["o_custkey", "o_orderpriority", "o_totalprice"]).groupBy((F.col("o_custkey") % 5).alias("fold"), F.col("o_orderpriority").alias("set")).agg(F.avg("o_totalprice").alias("s"))
    base = f.filter("set = '1-URGENT'").select("fold", F.col("s").alias("base"))
    g = f.join(base, "fold").groupBy("set")
    return g.agg(F.round(F.avg("s"), 4).alias("mean"), F.round(F.stddev_pop("s"), 4).alias("sd"), F.round(F.avg(F.col("s") - F.col("base")), 4).alias("gain"), F.count_if(F.col("s") > F.col("base")).alias("better"), F.count(F.lit(1)).alias("folds"))


@register("acceptance", "SELECT label AS set, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS gain FROM embeddings GROUP BY label HAVING avg(CAST(embedding[1] AS DOUBLE)) > 0 AND avg(CAST(embedding[2] AS DOUBLE)) > 0")
def acceptance(spark, d):
    e = table(spark, d, "embeddings").select(F.col("label").alias("set"), *[F.get("embedding", F.lit(i)).cast("double").alias(n) for i, n in enumerate("ab")])
    return e.groupBy("set").agg(F.avg("a").alias("gain"), F.avg("b").alias("un")).filter("gain > 0 AND un > 0").select("set", F.round("gain", 6).alias("gain"))


FEATURES = [f"e{i}" for i in range(1, 7)]


def matrix(spark, d):
    """Rows of the embeddings as a sample matrix: presence is the first three labels."""
    e = table(spark, d, "embeddings").select("vec_id", (F.col("label") < 3).cast("int").alias("y"), *[F.get("embedding", F.lit(i)).cast("double").alias(f"e{i + 1}") for i in range(12)])
    return T.folds(e, "e11", "e12", 0.05, 5)


@register("cv_logistic", None)
def cv_logistic(spark, d):
    """Out-of-fold AUC of the logistic model, features and their squares, by fold."""
    m, names = T.with_squares(matrix(spark, d), FEATURES)
    p = T.cross_validated(m, names, "y", "fold", 5, T.fit_logistic).select("fold", F.round("p", 6).alias("p"), (F.col("y") == 1).alias("site"))
    return T.auc(p, "p", "site", "fold")


@register("cv_boosting", None)
def cv_boosting(spark, d):
    """The same for boosted trees."""
    p = T.cross_validated(matrix(spark, d), FEATURES, "y", "fold", 5, T.fit_boosting).select("fold", F.round("p", 6).alias("p"), (F.col("y") == 1).alias("site"))
    return T.auc(p, "p", "site", "fold")


def fitted(spark, d):
    m = matrix(spark, d)
    return m, T.fit_logistic(m, FEATURES, "y")


@register("perm_importance", None)
def perm_importance(spark, d):
    """Loss of AUC when a feature's values are dealt anew, the mean of 5 deals."""
    m, model = fitted(spark, d)
    score = lambda df: T.auc(model(df).select(F.round("p", 9).alias("p"), (F.col("y") == 1).alias("site")), "p", "site").first().auc
    base = score(m)
    return spark.createDataFrame([(f, float(base - sum(score(T.permuted(m, f, "vec_id", i)) for i in range(5)) / 5)) for f in FEATURES], "feature string, drop double").orderBy(F.col("drop").desc())


@register("partial_dependence", None)
def partial_dependence(spark, d):
    """Mean prediction with one feature held at each of 40 values."""
    m, model = fitted(spark, d)
    lo, hi = m.agg(F.min("e1"), F.max("e1")).first()
    held = m.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(39)))).withColumn("e1", F.lit(lo) + F.col("i") * F.lit((hi - lo) / 39))
    return model(held).groupBy("i").agg(F.first("e1").alias("value"), F.avg("p").alias("p"))


@register("bootstrap_ci", None)
def bootstrap_ci(spark, d):
    """Interval of the AUC over 2000 resamples of the suppliers."""
    s = table(spark, d, "supplier").select("s_suppkey", F.col("s_acctbal").alias("p"), (F.col("s_nationkey") < 8).alias("site"))
    reps = T.bootstrap_auc(s, "s_suppkey", "p", "site", 2000)
    return reps.agg(F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.5).alias("mid"), F.percentile("auc", 0.975).alias("high"))


@register("control_group", "SELECT c_custkey AS id, CASE ((c_custkey * 1103515245 + 12345) % 2147483648) % 3 WHEN 0 THEN 'inside' WHEN 1 THEN 'outskirts' ELSE 'beyond' END AS position FROM customer WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
def control_group(spark, d):
    """Villages without sites, placed by a hashed draw of positions."""
    busy = table(spark, d, "supplier", ["s_nationkey", "s_acctbal"]).filter("s_acctbal > 9000").select(F.col("s_nationkey").alias("c_nationkey"))
    c = table(spark, d, "customer", ["c_custkey", "c_nationkey"]).join(busy, "c_nationkey", "left_anti")
    k = T.draw(F.col("c_custkey")) % 3
    return c.select(F.col("c_custkey").alias("id"), F.when(k == 0, "inside").when(k == 1, "outskirts").otherwise("beyond").alias("position"))
