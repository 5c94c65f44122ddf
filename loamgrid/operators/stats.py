"""Rank statistics, spatial designs and model evaluation on tables."""

from __future__ import annotations

import math

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import ensure_checkpoints


def running(df: DataFrame, amount: Column, order: list, *by: str) -> DataFrame:
    """Adds before: the sum of amounts of the rows that stand before a row in order, per
    group. Rows are dealt by ranges of (by, order); each range is summed on its own and
    starts from the totals of those before it, so no task sorts a whole group."""
    ensure_checkpoints(df.sparkSession)
    dealt = df.withColumn("amount", amount).repartitionByRange(*by, *order).withColumn("part", F.spark_partition_id()).checkpoint()
    inner = Window.partitionBy("part", *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    # a row per range and group
    base = dealt.groupBy("part", *by).agg(F.sum("amount").alias("amount")).select("part", *by, F.coalesce(F.sum("amount").over(outer), zero).alias("base"))
    summed = dealt.withColumn("inner", F.coalesce(F.sum("amount").over(inner), zero))
    on = summed["part"] == base["part"]
    for c in by:
        on &= summed[c].eqNullSafe(base[c])
    return summed.join(base.select("part", "base", *by), on).select(*[summed[c] for c in df.columns], (F.col("inner") + F.col("base")).alias("before"))


def value_ranks(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Mid-ranks of values, per group: rows (by, value, ties, rank). Ranks are told
    from the counts of distinct values, summed in value ranges."""
    n = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties"))
    return running(n, F.col("ties"), [value], *by).withColumn("rank", F.col("before") + (F.col("ties") + 1) / 2).drop("before")


def auc(df: DataFrame, score: str, positive: str, *by: str) -> DataFrame:
    """Probability that a positive's score is above a negative's, ties half; NULL if
    either class is empty: (by, n1, n0, auc)."""
    ranked = df.join(value_ranks(df, score, *by).drop("ties"), [*by, score]) if by else df.join(value_ranks(df, score).drop("ties"), score)
    g = ranked.groupBy(*by).agg(F.count_if(positive).alias("n1"), F.count_if(~F.col(positive)).alias("n0"), F.sum(F.when(F.col(positive), F.col("rank"))).alias("s"))
    return g.select(*by, "n1", "n0", ((F.col("s") - F.col("n1") * (F.col("n1") + 1) / 2) / F.nullif(F.col("n1") * F.col("n0"), F.lit(0))).alias("auc"))


def normal_tail(z: float) -> float:
    """Two-sided probability of a standard normal."""
    return math.erfc(abs(z) / math.sqrt(2))


def mann_whitney(df: DataFrame, value: str, group: str) -> dict:
    """Two-sided p by the tie-corrected normal approximation, continuity-corrected.
    Only sums leave the executors."""
    ranks = value_ranks(df, value)
    ties = ranks.agg(F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")).alias("t")).first().t or 0.0
    s = df.join(ranks.drop("ties"), value).agg(F.count_if(group).alias("a"), F.count_if(~F.col(group)).alias("b"), F.sum(F.when(F.col(group), F.col("rank"))).alias("r")).first()
    n, u = s.a + s.b, (s.r or 0) - s.a * (s.a + 1) / 2
    if not s.a or not s.b:
        return {"n1": s.a, "n0": s.b, "u": None, "p": None}
    sd = math.sqrt(s.a * s.b / 12 * (n + 1 - ties / (n * (n - 1))))
    z = (abs(u - s.a * s.b / 2) - 0.5) / sd if sd else 0.0
    return {"n1": s.a, "n0": s.b, "u": float(u), "p": min(1.0, normal_tail(z))}


def wilcoxon(df: DataFrame, diff: str) -> dict:
    """Signed-rank test of differences, zeros left out, tie-corrected."""
    d = df.filter(F.col(diff) != 0).select(F.abs(diff).alias("a"), (F.col(diff) > 0).alias("up"))
    ranks = value_ranks(d, "a")
    t = ranks.agg(F.sum(F.col("ties").cast("double") ** 3 - F.col("ties")).alias("t")).first().t or 0.0
    s = d.join(ranks.drop("ties"), "a").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("up"), F.col("rank")).otherwise(0.0)).alias("w")).first()
    if not s.n:
        return {"n": 0, "w": None, "p": None}
    sd = math.sqrt(s.n * (s.n + 1) * (2 * s.n + 1) / 24 - t / 48)
    return {"n": s.n, "w": float(s.w), "p": normal_tail((s.w - s.n * (s.n + 1) / 4) / sd) if sd else 1.0}


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of mid-ranks over complete pairs: one row (n, rho)."""
    d = df.select(a, b).dropna()
    d = d.join(value_ranks(d, a).select(a, F.col("rank").alias("ra")), a).join(value_ranks(d, b).select(b, F.col("rank").alias("rb")), b)
    return d.agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("rho"))


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts per bin between edges: (bin, n); 0 lies below the first edge."""
    bin_ = sum((F.when(F.col(value) >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("long")
    return df.filter(F.col(value).isNotNull()).groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def draw(key: Column, seed: int = 12345) -> Column:
    """A whole number from 0 to 2**31 - 1 by a congruence of a key: reruns agree. The key
    is reduced first, so that no product overflows."""
    return F.pmod(F.pmod(key.cast("long"), F.lit(2147483648)) * 1103515245 + seed, F.lit(2147483648))


def folds(df: DataFrame, x: str, y: str, block: float, n: int, repeat: int = 0) -> DataFrame:
    """Adds bx, by and fold: whole blocks of the plane fall into one fold."""
    b = df.withColumn("bx", F.floor(F.col(x) / block).cast("long")).withColumn("by", F.floor(F.col(y) / block).cast("long"))
    return b.withColumn("fold", F.pmod(draw(F.col("bx") * 92821 + F.col("by") * 68917 + repeat * 7919), F.lit(1009)) % n)


def background(sites: DataFrame, pool: DataFrame, value: str, edges: list[float], key: str, most: int) -> DataFrame:
    """Rows of the pool drawn without replacement so that their histogram of a value
    follows the sites': exponential keys, weight = sites per pool row of the bin."""
    bin_ = sum((F.when(F.col(value) >= e, 1).otherwise(0) for e in edges), F.lit(0)).cast("long")
    s = histogram(sites, value, edges).withColumnRenamed("n", "ns")
    p = histogram(pool, value, edges).withColumnRenamed("n", "np")
    w = p.join(s, "bin").select("bin", (F.col("ns") / F.col("np")).alias("w"))
    u = (draw(F.pmod(F.col(key).cast("long"), F.lit(2147483648)) * 48271 + 11) + 0.5) / 2147483648.0
    return pool.withColumn("bin", bin_).join(F.broadcast(w), "bin").withColumn("draw", -F.log(u) / F.col("w")).orderBy("draw", key).limit(most)


def percentile_rank(scores: DataFrame, reference: DataFrame, score: str) -> DataFrame:
    """Adds rank: 100 times the share of reference scores below each score."""
    both = scores.select(score, F.lit(0).alias("ref")).unionByName(reference.select(score, F.lit(1).alias("ref")))
    by_value = both.groupBy(score).agg(F.sum("ref").alias("n"))
    total = reference.count()
    ranks = running(by_value, F.col("n"), [score]).select(score, (100.0 * F.col("before") / total).alias("rank"))
    return scores.join(ranks, score)


def with_squares(df: DataFrame, features: list[str]) -> tuple[DataFrame, list[str]]:
    names = [f"{f}_sq" for f in features]
    return df.withColumns({n: F.col(f) * F.col(f) for n, f in zip(names, features)}), features + names


def assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="skip").transform(df)


def fit_logistic(train: DataFrame, features: list[str], label: str, c: float = 1.0):
    """Balanced logistic regression on standardised features, L2 with strength 1/c."""
    vec = assembled(train, features)
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(vec)
    n = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    total = sum(n.values())
    weight = F.when(F.col(label) == 1, total / (2 * n.get(1, 1))).otherwise(total / (2 * n.get(0, 1)))
    rows = scaler.transform(vec).withColumn("weight", weight)
    model = LogisticRegression(featuresCol="features", labelCol=label, weightCol="weight", regParam=1 / (c * total), elasticNetParam=0.0, standardization=False, maxIter=100).fit(rows)
    return lambda df: model.transform(scaler.transform(assembled(df, features))).withColumn("p", vector_to_array("probability")[1]).drop("raw", "features", "rawPrediction", "probability", "prediction")


def fit_boosting(train: DataFrame, features: list[str], label: str, iterations: int = 300):
    """Boosted trees of depth 3, step 0.05, 40 rows a leaf at least."""
    model = GBTClassifier(featuresCol="raw", labelCol=label, maxDepth=3, stepSize=0.05, maxIter=iterations, minInstancesPerNode=40, seed=42).fit(assembled(train, features))
    return lambda df: model.transform(assembled(df, features)).withColumn("p", vector_to_array("probability")[1]).drop("raw", "rawPrediction", "probability", "prediction")


def cross_validated(df: DataFrame, features: list[str], label: str, fold: str, n: int, fit, least: int = 10) -> DataFrame:
    """Out-of-fold predictions p; folds with under `least` positives on either side
    are left out. The loop is over folds; each fit is distributed."""
    out = None
    have = {r[fold]: r.k for r in df.filter(F.col(label) == 1).groupBy(fold).agg(F.count(F.lit(1)).alias("k")).collect()}
    for k in range(n):
        if have.get(k, 0) < least or sum(have.values()) - have.get(k, 0) < least:
            continue
        part = fit(df.filter(F.col(fold) != k), features, label)(df.filter(F.col(fold) == k))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no fold has enough positives")
    return out


def permuted(df: DataFrame, column: str, key: str, deal: int = 0) -> DataFrame:
    """The column's values dealt anew among the rows, in order of a hash of the key
    and the number of the deal."""
    place = running(df, F.lit(1), [F.col(key)]).withColumnRenamed("before", "at")
    rows = df.select(F.col(column).alias("dealt"), F.xxhash64(key, F.lit(deal)).alias("draw"), F.col(key).alias("tie"))
    dealt = running(rows, F.lit(1), [F.col("draw"), F.col("tie")]).select("dealt", F.col("before").alias("at"))
    return place.join(dealt, "at").withColumn(column, F.col("dealt")).drop("at", "dealt")


def poisson(u: Column, most: int = 12) -> Column:
    """A Poisson number of mean 1 from a uniform one: how many steps of the
    distribution function lie at or below it."""
    steps, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        steps.append(total)
    return sum((F.when(u >= t, 1).otherwise(0) for t in steps), F.lit(0))


def bootstrap_auc(df: DataFrame, group: str, score: str, positive: str, times: int) -> DataFrame:
    """AUC of weighted resamples: each group's rows count as often as a Poisson draw
    by resample and group says: (rep, auc), NULL where a class has no weight. Draws
    are hashes, so reruns agree; counts are summed per resample and score first."""
    reps = df.select(F.col(score).alias("s"), F.col(positive).alias("y"), F.col(group).alias("g")).filter("s IS NOT NULL").withColumn("rep", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(times).cast("long"))))
    u = (F.pmod(F.xxhash64("rep", "g"), F.lit(1 << 31)) + 0.5) / float(1 << 31)
    levels = reps.withColumn("w", poisson(u)).groupBy("rep", "s").agg(F.sum(F.when(F.col("y"), F.col("w")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y"), 0).otherwise(F.col("w"))).alias("neg"))
    lower = Window.partitionBy("rep").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("pos") * (F.coalesce(F.sum("neg").over(lower), F.lit(0)) + F.col("neg") / 2)
    sums = levels.withColumn("won", won).groupBy("rep").agg(F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select("rep", (F.col("won") / F.nullif(F.col("p") * F.col("n"), F.lit(0))).alias("auc"))
