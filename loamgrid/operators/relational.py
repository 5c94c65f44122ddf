"""Relational building blocks: gates, mappings, votes, fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_columns(df: DataFrame, wanted: list[str], also: list[str] = ()) -> DataFrame:
    """Those of the wanted columns that there are; `also` must be there."""
    require(df, *also)
    return df.select(*[c for c in [*wanted, *also] if c in df.columns])


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Fails at once, by name, where a column is missing."""
    gone = [c for c in columns if c not in df.columns]
    if gone:
        raise ValueError(f"columns missing: {', '.join(gone)}")
    return df


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """Fails where there are no rows."""
    if not df.limit(1).count():
        raise ValueError(f"{what} is empty")
    return df


def gate(df: DataFrame, present: str, kind: str, kinds: tuple) -> DataFrame:
    """Rows with a value in `present` and a kind among kinds."""
    return df.filter(F.col(present).isNotNull() & F.col(kind).isin(*kinds))


def first_case(cases: list[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The label of the first condition that holds."""
    out = None
    for condition, label in cases:
        out = F.when(condition, label) if out is None else out.when(condition, label)
    return out.otherwise(F.lit(otherwise))


def unknown(df: DataFrame, column: str, known: tuple) -> DataFrame:
    """Categories outside the known ones, with counts: (category, n)."""
    return df.filter(~F.col(column).isin(*known)).groupBy(F.col(column).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def check_known(df: DataFrame, column: str, known: tuple) -> DataFrame:
    """df, or an error that lists the unknown categories."""
    bad = [r.category for r in unknown(df, column, known).limit(20).collect()]
    if bad:
        raise ValueError(f"unknown {column}: {', '.join(map(str, sorted(bad)))}")
    return df


def dominant(df: DataFrame, key: str, value: str, weight: str, order: list[str]) -> DataFrame:
    """Per key the value of the largest weight; ties to the first in order. A partial
    aggregate, not a window: keys of any size combine before the shuffle."""
    first = F.struct((-F.col(weight)).alias("w"), *order, F.col(value).alias("v"))
    return df.groupBy(key).agg(F.min(first).alias("m")).select(key, F.col("m.v").alias(value), (-F.col("m.w")).alias(weight))


def vote(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Per key the most frequent value; ties to the one seen first: (key, value, votes)."""
    counts = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("n"), "first", value)).alias("m"))
    return best.select(key, F.col(f"m.{value}").alias(value), (-F.col("m.n")).alias("votes"))


def shares(df: DataFrame, kind: str) -> DataFrame:
    """Counts of a column's values and their shares of all rows."""
    n = df.groupBy(kind).agg(F.count(F.lit(1)).alias("n"))
    return n.select(kind, "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6).alias("share"))


def missing_ids(df: DataFrame, column: str) -> DataFrame:
    """Numbers from 1 to the largest that the column doesn't hold."""
    top = df.agg(F.max(column)).first()[0] or 0
    return df.sparkSession.range(1, top + 1).select(F.col("id").alias("missing")).join(df.select(F.col(column).alias("missing")), "missing", "left_anti")


def every_nth(df: DataFrame, order: list[str], step: int, most: int) -> DataFrame:
    """Every step-th row in order, the first `most` of them."""
    first = df.orderBy(*order).limit(step * most)  # a bounded top-k, then numbered
    return first.withColumn("i", F.row_number().over(Window.orderBy(*order)) - 1).filter(F.col("i") % step == 0).drop("i")


def fill_median(df: DataFrame, column: str) -> DataFrame:
    """NULLs of a column become its median, a one-row broadcast."""
    m = df.agg(F.median(column).alias("fill"))
    return df.join(F.broadcast(m)).withColumn(column, F.coalesce(column, "fill")).drop("fill")


def unless_empty(df: DataFrame, key: list[str], condition: Column) -> DataFrame:
    """Narrows each key's rows to those that meet the condition, unless none does."""
    flagged = df.withColumn("ok", F.coalesce(condition, F.lit(False)))
    return flagged.withColumn("any", F.max("ok").over(Window.partitionBy(*key))).filter("ok OR NOT any").drop("ok", "any")


def zipped(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One-to-one join; fails where a key has no partner or several."""
    pairs = a.groupBy(key).agg(F.count(F.lit(1)).alias("na")).join(b.groupBy(key).agg(F.count(F.lit(1)).alias("nb")), key, "full")
    if pairs.filter("coalesce(na, 0) <> 1 OR coalesce(nb, 0) <> 1").limit(1).count():
        raise ValueError(f"rows don't pair up by {key}")
    return a.join(b, key)


def with_group(df: DataFrame, key: list[str], **aggregates: Column) -> DataFrame:
    """Adds aggregates of each row's group."""
    return df.join(df.groupBy(*key).agg(*[a.alias(n) for n, a in aggregates.items()]), key)


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by a partial aggregate."""
    rest = [c for c in df.columns if c not in key and c not in order]
    return df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("m")).select(*key, *[F.col(f"m.{c}").alias(c) for c in [*order, *rest]])
