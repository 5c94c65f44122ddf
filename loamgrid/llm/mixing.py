"""Mixing sources to target weights by systematic sampling.

Every source has a target number of words. Its documents expect
target / source size copies each; they stand in order of size, the expected
copies are prefix-summed, one random offset is added, and a document is emitted
once for each integer that its stretch of the sum crosses. Sorted by size, the
words taken differ from the target by about the largest document at most.

A source may hold a third of all rows, so no task gets a whole source: the order
is (size class, salt, size, id), and ranks come from three levels of prefix sums:
classes of a source (some hundred rows), salts of a class (SALTS rows), rows of
one salt.

Defined results: a null or empty text has size 0 and keeps its place in the
order; a null source is a source of its own, last in order; a source of size 0
has target 0 and takes nothing; an empty table gives an empty table; repeated
rows are rows of their own; rows alike in all columns may swap copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, words_of

SALTS_HEX = 2  # hex digits of md5: 256 salts


def _source_key(source: Column) -> Column:
    """Sorts as the sources do by code point, null last; never null."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _size_class(size: Column) -> Column:
    """Bit length and the five leading bits: sizes of a class differ by 1/16 at
    most, and there are under 1,000 classes."""
    bits = F.bin(size)
    return F.concat(F.lpad(F.length(bits).cast("string"), 2, "0"), F.substring(bits, 1, 5))


def targets(per_source: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """Adds weight and target to rows (mix_key, source_size): 100 % of all sizes
    shared by weight, none above cap times its source's size, the excess shared
    again by weight. One row per source."""
    everything = Window.partitionBy()
    order = Window.orderBy("mix_key")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    df = per_source.withColumn("weight", weight)
    # Sources reach their cap in the order of cap over weight. Before the first that
    # doesn't, all are at their cap; the rest share what is left by weight.
    df = df.withColumn("limit", F.col("source_size") * cap)
    by_ratio = Window.orderBy(F.col("limit") / F.col("weight"), "mix_key")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    df = df.withColumn("level", left / F.sum("weight").over(after))
    df = df.withColumn("free", F.col("limit") >= F.col("weight") * F.col("level"))
    df = df.withColumn("share", F.min(F.when(F.col("free"), F.struct(F.col("limit") / F.col("weight"), "mix_key", "level"))).over(everything)["level"])
    return df.withColumn("target", F.least(F.col("limit").cast("double"), F.coalesce(F.col("weight") * F.col("share"), F.lit(0.0)))).select("mix_key", "source_size", "weight", "target")


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    cap: int = 3,
    seed: str = "mix",
    keep: list[str] | None = None,
) -> DataFrame:
    """Every row of docs with size, source_size, target, copies and taken
    (copies times size); keep names the columns to carry, id and source if None."""
    keep = [id_col, source_col] if keep is None else keep
    base = docs.select(
        *[F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep)],
        _source_key(F.col(f"`{source_col}`")).alias("mix_key"),
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("mix_id"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("mix_tie"),
        words_of(F.col(f"`{text_col}`")).alias("size"),
    )
    base = base.withColumn("mix_class", _size_class(F.col("size"))).withColumn("mix_salt", F.substring(F.md5(F.col("mix_id")), 1, SALTS_HEX))

    block = ["mix_key", "mix_class", "mix_salt"]
    blocks = checkpointed(base.groupBy(*block).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    classes = blocks.groupBy("mix_key", "mix_class").agg(F.sum("n").alias("class_n"), F.sum("words").alias("class_words"))
    per_source = targets(classes.groupBy("mix_key").agg(F.sum("class_words").alias("source_size")), weights, cap)
    classes = classes.withColumn("class_base", F.coalesce(F.sum("class_n").over(before(Window.partitionBy("mix_key").orderBy("mix_class"))), F.lit(0))).select("mix_key", "mix_class", "class_base")
    salts = blocks.withColumn("salt_base", F.coalesce(F.sum("n").over(before(Window.partitionBy("mix_key", "mix_class").orderBy("mix_salt"))), F.lit(0)))
    # one random offset per source, in 65536ths so that sums stay exact
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.col("mix_key"))), 1, 4), 16, 10).cast("double") / 65536
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    starts = (
        salts.join(classes, ["mix_key", "mix_class"])
        .join(per_source, "mix_key")
        .select(*block, (F.col("class_base") + F.col("salt_base")).alias("start"), "source_size", "target", rate.alias("rate"), offset.alias("offset"))
    )
    rows = base.withColumn("in_block", F.row_number().over(Window.partitionBy(*block).orderBy("size", "mix_id", "mix_tie")))
    rows = rows.join(starts, block).withColumn("rank", F.col("start") + F.col("in_block"))
    until = lambda rank: F.floor(rank * F.col("rate") + F.col("offset"))
    copies = (until(F.col("rank")) - until(F.col("rank") - 1)).cast("long")
    return rows.withColumn("copies", copies).select(
        *[F.col(f"keep_{i}").alias(c) for i, c in enumerate(keep)],
        *[c for c in ("size", "source_size", "target", "copies") if c not in keep],
        *([(F.col("copies") * F.col("size")).alias("taken")] if "taken" not in keep else []),
    )


def mixed(docs: DataFrame) -> DataFrame:
    """docs with every row repeated as often as the mix takes it; same columns."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    at = {c: f"c{i}" for i, c in enumerate(columns)}
    out = mix(plain, at["doc_id"], at["text"], at["source"], keep=plain.columns)
    again = out.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return again.select(*plain.columns).toDF(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix in DuckDB.
SQL = r"""
WITH base AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
    coalesce(CAST(doc_id AS VARCHAR), '') AS id,
    CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
coded AS (
  SELECT *, lpad(CAST(length(bin(size)) AS VARCHAR), 2, '0') || substr(bin(size), 1, 5) AS cls,
    substr(md5(id), 1, 2) AS salt FROM base),
per_source AS (SELECT k, CAST(sum(size) AS BIGINT) AS source_size FROM coded GROUP BY k),
weighted AS (SELECT *, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS weight, source_size * 3 AS cap FROM per_source),
levels AS (
  SELECT *, CAST((SELECT sum(source_size) FROM weighted) - coalesce(sum(cap) OVER (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY cap / weight, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighted),
shared AS (SELECT coalesce((SELECT level FROM levels WHERE cap >= weight * level ORDER BY cap / weight, k LIMIT 1), 0) AS share),
target AS (
  SELECT k, source_size, least(CAST(cap AS DOUBLE), weight * share) AS target,
    CAST(('0x' || substr(md5('mix:' || k), 1, 4))::BIGINT AS DOUBLE) / 65536 AS u
  FROM levels, shared),
ranked AS (
  SELECT c.*, t.source_size, t.target, t.u, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
    row_number() OVER (PARTITION BY k ORDER BY cls, salt, size, id) AS rank
  FROM coded c JOIN target t USING (k))
SELECT doc_id, size, source_size, target,
  CAST((floor(rank * rate + u) - floor((rank - 1) * rate + u)) * size AS BIGINT) AS taken
FROM ranked
"""
