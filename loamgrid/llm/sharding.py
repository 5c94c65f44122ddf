"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Groups of equal texts are the items. Small groups are first pooled by hash into
a fixed number of buckets, so that the packer sees a bounded number of items
however large the corpus is; groups that alone outweigh a bucket are items of
their own, and one that outweighs an eighth of a shard is cut into chunks by id.
The packer places items, largest first, where the dot product of the item with
the shards' residual capacity is highest. Law: `bytes` (sizes near equal).

Defined results: a null text has no bytes and no tokens, and groups with other
nulls; repeated rows are rows of their own; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, words_of

SHARDS = 40
#: Buckets per shard: the packer gets SHARDS * PER_SHARD pooled items at most,
#: and at most three times as many groups of their own.
PER_SHARD = 256
#: A group above this part of a shard, or of more rows, is cut into chunks.
WHOLE, CHUNK_ROWS = 8, 1 << 20


def pack(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item; items: one row each of (bytes, tokens, rows)."""
    total = items.sum(axis=0, dtype=np.float64)
    load = items / np.where(total > 0, total, 1) * shards
    residual = np.ones((shards, load.shape[1]))
    out = np.zeros(len(items), np.int64)
    for i in np.argsort(-load.max(axis=1), kind="stable"):
        # a full shard's negative residual counts as such: the item goes elsewhere
        out[i] = best = int(np.argmax(residual @ load[i]))
        residual[best] -= load[i]
    return settle(load, out, shards)


def settle(load: np.ndarray, shard: np.ndarray, shards: int, rounds: int = 400) -> np.ndarray:
    """Moves single items from the fullest to the emptiest shard by bytes while
    that narrows the gap: the law holds bytes near equal."""
    held = np.bincount(shard, weights=load[:, 0], minlength=shards)
    for _ in range(rounds):
        high, low = int(held.argmax()), int(held.argmin())
        gap = held[high] - held[low]
        mine = np.flatnonzero(shard == high)
        sizes = load[mine, 0]
        fits = (sizes > 0) & (sizes < gap)
        if not fits.any():
            break
        best = mine[fits][np.argmin(np.abs(sizes[fits] - gap / 2))]
        shard[best] = low
        held[high] -= load[best, 0]
        held[low] += load[best, 0]
    return shard


def shard(docs: DataFrame, shards: int = SHARDS, per_shard: int = PER_SHARD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, law, shard, slot, grown_shard)."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    base = checkpointed(docs.select(
        F.col(f"`{id_col}`").alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        words_of(text).alias("tokens"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.xxhash64(text, F.octet_length(text)).alias("h"),
    ))  # narrow rows; the texts are read once
    buckets = shards * per_shard
    total = base.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    bytes_all, tokens_all, rows_all = (int(x or 0) for x in total)
    dims = {"b": max(1, bytes_all), "t": max(1, tokens_all), "r": max(1, rows_all)}
    groups = base.groupBy("h").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r"))
    part = F.greatest(*[F.col(c) / F.lit(float(n)) for c, n in dims.items()])
    # at most 3 * buckets groups can exceed 1 / buckets of some total
    heavy = groups.filter(part * buckets > 1).withColumn("chunks", F.greatest(F.ceil(part * shards * WHOLE), F.ceil(F.col("r") / CHUNK_ROWS)).cast("int"))
    heavy = spark.createDataFrame(heavy.select("h", "chunks").orderBy("h").collect(), "h long, chunks int")
    salt = F.pmod(F.xxhash64(F.col("id"), F.lit(7)), F.coalesce("chunks", F.lit(1)))
    item = F.when(F.col("chunks").isNull(), F.struct(F.pmod("h", F.lit(buckets)).alias("g"), F.lit(-1).cast("long").alias("c"))).otherwise(F.struct(F.col("h").alias("g"), salt.alias("c")))
    rows = base.join(F.broadcast(heavy), "h", "left").withColumn("item", item).select("id", "size", "tokens", "crc", "h", "item.g", "item.c")
    items = rows.groupBy("g", "c").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("r")).orderBy("g", "c").collect()
    placed = pack(np.array([[x.b, x.t, x.r] for x in items], np.float64).reshape(-1, 3), shards)
    first = [0] * shards
    plan = []
    for x, s in zip(items, placed.tolist()):
        plan.append((x.g, x.c, s, first[s]))
        first[s] += x.r
    plan = spark.createDataFrame(plan, "g long, c long, shard int, base long")
    within = Window.partitionBy("g", "c").orderBy("h", "id", "size")
    out = rows.withColumn("n", F.row_number().over(within)).join(F.broadcast(plan), ["g", "c"])
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", (F.col("base") + F.col("n") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
