"""What leaves the engine: features, contracts, pictures' colours, sealed payloads."""

from __future__ import annotations

import gzip
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITERATIONS, LEAST_PHRASE = 600_000, 14


def point_feature(x: Column, y: Column, places: int, **properties: Column) -> Column:
    """A point feature as JSON text, coordinates rounded."""
    geometry = F.struct(F.lit("Point").alias("type"), F.array(F.round(x, places), F.round(y, places)).alias("coordinates"))
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*[c.alias(n) for n, c in properties.items()]).alias("properties"), geometry.alias("geometry")))


def contract(df: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """df, if it has the columns allowed and no others."""
    if tuple(df.columns) != tuple(allowed):
        raise ValueError(f"public columns are {', '.join(allowed)}, not {', '.join(df.columns)}")
    return df


def sealed(spark, payload: str, phrase: str, salt: bytes, iv: bytes) -> DataFrame:
    """One row (kdf, iterations, cipher, compression, salt, iv, ct): the payload,
    compressed and sealed under a phrase of LEAST_PHRASE characters or more."""
    if len(phrase) < LEAST_PHRASE:
        raise ValueError(f"the phrase needs {LEAST_PHRASE} characters")
    key = hashlib.pbkdf2_hmac("sha256", phrase.encode(), salt, ITERATIONS, 32)
    row = spark.createDataFrame([(bytearray(gzip.compress(payload.encode(), mtime=0)), bytearray(key), bytearray(iv))], "body binary, key binary, iv binary")
    ct = F.expr("substring(aes_encrypt(body, key, 'GCM', 'DEFAULT', iv), 13)")  # without the leading iv
    return row.select(F.lit("PBKDF2-SHA256").alias("kdf"), F.lit(ITERATIONS).alias("iterations"), F.lit("AES-256-GCM").alias("cipher"), F.lit("gzip").alias("compression"), F.lit(salt.hex()).alias("salt"), F.lit(iv.hex()).alias("iv"), F.base64(ct).alias("ct"))


def sealed_chunks(features: DataFrame, chunk: str, feature: str, phrase: str, salt: bytes, iv: bytes) -> DataFrame:
    """One row (chunk, kdf, iterations, cipher, compression, salt, iv, ct) for each
    chunk of features (JSON texts), as sealed() makes it; chunk is a whole number from
    0 on. Under one key no iv may serve twice: a chunk's is iv plus its number."""
    if len(phrase) < LEAST_PHRASE:
        raise ValueError(f"the phrase needs {LEAST_PHRASE} characters")
    key = hashlib.pbkdf2_hmac("sha256", phrase.encode(), salt, ITERATIONS, 32)
    first = int.from_bytes(iv, "big")

    def run(batches):
        for batch in batches:
            chunks, payloads = (batch.column(i).to_pylist() for i in range(2))
            ivs = [((first + c) % (1 << 96)).to_bytes(12, "big") for c in chunks]
            bodies = [gzip.compress(p.encode(), mtime=0) for p in payloads]
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(bodies, pa.binary()), pa.array(ivs, pa.binary())], names=["chunk", "body", "iv"])

    listed = F.array_join(F.array_sort(F.collect_list(feature)), ",")
    payloads = features.groupBy(F.col(chunk).cast("long").alias("chunk")).agg(F.concat(F.lit("["), listed, F.lit("]")).alias("payload"))
    rows = payloads.mapInArrow(run, "chunk long, body binary, iv binary").withColumn("key", F.lit(bytearray(key)))
    ct = F.expr("substring(aes_encrypt(body, key, 'GCM', 'DEFAULT', iv), 13)")  # without the leading iv
    return rows.select("chunk", F.lit("PBKDF2-SHA256").alias("kdf"), F.lit(ITERATIONS).alias("iterations"), F.lit("AES-256-GCM").alias("cipher"), F.lit("gzip").alias("compression"), F.lit(salt.hex()).alias("salt"), F.lower(F.hex("iv")).alias("iv"), F.base64(ct).alias("ct"))


def accuracy(snap: Column, placed: Column) -> Column:
    """A: snapped to a named bank; B: snapped; C: placed by rules; D: at the node."""
    return F.when(snap == "named", "A").when(snap == "dem", "B").when(placed.isNotNull() & (placed != "node"), "C").otherwise("D")


RADIUS = {"A": 150, "B": 300, "C": 750, "D": 1500}
COLOURS = ("#f7f3e8", "#e6d8b8", "#cfb48a", "#b08a5f", "#8a623f", "#5f4029", "#352216")


def rgba(code: Column, alpha: int = 215) -> Column:
    """Colour of a class 1 to 7 as text; transparent for 0."""
    return F.when(code > 0, F.concat(F.get(F.array(*[F.lit(c) for c in COLOURS]), code.cast("int") - 1), F.lit(f"{alpha:02x}"))).otherwise("#00000000")


def write_layer(df: DataFrame, path: str, partition: str | None = None, keep: bool = False) -> None:
    """A layer as Parquet; the committer publishes it whole. keep: an existing one stays."""
    w = df.write.mode("ignore" if keep else "overwrite")
    (w.partitionBy(partition) if partition else w).parquet(path)


def write_features(df: DataFrame, column: str, path: str) -> None:
    """Features, one JSON text per line."""
    df.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "\\N").csv(path)
