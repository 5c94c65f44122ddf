"""Shared parts of the training-data operators: scratch storage, Arrow text
access, word boundaries and word hashes."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than space and \x09-\x0D.
WORD = r"[^\x20\x09-\x0D]+"

#: Texts are handled in Python this many bytes at a time, whole documents each.
CHUNK_BYTES = 1 << 20

_own_dir: str | None = None


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary
    folder where it is unset (local mode only)."""
    global _own_dir
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="loamgrid-")
    return _own_dir


#: Rows of a batch that goes to Python. Rows hold whole texts or packed arrays, so that
#: Spark's 10,000 would be tens of MB in the JVM and again in the worker, for each task.
BATCH_ROWS = 1000


def smaller_batches(spark: SparkSession) -> None:
    """Batches of BATCH_ROWS from now on in this session, unless it has a number of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared folder and reads it back: lineage ends there,
    so a lost executor costs only the tasks it was running. All tables of an
    application stand in one folder, to be removed when it has ended. What it writes,
    and all that follows in the session, is dealt to Python in smaller_batches."""
    spark = df.sparkSession
    smaller_batches(spark)
    path = f"{scratch_dir(spark)}/loamgrid-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def checkpointed(df: DataFrame) -> DataFrame:
    """df.checkpoint(), in the shared folder also where the session names none."""
    smaller_batches(df.sparkSession)
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(scratch_dir(df.sparkSession))
    return df.checkpoint()


def discard(df: DataFrame) -> None:
    """Removes a table of stored() that nothing reads any more."""
    spark = df.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: A side of a join with this many rows of a few numbers at most is sent to all tasks.
FEW = 1 << 17


def text_key(text):
    """64-bit key of a text column; null for a null text."""
    return F.when(text.isNotNull(), F.xxhash64(text))


def picked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of docs (id, t, ...) whose (id, t) is among those of wanted, with wanted's
    other columns; ids may be null. Where few are wanted the others aren't shuffled."""
    on = lambda d, k: d["id"].eqNullSafe(k["want_id"]) & (d["t"] == k["want_t"])
    keyed = wanted.withColumnsRenamed({"id": "want_id", "t": "want_t"})
    more = [c for c in keyed.columns if c not in ("want_id", "want_t")]
    if wanted.count() <= FEW:
        keys = F.broadcast(keyed.select("want_id", "want_t"))
        docs = docs.join(keys, on(docs, keys), "left_semi")
        if not more:
            return docs
    if not more:
        return docs.join(keyed, on(docs, keyed), "left_semi")
    return docs.join(keyed, on(docs, keyed)).drop("want_id", "want_t")


def words_of(text):
    """Number of words of a text column; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_rest(id_col, modulus: int):
    """crc32 of the id as text, modulo modulus; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))


def spans(lengths: np.ndarray, limit: int = CHUNK_BYTES):
    """Row ranges whose lengths add up to about limit at most; one row at least."""
    start, total = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of an Arrow string or binary array and the offsets of its rows
    (rows + 1); null counts as empty. The bytes are the array's own buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


#: ASCII letters in lower case, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: True for the six bytes that part words.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit numbers (the splitmix64 finisher)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ROOT = 0x9E3779B97F4A7C15 | 1
_UNROOT = pow(_ROOT, -1, 2**64)
_powers: dict[str, np.ndarray] = {}


def _power(root: int, n: int, name: str) -> np.ndarray:
    """The first n powers of an odd root modulo 2**64."""
    have = _powers.get(name)
    if have is None or len(have) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        have = np.full(size, root, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= SEGMENT:
            _powers[name] = have
    return have[:n]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in rows of UTF-8, and the row of each.
    A row's end parts words as white space does."""
    gap = SPACE[data]
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets[:-1][offsets[:-1] < n]] = True
    first = first[:n]
    start = np.empty(n, bool)
    if n:
        start[0] = True
        start[1:] = gap[:-1]
        start |= first
        start &= ~gap
    stop = np.empty(n, bool)
    if n:
        stop[-1] = True
        stop[:-1] = gap[1:] | first[1:]
        stop &= ~gap
    begin, end = np.flatnonzero(start), np.flatnonzero(stop) + 1
    row = np.searchsorted(offsets, begin, side="right") - 1
    return begin, end, row


#: Bytes that words are hashed by at a time, more only for a longer word.
SEGMENT = 1 << 19


def word_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each span of bytes, alike wherever the span stands; spans
    are in order."""
    out = np.empty(len(begin), np.uint64)
    table = _BYTE[LOWER] if lower else _BYTE
    i = 0
    while i < len(begin):
        j = max(i + 1, int(np.searchsorted(end, begin[i] + SEGMENT, side="right")))
        first = int(begin[i])
        piece = data[first : int(end[j - 1])]
        # a span's sum of byte value times power, taken back to power 0
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(table[piece] * _power(_ROOT, len(piece), "up"), out=total[1:])
        out[i:j] = mix64((total[end[i:j] - first] - total[begin[i:j] - first]) * _power(_UNROOT, len(piece), "down")[begin[i:j] - first])
        i = j
    return out
