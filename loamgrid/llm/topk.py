"""Exact top-k search over a bit-sliced index.

Components are quantised to integers. A block of rows is indexed by slices: bit j
of component d of all its rows is one bitmap. A query's inner products with all
rows of a block are sums of shifted slices (of their complements where the query's
digit is negative), added by carry-save bitmap arithmetic; the sums are slices
too. The k best rows are then chosen from the most significant slice downward, and
rows that tie at the boundary are resolved by id. Nothing is approximated.

Queries meet rows in blocks: an index block is sent once to each block of queries, and
a block of queries to each of SALTS parts of the index, so that no key grows with the
table. A task keeps k rows per query.

Defined results: vectors that are null or hold null or non-finite components, or
have a null id, take no part; a slice's number of bits follows its block's largest
component, whatever its size, and sums are exact; a score beyond a long is returned
as the largest or least long, though ranked by its own size; vectors of other lengths aren't compared, empty ones
score 0; rows with the query's id are its own; repeated rows are candidates each; an
empty table gives an empty table. Other columns don't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K = 5
SCALE = 256.0
EVERY = 50
#: Rows of an index block, and queries of a block of queries.
ROWS, QUERIES = 8192, 1024
#: Parts of the index that a block of queries is sent to, at most.
SALTS = 64
#: Components below it are held as 64-bit integers, larger ones as Python's.
WIDE = 1 << 62
LONG = (1 << 63) - 1


def slices(values: np.ndarray) -> tuple[np.ndarray, int]:
    """Bitmaps of values + bias, by component and bit, then their complements; and
    the number of bits. The bias, 2 ** (bits - 1), makes all values positive."""
    n, dim = values.shape
    bits = int(max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1, 0)).bit_length() + 1
    raised = (values + (1 << (bits - 1))).T
    words = -(-n // 64)
    out = np.zeros((2, dim, bits, words * 8), np.uint8)
    for j in range(bits):
        packed = np.packbits(((raised >> j) & 1).astype(np.uint8).reshape(dim, n), axis=1, bitorder="little")
        out[0, :, j, : packed.shape[1]] = packed
    out[1] = ~out[0]
    return out.view(np.uint64), bits


def digits(value: int) -> list[tuple[int, int]]:
    """(place, sign) of the non-adjacent form: fewest signed binary digits."""
    out, place, sign = [], 0, 1 if value >= 0 else -1
    value = abs(value)
    while value:
        if value & 1:
            d = 2 - (value & 3)
            out.append((place, sign * d))
            value -= d
        value >>= 1
        place += 1
    return out


def add(table: np.ndarray, bits: int, query: list[int]) -> tuple[list[np.ndarray], int]:
    """Slices, lowest first, of the query's inner products less a constant; and
    that constant."""
    _, dim, _, words = table.shape
    flat = table.reshape(-1, words)
    levels: dict[int, list[int]] = {}
    base = 0
    for d, value in enumerate(query):
        for place, sign in digits(value):
            at = ((0 if sign > 0 else dim) + d) * bits
            for j in range(bits):
                levels.setdefault(place + j, []).append(at + j)
            # u = v + bias; its complement is 2 ** bits - 1 - u
            base += (-(1 << (bits - 1)) if sign > 0 else (1 << (bits - 1)) - (1 << bits) + 1) << place
    out: list[np.ndarray] = []
    carried: list[np.ndarray] = []
    level = 0
    while level <= max(levels, default=-1) or carried:
        own = [flat[levels[level]]] if level in levels else []
        parts = own + carried
        carried = []
        pile = np.concatenate(parts) if parts else np.zeros((0, words), np.uint64)
        while len(pile) > 2:  # three slices of a level become one, and one of the next
            n = len(pile) // 3
            a, b, c = pile[:n], pile[n : 2 * n], pile[2 * n : 3 * n]
            half = a ^ b
            carried.append((a & b) | (half & c))
            half ^= c
            pile = np.concatenate([half, pile[3 * n :]])
        if len(pile) == 2:
            carried.append((pile[0] & pile[1])[None])
            out.append(pile[0] ^ pile[1])
        else:
            out.append(pile[0] if len(pile) else np.zeros(words, np.uint64))
        level += 1
    return out, base


def choose(sums: list[np.ndarray], live: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Numbers of the k rows among live with the highest sums, ties to smaller ids."""
    sure, tied = np.zeros_like(live), live.copy()
    for s in reversed(sums):
        ones = tied & s
        n = int(np.bitwise_count(sure).sum()) + int(np.bitwise_count(ones).sum())
        if n > k:
            tied = ones
        else:
            sure |= ones
            tied &= ~s
            if n == k:
                tied[:] = 0
                break
    rows = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
    rest = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))
    if len(rest) > k - len(rows):
        rest = rest[np.argsort(ids[rest], kind="stable")[: k - len(rows)]]
    return np.concatenate([rows, rest])


def value_of(sums: list[np.ndarray], row: int) -> int:
    return sum(int((s[row >> 6] >> np.uint64(row & 63)) & np.uint64(1)) << i for i, s in enumerate(sums))


def search(table: np.ndarray, bits: int, ids: np.ndarray, queries: np.ndarray, query_ids: np.ndarray, k: int):
    """(number of the query, id, score) of each query's k best rows of a block."""
    n, words = len(ids), table.shape[-1]
    full = np.zeros(words * 64, np.uint8)
    full[:n] = 1
    full = np.packbits(full, bitorder="little").view(np.uint64)
    order = np.argsort(ids, kind="stable")
    ranked = ids[order]
    at, found, scores = [], [], []
    for i, (query, own) in enumerate(zip(queries.tolist(), query_ids.tolist())):
        live = full
        a, b = np.searchsorted(ranked, own, "left"), np.searchsorted(ranked, own, "right")
        if b > a:
            live = full.copy()
            for row in order[a:b].tolist():
                live[row >> 6] &= ~(np.uint64(1) << np.uint64(row & 63))
        sums, base = add(table, bits, query)
        if not sums:  # a query of zeros
            sums = [np.zeros(words, np.uint64)]
        for row in choose(sums, live, ids, k).tolist():
            at.append(i)
            found.append(int(ids[row]))
            scores.append(value_of(sums, row) + base)
    return at, found, scores


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """Rows (id, dim, v) of the vectors that take part."""
    x = F.col("x")
    scaled = lambda e: F.lit(scale) * e.cast("double")
    # from 2 ** 52 on doubles are whole, and floor's long might not hold them
    double = F.transform("x", lambda e: F.when(F.abs(scaled(e)) < 2.0**52, F.floor(scaled(e)).cast("double")).otherwise(scaled(e)))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").alias("x")).filter(x.isNotNull() & F.col("id").isNotNull())
    fine = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e.cast("double")) < float("inf")))
    return rows.filter(fine).select("id", F.size("x").alias("dim"), double.alias("v"))


def _matrix(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Whole numbers, held as doubles, of vectors of dim components."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat, np.float64).reshape(len(column), dim)


def integers(values: np.ndarray) -> np.ndarray:
    if np.abs(values).max(initial=0) < WIDE:
        return values.astype(np.int64)
    return np.array([[int(x) for x in row] for row in values.tolist()], object).reshape(values.shape)


def top(vectors: DataFrame, is_query, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE) -> DataFrame:
    """Rows (query_id, rank, vec_id, score); is_query: from the id column to a
    condition."""
    rows = quantised(vectors, id_col, vector_col, scale)
    asked = rows.filter(is_query(F.col("id")))
    n_rows, n_asked = rows.count(), asked.count()
    row_blocks, query_blocks = max(1, -(-n_rows // ROWS)), max(1, -(-n_asked // QUERIES))

    salts = min(SALTS, row_blocks)

    def index(table: pa.Table) -> pa.Table:
        dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
        ids = table["id"].to_numpy().astype(np.int64)
        out, bits = slices(integers(_matrix(table["v"], dim)))
        return pa.table({"dim": pa.array([dim], pa.int32()), "salt": pa.array([block % salts], pa.int64()), "bits": pa.array([bits], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "table": pa.array([out[0].tobytes()], pa.binary())})

    blocks = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(row_blocks))).groupBy("dim", "block").applyInArrow(index, "dim int, salt long, bits int, ids binary, table binary")

    def gather(table: pa.Table) -> pa.Table:
        dim, block = table["dim"][0].as_py(), table["asked"][0].as_py()
        values, ids = _matrix(table["v"], dim), table["id"].to_numpy().astype(np.int64)
        return pa.table({"dim": pa.array([dim], pa.int32()), "asked": pa.array([block], pa.int64()), "query_ids": pa.array([ids.tobytes()], pa.binary()), "queries": pa.array([values.tobytes()], pa.binary())})

    queries = asked.withColumn("asked", F.pmod(F.xxhash64("id", F.lit(5)), F.lit(query_blocks))).groupBy("dim", "asked").applyInArrow(gather, "dim int, asked long, query_ids binary, queries binary")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    pairs = blocks.withColumn("asked", every(query_blocks))
    pairs = pairs.join(queries.withColumn("salt", every(salts)).hint("merge"), ["dim", "asked", "salt"])

    def run(batches):
        best: dict[tuple, dict[int, list]] = {}  # by block of queries, sorted as the join leaves them

        def told():
            for (asked_block, dim), by_query in best.items():
                lines = [(f"{asked_block}:{dim}:{i}", own, row, x) for i, (own, some) in by_query.items() for x, row in some]
                key, own, found, scores = zip(*lines) if lines else ((), (), (), ())
                # scores that a long can't tell apart are ranked by their digits
                order = [None if -LONG - 1 < x < LONG else f"{x + 10**99:0100d}" for x in scores]
                columns = [pa.array(key, pa.string()), pa.array(own, pa.int64()), pa.array(found, pa.int64()), pa.array([max(-LONG - 1, min(LONG, x)) for x in scores], pa.int64()), pa.array(order, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "query_id", "vec_id", "score", "wide"])
            best.clear()

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                dim, bits, place = row["dim"], row["bits"], (row["asked"], row["dim"])
                if place not in best:
                    yield from told()
                    best[place] = {}
                ids = np.frombuffer(row["ids"], np.int64)
                plain = np.frombuffer(row["table"], np.uint64).reshape(dim, bits, -(-len(ids) // 64))
                table = np.stack([plain, ~plain])
                asked_ids = np.frombuffer(row["query_ids"], np.int64)
                values = integers(np.frombuffer(row["queries"], np.float64).reshape(len(asked_ids), dim))
                by_query: dict[int, list] = {}
                for i, found, score in zip(*search(table, bits, ids, values, asked_ids, k)):
                    by_query.setdefault(i, []).append((score, found))
                for i, some in by_query.items():
                    _, before = best[place].get(i, (0, []))
                    best[place][i] = int(asked_ids[i]), sorted(before + some, key=lambda x: (-x[0], x[1]))[:k]
        yield from told()

    found = pairs.mapInArrow(run, "key string, query_id long, vec_id long, score long, wide string")
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(F.col("score").desc(), F.col("wide").desc(), "vec_id")))
    return best.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return top(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), lambda c: F.pmod(c, F.lit(EVERY)) == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, r.vec_id AS vec_id, CAST(list_dot_product(q.e, r.e) AS BIGINT) AS score
  FROM v q JOIN v r ON q.vec_id <> r.vec_id WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s)
SELECT query_id, CAST(k AS INTEGER) AS rank, vec_id, score FROM t WHERE k <= 5
"""
