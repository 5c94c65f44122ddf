"""Passages that repeat across documents, by a sparse suffix array.

Suffixes are kept where a run of KEY words has the least hash of WINDOW runs in a
row: any LEAST words that two texts share hold such a place, the same in both.
Suffixes whose first KEY words occur in one text only are dropped. The others are
sorted by their words (range partitions, so that a passage in very many documents
is split) and compared with their neighbours from other texts, before and after,
also over the partitions' boundaries. Suffixes with the same first words are
sorted a second time by the words to their left, nearest first, and compared
likewise. Matches are extended left and right; those of LEAST words or more are
reported, and matches of one text that meet are one passage.

Neighbours may all have larger ids. So each LEAST words around a kept place are
also looked up by their hash, with the least and the largest id of the texts that
hold them: every one held by an earlier document is cut, whatever stands beside it
in either order.

A suffix carries the words around it that lie nearer than the next kept ones, so
longer passages are joined from several suffixes. Equal texts are one text, and
the whole of it is a passage. Words are compared by hash, case and all.

A match is cut where its partner is earlier: has a smaller id, or the same id and a
smaller text key. So what is cut stands in an earlier document, and in the end in
one where it stays.

Defined results: null texts and texts under LEAST words hold no passage; a null id
counts as the largest; ids may repeat with other texts, a row is told by id and text;
of a text of one word over and over, the run is kept from its first word on; repeated
rows of one id and text are one document; an empty table gives an empty table. Columns
with clashing names don't matter; a text is held whole while it is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, mix64, picked, spans, stored, text_key, utf8, word_hashes, words

LEAST, KEY = 50, 20
WINDOW = LEAST - KEY + 1
#: Words that a suffix carries before it, and after its key.
LEFT, RIGHT = WINDOW, WINDOW + 1
#: Stands for a null id.
LAST = 2**63 - 1


def _sliding(x: np.ndarray, n: int, least) -> np.ndarray:
    """least (np.minimum or np.maximum) of n values from each place on; the last
    n - 1 places are cut off."""
    size, out = 1, x
    while 2 * size <= n:
        out = least(out[:-size], out[size:])
        size *= 2
    rest = n - size
    return least(out[: len(out) - rest], out[rest:]) if rest else out


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Places kept in a text of word hashes, and hashes of the KEY words there; for
    each LEAST words in a row their hash, and the key kept among them."""
    n = len(h) - KEY + 1
    if len(h) < LEAST:
        return np.zeros(0, np.int64), *[np.zeros(0, np.uint64)] * 3
    # runs of 4, 16 and 20 words: each hash is of two shorter runs'
    two = mix64(h[:-1] + mix64(h[1:]))
    four = mix64(two[:-2] + mix64(two[2:]))
    eight = mix64(four[:-4] + mix64(four[4:]))
    sixteen = mix64(eight[:-8] + mix64(eight[8:]))
    key = mix64(sixteen[:n] + mix64(four[16 : 16 + n]))
    lowest = _sliding(key, WINDOW, np.minimum)
    # LEAST words are 16 and 16 and 16 and 2
    m = len(lowest)
    whole = mix64(sixteen[:m] + mix64(sixteen[16 : 16 + m] + mix64(sixteen[32 : 32 + m] + mix64(two[48 : 48 + m]))))
    # a place is kept if it is the lowest of one of the windows that it lies in
    wide = np.concatenate([np.zeros(WINDOW - 1, np.uint64), lowest, np.zeros(WINDOW - 1, np.uint64)])
    keep = _sliding(wide, WINDOW, np.maximum) == key
    keep[1:] &= key[1:] != key[:-1]
    at = np.flatnonzero(keep)
    return at, key[at], whole, lowest


def _kept(batches):
    """(id, t, n, keys) of each row (id, t, text): number of words, keys of the suffixes kept."""
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for a, b in spans(np.diff(offsets)):
            piece, where = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            begin, end, row = words(piece, where)
            h = word_hashes(piece, begin, end)
            limit = np.searchsorted(row, np.arange(b - a + 1))
            found = [np.unique(anchors(h[i:j])[1]).view(np.int64) for i, j in zip(limit.tolist(), limit[1:].tolist())]
            size = np.cumsum([0, *map(len, found)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(size), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(np.diff(limit)), listed], names=["id", "t", "n", "keys"])


SUFFIX = "key long, `right` binary, `left` binary, id long, t long, pos long, n long, runs array<struct<start: long, run: long>>"


def _suffixes(batches):
    """The suffixes of a text whose keys are wanted, with the words around; each LEAST
    words whose key is wanted stand with the suffix before them."""
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        ids, ts, wanted = batch.column(0), batch.column(1), batch.column(3)
        for i in range(batch.num_rows):
            raw = data[offsets[i] : offsets[i + 1]]
            begin, end, _ = words(raw, np.array([0, len(raw)]))
            h = word_hashes(raw, begin, end)
            at, key, whole, lowest = anchors(h)
            of = np.array(wanted[i].as_py(), np.int64).view(np.uint64)
            ok = np.isin(key, of)
            at, key = at[ok], key[ok]
            start = np.flatnonzero(np.isin(lowest, of))
            limit = np.concatenate([[0], np.searchsorted(start, at[1:]), [len(start)]]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(limit[: len(at) + 1]), pa.StructArray.from_arrays([pa.array(start), pa.array(whole[start].view(np.int64))], names=["start", "run"]))
            short = np.concatenate([np.zeros(LEFT, np.uint32), (h >> np.uint64(32)).astype(np.uint32), np.zeros(RIGHT, np.uint32)]).astype(">u4")
            right = short[(at + LEFT + KEY)[:, None] + np.arange(RIGHT)]
            left = short[(at + LEFT - 1)[:, None] - np.arange(LEFT)]
            n = len(at)
            pack = lambda m: pa.array([x.tobytes() for x in m], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pack(right), pack(left), pa.array(np.full(n, ids[i].as_py())), pa.array(np.full(n, ts[i].as_py())), pa.array(at), pa.array(np.full(n, len(h))), runs],
                names=["key", "right", "left", "id", "t", "pos", "n", "runs"],
            )


class Suffixes:
    """Columns of sorted suffixes."""

    def __init__(self, table: pa.Table):
        self.key, self.id, self.t, self.pos, self.n = (table[c].to_numpy() for c in ("key", "id", "t", "pos", "n"))
        unpack = lambda c, k: np.frombuffer(b"".join(table[c].to_pylist()), ">u4").reshape(-1, k)
        self.right, self.left = unpack("right", RIGHT), unpack("left", LEFT)

    def match(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that suffixes a and b, of one key, share to the left and from their
        first word on."""

        def run(x, room):
            same = x[a] == x[b]
            n = np.where(same.all(axis=1), x.shape[1], same.argmin(axis=1))
            return np.minimum(n, np.minimum(room[a], room[b]))

        return run(self.left, self.pos), KEY + run(self.right, self.n - self.pos - KEY)


def partners(s: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (suffix, partner) to compare: the nearest of another text before and
    after in order, of the same key."""
    n = len(s.key)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    step = (s.key[1:] != s.key[:-1]) | (s.t[1:] != s.t[:-1])
    first = np.concatenate([[0], np.flatnonzero(step) + 1])
    run = np.cumsum(np.concatenate([[0], step]))
    before, after = first[run] - 1, np.append(first[1:], n)[run]
    here = np.arange(n)
    a = np.concatenate([here, here])
    b = np.concatenate([before, after])
    ok = (b >= 0) & (b < n)
    a, b = a[ok], b[ok]
    ok = (s.key[a] == s.key[b]) & (s.t[a] != s.t[b])
    return a[ok], b[ok]


def found(s: Suffixes, a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Passages (t, start, stop, other, cut) of LEAST words or more."""
    parts = []
    for at in range(0, len(a), 1 << 16):
        x, y = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        left, right = s.match(x, y)
        ok = left + right >= LEAST
        x, y, left, right = x[ok], y[ok], left[ok], right[ok]
        cut = (s.id[y] < s.id[x]) | ((s.id[y] == s.id[x]) & (s.t[y] < s.t[x]))
        parts.append(pa.table([pa.array(c) for c in (s.t[x], s.pos[x] - left, s.pos[x] + right, s.id[y], cut)], names=["t", "start", "stop", "other", "cut"]))
    return pa.concat_tables(parts) if parts else pa.table({c: pa.array([], k) for c, k in (("t", pa.int64()), ("start", pa.int64()), ("stop", pa.int64()), ("other", pa.int64()), ("cut", pa.bool_()))})


MATCH = "t long, start long, stop long, other long, cut boolean"
EDGE = "part int, place int, edge boolean"


def _neighbours(batches):
    """Matches within a sorted partition; and the suffixes at its ends, as rows with
    a part: those of its first and last texts, and one beyond them."""
    from pyspark import TaskContext

    table = pa.Table.from_batches(list(batches)) if batches is not None else None
    if table is None or not table.num_rows:
        return
    s = Suffixes(table)
    n = table.num_rows
    part = TaskContext.get().partitionId()
    out = found(s, *partners(s))
    blank = lambda m, k: pa.nulls(m, k)
    kinds = [table.schema.field(c).type for c in table.schema.names]
    m = out.num_rows
    if m:
        yield pa.RecordBatch.from_arrays([*[out[c].combine_chunks() for c in out.schema.names], blank(m, pa.int32()), blank(m, pa.int32()), blank(m, pa.bool_()), *[blank(m, k) for k in kinds]], names=COLUMNS)
    step = np.flatnonzero((s.key[1:] != s.key[:-1]) | (s.t[1:] != s.t[:-1])) + 1
    head, tail = (int(step[0]), int(step[-1])) if len(step) else (n, 0)
    edge = {*range(head), *range(tail, n)}
    more = {min(head, n - 1), max(tail - 1, 0)}
    rows = np.array(sorted(edge | more))
    of = table.take(pa.array(rows))
    m = len(rows)
    kinds_of_match = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
    yield pa.RecordBatch.from_arrays(
        [*[blank(m, k) for k in kinds_of_match], pa.array(np.full(m, part, np.int32)), pa.array(rows.astype(np.int32)), pa.array(np.isin(rows, sorted(edge))), *[of[c].combine_chunks() for c in table.schema.names]], names=COLUMNS
    )


COLUMNS = ["t", "start", "stop", "other", "cut", "part", "place", "edge", "s_key", "s_right", "s_left", "s_id", "s_t", "s_pos", "s_n"]
SORTED = f"{MATCH}, {EDGE}, s_key long, s_right binary, s_left binary, s_id long, s_t long, s_pos long, s_n long"


def matches(suffixes: DataFrame, *sides: str) -> DataFrame:
    """Sorts the suffixes, by their keys and then by the words of the first side,
    then of the other, and returns MATCH rows."""
    spark = suffixes.sparkSession
    order = ["key", *sides, "t", "pos"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = suffixes.select("key", "right", "left", "id", "t", "pos", "n").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    told = stored(rows.mapInArrow(_neighbours, SORTED), "matches")
    inner = told.filter("part IS NULL").select("t", "start", "stop", "other", "cut")
    # a few suffixes from each partition: the order goes on from one to the next
    ends = told.filter("part IS NOT NULL").select("part", "place", "s_key", *[F.col(f"s_{c}").alias(c) for c in ("key", "right", "left", "id", "t", "pos", "n")])
    return inner.unionByName(ends.groupBy("s_key").applyInArrow(_across, MATCH))


def _across(ends: pa.Table) -> pa.Table:
    """Matches over partitions' boundaries, among the boundary suffixes of one key."""
    s = Suffixes(ends.sort_by([("part", "ascending"), ("place", "ascending")]))
    return found(s, *partners(s))


def held(suffixes: DataFrame) -> DataFrame:
    """MATCH rows of every LEAST words that several texts hold, against the earliest
    of these; in the earliest, against the latest."""
    me = F.struct("id", "t")
    runs = suffixes.select("t", "id", F.explode("runs").alias("x")).select("t", "id", "x.start", "x.run")
    ends = runs.groupBy("run").agg(F.min(me).alias("least"), F.max(me).alias("most")).filter("least < most")
    cut = F.col("least") < me
    other = F.when(cut, F.col("least.id")).otherwise(F.col("most.id"))
    return runs.join(ends, "run").select("t", "start", (F.col("start") + LEAST).alias("stop"), other.alias("other"), cut.alias("cut"))


def _joined(batches):
    """One row (t, start, stop, other, cut) for matches of a text that meet; cut
    and uncut apart."""
    for batch in batches:
        out = []
        for t, some in zip(batch.column("t").to_pylist(), batch.column("found").to_pylist()):
            for cut in (False, True):
                last = None
                for x in sorted((x["start"], x["stop"], x["other"]) for x in some if x["cut"] or not cut):
                    if last and x[0] <= last[1]:
                        last[1], last[2] = max(last[1], x[1]), min(last[2], x[2])
                    else:
                        last = [x[0], x[1], x[2]]
                        out.append((t, cut, last))
        columns = ([x[0] for x in out], *[[x[2][i] for x in out] for i in range(3)])
        yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array([x[1] for x in out], pa.bool_())], names=["t", "start", "stop", "other", "cut"])


def _passages(docs: DataFrame) -> DataFrame:
    """docs: (id, t, text). Rows (id, t, start, n_words, other_id, cut) as passages()
    has them, one document for all rows of an id and text."""
    docs = docs.withColumn("id", F.coalesce("id", F.lit(LAST))).filter("t IS NOT NULL")
    rows = stored(docs.mapInArrow(_kept, "id long, t long, n long, keys array<long>"), "kept")
    texts = checkpointed(rows.groupBy("t").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("n").alias("n"), F.first("keys").alias("keys")))
    keyed = texts.select("t", "id", F.explode("keys").alias("key"))
    common = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1").select("key")
    wanted = checkpointed(keyed.join(common, "key").groupBy("t", "id").agg(F.collect_list("key").alias("wanted")))
    some = picked(docs, wanted).dropDuplicates(["id", "t"]).select("id", "t", "text", "wanted")
    suffixes = stored(some.mapInArrow(_suffixes, SUFFIX), "suffixes")
    # the neighbour in one order shares most to the right, in the other most to the left
    near = matches(suffixes, "right", "left").unionByName(matches(suffixes, "left", "right")).unionByName(held(suffixes)).groupBy("t").agg(F.collect_list(F.struct("start", "stop", "other", "cut")).alias("found"))
    near = checkpointed(near.mapInArrow(_joined, "t long, start long, stop long, other long, cut boolean"))
    discard(suffixes)
    single = rows.select("id", "t").distinct()
    out = single.join(near, "t").select("id", "t", "start", (F.col("stop") - F.col("start")).alias("n_words"), F.col("other").alias("other_id"), "cut")
    # equal texts under several ids: all of it repeats, and all but the first are cut
    equal = texts.filter((F.col("last") > F.col("id")) & (F.col("n") >= LEAST)).select("t", F.col("id").alias("least"), "last", "n")
    copies = single.join(equal, "t").withColumn("other_id", F.when(F.col("id") == F.col("least"), F.col("last")).otherwise(F.col("least")))
    whole = lambda cut: copies.select("id", "t", F.lit(0).cast("long").alias("start"), F.col("n").alias("n_words"), "other_id", F.lit(cut).alias("cut"))
    out = out.unionByName(whole(False)).unionByName(whole(True).filter("other_id < id"))
    null = lambda c: F.when(F.col(c) != LAST, F.col(c)).alias(c)
    return out.select(null("id"), "t", "start", "n_words", null("other_id"), "cut")


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, start, n_words, other_id, cut): passages by first word and number
    of words. other_id is another document that holds it. cut = false: all repeated
    passages; cut = true: the parts to take out so that each passage stays once."""
    text = F.col(f"`{text_col}`")
    return _passages(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(text).alias("t"), text.alias("text"))).drop("t")


def cut_words(text: str, parts: list[tuple[int, int]]) -> str:
    """The text without the words of parts (first, number); what is left on either
    side of a part is joined by a line feed."""
    raw = np.frombuffer(text.encode(), np.uint8)
    begin, end, _ = words(raw, np.array([0, len(raw)]))
    left, at, data = [], 0, raw.tobytes()
    for first, n in sorted(parts):
        start, stop = int(begin[first]), int(end[min(first + n, len(end)) - 1])
        if start > at:
            left.append(data[at:start].decode("utf-8", "replace"))
        at = max(at, stop)
    left.append(data[at:].decode("utf-8", "replace"))
    return "\n".join(x for x in map(str.strip, left) if x)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs without the parts to cut; documents of which nothing is left go. Same
    columns; n_chars, where there is one, is told anew for the texts that change."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    text = f"c{columns.index('text')}"
    rows = plain.withColumns({"row_id": F.col(f"c{columns.index('doc_id')}").cast("long"), "row_t": text_key(F.col(text))})
    found = _passages(rows.select(F.col("row_id").alias("id"), F.col("row_t").alias("t"), F.col(text).alias("text")))
    parts = found.filter("cut").groupBy("id", "t").agg(F.collect_list(F.struct("start", "n_words")).alias("parts"))
    both = rows.join(parts, rows["row_id"].eqNullSafe(parts["id"]) & (rows["row_t"] == parts["t"]), "left").select(*plain.columns, "parts")

    def run(batches):
        for batch in batches:
            names = list(batch.schema.names)
            at = names.index(text)
            texts, out = batch.column(at).to_pylist(), []
            for x, some in zip(texts, batch.column(len(names) - 1).to_pylist()):
                out.append(x if some is None or x is None else cut_words(x, [(p["start"], p["n_words"]) for p in some]))
            arrays = [pa.array(out, batch.schema.field(at).type) if i == at else batch.column(i) for i in range(len(names) - 1)]
            keep = pa.array([some is None or x != "" for x, some in zip(out, batch.column(len(names) - 1).to_pylist())])
            changed = pa.array([some is not None for some in batch.column(len(names) - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*arrays, changed], names=[*names[:-1], "changed"]).filter(keep)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields) + ", changed boolean"
    out = both.mapInArrow(run, schema)
    if "n_chars" in columns:
        n = f"c{columns.index('n_chars')}"
        out = out.withColumn(n, F.when(F.col("changed"), F.length(text)).otherwise(F.col(n)).cast(plain.schema[n].dataType))
    return out.select(*plain.columns).toDF(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = passages(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return found.filter("NOT cut").select(F.col("id").alias("doc_id"), F.col("start").alias("start_word"), "n_words", F.col("other_id").alias("other_doc_id"))
