"""Near-duplicate documents by ProbMinHash.

A document is its set of five-word shingles, weighted by how often they occur. For
each shingle, arrivals of a Poisson process of the shingle's weight fall on random
registers; a register keeps the earliest. A shingle's arrivals end as soon as they
come later than all registers' earliest, so most shingles arrive once. Registers
of two documents agree with the probability Jaccard similarity of their shingles.

Registers are banded. Documents that share a band are compared, first by registers,
then exactly, by the probability Jaccard similarity of all their shingles (equal
to the Jaccard similarity where no shingle recurs); links are those of THRESHOLD or
more, and classes are connected documents.

Equal texts are one text. A band's texts are never paired with each other at once:
first each text is compared with the leader of a band (the best-looking of its
bands). Texts in one band that this leaves in different components are compared in
blocks of BLOCK, without those of the band's largest component among themselves;
pairs are not written, only links. So no link between different texts is lost, and a
pair whose components are joined by then is not compared. Signatures come first;
shingles are fetched for texts that have a pair to verify only.

Defined results: texts of one to four words have one shingle of all words; texts
without words are linked with equal texts only; a null text is in a class of its
own; repeated rows get a row each; ids may repeat with other texts, a row is told by
id and text; an empty table gives an empty table. A class is named by its least id
that isn't null, null where there is none. Columns with clashing names don't matter;
a text is held whole while it is read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, discard, mix64, picked, spans, stored, text_key, utf8, word_hashes, words
from .components import components

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 5
REGISTERS = BANDS * ROWS
#: Pairs whose registers agree less are not compared exactly: five standard errors below THRESHOLD.
LOOKS = 0.6
BLOCK = 1024

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def _step(n: int) -> np.uint64:
    return np.uint64(n * int(_GOLDEN) & (2**64 - 1))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, hashes and counts of the different shingles of rows of UTF-8, in order
    of row and hash."""
    begin, end, row = words(data, offsets)
    h = word_hashes(data, begin, end, lower=True)
    n = np.bincount(row, minlength=len(offsets) - 1)
    first = np.cumsum(n) - n
    place = np.arange(len(h)) - first[row]
    whole = np.zeros(len(h), np.uint64)
    for step in range(SHINGLE):  # words beyond the end of a short text count as nothing
        at = np.minimum(np.arange(len(h)) + step, max(len(h) - 1, 0))
        more = mix64(h[at] + _step(step + 1))
        whole += np.where(place + step < n[row], more, np.uint64(0))
    starts = (place + SHINGLE <= n[row]) | ((place == 0) & (n[row] < SHINGLE))
    key, of = mix64(whole[starts]), row[starts]
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    return of[at], key[at], np.diff(at, append=len(key))


def signatures(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int) -> np.ndarray:
    """Register contents (the keys that arrived first), rows by REGISTERS; 0 in rows
    without shingles."""
    first = np.full(rows * REGISTERS, np.inf)
    content = np.zeros(rows * REGISTERS, np.uint64)
    key_, row_, weight_ = key, row, weight.astype(float)
    time = np.zeros(len(key))
    step = 0
    while len(key_):
        step += 1
        a = mix64(key_ + _step(2 * step))
        time = time - np.log(((a >> np.uint64(11)).astype(float) + 1) * 2.0**-53) / weight_
        b = mix64(key_ + _step(2 * step + 1))
        register = row_ * REGISTERS + ((b >> np.uint64(32)) * np.uint64(REGISTERS) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(first, register, time)
        won = time == first[register]
        content[register[won]] = key_[won]
        latest = first.reshape(rows, REGISTERS).max(axis=1)
        on = time < latest[row_]
        key_, row_, weight_, time = key_[on], row_[on], weight_[on], time[on]
    return content.reshape(rows, REGISTERS)


def bands(content: np.ndarray) -> np.ndarray:
    """Keys of the bands, rows by BANDS."""
    parts = content.reshape(len(content), BANDS, ROWS)
    out = np.tile((np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * _GOLDEN, (len(content), 1))
    for i in range(ROWS):
        out = mix64(out + parts[:, :, i])
    return out.view(np.int64)


def similarity(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Probability Jaccard similarity of two weighted sets of ascending keys."""
    if not len(a) or not len(b):
        return 0.0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    common = b[at] == a
    if not common.any():
        return 0.0
    wa, wb = wa.astype(float), wb.astype(float)
    x, y = wa[common], wb[at[common]]
    only_a, only_b = wa[~common].sum(), wb.sum() - y.sum()
    if (x == x[0]).all() and (y == y[0]).all():
        return float(len(x) / (len(x) + only_a / x[0] + only_b / y[0]))
    # of the shares x / x_d and y / y_d the larger counts: x's where y / x is no larger than at d
    ratio = y / x
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    upto = np.searchsorted(ratio, ratio, side="right")
    sum_x = np.concatenate([[0], np.cumsum(x)])[upto] + only_a
    sum_y = y.sum() - np.concatenate([[0], np.cumsum(y)])[upto] + only_b
    return float((1 / (sum_x / x + sum_y / y)).sum())


def _signed(batches):
    """(id, t, sig, bands) of each row (id, t, text): registers' low bytes, band keys."""
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for a, b in spans(np.diff(offsets)):
            piece, where = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            row, key, count = shingles(piece, where)
            content = signatures(row, key, count, b - a)
            some = np.bincount(row, minlength=b - a) > 0
            low = (content & np.uint64(255)).astype(np.uint8)
            keys = bands(content)
            sig = [low[i].tobytes() if some[i] else None for i in range(b - a)]
            of = np.where(some, BANDS, 0)
            flat = pa.array(keys[some].reshape(-1))
            listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(of)]).astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(sig, pa.binary()), listed], names=["id", "t", "sig", "bands"])


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity by the low bytes of registers, chance agreement taken off."""
    return ((a == b).mean(axis=-1) - 1 / 256) / (1 - 1 / 256)


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def _looks(batches):
    for batch in batches:
        if batch.num_rows:
            look = _agreement(_matrix(batch.column("sig_a")), _matrix(batch.column("sig_b")))
            ok = np.flatnonzero(look >= LOOKS)
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(ok)), batch.column("b").take(pa.array(ok)), pa.array(look[ok])], names=["a", "b", "look"])


def _shingled(batches):
    """(t, keys, counts) of rows (t, text): all shingles."""
    for batch in batches:
        data, offsets = utf8(batch.column(1))
        for a, b in spans(np.diff(offsets)):
            piece, where = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            row, key, count = shingles(piece, where)
            limit = np.searchsorted(row, np.arange(b - a + 1))
            keys = [key[i:j].tobytes() for i, j in zip(limit.tolist(), limit[1:].tolist())]
            # counts only where a shingle recurs
            counts = [c.astype(np.uint32).tobytes() if (c := count[i:j]).max(initial=1) > 1 else b"" for i, j in zip(limit.tolist(), limit[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], names=["t", "keys", "counts"])


def _verified(threshold: float):
    def weights(raw: bytes, n: int) -> np.ndarray:
        return np.frombuffer(raw, np.uint32) if raw else np.ones(n, np.uint32)

    def run(batches):
        for batch in batches:
            a, b = batch.column("a"), batch.column("b")
            ok = []
            for i in range(batch.num_rows):  # row by row: the arrays are large
                x, y = (np.frombuffer(batch.column(c)[i].as_py(), np.uint64) for c in ("keys_a", "keys_b"))
                wx, wy = weights(batch.column("counts_a")[i].as_py(), len(x)), weights(batch.column("counts_b")[i].as_py(), len(y))
                if similarity(x, wx, y, wy) >= threshold - 1e-12:
                    ok.append(i)
            at = pa.array(ok, pa.int64())
            yield pa.RecordBatch.from_arrays([a.take(at), b.take(at)], names=["a", "b"])

    return run


def shingle_table(wanted: DataFrame, docs: DataFrame, texts: DataFrame) -> DataFrame:
    """All shingles (t, keys, counts) of the texts wanted (t), written; each is read
    from one document that has it, that of the least id."""
    owners = checkpointed(texts.join(wanted, "t", "left_semi").select("id", "t"))
    known = picked(docs, owners).dropDuplicates(["id", "t"]).select("t", "text")
    return stored(known.mapInArrow(_shingled, "t long, keys binary, counts binary"), "shingles")


def verify(pairs: DataFrame, known: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of texts that are as similar as threshold or more."""
    side = lambda c: known.select(F.col("t").alias(c), F.col("keys").alias(f"keys_{c}"), F.col("counts").alias(f"counts_{c}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "keys_a", "counts_a", "keys_b", "counts_b")
    return checkpointed(both.mapInArrow(_verified(threshold), "a long, b long"))


def _block(table: pa.Table):
    """Columns of a block, and its pairs to look at: a text on the left with those on
    the right that have another label, look alike, and share no earlier band; with
    the agreement of their registers."""
    sig = _matrix(table["sig"])
    keys = np.frombuffer(b"".join(np.asarray(x, np.int64).tobytes() for x in table["bands"].to_pylist()), np.int64).reshape(-1, BANDS)
    t, label = table["t"].to_numpy(), table["label"].to_numpy()
    left, minor = (np.array(table[c].to_pylist(), bool) for c in ("left", "minor"))
    key = int(table["key"][0].as_py())
    rows, columns = np.flatnonzero(left), np.flatnonzero(~left)
    a, b, looks = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
    for i in rows.tolist():
        # a pair of two minor texts stands on both sides; once is enough
        others = columns[(label[columns] != label[i]) & (~minor[columns] | (t[columns] > t[i]))]
        if not len(others):
            continue
        look = _agreement(sig[others], sig[i])
        others, look = others[look >= LOOKS], look[look >= LOOKS]
        first = keys[i][(keys[others] == keys[i]).argmax(axis=1)] == key
        a.append(np.full(int(first.sum()), i))
        b.append(others[first])
        looks.append(look[first])
    return t, label, np.concatenate(a), np.concatenate(b), np.concatenate(looks)


def _participants(table: pa.Table) -> pa.Table:
    """Texts of a block that have a pair to look at."""
    t, _, a, b, _ = _block(table)
    who = np.unique(np.concatenate([t[a], t[b]])) if len(a) else np.zeros(0, np.int64)
    return pa.table({"key": pa.array(np.full(len(who), table["key"][0].as_py(), np.int64)), "t": pa.array(who)})


def _crossing(threshold: float):
    """Links of a block between components, by their labels, the pairs that look most
    alike first; a pair whose components are joined by then needs no comparison."""

    def run(table: pa.Table) -> pa.Table:
        _, label, a, b, looks = _block(table)
        keys = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
        counts = [np.frombuffer(x, np.uint32) if x else np.ones(len(k), np.uint32) for x, k in zip(table["counts"].to_pylist(), keys)]
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        out = []
        for k in np.argsort(-looks, kind="stable").tolist():
            i, j = int(a[k]), int(b[k])
            x, y = top(int(label[i])), top(int(label[j]))
            if x != y and similarity(keys[i], counts[i], keys[j], counts[j]) >= threshold - 1e-12:
                up[max(x, y)] = min(x, y)
                out.append((x, y))
        return pa.table({"a": pa.array([x[0] for x in out], pa.int64()), "b": pa.array([x[1] for x in out], pa.int64())})

    return run


def _blocks(members: DataFrame) -> DataFrame:
    """members (key, t, label) of bands; rows (key, i, j, left, minor, t, label) so that
    in each block (key, i, j) texts on the left meet those on the right. Texts of a
    band's most frequent label needn't meet each other: only the others, the minor
    ones, stand on the left."""
    by_label = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    of_key = by_label.groupBy("key").agg(F.max(F.struct("n", "label")).alias("m"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("labels"))
    of_key = of_key.filter("labels > 1").select("key", F.col("m.label").alias("major"), F.ceil((F.col("n") - F.col("m.n")) / BLOCK).cast("int").alias("ni"), F.ceil(F.col("n") / BLOCK).cast("int").alias("nj"))
    rows = members.join(of_key, "key").withColumn("minor", F.col("label") != F.col("major"))
    i, j = F.pmod(F.xxhash64("t"), F.col("ni")).cast("int"), F.pmod(F.xxhash64("t", F.lit(1)), F.col("nj")).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    left = F.when(F.col("minor"), F.transform(every("nj"), lambda x: F.struct(i.alias("i"), x.alias("j"), F.lit(True).alias("left"))))
    right = F.transform(every("ni"), lambda x: F.struct(x.alias("i"), j.alias("j"), F.lit(False).alias("left")))
    placed = rows.withColumn("spot", F.explode(F.concat(right, F.coalesce(left, F.array().cast("array<struct<i:int,j:int,left:boolean>>")))))
    return placed.select("key", "spot.i", "spot.j", "spot.left", "minor", "t", "label")


def across(multi: DataFrame, labels: DataFrame, signed: DataFrame, docs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b), by label, between texts that share a band and lie in different
    components, as many as it takes to join the components that have one. multi: (key,
    t) of the bands of several texts; labels: (t, label) of all texts."""
    slim = multi.join(labels, "t").select("key", "t", "label")
    open_ = slim.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key")
    members = stored(slim.join(open_, "key"), "members")
    full = _blocks(members).join(signed, "t").select("key", "i", "j", "left", "minor", "t", "label", "sig", "bands")
    who = checkpointed(full.groupBy("key", "i", "j").applyInArrow(_participants, "key long, t long").distinct())
    known = shingle_table(who.select("t").distinct(), docs, texts)
    full = _blocks(members.join(who, ["key", "t"], "left_semi")).join(signed.join(known, "t"), "t").select("key", "i", "j", "left", "minor", "t", "label", "sig", "bands", "keys", "counts")
    out = checkpointed(full.groupBy("key", "i", "j").applyInArrow(_crossing(threshold), "a long, b long"))
    discard(known)
    discard(members)
    return out


def _labelled(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """docs: (id, t, text). Returns rows (id, t), one per row of docs, and for each
    text (t, id, label): its least id, and its class."""
    rows = stored(docs.mapInArrow(_signed, "id long, t long, sig binary, bands array<long>"), "signed")
    texts = stored(rows.filter("t IS NOT NULL").groupBy("t").agg(F.min("id").alias("id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")), "texts")
    signed = texts.filter("sig IS NOT NULL").select("t", "sig", "bands")

    banded = signed.select("t", F.explode("bands").alias("key"))
    # text keys are random, so the least one leads
    led = banded.groupBy("key").agg(F.min("t").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("key", "leader")
    multi = stored(banded.join(led, "key").select("key", "t", "leader"), "bands")
    pairs = multi.filter("t <> leader").select(F.col("t").alias("a"), F.col("leader").alias("b")).distinct()
    side = lambda c: signed.select(F.col("t").alias(c), F.col("sig").alias(f"sig_{c}"))
    looks = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sig_a", "sig_b").mapInArrow(_looks, "a long, b long, look double")
    # the best-looking leader of each text first
    best = checkpointed(looks.groupBy("a").agg(F.max_by("b", "look").alias("b")))
    known = shingle_table(best.select(F.explode(F.array("a", "b")).alias("t")).distinct(), docs, texts)
    edges = verify(best, known, threshold)
    discard(known)
    first = components(edges).select(F.col("node").alias("t"), F.col("label"))
    named = checkpointed(texts.select("t", "id").join(first, "t", "left").select("t", "id", F.coalesce("label", "t").alias("label")))
    more = across(multi.select("key", "t"), named.select("t", "label"), signed, docs, texts.select("t", "id"), threshold)
    joined = components(more).select(F.col("node").alias("label"), F.col("label").alias("joined"))
    discard(multi)
    return rows.select("id", "t"), checkpointed(named.join(joined, "label", "left").select("t", "id", F.coalesce("joined", "label").alias("label")))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Rows (id, class_id), one for each row of docs."""
    text = F.col(f"`{text_col}`")
    rows, texts = _labelled(docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_key(text).alias("t"), text.alias("text")), threshold)
    of_label = texts.groupBy("label").agg(F.min("id").alias("class_id"))
    of_text = texts.join(of_label, "label").select("t", "class_id")
    return rows.join(of_text, "t", "left").select(F.col("id").alias(id_col), F.when(F.col("t").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class, one of its least id (of texts with that id the
    one of the least key; of repeated rows any); rows with a null text all stay. Same
    columns."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    id_, text = F.col(f"c{columns.index('doc_id')}").cast("long"), F.col(f"c{columns.index('text')}")
    _, texts = _labelled(plain.select(id_.alias("id"), text_key(text).alias("t"), text.alias("text")), threshold)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "t")).alias("x")
    kept = texts.groupBy("label").agg(first).select(F.col("x.id").alias("kept_id"), F.col("x.t").alias("kept_t"))
    rows = plain.withColumn("row_id", id_).withColumn("row_t", text_key(text))
    some = rows.join(kept, rows["row_id"].eqNullSafe(kept["kept_id"]) & (rows["row_t"] == kept["kept_t"]), "left_semi").dropDuplicates(["row_id", "row_t"])
    return some.unionByName(rows.filter(F.col("row_t").isNull())).select(*plain.columns).toDF(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
