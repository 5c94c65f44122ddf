"""Language-model scoring with a weighted backoff automaton of words.

A state is the word read last; a document begins in the state of its end token. A
state has an arc for each word that followed it in training, with a probability
smoothed by a Dirichlet prior, and a failure arc with the weight left over, to the
empty context. That one has an arc for every word seen; its probability adds the
word's share of all tokens (Good-Turing: the share of unseen words is that of words
seen once) and the probability of its spelling in the automaton of automaton.py. Words
not seen in training are one event together. A text is read once, left to right.

Every word and every pair of words of the training texts is in the model. With p the
word before, t the word, n counts and P0 the empty context,

    P(t | p) = (n(p, t) + PRIOR P0(t)) / (n(p) + PRIOR),

so the log of a token is that of P0(t), that of the failure arc's weight PRIOR / (n(p) +
PRIOR), and, where the pair has an arc, log(1 + n(p, t) / (PRIOR P0(t))). The first two
need the counts of words only, the third the count of the pair and P0(t); these can be
added up in different places.

Training passes over the text twice: words, then pairs of context words. All are
counted per task in numpy, dealt by hash in packed arrays and summed. Each word is spelled
once, whatever its count: the bytes that follow each other in the words, times their
counts, are the arcs of the spelling automaton, whose states are all contexts of bytes.
The states of the most frequent contexts (STATES at most) are laid out as tables, by which
all words are read; a byte whose whole context has no state there asks for its arc among
all of them, which stay dealt by hash.

The most frequent words (HOT at most) and the arcs between the CONTEXTS most frequent
are small enough for every task. Everything else stays dealt by hash, and documents ask
there: the counts and spellings of
other words are one table; the other pairs of training documents are counted from what
the documents ask, since each asks for all of its pairs. A pair goes to the part of its
second word where that isn't among HOT, so that it meets that word's count, else to
one of its own hash. A pair dealt so has a word beyond the CONTEXTS most frequent, hence
at most 1 / CONTEXTS of all tokens.

The base score is exact: every word's count over all training tokens, frequent or
not. Words are compared by 64-bit hash, pairs by 48 bits of theirs within a part.

Defined results: a null text is an empty one, whose only token is its end; without
training documents all counts are 0; repeated rows are scored each; an empty table
gives an empty table; a kept column named like a result, or like a column that the
operator needs on the way, is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import ORDER, PART, Automaton, arcs_taken, context_totals, merge, resolved, shorter, since_start, stream
from .common import crc_rest, discard, mix64, spans, stored, utf8, word_hashes, words

#: Words that every task gets, and states of spellings that are laid out as tables, at most.
HOT, STATES = 200_000, 100_000
#: Words the arcs between which every task gets, at most.
CONTEXTS = 2048
#: Tokens that the empty context counts for in a state, and the weight of shares of
#: all tokens against spellings.
PRIOR, SHARES = 300.0, 0.8
#: Hash of the end of a document, a token like any other.
END = mix64(np.array([0x656E64], np.uint64))
GRAMS = 1
#: Entries that a task gathers before it sums them.
GATHER = 4_000_000
#: Training tokens for a part that is asked, and parts that are made for them at most: each
#: is asked by every task, and more parts than that follow from spark.sql.shuffle.partitions.
ASKED, PARTS = 1_000_000, 4096
#: Frequencies are told apart by 1/8 of a power of 2 where a threshold is sought.
STEPS = 8


def _deal(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings entries together by part, and the parts' limits."""
    part = (mix64(keys) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _gram_key(codes: np.ndarray) -> np.ndarray:
    """Grams meet by the last two bytes of their context, so that all contexts of
    two bytes or more are whole in one part."""
    return (codes >> np.uint64(8)) & np.uint64(0xFFFF)


def _spelled_words(text: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The words of a stream, each with the space that ends it."""
    limits = np.append(starts, len(text)).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(limits), pa.py_buffer(np.ascontiguousarray(text))])


def _distinct(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Keys, ascending, counts and spellings of the words of these spans."""
    keys, first, counts = np.unique(word_hashes(data, begin, end, lower=True), return_index=True, return_counts=True)
    if not len(keys):
        return keys, counts, pa.array([], pa.large_binary())
    limits = np.stack([begin, end], 1).astype(np.int64).reshape(-1)  # words, and the gaps between them
    each = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(limits) - 1, [None, pa.py_buffer(limits), pa.py_buffer(np.ascontiguousarray(data))])
    return keys, counts.astype(np.int64), _spelled_words(*stream(*utf8(each.take(pa.array(2 * first)))))


def _merged(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Sums of counts by word, keys ascending."""
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.large_binary())
    keys, counts, texts = zip(*held)
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=keys[order][:1] + np.uint64(1)))
    return keys[order[first]], np.add.reduceat(counts[order], first) if len(first) else counts, pa.concat_arrays(texts).take(pa.array(order[first]))


def _counting(parts: int):
    def run(batches):
        held = []

        def size():
            return sum(len(x[0]) + x[2].nbytes // 16 for x in held)

        def sent():
            keys, counts, texts = _merged(held)
            order, limits = _deal(keys, parts)
            for p in np.flatnonzero(np.diff(limits)).tolist():
                of = order[limits[p] : limits[p + 1]]
                yield _words_packed(p, keys[of], counts[of], texts.take(pa.array(of)))

        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in spans(np.diff(offsets)):
                piece, where = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                begin, end, _ = words(piece, where)
                held += [_distinct(piece, begin, end), (END, np.array([b - a]), pa.array([b""], pa.large_binary()))]
                if size() > 2 * GATHER:
                    held = [_merged(held)]
                    if size() > GATHER:
                        yield from sent()
                        held = []
        yield from sent()

    return run


WORD_ROW = "p int, keys binary, counts binary, spelling binary"


def _words_packed(p: int, keys: np.ndarray, counts: np.ndarray, texts: pa.Array) -> pa.RecordBatch:
    columns = keys.astype(np.uint64), counts.astype(np.int64), utf8(texts)[0]
    return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in columns]], names=["p", "keys", "counts", "spelling"])


def _words_of(table):
    """Keys, counts and spellings of each row; that of the end is empty."""
    for row in zip(*(table.column(c).to_pylist() for c in ("keys", "counts", "spelling"))):
        keys, counts, text = (np.frombuffer(x, t) for x, t in zip(row, (np.uint64, np.int64, np.uint8)))
        lengths = np.zeros(len(keys), np.int64)
        lengths[keys != END] = np.diff(np.flatnonzero(text == PART), prepend=-1)
        yield keys, counts, _spelled_words(text, np.cumsum(lengths) - lengths)


def _sum_words(table: pa.Table) -> pa.Table:
    return pa.Table.from_batches([_words_packed(table["p"][0].as_py(), *_merged(list(_words_of(table))))])


def _spans_of(texts: pa.Array):
    """Streams of words some at a time: the first and last of them, text and starts."""
    data, offsets = utf8(texts)
    for a, b in spans(np.diff(offsets)):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a:b] - offsets[a]


def _spelling(parts: int):
    """Counts of the arcs that the spellings take, dealt so that all arcs of a context
    of two bytes or more meet."""

    def run(batches):
        held = ([], [])

        def sent():
            codes, counts = merge(*held)
            order, limits = _deal(_gram_key(codes), parts)
            for p in np.flatnonzero(np.diff(limits)).tolist():
                of = order[limits[p] : limits[p + 1]]
                yield _packed(GRAMS, p, codes[of], counts[of])

        for batch in batches:
            for keys, counts, texts in _words_of(batch):
                own = np.flatnonzero(keys != END)
                counts = counts[own]
                for a, b, text, starts in _spans_of(texts.take(pa.array(own))):
                    codes, times = merge([arcs_taken(text, starts)], [np.repeat(counts[a:b], np.diff(starts, append=len(text)))])
                    held[0].append(codes)
                    held[1].append(times)
                    if sum(map(len, held[0])) > 2 * GATHER:
                        held = tuple([x] for x in merge(*held))
                        if len(held[0][0]) > GATHER:
                            yield from sent()
                            held = ([], [])
        yield from sent()

    return run


PACKED = "kind int, p int, keys binary, counts binary"


def _packed(kind: int, p: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([kind], pa.int32()), pa.array([p], pa.int32()), pa.array([keys.astype(np.uint64).tobytes()], pa.binary()), pa.array([counts.astype(np.int64).tobytes()], pa.binary())],
        names=["kind", "p", "keys", "counts"],
    )


def _arrays(table) -> tuple[list[np.ndarray], list[np.ndarray]]:
    unpack = lambda c, t: [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
    return unpack("keys", np.uint64), unpack("counts", np.int64)


def _sum(table: pa.Table) -> pa.Table:
    keys, counts = merge(*_arrays(table))
    return pa.Table.from_batches([_packed(table["kind"][0].as_py(), table["p"][0].as_py(), keys, counts)])


def _level(counts: np.ndarray) -> np.ndarray:
    return np.floor(STEPS * np.log2(np.maximum(counts, 1))).astype(np.int64)


def _levels(batches):
    """How many words, or contexts of two bytes or more, have which frequency."""
    for batch in batches:
        arcs = "kind" in batch.schema.names
        for keys, counts in zip(*_arrays(batch)):
            found = [context_totals(*shorter(keys, counts, n))[1] for n in range(2, ORDER)] if arcs else [counts]
            for c in found:
                level, first = np.unique(_level(c), return_inverse=True)
                n, total = np.bincount(first), np.bincount(first, weights=c).astype(np.int64) if len(c) else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(level), pa.array(n), pa.array(total)], names=["level", "n", "total"])


def _told_levels(table: DataFrame) -> list[tuple[int, int, int]]:
    told = table.mapInArrow(_levels, "level long, n long, total long").groupBy("level").agg(F.sum("n"), F.sum("total"))
    return [tuple(r) for r in told.collect()]


def _least(levels: list, most: int) -> int:
    """The lowest level such that at most `most` entries stand at it or above."""
    total, least = 0, 10**6
    for level, n in sorted(levels, reverse=True):
        total += n
        if total > most:
            break
        least = level
    return least


def _frequent(level: int):
    """The arcs of the contexts kept."""

    def run(batches):
        for batch in batches:
            for keys, counts in zip(*_arrays(batch)):
                for n in range(ORDER):
                    codes, times = shorter(keys, counts, n)
                    if n >= 2:
                        names, total = context_totals(codes, times)
                        ok = _level(total[np.searchsorted(names, codes >> np.uint64(8))]) >= level
                        codes, times = codes[ok], times[ok]
                    yield _packed(n, 0, codes, times)

    return run


class Spelling:
    """The arcs of the contexts kept, by the context's length, laid out once per worker."""

    def __init__(self, arcs: dict[int, tuple[np.ndarray, np.ndarray]]):
        self.arcs = arcs

    def automaton(self) -> Automaton:
        if "built" not in self.__dict__:
            self.built = Automaton(self.arcs)
        return self.built

    def __getstate__(self):
        return {"arcs": self.arcs}

    def read(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log10 probabilities of a stream's bytes, the places of those whose whole
        context has no state here, and the arcs that these take."""
        logp, depth = self.automaton().walk(text)
        away = np.flatnonzero(depth < np.minimum(since_start(text, starts) + 1, ORDER - 1))
        return logp.astype(np.float64), away, arcs_taken(text, starts)[away]


def _asking_arcs(shared, parts: int):
    """The arcs that the words of each part ask for, by the part that has them."""

    def run(batches):
        def sent(back, held):
            codes = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
            order, limits = _deal(_gram_key(codes), parts)
            for p in np.flatnonzero(np.diff(limits)).tolist():
                own = np.sort(codes[order[limits[p] : limits[p + 1]]])
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([back], pa.int32()), pa.array([own.tobytes()], pa.binary())], names=["p", "back", "codes"])

        for batch in batches:
            for back, (keys, _, texts) in zip(batch.column("p").to_pylist(), _words_of(batch)):
                held = []
                for _, _, text, starts in _spans_of(texts.take(pa.array(np.flatnonzero(keys != END)))):
                    held.append(np.unique(shared.value.read(text, starts)[2]))
                    if sum(map(len, held)) > GATHER:
                        yield from sent(back, held)
                        held = []
                yield from sent(back, held)

    return run


def _resolving(shared):
    """log10 probabilities of the arcs that are asked for, from all arcs of their part."""

    def run(asked: pa.Table, arcs: pa.Table) -> pa.Table:
        logs = []
        if asked.num_rows:
            codes, counts = merge(*_arrays(arcs))
            logp = resolved(codes, counts, shared.value.arcs)
            logs = [logp[np.searchsorted(codes, np.frombuffer(x, np.uint64))].tobytes() for x in asked["codes"].to_pylist()]
        return pa.table([asked["back"].cast(pa.int32()), asked["codes"].cast(pa.binary()), pa.array(logs, pa.binary())], names=["p", "codes", "logs"])

    return run


SPELT = "p int, keys binary, counts binary, spelled binary"


def _spelt(p: int, keys: np.ndarray, counts: np.ndarray, spelled: np.ndarray) -> pa.RecordBatch:
    columns = keys.astype(np.uint64), counts.astype(np.int64), spelled.astype(np.float64)
    return pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), *[pa.array([x.tobytes()], pa.binary()) for x in columns]], names=["p", "keys", "counts", "spelled"])


def _spelt_arrays(table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, ascending, counts and spellings of all rows; no word stands in two of them."""
    found = [[np.frombuffer(x, t) for x in table.column(c).to_pylist()] for c, t in (("keys", np.uint64), ("counts", np.int64), ("spelled", np.float64))]
    keys, counts, spelled = (np.concatenate([np.zeros(0, t), *x]) for x, t in zip(found, (np.uint64, np.int64, np.float64)))
    order = np.argsort(keys, kind="stable")
    return keys[order], counts[order], spelled[order]


def _spell(shared):
    """log10 probabilities of the spellings of a part's words; the end has none."""

    def run(own: pa.Table, told: pa.Table) -> pa.Table:
        codes = np.concatenate([np.zeros(0, np.uint64), *[np.frombuffer(x, np.uint64) for x in told["codes"].to_pylist()]])
        logs = np.concatenate([np.zeros(0), *[np.frombuffer(x, np.float64) for x in told["logs"].to_pylist()]])
        order = np.argsort(codes, kind="stable")
        codes, logs, out = codes[order], logs[order], []
        for p, (keys, counts, texts) in zip(own["p"].to_pylist(), _words_of(own)):
            spelled = np.full(len(keys), -np.inf)
            of = np.flatnonzero(keys != END)
            for a, b, text, starts in _spans_of(texts.take(pa.array(of))):
                logp, away, arcs = shared.value.read(text, starts)
                logp[away] = logs[np.searchsorted(codes, arcs)]
                spelled[of[a:b]] = np.add.reduceat(logp, starts)
            out.append(_spelt(p, keys, counts, spelled))
        return pa.Table.from_batches(out)

    return run


def _hot(level: int):
    def run(batches):
        for batch in batches:
            keys, counts, spelled = _spelt_arrays(batch)
            ok = _level(counts) >= level
            yield _spelt(0, keys[ok], counts[ok], spelled[ok])

    return run


class Model:
    """What every task gets: totals, frequent words with the log10 probabilities of
    their spellings, arcs. Tables are laid out once per worker."""

    def __init__(self, tokens: int, distinct: int, once: int, hot: tuple, spelled: np.ndarray, spelling: Spelling):
        self.tokens, self.distinct, self.once = tokens, distinct, once
        self.hot, self.spelled, self.spelling = hot, spelled, spelling
        most = np.argsort(-hot[1], kind="stable")[:CONTEXTS]
        self.contexts = np.sort(most)  # places in hot
        self.pairs = (np.zeros(0, np.int64), np.zeros(0, np.int64))

    @property
    def log_total(self) -> float:
        return float(np.log10(self.tokens + 0.5 * (self.distinct + 1)))

    def automaton(self) -> Automaton:
        return self.spelling.automaton()

    def arcs(self) -> np.ndarray:
        """Counts of the pairs of context words, flat."""
        if "laid" not in self.__dict__:
            n = len(self.contexts)
            self.laid = np.zeros(n * n, np.int64 if self.tokens >> 31 else np.int32)
            at, times = self.pairs
            self.laid[at] = times
        return self.laid

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("spelling", "laid")}

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Counts of frequent words (0 for others), their numbers as contexts (-1) and
        their spellings (NaN)."""
        names, counts = self.hot
        if not len(names):
            return np.zeros(len(keys), np.int64), np.full(len(keys), -1), np.full(len(keys), np.nan)
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        same = names[at] == keys
        place = np.minimum(np.searchsorted(self.contexts, at), len(self.contexts) - 1)
        return np.where(same, counts[at], 0), np.where(same & (self.contexts[place] == at), place, -1), np.where(same, self.spelled[at], np.nan)

    def total(self) -> tuple[int, int]:
        return self.tokens, self.once

    def log_word(self, counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        return log_word(self.total(), counts, spelled)


def log_word(total: tuple[int, int], counts: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    """log10 probability of words in the empty context, by their counts; total: all tokens
    and the words seen once."""
    tokens, once = total
    share = np.where(counts > 0, counts, once + 1) / (tokens + once + 1)
    return np.log10(SHARES * share + np.where(counts > 0, (1 - SHARES) * 10.0**spelled, 0))


def log_fail(counts: np.ndarray) -> np.ndarray:
    """log10 weight of the failure arcs of words with these counts."""
    return np.log10(PRIOR / (counts + PRIOR))


def log_arc(pairs: np.ndarray, log_word: np.ndarray) -> np.ndarray:
    """What an arc adds to the path through the failure arc, log10."""
    return np.log10(1 + pairs / (PRIOR * 10.0**log_word))


def pair_keys(before: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return mix64(before * np.uint64(0x9E3779B97F4A7C15) + keys)


def tokens_of(piece: np.ndarray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and rows of the tokens, in order."""
    begin, end, row = words(piece, where)
    n = len(where) - 1
    order = np.argsort(np.concatenate([row, np.arange(n)]), kind="stable")  # a row's end is last
    keys = np.concatenate([word_hashes(piece, begin, end, lower=True), np.repeat(END, n)])[order]
    return keys, np.concatenate([row, np.arange(n)])[order]


def before(values: np.ndarray, row: np.ndarray, start) -> np.ndarray:
    """Of each token the value of the one before, start at a row's first."""
    out = np.empty_like(values)
    if len(values):
        out[0] = start
        out[1:] = np.where(row[1:] != row[:-1], start, values[:-1])
    return out


def _pairing(shared, parts: int):
    """Counts of pairs of context words, over one partition."""

    def run(batches):
        model, held = shared.value, ([], [])
        n = len(model.contexts)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for a, b in spans(np.diff(offsets)):
                keys, row = tokens_of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                _, place, _ = model.places(keys)
                last = before(place, row, model.places(END)[1][0])
                ok = (last >= 0) & (place >= 0)
                pair, times = np.unique(last[ok] * n + place[ok], return_counts=True)
                held[0].append(pair.astype(np.uint64))
                held[1].append(times.astype(np.int64))
                if sum(map(len, held[0])) > GATHER:
                    held = tuple([x] for x in merge(*held))
        keys, counts = merge(*held)
        order, limits = _deal(keys, parts)
        for p in np.flatnonzero(np.diff(limits)).tolist():
            of = order[limits[p] : limits[p + 1]]
            yield _packed(GRAMS, p, keys[of], counts[of])

    return run


def train(texts: DataFrame) -> tuple[Model, DataFrame]:
    """texts: one column of training texts. Returns the model and the counts and spellings
    of all words, packed by part (a written table of rows SPELT)."""
    spark = texts.sparkSession
    parts = part_count(spark)
    told = stored(texts.mapInArrow(_counting(parts), WORD_ROW), "counted")
    summed = stored(told.groupBy("p").applyInArrow(_sum_words, WORD_ROW), "summed")
    discard(told)
    arcs = stored(summed.mapInArrow(_spelling(parts), PACKED).groupBy("kind", "p").applyInArrow(_sum, PACKED), "arcs")
    mine, contexts = _told_levels(summed), _told_levels(arcs)
    tokens = sum(total for _, _, total in mine)
    mine = [(level, n) for level, n, _ in mine]
    found = {n: ([], []) for n in range(ORDER)}
    for r in arcs.mapInArrow(_frequent(_least([(level, n) for level, n, _ in contexts], STATES)), PACKED).toLocalIterator():
        found[r.kind][0].append(np.frombuffer(r.keys, np.uint64))
        found[r.kind][1].append(np.frombuffer(r.counts, np.int64))
    spelling = Spelling({n: merge(*x) for n, x in found.items()})
    kept = spark.sparkContext.broadcast(spelling)  # arcs of STATES states at most
    asked = summed.mapInArrow(_asking_arcs(kept, parts), "p int, back int, codes binary")
    told = asked.groupBy("p").cogroup(arcs.select("p", "keys", "counts").groupBy("p")).applyInArrow(_resolving(kept), "p int, codes binary, logs binary")
    spelt = stored(summed.groupBy("p").cogroup(told.groupBy("p")).applyInArrow(_spell(kept), SPELT), "spelt")
    discard(summed)
    discard(arcs)
    hot = [(r.keys, r.counts, r.spelled) for r in spelt.mapInArrow(_hot(_least(mine, HOT)), SPELT).toLocalIterator()]
    names, counts, spelled = _spelt_arrays(pa.table(list(map(list, zip(*hot))) or [[], [], []], names=["keys", "counts", "spelled"]))
    model = Model(int(tokens), sum(n for _, n in mine), dict(mine).get(0, 0), (names, counts), spelled, spelling)
    shared = spark.sparkContext.broadcast(model)
    few = max(1, min(parts, 64))  # CONTEXTS ** 2 sums at most
    pairs = texts.mapInArrow(_pairing(shared, few), PACKED).groupBy("kind", "p").applyInArrow(_sum, PACKED)
    got = [(np.frombuffer(r.keys, np.uint64), np.frombuffer(r.counts, np.int64)) for r in pairs.toLocalIterator()]
    at, times = merge([x for x, _ in got], [x for _, x in got])
    model.pairs = at.astype(np.int64), times
    return model, spelt


def part_count(spark) -> int:
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def _dealt(parts: int):
    """Words with counts and spellings, dealt to this many parts."""

    def run(batches):
        for batch in batches:
            keys, counts, spelled = _spelt_arrays(batch)
            order, limits = _deal(keys, parts)
            for p in np.flatnonzero(np.diff(limits)).tolist():
                of = order[limits[p] : limits[p + 1]]
                yield _spelt(p, keys[of], counts[of], spelled[of])

    return run


ROW = "kind int, p int, part int, i long, n_tokens long, n_known long, base double, score double, at binary, keys binary, times binary, pair_at binary, pair_keys binary, pair_times binary, pair_log binary, pair_word binary"


class Asked:
    """What a task's documents ask of the parts, gathered and sent in packed arrays.

    Words: document, key, times there. Pairs: document, key, times there
    (negative outside training), log10 P0 of the second word, NaN where its count isn't
    known here, and then the number of that word among the words sent."""

    WORDS, PAIRS = (np.uint32, np.uint64, np.uint32), (np.uint32, np.uint64, np.int32, np.float32, np.uint32)

    def __init__(self, parts: int):
        self.parts, self.words, self.pairs, self.by, self.n = parts, [], [], [], 0

    def add(self, words: tuple, pairs: tuple, by: np.ndarray) -> None:
        """by: the keys that the pairs are dealt by."""
        pairs[4][:] += self.n
        self.n += len(words[0])
        self.words.append(words)
        self.pairs.append(pairs)
        self.by.append(by)

    def __len__(self) -> int:
        return self.n + sum(map(len, self.by))

    def sent(self):
        """Part and columns, a row for each part that is asked."""
        words, pairs = [np.concatenate(x) for x in zip(*self.words)], [np.concatenate(x) for x in zip(*self.pairs)]
        order, limits = _deal(words[1], self.parts)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        pair_order, pair_limits = _deal(np.concatenate(self.by), self.parts)
        for p in np.flatnonzero(np.diff(limits) + np.diff(pair_limits)).tolist():
            of, at = order[limits[p] : limits[p + 1]], pair_order[pair_limits[p] : pair_limits[p + 1]]
            own = [x[of] for x in words]
            two = [x[at] for x in pairs]
            two[4] = np.where(np.isnan(two[3]), number[np.minimum(two[4], max(len(number) - 1, 0))] - limits[p], 0) if len(number) else two[4]
            own[0], two[0] = steps(own[0]), steps(two[0])
            packed = [*map(planes, own, self.WORDS), *map(planes, two, self.PAIRS, (8, PAIR_BYTES, 8, 8, 8))]
            yield p, [pa.array([x], pa.binary()) for x in packed]


def steps(at: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, which compress better."""
    return np.diff(at, prepend=0)


def planes(x: np.ndarray, kind, width: int = 8) -> bytes:
    """The first bytes of all numbers, then the second ones, width of them at most: those
    of small numbers compress."""
    x = np.ascontiguousarray(x, kind)
    return x.view(np.uint8).reshape(len(x), x.itemsize)[:, :width].T.tobytes()


def unplaned(x: bytes, kind, width: int = 8) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = np.frombuffer(x, np.uint8).reshape(min(width, size), -1)
    out = np.zeros((raw.shape[1], size), np.uint8)
    out[:, : len(raw)] = raw.T
    return out.view(kind).reshape(-1)


#: Bytes of a pair's hash that are sent, beside the part.
PAIR_BYTES = 6


def _reading(keep: list[str], shared, parts: int):
    """For each document a row with what the model tells alone; for each part rows
    with the words and pairs whose counts are asked for there."""
    most = GATHER // 8

    def run(batches):
        from pyspark import TaskContext

        model = shared.value
        part, done = TaskContext.get().partitionId(), 0
        arcs, contexts = model.arcs(), len(model.contexts)
        start = int(model.places(END)[1][0])
        asked = Asked(parts)
        types = None

        def send():
            nonlocal asked
            none = [pa.nulls(1, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            for p, packed in asked.sent() if asked.words else ():
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in types], pa.array([1], pa.int32()), pa.array([p], pa.int32()), pa.array([part], pa.int32()), *none, *packed], names=NAMES(keep))
            asked = Asked(parts)

        for batch in batches:
            types = [c.type for c in batch.columns[:-2]]
            trained = np.asarray(batch.column(batch.num_columns - 2).to_pylist(), bool)
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            for a, b in spans(np.diff(offsets)):
                piece, where = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                n = b - a
                keys, row = tokens_of(piece, where)
                names, of = np.unique(keys, return_inverse=True)
                count, place, spelled = (x[of] for x in model.places(names))
                own = count > 0
                # the arc of the empty context, and the failure arc of the state that the word leads to
                word = np.where(own, model.log_word(np.maximum(count, 1), spelled), np.nan)
                logp = np.where(own, word + log_fail(count), 0.0)
                # arcs of states: of context words here, of others from what is asked
                last = before(place, row, start)
                here = (last >= 0) & (place >= 0)
                arc = np.flatnonzero(here)
                logp[arc] += log_arc(arcs[last[arc] * contexts + place[arc]], word[arc])
                tell = lambda w: np.bincount(row, weights=w, minlength=n)
                base = np.where(own, np.log10(count + 0.5), 0.0)
                sizes = np.bincount(row, minlength=n)
                wide = np.int64(max(len(names), 1))
                rare = np.flatnonzero(~own)
                entries, times = np.unique(row[rare] * wide + of[rare], return_counts=True)
                name = entries % wide
                away = np.flatnonzero(~here)
                # the end that a row starts after is its last token
                ended = np.append(np.flatnonzero(np.diff(row)), len(row) - 1)
                previous = before(of, row, of[ended[0]])
                two, at, twice = np.unique((row[away] * wide + previous[away]) * wide + of[away], return_index=True, return_counts=True)
                at = away[at]
                ask = np.searchsorted(entries, row[at] * wide + of[at])
                pair = pair_keys(names[previous[at]], names[of[at]])
                asked.add(
                    (done + entries // wide, names[name], times),
                    (done + row[at], pair, np.where(trained[a:b][row[at]], twice, -twice), word[at], ask),
                    np.where(own[at], pair, names[of[at]]),
                )
                empty = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        *[c.slice(a, n) for c in batch.columns[:-2]],
                        pa.array(np.zeros(n, np.int32)), pa.array(((part + done + np.arange(n)) % parts).astype(np.int32)), pa.array(np.full(n, part, np.int32)),
                        pa.array(done + np.arange(n)), pa.array(sizes), pa.array(tell(own).astype(np.int64)),
                        pa.array(tell(base) - sizes * model.log_total), pa.array(tell(logp)), *[empty] * 8,
                    ],
                    names=NAMES(keep),
                )
                done += n
                if len(asked) > most:
                    yield from send()
        yield from send()

    return run


def NAMES(keep: list[str]) -> list[str]:
    return [*keep, *[x.split()[0] for x in ROW.split(", ")]]


ANSWER = "part int, i long, n_tokens long, n_known long, base double, score double, at binary, counts binary, times binary, logs binary, pair_at binary, pair_logs binary"
ANSWERS = (np.uint32, np.uint64, np.uint32, np.float32, np.uint32, np.float32)


def looked_up(names: np.ndarray, counts: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Counts, or other values, of keys, 0 for those not among names."""
    if not len(names):
        return np.zeros(len(keys), counts.dtype)
    i = np.minimum(np.searchsorted(names, keys), len(names) - 1)
    return np.where(names[i] == keys, counts[i], 0)


def _answer(keep: list[str], total: tuple[int, int]):
    """Looks up the counts and spellings of a part's words, and its pairs, for all documents that ask;
    rows of documents pass through."""
    own = [*keep, "part", "i", "n_tokens", "n_known", "base", "score"]

    def run(rows: pa.Table, counted: pa.Table) -> pa.Table:
        asked = rows.filter(pc.equal(rows["kind"], 1))
        names, counts, spellings = _spelt_arrays(counted)
        columns = {c: asked.column(c).to_pylist() for c in NAMES([])[8:]}
        unpack = lambda c, t, width=8: [unplaned(x, t, width) for x in columns.pop(c)]
        pairs, twice = unpack("pair_keys", np.uint64, PAIR_BYTES), unpack("pair_times", np.int32)
        arcs = merge([k[t > 0] for k, t in zip(pairs, twice)], [t[t > 0].astype(np.int64) for t in twice])
        out = [[] for _ in ANSWERS]
        words = zip(*(unpack(c, t) for c, t in zip(("at", "keys", "times"), Asked.WORDS)))
        more = zip(unpack("pair_at", np.uint32), pairs, twice, unpack("pair_log", np.float32), unpack("pair_word", np.uint32))
        for (at, keys, times), (pair_at, pair, twice, log, word) in zip(words, more):
            count = looked_up(names, counts, keys)
            logp = log_word(total, count, looked_up(names, spellings, keys))
            n = looked_up(*arcs, pair)
            some = np.flatnonzero(n)  # the others take the failure arc
            log, unknown = log[some].astype(np.float64), np.isnan(log[some])
            log[unknown] = logp[word[some[unknown]]]
            document, added = np.cumsum(pair_at, dtype=np.int64)[some], np.abs(twice[some]) * log_arc(n[some], log)
            first = np.flatnonzero(np.diff(document, prepend=-1))
            added = np.add.reduceat(added, first) if len(first) else added
            for x, told, t in zip(out, (at, count, times, logp, steps(document[first]), added), ANSWERS):
                x.append(planes(told, t))
        passed, packed = rows.filter(pc.equal(rows["kind"], 0)).select(own), ANSWER_NAMES[6:]
        answers = asked.select(own)
        for name, x in zip(packed, out):
            passed = passed.append_column(name, pa.nulls(passed.num_rows, pa.binary()))
            answers = answers.append_column(name, pa.array(x, pa.binary()))
        return pa.concat_tables([passed, answers])

    return run


ANSWER_NAMES = [x.split()[0] for x in ANSWER.split(", ")]


def _finish(keep: list[str]):
    def run(table: pa.Table) -> pa.Table:
        rows, answers = (table.filter(f(table["i"])) for f in (pc.is_valid, pc.is_null))
        i = rows["i"].to_numpy()
        n = int(i.max()) + 1 if len(i) else 0
        base, known, logp = np.zeros(n), np.zeros(n), np.zeros(n)
        for packed in zip(*(answers.column(c).to_pylist() for c in ANSWER_NAMES[6:])):
            at, count, times, log, pair_at, added = map(unplaned, packed, ANSWERS)
            at, of = np.unique(np.cumsum(at, dtype=np.int64), return_inverse=True)
            add = lambda x: np.bincount(of, weights=times * x, minlength=len(at))  # noqa: B023, E731
            base[at] += add(np.log10(count + 0.5))
            known[at] += add(count > 0)
            logp[at] += add(log + log_fail(count))
            logp[np.cumsum(pair_at, dtype=np.int64)] += added
        known = known.astype(np.int64)
        told = [pa.array(rows[c].to_numpy() + x[i]) for c, x in (("n_known", known), ("base", base), ("score", logp))]
        return pa.table([*[rows[c] for c in keep], rows["n_tokens"], *told], names=[*keep, "n_tokens", "n_known", "base_score", "score"])

    return run


def score(docs: DataFrame, is_training, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """Kept columns, n_tokens, n_known, train_tokens, base_score and score.

    is_training: a condition on docs' columns, given as a Column. Answers find their
    documents by partition and place there, so docs must be a table as read or stored,
    whose partitions a repeated task reads in the same order."""
    taken = {*NAMES([]), *ANSWER_NAMES, "n_tokens", "n_known", "train_tokens", "base_score", "score", "read_trained", "read_text"}
    keep = [c for c in (["doc_id"] if keep is None else keep) if c not in taken]
    spark = docs.sparkSession
    model, counts = train(docs.filter(is_training).select(F.col(f"`{text_col}`").alias("text")))
    shared = spark.sparkContext.broadcast(model)  # HOT words and the arcs between CONTEXTS at most
    parts = part_count(spark)
    finer = min(model.tokens // ASKED, PARTS) // parts
    if finer > 1:
        parts *= finer
        counts = counts.mapInArrow(_dealt(parts), SPELT)
    trained = F.coalesce(is_training, F.lit(False)).alias("read_trained")
    rows = docs.select(*[f"`{c}`" for c in keep], trained, F.col(f"`{text_col}`").alias("read_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-2])
    read = rows.mapInArrow(_reading(keep, shared, parts), f"{kept}, {ROW}")
    answered = read.groupBy("p").cogroup(counts.groupBy("p")).applyInArrow(_answer(keep, model.total()), f"{kept}, {ANSWER}")
    out = answered.groupBy("part").applyInArrow(_finish(keep), f"{kept}, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = score(docs, crc_rest(F.col("doc_id"), 5) != 1)
    return out.select("doc_id", (crc_rest(F.col("doc_id"), 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
