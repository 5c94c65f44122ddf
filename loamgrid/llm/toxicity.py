"""Toxicity by a weighted finite-state pattern grammar.

A cascade of transducers reads a text. The first rewrites words and marks to symbols,
with a weight for an insult. The negation transducer rewrites insults and threat verbs
within the scope of a negation (the next SCOPE words; marks don't count), the one of
reported speech those in a report: from a word of saying to the end of its clause, and
on over colons to the end of a quotation that it opens. Two transducers read what is
left and put out matches, with the weights held on the way: an insult that meets a
target in its clause before or after it (aimed), or none (plain), a negated and a
reported one; and a will, a threat verb and a target (threat, or negated or reported
likewise). A clause may match several times. The cascade is composed once into one
table of arcs with their outputs. A document's score is a logistic function of the
weights of its matches by kind, so a word counts only through its clause.

The insult lexicon is learned from labelled rows: words and word stems that occur
in toxic rows and in no or hardly any clean ones, chosen greedily until the toxic
rows are explained, and words that stand in toxic rows only, so often that by chance
hardly one word would; each needs SUPPORT rows or more, so SAMPLE bounds the lexicon.
The logistic weights are fitted to the same rows, from a prior under which negation
and report take most of an insult's weight away.

Defined results: null and empty texts match nothing and get the score of no
match; without labels the seed lexicon and the prior weights hold; repeated rows
are scored each; an empty table gives an empty table; a kept column named score is
left out; a text is held whole while it is read.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest, spans, utf8
from .labelled import sample

THRESHOLD = 0.3
#: Most labelled documents that learning uses.
SAMPLE = 16000
#: A unit is a whole word or a stem of so many letters.
STEMS = (4, 5, 6)
#: Toxic documents that a unit must explain beyond those explained so far, and its
#: least share of toxic ones among all documents with it.
SUPPORT, PURITY = 4, 0.9
CHANCE = 0.05
#: Words after a negation that it negates.
SCOPE = 3

#: Symbols of a text, MARK for a quotation mark, END for the end of a clause, BREAK for a
#: line's; then those that negation and report put in place of insults and threat verbs.
OTHER, INSULT, THREAT, WILL, TARGET, NEGATION, REPORT, MARK, END, BREAK, NO_INSULT, NO_THREAT, SAID_INSULT, SAID_THREAT = range(14)
SYMBOLS = BREAK + 1

# Seed words of the grammar.
SEED_INSULTS = ("idiot", "idiots", "moron", "morons", "scum", "imbecile", "cretin", "bastard", "dumbass", "asshole")
THREATS = ("kill", "hurt", "beat", "crush", "destroy", "shoot", "stab", "strangle", "murder", "töten", "umbringen", "matar", "tuer")
WILLS = ("will", "shall", "gonna", "werde", "werden", "voy", "vamos", "vais", "allons")
TARGETS = (
    "you", "your", "yours", "yourself", "youre", "he", "she", "they", "them", "him", "her", "du", "dich", "dir", "dein", "deine", "ihr", "euch",
    "tu", "toi", "vous", "ton", "votre", "tú", "ti", "usted", "ustedes", "eres", "vosotros",
)
NEGATIONS = ("not", "never", "no", "nobody", "isnt", "arent", "wasnt", "dont", "nicht", "kein", "keine", "nie", "niemals", "pas", "jamais", "aucun", "nunca", "ningún", "tampoco")
REPORTS = ("said", "says", "called", "quoted", "wrote", "claimed", "reported", "sagte", "schrieb", "nannte", "meinte", "dit", "écrit", "déclaré", "appelé", "dijo", "llamó", "escribió")

TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n\"“”„«»]")
WORDS = re.compile(r"[^\W\d_]+")

KINDS = ("aimed", "plain", "negated", "reported", "threat")
AIMED, PLAIN, NEGATED, REPORTED, THREATENED = range(5)
#: An output that keeps a word's weight until a release.
HOLD = -1
#: Prior means of the logistic weights: bias, then one per kind.
PRIOR = np.array([-4.0, 3.0, 2.5, 0.3, 0.3, 6.0])
PRIOR_PRECISION = np.array([0.05, 0.3, 0.3, 0.3, 0.3, 0.3])


class Transducer:
    """arcs: (state, symbol) -> (state, output); where a symbol has no arc the state
    and, from a rewriting transducer, the symbol stay."""

    def __init__(self, arcs: dict):
        self.arcs = arcs

    def step(self, state: int, symbol: int, otherwise) -> tuple:
        return self.arcs.get((state, symbol), (state, otherwise))


WORD_SYMBOLS = (OTHER, INSULT, THREAT, WILL, TARGET, REPORT)
#: States: words left in the scope.
NEGATES = Transducer(
    {(s, x): (s - 1, {INSULT: NO_INSULT, THREAT: NO_THREAT}.get(x, x)) for s in range(1, SCOPE + 1) for x in WORD_SYMBOLS}
    | {(s, NEGATION): (SCOPE, OTHER) for s in range(SCOPE + 1)}
    | {(s, x): (0, x) for s in range(SCOPE + 1) for x in (END, BREAK)}
)
#: 0; 1: in a report; 2: in a quotation that the report opened, which goes on over clauses.
SAYS = Transducer(
    {(s, x): (s, SAID_INSULT if x in (INSULT, NO_INSULT) else SAID_THREAT) for s in (1, 2) for x in (INSULT, NO_INSULT, THREAT, NO_THREAT)}
    | {(0, REPORT): (1, OTHER), (1, MARK): (2, OTHER), (2, MARK): (0, OTHER), (1, END): (0, END), (1, BREAK): (0, BREAK), (2, BREAK): (0, BREAK)}
)
#: 0; 1: a target was read; 2: an insult is held. Outputs: (kind, release).
INSULTS = Transducer(
    {(0, INSULT): (2, (HOLD, False)), (2, INSULT): (2, (HOLD, False)), (1, INSULT): (1, (AIMED, False)), (0, TARGET): (1, None), (2, TARGET): (1, (AIMED, True))}
    | {(s, NO_INSULT): (s, (NEGATED, False)) for s in range(3)}
    | {(s, SAID_INSULT): (s, (REPORTED, False)) for s in range(3)}
    | {(s, x): (0, (PLAIN, True) if s == 2 else None) for s in range(3) for x in (END, BREAK)}
)
#: 0; 1: a will was read; 2, 3, 4: and a threat verb, a negated one, a reported one.
THREATENS = Transducer(
    {(0, WILL): (1, None)}
    | {(s, x): (to, None) for s in range(1, 5) for x, to in ((THREAT, 2), (NO_THREAT, 3), (SAID_THREAT, 4))}
    | {(s, TARGET): (1, (kind, False)) for s, kind in ((2, THREATENED), (3, NEGATED), (4, REPORTED))}
    | {(s, x): (0, None) for s in range(5) for x in (END, BREAK)}
)


def cascade(states: tuple, symbol: int) -> tuple[tuple, tuple]:
    """States of NEGATES, SAYS, INSULTS and THREATENS after a symbol, and the outputs."""
    negates, said, insult, threat = states
    negates, symbol = NEGATES.step(negates, symbol, symbol)
    said, symbol = SAYS.step(said, symbol, symbol)
    insult, a = INSULTS.step(insult, symbol, None)
    threat, b = THREATENS.step(threat, symbol, None)
    return (negates, said, insult, threat), tuple(x for x in (a, b) if x)


def compose() -> tuple[list[list[int]], list[list[tuple]]]:
    """The composition: next state and outputs by state and symbol."""
    number, todo, table, outputs = {(0, 0, 0, 0): 0}, [(0, 0, 0, 0)], [], []
    for states in todo:
        row, out = [], []
        for symbol in range(SYMBOLS):
            after, told = cascade(states, symbol)
            if after not in number:
                number[after] = len(number)
                todo.append(after)
            row.append(number[after])
            out.append(told)
        table.append(row)
        outputs.append(out)
    return table, outputs


NEXT, OUTPUTS = compose()


def read(symbols: list[tuple[int, float]]) -> list[tuple[int, float]]:
    """(kind, weight) of the matches in weighted symbols, a line's end put behind them."""
    out, state, held = [], 0, 0.0
    table, outputs = NEXT, OUTPUTS
    for symbol, weight in [*symbols, (BREAK, 0.0)]:
        if told := outputs[state][symbol]:
            for kind, release in told:
                if kind == HOLD:
                    held += weight
                elif release:
                    out.append((kind, held))
                    held = 0.0
                else:
                    out.append((kind, weight))
        state = table[state][symbol]
    return out


class Grammar:
    """insults: {unit: weight}; a unit that ends in * is a stem."""

    def __init__(self, insults: dict[str, float], weights: np.ndarray):
        self.insults, self.weights = insults, weights
        self.symbols = {w: (s, 0.0) for s, group in ((THREAT, THREATS), (WILL, WILLS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in group}
        self.stems = sorted({len(u) - 1 for u in insults if u.endswith("*")}, reverse=True)
        self.known: dict[str, tuple[int, float]] = {}

    def __getstate__(self):
        return {**self.__dict__, "known": {}}

    def symbol(self, word: str) -> tuple[int, float]:
        """Symbol and weight of a word or punctuation mark."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > 300_000:
                self.known.clear()
            found = self.known[word] = self._symbol(word)
        return found

    def _symbol(self, word: str) -> tuple[int, float]:
        if not (word[0].isalpha()):
            return (BREAK if word == "\n" else END if word in ".!?;" else MARK), 0.0
        weight = self.insults.get(word)
        if weight is None:
            for n in self.stems:
                if len(word) >= n and (weight := self.insults.get(word[:n] + "*")) is not None:
                    break
        if weight is not None:
            return INSULT, weight
        return self.symbols.get(word, (OTHER, 0.0))

    def clauses(self, text: str) -> list[tuple[int, float]]:
        """(kind, weight) of the matches in a lower-case text."""
        return read([self.symbol(word) for word in TOKEN.findall(text)])

    def matches(self, text: str) -> np.ndarray:
        """Per kind, log(1 + sum of the weights of the matches)."""
        out = np.zeros(len(KINDS))
        text = fold(text)
        # only a word of weight or a threat verb can make a clause match
        if any(self.symbol(w)[0] in (INSULT, THREAT) for w in set(WORDS.findall(text))):
            for kind, weight in self.clauses(text):
                out[kind] += max(weight, 1.0)
        return np.log1p(out)

    def score(self, text: str) -> float:
        z = self.weights[0] + float(self.weights[1:] @ self.matches(text))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fold(text: str) -> str:
    """Lower case, composed characters, apostrophes dropped (isn't: isnt)."""
    text = text.lower()
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.replace("'", "").replace("’", "")


def units(text: str) -> set[str]:
    """The words and stems that a text holds."""
    found = set(WORDS.findall(fold(text)))
    return found | {w[:n] + "*" for w in found for n in STEMS if len(w) > n}


def _counts(batches):
    """Documents by class for each unit, over one partition."""
    by = (Counter(), Counter())
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by[1 if label > 0 else 0].update(units(text))
    names = list(by[1])  # units of no toxic row can't enter the lexicon
    for at in range(0, len(names), 50_000):
        part = names[at : at + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([by[1][u] for u in part], pa.int64())], names=["unit", "toxic"])


def _clean_counts(wanted: frozenset):
    def run(batches):
        found = Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if label <= 0:
                    found.update(wanted & units(text))
        names = list(found)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([found[u] for u in names], pa.int64())], names=["unit", "clean"])

    return run


def choose(candidates: dict[str, tuple[int, int]], toxic_rows: list[set[str]], share: float = 0.5, looked_at: int = 1) -> dict[str, float]:
    """Units with weights, chosen greedily: the one that explains most of the toxic
    rows not yet explained, of equals the longest; until none explains SUPPORT. share:
    of toxic rows among all; looked_at: number of units."""
    holders: dict[str, set[int]] = {u: set() for u in candidates}
    for i, row in enumerate(toxic_rows):
        for u in row:
            if u in holders:
                holders[u].add(i)
    left = set(range(len(toxic_rows)))
    out: dict[str, float] = {}

    def value(u):
        gain = len(holders[u] & left)
        return gain - 3 * candidates[u][1], len(u) if gain else 0, u

    order = sorted(holders, key=lambda u: len(holders[u]), reverse=True)
    while left:
        best = None
        for u in order:
            if len(holders[u]) < (best[0] if best else SUPPORT):
                break  # holders bound the gain
            if (now := value(u)) > (best or (SUPPORT - 1, 0, "")):
                best = now
        if best is None or best[0] < SUPPORT:
            break
        unit = best[2]
        toxic, clean = candidates[unit]
        out[unit] = float(np.log((toxic + 0.5) / (clean + 0.5)))
        left -= holders[unit]
        order = [u for u in order if u != unit and len(holders[u] & left) >= SUPPORT]
    # units of rows already explained too, if fewer than CHANCE units would stand in so
    # many toxic rows and no clean one were they dealt at random; the shortest first
    enough = max(SUPPORT, np.log(max(looked_at, 1) / CHANCE) / -np.log(min(max(share, 1e-6), 1 - 1e-6)))
    stems = {u[:-1] for u in out if u.endswith("*")}
    for u in sorted(candidates, key=lambda u: (not u.endswith("*"), len(u), u)):
        toxic, clean = candidates[u]
        if u not in out and clean == 0 and toxic >= enough and not any(u[:n] in stems for n in STEMS) and _spread(holders[u], toxic_rows):
            out[u] = float(np.log((toxic + 0.5) / 0.5))
            if u.endswith("*"):
                stems.add(u[:-1])
    return out


def _spread(rows: set[int], toxic_rows: list[set[str]], limit: float = 0.35) -> bool:
    """Whether the rows with a unit differ else, so that it isn't just a word of
    many near copies: the mean overlap of rows next to each other is low."""
    some = sorted(rows)
    pairs = [(toxic_rows[a], toxic_rows[b]) for a, b in zip(some, some[1:])]
    shared = [len(a & b) / max(1, len(a | b)) for a, b in pairs]
    return bool(shared) and sum(shared) / len(shared) < limit


def weigh(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights, maximum a posteriori (Newton steps); kinds weigh 0 at least."""
    w = PRIOR.copy()
    if len(y):
        full = np.column_stack([np.ones(len(y)), x])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(full @ w, -30, 30)))
            gradient = full.T @ (p - y) + PRIOR_PRECISION * (w - PRIOR)
            hessian = (full * (p * (1 - p))[:, None]).T @ full + np.diag(PRIOR_PRECISION)
            step = np.linalg.solve(hessian, gradient)
            w = w - step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
            if np.abs(step).max() < 1e-6:
                break
        w[1:] = np.maximum(w[1:], 0)
    return w


def train(docs: DataFrame, labels: DataFrame, keep_id, label_col: str = "toxic", limit: int = SAMPLE) -> Grammar:
    """Counts units on the executors; the driver gets the candidate units, the
    toxic rows' candidates and one row of figures per sampled document."""
    from .common import discard, stored

    rows = stored(sample(docs, labels, label_col, keep_id, limit).select("text", "label"), "toxic-sample")
    toxic = rows.mapInArrow(_counts, "unit string, toxic long").groupBy("unit").agg(F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= SUPPORT)
    top = {r.unit: int(r.toxic) for r in toxic.orderBy(F.col("toxic").desc(), "unit").collect()}  # of at most limit documents
    clean = {r.unit: int(r.clean) for r in rows.mapInArrow(_clean_counts(frozenset(top)), "unit string, clean long").groupBy("unit").agg(F.sum("clean").alias("clean")).collect()}
    candidates = {u: (n, clean.get(u, 0)) for u, n in top.items() if n / (n + clean.get(u, 0)) >= PURITY}
    wanted = frozenset(candidates)

    def held(batches):
        for batch in batches:
            out = [sorted(wanted & units(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.string()))], names=["units"])

    toxic_rows = [set(r.units) for r in rows.filter("label > 0").orderBy(F.xxhash64("text")).mapInArrow(held, "units array<string>").collect()] if wanted else []
    share = len(toxic_rows) / max(rows.count(), 1)
    insults = {u: 3.0 for u in SEED_INSULTS if clean.get(u, 0) == 0} | choose(candidates, toxic_rows, share, len(top))
    grammar = Grammar(insults, PRIOR)

    def figures(batches):
        for batch in batches:
            x = np.array([grammar.matches(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays([*[pa.array(x[:, i]) for i in range(len(KINDS))], batch.column(1)], names=[*KINDS, "label"])

    schema = ", ".join(f"{k} double" for k in KINDS) + ", label int"
    told = rows.mapInArrow(figures, schema).groupBy(*[F.round(k, 3).alias(k) for k in KINDS], "label").agg(F.count(F.lit(1)).alias("n")).orderBy(*KINDS, "label").toPandas()
    x = np.repeat(told[list(KINDS)].to_numpy(float), told["n"].to_numpy(int), axis=0)
    y = np.repeat((told["label"].to_numpy(int) > 0).astype(float), told["n"].to_numpy(int))
    discard(rows)
    return Grammar(insults, weigh(x, y))


def scored(docs: DataFrame, grammar: Grammar, keep: list[str], text_col: str = "text") -> DataFrame:
    """Kept columns and score, one row per row of docs."""
    keep = [c for c in keep if c != "score"]
    rows = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text_col}`").alias("scored_text"))
    shared = docs.sparkSession.sparkContext.broadcast(grammar)  # a lexicon learned from SAMPLE documents at most

    def run(batches):
        grammar = shared.value
        for batch in batches:
            text, out = batch.column(batch.num_columns - 1), np.empty(batch.num_rows)
            _, offsets = utf8(text)
            for a, b in spans(np.diff(offsets)):
                out[a:b] = [grammar.score(t or "") for t in text.slice(a, b - a).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*keep, "score"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}score double")


def held_in(id_col):
    """Whether labels of an id may be learned from."""
    return crc_rest(id_col, 4) != 2


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs less those that the grammar rejects; same columns."""
    columns = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(columns))])
    id_, text = f"c{columns.index('doc_id')}", f"c{columns.index('text')}"
    grammar = train(docs.select("doc_id", "text"), labels, held_in)
    out = scored(plain, grammar, plain.columns, text).filter(F.col("score") < THRESHOLD)
    return out.select(*plain.columns).toDF(*columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    grammar = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_in)
    out = scored(docs, grammar, ["doc_id"])
    return out.select("doc_id", (~held_in(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
