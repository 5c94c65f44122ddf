"""Quality classifier: naive Bayes support vectors.

Features are indicators of byte n-grams (n = 1, 2, 3; trigrams hashed) and of
n-grams of repetition from word to word, over the whole text. Each is scaled by the log-count ratio of the two classes, rows are
brought to unit length, and a linear model with hinge loss is fitted by dual
coordinate descent, then drawn towards its mean weight. Margins become
probabilities through a logistic curve fitted on rows kept back from the fit.

Learning uses at most SAMPLE labelled documents; scoring is one map over all
documents with a weight table of fixed size.

Defined results: null and empty texts have no features and get the score of the
bias alone; with one class only, or no labels, every score is the share of
label 1 (0.5 without labels); repeated rows are scored each; an empty table
gives an empty table; a kept column named score is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_rest, spans, utf8, word_hashes, words
from .labelled import sample

TRI_BITS = 17
#: First of 16 features of repetition: 8 patterns of three steps from word to word,
#: each the same word again or not; and 8 classes of the share of such steps.
AGAIN = 256 + 65536 + (1 << TRI_BITS)
DIM = AGAIN + 16
#: Most labelled documents that the fit uses.
SAMPLE = 6000
THRESHOLD = 0.3
SEGMENT = 1 << 20


def features(data: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Numbers of the n-grams that a text holds; seen: all False, and so left."""
    for at in range(0, max(len(data), 1), SEGMENT):
        piece = data[at : at + SEGMENT + 2].astype(np.int32)
        seen[piece] = True
        if len(piece) > 1:
            two = (piece[:-1] << 8) | piece[1:]
            seen[two + 256] = True
            if len(piece) > 2:
                three = ((two[:-1] << 8) | piece[2:]) * np.int32(-1640531527)
                seen[((three >> (31 - TRI_BITS)) & ((1 << TRI_BITS) - 1)) + (256 + 65536)] = True
    begin, end, _ = words(data, np.array([0, len(data)]))
    if len(begin) > 1:
        h = word_hashes(data, begin, end)
        same = (h[1:] == h[:-1]).astype(np.int64)
        seen[AGAIN + 4 * same[:-2] + 2 * same[1:-1] + same[2:]] = True
        share = float(same.mean())
        seen[AGAIN + 8 + (1 + min(6, int(8 * share)) if share else 0)] = True
    found = np.flatnonzero(seen)
    seen[found] = False
    return found


class Model:
    """weights: hinge weight times ratio; squares: ratio squared, for row lengths."""

    def __init__(self, weights, squares, bias, slope, shift):
        self.weights, self.squares = weights, squares
        self.bias, self.slope, self.shift = bias, slope, shift

    def score(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.empty(len(rows))
        for i, f in enumerate(rows):
            out[i] = self.weights[f].sum(dtype=np.float64) / max(np.sqrt(self.squares[f].sum(dtype=np.float64)), 1e-9)
        z = np.clip(self.slope * (out + self.bias) + self.shift, -30, 30)
        return 1 / (1 + np.exp(-z))


def descend(rows, values, y, cost, passes: int, dim: int, seed: int = 3):
    """Dual coordinate descent for hinge loss with an L2 penalty; the last weight
    is the bias. Stops early when no coordinate moves."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(dim), 0.0, np.zeros(len(rows))
    square = np.array([float(v @ v) for v in values]) + 1.0
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            f, v = rows[i], values[i]
            slope = y[i] * (float(w[f] @ v) + bias) - 1
            new = min(max(alpha[i] - slope / square[i], 0.0), cost[i])
            if (step := new - alpha[i]) != 0.0:
                w[f] += (step * y[i]) * v
                bias += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, bias


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (above 0) and shift of a logistic curve through smoothed targets."""
    positive, negative = int(y.sum()), int(len(y) - y.sum())
    target = np.where(y == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    a, b = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum() + 1e-3 * (a - 1), (p - target).sum()])
        s = p * (1 - p) + 1e-9
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum()]])
        step = np.linalg.solve(h + 1e-6 * np.eye(2), g)
        step *= min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))  # short steps: full ones may overshoot
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def fit(rows: list[np.ndarray], y: np.ndarray, passes: int = 12, cost: float = 10.0, blend: float = 0.5) -> Model:
    """rows: n-gram numbers per document; y: labels 0 and 1."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(DIM, np.float32), np.ones(DIM, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    count = np.ones((2, DIM))
    for f, label in zip(rows, y.tolist()):
        count[label, f] += 1
    ratio = np.log(count[1] / count[1].sum()) - np.log(count[0] / count[0].sum())
    values = [(v := ratio[f]) / max(np.sqrt(v @ v), 1e-9) for f in rows]
    sign = np.where(y == 1, 1.0, -1.0)
    weight = len(y) / (2 * np.maximum(np.bincount(y, minlength=2), 1))  # both classes weigh alike
    back = np.arange(len(y)) % 5 == 4
    use = np.flatnonzero(~back)
    w, bias = descend([rows[i] for i in use], [values[i] for i in use], sign[use], cost * weight[y[use]], passes, DIM)
    # towards the mean weight: equal weights on ratios are naive Bayes
    known = (count > 1).any(axis=0)
    mean = np.abs(w[known]).mean()
    w = np.where(known, (1 - blend) * mean + blend * w, 0.0)
    scale = 1.0 / max(np.abs([float(w[rows[i]] @ values[i]) for i in use]).max(), 1e-9)
    w, bias = w * scale, bias * scale * blend
    held = np.flatnonzero(back)
    margin = np.array([float(w[rows[i]] @ values[i]) + bias for i in held])
    both = len(set(y[held].tolist())) > 1
    slope, shift = logistic(margin * 10, y[held]) if both else (1.0, 0.0)
    return Model((w * ratio).astype(np.float32), (ratio * ratio).astype(np.float32), float(bias), slope * 10, shift)


def _extract(batches):
    seen = np.zeros(DIM, bool)
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        out = [features(data[i:j], seen).astype("<i4").tobytes() for i, j in zip(offsets.tolist(), offsets[1:].tolist())]
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out, pa.binary())], names=["label", "features"])


def train(docs: DataFrame, labels: DataFrame, keep_id, label_col: str = "quality", limit: int = SAMPLE) -> Model:
    """Fits on the driver, which gets the n-gram numbers of limit documents at most."""
    rows = sample(docs, labels, label_col, keep_id, limit)
    table = rows.select("text", "label", F.xxhash64("text").alias("h")).orderBy("h").select("text", "label").mapInArrow(_extract, "label int, features binary").toArrow()
    found = [np.frombuffer(x, "<i4") for x in table["features"].to_pylist()]
    return fit(found, np.array(table["label"].to_pylist(), np.int64).clip(0, 1))


def scored(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """Kept columns and score, one row per row of docs."""
    keep = [c for c in keep if c != "score"]
    rows = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text_col}`").alias("scored_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: two tables of DIM floats

    def run(batches):
        seen, model = np.zeros(DIM, bool), shared.value
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            out = np.empty(batch.num_rows)
            for a, b in spans(np.diff(offsets)):
                out[a:b] = model.score([features(data[i:j], seen) for i, j in zip(offsets[a:b].tolist(), offsets[a + 1 : b + 1].tolist())])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*keep, "score"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels, lambda c: crc_rest(c, 5) != 0)
    out = scored(docs, model, ["doc_id"])
    return out.select("doc_id", (crc_rest(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
