"""Media columns: texts stored as lossless WebP images, read back and described.

A text's UTF-8 bytes are padded with spaces to a positive multiple of 192; each
byte is one pixel (its green sample) of an image 192 pixels wide, wider by whole
multiples where it would be too high. Each image is stored by what costs it least, told
by the entropy of its samples: as they are, with lines that recur as back-references;
less a predictor's guess (the pixel before, the one above, or what they suggest); or,
with at most 16 different bytes, as a palette with several pixels to a byte. The reader
reads all of the format, also what the writer doesn't choose.

Defined results: null and empty texts are 192 spaces; equal texts give equal
values; repeated rows give a row each; an empty table gives an empty table; a text that
no single image can hold becomes several, one after another; a kept column named like
a result is left out; a batch's texts are held whole.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import webp
from .common import utf8

UNIT = 192
OPAQUE = np.uint32(0xFF000000)
#: Lines shorter than this are not looked up for copies.
LEAST_COPY = 24


def payload(text: bytes) -> bytes:
    return text + b" " * (-len(text) % UNIT or (UNIT if not text else 0))


def sides(n: int) -> tuple[int, int]:
    """Width and height of the image of n bytes, n a multiple of UNIT; the width
    is the least multiple of UNIT that divides well enough for the height."""
    rows = n // UNIT
    wide = 1
    while rows % wide or rows // wide > webp.MAX_SIDE:
        wide += 1
        if wide * UNIT > webp.MAX_SIDE:
            raise ValueError(f"{n} bytes don't fit one image")
    return UNIT * wide, rows // wide


def repeats(data: bytes) -> list[tuple[int, int, int]]:
    """(position, length, distance) of lines that stood before, joined where they
    follow each other at one distance."""
    if data.count(b"\n") < 2:
        return []
    out: list[list[int]] = []
    seen: dict[bytes, int] = {}
    at = 0
    for line in data.split(b"\n"):
        n = len(line) + 1
        if n > LEAST_COPY and at + n <= len(data):
            before = seen.get(line)
            if before is not None:
                back = at - before
                if out and out[-1][2] == back and out[-1][0] + out[-1][1] == at:
                    out[-1][1] += n
                else:
                    out.append([at, n, back])
            seen[line] = at
        at += n
    pieces = []
    for at, n, back in out:
        for start in range(at, at + n, webp.MAX_COPY):
            pieces.append((start, min(webp.MAX_COPY, at + n - start), back))
    return pieces


#: Predictors that are tried, and the bits that one must save beside its header.
MODES, SAVES = (1, 2, 7, 11), 512
#: The predictor's block, as a power of 2: the largest of the format.
PREDICTED = 9


def _cost(samples: np.ndarray) -> float:
    """Bits of samples by their entropy."""
    counts = np.bincount(samples, minlength=256)
    counts = counts[counts > 0]
    return float((counts * (np.log2(len(samples)) - np.log2(counts))).sum())


def guessed(samples: np.ndarray, width: int) -> int:
    """The predictor that makes samples cheapest, -1 if none does. Told from the first
    and middle rows of a large image: a choice of cost, never of what is stored."""
    rows = samples.reshape(-1, width)
    if len(rows) > 48:
        rows = np.concatenate([rows[:24], rows[len(rows) // 2 :][:24]])
    if len(rows) < 2:
        return -1
    here, left, top, corner = (x.astype(np.int16) for x in (rows[1:, 1:], rows[1:, :-1], rows[:-1, 1:], rows[:-1, :-1]))
    nearer_left = np.abs(top - corner) < np.abs(left - corner)
    guesses = {1: left, 2: top, 7: (left + top) >> 1, 11: np.where(nearer_left, left, top)}
    costs = {m: _cost(((here - guesses[m]) & 255).ravel()) for m in MODES}
    best = min(MODES, key=costs.__getitem__)
    return best if costs[best] + SAVES < _cost(here.ravel() & 255) else -1


def store(data: bytes) -> bytes:
    """The image file of a payload; several files one after another if one can't
    hold it."""
    most = UNIT * webp.MAX_SIDE
    if len(data) > most:
        return b"".join(store(data[i : i + most]) for i in range(0, len(data), most))
    width, height = sides(len(data))
    samples = np.frombuffer(data, np.uint8)
    pixels = (samples.astype(np.uint32) << np.uint32(8)) | OPAQUE
    present = np.flatnonzero(np.bincount(samples, minlength=256))
    if len(present) <= 16:
        return webp.encode(width, height, pixels, transforms=[("palette", (present.astype(np.uint32) << np.uint32(8)) | OPAQUE)])
    copies = repeats(data)
    mode = -1 if copies else guessed(samples, width)
    if mode < 0:
        return webp.encode(width, height, pixels, copies=copies)
    blocks = (-(-width >> PREDICTED)) * (-(-height >> PREDICTED))
    return webp.encode(width, height, pixels, transforms=[("predictor", PREDICTED, np.full(blocks, mode))])


def load(file: bytes) -> np.ndarray:
    """The samples of the images in a stored form."""
    out, at = [], 0
    while at < len(file):
        size = 8 + int.from_bytes(file[at + 4 : at + 8], "little")
        out.append(((webp.decode(file[at : at + size])[2] >> np.uint32(8)) & np.uint32(255)).astype(np.uint8))
        at += size
    return out[0] if len(out) == 1 else np.concatenate(out)


def feature(samples: np.ndarray) -> str:
    """Mean, spread and entropy of the samples, their most frequent value and how
    many differ, and the mean step from a sample to the next."""
    counts = np.bincount(samples, minlength=256)
    n = len(samples)
    share = counts[counts > 0] / n
    values = np.arange(256)
    mean = float(counts @ values) / n
    spread = float(counts @ (values - mean) ** 2) / n
    steps = float(np.abs(np.diff(samples.astype(np.int16))).sum()) / max(n - 1, 1)
    return f"rows={n // UNIT};mean={mean:.3f};spread={spread**0.5:.3f};bits={float(-(share * np.log2(share)).sum()) + 0.0:.3f};top={int(counts.argmax())};values={len(share)};step={steps:.3f}"


FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(text: bytes) -> tuple:
    """The digest columns of one text, all told from the stored form read back."""
    file = store(payload(text))
    samples = load(file)
    back = samples.tobytes()
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature(samples)


def media(docs: DataFrame, keep: list[str], text_col: str = "text", with_file: bool = False) -> DataFrame:
    """Kept columns and FIELDS; with_file: also the stored form, as media."""
    results = [*[f.split()[0] for f in FIELDS.split(", ")], "media"]
    keep = [c for c in keep if c not in results]
    rows = docs.select(*[f"`{c}`" for c in keep], F.col(f"`{text_col}`").alias("media_text"))

    def run(batches):
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            data, offsets = utf8(batch.column(batch.num_columns - 1))
            data, at = data.tobytes(), offsets.tolist()
            known: dict[bytes, tuple] = {}  # equal texts of a batch are stored once
            out = []
            for i, j in zip(at, at[1:]):
                text = data[i:j]
                if (told := known.get(text)) is None:
                    told = known[text] = described(text)
                out.append(told)
            columns = [pa.array([x[i] for x in out], t) for i, t in enumerate(types)]
            names = [f.split()[0] for f in FIELDS.split(", ")]
            if with_file:
                columns.append(pa.array([store(payload(data[i:j])) for i, j in zip(at, at[1:])], pa.binary()))
                names.append("media")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], names=[*keep, *names])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kept}{FIELDS}" + ", media binary" * with_file)


def query(spark, sf_dir: str) -> DataFrame:
    return media(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), ["doc_id"])
