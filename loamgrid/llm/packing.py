"""Packing: concatenate the token ids of all documents and cut into windows.

Pass 1 encodes each document, ends it with the separator id and writes the ids
beside the document's offset within its partition; the totals of the partitions
are prefix-summed. Pass 2 adds a partition's base to the offsets, which gives
global offsets, and cuts every document at multiples of the window: a document
that crosses a boundary leaves one record on either side. Only the last window
is short.

Defined results: a null text is an empty one (its only id is the separator);
repeated rows are packed each; an empty table gives an empty table; a kept column
named like one of the results is left out; a text is held whole while it is encoded.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spans, stored, utf8

WINDOW = 1024
SEPARATOR = 0
#: Entries of a worker's cache of encoded words, and their longest. When full it makes
#: way for a new one, which takes over what is still asked for.
CACHE, LONGEST = 300_000, 48

#: The white space of the vocabulary's pattern, and characters that
#: some readers count as such.
BLANK = " \t\n\v\f\r\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LETTERS, DIGITS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: Words of characters whose kind is plain, and the parts of the pattern in them.
PLAIN = re.compile(f"([{BLANK}]*)([!-~\xa1-\u024f\u2010-\u2027]+)")
PARTS = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{DIGITS}]+| ?[^{BLANK}{LETTERS}{DIGITS}]+")
#: Blanks that don't part one by one: three in a row, two at the end, rarer ones.
ROUGH = re.compile(f"[ \\n]{{3}}|[ \\n]{{2}}\\Z|[{BLANK[1]}{BLANK[3:]}]")
#: The vocabulary writes a byte as the character of that number, bytes that don't print
#: as those from 256 on in order.
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
WRITTEN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTED)}
DOUBTFUL = re.compile("[\x1c-\x1f\x85\u180e\u200b\ufeff]")

_encoders: dict[str, tuple] = {}


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str):
    """A function from text to the bytes of its ids (little-endian 16 bits).

    No token of the pattern holds a blank after another character, so a text parts
    before each run of blanks, and such a run with the word behind it is encoded alike
    wherever it stands; these pieces recur and are kept, and so are the pattern's parts
of a piece of plain characters. A text that holds one of the
    special tokens, or a character of doubtful kind, is encoded at once."""
    if path not in _encoders:
        import tiktoken
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        assert own.get_vocab_size() <= 1 << 16 and sys.byteorder == "little"
        special = [t.content for t in own.get_added_tokens_decoder().values()]
        found = re.compile("|".join(map(re.escape, special))) if special else re.compile("(?!)")
        byte = {chr(c): b for b, c in WRITTEN.items()} | {chr(b): b for b in PRINTED}
        ranks = {bytes(byte[c] for c in name): i for name, i in own.get_vocab().items() if name not in special}
        merges = tiktoken.Encoding("own", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        _encoders[path] = own, merges, [{}, {}], found, re.compile(f"[{BLANK}]*[^{BLANK}]+|[{BLANK}]+")
    own, merges, known, special, pieces = _encoders[path]

    def ids(text: str) -> bytes:
        return array("H", own.encode(text, add_special_tokens=False).ids).tobytes()

    def part_ids(part: str) -> bytes:
        """Of what the pattern leaves whole."""
        return array("H", merges(part)).tobytes()

    def fresh(word: str) -> bytes:
        if word.isascii() and word.strip(" ").isalpha() and word.count(" ") < 2:
            return part_ids(word)
        found = PLAIN.fullmatch(word)
        if not found:
            return ids(word)
        blank, ink = found.groups()
        # the last of several blanks stands alone, or before the word if it is a space
        parts = [x for x in ((blank[:-1], ink) if blank[-1:] == " " else (blank[:-1], blank[-1:], ink)) if x][:-1]
        parts += PARTS.findall(" " * (blank[-1:] == " ") + ink)
        if len(parts) == 1:
            return part_ids(word)
        new, old = known
        out = []
        for part in parts:
            piece = new.get(part) or old.get(part)
            if piece is None:
                piece = new[part] = part_ids(part)
            out.append(piece)
        return b"".join(out)

    def encode(text: str) -> bytes:
        if special.search(text) or DOUBTFUL.search(text):
            return ids(text)
        if ROUGH.search(text):
            words = pieces.findall(text)
        else:  # the same pieces, but for a blank before another, which stands alone
            words = text.replace(" ", "\x1f ").replace("\n", "\x1f\n").split("\x1f")
        out = list(map(known[0].get, words))
        if None in out:
            new, old = known
            for i in [i for i, piece in enumerate(out) if piece is None]:
                word = words[i]
                piece = old.get(word) or new.get(word) or fresh(word)
                if len(word) <= LONGEST:
                    new[word] = piece
                out[i] = piece
            if len(new) > CACHE:
                known[:] = {}, new
        return b"".join(out)

    return encode


def _encoded(path: str):
    def run(batches):
        from pyspark import TaskContext

        encode, end = encoder(path), np.array([SEPARATOR], "<u2").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            text = batch.column(batch.num_columns - 1)
            _, offsets = utf8(text)
            for a, b in spans(np.diff(offsets)):
                data, where = utf8(text.slice(a, b - a))
                data, where = data.tobytes(), where.tolist()
                out = [encode(data[i:j].decode("utf-8", "replace")) + end for i, j in zip(where, where[1:])]
                n = np.array([len(x) // 2 for x in out], np.int64)
                begin = at + np.cumsum(n) - n
                at += int(n.sum())
                columns = [c.slice(a, b - a) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(np.full(b - a, part, np.int32)), pa.array(begin), pa.array(n), pa.array(out, pa.binary())],
                    names=[*batch.schema.names[:-1], "part", "at", "n", "ids"],
                )

    return run


def _own(keep: list[str]) -> list[str]:
    """Names of kept columns while others stand beside them."""
    return [f"keep_{i}" for i in range(len(keep))]


def encoded(docs: DataFrame, keep: list[str], text_col: str = "text", path: str | None = None) -> DataFrame:
    """Pass 1, written: kept columns (named keep_0 and so on), part, at (offset in the
    partition), n, ids."""
    rows = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(keep, _own(keep))], F.col(f"`{text_col}`").alias("packed_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return stored(rows.mapInArrow(_encoded(path or tokenizer_path()), f"{schema}part int, at long, n long, ids binary"), "tokens")


RESULTS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "sequence_tokens")


def pieces(ids: DataFrame, names: list[str], window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pass 2: a row for each document and window that it meets; names: of the kept
    columns of encoded()."""
    keep = _own(names)
    totals = ids.groupBy("part").agg(F.sum("n").alias("total")).orderBy("part").collect()  # a row per partition
    base, total = {}, 0
    for x in totals:
        base[x.part] = total
        total += x.total
    last = (total - 1) // window

    def run(batches):
        for batch in batches:
            table = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            part, at, n = (table[c].to_numpy(zero_copy_only=False) for c in ("part", "at", "n"))
            data, offsets = utf8(table["ids"])
            for a, b in spans(np.diff(offsets), 1 << 23):
                begin = at[a:b] + np.array([base[p] for p in part[a:b].tolist()], np.int64)
                sequence = begin // window
                count = (begin + n[a:b] - 1) // window - sequence + 1
                row = np.repeat(np.arange(b - a), count)
                order = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                window_of = sequence[row] + order
                start = np.maximum(window_of * window, begin[row])
                stop = np.minimum((window_of + 1) * window, begin[row] + n[a:b][row])
                wide = data[offsets[a] : offsets[b]].view("<u2").astype("<u4")
                left = (start - begin[row]) + (offsets[a:b][row] - offsets[a]) // 2
                cut = [wide[i : i + m] for i, m in zip(left.tolist(), (stop - start).tolist())]
                taken = pa.array(row + a)
                extra = [pa.array([x.tobytes() for x in cut], pa.binary())] if with_ids else []
                yield pa.RecordBatch.from_arrays(
                    [
                        *[table[c].take(taken) for c in keep],
                        pa.array(start - begin[row]),
                        pa.array(stop - start),
                        pa.array(np.array([zlib.crc32(x) for x in cut], np.int64)),
                        pa.array(n[a:b][row]),
                        pa.array(window_of),
                        pa.array(start - window_of * window),
                        *extra,
                    ],
                    names=[*keep, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"][: len(extra)]],
                )

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in ids.select(*keep).schema.fields)
    schema += "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    out = ids.mapInArrow(run, schema)
    used = F.when(F.col("sequence_id") == F.lit(last), F.lit(total - last * window)).otherwise(F.lit(window))
    out = out.withColumn("sequence_tokens", used.cast("long"))
    kept = [F.col(k).alias(c) for k, c in zip(keep, names) if c not in RESULTS]
    return out.select(*kept, *[c for c in RESULTS if c in out.columns])


def pack(docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Rows (kept columns, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_tokens); sequences short of the window are padded up to it."""
    keep = ["doc_id"] if keep is None else keep
    return pieces(encoded(docs, keep), keep, window, with_ids)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
