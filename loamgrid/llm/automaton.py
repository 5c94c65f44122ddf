"""A smoothed byte n-gram model of spellings as a weighted backoff automaton.

Words stand lower-cased, each ended by a space; contexts don't reach over the space
before a word. States are the contexts of up to ORDER - 1 bytes that the model keeps.
A state has an arc for each byte that followed its context in training, with the
Witten-Bell interpolated probability, and a failure arc, weighted with the mass
left for other bytes, to the state of the next shorter context. The arcs that a
byte takes through failures are resolved when the tables are laid out, so that
reading a text is one step per byte from left to right.

Where not all contexts are kept, a byte is read exactly from the state of its whole
context only; walk() tells the length of each state's context, and resolved() the
probabilities of arcs beyond the tables, from all arcs of their contexts.

The state after ORDER - 1 bytes doesn't depend on what stood before them. So a
stream is read in many lanes at once, each begun ORDER - 1 bytes early.
"""

from __future__ import annotations

import numpy as np

from .common import LOWER, SPACE

ORDER = 6
SYMBOLS = 257  # of the uniform distribution under the lowest order
PART = 32
NUL = 9  # stands for zero bytes, as zeros stand before a word's start; no word holds it
LANES = 1024
READ = np.where(np.arange(256) == 0, NUL, LOWER).astype(np.uint8)


def stream(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that the model reads for rows of UTF-8, each word ended by a
    space, and where the words start there."""
    inked = np.flatnonzero(~SPACE[data])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[inked]
    new = np.ones(len(inked), bool)
    new[1:] = (np.diff(inked) > 1) | (np.diff(row) > 0)
    word = np.cumsum(new)
    out = np.full(len(inked) + int(new.sum()), PART, np.uint8)
    # before an inked byte stand the inked ones and a space for each earlier word
    place = np.arange(len(inked)) + word - 1
    out[place] = READ[data[inked]]
    return out, place[new]


def since_start(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Bytes of its word before each byte."""
    return np.arange(len(text)) - np.repeat(starts, np.diff(starts, append=len(text)))


def arcs_taken(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Numbers of the ORDER bytes that end at each byte (the highest are first;
    zeros before a word's start but for the space just before it)."""
    since = since_start(text, starts)
    code = np.zeros(len(text), np.uint64)
    for back in range(ORDER - 1, -1, -1):
        byte = np.zeros(len(text), np.uint64)
        byte[back:] = text[: max(len(text) - back, 0)]
        byte[since < back] = 0
        byte[since == back - 1] = PART
        code = (code << np.uint64(8)) | byte
    return code


def grams(text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of arcs_taken, ascending, and their counts."""
    return np.unique(arcs_taken(text, starts), return_counts=True)


def merge(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by code, codes ascending."""
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code, count = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code, kind="stable")
    code, count = code[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    return code[first], np.add.reduceat(count, first) if len(first) else count[:0]


def shorter(codes: np.ndarray, counts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the last length + 1 bytes: contexts of `length` bytes with the
    byte that follows. Those that reach over a word's start are left out."""
    mask = np.uint64((1 << (8 * (length + 1))) - 1)
    cut = codes & mask
    if length:
        ok = (cut >> np.uint64(8 * length)) > 0  # a context's first byte is none of the zeros
        cut, counts = cut[ok], counts[ok]
    return merge([cut], [counts])


def context_totals(codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return merge([codes >> np.uint64(8)], [counts])


def resolved(codes: np.ndarray, counts: np.ndarray, low: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """log10 probability of each arc (codes of ORDER bytes, ascending), as the automaton
    of all contexts has it. The codes hold all arcs of their contexts of two bytes or more;
    low has those of none and of one."""
    byte = (codes & np.uint64(255)).astype(np.int64)
    zero = np.bincount(low[0][0].astype(np.int64), weights=low[0][1], minlength=256)
    total, kinds = zero.sum(), np.count_nonzero(zero)
    p = (zero[byte] + kinds / SYMBOLS) / (total + kinds)
    for length in range(1, ORDER):
        arc, times = low[1] if length == 1 else shorter(codes, counts, length)
        of, first, kinds = np.unique(arc >> np.uint64(8), return_index=True, return_counts=True)
        total = np.add.reduceat(times, first) if len(first) else times
        own = codes & np.uint64((1 << (8 * (length + 1))) - 1)
        deep = np.flatnonzero((own >> np.uint64(8 * length)) > 0)  # others have no context so long
        taken, at = times[np.searchsorted(arc, own[deep])], np.searchsorted(of, own[deep] >> np.uint64(8))
        p[deep] = (taken + kinds[at] * p[deep]) / (total[at] + kinds[at])
    return np.log10(p)


class Automaton:
    """arcs: {length: (codes of context and byte, counts)} for the contexts kept;
    these must hold every shorter part of a context too."""

    def __init__(self, arcs: dict[int, tuple[np.ndarray, np.ndarray]]):
        zero = arcs.get(0, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
        used = np.zeros(256, bool)
        used[zero[0].astype(np.int64)] = True
        self.column = np.zeros(256, np.int64)  # 0: bytes never seen
        self.column[used] = 1 + np.arange(int(used.sum()))
        width = 1 + int(used.sum())
        names = [np.unique(c >> np.uint64(8)) for _, (c, _) in sorted(arcs.items())[1:]]
        lengths = [length for length, _ in sorted(arcs.items())[1:]]
        first = np.cumsum([1, *[len(x) for x in names]])
        states = int(first[-1])
        logp = np.empty((states, width), np.float32)
        follow = np.zeros((states, width), np.int32)

        def number(name: np.ndarray, level: int) -> np.ndarray:
            """State of contexts of lengths[level] bytes, -1 where there is none."""
            at = np.searchsorted(names[level], name)
            at = np.minimum(at, max(len(names[level]) - 1, 0))
            ok = names[level][at] == name if len(names[level]) else np.zeros(len(name), bool)
            return np.where(ok, first[level] + at, -1)

        # the empty context, over a uniform distribution
        total, kinds = float(zero[1].sum()), float(len(zero[0]))
        p = np.full(width, (kinds / (total + kinds) if total else 1.0) / SYMBOLS)
        p[self.column[zero[0].astype(np.int64)]] += zero[1] / (total + kinds) if total else 0
        logp[0] = np.log10(p)
        for level, length in enumerate(lengths):
            codes, counts = arcs[length]
            context = codes >> np.uint64(8)
            own = names[level]
            at = np.searchsorted(own, context)
            total = np.bincount(at, weights=counts, minlength=len(own))
            kinds = np.bincount(at, minlength=len(own)).astype(float)
            fail = number(own & np.uint64((1 << (8 * (length - 1))) - 1), level - 1) if level else np.zeros(len(own), np.int64)
            fail = np.maximum(fail, 0)
            rows = slice(first[level], first[level] + len(own))
            left = kinds / (total + kinds)
            logp[rows] = logp[fail] + np.log10(left)[:, None]
            column = self.column[(codes & np.uint64(255)).astype(np.int64)]
            below = 10.0 ** logp[fail[at], column].astype(np.float64)
            logp[first[level] + at, column] = np.log10((counts + kinds[at] * below) / (total[at] + kinds[at]))
            self._arcs(follow, codes, column, first[level] + at, level, fail, rows, number, lengths)
        # arcs out of the empty context
        if lengths:
            root = number(zero[0], 0)
            follow[0, self.column[zero[0].astype(np.int64)]] = np.maximum(root, 0)
        for level in range(len(lengths)):
            rows = slice(first[level], first[level] + len(names[level]))
            fail = np.maximum(number(names[level] & np.uint64((1 << (8 * (lengths[level] - 1))) - 1), level - 1), 0) if level else np.zeros(len(names[level]), np.int64)
            own = follow[rows]
            follow[rows] = np.where(own > 0, own, follow[fail])
        start = number(np.array([PART], np.uint64), 0) if lengths else np.array([-1])
        self.start = max(0, int(start[0]))
        if used[PART]:
            follow[:, self.column[PART]] = self.start
        self.depth = np.repeat(np.array([0, *lengths], np.int8), [1, *[len(x) for x in names]])
        self.logp, self.follow, self.width = logp.reshape(-1), (follow.astype(np.int64) * width).astype(np.int32).reshape(-1), width

    @staticmethod
    def _arcs(follow, codes, column, state, level, fail, rows, number, lengths) -> None:
        """Arcs to the longer context of context and byte, where it is kept."""
        if level + 1 < len(lengths):
            target = number(codes, level + 1)
            ok = target >= 0
            follow[state[ok], column[ok]] = target[ok]

    def read(self, text: np.ndarray) -> np.ndarray:
        """log10 probability of each byte of a stream, left to right."""
        return self.walk(text)[0]

    def walk(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each byte of a stream, left to right, and the length of
        the context of the state that it is read from."""
        n, warm = len(text), ORDER - 1
        if not n:
            return np.zeros(0, np.float32), np.zeros(0, np.int8)
        steps = -(-n // LANES)
        lanes = -(-n // steps)
        padded = np.full(warm + lanes * steps, self.column[PART], np.int32)
        padded[warm : warm + n] = self.column[text]
        out, depth = np.empty((steps, lanes), np.float32), np.empty((steps, lanes), np.int8)
        begin = np.arange(lanes) * steps
        state = np.full(lanes, self.start * self.width, np.int32)
        for i in range(warm):  # brings each lane to the state that it starts in
            state = self.follow[state + padded[begin + i]]
        state[0] = self.start * self.width
        body = np.ascontiguousarray(padded[warm:].reshape(lanes, steps).T)
        for i in range(steps):
            at = state + body[i]
            out[i] = self.logp[at]
            depth[i] = self.depth[state // self.width]
            state = self.follow[at]
        return out.T.reshape(-1)[:n], depth.T.reshape(-1)[:n]
