"""Lossless WebP (VP8L): an encoder and a full decoder, on numpy.

The decoder reads prefix codes (simple and normal), meta prefix codes,
back-references and the colour cache, and inverts the predictor, cross-colour,
subtract-green and palette transforms. Images whose pixels are one green code
each (red, blue and alpha constant, one group of codes, no cache) take a faster
path: code lengths are looked up at every bit position at once, and only the
walk from code to code is a loop.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3
MAX_SIDE = 1 << 14
MAX_COPY = 4096
LITERALS, LENGTHS, DISTANCES = 256, 24, 40
CACHE_FACTOR = 0x1E35A7BD
#: Short distance codes: (rows up, columns left) by nearness, then by columns,
#: left before right. Seven rows up and 8 columns left or 7 right belong to them.
PLANE = sorted(
    [(0, x) for x in range(1, 9)] + [(y, x) for y in range(1, 8) for x in range(-7, 9)],
    key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[1]), -p[1]),
)


class Bits:
    """Reads little-endian bits; past the end it raises ValueError."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data, 0, 8 * len(data)

    def peek(self, n: int) -> int:
        i = self.at >> 3
        return (int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return value


class Writer:
    """Gathers (value, bits) fields and arrays of them; lowest bit first."""

    def __init__(self):
        self.values, self.sizes = [], []
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def put(self, value: int, bits: int) -> None:
        if bits:
            self.values.append(value)
            self.sizes.append(bits)

    def flush(self) -> None:
        if self.values:
            self.parts.append((np.array(self.values, np.int64), np.array(self.sizes, np.int64)))
            self.values, self.sizes = [], []

    def extend(self, values: np.ndarray, sizes: np.ndarray) -> None:
        self.flush()
        self.parts.append((values, sizes))

    def bytes(self) -> bytes:
        self.flush()
        values = np.concatenate([p[0] for p in self.parts])
        sizes = np.concatenate([p[1] for p in self.parts])
        ends = np.cumsum(sizes)
        starts = ends - sizes
        # fields don't overlap, so the sums below are unions of their bits
        moved, first = values << (starts & 7), starts >> 3
        total = (int(ends[-1]) + 7) >> 3
        out = np.zeros(total + 8)
        step = 0
        while moved.any():
            out += np.bincount(first + step, weights=moved & 255, minlength=len(out))[: len(out)]
            moved >>= 8
            step += 1
        return out[:total].astype(np.uint8).tobytes()


def code_lengths(counts: np.ndarray, limit: int = 15) -> np.ndarray:
    """Lengths of a prefix code of least cost for the counts, none over limit."""
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) <= 1:
        out[used] = 1
        return out
    weight = counts[used].astype(np.int64)
    while True:
        order = np.argsort(weight, kind="stable")
        lengths = np.zeros(len(used), np.int64)
        lengths[order] = _depths(weight[order].tolist())
        if lengths.max() <= limit:
            out[used] = lengths
            return out
        weight = np.maximum(weight, max(1, int(weight.sum()) >> limit)) if weight.min() < int(weight.sum()) >> limit else (weight >> 1) + 1


def _depths(weights: list[int]) -> list[int]:
    """Code lengths for ascending weights: two queues, then depths from the root."""
    n = len(weights)
    parent = [0] * (2 * n - 1)
    merged: list[int] = []
    leaf = node = 0
    for at in range(n, 2 * n - 1):
        total = 0
        for _ in range(2):
            if leaf < n and (node >= len(merged) or weights[leaf] <= merged[node]):
                total += weights[leaf]
                parent[leaf] = at
                leaf += 1
            else:
                total += merged[node]
                parent[n + node] = at
                node += 1
        merged.append(total)
    depth = [0] * (2 * n - 1)
    for at in range(2 * n - 3, -1, -1):
        depth[at] = depth[parent[at]] + 1
    return depth[:n]


_FLIPPED = sum(((np.arange(1 << 15) >> i) & 1) << (14 - i) for i in range(15))


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, bits reversed as they are stored."""
    codes = np.zeros(len(lengths), np.int64)
    used = np.flatnonzero(lengths)
    if len(used) > 1:
        order = used[np.argsort(lengths[used], kind="stable")]
        # in canonical order each code is the sum of 2 ** -length of those before
        parts = np.cumsum(1 << (15 - lengths[order]))
        codes[order[1:]] = _FLIPPED[parts[:-1]]
    return codes


class Code:
    """A prefix code for reading: symbol and length by the next `width` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise ValueError("a prefix code without symbols")
        self.only = int(used[0]) if len(used) == 1 else -1
        if self.only >= 0:
            self.width, self.symbols, self.sizes = 0, np.array([self.only]), np.zeros(1, np.uint8)
        else:
            size = lengths[used]
            if int((1 << (15 - size)).sum()) != 1 << 15:
                raise ValueError("a prefix code that isn't complete")
            self.width = int(size.max())
            codes = canonical(lengths)[used]
            self.symbols = np.zeros(1 << self.width, np.int32)
            self.sizes = np.zeros(1 << self.width, np.uint8)
            for symbol, code, n in zip(used.tolist(), codes.tolist(), size.tolist()):
                self.symbols[code :: 1 << n] = symbol
                self.sizes[code :: 1 << n] = n
        self._lists = None

    def read(self, bits: Bits) -> int:
        if self.only >= 0:
            return self.only
        if self._lists is None:
            self._lists = self.symbols.tolist(), self.sizes.tolist()
        window = bits.peek(self.width)
        bits.at += self._lists[1][window]
        return self._lists[0][window]


# ---------------------------------------------------------------- prefix codes


def write_code(out: Writer, lengths: np.ndarray) -> None:
    """Writes a code: simple for one or two symbols below 256, else normal."""
    used = np.flatnonzero(lengths)
    if len(used) <= 2 and (not len(used) or used[-1] < 256):
        first = int(used[0]) if len(used) else 0
        out.put(1, 1)
        out.put(int(len(used) == 2), 1)
        out.put(int(first > 1), 1)
        out.put(first, 8 if first > 1 else 1)
        if len(used) == 2:
            out.put(int(used[1]), 8)
        return
    out.put(0, 1)
    last = int(used[-1]) + 1
    tokens = run_lengths(lengths[:last])
    counts = np.bincount([t for t, _, _ in tokens], minlength=19)
    of = code_lengths(counts, 7)
    code = canonical(of).tolist()
    sizes = of.tolist()
    if (of > 0).sum() == 1:
        sizes = [0] * 19  # a code of one symbol takes no bits
    order = [int(of[i]) for i in CODE_LENGTH_ORDER]
    n = max(4, max(i + 1 for i, x in enumerate(order) if x))
    out.put(n - 4, 4)
    for x in order[:n]:
        out.put(x, 3)
    if last == len(lengths):
        out.put(0, 1)
    else:  # the number of tokens read
        out.put(1, 1)
        k = len(tokens) - 2
        step = max(0, (max(k, 1).bit_length() - 1) // 2)
        out.put(step, 3)
        out.put(k, 2 + 2 * step)
    for token, extra, bits in tokens:
        out.put(code[token], sizes[token])
        out.put(extra, bits)


def run_lengths(lengths: np.ndarray) -> list[tuple[int, int, int]]:
    """(token, extra value, extra bits): 16 repeats the last length, 17 and 18 zeros."""
    out, before = [], 8
    edges = np.flatnonzero(np.diff(lengths)) + 1
    starts = [0, *edges.tolist()]
    for start, stop in zip(starts, [*starts[1:], len(lengths)]):
        value, n = int(lengths[start]), stop - start
        if value == 0:
            while n >= 11:
                k = min(n, 138)
                out.append((18, k - 11, 7))
                n -= k
            if n >= 3:
                out.append((17, n - 3, 3))
                n = 0
        else:
            if value != before:
                out.append((value, 0, 0))
                n -= 1
            before = value
            while n >= 3:
                k = min(n, 6)
                out.append((16, k - 3, 2))
                n -= k
        out += [(value, 0, 0)] * n
    if len(out) < 2:
        out.append((0, 0, 0))
    return out


def read_code(bits: Bits, size: int) -> Code:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two = bits.read(1)
        first = bits.read(8 if bits.read(1) else 1)
        symbols = [first, bits.read(8)] if two else [first]
        if max(symbols) >= size:
            raise ValueError("a symbol beyond the alphabet")
        lengths[symbols] = 1
        return Code(lengths)
    of = np.zeros(19, np.int64)
    for i in range(4 + bits.read(4)):
        of[CODE_LENGTH_ORDER[i]] = bits.read(3)
    code = Code(of)
    left = size
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
    at, before, found = 0, 8, [0] * size
    while at < size and left > 0:
        left -= 1
        token = code.read(bits)
        if token < 16:
            found[at] = token
            at += 1
            before = token or before
            continue
        base, n, value = ((3, 2, before), (3, 3, 0), (11, 7, 0))[token - 16]
        n = base + bits.read(n)
        if at + n > size:
            raise ValueError("code lengths beyond the alphabet")
        found[at : at + n] = [value] * n
        at += n
    return Code(np.array(found, np.int64))


def prefix(value: int) -> tuple[int, int, int]:
    """Prefix symbol, extra value and extra bits of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    high = (value - 1).bit_length() - 1
    second = ((value - 1) >> (high - 1)) & 1
    return 2 * high + second, (value - 1) & ((1 << (high - 1)) - 1), high - 1


def read_prefixed(bits: Bits, symbol: int) -> int:
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def distance(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    up, left = PLANE[code - 1]
    return max(1, up * width + left)


# ------------------------------------------------------------------- decoding


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """Entropy-coded pixels, as a flat array of ARGB numbers."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise ValueError("a colour cache too large")
    groups_of, block = None, 0
    n_groups = 1
    if main and bits.read(1):
        block = bits.read(3) + 2
        across = -(-width >> block)
        entropy = read_image(bits, across, -(-height >> block), False)
        groups_of = ((entropy >> 8) & 0xFFFF).astype(np.int64)
        n_groups = int(groups_of.max()) + 1
    cache_size = (1 << cache_bits) if cache_bits else 0
    groups = []
    for _ in range(n_groups):
        groups.append([read_code(bits, n) for n in (LITERALS + LENGTHS + cache_size, 256, 256, 256, DISTANCES)])
    if groups_of is None and not cache_bits and all(c.only >= 0 for c in groups[0][1:4]):
        return _read_green(bits, width * height, width, groups[0])
    total = width * height
    out = np.zeros(total, np.uint32)
    cache = [0] * cache_size
    shift = 32 - cache_bits
    at, cached = 0, 0
    pixels: list[int] = []
    while at < total:
        if groups_of is not None:
            y, x = divmod(at, width)
            group = groups[int(groups_of[(y >> block) * across + (x >> block)])]
        else:
            group = groups[0]
        symbol = group[0].read(bits)
        if symbol < LITERALS:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            pixels.append((alpha << 24) | (red << 16) | (symbol << 8) | blue)
            at += 1
        elif symbol < LITERALS + LENGTHS:
            n = read_prefixed(bits, symbol - LITERALS)
            back = distance(read_prefixed(bits, group[4].read(bits)), width)
            if back > at or at + n > total:
                raise ValueError("a copy from outside the image")
            start = at - back
            if back >= n:
                pixels += pixels[start : start + n]
            else:
                piece = pixels[start:]
                pixels += (piece * (-(-n // back)))[:n]
            at += n
        else:
            while cached < at:  # the cache holds all pixels so far
                cache[((CACHE_FACTOR * pixels[cached]) & 0xFFFFFFFF) >> shift] = pixels[cached]
                cached += 1
            pixels.append(cache[symbol - LITERALS - LENGTHS])
            at += 1
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
    out[:] = pixels
    return out


def _read_green(bits: Bits, total: int, width: int, group) -> np.ndarray:
    """Pixels that differ in green alone."""
    green, far = group[0], group[4]
    rest = (group[3].only << 24) | (group[1].only << 16) | group[2].only
    if green.only >= 0 and green.only < LITERALS:
        return np.full(total, rest | (green.only << 8), np.uint32)
    first = bits.at >> 3
    data = np.frombuffer(bits.data, np.uint8)[first:]
    padded = np.zeros(len(data) + 8, np.uint32)
    padded[: len(data)] = data
    words = padded[:-3] | (padded[1:-2] << np.uint32(8)) | (padded[2:-1] << np.uint32(16))
    mask = np.uint32((1 << green.width) - 1)
    window = ((words[:, None] >> np.arange(8, dtype=np.uint32)) & mask).reshape(-1)
    # size of the literal that starts at each bit; 0: a copy does
    literal = np.where(green.symbols < LITERALS, green.sizes, 0).astype(np.uint8)
    one = literal[window]
    if green.only >= 0:
        one[:] = 0
    # size of two literals, of one where a copy follows
    after = np.arange(len(one)) + one
    follows = one[np.minimum(after, len(one) - 1)]
    two = one + follows
    two[one == 0] = 0
    pair, sizes = two.tobytes(), one.tobytes()
    at, done, end = bits.at - 8 * first, 0, bits.end - 8 * first
    out = np.zeros(total, np.uint8)
    starts: list[int] = []
    add = starts.append
    while done < total:
        # a run of literals, two in a step
        room = total - done
        try:
            for _ in range(room >> 1):
                add(at)
                at += pair[at]
                if not pair[at]:
                    break
        except IndexError:
            raise ValueError("the stream ends early") from None
        if starts:
            heads = np.array(starts)
            seconds = heads + one[heads]
            both = np.column_stack([heads, seconds]).reshape(-1)
            ok = np.ones(len(both), bool)
            ok[1::2] = seconds < at
            found = both[ok & (one[np.minimum(both, len(one) - 1)] > 0)]
            out[done : done + len(found)] = green.symbols[window[found]]
            done += len(found)
            starts.clear()
        if done < total and at < len(sizes) and sizes[at]:
            out[done] = green.symbols[window[at]]
            at += sizes[at]
            done += 1
        if at > end:
            raise ValueError("the stream ends early")
        if done == total:
            break
        if at < len(sizes) and sizes[at]:
            continue
        room = total - done
        bits.at = at + 8 * first
        symbol = green.read(bits)
        n = read_prefixed(bits, symbol - LITERALS)
        back = distance(read_prefixed(bits, far.read(bits)), width)
        if back > done or n > room:
            raise ValueError("a copy from outside the image")
        start = done - back
        if back >= n:
            out[done : done + n] = out[start : start + n]
        else:
            out[done : done + n] = np.resize(out[start:done], n)
        done += n
        at = bits.at - 8 * first
    bits.at = at + 8 * first
    return (out.astype(np.uint32) << np.uint32(8)) | np.uint32(rest)


def _add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sum of ARGB numbers, channel by channel modulo 256."""
    even = ((a & 0xFF00FF00) + (b & 0xFF00FF00)) & 0xFF00FF00
    odd = ((a & 0x00FF00FF) + (b & 0x00FF00FF)) & 0x00FF00FF
    return even | odd


def _channels(p: int) -> tuple[int, int, int, int]:
    return p >> 24, (p >> 16) & 255, (p >> 8) & 255, p & 255


def _join(c) -> int:
    return (c[0] << 24) | (c[1] << 16) | (c[2] << 8) | c[3]


def _average(a: int, b: int) -> int:
    return (((a ^ b) & 0xFEFEFEFE) >> 1) + (a & b)


def predicted(mode: int, left: int, top: int, corner: int, right: int) -> int:
    """What mode predicts from the neighbours L, T, TL and TR."""
    if mode == 0 or mode > 13:
        return 0xFF000000
    if mode <= 4:
        return (left, top, right, corner)[mode - 1]
    if mode <= 10:
        pair = {6: (left, corner), 7: (left, top), 8: (corner, top), 9: (top, right)}
        if mode == 5:
            return _average(_average(left, right), top)
        if mode == 10:
            return _average(_average(left, corner), _average(top, right))
        return _average(*pair[mode])
    l, t, c = _channels(left), _channels(top), _channels(corner)  # noqa: E741
    if mode == 11:
        # the side that the gradient estimate L + T - TL is nearer to
        to_left = sum(abs(b - d) for b, d in zip(t, c))
        to_top = sum(abs(a - d) for a, d in zip(l, c))
        return left if to_left < to_top else top
    if mode == 12:
        return _join([min(255, max(0, a + b - d)) for a, b, d in zip(l, t, c)])
    mean = _channels(_average(left, top))
    return _join([min(255, max(0, m + int((m - d) / 2))) for m, d in zip(mean, c)])


def undo_predictor(pixels: np.ndarray, width: int, modes: np.ndarray, block: int) -> np.ndarray:
    """Adds to every residual what its block's mode predicts. The first row
    predicts from the left, the first column from the top."""
    height = len(pixels) // width
    across = -(-width >> block)
    rows = pixels.reshape(height, width)
    out = np.zeros((height, width), np.uint32)
    before: list[int] = []
    for y in range(height):
        residual = rows[y]
        row_modes = np.repeat(modes[(y >> block) * across : (y >> block) * across + across], 1 << block)[:width]
        if y and width > 1 and (row_modes[1:] == 2).all() or width == 1 and y:
            out[y] = _add(residual, out[y - 1])  # all from the top
            before = out[y].tolist()
            continue
        line: list[int] = []
        kinds = row_modes.tolist()
        for x, value in enumerate(residual.tolist()):
            if y == 0:
                guess = 0xFF000000 if x == 0 else line[x - 1]
            elif x == 0:
                guess = before[0]
            else:
                # beyond the right edge stands the leftmost pixel of this row
                right = before[x + 1] if x + 1 < width else line[0]
                guess = predicted(kinds[x], line[x - 1], before[x], before[x - 1], right)
            even = ((value & 0xFF00FF00) + (guess & 0xFF00FF00)) & 0xFF00FF00
            line.append(even | (((value & 0x00FF00FF) + (guess & 0x00FF00FF)) & 0x00FF00FF))
        out[y] = line
        before = line
    return out.reshape(-1)


def _signed(x: np.ndarray) -> np.ndarray:
    return ((x.astype(np.int64) & 255) ^ 128) - 128


def _block_values(values: np.ndarray, width: int, height: int, block: int) -> np.ndarray:
    """A block image's value for each pixel."""
    across = -(-width >> block)
    y, x = np.arange(height) >> block, np.arange(width) >> block
    return values.reshape(-1, across)[y[:, None], x[None, :]].reshape(-1)


def cross_colour(pixels: np.ndarray, elements: np.ndarray, undo: bool) -> np.ndarray:
    """elements: one per pixel; red to blue in bits 16-23, green to blue in 8-15,
    green to red in 0-7."""
    red, green, blue = ((pixels >> s) & 255 for s in (16, 8, 0))
    sign = 1 if undo else -1
    delta = lambda e, c: (_signed(e) * _signed(c)) >> 5
    new_red = (red.astype(np.int64) + sign * delta(elements, green)) & 255
    seen = new_red if undo else red  # blue is told from the original red
    new_blue = (blue.astype(np.int64) + sign * delta(elements >> 8, green) + sign * delta(elements >> 16, seen)) & 255
    return (pixels & np.uint32(0xFF00FF00)) | (new_red << 16).astype(np.uint32) | new_blue.astype(np.uint32)


def subtract_green(pixels: np.ndarray, undo: bool) -> np.ndarray:
    green = (pixels >> 8) & 255
    both = (green << 16) | green
    if undo:
        return (pixels & np.uint32(0xFF00FF00)) | (((pixels & np.uint32(0x00FF00FF)) + both) & np.uint32(0x00FF00FF))
    return (pixels & np.uint32(0xFF00FF00)) | (((pixels & np.uint32(0x00FF00FF)) + np.uint32(0x01000100) - both) & np.uint32(0x00FF00FF))


def _bundle(colours: int) -> int:
    """Bits of shift by which a palette image is narrower."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def undo_palette(pixels: np.ndarray, packed_width: int, width: int, palette: np.ndarray) -> np.ndarray:
    shift = _bundle(len(palette))
    index = ((pixels >> 8) & 255).reshape(-1, packed_width)
    if shift:
        each = 8 >> shift
        index = ((index[:, :, None] >> (np.arange(1 << shift) * each)) & ((1 << each) - 1)).reshape(len(index), -1)[:, :width]
    table = np.zeros(256, np.uint32)  # beyond the palette: transparent black
    table[: len(palette)] = palette
    return table[index].reshape(-1)


def decode(file: bytes) -> tuple[int, int, np.ndarray]:
    """Width, height and ARGB numbers of a WebP file with one VP8L chunk."""
    if file[:4] != b"RIFF" or file[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    size = struct.unpack("<I", file[16:20])[0]
    bits = Bits(file[20 : 20 + size])
    if bits.read(8) != 0x2F:
        raise ValueError("no VP8L signature")
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise ValueError("an unknown version")
    undo = []
    inner = width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [u[0] for u in undo]:
            raise ValueError("a transform stands twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            block = bits.read(3) + 2
            undo.append((kind, inner, block, read_image(bits, -(-inner >> block), -(-height >> block), False)))
        elif kind == SUBTRACT_GREEN:
            undo.append((kind, inner))
        else:
            table = read_image(bits, bits.read(8) + 1, 1, False)
            steps = [((table >> s) & 255).astype(np.uint64).cumsum() & 255 for s in (24, 16, 8, 0)]
            palette = (steps[0] << 24 | steps[1] << 16 | steps[2] << 8 | steps[3]).astype(np.uint32)
            undo.append((kind, inner, palette))
            inner = -(-inner >> _bundle(len(palette)))
    pixels = read_image(bits, inner, height, True)
    for kind, wide, *more in reversed(undo):
        if kind == PREDICTOR:
            pixels = undo_predictor(pixels, wide, ((more[1] >> 8) & 15).astype(np.int64), more[0])
        elif kind == CROSS_COLOUR:
            pixels = cross_colour(pixels, _block_values(more[1], wide, height, more[0]), True)
        elif kind == SUBTRACT_GREEN:
            pixels = subtract_green(pixels, True)
        else:
            pixels = undo_palette(pixels, inner, wide, more[0])
            inner = wide
    return width, height, pixels


# ------------------------------------------------------------------- encoding


def write_image(out: Writer, pixels: np.ndarray, main: bool, copies=(), cache_bits: int = 0, groups: tuple | None = None) -> None:
    """Entropy-codes pixels.

    copies: (position, length, distance) in order, not overlapping; they replace
    the pixels they cover. cache_bits: literals that the colour cache holds are
    written as its indexes. groups: (block bits, width, group of each pixel, block
    image) for meta prefix codes."""
    out.put(int(cache_bits > 0), 1)
    out.put(cache_bits, 4 if cache_bits else 0)
    of_pixel = None
    if main:
        out.put(int(groups is not None), 1)
        if groups is not None:
            block, _, of_pixel, image = groups
            out.put(block - 2, 3)
            write_image(out, (image.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), False)
    keep = np.ones(len(pixels), bool)
    for at, n, _ in copies:
        keep[at : at + n] = False
    where = np.flatnonzero(keep)
    value = pixels[where]
    green = ((value >> 8) & 255).astype(np.int64)
    if cache_bits:
        green = _cached(pixels, where, green, cache_bits)
    group = of_pixel[where].astype(np.int64) if of_pixel is not None else np.zeros(len(where), np.int64)
    n_groups = int(of_pixel.max()) + 1 if of_pixel is not None else 1
    sizes = (LITERALS + LENGTHS + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, DISTANCES)
    channel = [green, *[((value >> s) & 255).astype(np.int64) for s in (16, 0, 24)]]
    plain = green < LITERALS
    told = []
    for at, n, back in copies:
        g = int(of_pixel[at]) if of_pixel is not None else 0
        told.append((at, g, prefix(n), prefix(back + 120)))
    tables = []
    for g in range(n_groups):
        mine = group == g
        counts = [np.bincount(c[mine if i == 0 else mine & plain], minlength=sizes[i]) for i, c in enumerate(channel)]
        counts.append(np.zeros(DISTANCES, np.int64))
        for _, h, length, far in told:
            if h == g:
                counts[0][LITERALS + length[0]] += 1
                counts[4][far[0]] += 1
        lengths = [code_lengths(c) for c in counts]
        for x in lengths:
            write_code(out, x)
        tables.append([(canonical(x), x if (x > 0).sum() > 1 else np.zeros_like(x)) for x in lengths])
    # four fields for each literal (cache indexes: one), four for each copy, in order of position
    columns, widths = [], []
    for i, c in enumerate(channel):
        code, bits = np.zeros(len(where), np.int64), np.zeros(len(where), np.int64)
        for g in range(n_groups):
            mine = np.flatnonzero((group == g) & (plain if i else True)) if n_groups > 1 or i else slice(None)
            if i and n_groups == 1:
                mine = np.flatnonzero(plain) if cache_bits else slice(None)
            code[mine], bits[mine] = tables[g][i][0][c[mine]], tables[g][i][1][c[mine]]
        if i == 0 or bits.any():
            columns.append(code)
            widths.append(bits)
    codes, bits = np.column_stack(columns), np.column_stack(widths)
    done = 0
    out.flush()
    for at, g, length, far in told:
        until = int(np.searchsorted(where, at))
        if until > done:
            out.extend(codes[done:until].reshape(-1), bits[done:until].reshape(-1))
            done = until
        out.put(int(tables[g][0][0][LITERALS + length[0]]), int(tables[g][0][1][LITERALS + length[0]]))
        out.put(length[1], length[2])
        out.put(int(tables[g][4][0][far[0]]), int(tables[g][4][1][far[0]]))
        out.put(far[1], far[2])
    if done < len(where):
        out.extend(codes[done:].reshape(-1), bits[done:].reshape(-1))


def _cached(pixels: np.ndarray, where: np.ndarray, green: np.ndarray, cache_bits: int) -> np.ndarray:
    """Green symbols in which pixels that stand in the colour cache are indexes."""
    shift, cache = 32 - cache_bits, {}
    out = green.copy()
    literal = dict(zip(where.tolist(), range(len(where))))
    for at, value in enumerate(pixels.tolist()):
        key = ((CACHE_FACTOR * value) & 0xFFFFFFFF) >> shift
        i = literal.get(at)
        if i is not None and cache.get(key) == value:
            out[i] = LITERALS + LENGTHS + key
        cache[key] = value
    return out


def encode(width: int, height: int, pixels: np.ndarray, copies=(), transforms=(), cache_bits: int = 0, groups: tuple | None = None) -> bytes:
    """A WebP file of ARGB numbers.

    transforms, in the order they are applied: ("predictor", block, mode image),
    ("cross", block, element image), ("green",), ("palette", colours). copies refer
    to the pixels as they are after the transforms."""
    if not (0 < width <= MAX_SIDE and 0 < height <= MAX_SIDE and len(pixels) == width * height):
        raise ValueError("sizes out of range")
    out = Writer()
    out.put(0x2F, 8)
    out.put(width - 1, 14)
    out.put(height - 1, 14)
    out.put(int(bool((pixels >> 24 != 255).any())), 1)
    out.put(0, 3)
    inner = width
    for kind, *more in transforms:
        out.put(1, 1)
        if kind == "predictor":
            block, modes = more
            out.put(PREDICTOR, 2)
            out.put(block - 2, 3)
            write_image(out, (modes.astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000), False)
            pixels = _residuals(pixels, inner, modes, block)
        elif kind == "cross":
            block, elements = more
            out.put(CROSS_COLOUR, 2)
            out.put(block - 2, 3)
            write_image(out, elements.astype(np.uint32) | np.uint32(0xFF000000), False)
            pixels = cross_colour(pixels, _block_values(elements, inner, height, block), False)
        elif kind == "green":
            out.put(SUBTRACT_GREEN, 2)
            pixels = subtract_green(pixels, False)
        else:
            colours = np.asarray(more[0], np.uint32)
            out.put(PALETTE, 2)
            out.put(len(colours) - 1, 8)
            before = np.concatenate([[np.uint32(0)], colours[:-1]])
            steps = [((colours >> s) - (before >> s)) & 255 for s in (24, 16, 8, 0)]
            write_image(out, (steps[0] << 24 | steps[1] << 16 | steps[2] << 8 | steps[3]).astype(np.uint32), False)
            order = np.argsort(colours, kind="stable")
            index = order[np.searchsorted(colours[order], pixels)].reshape(height, inner)
            shift = _bundle(len(colours))
            if shift:
                each, many = 8 >> shift, 1 << shift
                packed = -(-inner >> shift)
                wide = np.zeros((height, packed * many), np.int64)
                wide[:, :inner] = index
                index = (wide.reshape(height, packed, many) << (np.arange(many) * each)).sum(axis=2)
                inner = packed
            pixels = (index.reshape(-1).astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
    out.put(0, 1)
    write_image(out, pixels, True, copies, cache_bits, groups)
    data = out.bytes()
    data += b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(data) + 12) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data


def _residuals(pixels: np.ndarray, width: int, modes: np.ndarray, block: int) -> np.ndarray:
    """Pixels less what their neighbours predict."""
    height, across = len(pixels) // width, -(-width >> block)
    rows, out, kinds = pixels.reshape(height, width).tolist(), [], modes.tolist()
    for y, row in enumerate(rows):
        for x, value in enumerate(row):
            if y == 0:
                guess = 0xFF000000 if x == 0 else row[x - 1]
            elif x == 0:
                guess = rows[y - 1][0]
            else:
                right = rows[y - 1][x + 1] if x + 1 < width else row[0]
                guess = predicted(kinds[(y >> block) * across + (x >> block)], row[x - 1], rows[y - 1][x], rows[y - 1][x - 1], right)
            out.append(_join([(a - b) & 255 for a, b in zip(_channels(value), _channels(guess))]))
    return np.array(out, np.uint32)
