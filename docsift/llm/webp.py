"""Lossless WebP (VP8L): a decoder for all of its coding tools, and an encoder for grey payloads."""

from __future__ import annotations

import heapq
from functools import cache

import numpy as np

# Fixed values of the format.
CODE_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
ALPHABETS = (256 + 24, 256, 256, 256, 40)  # green and lengths (and cache), red, blue, alpha, distance
CACHE_FACTOR = 0x1E35A7BD
SIGNATURE = 0x2F
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
MAX_SIDE = 16384
WIDTH = 64  # of an image that holds a payload
MAX_COPY = 4096
#: Longest code that the encoder gives out, and shortest line that it copies.
LIMIT, LEAST_COPY = 12, 24


class Damaged(ValueError):
    """The bytes aren't a whole lossless WebP image."""


@cache
def reversed_bits(width: int) -> np.ndarray:
    """Each number below 2 ** width with its bits in reverse order."""
    out = np.zeros(1, "i8")
    for k in range(width):
        out = np.concatenate([out, out + (1 << (width - 1 - k))])
    # built from the lowest bit upwards: bit k of the index is bit width - 1 - k of the value
    return out


@cache
def near_offsets() -> list[tuple[int, int]]:
    """(x, y) of the 120 short distance codes: nearer first, then smaller |x|, left of the pixel before right."""
    spots = [(x, y) for y in range(8) for x in range(-7, 9) if y or x > 0]
    return sorted(spots, key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0))


class Bits:
    """Reads bits from the lowest of each byte on."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(16), 0, 8 * len(data)

    def peek(self, n: int) -> int:
        byte = self.at >> 3
        return (int.from_bytes(self.data[byte : byte + 5], "little") >> (self.at & 7)) & ((1 << n) - 1)

    def read(self, n: int) -> int:
        value = self.peek(n)
        self.at += n
        if self.at > self.end:
            raise Damaged("the data ends too early")
        return value


class Code:
    """A canonical prefix code as a table over the next ``width`` bits."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if not len(used):
            raise Damaged("a prefix code without symbols")
        if len(used) == 1:
            self.width, self.symbols, self.lengths = 0, used[:1], np.zeros(1, "i8")
        else:
            order = used[np.argsort(lengths[used], kind="stable")]
            size = lengths[order].astype("i8")
            self.width = int(size[-1])
            spans = 1 << (self.width - size)
            if spans.sum() != 1 << self.width:
                raise Damaged("an incomplete or overfull prefix code")
            back = reversed_bits(self.width)
            self.symbols, self.lengths = np.repeat(order, spans)[back], np.repeat(size, spans)[back]
        self._lists: tuple[list[int], list[int]] | None = None

    def read(self, bits: Bits) -> int:
        if self._lists is None:
            self._lists = self.symbols.tolist(), self.lengths.tolist()
        at = bits.peek(self.width)
        bits.at += self._lists[1][at]
        if bits.at > bits.end:
            raise Damaged("the data ends too early")
        return self._lists[0][at]


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, "i8")
    if bits.read(1):
        two, wide = bits.read(1), bits.read(1)
        symbols = [bits.read(8 if wide else 1)] + ([bits.read(8)] if two else [])
        if max(symbols) >= alphabet:
            raise Damaged("a symbol beyond the alphabet")
        lengths[symbols] = 1
        return Code(lengths)
    first = np.zeros(19, "i8")
    for k in CODE_ORDER[: 4 + bits.read(4)]:
        first[k] = bits.read(3)
    code = Code(first)
    left = alphabet
    if bits.read(1):
        left = 2 + bits.read(2 + 2 * bits.read(3))
        if left > alphabet:
            raise Damaged("more code lengths than symbols")
    at, previous = 0, 8
    while at < alphabet and left:
        left -= 1
        symbol = code.read(bits)
        if symbol < 16:
            lengths[at] = symbol
            at += 1
            previous = symbol or previous
            continue
        base, extra = ((3, 2), (3, 3), (11, 7))[symbol - 16]
        times = base + bits.read(extra)
        if at + times > alphabet:
            raise Damaged("code lengths beyond the alphabet")
        if symbol == 16:
            lengths[at : at + times] = previous
        at += times
    return Code(lengths)


def prefixed(symbol: int, bits: Bits) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << extra) + bits.read(extra) + 1


def distance_of(code: int, width: int) -> int:
    if code > 120:
        return code - 120
    x, y = near_offsets()[code - 1]
    return max(1, x + y * width)


def read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """ARGB pixels (uint32) of an entropy-coded image, in a row."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise Damaged("colour cache too large")
    groups, block, tile = 1, None, 0
    if main and bits.read(1):
        tile = bits.read(3) + 2
        across, down = (width + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
        block = ((read_image(bits, across, down, False) >> 8) & 0xFFFF).reshape(down, across)
        groups = int(block.max()) + 1
    sizes = (ALPHABETS[0] + ((1 << cache_bits) if cache_bits else 0), *ALPHABETS[1:])
    codes = [[read_code(bits, n) for n in sizes] for _ in range(groups)]
    if groups == 1 and not cache_bits and not any(c.width for c in codes[0][1:4]):
        return _green_only(bits, codes[0], width, width * height)
    return _pixels(bits, codes, block, tile, cache_bits, width, width * height)


def _pixels(bits: Bits, codes: list[list[Code]], block, tile: int, cache_bits: int, width: int, total: int) -> np.ndarray:
    """Pixel by pixel: literals, copies and cached colours."""
    out: list[int] = []
    cached = [0] * (1 << cache_bits)
    shift, kept = 32 - cache_bits, 0
    group = codes[0]
    while (at := len(out)) < total:
        if block is not None:
            group = codes[block[at // width >> tile, at % width >> tile]]
        symbol = group[0].read(bits)
        if symbol < 256:
            red, blue, alpha = group[1].read(bits), group[2].read(bits), group[3].read(bits)
            out.append(alpha << 24 | red << 16 | symbol << 8 | blue)
        elif symbol < 280:
            length = prefixed(symbol - 256, bits)
            back = distance_of(prefixed(group[4].read(bits), bits), width)
            if back > at or at + length > total:
                raise Damaged("a copy from outside the image")
            for _ in range(length):
                out.append(out[-back])
        else:
            for pixel in out[kept:]:
                cached[(CACHE_FACTOR * pixel & 0xFFFFFFFF) >> shift] = pixel
            kept = len(out)
            out.append(cached[symbol - 280])
    return np.array(out, "u4")


def _green_only(bits: Bits, group: list[Code], width: int, total: int) -> np.ndarray:
    """As _pixels, where red, blue and alpha are constant: several green symbols by one table entry."""
    green = group[0]
    constant = int(group[3].symbols[0]) << 24 | int(group[1].symbols[0]) << 16 | int(group[2].symbols[0])
    if not green.width:
        symbol = int(green.symbols[0])
        if symbol > 255:
            raise Damaged("a copy without a source")
        return np.full(total, constant | symbol << 8, "u4")
    size = max(green.width, LIMIT)
    index = np.arange(1 << size)
    rest, used = index.copy(), np.zeros(len(index), "i8")
    row, count, open_ = np.zeros((len(index), 4), "u1"), np.zeros(len(index), "i8"), np.ones(len(index), bool)
    mask = (1 << green.width) - 1
    for k in range(4):
        symbol, length = green.symbols[rest & mask], green.lengths[rest & mask]
        open_ &= (used + length <= size) & (symbol < 256)
        row[:, k] = symbol
        count += open_
        used += length * open_
        rest >>= length
    steps = used.tolist()
    padded = np.frombuffer(bits.data, "u1").astype("u4")
    windows = (padded[:-3] | padded[1:-2] << 8 | padded[2:-1] << 16 | padded[3:] << 24).tolist()
    out = np.zeros(total, "u1")
    done, at, low, end = 0, bits.at, (1 << size) - 1, bits.end
    while done < total:
        hits: list[int] = []
        add = hits.append
        step = 1
        while step and at < end:
            i = windows[at >> 3] >> (at & 7) & low
            step = steps[i]
            add(i)
            at += step
        found = np.array(hits, "i8")
        many = count[found]
        literals = row[found][np.arange(4) < many[:, None]]
        if len(literals) >= total - done:
            out[done:] = literals[: total - done]
            ends = np.cumsum(many)
            last = int(np.searchsorted(ends, total - done))  # give back what was read beyond the image
            at -= int(used[found[last:]].sum())
            bits.at = at
            for _ in range(total - done - int(ends[last] - many[last])):
                green.read(bits)
            return constant | out.astype("u4") << 8
        out[done : done + len(literals)] = literals
        done += len(literals)
        if step:
            raise Damaged("the data ends too early")
        bits.at = at
        symbol = green.read(bits)
        length = prefixed(symbol - 256, bits)
        back = distance_of(prefixed(group[4].read(bits), bits), width)
        if back > done or done + length > total:
            raise Damaged("a copy from outside the image")
        pattern = out[done - back : done]
        out[done : done + length] = pattern[:length] if back >= length else np.resize(pattern, length)
        done += length
        at = bits.at
    bits.at = at
    return constant | out.astype("u4") << 8


def _channels(pixels: np.ndarray) -> np.ndarray:
    """[..., 4] of alpha, red, green, blue."""
    return np.stack([(pixels >> s) & 255 for s in (24, 16, 8, 0)], -1).astype("i4")


def _pixel(channels: np.ndarray) -> np.ndarray:
    c = channels.astype("u4") & 255
    return c[..., 0] << 24 | c[..., 1] << 16 | c[..., 2] << 8 | c[..., 3]


def predict(mode: int, left: np.ndarray, top: np.ndarray, top_left: np.ndarray, top_right: np.ndarray) -> np.ndarray:
    """The prediction of one pixel's channels from its neighbours'."""
    mean = lambda a, b: (a + b) >> 1
    if mode in (1, 2, 3, 4):
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return mean(*((left, top_left), (left, top), (top_left, top), (top, top_right))[mode - 6])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        to_left, to_top = np.abs(top - top_left).sum(), np.abs(left - top_left).sum()
        return left if to_left < to_top else top
    if mode == 12:
        return np.clip(left + top - top_left, 0, 255)
    if mode == 13:
        m = mean(left, top)
        return np.clip(m + np.trunc((m - top_left) / 2).astype("i4"), 0, 255)
    return np.array([255, 0, 0, 0], "i4")


def undo_predictor(pixels: np.ndarray, modes: np.ndarray, tile: int) -> np.ndarray:
    """Add predictions to residuals, in scan order. pixels: [height, width]."""
    height, width = pixels.shape
    c = _channels(pixels)
    c[0, 0] = (c[0, 0] + [255, 0, 0, 0]) & 255
    c[0, 1:] = c[0, 1:]
    c[0] = np.cumsum(c[0], 0) & 255  # the first row takes the left neighbour
    for y in range(1, height):
        c[y, 0] = (c[y, 0] + c[y - 1, 0]) & 255  # the first column takes the one above
        for x in range(1, width):
            beyond = c[y, 0] if x == width - 1 else c[y - 1, x + 1]  # the next pixel in memory
            guess = predict(int(modes[y >> tile, x >> tile]), c[y, x - 1], c[y - 1, x], c[y - 1, x - 1], beyond)
            c[y, x] = (c[y, x] + guess) & 255
    return _pixel(c)


def undo_cross_colour(pixels: np.ndarray, factors: np.ndarray, tile: int) -> np.ndarray:
    c = _channels(pixels)
    f = _channels(np.repeat(np.repeat(factors, 1 << tile, 0), 1 << tile, 1)[: c.shape[0], : c.shape[1]])
    signed = lambda v: ((v & 255) ^ 128) - 128
    delta = lambda factor, colour: (signed(factor) * signed(colour)) >> 5
    red = (c[..., 1] + delta(f[..., 3], c[..., 2])) & 255
    blue = (c[..., 3] + delta(f[..., 2], c[..., 2]) + delta(f[..., 1], red)) & 255
    return _pixel(np.stack([c[..., 0], red, c[..., 2], blue], -1))


def undo_subtract_green(pixels: np.ndarray) -> np.ndarray:
    c = _channels(pixels)
    c[..., 1] += c[..., 2]
    c[..., 3] += c[..., 2]
    return _pixel(c)


def undo_palette(pixels: np.ndarray, colours: np.ndarray, width: int, pack: int) -> np.ndarray:
    """Colours by index; 2 ** pack indices are packed in each green value, the lowest bits first."""
    index = (pixels >> 8) & 255
    if pack:
        depth = 8 >> pack
        parts = [(index >> (depth * k)) & ((1 << depth) - 1) for k in range(1 << pack)]
        index = np.stack(parts, -1).reshape(len(pixels), -1)[:, :width]
    table = np.zeros(256, "u4")
    table[: len(colours)] = colours
    return table[index]


def decode(data: bytes) -> np.ndarray:
    """[height, width] ARGB pixels (uint32) of one WebP file. Damaged if it isn't whole or not lossless."""
    if len(data) < 25 or data[:4] != b"RIFF" or data[8:16] != b"WEBPVP8L":
        raise Damaged("not a lossless WebP file")
    size = int.from_bytes(data[16:20], "little")
    if len(data) < 20 + size or data[20] != SIGNATURE:
        raise Damaged("not a whole lossless WebP file")
    bits = Bits(data[21 : 20 + size])
    width, height = bits.read(14) + 1, bits.read(14) + 1
    bits.read(1)
    if bits.read(3):
        raise Damaged("unknown version")
    undo, now = [], width
    seen: set[int] = set()
    while bits.read(1):
        kind = bits.read(2)
        if kind in seen:
            raise Damaged("a transform twice")
        seen.add(kind)
        if kind in (PREDICTOR, CROSS_COLOUR):
            tile = bits.read(3) + 2
            across, down = (now + (1 << tile) - 1) >> tile, (height + (1 << tile) - 1) >> tile
            grid = read_image(bits, across, down, False).reshape(down, across)
            if kind == PREDICTOR:
                undo.append(lambda p, g=(grid >> 8) & 15, t=tile: undo_predictor(p, g, t))
            else:
                undo.append(lambda p, g=grid, t=tile: undo_cross_colour(p, g, t))
        elif kind == SUBTRACT_GREEN:
            undo.append(undo_subtract_green)
        else:
            many = bits.read(8) + 1
            colours = _pixel(np.cumsum(_channels(read_image(bits, many, 1, False)), 0) & 255)
            pack = 3 if many <= 2 else 2 if many <= 4 else 1 if many <= 16 else 0
            undo.append(lambda p, c=colours, w=now, k=pack: undo_palette(p, c, w, k))
            now = (now + (1 << pack) - 1) >> pack
    pixels = read_image(bits, now, height, True).reshape(height, now)
    for step in reversed(undo):
        pixels = step(pixels)
    return pixels


# Encoding.


def code_lengths(counts: list[tuple[int, int]], limit: int = LIMIT) -> dict[int, int]:
    """Huffman code lengths of at most ``limit`` for (count, symbol) pairs."""
    while True:
        heap = [(n, s, s) for n, s in counts]
        heapq.heapify(heap)
        serial = 1 << 20
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            serial += 1
            heapq.heappush(heap, (a[0] + b[0], serial, (a[2], b[2])))
        out: dict[int, int] = {}
        stack = [(heap[0][2], 0)]
        while stack:
            node, depth = stack.pop()
            if isinstance(node, tuple):
                stack += [(node[0], depth + 1), (node[1], depth + 1)]
            else:
                out[node] = max(1, depth)
        if max(out.values()) <= limit:
            return out
        counts = [((n >> 1) + 1, s) for n, s in counts]


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits in stream order, how many)."""
    out, code, before = {}, 0, 0
    for symbol, size in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= size - before
        before = size
        out[symbol] = (int(f"{code:0{size}b}"[::-1], 2), size)
        code += 1
    return out


class Writer:
    """Collects (value, bits) from the lowest bit on."""

    def __init__(self) -> None:
        self.value = self.size = 0

    def put(self, value: int, size: int) -> None:
        self.value |= value << self.size
        self.size += size


def put_code(out: Writer, counts: list[tuple[int, int]], alphabet: int) -> dict[int, tuple[int, int]]:
    """Write a prefix code for (count, symbol) pairs, at least one; returns the symbols' bits."""
    symbols = sorted(s for _, s in counts)
    if len(symbols) <= 2 and symbols[-1] < 256:
        out.put(1 | (len(symbols) - 1) << 1 | 1 << 2, 3)
        for s in symbols:
            out.put(s, 8)
        return {s: (k, len(symbols) - 1) for k, s in enumerate(symbols)}
    lengths = code_lengths(counts)
    row: list[tuple[int, int, int]] = []  # (symbol of the code-length code, extra value, extra bits)
    at = 0
    for s in [*symbols, alphabet]:
        gap = s - at
        while gap > 10:
            n = min(gap, 138)
            row.append((18, n - 11, 7))
            gap -= n
        if gap > 2:
            row.append((17, gap - 3, 3))
        else:
            row += [(0, 0, 0)] * gap
        if s < alphabet:
            row.append((lengths[s], 0, 0))
        at = s + 1
    seen: dict[int, int] = {}
    for k, _, _ in row:
        seen[k] = seen.get(k, 0) + 1
    if len(seen) == 1:
        seen[0 if 0 not in seen else 1] = 1
    second = code_lengths([(n, k) for k, n in seen.items()], 7)
    out.put(0, 1)
    out.put(15, 4)
    for k in CODE_ORDER:
        out.put(second.get(k, 0), 3)
    out.put(0, 1)
    words = canonical(second)
    for k, extra, size in row:
        out.put(*words[k])
        if size:
            out.put(extra, size)
    return canonical(lengths)


def prefix_of(value: int) -> tuple[int, int, int]:
    """(symbol, extra value, extra bits) of a length or distance."""
    v = value - 1
    if v < 4:
        return v, 0, 0
    high = v.bit_length() - 1
    return 2 * high + (v >> (high - 1) & 1), v & ((1 << (high - 1)) - 1), high - 1


def find_copies(data: bytes) -> list[tuple[int, int, int]]:
    """(at, length, distance): lines that stood before, and a run of zeros at the end."""
    out: list[tuple[int, int, int]] = []
    known: dict[bytes, int] = {}
    at = 0
    for line in data.split(b"\n"):
        size = len(line)
        if size >= LEAST_COPY:
            before = known.get(line)
            if before is not None:
                out += [(at + k, min(MAX_COPY, size - k), at - before) for k in range(0, size, MAX_COPY)]
            known[line] = at
        at += size + 1
    zeros = len(data) - len(data.rstrip(b"\0"))
    end = out[-1][0] + out[-1][1] if out else 0
    start = max(len(data) - zeros + 1, end, 1)
    if len(data) - start >= 4:
        out += [(k, min(MAX_COPY, len(data) - k), 1) for k in range(start, len(data), MAX_COPY)]
    return out


def encode_grey(data: bytes) -> bytes:
    """One WebP file of a WIDTH wide grey image whose pixels are the bytes; at most MAX_SIDE rows."""
    rows = len(data) // WIDTH
    if len(data) % WIDTH or not 0 < rows <= MAX_SIDE:
        raise ValueError("not whole rows of one image")
    out = Writer()
    out.put(SIGNATURE, 8)
    out.put(WIDTH - 1, 14)
    out.put(rows - 1, 14)
    out.put(0, 4)
    out.put(1 | SUBTRACT_GREEN << 1, 3)
    out.put(0, 1)  # no more transforms
    out.put(0, 2)  # no cache, one group of codes
    raw = np.frombuffer(data, "u1")
    copies = find_copies(data)
    marks = [(at, *prefix_of(size), *prefix_of(back + 120)) for at, size, back in copies]
    if copies:
        literal = np.ones(len(raw), bool)
        for at, size, _ in copies:
            literal[at : at + size] = False
        counts = np.bincount(raw[literal], minlength=256)
    else:
        counts = np.bincount(raw, minlength=256)
    used = np.flatnonzero(counts)
    green = list(zip(counts[used].tolist(), used.tolist(), strict=True))
    lengths: dict[int, int] = {}
    backs: dict[int, int] = {}
    for _, s, _, _, d, _, _ in marks:
        lengths[256 + s] = lengths.get(256 + s, 0) + 1
        backs[d] = backs.get(d, 0) + 1
    words = put_code(out, green + [(n, s) for s, n in lengths.items()], ALPHABETS[0])
    for symbol in (0, 0, 255):
        put_code(out, [(1, symbol)], 256)
    far = put_code(out, [(n, s) for s, n in backs.items()] or [(1, 0)], ALPHABETS[4])
    value, size = np.zeros(256, "u4"), np.zeros(256, "i8")
    for s in used.tolist():
        value[s], size[s] = words[s]
    if copies:
        values, sizes, at = [], [], 0
        for (where, many, _), (_, s, e, n, d, f, m) in zip(copies, marks, strict=True):
            values += [value[raw[at:where]], np.array([words[256 + s][0], e, far[d][0], f], "u4")]
            sizes += [size[raw[at:where]], np.array([words[256 + s][1], n, far[d][1], m], "i8")]
            at = where + many
        v = np.concatenate([*values, value[raw[at:]]])
        z = np.concatenate([*sizes, size[raw[at:]]])
    else:
        v, z = value[raw], size[raw]
    ends = np.cumsum(z)
    place = np.arange(ends[-1], dtype="u4") - np.repeat((ends - z).astype("u4"), z)
    pixel_bits = (np.repeat(v, z) >> place).astype("u1") & 1
    head = np.unpackbits(np.frombuffer(out.value.to_bytes((out.size + 7) // 8, "little"), "u1"), count=out.size, bitorder="little")
    body = np.packbits(np.concatenate([head, pixel_bits]), bitorder="little").tobytes()
    pad = len(body) & 1
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + bytes(pad)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def encode_payload(data: bytes) -> bytes:
    """WebP files one after another, each of at most MAX_SIDE rows."""
    step = WIDTH * MAX_SIDE
    return b"".join(encode_grey(data[at : at + step]) for at in range(0, len(data), step))


def decode_payload(media: bytes) -> np.ndarray:
    """[rows, WIDTH] grey samples of the files in media."""
    parts, at = [], 0
    while at < len(media):
        size = 8 + int.from_bytes(media[at + 4 : at + 8], "little")
        pixels = decode(media[at : at + size])
        grey = (pixels & 255).astype("u1")
        if not ((pixels >> 8 & 255 == grey) & (pixels >> 16 & 255 == grey)).all():
            raise Damaged("not a grey image")
        parts.append(grey)
        at += size
    if not parts:
        raise Damaged("no image")
    return np.concatenate(parts)
