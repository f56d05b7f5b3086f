import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docsift.llm import media, webp

TEXT = "The quick brown fox jumps over the lazy dog.\nRepeated line of the page, long enough.\nRepeated line of the page, long enough.\nÄöü 数字\n"


class Image:
    """A small writer of whole images with any coding tool, after the format's description."""

    def __init__(self, argb, cache=0, copies=(), groups=None):
        self.argb, self.cache, self.copies, self.groups = [int(x) for x in argb], cache, dict(copies), groups

    def write(self, out, width, main):
        out.put(1 if self.cache else 0, 1)
        if self.cache:
            out.put(self.cache, 4)
        if main and self.groups is None:
            out.put(0, 1)
        kinds = [0] * len(self.argb)
        if main and self.groups is not None:
            tile, numbers = self.groups
            out.put(1, 1)
            out.put(tile - 2, 3)
            across = -(-width // (1 << tile))
            Image([n << 8 for n in numbers]).write(out, across, False)
            kinds = [numbers[(i // width >> tile) * across + (i % width >> tile)] for i in range(len(self.argb))]
        tokens, cached, at = [], {}, 0
        while at < len(self.argb):
            if at in self.copies:
                size, back = self.copies[at]
                tokens.append((kinds[at], "copy", size, back))
                step = size
            else:
                p = self.argb[at]
                slot = (webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - self.cache) if self.cache else 0
                tokens.append((kinds[at], "cache", slot, 0) if self.cache and cached.get(slot) == p else (kinds[at], "pixel", p, 0))
                step = 1
            for p in self.argb[at : at + step]:
                if self.cache:
                    cached[(webp.CACHE_FACTOR * p & 0xFFFFFFFF) >> (32 - self.cache)] = p
            at += step
        number = max(kinds) + 1
        counts = [[{} for _ in range(5)] for _ in range(number)]

        def split(kind, a, b):
            if kind == "pixel":
                return [(0, a >> 8 & 255, 0, 0), (1, a >> 16 & 255, 0, 0), (2, a & 255, 0, 0), (3, a >> 24, 0, 0)]
            if kind == "cache":
                return [(0, 280 + a, 0, 0)]
            s, e, n = webp.prefix_of(a)
            d, f, m = webp.prefix_of(b)
            return [(0, 256 + s, e, n), (4, d, f, m)]

        for g, kind, a, b in tokens:
            for k, s, _, _ in split(kind, a, b):
                counts[g][k][s] = counts[g][k].get(s, 0) + 1
        sizes = [280 + ((1 << self.cache) if self.cache else 0), 256, 256, 256, 40]
        codes = [[webp.put_code(out, [(n, s) for s, n in c.items()] or [(1, 0)], sizes[k]) for k, c in enumerate(group)] for group in counts]
        for g, kind, a, b in tokens:
            for k, s, extra, n in split(kind, a, b):
                out.put(*codes[g][k][s])
                out.put(extra, n)


def file_of(image, width, height, transforms=(), shown=None):
    out = webp.Writer()
    for value, size in ((webp.SIGNATURE, 8), ((shown or width) - 1, 14), (height - 1, 14), (0, 4)):
        out.put(value, size)
    for kind, write in transforms:
        out.put(1 | kind << 1, 3)
        write(out)
    out.put(0, 1)
    image.write(out, width, True)
    body = out.value.to_bytes((out.size + 7) // 8, "little")
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + bytes(len(body) & 1)
    return b"RIFF" + (4 + len(chunk)).to_bytes(4, "little") + b"WEBP" + chunk


def picture(h, w, seed=0, colours=None):
    rng = np.random.default_rng(seed)
    if colours:
        table = rng.integers(0, 2**32, colours, dtype="u4")
        return table[rng.integers(0, colours, (h, w))]
    base = (np.add.outer(np.arange(h) * 3, np.arange(w) * 5)[..., None] + rng.integers(0, 9, (h, w, 4))) % 256
    return (base[..., 0] << 24 | base[..., 1] << 16 | base[..., 2] << 8 | base[..., 3]).astype("u4")


@pytest.mark.parametrize("cache", [0, 1, 6, 10])
def test_literals_cache_and_copies(cache):
    p = picture(9, 31, colours=20)
    p[4:6] = p[1:3]
    flat = p.ravel().tolist()
    flat[200:230] = [flat[199]] * 30
    copies = {4 * 31: (62, 3 * 31 + 120), 200: (30, 2)}  # code 2 is one pixel to the left
    data = file_of(Image(flat, cache, copies), 31, 9)
    assert webp.decode(data).ravel().tolist() == flat


def test_groups_of_codes():
    p = picture(10, 12, 3)
    data = file_of(Image(p.ravel(), 0, (), (2, [0, 1, 2, 1, 1, 0, 2, 2, 0])), 12, 10)
    assert np.array_equal(webp.decode(data), p)


def test_near_offsets():
    spots = webp.near_offsets()
    assert len(spots) == len(set(spots)) == 120 and spots[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and spots[-3:] == [(-7, 7), (8, 6), (8, 7)]


def channel(p):
    return [p >> 24 & 255, p >> 16 & 255, p >> 8 & 255, p & 255]


def scalar_guess(mode, l, t, tl, tr):
    """One channel's prediction, spelled out."""
    avg = lambda a, b: (a + b) // 2
    clamp = lambda v: max(0, min(255, v))
    half = avg(l, t)
    diff = half - tl
    return {
        1: l, 2: t, 3: tr, 4: tl, 5: avg(avg(l, tr), t), 6: avg(l, tl), 7: avg(l, t), 8: avg(tl, t), 9: avg(t, tr), 10: avg(avg(l, tl), avg(t, tr)),
        12: clamp(l + t - tl), 13: clamp(half + (diff // 2 if diff >= 0 else -(-diff // 2))),
    }[mode]


@pytest.mark.parametrize("mode", range(14))
def test_predictors(mode):
    h, w, tile = 7, 9, 2
    p = picture(h, w, mode + 10)
    residual = np.zeros((h, w), "u4")
    for y in range(h):
        for x in range(w):
            here = channel(int(p[y, x]))
            if y == 0 and x == 0 or (mode == 0 and y and x):
                guess = [255, 0, 0, 0]
            elif y == 0:
                guess = channel(int(p[0, x - 1]))
            elif x == 0:
                guess = channel(int(p[y - 1, 0]))
            else:
                l, t, tl = channel(int(p[y, x - 1])), channel(int(p[y - 1, x])), channel(int(p[y - 1, x - 1]))
                tr = channel(int(p[y, 0] if x == w - 1 else p[y - 1, x + 1]))
                if mode == 11:
                    to_l = sum(abs(a + b - c - a) for a, b, c in zip(l, t, tl))
                    to_t = sum(abs(a + b - c - b) for a, b, c in zip(l, t, tl))
                    guess = l if to_l < to_t else t
                else:
                    guess = [scalar_guess(mode, *v) for v in zip(l, t, tl, tr)]
            d = [(a - b) % 256 for a, b in zip(here, guess)]
            residual[y, x] = d[0] << 24 | d[1] << 16 | d[2] << 8 | d[3]

    def head(out):
        out.put(tile - 2, 3)
        Image([mode << 8] * (-(-h // 4) * -(-w // 4))).write(out, 3, False)

    assert np.array_equal(webp.decode(file_of(Image(residual.ravel()), w, h, [(webp.PREDICTOR, head)])), p)


def test_cross_colour_and_subtract_green():
    h, w, tile = 6, 5, 2
    p = picture(h, w, 77)
    factors = [(200 << 16 | 31 << 8 | 5), (7 << 16 | 250 << 8 | 129), (0), (90 << 16 | 128 << 8 | 255)]
    signed = lambda v: v - 256 if v > 127 else v
    flat = []
    for y in range(h):
        for x in range(w):
            a, r, g, b = channel(int(p[y, x]))
            f = factors[(y >> tile) * 2 + (x >> tile)]
            red_blue, green_blue, green_red = f >> 16 & 255, f >> 8 & 255, f & 255
            r2 = (r - (signed(green_red) * signed(g) >> 5)) % 256
            b2 = (b - (signed(green_blue) * signed(g) >> 5) - (signed(red_blue) * signed(r) >> 5)) % 256
            flat.append(a << 24 | ((r2 - g) % 256) << 16 | g << 8 | ((b2 - g) % 256))

    def head(out):
        out.put(tile - 2, 3)
        Image(factors).write(out, 2, False)

    data = file_of(Image(flat), w, h, [(webp.CROSS_COLOUR, head), (webp.SUBTRACT_GREEN, lambda out: None)])
    assert np.array_equal(webp.decode(data), p)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palettes(colours):
    h, w = 5, 13
    table = np.random.default_rng(colours).integers(0, 2**32, colours, dtype="u4")
    index = np.random.default_rng(1).integers(0, colours, (h, w))
    pack = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    narrow, depth = -(-w // (1 << pack)), 8 >> pack
    flat = [sum(int(index[y, x]) << depth * (x % (1 << pack)) for x in range(c << pack, min(w, (c + 1) << pack))) << 8 for y in range(h) for c in range(narrow)]
    deltas, before = [], [0] * 4
    for colour in table.tolist():
        now = channel(colour)
        d = [(a - b) % 256 for a, b in zip(now, before)]
        deltas.append(d[0] << 24 | d[1] << 16 | d[2] << 8 | d[3])
        before = now

    def head(out):
        out.put(colours - 1, 8)
        Image(deltas).write(out, colours, False)

    assert np.array_equal(webp.decode(file_of(Image(flat), narrow, h, [(webp.PALETTE, head)], shown=w)), table[index])


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.integers(1, 6))
def test_payloads_round_trip(data, times):
    data = media.padded(b"\n".join([data] * times))
    assert webp.decode_payload(webp.encode_payload(data)).tobytes() == data


def test_fast_path_is_the_plain_one(monkeypatch):
    data = media.padded((TEXT * 30).encode())
    stored = webp.encode_payload(data)
    assert len(stored) < len(data) / 3  # lines are copied
    monkeypatch.setattr(webp, "_green_only", lambda bits, group, width, total: webp._pixels(bits, [group], None, 0, 0, width, total))
    assert webp.decode_payload(stored).tobytes() == data


@pytest.mark.parametrize("size", [0, 64, 63, 2 << 20])
def test_sizes(size):
    data = media.padded(bytes(i * 31 % 97 for i in range(size)))
    stored = webp.encode_payload(data)
    assert webp.decode_payload(stored).tobytes() == data and stored.count(b"VP8L") >= max(1, size >> 20)


def test_damage_is_reported():
    stored = webp.encode_payload(media.padded(TEXT.encode()))
    for bad in (b"", b"RIFF", stored[:40], stored[:-30], stored[:20] + b"\0" + stored[21:], b"x" * 100, stored[:16] + b"\x20\0\0\0" + stored[20:]):
        with pytest.raises(webp.Damaged):
            webp.decode_payload(bad)


def test_media_table(spark):
    rows = [(1, TEXT, "", ""), (2, None, None, None), (3, "", "", ""), (4, TEXT, "", ""), (None, "x" * 64, "", ""), (5, "long " * 300000, "", ""), (5, "y", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, media string, n_bytes string")
    found = media.round_trip(docs).collect()
    assert len(found) == len(rows) and all(r["error"] is None for r in found)
    expected = sorted((-1 if d is None else d, len((t or "").encode()), hashlib.sha256(p := media.padded((t or "").encode())).hexdigest(), len(p), zlib.crc32(p[-64:])) for d, t, *_ in rows)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_bytes"], r["payload_sha256"], r["payload_bytes"], r["tail_crc32"]) for r in found) == expected
    same = [(r["media_sha256"], r["feature"], r["media_bytes"]) for r in found if r["doc_id"] in (1, 4)]
    assert same[0] == same[1] and len(same[0][1]) == 16
    bad = media.decode_media(spark.createDataFrame([(1, 0, bytearray(b"junk")), (2, 0, None)], "doc_id long, n_bytes long, media binary"), with_pixels=True).collect()
    assert all(r["error"] and r["pixels"] is None for r in bad)
    assert media.round_trip(docs.limit(0)).count() == 0
