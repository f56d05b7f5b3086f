"""Sets of five-word shingles of whole texts, as 64-bit hashes, computed over Arrow buffers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash

WORDS = 5
_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Words longer than this are hashed one by one.
LONG_WORD = 32


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(32))) * _MIX
    return h ^ (h >> np.uint64(32))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row, and each text's bounds; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, "i8")[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1")
    return raw[bounds[0] : bounds[-1]], bounds - bounds[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, and each text's bounds among them."""
    raw, bounds = buffers(texts)
    if not len(raw):
        return np.zeros(0, "u8"), np.zeros(len(bounds), "i8")
    data, ink = _LOWER[raw], ~_WHITE[raw]
    cut = np.zeros(len(raw) + 1, bool)  # a text begins here
    cut[bounds] = True
    before = np.concatenate([[False], ink[:-1]]) & ~cut[:-1]
    after = np.concatenate([ink[1:], [False]]) & ~cut[1:]
    starts, ends = np.flatnonzero(ink & ~before), np.flatnonzero(ink & ~after) + 1
    sizes = ends - starts
    h = sizes.astype("u8") * _STEP
    live = np.flatnonzero(sizes <= LONG_WORD)
    for k in range(LONG_WORD):
        live = live[sizes[live] > k]
        if not len(live):
            break
        h[live] = (h[live] ^ (data[starts[live] + k].astype("u8") + np.uint64(1))) * _STEP
        h[live] ^= h[live] >> np.uint64(29)
    for i in np.flatnonzero(sizes > LONG_WORD):
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return _mix(h), np.searchsorted(starts, bounds)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after another, and their bounds.

    A text of one to four words has one shingle, its whole sequence; one without words has none.
    """
    words, bounds = word_hashes(texts)
    counts = np.diff(bounds)
    many = np.where(counts >= WORDS, counts - WORDS + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(many)])
    out = np.empty(at[-1], "u8")
    if len(words) >= WORDS:
        acc = words[: len(words) - WORDS + 1].copy()
        for j in range(1, WORDS):
            acc = acc * _STEP + words[j : len(words) - WORDS + 1 + j]
        acc = _mix(acc)
    full = counts >= WORDS
    if full.any():
        take = np.arange(int(many[full].sum()))
        shift = np.repeat(bounds[:-1][full] - np.concatenate([[0], np.cumsum(many[full])[:-1]]), many[full])
        out[np.repeat(full, many)] = acc[take + shift]
    for n in range(1, WORDS):
        short = np.flatnonzero(counts == n)
        if len(short):
            acc1 = np.full(len(short), n, "u8")
            for j in range(n):
                acc1 = acc1 * _STEP + words[bounds[short] + j]
            out[at[short]] = _mix(acc1 + np.uint64(n))
    for a, b in zip(at[:-1][many > 1], at[1:][many > 1], strict=True):
        out[a:b].sort()
    fresh = np.ones(len(out), bool)
    fresh[1:] = out[1:] != out[:-1]
    fresh[at[:-1][many > 0]] = True
    kept = np.concatenate([[0], np.cumsum(fresh)])
    return out[fresh], kept[at]


def signature(shingles: np.ndarray) -> bytes:
    """128 bits that stand for a whole set."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
