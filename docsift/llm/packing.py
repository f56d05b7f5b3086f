"""Packing token ids into training sequences of several context sizes."""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from docsift.llm.tokens import END_ID, encoder, slices

TIERS = (256, 512, 1024, 2048)
#: Ids packed together; what doesn't fill a window is carried into the next block.
BLOCK_IDS = 2_000_000
#: Ids per step group: so many long windows' worth.
STEP_WINDOWS = 64
SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
    "tier int, step_group long"
)


@dataclass(order=True)
class Piece:
    """Ids [start, start + length) of a document."""

    length: int
    serial: int
    doc: int | None
    start: int
    doc_tokens: int
    ids: bytes  # of the whole document

    def cut(self, length: int, serial: int) -> tuple[Piece, Piece]:
        head = Piece(length, self.serial, self.doc, self.start, self.doc_tokens, self.ids)
        return head, Piece(self.length - length, serial, self.doc, self.start + length, self.doc_tokens, self.ids)


class Packer:
    """Packs pieces so that every window is exactly full, tier by tier from the longest."""

    def __init__(self, tiers: Sequence[int] = TIERS):
        if list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers):
            raise ValueError("tiers must be ascending powers of two")
        self.tiers, self.top, self.serial = list(tiers), tiers[-1], 0
        self.waiting: list[list[Piece]] = [[] for _ in tiers]  # by tier, ascending by length

    def add(self, doc: int | None, ids: bytes) -> list[list[Piece]]:
        """Full long windows leave at once; the rest waits in the smallest tier that holds it."""
        n, out = len(ids) // 4, []
        for start in range(0, n, self.top):
            self.serial += 1
            piece = Piece(min(self.top, n - start), self.serial, doc, start, n, ids)
            if piece.length == self.top:
                out.append([piece])
            else:
                self._wait(piece)
        return out

    def _tier(self, length: int) -> int:
        return next(i for i, t in enumerate(self.tiers) if length <= t)

    def _wait(self, piece: Piece) -> None:
        insort(self.waiting[self._tier(piece.length)], piece)

    def _fill(self, window: list[Piece], gap: int, below: int) -> int:
        """Fill a gap: whole pieces first, the longest that fit, from this tier downwards; then one that is cut."""
        while gap:
            for t in range(min(below, self._tier(gap)), -1, -1):
                at = bisect_right(self.waiting[t], gap, key=lambda p: p.length)
                if at:
                    piece = self.waiting[t].pop(at - 1)
                    break
            else:
                t = next((t for t in range(below + 1) if self.waiting[t]), None)
                if t is None:
                    return gap
                piece, rest = self.waiting[t].pop(0).cut(gap, self.serial + 1)
                self.serial += 1
                self._wait(rest)
            window.append(piece)
            gap -= piece.length
        return 0

    def windows(self) -> list[list[Piece]]:
        """All the windows that the waiting pieces fill; what cannot fill one stays."""
        out = []
        for t in range(len(self.tiers) - 1, -1, -1):
            size = self.tiers[t]
            floor = 0 if t == 0 else self.tiers[t - 1]
            while self.waiting[t] and sum_at_least(self.waiting[: t + 1], size):
                first = self.waiting[t].pop()  # the longest
                window = [first]
                left = self._fill(window, size - first.length, t)
                assert not left and floor < first.length <= size
                out.append(window)
        return out

    def rest(self) -> list[list[Piece]]:
        """The last ids, in windows of falling powers of two, so that these need no padding either."""
        out, pieces = [], [p for tier in self.waiting for p in tier]
        self.waiting = [[] for _ in self.tiers]
        total = sum(p.length for p in pieces)
        while total:
            size = min(self.top, 1 << (total.bit_length() - 1))
            window, room = [], size
            while room:
                piece = pieces.pop()
                if piece.length > room:
                    self.serial += 1
                    piece, later = piece.cut(room, self.serial)
                    pieces.append(later)
                window.append(piece)
                room -= piece.length
            out.append(window)
            total -= size
        return out


def sum_at_least(tiers: list[list[Piece]], size: int) -> bool:
    total = 0
    for tier in tiers:
        for piece in tier:
            total += piece.length
            if total >= size:
                return True
    return False


def step_groups(sizes: Sequence[int], step: int) -> list[int]:
    """A group number for each window: the longest first, each to the group with the fewest ids."""
    count = max(1, -(-sum(sizes) // step))
    heap, out = [(0, g) for g in range(count)], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        load, group = heapq.heappop(heap)
        out[i] = group
        heapq.heappush(heap, (load + sizes[i], group))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, tiers: Sequence[int] = TIERS) -> DataFrame:
    """One row per piece: SCHEMA; ids are the piece's ids as little-endian uint32.

    Documents are tokenised and packed where they are read, without a shuffle, so every
    task packs its own rows and a lost task packs the same rows again. A document's ids and
    the end id are cut freely: full long windows first, the remainder goes to the smallest
    context tier that holds it. Each tier, from the longest, starts a window with its longest
    piece and fills the gap with the longest pieces that fit, of this tier and shorter ones,
    cutting one where none fits. The last ids of a task go to windows of falling powers of two;
    no window needs padding. Windows of a block are dealt to step groups with almost equal
    ids. Null texts are empty (the end id alone); null or repeated doc_ids and repeated
    rows are documents of their own; very long texts give many windows; an empty table
    gives no rows; other columns aren't read.
    """
    tiers = tuple(tiers)
    end = np.array([END_ID], "<u4").tobytes()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        own, packer = encoder(tokenizer), Packer(tiers)
        sequence = group = held = 0
        done: list[list[Piece]] = []

        def emit(windows: list[list[Piece]]) -> Iterator[pa.RecordBatch]:
            nonlocal sequence, group
            sizes = [sum(p.length for p in w) for w in windows]
            groups = step_groups(sizes, STEP_WINDOWS * tiers[-1])
            rows: list[tuple] = []
            for window, size, g in zip(windows, sizes, groups, strict=True):
                offset = 0
                for p in window:
                    ids = p.ids[4 * p.start : 4 * (p.start + p.length)]
                    rows.append((p.doc, p.start, p.length, ids, p.doc_tokens, base + sequence, offset, size, base + group + g))
                    offset += p.length
                sequence += 1
            group += max(groups, default=-1) + 1
            for at in range(0, len(rows), 2000):
                yield _batch(rows[at : at + 2000])

        for some in slices(batches):
            texts = own.encode(some.column("text").to_pylist())
            for doc, ids in zip(some.column("doc_id").to_pylist(), texts, strict=True):
                done += packer.add(doc, ids + end)
                held += len(ids) // 4 + 1
            if held >= BLOCK_IDS:
                yield from emit(done + packer.windows())
                done, held = [], 0
        yield from emit(done + packer.windows() + packer.rest())

    return docs.selectExpr("cast(doc_id AS long) AS doc_id", "text").mapInArrow(pack, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
