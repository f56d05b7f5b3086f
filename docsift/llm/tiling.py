"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.tokens import slices

#: Words of a seed, and of the shortest tile.
SEED = 4
#: Share of an item's words that tiles must cover.
COVERAGE = 0.5
#: Text bytes of the items of one block, which is sent to every task; more make more passes over the documents.
BLOCK_BYTES = 16 << 20
_WORD = re.compile(r"\w+")
_BASE, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))  # the base is odd, so it has one
SCHEMA = "doc_id long, item_id long, item_words int, matched int, coverage double, tiles array<struct<doc_at:int,item_at:int,length:int>>"


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


class Prefixes:
    """Running Karp-Rabin hashes of a sequence of ids: one pass, then any window's hash is two look-ups."""

    def __init__(self, ids: np.ndarray):
        values = (ids.astype("u8") + np.uint64(1)) * _STEP
        n = len(ids)
        self.inverse = _powers(_INVERSE, n)
        with np.errstate(over="ignore"):  # h[i] = sum of values[j] * BASE**-j, so that a window is a difference times a power
            self.sums = np.concatenate([np.zeros(1, "u8"), np.cumsum(values * self.inverse, dtype="u8")])
            self.powers = _powers(_BASE, n)

    def windows(self, size: int) -> np.ndarray:
        """Hashes of all windows of ``size`` ids; equal windows have equal hashes wherever they stand."""
        if size > len(self.powers):
            return np.zeros(0, "u8")
        return (self.sums[size:] - self.sums[:-size]) * self.powers[: len(self.sums) - size]


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(min(1, n), "u8"), np.full(max(0, n - 1), base, "u8")]), dtype="u8")


def seeds_of(ids: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` ids."""
    return Prefixes(ids).windows(size)


def tiles(text: np.ndarray, item: np.ndarray, least: int = SEED) -> list[tuple[int, int, int]]:
    """Maximal non-overlapping matches (text_at, item_at, length) of at least ``least`` ids, the longest first.

    Negative ids of the text match nothing. Windows of a search length are hashed on both sides
    where unmarked; equal hashes are compared and extended. A match over twice the search
    length starts the search again at its own length; else matches are marked from the
    longest down (of equals the first of the item, then of the text), and the search length is
    halved until ``least``.
    """
    free_text, free_item = text >= 0, np.ones(len(item), bool)
    hashes = Prefixes(text), Prefixes(item)
    out: list[tuple[int, int, int]] = []
    size = max(least, len(item) // 2)
    while True:
        found = _matches(text, item, free_text, free_item, hashes, size)
        longest = max((m[2] for m in found), default=0)
        if longest > 2 * size:
            size = longest
            continue
        again = False
        for a, b, n in sorted(found, key=lambda m: (-m[2], m[1], m[0])):
            if free_text[a : a + n].all() and free_item[b : b + n].all():
                free_text[a : a + n] = free_item[b : b + n] = False
                out.append((a, b, n))
            else:
                again = True  # what is left of it may still be long enough
        if again and len(_open_windows(free_item, size)):
            continue
        if size == least:
            return out
        size = max(least, size // 2)


def _open_windows(free: np.ndarray, size: int) -> np.ndarray:
    """Starts of the windows without a marked place."""
    if len(free) < size:
        return np.zeros(0, "i8")
    marked = np.concatenate([[0], np.cumsum(~free)])
    return np.flatnonzero(marked[size:] == marked[:-size])


def _run_ends(free: np.ndarray) -> np.ndarray:
    """For each place the next marked one."""
    return np.minimum.accumulate(np.where(free, len(free), np.arange(len(free)))[::-1])[::-1]


def _matches(text: np.ndarray, item: np.ndarray, free_text: np.ndarray, free_item: np.ndarray, hashes: tuple[Prefixes, Prefixes], size: int) -> list[tuple[int, int, int]]:
    """(text_at, item_at, length) of the longest match of each open window of the item that has one."""
    open_text, open_item = _open_windows(free_text, size), _open_windows(free_item, size)
    if not len(open_text) or not len(open_item):
        return []
    ours, theirs = hashes[0].windows(size)[open_text], hashes[1].windows(size)[open_item]
    order = np.argsort(ours, kind="stable")
    ours, open_text = ours[order], open_text[order]
    low, high = np.searchsorted(ours, theirs, "left"), np.searchsorted(ours, theirs, "right")
    hit = np.flatnonzero(high > low)
    if not len(hit):
        return []
    end_text, end_item = _run_ends(free_text), _run_ends(free_item)
    out: list[tuple[int, int, int]] = []
    reach: dict[int, int] = {}  # by difference of places: how far the last match went, whose later windows are parts of it
    for k in hit.tolist():
        b, best = int(open_item[k]), None
        for a in open_text[low[k] : high[k]].tolist():
            done = reach.get(a - b, 0)
            if done >= b + size:
                n = done - b
            else:
                most = min(int(end_text[a]) - a, int(end_item[b]) - b)
                differ = np.flatnonzero(text[a : a + most] != item[b : b + most])
                n = int(differ[0]) if len(differ) else most
                reach[a - b] = b + n
            if n >= size and (best is None or n > best[2]):
                best = (a, b, n)
        if best:
            out.append(best)
    return out


@dataclass
class Benchmark:
    """Items as ids of their own vocabulary, and their seeds in order, by seed length.

    The seed length is SEED. An item of fewer words is one seed of its own length, and only a
    text of just these words holds it, as so short a run stands in many clean texts.
    """

    items: list[tuple[int | None, np.ndarray]]
    vocabulary: dict[str, int]
    seeds: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Benchmark:
        vocabulary: dict[str, int] = {}
        items, by_size = [], defaultdict(list)
        for item, text in rows:
            ids = np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(text)], "i8")
            if len(ids):
                size = min(SEED, len(ids))
                found = seeds_of(ids, size)
                by_size[size].append((found, np.full(len(found), len(items))))
                items.append((item, ids))
        seeds = {}
        for size, pairs in by_size.items():
            hashes, owners = (np.concatenate(x) for x in zip(*pairs, strict=True))
            order = np.argsort(hashes, kind="stable")
            seeds[size] = hashes[order], owners[order]
        return cls(items, vocabulary, seeds)

    def check(self, texts: list[str | None]) -> Iterator[tuple[int, int, float, list[tuple[int, int, int]]]]:
        """(text's index, item's index, coverage, tiles) of all pairs that share a seed."""
        if not self.items:
            return
        get, split = self.vocabulary.get, [words_of(t) for t in texts]
        ids = np.array([get(w, -1) for words in split for w in [*words, ""]], "i8")  # "" ends each text
        ends = np.cumsum([len(words) + 1 for words in split])
        prefixes = Prefixes(ids)
        for size, (seeds, owners) in sorted(self.seeds.items()):
            whole = _open_windows(ids >= 0, size)
            if not len(whole):
                continue
            hashes = prefixes.windows(size)[whole]
            first, last = np.searchsorted(seeds, hashes, "left"), np.searchsorted(seeds, hashes, "right")
            hit = last > first
            places: dict[tuple[int, int], list[int]] = defaultdict(list)
            for at, a, b, k in zip(whole[hit].tolist(), first[hit].tolist(), last[hit].tolist(), np.searchsorted(ends, whole[hit], "right").tolist(), strict=True):
                for owner in set(owners[a:b].tolist()):
                    places[k, owner].append(at)
            for (k, owner), starts in places.items():
                item, begin = self.items[owner][1], int(ends[k]) - len(split[k]) - 1
                if size < SEED and len(split[k]) != size:
                    continue
                text, back = self._seeded(ids, np.array(starts), size, begin)
                found = [(int(back[a]), b, n) for a, b, n in tiles(text, item, size)]
                yield k, owner, sum(n for *_, n in found) / len(item), found

    @staticmethod
    def _seeded(ids: np.ndarray, starts: np.ndarray, size: int, begin: int) -> tuple[np.ndarray, np.ndarray]:
        """The parts of a text that hold seeds, kept apart by -1, and the places where they stand."""
        covered = np.unique(np.add.outer(starts, np.arange(size)).ravel())
        cuts = np.flatnonzero(np.diff(covered) > 1) + 1
        text = np.insert(ids[covered], cuts, -1)
        return text, np.insert(covered - begin, cuts, -1)


def benchmark_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[Benchmark]:
    """The benchmark in blocks of about block_bytes of text, each small enough to be sent to every task.

    A longer item is a block of its own. Blocks are read one at a time.
    """
    sized = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text", (F.coalesce(F.octet_length("text"), F.lit(0)) + 64).alias("size"))
    blocks = -(-(sized.agg(F.sum("size")).first()[0] or 0) // block_bytes)
    long = F.col("size") > block_bytes // 4
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, blocks)))
    for k in range(blocks):
        rows = sized.where((part == k) & ~long).select("item_id", "text").collect()
        yield Benchmark.of(sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")))
    for row in sized.where(long).select("item_id", "text").toLocalIterator():
        yield Benchmark.of([tuple(row)])


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """SCHEMA rows: each document with each benchmark item that its tiles cover by at least ``coverage``.

    Words ``\\w+`` are compared lower-cased. Tiles may stand in any order, so an item whose
    sentences were moved is found; single shared phrases stay below the threshold. An item of
    under SEED words is held by a text of just these words. Null or empty texts and items match nothing;
    repeated rows and items give a row each; very long texts are scanned whole; of equally long
    tiles the first in the item counts; other columns, whatever their names, aren't read; empty
    tables give no rows.
    """
    spark, out = docs.sparkSession, None
    for block in benchmark_blocks(benchmark, block_bytes):
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for some in slices(batches):
                ids = some.column("doc_id").to_pylist()
                rows = []
                for k, owner, share, found in sent.value.check(some.column("text").to_pylist()):
                    if share >= coverage:
                        item, words = sent.value.items[owner]
                        marks = [{"doc_at": a, "item_at": b, "length": n} for a, b, n in found]
                        rows.append((ids[k], item, len(words), sum(n for *_, n in found), share, marks))
                if rows:
                    yield _batch(rows)

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], SCHEMA) if out is None else out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    mark = pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()), ("length", pa.int32())])
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(mark)]
    names = ["doc_id", "item_id", "item_words", "matched", "coverage", "tiles"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that ``contaminated_pairs`` would name; every column is kept, nothing is shuffled."""
    for block in benchmark_blocks(benchmark, block_bytes):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for some in slices(batches):
                keep = np.ones(some.num_rows, bool)
                for k, _, share, _ in sent.value.check(some.column("text").to_pylist()):
                    keep[k] &= share < coverage
                yield some.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
