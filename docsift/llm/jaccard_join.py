"""N-gram Jaccard self-join with adaptive multi-match prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsift.llm.components import connected_components
from docsift.llm.shared import drop_table, materialize, release
from docsift.llm.shingles import buffers, shingle_sets, signature
from docsift.llm.tokens import encoder, slices

#: Similar: 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Matches that a document may ask for; see ``choose_matches``.
MATCHES = (1, 2, 3, 4, 6, 8, 12, 16)
#: Tokens in at most so many documents pair them directly; others make families.
LIGHT = 8
#: Text bytes of a work group, and of the texts whose shingles one counting bucket holds, up to USUAL_BYTES of input.
GROUP_BYTES, BUCKET_BYTES = 2 << 20, 12 << 20
#: Beyond it both grow with the square root of the input, up to so many times: what fits a task's memory.
USUAL_BYTES, MOST_TIMES = 64 << 30, 8
#: Documents and shingles of one block of a family.
BLOCK_DOCS, BLOCK_SHINGLES = 1024, 1_000_000
#: Bytes of a Parquet row group of tables with texts or sets: what a task holds of them at once.
ROWS_BYTES = 8 << 20
#: Tokens that a block pair or a counting bucket sorts at once; more are dealt into parts by their lower bits.
PART_TOKENS = 1 << 18
#: Frequencies are exact up to here, then in eighths of a doubling.
EXACT = 127
SET_SCHEMA = "doc_id long, n long, sig binary, matches int, prefix array<long>, classes array<int>, shingles binary"


def least_overlap(n: int | np.ndarray):
    """Fewest shingles that a set of n shares with any similar set."""
    return -(-PERCENT * n // 100)


def similar(common: int | np.ndarray, n: int | np.ndarray, m: int | np.ndarray):
    return 100 * common >= PERCENT * (n + m - common)


def frequency_class(df: np.ndarray) -> np.ndarray:
    """One byte that never falls as the frequency rises; the frequency itself up to EXACT."""
    over = np.ceil(8 * np.log2(np.maximum(df, EXACT) / EXACT))
    return np.where(df <= EXACT, df, np.minimum(255, EXACT + over)).astype("u1")


def class_frequency(classes: np.ndarray) -> np.ndarray:
    c = classes.astype("f8")
    return np.where(c <= EXACT, c, EXACT * 2 ** ((c - EXACT) / 8))


def choose_matches(n: int, rare: int, frequencies: np.ndarray) -> tuple[int, int]:
    """(matches, prefix tokens) of least estimated cost.

    frequencies: of the set's shared tokens in the global order; ``rare`` tokens that no other
    document has stand before them. Asking for k matches takes a prefix of
    n - least_overlap(n) + k tokens; its frequencies sum to the postings that are read, each
    candidate uses up k of these, and a candidate costs a verification.
    """
    base = n - int(least_overlap(n)) - rare
    reads = np.concatenate([[0.0], np.cumsum(frequencies - 1)])
    best = (math.inf, 1, base + 1)
    for k in MATCHES:
        if base + k > len(frequencies):
            break
        cost = reads[base + k] * (1 + n / 8 / k)
        if cost < best[0]:
            best = (cost, k, base + k)
    return best[1], best[2]


def work_sizes(size: int) -> tuple[int, int]:
    """(text bytes of a work group, bits of a counting bucket's number) for so many bytes of text.

    A group has an entry for each bucket that it has shingles of; sizes that grow with the
    input keep an entry's shingles many for longer. There are never more entries than shingles.
    """
    times = min(MOST_TIMES, max(1.0, math.sqrt(size / USUAL_BYTES)))
    return int(GROUP_BYTES * times), max(4, math.ceil(math.log2(max(1, size / (BUCKET_BYTES * times)))))


def grouped(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """A written table of work groups: g, bytes, doc_id (list), text (list); each about group_bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()
        base, n, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def pack() -> pa.RecordBatch:
            some = pa.Table.from_batches(held).combine_chunks()
            ends = pa.array([0, some.num_rows], pa.int32())
            lists = [pa.ListArray.from_arrays(ends, some.column(c).chunk(0)) for c in ("doc_id", "text")]
            return pa.record_batch([pa.array([base + n]), pa.array([size]), *lists], names=["g", "bytes", "doc_id", "text"])

        for batch in batches:
            for some in slices([batch], limit=group_bytes // 4):
                held.append(some)
                size += some.column("text").nbytes
                if size >= group_bytes:
                    yield pack()
                    n, held, size = n + 1, [], 0
        if size or held:
            yield pack()

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return materialize(narrow.mapInArrow(run, "g long, bytes long, doc_id array<long>, text array<string>"), "jaccard-groups", block_rows=max(1, ROWS_BYTES // group_bytes))


def _keys(shingles: np.ndarray, bits: int) -> np.ndarray:
    """The upper bits of a hash: bucket and 32-bit fingerprint. A rare collision only raises a frequency."""
    return shingles >> np.uint64(32 - bits)


def parts_of(tokens: np.ndarray) -> Iterator[np.ndarray]:
    """Places of the tokens, in parts of about PART_TOKENS; equal tokens are in one part."""
    parts = 1 << max(0, math.ceil(math.log2(max(1, len(tokens)) / PART_TOKENS)))
    for k in range(parts):
        yield np.flatnonzero((tokens & tokens.dtype.type(parts - 1)) == k) if parts > 1 else np.arange(len(tokens))


def count_tokens(groups: DataFrame, bits: int) -> DataFrame:
    """(g, bucket, classes): for each group, the frequency classes of its distinct tokens in ascending order.

    Groups count their own tokens first, so that a token in a third of all documents is one
    entry per group; then buckets of the hash range are counted, each in one task.
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, texts in zip(batch.column("g").to_pylist(), batch.column("text"), strict=True):
                keys, counts = np.unique(_keys(shingle_sets(texts.values)[0], bits), return_counts=True)
                of, starts = np.unique(keys >> np.uint64(32), return_index=True)
                prints, counts = keys.astype("<u4"), np.minimum(counts, 2**16 - 1).astype("<u2")
                rows = [(b, prints[x:y].tobytes(), counts[x:y].tobytes()) for b, x, y in zip(of.tolist(), starts, np.append(starts[1:], len(keys)), strict=False)]
                if rows:
                    buckets, ids, sizes = zip(*rows, strict=True)
                    yield pa.record_batch([pa.array([g] * len(rows)), pa.array(buckets, pa.int32()), pa.array(ids), pa.array(sizes)], names=["g", "bucket", "prints", "counts"])

    def total(table: pa.Table) -> pa.Table:
        prints, bounds = buffers(table.column("prints"))
        prints, counts = prints.view("<u4"), buffers(table.column("counts"))[0].view("<u2")
        flags = np.empty(len(prints), "u1")
        for at in parts_of(prints):
            _, inverse = np.unique(prints[at], return_inverse=True)
            flags[at] = frequency_class(np.bincount(inverse, weights=counts[at]))[inverse]
        classes = pa.Array.from_buffers(pa.binary(), len(table), [None, pa.py_buffer((bounds // 4).astype("i4")), pa.py_buffer(flags)])
        return pa.table({"g": table.column("g"), "bucket": table.column("bucket"), "classes": classes})

    counted = groups.select("g", "text").mapInArrow(local, "g long, bucket int, prints binary, counts binary")
    return counted.groupBy("bucket").applyInArrow(total, "g long, bucket int, classes binary")


def document_sets(groups: DataFrame, classes: DataFrame, bits: int) -> DataFrame:
    """SET_SCHEMA rows per document; matches, prefix, classes and shingles only where a similar set can exist."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        order = np.argsort(right.column("bucket").to_numpy())
        flags = right.column("classes").to_pylist()
        known = np.frombuffer(b"".join(flags[i] for i in order), "u1")
        for ids, texts in zip(left.column("doc_id").combine_chunks(), left.column("text").combine_chunks(), strict=True):
            flat, bounds = shingle_sets(texts.values)
            keys = _keys(flat, bits)
            own = known[np.searchsorted(np.unique(keys), keys)]
            for doc, a, b in zip(ids.values.to_pylist(), bounds, bounds[1:], strict=False):
                n, tokens, cls = int(b - a), flat[a:b], own[a:b]
                sig = signature(tokens) if n else None
                shared = np.flatnonzero(cls > 1)
                if not n or len(shared) < least_overlap(n):
                    rows.append((doc, n, sig, None, None, None, None))
                    continue
                shared = shared[np.lexsort((tokens[shared], cls[shared]))]
                k, size = choose_matches(n, n - len(shared), class_frequency(cls[shared]))
                first = shared[:size]
                rows.append((doc, n, sig, k, tokens[first].view("i8"), cls[first].astype("i4"), tokens.tobytes()))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
        names = [c.split()[0] for c in SET_SCHEMA.split(", ")]
        columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
        return pa.table([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return groups.groupBy("g").cogroup(classes.groupBy("g")).applyInArrow(run, SET_SCHEMA)


def light_pairs(reps: DataFrame) -> DataFrame:
    """(x, y): pairs with enough common prefix tokens among those of at most LIGHT documents.

    A token's documents are at most LIGHT, so a token gives a bounded number of pairs.
    """
    zipped = F.filter(F.arrays_zip("prefix", "classes"), lambda t: t["classes"] <= LIGHT)
    postings = reps.select("doc_id", "n", "matches", F.explode(zipped).alias("t"))
    lists = postings.groupBy(F.col("t.prefix").alias("token")).agg(F.collect_set(F.struct("doc_id", "n", "matches")).alias("d"))
    lists = lists.where("size(d) > 1").select(F.array_sort("d").alias("d"))
    pairs = lists.select("d", F.posexplode("d").alias("i", "x")).select("x", F.explode(F.expr("slice(d, i + 2, size(d))")).alias("y"))
    pairs = pairs.where(f"100 * least(x.n, y.n) >= {PERCENT} * greatest(x.n, y.n) AND x.doc_id <> y.doc_id")
    found = pairs.groupBy(F.col("x.doc_id").alias("x"), F.col("y.doc_id").alias("y")).agg(
        F.count(F.lit(1)).alias("common"), F.min(F.least("x.matches", "y.matches")).alias("asked")
    )
    return found.where("common >= asked").select("x", "y")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose whole sets are similar. sets: doc_id, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("sx"), batch.column("sy"), strict=True):
                p, q = np.frombuffer(a.as_buffer(), "u8"), np.frombuffer(b.as_buffer(), "u8")
                keep.append(bool(similar(len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q))))
            yield pa.record_batch([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(keep, pa.bool_()))

    x = sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("sx"))
    y = sets.select(F.col("doc_id").alias("y"), F.col("shingles").alias("sy"))
    return pairs.join(x, "x").join(y, "y").select("x", "y", "sx", "sy").mapInArrow(run, "x long, y long")


def families(reps: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(doc_id, family, block, blocks) of documents with a prefix token of more than LIGHT documents, and the tables it reads.

    A family is a component of documents and such tokens, found without pairing documents;
    its blocks are of about BLOCK_DOCS documents and BLOCK_SHINGLES shingles.
    """
    heavy = F.filter(F.arrays_zip("prefix", "classes"), lambda t: t["classes"] > LIGHT)
    edges = reps.select(
        F.xxhash64(F.lit("document"), "doc_id").alias("a"), F.explode(F.transform(heavy, lambda t: F.xxhash64(F.lit("token"), t["prefix"]))).alias("b")
    )
    roots = connected_components(edges)
    members = reps.select("doc_id", "n", F.xxhash64(F.lit("document"), "doc_id").alias("node")).join(roots, "node").select("doc_id", "n", F.col("root").alias("family"))
    members = materialize(members.distinct(), "jaccard-members")
    sizes = members.groupBy("family").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles")).where("docs > 1")
    sizes = sizes.select("family", F.ceil(F.greatest(F.col("docs") / BLOCK_DOCS, F.col("shingles") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    sizes = materialize(sizes, "jaccard-sizes")
    placed = members.join(sizes, "family")
    placed = placed.select("doc_id", "family", F.pmod(F.xxhash64(F.lit("block"), "doc_id"), F.col("blocks")).cast("int").alias("block"), "blocks")
    return placed, [roots, members, sizes]


def family_links(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(x, y): links that join what is similar within each family; every pair of blocks is one bounded task.

    sets: doc_id, n, matches, prefix, shingles. A pair of blocks counts common prefix tokens,
    verifies pairs with as many as asked, and returns a spanning forest of its links.
    """

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("doc_id").to_numpy()
        side = table.column("block").to_numpy()
        low, high = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        prefixes = [p.values.to_numpy() for p in table.column("prefix")]
        sets_ = [np.frombuffer(s.as_buffer(), "i8") for s in table.column("shingles")]
        asked, n = table.column("matches").to_numpy(), table.column("n").to_numpy()
        rows, columns = np.flatnonzero(side == low), np.flatnonzero(side == high)
        common = overlap(prefixes, rows, columns)
        ok = common >= np.minimum(asked[rows][:, None], asked[columns][None])
        small, large = np.minimum(n[rows][:, None], n[columns][None]), np.maximum(n[rows][:, None], n[columns][None])
        ok &= 100 * small >= PERCENT * large
        if low == high:
            ok &= rows[:, None] < columns[None]
        keep_r, keep_c = rows[ok.any(1)], columns[ok.any(0)]
        ok = ok[ok.any(1)][:, ok.any(0)]
        links = []
        if len(keep_r):
            whole = overlap(sets_, keep_r, keep_c)
            a, b = np.nonzero(ok & similar(whole, n[keep_r][:, None], n[keep_c][None]))
            links = forest(ids[keep_r[a]].tolist(), ids[keep_c[b]].tolist())
        x, y = zip(*links, strict=True) if links else ((), ())
        return pa.table({"x": pa.array(x, pa.int64()), "y": pa.array(y, pa.int64())})

    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = placed.select("doc_id", "family", "block", other.alias("o")).select("doc_id", "family", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"))
    full = dealt.join(sets.select("doc_id", "n", "matches", "prefix", "shingles"), "doc_id")
    return full.groupBy("family", "i", "j").applyInArrow(run, "x long, y long")


def overlap(sets_: list[np.ndarray], rows: np.ndarray, columns: np.ndarray, width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of two lists of different sets, by products of membership matrices.

    Tokens are taken in parts and these in ranges of ``width``, so only the result grows with more than the sets.
    """
    used = np.unique(np.concatenate([rows, columns]))
    flat = np.concatenate([sets_[i] for i in used])
    owner = np.repeat(used.astype("i4"), [len(sets_[i]) for i in used])
    at_row, at_column = np.full(len(sets_), -1), np.full(len(sets_), -1)
    at_row[rows], at_column[columns] = np.arange(len(rows)), np.arange(len(columns))
    out = np.zeros((len(rows), len(columns)), "i8")
    for part in parts_of(flat):
        _, codes, counts = np.unique(flat[part], return_inverse=True, return_counts=True)
        shared = counts[codes] > 1
        codes, who = (np.cumsum(counts > 1) - 1)[codes[shared]], owner[part[shared]]
        order = np.argsort(codes, kind="stable")
        codes, who = codes[order], who[order]
        top = int(codes.max(initial=-1)) + 1
        for first in range(0, top, width):
            a, b = np.searchsorted(codes, [first, first + width])
            left, right = (np.zeros((k, min(width, top - first)), "f4") for k in out.shape)
            for matrix, place in ((left, at_row), (right, at_column)):
                at = place[who[a:b]]
                matrix[at[at >= 0], codes[a:b][at >= 0] - first] = 1
            out += (left @ right.T).astype("i8")
    return out


def forest(x: list[int], y: list[int]) -> list[tuple[int, int]]:
    """A spanning forest of the links."""
    up: dict[int, int] = {}

    def find(v: int) -> int:
        while up.setdefault(v, v) != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    out = []
    for a, b in zip(x, y, strict=True):
        p, q = find(a), find(b)
        if p != q:
            up[p] = q
            out.append((a, b))
    return out


def jaccard_components(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id per row of docs.

    A document is what carries one doc_id: rows that repeat an id are joined in one component.
    Equal sets are joined through the least doc_id that has them and compared once. Null and
    empty texts have an empty set and link with nothing, as do rows with a null doc_id
    (their component is null). Very long texts are one set like others. An empty table gives
    no rows; other columns aren't read. Sets are compared by 64-bit shingle hashes.

    Steps: shingle frequencies are counted in buckets of the hash range; each document orders
    its shingles from rare to frequent, and takes the prefix and the number of matches that
    cost least; a document with too many unshared shingles can't have a partner and stops
    here. Rare prefix tokens pair documents directly, frequent ones make families that are
    compared block by block, so that a large group of near copies emits links but no pairs.
    """
    spark = docs.sparkSession
    group_bytes, bits = work_sizes(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    groups = grouped(docs, group_bytes)
    sets = materialize(document_sets(groups, count_tokens(groups, bits), bits), "jaccard-sets", ROWS_BYTES)
    drop_table(groups)
    release(spark)
    named = sets.where("n > 0 AND doc_id IS NOT NULL")
    first = materialize(named.groupBy("sig").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows")), "jaccard-first")
    copies = named.select("doc_id", "sig").join(first.where("rows > 1").select("sig", "rep"), "sig").where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    able = named.where("matches IS NOT NULL").select("doc_id", "sig", "n", "matches", "prefix", "classes")
    reps = materialize(able.join(first.select("sig", F.col("rep").alias("doc_id")), ["sig", "doc_id"]).dropDuplicates(["sig", "doc_id"]), "jaccard-reps", ROWS_BYTES)
    stored = named.where("matches IS NOT NULL")
    if not named.groupBy("doc_id").count().where("count > 1").isEmpty():  # repeated rows: one of each set
        stored = materialize(stored.dropDuplicates(["sig", "doc_id"]), "jaccard-stored", ROWS_BYTES)
    stored = stored.select("doc_id", "n", "matches", "prefix", "shingles")
    light = materialize(light_pairs(reps), "jaccard-pairs")
    links = verified(light, stored.select("doc_id", "shingles"))
    placed, read = families(reps)
    links = links.unionByName(family_links(placed, stored)).select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = connected_components(links.unionByName(copies))
    for done in (first, reps, light, *read):
        drop_table(done)
    least = materialize(found.groupBy("root").agg(F.min("node").alias("component_id")), "jaccard-least")
    of_doc = found.join(least, "root").select(F.col("node").alias("doc_id"), "component_id")
    return sets.select("doc_id", F.col("n").alias("n_shingles")).join(of_doc, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def without_duplicates(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: a row of its least doc_id.

    Rows with a null doc_id stay. Columns and their order are those of docs.
    """
    found = jaccard_components(docs).where("component_id = doc_id")
    kept = materialize(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "jaccard-kept")
    out = docs.where("doc_id IS NOT NULL").join(kept.select("doc_id"), "doc_id", "left_semi")
    if not kept.where("rows > 1").isEmpty():
        out = out.dropDuplicates(["doc_id"])
    return out.select(docs.columns).unionByName(docs.where("doc_id IS NULL"))
