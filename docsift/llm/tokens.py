"""Token ids of whole texts, and an Arrow stream-file format for equal-length sequences."""

from __future__ import annotations

import functools
import itertools
import json
import string
import uuid
import zlib
from collections.abc import Iterable, Iterator, Sequence
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsift.llm.shared import materialize, new_path, open_fs

SEQUENCE = 2048
END_ID = 1
#: Words kept per worker before the cache starts anew; about 120 MB.
CACHED_WORDS = 600_000
#: ASCII punctuation.
PUNCTUATION = string.punctuation
#: Rows and characters encoded at a time.
SLICE_ROWS, SLICE_CHARS = 512, 4_000_000
#: A file is closed beyond so many ids, and a task's share of the text is about so many bytes at most.
FILE_IDS, TASK_BYTES = 64 << 20, 256 << 20
#: Sequences per record batch of a file.
BATCH_SEQUENCES = 256


class Encoder:
    """Ids of whole texts as little-endian uint32 bytes, by the tokenizers library.

    The tokenizer drops white space and never joins across it, so a text's ids are those of
    its words one after another; each word is encoded once and kept. A word of letters with
    ASCII punctuation behind is two pieces to the tokenizer, which are kept apart.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or ""
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        if suffix:
            self.ends[[i for w, i in vocab.items() if w.endswith(suffix)]] = True
        self.letters = self._for_letters()
        self._reset()

    def _for_letters(self):
        """The same model without the patterns that leave runs of letters, apart by spaces, as they are."""
        from tokenizers import Tokenizer

        parts = json.loads(self.tokenizer.to_str())
        before = parts["pre_tokenizer"]
        known = [x["type"] for x in parts["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"] if (parts["normalizer"] or {}).get("type") == "Sequence" else False
        if not known or before["type"] != "Sequence" or [x["type"] for x in before["pretokenizers"]] != ["Split", "ByteLevel"]:
            return self.tokenizer
        parts["normalizer"] = {"type": "Lowercase"}
        before["pretokenizers"][0] = {"type": "WhitespaceSplit"}
        return Tokenizer.from_str(json.dumps(parts))

    def _reset(self) -> None:
        self.words: dict[str, bytes] = {"": b""}

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, missing: Iterable[str]) -> None:
        split: list[tuple[str, str]] = []
        words = self.words
        heads: set[str] = set()
        for w in missing:
            head = w.rstrip(PUNCTUATION)
            if not head.isalpha():
                words[w] = self._ids(w)
                continue
            if head.isascii():
                key = head.lower()
            elif is_normalized("NFC", head) and head.lower().isalpha():  # lower case may bring marks, which stand apart
                key = head
            else:
                words[w] = self._ids(w)
                continue
            split.append((w, key))
            if key not in words:
                heads.add(key)
        self._learn_heads(list(heads))
        for w, key in split:
            if len(w) == len(key):
                words[w] = words[key]
                continue
            tail = w[len(key) :]
            if tail not in words:
                words[tail] = self._ids(tail)
            words[w] = words[key] + words[tail]

    def _learn_heads(self, heads: list[str]) -> None:
        """Runs of letters go through the tokenizer in one text, cut again where words end."""
        for at in range(0, len(heads), 4096):
            some = heads[at : at + 4096]
            found = self.letters.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0]
            ids = np.array(found.ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(some):  # one end for each, as every run gives at least one
                data, bounds = ids.tobytes(), [0, *(4 * cuts).tolist()]
                self.words.update((w, data[a:b]) for w, a, b in zip(some, bounds, bounds[1:], strict=False))
            else:  # lower-casing split a run, or the vocabulary marks no ends
                self.words.update((w, self._ids(w)) for w in some)

    def _plain(self, text: str) -> str:
        """The text with the tokenizer's own white-space and case folding done where that is certain to be the same."""
        text = text.replace("\n", " ")
        if self.letters is self.tokenizer or "<|" in text:
            return text
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        return text.lower()

    def encode(self, texts: Iterable[str | None]) -> list[bytes]:
        split = [self._plain(t or "").split(" ") for t in texts]
        if len(self.words) > CACHED_WORDS:
            self._reset()
        missing = set().union(*split) - self.words.keys()
        if missing:
            self._learn(missing)
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]


@functools.cache
def encoder(path: str) -> Encoder:
    """One encoder per worker process, so that its words serve later tasks too.

    Workers serve other operators later on; these call ``encoder.cache_clear()``.
    """
    return Encoder(path)


def slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE_ROWS rows and about ``limit`` bytes; a longer text stands alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (i - start >= SLICE_ROWS or total + size > limit):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)


def write_stream(stream, ids_of_docs: Iterator[tuple[int | None, bytes]], sequence: int, dtype: str, most_ids: int = FILE_IDS) -> tuple[int, int, list[int]]:
    """Write documents' ids as one Arrow stream, until none is left or most_ids are written.

    Returns the documents, their ids and the place of each batch in the stream.

    Every batch has the columns ids (fixed-size list of ``sequence``), mask (the same, true
    for real ids) and docs (list of struct(doc_id, n): the documents that end in the row, in
    order, with their lengths). Buffers aren't compressed, so a mapped file serves any
    sequence without a copy. Only the last row is padded.
    """
    width = np.dtype(dtype)
    kind = pa.from_numpy_dtype(width)
    info = pa.list_(pa.struct([("doc_id", pa.int64()), ("n", pa.int64())]))
    schema = pa.schema([("ids", pa.list_(kind, sequence)), ("mask", pa.list_(pa.bool_(), sequence)), ("docs", info)])
    writer = pa.ipc.new_stream(stream, schema)
    held: list[np.ndarray] = []
    ends: list[tuple[int, int | None, int]] = []
    places: list[int] = []
    count = total = in_held = 0

    def flush(rows: int, real: int) -> None:
        nonlocal held, in_held, ends
        places.append(stream.tell())
        flat = np.concatenate(held) if held else np.zeros(0, width)
        used, rest = flat[: rows * sequence], flat[rows * sequence :]
        padded = np.zeros(rows * sequence, width)
        padded[: len(used)] = used
        mask = np.arange(rows * sequence) < real
        per_row: list[list[dict]] = [[] for _ in range(rows)]
        later = []
        for end, doc, n in ends:
            row = max(0, end - 1) // sequence
            if row < rows:
                per_row[row].append({"doc_id": doc, "n": n})
            else:
                later.append((end - rows * sequence, doc, n))
        writer.write_batch(
            pa.record_batch(
                [
                    pa.FixedSizeListArray.from_arrays(pa.array(padded, kind), sequence),
                    pa.FixedSizeListArray.from_arrays(pa.array(mask), sequence),
                    pa.array(per_row, info),
                ],
                schema=schema,
            )
        )
        held, in_held, ends = [rest], len(rest), later

    for doc, ids in ids_of_docs:
        part = np.frombuffer(ids, "<u4").astype(width)
        held.append(part)
        in_held += len(part)
        count, total = count + 1, total + len(part)
        ends.append((in_held, doc, len(part)))
        while in_held >= BATCH_SEQUENCES * sequence:
            flush(BATCH_SEQUENCES, BATCH_SEQUENCES * sequence)
        if total >= most_ids:
            break
    if ends or in_held:
        flush(max(1, -(-in_held // sequence)), in_held)
    writer.close()
    return count, total, places


def read_stream(stream) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, start within the file, uint32 ids) of each document, in file order."""
    carried, start = b"", 0
    for batch in pa.ipc.open_stream(stream):
        ids = batch.column("ids").flatten().to_numpy().astype("<u4")
        keep = batch.column("mask").flatten().to_numpy(zero_copy_only=False)
        data, at = carried + ids[keep].tobytes(), 0
        for row in batch.column("docs").to_pylist():
            for doc in row:
                n = doc["n"]
                yield doc["doc_id"], start, data[at : at + 4 * n]
                at, start = at + 4 * n, start + n
        carried = data[at:]


def sequence_at(path: str, index: int, places: Sequence[int], sequence: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """One sequence and its mask out of a mapped file, by the places of its batches (``write_stream``, a manifest's).

    Only the batch that holds the sequence is looked at; the ids are a view of the file's bytes.
    """
    batch, row = divmod(index, BATCH_SEQUENCES)
    if index < 0 or batch >= len(places):
        raise IndexError(index)
    with pa.memory_map(path) as source:
        schema = pa.ipc.open_stream(source).schema
        source.seek(places[batch])
        message = pa.ipc.read_message(source)
        if message.type == "schema":  # stands before the first batch
            message = pa.ipc.read_message(source)
        found = pa.ipc.read_record_batch(message, schema)
    if row >= found.num_rows:
        raise IndexError(index)
    ids = found.column("ids").flatten().slice(row * sequence, sequence)
    return ids.to_numpy(), found.column("mask").flatten().slice(row * sequence, sequence).to_numpy(zero_copy_only=False)


def write_token_files(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, partitions: int | None = None, file_ids: int = FILE_IDS) -> DataFrame:
    """Tokenise whole texts and write Arrow stream files in ascending doc_id order.

    Returns the manifest (a written table): file_no, path, docs, ids, places (of the batches);
    files follow one another in doc_id order. There are as many tasks as shuffle partitions, or
    more, so that none has over about TASK_BYTES of text. Each task streams its range of ids into
    files of about file_ids, under names of its own attempt; only files in the manifest
    count, so a retried task leaves no trace in the result. A very long text is one document
    of one file, which is longer by it. Ids are stored as uint16 where the vocabulary allows. Null texts are empty
    (the end id alone); null doc_ids come first; repeated rows are kept.
    """
    spark = docs.sparkSession
    root = new_path(spark, "token-files")
    if not partitions:
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    end = np.array([END_ID], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        dtype = "<u2" if own.tokenizer.get_vocab_size() <= 2**16 else "<u4"

        def documents() -> Iterator[tuple[int | None, bytes]]:
            for some in slices(batches):
                ids = own.encode(some.column("text").to_pylist())
                yield from zip(some.column("doc_id").to_pylist(), (x + end for x in ids), strict=True)

        number = TaskContext.get().partitionId()
        fs, folder = open_fs(root)
        fs.create_dir(folder, recursive=True)
        left = documents()
        for roll in itertools.count():
            first = next(left, None)
            if first is None:
                return
            name = f"{number:06d}-{roll:06d}-{uuid.uuid4().hex}.arrows"
            with fs.open_output_stream(f"{folder}/{name}") as out:
                count, total, places = write_stream(out, itertools.chain([first], left), sequence, dtype, file_ids)
            yield pa.record_batch({"file_no": [(number << 32) + roll], "path": [f"{root}/{name}"], "docs": [count], "ids": [total], "places": pa.array([places], pa.list_(pa.int64()))})

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("tie"))  # splits a doc_id of many rows
    ranged = keyed.repartitionByRange(partitions, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    written = ranged.mapInArrow(write, "file_no long, path string, docs long, ids long, places array<long>")
    return materialize(written, "token-manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of a manifest."""
    before = W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)  # one row per file
    files = manifest.select("path", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    files = files.repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, name = open_fs(path)
                rows: list[tuple] = []
                with fs.open_input_stream(name) as stream:
                    for doc, start, ids in read_stream(stream):
                        rows.append((doc, base + start, len(ids) // 4, zlib.crc32(ids)))
                        if len(rows) == 10_000:
                            yield _digest_rows(rows)
                            rows = []
                if rows:
                    yield _digest_rows(rows)

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.record_batch({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)})
