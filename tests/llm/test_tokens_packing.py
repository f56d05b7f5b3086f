import tempfile
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docsift.llm import packing, tokens
from docsift.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, start string, ids string"
ENCODER = Encoder(PATH)


def plain_ids(text):
    return ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids


def cases():
    odd = ["", " ", "a", "  Two  words\n\nmore\ttabs\x0bv\x1cfs", "It's they'll 'sword don't.", "x.) (y) \"q\" a_b _ ...", "İstanbul ΣΑΣ ßÉ e\u0301 ﬁ",
           "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "数字 123 ٣ ½ ²", "word\u00a0nbsp\u2003em", "naïve café, coöperate!", "a" * 3000, "12,345.67 $$$ %%% ###"]
    rows = [(i, t, None, "x") for i, t in enumerate(odd)]
    return rows + [(99, None, None, None), (3, odd[3], "", ""), (None, "no id", "", ""), (100, "long text here. " * 4000, "", "")]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_encoder_is_the_tokenizer(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == plain_ids(text)


def test_encoder_on_cases():
    for _, text, _, _ in cases():
        assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == plain_ids(text)


def test_token_files(spark):
    rows = cases()
    manifest = tokens.write_token_files(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH, sequence=64)
    found = tokens.read_token_files(manifest).collect()
    ids = [(d, np.array([*plain_ids(t), 1], "<u4")) for d, t, _, _ in rows]
    expect = sorted(((-5 if d is None else d), len(x), zlib.crc32(x.tobytes())) for d, x in ids)
    assert sorted((-5 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == expect
    at = 0
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [-5 if r["doc_id"] is None else r["doc_id"] for r in sorted(found, key=lambda r: r["start"])]
    assert order == sorted(order)
    flat = np.concatenate([x for _, x in sorted(ids, key=lambda i: -5 if i[0] is None else i[0])])
    assert sum(r["ids"] for r in manifest.collect()) == len(flat)


def test_any_sequence_is_read_by_its_batch_alone(spark, monkeypatch):
    monkeypatch.setattr(tokens, "BATCH_SEQUENCES", 3)
    docs = [(i, f"word{i} and " * (50 * i)) for i in range(12)]
    flat = np.concatenate([[*plain_ids(t), 1] for _, t in docs])
    out = pa.BufferOutputStream()
    packed = iter([(i, np.array([*plain_ids(t), 1], "<u4").tobytes()) for i, t in docs])
    count, total, places = tokens.write_stream(out, packed, 16, "<u2")
    assert (count, total) == (12, len(flat)) and len(places) == -(-len(flat) // 48)
    path = f"{tempfile.mkdtemp()}/x.arrows"
    Path(path).write_bytes(out.getvalue())
    for k in (0, 1, 2, 3, 7, len(flat) // 16 - 1):
        sequence, mask = tokens.sequence_at(path, k, places, 16)
        assert sequence.dtype == np.uint16 and mask.all() and not sequence.flags.owndata and sequence.tolist() == flat[16 * k : 16 * k + 16].tolist()
    last, mask = tokens.sequence_at(path, -(-len(flat) // 16) - 1, places, 16)
    assert last[mask].tolist() == flat[len(flat) // 16 * 16 :].tolist() or len(flat) % 16 == 0
    for k in (-1, -(-len(flat) // 16), 10**6):
        with pytest.raises(IndexError):
            tokens.sequence_at(path, k, places, 16)


def test_files_are_closed_beyond_their_size(spark):
    rows = cases() + [(200 + i, "some words of it " * 30, "", "") for i in range(60)]
    manifest = tokens.write_token_files(spark.createDataFrame(rows, SCHEMA), PATH, sequence=64, partitions=2, file_ids=500)
    files = manifest.collect()
    assert len(files) > 6 and all(r["ids"] < 500 + 10_000 * (r["docs"] < 60) + 30_000 for r in files)
    found = sorted(tokens.read_token_files(manifest).collect(), key=lambda r: r["start"])
    ids = sorted(((-5 if d is None else d), len(plain_ids(t)) + 1) for d, t, _, _ in rows)
    assert sorted((-5 if r["doc_id"] is None else r["doc_id"], r["n_tokens"]) for r in found) == ids
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]


def test_token_files_of_an_empty_table(spark):
    assert tokens.read_token_files(tokens.write_token_files(spark.createDataFrame([], SCHEMA), PATH)).count() == 0


def test_packing_keeps_every_id_once_without_padding(spark):
    rows = cases() + [(1000 + i, "some more words " * (i % 97), "", "") for i in range(300)]
    found = packing.pack_documents(spark.createDataFrame(rows, SCHEMA).repartition(2), PATH).collect()
    pieces, windows = {}, {}
    for r in found:
        pieces.setdefault(r["doc_id"], []).append(r)
        windows.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"] and r["length"] > 0
    expected = {}
    for d, t, _, _ in rows:
        expected.setdefault(d, []).append(np.array([*plain_ids(t), 1], "<u4").tobytes())
    for d, texts in expected.items():
        assert sum(r["length"] for r in pieces[d]) == sum(map(len, texts)) // 4
        if len(texts) == 1:
            assert b"".join(bytes(r["ids"]) for r in sorted(pieces[d], key=lambda r: r["start"])) == texts[0]
            assert {r["doc_tokens"] for r in pieces[d]} == {len(texts[0]) // 4}
    for some in windows.values():
        at = 0
        for r in sorted(some, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048 and not at & (at - 1)
    assert packing.pack_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_step_groups_are_balanced_and_tiers_checked():
    groups = packing.step_groups([2048] * 10 + [512] * 9 + [256] * 3, 4096)
    loads = [sum(s for s, g in zip([2048] * 10 + [512] * 9 + [256] * 3, groups) if g == k) for k in set(groups)]
    assert max(loads) - min(loads) <= 2048
    with pytest.raises(ValueError):
        packing.Packer((100, 200))
