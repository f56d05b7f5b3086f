import glob
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docsift.llm import jaccard_join as J
from docsift.llm.components import connected_components
from docsift.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, n long, sig string"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(*[words[i:] for i in range(5)])) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute(rows):
    """component by doc_id over all pairs."""
    sets = [(d, plain_set(t)) for d, t, *_ in rows if d is not None]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, p) in enumerate(sets):
        for b, q in sets[:i]:
            if a == b or (p and q and 100 * len(p & q) >= 80 * len(p | q)):
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {d: find(d) for d in up}


def check(spark, rows):
    found = J.jaccard_components(spark.createDataFrame(rows, SCHEMA)).collect()
    expected = brute(rows)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["n_shingles"], r["component_id"]) for r in found if r["doc_id"] is not None) == sorted(
        ((False, d), len(plain_set(t)), expected[d]) for d, t, *_ in rows if d is not None
    )
    nulls = [r for r in found if r["doc_id"] is None]
    assert len(nulls) == sum(d is None for d, *_ in rows) and all(r["component_id"] is None for r in nulls)


def corpus(seed, families, size, words=60, edits=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows, key = [], 0
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(5, words))] + (passage if rng.random() < 0.5 else [])
        for _ in range(rng.randint(1, size)):
            copy = list(base)
            for _ in range(rng.randint(0, edits)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((key * 7 % 100003, " ".join(copy), 1, ""))
            key += 1
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_pairs(spark, seed):
    check(spark, corpus(seed, 40, 6))


def test_large_family_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(J, "BLOCK_DOCS", 40)  # several blocks
    check(spark, corpus(5, 2, 180, words=90, edits=4) + corpus(6, 30, 3))


def test_odd_rows(spark):
    long = " ".join(f"t{i}" for i in range(30000))
    check(spark, [
        (1, "a b c d", 0, None), (2, "A  B\tc d", 0, None), (3, "a b c", 0, ""), (4, "", 0, ""), (5, None, 0, ""), (6, "   ", 0, ""), (7, "É b c d e f", 0, ""), (8, "é b c d e f", 0, ""),
        (9, long, 0, ""), (10, long + " tail", 0, ""), (11, "one two three four five six", 0, ""), (11, "one two three four five six", 0, ""), (11, "quite another text of six words", 0, ""),
        (12, "one two three four five six", 0, ""), (13, "quite another text of six words", 0, ""), (None, "a b c d", 0, ""), (None, None, 0, ""), (-5, "a b c d", 0, ""), (14, "x" * 500 + " y", 0, ""),
    ])


def test_empty_table_and_duplicates_removed(spark):
    assert J.jaccard_components(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, "a b c d e", 0, "x"), (2, "a b c d e", 0, "y"), (3, "other", 0, None), (3, "other", 0, None), (None, "a b c d e", 0, "z"), (4, None, 0, ""), (5, None, 0, "")]
    kept = J.without_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "n", "sig"]
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 1, 3, 4, 5]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB \t\nçÉ \x1c."), max_size=60)), max_size=8))
def test_shingles_follow_the_definition(texts):
    flat, bounds = shingle_sets(pa.array(texts, pa.string()))
    assert len(bounds) == len(texts) + 1
    sets = [flat[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert all(s == sorted(set(s)) for s in sets)
    expected = [plain_set(t) for t in texts]
    assert [len(s) for s in sets] == [len(e) for e in expected]
    for i in range(len(texts)):
        for j in range(i):
            assert len(set(sets[i]) & set(sets[j])) == len(expected[i] & expected[j])


def test_slices_of_arrays_and_overlaps():
    texts = pa.array([f"a{i} b c d e f g" for i in range(9)])
    whole, bounds = shingle_sets(texts)
    part, inner = shingle_sets(texts.slice(3, 4))
    assert np.array_equal(part, whole[bounds[3] : bounds[7]]) and np.array_equal(inner, bounds[3:8] - bounds[3])
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))) for _ in range(12)]
    got = J.overlap(sets, np.arange(5), np.arange(3, 12), width=64)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[3 + j])) for i in range(5) for j in range(9) if i != 3 + j)


def test_full_pair_of_blocks_takes_bounded_memory(monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.integers(-(2**62), 2**62, 1000)
    sets = [np.unique(np.concatenate([base[rng.random(1000) < 0.9], rng.integers(-(2**62), 2**62, 60)])) for _ in range(1600)]
    rows, columns = np.arange(800), np.arange(800, 1600)
    tracemalloc.start()
    got = J.overlap(sets, rows, columns)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 70 << 20  # 1.5 million tokens: 12 MB, and 5 MB of result
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[800 + j])) for i, j in rng.integers(0, 800, (60, 2)))
    monkeypatch.setattr(J, "PART_TOKENS", 64)
    few = J.overlap(sets[:40], np.arange(20), np.arange(20, 40))
    assert all(few[i, j] == len(np.intersect1d(sets[i], sets[20 + j])) for i in range(20) for j in range(20))


def test_tables_of_texts_have_small_row_groups(spark):
    text = " ".join(f"w{i}" for i in range(40_000))
    groups = J.grouped(spark.createDataFrame([(i, text + str(i)) for i in range(80)], "doc_id long, text string").coalesce(1))
    parts = [pq.ParquetFile(f).metadata for f in glob.glob(f"{groups._docsift_path.removeprefix('file://')}/*.parquet")]
    held = [m.row_group(k).total_byte_size for m in parts for k in range(m.num_row_groups)]
    assert sum(held) > 20 << 20 and max(held) < 13 << 20  # a reader may hold a whole row group
    assert groups.selectExpr("sum(size(doc_id))").first()[0] == 80


def test_frequencies_in_parts(spark, monkeypatch):
    monkeypatch.setattr(J, "PART_TOKENS", 32)
    check(spark, corpus(8, 12, 14))


def test_matches_and_classes():
    df = np.array([1, 2, 127, 128, 200, 5000, 10**7])
    classes = J.frequency_class(df)
    assert list(classes[:3]) == [1, 2, 127] and (np.diff(classes.astype(int)) >= 0).all()
    matches, size = J.choose_matches(100, 0, np.full(100, 50.0))
    assert size == 100 - 80 + matches and 1 <= matches <= 16


def test_components_of_chains_stars_and_text_nodes(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 1), (3, 4), (4, 3)]
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({found[k] for k in range(61)}) == 1 and len({found[k] for k in range(100, 160)}) == 1 and found[0] != found[100] and len(found) == 121
    assert connected_components(spark.createDataFrame([], "a string, b string")).count() == 0
