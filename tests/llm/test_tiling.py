import random
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docsift.llm import tiling

DOCS, ITEMS = "doc_id long, text string, item_id string, tiles string", "item_id long, text string"


def plain_tiles(text, item, least):
    """Greedy tiling by its definition: the longest unmarked common run, again and again."""
    free_t, free_i, out = [t >= 0 for t in text], [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for b in range(len(item)):
            for a in range(len(text)):
                n = 0
                while a + n < len(text) and b + n < len(item) and free_t[a + n] and free_i[b + n] and text[a + n] == item[b + n]:
                    n += 1
                if n > best[0]:
                    best = (n, a, b)
        n, a, b = best
        if n < least:
            return out
        for k in range(n):
            free_t[a + k] = free_i[b + k] = False
        out.append((a, b, n))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(-1, 3), max_size=40), st.lists(st.integers(0, 3), min_size=2, max_size=16), st.integers(1, 4))
def test_tiles_don_t_overlap_and_none_is_left(text, item, least):
    found = tiling.tiles(np.array(text, "i8"), np.array(item, "i8"), least)
    seen_t, seen_i = set(), set()
    for a, b, n in found:
        assert n >= least and text[a : a + n] == item[b : b + n] and min(text[a : a + n]) >= 0
        assert not seen_t & set(range(a, a + n)) and not seen_i & set(range(b, b + n))
        seen_t |= set(range(a, a + n))
        seen_i |= set(range(b, b + n))
    masked = [-1 if i in seen_t else t for i, t in enumerate(text)]
    rest = [-2 if i in seen_i else t for i, t in enumerate(item)]
    assert plain_tiles(masked, rest, least) == []
    assert max([n for *_, n in found], default=0) == max([n for *_, n in plain_tiles(text, item, least)], default=0)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_running_hashes_are_those_of_windows(ids, size):
    ids = np.array(ids, "i8")
    found = tiling.seeds_of(ids, size)
    windows = [tuple(ids[i : i + size].tolist()) for i in range(len(ids) - size + 1)]
    assert len(found) == len(windows) and len(set(found.tolist())) == len(set(windows))
    assert all(found[i] == tiling.seeds_of(ids[i : i + size], size)[0] for i in range(len(windows)))


def test_long_items_take_time_in_proportion():
    took = []
    for n in (4000, 32000):
        ids = np.arange(n) % 997
        began = time.perf_counter()
        assert tiling.tiles(ids, ids) == [(0, 0, n)]
        took.append(time.perf_counter() - began)
    assert took[1] < 60 * max(took[0], 0.01)


def plain_pairs(docs, items, coverage):
    """(doc_id, item_id) by whole texts and tiles by their definition; text and item may have the same words in any order."""
    out = []
    for doc, text in docs:
        words = tiling.words_of(text)
        for item, body in items:
            ours = tiling.words_of(body)
            if len(ours) < tiling.SEED:
                out += [(doc, item)] * bool(ours and ours == words)
                continue
            ids = {w: k for k, w in enumerate(dict.fromkeys(ours))}
            found = plain_tiles([ids.get(w, -1) for w in words], [ids[w] for w in ours], tiling.SEED)
            if ours and sum(n for *_, n in found) >= coverage * len(ours):
                out.append((doc, item))
    return sorted(out)


def test_pairs_against_brute_force(spark):
    rng = random.Random(8)
    items = [(i, " ".join(f"k{rng.randrange(300)}" for _ in range(rng.choice([1, 2, 3, 4, 9, 20])))) for i in range(14)]
    docs = []
    for d in range(60):
        words = [f"k{rng.randrange(300)}" for _ in range(rng.randrange(30))]
        body = tiling.words_of(items[d % 14][1])
        cut = rng.randrange(len(body) + 1)
        docs.append((d, " ".join([*words, *rng.choice([body, body[cut:] + ["zz"] + body[:cut], body[: len(body) // 2], body[: len(body) // 3]]), *words[:3]])))
    docs += [(100 + i, body.upper()) for i, body in items]
    d = spark.createDataFrame([(*r, "", "") for r in docs], DOCS)
    found = tiling.contaminated_pairs(d, spark.createDataFrame(items, ITEMS))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == plain_pairs(docs, items, tiling.COVERAGE)


def test_coverage_of_whole_reordered_and_partial_items(spark):
    rng = random.Random(3)
    words = [f"q{i}" for i in range(40)]
    parts = [words[i : i + 8] for i in range(0, 40, 8)]
    rng.shuffle(parts)
    noise = " ".join(f"n{i}" for i in range(3000))
    docs = [
        (1, f"{noise} {' '.join(words).upper()}, {noise}", "", ""), (2, noise + " " + " x ".join(" ".join(p) for p in parts), None, None), (3, " ".join(words[:12]), "", ""), (4, " ".join(words[::-1]), "", ""),
        (5, None, "", ""), (6, "", "", ""), (None, " ".join(words), "", ""), (1, " ".join(words), "", ""), (7, "a b c", "", ""), (8, noise, "", ""),
    ]
    items = [(10, " ".join(words)), (11, None), (12, ""), (13, "a b c"), (14, " ".join(words))]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    found = tiling.contaminated_pairs(d, i).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in found) == sorted([*((k, n) for k in (0, 1, 1, 2) for n in (10, 14)), (7, 13)])
    assert all(r["coverage"] == 1 and sum(t["length"] for t in r["tiles"]) == r["matched"] == r["item_words"] for r in found)
    blocks = tiling.contaminated_pairs(d, i, block_bytes=200).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"]) for r in blocks) == sorted((r["doc_id"] or 0, r["item_id"]) for r in found)
    kept = tiling.without_contaminated(d, i)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5, 6, 8]
    assert tiling.contaminated_pairs(d.limit(0), i).count() == 0 and tiling.contaminated_pairs(d, i.limit(0)).count() == 0
