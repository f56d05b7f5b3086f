import random
import zlib

import numpy as np
import pytest

from docsift.llm import toxicity as T

DOCS, LABELS = "doc_id long, text string, held_out string, score string", "doc_id long, quality int, toxic int"


def sample(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "run"]) + rng.choice(["", "s", "ed"]) for _ in range(rng.randint(5, 300))]
        if i % 3 == 0:
            for _ in range(max(1, len(words) // 30)):
                words[rng.randrange(len(words))] = "vile" + rng.choice(["ly", "ness", "st", "x", "za"])
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    return rows


def test_windows_cover_and_overlap():
    for n in (0, 1, 127, 128, 129, 1000):
        spans = T.windows_of(n)
        assert spans[0][0] == 0 and spans[-1][1] == n and all(b - a <= T.WINDOW for a, b in spans)
        assert all(y[0] < x[1] for x, y in zip(spans, spans[1:]))


def test_gradients_are_those_of_the_loss():
    net = T.Network()
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    words = T.Features(["one", "two", "three", "four"])
    net.p["words"] = net.rng.standard_normal(net.p["words"].shape) * 0.3
    steps, sizes, labels = np.array([[0, 1, 2], [3, 1, 0]]), np.array([3, 2]), np.array([1.0, 0.0])

    def loss(x):
        score = net.forward(net.project(x), steps, sizes)
        return -np.mean(np.log(np.where(labels > 0, score, 1 - score)))

    x = net.inputs(words).astype("f8")
    g, dx, _ = net.gradients(x, steps, sizes, labels)
    for name in ("wh", "wx", "wa", "va", "wo", "bo", "b"):
        at = tuple(0 for _ in net.p[name].shape)
        eps = 1e-2
        net.p[name][at] += eps
        up = loss(x)
        net.p[name][at] -= 2 * eps
        down = loss(x)
        net.p[name][at] += eps
        assert (up - down) / (2 * eps) == pytest.approx(g[name][at], rel=0.05, abs=2e-3), name
    moved = x.copy()
    moved[1, 2] += 1e-2
    back = x.copy()
    back[1, 2] -= 1e-2
    assert (loss(moved) - loss(back)) / 2e-2 == pytest.approx(dx[1, 2], rel=0.05, abs=2e-3)


def test_scores_generalise_and_cases_are_defined(spark):
    rows = sample(400, 1)
    docs = [(i, t, "x", None) for i, t, _ in rows] + [(1000, None, "", ""), (1001, "", "", ""), (None, "alpha", "", ""), (0, rows[0][1], "", ""), (1002, "alpha beta " * 20000 + "vilely vileness " * 4, "", "")]
    labels = [(i, 1, y) for i, _, y in rows] + [(None, 0, 1), (5, 0, None), (9999, 0, 1)]
    d, l = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    found = T.score_toxicity(d, l).collect()
    assert len(found) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in found)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    truth = {i: y for i, _, y in rows}
    held = [(r["predicted"], truth[r["doc_id"]]) for r in found if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == y for p, y in held]) > 0.9
    empty = {r["doc_id"]: r["score"] for r in found if r["doc_id"] in (1000, 1001)}
    assert empty[1000] == empty[1001] < 0.5
    kept = T.without_toxic(d, l)
    assert kept.columns == d.columns and kept.count() == sum(not r["predicted"] for r in found)


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "a", "", "")], DOCS)
    assert [r["score"] for r in T.score_toxicity(d, spark.createDataFrame([(1, 1, 0)], LABELS)).collect()] == [0.0]
    assert T.score_toxicity(d.limit(0), spark.createDataFrame([], LABELS)).count() == 0
    assert T.without_toxic(d, spark.createDataFrame([], LABELS)).count() == 1


def test_held_out_labels_are_never_learned(spark):
    rows = sample(60, 2)
    d = spark.createDataFrame([(i, t, "", "") for i, t, _ in rows], DOCS)
    texts = [r["text"] for r in T.labelled_sample(d, spark.createDataFrame([(i, 1, y) for i, _, y in rows], LABELS)).collect()]
    held = {t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5 == 0}
    assert texts and not held & set(texts)


def test_all_windows_of_every_text_take_part(monkeypatch):
    words = ["alpha", "beta", "gamma"] * 1000
    words[1500:1504] = ["vilely", "vileness"] * 2
    texts, labels = [" ".join(words), "beta " * 2000, "", "alpha beta"], [1, 0, 0, 1]
    windows = len(T.windows_of(3000)) + len(T.windows_of(2000)) + 2
    scored, real, trained, gradients = [], T._score_spans, [], T.Network.gradients
    monkeypatch.setattr(T, "_score_spans", lambda net, gates, ids, spans: scored.append(len(spans)) or real(net, gates, ids, spans))
    monkeypatch.setattr(T.Network, "gradients", lambda net, x, steps, sizes, y, w: trained.append((len(y), w)) or gradients(net, x, steps, sizes, y, w))
    monkeypatch.setattr(T, "LEAST_STEPS", 0)
    T.fit(texts, labels, epochs=1)
    assert sum(n for n, _ in trained) == windows and scored == []
    T.fit(texts, labels, epochs=3)
    assert set(scored) == {windows} and {float(x) for _, w in trained for x in w} <= {1.0, float(T.EASY_SHARE)}


def test_batches_of_any_remainder_and_of_empty_windows_alone(monkeypatch):
    monkeypatch.setattr(T, "LEAST_STEPS", 0)
    for n in range(2, T.BATCH + 6):
        net = T.fit(["alpha vile" if k % 2 else "" for k in range(n)], [k % 2 for k in range(n)], epochs=1)
        assert all(np.isfinite(v).all() for v in net.p.values())
        net = T.fit([""] * n, [k % 2 for k in range(n)], epochs=1)
        assert np.isfinite(T.Scorer(net).score(["", None, "alpha"])).all()


def test_a_batch_of_empty_windows_alone():
    g, dx, loss = T.Network().gradients(np.zeros((0, 2 * T.WIDTH), "f4"), np.zeros((2, 0), "i8"), np.zeros(2, "i8"), np.zeros(2, "f4"))
    assert np.isfinite(loss) and g["bo"].item() > 0 and dx.shape == (0, 2 * T.WIDTH)


def plain_score(net, text):
    """The network by its equations, a word at a time, and the highest of all windows."""
    p, h = net.p, T.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    vectors = []
    for w in T.words_of(text):
        whole, triples = T.features(w)
        vectors.append(np.concatenate([p["words"][whole], np.mean([p["chars"][t] for t in triples], 0)]))
    best = 0.0
    for a, b in T.windows_of(len(vectors)):
        some, sides = vectors[a:b], []
        for d in (0, 1):
            state, seen = np.zeros(h), []
            for x in some[:: 1 - 2 * d]:
                g, u = x @ p["wx"][d] + p["b"][d, 0], state @ p["wh"][d]
                z, r = sig(g[:h] + u[:h]), sig(g[h : 2 * h] + u[h : 2 * h])
                state = z * state + (1 - z) * np.tanh(g[2 * h :] + r * u[2 * h :])
                seen.append(state)
            sides.append(seen[:: 1 - 2 * d])
        both = [np.concatenate(s) for s in zip(*sides, strict=True)]
        e = np.array([(np.tanh(s @ p["wa"]) @ p["va"])[0] for s in both])
        share = np.exp(e - e.max()) / np.exp(e - e.max()).sum() if len(e) else e
        pooled = sum((s * w for s, w in zip(both, share, strict=True)), np.zeros(2 * h))
        best = max(best, float(sig(pooled @ p["wo"] + p["bo"][0])[0]))
    return best


def test_scores_are_those_of_the_equations():
    rows = sample(24, 7)
    net = T.fit([t for _, t, _ in rows], [y for *_, y in rows], epochs=2)
    texts = ["", "alpha", None, "Vilely, ALPHA beta! " * 70, *(t for _, t, _ in sample(8, 9))]
    assert T.Scorer(net).score(texts) == pytest.approx([plain_score(net, t) for t in texts], abs=1e-4)


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    rows = [(i, "word " * (20 if i % 2 else 200), "", "") for i in range(200)] + [(500, "word " * 10_000, "", ""), (3, "zzz", "", ""), (7, None, "", "")]
    d = spark.createDataFrame(rows, DOCS)
    l = spark.createDataFrame([(i, 1, i % 2) for i in range(200)] + [(500, 1, 0)], LABELS)
    monkeypatch.setattr(T, "FIT_BYTES", 6000)
    rows = T.labelled_sample(d, l).collect()
    size = {y: sum(len(r["text"]) for r in rows if r["toxic"] == y) for y in (0, 1)}
    assert 0 < size[0] <= 6000 and 0 < size[1] <= 6000
    assert sorted(rows) == sorted(T.labelled_sample(d.repartition(7), l.repartition(3)).collect())
