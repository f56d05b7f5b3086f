"""Toxicity scores by a bidirectional gated recurrent network with attention pooling."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsift.llm.shared import drop_table, materialize
from docsift.llm.tokens import encoder, slices

WINDOW, STRIDE = 128, 96
BUCKETS, WIDTH, HIDDEN = 1 << 14, 8, 8
#: Labelled rows that the network is fitted on: at most so many toxic ones and so many others, and so many bytes of text of each.
FIT_TOXIC, FIT_CLEAN = 1500, 2500
FIT_BYTES = 8_000_000
EPOCHS, BATCH, RATE, SEED = 5, 64, 0.01, 20240229
#: Clean windows that score below EASY train one in EASY_SHARE, with its weight.
EASY, EASY_SHARE = 0.03, 4
#: Small samples are gone through more often, up to about so many steps.
LEAST_STEPS = 300
#: Share of a batch's words that only their triples stand for, and how embeddings shrink at each step.
WORD_DROP, DECAY = 0.8, 0.003
#: Words whose input vectors a worker keeps.
CACHED_WORDS = 200_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def windows_of(n: int) -> list[tuple[int, int]]:
    """Overlapping windows [from, to) that cover n words; one empty window for no words."""
    starts = range(0, max(1, n - (WINDOW - STRIDE)), STRIDE)
    return [(s, min(n, s + WINDOW)) for s in starts]


def features(word: str) -> tuple[int, list[int]]:
    """Bucket of the word, and buckets of its letter triples, with marks at both ends."""
    whole = zlib.crc32(word.encode()) % BUCKETS
    marked = f"^{word}$"
    triples = [zlib.crc32(marked[i : i + 3].encode(), 7) % BUCKETS for i in range(max(1, len(marked) - 2))]
    return whole, triples


class Features:
    """Buckets of many words: one whole-word bucket each, and their triples' in a row."""

    def __init__(self, words: list[str]):
        found = [features(w) for w in words]
        self.whole = np.array([w for w, _ in found], "i8")
        self.sizes = np.array([len(t) for _, t in found], "i8")
        self.triples = np.array([x for _, t in found for x in t], "i8")
        self.starts = np.cumsum(self.sizes) - self.sizes

    def take(self, ids: np.ndarray) -> Features:
        out = Features([])
        out.whole, out.sizes = self.whole[ids], self.sizes[ids]
        out.starts = np.cumsum(out.sizes) - out.sizes
        out.triples = self.triples[np.repeat(self.starts[ids] - out.starts, out.sizes) + np.arange(out.sizes.sum())]
        return out


def summed(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, the sum of each one's rows)."""
    order = np.argsort(ids, kind="stable")
    ids = ids[order]
    starts = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])[: len(ids)])
    return ids[starts], np.add.reduceat(rows[order], starts)


@dataclass
class Network:
    """Word and letter-triple embeddings, a GRU in each direction, attention and one output.

    wx: [direction, input, 3 * hidden] with the gates z, r, n; wh likewise from the state.
    """

    rng: np.random.Generator = field(default_factory=lambda: np.random.default_rng(SEED))
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if not self.p:
            draw = lambda *shape, scale: (self.rng.standard_normal(shape) * scale).astype("f4")
            d, h = 2 * WIDTH, HIDDEN
            self.p = {
                "words": np.zeros((BUCKETS, WIDTH), "f4"),  # unseen words and triples say nothing
                "chars": draw(BUCKETS, WIDTH, scale=0.02),
                "wx": draw(2, d, 3 * h, scale=d**-0.5),
                "b": np.zeros((2, 1, 3 * h), "f4"),
                "wh": draw(2, h, 3 * h, scale=h**-0.5),
                "wa": draw(2 * h, h, scale=(2 * h) ** -0.5),
                "va": draw(h, 1, scale=h**-0.5),
                "wo": draw(2 * h, 1, scale=(2 * h) ** -0.5),
                "bo": np.zeros((1, 1), "f4"),
            }

    def inputs(self, words: Features, drop: np.ndarray | None = None) -> np.ndarray:
        """[word, 2 * WIDTH]: the word's embedding (none where drop says so) beside the mean of its triples'."""
        if not len(words.whole):
            return np.zeros((0, 2 * WIDTH), "f4")
        known = self.p["words"][words.whole]
        if drop is not None:
            known = known * ~drop[:, None]
        sums = np.add.reduceat(self.p["chars"][words.triples], words.starts)
        return np.hstack([known, sums / words.sizes[:, None].astype("f4")]).astype(self.p["wx"].dtype)

    def project(self, x: np.ndarray) -> np.ndarray:
        """[word, direction, 3 * hidden]: what an input adds to the gates."""
        return np.ascontiguousarray((np.matmul(x, self.p["wx"]) + self.p["b"]).transpose(1, 0, 2))

    def forward(self, gates: np.ndarray, steps: np.ndarray, sizes: np.ndarray, keep: bool = False):
        """Scores of windows. gates: as from project; steps: [window, time] rows of gates; sizes: words each.

        The second direction reads each window from its own last word. A state stays as it is
        beyond its window's words, and attention leaves these out.
        """
        many, time = steps.shape
        h3, h = 3 * HIDDEN, HIDDEN
        at = np.arange(time)
        back = np.where(at[None] < sizes[:, None], sizes[:, None] - 1 - at[None], at[None])
        order = np.stack([steps, np.take_along_axis(steps, back, 1)])  # [2, window, time]
        live = (at[None] < sizes[:, None]).astype("f4")
        least = int(sizes.min(initial=time))  # up to here every window has words
        state = np.zeros((2, many, h), "f4")
        states = np.empty((time, 2, many, h), "f4")
        x = np.empty((time, 2, many, h3), "f4")
        x[:, 0], x[:, 1] = gates[order[0].T, 0], gates[order[1].T, 1]
        x[..., : 2 * h] *= 0.5  # a sigmoid is half a tanh of half
        half = self.p["wh"].copy()
        half[..., : 2 * h] *= 0.5
        saved = []
        for t in range(time):
            u = np.matmul(state, half)
            zr = np.tanh(x[t, ..., : 2 * h] + u[..., : 2 * h])
            zr += 1
            zr *= 0.5
            z, r = zr[..., :h], zr[..., h:]
            un = u[..., 2 * h :]
            n = r * un
            n += x[t, ..., 2 * h :]
            np.tanh(n, out=n)
            new = state - n
            new *= z
            new += n
            if t >= least:
                new = np.where(live[None, :, t, None] > 0, new, state)
            if keep:
                saved.append((state, z, r, n, un))
            state = states[t] = new
        back_t = back.T  # states of the second direction in the order of the text
        both = np.concatenate([states[:, 0], states[back_t, 1, np.arange(many)[None]]], -1)  # [time, window, 2h]
        a = np.tanh(both @ self.p["wa"])
        e = (a @ self.p["va"])[..., 0]
        e = np.where(live.T > 0, e, -1e9)
        w = np.exp(e - e.max(0, keepdims=True, initial=-1e9)) * live.T
        w /= np.maximum(w.sum(0, keepdims=True), 1e-9)
        pooled = (w[..., None] * both).sum(0)
        logit = (pooled @ self.p["wo"] + self.p["bo"])[:, 0]
        score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        return (score, saved, (order, live, back_t, both, a, w, pooled)) if keep else score

    def gradients(self, x: np.ndarray, steps: np.ndarray, sizes: np.ndarray, labels: np.ndarray, weights: np.ndarray | float = 1.0) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the mean of the windows' weighted log losses, those of x itself, and the loss."""
        p, h = self.p, HIDDEN
        score, saved, (order, live, back_t, both, a, w, pooled) = self.forward(self.project(x), steps, sizes, keep=True)
        many, time = steps.shape
        loss = float(-np.mean(weights * np.log(np.where(labels > 0, score, 1 - score) + 1e-7)))
        dlogit = (weights * (score - labels) / many).astype("f4")[:, None]
        g = {k: np.zeros_like(p[k]) for k in ("wh", "wx", "b")}
        g["wo"], g["bo"] = pooled.T @ dlogit, dlogit.sum(0, keepdims=True)
        dpooled = dlogit @ p["wo"].T
        dboth = w[..., None] * dpooled[None]
        dw = (both * dpooled[None]).sum(-1)
        de = w * (dw - (w * dw).sum(0, keepdims=True))
        g["va"] = np.einsum("tbh,tb->h", a, de)[:, None]
        da = de[..., None] * p["va"][:, 0] * (1 - a * a)
        g["wa"] = np.einsum("tbi,tbh->ih", both, da)
        dboth += da @ p["wa"].T
        dstates = np.empty((time, 2, many, h), "f4")
        dstates[:, 0] = dboth[..., :h]
        dstates[back_t, 1, np.arange(many)[None]] = dboth[..., h:]
        dins = np.empty((time, 2, many, 3 * h), "f4")
        dus = np.empty((time, 2, many, 3 * h), "f4")
        carry, least, back_wh = np.zeros((2, many, h), "f4"), int(sizes.min(initial=time)), np.ascontiguousarray(p["wh"].transpose(0, 2, 1))
        for t in range(time - 1, -1, -1):
            state, z, r, n, un = saved[t]
            d = carry + dstates[t]
            m = live[None, :, t, None]
            dnew = d * m if t >= least else d
            own, du = dins[t], dus[t]
            np.multiply(dnew * (1 - z), 1 - n * n, out=own[..., 2 * h :])
            dn = own[..., 2 * h :]
            np.multiply(dnew * (state - n), z * (1 - z), out=own[..., :h])
            np.multiply(dn * un, r * (1 - r), out=own[..., h : 2 * h])
            du[..., : 2 * h] = own[..., : 2 * h]
            np.multiply(dn, r, out=du[..., 2 * h :])
            carry = np.matmul(du, back_wh)
            carry += dnew * z
            if t >= least:
                carry += d * (1 - m)
        before = np.stack([s[0] for s in saved]) if saved else np.zeros((0, 2, many, h), "f4")
        g["wh"] = np.stack([before[:, k].reshape(-1, h).T @ dus[:, k].reshape(-1, 3 * h) for k in (0, 1)])
        dx = np.zeros((2, len(x), 3 * h), "f4")
        for k in (0, 1):
            ids, rows = summed(order[k].T.ravel(), dins[:, k].reshape(-1, 3 * h))
            dx[k, ids] = rows
        g["b"] = dx.sum(1, keepdims=True)
        g["wx"] = np.matmul(x.T[None], dx)
        return g, (np.matmul(dx, p["wx"].transpose(0, 2, 1))).sum(0), loss


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> Network | None:
    """Train on whole documents' labels: a window of a toxic document counts once it leads there.

    In the first epoch every window has its document's label. Before each later one all windows
    of all texts are scored: of a toxic document only those count that score at least half of
    its best; of the clean windows below EASY one in EASY_SHARE stands for as many. A text
    without words is one empty window, and where no text is, some empty windows stand for
    clean ones. None without both classes.
    """
    if len(set(labels)) < 2:
        return None
    net = Network()
    vocab: dict[str, int] = {}
    coded = [np.array([vocab.setdefault(w, len(vocab)) for w in words_of(text)], "i8") for text in texts]
    feats = Features(list(vocab))
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    turn = 0
    windows = sum(len(windows_of(len(ids))) for ids in coded)
    blank = all(len(ids) for ids in coded)
    epochs = max(epochs, -(-LEAST_STEPS * BATCH // max(1, windows)))
    epochs = min(epochs, 10 * EPOCHS)
    flat, spans_of = np.concatenate(coded), [windows_of(len(ids)) for ids in coded]
    starts = np.cumsum([0, *(len(ids) for ids in coded)]).tolist()
    spans = [(base + a, base + b) for base, own in zip(starts, spans_of, strict=False) for a, b in own]
    firsts = np.cumsum([0, *map(len, spans_of)])
    owner_label = np.repeat(labels, np.diff(firsts))
    for epoch in range(epochs):
        weights = np.ones(len(spans), "f4")
        if epoch and vocab:
            scores = _score_spans(net, net.project(net.inputs(feats)), flat, spans)
            best = np.maximum.reduceat(scores, firsts[:-1])
            weights[(owner_label > 0) & (scores < np.repeat(best, np.diff(firsts)) / 2)] = 0
            easy = (owner_label == 0) & (scores < EASY)
            weights[easy] = np.where(net.rng.random(int(easy.sum())) < 1 / EASY_SHARE, EASY_SHARE, 0)
        items = [(flat[spans[k][0] : spans[k][1]], int(owner_label[k]), float(weights[k])) for k in np.flatnonzero(weights)]
        if blank:  # no label tells what a text without words is
            items += [(np.zeros(0, "i8"), 0, 1.0)] * (1 + len(items) // 50)
        net.rng.shuffle(items)
        items = sorted(items, key=lambda x: len(x[0])) if len(items) < BATCH else items
        for at in range(0, len(items), BATCH):
            some = items[at : at + BATCH]
            sizes = np.array([len(i) for i, *_ in some])
            used, inverse = np.unique(np.concatenate([i for i, *_ in some]), return_inverse=True)
            steps = np.zeros((len(some), sizes.max()), "i8")
            cut = np.cumsum(sizes) - sizes
            for k, (n, c) in enumerate(zip(sizes, cut, strict=True)):
                steps[k, :n] = inverse[c : c + n]
            words = feats.take(used)
            drop = net.rng.random(len(used)) < WORD_DROP
            g, dx, _ = net.gradients(net.inputs(words, drop), steps, sizes, *(np.array([x[k] for x in some], "f4") for k in (1, 2)))
            sparse = {
                "words": summed(words.whole, dx[:, :WIDTH] * ~drop[:, None]) if len(used) else None,
                "chars": summed(words.triples, np.repeat(dx[:, WIDTH:] / words.sizes[:, None], words.sizes, 0)) if len(used) else None,
            }
            turn += 1
            slower = 1 - (epoch + at / len(items)) / epochs  # the rate falls to nothing by the end
            parts = [(k, slice(None), v) for k, v in g.items()] + [(k, *v) for k, v in sparse.items() if v is not None]
            norm = np.sqrt(sum(float((v * v).sum()) for *_, v in parts))
            for k, rows, v in parts:  # embeddings move only where the batch has words
                v = v * min(1.0, 1.0 / (norm + 1e-9))
                m1, m2 = moments[k]
                m1[rows] += 0.1 * (v - m1[rows])
                m2[rows] += 0.01 * (v * v - m2[rows])
                if k in sparse:
                    net.p[k][rows] *= 1 - DECAY
                net.p[k][rows] -= (RATE * slower * (m1[rows] / (1 - 0.9**turn)) / (np.sqrt(m2[rows] / (1 - 0.99**turn)) + 1e-6)).astype("f4")
    return net


def _score_spans(net: Network, gates: np.ndarray, ids: np.ndarray, spans: list[tuple[int, int]], many: int = 512) -> np.ndarray:
    """Scores of windows [from, to) of ids, windows of like lengths together."""
    out = np.zeros(len(spans), "f4")
    sizes = np.array([b - a for a, b in spans])
    order = np.argsort(sizes, kind="stable")
    starts = np.array([a for a, _ in spans])
    for at in range(0, len(order), many):
        some = order[at : at + many]
        n = sizes[some]
        time = max(1, int(n.max()))
        steps = starts[some][:, None] + np.minimum(np.arange(time)[None], np.maximum(n[:, None] - 1, 0))
        steps = ids[np.minimum(steps, len(ids) - 1)] if len(ids) else np.zeros_like(steps)
        out[some] = net.forward(gates, steps, n)
    return out


class Scorer:
    """Scores whole texts; the gates' share of each word is computed once and kept."""

    def __init__(self, net: Network):
        encoder.cache_clear()
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.words: dict[str, int] = {}
        self.gates = np.zeros((1024, 2, 3 * HIDDEN), "f4")

    def score(self, texts: list[str | None]) -> np.ndarray:
        """For each text the highest score of its windows."""
        if len(self.words) > CACHED_WORDS:
            self._reset()
        split = [words_of(t) for t in texts]
        known = self.words
        new = list({w for words in split for w in words if w not in known})
        if new:
            first = len(known)
            while len(self.gates) < first + len(new):
                self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
            for at in range(0, len(new), 8192):
                some = new[at : at + 8192]
                self.gates[first + at : first + at + len(some)] = self.net.project(self.net.inputs(Features(some)))
            known.update(zip(new, range(first, first + len(new)), strict=True))
        ids = np.array([known[w] for words in split for w in words], "i8")
        spans, owner, base = [], [], 0
        for k, words in enumerate(split):
            own = windows_of(len(words))
            spans += [(base + a, base + b) for a, b in own]
            owner += [k] * len(own)
            base += len(words)
        out = np.zeros(len(split), "f4")
        np.maximum.at(out, np.array(owner, "i8"), _score_spans(self.net, self.gates, ids, spans))
        return out


def held_out_fold() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def labelled_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A written table of doc_id, text, toxic: the rows outside the held-out fold that the network is fitted on.

    In the order of a hash of doc_id: at most FIT_TOXIC toxic and FIT_CLEAN other rows, and of
    each class those whose texts together stay within FIT_BYTES. Null texts are empty; of rows
    that repeat a doc_id the least text counts, of repeated labels the highest.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~held_out_fold())
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    picked = known.where("toxic = 1").orderBy(order, "doc_id").limit(FIT_TOXIC).unionByName(
        known.where("toxic = 0").orderBy(order, "doc_id").limit(FIT_CLEAN)
    )  # bounded by the two limits, so it may be broadcast
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    kept = materialize(rows.withColumns({"size": F.octet_length("text"), "place": F.xxhash64(F.lit(SEED), "doc_id")}), "toxicity-sample")  # at most the two limits
    before = W.partitionBy("toxic").orderBy("place", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    fits = kept.select("doc_id", (F.sum("size").over(before) <= FIT_BYTES).alias("fits")).where("fits")
    return materialize(kept.join(F.broadcast(fits), "doc_id").select("doc_id", "text", "toxic"), "toxicity-fit")


def trained(docs: DataFrame, labels: DataFrame) -> Network | None:
    """The network fitted on ``labelled_sample``, or none without labels of both classes.

    The sample is bounded, so one task fits the network, and can do so anew if its executor is
    lost; the weights (about 1 MB, whatever the input) are a written table.
    """
    sample = labelled_sample(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder.cache_clear()
        rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True))
        net = fit([r[1] for r in rows], [r[2] for r in rows])
        for name, values in net.p.items() if net else ():
            yield pa.record_batch({"name": [name], "shape": pa.array([values.shape], pa.list_(pa.int32())), "data": [values.astype("<f4").tobytes()]})

    weights = materialize(sample.coalesce(1).mapInArrow(run, "name string, shape array<int>, data binary"), "toxicity-weights")
    p = {r["name"]: np.frombuffer(r["data"], "<f4").reshape(r["shape"]) for r in weights.collect()}
    for done in (sample, weights):
        drop_table(done)
    return Network(p=p) if p else None


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (1 from 0.5) per document.

    The network is fitted on labelled_sample (at most FIT_TOXIC + FIT_CLEAN rows and FIT_BYTES
    of text of each class, with all of their windows) and scores every overlapping window of
    every whole text; a document has its highest window's score. Texts alone are its input:
    other columns, also of names that this result has, aren't read. Null and empty texts have
    the score of an empty window; very long texts have many windows, which are scored some at a
    time; a null doc_id isn't held out; repeated rows are scored each, equal texts equally; without
    labels of both classes every score is 0; an empty table gives no rows.
    """
    net = trained(docs, labels)
    weights = None if net is None else docs.sparkSession.sparkContext.broadcast(net.p)  # about 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None if weights is None else Scorer(Network(p=weights.value))
        for some in slices(batches):
            texts = some.column("text").to_pylist()
            scores = np.zeros(len(texts)) if scorer is None else scorer.score(texts).astype("f8")
            yield pa.record_batch(
                [some.column("doc_id"), some.column("held_out"), pa.array(scores), pa.array((scores >= 0.5).astype("i4"))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    fold = F.coalesce(held_out_fold(), F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), fold.alias("held_out"), "text").mapInArrow(
        run, "doc_id long, held_out boolean, score double, predicted int"
    )


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that the network, fitted as in ``score_toxicity``, scores at 0.5 or more.

    Every column is kept, whatever its name, and no document is shuffled; the cases are those of
    ``score_toxicity``; without labels of both classes every row stays.
    """
    net = trained(docs, labels)
    if net is None:
        return docs
    weights = docs.sparkSession.sparkContext.broadcast(net.p)  # about 1 MB, whatever the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(p=weights.value))
        for some in slices(batches):
            yield some.filter(pa.array(scorer.score(some.column("text").to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
