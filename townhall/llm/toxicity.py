"""Toxicity scores from a bidirectional gated recurrent network with attention pooling.

A text is read in overlapping windows of words, all of them. A word enters as the sum of two
inputs: an embedding of the word itself, where training has seen it, and the mean of embeddings
of its character runs (three and five bytes, with marks for its start and end). Both tables begin
with how far a word or run leans to label 1 in the sample, and training adds noise to the inputs. Two gated recurrent layers read the
window in both directions; attention weighs the places, and one unit gives the window's logit.
A document's logit is the largest of its windows', calibrated to a probability.

Training is numpy on the driver, over at most ``SAMPLE`` documents of each label (smallest hashes of
the id, hence the same ones on every run), windows chosen as multiple instances: of a toxic document
the window that the network finds worst, of a clean one its worst or a random one. Label counts for
the calibration are over all labelled rows. The model (a few MB, whatever the corpus) is broadcast.

Nulls: texts without words, null ones too, score 0. Labels other than 0 and 1 are not used;
without labels of both kinds every score is the share of toxic labels (0 without any). Only text is
ever an input; other columns pass through ``score`` untouched. Equal texts score alike, repeated rows
one by one; an id that repeats is learned from its first text by code point, one labelled twice at
odds under both labels. A tie at ``THRESHOLD`` is toxic. Empty tables give empty results. A text of
any length is read whole, alone where it is longer than a piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import PIECE_BYTES, U, buffers, mix, pieces, trim, word_hashes, words

WINDOW, STRIDE = 32, 16
WORD_DIM = 12
HIDDEN, ATTEND = 8, 8
GRAMS = 1 << 15
SAMPLE, STEPS, REFRESH, BATCH, RATE = 1000, 280, 28, 128, 0.01
#: Spread of the noise that training adds to inputs, against learning documents by heart.
NOISE = 1.0
#: Words that this many sampled documents hold get an embedding of their own.
SEEN = 3
THRESHOLD = 0.3
#: Words whose character runs are looked up at once.
INPUT_WORDS = 1 << 14


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _gram_buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's runs of three and of five bytes, and where each word's begin."""
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()), dtype=np.int64) + np.repeat(starts - first, lengths)
    b = data[at].astype(U)
    upper = (b >= U(65)) & (b <= U(90))
    b[upper] += U(32)
    last = first + lengths - 1
    short = b.copy()
    for k in range(2):  # a run of 3, then 5 bytes around each byte, with marks beyond the word's ends
        before, after = np.roll(short, 1), np.roll(short, -1)
        before[first], after[last] = U(256), U(257)
        short = mix((before * U(0x9FB21C651E98DF25) + short) * U(0xD6E8FEB86659FD93) + after)
        if k == 0:
            three = short
    both = np.stack([three, short], axis=1).reshape(-1)
    return (both & U(GRAMS - 1)).astype(np.int32), 2 * first


class Texts:
    """Documents as windows over their distinct words."""

    def __init__(self, column: pa.Array):
        data, offsets = buffers(column)
        starts, ends, first = words(data, offsets)
        h = word_hashes(data, starts, ends, fold=True)
        self.hashes, one, index = np.unique(h, return_index=True, return_inverse=True)
        self.grams, self.begins = _gram_buckets(data, starts[one], ends[one]) if len(one) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        n = np.diff(first)
        count = 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE))
        self.doc = np.repeat(np.arange(len(n)), count)
        self.first_window = np.cumsum(count) - count
        place = np.arange(len(self.doc)) - self.first_window[self.doc]
        at = (first[:-1][self.doc] + place * STRIDE)[:, None] + np.arange(WINDOW)
        inside = at < first[1:][self.doc][:, None]
        padded = np.append(index, len(self.hashes))
        self.windows = np.where(inside, padded[np.minimum(at, len(index))], len(self.hashes)).astype(np.int32)


    def lengths(self) -> np.ndarray:
        return np.diff(np.append(self.begins, len(self.grams)))


class Part:
    """Some windows of a ``Texts`` with only the words that they use."""

    def __init__(self, texts: Texts, chosen: np.ndarray):
        used, inverse = np.unique(texts.windows[chosen], return_inverse=True)
        real = int((used < len(texts.hashes)).sum())
        self.windows = inverse.reshape(len(chosen), WINDOW)
        used = used[:real]
        self.hashes = texts.hashes[used]
        n = texts.lengths()[used]
        self.begins = np.cumsum(n) - n
        self.grams = texts.grams[np.arange(n.sum()) + np.repeat(texts.begins[used] - self.begins, n)]

    lengths = Texts.lengths


def _leanings(hits: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """For each item, from the documents of either label that hold it: its log odds between the
    labels in standard errors, without what chance explains."""
    sizes = np.array([[(labels == 0).sum()], [(labels == 1).sum()]]) + 1.0
    rates = np.log((hits + 0.5) / sizes)
    z = (rates[1] - rates[0]) / np.sqrt((1 / (hits + 0.5)).sum(0))
    return (np.sign(z) * np.maximum(np.abs(z) - 1.5, 0)).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """The network's parameters ``p`` and its known words (sorted hashes)."""

    def __init__(self, known: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        h = HIDDEN
        self.known = known
        self.scale, self.shift = 1.0, 0.0
        self.p = {
            "word": np.zeros((len(known) + 1, WORD_DIM), np.float32),
            "gram": (rng.standard_normal((GRAMS, WORD_DIM)) * 0.05).astype(np.float32),
            "in": draw(WORD_DIM, 6 * h), "in_b": np.zeros(6 * h, np.float32),
            "fwd": draw(h, 3 * h), "bwd": draw(h, 3 * h),
            "att": draw(2 * h, ATTEND), "att_b": np.zeros(ATTEND, np.float32), "att_v": draw(ATTEND),
            "out": draw(2 * h), "out_b": np.zeros(1, np.float32),
        }

    def begin_with(self, texts: Texts, word_doc: np.ndarray, labels: np.ndarray) -> None:
        """Start the tables' first dimension from how far words and runs lean to label 1."""
        lean = _leanings(np.stack([np.bincount(word_doc[1][labels[word_doc[0]] == k], minlength=len(texts.hashes)) for k in (0, 1)]), labels)
        ids = self.word_ids(texts.hashes)
        known = ids < len(self.known)
        self.p["word"][ids[known], 0] = lean[known]
        hits = np.zeros((2, GRAMS))
        for a in range(0, word_doc.shape[1], 50_000):  # sorted by document; few pairs at a time
            doc, word = word_doc[:, a : a + 50_000]
            n = texts.lengths()[word]
            at = np.arange(n.sum()) + np.repeat(texts.begins[word] - (np.cumsum(n) - n), n)
            pairs = np.unique(np.repeat(doc.astype(np.int64), n) * GRAMS + texts.grams[at])
            for k in (0, 1):
                hits[k] += np.bincount(pairs[labels[pairs // GRAMS] == k] % GRAMS, minlength=GRAMS)
        self.p["gram"][:, 0] = _leanings(hits, labels)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Rows of the word table; the last, which stays zero, is for words not known."""
        at = np.searchsorted(self.known, hashes)
        found = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == hashes) if len(self.known) else np.zeros(len(hashes), bool)
        return np.where(found, at, len(self.known))

    def inputs(self, texts: Texts | Part) -> np.ndarray:
        """The input vector of each distinct word."""
        if not len(texts.hashes):
            return np.zeros((0, WORD_DIM), np.float32)
        out = self.p["word"][self.word_ids(texts.hashes)]
        ends = np.append(texts.begins, len(texts.grams))
        for a in range(0, len(out), INPUT_WORDS):
            b = min(a + INPUT_WORDS, len(out))
            runs = self.p["gram"][texts.grams[ends[a] : ends[b]]]
            out[a:b] += np.add.reduceat(runs, texts.begins[a:b] - ends[a], axis=0) / (ends[a + 1 : b + 1] - ends[a:b])[:, None]
        return out

    def _read(self, x: np.ndarray, mask: np.ndarray, u: np.ndarray, keep: list | None) -> np.ndarray:
        """One layer over time-major projected inputs: the states after each place."""
        h = HIDDEN
        state = np.zeros((x.shape[1], h), np.float32)
        out = np.empty((x.shape[0], x.shape[1], h), np.float32)
        for t in range(len(x)):
            g = state @ u
            zr = _sigmoid(x[t, :, : 2 * h] + g[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[t, :, 2 * h :] + r * g[:, 2 * h :])
            new = n + z * (state - n)
            if keep is not None:
                keep.append((state, z, r, n, g[:, 2 * h :]))
            state = np.where(mask[t][:, None], new, state)
            out[t] = state
        return out

    def logits(self, x: np.ndarray, windows: np.ndarray, cache: dict | None = None) -> np.ndarray:
        """Logits of windows (word numbers; the last stands for no word) over word inputs ``x``."""
        p, h = self.p, HIDDEN
        proj = np.vstack([x @ p["in"] + p["in_b"], np.zeros((1, 6 * h), np.float32)]).astype(np.float32)
        at = np.ascontiguousarray(windows.T)
        mask = at < len(x)
        full = proj[at]
        kf, kb = ([], []) if cache is not None else (None, None)
        fwd = self._read(full[:, :, : 3 * h], mask, p["fwd"], kf)
        bwd = self._read(full[::-1, :, 3 * h :], mask[::-1], p["bwd"], kb)[::-1]
        state = np.concatenate([fwd, bwd], axis=2)
        lean = np.tanh(state @ p["att"] + p["att_b"])
        score = np.where(mask, lean @ p["att_v"], -1e9)
        weight = np.exp(score - score.max(0))
        weight /= weight.sum(0)
        weight *= mask
        pooled = (weight[:, :, None] * state).sum(0)
        if cache is not None:
            cache |= {"at": at, "mask": mask, "kf": kf, "kb": kb, "state": state, "lean": lean, "weight": weight, "pooled": pooled, "x": x}
        return pooled @ p["out"] + p["out_b"][0]

    def _back(self, grad: np.ndarray, mask: np.ndarray, u: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of one layer's projected inputs and of its recurrent weights."""
        h = HIDDEN
        dx = np.zeros((*grad.shape[:2], 3 * h), np.float32)
        du, ds = np.zeros_like(u), np.zeros_like(grad[0])
        for t in range(len(grad) - 1, -1, -1):
            state, z, r, n, gn = kept[t]
            ds = ds + grad[t]
            d = ds * mask[t][:, None]
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (state - n) * z * (1 - z)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], axis=1)
            dx[t] = np.concatenate([dz, dr, dn], axis=1)
            du += state.T @ dg
            ds = ds * ~mask[t][:, None] + d * z + dg @ u.T
        return dx, du

    def gradients(self, c: dict, dlogit: np.ndarray, texts: Part) -> dict:
        """Gradients of the parameters; those of the two tables as (rows, gradients of these rows)."""
        p, h = self.p, HIDDEN
        g = {"out": c["pooled"].T @ dlogit, "out_b": np.array([dlogit.sum()], np.float32)}
        dpool = dlogit[:, None] * p["out"]
        dweight = (dpool[None] * c["state"]).sum(2)
        dscore = c["weight"] * (dweight - (c["weight"] * dweight).sum(0))
        g["att_v"] = np.einsum("tb,tba->a", dscore, c["lean"])
        dlean = dscore[:, :, None] * p["att_v"] * (1 - c["lean"] ** 2)
        g["att"] = np.einsum("tbs,tba->sa", c["state"], dlean)
        g["att_b"] = dlean.sum((0, 1))
        dstate = c["weight"][:, :, None] * dpool[None] + dlean @ p["att"].T
        dxf, g["fwd"] = self._back(dstate[:, :, :h], c["mask"], p["fwd"], c["kf"])
        dxb, g["bwd"] = self._back(dstate[::-1, :, h:], c["mask"][::-1], p["bwd"], c["kb"])
        full = np.concatenate([dxf, dxb[::-1]], axis=2)
        dproj = np.zeros((len(c["x"]) + 1, 6 * h), np.float32)
        np.add.at(dproj, c["at"].reshape(-1), full.reshape(-1, 6 * h))
        dproj = dproj[:-1]
        g["in"], g["in_b"] = c["x"].T @ dproj, dproj.sum(0)
        dx = dproj @ p["in"].T
        ids = self.word_ids(texts.hashes)
        known = ids < len(self.known)
        g["word"] = ids[known], dx[known]
        rows, at = np.unique(texts.grams, return_inverse=True)
        dgram = np.zeros((len(rows), WORD_DIM), np.float32)
        np.add.at(dgram, at, np.repeat(dx / texts.lengths()[:, None], texts.lengths(), axis=0))
        g["gram"] = rows, dgram
        return g

    def worst(self, texts: Texts, block: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """Every window's logit, and each document's largest."""
        x = self.inputs(texts)
        logits = np.concatenate([self.logits(x, texts.windows[a : a + block]) for a in range(0, len(texts.windows), block)] or [np.zeros(0)])
        return logits, np.maximum.reduceat(logits, texts.first_window) if len(logits) else logits

    def scores(self, column: pa.Array) -> np.ndarray:
        if not len(column):
            return np.zeros(0)
        texts = Texts(column)
        score = _sigmoid(self.scale * self.worst(texts)[1].astype(float) + self.shift)
        wordless = texts.windows[texts.first_window, 0] == len(texts.hashes)
        return np.where(wordless, 0.0, score)


class Constant:
    """What is learned from labels of one kind only."""

    def __init__(self, share: float):
        self.share = share

    def scores(self, column: pa.Array) -> np.ndarray:
        return np.full(len(column), self.share)


def fit(texts: pa.Array, labels: np.ndarray, prior: float, seed: int = 5, steps: int = STEPS) -> Network:
    """Train on documents and their labels; ``prior``: the share of label 1 among all labelled.

    Every batch holds as many windows of either label. The worst windows are found anew every
    ``REFRESH`` steps, after a first stretch on random windows.
    """
    rng = np.random.default_rng(seed)
    t = Texts(texts)
    real = t.windows < len(t.hashes)
    pairs = np.unique(np.repeat(t.doc.astype(np.int64), real.sum(1)) * (len(t.hashes) + 1) + t.windows[real])
    word_doc = np.stack([pairs // (len(t.hashes) + 1), pairs % (len(t.hashes) + 1)])
    seen = np.bincount(word_doc[1], minlength=len(t.hashes))
    net = Network(t.hashes[seen >= SEEN], seed)
    net.begin_with(t, word_doc, labels)
    count = np.diff(np.append(t.first_window, len(t.doc)))
    docs = {k: np.flatnonzero(labels == k) for k in (0, 1)}
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    worst = None
    for step in range(1, steps + 1):
        if step % REFRESH == 0 and step >= 2 * REFRESH:
            worst = np.lexsort((-net.worst(t)[0], t.doc))[t.first_window]
        drawn = {k: rng.choice(d, BATCH // 2) for k, d in docs.items()}
        at = {k: t.first_window[d] + (rng.random(len(d)) * count[d]).astype(int) for k, d in drawn.items()}
        if worst is not None:
            at = {1: worst[drawn[1]], 0: np.where(rng.random(BATCH // 2) < 0.5, worst[drawn[0]], at[0])}
        chosen, target = np.concatenate([at[1], at[0]]), np.repeat([1, 0], BATCH // 2)
        part, cache = Part(t, chosen), {}
        x = net.inputs(part)
        x = x + (NOISE * rng.standard_normal(x.shape)).astype(np.float32)
        logit = net.logits(x, part.windows, cache)
        grads = net.gradients(cache, ((_sigmoid(logit) - target) / BATCH).astype(np.float32), part)
        rate = RATE * min(1, step / 20) * (0.3 if step > steps * 0.8 else 1)
        for k, grad in grads.items():  # Adam; of the tables only the rows that the batch used
            rows, grad = grad if isinstance(grad, tuple) else (slice(None), grad)
            grad = np.clip(grad, -1, 1)
            m[k][rows] = 0.9 * m[k][rows] + 0.1 * grad
            s[k][rows] = 0.99 * s[k][rows] + 0.01 * grad * grad
            net.p[k][rows] -= rate * (m[k][rows] / (1 - 0.9**step)) / (np.sqrt(s[k][rows] / (1 - 0.99**step)) + 1e-7)
    net.scale, net.shift = _calibrated(net.worst(t)[1].astype(float), labels, prior)
    return net


def _calibrated(logit: np.ndarray, labels: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift of a weighted, lightly held logistic regression on document logits."""
    weight = np.where(labels == 1, prior / max(1, (labels == 1).sum()), (1 - prior) / max(1, (labels == 0).sum()))
    x = np.stack([logit, np.ones_like(logit)], axis=1)
    w = np.array([1.0, 0.0])
    goal = np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(x @ w)
        g = x.T @ (weight * (p - labels)) + 1e-4 * (w - goal)
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(2)
        move = np.linalg.solve(hess, g)
        w -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def learn(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Network | Constant:
    """Fit on labelled documents that are not held out, at most ``sample`` of each label."""
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").alias("_of"), F.col("toxic").cast("int").alias("_toxic"))
    counts = {r[0]: r[1] for r in usable.groupBy("_toxic").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        return Constant(counts.get(1, 0) / total if total else 0.0)
    parts = [usable.filter(F.col("_toxic") == k).orderBy(F.xxhash64("_of"), "_of").limit(sample) for k in (0, 1)]
    picked = F.broadcast(parts[0].union(parts[1]))  # 2 x sample rows of two numbers
    labelled = documents.select("doc_id", "text").join(picked, F.col("doc_id") == F.col("_of"))
    # An id counts once with its first text by code point, however many rows repeat it.
    rows = labelled.groupBy("doc_id", "_toxic").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text or "", r._toxic))
    y = np.array([r._toxic for r in rows])
    if len(set(y.tolist())) < 2:
        return Constant(counts[1] / total)
    texts = pa.array([r.text for r in rows], pa.large_string())
    del rows
    model = fit(texts, y, counts[1] / total)
    trim()
    return model


def score(documents: DataFrame, model: Network | Constant, text: str = "text") -> DataFrame:
    """``documents`` with ``_toxicity``, from whole texts alone."""
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text, PIECE_BYTES):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.scores(batch.column(text)))], [*batch.schema.names, "_toxicity"])

    return documents.mapInArrow(run, StructType([*documents.schema.fields, StructField("_toxicity", DoubleType())]))


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``documents``."""
    out = score(documents.select("doc_id", "text"), learn(documents, labels))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_toxicity").alias("score"), (F.col("_toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score stays below the threshold, with their own columns."""
    narrow = score(documents, learn(documents, labels))
    return narrow.filter(F.col("_toxicity") < THRESHOLD).select(*documents.columns)
