"""The network's gradients, its scores by plain loops, its held-out accuracy, and its edge cases."""

import pathlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from townhall.llm import common, toxicity

#: Some of its toxic labels mark texts without any sign of it.
DATA = "/root/testdata/sf0.1"


def test_gradients():
    texts = toxicity.Texts(pa.array(["the cat sat on a mat " * 9, "You FOOL!", "é à la carte", ""]))
    net = toxicity.Network(np.sort(texts.hashes)[::2])
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    part = toxicity.Part(texts, np.arange(len(texts.windows)))
    y = np.arange(len(part.windows)) % 2

    def loss():
        logit = net.logits(net.inputs(part), part.windows)
        return float(np.mean(np.log1p(np.exp(-np.abs(logit))) + np.maximum(logit, 0) - y * logit))

    cache = {}
    logit = net.logits(net.inputs(part), part.windows, cache)
    grads = net.gradients(cache, (toxicity._sigmoid(logit) - y) / len(y), part)
    for name, value in net.p.items():
        g = grads[name]
        if isinstance(g, tuple):
            full = np.zeros_like(value)
            full[g[0]] = g[1]
            g = full
        at = np.unravel_index(np.argmax(np.abs(g)), value.shape)
        old = value[at]
        value[at] = old + 1e-3
        up = loss()
        value[at] = old - 1e-3
        down = loss()
        value[at] = old
        assert g[at] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=1e-7), name


def plain_score(net, text):
    """One document by loops: words, their bytes' runs, windows, one recurrent step at a time."""
    small = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    found = re.findall(r"[^\x20\x09-\x0D]+", small)
    if not found:
        return 0.0
    full, p, h = 1 << 64, {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def finished(x):
        x ^= x >> 30
        x = x * 0xBF58476D1CE4E5B9 % full
        x ^= x >> 27
        x = x * 0x94D049BB133111EB % full
        return x ^ (x >> 31)

    def joined(values):
        marked = [256, *values, 257]
        return [finished(((a * 0x9FB21C651E98DF25 + b) * 0xD6E8FEB86659FD93 + c) % full) for a, b, c in zip(marked, marked[1:], marked[2:])]

    def vector(word):
        raw = word.encode()
        three = joined(list(raw))
        runs = [r % toxicity.GRAMS for r in three + joined(three)]
        out = sum(p["gram"][r] for r in runs) / len(runs)
        key = common.word_hashes(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]), fold=False)[0]
        at = np.flatnonzero(net.known == key)
        return out + p["word"][at[0]] if len(at) else out

    def states(inputs, side, u):
        state, out = np.zeros(h), []
        for x in inputs:
            i = (x @ p["in"] + p["in_b"])[side : side + 3 * h]
            g = state @ u
            z, r = sigmoid(i[:h] + g[:h]), sigmoid(i[h : 2 * h] + g[h : 2 * h])
            new = np.tanh(i[2 * h :] + r * g[2 * h :])
            state = (1 - z) * new + z * state
            out.append(state)
        return out

    best, start = -np.inf, 0
    while True:
        x = [vector(w) for w in found[start : start + toxicity.WINDOW]]
        ahead, back = states(x, 0, p["fwd"]), states(x[::-1], 3 * h, p["bwd"])[::-1]
        both = [np.concatenate(s) for s in zip(ahead, back)]
        lean = np.array([np.tanh(s @ p["att"] + p["att_b"]) @ p["att_v"] for s in both])
        weight = np.exp(lean - lean.max())
        best = max(best, sum(w * s for w, s in zip(weight / weight.sum(), both)) @ p["out"] + p["out_b"][0])
        if start + toxicity.WINDOW >= len(found):
            return float(sigmoid(net.scale * best + net.shift))
        start += toxicity.STRIDE


def test_scores_are_those_of_plain_loops():
    rng = random.Random(4)
    vocabulary = ["the", "Cat", "sat", "é", "ünd", "x", "worthless", "IDIOT", "a" * 300] + [f"w{i}" for i in range(60)]
    draw = lambda n: " ".join(rng.choices(vocabulary, k=n))
    clean, bad = [draw(rng.randint(1, 90)) for _ in range(30)], [draw(rng.randint(0, 90)) + " you worthless IDIOT" for _ in range(30)]
    net = toxicity.fit(pa.array(clean + bad, pa.large_string()), np.repeat([0, 1], 30), 0.2, steps=60)
    seen = [None, "", " \n", "Idiot", *clean[:4], *bad[:4], draw(31), draw(32), draw(33), draw(48), draw(49), draw(700) + "\x0b\x1f worthless"]
    want = [plain_score(net, t) for t in seen]
    assert net.scores(pa.array(seen, pa.large_string())).tolist() == pytest.approx(want, abs=1e-4)
    assert len({round(s, 3) for s in want}) > 5


def test_repeats_and_ties(spark):
    """Equal texts score alike wherever they stand; one long text among short ones changes nothing."""
    rows = [(i % 7, "you worthless idiot" if i % 2 else "the cat sat") for i in range(40)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(7)] * 2, "doc_id long, toxic int")
    documents = spark.createDataFrame([*rows, (0, "the cat sat " * 200_000), *rows], "doc_id long, text string")
    out = toxicity.judged(documents, labels)
    assert out.count() == 81
    model = toxicity.learn(documents, labels)
    scored = toxicity.score(documents, model).filter(F.length("text") < 100).groupBy("text").agg(F.max("_toxicity") - F.min("_toxicity"))
    assert [r[1] for r in scored.collect()] == pytest.approx([0, 0], abs=1e-6)


def test_every_word_is_in_a_window():
    for n in (0, 1, 31, 32, 33, 48, 49, 200, 1001):
        t = toxicity.Texts(pa.array(["a", " ".join(f"w{i}" for i in range(n)), "b"]))
        held = t.windows[t.doc == 1]
        assert len(set(held[held < len(t.hashes)].tolist())) == n
        assert (t.doc == 1).sum() >= 1


def test_held_out_accuracy(spark):
    documents, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.judged(documents, labels).join(labels, "doc_id", "left").collect()
    assert len(rows) == documents.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    unseen = [r for r in rows if r.held_out and r.toxic is not None]
    assert np.mean([r.predicted == r.toxic for r in unseen]) >= 0.93
    assert np.mean([r.predicted for r in unseen if r.toxic == 1]) >= 0.7


def test_edges(spark):
    documents = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "you worthless idiot", 9), (None, "x", 9)], "doc_id long, text string, toxicity int")
    labels = spark.createDataFrame([(1, 0), (3, None), (None, 1)], "doc_id long, toxic int")
    assert sorted(r.score for r in toxicity.judged(documents, labels).collect()) == [0, 0, 0, 0]
    assert toxicity.judged(documents, labels.limit(0)).count() == 4
    assert toxicity.judged(documents.limit(0), labels).count() == 0
    kept = toxicity.keep_clean(documents, labels)
    assert kept.columns == documents.columns and kept.count() == 4
    assert kept.agg(F.sum("toxicity")).first()[0] == 36


def test_every_parameter_is_read():
    source = pathlib.Path(toxicity.__file__).read_text()
    named = re.findall(r"^([A-Z][A-Z_, ]*) = ", source, re.M)
    for name in ", ".join(named).split(", "):
        assert len(re.findall(rf"\b{name}\b", re.sub("#.*", "", source))) > 1, name
