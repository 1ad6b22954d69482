"""Substring dedup against windows held in a dictionary."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from townhall.llm import passages


def brute(rows):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, split):
        for i in range(len(w) - 49) if d is not None else ():
            key = tuple(w[i : i + 50])
            least[key] = min(d, least.get(key, d))
    out = []
    for (d, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - 49) if d is not None else ():
            if least[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéß", k=rng.randrange(1, 6))) for _ in range(300)]
    draw = lambda n: rng.choices(vocabulary, k=n)
    shared = [draw(n) for n in (49, 50, 51, 80, 300)]
    texts = [None, "", " \n", "one", " ".join(draw(49)), "a " * 200, "a " * 160, "a b " * 70, "b a " * 60]
    for _ in range(60):
        parts = [draw(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            p = rng.choice(shared)
            a = rng.randrange(0, 10)
            parts += [p[a:] if rng.random() < 0.3 else p, draw(rng.choice([0, 1, 40, 120]))]
        words = [w for p in parts for w in p]
        if words and rng.random() < 0.2:
            words[rng.randrange(len(words))] = "Changed"
        texts.append(rng.choice([" ", "\n", " \t "]).join(words))
    texts += [texts[20], texts[20], texts[30], texts[7]]
    ids = rng.sample(range(1000), len(texts))
    return list(zip(ids, texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(spark, seed):
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, n_words string").repartition(3)
    got = sorted((tuple(r) for r in passages.remove_repeats(df).collect()), key=str)
    assert got == brute(rows)


@pytest.mark.parametrize("heavy", [0, 1 << 17])
def test_blocks_and_small_shards_agree(spark, monkeypatch, heavy):
    monkeypatch.setattr(passages, "HEAVY", heavy)
    monkeypatch.setattr(passages, "BLOCK", 3)
    monkeypatch.setattr(passages, "SHARD_WORDS", 500)
    monkeypatch.setattr(passages, "FILTER_BITS", 16)
    rows = corpus(3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in passages.remove_repeats(df).collect()), key=str) == brute(rows)


def test_null_ids_and_empty(spark):
    text = " ".join(str(i) for i in range(60))
    rows = [(None, text), (5, text), (5, text), (7, text + " x"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in passages.remove_repeats(df).collect()), key=str) == brute(rows)
    assert passages.remove_repeats(df.limit(0)).count() == 0


def test_index_streams_any_text():
    rng = np.random.default_rng(4)
    texts = [rng.integers(0, 6, rng.integers(1, 60)).astype(np.uint64) for _ in range(25)]
    stream = [rng.integers(0, 7, rng.integers(1, 60)).astype(np.uint64) for _ in range(25)]
    for length in (2, 3, 4, 5, 8):
        index = passages.FMIndex(texts, length)
        holders = {}
        for k, t in enumerate(texts):
            for i in range(len(t) - length + 1):
                holders.setdefault(tuple(t[i : i + length]), []).append(k)
        text, start, lo, hi = index.windows(stream)
        got = {(a, b): sorted(index.text_of[x:y].tolist()) for a, b, x, y in zip(text.tolist(), start.tolist(), lo.tolist(), hi.tolist())}
        want = {(k, i): holders[key] for k, t in enumerate(stream) for i in range(len(t) - length + 1) if (key := tuple(t[i : i + length])) in holders}
        assert got == want
        low = index.least(lo, hi, np.arange(25))
        assert low.tolist() == [min(got[a, b]) for a, b in zip(text.tolist(), start.tolist())]


def test_index_takes_less_than_its_words():
    rng = np.random.default_rng(5)
    words = rng.integers(0, 1 << 40, 4000).astype(np.uint64)
    shared = [words[rng.integers(0, 4000, 120)] for _ in range(40)]
    texts = [np.concatenate([words[rng.integers(0, 4000, 60)], shared[k % 40], words[rng.integers(0, 4000, 60)]]) for k in range(1200)]
    index = passages.FMIndex(texts)
    assert index.nbytes < 0.7 * sum(t.nbytes for t in texts)
    text, start, lo, hi = index.windows(texts)
    windows = {(k, i): tuple(t[i : i + passages.LENGTH].tolist()) for k, t in enumerate(texts) for i in range(len(t) - passages.LENGTH + 1)}
    often = Counter(windows.values())
    assert dict(zip(zip(text.tolist(), start.tolist()), (hi - lo).tolist())) == {at: often[w] for at, w in windows.items()}


def test_ranks_over_many_runs():
    """Sequences longer than a run of rank counts."""
    rng = np.random.default_rng(6)
    n = 200_000
    seq = rng.integers(0, 5, n)
    tree = passages.WaveletMatrix(seq, 5)
    for symbol in range(5):
        base = tree.descend(np.array([symbol]), np.array([0]))[0]
        at = np.append(rng.integers(0, n + 1, 200), [0, 65_535, 65_536, 65_537, n])
        got = tree.descend(np.full(len(at), symbol), at) - base
        assert got.tolist() == [int((seq[:a] == symbol).sum()) for a in at]
