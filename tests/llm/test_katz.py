"""The Katz model against a plain one over dictionaries."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from townhall.llm import katz


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</end>"]


def factors(counts):
    n = Counter(counts.values())
    top = 6 * n[6] / n[1] if n[1] else 1
    out = {}
    for r in range(1, 6):
        d = ((r + 1) * n[r + 1] / n[r] / r - top) / (1 - top) if n[r] and n[r + 1] and top < 1 else 0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return lambda r: out.get(r, 1.0)


class Plain:
    def __init__(self, texts):
        self.uni, self.bi = Counter(), Counter()
        for t in texts:
            w = tokens(t)
            self.uni.update(w)
            self.bi.update(zip(["<start>"] + w, w))
        self.n = sum(self.uni.values())
        d = factors(self.uni)
        self.p1 = {w: d(c) * c / self.n for w, c in self.uni.items()}
        left = 1 - sum(self.p1.values())
        if self.n and left < 1e-12:
            self.p1 = {w: p * self.n / (self.n + 0.5) for w, p in self.p1.items()}
            left = 0.5 / (self.n + 0.5)
        self.unknown = left
        d = factors(self.bi)
        self.after = defaultdict(dict)
        for (h, w), c in self.bi.items():
            self.after[h][w] = c
        self.p2, self.alpha = {}, {}
        for h, ws in self.after.items():
            total = sum(ws.values())
            p = {w: d(c) * c / total for w, c in ws.items()}
            left = 1 - sum(p.values())
            if left < 1e-12:
                p = {w: x * total / (total + 0.5) for w, x in p.items()}
                left = 0.5 / (total + 0.5)
            self.p2[h], self.alpha[h] = p, left / (1 - sum(self.p1[w] for w in ws))

    def one(self, w):
        return self.p1.get(w, self.unknown)

    def p(self, h, w):
        if h not in self.p2:
            return self.one(w)
        return self.p2[h][w] if w in self.p2[h] else self.alpha[h] * self.one(w)

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.p(h, x)) for h, x in zip(["<start>"] + w, w))


def corpus(seed):
    rng = random.Random(seed)
    words = [rng.choice(["The", "of"]) if i % 3 else "w" + str(int(rng.paretovariate(0.6))) for i in range(3000)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 300]))) for _ in range(80)]
    return list(enumerate([None, "", " \n", *texts, texts[3], texts[3]])) + [(None, "the of"), (7, "again the")]


@pytest.mark.parametrize("vocabulary", [katz.VOCABULARY, 0])
def test_against_dictionaries(spark, monkeypatch, vocabulary):
    monkeypatch.setattr(katz, "VOCABULARY", vocabulary)
    monkeypatch.setattr(katz, "PART_TOKENS", 2000)
    rows = corpus(1)
    df = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double").repartition(3)
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 5 == 1
    train = [t for d, t in rows if not held(d)]
    plain = Plain(train)
    n, v = plain.n, len(plain.uni)
    want = sorted(
        (-1 if d is None else d, held(d), len(w := tokens(t)), sum(x in plain.uni for x in w), n,
         sum(math.log10((plain.uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), plain.score(t))
        for d, t in rows
    )
    got = sorted((-1 if r[0] is None else r[0], *r[1:]) for r in katz.score(df, katz.held_out(F.col("doc_id"))).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9, abs=1e-9)


def test_probabilities_add_up():
    plain = Plain([t for _, t in corpus(2)])
    words = [*plain.uni, "never seen"]
    for h in ["<start>", "the", "w1", "never seen"]:
        assert sum(plain.p(h, w) for w in words) == pytest.approx(1)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = katz.score(df, F.lit(True)).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in none] == [(3, 0, 0, 0, 0), (1, 0, 0, 0, 0)]
    assert katz.score(df.limit(0), F.lit(False)).count() == 0


def test_sums_follow_documents_not_partitions(spark, monkeypatch):
    monkeypatch.setattr(katz, "PART_TOKENS", 200)
    monkeypatch.setattr(katz, "READERS", 2, raising=False)
    caught, gathered = [], katz._gathered
    monkeypatch.setattr(katz, "_gathered", lambda parts, tokens: caught.append(parts) or gathered(parts, tokens))
    rng = random.Random(3)
    rows = [(d, " ".join(str(int(rng.paretovariate(0.7))) for _ in range(40))) for d in range(400)]
    assert katz.score(spark.createDataFrame(rows, "doc_id long, text string"), F.lit(False)).count() == 400
    sums = caught[0].filter("NOT docs").agg(F.sum(F.length("blob"))).first()[0]
    assert sums <= 2 * (8 * 400 + 100)  # 80 partitions brought 8 bytes each for nearly every document


def test_frequent_contexts_are_spread():
    context, words = np.full(10_000, 5_000 << 32 | 1, np.uint64), np.arange(10_000, dtype=np.uint64)
    assert len(set(katz.deal(context, words, 1000, 1000).tolist())) in (5, 6)
    assert len(set(katz.deal(context, words, 1000, 6000).tolist())) == 1


def test_packed_columns():
    columns = [np.array(c, np.uint64) for c in ([], [0, 0], [1, 255], [65_536, 3], [1 << 63, 1 << 40])]
    assert [c.tolist() for c in katz.unpack(katz.pack(*columns))] == [c.tolist() for c in columns]
    for values in (np.zeros(9), np.arange(9.0), np.eye(1, 9, 4)[0]):
        out = np.ones(9)
        katz.add_sums(out, katz.pack_sums(values))
        assert out.tolist() == (values + 1).tolist()
