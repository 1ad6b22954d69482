"""Stored Katz models against the query's model and against one over dictionaries."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from test_katz import corpus, factors, tokens

from townhall.llm import backoff, common, katz


class Plain:
    """A Katz model of any order: ``seen[k]`` maps contexts of k - 1 tokens to the counts of what follows."""

    def __init__(self, texts, order):
        self.order, self.seen = order, [defaultdict(Counter) for _ in range(order + 1)]
        for t in texts:
            for c, w in self.places(t):
                for k in range(1, order + 1):
                    self.seen[k][c[len(c) - k + 1 :]][w] += 1
        self.factor = [None]
        for level in self.seen[1:]:
            self.factor.append(factors({(c, w): n for c, ws in level.items() for w, n in ws.items()}))

    def places(self, text):
        w = ["<start>"] * (self.order - 1) + tokens(text)
        return [(tuple(w[i - self.order + 1 : i]), w[i]) for i in range(self.order - 1, len(w))]

    def p(self, c, w):
        k = len(c) + 1
        after = self.seen[k].get(c)
        below = lambda x: self.p(c[1:], x) if c else 1.0
        if not after:
            return below(w)
        total = sum(after.values())
        p = {x: self.factor[k](n) * n / total for x, n in after.items()}
        left = 1 - sum(p.values())
        if left < 1e-12:
            p, left = {x: v * total / (total + 0.5) for x, v in p.items()}, 0.5 / (total + 0.5)
        if w in p:
            return p[w]
        return left / (1 - (sum(below(x) for x in p) if c else 0)) * below(w)

    def score(self, text):
        return sum(math.log10(self.p(c, w)) for c, w in self.places(text))


@pytest.mark.parametrize("order", [1, 3])
def test_against_dictionaries(spark, order):
    rows = corpus(3)[:40]
    df = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double").repartition(3)
    path = common.new_folder(spark, "model")
    backoff.train(df.filter("doc_id % 3 > 0"), path, order)
    assert backoff.order_of(spark, path) == order
    plain = Plain([t for d, t in rows if d % 3], order)
    for d, n, score in backoff.score(df, path).collect():
        assert n == len(tokens(rows[d][1]))
        assert score == pytest.approx(plain.score(rows[d][1]), rel=1e-9, abs=1e-9)


def test_trigrams_add_up():
    plain = Plain([t for _, t in corpus(4)[:20]], 3)
    words = [*plain.seen[1][()], "never seen"]
    for c in [("<start>", "<start>"), ("the", "the"), ("of", "w1"), ("never", "seen")]:
        assert sum(plain.p(c, w) for w in words) == pytest.approx(1)


def test_bigrams_are_the_query_model(spark):
    df = spark.createDataFrame(corpus(5), "doc_id long, text string").repartition(4)
    held = katz.held_out(F.col("doc_id"))
    path = common.new_folder(spark, "model")
    backoff.train(df.filter(~held), path, 2)
    order = lambda r: (-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.score)
    stored, direct = (sorted(x.collect(), key=order) for x in (backoff.score(df, path), katz.score(df, held)))
    assert len(stored) == len(direct) == df.count()
    for a, b in zip(stored, direct):
        assert (a.doc_id, a.n_tokens) == (b.doc_id, b.n_tokens)
        assert a.score == pytest.approx(b.score, rel=1e-9, abs=1e-9)


def test_edges(spark):
    df = spark.createDataFrame([(1, "a B"), (1, "a B"), (2, None), (None, " ")], "doc_id long, text string")
    path = common.new_folder(spark, "model")
    backoff.train(df.limit(0), path, 2)
    assert sorted(r.n_tokens for r in backoff.score(df, path).collect()) == [1, 1, 3, 3]
    assert {r.score for r in backoff.score(df, path).collect()} == {0.0}
    assert backoff.score(df.limit(0), path).count() == 0
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        backoff.train(df, path, 2)
