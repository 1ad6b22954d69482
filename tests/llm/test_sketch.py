"""Near-duplicate documents against all pairs."""

import random
import re

import numpy as np
import pytest

from townhall.llm import sketch


def shingles(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or {tuple(words)}


def brute(rows, k, percent):
    sets = {d: shingles(t, k) for d, t in rows}
    top = {d: d for d in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                top[y] = x
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdeéöß", k=rng.randrange(2, 7))) for _ in range(400)]
    texts = [None, "", " \n\t ", "one", "ONE", "one two", "one two three", "One  two\tthree", "É é", "é É"]
    for family in range(12):
        base = rng.choices(vocabulary, k=rng.choice([5, 20, 60, 200, 900]))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(12)):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(copy) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(rng.choice([" ", "\n"]).join(copy).title() if rng.random() < 0.3 else " ".join(copy))
    texts += [texts[20]] * 5
    rng.shuffle(texts)
    return list(enumerate(texts, start=3))


@pytest.mark.parametrize("k", [4, 5])
def test_against_all_pairs(spark, k):
    rows = corpus()
    df = spark.createDataFrame([(d, t, -1) for d, t in rows], "doc_id long, text string, component_id int").repartition(3)
    want = brute(rows, k, 80)
    got = {r.doc_id: r for r in sketch.near_duplicates(df, k, 80).collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in got.items()} == want
    assert all(r.kept == (r.component_id == d) for d, r in got.items())


def test_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr(sketch, "BLOCK_DOCS", 3)
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sketch.near_duplicates(df, 4, 80).collect()}
    assert got == brute(rows, 4, 80)


def test_null_ids_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (1, "a b c d e"), (1, "a b c d e"), (2, "x")], "doc_id long, text string")
    rows = sketch.near_duplicates(df, 4, 80).collect()
    assert len(rows) == 4
    assert [r.component_id for r in rows if r.doc_id is None] == [None]
    # One row of the group stays; the row without an id stays too.
    assert sorted((r.doc_id or 0, r.text) for r in sketch.keep_one(df).collect()) == [(0, "a b c d e"), (1, "a b c d e"), (2, "x")]
    assert sketch.near_duplicates(df.limit(0), 4, 80).count() == 0


def test_registers_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
    errors = []
    for _ in range(20):
        a, b = np.unique(pool[:2000]), np.unique(pool[200:2200])
        pool = rng.integers(0, 1 << 63, 3000).astype(np.uint64)
        regs = sketch.registers([a, b])
        got = sketch.similarity(regs[0], regs[1:], len(a), np.array([len(b)]))[0]
        errors.append(got - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
    assert abs(np.mean(errors)) < 0.03 and np.max(np.abs(errors)) < 0.17


def test_registers_merge():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (50, 700))
    one, two, both = sketch.registers([a, b, np.union1d(a, b)])
    assert (np.maximum(one, two) == both).all()


def test_keep_one_by_text(spark):
    """Repeated ids with several texts: each group keeps one row, and no near copy of it."""
    far, near = "p q r s t u v w x y", "a b c d e f g h i j k l m n o"
    rows = [(1, near, "k"), (5, near, "l"), (5, far, "m"), (5, far, "m"), (6, far + "", "n"), (7, None, "o"), (7, None, "o"), (8, " ", "p"), (None, far, "q")]
    df = spark.createDataFrame([(d, t, e, 1, 2) for d, t, e in rows], "doc_id long, text string, row string, id int, n int").repartition(3)
    out = sketch.keep_one(df)
    assert out.columns == df.columns
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "")
    assert sorted((key(r) for r in out.collect())) == sorted([(False, 1, near), (False, 5, far), (False, 7, ""), (False, 7, ""), (False, 8, " "), (True, 0, far)])
    assert sketch.keep_one(df.limit(0)).count() == 0


def test_a_text_longer_than_a_piece(spark):
    rng = random.Random(4)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(400_000))
    rows = [(1, long), (2, long + " end"), (3, "a b c d e f"), (4, long[: len(long) // 2])]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in sketch.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert got == brute(rows, 5, 80)
