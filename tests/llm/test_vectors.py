"""Embedding near-dedup and nearest neighbours against brute force."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from townhall.llm import descent, graph, vectors

BAD = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [float("inf")] * 16]


def rows(seed=1, n=300, dim=16):
    rng = np.random.default_rng(seed)
    out = [rng.standard_normal(dim) for _ in range(n)]
    for c in range(6):
        centre = rng.standard_normal(dim)
        out += [centre + rng.standard_normal(dim) * 0.25 for _ in range(int(rng.integers(2, 60)))]
    out += [out[5]] * 9 + [out[7] * 3]
    listed = [[float(np.float32(x)) for x in v] for v in out] + BAD + [[1.0, 2.0, 3.0], [2.0, 4.0, 6.0]]
    order = rng.permutation(len(listed))
    return [(int(i), listed[j], "x") for i, j in enumerate(order)]


def frame(spark, data, kind="float"):
    return spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>, n_links string").repartition(3)


def cosines(data):
    good = [(i, np.array(v, float)) for i, v, _ in data if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    pairs = {}
    for a, x in good:
        for b, y in good:
            if a != b and len(x) == len(y):
                pairs[a, b] = float(x @ y / np.sqrt((x @ x) * (y @ y)))
    return [i for i, _ in good], pairs


def check(spark, data):
    ids, pairs = cosines(data)
    links = {i: [b for (a, b), s in pairs.items() if a == i and s >= 0.9] for i, _, _ in data}
    top = {}
    for i in sorted(links):
        if i not in top:
            stack = [i]
            while stack:
                x = stack.pop()
                if x not in top:
                    top[x] = i
                    stack += links[x]
    got = {r.vec_id: r for r in vectors.near_duplicates(frame(spark, data)).collect()}
    assert len(got) == len(data)
    assert {i: r.n_links for i, r in got.items()} == {i: len(v) for i, v in links.items()}
    assert {i: r.component_id for i, r in got.items()} == top
    assert all(r.kept == (top[i] == i) for i, r in got.items())


def test_links_against_all_pairs(spark):
    check(spark, rows())


def test_blocks_agree(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    check(spark, rows(2, 60))


def test_empty(spark):
    df = frame(spark, rows()).limit(0)
    assert vectors.near_duplicates(df).count() == 0
    assert descent.search(df, F.col("vec_id") % 5 == 0).count() == 0


def test_nearest(spark):
    data = rows(3, 1500)
    ids, pairs = cosines(data)
    got = {}
    for r in descent.search(frame(spark, data), F.col("vec_id") % 5 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    by = {}
    for (a, b), s in pairs.items():
        by.setdefault(a, []).append((-round(s, 12), b))
    for q in (i for i in ids if i % 5 == 0):
        want = sorted(by.get(q, []))[:5]
        have = sorted(got.get(q, []))
        assert [k for k, _, _ in have] == list(range(1, len(want) + 1))
        assert all(abs(s - pairs[q, v]) < 1e-12 for _, v, s in have)
        assert [(-round(s, 12), v) for _, v, s in have] == sorted((-round(s, 12), v) for _, v, s in have)
        hits += len({v for _, v, _ in have} & {b for _, b in want})
        total += len(want)
    assert set(got) <= set(ids) and hits / total >= 0.95


def crowded(n, dim=64, seed=4):
    """Unit vectors: a third in a cone of mutual cosine 0.8, and pairs at cosine 0.901 in and out of it."""
    rng = np.random.default_rng(seed)
    out = rng.standard_normal((n, dim))
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    axis = np.eye(dim)[0]
    cone = np.arange(n) % 3 == 0
    out[cone] = np.sqrt(0.8) * axis + np.sqrt(0.2) * out[cone]
    out /= np.linalg.norm(out, axis=1, keepdims=True)
    for i in range(0, n - 3, 24):
        for x in (i, i + 1):
            noise = rng.standard_normal(dim)
            noise -= noise @ out[x] * out[x]
            out[x + 3] = 0.901 * out[x] + np.sqrt(1 - 0.901**2) * noise / np.linalg.norm(noise)
    return out.astype(np.float32)


@pytest.mark.parametrize("n", [3000, 15000])
def test_no_link_is_lost_in_a_crowd(spark, n):
    x = crowded(n)
    data = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))})
    got = vectors.near_duplicates(spark.createDataFrame(data)).toPandas().sort_values("vec_id")
    wide = x.astype(float)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    want = np.array([np.count_nonzero(wide @ v >= 0.9) - 1 for v in wide])
    assert want.sum() >= n // 12
    assert (got.n_links.to_numpy() == want).all()


@pytest.mark.parametrize("n", [20000, 120000])
def test_no_neighbour_is_lost_in_a_large_table(spark, n):
    x = np.random.default_rng(6).standard_normal((n, 64)).astype(np.float32)
    data = pa.table({"vec_id": np.arange(n), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))})
    got = descent.search(spark.createDataFrame(data), F.col("vec_id") % (n // 100) == 0).toPandas().sort_values(["query_id", "rank"])
    wide = x.astype(float)
    wide /= np.linalg.norm(wide, axis=1, keepdims=True)
    score = wide[:: n // 100] @ wide.T
    score[np.arange(100), np.arange(0, n, n // 100)] = -2
    assert got.vec_id.to_list() == np.argsort(-score, axis=1)[:, :5].ravel().tolist()


def test_windows_are_whole_across_partitions(spark):
    """Partitions, spans and windows smaller than each other's neighbourhoods lose no pair of a window."""
    rng = np.random.default_rng(9)
    centre = rng.standard_normal((12, 16))
    x = (centre[rng.integers(0, 12, 600)] + rng.standard_normal((600, 16)) * 0.3).astype(np.float32)
    data = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    _, classes = vectors.classes_of(spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    rep = {r.node: r.rep for r in classes.select("node", "rep").collect()}
    wide = vectors.unit(x.astype(float))
    keys = vectors.Planes(3).keys(wide, range(3))
    of = {v: k for k, v in rep.items()}
    want = np.arange(600)
    for p in range(3):
        order = sorted(range(600), key=lambda i: (keys[i, p], of[i]))
        for o in range(1, 17):
            for a, b in zip(order, order[o:]):
                if wide[a] @ wide[b] >= 0.9:
                    list(vectors.forest(want, np.array([a]), np.array([b])))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "97")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = vectors.pass_links(classes, True, 0.9, range(3), 16, 20).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    got = np.arange(600)
    for r in found:
        assert wide[rep[r.a]] @ wide[rep[r.b]] >= 0.9
        list(vectors.forest(got, np.array([rep[r.a]]), np.array([rep[r.b]])))
    root = lambda top, i: i if top[i] == i else root(top, top[i])
    # Tiles reach a little past the window, so more may be connected, but nothing less.
    assert all(root(got, i) == root(got, root(want, i)) for i in range(600))


def test_exact_way_agrees(spark, monkeypatch):
    data = rows(5, 120)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    want = key(vectors.near_duplicates(frame(spark, data)))
    assert key(vectors.near_duplicates(frame(spark, data), exact=True)) == want
    monkeypatch.setattr(vectors, "MOST", 0)
    assert key(vectors.near_duplicates(frame(spark, data))) == want


def test_plan_grows_with_crowding():
    met = np.full((10, vectors.TRIALS), 100)
    assert vectors.plan(met, 1 << 20) == (3, 256)
    met[:, : vectors.TRIALS // 2] = 1 << 20
    more = vectors.plan(met, 1 << 20)
    assert more[1] == 256 and more[0] > 3
    assert vectors.plan(np.full((10, vectors.TRIALS), 1 << 20), 1 << 20) is None


def test_null_and_repeated_ids(spark):
    data = [(None, [1.0, 0.0]), (None, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.01, 1.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.0]), (4, [-1.0, 0.0])]
    df = spark.createDataFrame([(*r, 0, 0.5) for r in data], "vec_id long, embedding array<float>, rank int, score double")
    got = sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect())
    # One of the rows of id 1 links with 2 and 3, the other with nothing.
    assert got == sorted([(0, 0, None, True)] * 2 + [(1, 0, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (4, 1, 4, True)])
    near = [(r.query_id, r["rank"], r.vec_id) for r in descent.walk_search(df, F.col("vec_id") == 4, 2).collect()]
    assert {q for q, _, _ in near} == {4} and all(v != 4 for _, _, v in near)


def test_walks(spark):
    """Ranks, scores, ties and recall of the graph search; vectors of other lengths and bad ones."""
    data = rows(7, 500)
    ids, pairs = cosines(data)
    by, got = {}, {}
    for (a, b), s in pairs.items():
        by.setdefault(a, []).append((-round(s, 12), b))
    for r in descent.walk_search(frame(spark, data), F.col("vec_id") % 5 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    hits = total = 0
    for q in (i for i in ids if i % 5 == 0):
        want, have = sorted(by.get(q, []))[:5], sorted(got.get(q, []))
        assert [k for k, _, _ in have] == list(range(1, len(want) + 1))
        assert all(abs(s - pairs[q, v]) < 1e-12 for _, v, s in have)
        assert [(-round(s, 12), v) for _, v, s in have] == sorted((-round(s, 12), v) for _, v, s in have)
        hits += len({v for _, v, _ in have} & {b for _, b in want})
        total += len(want)
    assert set(got) <= set(ids) and hits / total >= 0.99
    assert descent.walk_search(frame(spark, data).limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_graph_recall_in_one_shard():
    """A graph of one shard, by rounds to rest, and walks on it, against all pairs."""
    rng = np.random.default_rng(8)
    x = vectors.unit(rng.standard_normal((3000, 64)))
    single = x.astype(np.float32)
    ids, sims = descent.first_lists(x)
    fresh, turn = ids >= 0, 0
    while fresh.mean() > descent.SETTLED:
        u, v, place = descent.hoods(ids, turn)
        new = fresh.reshape(-1)[place]
        old = ids
        askers = descent._unpacked(descent._grouped_ids(v[new], u[new], len(x)))
        hood = descent._unpacked(descent._grouped_ids(u, v, len(x)))
        for a in range(0, len(x), 200):
            ids, sims = descent.improved(single, ids, sims, askers[a : a + 200], hood[a : a + 200])
        fresh = ~(ids[:, :, None] == old[:, None, :]).any(2)
        turn += 1
    assert 3 <= turn <= 15
    q = vectors.unit(rng.standard_normal((200, 64)))
    found, _ = descent.walk(q.astype(np.float32), single, descent.paths(ids, sims), descent.BEAM)
    want = np.argsort(-(q @ x.T), axis=1)[:, :5]
    assert np.mean([len(set(f) & set(w)) / 5 for f, w in zip(found[:, :5].tolist(), want.tolist())]) >= 0.97


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_components(spark, monkeypatch, few):
    """A long path, a star past the hub bound, a clique and single links, in rounds and in one task."""
    monkeypatch.setattr(graph, "FEW", few)
    rng = np.random.default_rng(3)
    links = [(i, i + 1) for i in range(40)] + [(100, 200 + i) for i in range(300)] + [(i, j) for i in range(600, 610) for j in range(600, 610)]
    links += [(int(a), int(b)) for a, b in rng.integers(700, 900, (90, 2))] + [(None, 5), (7, None)]
    top = {}
    find = lambda a: a if top.setdefault(a, a) == a else find(top[a])
    for a, b in links:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            top[y] = x
    got = graph.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert {r.id: r.component for r in got} == {a: find(a) for a in top} and len(got) == len(top)
