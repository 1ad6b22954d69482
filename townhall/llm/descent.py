"""Nearest neighbours: a neighbour graph by NN-descent, searched greedily.

``walk_search``, the operator, keeps a graph in shards of at most ``SHARD`` distinct vectors, so that
what a walk may miss does not grow with the table.

1. Shards: vectors are dealt by a hash; first lists come from blocks of a few sorted projection
   orders.
2. NN-descent: in each round every node joins its new neighbours (its own, and those that name it)
   with their neighbours. The neighbours of neighbours so met are scored against the shard's vectors,
   and both ends keep their ``K`` nearest. Rounds go on until few lists change.
3. A query enters every shard at a few nodes, and moves greedily: the nearest nodes of its beam that
   are not expanded yet are, until none is left. No number of moves ends a walk before that. The
   nearest of all shards are scored in double precision on the original vectors.

A shard with its graph is some 20 MB at 64 dimensions, whatever the table's size; queries stream
past it. In-degrees over ``REVERSE`` are sampled, as NN-descent does, anew in each round.

``search`` is exact: every query is compared with every vector, block by block. It costs queries x
vectors products, and is what the recall of ``walk_search`` is measured against.

Copies of a vector are one node with its smallest ids, and are told apart at the end, so every copy
can be a result and ties go to the smaller id. Rows that repeat a query's id are its own. Vectors that
are null, zero or hold null or non-finite components take no part, as query or as candidate, nor do
rows without an id. Vectors of other lengths than the query's are no candidates. Empty tables give
empty results; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, grouped, join_hubs
from .vectors import BLOCK_BYTES, LEAST_TASKS, TASK_ROWS, WIDE, Planes, classes_of, is_single, products, slack, unit, unpack

#: Nodes of a shard at most (two bytes name one), and the fewest shards, so that small tables are spread too.
SHARD, LEAST_SHARDS = 1 << 14, 8
#: Neighbours a node keeps, those that name it and are looked at, and the share of new ones at rest.
K, REVERSE, SETTLED = 24, 24, 0.005
#: Sorted orders of the first lists, and rows of their blocks.
SEED_PASSES, SEED_BLOCK = 4, 64
#: Pairs scored at once; neighbours of a node on a walk; queries that walk together.
PAIRS, DEGREE, WALKERS = 1 << 20, 48, 256
#: Nodes of a beam, of those expanded at once, and at which a walk enters.
BEAM, AHEAD, ENTRIES = 160, 4, 128
#: Queries of an exact search's block at most, and its fewest blocks of vectors.
QUERY_BLOCK, LEAST_BLOCKS = 8192, 24
#: Queries and vectors that an exact search multiplies at once.
TILE, SPAN = 512, 4096


def merged(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row by row, the ``k`` nearest different ids (-1: none), nearest first: ids, sims, and the
    columns they came from; of a repeated id its first column stays."""
    order = np.argsort(ids, axis=1, kind="stable")
    row = np.arange(len(ids))[:, None]
    by = ids[row, order]
    again = np.zeros(ids.shape, bool)
    again[:, 1:] = by[:, 1:] == by[:, :-1]
    value = np.where(again | (by < 0), -np.inf, sims[row, order])
    top = np.argsort(-value, axis=1, kind="stable")[:, :k]
    value = value[row, top]
    return np.where(value > -np.inf, by[row, top], -1), value, order[row, top]


def packed_rows(node: np.ndarray, other: np.ndarray, sim: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` pairs of largest ``sim`` of each node as n x k matrices (ids; -1: none)."""
    ids, sims = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
    order = np.lexsort((-sim, node))
    node, other, sim = node[order], other[order], sim[order]
    place = np.arange(len(node)) - np.searchsorted(node, np.arange(n))[node]
    few = place < k
    ids[node[few], place[few]], sims[node[few], place[few]] = other[few], sim[few]
    return ids, sims


def first_lists(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids, sims: for each unit vector the nearest of its blocks in a few sorted orders."""
    n = len(x)
    ids, sims = np.full((n, 0), -1, np.int64), np.full((n, 0), -np.inf)
    single = x.astype(np.float32)
    keys = Planes(SEED_PASSES).keys(x, range(SEED_PASSES))
    for p in range(SEED_PASSES):
        order = np.argsort(keys[:, p], kind="stable")
        more, near = np.full((n, K), -1, np.int64), np.full((n, K), -np.inf)
        for a in range(0, n, SEED_BLOCK):
            at = order[max(0, min(a, n - SEED_BLOCK)) : a + SEED_BLOCK]
            s = single[at] @ single[at].T
            np.fill_diagonal(s, -np.inf)
            top = np.argsort(-s, axis=1)[:, : min(K, len(at) - 1)]
            more[at, : top.shape[1]], near[at, : top.shape[1]] = at[top], np.take_along_axis(s, top, 1)
        ids, sims, _ = merged(np.concatenate([ids, more], axis=1), np.concatenate([sims, near], axis=1), K)
    return ids, sims


def hoods(ids: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edges both ways (from, to, place in the flattened lists): all of a node's own, and at most
    about REVERSE, drawn evenly, of those that name it."""
    n, k = ids.shape
    place = np.flatnonzero(ids.reshape(-1) >= 0)
    u, v = place // k, ids.reshape(-1)[place]
    named = np.bincount(v, minlength=n)
    draw = np.random.default_rng([seed, n]).random(len(v)) * named[v] < REVERSE
    return np.concatenate([u, v[draw]]), np.concatenate([v, u[draw]]), np.concatenate([place, place[draw]])


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _bytes(matrix: np.ndarray, kind: str) -> pa.Array:
    rows = np.ascontiguousarray(matrix.astype(kind))
    return pa.array([r.tobytes() for r in rows], pa.binary())


_LISTS = "g int, at int, near binary, sims binary, fresh binary, new int"
_NAMES = ["g", "at", "near", "sims", "fresh", "new"]


def _list_batch(g: int, ids: np.ndarray, sims: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    n = len(ids)
    columns = [pa.array(np.full(n, g, np.int32)), pa.array(np.arange(n, dtype=np.int32)), _bytes(ids, "<i4"), _bytes(sims, "<f4"), _bytes(fresh, "?"), pa.array(fresh.sum(axis=1).astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, _NAMES)


def _lists_of(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return _matrix(group["near"], "<i4").astype(np.int64), _matrix(group["sims"], "<f4").astype(float), _matrix(group["fresh"], "?")


def shards(classes: DataFrame, single: bool) -> tuple[DataFrame, DataFrame]:
    """(index, lists): g, size, at, node, rep, vector of every node; its first lists."""
    sizes = classes.groupBy(F.octet_length("vector").alias("size")).agg(F.greatest(F.lit(LEAST_SHARDS), F.ceil(F.count("*") / (SHARD * 0.9))).alias("shards"))
    placed = classes.withColumn("size", F.octet_length("vector")).join(sizes, "size")
    dealt = placed.withColumn("shard", F.pmod(F.xxhash64("node"), F.col("shards")).cast("int"))
    groups = sorted((r["size"], s) for r in sizes.collect() for s in range(r["shards"]))  # one for each shard
    named = classes.sparkSession.createDataFrame([(size, s, g) for g, (size, s) in enumerate(groups)] or [(-1, 0, 0)], "size int, shard int, g int")
    ordered = dealt.join(F.broadcast(named), ["size", "shard"]).select("g", "size", "node", "rep", "vector").repartition("g").sortWithinPartitions("g", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["g"]):
            n = group.num_rows
            ids, sims = first_lists(unit(unpack(group["vector"].to_pylist(), single)))
            lists = _list_batch(group["g"][0].as_py(), ids, sims, ids >= 0)
            own = group.select(["size", "node", "rep", "vector"]).combine_chunks()
            for a in range(0, n, 4096):
                some = own.slice(a, 4096).to_batches()[0]
                yield pa.RecordBatch.from_arrays([*lists.slice(a, 4096).columns, *some.columns], [*_NAMES, "size", "node", "rep", "vector"])

    built = cut(ordered.mapInArrow(run, f"{_LISTS}, size int, node long, rep long, vector binary"))
    return built.select("g", "size", "at", "node", "rep", "vector"), built.select(*_NAMES)


def _grouped_ids(of: np.ndarray, ids: np.ndarray, n: int) -> pa.Array:
    """The ids of each group 0 to n - 1, packed."""
    order = np.argsort(of, kind="stable")
    packed, ends = ids[order].astype("<u2"), np.searchsorted(of[order], np.arange(n + 1))
    return pa.array([packed[a:b].tobytes() for a, b in zip(ends, ends[1:])], pa.binary())


def _neighbours(lists: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """g, at, and packed: the nodes that have ``at`` as a new neighbour, both ways (``askers``), and
    all neighbours of ``at``, both ways (``hood``)."""

    def packed(name: str, new_only: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for group in grouped(batches, ["g"]):
                ids, _, fresh = _lists_of(group)
                u, v, place = hoods(ids, turn)
                some = fresh.reshape(-1)[place] if new_only else slice(None)
                ends = (v, u) if new_only else (u, v)
                columns = [group["g"].combine_chunks(), group["at"].combine_chunks(), _grouped_ids(ends[0][some], ends[1][some], len(ids))]
                yield pa.RecordBatch.from_arrays(columns, ["g", "at", name])

        return lists.mapInArrow(run, f"g int, at int, {name} binary").filter(F.octet_length(name) > 0)

    return packed("askers", True), packed("hood", False)


def _padded(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Values of groups 0 to n - 1 (``of``, ascending) as rows, filled up with -1."""
    size = np.bincount(of, minlength=n)
    out = np.full((n, max(1, int(size.max(initial=0)))), -1, np.int64)
    out[of, np.arange(len(of)) - (np.cumsum(size) - size)[of]] = values
    return out


def _unpacked(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return _padded(np.repeat(np.arange(len(rows)), [len(r) // 2 for r in rows]), np.frombuffer(b"".join(rows), "<u2").astype(np.int64), len(rows))


def improved(x: np.ndarray, ids: np.ndarray, sims: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lists after each row's nodes of ``left`` met those of ``right`` (-1: none); both ends of a
    pair keep their nearest."""
    n, k = ids.shape
    s = np.matmul(x[left], x[right].transpose(0, 2, 1))
    s[(left < 0)[:, :, None] | (right < 0)[:, None, :] | (left[:, :, None] == right[:, None, :])] = -np.inf
    floor = sims[:, -1].astype(np.float32)
    pairs = []
    for good, ends in ((s > floor[left][:, :, None], (0, 1)), (s > floor[right][:, None, :], (1, 0))):
        r, i, j = np.nonzero(good)
        both = (left[r, i], right[r, j])
        pairs.append((both[ends[0]] * n + both[ends[1]], s[r, i, j]))
    pair, one = np.unique(np.concatenate([p for p, _ in pairs]), return_index=True)
    more, near = packed_rows(pair // n, pair % n, np.concatenate([v for _, v in pairs])[one].astype(float), n, 2 * k)
    some = np.flatnonzero(more[:, 0] >= 0)
    ids, sims = ids.copy(), sims.copy()
    ids[some], sims[some], _ = merged(np.concatenate([ids[some], more[some]], axis=1), np.concatenate([sims[some], near[some]], axis=1), k)
    return ids, sims


def _round(index: DataFrame, lists: DataFrame, single: bool, turn: int) -> DataFrame:
    """One round of NN-descent: neighbours of neighbours by a join, scored shard by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g, nodes, rest in _streams(batches):
            x = unit(unpack(nodes["vector"].to_pylist(), single)).astype(np.float32)
            old, sims, _ = _lists_of(nodes)
            ids = old
            for met in rest:  # the askers and the neighbours of a node
                left, right = _unpacked(met["askers"]), _unpacked(met["hood"])
                step = max(1, PAIRS // (left.shape[1] * right.shape[1]))
                for a in range(0, len(left), step):
                    ids, sims = improved(x, ids, sims, left[a : a + step], right[a : a + step])
            fresh = np.empty(ids.shape, bool)
            for a in range(0, len(ids), 1024):
                fresh[a : a + 1024] = ~(ids[a : a + 1024, :, None] == old[a : a + 1024, None, :]).any(2)
            yield _list_batch(g, ids, sims, fresh & (ids >= 0))

    asks, near = _neighbours(lists, turn)
    return cut(_streamed(index.join(lists, ["g", "at"]), asks.join(near, ["g", "at"])).mapInArrow(run, _LISTS))


_STREAM = {"g": "int", "late": "boolean", "at": "int", "node": "long", "rep": "long", "vector": "binary", "near": "binary", "sims": "binary", "fresh": "binary", "askers": "binary", "hood": "binary"}


def _streamed(nodes: DataFrame, late: DataFrame) -> DataFrame:
    """Each shard's nodes, in order, and after them its rows of ``late``."""
    both = nodes.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)), allowMissingColumns=True)
    missing = {c: F.lit(None).cast(kind) for c, kind in _STREAM.items() if c not in both.columns}
    return both.withColumns(missing).repartition("g").sortWithinPartitions("g", "late", "at").select(*_STREAM)


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table, Iterator[pa.Table]]]:
    """(g, nodes, the later rows batch by batch) of each shard of ``_streamed`` rows; the later rows
    are to be read before the next shard is asked for."""
    runs = _runs(batches)
    ahead = next(runs, None)
    while ahead is not None:
        g, nodes = ahead[0], []
        while ahead is not None and ahead[0] == g and not ahead[1]:
            nodes.append(ahead[2])
            ahead = next(runs, None)

        def rest() -> Iterator[pa.Table]:
            nonlocal ahead
            while ahead is not None and ahead[0] == g:
                now, ahead = ahead[2], next(runs, None)
                yield now

        later = rest()
        yield g, pa.concat_tables(nodes), later
        for _ in later:
            pass


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, pa.Table]]:
    for batch in batches:
        if batch.num_rows:
            g, late = batch.column("g").to_numpy(), batch.column("late").to_numpy(zero_copy_only=False)
            bounds = [0, *(np.flatnonzero((g[1:] != g[:-1]) | (late[1:] != late[:-1])) + 1), batch.num_rows]
            for a, b in zip(bounds, bounds[1:]):
                yield int(g[a]), bool(late[a]), pa.Table.from_batches([batch.slice(a, b - a)])


def build(classes: DataFrame, single: bool) -> tuple[DataFrame, DataFrame]:
    """(index, lists): the nodes of each shard, and the neighbours of each node when few change."""
    index, lists = shards(classes, single)
    turn, n = 0, index.count()
    while n:
        lists = _round(index, lists, single, turn)
        turn += 1
        if lists.agg(F.sum("new")).first()[0] <= SETTLED * K * n:
            break
    return index, lists


def paths(ids: np.ndarray, sims: np.ndarray) -> np.ndarray:
    """n x DEGREE neighbours (-1: none) that a walk may go to: a node's own, and the nearest of those
    that name it."""
    n, k = ids.shape
    place = np.flatnonzero(ids.reshape(-1) >= 0)
    u, v, s = place // k, ids.reshape(-1)[place], sims.reshape(-1)[place]
    back, near = packed_rows(v, u, s, n, DEGREE)
    return merged(np.concatenate([ids, back], axis=1), np.concatenate([np.where(ids >= 0, 3.0, -np.inf), near], axis=1), DEGREE)[0]


def walk(q: np.ndarray, x: np.ndarray, to: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """ids, sims (queries x beam; -1: none): what greedy search finds near each unit vector of q."""
    n, m = len(q), len(x)
    seen = np.zeros((n, m), bool)
    start = np.arange(min(m, ENTRIES))
    seen[:, start] = True
    order = np.argsort(-(q @ x[start].T), axis=1)[:, :beam]
    ids, sims = np.full((n, beam), -1), np.full((n, beam), -np.inf, np.float32)
    ids[:, : order.shape[1]] = start[order]
    sims[:, : order.shape[1]] = np.take_along_axis(q @ x[start].T, order, 1)
    done = ids < 0
    while True:
        live = np.flatnonzero(~done.all(axis=1))
        if not len(live):
            return ids, sims
        step = np.argsort(done[live], axis=1, kind="stable")[:, :AHEAD]
        fresh = ~np.take_along_axis(done[live], step, 1)
        done[live[:, None], step] = True
        hood = to[ids[live[:, None], step]]
        hood[~fresh] = -1
        row, other = np.repeat(live, hood[0].size), hood.reshape(-1)
        row, other = row[other >= 0], other[other >= 0]
        new = ~seen[row, other]
        row, other = np.divmod(np.unique(row[new] * m + other[new]), m)
        if not len(row):
            continue
        seen[row, other] = True
        s = np.einsum("ij,ij->i", q[row], x[other])
        good = s > sims[row, -1]
        row, other, s = row[good], other[good], s[good]
        rows, at = np.unique(row, return_inverse=True)
        width = int(np.bincount(at).max(initial=0))
        if not width:
            continue
        place = np.arange(len(row)) - np.searchsorted(row, rows)[at]
        more, near = np.full((len(rows), width), -1), np.full((len(rows), width), -np.inf, np.float32)
        more[at, place], near[at, place] = other, s
        all_ids, all_sims = np.concatenate([ids[rows], more], axis=1), np.concatenate([sims[rows], near], axis=1)
        all_done = np.concatenate([done[rows], more < 0], axis=1)
        top = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        ids[rows], sims[rows], done[rows] = (np.take_along_axis(c, top, 1) for c in (all_ids, all_sims, all_done))


def _walked(stream: DataFrame, single: bool, k: int) -> DataFrame:
    """q, node, score: the ``k`` nearest nodes found in each shard for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, nodes, queries in _streams(batches):
            x = unit(unpack(nodes["vector"].to_pylist(), single))
            to, small = paths(*_lists_of(nodes)[:2]), x.astype(np.float32)
            names, reps = nodes["node"].to_numpy(), nodes["rep"].to_numpy()
            for batch in queries:
                for a in range(0, batch.num_rows, WALKERS):
                    some = batch.slice(a, WALKERS)
                    q = unit(unpack(some["vector"].to_pylist(), single))
                    ids, _ = walk(q.astype(np.float32), small, to, max(BEAM, 2 * k))
                    ids = ids[:, : 2 * k]
                    row, place = np.nonzero(ids >= 0)
                    at = ids[row, place]
                    score = products(q, x, row, at)
                    order = np.lexsort((reps[at], -score, row))
                    row, at, score = row[order], at[order], score[order]
                    near = np.arange(len(row)) - np.searchsorted(row, np.arange(len(q)))[row] < k
                    yield pa.RecordBatch.from_arrays([pa.array(some["node"].to_numpy()[row[near]]), pa.array(names[at[near]]), pa.array(score[near])], ["q", "node", "score"])

    return stream.mapInArrow(run, "q long, node long, score double")


def walk_search(vectors: DataFrame, chosen: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows that walks over the graph find for each
    row where ``chosen``."""
    single = is_single(vectors)
    rows, classes = classes_of(vectors)
    index, lists = build(classes, single)
    asked = _asked(rows, classes, chosen)
    queries = index.join(asked.select(F.col("q").alias("node")).distinct(), "node").select("size", "node", "vector")
    sent = queries.join(index.select("g", "size").distinct(), "size").select("g", F.lit(0).alias("at"), "node", "vector")
    found = _walked(_streamed(index.join(lists, ["g", "at"]), sent), single, k + 1)
    return _ranked(found, rows, classes, asked, k)


def nearest(queries: np.ndarray, x: np.ndarray, reps: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, place, score): the ``k`` nearest of the unit vectors x for each query, by tiles."""
    error = slack(x.shape[1])
    left, right = queries.astype(np.float32), x.astype(np.float32)
    for i in range(0, len(queries), TILE):
        n = min(TILE, len(queries) - i)
        floor = np.full(n, -np.inf)
        q, at, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for j in range(0, len(x), SPAN):
            s = left[i : i + n] @ right[j : j + SPAN].T
            if j == 0 and s.shape[1] > k:
                floor = np.partition(s, -k, axis=1)[:, -k].astype(float) - error
            a, b = np.nonzero(s >= (floor - error).astype(np.float32)[:, None])
            if not len(a):
                continue
            q, at = np.concatenate([q, a]), np.concatenate([at, b + j])
            score = np.concatenate([score, products(queries, x, a + i, b + j)])
            order = np.lexsort((reps[at], -score, q))
            first = np.searchsorted(q[order], np.arange(n))
            order = order[np.arange(len(order)) - first[q[order]] < k]
            q, at, score = q[order], at[order], score[order]
            full = np.flatnonzero(np.bincount(q, minlength=n) == k)
            floor[full] = score[np.searchsorted(q, full, "right") - 1]
        yield q + i, at, score


def _block_nearest(blocks: DataFrame, single: bool, k: int) -> DataFrame:
    """q, node, score: the ``k`` nearest of a block's vectors for each of its queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["i", "j"]):
            sizes = pc.binary_length(group["vector"]).to_numpy()
            for size in np.unique(sizes):
                part = group.filter(pa.array(sizes == size))
                asks, reps = part["asks"].to_numpy(), part["rep"].to_numpy()
                x = unit(unpack(part["vector"].to_pylist(), single))
                nodes = part["node"].to_numpy()
                for q, at, score in nearest(x[asks], x[~asks], reps[~asks], k):
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[asks][q]), pa.array(nodes[~asks][at]), pa.array(score)], ["q", "node", "score"])

    return blocks.mapInArrow(run, "q long, node long, score double")


def all_nearest(queries: DataFrame, classes: DataFrame, single: bool, k: int) -> DataFrame:
    """q, node, score: the ``k`` nearest classes of each block of vectors for each query class."""
    size = [F.count("*"), F.coalesce(F.sum(F.octet_length("vector")), F.lit(0))]
    (asked, ask_bytes), (n, n_bytes) = queries.agg(*size).first(), classes.agg(*size).first()
    rows = max(1, -(-asked // QUERY_BLOCK), -(-ask_bytes // BLOCK_BYTES))
    columns = max(LEAST_BLOCKS, -(-n // WIDE), -(-n_bytes // BLOCK_BYTES))
    tasks = min(rows * columns, max(LEAST_TASKS, (asked * columns + n * rows) // TASK_ROWS))
    own = lambda blocks: F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = queries.select(own(rows).alias("i"), every(columns).alias("j"), F.lit(True).alias("asks"), "node", "rep", "vector")
    right = classes.select(every(rows).alias("i"), own(columns).alias("j"), F.lit(False).alias("asks"), "node", "rep", "vector")
    dealt = left.unionByName(right).repartition(tasks, "i", "j").sortWithinPartitions("i", "j")
    return _block_nearest(dealt, single, k)


def _smallest(rows: DataFrame, n: int) -> DataFrame:
    """digest, vec_id: the n smallest ids of each class, in two steps so that no class is one task."""
    salted = Window.partitionBy("digest", "salt").orderBy("vec_id")
    some = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64))).withColumn("n", F.row_number().over(salted)).filter(F.col("n") <= n)
    return some.withColumn("n", F.row_number().over(Window.partitionBy("digest").orderBy("vec_id"))).filter(F.col("n") <= n).select("digest", "vec_id")


def _named(rows: DataFrame) -> DataFrame:
    return rows.filter("digest IS NOT NULL AND vec_id IS NOT NULL").select("vec_id", "digest")


def _asked(rows: DataFrame, classes: DataFrame, chosen: Column) -> DataFrame:
    """query_id, q: the chosen rows and their nodes."""
    names = classes.select("digest", "node", F.col("copies").alias("held"))
    asked = join_hubs(_named(rows).filter(chosen), names, "digest", rows.count())
    return cut(asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")))


#: Parts that the queries of one node are dealt to.
SALTS = 16


def _ranked(scored: DataFrame, rows: DataFrame, classes: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The result from each query node's nearest nodes (q, node, score)."""
    scored = scored.join(classes.select("node", "rep"), "node")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "rep", "node")
    best = scored.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= k + 1).select("q", "node", "score")
    ids = _smallest(_named(rows), k + 1).join(classes.select("digest", "node"), "digest").select("node", "vec_id")
    # Each query keeps its class's k + 1 nearest rows; one of them may be the query itself.
    nearest_rows = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    few = cut(best.join(ids, "node").withColumn("n", F.row_number().over(nearest_rows)).filter(F.col("n") <= k + 1).select("q", "vec_id", "score"))
    spread = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    result = asked.withColumn("salt", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).cast("int")).join(spread, ["q", "salt"]).filter("vec_id <> query_id")
    ranks = result.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranks.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def search(vectors: DataFrame, chosen: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row where ``chosen``, exactly."""
    single = is_single(vectors)
    rows, classes = classes_of(vectors)
    asked = _asked(rows, classes, chosen)
    queries = classes.join(asked.select(F.col("q").alias("node")).distinct(), "node", "left_semi")
    return _ranked(all_nearest(queries, classes, single, k + 1), rows, classes, asked, k)
