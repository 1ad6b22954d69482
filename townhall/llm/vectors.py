"""Embedding near-dedup by sorted projection passes.

In each pass all vectors stand in lexicographic order of concatenated random hashes (sign bits of
random projections); every vector is compared with the ``window`` that follow it, and verified pairs
are united across passes. Equal vectors are one class with a count of copies from the start, so
copies never fill a window.

How many passes and how wide a window follow from the table (``plan``). Probes, drawn evenly and from
the most crowded hash prefixes, get a partner at exactly the threshold; the rows that stand between
the two are counted over the whole table in trial passes. The cheapest window and number of passes
is taken that would miss such a pair with probability ``MISS`` at most, crowded places included.
Where ``MOST`` passes would not do, all pairs are compared in blocks instead (``all_links``; also to
be had with ``exact``).

A pass sorts hashes and digests only, and numbers the rows in that order. Spans of consecutive rows,
each with the window's rows that follow it, then get their vectors by a join, so windows are whole
however the rows are partitioned. As many passes run together as make ``ROUND_ROWS`` rows.

The components so found are then counted exactly: all members of a component are compared in blocks,
and every pair of blocks is one group of a task, so a window never limits a link count.

Products are taken in single precision; those within its error bound of the threshold are decided
in double precision on the original vectors. Vectors that are null, zero or hold null or non-finite
components link with nothing; rows without an id neither. Vectors of different lengths never link.
Rows that repeat an id are judged by their own vectors. Empty tables give empty results; other
columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, grouped, join_hubs
from .graph import forest, named_components

BITS, SEED = 48, 11
#: The chance that a pair at the threshold is missed, the passes that may be spent on that, and the
#: windows to choose from.
MISS, MOST, WINDOWS = 1e-5, 192, (256, 512, 1024, 2048, 4096)
#: Evenly drawn probes, probes from the most crowded prefixes, and trial passes to count them in.
PROBES, CROWDED, TRIALS = 128, 48, 32
#: What sorting and joining a row for a pass costs, in comparisons; rows of passes that run together.
SORT_COST, ROUND_ROWS = 4000, 1 << 18
#: Windows that a span of rows is long.
SPAN_WINDOWS = 8
#: Members of a component that are compared as one block; past ``MANY`` blocks these grow.
BLOCK, MANY = 128, 32
#: Rows and bytes of a block at most, and the fewest blocks of a whole table.
WIDE, BLOCK_BYTES, LEAST_BLOCKS = 65536, 16 << 20, 8
#: Vectors that are multiplied at once; rows that a task is worth, and the fewest tasks.
TILE, STEP, TASK_ROWS, LEAST_TASKS = 1024, 256, 1 << 16, 36


def parsed(column: pa.Array) -> list[np.ndarray | None]:
    """Each row as a double array, or None where it takes no part."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return []
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    offsets = column.offsets.to_numpy()
    null = column.is_null().to_numpy(zero_copy_only=False)
    out: list[np.ndarray | None] = []
    for i in range(len(column)):
        v = flat[offsets[i] : offsets[i + 1]] + 0.0
        out.append(v if not null[i] and len(v) and np.isfinite(v).all() and v.any() else None)
    return out


def unit(v: np.ndarray) -> np.ndarray:
    """The vectors of a matrix at length 1, scaled first so that no square overflows or vanishes."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def pack(v: np.ndarray, single: bool) -> bytes:
    return v.astype("<f4" if single else "<f8").tobytes()


def unpack(packed: list[bytes], single: bool) -> np.ndarray:
    """Packed vectors of one length as a double matrix."""
    return np.frombuffer(b"".join(packed), "<f4" if single else "<f8").astype(float).reshape(len(packed), -1)


def is_single(df: DataFrame, column: str = "embedding") -> bool:
    return df.schema[column].dataType.simpleString() == "array<float>"


def classes_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): vec_id, digest (null: takes no part); node, digest, rep, copies, vector."""
    single = is_single(vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [None if v is None else pack(v, single) for v in parsed(batch.column("embedding"))]
            digests = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(digests, pa.binary()), pa.array(rows, pa.binary())], ["vec_id", "digest", "vector"])

    rows = cut(vectors.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, "vec_id long, digest binary, vector binary"))
    named = rows.filter("digest IS NOT NULL AND vec_id IS NOT NULL")
    classes = cut(named.groupBy("digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vector").alias("vector")).withColumn("node", F.monotonically_increasing_id()))
    return rows, classes


def slack(dim: int) -> float:
    """More than the error of a product of two unit vectors in single precision."""
    return (dim + 4) * 2.0**-23


def products(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosines in double precision of the pairs (a, b) of unit vectors."""
    out = np.empty(len(a))
    step = max(1, (1 << 21) // x.shape[1])
    for k in range(0, len(a), step):
        out[k : k + step] = np.einsum("ij,ij->i", x[a[k : k + step]], y[b[k : k + step]])
    return out


def _linked(s: np.ndarray, x: np.ndarray, y: np.ndarray, least: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of x and y whose cosine is ``least`` or more, from products ``s`` in single
    precision; ``upper``: of those of a row with later ones only."""
    error = slack(x.shape[1])
    a, b = np.nonzero(s >= least - error)
    if upper:
        a, b = a[a < b], b[a < b]
    hit = s[a, b] >= least + error
    close = np.flatnonzero(~hit)
    hit[close] = products(x, y, a[close], b[close]) >= least
    return a[hit], b[hit]


def near_pairs(x: np.ndarray, y: np.ndarray | None, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair (of x, of y) of unit vectors at ``least`` or more, by tiles; x with itself without y."""
    other = x if y is None else y
    left, right = x.astype(np.float32), other.astype(np.float32)
    for i in range(0, len(x), TILE):
        for j in range(i if y is None else 0, len(other), TILE):
            s = left[i : i + TILE] @ right[j : j + TILE].T
            a, b = _linked(s, x[i : i + TILE], other[j : j + TILE], least, y is None and i == j)
            if len(a):
                yield a + i, b + j


def window_pairs(x: np.ndarray, own: int, window: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs at ``least`` or more of each of the first ``own`` unit vectors with at least the
    ``window`` that follow it."""
    single = x.astype(np.float32)
    for i in range(0, own, STEP):
        j = min(i + STEP, own)
        s = single[i:j] @ single[i : j + window].T
        a, b = _linked(s, x[i:j], x[i : j + window], least, True)
        if len(a):
            yield a + i, b + i


class Planes:
    """The hyperplanes of the passes, by vector length, and the sort keys they give."""

    def __init__(self, passes: int):
        self.passes, self._of = passes, {}

    def keys(self, x: np.ndarray, which: range) -> np.ndarray:
        """len(x) x len(which) keys of unit vectors: the first sign bit is the highest."""
        dim = x.shape[1]
        weights = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        single, out = x.astype(np.float32), np.empty((len(x), len(which)), np.int64)
        for k, p in enumerate(which):
            if (dim, p) not in self._of:
                self._of[dim, p] = np.random.default_rng([SEED, dim, p]).standard_normal((dim, BITS)).astype(np.float32)
            out[:, k] = (single @ self._of[dim, p] > 0) @ weights
        return out


def _by_length(batch: pa.RecordBatch | pa.Table, single: bool, rows: int = 4096) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, unit vectors) of a batch's rows, one vector length and some rows at a time."""
    sizes = pc.binary_length(batch["vector"]).to_numpy(zero_copy_only=False)
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        for k in range(0, len(at), rows):
            some = at[k : k + rows]
            yield some, unit(unpack(batch["vector"].take(pa.array(some)).to_pylist(), single))


def sort_keys(classes: DataFrame, single: bool, passes: range) -> DataFrame:
    """node, pass, key: one row for every pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, n = Planes(len(passes)), len(passes)
        for batch in batches:
            for at, x in _by_length(batch, single):
                keys = planes.keys(x, passes)
                nodes = np.repeat(batch.column("node").to_numpy()[at], n)
                yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(np.tile(np.array(passes, np.int32), len(at))), pa.array(keys.reshape(-1))], ["node", "pass", "key"])

    return classes.select("node", "vector").mapInArrow(run, "node long, pass int, key long")


def _probes(classes: DataFrame, single: bool) -> list[bytes]:
    """Vectors of an even sample (digests are random), and of the most crowded key prefixes."""
    even = [bytes(r.vector) for r in classes.orderBy("digest").select("vector").limit(PROBES).collect()]
    prefix = sort_keys(classes, single, range(1)).groupBy(F.shiftright("key", BITS - 16).alias("prefix"))
    top = prefix.agg(F.count("*").alias("n"), F.min("node").alias("node")).orderBy(F.desc("n"), "prefix").limit(CROWDED).select("node")
    return even + [bytes(r.vector) for r in classes.join(F.broadcast(top), "node", "left_semi").select("vector").collect()]


def between(classes: DataFrame, single: bool, least: float) -> np.ndarray:
    """Probes x trials: the rows that stand between a probe and a partner at cosine ``least``."""
    packed = sorted(_probes(classes, single), key=lambda p: (len(p), p))
    planes, rng = Planes(TRIALS), np.random.default_rng(SEED)
    low, high = np.empty((2, len(packed), TRIALS), np.int64)
    for k, p in enumerate(packed):
        x = unit(unpack([p], single))
        away = rng.standard_normal(x.shape)
        away -= (away @ x.T) * x
        size = np.sqrt((away * away).sum())
        partner = least * x + math.sqrt(max(0.0, 1 - least * least)) * (away / size if size > 1e-9 else 0 * away)
        both = np.sort(planes.keys(np.concatenate([x, partner]), range(TRIALS)), axis=0)
        low[k], high[k] = both

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, n = Planes(TRIALS), np.zeros((len(packed), TRIALS), np.int64)
        for batch in batches:
            for _, x in _by_length(batch, single):
                keys = np.sort(own.keys(x, range(TRIALS)), axis=0)
                for t in range(TRIALS):
                    n[:, t] += np.searchsorted(keys[:, t], high[:, t]) - np.searchsorted(keys[:, t], low[:, t], "right")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n.size, dtype=np.int32)), pa.array(np.maximum(n, 0).reshape(-1))], ["slot", "n"])

    counted = classes.select("vector").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(packed) * TRIALS, np.int64)
    for r in counted:
        out[r.slot] = r.n
    return out.reshape(len(packed), TRIALS)


def plan(counts: np.ndarray, widest: int) -> tuple[int, int] | None:
    """(passes, window) of least cost that miss a probe's partner with probability MISS at most, as
    ``between`` counted; None if no window of ``widest`` rows at most does within MOST passes."""
    best = None
    for window in [w for w in WINDOWS if w <= max(widest, WINDOWS[0])]:
        met = ((counts <= window).sum(axis=1) + 0.5) / (TRIALS + 1)
        missed = np.power((1 - met)[None, :], np.arange(1, MOST + 1)[:, None]).mean(axis=1)
        enough = np.flatnonzero(missed <= MISS)
        if len(enough):
            cost = (enough[0] + 1) * (window + SORT_COST)
            best = min(best or (math.inf, 0, 0), (cost, int(enough[0]) + 1, window))
    return best and best[1:]


def ranked(classes: DataFrame, single: bool, passes: range) -> DataFrame:
    """node, pass, rank: the place of each row in each pass, from 0."""
    keyed = sort_keys(classes, single, passes)
    ordered = keyed.repartitionByRange("pass", "key", "node").sortWithinPartitions("pass", "key", "node")
    place = F.monotonically_increasing_id()
    ordered = cut(ordered.select("node", "pass", F.shiftright(place, 33).alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")))
    runs = sorted(tuple(r) for r in ordered.groupBy("pass", "part").agg(F.min("at"), F.count("*")).collect())  # partitions + passes at most
    starts, last, done = [], None, 0
    for p, part, first, n in runs:
        done = done if p == last else 0
        starts.append((p, part, done - first))
        last, done = p, done + n
    shift = ordered.sparkSession.createDataFrame(starts or [(-1, -1, 0)], "pass int, part long, shift long")
    return ordered.join(F.broadcast(shift), ["pass", "part"]).select("node", "pass", (F.col("at") + F.col("shift")).alias("rank"))


def pass_links(classes: DataFrame, single: bool, least: float, passes: range, window: int, span: int) -> DataFrame:
    """(a, b): links that connect all that the windows of ``passes`` connect."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["pass", "span"]):
            sizes = pc.binary_length(group["vector"]).to_numpy()
            for size in np.unique(sizes):
                part = group.filter(pa.array(sizes == size))
                x = unit(unpack(part["vector"].to_pylist(), single))
                own = int(np.count_nonzero(part["rank"].to_numpy() // span == part["span"].to_numpy()))
                top, nodes = np.arange(len(x)), part["node"].to_numpy()
                edges = [e for a, b in window_pairs(x, own, window, least) for e in forest(top, a, b)]
                if edges:
                    a, b = (np.concatenate(e) for e in zip(*edges))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b])], ["a", "b"])

    here = F.floor(F.col("rank") / span)
    spans = F.when((F.col("rank") % span < window) & (here > 0), F.array(here, here - 1)).otherwise(F.array(here))
    placed = ranked(classes, single, passes).select("node", "pass", "rank", F.explode(spans).alias("span"))
    dealt = placed.join(classes.select("node", "vector"), "node").repartition("pass", "span").sortWithinPartitions("pass", "span", "rank")
    return dealt.select("pass", "span", "rank", "node", "vector").mapInArrow(run, "a long, b long")


def _block_links(blocks: DataFrame, single: bool, least: float) -> DataFrame:
    """(a, null, links): rows of the other block that a links with; (a, b, null): links of a forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["part", "i", "j"]):
            i, j = group["i"][0].as_py(), group["j"][0].as_py()
            sizes = pc.binary_length(group["vector"]).to_numpy()
            for size in np.unique(sizes):
                part = group.filter(pa.array(sizes == size))
                own, nodes, copies = (part[c].to_numpy() for c in ("own", "node", "copies"))
                x = unit(unpack(part["vector"].to_pylist(), single))
                at = np.flatnonzero(own == i)
                to = at if i == j else np.flatnonzero(own == j)
                top, links, edges = np.arange(len(x)), np.zeros(len(x)), []
                for a, b in near_pairs(x[at], None if i == j else x[to], least):
                    a, b = at[a], to[b]
                    links += np.bincount(a, copies[b], len(x)) + np.bincount(b, copies[a], len(x))
                    edges += forest(top, a, b)
                some = np.flatnonzero(links)
                if len(some):
                    a, b = (np.concatenate(e) for e in zip(*edges))
                    none = pa.nulls(len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), none, pa.array(links[some].astype(np.int64))], ["a", "b", "links"])
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[a]), pa.array(nodes[b]), pa.nulls(len(a), pa.int64())], ["a", "b", "links"])

    return blocks.mapInArrow(run, "a long, b long, links long")


def _dealt(members: DataFrame, tasks: int | None) -> DataFrame:
    """Every pair of blocks (i, j) of a ``part`` as a group of rows; ``blocks``: how many it has."""
    spread = members.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = spread.withColumn("x", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    spread = spread.withColumns({"i": F.least("own", "x"), "j": F.greatest("own", "x")}).select("part", "i", "j", "own", "node", "copies", "vector")
    return spread.repartition(*([tasks] if tasks else []), "part", "i", "j").sortWithinPartitions("part", "i", "j")


def all_links(classes: DataFrame, single: bool, least: float) -> DataFrame:
    """The links of all pairs of ``classes``, as counts and forests (see ``_block_links``)."""
    n, size = classes.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("vector")), F.lit(0))).first()
    blocks = max(LEAST_BLOCKS, -(-n // WIDE), -(-size // BLOCK_BYTES))
    tasks = min(blocks * (blocks + 1) // 2, max(LEAST_TASKS, n * blocks // TASK_ROWS))
    return _block_links(_dealt(classes.withColumns({"part": F.lit(0), "blocks": F.lit(blocks).cast("long")}), tasks), single, least)


def _component_links(classes: DataFrame, part: DataFrame, single: bool, least: float) -> DataFrame:
    """The counts of all links within components."""
    members = cut(classes.join(part, "node").select("node", "copies", "vector", F.col("component").alias("part")))
    held = F.count("*")
    blocks = F.least(F.ceil(held / BLOCK), F.greatest(F.lit(MANY), F.ceil(held / WIDE), F.ceil(F.sum(F.octet_length("vector")) / BLOCK_BYTES)))
    dealt = _dealt(members.join(members.groupBy("part").agg(blocks.alias("blocks")), "part"), None)
    return _block_links(dealt, single, least).filter("b IS NULL")


def sorted_links(classes: DataFrame, single: bool, least: float) -> DataFrame | None:
    """(a, b): links that connect what the planned passes connect; None where no plan will do."""
    n, longest = classes.agg(F.count("*"), F.coalesce(F.max(F.octet_length("vector")), F.lit(1))).first()
    room = max(1, BLOCK_BYTES // longest)
    chosen = plan(between(classes, single, least), room) if n else (1, 1)
    if chosen is None:
        return None
    passes, window = chosen
    span = max(window, min(SPAN_WINDOWS * window, room))
    together = max(1, ROUND_ROWS // max(n, 1))
    found = [cut(pass_links(classes, single, least, range(p, min(p + together, passes)), window, span)) for p in range(0, passes, together)]
    links = found[0]
    for more in found[1:]:
        links = links.union(more)
    return links


def near_duplicates(vectors: DataFrame, least: float = 0.9, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row for each row of ``vectors``."""
    single = is_single(vectors)
    rows, classes = classes_of(vectors)
    links = None if exact else sorted_links(classes, single, least)
    if links is None:
        found = cut(all_links(classes, single, least))
        part, counts = named_components(found.filter("b IS NOT NULL"), classes), found.filter("b IS NULL")
    else:
        part = cut(named_components(links, classes))
        counts = _component_links(classes, part, single, least)
    counted = counts.groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("others"))
    known = classes.select("node", "digest", "rep", "copies").join(part, "node", "left").join(counted, "node", "left")
    known = known.select("digest", F.col("copies").alias("held"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), F.coalesce("name", "rep").alias("component"))
    out = join_hubs(rows.select("vec_id", "digest"), known, "digest", rows.count())
    has_id = F.col("vec_id").isNotNull()
    out = out.select("vec_id", F.when(has_id, F.coalesce("n", F.lit(0))).otherwise(0).alias("n_links"), F.when(has_id, F.coalesce("component", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
