"""MinHash near-dedup on SetSketch registers.

Every element of a set draws exponentially spaced points, in rising order, each for the next
register of its own permutation; a register keeps its smallest point, stored as the exponent
floor(1 - log_b). Points past a bound that suffices to fill all registers are never drawn. Such
registers merge by maximum and agree on a share of places that follows the Jaccard similarity.

1. Sketch every document's set of word shingles (whole text; numpy over Arrow buffers).
2. Documents with one and the same set are one class, represented by its smallest id.
3. Bands of ``ROWS`` registers are bucket keys; documents that share a key belong to one family
   (connected components over edges to each bucket's smallest id, so a bucket of any size emits a
   row per member).
4. Families are searched breadth first: a document reached is compared with those not reached
   yet, by size, then by the joint likelihood of both sketches, then on the full sets. Every pair
   of a family that is not yet connected is judged, so no component is lost, while a group of
   copies needs a few searches, not all pairs. Families past a size are cut into blocks, and
   every pair of blocks is a task.
5. Components of the confirmed links.

With ``ROWS`` = 4 and 32 bands, two sets at similarity 0.8 share no key with probability 5e-8.

Nulls: null and wordless texts have the empty set and link with nothing; a null id gets no component
and stays. Rows that repeat an id are judged each by its own text. Columns other than id and text are
not read. A text longer than a piece of work is sketched alone, whole. Empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, cut, gram_hashes, grouped, join_hubs, mix, pieces, text_hashes
from .graph import components, named_components

REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
BASE, RATE, TOP = 1.001, 20.0, 65535
#: Estimates this far below the threshold (over five standard errors) are not looked at further.
MARGIN = 0.2
WORD = r"[^\x20\x09-\x0D]"
#: A family of more documents or elements than this is searched in blocks.
BLOCK_DOCS, BLOCK_ELEMENTS = 4096, 2_000_000
#: Ids of family members (8 bytes each) that are sent to the texts' scan; more are joined after it.
SENT_IDS = 1 << 20


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """The distinct k-word shingles of each text as sorted hashes; shorter texts are one shingle."""
    h, first = text_hashes(column, fold=True)
    g = gram_hashes(h, k)
    out = []
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= k:
            out.append(np.unique(g[a : b - k + 1]))
        elif b > a:
            out.append(gram_hashes(h[a:b], int(b - a)))
        else:
            out.append(h[:0])
    return out


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The sketch of each set: len(sets) x REGISTERS exponents (0 for the empty set)."""
    m = REGISTERS
    sizes = np.array([len(s) for s in sets])
    x = np.concatenate([*sets, np.zeros(0, U)])
    owner = np.repeat(np.arange(len(sets)), sizes)
    turn, start = mix(x ^ U(0x51ED2701A3C5B7F9)) | U(1), mix(x ^ U(0x2545F4914F6CDD1D))
    low = np.full(len(sets) * m, np.inf)
    bound = (np.log(m) + 3) / (RATE * np.maximum(sizes, 1))

    def spacing(e: np.ndarray, j: np.ndarray) -> np.ndarray:
        u = (mix(x[e] + (j + U(1)) * U(0x9E3779B97F4A7C15)) >> U(11)) * 2.0**-53
        return -np.log1p(-u) / (RATE * (m - j.astype(float)))

    e, j = np.arange(len(x)), np.zeros(len(x), U)
    v = spacing(e, j)
    waiting: list[tuple[np.ndarray, ...]] = []
    while True:
        while len(e):
            near = v <= bound[owner[e]]
            waiting.append((e[~near], v[~near], j[~near]))
            e, v, j = e[near], v[near], j[near]
            place = ((turn[e] * j + start[e]) & U(m - 1)).astype(np.int64)
            np.minimum.at(low, owner[e] * m + place, v)
            j = j + U(1)
            more = j < U(m)
            e, v, j = e[more], v[more], j[more]
            v = v + spacing(e, j)
        short = np.isinf(low.reshape(-1, m)).any(1) & (sizes > 0)
        if not short.any():
            break
        bound[short] *= 2
        e, v, j = (np.concatenate(parts) for parts in zip(*waiting))
        again = short[owner[e]]
        waiting = [(e[~again], v[~again], j[~again])]
        e, v, j = e[again], v[again], j[again]
    with np.errstate(divide="ignore"):
        power = np.floor(1 - np.log(low) / np.log(BASE))
    return np.clip(power, 0, TOP).astype("<u2").reshape(-1, m)


def band_keys(regs: np.ndarray) -> np.ndarray:
    packed = np.ascontiguousarray(regs).view("<u8").astype(U)
    return mix(packed + np.arange(1, BANDS + 1, dtype=U) * U(0x9E3779B97F4A7C15)).view(np.int64)


def similarity(one: np.ndarray, others: np.ndarray, size: int, sizes: np.ndarray) -> np.ndarray:
    """Jaccard similarities of most joint likelihood, given how many registers of ``one`` are above,
    below and equal to those of each of ``others``, and the sets' exact sizes."""
    above, below = (others < one).sum(1), (others > one).sum(1)
    equal = REGISTERS - above - below
    u, v = size / (size + sizes), sizes / (size + sizes)
    c = (BASE - 1) / BASE
    chance = lambda x: -np.log1p(-x * c) / np.log(BASE)
    slope = lambda x: c / (np.log(BASE) * (1 - x * c))
    lo, hi = np.zeros(len(sizes)), np.minimum(u / v, v / u)
    for _ in range(22):
        at = (lo + hi) / 2
        up, down = u - v * at, v - u * at
        gain = (v * slope(up) + u * slope(down)) / np.maximum(1 - chance(up) - chance(down), 1e-12)
        rise = equal * gain - above * v * slope(up) / np.maximum(chance(up), 1e-12) - below * u * slope(down) / np.maximum(chance(down), 1e-12)
        lo, hi = np.where(rise > 0, at, lo), np.where(rise > 0, hi, at)
    return (lo + hi) / 2


def links(ids: np.ndarray, sets: list[np.ndarray], regs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links that connect every component of the family (a spanning forest)."""
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    names, flat = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(names), bool)
    free = np.ones(len(sets), bool)
    found = []
    for root in range(len(sets)):
        if not free[root]:
            continue
        free[root] = False
        queue = [root]
        while queue:
            p = queue.pop()
            c = np.flatnonzero(free)
            if not len(c):
                return found
            c = c[100 * np.minimum(sizes[c], sizes[p]) >= percent * np.maximum(sizes[c], sizes[p])]
            agree = (regs[c] == regs[p]).mean(1)
            c = c[agree >= percent / 100 - 2 * MARGIN]
            if len(c):
                c = c[similarity(regs[p], regs[c], sizes[p], sizes[c]) >= percent / 100 - MARGIN]
            if not len(c):
                continue
            marked[flat[begins[p] : ends[p]]] = True
            n = sizes[c]
            at = np.arange(n.sum()) + np.repeat(begins[c] - (np.cumsum(n) - n), n)
            shared = np.add.reduceat(marked[flat[at]].astype(np.int64), np.cumsum(n) - n)
            marked[flat[begins[p] : ends[p]]] = False
            c = c[100 * shared >= percent * (n + sizes[p] - shared)]
            found += [(int(ids[p]), int(ids[q])) for q in c]
            free[c] = False
            queue += c.tolist()
    return found


def _digest(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def sketches(documents: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, digest (of the set; null if empty), sketch, bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            sets = shingle_sets(batch.column("text"), k)
            regs = registers(sets)
            keys = band_keys(regs)
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("text_hash"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s) if f else None for s, f in zip(sets, full)], pa.binary()),
                    pa.array([r.tobytes() if f else None for r, f in zip(regs, full)], pa.binary()),
                    pa.array([b if f else None for b, f in zip(keys, full)], pa.list_(pa.int64())),
                ],
                ["doc_id", "text_hash", "n_shingles", "digest", "sketch", "bands"],
            )

    schema = "doc_id long, text_hash long, n_shingles long, digest binary, sketch binary, bands array<long>"
    return documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def _family_links(members: DataFrame, k: int, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["family", "i", "j"]):
            sets: list[np.ndarray] = []
            for batch in pieces(iter(group.select(["text"]).to_batches()), "text"):
                sets += shingle_sets(batch.column("text"), k)
            ids = group.column("node").to_numpy()
            want = group.column("digest").to_pylist()
            own = list({int(ids[i]): i for i, s in enumerate(sets) if _digest(s) == want[i]}.values())
            sketch = group.column("sketch").to_pylist()
            regs = np.frombuffer(b"".join(sketch[i] for i in own), "<u2").reshape(-1, REGISTERS)
            pairs = links(ids[own], [sets[i] for i in own], regs, percent) if len(own) > 1 else []
            if pairs:
                a, b = zip(*pairs)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return members.mapInArrow(run, "a long, b long")


def _judged(documents: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(drawn, known): the rows' sketches, and digest, component, name (its smallest id), held (rows)."""
    drawn = cut(sketches(documents, k))
    identified = drawn.filter("digest IS NOT NULL AND doc_id IS NOT NULL")
    firsts = [F.first(c).alias(c) for c in ("n_shingles", "sketch", "bands")]
    classes = identified.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("held"), *firsts)
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    keys = classes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("held")).filter("held > 1")
    stars = keys.join(shared, "key").select(F.col("node").alias("a"), F.col("lead").alias("b"))
    family = components(stars).select(F.col("id").alias("node"), F.col("component").alias("family"))
    joined = cut(classes.select("node", "rep", "digest", F.col("n_shingles").alias("n"), "sketch").join(family, "node"))
    sums = joined.groupBy("family").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_ELEMENTS, F.count("*") / BLOCK_DOCS)).alias("blocks"))
    placed = joined.join(sums, "family").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = placed.select("node", "rep", "digest", "sketch", "family", "own", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("x"))
    dealt = dealt.select("node", "rep", "digest", "sketch", "family", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"))
    texts = documents.select(F.col("doc_id").cast("long").alias("rep"), "text")
    if joined.count() <= SENT_IDS:
        texts = texts.join(F.broadcast(joined.select("rep")), "rep", "left_semi")
    members = texts.join(dealt, "rep").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node")
    found = cut(_family_links(members, k, percent))
    part = named_components(found, classes)
    known = classes.join(part, "node", "left")
    return drawn, known.select("digest", F.coalesce("component", "node").alias("component"), F.coalesce("name", "rep").alias("name"), "held")


def near_duplicates(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for each row of ``documents``.

    Documents are linked when 100 * intersection >= percent * union of their shingle sets;
    component_id is the smallest id reachable, and the document of that id is kept.
    """
    drawn, known = _judged(documents, k, percent)
    rows = drawn.select("doc_id", "n_shingles", "digest")
    out = join_hubs(rows, known.select("digest", "name", "held"), "digest", rows.count())
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("name", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``documents`` with one row for each group of near copies: of the group's smallest id, and where
    that has several texts in the group, of one of them; rows that repeat it once.

    Rows without an id or without words stay as they are.
    """
    drawn, known = _judged(documents, k, percent)
    rows = drawn.filter("digest IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "text_hash", "digest")
    placed = join_hubs(rows, known.select("digest", "component", "held"), "digest", rows.count())
    texts = placed.groupBy("component", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = texts.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash", "n")).alias("one")).select("one.*")
    first = cut(first.select(F.col("doc_id").alias("id"), F.col("text_hash").alias("hash"), "n"))
    words = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    held = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("hash"), (~words | F.col("doc_id").isNull()).alias("free")
    )
    marked = held.join(first, ["id", "hash"], "left")
    single = marked.filter("free OR n = 1").select("row.*")
    if first.filter("n > 1").isEmpty():
        return single
    return single.unionByName(marked.filter("NOT free AND n > 1").dropDuplicates(["id", "hash"]).select("row.*"))
