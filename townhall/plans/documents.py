"""Versions of a text: chunking, content hashes, pooled embeddings, drift, eras, projections."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.arrays import cosine, dot, first_vector, normalised, pooled

#: Separators in the order they are tried, token limit, characters a token.
SEPARATORS, LIMIT, TOKEN_CHARS = ("\n## ", "\n### ", "\n# ", "\n\n", "\n"), 16_000, 4


def estimated_tokens(text: str) -> int:
    return len(text) // TOKEN_CHARS


def sections(text: str) -> list[str]:
    """The text at the first separator that occurs, which then starts each later part."""
    for mark in SEPARATORS:
        if mark in text:
            head, *rest = text.split(mark)
            return [head, *(mark.lstrip("\n") + part for part in rest)]
    return [text]


def _pieces(text: str, limit: int) -> list[str]:
    width = limit * TOKEN_CHARS
    return [text[i : i + width] for i in range(0, len(text), width)]


def packed_chunks(text: str, limit: int = LIMIT, count: Callable[[str], int] = estimated_tokens, mode: str = "fixed") -> list[tuple[str, int]]:
    """(text, tokens) chunks by greedy packing of sections.

    ``mode="reference"``: a section over the limit is cut only if nothing is waiting before it;
    otherwise it becomes a chunk of its own, over the limit. ``mode="fixed"``: it is always cut.
    """
    done: list[tuple[str, int]] = []
    waiting, size = "", 0
    for part in sections(text):
        n = count(part)
        over = n > limit
        if waiting and (size + n > limit):
            done.append((waiting, size))
            waiting, size = "", 0
            if over and mode == "reference":
                waiting, size = part, n
                continue
        if over:
            done += [(p, count(p)) for p in _pieces(part, limit)]
        elif waiting:
            waiting, size = waiting + "\n\n" + part, size + n
        else:
            waiting, size = part, size + n
    if waiting:
        done.append((waiting, size))
    return done


def chunked(documents: DataFrame, key: str, text: str, limit: int = LIMIT, mode: str = "fixed", count: Callable[[str], int] = estimated_tokens) -> DataFrame:
    """key, chunk_idx, text, n_tokens; a missing text has no chunks."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, t, n) for k, body in zip(batch["_key"], batch["_text"]) if body for i, (t, n) in enumerate(packed_chunks(body, limit, count, mode))]
            yield pd.DataFrame(rows, columns=["_key", "chunk_idx", "text", "n_tokens"])

    kind = documents.schema[key].dataType.simpleString()
    out = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInPandas(run, f"_key {kind}, chunk_idx int, text string, n_tokens int")
    return out.withColumnRenamed("_key", key)


def content_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def cache_split(chunks: DataFrame, cache: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(hits with their vectors, misses to embed) by content hash; ``cache``: hash, vector."""
    hashed = chunks.withColumn("hash", content_hash(F.col(text)))
    return hashed.join(cache, "hash"), hashed.join(cache, "hash", "left_anti")


def pooled_by(chunks: DataFrame, key: str, vector: str, strategy: str, weight: str = "n_tokens", order: str = "chunk_idx") -> DataFrame:
    if strategy == "first":
        return first_vector(chunks, key, order, vector)
    return pooled(chunks, key, vector, F.col(weight) if strategy == "weighted" else None)


def pair_similarity(vectors: DataFrame, key: str, vector: str, blocks: int = 8) -> DataFrame:
    """a, b, similarity for a < b. For a catalogue of versions: rows grow with its square.

    Keys are dealt to blocks and pairs of blocks are joined, so that no task holds all versions.
    """
    unit = vectors.select(F.col(key).alias("a"), normalised(F.col(vector)).alias("va"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("own"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = unit.select("a", "va", F.col("own").alias("i"), every.alias("j"))
    right = unit.select(F.col("a").alias("b"), F.col("va").alias("vb"), every.alias("i"), F.col("own").alias("j"))
    pairs = left.join(right, ["i", "j"]).filter(F.col("a") < F.col("b"))
    return pairs.select("a", "b", dot(F.col("va"), F.col("vb")).alias("similarity"))


def both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.union(pairs.select("b", "a", "similarity"))


def adjacent_drift(vectors: DataFrame, order: str, label: str, vector: str) -> DataFrame:
    """Each version and the next: distance (1 - cosine), middle of their dates, pair label."""
    w = Window.partitionBy().orderBy(order)
    after = vectors.withColumns({"_v": F.lead(vector).over(w), "_o": F.lead(order).over(w), "_l": F.lead(label).over(w)}).filter(F.col("_v").isNotNull())
    return after.select(
        F.concat_ws(" - ", F.col(label), F.col("_l")).alias("pair"), ((F.col(order) + F.col("_o")) / 2).alias("middle"), (1 - cosine(F.col(vector), F.col("_v"))).alias("distance")
    )


def baseline_drift(vectors: DataFrame, order: str, vector: str) -> DataFrame:
    """Distance of every version from the first; one vector is broadcast."""
    base = vectors.agg(F.min_by(vector, order).alias("_base"))
    return vectors.crossJoin(F.broadcast(base)).withColumn("distance", 1 - cosine(F.col(vector), F.col("_base"))).drop("_base")


def era_means(pairs: DataFrame, eras: DataFrame, key: str) -> DataFrame:
    """era_a, era_b, similarity over ordered pairs of different members; alone, an era has no row."""
    a = eras.select(F.col(key).alias("a"), F.col("era").alias("era_a"))
    b = eras.select(F.col(key).alias("b"), F.col("era").alias("era_b"))
    return both_ways(pairs).join(a, "a").join(b, "b").groupBy("era_a", "era_b").agg(F.avg("similarity").alias("similarity"))


def coherence(chunks: DataFrame, key: str, vector: str) -> DataFrame:
    """Mean similarity of a document's own chunks; 1 with fewer than two.

    The mean over pairs is ((sum of unit vectors)^2 - n) / (n (n - 1)): one pass, no pairs.
    """
    unit = chunks.select(key, normalised(F.col(vector)).alias("_v"))
    n = chunks.groupBy(key).agg(F.count("*").alias("n"))
    sums = unit.select(key, F.posexplode("_v").alias("_i", "_x")).groupBy(key, "_i").agg(F.sum("_x").alias("_s"))
    squares = sums.groupBy(key).agg(F.sum(F.col("_s") * F.col("_s")).alias("_q"))
    mean = (F.col("_q") - F.col("n")) / (F.col("n") * (F.col("n") - 1))
    return n.join(squares, key, "left").select(key, "n", F.when(F.col("n") < 2, 1.0).otherwise(mean).alias("coherence"))


def strategy_differences(pairs: dict[str, DataFrame], reference: str) -> DataFrame:
    """strategy, mean difference and correlation of pair similarities against one strategy."""
    base = pairs[reference].select("a", "b", F.col("similarity").alias("_r"))
    parts = [p.join(base, ["a", "b"]).agg(F.lit(s).alias("strategy"), F.avg(F.col("similarity") - F.col("_r")).alias("mean_difference"), F.corr("similarity", "_r").alias("correlation")) for s, p in pairs.items() if s != reference]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _matrix(vectors: DataFrame, key: str, vector: str) -> tuple[list, np.ndarray]:
    rows = vectors.select(key, vector).orderBy(key).collect()
    return [r[0] for r in rows], np.array([r[1] for r in rows], float)


def _moments(vectors: DataFrame, vector: str) -> np.ndarray:
    """The sums of products of (1, v) with itself, (dim + 1) square; vectors with a missing entry are left out.

    Every task adds up its own vectors' products; the tasks' rows of sums are then added up by row.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            column = batch.column("_v")
            if len(column):
                x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
                x = np.hstack([np.ones((len(x), 1)), x])
                x = x[np.isfinite(x).all(1)]
                sums = x.T @ x if sums is None else sums + x.T @ x
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(sums)), pa.int32()), pa.array([row.tobytes() for row in sums], pa.binary())], ["i", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, row in zip(batch.column("i").to_pylist(), batch.column("sums").to_pylist()):
                held[i] = held.get(i, 0.0) + np.frombuffer(row)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([row.tobytes() for row in held.values()], pa.binary())], ["i", "sums"])

    kind = "i int, sums binary"
    known = vectors.filter(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("_v"))
    rows = known.mapInArrow(partial, kind).repartition("i").mapInArrow(total, kind).collect()
    return np.array([np.frombuffer(r.sums) for r in sorted(rows, key=lambda r: r.i)])


def _spectrum(vectors: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, variances from the largest on, axes as columns); only (dim + 1)^2 sums come to the driver."""
    sums = _moments(vectors, vector)
    n, mean = sums[0, 0], sums[0, 1:] / sums[0, 0]
    values, axes = np.linalg.eigh((sums[1:, 1:] - n * np.outer(mean, mean)) / max(1, n - 1))
    return mean, values[::-1], axes[:, ::-1]


def principal_components(vectors: DataFrame, vector: str, k: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components k x dim, explained variance ratio); signs are fixed by each one's largest entry."""
    mean, values, axes = _spectrum(vectors, vector)
    parts = axes[:, :k].T.copy()
    parts *= np.sign(parts[np.arange(len(parts)), np.abs(parts).argmax(1)])[:, None]
    return mean, parts, values[:k] / values.sum()


def explained_variance(vectors: DataFrame, vector: str) -> DataFrame:
    """component (from 1), its variance and its share of the whole."""
    _, values, _ = _spectrum(vectors, vector)
    rows = [(i + 1, float(x), float(x / values.sum())) for i, x in enumerate(values)]
    return vectors.sparkSession.createDataFrame(rows, "component int, variance double, share double")


def projected(vectors: DataFrame, key: str, vector: str, k: int = 2) -> DataFrame:
    """key and its centred coordinates c1..ck."""
    mean, parts, _ = principal_components(vectors, vector, k)
    axes = {f"c{i + 1}": dot(F.transform(F.zip_with(vector, F.array(*[F.lit(float(m)) for m in mean]), lambda x, m: x - m), lambda x: x), F.array(*[F.lit(float(a)) for a in part])) for i, part in enumerate(parts)}
    return vectors.select(key, *[c.alias(n) for n, c in axes.items()])


def mds(distances: np.ndarray, k: int = 2, steps: int = 300, seed: int = 42) -> tuple[np.ndarray, float]:
    """(coordinates, stress) by majorisation on a small distance matrix."""
    n = len(distances)
    x = np.random.default_rng(seed).standard_normal((n, k))
    stress = np.inf
    for _ in range(steps):
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
        now = ((d - distances) ** 2).sum() / 2
        if stress - now < 1e-9 * max(1.0, now):
            break
        stress = now
        ratio = np.divide(distances, d, out=np.zeros_like(d), where=d > 0)
        b = -ratio
        b[np.arange(n), np.arange(n)] = ratio.sum(1) - np.diag(ratio)
        x = b @ x / n
    return x, float(stress)


def ward(distances: np.ndarray) -> np.ndarray:
    """Merges (a, b, height, size) of Ward's method on a small distance matrix; clusters from n up."""
    n = len(distances)
    d = {(i, j): float(distances[i, j]) for i in range(n) for j in range(i + 1, n)}
    size = dict.fromkeys(range(n), 1)
    out = []
    for new in range(n, 2 * n - 1):
        (a, b), height = min(d.items(), key=lambda item: (item[1], item[0]))
        out.append((a, b, height, size[a] + size[b]))
        live = [c for c in size if c not in (a, b)]
        get = lambda i, j: d[min(i, j), max(i, j)]
        for c in live:
            whole = size[a] + size[b] + size[c]
            square = ((size[a] + size[c]) * get(a, c) ** 2 + (size[b] + size[c]) * get(b, c) ** 2 - size[c] * height**2) / whole
            d[c, new] = float(np.sqrt(max(0.0, square)))
        d = {k: v for k, v in d.items() if a not in k and b not in k}
        size[new] = size.pop(a) + size.pop(b)
    return np.array(out)


def distance_matrix(vectors: DataFrame, key: str, vector: str, most: int = 2000) -> tuple[list, np.ndarray]:
    """(keys, 1 - cosine) on the driver, for catalogues of at most ``most`` versions."""
    if vectors.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} versions: use pair_similarity")
    keys, x = _matrix(vectors, key, vector)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    return keys, np.maximum(0, 1 - x @ x.T)
