"""Connected components of a link table, by alternating large-star and small-star steps.

Only minima travel: no neighbour list is ever gathered, so a node with very many links is a
partially aggregated key, and its minimum meets its links by a broadcast of the few such hubs
(``join_hubs``), not in one task of a join. Each round's edges are cut to the checkpoint
folder; the rounds grow with the logarithm of the longest path. Once no more than ``FEW`` edges are
left (16 MB), one task finishes them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_hubs

#: Edges (two 8-byte ids) that one task may finish.
FEW = 1 << 20


def _roots(top: np.ndarray, a: np.ndarray) -> np.ndarray:
    a = top[a]
    while (top[a] != a).any():
        a = top[a]
    return a


def forest(top: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the pairs that join what is apart in ``top``, which is changed to hold them."""
    while len(a):
        u, v = _roots(top, a), _roots(top, b)
        apart = u != v
        a, b, u, v = a[apart], b[apart], u[apart], v[apart]
        high, low = np.maximum(u, v), np.minimum(u, v)
        order = np.lexsort((low, high))
        one = order[np.unique(high[order], return_index=True)[1]]
        top[high[one]] = low[one]
        yield a[one], b[one]


def _finished(edges: DataFrame) -> DataFrame:
    """id, component of a bounded number of edges (u, v), in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*([b.column(k).to_numpy() for k in ("u", "v")] for b in batches))]
        if not columns:
            return
        names, index = np.unique(np.concatenate(columns), return_inverse=True)
        top = np.arange(len(names))
        for _ in forest(top, *np.split(index, 2)):
            pass
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(names[_roots(top, np.arange(len(names)))])], ["id", "component"])

    return edges.coalesce(1).mapInArrow(run, "id long, component long")


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (id, component) for every linked id; component is the smallest id.

    Links with a null end or to oneself say nothing and are ignored; repeated links count once.
    """
    pairs = links.filter("a IS NOT NULL AND b IS NOT NULL").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    stars = cut(pairs.filter("u <> v").distinct())
    if stars.count() <= FEW:
        return _finished(stars)
    mark = None
    while True:
        now = tuple(stars.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.count_distinct("u")).first())
        total = now[0]
        if now == mark:
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).union(stars.select("v", "v").distinct())
        mark = now
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("held"))
        large = join_hubs(both, low, "u", total).filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("held"))
        moved = join_hubs(large, lower, "u", total).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(moved.union(lower.select("u", F.col("m").alias("v"))).distinct())


def named_components(links: DataFrame, classes: DataFrame) -> DataFrame:
    """node, component, name for every linked node: name is the smallest ``rep`` of the component's
    ``classes`` (node, rep)."""
    part = components(links).join(classes.select(F.col("node").alias("id"), "rep"), "id")
    held = cut(part.select(F.col("component").alias("u"), F.col("id").alias("node"), "rep"))
    least = held.groupBy("u").agg(F.min("rep").alias("m"), F.count("*").alias("held"))
    return join_hubs(held, least, "u", held.count()).select("node", F.col("u").alias("component"), F.col("m").alias("name"))
