"""What the corpus operators share: reading, cutting lineage, and the byte-level word kernel.

A word is a run of bytes other than ASCII white space (``[^\\x20\\x09-\\x0D]+``). Texts are
handled as the UTF-8 buffers that Arrow hands over, whole batches at a time, so that no Python
object is made per word. Null texts are empty texts.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel works on at once; one longer document is worked on alone.
PIECE_BYTES = 2 << 20

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="townhall-code-")) / "townhall_code.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, str(f.relative_to(root.parent)))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: the one that ``spark.checkpoint.dir`` names; where a session
    has none, a temporary one on a single machine. A cluster without one is refused: its machines
    share no such folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="townhall-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and cut its lineage."""
    _shared_folder(df.sparkSession)
    return df.checkpoint()


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared checkpoint folder."""
    return f"{_shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared checkpoint folder and read again."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: A key with more than one in HUBS of all rows is a hub.
HUBS = 200


def join_hubs(rows: DataFrame, names: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` left joined with ``names``, which has each ``key`` once and ``held``, how many of
    the ``total`` rows have it: by a broadcast for the hubs (at most HUBS names, if ``total`` is
    right), by a join for all other keys, so that no hub's rows meet in one task."""
    hub = F.col("held") * HUBS > total
    hubs = F.broadcast(names.filter(hub).drop("held"))
    rest = rows.join(F.broadcast(names.filter(hub).select(key)), key, "left_anti")
    return rows.join(hubs, key).unionByName(rest.join(names.filter(~hub).drop("held"), key, "left"))


def trim() -> None:
    """Hand freed memory back to the system (where the C library can), so that a worker which lives
    on does not keep its largest task's memory."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else pa.large_string()
    column = pc.fill_null(column.cast(kind), b"" if kind == pa.large_binary() else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return (raw[off[0] : off[-1]], off - off[0]) if len(off) else (raw[:0], np.zeros(1, np.int64))


def pieces(batches: Iterator[pa.RecordBatch], column: str, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into row ranges whose ``column`` holds about ``limit`` bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.nan_to_num(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(float))
        part = np.cumsum(sizes) // limit
        bounds = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            yield batch.slice(a, b - a)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply) over an array."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def _byte_values(fold: bool) -> np.ndarray:
    values = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
    if fold:
        values[65:91] = values[97:123]
    return values


_VALUES = {fold: _byte_values(fold) for fold in (False, True)}
_BASE = 0xD6E8FEB86659FD93
_POWERS = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        steps = np.full(max(n, 256), U(_BASE), U)
        steps[0] = U(1)
        _POWERS = np.multiply.accumulate(steps)
    return _POWERS


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and for each row the index of its first word (n + 1)."""
    solid = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    if len(data):
        before[0], before[1:] = False, solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty_like(solid)
    if len(data):
        after[-1], after[:-1] = False, solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


#: Words that are hashed at once: the kernel's arrays take some 40 bytes for each of their bytes.
HASH_WORDS = 1 << 17


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of each word; ``fold`` lower-cases A-Z."""
    out = np.empty(len(starts), U)
    for a in range(0, len(starts), HASH_WORDS):
        out[a : a + HASH_WORDS] = _hashes(data, starts[a : a + HASH_WORDS], ends[a : a + HASH_WORDS], fold)
    return out


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64)
    shift = np.repeat(starts - first, lengths)
    value = _VALUES[fold][data[place + shift]]
    place -= np.repeat(first, lengths)
    value *= powers(int(lengths.max()))[place]
    return mix(np.add.reduceat(value, first) + lengths.astype(U) * U(0xA0761D6478BD642F))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values of ``h``, across rows too; len(h) - k + 1 values."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    g = h[:n].copy()
    for j in range(1, k):
        g *= U(0x9FB21C651E98DF25)
        g += h[j : j + n]
    return mix(g + U(k))


def text_hashes(column: pa.Array, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a text column, and each row's first word (n + 1)."""
    data, offsets = buffers(column)
    starts, ends, first = words(data, offsets)
    return word_hashes(data, starts, ends, fold), first


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The row groups of batches that are sorted by ``keys``, each as one table."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        now = tuple(c[0] for c in columns)
        if held and now != last:
            yield pa.Table.from_batches(held)
            held = []
        bounds = [0, *np.flatnonzero(change), batch.num_rows]
        for a, b in zip(bounds, bounds[1:-1]):
            yield pa.Table.from_batches([*held, batch.slice(a, b - a)])
            held = []
        held.append(batch.slice(bounds[-2], bounds[-1] - bounds[-2]))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
