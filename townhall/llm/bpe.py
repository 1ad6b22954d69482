"""BPE encoding and decoding with a contiguous rank array.

A word's parts and the ranks of its adjacent pairs lie in two short lists; the lowest rank is
found by scanning, its boundary is deleted, and only the two neighbouring ranks are looked up
again. Words past ``LONG`` symbols use a heap over the same ranks, with equal results, since
scanning is quadratic there.

Text between white space encodes independently of its surroundings, so encoded words are kept in
a bounded table per Python worker. Vocabulary and merges are read on the driver and broadcast;
their size is that of the tokenizer's file.

Null texts count as empty and give no tokens. Special tokens that occur literally in a text
encode to their own ids. Extra columns are not read. Empty tables give empty results.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

VOCABULARY = "word_bpe_49k.json"
#: Words kept per worker; beyond it the table starts anew.
KEEP = 300_000
#: Symbols from which a word's merges go through a heap.
LONG = 200
NEVER = 1 << 62
_OWN_SPACE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable stand-in of every byte that byte-level vocabularies use."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    table = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Coder:
    """Encoder and decoder of one tokenizer file (lower-casing BPE with word ends)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + end] for s in symbols]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for i, (a, b) in enumerate(model["merges"]):
            self.rank.setdefault(vocab[a] << 32 | vocab[b], i)
            self.made.append(vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = dict((i, t) for t, i in vocab.items()) | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}"))
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.known: dict[str, bytes] = {}

    def merged(self, parts: list[int]) -> list[int]:
        """The parts of one word after all merges: lowest rank first, leftmost on ties."""
        if len(parts) > LONG:
            return self._merged_long(parts)
        look, made = self.rank.get, self.made
        ranks = [look(a << 32 | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks and (low := min(ranks)) != NEVER:
            i = ranks.index(low)
            parts[i] = made[low]
            del parts[i + 1], ranks[i]
            if i:
                ranks[i - 1] = look(parts[i - 1] << 32 | parts[i], NEVER)
            if i < len(ranks):
                ranks[i] = look(parts[i] << 32 | parts[i + 1], NEVER)
        return parts

    def _merged_long(self, parts: list[int]) -> list[int]:
        n, look = len(parts), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := look(parts[i] << 32 | parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := look(parts[x] << 32 | parts[y])) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [p for p in parts if p >= 0]

    def chunk(self, text: str) -> bytes:
        """Ids, as packed little-endian 32-bit integers, of a text without special tokens."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            text = "".join([c.lower() for c in text])
        else:
            text = text.lower()
        ids: list[int] = []
        for word in self.split.findall(text):
            raw = word.encode()
            parts = [self.inner[b] for b in raw[:-1]]
            parts.append(self.final[raw[-1]])
            ids += self.merged(parts)
        return np.array(ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" in text and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return b"".join(self.special[p].to_bytes(4, "little") if i % 2 else self.encode_plain(p) for i, p in enumerate(parts))
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        if _OWN_SPACE.search(text):  # str.split() would cut where the tokenizer does not
            return self.chunk(text)
        words = text.split()
        known = self.known
        try:
            return b"".join([known[w] for w in words])
        except KeyError:
            for w in words:
                if w not in known:
                    if len(known) >= KEEP:
                        known.clear()
                        return b"".join([self.chunk(x) for x in words])
                    known[w] = self.chunk(w)
            return b"".join([known[w] for w in words])


_CODERS: dict[int, Coder] = {}


def _coder(source) -> Coder:
    """This worker's coder for a broadcast file; one is kept."""
    key = hash(source.value)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(source.value)
    return _CODERS[key]


def _strings(column: pa.Array) -> list[str]:
    return pc.fill_null(column, "").to_pylist()


def _decoded(names: pa.Array, ids: list[bytes]) -> pa.Array:
    flat = np.frombuffer(b"".join(ids), "<u4")
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), names.take(pa.array(flat)))
    return pc.binary_join(lists, " ")


def read_vocabulary(path: str | None = None) -> str:
    """The tokenizer file's content, read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        return f.read()


def _plan(df: DataFrame, key: str, text: str, path: str | None, with_text: bool) -> DataFrame:
    source = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(source)
        names = pa.array(coder.names, pa.string())
        for batch in pieces(batches, "_text"):
            ids = [coder.encode(t) for t in _strings(batch.column("_text"))]
            n = pa.array([len(x) // 4 for x in ids], pa.int64())
            out = [batch.column("_key"), n, pa.array(ids, pa.binary())]
            if with_text:
                out.append(_decoded(names, ids))
            yield pa.RecordBatch.from_arrays(out, ["_key", "n_tokens", "ids", "decoded"][: len(out)])

    kind = df.schema[key].dataType.simpleString()
    schema = f"_key {kind}, n_tokens long, ids binary" + ", decoded string" * with_text
    return df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_key", key)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """key, n_tokens, ids (packed little-endian unsigned 32-bit integers) of every row."""
    return _plan(df, key, text, path, with_text=False)


def encode_and_decode(df: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """As ``encode``, with ``decoded``: the ids' own decoding (token texts joined by a space)."""
    return _plan(df, key, text, path, with_text=True)


def decode(df: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """key, decoded for packed ids; null ids decode to an empty text."""
    source = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(_coder(source).names, pa.string())
        for batch in pieces(batches, "_ids"):
            packed = pc.fill_null(batch.column("_ids"), b"").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("_key"), _decoded(names, packed)], ["_key", "decoded"])

    kind = df.schema[key].dataType.simpleString()
    out = df.select(F.col(key).alias("_key"), F.col(ids).alias("_ids")).mapInArrow(run, f"_key {kind}, decoded string")
    return out.withColumnRenamed("_key", key)
