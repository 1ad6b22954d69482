"""Language-model scores: Katz backoff over Good-Turing discounted counts.

The model is a bigram model that backs off to unigrams, and those to one unknown word. A count r up
to ``LARGE`` is discounted by Katz's formula from the numbers of n-grams that occur r times; where
that gives no value between 0 and 1 (small corpora), half a count is taken off instead. Backoff
weights divide the mass left by a context by the mass that its unseen words have below, so that each
context's probabilities add up to 1, the unknown word included. A context whose discounts leave
nothing gives half a count to its unseen words; contexts never seen back off with weight 1.

1. Texts are coded in pieces of some MB: a piece's words once, as hashes with their training counts, and
   its tokens as their places. This is the one copy of the input that is stored (in the checkpoint folder).
2. The pieces' words are dealt out by hash, summed up, and answered by codes that hold a word's training
   count. The answers go back to the pieces; no table of words comes to the driver or to every task,
   whatever its size.
3. Every task folds its pieces' bigrams into sorted, packed lists (contexts, words, documents), dealt out
   by context. A context with more than a quarter of a partition's tokens is spread by the following word
   over as many partitions as it needs. The shuffle's files are the model's partitioned table: they are
   written once and read twice, as one RDD, since a second copy in the checkpoint folder would add to
   the disk. Lost ones are recomputed from the coded texts.
4. The first reading counts how many bigrams occur r times, and adds up the spread contexts.
5. The second derives discounts and backoff weights and evaluates all tokens of the bigrams it holds.
   ``READERS`` tasks do so, one partition after the other, and add up in memory what each piece's
   documents get, so that what comes back follows the documents and not documents x partitions. A task
   holds 8 bytes for each document.

Codes have 32 bits for a count and for the words of one count; larger corpora are refused.
Words are lower-cased (A-Z) and a text ends with an end token that is counted. Null and empty texts
are the end token alone. Repeated ids and rows are scored row by row. Without training texts every
score is 0. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import U, cut, grouped, mix, pieces, text_hashes, trim

LARGE = 5
START, END = U(0x5354415254), U(0x454E44)
#: Training tokens whose bigrams one partition should hold, bytes of text coded and folded together here, and
#: by ``backoff``.
PART_TOKENS, PIECE_TEXT, FOLD_BYTES = 1_000_000, 6 << 20, 3 << 20
#: Kinds of words of all pieces that one task sums up, and the least that this may be set to.
VOCABULARY, LEAST_KINDS = 1 << 20, 1 << 12
#: Tasks of the second reading: each brings 8 bytes for each document at most.
READERS = 48


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 1


def discounts(n: np.ndarray) -> np.ndarray:
    """Factors for counts 0 to LARGE, and 1 in the last place for larger ones; n[r]: n-grams seen r times."""
    out = np.ones(LARGE + 2)
    top = (LARGE + 1) * n[LARGE + 1] / n[1] if n[1] else 1.0
    for r in range(1, LARGE + 1):
        good = n[r] and n[r + 1] and top < 1
        d = ((r + 1) * n[r + 1] / n[r] / r - top) / (1 - top) if good else 0.0
        out[r] = d if 0 < d < 1 else 1 - 0.5 / r
    return out


@dataclass
class Unigrams:
    """Word probabilities: ``tokens`` in training, of ``types`` kinds; ``factor`` by count."""

    tokens: int
    types: int
    factor: np.ndarray
    seen: float  # the mass of seen words, before the guard

    @classmethod
    def of(cls, n: np.ndarray, tokens: int, types: int, over: int) -> Unigrams:
        """``n[r]``: words seen r times; ``over``: tokens of words seen more than LARGE times."""
        factor = discounts(n)
        kept = sum(factor[r] * r * n[r] for r in range(1, LARGE + 1)) + over
        return cls(tokens, types, factor, kept / tokens if tokens else 0.0)

    def probability(self, count: np.ndarray) -> np.ndarray:
        """By training count; count 0 is the one unknown word."""
        if not self.tokens:
            return np.ones(len(count))
        p = self.factor[np.minimum(count, LARGE + 1)] * count / self.tokens
        if self.seen > 1 - 1e-12:
            guard = self.tokens / (self.tokens + 0.5)
            return np.where(count > 0, p * guard, 1 - guard)
        return np.where(count > 0, p, 1 - self.seen)

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))


def token_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts, each with its end token, and each row's first token (n + 1)."""
    h, first = text_hashes(column, fold=True)
    n = len(first) - 1
    starts = first + np.arange(n + 1)
    out = np.full(len(h) + n, END, U)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(first))] = h
    return out, starts


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers below 2^64, each at its least width, byte by byte, compressed."""
    head, planes = [len(columns)], []
    for column in columns:
        width = (int(column.max()).bit_length() + 7) // 8 if len(column) else 0
        head += [len(column), width]
        planes.append(column.astype("<u8").view(np.uint8).reshape(-1, 8).T[:width].tobytes())
    return zlib.compress(np.array(head, "<u4").tobytes() + b"".join(planes), 1)


def unpack(blob: bytes) -> list[np.ndarray]:
    """The columns as ``pack`` got them, in types as wide as their largest value."""
    raw, out = zlib.decompress(blob), []
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    shape = np.frombuffer(raw, "<u4", 2 * n, 4).tolist()
    at = 4 + 8 * n
    for rows, width in zip(shape[::2], shape[1::2]):
        size = next(s for s in (1, 2, 4, 8) if s >= width)
        column = np.zeros((rows, size), np.uint8)
        column[:, :width] = np.frombuffer(raw, np.uint8, rows * width, at).reshape(width, rows).T
        out.append(column.view(f"<u{size}").reshape(-1))
        at += rows * width
    return out


_DOCUMENTS = ("<i8", "?", "?", "<i8", "<i8", "<f8", "<f8")


def pack_documents(*columns: np.ndarray) -> bytes:
    """Ids, whether there is one, held out or not, tokens, known tokens, base and unigram scores
    (or as many of these as are known)."""
    return len(columns).to_bytes(1) + b"".join(c.astype(t).tobytes() for c, t in zip(columns, _DOCUMENTS))


def unpack_documents(blob: bytes) -> list[np.ndarray]:
    types = _DOCUMENTS[: blob[0]]
    width = [np.dtype(t).itemsize for t in types]
    n = len(blob) // sum(width)
    ends = 1 + np.cumsum([0, *width]) * n
    return [np.frombuffer(blob[a:b], t) for a, b, t in zip(ends, ends[1:], types)]


def pack_sums(values: np.ndarray) -> bytes:
    """Doubles by place; only those other than 0 where that is shorter."""
    places = np.flatnonzero(values)
    if 12 * len(places) < 8 * len(values):
        return b"s" + values[places].astype("<f8").tobytes() + places.astype("<u4").tobytes()
    return b"d" + values.astype("<f8").tobytes()


def add_sums(score: np.ndarray, blob: bytes) -> None:
    if blob[:1] == b"s":
        n = (len(blob) - 1) // 12
        score[np.frombuffer(blob, "<u4", n, 1 + 8 * n)] += np.frombuffer(blob, "<f8", n, 1)
    else:
        score += np.frombuffer(blob, "<f8", -1, 1)


def by_count(counts: np.ndarray) -> np.ndarray:
    """The order of a piece's words in its tokens, which keeps those short."""
    return np.argsort(-counts.astype(np.int64), kind="stable")


def _coded(texts: DataFrame) -> DataFrame:
    """A row for each piece of texts: how many documents it trains on, how many kinds of words
    it has, its documents (training ones first), those kinds (sorted hashes, as differences), their
    training counts, and its tokens as places among the kinds in the order ``by_count``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = TaskContext.get().partitionId() << 32
        for piece, batch in enumerate(pieces(batches, "text", PIECE_TEXT), start):
            batch = batch.take(pa.array(np.argsort(batch.column("held").to_numpy(zero_copy_only=False), kind="stable")))
            held = batch.column("held").to_numpy(zero_copy_only=False).astype(bool)
            tokens, first = token_hashes(batch.column("text"))
            words, index = np.unique(tokens, return_inverse=True)
            trained = int(first[np.count_nonzero(~held)])
            counts = np.bincount(index[:trained], minlength=len(words))
            rank = np.empty(len(words), np.int64)
            rank[by_count(counts)] = np.arange(len(words))
            ids = pa.array(batch.column("doc_id"))
            docs = pack_documents(ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False), held, np.diff(first))
            row = [piece, int(np.count_nonzero(~held)), len(words), docs, pack(np.diff(words, prepend=U(0))), pack(counts), pack(rank[index])]
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names)
        trim()

    names = ["piece", "training", "kinds", "docs", "words", "counts", "tokens"]
    return texts.mapInArrow(run, "piece long, training long, kinds long, docs binary, words binary, counts binary, tokens binary")


def _answers(coded: DataFrame, shards: int) -> DataFrame:
    """piece, shard, blob: codes of each piece's kinds of words, in order, ``shards`` of them by hash. In place of a
    piece, -1: tokens in training, their kinds, tokens of those seen more than LARGE times, kinds seen
    1..LARGE + 1 times.

    A word's code is its training count << 32 and a number from 1 among the words of that count, so that
    frequent words take few bytes and a code holds its count; words that never occur in training
    share code 0."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, blob, counts in zip(*(batch.column(c) for c in ("piece", "words", "counts"))):
                words, counts = np.cumsum(unpack(blob.as_py())[0], dtype=U), unpack(counts.as_py())[0]
                ends = np.searchsorted((words >> U(32)) * U(shards) >> U(32), np.arange(shards + 1))
                full = np.flatnonzero(np.diff(ends))
                blobs = [pack(np.diff(words[a:b], prepend=U(0)), counts[a:b]) for a, b in zip(ends[full], ends[full + 1])]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(full), piece.as_py())), pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of: list[tuple[int, int]] = []
        words, counts = [], []
        for batch in batches:
            for piece, shard, blob in zip(*(batch.column(c).to_pylist() for c in names)):
                steps, n = unpack(blob)
                words.append(np.cumsum(steps, dtype=U))
                counts.append(n)
                of.append((piece, shard))
        if not of:
            return
        ends = np.cumsum([len(w) for w in words])
        kinds, at = np.unique(np.concatenate(words), return_inverse=True)
        n = np.bincount(at, np.concatenate(counts), len(kinds)).astype(np.int64)
        by = np.argsort(n, kind="stable")
        first = np.flatnonzero(np.diff(n[by], prepend=-1))
        number = np.empty_like(n)
        number[by] = np.arange(len(n)) - np.repeat(first, np.diff(np.append(first, len(n))))
        number = 1 + number * shards + of[0][1]
        if max(n.max(), number.max()) >> 32:
            raise OverflowError("a word's count, or the words of one count, go past 32 bits")
        code = np.where(n > 0, n << 32 | number, 0)[at]
        few = np.bincount(np.minimum(n, LARGE + 2), minlength=LARGE + 3)[1 : LARGE + 2]
        summary = np.array([n.sum(), np.count_nonzero(n), n[n > LARGE].sum(), *few])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([of[0][1]], pa.int32()), pa.array([pack(summary)])], names)
        for (piece, shard), a, b in zip(of, ends - [len(w) for w in words], ends):
            yield pa.RecordBatch.from_arrays([pa.array([piece]), pa.array([shard], pa.int32()), pa.array([pack(code[a:b])])], names)
        trim()

    names, schema = ["piece", "shard", "blob"], "piece long, shard int, blob binary"
    asked = coded.select("piece", "words", "counts").mapInArrow(ask, schema)
    return asked.repartitionById(shards, F.col("shard")).mapInArrow(run, schema)


def _summary(answers: DataFrame) -> Unigrams:
    """The unigram level, from a row for each shard of the words."""
    rows = [unpack(bytes(r.blob))[0].astype(np.int64) for r in answers.filter("piece < 0").select("blob").collect()]
    tokens, types, over, *n = sum(rows, np.zeros(LARGE + 4, np.int64)).tolist()
    return Unigrams.of(np.array([0, *n], float), tokens, types, over)


_FOLDED, _SUMS = "p int, piece long, docs boolean, blob binary", "piece long, docs boolean, blob binary"


def deal(context: np.ndarray, word: np.ndarray, parts: int, most: int) -> np.ndarray:
    """The partition of each bigram: by context; one with more than ``most`` tokens takes a partition for
    every so many, by the following word."""
    slots = (context >> U(32)) // U(most) + U(1)
    slot = mix(word ^ U(0xBB67AE8584CAA73B)) % slots
    return (mix(mix(context ^ U(0x6A09E667F3BCC908)) + slot) % U(parts)).astype(np.int64)


def _single(rows: RDD) -> RDD:
    """``rows`` handed on one by one, as those of zipped partitions must be."""
    return rows._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _with_answers(coded: DataFrame, answers: DataFrame) -> RDD:
    """(row of ``coded``, (piece, its answers' blobs by shard)). Both are brought together by the partition
    that a piece comes from, in its order there, so that the coded texts need no shuffle."""

    def own(rows: Iterator) -> Iterator[tuple[int, list[bytes]]]:
        of: dict[int, list[tuple[int, bytes]]] = {}
        for r in rows:
            of.setdefault(r.piece, []).append((r.shard, bytes(r.blob)))
        for piece in sorted(of):
            yield piece, [blob for _, blob in sorted(of.pop(piece))]

    rows = coded.select("piece", "docs", "counts", "tokens").rdd
    home = F.shiftright("piece", 32).cast("int")
    named = answers.filter("piece >= 0").repartitionById(rows.getNumPartitions(), home).rdd.mapPartitions(own)
    return _single(rows).zip(_single(named))


def _folded(coded: DataFrame, answers: DataFrame, unigrams: Unigrams, training: int, parts: int, most: int) -> DataFrame:
    """Packed bigrams dealt to partitions ``p``, and packed sums of each piece's documents. Bigrams whose
    context never occurs in training add nothing to a unigram score and are left out."""

    def run(pairs: Iterator) -> Iterator[tuple[int, int, bool, bytes]]:
        for row, (piece, blobs) in pairs:
            if row.piece != piece:
                raise ValueError("a piece met the answers of another one")
            ids, valid, held, n_tokens = unpack_documents(bytes(row.docs))
            index = unpack(bytes(row.tokens))[0].astype(np.int64)
            # Local numbers of words: 0 for all unknown ones, the last for the start.
            codes = np.concatenate([unpack(b)[0].astype(U) for b in blobs])[by_count(unpack(bytes(row.counts))[0])]
            codes = np.concatenate([np.zeros(1, U), codes, np.array([training << 32], U)])
            index = np.where(codes[index + 1] > 0, index + 1, 0)
            first = np.cumsum(n_tokens) - n_tokens
            rows, kinds = len(ids), len(codes)
            count = (codes >> U(32)).astype(np.int64)
            per = lambda values: np.add.reduceat(values[index], first)
            known, base, lower = per((count > 0).astype(np.int64)), per(unigrams.base(count)), per(np.log10(unigrams.probability(count)))
            context = np.empty_like(index)
            context[1:] = index[:-1]
            context[first] = kinds - 1
            doc = np.repeat(np.arange(rows), n_tokens)
            seen = codes[context] > 0
            pair, names = context[seen] * kinds + index[seen], None
            if kinds * kinds * rows >> 63:
                names, pair = np.unique(pair, return_inverse=True)
            post, times = np.unique(pair * rows + doc[seen], return_counts=True)
            pair, doc = post // rows, post % rows
            new = np.flatnonzero(np.diff(pair, prepend=-1))
            held_in = np.diff(np.append(new, len(pair)))
            pair = pair[new] if names is None else names[pair[new]]
            h, w = codes[pair // kinds], codes[pair % kinds]
            p = deal(h, w, parts, most)
            by = np.argsort(p, kind="stable")  # a context's bigrams lie together
            by_post = np.arange(len(doc)) - np.repeat(np.cumsum(held_in[by]) - held_in[by], held_in[by]) + np.repeat(new[by], held_in[by])
            h, w, m, doc, times = h[by], w[by], held_in[by], doc[by_post], times[by_post]
            ends = np.searchsorted(p[by], np.arange(parts + 1))
            post_ends = np.append(0, np.cumsum(m))[ends]
            at_p = np.flatnonzero(np.diff(ends))
            size = np.array([rows, np.count_nonzero(~held)])
            for k in at_p.tolist():
                i, j = slice(ends[k], ends[k + 1]), slice(post_ends[k], post_ends[k + 1])
                begin = np.flatnonzero(np.concatenate([[True], h[i][1:] != h[i][:-1]]))
                yield k, piece, False, pack(size, h[i][begin], np.diff(np.append(begin, len(h[i]))), w[i], m[i] - 1, doc[j], times[j] - 1)
            yield piece % parts, piece, True, pack_documents(ids, valid, held, n_tokens, known, base, lower)
        trim()

    return coded.sparkSession.createDataFrame(_with_answers(coded, answers).mapPartitions(run), _FOLDED, verifySchema=False)


class Bigrams:
    """One partition's bigrams, folded over all texts."""

    def __init__(self, blobs: list[bytes]):
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        while blobs:
            for column, values in zip(columns, unpack(blobs.pop(0))):
                column.append(values)
        sizes = np.array(columns[0], np.int64)
        self.rows, self.posts = sizes[:, 0].tolist(), [len(d) for d in columns[5]]
        ahead, h, k, w, m, self.place, times = (np.concatenate(c) for c in columns)
        del columns
        self.times = times.astype(np.int32) + 1
        self.held_in = m.astype(np.int32) + 1
        trained = np.where(self.place < np.repeat(sizes[:, 1], self.posts), self.times, 0)
        trained = np.add.reduceat(trained, np.cumsum(self.held_in, dtype=np.int64) - self.held_in, dtype=np.int64)
        h, w = np.repeat(h.astype(U), k), w.astype(U)
        order = np.lexsort((w, h))
        h, w = h[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
        self.kind = np.empty(len(h), np.int32 if len(h) < 1 << 31 else np.int64)  # of each packed row, its bigram
        self.kind[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
        self.context, self.lower_count = h[first], (w[first] >> U(32)).astype(np.int64)
        self.count = np.add.reduceat(trained[order], first)
        self.begin = np.flatnonzero(np.concatenate([[True], self.context[1:] != self.context[:-1]]))

    def sums(self, unigrams: Unigrams) -> np.ndarray:
        """For each context: bigrams seen 1..LARGE times, tokens of those seen more often, and mass of
        the seen words below."""
        seen = self.count > 0
        columns = [(self.count == r).astype(float) for r in range(1, LARGE + 1)]
        columns += [np.where(self.count > LARGE, self.count, 0), np.where(seen, unigrams.probability(self.lower_count), 0)]
        return np.stack([np.add.reduceat(c, self.begin) for c in columns], axis=1)


def context_weights(sums: np.ndarray, total: np.ndarray, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scale of the seen, backoff weight) of contexts, from ``Bigrams.sums`` and their tokens."""
    r = np.arange(1, LARGE + 1)
    kept = (sums[:, :LARGE] @ (factor[1 : LARGE + 1] * r) + sums[:, LARGE]) / total
    full = kept > 1 - 1e-12
    scale = np.where(full, total / (total + 0.5), 1.0)
    left = np.where(full, 1 - scale, 1 - kept)
    return scale, left / np.maximum(1 - sums[:, LARGE + 1], 1e-300)


def _parts(rows: Iterator) -> Iterator[tuple[list[int], list[bytes]]]:
    """The bigram rows of shuffle partitions, one ``p`` at a time: pieces and blobs."""
    for _, group in groupby((r for r in rows if not r.docs), lambda r: r.p):
        pieces_, blobs = [], []
        for r in group:
            pieces_.append(r.piece)
            blobs.append(bytes(r.blob))
        yield pieces_, blobs
        trim()


def _first_reading(rows: Iterator, unigrams: Unigrams, most: int) -> Iterator[tuple[int | None, list[float]]]:
    """(context, sums): bigrams by count (context None), and partial sums of contexts that are spread."""
    n, held = np.zeros(LARGE + 1), {}
    for _, blobs in _parts(rows):
        b = None  # the one before goes first
        b = Bigrams(blobs)
        n += np.bincount(np.minimum(b.count, LARGE + 2), minlength=LARGE + 3)[1 : LARGE + 2]
        contexts = b.context[b.begin]
        spread = np.flatnonzero(contexts >> U(32) >= most)
        if len(spread):
            sums = b.sums(unigrams)
            for i in spread.tolist():
                held[int(contexts[i])] = held.get(int(contexts[i]), 0) + sums[i]
    yield None, n.tolist()
    yield from ((k, v.tolist()) for k, v in held.items())


def _second_reading(rows: Iterator, unigrams: Unigrams, factor: np.ndarray, spread: dict[int, np.ndarray]) -> Iterator[tuple[int, bool, bytes]]:
    """(piece, docs, blob): what the bigrams of this task's partitions add to the piece's documents (packed
    doubles by place), and the documents themselves."""
    wide = np.array(sorted(spread), U)
    held: dict[int, np.ndarray] = {}
    passed: list[tuple[int, bool, bytes]] = []

    def others() -> Iterator:
        for r in rows:
            if r.docs:
                passed.append((r.piece, True, bytes(r.blob)))
            else:
                yield r

    for pieces_, blobs in _parts(others()):
        yield from passed
        passed.clear()
        b = None  # the one before goes first
        b = Bigrams(blobs)
        sums, contexts = b.sums(unigrams), b.context[b.begin]
        for i in np.flatnonzero(np.isin(contexts, wide)).tolist():
            sums[i] = spread[int(contexts[i])]
        total = (contexts >> U(32)).astype(float)
        scale, weight = context_weights(sums, total, factor)
        of = np.repeat(np.arange(len(b.begin)), np.diff(np.append(b.begin, len(b.context))))
        with np.errstate(divide="ignore"):
            direct = np.log10(factor[np.minimum(b.count, LARGE + 1)] * b.count * scale[of] / total[of] / unigrams.probability(b.lower_count))
        values = np.repeat(np.where(b.count > 0, direct, np.log10(weight[of]))[b.kind], b.held_in) * b.times
        at = 0
        for piece, n, posts in zip(pieces_, b.rows, b.posts):
            found = np.bincount(b.place[at : at + posts], values[at : at + posts], n)
            at += posts
            if piece in held:
                held[piece] += found
            else:
                held[piece] = found
    yield from passed
    yield from ((piece, False, pack_sums(values)) for piece, values in held.items())


def _gathered(parts: DataFrame, tokens: int) -> DataFrame:
    """Documents' rows from their pieces' packed sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches, ["piece"]):
            of, blobs = group["docs"].to_pylist(), group["blob"].to_pylist()
            ids, valid, held, n, known, base, lower = unpack_documents(blobs[of.index(True)])
            score = lower.copy()
            for docs, blob in zip(of, blobs):
                if not docs:
                    add_sums(score, blob)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, mask=~valid), pa.array(held), pa.array(n), pa.array(known), pa.array(np.full(len(n), tokens, np.int64)), pa.array(base), pa.array(score)],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return parts.repartition("piece").sortWithinPartitions("piece", "blob").mapInArrow(run, schema)


def score(documents: DataFrame, held: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row; the model
    learns from the rows where ``held`` is false."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held, F.lit(False)).alias("held"))
    coded = cut(_coded(texts))
    count, training, kinds = (x or 0 for x in coded.agg(F.count("*"), F.sum("training"), F.sum("kinds")).first())
    answers = cut(_answers(coded, max(1, -(-kinds // max(VOCABULARY, LEAST_KINDS)))))
    unigrams = _summary(answers)
    if not count:
        return _gathered(documents.sparkSession.createDataFrame([], _SUMS), 0)
    parts, most = max(1, -(-unigrams.tokens // PART_TOKENS)), max(1, PART_TOKENS // 4)
    table_of = _folded(coded, answers, unigrams, training, parts, most).repartitionById(parts, F.col("p")).rdd
    n, sums = np.zeros(LARGE + 2), {}
    for context, values in table_of.mapPartitions(lambda rows: _first_reading(rows, unigrams, most)).collect():
        if context is None:  # a row for each partition, and one for each spread context in it
            n[1:] += values
        else:
            sums[context] = sums.get(context, 0) + np.array(values)
    factor = discounts(n)
    second = table_of.coalesce(READERS).mapPartitions(lambda rows: _second_reading(rows, unigrams, factor, sums))
    found = documents.sparkSession.createDataFrame(second, _SUMS, verifySchema=False)
    return _gathered(found, unigrams.tokens)
