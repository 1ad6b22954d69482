"""Substring dedup over compressed FM-indexes.

Repeated passages are found window by window (``LENGTH`` consecutive words of one document):

1. Each window names an anchor: of its 25-word runs the one of least hash. Consecutive windows with
   one anchor form a fragment. Anchors that documents of different texts share are live; equal
   whole texts are compared by digest instead.
2. Fragments at live anchors are dealt to shards by their anchor, so equal windows always meet, and
   equal fragments are folded into one with the smallest id. A fixed-size Bloom filter (bounded by
   ``FILTER_BITS``) spares shuffling the others; beyond its capacity every text is joined with the
   list of its own live anchors, so that texts are shuffled once and other fragments not at all.
3. A shard's fragments become one FM-index: suffixes sorted to window depth, their BWT in a wavelet
   matrix with rank counts in two steps; the suffixes' order is dropped. Fragments then stream through it: backward search keeps each one's
   interval, cut back to 49 words after each full match, and reports the interval of every window.
   The least document of an interval decides. Anchors with more fragments than ``BLOCK`` are
   spread over blocks, and every pair of blocks is a shard, so no shard's size follows one anchor.
4. Words covered by a window that also starts in a smaller document go.

Nulls: a null text has no words. Rows with a null id lose nothing and make nothing be removed.
Repeated ids are told apart by their text. Empty tables give empty results; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U, cut, gram_hashes, join_hubs, pieces, text_hashes

LENGTH, GRAM = 50, 25
#: Fragments of an anchor beyond which it is spread over blocks; words a shard should hold.
BLOCK, SHARD_WORDS = 8192, 1_000_000
#: Spread anchors (16 bytes each) up to which they are broadcast to the fragments.
HEAVY = 1 << 17
#: The Bloom filter's largest size (16 MB), and bits a member should have.
FILTER_BITS, MEMBER_BITS = 1 << 27, 16
WORD_BYTES = 5
_SHIFTS = (0, 32)
_PLACE = U((1 << 28) - 1)


# ---- the index -------------------------------------------------------------------------------------


class WaveletMatrix:
    """Ranks of symbols in a sequence, level by level over their bits.

    A level takes a bit for each symbol and a quarter of a bit for counts of ones: 16 bits before each
    block of 64, within its run of ``1 << RUN`` blocks, and one full count for each run.
    """

    RUN = 10

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.levels = []
        n = len(sequence)
        seq = sequence
        for level in range(max(1, int(symbols - 1).bit_length()) - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            packed = np.zeros((n // 64 + 1) * 8, np.uint8)
            packed[: (n + 7) // 8] = np.packbits(bit, bitorder="little")
            blocks = packed.view("<u8")
            before = np.cumsum(np.bitwise_count(blocks), dtype=np.int64)
            before = np.append(0, before[:-1])
            runs = before[:: 1 << self.RUN]
            inner = (before - np.repeat(runs, 1 << self.RUN)[: len(before)]).astype(np.uint16)
            self.levels.append((level, blocks, runs, inner, n - int(bit.sum())))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position ``at`` of the sequence falls among the symbols, after all levels."""
        for level, blocks, runs, inner, zeros in self.levels:
            block = at >> 6
            below = (U(1) << (at & 63).astype(U)) - U(1)
            ones = runs[block >> self.RUN] + inner[block] + np.bitwise_count(blocks[block] & below)
            at = np.where(symbol >> level & 1, zeros + ones, at - ones)
        return at

    @property
    def nbytes(self) -> int:
        return sum(part.nbytes for _, *parts, _ in self.levels for part in parts)


class FMIndex:
    """An FM-index over texts of symbols, sorted to a depth of ``length``.

    ``texts``: arrays of hashes; they are indexed one after the other with separators between. Neither
    the symbols nor the suffixes' order are kept. What is: the wavelet matrix, the symbols' hashes and
    bases, each suffix's text at the least width, and the runs of suffixes that agree on
    ``length - 1`` symbols, where more than one does.
    """

    def __init__(self, texts: list[np.ndarray], length: int = LENGTH):
        self.length = length
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes + 1) - (sizes + 1)
        n = int((sizes + 1).sum())
        self.names, inverse = np.unique(np.concatenate(texts), return_inverse=True)
        seq = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[starts + sizes] = False
        seq[inside] = inverse + 1
        self.n, self.symbols = n, len(self.names) + 1

        rank, depth = seq, 1
        while depth * 2 < length:
            rank = self._paired(rank, depth)
            depth *= 2
        key = self._key(rank, length - depth)
        order = np.argsort(key, kind="stable")
        ordered = self._key(rank, length - 1 - depth)[order]
        change = np.append(np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])), n)
        several = np.flatnonzero(np.diff(change) > 1)
        width = np.min_scalar_type(n)
        self.opens, self.closes = change[several].astype(width), change[several + 1].astype(width)
        before = np.append(0, np.cumsum(np.bincount(seq, minlength=self.symbols)))[:-1]
        self.tree = WaveletMatrix(seq[order - 1], self.symbols)
        every = np.arange(self.symbols)
        self.base = before - self.tree.descend(every, np.zeros(self.symbols, np.int64))
        self.text_of = np.repeat(np.arange(len(texts), dtype=np.min_scalar_type(len(texts))), sizes + 1)[order]

    @staticmethod
    def _key(rank: np.ndarray, step: int) -> np.ndarray:
        later = np.zeros_like(rank)
        if step < len(rank):
            later[: len(rank) - step] = rank[step:]
        return rank * (int(rank.max()) + 1) + later

    def _paired(self, rank: np.ndarray, step: int) -> np.ndarray:
        return np.unique(self._key(rank, step), return_inverse=True)[1].astype(np.int64)

    @property
    def nbytes(self) -> int:
        return self.tree.nbytes + sum(x.nbytes for x in (self.names, self.base, self.text_of, self.opens, self.closes))

    def shortened(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The intervals of the first ``length - 1`` symbols of the suffixes at ``lo``."""
        if not len(self.opens):
            return lo, lo + 1
        run = np.maximum(np.searchsorted(self.opens, lo.astype(self.opens.dtype), side="right") - 1, 0)
        opens, closes = self.opens[run].astype(np.int64), self.closes[run].astype(np.int64)
        inside = (opens <= lo) & (lo < closes)
        return np.where(inside, opens, lo), np.where(inside, closes, lo + 1)

    def symbols_of(self, hashes: np.ndarray) -> np.ndarray:
        """Symbols of hashes; 0, which no text holds, for unknown ones."""
        at = np.minimum(np.searchsorted(self.names, hashes), len(self.names) - 1)
        return np.where(self.names[at] == hashes, at + 1, 0)

    def windows(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows of the texts that occur in the index: text, start, and interval [lo, hi)."""
        sizes = np.array([len(t) for t in texts])
        begin = np.cumsum(sizes) - sizes
        flat = self.symbols_of(np.concatenate(texts))
        lane = np.flatnonzero(sizes >= self.length)
        place = sizes[lane] - 1
        lo, hi, held = np.zeros(len(lane), np.int64), np.full(len(lane), self.n, np.int64), np.zeros(len(lane), np.int64)
        found: list[tuple[np.ndarray, ...]] = []
        while len(lane):
            symbol = flat[begin[lane] + place]
            ends = self.tree.descend(np.concatenate([symbol, symbol]), np.concatenate([lo, hi])) + np.concatenate([self.base[symbol]] * 2)
            lo, hi = ends[: len(lane)], ends[len(lane) :]
            held += 1
            lost = (hi <= lo) | (symbol == 0)
            full = ~lost & (held == self.length)
            if full.any():
                found.append((lane[full], place[full], lo[full], hi[full]))
                lo[full], hi[full] = self.shortened(lo[full])
                held[full] = self.length - 1
            # What was lost occurs nowhere: start anew with the run that ends before its last symbol.
            place = np.where(lost, place + held - 2, place - 1)
            if lost.any():
                lo[lost], hi[lost], held[lost] = 0, self.n, 0
            # A lane ends once the window that it would complete next starts before its text.
            alive = place - (self.length - 1 - held) >= 0
            lane, place, lo, hi, held = lane[alive], place[alive], lo[alive], hi[alive], held[alive]
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *parts]) for parts in zip(*found)) if found else (none, none, none, none)

    def least(self, lo: np.ndarray, hi: np.ndarray, value: np.ndarray) -> np.ndarray:
        """The least ``value`` (one for each indexed text) over each interval; equal ones once."""
        if not len(lo):
            return np.zeros(0, value.dtype)
        _, one, back = np.unique(lo, return_index=True, return_inverse=True)
        a, b = lo[one], hi[one]
        rows = np.append(value[self.text_of], value[:1])
        ends = np.stack([a, b], axis=1).reshape(-1)
        return np.minimum.reduceat(rows, ends)[::2][back]


def pack(h: np.ndarray) -> bytes:
    """Word hashes at 40 bits each: fragments are only compared where a 64-bit anchor agrees."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES].tobytes()


def unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // WORD_BYTES, 8), np.uint8)
    out[:, :WORD_BYTES] = np.frombuffer(packed, np.uint8).reshape(-1, WORD_BYTES)
    return out.view("<u8").reshape(-1)


# ---- fragments -------------------------------------------------------------------------------------


def fragments(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents as word hashes: each fragment's document, first and last window, and anchor."""
    g = gram_hashes(h, GRAM)
    n = len(h) - LENGTH + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none
    low = (g & ~_PLACE) | np.arange(len(g), dtype=U)
    width, span = LENGTH - GRAM + 1, 1
    while span * 2 <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: n], low[width - span : width - span + n])
    at = (low[:n] & _PLACE).astype(np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = doc[:n] == doc[LENGTH - 1 : LENGTH - 1 + n]
    start = np.flatnonzero(whole)
    if not len(start):
        return none, none, none, none
    at, doc = at[start], doc[start]
    new = np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(start)) - 1
    return doc[a], start[a] - first[doc[a]], start[b] - first[doc[a]], g[at[a]].view(np.int64)


def _scan(documents: DataFrame) -> DataFrame:
    """doc_id, h, n_words, digest, kept (hash of the words joined by a space), anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            h, first = text_hashes(batch.column("text"), fold=False)
            doc, _, _, anchor = fragments(h, first)
            ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            texts = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("h"), pa.array(np.diff(first), pa.int64()),
                    pa.array([hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first, first[1:])], pa.binary()),
                    pa.array([hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in texts]),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(anchor)),
                ],
                ["doc_id", "h", "n_words", "digest", "kept", "anchors"],
            )

    return documents.mapInArrow(run, "doc_id long, h long, n_words long, digest binary, kept string, anchors array<long>")


def member_filter(members: DataFrame, column: str) -> np.ndarray | None:
    """A Bloom filter of a long column, two bits a member; None past the size it is good for."""
    count = members.count()
    bits = 1 << max(10, (count * MEMBER_BITS - 1).bit_length())
    if bits > FILTER_BITS * 2:
        return None
    bits = min(bits, FILTER_BITS)
    h = F.col(column)
    places = F.array(*[F.pmod(F.shiftright(h, s), F.lit(bits)) for s in _SHIFTS])
    words = members.select(F.explode(places).alias("p")).groupBy((F.col("p") / 64).cast("int").alias("w"))
    filled = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w, b = (batch.column(c).to_numpy().tobytes() for c in "wb")
            yield pa.RecordBatch.from_arrays([pa.array([w], pa.binary()), pa.array([b], pa.binary())], ["w", "b"])

    table = np.zeros(bits // 64, np.int64)
    for w, b in filled.mapInArrow(run, "w binary, b binary").collect():
        table[np.frombuffer(w, np.int32)] = np.frombuffer(b, np.int64)
    return table


def _with_lists(texts: DataFrame, rows: DataFrame, live: DataFrame) -> DataFrame:
    """``texts`` that hold live anchors, with them as ``live``: one list for each text hash ``h``."""
    named = rows.filter("doc_id IS NOT NULL")
    pairs = named.select("h", F.explode("anchors").alias("anchor")).distinct()
    lists = pairs.join(live, "anchor").groupBy("h").agg(F.collect_list("anchor").alias("live"))
    held = named.groupBy("h").agg(F.count("*").alias("held"))
    return join_hubs(texts, cut(lists.join(held, "h")), "h", named.count()).filter("live IS NOT NULL")


def in_filter(table: np.ndarray | None, values: np.ndarray) -> np.ndarray:
    """Which longs may be members."""
    if table is None:
        return np.ones(len(values), bool)
    out = np.ones(len(values), bool)
    for s in _SHIFTS:
        p = (values >> s) & np.int64(len(table) * 64 - 1)
        out &= (table[p >> 6] >> (p & 63) & 1).astype(bool)
    return out


def _pieces_at(documents: DataFrame, live: np.ndarray | None) -> DataFrame:
    """doc_id, text (its digest), anchor, fragment (digest), first (window), words (hashes).

    ``live``: a filter of the live anchors; without one each document brings its own as a list.
    """
    sent = documents.sparkSession.sparkContext.broadcast(live)

    def listed(batch: pa.RecordBatch, doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        ends = np.searchsorted(doc, np.arange(batch.num_rows + 1)).tolist()
        lists = [np.asarray(one, np.int64) for one in batch.column("live").to_pylist()]
        return np.concatenate([np.zeros(0, bool), *[np.isin(anchor[a:b], one) for a, b, one in zip(ends, ends[1:], lists)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[bytes] = set()
        for batch in pieces(batches, "text"):
            h, first = text_hashes(batch.column("text"), fold=False)
            doc, a, b, anchor = fragments(h, first)
            may = listed(batch, doc, anchor) if sent.value is None else in_filter(sent.value, anchor)
            doc, a, b, anchor = doc[may], a[may], b[may], anchor[may]
            runs = [h[first[d] + x : first[d] + y + LENGTH] for d, x, y in zip(doc, a, b)]
            digests = [hashlib.blake2b(r.tobytes(), digest_size=16).digest() for r in runs]
            rows: list[bytes | None] = [pack(r) for r in runs]
            for i, d in enumerate(digests):  # a task sends the words of equal fragments once
                if d in known:
                    rows[i] = None
                elif len(known) < 1 << 18:
                    known.add(d)
            whole = {d: hashlib.blake2b(h[first[d] : first[d + 1]].tobytes(), digest_size=16).digest() for d in set(doc.tolist())}
            ids = batch.column("doc_id").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array([whole[d] for d in doc.tolist()], pa.binary()), pa.array(anchor), pa.array(digests, pa.binary()), pa.array(a), pa.array(rows, pa.binary())],
                ["doc_id", "digest", "anchor", "fragment", "first", "words"],
            )

    return documents.mapInArrow(run, "doc_id long, digest binary, anchor long, fragment binary, first long, words binary")


def _shards(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows sorted by anchor and blocks, as tables of whole groups with about ``limit`` words."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("anchor", "i", "j")], axis=1)
        new = np.concatenate([[last is not None and (keys[0] != last).any()], (keys[1:] != keys[:-1]).any(1)])
        total = np.concatenate([[0], np.cumsum([len(w) // WORD_BYTES for w in batch.column("words").to_pylist()])])
        start = 0
        for at in np.flatnonzero(new).tolist():
            if size + total[at] - total[start] >= limit:
                yield pa.Table.from_batches([*held, batch.slice(start, at - start)])
                held, size, start = [], 0, at
        held.append(batch.slice(start))
        size += int(total[-1] - total[start])
        last = keys[-1]
    if held:
        yield pa.Table.from_batches(held)


def _least_documents(shards: DataFrame) -> DataFrame:
    """fragment, least: of each window of a fragment the least document of the shard that holds it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, SHARD_WORDS):
            texts = [unpack(w) for w in shard["words"].to_pylist()]
            index = FMIndex(texts)
            text, start, lo, hi = index.windows(texts)
            low = index.least(lo, hi, shard["doc"].to_numpy())[np.lexsort((start, text))]
            ends = np.searchsorted(np.sort(text), np.arange(len(texts) + 1))
            least = [low[x:y].tobytes() for x, y in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays([shard["fragment"].combine_chunks(), pa.array(least, pa.binary())], ["fragment", "least"])

    return shards.mapInArrow(run, "fragment binary, least binary")


def repeats(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, marks): what ``_scan`` says of each document; (doc_id, digest, first, least) of fragments.

    ``least`` packs, for the windows from ``first`` on, the least document they start in, for
    windows that documents of different texts may share.
    """
    narrow = documents.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    rows = cut(_scan(narrow))
    anchors = rows.filter("doc_id IS NOT NULL").select(F.explode(F.array_distinct("anchors")).alias("anchor"), F.xxhash64("digest").alias("d"))
    live = cut(anchors.groupBy("anchor").agg(F.min("d").alias("a"), F.max("d").alias("b")).filter("a <> b").select("anchor"))
    texts, members = narrow.filter("doc_id IS NOT NULL"), member_filter(live, "anchor")
    texts = _with_lists(texts, rows, live) if members is None else texts
    cuts = cut(_pieces_at(texts, members).join(live, "anchor", "left_semi"))
    folded = cut(cuts.groupBy("anchor", "fragment").agg(F.min("doc_id").alias("doc"), F.first("words", ignorenulls=True).alias("words")))
    heavy = cut(folded.groupBy("anchor").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")).filter("blocks > 1"))
    heavy = F.broadcast(heavy) if heavy.count() <= HEAVY else heavy
    placed = folded.join(heavy, "anchor", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    placed = placed.withColumn("own", F.pmod(F.xxhash64("fragment"), F.col("blocks")).cast("int"))
    dealt = placed.withColumn("x", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    dealt = dealt.select("anchor", "fragment", "doc", "words", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"))
    least = _least_documents(dealt.repartition("anchor", "i", "j").sortWithinPartitions("anchor", "i", "j"))
    marks = cuts.select("doc_id", "digest", "fragment", "first").join(cut(least), "fragment").select("doc_id", "digest", "first", "least")
    return rows, marks


def _covered(marks: DataFrame) -> DataFrame:
    """doc_id, digest, spans: packed [start, end) pairs of windows that also start in a smaller document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, first = batch.column("doc_id").to_numpy(), batch.column("first").to_numpy()
            spans = []
            for d, f, packed in zip(ids, first, batch.column("least").to_pylist()):
                hit = np.flatnonzero(np.frombuffer(packed, np.int64) < d)
                if not len(hit):
                    spans.append(None)
                    continue
                edge = np.flatnonzero(np.diff(hit) > 1)
                a, b = hit[np.append(0, edge + 1)], hit[np.append(edge, len(hit) - 1)]
                spans.append(np.stack([a + f, b + f + LENGTH], axis=1).astype(np.int64).tobytes())
            keep = pa.array([s is not None for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(spans, pa.binary())], ["doc_id", "digest", "spans"]).filter(keep)

    return marks.mapInArrow(run, "doc_id long, digest binary, spans binary")


def _apply(documents: DataFrame, spans: DataFrame) -> DataFrame:
    """doc_id, digest, n_removed, cleaned: documents that lose words, with the words they keep."""
    sent = documents.sparkSession.sparkContext.broadcast(member_filter(spans.select(F.xxhash64("doc_id").alias("h")).distinct(), "h"))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            batch = batch.filter(pa.array(in_filter(sent.value, batch.column("h").to_numpy())))
            h, first = text_hashes(batch.column("text"), fold=False)
            digests = [hashlib.blake2b(h[a:b].tobytes(), digest_size=16).digest() for a, b in zip(first, first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), batch.column("text")], ["doc_id", "digest", "text"])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            removed, kept = [], []
            for text, lists in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist()):
                split = text.encode().split()
                change = np.zeros(len(split) + 1, np.int64)
                for packed in lists:
                    pairs = np.frombuffer(packed, np.int64).reshape(-1, 2)
                    np.add.at(change, pairs[:, 0], 1)
                    np.add.at(change, pairs[:, 1], -1)
                stays = np.cumsum(change[:-1]) == 0
                removed.append(len(split) - int(stays.sum()))
                kept.append(b" ".join([w for w, s in zip(split, stays.tolist()) if s]).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(removed, pa.int64()), pa.array(kept)], ["doc_id", "digest", "n_removed", "cleaned"])

    some = documents.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.col("doc_id").cast("long")).alias("h"))
    some = some.mapInArrow(texts, "doc_id long, digest binary, text string")
    lists = spans.groupBy("doc_id", "digest").agg(F.collect_list("spans").alias("spans"))
    both = some.join(lists, ["doc_id", "digest"])
    done = both.mapInArrow(clean, "doc_id long, digest binary, n_removed long, cleaned string")
    return done.dropDuplicates(["doc_id", "digest"])


def remove_repeats(documents: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, one row for each row of ``documents``."""
    rows, marks = repeats(documents)
    copies = rows.filter("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("least"))
    done = _apply(documents, cut(_covered(marks))).select("doc_id", "digest", "n_removed", F.sha2("cleaned", 256).alias("cleaned"))
    out = rows.select("doc_id", "n_words", "digest", "kept").join(copies, "digest", "left").join(done, ["doc_id", "digest"], "left")
    copied = (F.col("least") < F.col("doc_id")) & (F.col("n_words") >= LENGTH)
    return out.select(
        "doc_id", "n_words",
        F.when(copied, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copied, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("cleaned", "kept")).alias("kept_sha256"),
    )
