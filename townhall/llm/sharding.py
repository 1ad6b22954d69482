"""Sharding by fixed virtual slots.

Every record hashes to one of ``SLOTS`` virtual slots. Bytes and rows are summed per slot (a
table of ``SLOTS`` rows whatever the corpus holds), and a versioned map says which shard each slot
belongs to. Rebalancing edits the map; records never rehash. The map is the only thing that is
collected or broadcast.

Documents are dealt by id and text together, so rows that share an id (or have none) spread like any
others. Equal texts under different ids may go to different shards: the law is near equal bytes, and
nothing keeps copies together. Only rows equal in both share a slot.

Nulls: a null text counts as empty, a null id hashes like any other value. Empty tables give an
empty result. Texts are measured whole, however long. Input columns other than the ones named are not
read, so their names may clash with the result's.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import new_folder

SLOTS = 4096


def slot_of(*key: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(slots)).cast("int")


@dataclass
class SlotMap:
    """Which shard owns each slot. Each edit gives a map of the next version."""

    shards: int
    owner: list[int]
    weight: list[int] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)
    version: int = 1

    @classmethod
    def even(cls, shards: int, slots: int = SLOTS) -> SlotMap:
        return cls(shards, [s % shards for s in range(slots)], [0] * slots, [0] * slots)

    def measured(self, sums: Iterable[tuple[int, int, int]]) -> SlotMap:
        """The same owners with (slot, bytes, rows) filled in."""
        weight, rows = [0] * len(self.owner), [0] * len(self.owner)
        for slot, size, n in sums:
            weight[slot], rows[slot] = size, n
        return SlotMap(self.shards, list(self.owner), weight, rows, self.version)

    def loads(self) -> list[int]:
        out = [0] * self.shards
        for slot, shard in enumerate(self.owner):
            out[shard] += self.weight[slot]
        return out

    def rebalanced(self) -> SlotMap:
        """Next version: shards above the mean give up their heaviest slots that fit the excess,
        which go, heaviest first, to the lightest shard."""
        owner, load = list(self.owner), self.loads()
        mean = sum(load) / self.shards
        freed = []
        for slot in sorted(range(len(owner)), key=lambda s: (-self.weight[s], s)):
            shard = owner[slot]
            if self.weight[slot] and load[shard] > mean:
                freed.append(slot)
                load[shard] -= self.weight[slot]
        heap = [(size, shard) for shard, size in enumerate(load)]
        heapq.heapify(heap)
        for slot in freed:
            size, shard = heapq.heappop(heap)
            owner[slot] = shard
            heapq.heappush(heap, (size + self.weight[slot], shard))
        return SlotMap(self.shards, owner, self.weight, self.rows, self.version + 1)

    def grown(self) -> SlotMap:
        """Next version with one shard more, which alone receives slots, up to the new mean."""
        owner, load = list(self.owner), [*self.loads(), 0]
        mean = sum(load) / (self.shards + 1)
        for slot in sorted(range(len(owner)), key=lambda s: (-self.weight[s], s)):
            shard, w = owner[slot], self.weight[slot]
            if w and load[shard] - w >= mean * 0.98 and load[-1] + w <= mean * 1.02:
                owner[slot] = self.shards
                load[shard] -= w
                load[-1] += w
        return SlotMap(self.shards + 1, owner, self.weight, self.rows, self.version + 1)

    def frame(self, spark: SparkSession) -> DataFrame:
        """version, vslot, shard, bytes, rows, and ``base``: rows of the shard's earlier slots."""
        base, seen = [], [0] * self.shards
        for slot, shard in enumerate(self.owner):
            base.append(seen[shard])
            seen[shard] += self.rows[slot] if self.rows else 0
        rows = [(self.version, s, self.owner[s], self.weight[s], self.rows[s], base[s]) for s in range(len(self.owner))]
        return spark.createDataFrame(rows, "version int, vslot int, shard int, bytes long, rows long, base long")

    def save(self, spark: SparkSession, path: str) -> None:
        """Add this version to the map's history at ``path``."""
        self.frame(spark).coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={self.version}")

    @classmethod
    def load(cls, spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = sorted(spark.read.parquet(f"{path}/version={version}").select("vslot", "shard", "bytes", "rows").collect())
        return cls(1 + max(r[1] for r in rows), [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], version)


def slot_sums(records: DataFrame, key: list[str], size: str, slots: int = SLOTS) -> list[tuple[int, int, int]]:
    """(slot, bytes, rows) for every slot in use: at most ``slots`` rows come to the driver."""
    sums = records.groupBy(slot_of(*[F.col(c) for c in key], slots=slots).alias("vslot")).agg(F.sum(size).alias("bytes"), F.count("*").alias("rows"))
    return [tuple(r) for r in sums.collect()]


def place(records: DataFrame, key: list[str], slot_map: SlotMap) -> DataFrame:
    """``records`` with shard and slot: the record's place in its shard, gapless from 0.

    Places are counted within virtual slots and shifted by the map's row counts, so no task
    holds a shard. Equal keys are told apart by the other columns.
    """
    slots = len(slot_map.owner)
    owners = slot_map.frame(records.sparkSession).select("vslot", "shard", "base")
    inside = Window.partitionBy("vslot").orderBy(*[F.col(c) for c in records.columns])
    keyed = records.withColumn("vslot", slot_of(*[F.col(c) for c in key], slots=slots))
    ranked = keyed.withColumn("place", F.row_number().over(inside))
    return ranked.join(F.broadcast(owners), "vslot").withColumn("slot", F.col("base") + F.col("place") - 1).drop("base", "place", "vslot")


def shard_documents(documents: DataFrame, shards: int = 16, maps: str | None = None) -> DataFrame:
    """Shards of near equal bytes: doc_id, size, text_crc32, law, shard, slot, grown_shard, map_version.

    The slot map's versions, the even one and the rebalanced one, are stored at ``maps``, by default
    in a folder of their own beside the checkpoints; the placement is read from what was stored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    records = documents.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    spark, key = documents.sparkSession, ["doc_id", "text_crc32"]
    maps = maps or new_folder(spark, "slot-map")
    first = SlotMap.even(shards).measured(slot_sums(records, key, "size"))
    for version in (first, first.rebalanced()):
        version.save(spark, maps)
    slot_map = SlotMap.load(spark, maps, first.version + 1)
    placed = place(records, key, slot_map)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"),
        F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
        F.lit(slot_map.version).alias("map_version"),
    )
