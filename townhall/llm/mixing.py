"""Mixing sources to target weights by systematic sampling, on DataFrame functions alone.

Each source gets a target number of words; the rate of a source is target / size. Within a source
the documents stand in a fixed order (size class, salt, size, id); the k-th has the expected copies
prefix sum k * rate, and is emitted once for each integer that prefix sum plus the source's one
random offset crosses. Standing by size, documents of like sizes are thinned evenly, so a source's
words come near its target.

A rank is the count of rows in earlier cells (source, class, salt), from a small table of counts,
plus the rank in the own cell. A cell is one sort group; ``salts`` bounds its share of a source.

Nulls: a null text has size 0 and is still a document; the null source is a source of its own and
comes last. Sources without words have target 0. Equal documents are separate rows, told apart by
id; rows equal in all of them are interchangeable. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut

#: Fixed values of the contract: weights by rank of the source, share of all words, cap.
WEIGHTS, SHARE, CAP = (5, 2, 1), 1.5, 2.0
SALTS = 256
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(text: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of an MD5, the same in any engine."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def size_class(size: Column) -> Column:
    """Two leading digits and the number of digits: an integer that grows with the size."""
    digits = F.length(size.cast("string"))
    return F.when(size < 100, size).otherwise(digits * 100 + F.substring(size.cast("string"), 1, 2).cast("int")).cast("int")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size -> target: shares by weight, none above ``cap`` times its source.

    Sources that reach their cap first (smallest cap / weight) are capped; the level of the rest
    follows from one running sum, which is what repeated resharing converges to. One row per
    source comes in, so the ordered windows are over the list of sources.
    """
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    valued = ranked.withColumn("weight", pick).withColumn("most", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    earlier, rest, whole = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    spare = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("most").over(earlier), F.lit(0.0))
    level = valued.withColumn("level", spare / F.sum("weight").over(rest)).withColumn("free", F.col("level") * F.col("weight") <= F.col("most"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("most") / F.col("weight"), F.col("rank"), F.col("level")))).over(whole)["level"]
    leveled = level.withColumn("common", first)
    return leveled.select("source", "source_size", F.coalesce(F.least(F.col("most"), F.col("common") * F.col("weight")), F.col("most")).alias("target"))


def copies(documents: DataFrame, seed: int = 17, salts: int = SALTS) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of ``documents``."""
    narrow = documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    salt = F.pmod(F.floor(unit_hash(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) * 1048576), F.lit(salts)).cast("int")
    sized = cut(narrow.withColumn("class", size_class(F.col("size"))).withColumn("salt", salt))
    cells = cut(sized.groupBy("source", "class", "salt").agg(F.count("*").alias("rows"), F.sum("size").alias("words")))
    goals = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")))
    before = Window.partitionBy("source").orderBy("class", "salt").rowsBetween(Window.unboundedPreceding, -1)
    based = cells.withColumn("base", F.coalesce(F.sum("rows").over(before), F.lit(0))).drop("rows", "words")
    planned = based.join(goals, based["source"].eqNullSafe(goals["source"]), "inner").drop(goals["source"])
    keyed = [sized[c].eqNullSafe(planned[c]) if c == "source" else sized[c] == planned[c] for c in ("source", "class", "salt")]
    joined = sized.join(planned, keyed[0] & keyed[1] & keyed[2]).select(sized["*"], "base", "source_size", "target")
    inside = Window.partitionBy("source", "class", "salt").orderBy("size", "doc_id")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = unit_hash(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("source"), F.lit("\x00"))))
    ranked = joined.withColumn("k", F.col("base") + F.row_number().over(inside)).withColumn("rate", rate).withColumn("offset", offset)
    crossed = F.floor(F.col("k") * F.col("rate") + F.col("offset")) - F.floor((F.col("k") - 1) * F.col("rate") + F.col("offset"))
    return ranked.select("doc_id", "source", "size", "source_size", "target", crossed.cast("long").alias("copies"))


def mix(documents: DataFrame, seed: int = 17) -> DataFrame:
    """The mixed documents themselves: every row as often as it is taken, with its own columns.

    Rows of one id, source and size are interchangeable: they are matched with their plans in turn.
    """
    key = ["id", "source", "size"]
    turn = F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0)))
    plan = copies(documents, seed).select(F.col("doc_id").alias("id"), "source", "size", "copies").withColumn("turn", turn).filter("copies > 0")
    plan = plan.toDF("of_id", "of_source", "of_size", "copies", "of_turn")
    row = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    rows = documents.select(row.alias("row"), F.col("doc_id").alias("id"), "source", word_count(F.col("text")).alias("size")).withColumn("turn", turn)
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in key] + [F.col("turn") == F.col("of_turn")]
    both = rows.join(plan, same[0] & same[1] & same[2] & same[3])
    return both.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
