"""Katz models of any order as stored tables, for texts other than the ones they were trained on.

``train`` writes a model to a folder, ``score`` evaluates texts against one. The model is the one of
``katz`` (Good-Turing discounts up to ``LARGE``, backoff weights that make each context add up to 1,
half a count where discounts leave nothing), at any order, as three tables partitioned by order:

* ``counts``: order, gram, context, tail, n. A gram is a 64-bit hash of its tokens; its context is
  the gram without its last token, its tail the one without its first. Both are 0 at order 1.
* ``grams``: order, gram, n, log_p: the discounted log10 probability of the last token.
* ``contexts``: order, context, total, log_weight. The one context of order 1 weighs the unknown word.

Scoring is recursive: a token whose gram is stored has its log_p; any other adds its context's weight
(0 where the context is not stored) and is looked up by its tail. Every level is one join of the
tokens that are still open, folded by text and gram, with a table of its order; what all tokens of a
frequent gram would bring to one task is joined by broadcast (``join_hubs``).

Nothing but sums over an order comes to the driver. Words are lower-cased (A-Z), texts end with an end
token, and begin after ``order`` - 1 start tokens. Null and empty texts are the end token alone.
Equal texts are scored once. Without training texts every score is 0. Repeated ids are scored row by
row; other columns are not read. A folder that already exists is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U, cut, gram_hashes, join_hubs, pieces, text_hashes
from .katz import END, FOLD_BYTES, LARGE, START, discounts

ORDER = 3

_COUNTS = "order int, gram long, context long, tail long, n long"


def gram_ids(column: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Hashes of all runs of 0 to ``order`` tokens by their first place, the places of the tokens that
    are scored, and each row's number of them. The run of none is 0."""
    h, first = text_hashes(column, fold=True)
    rows, words, pad = np.arange(len(first) - 1), np.diff(first), order - 1
    ends = np.cumsum(words + 1 + pad) - 1
    tokens = np.full(len(h) + len(rows) * (1 + pad), START, U)
    tokens[ends] = END
    tokens[np.arange(len(h)) + np.repeat((rows + 1) * pad + rows, words)] = h
    at = np.arange(len(h) + len(rows)) + np.repeat((rows + 1) * pad, words + 1)
    runs = [np.zeros(len(tokens) + 1, U), *(gram_hashes(tokens, k) for k in range(1, order + 1))]
    return runs, at, words + 1


def _long(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def gram_counts(texts: DataFrame, order: int) -> DataFrame:
    """order, gram, context, tail, n over all texts, for every order up to ``order``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", FOLD_BYTES):
            runs, at, _ = gram_ids(batch.column("text"), order)
            for k in range(1, order + 1):
                gram, one, n = np.unique(runs[k][at - k + 1], return_index=True, return_counts=True)
                begin = at[one] - k + 1
                columns = [pa.array(np.full(len(gram), k, np.int32)), _long(gram), _long(runs[k - 1][begin]), _long(runs[k - 1][begin + 1]), pa.array(n)]
                yield pa.RecordBatch.from_arrays(columns, ["order", "gram", "context", "tail", "n"])

    return texts.select("text").mapInArrow(run, _COUNTS).groupBy("order", "gram").agg(F.min("context").alias("context"), F.min("tail").alias("tail"), F.sum("n").alias("n"))


def _kept(rows: DataFrame) -> tuple[Column, int]:
    """What discounts leave of a gram's count ``n``, and how many tokens there are."""
    row = rows.agg(F.sum("n"), *[F.count_if(F.col("n") == r) for r in range(1, LARGE + 2)]).first()
    factor = discounts(np.array([0, *row[1:]], float))
    by_count = F.array(*[F.lit(float(f)) for f in factor[1:]])
    return F.element_at(by_count, F.least("n", F.lit(LARGE + 1)).cast("int")) * F.col("n"), row[0] or 0


def _weights(rows: DataFrame, kept: Column) -> DataFrame:
    """context, total, scale of its seen grams, log_weight of the others."""
    sums = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(kept) / F.sum("n")).alias("kept"), F.sum("below").alias("below"))
    scale = F.when(F.col("kept") > 1 - 1e-12, F.col("total") / (F.col("total") + 0.5)).otherwise(F.lit(1.0))
    left = F.when(F.col("kept") > 1 - 1e-12, 0.5 / (F.col("total") + 0.5)).otherwise(1 - F.col("kept"))
    weight = F.log10(left / F.greatest(1 - F.col("below"), F.lit(1e-300)))
    return sums.select("context", "total", scale.alias("scale"), weight.alias("log_weight"))


def train(documents: DataFrame, path: str, order: int = ORDER) -> None:
    """Write the model of ``documents``' texts to the folder ``path``, which all executors share."""
    spark = documents.sparkSession
    gram_counts(documents, order).write.partitionBy("order").parquet(f"{path}/counts")
    counts = spark.read.schema(_COUNTS).parquet(f"{path}/counts")
    for k in range(1, order + 1):
        rows = counts.filter(F.col("order") == k).drop("order")
        kept, tokens = _kept(rows)
        if k == 1:
            rows = rows.withColumn("below", F.lit(0.0))
        else:  # a gram of the order below has at most as many rows here as it has tokens
            lower = spark.read.parquet(f"{path}/grams/order={k - 1}")
            named = lower.select(F.col("gram").alias("tail"), F.col("n").alias("held"), F.pow(F.lit(10.0), "log_p").alias("below"))
            rows = join_hubs(rows, named, "tail", tokens)
        _weights(rows, kept).write.parquet(f"{path}/contexts/order={k}")
        contexts = spark.read.parquet(f"{path}/contexts/order={k}").select("context", F.col("total").alias("held"), "total", "scale")
        of_all = join_hubs(rows, contexts, "context", tokens)
        of_all.select("gram", "n", F.log10(kept * F.col("scale") / F.col("total")).alias("log_p")).write.parquet(f"{path}/grams/order={k}")


def order_of(spark: SparkSession, path: str) -> int:
    """The order of a stored model."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/grams")
    names = [s.getPath().getName() for s in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    return max(int(n.removeprefix("order=")) for n in names if n.startswith("order="))


def _postings(texts: DataFrame, order: int) -> DataFrame:
    """id, times, and g1.. and c1.., the grams and contexts of every order, once for each gram of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            runs, at, n = gram_ids(batch.column("text"), order)
            row, top = np.repeat(np.arange(len(n)), n), runs[order][at - order + 1]
            by = np.lexsort((top, row))
            new = np.flatnonzero(np.concatenate([[True], (top[by][1:] != top[by][:-1]) | (row[by][1:] != row[by][:-1])]))
            places, times = at[by[new]], np.diff(np.append(new, len(by)))
            ids = pa.array(batch.column("id").to_numpy()[row[by[new]]])
            grams = [_long(runs[k][places - k + 1]) for k in range(1, order + 1)]
            contexts = [_long(runs[k - 1][places - k + 1]) for k in range(1, order + 1)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(times), *grams, *contexts], names)

    names = ["id", "times", *(f"{c}{k}" for c in "gc" for k in range(1, order + 1))]
    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def score(documents: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, score (log10) of every row, under the model stored at ``path``."""
    spark = documents.sparkSession
    order = order_of(spark, path)
    keyed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    texts = cut(keyed.dropDuplicates(["key"]).select("key", "text").withColumn("id", F.monotonically_increasing_id()))
    rows = cut(_postings(texts.select("id", "text"), order).withColumn("passed", F.lit(0.0)))
    done = []
    for k in range(order, 0, -1):
        grams, contexts = (spark.read.parquet(f"{path}/{t}/order={k}") for t in ("grams", "contexts"))
        tokens = grams.agg(F.sum("n")).first()[0] or 0
        met = cut(join_hubs(rows, grams.select(F.col("gram").alias(f"g{k}"), F.col("n").alias("held"), "log_p"), f"g{k}", tokens))
        done.append(met.filter("log_p IS NOT NULL").select("id", "times", (F.col("passed") + F.col("log_p")).alias("value")))
        named = contexts.select(F.col("context").alias(f"c{k}"), F.col("total").alias("held"), "log_weight")
        weighed = join_hubs(met.filter("log_p IS NULL").drop("log_p"), named, f"c{k}", tokens)
        rows = cut(weighed.withColumn("passed", F.col("passed") + F.coalesce("log_weight", F.lit(0.0))).drop("log_weight"))
    values = rows.select("id", "times", F.col("passed").alias("value"))
    for part in done:
        values = values.unionByName(part)
    sums = values.groupBy("id").agg(F.sum("times").alias("n_tokens"), F.sum(F.col("times") * F.col("value")).alias("score"))
    copies = keyed.groupBy("key").agg(F.count("*").alias("held"))
    named = cut(texts.select("key", "id").join(sums, "id").join(copies, "key").drop("id"))
    return join_hubs(keyed.drop("text"), named, "key", documents.count()).select("doc_id", "n_tokens", "score")
