"""The thin queries over the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, descent, katz, lines, mixing, passages, sharding, sketch, toxicity, vectors
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score(table(spark, sf_dir, "documents"), katz.held_out(F.col("doc_id")))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_and_decode(table(spark, sf_dir, "documents"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.clean_pages(table(spark, sf_dir, "pages"))
    return done.select("page_id", "host", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.copies(table(spark, sf_dir, "documents"))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return descent.walk_search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


OP1_SQL = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 3], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM t WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(d, m) AS (SELECT x, x FROM e UNION SELECT e.y, r.m FROM r JOIN e ON r.d = e.x),
c AS (SELECT d, min(m) AS m FROM r GROUP BY 1)
SELECT t.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(m, t.doc_id) AS component_id, coalesce(m, t.doc_id) = t.doc_id AS kept
FROM t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN c ON d = t.doc_id
"""

OP2_SQL = r"""
WITH t AS (
  SELECT doc_id,
    xor(list_reduce(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT),
      lambda crc, byte: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, xor(crc, byte)),
      4294967295::BIGINT), 4294967295) % 5 = 1 AS held_out,
    list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+'), ' ') AS words
  FROM documents),
x AS (SELECT doc_id, held_out, unnest(list_prepend(chr(9), words[1:len(words) - 1])) AS h, unnest(words) AS w FROM t),
u AS (SELECT w, count(*) AS c FROM x WHERE NOT held_out GROUP BY 1),
b AS (SELECT h, w, count(*) AS c FROM x WHERE NOT held_out GROUP BY 1, 2),
k AS (SELECT 1 AS level, c, count(*)::DOUBLE AS n FROM u GROUP BY 2 UNION ALL SELECT 2, c, count(*)::DOUBLE FROM b GROUP BY 2),
r AS (
  SELECT a.level, g.r, coalesce(max(n) FILTER (c = g.r), 0) AS n, coalesce(max(n) FILTER (c = g.r + 1), 0) AS more,
    CASE WHEN max(n) FILTER (c = 1) > 0 THEN 6 * coalesce(max(n) FILTER (c = 6), 0) / max(n) FILTER (c = 1) ELSE 1 END AS top
  FROM k a, (SELECT unnest(range(1, 6)) AS r) g GROUP BY 1, 2),
katz AS (SELECT *, CASE WHEN n > 0 AND more > 0 AND top < 1 THEN ((r + 1) * more / n / r - top) / (1 - top) ELSE 0 END AS d FROM r),
f AS (SELECT level, r, CASE WHEN d > 0 AND d < 1 THEN d ELSE 1 - 0.5::DOUBLE / r END AS f FROM katz),
n AS (SELECT sum(c)::BIGINT AS tokens, count(*) AS types FROM u),
u1 AS (SELECT w, c, coalesce(f, 1) * c / tokens AS p FROM u CROSS JOIN n LEFT JOIN f ON level = 1 AND r = c),
s1 AS (SELECT sum(p) AS seen, max(tokens) AS tokens FROM u1 CROSS JOIN n),
g1 AS (SELECT CASE WHEN seen > 1 - 1e-12 THEN tokens / (tokens + 0.5::DOUBLE) ELSE 1 END AS guard,
  CASE WHEN seen > 1 - 1e-12 THEN 0.5::DOUBLE / (tokens + 0.5::DOUBLE) ELSE 1 - seen END AS unknown FROM s1),
p1 AS (SELECT w, c, p * guard AS p FROM u1 CROSS JOIN g1),
h2 AS (SELECT h, sum(c)::BIGINT AS total FROM b GROUP BY 1),
b2 AS (SELECT b.h, b.w, coalesce(f, 1) * b.c / total AS p, total, p1.p AS below
  FROM b JOIN h2 ON h2.h = b.h JOIN p1 ON p1.w = b.w LEFT JOIN f ON level = 2 AND r = b.c),
a AS (SELECT h, CASE WHEN sum(p) > 1 - 1e-12 THEN max(total) / (max(total) + 0.5::DOUBLE) ELSE 1 END AS guard,
  CASE WHEN sum(p) > 1 - 1e-12 THEN 0.5::DOUBLE / (max(total) + 0.5::DOUBLE) ELSE 1 - sum(p) END / (1 - sum(below)) AS alpha
  FROM b2 GROUP BY 1),
p2 AS (SELECT b2.h, w, p * guard AS p FROM b2 JOIN a ON a.h = b2.h),
z AS (SELECT x.doc_id, x.held_out, coalesce(p1.c, 0) AS c, coalesce(p2.p, coalesce(a.alpha, 1) * coalesce(p1.p, unknown)) AS p
  FROM x CROSS JOIN g1 LEFT JOIN p1 ON p1.w = x.w LEFT JOIN a ON a.h = x.h LEFT JOIN p2 ON p2.h = x.h AND p2.w = x.w)
SELECT doc_id, held_out, count(*)::BIGINT AS n_tokens, (count(*) FILTER (c > 0))::BIGINT AS n_known, max(tokens)::BIGINT AS train_tokens,
  sum(log10((c + 0.5::DOUBLE) / (tokens + 0.5::DOUBLE * (types + 1)))) AS base_score, sum(log10(p)) AS score
FROM z CROSS JOIN n GROUP BY 1, 2
"""

OP3_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL AND list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) > 0),
e AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
n AS (SELECT x, count(*)::BIGINT AS n FROM e GROUP BY 1),
r(d, m) AS (SELECT x, x FROM e UNION SELECT e.y, r.m FROM r JOIN e ON r.d = e.x),
c AS (SELECT d, min(m) AS m FROM r GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(m, vec_id) AS component_id, coalesce(m, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN n ON x = vec_id LEFT JOIN c ON d = vec_id
"""

OP5_SQL = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM t WHERE len(w) >= 50)),
m AS (SELECT k, min(doc_id) AS least FROM g GROUP BY 1),
h AS (SELECT DISTINCT doc_id, i + o AS j FROM (SELECT g.doc_id, i, unnest(range(0, 50)) AS o FROM g JOIN m ON g.k = m.k AND least < g.doc_id)),
d AS (SELECT doc_id, list(j) AS gone FROM h GROUP BY 1),
s AS (SELECT t.doc_id, w, coalesce(gone, []) AS gone FROM t LEFT JOIN d ON d.doc_id = t.doc_id),
u AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda j: NOT list_contains(gone, j)) AS stay FROM s)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - len(stay))::BIGINT AS n_removed, sha256(array_to_string(list_transform(stay, lambda j: w[j]), ' ')) AS kept_sha256 FROM u
"""

OP8_SQL = r"""
WITH p AS (
  SELECT page_id, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)), '') AS host,
    list_filter(list_transform(string_split_regex(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), '[\r\n]+'),
      lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM pages),
held AS (SELECT DISTINCT page_id, host, unnest(lines) AS line FROM p),
totals AS (SELECT host, count(*) AS total FROM p GROUP BY 1),
common AS (
  SELECT c.host, c.line FROM (SELECT host, line, count(*) AS n FROM held GROUP BY 1, 2) c
  JOIN totals t ON c.host IS NOT DISTINCT FROM t.host WHERE n >= 3 AND n > total * 0.1),
drops AS (
  SELECT page_id, h.host, list(h.line) AS gone FROM held h
  JOIN common c ON h.host IS NOT DISTINCT FROM c.host AND h.line = c.line GROUP BY 1, 2),
kept AS (
  SELECT p.page_id, p.host, p.lines, list_filter(p.lines, lambda x: NOT list_contains(coalesce(d.gone, []), x)) AS stay
  FROM p LEFT JOIN drops d ON p.page_id = d.page_id AND p.host IS NOT DISTINCT FROM d.host)
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(stay))::BIGINT AS n_removed,
  sha256(array_to_string(stay, chr(10))) AS kept_sha256 FROM kept
"""

OP9_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
celled AS (
  SELECT *, CASE WHEN size < 100 THEN size ELSE len(size::VARCHAR) * 100 + substr(size::VARCHAR, 1, 2)::INT END AS class,
    floor(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 * 1048576)::BIGINT % 256 AS salt
  FROM sized),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY 1),
ranked AS (
  SELECT source, source_size, row_number() OVER (ORDER BY encode(source) NULLS LAST) AS rank FROM totals),
valued AS (
  SELECT *, [5.0::DOUBLE, 2.0, 1.0][((rank - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS most FROM ranked),
leveled AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM valued),
goals AS (
  SELECT source, source_size, coalesce(least(most, weight * (SELECT level FROM leveled l WHERE l.level * l.weight <= l.most
      ORDER BY l.most / l.weight, l.rank LIMIT 1)), most)::DOUBLE AS target FROM leveled),
placed AS (
  SELECT c.doc_id, c.size, g.source_size, g.target,
    CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('17/' || coalesce(c.source, chr(0))), 1, 8))::BIGINT / 4294967296.0 AS start,
    row_number() OVER (PARTITION BY c.source ORDER BY c.class, c.salt, c.size, c.doc_id) AS k
  FROM celled c JOIN goals g ON c.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  ((floor(k * rate + start) - floor((k - 1) * rate + start))::BIGINT * size)::BIGINT AS taken FROM placed
"""

OP10_SQL = r"""
WITH v AS (
  SELECT vec_id, v FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)
  WHERE list_sum(list_transform(v, lambda x: x * x)) > 0 AND len(list_filter(v, lambda x: coalesce(isfinite(x), false))) = len(v)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def queries() -> dict[str, Query]:
    return {
        "op1_minhash": op1_minhash,
        "op2_katz": op2_katz,
        "op3_embedding_dedup": op3_embedding_dedup,
        "op4_bpe": op4_bpe,
        "op5_passages": op5_passages,
        "op6_sharding": op6_sharding,
        "op7_toxicity": op7_toxicity,
        "op8_line_dedup": op8_line_dedup,
        "op9_mixing": op9_mixing,
        "op10_nearest": op10_nearest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash": OP1_SQL,
        "op2_katz": OP2_SQL,
        "op3_embedding_dedup": OP3_SQL,
        "op5_passages": OP5_SQL,
        "op8_line_dedup": OP8_SQL,
        "op9_mixing": OP9_SQL,
        "op10_nearest": OP10_SQL,
    }
