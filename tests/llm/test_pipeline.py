"""The pipeline, stage by stage, on a fixture with planted cases, and as a whole."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(1)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 8))) for _ in range(800)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    rows, labels = [], []
    for i in range(300):
        body = [line(rng.randrange(5, 30)) for _ in range(rng.randrange(1, 6))]
        toxic = i % 6 == 0
        if toxic:
            at = rng.randrange(len(body))
            body[at] = f"{body[at]} {rng.choice(['vilescum', 'nastyfool'])} {line(3)}"
        if i % 4 == 1:
            body.append("read more on our site")
        rows.append((i, "\n".join(body), rng.choice(["a", "a", "b", "c"])))
        if i < 250:
            labels.append((i, 1, int(toxic)))
    base = line(200)
    rows += [(300, base, "a"), (301, base, "b"), (302, base + " more words", "a"), (303, None, "a"), (304, "", None)]
    folder = str(tmp_path_factory.mktemp("sf"))
    docs = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_stages(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, corpus).cache()
    kept = {r.doc_id for r in clean.collect()}
    assert {300, 301, 302, 303, 304} <= kept and clean.columns == docs.columns
    assert sum(i in kept for i in range(0, 300, 6)) <= 5
    assert sum(i in kept for i in range(300) if i % 6) >= 240
    lined = stages["line_dedup"](spark, clean, corpus).cache()
    assert lined.columns == docs.columns and lined.count() == clean.count()
    assert lined.filter(F.col("text").contains("read more on our site")).count() == 0
    assert lined.filter("doc_id = 303 AND text IS NULL").count() == 1
    single = stages["minhash_dedup"](spark, lined, corpus).cache()
    assert single.columns == docs.columns
    assert {r.doc_id for r in lined.collect()} - {r.doc_id for r in single.collect()} == {301, 302}
    mixed = stages["mixing"](spark, single, corpus).cache()
    assert mixed.columns == docs.columns
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in single.collect()}
    coded = {r.doc_id: r for r in stages["bpe"](spark, mixed, corpus).collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in mixed.collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        assert coded[r.doc_id].n_tokens == len(ids)
        assert coded[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_run_is_the_stages_in_turn(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, corpus)
    key = lambda df: sorted((r.doc_id, r.ids_sha256) for r in df.collect())
    whole = corpus_pipeline.run(spark, corpus)
    assert key(whole) == key(docs) and whole.count() > 0


def test_repeated_lines_go_and_copies_stay(spark, corpus):
    rows = []
    for source, n, held in [("a", 20, 3), ("b", 50, 3), ("c", 50, 5), ("d", 200, 10), ("e", 200, 20), ("f", 500, 25), ("g", 500, 50)]:
        rows += [(len(rows) + i, f"text {i} of {source}" + "\nread on" * (i < held), source) for i in range(n)]
        rows += [(len(rows) + i, f"copied in {source}\nas it is", source) for i in range(n // 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    out = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, frame, corpus).collect()}
    assert out == {d: t.replace("\nread on", "") for d, t, _ in rows}


def test_empty_null_and_repeated_rows(spark, corpus, tmp_path):
    """Stages on no rows, null ids, repeated rows, and columns beyond those of documents."""
    docs = spark.read.parquet(f"{corpus}/documents.parquet").withColumn("row", F.lit(1)).withColumn("_host", F.lit("h"))
    some = docs.limit(20).unionByName(docs.filter("doc_id = 300")).unionByName(docs.filter("doc_id = 300")).unionByName(docs.filter("doc_id = 302").withColumn("doc_id", F.lit(None).cast("long")))
    folder = str(tmp_path / "sf")
    spark.read.parquet(f"{corpus}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    for name, table in (("some", some), ("none", docs.limit(0))):
        now = table
        for stage, f in corpus_pipeline.STAGES:
            now = f(spark, now, folder)
            assert stage == "bpe" or now.columns == docs.columns
            if stage == "minhash_dedup" and name == "some":
                ids = [r.doc_id for r in now.select("doc_id").collect()]
                assert ids.count(300) == 1 and ids.count(None) == 1 and len(set(ids)) == len(ids)
        assert (now.count() == 0) == (name == "none")
