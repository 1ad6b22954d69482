"""BPE against the tokenizers library."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from townhall.llm import bpe

HARD = [
    None, "", " ", "\n\t", "a", "don't WON'T we'll I'M it's", "<|endoftext|>", "x<|startoftext|>y<|endoftext|>", "<|endoftext|",
    "ΟΔΟΣ Σ σίγμα İstanbul ẞ straße", "é é ́x ﬁ", "1234 ٣٤ ² Ⅷ", "日本語テキスト", "😀👍🏽 flags 🇫🇷", "a b c　d​e",
    "x\x1cy\x1dz \x1e\x1f q\x85r\x0bs", "\x00\x01", "a" * 5000, "ab" * 3000 + "!" * 700, "...!!!???" * 50, "_under_score-dash/slash", "naïve café résumé",
    "ｆｕｌｌ Ｗｉｄｔｈ", "﻿bom", "Å Å K K",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))


def test_matches_the_library(spark, library):
    random.seed(3)
    alphabet = "abcdefghij ABC'st.,!0123é́Σßİ \n\x1c <|>日😀"
    texts = HARD + ["".join(random.choices(alphabet, k=random.randrange(80))) for _ in range(400)]
    rows = [(i, t, "clash") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.encode_and_decode(df).collect()}
    back = {r.doc_id: r.decoded for r in bpe.decode(bpe.encode(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = library.encode(t or "", add_special_tokens=False).ids
        ids = [int.from_bytes(got[i].ids[j : j + 4], "little") for j in range(0, len(got[i].ids), 4)]
        assert ids == want, repr(t)
        assert got[i].n_tokens == len(want)
        assert got[i].decoded == back[i] == library.decode(want, skip_special_tokens=False), repr(t)


def test_heap_and_scan_agree(library):
    coder = bpe.Coder(bpe.read_vocabulary())
    random.seed(5)
    for _ in range(100):
        parts = [coder.inner[b] for b in random.choices(b"thearnio", k=90)]
        assert coder.merged(list(parts)) == coder._merged_long(list(parts))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_and_decode(df).count() == 0
    assert pa.array([b""]) is not None


def test_table_of_words_starts_anew(library, monkeypatch):
    monkeypatch.setattr(bpe, "KEEP", 5)
    coder = bpe.Coder(bpe.read_vocabulary())
    text = "one two three four five six seven eight nine one two three"
    want = library.encode(text, add_special_tokens=False).ids
    for _ in range(3):
        got = coder.encode(text)
        assert [int.from_bytes(got[j : j + 4], "little") for j in range(0, len(got), 4)] == want
