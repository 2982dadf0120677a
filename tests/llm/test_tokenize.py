import os
import random

import pytest
from pyspark import SparkFiles

from tamarack.llm.tokenize import count_tokens, decode_corpus, encode_corpus, encoder, VOCABULARY

HARD = [None, "", " ", "\n\n \t x", "don't  stop ’s", "日本語 テキスト", "​ \u0085\x1c\x1d a\x1fb", "a" * 70_000, "<|endoftext|> 12３４½", "👩‍👩‍👧 é", "x\r\ny  \r\n", "   lead", "trail   "]


def test_ids_equal_direct_encoding(spark):
    rng = random.Random(1)
    texts = HARD + ["".join(rng.choice("ab 1.\n'sté 漢") for _ in range(rng.randint(1, 300))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in enumerate(texts)], "doc_id long, text string, ids string").repartition(3)
    direct = encoder(VOCABULARY).encode_ordinary
    want = {i: direct(t) if t else [] for i, t in enumerate(texts)}
    for size in (50, 4_000_000):
        assert {r.doc_id: r.ids for r in encode_corpus(docs, block_chars=size).collect()} == want
    assert {r.doc_id: r.ids for r in encode_corpus(docs, block_chars=50, hot_rows=3).collect()} == want  # words of many blocks joined apart
    assert {r.doc_id: r.n_tokens for r in count_tokens(docs, ["doc_id"]).collect()} == {i: len(x) for i, x in want.items()}
    assert {r.doc_id: bytes(r.data).decode() for r in decode_corpus(encode_corpus(docs)).collect()} == {i: t or "" for i, t in enumerate(texts)}
    some = spark.createDataFrame([(1, None), (2, []), (3, want[7])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.data and bytes(r.data) for r in decode_corpus(some).collect()} == {1: None, 2: b"", 3: texts[7].encode()}


def test_equals_the_other_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    texts = [x for x in HARD if x]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in encode_corpus(docs).collect()}
    assert got == {i: e.ids for i, e in enumerate(t.encode_batch(texts, add_special_tokens=False))}


def test_vocabulary_is_sent_to_the_executors(spark):
    docs = spark.createDataFrame([(1, "a b c d e")], "doc_id long, text string")
    assert count_tokens(docs, ["doc_id"]).collect()[0].n_tokens == 5
    seen = docs.rdd.map(lambda _: os.path.exists(SparkFiles.get(os.path.basename(VOCABULARY)))).collect()
    assert seen == [True]


def test_empty_and_repeated(spark):
    assert encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sorted((r.doc_id or 0, len(r.ids)) for r in encode_corpus(twice).collect()) == [(0, 1), (1, 2), (1, 2)]
