"""Encoding of a corpus with a public byte-level BPE through its distinct words.

A block of documents is cut into pre-tokens once; the block keeps its distinct words and,
for each document, the positions as indices into them (compressed). Only the distinct
words of the blocks travel: each word of the corpus is encoded once, its ids are joined
back to the blocks that hold it, and every block is put together by position. A frequent
word costs one row a block, not one an occurrence; a word that very many blocks hold is
known by that number, and its ids are sent to all tasks instead.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamarack.operators.parallel import spread
from tamarack.operators.skew import hot_aware_join
from tamarack.storage import materialize

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-token pattern of the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BLOCK_CHARS = 4_000_000


def ship_vocabulary(spark: SparkSession, path: str) -> None:
    """Send the vocabulary file to the executors, which need no copy of their own."""
    spark.sparkContext.addFile(path)


@lru_cache(maxsize=4)
def _ranks(path: str) -> dict[bytes, int]:
    """The tokens of a vocabulary file, as it was sent to this executor, else at its path."""
    sent = SparkFiles.get(os.path.basename(path)) if SparkFiles._is_running_on_worker else path
    with open(sent if os.path.exists(sent) else path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str = PATTERN):
    import tiktoken

    return tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=_ranks(path), special_tokens={})


def _pack(codes: np.ndarray) -> bytes:
    import zstandard

    wide = len(codes) and codes.max() > 65535
    return (b"4" if wide else b"2") + zstandard.compress(codes.astype(np.uint32 if wide else np.uint16).tobytes(), 3)


def _unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.decompress(data[1:]), dtype=np.uint32 if data[:1] == b"4" else np.uint16).astype(np.int64)


_BLOCKS = T.StructType([T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(T.LongType())), T.StructField("lengths", T.ArrayType(T.IntegerType())), T.StructField("words", T.ArrayType(T.StringType())), T.StructField("codes", T.BinaryType())])


def _cut(pattern: str, block_chars: int):
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        number = TaskContext.get().partitionId() << 33
        schema = pa.schema([("block", pa.int64()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("words", pa.list_(pa.string())), ("codes", pa.binary())])

        def close() -> pa.RecordBatch:
            words = list(seen)
            order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable") if words else np.zeros(0, np.int64)
            rank = np.empty(len(words), np.int64)
            rank[order] = np.arange(len(words))
            coded = rank[np.array(codes, np.int64)] if codes else np.zeros(0, np.int64)
            return pa.RecordBatch.from_pylist([{"block": number, "docs": docs, "lengths": lengths, "words": [words[i] for i in order], "codes": _pack(coded)}], schema)

        seen, codes, docs, lengths, chars = {}, [], [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = find(text) if text else []
                codes.extend([seen.setdefault(w, len(seen)) for w in words])
                docs.append(doc)
                lengths.append(len(words))
                chars += len(text or "")
                if chars >= block_chars or len(docs) >= 50_000:
                    yield close()
                    number += 1
                    seen, codes, docs, lengths, chars = {}, [], [], [], 0
        if docs:
            yield close()

    return blocks


def _encode(path: str, pattern: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path, pattern).encode_ordinary  # a pre-token standing alone is cut as one
        for batch in batches:
            words = batch.column(0)
            yield pa.RecordBatch.from_arrays([words, batch.column(1), pa.array([one(w) for w in words.to_pylist()], pa.list_(pa.int32()))], ["word", "held_by", "ids"])

    return encode


def _assemble(key: tuple, block: pa.Table, coded: pa.Table) -> pa.Table:
    row = block.to_pylist()[0]
    codes = _unpack(row["codes"])
    lists = coded.column("ids").combine_chunks()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.zeros(len(row["words"]), np.int64)
    length = np.zeros(len(row["words"]), np.int64)
    at = coded.column("at").to_numpy()
    starts[at], length[at] = np.cumsum(sizes) - sizes, sizes
    each = length[codes]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    index = np.repeat(starts[codes] - (ends - each), each) + np.arange(total)
    words_end = np.cumsum(np.array(row["lengths"], np.int64))
    offsets = np.concatenate([[0], np.concatenate([[0], ends])[words_end]]).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat[index].astype(np.int32) if total else np.zeros(0, np.int32)))
    return pa.table({"doc_id": pa.array(row["docs"], pa.int64()), "ids": ids})


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN, block_chars: int = BLOCK_CHARS, hot_rows: int = 50_000) -> DataFrame:
    """(doc_id bigint, ids array<int>): the ids of every text, without special tokens.

    A null or an empty text gives an empty list. Rows are kept as they are: a document
    that is there twice comes out twice; other columns are ignored. The strings of special
    tokens in a text are ordinary text. ``block_chars`` bounds what one task assembles at
    once, unless a single text is longer; a word that over ``hot_rows`` blocks hold is joined
    without a shuffle.
    """
    ship_vocabulary(docs.sparkSession, vocabulary)
    picked = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    blocks = materialize(spread(picked).mapInArrow(_cut(pattern, block_chars), _BLOCKS))
    held = blocks.select("block", F.posexplode("words").alias("at", "word"))
    known = materialize(held.groupBy("word").agg(F.count("*").alias("held_by")).mapInArrow(_encode(vocabulary, pattern), "word string, held_by bigint, ids array<int>"))
    total = known.agg(F.sum("held_by")).first()[0] or 0
    coded = hot_aware_join(held, known, ["word"], "held_by", total, hot_rows).select(F.col("block").alias("home"), "at", "ids")
    return blocks.groupBy("block").cogroup(coded.groupBy("home")).applyInArrow(_assemble, "doc_id bigint, ids array<int>")


@lru_cache(maxsize=4)
def _byte_table(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all tokens end to end, where each id's begin, and how many they are."""
    ranks = _ranks(path)
    tokens = [b""] * (max(ranks.values()) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    lengths = np.array([len(t) for t in tokens], np.int64)
    return np.frombuffer(b"".join(tokens), np.uint8), np.cumsum(lengths) - lengths, lengths


def decode_corpus(encoded: DataFrame, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id bigint, data binary): the bytes of each list of ids, joined to the token-byte table inside the rows' own batch; null ids give null."""

    ship_vocabulary(encoded.sparkSession, vocabulary)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, starts, lengths = _byte_table(vocabulary)
        for batch in batches:
            lists = batch.column(1)
            sizes = np.where(lists.is_valid().to_numpy(zero_copy_only=False), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False), 0)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            each = lengths[ids]
            ends = np.cumsum(each)
            total = int(ends[-1]) if len(ends) else 0
            bytes_ = data[np.repeat(starts[ids] - (ends - each), each) + np.arange(total)]
            offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])].astype(np.int32)
            texts = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(offsets), pa.py_buffer(bytes_.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.binary()))], ["doc_id", "data"])

    return encoded.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(decode, "doc_id bigint, data binary")


def count_tokens(docs: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """The columns ``keep`` and n_tokens bigint: the number of ids of each text, 0 for null and empty ones; no shuffle."""
    ship_vocabulary(docs.sparkSession, vocabulary)
    picked = docs.select(*keep, F.col(text).cast("string").alias("__text"))
    schema = T.StructType([*(picked.schema[c] for c in keep), T.StructField("n_tokens", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, pattern).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return spread(picked).mapInArrow(count, schema)
