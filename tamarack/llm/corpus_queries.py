"""Queries over the corpus of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.llm.packing import pack_documents, packing_report
from tamarack.llm.spam import spam_pages, spam_scores
from tamarack.llm.tokenize import decode_corpus, encode_corpus
from tamarack.sources.tables import table


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_corpus(table(spark, sf_dir, "documents"))


def p6_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decode_corpus(p6_ids(spark, sf_dir)).select("doc_id", F.decode("data", "UTF-8").alias("text"))


QUERIES = {"p6_ids": p6_ids, "p6_decoded": p6_decoded}
ORACLE = {"p6_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents"}


def p7_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes"))
    return packed.select("pack_name", "container_id", "doc_id", "piece", F.col("start").alias("start_token"), F.col("length").alias("n_tokens"))


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing_report(pack_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_sizes")))


QUERIES |= {"p7_packs": p7_packs, "p7_report": p7_report}


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_pages(table(spark, sf_dir, "documents"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam_scores(table(spark, sf_dir, "documents"))


QUERIES |= {"p8_found": p8_found, "p8_scores": p8_scores}
