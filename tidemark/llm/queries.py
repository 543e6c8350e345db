"""One query for each operator of this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, conversations, decontaminate, jaccard, langid, linededup, quality, sharding, substring, toxicity, vectorcodes, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.report(table(spark, sf_dir, "documents"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op7_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN)


def op9_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op11_vectorcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.report(table(spark, sf_dir, "embeddings"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.damaged_report(table(spark, sf_dir, "conversations"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_langid": op1_langid,
    "op2_decontaminate": op2_decontaminate,
    "op3_sharding": op3_sharding,
    "op4_substring": op4_substring,
    "op5_quality": op5_quality,
    "op6_ann": op6_ann,
    "op7_linededup": op7_linededup,
    "op8_bpe": op8_bpe,
    "op9_jaccard": op9_jaccard,
    "op10_warc": op10_warc,
    "op11_vectorcodes": op11_vectorcodes,
    "op12_conversations": op12_conversations,
    "op13_toxicity": op13_toxicity,
}

ORACLES = {
    "op2_decontaminate": decontaminate.ORACLE,
    "op3_sharding": sharding.ORACLE,
    "op4_substring": substring.ORACLE,
    "op9_jaccard": jaccard.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_vectorcodes": vectorcodes.ORACLE,
    "op12_conversations": conversations.ORACLE,
}
