"""A cleaning pipeline over `documents`; each stage applies one operator of tidemark.llm to all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard, langid, linededup
from tidemark.llm.shared import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter or in none of the learned languages; `lang` becomes the predicted one."""
    model = langid.train(docs, ~langid.held_out())
    found = langid.classify(docs.select(*COLUMNS), model, strict=True)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes near-copied lines out of texts, all but the first; n_chars is of what is left. Documents that lose all they had go."""
    found = linededup.dedup(docs.select(*COLUMNS)).where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return found.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def keep_one_near_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group: five-word shingles, similarity 0.8 or more.

    That of the smallest doc_id stays, null ids last; rows that agree in id and text are one document.
    """
    lead = jaccard.groups(docs, k=5, num=80, den=100).where("leads").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    lead = Scratch(spark, "kept").keep(lead, "ids")
    same = docs["doc_id"].eqNullSafe(lead["_id"]) & (F.xxhash64(docs["text"]) == lead["_hash"])
    out = docs.join(lead.distinct(), same, "left_semi").select(*COLUMNS)
    return out.dropDuplicates(["doc_id", "text"]) if lead.groupBy("_id", "_hash").count().where("count > 1").take(1) else out


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item, ten words or all of a shorter item.

    A row is judged by its own text: clean rows stay, whatever rows share their doc_id or have none.
    """
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, checked by decoding them again."""
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    coded = bpe.encode(docs.select(*COLUMNS), path, pattern, decoded="decoded")
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_near_copy),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Language identification and the edit join have no SQL form; the pipeline is tested stage by stage.
ORACLE_SQL = None
