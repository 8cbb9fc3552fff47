"""Corpus pipeline: language, toxicity, near duplicates, repeated strings, packing.

Each stage takes all documents that the one before kept and returns the columns of documents; the last one returns
packed pieces. Stages depend on one another's decisions: models and corpus facts are those of the stage's own input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import common, language, ngram_join, packing, suffix_dedup, toxicity


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or far from all languages' centroids, go. Fitted on the labelled rows of ``docs``."""
    model = language.fit(docs)
    return docs.withColumn("__language", language.identified(F.col("text"), model)).filter(~F.col("__language.rejected")).drop("__language")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go. Fitted on the labelled rows of ``docs``."""
    model = toxicity.fit(docs, common.table(spark, sf_dir, "labels"))
    return docs.withColumn("__toxicity", toxicity.score(F.col("text"), model)).filter(F.col("__toxicity") < 0.5).drop("__toxicity")


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more) the document with the least
    doc_id stays; of repeated rows one."""
    kept = ngram_join.linked(docs, n=5, num=80).filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id"))
    docs = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    return docs.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).drop("__text")


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur elsewhere go from the texts; what is left of a character cut apart goes too."""
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # the results' names may be columns of the table
    out = suffix_dedup.deduplicated(docs.toDF(*place.values()), id_col=place["doc_id"], text_col=place["text"])
    out = out.withColumn(place["text"], F.when(F.col(place["text"]).isNotNull(), F.col("dedup_text")))
    if "n_chars" in docs.columns:
        out = out.withColumn(place["n_chars"], F.length(place["text"]).cast(docs.schema["n_chars"].dataType))
    return out.select(*place.values()).toDF(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens."""
    return packing.pack(docs, common.tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("ngram_join", near_duplicate_stage),
    ("suffix_dedup", repeats_stage),
    ("packing", packing_stage),
]

#: SQL can't express the fitted models, the byte-wise repeats or the packing; tests hold their operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
