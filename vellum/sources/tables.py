"""Readers: the tables, labelled corpora, vocabularies and term lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LABELLED = "doc_id string, para_index int, text string, gold_tag string, canonical_gold_tag string, alignment_score double, zone string, notes string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def labelled(spark: SparkSession, path: str, usable_only: bool = False) -> DataFrame:
    """Labelled JSONL; malformed lines are dropped, zones lower-cased, ``mapped`` marks rows with a canonical tag."""
    df = spark.read.schema(LABELLED).option("mode", "DROPMALFORMED").json(path)
    df = df.withColumns({"zone": F.lower("zone"), "mapped": (F.coalesce("canonical_gold_tag", F.lit("")) != "") & (F.col("canonical_gold_tag") != "UNMAPPED")})
    return df.filter(F.col("mapped") & (F.col("alignment_score") >= 0.75)) if usable_only else df


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(style) of a JSON array of names; blank and repeated ones go."""
    df = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("style"))
    return df.filter(F.trim("style") != "").distinct()


def aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, style) of a JSON object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("alias", "style"))


def terms(spark: SparkSession, path: str) -> DataFrame:
    """(term, category) of a CSV with a header; white space collapsed, the last line of a term wins."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    names = {c.strip().lstrip("﻿").lower(): c for c in raw.columns}
    df = raw.select(F.regexp_replace(F.trim(F.col(f"`{names['term']}`")), r"\s+", " ").alias("term"), F.trim(F.col(f"`{names['category']}`")).alias("category"), F.monotonically_increasing_id().alias("line"))
    return df.filter(F.col("term") != "").groupBy("term").agg(F.max_by("category", "line").alias("category"))


def upper_or_any_case(term: str, text: str) -> F.Column:
    """Terms in capitals match as they are, others in any case."""
    t, x = F.col(term), F.col(text)
    return F.when(t == F.upper(t), F.contains(x, t)).otherwise(F.contains(F.lower(x), F.lower(t)))


def numbered(df: DataFrame, doc: str, order: list[str], name: str = "pos") -> DataFrame:
    """Dense positions from 1 within each document."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(doc).orderBy(*order)))
