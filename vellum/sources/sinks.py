"""Writers and reports: JSON results, rule files, priors, review rows, plain-text reports, append-only caches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RULES = "feature string, value string, tag string, support long, total long, confidence double"


def result_documents(df: DataFrame, doc: str, pos: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """(doc, json): one JSON document with a document's rows in order. A document's rows meet in one group."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*pos).alias("k"), F.struct(*columns).alias("v")))), lambda x: x["v"])
    return df.groupBy(doc).agg(F.to_json(F.struct(F.count("*").alias("rows"), rows.alias("results"))).alias("json"))


def save_rules(rules: DataFrame, path: str) -> None:
    rules.select(*(f.split()[0] for f in RULES.split(", "))).write.mode("overwrite").json(path)


def load_rules(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """Saved rules; without them an error, or with ``required`` off no rows."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(RULES).json(path)
    except AnalysisException:
        if required:
            raise
        return spark.createDataFrame([], RULES)


def save_artifact(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    """Priors and other knowledge as Parquet, partitioned for readers that want one group."""
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def report_lines(df: DataFrame, by: str, order: Sequence[str], line: Column, header: str) -> DataFrame:
    """(by, report): a header and one line for each row, in order."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(*order, line.alias("__line")))), lambda x: x["__line"])
    return df.groupBy(by).agg(F.concat(F.lit(f"{header} "), F.col(by).cast("string"), F.lit("\n"), F.array_join(lines, "\n")).alias("report"))


def review_rows(df: DataFrame, k: int) -> DataFrame:
    """The k rows that need a look most: low confidence first, plain text before the rest."""
    return df.orderBy("confidence", F.when(F.col("tag") == "TXT", 0).otherwise(1), *(c for c in ("doc_id", "pos") if c in df.columns)).limit(k)


def append_cache(entries: DataFrame, path: str) -> None:
    """Append to a cache; readers take the last entry of a key (``workflow.valid_latest``)."""
    entries.write.mode("append").parquet(path)


def invalid_rules(spark: SparkSession, rules: Sequence[tuple[str, str]], longest: int = 500) -> list[tuple[str, str]]:
    """(name, reason) of rules that can't be used: too long, or not a pattern that the engine compiles."""
    out = []
    for name, pattern in rules:
        if not pattern or len(pattern) > longest:
            out.append((name, "empty" if not pattern else "too long"))
            continue
        try:
            spark._jvm.java.util.regex.Pattern.compile(pattern)
        except Exception:
            out.append((name, "not a pattern"))
    return out
