"""Joins: lookups, overrides, cascades, as-of and interval joins, differences.

Physical strategy is Catalyst's: no side is broadcast by hint here, because none has a proven bound; AQE broadcasts
small ones and splits skewed partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, dim: DataFrame, on: str | Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """Left lookup; missing values of the dimension's columns get defaults."""
    out = df.join(dim, on, "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def override_merge(base: DataFrame, override: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows of both; where both have a key, the override's row."""
    return base.join(override, on, "left_anti").unionByName(override.select(base.columns))


def update_join(base: DataFrame, other: DataFrame, on: str, column: str) -> DataFrame:
    """``column`` from ``other`` where that has a value, else as it was."""
    o = other.select(on, F.col(column).alias("__new"))
    return base.join(o, on, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


def conditional_update(base: DataFrame, new: DataFrame, on: str, value: str, confidence: str) -> DataFrame:
    """Take the new value and confidence where the confidence is higher or the value differs; ``changed`` marks it."""
    n = new.select(on, F.col(value).alias("__value"), F.col(confidence).alias("__confidence"))
    take = F.col("__value").isNotNull() & ((F.col("__confidence") > F.col(confidence)) | ~F.col("__value").eqNullSafe(F.col(value)))
    out = base.join(n, on, "left").withColumn("changed", F.coalesce(take, F.lit(False)))
    return out.withColumns({value: F.when(F.col("changed"), F.col("__value")).otherwise(F.col(value)), confidence: F.when(F.col("changed"), F.col("__confidence")).otherwise(F.col(confidence))}).drop("__value", "__confidence")


def missing_and_unused(cited: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """Keys cited but not listed ('missing') and listed but not cited ('unused')."""
    a, b = cited.select(key).distinct(), listed.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("kind", F.lit("missing")).unionByName(b.join(a, key, "left_anti").withColumn("kind", F.lit("unused")))


def cascade(df: DataFrame, rules: Sequence[tuple[str, DataFrame, str]], on: str, name: str = "matched") -> DataFrame:
    """First of several lookups that hits. rules: (label, table with ``on`` and a value column, its value column)."""
    for label, t, value in rules:
        df = df.join(t.select(on, F.col(value).alias(f"__{label}")).dropDuplicates([on]), on, "left")
    hits = [F.when(F.col(f"__{label}").isNotNull(), F.struct(F.lit(label).alias("by"), F.col(f"__{label}").alias("value"))) for label, _, _ in rules]
    return df.withColumn(name, F.coalesce(*hits)).drop(*(f"__{label}" for label, _, _ in rules))


def as_of(left: DataFrame, right: DataFrame, by: Sequence[str], pos: str, value: str) -> DataFrame:
    """The right side's last value at or before each left row: one union and one window, no range join."""
    marks = right.select(*by, F.col(pos), F.col(value).alias("__value"), F.lit(0).alias("__side"))
    rows = left.withColumn("__side", F.lit(1))
    both = rows.unionByName(marks, allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(pos, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn(value, F.last("__value", ignorenulls=True).over(w)).filter("__side = 1").drop("__side", "__value")


def nearest_within(anchors: DataFrame, candidates: DataFrame, by: Sequence[str], pos: str, reach: int, prefer: Column) -> DataFrame:
    """For each anchor the best candidate at most ``reach`` positions away: preferred ones, then the nearest, then the
    one before. Positions are cut into blocks of ``reach``, so the range join becomes an equi-join of three blocks.
    Columns of candidates get the prefix ``c_``. Repeated anchors get a row each, repeated candidates count once."""
    block = F.floor(F.col(pos) / reach)
    a = anchors.withColumn("__b", F.explode(F.array(block - 1, block, block + 1)))
    c = candidates.select(*(F.col(k) for k in by), *(F.col(k).alias(f"c_{k}") for k in candidates.columns if k not in by)).distinct().withColumn("__b", F.floor(F.col(f"c_{pos}") / reach))
    both = a.join(c, [*by, "__b"]).withColumn("__d", F.abs(F.col(pos) - F.col(f"c_{pos}"))).filter((F.col("__d") <= reach) & (F.col("__d") > 0))
    # equal ranks are repeated anchors only: the order ends with all columns of the candidates, which are distinct
    w = Window.partitionBy(*anchors.columns).orderBy(F.desc(prefer.cast("int")), "__d", f"c_{pos}", *(x for x in c.columns if x.startswith("c_")))
    return both.withColumn("__rank", F.rank().over(w)).filter("__rank = 1").drop("__rank", "__b").withColumnRenamed("__d", "distance")


def positional_diff(a: DataFrame, b: DataFrame, on: Sequence[str], compare: Sequence[str]) -> DataFrame:
    """Rows whose compared columns differ at a position, or that one side lacks."""
    x = a.select(*on, *(F.col(c).alias(f"a_{c}") for c in compare), F.lit(True).alias("__a"))
    y = b.select(*on, *(F.col(c).alias(f"b_{c}") for c in compare), F.lit(True).alias("__b"))
    status = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed")
    for c in compare:
        status = status.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), f"{c} differs")
    return x.join(y, list(on), "full").withColumn("status", status).filter(F.col("status").isNotNull()).drop("__a", "__b")


def outer_merge(inline: DataFrame, legend: DataFrame, on: Sequence[str], text: str) -> DataFrame:
    """Full outer merge; where both have a text the longer one (the first side's at equal length)."""
    x, y = inline.select(*on, F.col(text).alias("__x")), legend.select(*on, F.col(text).alias("__y"))
    longer = F.when(F.col("__y").isNull() | (F.length("__x") >= F.length("__y")), F.col("__x")).otherwise(F.col("__y"))
    return x.join(y, list(on), "full").withColumn(text, F.when(F.col("__x").isNull(), F.col("__y")).otherwise(longer)).drop("__x", "__y")


def covered(inputs: DataFrame, outputs: DataFrame, text: str) -> DataFrame:
    """Inputs that occur neither as an output nor as two adjacent ones (``outputs``: see ``adjacent_pairs``)."""
    return inputs.join(outputs.select(text).distinct(), text, "left_anti")


def first_page(sentences: DataFrame, pages: DataFrame, by: Sequence[str], sentence: str, page: str, text: str) -> DataFrame:
    """Per distinct sentence of a document the first page that holds its beginning: of letters and digits, in lower case,
    the first 60. Null where no page does; a sentence without a letter is on the first page. The join is on the document,
    and what meets a page there is beginnings, not sentences."""
    plain = lambda c: F.lower(F.regexp_replace(F.col(c), r"[^\p{L}\p{N}]+", ""))
    wanted = sentences.select(*by, sentence).distinct().withColumn("__start", F.left(plain(sentence), F.lit(60)))
    held = pages.select(*by, page, plain(text).alias("__page"))
    found = wanted.select(*by, "__start").distinct().join(held, list(by)).filter(F.contains("__page", "__start")).groupBy(*by, "__start").agg(F.min(page).alias(page))
    return wanted.join(found, [*by, "__start"], "left").drop("__start")
