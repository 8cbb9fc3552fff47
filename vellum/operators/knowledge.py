"""Knowledge of a labelled corpus: tag families, list depths, markers, roles, guidance, and predictors built on it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import corpus, stages


def tag_families(df: DataFrame, tag: str) -> DataFrame:
    """Per family (a tag without its position and depth): members, positions, depths and rows."""
    t = F.col(tag)
    base = F.regexp_replace(F.regexp_replace(t, "-(FIRST|MID|LAST)$", ""), "[0-9]+$", "")
    depth = F.regexp_extract(F.regexp_replace(t, "-(FIRST|MID|LAST)$", ""), "([0-9]+)$", 1)
    position = F.nullif(F.regexp_extract(t, "-(FIRST|MID|LAST)$", 1), F.lit(""))
    n = df.groupBy(t.alias("tag"), base.alias("family"), position.alias("position"), F.nullif(depth, F.lit("")).alias("depth")).agg(F.count("*").alias("n"))
    sets = {k: F.array_sort(F.collect_set(k)) for k in ("tag", "position", "depth")}
    return n.groupBy("family").agg(sets["tag"].alias("members"), sets["position"].alias("positions"), sets["depth"].alias("depths"), F.sum("n").alias("total"))


def list_depths(df: DataFrame, tag: str, most: int = 12) -> DataFrame:
    """Per list base and depth: rows, and the first variants by name."""
    d = df.withColumn("__d", stages.list_depth(F.col(tag))).filter(F.col("__d").isNotNull())
    n = d.groupBy("__d.base", "__d.depth").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(tag)), 1, most).alias("variants"))
    return n


def marker_counts(df: DataFrame, text: str, k: int = 10) -> DataFrame:
    """The k most frequent patterns of each class of marker rows."""
    m = df.select(stages.marker_class(F.col(text)).alias("m")).select("m.*")
    return corpus.top_k(m, ["class"], "pattern", k)


def role_counts(df: DataFrame, tag: str, roles: DataFrame) -> DataFrame:
    """Rows of each role; roles (role, tag) without rows count 0."""
    n = df.groupBy(F.col(tag).alias("tag")).agg(F.count("*").alias("n"))
    return roles.join(n, "tag", "left").groupBy("role").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_sort(F.collect_set("tag")).alias("tags"))


def zone_family(df: DataFrame, zone: str, tag: str, inside: str, start: str, k: int = 20) -> DataFrame:
    """The k most frequent tags of a zone, and of the rest those of a family: (place, tag, n)."""
    a = df.filter(F.col(zone) == inside).withColumn("place", F.lit("inside"))
    b = df.filter((F.col(zone) != inside) & F.startswith(tag, F.lit(start))).withColumn("place", F.lit("outside"))
    return corpus.top_k(a.unionByName(b).select("place", tag), ["place"], tag, k)


def guidance(priors: DataFrame, given: str, tag: str, k: int = 5) -> DataFrame:
    """One line for each zone: its k most frequent tags with their shares."""
    w = Window.partitionBy(given).orderBy(F.desc("n"), tag)
    top = priors.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= k)
    part = F.transform(F.array_sort(F.collect_list(F.struct("__r", tag, "freq"))), lambda x: F.concat(x[tag], F.lit(" "), F.format_number(x["freq"] * 100, 1), F.lit("%")))
    return top.groupBy(given).agg(F.array_join(part, ", ").alias("line"))


def prior_prediction(df: DataFrame, zone: str, previous: str, zone_priors: DataFrame, transitions: DataFrame, least_zone: float = 0.40, least_next: float = 0.75) -> DataFrame:
    """``predicted``: the zone's top tag if frequent enough, else the previous tag's top successor if likely enough."""
    z = zone_priors.groupBy(zone).agg(F.max_by(F.struct("tag", "freq"), F.struct("freq", "tag")).alias("__z"))
    t = transitions.groupBy(F.col("src").alias(previous)).agg(F.max_by(F.struct("dst", "p"), F.struct("p", "dst")).alias("__t"))
    out = df.join(z, zone, "left").join(t, previous, "left")
    return out.withColumn("predicted", F.when(F.col("__z.freq") >= least_zone, F.col("__z.tag")).when(F.col("__t.p") >= least_next, F.col("__t.dst"))).drop("__z", "__t")


def cascade(df: DataFrame, predictors: Sequence[tuple[str, Column]], name: str = "tag") -> DataFrame:
    """First predictor that says something; ``<name>_by`` names it."""
    by = F.lit(None).cast("string")
    for label, c in reversed(predictors):
        by = F.when(c.isNotNull(), label).otherwise(by)
    return df.withColumns({name: F.coalesce(*(c for _, c in predictors)), f"{name}_by": by})


def complete(results: DataFrame, sent: DataFrame, key: Sequence[str], known: DataFrame) -> DataFrame:
    """One result for each row sent: unknown tags become TXT with a confidence of 50 at most, missing rows TXT with 0."""
    ok = results.join(known.select(F.col("style").alias("tag"), F.lit(True).alias("__ok")), "tag", "left")
    fixed = ok.select(*key, F.when(F.col("__ok"), F.col("tag")).otherwise("TXT").alias("tag"), F.when(F.col("__ok"), F.col("confidence")).otherwise(F.least("confidence", F.lit(50))).alias("confidence"))
    return sent.select(*key).join(fixed, list(key), "left").withColumns({"tag": F.coalesce("tag", F.lit("TXT")), "confidence": F.coalesce("confidence", F.lit(0))})


def family_votes(df: DataFrame, doc: str, text: str, patterns: dict[str, str], default: str) -> DataFrame:
    """Per document the style whose pattern occurs most often; ties and none: the order given, then the default."""
    n = df.groupBy(doc).agg(*(F.sum(F.regexp_count(text, F.lit(p))).alias(k) for k, p in patterns.items()))
    most = F.greatest(*patterns) if len(patterns) > 1 else F.col(next(iter(patterns)))
    out = F.lit(default)
    for k in reversed(list(patterns)):
        out = F.when((F.col(k) == most) & (most > 0), k).otherwise(out)
    return n.withColumn("style", out)


def header_score(text: Column, row: Column, cell: Column, rows: Column) -> Column:
    """How much a table cell looks like a header, 0 to 1."""
    w = [(row == 0, 0.4), (F.length(text) <= 30, 0.2), ((F.upper(text) == text) & text.rlike(r"\p{L}"), 0.2), (~text.rlike(r"[.!?]\s*$"), 0.1), (~text.rlike(r"^[0-9.,%\s]+$"), 0.1), ((cell == 0) & (rows > 1), 0.1)]
    return F.least(F.lit(1.0), sum((F.when(c, v).otherwise(0.0) for c, v in w), F.lit(0.0)))
