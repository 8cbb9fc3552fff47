"""Row rewrites, gates, document scores and contracts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import sequence as seq

#: Box zones and their tag prefixes.
BOX_PREFIX = {f"BOX_{b}": b for b in ("NBX", "BX1", "BX2", "BX3", "BX4", "BX6", "BX7", "BX15", "BX16")}


def gate_rule() -> Column:
    """The first deterministic rule that settles a block, as struct (rule, tag, confidence), else null.

    Needs columns text, zone, lock_style, skip_llm, allowed_styles, caption_type, source_line, box_marker, box_label,
    box_title, marker_style (the style of a leading marker, null if it resolves to none).
    """
    out = lambda rule, tag, conf: F.struct(F.lit(rule).alias("rule"), (tag if isinstance(tag, Column) else F.lit(tag)).alias("tag"), F.lit(conf).alias("confidence"))
    first = F.try_element_at("allowed_styles", F.lit(1))
    text = F.coalesce("text", F.lit(""))
    bare = T.strip(text)
    zone = F.coalesce("zone", F.lit("BODY"))
    prefix = F.create_map(*(F.lit(x) for kv in BOX_PREFIX.items() for x in kv))[zone]
    table = zone == "TABLE"
    return (
        F.when(F.col("lock_style") & first.isNotNull(), out("locked-style", first, 99))
        .when(F.col("skip_llm"), out("skip", F.coalesce(first, F.lit("PMI")), 99))
        .when((bare == "") & table, out("empty-table", "T", 99))
        .when(bare == "", out("empty", "PMI", 99))
        .when(T.marker_token(text).isNotNull() & F.col("marker_style").isNotNull(), out("marker", F.col("marker_style"), 99))
        .when(T.marker_only(text), out("marker-only", "PMI", 99))
        .when(F.col("caption_type") == "table", out("table-caption", "T1", 99))
        .when(F.col("caption_type") == "figure", out("figure-caption", "FIG-LEG", 99))
        .when(F.col("source_line"), out("source-line", "TSN", 99))
        .when(F.col("box_marker").isin("start", "end"), out("box-marker", "PMI", 99))
        .when(F.col("box_label").isNotNull() & prefix.isNotNull(), out("box-label", F.concat(prefix, F.lit("-TYPE")), 95))
        .when(F.col("box_title") & prefix.isNotNull(), out("box-title", F.concat(prefix, F.lit("-TTL")), 95))
        .when(table & T.is_source_line(bare), out("table-source", "TSN", 95))
        .when(table & T.is_table_note(bare), out("table-footnote", "TFN", 95))
        .when((F.length(bare) <= 2) & ~bare.rlike(r"\p{L}"), out("short-token", "PMI", 90))
    )


def gated(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settled rows with rule, tag and confidence; rows that need a model)."""
    marked = blocks.withColumn("gate", gate_rule())
    return marked.filter(F.col("gate").isNotNull()).select("*", "gate.*").drop("gate"), marked.filter(F.col("gate").isNull()).drop("gate")


def review_split(df: DataFrame, threshold: float = 85) -> DataFrame:
    """Whether a row needs review: confidence below the threshold."""
    return df.withColumn("needs_review", F.col("confidence") < threshold)


def zone_allowed(zone: Column, tag: Column, styles: DataFrame, df: DataFrame) -> DataFrame:
    """``zone_ok``: the zone has no list, or the tag (as it is, or without trailing digits) is on it."""
    s = styles.select(F.col("zone").alias("__z"), F.col("style").alias("__s"))
    lists = s.groupBy("__z").agg(F.collect_set("__s").alias("__list"))
    out = df.withColumns({"__zone": zone, "__tag": tag}).join(lists, F.col("__zone") == F.col("__z"), "left")
    ok = F.col("__list").isNull() | F.array_contains("__list", F.col("__tag")) | F.array_contains("__list", F.regexp_replace("__tag", "[0-9]+$", ""))
    return out.withColumn("zone_ok", ok).drop("__zone", "__tag", "__z", "__list")


def half_even_percent(x: Column) -> Column:
    """Clamped to 0..100, rounded half to even."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.bround(x))).cast("int")


def document_score(df: DataFrame, doc: seq.Names, pos: seq.Names, tag: str, known: Column, confidence: str, low: float, level: Column, table_tag: Column, source_tag: Column) -> DataFrame:
    """Quality of each document: 100 less weighted shares of unknown tags, low confidences and violations, and what to
    do with it (PASS from 85, RETRY from 70, else REVIEW). ``level``: heading level of a row or null."""
    df = df.withColumns({"__level": level, "__known": known})
    df = seq.hierarchy_violations(df, doc, pos, "__level")
    df = df.withColumn("__lonely", source_tag & ~seq.neighbour_exists(table_tag, doc, pos, 3))
    n = df.groupBy(*seq.cols(doc)).agg(
        F.count("*").alias("rows"), F.count_if(~F.col("__known")).alias("unknown"), F.count_if(F.col(confidence) < low).alias("low"),
        F.count_if("orphan").alias("orphans"), F.count_if("__lonely").alias("lonely"),
    )
    share = lambda c, w: F.least(F.lit(float(w)), F.col(c) / F.col("rows") * 100 * w / 40)
    score = half_even_percent(100 - share("unknown", 40) - share("low", 20) - F.least(F.lit(20), F.col("orphans") * 2) - F.least(F.lit(20), F.col("lonely")))
    n = n.withColumn("score", score)
    action = F.when((F.col("score") >= 85) & (F.col("unknown") == 0), "PASS").when((F.col("score") >= 70) & (F.col("unknown") == 0), "RETRY").otherwise("REVIEW")
    return n.withColumn("action", action)


def unknown_styles(df: DataFrame, tag: str, known: DataFrame, k: int) -> DataFrame:
    """Tags outside the vocabulary, the k most frequent."""
    return df.join(known.select(F.col("style").alias(tag)), tag, "left_anti").groupBy(tag).agg(F.count("*").alias("n")).orderBy(F.desc("n"), tag).limit(k)


def signature(df: DataFrame, doc: Sequence[str], order: Sequence[str], parts: Sequence[str]) -> DataFrame:
    """SHA-256 over a document's ordered rows. The order columns must be unique within a document."""
    row = F.struct(*order, F.concat_ws("|", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts)).alias("__row"))
    lines = F.transform(F.array_sort(F.collect_list(row)), lambda r: r["__row"])
    return df.groupBy(*doc).agg(F.sha2(F.array_join(lines, "\n"), 256).alias("signature"), F.count("*").alias("rows"))


def token_loss(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """Distinct tokens and lines that ``after`` lacks, and the loss in percent: distinct missing tokens over all tokens."""
    lines = lambda c: F.filter(F.transform(F.split(c, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    # each array once: the counts below read columns, not expressions that would be evaluated again
    # as hashes: set operations on arrays of longs take a hash set, those on strings compare each with each
    hashed = lambda a: F.transform(a, lambda x: F.xxhash64(x))
    df = df.withColumns({"__a": hashed(T.tokens(before)), "__b": hashed(T.tokens(after)), "__la": hashed(lines(before)), "__lb": hashed(lines(after))})
    df = df.withColumns({
        "tokens": F.size("__a").cast("long"), "missing_tokens": F.size(F.array_except("__a", "__b")).cast("long"), "extra_tokens": F.size(F.array_except("__b", "__a")).cast("long"),
        "missing_lines": F.size(F.array_except(F.array_distinct("__la"), "__lb")).cast("long"),
    })
    loss = F.when(F.col("tokens") > 0, F.round(F.col("missing_tokens") / F.col("tokens") * 100, 4)).otherwise(F.lit(0.0))
    return df.withColumn("loss_percent", loss).drop("__a", "__b", "__la", "__lb")


def contract(before: DataFrame, after: DataFrame, key: Sequence[str], text: str | None) -> DataFrame:
    """Violations of a stage's contract: rows lost, added, or (with ``text``) changed."""
    x = before.select(*key, F.lit(1).alias("__b"), *([F.col(text).alias("__t")] if text else []))
    y = after.select(*key, F.lit(1).alias("__a"), *([F.col(text).alias("__u")] if text else []))
    kind = F.when(F.col("__a").isNull(), "lost").when(F.col("__b").isNull(), "added")
    if text:
        kind = kind.when(~F.col("__t").eqNullSafe(F.col("__u")), "text changed")
    return x.join(y, list(key), "full").select(*key, kind.alias("violation")).filter(F.col("violation").isNotNull())


def staged(df: DataFrame, stage: Callable[[DataFrame], DataFrame], key: Sequence[str], text: str | None) -> DataFrame:
    """Run a stage under its contract; a row that breaks it raises when the result is computed."""
    out = stage(df)
    bad = contract(df, out, key, text).agg(F.count("*").alias("__bad"))
    return out.crossJoin(bad).filter(F.coalesce(F.assert_true(F.col("__bad") == 0, F.lit("stage contract broken")).isNull(), F.lit(True))).drop("__bad")  # one row


def profile(share: dict[str, Column], rules: Sequence[tuple[str, str, float]], default: str) -> Callable[[DataFrame, Sequence[str]], DataFrame]:
    """Route groups to a profile by shares of flags: first rule (profile, flag, least share) that holds."""

    def run(df: DataFrame, by: Sequence[str]) -> DataFrame:
        n = df.groupBy(*by).agg(*(F.avg(c.cast("int")).alias(k) for k, c in share.items()))
        out = F.lit(default)
        for name, flag, least in reversed(rules):
            out = F.when(F.col(flag) >= least, name).otherwise(out)
        return n.withColumn("profile", out)

    return run


def pattern_counts(df: DataFrame, text: str, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(rule, matches, distinct matches, rows) for each pattern. A row sends each of its matches once, and one record with
    their number; these add up by (rule, match) before they are shuffled, so each text is read once and no set of rows is
    kept."""
    each = F.array(*(F.struct(F.lit(n).alias("rule"), F.regexp_extract_all(text, F.lit(p), 0).alias("found")) for n, p in rules))
    said = df.select(F.explode(each).alias("r")).select("r.*").filter(F.size("found") > 0)
    record = lambda match, n: F.struct(match.alias("match"), n.cast("long").alias("n"))
    sent = F.concat(F.array(record(F.lit(None).cast("string"), F.size("found"))), F.transform(F.array_distinct("found"), lambda m: record(m, F.lit(0))))
    met = said.select("rule", F.explode(sent).alias("m")).groupBy("rule", "m.match").agg(F.sum("m.n").alias("n"), F.count("*").alias("rows"))
    whole = F.col("match").isNull()
    return met.groupBy("rule").agg(F.sum("n").alias("matches"), F.count("match").alias("distinct_matches"), F.max(F.when(whole, F.col("rows"))).alias("rows"))


def latest(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key: an aggregate with map-side combine, no window."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r")).select(*key, "__r.*")


def islands_text(df: DataFrame, doc: Sequence[str], pos: str, key: str, text: str, glue: str) -> DataFrame:
    """Texts of contiguous rows with one key, joined in order."""
    df = df.withColumn("__run", seq.run_id(doc, pos, key))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda r: r[text]), glue)
    return df.groupBy(*doc, key, "__run").agg(F.min(pos).alias(pos), joined.alias(text)).drop("__run")


def windowed_rank(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
