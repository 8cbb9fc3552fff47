"""Boxes and their credits in ordered rows, for a permission log.

A tagged box runs from its start tag to its end tag, the next start or a chapter, whichever comes first; its title is the
first line, its credit the first later line that has one. A credit line that stands alone closes an untagged box whose
title is looked for in the rows before, unless the line belongs to a table or a caption. All by windows over the document's order: span
numbers, running flags and frames of fixed reach; a box is summed up by group, so no box is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as T
from .sequence import Names, cols

# Tags, patterns and reaches of the rules.
START = r"(?i)\\?<BX(?:-TITLE)?>"
END = r"(?i)\\?</BX>"
CHAPTER = r"(?i)^(chapter\s+\d+|\d+\.\s+[A-Z][A-Za-z ].+)"
CREDIT_ALONE = (
    r"(?i)^[*_]?\s*(sources?|information\s+from|data\s+from|adapted\s+(?:with\s+permission\s+)?from|modified\s+(?:with\s+permission\s+)?from|reproduced\s+(?:with\s+permission\s+)?from|reprinted\s+(?:with\s+permission\s+)?from)\b"
)
ITEM = r"(Figures?|Figs?\.?|Tables?|Tabs?\.?|Boxes?|Images?|Imgs?\.?|Photos?|Illustrations?)"
CAPTION = rf"(?i)^\(?{ITEM}\.?(\s*[0-9]+([.\-][0-9]+)*[A-Za-z]?(\)|\b)|\s|$)"
LAST_ROW_CREDIT = r"(?i)(reprinted|adapted|modified|reproduced|source[s]?[:\s]|from\s|courtesy|copyright|©|https?://|doi\.)"
TITLE_REACH, CAPTION_REACH, TABLE_REACH, TITLE_CHARS = 14, 10, 14, 200


def is_caption(text: Column) -> Column:
    return text.rlike(CAPTION)


def _credit(text: Column) -> Column:
    return F.nullif(F.regexp_replace(checks.split_credit(text)["credit"], r"^[*_]+|[*_]+$", ""), F.lit(""))


def tagged(df: DataFrame, doc: Names, pos: Names) -> DataFrame:
    """(doc, pos of the start, caption, credit) of tagged boxes that have both."""
    by, at = cols(doc), cols(pos)
    text = F.coalesce("text", F.lit(""))
    df = df.select(*by, *at, text.alias("text"), text.rlike(START).alias("__start"))
    df = df.withColumn("__span", F.sum(F.col("__start").cast("int")).over(Window.partitionBy(*by).orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy(*by, "__span").orderBy(*at).rowsBetween(Window.unboundedPreceding, 0)
    df = df.filter(F.col("__span") > 0).withColumn("__over", F.bool_or(F.col("text").rlike(END) | (F.col("text").rlike(CHAPTER) & ~F.col("__start"))).over(inside))
    line = T.strip(F.regexp_replace(F.regexp_replace("text", START, ""), END, ""))
    df = df.withColumn("__line", F.when(~F.col("__over") & (line != ""), line))
    place = F.struct(*at)
    # the first line is the title: only rows after it can hold the credit
    df = df.withColumn("__later", F.count("__line").over(inside) > 1)
    credit = F.when(F.col("__later") & F.col("__line").isNotNull(), _credit(F.col("__line")))
    df = df.withColumn("__credit", credit)
    out = df.groupBy(*by, "__span").agg(
        F.min(place).alias("__at"), F.min_by("__line", F.when(F.col("__line").isNotNull(), place)).alias("caption"), F.min_by("__credit", F.when(F.col("__credit").isNotNull(), place)).alias("credit")
    )
    caption = T.strip(F.regexp_replace("caption", r"^[*_]+|[*_]+$", ""))
    return out.select(*by, "__at.*", caption.alias("caption"), "credit").filter((F.col("caption") != "") & F.col("credit").isNotNull())


def untagged(df: DataFrame, doc: Names, pos: Names) -> DataFrame:
    """(doc, pos of the credit line, caption, credit) of boxes known by a credit that stands alone. Columns before_table and
    after_table say whether a table is the next or previous element."""
    by, at = cols(doc), cols(pos)
    text = F.coalesce("text", F.lit(""))
    order = Window.partitionBy(*by).orderBy(*at)
    df = df.select(*by, *at, text.alias("text"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("before_table", "after_table")))
    bare = T.strip(F.regexp_replace(T.strip(F.col("text")), r"^[*_]+|[*_]+$", ""))
    df = df.withColumns({"__bare": bare, "__caption": is_caption(F.col("text")), "__chapter": F.col("text").rlike(CHAPTER)})
    ahead = F.first(F.when(F.col("before_table") | F.col("__caption") | F.col("__chapter"), F.col("before_table")), ignorenulls=True).over(order.rowsBetween(1, TABLE_REACH))
    stop = F.col("__bare").rlike(CHAPTER) | is_caption(F.col("__bare")) | F.col("__bare").rlike(CREDIT_ALONE)
    seen = F.when(F.col("__bare") != "", F.when(stop, F.lit("")).when(F.length("__bare") <= TITLE_CHARS, F.col("__bare")))
    df = df.withColumns({
        "__footnote": F.col("after_table") | F.coalesce(ahead, F.lit(False)), "__captioned": F.coalesce(F.bool_or("__caption").over(order.rowsBetween(-CAPTION_REACH, -1)), F.lit(False)),
        "caption": F.last(seen, ignorenulls=True).over(order.rowsBetween(-TITLE_REACH, -1)),
    })
    df = df.filter(F.col("text").rlike(CREDIT_ALONE) & ~F.col("text").rlike(START) & ~F.col("__footnote") & ~F.col("__captioned") & (F.col("caption") != ""))
    return df.select(*by, *at, "caption", _credit(F.col("text")).alias("credit")).filter(F.col("credit").isNotNull())


def boxes(df: DataFrame, doc: Names, pos: Names) -> DataFrame:
    """All boxes (doc, pos, caption, credit, tagged, needs_permission) of rows (doc, pos, text, before_table, after_table)."""
    out = tagged(df, doc, pos).withColumn("tagged", F.lit(True)).unionByName(untagged(df, doc, pos).withColumn("tagged", F.lit(False)))
    return out.withColumn("needs_permission", T.needs_permission(F.col("caption"), F.col("credit")))


def scan_rows(paragraphs: DataFrame) -> DataFrame:
    """Rows of word files (``docx.parsed``) in document order, as a permission log reads them: (doc, pos, text, is_table,
    before_table, after_table, in_box). Blank rows are left out."""
    rows = paragraphs.filter(T.strip(F.col("text")) != "").withColumn("text", T.strip(F.col("text")))
    tables = paragraphs.filter("is_table").select("doc", F.col("body_pos").alias("__table")).distinct()
    before = tables.select("doc", (F.col("__table") - 1).alias("body_pos"), F.lit(True).alias("__before"))
    after = tables.select("doc", (F.col("__table") + 1).alias("body_pos"), F.lit(True).alias("__after"))
    rows = rows.join(before, ["doc", "body_pos"], "left").join(after, ["doc", "body_pos"], "left")
    order = Window.partitionBy("doc").orderBy("body_pos", "id")
    beside = lambda c: ~F.col("is_table") & F.coalesce(c, F.lit(False))
    rows = rows.withColumns({"pos": F.row_number().over(order) - 1, "before_table": beside("__before"), "after_table": beside("__after")})
    opens, closes = F.col("text").rlike(r"(?i)<BX[^/>\s]*>"), F.col("text").rlike(r"(?i)</BX>")
    inside = F.last(F.when(opens, True).when(closes, False), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("doc", "pos", "text", "is_table", "before_table", "after_table", F.coalesce(inside, F.lit(False)).alias("in_box"))
