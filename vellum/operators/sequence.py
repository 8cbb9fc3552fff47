"""Ordered-state operators: windows over rows (document, position).

All of them use windows partitioned by the document and ordered by the position, so Catalyst shares one exchange
and one sort among operators chained on the same keys. Order columns must be unique within a document.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

Names = str | Sequence[str]


def cols(names: Names) -> list[str]:
    return [names] if isinstance(names, str) else list(names)


def ordered(doc: Names, pos: Names) -> WindowSpec:
    return Window.partitionBy(*cols(doc)).orderBy(*cols(pos))


def before(doc: Names, pos: Names) -> WindowSpec:
    """All earlier rows of the document."""
    return ordered(doc, pos).rowsBetween(Window.unboundedPreceding, -1)


def so_far(doc: Names, pos: Names) -> WindowSpec:
    """All rows up to this one."""
    return ordered(doc, pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def lag_reset(tag: Column, mapped: Column, doc: Names, pos: Names) -> Column:
    """Tag of the row before, null if that row isn't mapped."""
    w = ordered(doc, pos)
    return F.when(F.lag(mapped).over(w), F.lag(tag).over(w))


def carried(tag: Column, mapped: Column, doc: Names, pos: Names, start: str = "START") -> Column:
    """The last mapped tag before this row, past rows that aren't mapped."""
    return F.coalesce(F.last(F.when(mapped, tag), ignorenulls=True).over(before(doc, pos)), F.lit(start))


def context_carry(df: DataFrame, doc: Names, pos: Names, tag: str, mapped: Column) -> DataFrame:
    return df.withColumn("prev_tag", carried(F.col(tag), mapped, doc, pos))


def context_lag_lead(df: DataFrame, doc: Names, pos: Names, tag: str) -> DataFrame:
    """Neighbours' tags as they are, with START and END at the edges."""
    w = ordered(doc, pos)
    return df.withColumns({"prev_tag": F.lag(tag, 1, "START").over(w), "next_tag": F.lead(tag, 1, "END").over(w)})


def place_name(rank: Column, size: Column) -> Column:
    """FIRST, MID or LAST; a run of one is FIRST."""
    return F.when(rank == 1, "FIRST").when(rank == size, "LAST").otherwise("MID")


def run_positions(df: DataFrame, doc: Names, pos: Names, key: str) -> DataFrame:
    """Position within contiguous runs of equal keys, and whether the run is a singleton."""
    df = df.withColumn("run_id", run_id(doc, pos, key))
    part = Window.partitionBy(*cols(doc), "run_id")
    size = F.count(F.lit(1)).over(part)
    rank = F.row_number().over(part.orderBy(*cols(pos)))
    return df.withColumns({"list_position": place_name(rank, size), "singleton": size == 1})


def run_id(doc: Names, pos: Names, key: str) -> Column:
    """Names the run of equal keys that a row is in: the key, and its rank in the document less its rank among the
    key's rows (gaps and islands, without a window inside a window)."""
    step = F.row_number().over(ordered(doc, pos)) - F.row_number().over(Window.partitionBy(*cols(doc), key).orderBy(*cols(pos)))
    return F.struct(F.col(key), step.alias("step"))


def partition_positions(df: DataFrame, doc: Names, pos: Names, key: Names) -> DataFrame:
    """Position among all rows of a key, contiguous or not."""
    part = Window.partitionBy(*cols(doc), *cols(key))
    return df.withColumn("list_position", place_name(F.row_number().over(part.orderBy(*cols(pos))), F.count(F.lit(1)).over(part)))


def neighbour_exists(flag: Column, doc: Names, pos: Names, reach: int) -> Column:
    """Whether some other row within ``reach`` places has the flag."""
    w = ordered(doc, pos)
    return F.coalesce(F.bool_or(flag).over(w.rowsBetween(-reach, -1)), F.lit(False)) | F.coalesce(F.bool_or(flag).over(w.rowsBetween(1, reach)), F.lit(False))


def hierarchy_violations(df: DataFrame, doc: Names, pos: Names, level: str) -> DataFrame:
    """Level-2 headings before any level 1, level-3 headings without a level 2 since the last level 1, and jumps of
    more than one level from the heading before. ``level``: null for rows that aren't headings."""
    earlier = before(doc, pos)
    order = F.row_number().over(ordered(doc, pos))
    df = df.withColumn("__order", order)
    last = lambda n: F.max(F.when(F.col(level) == n, F.col("__order"))).over(earlier)
    previous = F.last(level, ignorenulls=True).over(earlier)
    bad2 = (F.col(level) == 2) & last(1).isNull()
    bad3 = (F.col(level) == 3) & (last(2).isNull() | (last(2) < F.coalesce(last(1), F.lit(0))))
    jump = F.col(level) > previous + 1
    return df.withColumns({"orphan": F.coalesce(bad2 | bad3, F.lit(False)), "level_jump": F.coalesce(jump, F.lit(False))}).drop("__order")


def carry_forward(value: Column, doc: Names, pos: Names) -> Column:
    """The last value that isn't null, this row's included."""
    return F.last(value, ignorenulls=True).over(so_far(doc, pos))


def appearance_rank(df: DataFrame, doc: Names, pos: str, item: str) -> DataFrame:
    """Rank of each item by its first appearance, and whether the item's own number differs from it."""
    first = df.groupBy(*cols(doc), item).agg(F.min(pos).alias("first_pos"))
    rank = F.row_number().over(Window.partitionBy(*cols(doc)).orderBy("first_pos", item)).cast("long")
    return first.withColumn("appearance", rank).withColumn("sequence_issue", F.col(item) != F.col("appearance"))


def page_estimate(df: DataFrame, doc: Names, pos: Names, words: str, words_per_page: int) -> DataFrame:
    """Page on which a row begins, from the words before it (at least page 1)."""
    total = F.coalesce(F.sum(words).over(before(doc, pos)), F.lit(0))
    return df.withColumns({"words_before": total, "page": F.greatest(F.lit(1), F.ceil(total / words_per_page)).cast("long")})


def sections(df: DataFrame, doc: Names, pos: Names, heading: Column) -> DataFrame:
    """Number of the section of a row: headings so far."""
    return df.withColumn("section", F.sum(F.when(heading, 1).otherwise(0)).over(so_far(doc, pos)))


def section_list_positions(df: DataFrame, doc: Names, pos: Names, heading: Column, item: Column) -> DataFrame:
    """First, middle and last items of each section."""
    df = sections(df, doc, pos, heading).withColumn("__item", item)
    part = Window.partitionBy(*cols(doc), "section", "__item")
    return df.withColumn("list_position", F.when(F.col("__item"), place_name(F.row_number().over(part.orderBy(*cols(pos))), F.count(F.lit(1)).over(part)))).drop("__item")


def after_heading(heading: Column, doc: Names, pos: Names) -> Column:
    """First row after a heading, itself no heading."""
    return F.coalesce(F.lag(heading).over(ordered(doc, pos)), F.lit(False)) & ~heading


def usage_number(doc: Names, item: Names, pos: Names) -> Column:
    """1 for the first usage of an item, 2 for the second ..."""
    return F.row_number().over(Window.partitionBy(*cols(doc), *cols(item)).orderBy(*cols(pos))).cast("long")


def order_issues(df: DataFrame, doc: Names, pos: Names, key: str) -> DataFrame:
    """Rows that sort before their predecessor, and repeats of an earlier key."""
    previous = F.lag(key).over(ordered(doc, pos))
    return df.withColumns({"out_of_order": F.coalesce(F.col(key) < previous, F.lit(False)), "repeat": usage_number(doc, key, pos) > 1})


def renumbered(df: DataFrame, doc: Names, pos: Names, label: str, least: int) -> DataFrame:
    """Labels 1, 2, ... in order where a document has at least ``least``; ``changed`` marks rows whose label differs."""
    part = Window.partitionBy(*cols(doc))
    enough = F.count(label).over(part) >= least
    number = F.when(F.col(label).isNotNull() & enough, F.sum(F.col(label).isNotNull().cast("long")).over(so_far(doc, pos)))
    return df.withColumn("new_label", F.coalesce(number, F.col(label).cast("long"))).withColumn("changed", ~F.col("new_label").eqNullSafe(F.col(label).cast("long")))


def last_event(event: Column, doc: Names, pos: Names, include: bool = True) -> Column:
    """The state that the last start or stop event set; null before any."""
    return F.last(event, ignorenulls=True).over(so_far(doc, pos) if include else before(doc, pos))


def forward_first(value: Column, doc: Names, pos: Names, reach: int) -> Column:
    """First value that isn't null among the next ``reach`` rows."""
    return F.first(value, ignorenulls=True).over(ordered(doc, pos).rowsBetween(1, reach))


def adjacent_pairs(df: DataFrame, doc: Names, pos: Names, text: str) -> DataFrame:
    """All texts, and all texts of two adjacent rows joined by a space."""
    more = df.withColumn("__next", F.lead(text).over(ordered(doc, pos))).filter(F.col("__next").isNotNull()).withColumn(text, F.concat_ws(" ", text, "__next")).drop("__next")
    return df.unionByName(more)


def reference_zone_end(df: DataFrame, doc: Names, pos: Names, hit: Column, streak: int) -> DataFrame:
    """Rows of a zone up to the last hit before ``streak`` misses in a row: ``in_zone``."""
    df = df.withColumn("__hits", F.sum(hit.cast("int")).over(so_far(doc, pos)))
    misses = F.row_number().over(Window.partitionBy(*cols(doc), "__hits").orderBy(*cols(pos))) - 1
    df = df.withColumn("__misses", misses)
    ended = F.coalesce(F.bool_or(F.col("__misses") >= streak).over(so_far(doc, pos)), F.lit(False))
    return df.withColumn("in_zone", ~ended & (F.col("__hits") > 0)).drop("__hits", "__misses")


def between(df: DataFrame, doc: Names, pos: Names, opens: Column, closes: Column) -> DataFrame:
    """Rows inside open and close rows (both kept), by the running balance; nested ones count as inside."""
    w = so_far(doc, pos)
    opened = F.sum(F.when(opens, 1).otherwise(0)).over(w)
    closed = F.sum(F.when(closes, 1).otherwise(0)).over(before(doc, pos))
    return df.withColumn("__open", opened - F.coalesce(closed, F.lit(0))).filter(F.col("__open") > 0).drop("__open")


def unexpected_levels(df: DataFrame, doc: Names, pos: Names, level: str) -> DataFrame:
    """Headings whose next outer level never came before: ``missing`` is that level, else null."""
    seen = F.collect_set(level).over(before(doc, pos))
    need = F.col(level) - 1
    return df.withColumn("missing", F.when((need >= 1) & ~F.array_contains(seen, need), need))


def reference_zone(df: DataFrame, doc: Names, pos: Names, heading: Column, secondary: Column, like: Column, streak: int = 15, hits: int = 3) -> DataFrame:
    """``in_zone``: rows of a document's list of references.

    It starts after the first heading; without one, after a secondary heading in the last quarter that at least 3 of
    the next 5 rows bear out. After ``hits`` rows that read like references it ends where ``streak`` others in a row
    are complete."""
    whole = Window.partitionBy(*cols(doc))
    w = ordered(doc, pos)
    df = df.withColumns({"__r": F.row_number().over(w), "__n": F.count(F.lit(1)).over(whole), "__like": F.coalesce(like, F.lit(False)), "__head": F.coalesce(heading, F.lit(False))})
    df = df.withColumn("__late", F.coalesce(secondary, F.lit(False)) & (F.col("__r") > 0.75 * F.col("__n")) & (F.coalesce(F.sum(F.col("__like").cast("int")).over(w.rowsBetween(1, 5)), F.lit(0)) >= 3))
    first = lambda c: F.min(F.when(F.col(c), F.col("__r"))).over(whole)
    df = df.withColumn("__start", F.coalesce(first("__head"), first("__late")))
    df = df.withColumn("__in", F.coalesce(F.col("__r") > F.col("__start"), F.lit(False)))
    df = df.withColumn("__hits", F.sum((F.col("__in") & F.col("__like")).cast("int")).over(so_far(doc, pos)))
    misses = F.row_number().over(Window.partitionBy(*cols(doc), "__in", "__hits").orderBy(*cols(pos))) - 1  # the first row of such a group is the hit
    df = df.withColumn("__done", F.col("__in") & (F.col("__hits") >= hits) & (misses >= streak))
    ended = F.coalesce(F.bool_or("__done").over(so_far(doc, pos)), F.lit(False))
    return df.withColumn("in_zone", F.col("__in") & ~ended).drop("__r", "__n", "__like", "__head", "__late", "__start", "__in", "__hits", "__done")
