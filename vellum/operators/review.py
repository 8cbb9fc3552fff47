"""What tagging may change in a source row, and what a person should look at: list and heading styles that stay, list tags
from a row's list facts, heading variants, review flags. All are column rules; none needs an exchange.

Nulls count as absent: no tag is neither list nor heading, no level is no heading, no zone is BODY.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the tag vocabulary.
BULLET_TAG = r"(?i)(?:^|-)(?:BL|UL|TBL|TUL|BUL)\d*(?:-|$)"
NUMBER_TAG = r"(?i)(?:^|-)(?:NL|LL)\d*(?:-|$)"
HEADING_TAG = r"(?i)^(?:H[1-6]\d*|SP-H1|EOC-H1|REFH1|REF-H1|APX-H[1-3]|CS-H1|REFH2|REFH2A|REF-H2)$"
TABLE_TAGS = ("T", "T1", "T11", "T12", "T2", "T2-C", "T21", "T22", "T23", "T3", "T4", "T5", "T6", "TD", "TFN", "TSN", "T0", "T10")
TABLE_TAG_STARTS = "^(?:TH|TBL|TNL|TUL)"
REFERENCE_TAG = "^(?:REF|APX-REF)|^(?:BIB|SR|SRH1)$"
LIST_POSITION_TAG = r"^(.*?)((?:BL|NL|UL|LL)\d*)-(?:FIRST|MID|LAST)$"
HEADING_VARIANTS = {(1, "Heading 2"): "H10", (2, "Heading 3"): "H20", (2, "Heading 2"): "H21"}


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def list_family(tag: Column) -> Column:
    """bullet or numbered for list tags, else null."""
    return F.when(tag.rlike(BULLET_TAG), "bullet").when(tag.rlike(NUMBER_TAG), "numbered")


def is_table_tag(tag: Column) -> Column:
    up = F.upper(tag)
    return _sure(up.isin(*TABLE_TAGS) | up.rlike(TABLE_TAG_STARTS))


def keeps_list_style(is_list: Column, has_numbering: Column, tag: Column) -> Column:
    """Whether the source style must stay: it alone makes the row a list, and the tag isn't a list's."""
    return _sure(is_list) & ~_sure(has_numbering) & list_family(tag).isNull()


def keeps_heading_style(level: Column, tag: Column, in_table: Column, text: Column) -> Column:
    """Whether the source style of a heading (0: title) must stay. It gives way to a heading tag where the text opens with
    an inline heading marker, and to table tags in a table; a title gives way to either of these two."""
    marked = _sure(text.rlike(r"(?i)^\s*<h[1-6]\b[^>]*>") & F.trim(tag).rlike(HEADING_TAG))
    inside, table = _sure(in_table), is_table_tag(tag)
    gives = marked | F.when(level == 0, inside | table).otherwise(inside & table)
    return level.isNotNull() & ~gives


def needs_review(tag: Column, zone: Column, in_reference_zone: Column, confidence: Column, table: int = 80, references: int = 80, other: int = 85) -> Column:
    """Whether confidence (85 where there is none) lies under the bar of a table's, a reference's or another row."""
    bar = F.when(_sure(zone == "TABLE") | is_table_tag(tag), table).when(_sure(tag.rlike(REFERENCE_TAG)) | _sure(in_reference_zone) | _sure(F.upper(zone) == "REFERENCE"), references).otherwise(other)
    return F.coalesce(confidence, F.lit(85)) < bar


def list_tag(kind: Column, position: Column, zone: Column, box: Column, bulleted: Column, tag: Column) -> Column:
    """Tag of a row of a list by kind (bullet, numbered or other), zone and box; a tag with a list family of its own keeps
    what stands before it. Null without a kind or position."""
    zone = F.coalesce(zone, F.lit("BODY"))
    boxed = F.startswith(zone, F.lit("BOX_"))
    bullet, number = kind == "bullet", kind == "numbered"
    other = F.when(boxed, "UL").when(_sure(bulleted), F.when(zone == "TABLE", "TBL").otherwise("BL")).otherwise(F.when(zone == "TABLE", "TUL").otherwise("UL"))
    family = F.when(bullet, F.when(zone == "TABLE", "TBL").otherwise("BL")).when(number, F.when(zone == "TABLE", "TNL").otherwise("NL")).otherwise(other)
    plain = F.when(boxed, F.concat_ws("-", F.coalesce(box, F.lit("NBX")), family)).otherwise(family)
    own = F.coalesce(*(F.when(F.contains(tag, F.lit(f"-{x}")), F.concat(F.substring_index(tag, f"-{x}", 1), F.lit(f"-{x}"))) for x in ("BL", "NL", "UL")), plain)
    return F.when((kind != "") & (position != ""), F.concat_ws("-", own, position))


def aligned_position(tag: Column, position: Column, allowed: Column) -> Column:
    """A list tag with the position FIRST, MID or LAST of its row, or with MID where the vocabulary lacks that one; null
    where neither is allowed (an empty vocabulary allows all) or the tag has no position."""
    place = F.upper(F.trim(position))
    stem = F.concat(F.regexp_extract(tag, LIST_POSITION_TAG, 1), F.regexp_extract(tag, LIST_POSITION_TAG, 2))
    want, mid = F.concat_ws("-", stem, place), F.concat(stem, F.lit("-MID"))
    ok = lambda c: (F.size(allowed) == 0) | F.array_contains(allowed, c)
    return F.when(tag.rlike(LIST_POSITION_TAG) & place.isin("FIRST", "MID", "LAST"), F.when(ok(want), want).when(ok(mid), mid))


def heading_variant(text: Column, style: Column, zone: Column) -> Column:
    """Variant of a heading by its inline marker's level and its source style, in BODY only; else null."""
    level = F.regexp_extract(text, r"(?i)^\s*<H([1-6])>[\p{L}\p{N}_]", 1)
    out = F.lit(None).cast("string")
    for (n, name), tag in HEADING_VARIANTS.items():
        out = F.when((level == str(n)) & (style == name), tag).otherwise(out)
    return F.when(F.coalesce(zone, F.lit("BODY")) == "BODY", out)


def first_allowed(candidates: Sequence[Column], allowed: Column) -> Column:
    """The first candidate that the vocabulary has, else null."""
    return F.coalesce(*(F.when(F.array_contains(allowed, c), c) for c in candidates))
