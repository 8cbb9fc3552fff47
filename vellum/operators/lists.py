"""Lists in ordered rows: what makes a row an item, its level by indent, promotion under a parent item, parent links.

Levels come from the paragraph's list level, else its indent, else white space before the text, never from the bullet's
shape. Promotion is a state machine; parent links are running maxima by level, carried from chunk to chunk of a document,
so both are linear and neither needs a document in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import stages, statescan
from .sequence import Names, cols

# Bullets, number formats in the order they are tried, and beginnings of items that others hang on.
BULLETS = "●•·○◦◯■▪□▲△►▸◆◇❖✓✔☑➢➤→▶★☆─–—-" "\uf0b7\uf0a7\uf0d8\uf076\uf0fc"  # the last five: symbol fonts
NUMBER_FORMATS = {
    "decimal": r"^\d+\.\s", "decimal_paren": r"^\d+\)\s", "decimal_both": r"^\(\d+\)\s", "upper_alpha": r"^[A-Z]\.\s", "lower_alpha": r"^[a-z]\.\s", "lower_alpha_paren": r"^[a-z]\)\s",
    "upper_roman": r"^[IVXLCDM]+\.\s", "lower_roman": r"^[ivxlcdm]+\.\s",
}
PARENT_STARTS = (
    r"grading\b", r"work-?up\b", r"diagnosis\s*:", r"symptoms\s*:", r"classification\s*:", r"characteristics\s*:", r"second-?line\s+therap", r"third-?line", r"differential\s+diagnosis", r"management\s*:",
    r"treatment\s*:", r"types\s*:", r"categories\s*:",
)
_BULLET = "[" + BULLETS.replace("-", r"\-") + "]"


def bullet(text: Column) -> Column:
    """The bullet that a text begins with (an o before white space counts as a circle), else null."""
    t = F.regexp_replace(text, r"^\s+", "")
    found = F.regexp_extract(t, f"^{_BULLET}", 0)
    return F.when(found != "", found).when(t.rlike(r"^o[ \t]"), "○")


def number_format(text: Column) -> Column:
    t = F.regexp_replace(text, r"^\s+", "")
    return F.coalesce(*(F.when(t.rlike(p), F.lit(name)) for name, p in NUMBER_FORMATS.items()))


def is_parent(text: Column) -> Column:
    """Whether items may hang on this one: by its first words, a short text that ends in a colon, or a class in brackets."""
    bare = F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), rf"^{_BULLET}\s*", "")
    bare = F.regexp_replace(bare, r"^[\p{L}\p{N}_]+[.)]\s*", "")
    return F.lower(T.strip(bare)).rlike("^(?:" + "|".join(PARENT_STARTS) + ")") | ((F.length(bare) < 60) & bare.rlike(r":\s*$")) | bare.rlike(r"\([A-Z]+\s*[\d.]+\)\s*$")


def items(df: DataFrame, text: str = "text") -> DataFrame:
    """Facts of each row: is_list, bullet, number_format, is_numbered, indent_level, indent_source, is_trigger. Uses the
    columns ilvl, indent, has_bullet, has_numbering, has_xml_list where the table has them; null for rows of no list."""
    given = lambda c, kind: F.col(c).cast(kind) if c in df.columns else F.lit(None).cast(kind)
    t, sure = F.coalesce(F.col(text), F.lit("")), lambda c: F.coalesce(c, F.lit(False))
    xml = sure(given("has_bullet", "boolean")) | sure(given("has_numbering", "boolean")) | sure(given("has_xml_list", "boolean"))
    df = df.withColumns({"bullet": bullet(t), "number_format": number_format(t)})
    on = (T.strip(t) != "") & (F.col("bullet").isNotNull() | F.col("number_format").isNotNull() | xml)
    space = F.regexp_extract(t, r"^[\t ]*", 0)
    tabs = F.length(space) - F.length(F.translate(space, "\t", ""))
    ilvl = given("ilvl", "int")
    level = F.coalesce(F.when(ilvl.isNotNull(), F.least(ilvl, F.lit(2))), stages.indent_level(given("indent", "int")), stages.whitespace_level(tabs, F.length(space) - tabs))
    source = F.when(ilvl.isNotNull(), "ooxml_ilvl").when(given("indent", "int").isNotNull(), "ooxml_ind").otherwise("text_whitespace")
    return df.withColumns({
        "is_list": on, "bullet": F.when(on, F.col("bullet")), "number_format": F.when(on, F.col("number_format")), "is_numbered": F.when(on, F.col("number_format").isNotNull() | sure(given("has_numbering", "boolean"))),
        "indent_level": F.when(on, level.cast("int")), "indent_source": F.when(on, source), "is_trigger": F.when(on, is_parent(t)),
    })


def _promotion(parent: int | None, symbol: tuple) -> tuple[int | None, int | None]:
    """State: level of the active parent item. Symbol: (level or null, trigger, heading)."""
    level, trigger, heading = symbol
    if heading:
        return None, level
    if level is None:
        return parent, None
    if level == 0:
        return (0 if trigger else None), 0
    if level == 1 and trigger:
        return 1, 1
    return parent, 2 if level == 1 and parent == 1 else level


def hierarchy(df: DataFrame, doc: Names, pos: Names, heading: Column, text: str = "text", chunk: Column | None = None) -> DataFrame:
    """``items`` with semantic_level (level-1 items under a level-1 parent item become level 2, up to the next level-0
    item or heading) and list_style_prefix. ``heading``: rows that end what came before."""
    df = items(df, text).withColumn("__heading", F.coalesce(heading, F.lit(False)))
    symbols = [(n, t, h) for n in (None, 0, 1, 2) for t in (False, True) for h in (False, True)]
    number = (F.coalesce(F.col("indent_level") + 1, F.lit(0)) * 2 + F.coalesce("is_trigger", F.lit(False)).cast("int")) * 2 + F.col("__heading").cast("int")
    machine = statescan.Machine([None, 0, 1], symbols, _promotion)
    df = statescan.scanned(df, doc, pos, number, machine, "__state", chunk)
    df = df.withColumn("semantic_level", machine.output(number, F.col("__state"), "int"))
    family = F.when(F.col("is_numbered"), "NL").otherwise("BL")
    prefix = F.concat(family, F.when(F.col("semantic_level") == 0, "").otherwise((F.col("semantic_level") + 1).cast("string")), F.lit("-"))
    return df.withColumn("list_style_prefix", F.when(F.col("is_list"), prefix)).drop("__state", "__heading")


def parents(df: DataFrame, doc: Names, pos: str, level: str, most: int, name: str = "parent", chunk: Column | None = None) -> DataFrame:
    """Place (``pos``) of the nearest earlier row with a smaller level, for levels 0 to ``most``; null where there is
    none. A chunk's last place of each level is carried to the chunks after it."""
    chunk = F.floor(F.col(pos) / statescan.CHUNK) if chunk is None else chunk
    by = cols(doc)
    df = df.withColumns({"__doc": F.to_json(F.struct(*by)), "__chunk": chunk.cast("long")})
    at = lambda n: F.max(F.when(F.col(level) == n, F.col(pos)))
    ends = df.groupBy("__doc", "__chunk").agg(*(at(n).alias(f"__last_{n}") for n in range(most)))
    earlier = Window.partitionBy("__doc").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("__doc", "__chunk", *(F.max(f"__last_{n}").over(earlier).alias(f"__last_{n}") for n in range(most)))
    within = Window.partitionBy("__doc", "__chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumns({f"__near_{n}": at(n).over(within) for n in range(most)}).join(ends, ["__doc", "__chunk"])
    pick = F.lit(None).cast(df.schema[pos].dataType)
    for n in range(most + 1):
        below = [F.col(f"__{kind}_{m}") for m in range(n) for kind in ("near", "last")]
        pick = F.when(F.col(level) == n, F.greatest(*below) if below else F.lit(None)).otherwise(pick)
    return df.withColumn(name, pick).drop("__doc", "__chunk", *(f"__{kind}_{n}" for n in range(most) for kind in ("near", "last")))
