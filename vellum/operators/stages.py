"""Row-rewrite stages: each takes tagged rows and returns the same rows with tags, locks or flags set anew.

A stage is one projection (plus a window or a small join where noted), so stages chain without further exchanges.
Neighbour rules read the tags as they were when the stage began.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import sequence as seq

#: Fixed values of the tag vocabulary.
ZONE_FALLBACK = {
    "METADATA": "PMI", "FRONT_MATTER": "TXT", "TABLE": "T", "BOX_NBX": "NBX-TXT", "BOX_BX1": "BX1-TXT", "BOX_BX2": "BX2-TXT", "BOX_BX3": "BX3-TXT", "BOX_BX4": "BX4-TXT",
    "BOX_BX6": "BX6-TXT", "BOX_BX7": "BX7-TXT", "BOX_BX15": "BX15-TXT", "BOX_BX16": "BX16-UNT", "BACK_MATTER": "PMI", "EXERCISE": "PMI",
}
NOTE_SOURCES = ("source:", "sources:", "adapted from", "reproduced from", "reprinted from", "data from", "courtesy of", "with permission from", "from ")
ANCHORS = ("T1", "T11", "T12", "TSN", "T2", "T4")
ANCHOR_STARTS = ("TFN", "TBL", "TH")
BOX_RENAMES = {"NBX-TXT": "BX1-TXT-FLUSH", "NBX-H4": "BX1-H3"}
ALTERNATIVES = {
    "H1": ["H2", "CT", "SP-H1"], "H2": ["H1", "H3", "REFH2"], "H3": ["H2", "H4"], "H4": ["H3", "H5"], "TXT": ["TXT-FLUSH", "BX1-TXT-FIRST", "CS-TXT"], "TXT-FLUSH": ["TXT", "NBX1-TXT-FLUSH"],
    "BL-FIRST": ["BL-MID", "NBX1-BL-FIRST"], "BL-MID": ["BL-FIRST", "BL-LAST"], "BL-LAST": ["BL-MID", "BL-FIRST"], "NL-FIRST": ["NL-MID", "EOC-NL-FIRST"], "NL-MID": ["NL-FIRST", "NL-LAST"],
    "NL-LAST": ["NL-MID"], "T2": ["T3", "TBL-MID"], "T3": ["T2", "TBL-MID"], "TBL-MID": ["T2", "T3"], "REF-N": ["NL-FIRST", "NL-MID"],
}


def table_of(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def locked(df: DataFrame, when: Column, tag: Column) -> DataFrame:
    """Lock rows to one tag: lock_style, skip_llm and allowed_styles; other rows keep what they have."""
    have = {c: F.col(c) if c in df.columns else F.lit(None).cast(t) for c, t in (("lock_style", "boolean"), ("skip_llm", "boolean"), ("allowed_styles", "array<string>"))}
    hit = F.coalesce(when, F.lit(False))
    return df.withColumns({
        "lock_style": F.when(hit, True).otherwise(have["lock_style"]), "skip_llm": F.when(hit, True).otherwise(have["skip_llm"]),
        "allowed_styles": F.when(hit, F.array(tag)).otherwise(have["allowed_styles"]),
    })


def lock_markers(df: DataFrame) -> DataFrame:
    """Rows that are one ``<marker>`` and nothing else become PMI."""
    return locked(df, T.strip(F.col("text")).rlike("^<[^<>]+>$"), F.lit("PMI"))


def lock_table_titles(df: DataFrame) -> DataFrame:
    """``Table 1`` and ``Table 2.3`` rows become T1 in zone TABLE."""
    hit = F.coalesce(F.col("text").rlike(r"^Table\s+\d+(\.\d+)?\b"), F.lit(False))
    return locked(df, hit, F.lit("T1")).withColumn("zone", F.when(hit, "TABLE").otherwise(F.col("zone")))


def list_tag() -> Column:
    """Tag of a list row by kind and level; null for rows without a list level or style prefix."""
    family = F.when(F.col("has_bullet"), "BL").when(F.col("has_numbering"), "NL").when(F.col("has_xml_list"), "UL").otherwise("BL")
    level = F.when(F.col("xml_list_level") == 0, "").otherwise(F.least(F.col("xml_list_level") + 1, F.lit(4)).cast("string"))
    return F.when(F.col("xml_list_level").isNotNull(), F.concat(family, level, F.lit("-MID"))).when(F.coalesce("list_style_prefix", F.lit("")) != "", F.concat("list_style_prefix", F.lit("MID")))


def lock_lists(df: DataFrame) -> DataFrame:
    """List rows outside tables get their level's tag."""
    return locked(df, list_tag().isNotNull() & ~F.col("zone").eqNullSafe("TABLE"), list_tag())


def marker_style() -> Column:
    """Style of a leading marker, null if it resolves to none."""
    token = F.lower(T.marker_token(F.col("text")))
    rest = F.lower(T.strip(F.regexp_replace("text", r"^\s*</?[A-Za-z][A-Za-z0-9 _-]*>", "")))
    return (
        F.when(token == "h1-intro", "SP-H1")
        .when((token == "sum") & F.contains(rest, F.lit("summary")), "EOC-H1")
        .when((token == "h1") & rest.rlike(r"^\s*references\s*$"), "REFH1")
        .when(token == "h1", F.lit(None).cast("string"))
        .when(token.isNotNull() & (rest == ""), "PMI")
    )


def repaired(df: DataFrame, new_tag: Column, reason: str, glue: str = ";") -> DataFrame:
    """Set the tag where ``new_tag`` has one that differs; notes it in repaired and repair_reason."""
    df = df.withColumn("__new", new_tag)
    hit = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col("tag"))
    old = F.col("repair_reason") if "repair_reason" in df.columns else F.lit(None).cast("string")
    was = F.col("repaired") if "repaired" in df.columns else F.lit(False)
    out = {"tag": F.when(hit, F.col("__new")).otherwise(F.col("tag")), "repaired": hit | was, "repair_reason": F.when(hit, F.concat_ws(glue, F.nullif(old, F.lit("")), F.lit(reason))).otherwise(old)}
    return df.withColumns(out).drop("__new")


def marker_overrides(df: DataFrame, valid: Column) -> DataFrame:
    """Tags from leading markers; other styles than PMI only where ``valid`` holds for the row."""
    style = marker_style()
    return repaired(df, F.when((style == "PMI") | valid, style), "marker-override", ",")


def note_kind(text: Column) -> Column:
    """TSN or TFN for a text beside a table, else null."""
    t = T.strip(text)
    low = F.lower(t)
    starts = lambda names: F.array_contains(F.array(*(F.startswith(low, F.lit(n)) for n in names)), True)
    note = starts(("note:", "notes:")) | t.rlike(r"^[*†‡§#]") | t.rlike(r"(?i)^[a-z]\)\s") | t.rlike(r"(?i)^[a-z]\s+\S") | t.rlike(r"^\d\s+\S")
    return F.when(starts(NOTE_SOURCES), "TSN").when(note, "TFN")


def table_notes(df: DataFrame, doc: seq.Names, pos: seq.Names) -> DataFrame:
    """Sources and footnotes within ten rows of a table's tag, outside tables themselves."""
    tag = F.coalesce("tag", F.lit(""))
    anchor = tag.isin(*ANCHORS) | F.array_contains(F.array(*(F.startswith(tag, F.lit(a)) for a in ANCHOR_STARTS)), True)
    df = df.withColumn("__near", seq.neighbour_exists(anchor, doc, pos, 10))
    hit = F.col("__near") & ~F.col("zone").eqNullSafe("TABLE") & ~F.startswith(tag, F.lit("TFN")) & (tag != "TSN")
    kind = note_kind(F.col("text"))
    out = repaired(df, F.when(hit & (kind == "TSN"), kind), "table-source-note")
    # rows that the first rule has set are TSN now, so the second can't meet them
    return repaired(out, F.when(hit & (kind == "TFN"), kind), "table-footnote").drop("__near")


def box_tag(tag: Column, styles: Column) -> Column:
    """Numberless box tags as those of box 1, where the vocabulary (array) has them; else null."""
    upper = F.upper(tag)
    fixed = table_of(BOX_RENAMES)[upper]
    suffix = F.regexp_replace(tag, "(?i)^NBX1?-", "")
    own, big = F.concat(F.lit("BX1-"), suffix), F.concat(F.lit("BX1-"), F.upper(suffix))
    has = lambda c: F.array_contains(styles, c)
    return F.when(fixed.isNotNull(), F.when(has(fixed), fixed)).when(upper.rlike("^NBX1?-"), F.when(has(own), own).when(has(big), big))


def box_styles(df: DataFrame, styles: Column) -> DataFrame:
    return repaired(df, F.when(F.startswith("zone", F.lit("BOX_")), box_tag(F.col("tag"), styles)), "box-region-normalize", ",")


def zone_enforced(df: DataFrame, known: Column, zone_ok: Column) -> DataFrame:
    """Unknown tags and tags that the zone doesn't allow get the zone's fallback (TXT where it has none)."""
    bad = ~F.coalesce(known, F.lit(False)) | ~F.coalesce(zone_ok, F.lit(False))
    fallback = F.coalesce(table_of(ZONE_FALLBACK)[F.col("zone")], F.lit("TXT"))
    return df.withColumns({"original_tag": F.when(bad, F.col("tag")), "zone_restricted": bad, "tag": F.when(bad, fallback).otherwise(F.col("tag"))})


def style_aliases(tag: Column, aliases: dict[str, str]) -> Column:
    """Alias as it is, with dashes, with underscores; the tag itself if none is known."""
    m = table_of(aliases)
    return F.coalesce(m[tag], m[F.translate(tag, "_", "-")], m[F.translate(tag, "-", "_")], tag)


def split_composite(tag: Column, styles: Column) -> Column:
    """First known part of a tag such as ``TXT/H1`` or ``BL-MID, TXT``; null if none is known."""
    return F.try_element_at(F.filter(F.split(tag, r"\s*[/,|+]\s*"), lambda p: F.array_contains(styles, p)), F.lit(1))


def alternatives(df: DataFrame, threshold: float = 85) -> DataFrame:
    """Other tags worth a look for rows below the threshold; empty for the rest."""
    m = F.create_map(*(x for k, v in ALTERNATIVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    none = F.array().cast("array<string>")
    return df.withColumn("alternatives", F.when(F.col("confidence") < threshold, F.coalesce(m[F.col("tag")], none)).otherwise(none))


def indent_level(twips: Column) -> Column:
    """List level of an indent: to 360 twips 0, to 1080 twips 1, else 2."""
    return F.when(twips <= 360, 0).when(twips <= 1080, 1).when(twips.isNotNull(), 2)


def whitespace_level(tabs: Column, spaces: Column) -> Column:
    """A tab or four spaces make a level, two at most."""
    return F.least(F.lit(2), tabs + F.floor(spaces / 4)).cast("int")


def alias_confidence(raw: Column, canonical: Column, support: Column, known: Column) -> Column:
    """Confidence of an alias: 1 for known ones, else a base with boosts for likeness and support, 0.95 at most."""
    bare = lambda c: F.translate(F.upper(c), "-_", "")
    like = F.contains(bare(raw), bare(canonical)) | F.startswith(bare(raw), F.left(bare(canonical), F.lit(4)))
    return F.when(known, 1.0).otherwise(F.round(F.least(F.lit(0.95), F.lit(0.65) + F.when(like, 0.10).otherwise(0.0) + F.least(support / 100, F.lit(0.10))), 4))


def list_depth(tag: Column) -> Column:
    """(base, depth) of list tags, prefixed families too; null for other tags."""
    p = r"(?i)(?:^|[-_])((?:[A-Z]+-)?(?:BL|NL|UL))([2-6])?(?:[-_](FIRST|MID|LAST|ONLY))?$"
    base, depth = F.upper(F.regexp_extract(tag, p, 1)), F.regexp_extract(tag, p, 2)
    return F.when(base != "", F.struct(base.alias("base"), F.when(depth == "", 1).otherwise(F.try_to_number(F.nullif(depth, F.lit("")), F.lit("9")).cast("int")).alias("depth")))


def marker_class(text: Column) -> Column:
    """(class, pattern) of a marker row: open, close, insert or other."""
    t = T.strip(text)
    out = lambda k, p: F.struct(F.lit(k).alias("class"), p.alias("pattern"))
    kind = F.regexp_extract(F.upper(F.left(t, F.lit(20))), r"<INSERT\s+([A-Z]+)", 1)
    return (
        F.when(t.rlike("(?i)^</?[A-Z][A-Z0-9_-]*>$") & ~F.startswith(t, F.lit("</")), out("open", F.upper(t)))
        .when(t.rlike("(?i)^</[A-Z][A-Z0-9_-]*>$"), out("close", F.upper(t)))
        .when(t.rlike(r"(?i)^<INSERT\s+"), out("insert", F.when(kind != "", F.concat(F.lit("<INSERT "), kind, F.lit("...>"))).otherwise("<INSERT ...>")))
        .otherwise(out("other", F.lit("<other_pmi_pattern>")))
    )


def cell_positions(df: DataFrame, cell: seq.Names, pos: seq.Names) -> DataFrame:
    """TBL-FIRST, TBL-MID, TBL-LAST for list rows of a cell, unless the cell has such a tag already or one row only."""
    from pyspark.sql import Window

    part = Window.partitionBy(*seq.cols(cell))
    place = F.row_number().over(part.orderBy(*seq.cols(pos)))
    n = F.count(F.lit(1)).over(part)
    taken = F.bool_or(F.col("tag").isin("TBL-FIRST", "TBL-MID", "TBL-LAST")).over(part)
    new = F.concat(F.lit("TBL-"), seq.place_name(place, n))
    df = df.withColumn("__new", F.when((n >= 2) & ~taken, new))
    return repaired(df, F.col("__new"), "cell-position-normalized").drop("__new")


def first_matching(df: DataFrame, text: str, rules: list[tuple[int, str, str]], default: str) -> DataFrame:
    """Tag of the rule (priority, pattern, tag) with the least priority that matches."""
    out = F.lit(default)
    for _, pattern, tag in sorted(rules, reverse=True):
        out = F.when(F.col(text).rlike(pattern), tag).otherwise(out)
    return df.withColumn("tag", out)


def lock_numbered_references(df: DataFrame, doc: seq.Names, pos: seq.Names, in_zone: str) -> DataFrame:
    """Numbered rows of the zone of references (a boolean column, see ``sequence.reference_zone``) become REF-N."""
    return locked(df, F.col(in_zone) & F.col("text").rlike(r"^\s*(\[\d+\]|\(\d+\)|\d+[.)])\s"), F.lit("REF-N"))


def kept_lists(df: DataFrame) -> DataFrame:
    """List tags after a model: family and level as the source has them, the model's position where it gave one, and a
    prefix of its tag if the rest fits. Tables and references stay as they are."""
    want = F.when(~F.col("zone").eqNullSafe("TABLE") & ~F.col("zone").eqNullSafe("REFERENCE"), list_tag())
    tag = F.coalesce("tag", F.lit(""))
    base = F.regexp_replace(want, "-MID$", "")
    position = F.nullif(F.regexp_extract(tag, "-(FIRST|MID|LAST)$", 1), F.lit(""))
    exact = F.concat(base, F.lit("-"), position)
    fits = (tag == want) | (tag == exact) | F.endswith(tag, F.concat(F.lit("-"), exact))
    new = F.when(F.coalesce(fits, F.lit(False)), F.col("tag")).otherwise(F.coalesce(exact, want))
    hit = want.isNotNull() & ~new.eqNullSafe(F.col("tag"))
    return df.withColumns({"original_tag": F.when(hit, F.col("tag")), "list_preserved": hit, "tag": F.when(hit, new).otherwise(F.col("tag"))})


#: Starts of question tags, and tags that numbered questions and references may keep.
QUESTION_STARTS = ("QUES-", "REV-QUES-", "EXER-", "CS-QUES-", "BX1-QUES-")
QUESTION_TAGS = ("QUES-NL-FIRST", "QUES-NL-MID", "QUES-NL-LAST", "REV-QUES-NL-FIRST", "REV-QUES-NL-MID", "REV-QUES-NL-LAST")
REFERENCE_TAGS = ("REF-N", "REF-N0", "REF-N-FIRST", "REF-U")


def question_numbers(df: DataFrame, doc: seq.Names, pos: seq.Names, aliases: dict[str, str], reach: int = 10) -> DataFrame:
    """Numbered rows of exercises (by zone, or by question tags within ``reach`` rows) and of back matter get question
    and reference tags; other rows their alias."""
    starts = lambda c: F.array_contains(F.array(*(F.startswith(c, F.lit(q)) for q in QUESTION_STARTS)), True)
    tag = F.coalesce("tag", F.lit(""))
    df = df.withColumns({"__own": F.coalesce(table_of(aliases)[tag], tag), "__near": seq.neighbour_exists(starts(tag), doc, pos, reach)})
    own = F.col("__own")
    numbered = F.coalesce(F.col("text").rlike(r"(?i)^\s*(?:Q\d+\.\s|\d+\.\s|\(\d+\)\s|\d+\)\s)"), F.lit(False))
    reference = F.col("zone").eqNullSafe("BACK_MATTER")
    question = F.col("zone").eqNullSafe("EXERCISE") | (~reference & (F.col("__near") | starts(own)))
    new = (
        F.when(numbered & question, F.when(~own.isin(*QUESTION_TAGS), "QUES-NL-MID"))
        .when(numbered & reference, F.when(~own.isin(*REFERENCE_TAGS), "REF-N"))
        .when(own != tag, own)
    )
    return repaired(df, new, "number-or-alias", ",").drop("__own", "__near")
