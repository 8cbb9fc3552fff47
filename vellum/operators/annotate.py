"""Tags of raw paragraphs by rules, blocks and the tag before: a recurrence as a state machine.

A row's own facts (explicit tag, block marker, list, first rule that matches) are columns; what they mean depends on the
open block, on whether the chapter's opening is going on, and on the tag before. These make few states, so the scan needs
no document in one group. A rule set has patterns in order, and texts that open blocks.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from . import statescan
from .sequence import Names

# Tags that matter to later rows, names of blocks with tags of their own, ends of a list of references.
OBJECTIVES, REFERENCES = "LEARNING_OBJECTIVES_BLOCK", "REFERENCES_BLOCK"
BLOCK_ENDERS = ("H1", "H2", "H3", "H4", "CT", "CN", "OBJ1", "REFH1")
OPENING = ("CN", "CT", "CAU")
AFTER_OPENING = ("H1", "H2", "H3", "OBJ1", "ABS")
HEADINGS = ("H1", "H2", "H3")
# Each of these begins with a capital from A to Z.
REFERENCES_END = r"^FIGURE\s+\d+|^Table\s+\d+|^Box\s+\d+|^[A-Z][A-Z\s]{3,}$"
_MARKED = ("CN", "CT", "CAU", "H1", "H2", "H3", "H4", "OBJ1", "REFH1", "ABS", "TXT", "EPI-ATT")


def step(state: tuple, symbol: tuple) -> tuple[tuple, str]:
    """State: open block, whether the opening goes on, kind of the tag before (CN, heading or other). Symbol: kind of row
    (empty, explicit, list, other), its block marker, whether it ends references, its own tag if a later row may care ('' for
    none, 'other' for the rest). Output: what the tag is taken from."""
    block, opening, before = state
    kind, marker, ends, own = symbol
    if kind == "empty":
        return state, "EMPTY"
    if kind != "explicit" and marker:
        block = marker
    elif block == REFERENCES and ends:
        block = None
    take = "own"
    if kind == "list":
        take = {OBJECTIVES: "OBJ-BL-MID", REFERENCES: "reference-item"}.get(block, "own")
        tag = own if take == "own" else "other"
    else:
        tag = own
        if kind == "other" and before == "CN":
            take = tag = "CT"
        found = bool(tag)
        if tag in BLOCK_ENDERS and not (block and marker == block):
            block = None
        if not found:
            take, tag = (f"text:{block}", "other") if block else ("TXT", "TXT")
    opening = True if tag in OPENING else False if tag in AFTER_OPENING else opening
    if opening and tag == "TXT":
        take, tag = "epigraph", "other"
    elif tag == "TXT" and before == "heading":
        take, tag = "TXT-FLUSH", "other"
    return (block, opening, "CN" if tag == "CN" else "heading" if tag in HEADINGS else "other"), take


def annotated(df: DataFrame, doc: Names, pos: Names, rules: Sequence[tuple[str, str, str]], markers: dict[str, str], chunk: Column | None = None) -> DataFrame:
    """``df`` (text, is_list, style) with new_tag and new_style. ``rules``: (pattern at the start, tag, style) in order;
    ``markers``: whole texts that open a block. Null text is empty, null is_list no list."""
    given_columns = df.columns
    df = df.withColumn("__raw", F.coalesce("text", F.lit(""))).withColumn("__whole", T.stripped(F.col("__raw")))
    whole, tagged = F.col("__whole"), r"(?s)^<([A-Z0-9-]+)>(.*)"
    explicit = F.when(F.startswith(whole, F.lit("<")), F.regexp_extract(whole, tagged, 1)).otherwise("")
    df = df.withColumn("__explicit", explicit)
    text = F.when(F.col("__explicit") != "", T.strip(F.regexp_extract(whole, tagged, 2))).otherwise(whole)
    df = df.withColumns({"__text": text, "__empty": whole == ""})
    # a search for a beginning goes on to the text's end, so the first character is asked before
    df = df.withColumn("__first", F.substring("__text", 1, 1))
    t, first = F.col("__text"), F.col("__first")
    digit = first.between("0", "9")
    numbered = digit & t.rlike(r"^\d+[.)]")
    style = F.coalesce("style", F.lit("")) if "style" in df.columns else F.lit("")
    item = F.when(numbered, "NL-MID").when(F.contains(style, F.lit("Bullet")) | first.isin("•", "–", "-"), "BL-MID").otherwise("NL-MID")
    given = F.coalesce("is_list", F.lit(False)) if "is_list" in df.columns else F.lit(False)
    kind = F.when(F.col("__empty"), "empty").when(F.col("__explicit") != "", "explicit").when(given, "list").otherwise("other")
    df = df.withColumn("__kind", kind)
    ruled = F.lit(0)
    for i, (pattern, _, _) in reversed([*enumerate(rules, 1)]):
        ruled = F.when(t.rlike(f"^(?:{pattern})"), i).otherwise(ruled)
    if not any(re.search(r"\\[1-9k]", p) for p, _, _ in rules):  # all rules at once: most rows have none
        ruled = F.when(t.rlike("^(?:" + "|".join(f"(?:{p})" for p, _, _ in rules) + ")"), ruled).otherwise(0) if rules else ruled
    # a tag of its own as a text, and which rule it comes from; rules are looked for in other rows only
    df = df.withColumn("__rule", F.when(F.col("__kind") == "other", ruled).otherwise(0))
    by_rule = lambda k: F.element_at(F.array(F.lit(None).cast("string"), *(F.lit(r[k]) for r in rules)), F.col("__rule") + 1)
    df = df.withColumn("__tag", F.when(F.col("__kind") == "explicit", F.col("__explicit")).when(F.col("__kind") == "list", item).otherwise(by_rule(1)))
    pair = lambda a, b: F.struct(a.alias("tag"), b.alias("style"))
    names = sorted(set(markers.values()))
    opened = F.lit(None).cast("string")
    for words, block in markers.items():
        opened = F.when(t == words, block).otherwise(opened)
    owns = ["", "other", *_MARKED]
    kinds = ["empty", "explicit", "list", "other"]
    symbols = [(k, m, e, o) for k in kinds for m in [None, *names] for e in (False, True) for o in owns]
    states = [(None, False, "other"), *((b, o, p) for b in [None, *names] for o in (False, True) for p in ("CN", "heading", "other") if (b, o, p) != (None, False, "other"))]
    number = F.array_position(F.array(*map(F.lit, kinds)), F.col("__kind")) - 1
    number = number * (len(names) + 1) + F.coalesce(F.array_position(F.array(*map(F.lit, names)), opened), F.lit(0)) if names else number
    number = number * 2 + (first.between("A", "Z") & t.rlike(REFERENCES_END)).cast("int")
    own = F.col("__tag")
    number = number * len(owns) + F.when(own.isNull(), 0).otherwise(F.greatest(F.array_position(F.array(*map(F.lit, owns)), own) - 1, F.lit(1)))
    df = df.withColumns({"__symbol_of": number.cast("int"), "__entry": (digit | (first == "[")) & t.rlike(r"^\[\d+\]|^\d+\."), "__source": first.isin("—", "–", "-")})
    # the scan reads its rows twice; texts aren't looked into again after it
    df = written(df.select(*given_columns, "__tag", "__rule", "__symbol_of", "__entry", "__source"), "facts")
    machine = statescan.Machine(states, symbols, step)
    df = statescan.scanned(df, doc, pos, F.col("__symbol_of"), machine, "__state", chunk).withColumn("__take", machine.output(F.col("__symbol_of"), F.col("__state"), "string"))
    take = F.col("__take")
    block = F.substring_index(take, ":", -1)
    inside = F.when(block == OBJECTIVES, "OBJ-TXT").when(block == REFERENCES, "REF-TXT").otherwise(F.concat(block, F.lit("_TXT")))
    same = lambda c: pair(c, c)
    entry = F.col("__entry")
    out = (
        F.when(take == "own", pair(F.col("__tag"), F.when(F.col("__rule") > 0, by_rule(2)).otherwise(F.col("__tag")))).when(take == "EMPTY", pair(F.lit("EMPTY"), F.lit("TXT"))).when(F.startswith(take, F.lit("text:")), same(inside))
        .when(take == "reference-item", pair(F.when(entry, "REF").otherwise("BODY_TEXT"), F.when(entry, "REF").otherwise("TXT"))).when(take == "epigraph", same(F.when(F.col("__source"), "EPI-ATT").otherwise("EPI")))
        .otherwise(same(take))
    )
    return df.withColumn("__out", out).withColumns({"new_tag": F.col("__out.tag"), "new_style": F.col("__out.style")}).drop("__out", "__take", "__state", "__symbol_of", "__tag", "__rule", "__entry", "__source")


# Levels of styles that count as headings.
STYLE_LEVELS = {"CT": 0, "Title": 0, "H1": 1, "Heading 1": 1, "H2": 2, "Heading 2": 2, "H3": 3, "Heading 3": 3, "H4": 4, "Heading 4": 4}


def enforced(
    df: DataFrame, doc: Names, pos: Names, synonyms: dict[str, str], mandatory: Sequence[str], h1_first: bool = True, no_skips: bool = True, chunk: Column | None = None
) -> DataFrame:
    """Annotated rows (text, new_tag, new_style) with synonyms of section titles replaced, mandatory sections as H1, no lower
    heading before the first H1, and no level skipped on the way down. The state is the level of the last heading."""
    df = df.withColumn("__raw", F.coalesce("text", F.lit(""))).withColumn("__whole", T.stripped(F.col("__raw")))
    renamed = F.lit(None).cast("string")
    for old, new in synonyms.items():
        renamed = F.when(F.col("__whole") == old, new).otherwise(renamed)
    df = df.withColumn("__renamed", renamed).withColumn("text", F.coalesce("__renamed", "text"))
    title = F.when(F.col("__renamed").isNull(), F.col("__whole")).otherwise(T.strip(F.col("__renamed")))
    must = title.isin(*mandatory) & (F.col("new_style") != "H1")
    df = df.withColumns({"new_tag": F.when(must, "H1").otherwise(F.col("new_tag")), "new_style": F.when(must, "H1").otherwise(F.col("new_style"))}).drop("__raw", "__whole", "__renamed")

    def step(last: int, level: int | None) -> tuple[int, str | None]:
        if level is None:
            return last, None
        now = 1 if h1_first and level > 1 and last == 0 else level
        now = min(now, last + 1) if no_skips else now
        return now, None if now == level else f"H{now}"

    number = F.lit(0)
    for style, level in STYLE_LEVELS.items():
        number = F.when(F.col("new_style") == style, level + 1).otherwise(number)
    df = written(df.withColumn("__level", number), "annotated")  # the scan reads its rows twice
    machine = statescan.Machine(range(5), [None, *range(5)], step)
    df = statescan.scanned(df, doc, pos, F.col("__level"), machine, "__state", chunk)
    return df.withColumn("new_style", F.coalesce(machine.output(F.col("__level"), F.col("__state"), "string"), F.col("new_style"))).drop("__level", "__state")
