"""Validation and repair of tagged rows: an ordered table of rules, then passes in which a row's result decides how later
rows are read.

The rules look at one row and read the tag that earlier rules left; they are projections. The passes are state machines
(``statescan``), so no document has to sit in one group: the section of references keeps its tags, floats of back matter
need an anchor within ten rows, text after a heading is flush, headings keep their order, marked sections of references.
Between passes the rows (keys, tags and flags, no text) are written to the shared folder.

Nulls: no tag is TXT, no confidence 85, no zone BODY, no text empty; facts that a table lacks are absent.
"""

from __future__ import annotations

import difflib
import functools
import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import written
from . import review, statescan
from .sequence import Names, cols

# Tags that stand in for tags a vocabulary lacks, best first.
FALLBACKS = {
    tag: others.split()
    for tag, others in (
        line.strip().split(": ")
        for line in """
    H6: H5 H4 H3
    H5: H4 H3
    H4: H3
    H3: H2
    H2: H1
    TXT-FLUSH: TXT
    TXT-FLUSH1: TXT-FLUSH TXT1 TXT
    TXT-FLUSH2: TXT-FLUSH TXT2 TXT
    TXT-FLUSH4: TXT-FLUSH TXT4 TXT
    TXT-DC: TXT-FLUSH TXT
    TXT-AU: TXT-FLUSH TXT
    TXT1: TXT
    TXT2: TXT
    TXT3: TXT
    TXT4: TXT
    BL-FIRST: BL-MID
    BL-LAST: BL-MID
    BL2-MID: BL-MID
    BL3-MID: BL2-MID BL-MID
    NL-FIRST: NL-MID
    NL-LAST: NL-MID
    UL-FIRST: UL-MID BL-FIRST BL-MID
    UL-LAST: UL-MID BL-LAST BL-MID
    UL-MID: BL-MID
    TH6: TH5 TH4 TH3
    TH5: TH4 TH3
    TH4: TH3
    TH3: TH2 TH1 T
    TH2: TH1 T
    TH1: T
    TBL-FIRST: TBL-MID
    TBL-LAST: TBL-MID
    TBL2-MID: TBL-MID
    TBL3-MID: TBL2-MID TBL-MID
    TBL4-MID: TBL3-MID TBL2-MID TBL-MID
    TNL-FIRST: TNL-MID
    TNL-LAST: TNL-MID
    T2-C: T2
    T21: T2
    T22: T2
    T23: T2
    T3: T4 T
    T4: T3 T
    T5: T
    T6: T
    TD: T
    TFN1: TFN
    TSN: TFN
    FIG-SRC: TSN FIG-LEG
    UNFIG-SRC: FIG-SRC TSN
    REF-N0: REF-N
    REF-U: REF-N
    Ref-H1: REFH1
    Ref-H2: REFH2
    NBX1-TTL: NBX-TTL
    NBX1-TXT: NBX-TXT TXT
    NBX1-TXT-FLUSH: NBX-TXT-FLUSH NBX-TXT TXT-FLUSH TXT
    NBX1-BL-FIRST: NBX-BL-FIRST NBX1-BL-MID BL-FIRST
    NBX1-BL-MID: NBX-BL-MID BL-MID
    NBX1-BL-LAST: NBX-BL-LAST NBX1-BL-MID BL-LAST
    NBX1-NL-FIRST: NBX-NL-FIRST NBX1-NL-MID NL-FIRST
    NBX1-NL-MID: NBX-NL-MID NL-MID
    NBX1-NL-LAST: NBX-NL-LAST NBX1-NL-MID NL-LAST
    EOC-NL-FIRST: EOC-NL-MID
    EOC-NL-LAST: EOC-NL-MID
    EOC-LL2-MID: EOC-NL-MID
    EOC-H1: H1
    APX-H1: H1
    APX-H2: H2
    APX-H3: H3
    APX-TXT: TXT
    APX-TXT-FLUSH: TXT-FLUSH TXT
    SP-H1: H1
    SP-TTL: H1
    SP-TXT: TXT
    INTRO: TXT-FLUSH TXT
    EXT-ONLY: TXT
    QUO: TXT
    EXER-NL-FIRST: EXER-MC-NL-FIRST EXER-SP-NL-FIRST NL-FIRST
    EXER-NL-MID: EXER-MC-NL-MID EXER-SP-NL-MID NL-MID
    EXER-NL-LAST: EXER-NL-MID NL-LAST NL-MID
    SKILL: TXT-FLUSH TXT
    EFP-BX: TXT
    EYU-BX: TXT
    """.strip().splitlines()
    )
}
# Patterns, word lists and tags of the rules.
REFERENCE_NUMBER = r"^\s*(?:[•●\-*–—]\s*)?(?:\(\d+\)|\[\d+\]|\d+[.)]|\d+\s+)"
REFERENCE_BULLET = r"^\s*[•●\-*–—]\s+"
#: A letter, later on its line a comma, later a full stop, not next to it. Only a line's first letter, the first comma after
#: it and the first full stop after that are tried, so the cost is a line's length.
NAMED = r"(?:^|[\n\r\u0085\u2028\u2029])[^A-Za-z\n\r\u0085\u2028\u2029]*+[A-Za-z][^,\n\r\u0085\u2028\u2029]*+,[^\n\r\u0085\u2028\u2029][^.\n\r\u0085\u2028\u2029]*+\."
READING_LISTS = r"\b(suggested readings|further reading|recommended reading)\b"
UNSUFFIXED_LIST = r"^.+-(BL\d*|NL\d*|UL\d*|LL\d*|TBL\d*|TNL\d*|TUL\d*)$"
POSITIONED_LIST = r"^(.*?)((?:BL|NL|UL|LL)\d*)-(FIRST|MID|LAST)$"
TABLE_SOURCES = ("source", "adapted from", "reproduced from", "reprinted from", "data from", "courtesy of", "with permission from", "from ")
TABLE_HEADINGS = ("SK_H", "TBL-H")
BACK_MATTER = {
    "FIG-LEG": ["FIG-LEG", "UNFIG-LEG", "FG-CAP", "TXT-FLUSH", "TXT"],
    "FIG-SRC": ["FIG-SRC", "UNFIG-SRC", "TSN", "TXT-FLUSH", "TXT"],
    "T1": ["T1", "BM-TTL", "TXT-FLUSH", "TXT"],
    "TFN": ["TFN", "TSN", "TXT-FLUSH", "TXT"],
    "BM-TTL": ["BM-TTL", "T1", "REFH1", "REF-H1", "TXT-FLUSH", "TXT"],
}
BACK_MATTER_TEXT = ["REF-U", "REF-N", "BM-TTL", "TSN", "TXT-FLUSH", "TXT"]
FLOAT_IN_REFERENCES = ["REF-U", "REF-N", "REF-TXT", "TXT-FLUSH", "TXT"]
FLOAT_ELSEWHERE = ["TSN", "BM-TTL", "TXT-FLUSH", "TXT"]
FLOATS = ("T1", "T2", "T4", "TFN", "TSN", "TBL-FIRST", "TBL-MID", "TBL-LAST")
FLOAT_ANCHORS = ("T1", "T2", "T4", "TFN", "TSN")
SECTION_STARTS = ("SRH1", "REFH1")
SECTION_KEEPS = ("SR", "REF-N", "REF-N0", "BIB", "APX-REF-N", "APX-REF-U", "APX-REFH1")
SECTION_ENDS = ("H1", "H2", "CN", "CT")
MARKED_ENDS = ("H1", "H2", "CN", "CT", "T1", "BM-TTL")
REFERENCE_TITLES = ("references", "bibliography", "works cited", "cited references", "literature cited")
BOX_ZONES = ("NBX", "BX1", "BX2", "BX3", "BX4", "BX6", "BX7", "BX15", "BX16")
BOX_TYPES = {
    "note": "NBX", "tip": "NBX", "clinical pearl": "BX1", "example": "BX1", "red flag": "BX2", "warning": "BX2", "alert": "BX2", "reflection": "BX3", "discussion": "BX3", "case study": "BX4",
    "practice": "EXER", "key point": "NBX", "important": "NBX", "remember": "NBX", "unnumbered box": "NBX", "box": "NBX",
}
#: Rows on either side in which a float's anchor may stand.
REACH = 10

#: Facts of a row that rules use, by type; a table may lack any.
FACTS = {
    "zone": "string", "style": "string", "box_type": "string", "box_marker": "string", "box_label": "boolean", "box_title": "boolean", "caption_type": "string", "source_line": "boolean", "list_kind": "string",
    "list_position": "string", "has_bullet": "boolean", "has_xml_list": "boolean", "is_header_row": "boolean", "is_stub_col": "boolean", "ref_heading": "boolean", "in_reference": "boolean",
}


def without_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*(?:<[^>]+>\s*)+", "")


def reference_like(text: Column) -> Column:
    """Numbered or bulleted, or with a year, DOI or et al. and two marks, or a name, a comma and a full stop."""
    return _reference_like(T.strip(without_tags(text)))


def _reference_like(t: Column) -> Column:
    low = F.lower(t)
    marks = F.length(t) - F.length(F.translate(t, ".;:,", ""))
    dated = low.rlike(r"\b(19|20)\d{2}\b") | F.contains(low, F.lit("doi")) | F.contains(low, F.lit("et al"))
    return (t != "") & ~low.rlike(READING_LISTS) & (t.rlike(REFERENCE_NUMBER) | t.rlike(REFERENCE_BULLET) | ((marks >= 2) & (dated | t.rlike(NAMED))))


def heading_like(text: Column) -> Column:
    """Short, without a final mark, no number, in capitals or with most of two or more words capitalised."""
    t = T.strip(text)
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    titled = F.size(F.filter(words, lambda w: F.regexp_replace(w, "[^A-Za-z0-9]", "").rlike("^[A-Z]")))
    most = F.greatest(F.lit(1), F.floor(0.7 * F.size(words)))
    fits = (t != "") & (F.length(t) <= 60) & ~t.rlike(r"[.!?;:]\s*$") & ~t.rlike(r"^[\d\s,./%\-()+]+$")
    return fits & (t.rlike(r"^[A-Z0-9][A-Z0-9\s/&\-]{1,59}$") | ((F.size(words) >= 2) & (titled >= most)))


def stand_in(tag: str, allowed: frozenset[str]) -> str:
    """The vocabulary's tag for one that it lacks: by the fixed list, by family (MID first, then the shortest), by likeness
    of 0.6 or more (ties: the first in order), else TXT, else the tag itself."""
    for other in FALLBACKS.get(tag, ()):
        if other in allowed:
            return other
    if re.fullmatch(UNSUFFIXED_LIST[1:-1], tag):
        for place in ("MID", "FIRST", "LAST"):
            if f"{tag}-{place}" in allowed:
                return f"{tag}-{place}"
    family = tag.rpartition("-")[0]
    if family:
        kin = [s for s in allowed if s.startswith(f"{family}-")]
        if kin:
            return f"{family}-MID" if f"{family}-MID" in allowed else min(kin, key=lambda s: (len(s), s))
    like = max(((difflib.SequenceMatcher(None, tag, s).ratio(), s) for s in sorted(allowed)), key=lambda x: x[0], default=(0.0, ""))
    return like[1] if like[0] >= 0.6 else "TXT" if "TXT" in allowed else tag


class Rules:
    """A rewrite of ``__tag``, rule by rule; the reasons of those that fired gather in ``__why``."""

    def __init__(self, df: DataFrame):
        self.df = df

    def put(self, **columns: Column) -> None:
        self.df = self.df.withColumns(columns)

    def rule(self, *choices: tuple) -> None:
        """(reason, condition, tag[, even]): the first condition that holds sets the tag. Without ``even`` nothing has
        happened if the tag is that one already."""
        new = None
        for reason, when, tag, *even in choices:
            pick = F.struct(F.lit(reason).alias("why"), (F.lit(tag) if isinstance(tag, str) else tag).alias("tag"), F.lit(bool(even)).alias("even"))
            when = F.coalesce(when, F.lit(False))
            new = F.when(when, pick) if new is None else new.when(when, pick)
        self.put(__new=new)
        hit = F.coalesce(F.col("__new.even") | (F.col("__new.tag") != F.col("__tag")), F.lit(False))
        self.put(__tag=F.when(hit, F.col("__new.tag")).otherwise(F.col("__tag")), __why=F.when(hit, F.concat("__why", F.array("__new.why"))).otherwise(F.col("__why")))


def _starts(c: Column, *heads: str) -> Column:
    out = F.lit(False)
    for h in heads:
        out = out | F.startswith(c, F.lit(h))
    return out


def _row_rules(df: DataFrame, allowed: frozenset[str], zones: dict[str, Sequence[str]], canonical: Callable[[Column], Column], preserve_lists: bool, preserve_markers: bool) -> DataFrame:
    """All rules of single rows. Adds __tag, __why, __h45 and the flags that the passes need."""
    tag, zone, text, confidence = F.col("__tag"), F.col("zone"), F.col("text"), F.col("confidence")
    fact = {c: F.col(c) for c in FACTS}
    has = lambda c: c.isin(*sorted(allowed))
    first = lambda names: next((n for n in names if n in allowed), None)
    box = F.when(_starts(zone, "BOX_") & F.substr(zone, F.lit(5)).isin(*BOX_ZONES), F.substr(zone, F.lit(5))).when(F.col("box_type") != "", F.coalesce(F.create_map(*(F.lit(x) for kv in BOX_TYPES.items() for x in kv))[F.col("box_type")], F.lit("NBX")))
    in_reference = fact["in_reference"] | (zone == "REFERENCE")
    free = ~F.col("__locked")

    # what rules ask of a row's text is worked out once, not in each rule
    r = Rules(df.withColumns({"__stripped": T.strip(text), "__untagged": without_tags(text), "__level": F.regexp_extract(text, r"(?i)^\s*<H([1-6])>[\p{L}\p{N}_]", 1), "__variant": review.heading_variant(text, fact["style"], zone)}))
    stripped, low, level, variant = F.col("__stripped"), F.col("__low"), F.col("__level"), F.col("__variant")
    r.put(__low=F.lower(stripped), __referred=F.when(F.col("__untagged").rlike(REFERENCE_BULLET), "REF-U").otherwise("REF-N"), __bare_text=T.strip(F.col("__untagged")))
    r.put(__like=_reference_like(F.col("__bare_text")), __box=F.coalesce(box, F.lit("NBX")))
    like, referred, box = F.col("__like"), F.col("__referred"), F.col("__box")
    list_tag = review.list_tag(fact["list_kind"], fact["list_position"], zone, box, fact["has_bullet"] | fact["has_xml_list"], tag)
    r.put(__tag=F.col("tag"), __norm=canonical(F.col("tag")), __why=F.array().cast("array<string>"))
    locked = has(F.col("__norm")) & (confidence >= 0.90)
    if preserve_markers:
        bare = F.upper(stripped) == "<BL>"
        locked = locked | ((tag == "PMI") & F.startswith(stripped, F.lit("<"))) | bare
        r.put(__locked=F.coalesce(locked, F.lit(False)))
        r.put(__tag=F.when(bare, "PMI").otherwise(tag))
    else:
        r.put(__locked=F.coalesce(locked, F.lit(False)))
    parts = F.filter(F.transform(F.split(tag, "[+/,|]"), lambda p: T.strip(p)), lambda p: p != "")
    known = F.filter(parts, lambda p: has(canonical(p)))
    whole = T.strip(F.element_at(F.split(tag, "[+/,|]"), 1))
    part = F.coalesce(F.try_element_at(known, F.lit(1)), F.nullif(whole, F.lit("")))
    r.rule(("composite-rejected", free & tag.rlike("[+/,|]") & part.isNotNull(), part, True))
    r.put(__norm=F.when(F.size("__why") > 0, canonical(tag)).otherwise(F.col("__norm")))
    r.rule(("style-canonicalize", free & (F.col("__norm") != ""), F.col("__norm")))
    r.rule(("box-marker", free & fact["box_marker"].isin("start", "end"), "PMI"))
    marker = stripped.rlike(r"^<[^>]+>$") & (level == "")
    r.put(__locked=F.col("__locked") | (marker & (tag != "PMI")), __marked=marker & (tag != "PMI"))
    r.rule(("marker-only", F.col("__marked"), "PMI"))
    r.rule(("metadata-zone", free & (zone == "METADATA"), "PMI"))
    r.rule(("inline-heading-variant", free & (zone != "TABLE") & has(variant), variant))
    r.rule(("inline-heading-marker", free & (zone != "TABLE") & (level != "") & (F.regexp_extract(canonical(tag), r"^H([1-6])\d*$", 1) != level), F.concat(F.lit("H"), level)))
    r.rule(("table-caption", free & (fact["caption_type"] == "table"), "T1"))
    r.rule(("figure-caption", free & (fact["caption_type"] == "figure"), "FIG-LEG"))
    r.rule(("source-line", free & fact["source_line"], "TSN"))
    boxed = free & _starts(zone, "BOX_")
    named = lambda end: F.concat(F.coalesce(box, F.lit("NBX")), F.lit(end))
    r.rule(("box-type-label", boxed & fact["box_label"], named("-TYPE")), ("box-title", boxed & fact["box_title"], named("-TTL")))
    r.put(__locked=F.col("__locked") & ~(fact["in_reference"] & ~F.startswith("__norm", F.lit("REF-"))))

    table = free & (zone == "TABLE")
    size = F.regexp_extract(F.col("tag"), f"^(?:{'|'.join(TABLE_HEADINGS)})([1-6])$", 1)
    head = F.concat(F.lit("TH"), size)
    r.rule(("zone-table-heading-map", table & (size != "") & has(head), head, True), ("zone-table-heading-fallback", table & (size != ""), "T", True))
    source = _starts(low, *TABLE_SOURCES)
    note = ~source & (_starts(low, "note", "*", "†") | low.rlike(r"^[a-z]\)"))
    r.rule(("zone-table-source", table & source, "TSN", True), ("zone-table-footnote", table & note, "TFN", True))
    r.rule(("zone-table-txt-to-td", table & (tag == "TBL-TXT") & F.lit("TD" in allowed), "TD"))
    plain = table & tag.isin("TXT", "TXT-FLUSH", "T") & ~note
    cell = heading_like(text) & F.lit("T4" in allowed)
    r.rule(
        ("zone-table-list", table & _starts(tag, "BL-", "UL-", "NL-"), "T", True), ("zone-table-header-row", plain & fact["is_header_row"] & F.lit("T2" in allowed), "T2", True),
        ("zone-table-stub-col", plain & fact["is_stub_col"] & cell, "T4", True), ("zone-table-t4-heuristic", plain & (confidence < 0.90) & cell, "T4", True), ("zone-table-text", plain, "T", True),
    )
    r.rule(*(("zone-backmatter-normalize", free & (zone == "BACK_MATTER") & (tag == t), best) for t, names in BACK_MATTER.items() if (best := first(names))))

    own = canonical(tag)
    want = F.concat(F.regexp_extract(own, POSITIONED_LIST, 1), F.regexp_extract(own, POSITIONED_LIST, 2), F.lit("-"))
    place = F.upper(F.trim(fact["list_position"]))
    exact, mid = F.concat(want, place), F.concat(want, F.lit("MID"))
    aligned = F.when(own.rlike(POSITIONED_LIST) & place.isin("FIRST", "MID", "LAST"), F.when(has(exact), exact).when(has(mid), mid))
    listed = free & ~in_reference
    no_reference = ~(F.startswith(own, F.lit("REF")) | own.isin("BIB", "SR", "SRH1")) & ~like
    drift = _starts(tag, "BL-") & (_starts(list_tag, "UL-") | F.lit(preserve_lists))
    r.rule(
        ("semantic-list-position", listed & aligned.isNotNull() & (aligned != tag) & no_reference, aligned), ("list-position", listed & list_tag.isNotNull() & ~tag.rlike("-(FIRST|MID|LAST)$") & no_reference, list_tag),
        ("list-position", listed & list_tag.isNotNull() & _starts(tag, "BL", "NL", "UL", "TBL", "TNL", "TUL") & ~drift, list_tag),
    )
    fits = F.lit(True)
    bare_tag = F.regexp_replace(tag, "[0-9]+$", "")
    for z, names in zones.items():
        fits = F.when(zone == z, tag.isin(*names) | bare_tag.isin(*names)).otherwise(fits)
    r.rule(("table-inferred", free & (zone == "TABLE") & ~fits, F.when(F.startswith(tag, F.lit("BX4-")), "BX4-TXT").otherwise("T")))
    back = F.coalesce(list_tag, F.lit(first(BACK_MATTER_TEXT)), tag)
    r.rule(("zone-fallback", free & (zone != "BODY") & ~fits, F.when(zone == "TABLE", "T").when(zone == "BACK_MATTER", back).otherwise(F.coalesce(list_tag, F.lit("TXT")))))
    r.put(__h45=free & tag.isin("H4", "H5"))
    r.rule(("heading-canonicalize", F.col("__h45"), "H3"))
    headed = F.startswith(low, F.lit("<ref-h2>")) | fact["ref_heading"]
    r.rule(
        ("ref-zone-heading", in_reference & headed, "REFH2"), ("ref-zone-list-override", in_reference & _starts(tag, "UL-", "BL-"), referred),
        ("ref-zone-pre-allowed", in_reference & ~_starts(tag, "APX-REF") & ~tag.isin("SR", "SRH1") & like, referred),
    )

    @F.pandas_udf("string")
    def nearest(tags: pd.Series) -> pd.Series:
        known = {t: stand_in(t, allowed) for t in set(tags) if isinstance(t, str)}
        return pd.Series([known.get(t) for t in tags], dtype=object)

    r.rule(("not-allowed", F.lit(True), F.when(has(own), own).otherwise(nearest(F.when(~has(own), own)))))
    bare_text = F.col("__bare_text")
    return r.df.withColumns({
        "__confidence": F.when(F.size("__why") > 0, F.least(confidence, F.lit(80.0))).otherwise(confidence), "__like": like, "__referred": referred, "__headed": headed, "__list": list_tag,
        "__empty": stripped == "", "__marker": F.startswith(low, F.lit("<ref>")), "__title": F.lower(bare_text).isin(*REFERENCE_TITLES), "__bare": bare_text != "", "__captioned": F.startswith(F.lower(bare_text), F.lit("table ")),
        "__raised": fact["caption_type"].isNotNull() & (fact["caption_type"] != "") | fact["source_line"],
    })


def heading_step(state: tuple, symbol: tuple) -> tuple[tuple, str | None]:
    """Order of headings. State: level of the last heading (0: none), whether a first and a second level came. Symbol:
    heading's level (0: none), whether it's trusted, whether it's sure (0.7 or more), whether level 3 may come early."""
    last, one, two = state
    level, trusted, sure, early = symbol

    def after(n: int) -> tuple:
        return {1: (1, True, False), 2: (2, one, True), 3: (3, one, two)}.get(n, state)

    if trusted or not level:
        return after(level if trusted else 0), None
    new = min(level, 3)
    if level == 2 and not one:
        new = 1 if sure else 0
    if level == 3 and not two and not early:
        new = 2
    if last and level > last + 1:
        new = min(last + 1, 2) if sure else 0
    return after(new), f"H{new}" if new else "TXT"


def marked_step(state: int, symbol: str) -> tuple[int, str | None]:
    """Sections of references that a marker opens. State: 0 outside, else 1 + references seen (3 at most)."""
    if symbol == "heading":
        return 1, "heading"
    if not state or symbol == "stop":
        return 0, None
    if symbol == "entry":
        return min(state + 1, 4), "entry"
    return (0 if symbol == "other" and state == 4 else state), None


def validated(
    df: DataFrame, doc: Names, pos: Names, allowed: Sequence[str], zones: dict[str, Sequence[str]], canonical: Callable[[Column], Column] = lambda c: c,
    preserve_lists: bool = False, preserve_markers: bool = False, chunk: Column | None = None,
) -> DataFrame:
    """(doc, pos, tag, confidence, repaired, repair_reason) of rows (doc, pos, text, tag, confidence, facts). ``allowed``:
    the vocabulary, in canonical form; ``zones``: tags that a zone allows, for zones that have a list."""
    words = frozenset(allowed)
    first = lambda names: next((n for n in names if n in words), "TXT-FLUSH")
    keys = [*cols(doc), *cols(pos)]
    given = {c: F.col(c).cast(k) if c in df.columns else F.lit(None).cast(k) for c, k in FACTS.items()}
    given = {c: F.coalesce(v, F.lit(False)) if FACTS[c] == "boolean" else v for c, v in given.items()} | {"zone": F.coalesce(given["zone"], F.lit("BODY"))}
    rows = df.select(*keys, F.coalesce("text", F.lit("")).alias("text"), F.coalesce("tag", F.lit("TXT")).alias("tag"), F.coalesce(F.col("confidence").cast("double"), F.lit(85.0)).alias("confidence"), *(v.alias(c) for c, v in given.items()))
    rows = rows.repartition(*keys)  # the rules cost far more than the shuffle, and a source may come in one piece
    flags = ["__like", "__referred", "__headed", "__list", "__empty", "__marker", "__title", "__bare", "__captioned", "__raised", "__h45"]
    rows = _row_rules(rows, words, zones, canonical, preserve_lists, preserve_markers).select(*keys, "tag", "zone", "in_reference", *flags, F.col("__tag").alias("now"), F.col("__confidence").alias("sure"), F.col("__why").alias("why"))
    now, own = F.col("now"), canonical(F.col("now"))
    reason = lambda hit, word: F.when(hit, F.concat("why", F.array(F.lit(word)))).otherwise(F.col("why"))
    hit = F.col("__hit")

    def passed(rows: DataFrame, symbol: Column, machine: statescan.Machine, kind: str, order: Names = pos, within: Column | None = chunk) -> DataFrame:
        rows = written(rows.withColumn("__s", symbol), "repair")
        return statescan.scanned(rows, doc, order, F.col("__s"), machine, "__state", within).withColumn("__out", machine.output(F.col("__s"), F.col("__state"), kind)).drop("__state", "__s")

    # the section of references keeps the tags that came in
    step = lambda on, x: ((on or "t" in x) if (on or "t" in x) and "k" in x else (on or "t" in x) and "e" not in x, (on or "t" in x) and "k" in x)
    names = ["t", "k", "e", "tk", "te", "ke", "tke", ""]
    traits = F.concat(F.when(own.isin(*SECTION_STARTS) | F.col("__marker"), "t").otherwise(""), F.when(canonical(F.col("tag")).isin(*SECTION_KEEPS) & canonical(F.col("tag")).isin(*sorted(words)), "k").otherwise(""), F.when(own.isin(*SECTION_ENDS), "e").otherwise(""))
    rows = passed(rows, statescan.numbered([(n, traits == n) for n in names], names), statescan.Machine([False, True], names, step), "boolean")
    rows = rows.withColumn("__hit", F.col("__out") & (now != F.col("tag")))
    rows = rows.withColumns({"why": reason(hit, "ref-section-preserve"), "now": F.when(hit, F.col("tag")).otherwise(now)})

    # floats of back matter: rows to the next anchor, from behind, then rows since the last one that is left
    anchor = F.startswith(now, F.lit("FIG-")) | now.isin(*FLOAT_ANCHORS)
    away = statescan.Machine([REACH, *range(REACH)], [True, False], lambda n, x: (0 if x else min(n + 1, REACH), n < REACH))
    rows = rows.withColumns({f"__back_{c}": -F.col(c).cast("long") for c in cols(pos)})
    behind = -F.floor(F.col(cols(pos)[0]) / statescan.CHUNK) if chunk is None else -chunk
    rows = passed(rows, F.when(anchor, 0).otherwise(1), away, "boolean", [f"__back_{c}" for c in cols(pos)], behind).drop(*(f"__back_{c}" for c in cols(pos)))
    floats = (F.col("zone") == "BACK_MATTER") & (F.startswith(now, F.lit("FIG-")) | now.isin(*FLOATS))
    ahead = F.col("__out")
    inside = F.col("in_reference")
    new = F.when(inside, first(FLOAT_IN_REFERENCES)).otherwise(first(FLOAT_ELSEWHERE))
    stays = lambda t: t.startswith("FIG-") or t in FLOAT_ANCHORS
    still = F.when(inside, stays(first(FLOAT_IN_REFERENCES))).otherwise(stays(first(FLOAT_ELSEWHERE)))
    # a float without an anchor ahead: it needs one behind; 'free' becomes an anchor in any case, 'lost' only if it was one
    kinds = ["plain", "anchor", "alone-anchor-stays", "alone-anchor-goes", "alone-other-stays", "alone-other-goes"]

    def float_step(n: int, x: str) -> tuple[int, bool]:
        found = n < REACH
        if not x.startswith("alone"):
            return (0 if x == "anchor" else min(n + 1, REACH)), False
        is_anchor = ("anchor" in x) if found else x.endswith("stays")
        return (0 if is_anchor else min(n + 1, REACH)), not found

    alone = floats & ~ahead
    kind = statescan.numbered([("alone-anchor-stays", alone & anchor & still), ("alone-anchor-goes", alone & anchor), ("alone-other-stays", alone & still), ("alone-other-goes", alone), ("anchor", anchor), ("plain", F.lit(True))], kinds)
    rows = passed(rows.withColumns({"__hit": F.lit(False)}), kind, statescan.Machine([REACH, *range(REACH)], kinds, float_step), "boolean")
    rows = rows.withColumn("__hit", F.col("__out"))
    rows = rows.withColumns({"why": reason(hit, "zone-backmatter-downgrade"), "now": F.when(hit, new).otherwise(now)})

    # text after a heading is flush
    after = statescan.Machine([False, True], [True, False], lambda was, x: (x, was))
    rows = passed(rows, F.when(own.isin("H1", "H2", "H3", "APX-H1", "APX-H2", "APX-H3"), 0).otherwise(1), after, "boolean")
    rows = rows.withColumn("__hit", F.col("__out") & ~F.col("__empty") & F.col("zone").isin("BODY", "BACK_MATTER", "REFERENCE") & (own == "TXT") & F.col("__list").isNull() & ~F.coalesce("__raised", F.lit(False)))
    rows = rows.withColumns({"why": reason(hit, "heading-following-flush"), "now": F.when(hit, F.lit("TXT-FLUSH" if "TXT-FLUSH" in words else "TXT")).otherwise(now)})

    # order of headings; whether the document's last row was a fourth or fifth level lets a third level come early
    rows = written(rows, "repair")
    early = rows.groupBy(*cols(doc)).agg(F.max_by("__h45", F.struct(*cols(pos))).alias("__early")).select(*(F.col(c).alias(f"__{c}") for c in cols(doc)), "__early")
    meets = functools.reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"__{c}")) for c in cols(doc)))
    rows = rows.join(early, meets).drop(*(f"__{c}" for c in cols(doc)))
    trusted, sure = own.isin(*sorted(words)) & (F.col("sure") >= 0.90), F.col("sure") >= 0.7
    level = F.when(now.rlike("^H[1-3]$") | (~trusted & now.rlike("^H[4-6]$")), F.substr(now, F.lit(2)).cast("int")).otherwise(0)
    states = [(0, False, False), *((n, one, two) for n in range(4) for one in (False, True) for two in (False, True) if (n, one, two) != (0, False, False))]
    symbols = [(n, t, s, e) for n in range(7) for t in (False, True) for s in (False, True) for e in (False, True)]
    number = ((level * 2 + trusted.cast("int")) * 2 + sure.cast("int")) * 2 + F.coalesce("__early", F.lit(False)).cast("int")
    rows = passed(rows, number, statescan.Machine(states, symbols, heading_step), "string")
    rows = rows.withColumn("__hit", F.coalesce(F.col("__out") != now, F.lit(False)))
    rows = rows.withColumns({"why": reason(hit, "heading-hierarchy"), "sure": F.when(hit, F.least("sure", F.lit(80.0))).otherwise(F.col("sure")), "now": F.when(hit, F.col("__out")).otherwise(now)})

    # rows of the zone of references, once more
    kept = now.isin("SR", "SRH1") | F.startswith(now, F.lit("APX-REF"))
    if preserve_lists and preserve_markers:
        kept = kept | (F.startswith(now, F.lit("SR")) & ~F.col("__like"))
    headed = inside & F.col("__headed")
    entry = inside & ~headed & ~kept & F.col("__like") & (now != F.col("__referred"))
    rows = rows.withColumn("__hit", F.when(headed, "ref-zone-heading").when(entry, "ref-zone-final"))
    rows = rows.withColumns({"why": F.when(hit.isNotNull(), F.concat("why", F.array(hit))).otherwise(F.col("why")), "sure": F.when(hit.isNotNull(), F.greatest("sure", F.lit(0.99))).otherwise(F.col("sure")), "now": F.when(headed, "REFH2").when(entry, F.col("__referred")).otherwise(now)})

    # sections of references that a marker opens
    stop = (F.col("zone") == "TABLE") | (own.isin(*MARKED_ENDS) & ~F.col("__marker")) | (F.col("__captioned") & own.isin("T1", "BM-TTL", "TXT", "TXT-FLUSH"))
    skip = now.isin("SR", "SRH1") | F.startswith(now, F.lit("APX-REF")) | ~F.col("__bare")
    names = ["heading", "stop", "skip", "entry", "other"]
    symbol = statescan.numbered([("heading", F.col("__marker") & F.col("__title")), ("stop", stop), ("skip", skip), ("entry", _starts(now, "UL-", "BL-", "NL-") | F.col("__like")), ("other", F.lit(True))], names)
    rows = passed(rows.drop("__hit"), symbol, statescan.Machine(range(5), names, marked_step), "string")
    new = F.when(F.col("__out") == "heading", "REFH1").when(F.col("__out") == "entry", F.col("__referred"))
    rows = rows.withColumn("__hit", F.coalesce(new != now, F.lit(False)))
    word = F.when(F.col("__out") == "heading", "ref-marker-heading").otherwise("ref-marker-section")
    why = F.when(hit, F.concat("why", F.array(word))).otherwise(F.col("why"))
    return rows.select(*keys, F.when(hit, new).otherwise(now).alias("tag"), F.when(hit, F.greatest("sure", F.lit(0.99))).otherwise(F.col("sure")).alias("confidence"), (F.size(why) > 0).alias("repaired"), F.nullif(F.concat_ws(",", why), F.lit("")).alias("repair_reason"))
