"""Column functions on text: normalisation, tokens, markers, numbers, scripts, credits. All stay in the JVM.

Java's ``\\s`` and ``\\w`` are ASCII unless ``(?U)`` is on; classes are written out where both engines must agree.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = r"[ \t\n\r\f\x0B]"
WORD = r"[\p{L}\p{N}_]+"

#: Vocabulary of the rules below, in the order in which they're tried.
SMART = {"‘": "'", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " "}
SCRIPTS = {"greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x4FF), "hebrew": (0x590, 0x5FF), "arabic": (0x600, 0x6FF), "devanagari": (0x900, 0x97F), "thai": (0xE00, 0xE7F), "kana": (0x3040, 0x30FF), "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7AF)}
SOURCE_STARTS = ("source:", "sources:", "adapted from", "reproduced from", "reprinted from", "data from", "courtesy of", "with permission")
TABLE_NOTE_MARKS = "*†‡§‖¶#"


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def stripped(c: Column) -> Column:
    """``strip`` of a column that is at hand (it is named several times): only texts with white space at an end are
    searched, as the search tries each place."""
    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return F.when(ends.rlike(r"(?U)\s"), strip(c)).otherwise(c)


def collapsed(c: Column) -> Column:
    """Runs of ASCII white space as one space, trimmed."""
    return F.trim(F.regexp_replace(c, f"{WHITE}+", " "))


def cache_text(c: Column) -> Column:
    """Tags as spaces, white space collapsed, lower case."""
    return F.lower(collapsed(F.regexp_replace(c, "<[^>]+>", " ")))


def ascii_punctuation(c: Column) -> Column:
    """Smart quotes, dashes and hard spaces as ASCII."""
    return F.translate(c, "".join(SMART), "".join(SMART.values()))


def without_list_number(c: Column) -> Column:
    """Without the list number or bullet at the start of each line."""
    return F.regexp_replace(c, r"(?m)^[ \t]*(?:\d+[.)]|[•●–-])[ \t]+", "")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), 0)


def tokens(c: Column) -> Column:
    """Lower-case words that aren't just digits."""
    return F.filter(words(F.lower(c)), lambda t: ~t.rlike("^[0-9]+$"))


def marker_token(c: Column) -> Column:
    """Leading ``<token>`` of a text, null if there is none."""
    t = F.regexp_extract(c, r"^\s*<(/?[A-Za-z][A-Za-z0-9 _-]*)>", 1)
    return F.when(t != "", t)


def marker_only(c: Column) -> Column:
    return c.rlike(r"^\s*</?[A-Za-z][A-Za-z0-9 _-]*>\s*$")


def tag_parts(c: Column) -> Column:
    """(prefix, position) of a tag such as ``BL-FIRST``."""
    return F.struct(F.regexp_replace(c, "-(FIRST|MID|LAST)$", "").alias("prefix"), F.nullif(F.regexp_extract(c, "-(FIRST|MID|LAST)$", 1), F.lit("")).alias("position"))


def list_base(c: Column) -> Column:
    """(base, depth) of a list tag: ``BL2-MID`` is (BL, 2); depth 1 without a number."""
    base = F.regexp_extract(c, "^([A-Z]+?)([0-9]*)(?:-(?:FIRST|MID|LAST))?$", 1)
    depth = F.regexp_extract(c, "^([A-Z]+?)([0-9]*)(?:-(?:FIRST|MID|LAST))?$", 2)
    return F.struct(base.alias("base"), F.coalesce(F.try_to_number(F.nullif(depth, F.lit("")), F.lit("999")).cast("int"), F.lit(1)).alias("depth"))


def numbers(c: Column) -> Column:
    """Numbers of a citation such as ``1, 3-5``; ranges are expanded, reversed ones dropped."""
    dash = F.regexp_replace(c, "[–—]", "-")
    parts = F.regexp_extract_all(dash, F.lit(r"\d+(?:\s*-\s*\d+)?"), 0)

    def expand(p: Column) -> Column:
        ends = F.split(p, r"\s*-\s*")
        a, b = F.element_at(ends, 1).cast("int"), F.element_at(ends, -1).cast("int")
        return F.when(b >= a, F.sequence(a, b, F.lit(1))).otherwise(F.array().cast("array<int>"))

    return F.flatten(F.transform(parts, expand))


def number_ranges(sorted_numbers: Column) -> Column:
    """Ascending distinct numbers as text: runs of three or more as ``a-b``, other numbers one by one, joined by ", "."""
    step = F.transform(sorted_numbers, lambda x, i: F.struct((x - i).alias("g"), x.alias("x")))
    keys = F.array_distinct(F.transform(step, lambda s: s["g"]))

    def one(g: Column) -> Column:
        xs = F.transform(F.filter(step, lambda s: s["g"] == g), lambda s: s["x"])
        a, b = F.array_min(xs).cast("string"), F.array_max(xs).cast("string")
        return F.when(F.size(xs) >= 3, F.concat(a, F.lit("-"), b)).when(F.size(xs) == 2, F.concat(a, F.lit(","), b)).otherwise(a)

    return F.array_join(F.transform(keys, one), ", ")


def full_pages(c: Column) -> Column:
    """Page range with its end written out: ``123-9`` is ``123-129``."""
    a, b = F.regexp_extract(c, r"^(\d+)-(\d+)$", 1), F.regexp_extract(c, r"^(\d+)-(\d+)$", 2)
    return F.when((a != "") & (F.length(b) < F.length(a)), F.concat(a, F.lit("-"), F.substr(a, F.lit(1), F.length(a) - F.length(b)), b)).otherwise(c)


def doi(c: Column) -> Column:
    d = F.regexp_extract(c, r"(10\.[0-9]{4,9}/[-._;()/:A-Za-z0-9]+)", 1)
    return F.when(d != "", F.regexp_replace(d, "[.;,)]+$", ""))


def preview(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit("..."))).otherwise(c)


def scripts(c: Column) -> Column:
    """Names of the scripts that occur, in fixed order."""
    each = [F.when(c.rlike(f"[\\x{{{a:X}}}-\\x{{{b:X}}}]"), F.lit(n)) for n, (a, b) in SCRIPTS.items()]
    return F.array_compact(F.array(*each))


def needs_permission(caption: Column, credit: Column) -> Column:
    """Whether credit (else caption) speaks of another's work."""
    return F.coalesce(F.nullif(credit, F.lit("")), caption).rlike("(?i)(reprinted|reproduced|adapted|courtesy|permission|copyright|©)")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"[^.!?]+[.!?]*"), 0), lambda s: F.trim(s)), lambda s: s != "")


def surname(c: Column) -> Column:
    """First surname of an author list: what stands before the first comma, ampersand or ``et al``."""
    return F.trim(F.regexp_replace(F.regexp_extract(c, r"^([^,&]+)", 1), r"(?i)\s+(et al\.?|and\s.*)$", ""))


def acronym(c: Column) -> Column:
    """Initials of capitalised words."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"\b([A-Z])[A-Za-z]*"), 1), lambda x: x), "")


def citation_key(author: Column, year: Column) -> Column:
    return F.concat_ws("|", F.lower(strip(author)), strip(year.cast("string")))


def features(c: Column) -> Column:
    """Text features for rule learning, as a struct of booleans and classes."""
    n = F.size(F.split(F.trim(c), f"{WHITE}+"))
    return F.struct(
        F.when(n <= 3, "short").when(n <= 12, "medium").otherwise("long").alias("length_class"),
        c.rlike("^[0-9]").alias("starts_digit"), c.rlike(r"^\s*[•●*-]").alias("starts_bullet"), c.rlike(r"^\s*<").alias("starts_marker"),
        c.rlike(r"[.!?]\s*$").alias("ends_stop"), c.rlike(r":\s*$").alias("ends_colon"), c.rlike("[0-9]").alias("has_digit"), c.rlike(r"\(").alias("has_paren"),
        c.rlike("https?://").alias("has_url"), (F.upper(c) == c).alias("all_caps"), c.rlike("^[A-Z]").alias("starts_capital"),
    )


def paragraph_features(text: Column, zone: Column, list_kind: Column, list_position: Column) -> Column:
    """The whole feature struct of a paragraph: size, labels, form, content signs, zone and list facts. A null text counts
    as empty, a null zone as BODY."""
    text, zone = F.coalesce(text, F.lit("")), F.coalesce(zone, F.lit("BODY"))
    s = strip(text)
    low = F.lower(s)
    words = F.regexp_count(text, F.lit(r"(?U)\S+"))
    capitals = F.regexp_count(s, F.lit(r"(?U)(^|\s)\p{Lu}"))
    label = lambda inner, flags="": s.rlike(rf"{flags}^({inner}[.)]|\({inner}\))\s")
    numbered = label("[0-9]+") | s.rlike(r"^\[[0-9]+\]\s")
    bullet = s.rlike(r"^[•●*–—-]\s")
    year = text.rlike(r"(^|[^\p{L}\p{N}_])(19|20)[0-9]{2}([^\p{L}\p{N}_]|$)")
    cited = (year | F.contains(low, F.lit("doi")) | F.contains(low, F.lit("et al"))) & (F.regexp_count(text, F.lit("[.;:,]")) >= 2)
    starts = lambda c, *xs: F.exists(F.array(*map(F.lit, xs)), lambda x: F.startswith(c, x))
    n = F.length(s)
    each = {
        "length": F.length(text), "word_count": words, "is_empty": n == 0, "is_short": n < 50, "is_long": n > 500,
        "has_number_prefix": numbered, "has_letter_prefix": label("[a-z]", "(?i)"), "has_roman_prefix": label("[ivxlcdm]+", "(?i)"), "has_bullet": bullet,
        "is_all_caps": s.rlike("^[A-Z0-9 \t\n\r\f,.:;!?'\"-]+$"), "starts_with_digit": s.rlike(r"^\p{Nd}"), "ends_with_period": F.endswith(s, F.lit(".")), "ends_with_colon": F.endswith(s, F.lit(":")),
        "has_citation_year": year, "looks_like_heading": (n > 0) & (n <= 200) & ~s.rlike("[.!?]$") & (capitals >= F.greatest(F.lit(1), F.floor(F.lit(0.6) * words))),
        "looks_like_caption": starts(low, "figure", "table", "fig.", "tab."), "looks_like_reference": (n > 0) & (numbered | bullet | cited), "looks_like_footnote": starts(s, "*", "†", "‡") | s.rlike(r"^[a-z]\)"),
        "zone": zone, "is_in_table": zone == "TABLE", "is_in_box": F.startswith(zone, F.lit("BOX_")), "is_in_back_matter": zone == "BACK_MATTER",
        "list_kind": list_kind, "list_position": list_position,
    }
    return F.struct(*(c.alias(k) for k, c in each.items()))


def unbalanced(c: Column) -> Column:
    """(odd quotes, excess of opening over closing round, square and curly brackets)."""
    count = lambda p: F.regexp_count(c, F.lit(p)).cast("long")
    return F.struct((count('"') % 2 == 1).alias("odd_quotes"), (count(r"\(") - count(r"\)")).alias("round"), (count(r"\[") - count(r"\]")).alias("square"), (count(r"\{") - count(r"\}")).alias("curly"))


def is_source_line(c: Column) -> Column:
    low = F.lower(F.trim(c))
    out = F.lit(False)
    for s in SOURCE_STARTS:
        out = out | low.startswith(s)
    return out


def is_table_note(c: Column) -> Column:
    t = strip(c)
    return F.lower(t).startswith("note") | F.left(t, F.lit(1)).isin(*TABLE_NOTE_MARKS) | t.rlike(r"^[a-z]\s") | t.rlike(r"(?i)^[a-z]\)")


def json_ladder(c: Column, schema: str) -> Column:
    """Parse a JSON array: as it is, else the slice from the first [ to the last ], else cut after the last }, else each
    flat object alone."""
    parse = lambda x: F.from_json(x, f"array<{schema}>")
    usable = lambda x: F.when(F.get_json_object(x, "$[0]").isNotNull() & x.rlike(r"\]\s*$"), parse(x))
    sliced = F.regexp_extract(c, r"(?s)(\[.*\])", 1)
    cut = F.concat(F.regexp_extract(c, r"(?s)(\[.*\})", 1), F.lit("]"))
    flat = F.concat(F.lit("["), F.array_join(F.regexp_extract_all(c, F.lit(r"\{[^{}]*\}"), 0), ","), F.lit("]"))
    return F.coalesce(usable(c), usable(sliced), usable(cut), usable(flat))


def error_parts(c: Column) -> Column:
    """(code, message) of ``[CODE] message``; the code is null where there is none."""
    return F.struct(F.nullif(F.regexp_extract(c, r"^\[([A-Z_]+)\]\s*", 1), F.lit("")).alias("code"), F.regexp_replace(c, r"^\[[A-Z_]+\]\s*", "").alias("message"))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def page_key(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of parts joined by colons."""
    return F.left(F.sha2(F.concat_ws(":", *parts), 256), F.lit(16))
