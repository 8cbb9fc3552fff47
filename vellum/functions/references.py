"""Reference lines: style detection, parsing to structs, author lists, formatting. Built-in functions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .checks import author_parts
from .text import collapsed

#: Words that mark an organisation as author, as the rules have them.
ORGANISATIONS = ("association", "institute", "organization", "society", "academy", "university", "nurses", "center", "committee")
AUTHOR = "struct<family: string, given: string>"


def style(raw: Column) -> Column:
    """APA, AMA, CMS or Unknown, by the first sign that occurs."""
    s = collapsed(raw)
    ama = s.rlike(r"\b\d{4};") | s.rlike(r"[:;]\s*\d{4}\b") | s.rlike(r"\b\d{4}:\d+") | s.rlike(r"^\d+\.\s+[A-Z]") | s.rlike(r"(?i)\bIn:\s+.*eds?")
    return (
        F.when(s.rlike(r"(?i)\(\s*(?:\d{4}[a-z]?|n\.d\.|in press)\s*\)"), "APA").when(ama, "AMA").when(s.rlike(r'",\s+') | s.rlike(r"\bno\.\s+\d+"), "CMS").otherwise("Unknown")
    )


def authors(text: Column) -> Column:
    """Array of (family, given) of an author list in either style; an organisation is one family name."""
    bare = F.regexp_replace(F.trim(text), r"\.+$", "")
    person = r"([A-Z][a-z]+(?:[\-\s]+[A-Z][a-z]+)*)\s*,\s*([A-Z]\.?(?:\s*[A-Z]\.?)*)"

    def group(g: Column) -> Column:
        names, given = F.regexp_extract_all(g, F.lit(person), 1), F.regexp_extract_all(g, F.lit(person), 2)
        pairs = F.zip_with(names, given, lambda a, b: F.struct(F.trim(a).alias("family"), F.trim(b).alias("given")))
        short = F.regexp_extract(g, r"^(.+?)\s+([A-Z]{1,4})$", 2)
        one = F.struct(F.when(short != "", F.trim(F.regexp_extract(g, r"^(.+?)\s+([A-Z]{1,4})$", 1))).otherwise(g).alias("family"), F.nullif(short, F.lit("")).alias("given"))
        return F.when(F.size(pairs) > 0, pairs.cast(f"array<{AUTHOR}>")).otherwise(F.array(one).cast(f"array<{AUTHOR}>"))

    groups = F.filter(F.transform(F.split(bare, r"\s*&\s*"), lambda g: F.regexp_replace(F.trim(g), ",+$", "")), lambda g: g != "")
    many = F.flatten(F.transform(groups, group))
    organisation = F.lower(bare).rlike("|".join(ORGANISATIONS))
    none = F.array().cast(f"array<{AUTHOR}>")
    own = F.array(F.struct(bare.alias("family"), F.lit(None).cast("string").alias("given"))).cast(f"array<{AUTHOR}>")
    return F.when(F.coalesce(text, F.lit("")) == "", none).when(organisation, own).otherwise(many)


def ama_authors(text: Column) -> Column:
    """Array of (family, given) of a list ``Smith JB, Jones K``."""
    each = F.filter(F.transform(F.split(F.regexp_replace(F.trim(text), r"\.+$", ""), r"\s*,\s*"), lambda x: F.trim(x)), lambda a: (a != "") & ~a.rlike(r"(?i)^et al\.?$"))
    p = r"^(.+?)\s+([A-Z]{1,4})$"
    return F.transform(each, lambda a: F.struct(F.when(a.rlike(p), F.regexp_extract(a, p, 1)).otherwise(a).alias("family"), F.nullif(F.regexp_extract(a, p, 2), F.lit("")).alias("given")))


def parsed_ama(raw: Column) -> Column:
    """(authors, title, journal, year) of ``1. Authors. Title. Journal. 2020;...``."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(collapsed(raw), r"^\d+\.\s*", ""), r"\.\s+"), lambda x: F.trim(x)), lambda p: p != "")
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    return F.struct(at(1).alias("authors"), at(2).alias("title"), F.regexp_replace(at(3), "[. ]+$", "").alias("journal"), F.nullif(F.regexp_extract(raw, r"\b((?:19|20)\d{2})\b", 1), F.lit("")).alias("year"))


def parsed_apa(raw: Column) -> Column:
    """(authors, title, journal, year) of ``Authors (2020). Title. Journal, ...``; other lines are cut at full stops."""
    s = collapsed(raw)
    p = r"^(.+?)\s*\((\d{4})\)\.\s*(.+?)\.\s*([^,.]+)"
    parts = F.filter(F.transform(F.split(s, r"\."), lambda x: F.trim(x)), lambda x: x != "")
    at = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i)), F.lit(""))
    pick = lambda g, i: F.when(s.rlike(p), F.trim(F.regexp_extract(s, p, g))).otherwise(at(i))
    year = F.when(s.rlike(p), F.regexp_extract(s, p, 2)).otherwise(F.nullif(F.regexp_extract(s, r"\b((?:19|20)\d{2})\b", 1), F.lit("")))
    return F.struct(pick(1, 1).alias("authors"), pick(3, 2).alias("title"), pick(4, 3).alias("journal"), year.alias("year"))


def initials(given: Column) -> Column:
    """First letters of the parts of a given name, in capitals."""
    return F.array_join(F.transform(F.filter(F.split(F.coalesce(given, F.lit("")), "[ -]"), lambda p: p.rlike(r"^\p{L}")), lambda p: F.upper(F.left(p, F.lit(1)))), "")


def apa_authors_text(people: Column) -> Column:
    """``Smith, J., & Jones, K.``; "Unknown authors" for an empty list."""
    one = lambda a: F.concat(a["family"], F.lit(", "), F.when(F.coalesce(a["given"], F.lit("")) != "", F.concat(F.left(a["given"], F.lit(1)), F.lit("."))).otherwise(""))
    names = F.transform(people, lambda a: F.trim(one(a)))
    n = F.size(names)
    last = F.concat(F.lit("& "), F.try_element_at(names, F.lit(-1)))
    return F.when(n == 0, "Unknown authors").when(n == 1, F.try_element_at(names, F.lit(1))).otherwise(F.array_join(F.concat(F.slice(names, F.lit(1), F.greatest(n - 1, F.lit(1))), F.array(last)), ", "))


def ama_authors_text(people: Column) -> Column:
    """``Smith JB, Jones K``; of more than six the first three and et al."""
    names = F.transform(people, lambda a: F.trim(F.concat_ws(" ", a["family"], F.nullif(initials(a["given"]), F.lit("")))))
    return F.when(F.size(people) == 0, "Unknown authors").when(F.size(people) <= 6, F.array_join(names, ", ")).otherwise(F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.lit(", et al.")))


def apa_text(people: Column, year: Column, title: Column, journal: Column) -> Column:
    return F.concat(apa_authors_text(people), F.lit(" ("), F.coalesce(year, F.lit("n.d.")), F.lit("). "), title, F.lit(". "), journal, F.lit("."))


def ama_text(people: Column, year: Column, title: Column, journal: Column) -> Column:
    return F.concat(F.regexp_replace(ama_authors_text(people), r"\.$", ""), F.lit(". "), title, F.lit(". "), journal, F.lit(". "), F.coalesce(year, F.lit("")), F.lit("."))


def ordinal(n: Column) -> Column:
    """``2`` as 2nd; text that isn't a number stays."""
    v = F.try_to_number(F.when(n.rlike("^[0-9]{1,9}$"), n), F.lit("999999999")).cast("int")
    end = F.when((v % 100).between(11, 13), "th").when(v % 10 == 1, "st").when(v % 10 == 2, "nd").when(v % 10 == 3, "rd").otherwise("th")
    return F.when(v.isNotNull(), F.concat(v.cast("string"), end)).otherwise(n)


def source_kind(raw: Column) -> Column:
    """journal, web or book, by signs in the line."""
    return F.when(raw.rlike(r"(?i)https?://|accessed|retrieved"), "web").when(raw.rlike(r"(?i)\beds?\.|\bpublish|\bpress\b|\bedition\b|ISBN"), "book").otherwise("journal")


def number_prefix(raw: Column) -> Column:
    """(number, format) of a leading label: ``12.``, ``[12]``, ``(12)`` or ``12 ``; null without one."""
    forms = [("dot", r"^\s*(\d{1,4})\.\s"), ("square", r"^\s*\[(\d{1,4})\]"), ("round", r"^\s*\((\d{1,4})\)"), ("space", r"^\s*(\d{1,4})\s+[A-Z]")]
    return F.coalesce(*(F.when(raw.rlike(p), F.struct(F.regexp_extract(raw, p, 1).cast("int").alias("number"), F.lit(n).alias("format"))) for n, p in forms))


def display_authors(full: Column, organisation: Column) -> Column:
    """Authors as a text cites them. Notes in square brackets go; an organisation stays whole. Of people the first is named:
    alone, with the second after an ampersand if there are two, with et al. if there are more or the list says so. A list
    without names counts its capitalised words, and without those shows its first word."""
    plain = F.trim(F.regexp_replace(full, r"\[.*?\]", ""))
    parts = author_parts(plain)
    named = F.when(F.size(parts["names"]) > 0, parts["names"]).otherwise(parts["words"])
    count = F.size(named) + F.when(parts["further"], 2).otherwise(0)
    shown = F.when(count >= 3, F.concat(F.get(named, F.lit(0)), F.lit(" et al."))).when(count == 2, F.concat_ws(" & ", named)).otherwise(F.get(named, F.lit(0)))
    return F.when(F.coalesce(organisation, F.lit(False)), plain).otherwise(F.when(F.size(named) == 0, F.substring_index(plain, " ", 1)).otherwise(shown))


# Beginnings of reference lines by style (authors, date or year).
LINES = {
    "APA": r"^(.+?)\s*\(((?:(?:19|20)\d{2}[a-z]?|n\.?d\.?(?:-[a-z])?|in press).*?)\)\.?",
    "Vancouver": r"^([A-Z][^.]+?)\.\s*[^.]+?\.\s*.*?(\d{4})",
    "Chicago": r"^([A-Z][^.]+?)\.\s*(\d{4})\.\s*",
}
SHORT_FORM = r"[\[(]([A-Z]{2,})[\])]"


def parsed_line(line: Column, style_name: str) -> Column:
    """(author, year, full_author, abbreviations) of a reference line of one style; null where the line isn't of it. The
    author is as a text cites it. Short forms are those in brackets, else (APA) the initials of a name of three or more
    capitalised words without a comma."""
    pattern = LINES[style_name]
    people, date = F.trim(F.regexp_extract(line, pattern, 1)), F.trim(F.regexp_extract(line, pattern, 2))
    before_comma = lambda c: F.trim(F.substring_index(c, ",", 1))
    commas = F.split(people, ",")
    none = F.array().cast("array<string>")
    if style_name == "APA":
        year = (
            F.when(date.rlike(r"\b(?:19|20)\d{2}[a-z]?\b"), F.regexp_extract(date, r"\b((?:19|20)\d{2}[a-z]?)\b", 1))
            .when(F.contains(F.lower(date), F.lit("n.d")), F.coalesce(F.nullif(F.regexp_extract(date, r"(?i)\bn\.?d\.?(?:-[a-z])?\b", 0), F.lit("")), F.lit("n.d.")))
            .when(F.contains(F.lower(date), F.lit("in press")), "in press").otherwise(date)
        )
        full = F.regexp_replace(F.trim(F.regexp_replace(people, r"(?i)\s*\(\s*Eds?\.?\s*\)", "")), r",\s*$", "")
        clean = F.trim(F.regexp_replace(full, r"\s*[\[(][^\])]+[\])]\s*", " "))
        given, words = F.regexp_extract_all(full, F.lit(SHORT_FORM), 1), F.filter(F.split(clean, r"\s+"), lambda w: w != "")
        name = ~F.contains(clean, F.lit(",")) & (F.size(words) >= 3) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}"))
        short = F.when(F.size(given) > 0, given).when(name, F.array(F.array_join(F.transform(words, lambda w: F.left(w, F.lit(1))), ""))).otherwise(none)
        sides = F.split(clean, "&")
        author = F.when(F.size(sides) == 2, F.concat_ws(" & ", before_comma(sides[0]), before_comma(sides[1]))).otherwise(before_comma(sides[0]))
    else:
        full, year, short = people, date, none
        if style_name == "Vancouver":
            author = F.when(F.size(commas) >= 3, F.concat(F.trim(commas[0]), F.lit(" et al"))).when(F.size(commas) == 2, F.concat_ws(" and ", F.trim(commas[0]), F.trim(F.get(commas, F.lit(1))))).otherwise(people)
        else:
            author = F.when(F.size(commas) >= 3, F.concat(F.trim(commas[0]), F.lit(" et al."))).otherwise(F.trim(commas[0]))
    return F.when(line.rlike(pattern), F.struct(author.alias("author"), year.alias("year"), full.alias("full_author"), short.alias("abbreviations")))
