"""Technical edits: a dictionary of patterns to find, and replacements that a user has chosen.

Rules apply in order, each to what earlier ones have left: text that a rule has put in is closed to later rules, and
cuts the text around it, so that no later match reaches across. Built-in string and array functions only; word
boundaries, digits and case are Unicode's.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rules in their order, with category and the choices that a user has.
RULES = {
    "unpaired_quotes": (None, "Punctuation & Symbols", ("Ignore", "Highlight")),
    "special_chars": (r"[^\x00-\x7F]+", "Punctuation & Symbols", ("Ignore", "Highlight")),
    "trademark": (r"[®©™]", "Punctuation & Symbols", ("Ignore", "Highlight")),
    "greek": ("[\u0370-\u03ff]+", "Punctuation & Symbols", ("Ignore", "Highlight")),
    "unpaired_parens": (None, "Punctuation & Symbols", ("Ignore", "Highlight")),
    "thousand_separator": (r"\b\d{4,}\b", "Numbers & Units", ("x,xxx", "xxxx")),
    "spell_out_numbers": (r"\b([0-9]|[1-9][0-9])\b", "Numbers & Units", ("Spell Out", "Keep Digits")),
    "degree_symbol": (r"\b\d+\s*(degrees?|°)\b", "Numbers & Units", ("°", "degrees")),
    "percent_symbol": (r"\b(percent|per cent|%)\b", "Numbers & Units", ("%", "percent", "per cent")),
    "units_mmHg": (r"\bmm\s*Hg\b", "Numbers & Units", ("mmHg", "mm Hg")),
    "micro_units": (r"\b(mcg|mcm|mcl|micron|micro)\b", "Numbers & Units", ("µg", "µm", "µL", "mcg", "mcm")),
    "per_usage": (r"\b(per|/)\s*(dL|L|min|mL|µL)\b", "Numbers & Units", ("per unit", "/unit")),
    "latin_abbrev": (r"\b(e\.g\.|eg|i\.e\.|ie)\b", "Abbreviation & Terminology", ("e.g.", "i.e.", "eg", "ie", "Highlight")),
    "xray": (r"\b[xX][- ]?ray\b", "Abbreviation & Terminology", ("X-ray", "X Ray", "x ray")),
    "vs": (r"\b(vs\.|versus|v\.|vs)\b", "Abbreviation & Terminology", ("vs.", "versus", "v.", "vs")),
    "chemical_prefixes": (r"\b[DLN]-\w+", "Abbreviation & Terminology", ("Small Caps Prefix", "Regular Prefix")),
    "chemical_formulas": (r"\b(CO2|O2|H2O)\b", "Abbreviation & Terminology", ("Subscript Numbers", "Small Caps (User Request)", "Regular")),
    "time_format": (r"\b(AM|PM|a\.m\.|p\.m\.|am|pm)\b", "Abbreviation & Terminology", ("SMALL CAPS (AM/PM)", "a.m./p.m.", "AM/PM")),
    "dsm_covid": (r"\b(DSM|COVID[- ]?19)\b", "Abbreviation & Terminology", ("DSM", "COVID-19")),
    "fig_table_cite": (r"\b(Figure|Fig\.|Table|Tab\.)\s*\d+", "Citations & References", ("Figure X", "Fig. X", "Highlight")),
    "cross_ref": (r"\b(Section|section|Chapter|chapter)\s*\d+", "Citations & References", ("Capitalized", "lowercase")),
    "p_value": (r"\b[pP][- ]?value\b", "Citations & References", ("P value", "p value", "p-value")),
    "comparison": (r"(>|<|≥|≤|=|less than|greater than|equal to)", "Comparisons", ("<", ">", "=", "less than", "greater than")),
}
#: What each match begins with, in either case (with the letters that fold to i and s), so that dearer tests run at few places only.
LEADS = {
    "spell_out_numbers": "[0-9]", "degree_symbol": r"\d", "percent_symbol": "[Pp%][Ee]?", "units_mmHg": "[Mm][Mm]", "micro_units": "[Mm][CcIiİı]", "per_usage": "[Pp/]", "latin_abbrev": "[EeIiİı][.GgEe]", "xray": "[Xx]",
    "vs": "[Vv][.EeSsſ]", "chemical_prefixes": "[DdLlNn]-", "chemical_formulas": "[CcOoHh][Oo2]", "time_format": "[AaPp][.Mm]", "dsm_covid": "[DdCc][SsſOo]", "fig_table_cite": "[FfTt][IiİıAa]", "cross_ref": "[SsſCc][EeHh]",
    "p_value": "[Pp]", "comparison": "[<>≥≤=LlGgEe]",
}
#: What every match holds, one of these in lower case; a text without them isn't searched. "" is any letter outside ASCII.
NEEDED = {
    "special_chars": [""], "trademark": ["®", "©", "™"], "greek": [""], "degree_symbol": ["degree", "°"], "percent_symbol": ["per", "%"], "units_mmHg": ["hg"], "micro_units": ["mc", "micro"], "per_usage": ["per", "/"],
    "latin_abbrev": ["eg", "e.", "ie"], "xray": ["ray"], "vs": ["v"], "chemical_prefixes": ["-"], "chemical_formulas": ["o2", "h2o"], "time_format": ["m"], "dsm_covid": ["dsm", "covid"], "fig_table_cite": ["fig", "tab"],
    "cross_ref": ["section", "chapter"], "p_value": ["value"], "comparison": [">", "<", "≥", "≤", "=", "less", "greater", "equal"],
}
# Choices that change no text.
NO_TEXT = ("Ignore", "Highlight", "Spell Out", "Keep Digits", "x,xxx", "xxxx")
#: Noncharacters, which no text holds: begin and end of a match, begin and end of closed text.
_FROM, _TO, _SHUT, _OPEN = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"


def pattern(rule: str) -> str:
    lead = f"(?={LEADS[rule]})" if rule in LEADS else ""
    return f"(?U){lead}(?i){RULES[rule][0]}"


def found(text: Column) -> Column:
    """Array of (rule, count, matches: distinct, in order) of the rules that a text meets. Unpaired quotes and brackets give
    what is wrong instead of matches."""
    many = lambda c: F.length(text) - F.length(F.replace(text, F.lit(c)))
    straight, left, right, opened, closed = many('"'), many("“"), many("”"), many("("), many(")")
    say = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    quotes = F.array_compact(F.array(F.when(straight % 2 == 1, say('Unpaired straight quotes (") found: ', straight)), F.when(left != right, say("Unpaired smart quotes (open=", left, ", close=", right, ")"))))
    own = {
        "unpaired_quotes": (F.lit(None).cast("int"), quotes),
        "unpaired_parens": (F.abs(opened - closed).cast("int"), F.when(opened != closed, F.array(say("Open: ", opened, ", Close: ", closed))).otherwise(F.array().cast("array<string>"))),
    }
    plain = F.octet_length(text) == F.length(text)
    low = F.lower(F.when(plain, text).otherwise(F.translate(text, "ſ\u212aıİ", "skii")))  # letters that fold to ASCII

    def each(x: Column) -> Column:
        out = []
        for name, (p, *_) in RULES.items():
            n, hits = own[name] if p is None else (F.lit(None).cast("int"), F.regexp_extract_all(x["text"], F.lit(pattern(name)), F.lit(0)))
            if name in NEEDED:
                may = reduce(or_, (F.contains(x["low"], F.lit(w)) if w else ~x["plain"] for w in NEEDED[name]))
                hits = F.when(may, hits).otherwise(F.array().cast("array<string>"))
            out.append(F.struct(F.lit(name).alias("rule"), n.alias("count"), hits.alias("matches")))
        return F.array(*out)

    all_rules = F.get(F.transform(F.array(F.struct(text.alias("text"), low.alias("low"), plain.alias("plain"))), each), F.lit(0))
    # a rule's matches are looked for once; its count and distinct matches are taken from what was found
    counted = lambda r: F.coalesce(r["count"], F.size(r["matches"]))
    met = F.filter(all_rules, lambda r: counted(r) > 0)
    return F.transform(met, lambda r: F.struct(r["rule"].alias("rule"), counted(r).alias("count"), F.array_sort(F.array_distinct(r["matches"])).alias("matches")))


def _replacing(name: str, choice: str):
    """A function of one piece of text that puts the choice in, unless the piece is closed."""
    put = f"{_SHUT}{choice}{_OPEN}".replace("\\", "\\\\").replace("$", "\\$")

    def one(piece: Column) -> Column:
        marked = F.replace(F.regexp_replace(piece, pattern(name), f"{_FROM}$0{_TO}"), F.lit(f"{_FROM}{choice}{_TO}"), F.lit(choice))
        return F.when(F.startswith(piece, F.lit(_SHUT)), piece).otherwise(F.regexp_replace(marked, f"{_FROM}[^{_TO}]*{_TO}", put))

    return one


def edited(text: Column, choices: Mapping[str, str]) -> Column:
    """(text, edits) after the chosen replacements; ``edits`` are the inserted texts in order. Choices that only format or
    keep text change nothing. A match that is the choice already stays open to later rules."""
    unknown = set(choices) - set(RULES)
    if unknown:
        raise ValueError(f"no such rules: {sorted(unknown)}")
    now = text
    for name, choice in choices.items():  # in the user's order
        if RULES[name][0] is None or choice in NO_TEXT or "Small Caps" in choice or "Subscript" in choice:
            continue
        pieces = F.split(F.replace(F.replace(now, F.lit(_SHUT), F.lit(_FROM + _SHUT)), F.lit(_OPEN), F.lit(_OPEN + _FROM)), _FROM)

        now = F.array_join(F.transform(pieces, _replacing(name, choice)), "")
    return F.struct(F.translate(now, _SHUT + _OPEN, "").alias("text"), F.regexp_extract_all(now, F.lit(f"{_SHUT}([^{_OPEN}]*){_OPEN}"), 1).alias("edits"))


def totals(df: DataFrame, text: str) -> DataFrame:
    """(rule, category, matches, rows) over all rows: counted per row first, then added up."""
    named = F.create_map(*(F.lit(x) for k, v in RULES.items() for x in (k, v[1])))
    each = df.select(F.explode(F.transform(found(F.col(text)), lambda r: F.struct(r["rule"].alias("rule"), r["count"].alias("count")))).alias("r")).select("r.*")
    return each.groupBy("rule").agg(F.sum("count").alias("matches"), F.count("*").alias("rows")).withColumn("category", named[F.col("rule")])
