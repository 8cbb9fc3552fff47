"""Relations of a word file's parts: text by part, tables, sections, comments, notes, numbering, styles, runs.

Each takes a ``binaryFile`` relation (path, content) and opens only the parts that it needs. A file that is no archive, a
part that is no XML and a part that isn't there give no rows; ``broken`` lists the first two. What refers to something
else (numbers to their definitions, styles to the styles they build on) is resolved by joins; chains by pointer doubling.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.sequence import Names, cols
from . import archive
from .docx import W, _number, _text, _value
from .shared import written

_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_()}
#: Most levels of a numbered list.
LEVELS = 9


def relation(files: DataFrame, wanted: str, rows: Callable[[str, ElementTree.Element], Iterator[tuple]], schema: str) -> DataFrame:
    """(doc: path, then schema) of what ``rows`` gives for each wanted part's name and root element."""
    fields = [f.split() for f in schema.split(", ")]
    kinds = pa.schema([("doc", pa.string()), *((n, _ARROW[k]) for n, k in fields)])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        pattern = re.compile(wanted)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                for name, read in archive.listed(content.as_py() or b""):
                    if not pattern.fullmatch(name):
                        continue
                    try:
                        root = ElementTree.fromstring(read())
                    except ElementTree.ParseError:
                        continue
                    yield from ((path, *r) for r in rows(name, root))

    return files.select("path", "content").mapInArrow(lambda batches: archive.batched(found(batches), kinds), f"doc string, {schema}")


def broken(files: DataFrame) -> DataFrame:
    """(doc, problem) of files that are no archives, have no body part, or a body part that is no XML."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                body, seen = None, False
                for name, read in archive.listed(content.as_py() or b""):
                    seen = True
                    if name == "word/document.xml":
                        body = read()
                if body is None:
                    out.append((path, "no body" if seen else "not an archive"))
                    continue
                try:
                    ElementTree.fromstring(body)
                except ElementTree.ParseError:
                    out.append((path, "body is no XML"))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], ["doc", "problem"])

    return files.select("path", "content").mapInArrow(run, "doc string, problem string")


def texts(files: DataFrame) -> DataFrame:
    """All visible text (doc, part, kind, place, text): body, table, header, footer, footnote, endnote, comment. Blank
    paragraphs are left out; table paragraphs follow the body's."""

    def rows(name: str, root: ElementTree.Element) -> Iterator[tuple]:
        kind = re.match(r"word/([a-z]+)", name)[1].removesuffix("s")
        if kind == "document":
            body = root.find(f"{W}body")
            found = [("body", p) for p in body.findall(f"{W}p")] + [("table", p) for t in body.findall(f"{W}tbl") for p in t.iter(f"{W}p")]
        else:
            found = [(kind, p) for p in root.iter(f"{W}p")]
        place = 0
        for where, p in found:
            text = _text(p).strip()
            if text:
                place += 1
                yield name, where, place, text

    return relation(files, r"word/(document|header\d*|footer\d*|footnotes|endnotes|comments)\.xml", rows, "part string, kind string, place int, text string")


def tables(files: DataFrame) -> DataFrame:
    """(doc, table_index, rows, columns, nested, last_row): size of each top-level table, tables inside its cells, and the
    text of its last row where that has one cell only."""

    def rows(_: str, root: ElementTree.Element) -> Iterator[tuple]:
        for i, t in enumerate(root.find(f"{W}body").findall(f"{W}tbl")):
            lines = t.findall(f"{W}tr")
            grid = t.find(f"{W}tblGrid")
            wide = len(grid.findall(f"{W}gridCol")) if grid is not None else max((len(r.findall(f"{W}tc")) for r in lines), default=0)
            nested = sum(len(c.findall(f"{W}tbl")) for r in lines for c in r.findall(f"{W}tc"))
            last = lines[-1].findall(f"{W}tc") if lines else []
            yield i, len(lines), wide if lines else 0, nested, "\n".join(_text(p) for p in last[0].findall(f"{W}p")).strip() if len(last) == 1 else None

    return relation(files, r"word/document\.xml", rows, "table_index int, rows int, columns int, nested int, last_row string")


#: Kinds of breaks between sections.
BREAKS = {"continuous": "continuous", "nextColumn": "new_column", "nextPage": "new_page", "evenPage": "even_page", "oddPage": "odd_page"}


def sections(files: DataFrame) -> DataFrame:
    """(doc, section, break_type, paragraphs): sections in order, and how many body paragraphs each has."""

    def rows(_: str, root: ElementTree.Element) -> Iterator[tuple]:
        n, size = 0, 0
        body = root.find(f"{W}body")
        for node in body:
            if node.tag == f"{W}p":
                size += 1
            mark = node if node.tag == f"{W}sectPr" else node.find(f"{W}pPr/{W}sectPr") if node.tag == f"{W}p" else None
            if mark is not None:
                yield n, BREAKS.get(_value(mark, f"{W}type") or "nextPage", "new_page"), size
                n, size = n + 1, 0

    return relation(files, r"word/document\.xml", rows, "section int, break_type string, paragraphs int")


def comments(files: DataFrame) -> DataFrame:
    """(doc, comment, author, text)."""

    def rows(_: str, root: ElementTree.Element) -> Iterator[tuple]:
        for i, c in enumerate(root.iter(f"{W}comment")):
            yield i, c.get(f"{W}author", "Unknown"), "".join(t.text or "" for t in c.iter(f"{W}t"))

    return relation(files, r"word/comments\.xml", rows, "comment int, author string, text string")


def references(files: DataFrame) -> DataFrame:
    """(doc, footnotes, endnotes, images): references to notes in the body, and image relationships of the body part."""

    def rows(name: str, root: ElementTree.Element) -> Iterator[tuple]:
        if name.endswith(".rels"):
            yield "images", sum("image" in r.get("Type", "") for r in root)
        else:
            yield "footnotes", sum(1 for _ in root.iter(f"{W}footnoteReference"))
            yield "endnotes", sum(1 for _ in root.iter(f"{W}endnoteReference"))

    found = relation(files, r"word/(document\.xml|_rels/document\.xml\.rels)", rows, "kind string, n long")
    return found.groupBy("doc").pivot("kind", ["footnotes", "endnotes", "images"]).agg(F.sum("n")).fillna(0)


def numbering(files: DataFrame) -> DataFrame:
    """(doc, num_id, level, format, indent, start, label, restart): what a list number means at each level. Definitions
    that link to a style's definition are followed; a number's own overrides win."""

    def level_of(node) -> tuple:
        ind = node.find(f"{W}pPr/{W}ind")
        return (_value(node, f"{W}numFmt") or "bullet", _number(ind.get(f"{W}left")) or 0 if ind is not None else 0, _number(_value(node, f"{W}start")), _value(node, f"{W}lvlText"), _number(_value(node, f"{W}lvlRestart")))

    def rows(_: str, root: ElementTree.Element) -> Iterator[tuple]:
        for a in root.findall(f"{W}abstractNum"):
            key, to, own = a.get(f"{W}abstractNumId"), _value(a, f"{W}numStyleLink"), _value(a, f"{W}styleLink")
            yield "definition", key, None, to, own, None, None, None, None, None, None
            for x in a.findall(f"{W}lvl"):
                if (n := _number(x.get(f"{W}ilvl"))) is not None:
                    yield "level", key, None, None, None, n, *level_of(x)
        for num in root.findall(f"{W}num"):
            key, to = num.get(f"{W}numId"), _value(num, f"{W}abstractNumId")
            if key is None or to is None:
                continue
            yield "number", to, key, None, None, None, None, None, None, None, None
            for o in num.findall(f"{W}lvlOverride"):
                n, x = _number(o.get(f"{W}ilvl")), o.find(f"{W}lvl")
                if n is None:
                    continue
                first = _number(_value(o, f"{W}startOverride"))
                form, indent, start, label, restart = level_of(x) if x is not None else (None, None, None, None, None)
                yield "override", to, key, None, None, n, form, indent, first if first is not None else start, label, restart

    raw = relation(files, r"word/numbering\.xml", rows, "kind string, definition string, num_id string, to_style string, own_style string, level int, format string, indent int, start int, label string, restart int")
    raw = written(raw, "numbering")  # read five times below, and each reading would open all files
    pick = lambda kind, *names: raw.filter(F.col("kind") == kind).select("doc", *names)
    defined = pick("definition", "definition", "to_style", "own_style")
    linked = defined.select("doc", F.col("own_style").alias("to_style"), F.col("definition").alias("linked")).filter(F.col("to_style").isNotNull())
    defined = defined.join(linked, ["doc", "to_style"], "left").select("doc", "definition", F.coalesce("linked", "definition").alias("real"))
    levels = pick("level", F.col("definition").alias("real"), "level", "format", "indent", "start", "label", "restart")
    meant = pick("number", "definition", "num_id").join(defined, ["doc", "definition"]).join(levels, ["doc", "real"])
    own = pick("override", "num_id", "level", *(F.col(c).alias(f"o_{c}") for c in ("format", "indent", "start", "label", "restart")))
    out = meant.join(own, ["doc", "num_id", "level"], "left")
    best = lambda c: F.coalesce(f"o_{c}", c).alias(c)
    return out.select("doc", F.col("num_id").cast("int"), "level", best("format"), best("indent"), F.coalesce("o_start", "start", F.lit(1)).alias("start"), best("label"), best("restart"), F.col("real").alias("definition"), F.col("o_start").alias("own_start"))


def shown(n: Column, form: Column) -> Column:
    """A number as its format has it; bullets and unknown formats show nothing."""
    letter = lambda base: F.repeat(F.char(F.lit(base) + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int"))
    place = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (F.floor(n / by) % 10 + 1).cast("int"))
    tens = lambda a, b, c: ["", a, a * 2, a * 3, a + b, b, b + a, b + a * 2, b + a * 3, a + c]
    roman = F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), place(tens("C", "D", "M"), 100), place(tens("X", "L", "C"), 10), place(tens("I", "V", "X"), 1))
    return F.when(form == "decimal", n.cast("string")).when(form == "lowerLetter", letter(97)).when(form == "upperLetter", letter(65)).when(form == "upperRoman", roman).when(form == "lowerRoman", F.lower(roman)).when(form == "decimalZero", F.lpad(n.cast("string"), 2, "0")).otherwise("")


def labels(rows: DataFrame, numbers: DataFrame, doc: str, pos: Names) -> DataFrame:
    """Rows (doc, pos, num_id, list_level) with the label that a reader sees. Lists of one definition count on together,
    unless a number starts anew; a level starts again after an item of an outer one (or of the level that ``restart`` names; 0: never)."""
    at = cols(pos)
    defs = numbers.groupBy(F.col("doc").alias("__doc"), F.col("num_id").alias("__num")).agg(
        F.map_from_entries(F.collect_list(F.struct("level", F.struct("format", "start", "label", "restart")))).alias("__levels"), F.max("definition").alias("__list"), F.max(F.col("own_start").isNotNull()).alias("__own")
    )
    df = rows.join(defs, (F.col(doc) == F.col("__doc")) & (F.col("num_id") == F.col("__num")), "left")
    df = df.withColumn("__key", F.when(F.col("__own"), F.concat(F.lit("n"), F.col("num_id").cast("string"))).otherwise(F.col("__list")))
    part = Window.partitionBy(doc, "__key").orderBy(*at)
    to_here = part.rowsBetween(Window.unboundedPreceding, 0)
    level = F.coalesce("list_level", F.lit(0))
    df = df.withColumns({f"__c{n}": F.count(F.when(level == n, 1)).over(to_here) for n in range(LEVELS)})
    info = lambda n: F.col("__levels")[F.lit(n)]
    resets = lambda n: (level < n) & F.when(info(n)["restart"].isNotNull(), level < info(n)["restart"]).otherwise(F.lit(True))
    df = df.withColumns({f"__b{n}": F.last(F.when(resets(n), F.col(f"__c{n}")), ignorenulls=True).over(to_here) for n in range(1, LEVELS)} | {"__b0": F.lit(0)})
    count = lambda n: F.greatest(F.coalesce(F.col(f"__c{n}") - F.coalesce(f"__b{n}", F.lit(0)), F.lit(0)), F.lit(1))
    df = df.withColumns({f"__n{n}": F.coalesce(info(n)["start"], F.lit(1)) + count(n) - 1 for n in range(LEVELS)} | {f"__f{n}": info(n)["format"] for n in range(LEVELS)})
    label = F.col("__levels")[level]["label"]
    for n in range(LEVELS):
        label = F.replace(label, F.lit(f"%{n + 1}"), F.when(level >= n, shown(F.col(f"__n{n}"), F.col(f"__f{n}"))).otherwise(f"%{n + 1}"))
    return df.select(*rows.columns, F.when(F.col("__list").isNotNull(), label).alias("label"))


def inherited(df: DataFrame, by: Names, key: str, parent: str, values: list[str]) -> DataFrame:
    """``df`` with each value taken from the nearest row up the chain of parents that has one. Pointers double each round,
    so a chain of n rows takes log2(n) joins; circles end after as many rounds as the largest group can need."""
    group = cols(by)
    most = df.groupBy(*group).count().agg(F.max("count")).first()[0] or 1
    now = df.select(*group, F.col(key).alias("__key"), F.col(parent).alias("__up"), *values)
    for _ in range(max(1, (most - 1).bit_length())):
        above = now.select(*group, F.col("__key").alias("__up"), F.col("__up").alias("__next"), *(F.col(v).alias(f"__{v}") for v in values))
        now = now.join(above, [*group, "__up"], "left").select(*group, "__key", F.col("__next").alias("__up"), *(F.coalesce(v, f"__{v}").alias(v) for v in values))
    rest = [c for c in df.columns if c not in values]
    return df.select(*rest).join(now.drop("__up").withColumnRenamed("__key", key), [*group, key]).select(*df.columns)


TOGGLES = {"strike": "strike", "dstrike": "double_strike", "vanish": "hidden"}


def _toggle(pr, name: str) -> bool | None:
    node = None if pr is None else pr.find(f"{W}{name}")
    return None if node is None else node.get(f"{W}val") not in ("0", "false", "off", "none")


def styles(files: DataFrame) -> DataFrame:
    """(doc, style, type, based_on, strike, double_strike, hidden) as each style says itself; null where it says nothing."""

    def rows(_: str, root: ElementTree.Element) -> Iterator[tuple]:
        for s in root.iter(f"{W}style"):
            pr = s.find(f"{W}rPr")
            yield s.get(f"{W}styleId"), s.get(f"{W}type"), _value(s, f"{W}basedOn"), *(_toggle(pr, t) for t in TOGGLES)

    return relation(files, r"word/styles\.xml", rows, "style string, type string, based_on string, strike boolean, double_strike boolean, hidden boolean")


def runs(files: DataFrame) -> DataFrame:
    """(doc, paragraph, run, style, char_style, strike, double_strike, hidden, text) of body paragraphs' runs."""

    def rows(_: str, root: ElementTree.Element) -> Iterator[tuple]:
        for i, p in enumerate(root.find(f"{W}body").findall(f"{W}p")):
            style = _value(p, f"{W}pPr/{W}pStyle")
            for k, r in enumerate(p.findall(f"{W}r")):
                pr = r.find(f"{W}rPr")
                yield i, k, style, None if pr is None else _value(pr, f"{W}rStyle"), *(_toggle(pr, t) for t in TOGGLES), _text(r)

    return relation(files, r"word/document\.xml", rows, "paragraph int, run int, style string, char_style string, strike boolean, double_strike boolean, hidden boolean, text string")


def formats(files: DataFrame) -> DataFrame:
    """Inventory (doc, format, origin, runs, first_page): struck and hidden runs by where that comes from. ``direct``: the run
    says so; ``inherited``: its paragraph's or its own style does; ``toggled``: both styles do, which puts it off; and
    section breaks. Counts add up over parts of a document, so nothing is gathered. A page is forty paragraphs."""
    names = list(TOGGLES.values())
    known = inherited(written(styles(files), "styles"), "doc", "style", "based_on", names)
    of = lambda side, to: known.select("doc", F.col("style").alias(to), *(F.col(n).alias(f"{side}_{n}") for n in names))
    r = runs(files).join(of("p", "style"), ["doc", "style"], "left").join(of("c", "char_style"), ["doc", "char_style"], "left")
    on = lambda c: F.coalesce(c, F.lit(False))
    origin = lambda n: F.when(F.col(n).isNotNull(), F.when(F.col(n), "direct")).when(on(f"p_{n}") & on(f"c_{n}"), "toggled").when(on(f"p_{n}") | on(f"c_{n}"), "inherited")
    each = F.explode(F.filter(F.array(*(F.struct(F.lit(n).alias("format"), origin(n).alias("origin")) for n in names)), lambda x: x.origin.isNotNull())).alias("x")
    found = r.select("doc", F.floor(F.col("paragraph") / 40 + 1).alias("page"), each).groupBy("doc", "x.format", "x.origin").agg(F.count("*").alias("runs"), F.min("page").alias("first_page"))
    breaks = sections(files).groupBy("doc").agg(F.lit("section_break").alias("format"), F.lit("direct").alias("origin"), F.count("*").alias("runs"), F.lit(None).cast("long").alias("first_page"))
    return found.unionByName(breaks)
