"""Lists, word-file parts and archives on files that the test writes."""

import io
import zipfile

from pyspark.sql import functions as F

from vellum.operators import boxes, lists
from vellum.sources import archive, docx, docx_parts

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def zipped(parts: dict) -> bytes:
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return buf.getvalue()


def files(spark, contents: dict):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in contents.items()], "path string, content binary")


def test_list_items(spark):
    cases = {
        "• Item": ("•", None, 0), "    - Sub": ("-", None, 1), "\t\to circle": ("○", None, 2), "1. First": (None, "decimal", 0), "(2) Two": (None, "decimal_both", 0), "I. Roman": (None, "upper_alpha", 0),
        "iv. low": (None, "lower_roman", 0), "Plain text": None, "": None, "   ": None, "only": None, "\uf0b7 Wing": ("\uf0b7", None, 0),
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, text string")
    got = {r.text: (r.bullet, r.number_format, r.indent_level) if r.is_list else None for r in lists.items(df).collect()}
    assert got == cases
    rows = [(0, 0, "Text", 2, None, True), (1, 1, "Text", None, 700, True), (2, 2, "Text", None, 2000, True), (3, 3, "Text", 0, 2000, True), (4, 4, "Text", 1, None, False)]
    df = spark.createDataFrame(rows, "i int, pos int, text string, ilvl int, indent int, has_numbering boolean")
    got = [(r.indent_level, r.indent_source, r.is_numbered) for r in lists.items(df).orderBy("i").collect()]
    assert got == [(2, "ooxml_ilvl", True), (1, "ooxml_ind", True), (2, "ooxml_ind", True), (0, "ooxml_ilvl", True), (None, None, None)]


def test_promotion_and_parents(spark):
    texts = ["• A", "    • Types:", "    • x", "    • y", "• B", "    • z", "<h1>New", "    • Management: all", "    • w", "plain"]
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "doc int, pos int, text string")
    out = lists.hierarchy(df, "doc", "pos", F.startswith("text", F.lit("<h")), chunk=F.floor(F.col("pos") / 3))
    assert [r.semantic_level for r in out.orderBy("pos").collect()] == [0, 1, 2, 2, 0, 1, None, 1, 2, None]
    up = lists.parents(out, "doc", "pos", "semantic_level", 2, chunk=F.floor(F.col("pos") / 3)).orderBy("pos").collect()
    assert [r.parent for r in up] == [None, 0, 1, 1, None, 4, None, 4, 7, None]


def test_parts(spark):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    body = f"<w:document {W}><w:body>{p('One')}<w:p><w:pPr><w:sectPr><w:type w:val=\"evenPage\"/></w:sectPr></w:pPr></w:p><w:tbl><w:tr><w:tc>{p('a')}<w:tbl><w:tr><w:tc>{p('in')}</w:tc></w:tr></w:tbl></w:tc><w:tc>{p('b')}</w:tc></w:tr><w:tr><w:tc>{p('Source: x')}</w:tc></w:tr></w:tbl>{p('Two')}<w:sectPr/></w:body></w:document>"
    made = {
        "good": zipped({"word/document.xml": body, "word/header2.xml": f"<w:hdr {W}>{p('Top')}</w:hdr>", "word/footnotes.xml": f"<w:footnotes {W}><w:footnote>{p('note')}</w:footnote></w:footnotes>", "word/comments.xml": f"<w:comments {W}><w:comment w:author=\"Me\">{p('why')}</w:comment><w:comment>{p('so')}</w:comment></w:comments>"}),
        "no zip": b"junk", "no body": zipped({"a.txt": "x"}), "bad xml": zipped({"word/document.xml": "<w:oops"}), "empty": b"",
    }
    df = files(spark, made)
    assert sorted((r.kind, r.place, r.text) for r in docx_parts.texts(df).collect()) == [("body", 1, "One"), ("body", 2, "Two"), ("comment", 1, "why"), ("comment", 2, "so"), ("footnote", 1, "note"), ("header", 1, "Top"), ("table", 3, "a"), ("table", 4, "in"), ("table", 5, "b"), ("table", 6, "Source: x")]
    assert [tuple(r)[1:] for r in docx_parts.tables(df).collect()] == [(0, 2, 2, 1, "Source: x")]
    assert [tuple(r)[1:] for r in docx_parts.sections(df).orderBy("section").collect()] == [(0, "even_page", 2), (1, "new_page", 1)]
    assert [tuple(r)[1:] for r in docx_parts.comments(df).orderBy("comment").collect()] == [(0, "Me", "why"), (1, "Unknown", "so")]
    assert sorted(map(tuple, docx_parts.broken(df).collect())) == [("bad xml", "body is no XML"), ("empty", "not an archive"), ("no body", "no body"), ("no zip", "not an archive")]
    assert docx_parts.texts(df.limit(0)).count() == 0


def test_only_wanted_parts_are_opened(monkeypatch):
    data = zipped({"word/document.xml": "<a/>", "word/comments.xml": "<b/>", "x.zip": zipped({"word/comments.xml": "<c/>"})})
    opened, read = [], zipfile.ZipFile.read
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, name, pwd=None: (opened.append(getattr(name, "filename", name)), read(self, name, pwd))[1])
    wanted = [r() for name, r in archive.listed(data) if name.endswith("comments.xml")]
    assert wanted == [b"<b/>", b"<c/>"] and opened == ["x.zip", "word/comments.xml", "word/comments.xml"] or opened == ["word/comments.xml", "x.zip", "word/comments.xml"]


def test_archives(spark):
    made = {
        "p": zipped({"a.docx": "1", "Processed/b.DOCX": "2", "processed/c.docx": "3"}), "q": zipped({"n.txt": "0", "z.docx": "4", "a.docx": "5"}), "none": zipped({"n.txt": "0"}), "junk": b"PK",
        "nested": zipped({"in.zip": zipped({"processed/d.docx": "6", "deep.zip": zipped({"e.docx": "7"})}), "f.docx": "8"}),
    }
    df = files(spark, made)
    assert {r.path: (r.member, bytes(r.content)) for r in archive.first_documents(df).collect()} == {"p": ("Processed/b.DOCX", b"2"), "q": ("z.docx", b"4"), "nested": ("in.zip!processed/d.docx", b"6")}
    assert {(r.path, r.member) for r in archive.members(df, r"\.docx$").collect() if r.path == "nested"} == {("nested", "in.zip!processed/d.docx"), ("nested", "in.zip!deep.zip!e.docx"), ("nested", "f.docx")}
    back = spark.createDataFrame([({"b": "é", "a": "x"},)], "m map<string,string>").select(F.lit("k").alias("path"), archive.packed(F.col("m")).alias("content"))
    assert [(r.member, r.place, bytes(r.content).decode()) for r in archive.members(back, ".").collect()] == [("a", 0, "x"), ("b", 1, "é")]


def test_inherited(spark):
    chain = [("d", f"s{i}", f"s{i - 1}" if i else None, i == 0 or None, None) for i in range(37)] + [("d", "x", "y", None, None), ("d", "y", "x", False, None), ("e", "s5", "s4", None, True), ("d", "lost", "nowhere", None, True)]
    df = spark.createDataFrame(chain, "doc string, style string, based_on string, a boolean, b boolean")
    got = {(r.doc, r.style): (r.a, r.b) for r in docx_parts.inherited(df, "doc", "style", "based_on", ["a", "b"]).collect()}
    assert got == {("d", f"s{i}"): (True, None) for i in range(37)} | {("d", "x"): (False, None), ("d", "y"): (False, None), ("e", "s5"): (None, True), ("d", "lost"): (None, True)}


def test_boxes(spark):
    texts = [
        "<BX>Title here", "some text", "Source: First Press 2001", "Adapted from Second", "</BX>", "after", "<BX>Open one", "*Emph*", "<BX-TITLE>Next box", "Reprinted with permission from Lee", "Chapter 9 ends", "Source: not in the box",
        "A heading", "Body of the box", "Source: Own Press 1999", "Table 4.1 Caption", "cell", "Source: under a table", "Source: of the figure above", "<BX>in one line</BX>", "Source: x in no box at all",
    ]
    df = spark.createDataFrame([("d", i, t, i == 15, i in (17,)) for i, t in enumerate(texts)], "doc string, pos int, text string, before_table boolean, after_table boolean")
    got = sorted((r.pos, r.caption, r.credit, r.tagged, r.needs_permission) for r in boxes.boxes(df, "doc", "pos").collect())
    assert [g[:4] for g in got] == [
        (0, "Title here", "Source: First Press 2001", True), (2, "some text", "Source: First Press 2001", False), (8, "Next box", "Reprinted with permission from Lee", True),
        (9, "<BX-TITLE>Next box", "Reprinted with permission from Lee", False),
    ]
    assert [g[4] for g in got] == [False, False, True, True]
    assert boxes.boxes(df.limit(0), "doc", "pos").count() == 0


def test_scan_rows(spark):
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    table = f"<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>"
    body = f"<w:document {W}><w:body>{p('Caption')}{table}{p('Source: y')}{p('&lt;BX&gt;Box')}{p('in')}{p(' ')}{p('&lt;/BX&gt;')}{p('last')}{p('')}{table}</w:body></w:document>"
    rows = boxes.scan_rows(docx.parsed(files(spark, {"f": zipped({"word/document.xml": body})}))).orderBy("pos").collect()
    assert [(r.text, r.is_table, r.before_table, r.after_table, r.in_box) for r in rows] == [
        ("Caption", False, True, False, False), ("a", True, False, False, False), ("b", True, False, False, False), ("Source: y", False, False, True, False), ("<BX>Box", False, False, False, True),
        ("in", False, False, False, True), ("</BX>", False, False, False, False), ("last", False, False, False, False), ("a", True, False, False, False), ("b", True, False, False, False),
    ]
