"""PDF lines: page order, line order by height, strings and maps, object streams, broken files as rows."""

import pytest
from pdf_files import pdf, stream

from vellum.sources import pdf as source

FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"


def book(pages: list[bytes], packed=False, flate=True) -> bytes:
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: FONT, 4: b"<< /Type /Font /Subtype /Type0 /ToUnicode 5 0 R >>", 5: stream(b"1 beginbfchar <0041> <D83DDE42> endbfchar 1 beginbfrange <0000> <FFFF> <0000> endbfrange")}
    kids = []
    for i, code in enumerate(pages):
        kids.append(b"%d 0 R" % (10 + 2 * i))
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = stream(code, flate)
    objects[2] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(pages)
    return pdf(dict(sorted(objects.items(), reverse=True)), packed)


@pytest.mark.parametrize("packed,flate", [(False, True), (True, False)])
def test_lines(packed, flate):
    one = b"BT /F1 12 Tf 72 700 Td (First \\(line\\) \\101) Tj 0 -14 Td [(Sec) -10 (ond) -300 (line)] TJ ET BT 1 0 0 1 200 700 Tm (right) Tj ET"
    two = b"BT /F1 12 Tf 14 TL 72 100 Td (low) Tj T* (lower) Tj ET BT 72 500 Td (high \\\nup) Tj (  ) ' ET BT /F2 9 Tf 72 600 Td <00E9004100200416> Tj ET"
    assert list(source.text_lines(book([one, two], packed, flate))) == [(1, 1, "First (line) A right"), (1, 2, "Second line"), (2, 1, "é🙂 Ж"), (2, 2, "high up"), (2, 3, "low"), (2, 4, "lower")]


def test_files(spark):
    good = book([b"BT 10 10 Td (x) Tj ET", b""])
    made = {"good": good, "junk": b"hello", "none": b"", "no pages": pdf({1: b"<< /Type /Catalog >>"}), "locked": good.replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"), "cut": good[:40], "bad stream": book([b"BT"]).replace(b"/FlateDecode >>\nstream\n", b"/FlateDecode >>\nstream\nzz")}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in made.items()], "path string, content binary")
    got = {r.doc: (r.page, r.line, r.text, bool(r.problem)) for r in source.lines(df).collect()}
    assert got.pop("good") == (1, 1, "x", False) and set(got) == set(made) - {"good"} and all(v == (None, None, None, True) for v in got.values())
    assert source.lines(df.limit(0)).count() == 0


def test_codes_are_looked_up_once():
    """A long text asks the ranges of its font once for each code, not for each place."""
    asked = []

    class Ranges(list):
        def __iter__(self):
            asked.append(1)
            return super().__iter__()

    font = 2, {}, Ranges([(b"\0\0", b"\xff\xff", 0)])
    assert source._said("abcä".encode("utf-16-be") * 500, font) == "abcä" * 500
    assert len(asked) == 4
    size, single, ranges = source._to_unicode(b"1 beginbfchar <01> <0041> endbfchar 1 beginbfrange <02> <03> <0062> endbfrange")
    assert source._said(b"\x01\x02\x03\x04", (size, single, ranges)) == "Abc"
