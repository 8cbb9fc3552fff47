"""Files are opened once for what is asked of them, and their rows leave in batches of some size."""

import io
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vellum.sources import archive, docx_parts

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
NUMBERS = f'<w:numbering {NS}><w:abstractNum w:abstractNumId="0"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/></w:lvl></w:abstractNum><w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num></w:numbering>'
STYLES = f'<w:styles {NS}><w:style w:type="paragraph" w:styleId="A"><w:rPr><w:strike/></w:rPr></w:style><w:style w:type="paragraph" w:styleId="B"><w:basedOn w:val="A"/></w:style></w:styles>'
BODY = f'<w:document {NS}><w:body><w:p><w:pPr><w:pStyle w:val="B"/></w:pPr><w:r><w:t>x</w:t></w:r></w:p><w:sectPr/></w:body></w:document>'


def counted(spark, n):
    """(files, times that a file was made): each reading of the relation makes its files anew."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, text in (("word/numbering.xml", NUMBERS), ("word/styles.xml", STYLES), ("word/document.xml", BODY)):
            z.writestr(name, text)
    data, times = buf.getvalue(), spark.sparkContext.accumulator(0)

    @F.udf("binary")
    def content(_):
        times.add(1)
        return data

    return spark.range(n).select(F.col("id").cast("string").alias("path"), content("id").alias("content")), times


@pytest.mark.parametrize("relation,passes", [(docx_parts.numbering, 1), (docx_parts.formats, 3)])
def test_files_are_opened_once_a_part(spark, relation, passes):
    """Numbering is one part; formats read styles, runs and sections."""
    files, times = counted(spark, 20)
    assert {r.doc for r in relation(files).collect()} == {str(i) for i in range(20)}
    assert times.value == 20 * passes


def test_batches_hold_many_files():
    kinds = pa.schema([("a", pa.string()), ("b", pa.binary())])
    small = list(archive.batched(((str(i), b"x") for i in range(10_000)), kinds))
    assert len(small) == 3 and pa.Table.from_batches(small).column("a").to_pylist() == [str(i) for i in range(10_000)]
    large = list(archive.batched((("", bytes(archive.HELD_BYTES)) for _ in range(3)), kinds))
    assert [b.num_rows for b in large] == [1, 1, 1]
    assert list(archive.batched(iter(()), kinds)) == []
