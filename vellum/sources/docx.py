"""DOCX as a data source: one row for each paragraph of body and tables.

``spark.dataSource.register(DocxSource)``, then ``spark.read.format("docx").load(folder)``. Standard library only:
the file is a ZIP archive with XML in it. Blank body paragraphs are left out; ids are dense from 1 in a document, table
paragraphs after all body ones; ``body_pos`` keeps the visual order. For files in a remote store read them with
``binaryFile`` and use ``parsed``.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SCHEMA = (
    "doc string, id int, body_pos int, text string, style string, is_table boolean, table_index int, row_index int, cell_index int, para_in_cell int, "
    "num_id int, list_level int, indent int, bold boolean, italic boolean"
)


def _value(node, path: str) -> str | None:
    found = node.find(path)
    return None if found is None else found.get(f"{W}val")


def _number(x: str | None) -> int | None:
    try:
        return None if x is None else int(x)
    except ValueError:
        return None


def _text(p) -> str:
    return "".join(t.text or "" if t.tag == f"{W}t" else "\t" if t.tag == f"{W}tab" else "\n" for t in p.iter() if t.tag in (f"{W}t", f"{W}tab", f"{W}br"))


def _format(p) -> tuple:
    pr = p.find(f"{W}pPr")
    if pr is None:
        style = num = level = indent = None
    else:
        style, num, level = _value(pr, f"{W}pStyle"), _number(_value(pr, f"{W}numPr/{W}numId")), _number(_value(pr, f"{W}numPr/{W}ilvl"))
        ind = pr.find(f"{W}ind")
        indent = None if ind is None else _number(ind.get(f"{W}left"))
    runs = [r for r in p.iter(f"{W}r") if _text(r).strip()]
    on = lambda r, name: (x := r.find(f"{W}rPr/{W}{name}")) is not None and x.get(f"{W}val") not in ("0", "false")
    return style, num, level, indent, bool(runs) and all(on(r, "b") for r in runs), bool(runs) and all(on(r, "i") for r in runs)


def rows(name: str, data: bytes) -> Iterator[tuple]:
    """Rows of SCHEMA of one file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{W}body")
    number, late, place, tables = 0, [], 0, 0
    for node in body:
        if node.tag == f"{W}p":
            place += 1
            text = _text(node)
            if text.strip():
                number += 1
                style, num, level, indent, bold, italic = _format(node)
                yield name, number, place, text, style, False, None, None, None, None, num, level, indent, bold, italic
        elif node.tag == f"{W}tbl":
            place += 1
            for r, row in enumerate(node.findall(f"{W}tr")):
                for c, cell in enumerate(row.findall(f"{W}tc")):
                    late += [(place, tables, r, c, k, p) for k, p in enumerate(cell.findall(f"{W}p"))]
            tables += 1
    for at, t, r, c, k, p in late:
        number += 1
        style, num, level, indent, bold, italic = _format(p)
        yield name, number, at, _text(p), style, True, t, r, c, k, num, level, indent, bold, italic


class DocxSource(DataSource):
    """Batch reader of .docx files of a folder that all executors see."""

    @classmethod
    def name(cls) -> str:
        return "docx"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return DocxReader(self.options["path"])


class DocxReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(str(p)) for p in sorted(Path(self.path).rglob("*.docx"))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        p = Path(partition.value)
        yield from rows(p.name, p.read_bytes())


def parsed(files: DataFrame) -> DataFrame:
    """Rows of SCHEMA from a ``binaryFile`` relation (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                found = list(rows(path.rsplit("/", 1)[-1], content))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), _KINDS, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    return files.select("path", "content").mapInArrow(run, SCHEMA)


_KINDS = [{"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}[f.split()[1]] for f in SCHEMA.split(", ")]
