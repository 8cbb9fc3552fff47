"""Members of ZIP archives, read one by one from a ``binaryFile`` relation (path, content), so from any store that Spark
reads. The central directory tells what is there; only wanted members are opened, each once, nested archives too."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Archives inside archives that are followed.
DEPTH = 3
#: Rows and bytes that are held before a batch goes out.
HELD_ROWS, HELD_BYTES = 4096, 1 << 22


def batched(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows of many files in batches of some size, as a batch for each file costs more than what is in it."""
    made = lambda: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), schema.types, strict=True)], schema.names)
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str | bytes))
        if len(held) >= HELD_ROWS or size >= HELD_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def listed(data: bytes, name: str = "") -> Iterator[tuple[str, Callable[[], bytes]]]:
    """(name, reader) of all members, in the directory's order; members of inner archives as ``inner.zip!name``. An inner
    archive is opened once; what isn't an archive has no members."""
    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except zipfile.BadZipFile:
        return
    with z:
        for info in z.infolist():
            if info.is_dir():
                continue
            full = f"{name}{info.filename}"
            if info.filename.lower().endswith(".zip") and full.count("!") < DEPTH:
                yield from listed(z.read(info), f"{full}!")
            else:
                yield full, lambda info=info: z.read(info)


def members(files: DataFrame, wanted: str) -> DataFrame:
    """(path, member, place, content) of the members whose names match the pattern, in lower case."""
    kinds = pa.schema([("path", pa.string()), ("member", pa.string()), ("place", pa.int32()), ("content", pa.binary())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        pattern = re.compile(wanted)
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                for place, (name, read) in enumerate(listed(content.as_py() or b"")):
                    if pattern.search(name.lower()):
                        yield path, name, place, read()

    return files.select("path", "content").mapInArrow(lambda batches: batched(found(batches), kinds), "path string, member string, place int, content binary")


def first_documents(files: DataFrame) -> DataFrame:
    """(path, member, content) of each archive's first .docx below a folder ``processed``, else of its first .docx. Only
    that one is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                best = None
                for name, read in listed(content.as_py() or b""):
                    if name.lower().endswith(".docx"):
                        done = re.search(r"processed[/\\]", name.lower())
                        if done or best is None:
                            best = name, read() if done else None
                        if done:
                            break
                if best:
                    data = best[1] if best[1] is not None else next(read() for name, read in listed(content.as_py()) if name == best[0])
                    yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([best[0]]), pa.array([data], pa.binary())], ["path", "member", "content"])

    return files.select("path", "content").mapInArrow(run, "path string, member string, content binary")


def packed(parts: Column) -> Column:
    """A ZIP archive of a map from names to texts, names in order. Python holds a hundred rows at a time, as texts are many
    times larger than what comes out; an Arrow batch may hold 64 MB of them."""

    @F.udf("binary", useArrow=False)
    def zipped(texts: dict[str, str]) -> bytes:
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w", zipfile.ZIP_DEFLATED) as z:
            for name, text in sorted(texts.items()):
                z.writestr(zipfile.ZipInfo(name), text)
        return buf.getvalue()

    return zipped(parts)
