"""Lines of text of PDF files, from a ``binaryFile`` relation (path, content): (doc, page, line, text), blank lines left out.

The page tree gives the pages' order; content streams (plain or Flate) are read for their text operators; pieces of text
at one height make a line, from left to right. Fonts speak through their ToUnicode maps, else as Latin-1. Objects inside
object streams are found too. Encrypted files and files without a page tree give one row with a problem and no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import archive

_OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+\d+\s+obj\b(.*?)\bendobj", re.S)
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]+|[-+]?[0-9]*\.?[0-9]+|[A-Za-z'\"*]+", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r\n|.)", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r": b"", b"\r\n": b""}


class Broken(ValueError):
    """Why a file can't be read."""


def _stream(body: bytes) -> bytes:
    at = re.search(rb"stream\r?\n", body)
    if not at:
        return b""
    data = body[at.end() : body.rfind(b"endstream")]
    return zlib.decompressobj().decompress(data) if b"/FlateDecode" in body[: at.start()] else data


def _objects(data: bytes) -> dict[int, bytes]:
    out = {int(n): body for n, body in _OBJECT.findall(data)}
    for body in list(out.values()):
        if b"/ObjStm" in body[:300]:
            inner = _stream(body)
            first = int(re.search(rb"/First\s+(\d+)", body)[1])
            head = list(map(int, inner[:first].split()))
            places = list(zip(head[::2], head[1::2], strict=False))
            for i, (n, at) in enumerate(places):
                end = places[i + 1][1] if i + 1 < len(places) else len(inner) - first
                out.setdefault(n, inner[first + at : first + end])
    return out


def _entry(body: bytes, key: bytes) -> bytes:
    """What follows a key of a dictionary, up to the end of its value, roughly."""
    m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*(<<.*?>>|\[.*?\]|\d+\s+\d+\s+R|/?[^\s/<>\[\]]+)", body, re.S)
    return m[1] if m else b""


def _pages(objects: dict[int, bytes]) -> Iterator[bytes]:
    root = next((b for b in objects.values() if re.search(rb"/Type\s*/Catalog", b)), None)
    top = _REF.match(_entry(root, b"Pages")) if root else None
    if not top:
        raise Broken("no page tree")
    seen: set[int] = set()
    todo = [int(top[1])]
    while todo:
        n = todo.pop()
        body = objects.get(n, b"")
        if n in seen:
            continue
        seen.add(n)
        kids = _entry(body, b"Kids")
        if kids:
            todo += [int(x) for x in reversed(_REF.findall(kids))]
        elif re.search(rb"/Type\s*/Page(?!s)", body):
            yield body


def _string(token: bytes) -> bytes:
    if token.startswith(b"<"):
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _PLAIN.get(m[1], m[1]), token[1:-1])


def _to_unicode(cmap: bytes) -> tuple[int, dict[bytes, bytes], list[tuple[bytes, bytes, int]]]:
    """(bytes of a code, single codes in UTF-16, ranges: first, last, what the first means)."""
    hexes = lambda s: [bytes.fromhex(x.decode()) for x in re.findall(rb"<([0-9A-Fa-f]+)>", s)]
    single, ranges = {}, []
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        h = hexes(block)
        single |= {a: b.decode("utf-16-be", "replace") for a, b in zip(h[::2], h[1::2], strict=False)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        h = hexes(block)
        ranges += [(a, b, int.from_bytes(c)) for a, b, c in zip(h[::3], h[1::3], h[2::3], strict=False)]
    size = max([len(k) for k in single] + [len(a) for a, _, _ in ranges] + [1])
    return size, {c: said.encode("utf-16-be") for c, said in single.items()}, ranges


def _said(data: bytes, font: tuple | None) -> str:
    if font is None:
        return data.decode("latin-1")
    size, known, ranges = font
    codes = [data[i : i + size] for i in range(0, len(data), size)]
    for c in set(codes) - known.keys():  # a code is looked up in the ranges once
        known[c] = next(((m + int.from_bytes(c) - int.from_bytes(a)).to_bytes(2) for a, b, m in ranges if a <= c <= b), b"")
    return b"".join([known[c] for c in codes]).decode("utf-16-be", "replace")


def _page_lines(page: bytes, objects: dict[int, bytes]) -> list[str]:
    resources = _entry(page, b"Resources")
    if m := _REF.fullmatch(resources):
        resources = objects.get(int(m[1]), b"")
    elif not resources.startswith(b"<<"):
        resources = b""
    inside = page if resources and not _REF.fullmatch(resources) else b""
    fonts: dict[bytes, tuple | None] = {}
    listed = re.search(rb"/Font\s*(<<.*?>>|\d+\s+\d+\s+R)", resources + inside, re.S)
    names = objects.get(int(m[1]), b"") if listed and (m := _REF.fullmatch(listed[1])) else listed[1] if listed else b""
    for name, n in re.findall(rb"/([^\s/<>]+)\s+(\d+)\s+\d+\s+R", names):
        to = _REF.match(_entry(objects.get(int(n), b""), b"ToUnicode"))
        fonts[b"/" + name] = _to_unicode(_stream(objects.get(int(to[1]), b""))) if to else None
    contents = _entry(page, b"Contents")
    code = b"\n".join(_stream(objects.get(int(n), b"")) for n in _REF.findall(contents))
    pieces: list[tuple[float, float, int, str]] = []
    x = y = lead = 0.0
    font, stack, array = None, [], None
    for token in _TOKEN.findall(code):
        if token == b"[":
            array = []
        elif token == b"]":
            stack.append(array or [])
            array = None
        elif array is not None:
            array.append(token)
        elif token[:1] in b"(<" or token[:1] == b"/" or token[:1] in b"+-.0123456789":
            stack.append(token)
        else:
            number = lambda i: float(stack[i])  # noqa: B023, E731
            if token == b"BT":
                x = y = 0.0
            elif token == b"Tf" and len(stack) > 1:
                font = fonts.get(stack[-2])
            elif token == b"TL" and stack:
                lead = number(-1)
            elif token in (b"Td", b"TD") and len(stack) > 1:
                x, y = x + number(-2), y + number(-1)
                lead = -number(-1) if token == b"TD" else lead
            elif token == b"Tm" and len(stack) > 5:
                x, y = number(-2), number(-1)
            elif token in (b"T*", b"'", b'"'):
                y -= lead
            if token in (b"Tj", b"'", b'"', b"TJ") and stack:
                parts = stack[-1] if token == b"TJ" else [stack[-1]]
                # in an array, a gap of more than a fifth of the size stands for a space
                words = [_said(_string(p), font) if p[:1] in b"(<" else " " if float(p) < -200 else "" for p in parts]
                pieces.append((-round(y, 1), x, len(pieces), "".join(words)))
            stack = []
    lines: dict[float, list[str]] = {}
    for at, _, _, text in sorted(pieces):
        lines.setdefault(at, []).append(text)
    return [s for parts in lines.values() for s in " ".join(parts).split("\n")]


def text_lines(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(page, line, text), both from 1, of one file."""
    if not data.lstrip()[:5] == b"%PDF-":
        raise Broken("not a PDF")
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
        raise Broken("encrypted")
    objects = _objects(data)
    for p, page in enumerate(_pages(objects), 1):
        for i, text in enumerate((t for t in map(str.strip, _page_lines(page, objects)) if t), 1):
            yield p, i, text


def lines(files: DataFrame) -> DataFrame:
    """(doc, page, line, text, problem): a row a line, or one row with a problem."""
    kinds = pa.schema([("doc", pa.string()), ("page", pa.int32()), ("line", pa.int32()), ("text", pa.string()), ("problem", pa.string())])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            for path, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                try:
                    said = [(path, *r, None) for r in text_lines(content.as_py() or b"")]
                except (Broken, zlib.error, ValueError, TypeError) as e:
                    said = [(path, None, None, None, str(e) or "broken")]
                yield from said

    return files.select("path", "content").mapInArrow(lambda batches: archive.batched(found(batches), kinds), "doc string, page int, line int, text string, problem string")
