"""Small PDF files for tests."""

import zlib


def pdf(objects: dict[int, bytes], packed: bool = False) -> bytes:
    out = b"%PDF-1.5\n"
    if packed:  # all but streams in one object stream
        plain = {n: b for n, b in objects.items() if b"stream" not in b}
        head, body = b"", b""
        for n, b in plain.items():
            head += b"%d %d " % (n, len(body))
            body += b + b"\n"
        data = zlib.compress(head + body)
        objects = {n: b for n, b in objects.items() if n not in plain} | {99: b"<< /Type /ObjStm /N %d /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(plain), len(head), len(data)) + data + b"\nendstream"}
    for n, b in objects.items():
        out += b"%d 0 obj\n" % n + b + b"\nendobj\n"
    return out + b"trailer << /Root 1 0 R >>\n%%EOF"


def stream(data: bytes, flate: bool = True) -> bytes:
    body = zlib.compress(data) if flate else data
    return b"<< /Length %d%s >>\nstream\n" % (len(body), b" /Filter /FlateDecode" if flate else b"") + body + b"\nendstream"
