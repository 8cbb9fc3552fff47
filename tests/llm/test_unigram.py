"""Models written by hand (no training): scores, markers, byte fallback and unknowns as the library has them.

Scores are eighths, so sums are exact: where two cuts tie, the libraries' roundings (32 and 64 bits) would decide."""

import random
import struct

import pytest

from vellum.llm import spiece


def field(number: int, value) -> bytes:
    def varint(n: int) -> bytes:
        out = b""
        while n > 127:
            out += bytes([n & 127 | 128])
            n >>= 7
        return out + bytes([n])

    if isinstance(value, float):
        return varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    value = value.encode() if isinstance(value, str) else value
    return varint(number << 3 | 2) + varint(len(value)) + value


def model(kind: int, fallback: bool, squeeze: bool, prefix: bool) -> bytes:
    r = random.Random(1)
    words = ["▁", "▁a", "▁b", "a", "b", "c", "ab", "bc", "abc", "▁ab", "ca", "▁ca", "cab", "é", "▁é", "aa", "▁▁", "bb"]
    rows = [("<unk>", 0.0, spiece.UNKNOWN), ("<s>", 0.0, spiece.CONTROL), ("</s>", 0.0, spiece.CONTROL)]
    if fallback:
        rows += [(f"<0x{i:02X}>", -20.0, spiece.BYTE) for i in range(256)]
    rows += [(w, -3 - r.randrange(57) / 8, spiece.NORMAL) for w in words] if kind == spiece.UNIGRAM else [(w, float(-i), spiece.NORMAL) for i, w in enumerate(sorted(words, key=lambda w: -len(w)))]
    out = b"".join(field(1, field(1, p) + field(2, s) + field(3, k)) for p, s, k in rows)
    out += field(2, field(3, kind) + (field(35, 1) if fallback else b""))
    return out + field(3, field(1, "identity") + field(3, int(prefix)) + field(4, int(squeeze)) + field(5, 1))


@pytest.mark.parametrize("fallback", [False, True])
@pytest.mark.parametrize("squeeze", [False, True])
@pytest.mark.parametrize("kind", [spiece.UNIGRAM, spiece.BPE])
def test_parity(tmp_path, kind, fallback, squeeze):
    import sentencepiece

    data = model(kind, fallback, squeeze, True)
    path = tmp_path / "m.model"
    path.write_bytes(data)
    theirs = sentencepiece.SentencePieceProcessor(model_proto=data)
    own = spiece.Pieces(str(path))
    assert own.model.kind == kind and own.model.byte_fallback == fallback and own.model.squeeze == squeeze
    r = random.Random(2)
    texts = ["", " ", "a", "  a  b ", "xyz", "a x b", "éé", *("".join(r.choice("abcé x  ") for _ in range(r.randint(1, 25))) for _ in range(400))]
    ids, counts = own.encode(texts)
    at = 0
    for t, n in zip(texts, counts.tolist(), strict=True):
        assert ids[at : at + n].tolist() == theirs.encode(t), repr(t)
        at += n
