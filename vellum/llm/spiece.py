"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (wire format only), and from it an equal tokenizer is rebuilt: normaliser
(precompiled character map, extra white space, dummy prefix), the metaspace marker, unigram scores or merges ranked by
score, and byte fallback. ``encode`` works on batches with the library's threads; ``parity`` holds each text's ids
against the sentencepiece library's.

Nulls count as empty texts: no ids. Long texts are encoded whole; they are cut at markers first where the vocabulary
shows that no piece spans a cut. Repeated rows: encoded each. Other columns are left out of the result.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import common
from .pieces import IdCache, encode_joined, gather

MARK = "▁"
#: Fixed values of the public model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protobuf message; 32-bit ones as their four bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            n = varint()
            yield key >> 3, data[i : i + n]
            i += n
        else:
            n = {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[i : i + n]
            i += n


class Model:
    """What a .model file says."""

    def __init__(self, data: bytes):
        self.pieces: list[tuple[str, float, int]] = []
        trainer: dict = {}
        norm: dict = {}
        for k, v in fields(data):
            if k == 1:
                f = dict(fields(v))
                self.pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif k == 2:
                trainer = dict(fields(v))
            elif k == 3:
                norm = dict(fields(v))
        self.kind = trainer.get(3, UNIGRAM)
        self.byte_fallback = bool(trainer.get(35, 0))
        self.suffix = bool(trainer.get(24, 0))
        self.charsmap = norm.get(2, b"")
        self.dummy_prefix, self.squeeze, self.escape = (bool(norm.get(i, 1)) for i in (3, 4, 5))
        self.unknown = next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), None)
        self.bytes = {i: int(p[0][3:5], 16) for i, p in enumerate(self.pieces) if p[2] == BYTE}

    @property
    def cuts_at_marks(self) -> bool:
        """No piece has a marker after another character: then nothing merges across such a place."""
        return not any(MARK in p.lstrip(MARK) for p, _, kind in self.pieces if kind in (NORMAL, USER)) and not self.suffix

    def merges(self) -> list[tuple[str, str]]:
        """Pairs in the order in which they merge: by the score of what they make."""
        known = {p: i for i, (p, _, kind) in enumerate(self.pieces) if kind in (NORMAL, USER)}
        out = []
        for p, i in known.items():
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in known and b in known:
                    out.append((-self.pieces[i][1], i, known[a], known[b], a, b))
        return [(a, b) for *_, a, b in sorted(out)]

    def tokenizer(self):
        """An equal tokenizer of the tokenizers library, for text whose spaces are markers already."""
        from tokenizers import AddedToken, Tokenizer, models

        unknown = self.pieces[self.unknown][0] if self.unknown is not None else None
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        elif self.kind == BPE:
            model = models.BPE({p: i for i, (p, _, _) in enumerate(self.pieces)}, self.merges(), unk_token=unknown, fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model kind {self.kind}")
        out = Tokenizer(model)
        user = [AddedToken(p, normalized=False, special=False) for p, _, kind in self.pieces if kind == USER]
        if user:
            out.add_tokens(user)
        return out

    def normaliser(self):
        """Text to marked text."""
        from tokenizers.normalizers import Precompiled

        step = Precompiled(self.charsmap) if self.charsmap else None
        mark = MARK if self.escape else " "

        def run(text: str) -> str:
            if step is not None:
                text = step.normalize_str(text)
            if self.squeeze:
                text = re.sub(" +", " ", text).strip(" ")
            if text and self.dummy_prefix:
                text = f" {text}"
            return text.replace(" ", mark)

        return run


class Pieces:
    """Encoder and decoder of one model file, with a bounded cache of marker-led parts."""

    #: Stands between parts that are encoded together; a text that holds it is encoded alone.
    SEPARATOR = "\x00\ufdd0\x00"

    def __init__(self, path: str, threads: int = 1):
        # the library's pool of threads is made once, at the first batch of a process
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        with open(path, "rb") as f:
            self.model = Model(f.read())
        self.tok, self.normal = self.model.tokenizer(), self.model.normaliser()
        if self.model.cuts_at_marks and self.model.escape:
            from tokenizers import AddedToken

            joining = self.model.tokenizer()
            joining.add_special_tokens([AddedToken(self.SEPARATOR, normalized=False)])
            sep = joining.token_to_id(self.SEPARATOR)
            self.cache = IdCache(lambda w: encode_joined(joining, w, self.SEPARATOR, sep))
            #: The same for words that a single space leads, without their marker.
            self.words = IdCache(lambda w: encode_joined(joining, [MARK + x for x in w], self.SEPARATOR, sep))
            self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall
        else:
            self.cache = None
        each = [
            bytes([self.model.bytes[i]]) if i in self.model.bytes else b"" if kind == CONTROL else " ⁇ ".encode() if kind == UNKNOWN else p.replace(MARK, " ").encode()
            for i, (p, _, kind) in enumerate(self.model.pieces)
        ]
        self.piece_bytes = np.frombuffer(b"".join(each), np.uint8)
        self.piece_count = np.fromiter(map(len, each), np.int64, len(each))
        self.piece_start = np.cumsum(self.piece_count) - self.piece_count

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        marked = [self.normal(t) if t else "" for t in texts]
        if self.cache is not None and not any(self.SEPARATOR in m for m in marked):
            return self.cache.encode(list(map(self.split, marked)))
        each = [e.ids for e in self.tok.encode_batch(marked, add_special_tokens=False)]
        return np.array([i for ids in each for i in ids], np.int32), np.fromiter(map(len, each), np.int64, len(each))

    def encode_array(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for an Arrow array; where parts are just words after single spaces, only distinct ones become
        Python strings."""
        m = self.model
        if self.cache is None or m.charsmap or m.squeeze or not m.dummy_prefix:
            return self.encode(texts.to_pylist())
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, f"^$|^ | $|  |{MARK}|\x00").to_numpy(zero_copy_only=False)
        parts = pc.split_pattern(texts.filter(pa.array(~odd)), " ")
        ids, n = self.words.encode_array(parts.flatten(), pc.list_value_length(parts).to_numpy())
        if not odd.any():
            return ids, n
        other, counts = self.encode(texts.filter(pa.array(odd)).to_pylist())
        rest = iter(np.split(other, np.cumsum(counts)[:-1]))
        plain = iter(np.split(ids, np.cumsum(n)[:-1]))
        each = [next(rest) if o else next(plain) for o in odd.tolist()]
        return np.concatenate(each), np.fromiter(map(len, each), np.int64, len(each))

    def decode_bytes(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 of each text, without the dummy prefix."""
        n = self.piece_count[ids]
        data = gather(self.piece_bytes, self.piece_start[ids], n).tobytes()
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        drop = self.model.dummy_prefix
        return [data[i + (drop and data[i : i + 1] == b" ") : j] if j > i else b"" for i, j in zip(ends, ends[1:])]

    def decode(self, ids: list[int]) -> str:
        """Text of one list of ids; broken bytes become U+FFFD."""
        return self.decode_bytes(np.array(ids, np.int64), np.array([len(ids)]))[0].decode("utf-8", "replace")


def loaded(path: str, threads: int = 1) -> Pieces:
    """One for each model and Python worker."""
    held = common.kept("spiece")
    if (path, threads) not in held:
        held[path, threads] = Pieces(path, threads)
    return held[path, threads]


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 1, check: bool = True) -> DataFrame:
    """Per row: ``ids``, ``decoded`` (UTF-8 out of the ids) and ``parity`` with the sentencepiece library's ids of the
    whole text (null if ``check`` is off)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = loaded(path, threads)
        if check:
            import sentencepiece

            other = sentencepiece.SentencePieceProcessor(model_file=path)
        for b in common.blocks(batches, text_col, 2 * common.BLOCK_BYTES):
            texts = b.column(text_col).to_pylist()
            ids, n = own.encode_array(b.column(text_col))
            ends = np.concatenate([[0], np.cumsum(n)])
            same: list[bool | None] = [None] * len(texts)
            if check:
                theirs = other.encode([t or "" for t in texts], num_threads=threads)
                same = [np.array_equal(ids[i:j], t) for i, j, t in zip(ends[:-1], ends[1:], theirs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), common.lists(ids, ends, pa.int32()), pa.array(own.decode_bytes(ids, n), pa.binary()), pa.array(same, pa.bool_())],
                [id_col, "ids", "decoded", "parity"],
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>, decoded binary, parity boolean")


def digest(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of ``encoded`` rows: number and crc32 of the ids (little-endian 32-bit), sha256 of the decoded text, parity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("ids")
            ends = ids.offsets.to_numpy() - ids.offsets[0].as_py()
            view = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(), "<u4")).cast("B") if ends[-1] else b""
            crc = [zlib.crc32(view[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in b.column("decoded")]
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(np.diff(ends), pa.int64()), pa.array(crc, pa.int64()), pa.array(sha), b.column("parity")], [id_col, "n_tokens", "ids_crc32", "decoded_sha256", "parity"])

    return rows.mapInArrow(run, f"{id_col} {rows.schema[id_col].dataType.simpleString()}, n_tokens long, ids_crc32 long, decoded_sha256 string, parity boolean")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens, checksum of the ids, sha256 of the text decoded from them, parity with sentencepiece."""
    return digest(encoded(common.table(spark, sf_dir, "documents"), common.tokenizer_path("piece_bpe_32k.model")))
