"""Packing: order-preserving dynamic programming over window cuts.

Documents of a partition stand one after another in input order. A window (training sequence) is a run of at most
``window`` tokens; a cut may stand after a document (free) or after a sentence (a truncation penalty). Where two such
places are further apart than a window, hard cuts (a larger penalty) stand between them. With P(j) the number of
tokens before cut j, the best cost is

    best(j) = penalty(j) + window - P(j) + min { best(i) + P(i) : P(j) - P(i) <= window }

whose minimum over a sliding range a monotone queue gives in amortised constant time. Nothing is shuffled: each
partition is packed by one task, in chunks of bounded size; the last window of a chunk is packed again with the next.

Nulls and empty texts: only the end id. Repeated rows and ids: packed as often as they come. Very long texts: cut into
pieces over several windows. Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import common
from .pieces import loaded

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
CONTRACT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def cuts(place: np.ndarray, penalty: np.ndarray, window: int) -> np.ndarray:
    """Places where windows end, the last one included, with the least padding plus penalties.

    ``place``: ascending token counts before each allowed cut, the first one 0; neighbours at most ``window`` apart.
    """
    p, pen = place.tolist(), penalty.tolist()
    best, back = [0.0] * len(p), [0] * len(p)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(p)):
        least = p[j] - window
        while p[queue[0][1]] < least:
            queue.popleft()
        v, back[j] = queue[0]
        v += pen[j] + window - p[j]
        best[j] = v
        v += p[j]
        while queue and queue[-1][0] > v:
            queue.pop()
        queue.append((v, j))
    out, j = [], len(p) - 1
    while j:
        out.append(p[j])
        j = back[j]
    return np.array(out[::-1], np.int64)


def allowed(ends: np.ndarray, sentence: np.ndarray, window: int, sentence_penalty: float, hard_penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Allowed cuts and their penalties: 0, after each document, after each sentence, and hard ones in wide gaps."""
    place = np.union1d(np.concatenate([[0], ends]), sentence)
    gap = np.diff(place)
    step = max(1, window // 4)
    hard = [np.arange(place[i] + step, place[i + 1], step) for i in np.flatnonzero(gap > window)]
    penalty = np.full(len(place), float(sentence_penalty))
    penalty[np.isin(place, ends)] = 0
    if hard:
        h = np.concatenate(hard)
        place, penalty = np.concatenate([place, h]), np.concatenate([penalty, np.full(len(h), float(hard_penalty))])
        order = np.argsort(place, kind="stable")
        place, penalty = place[order], penalty[order]
    return place, penalty


class Packer:
    """Packs one stream of documents; feeds on blocks and gives back finished pieces."""

    def __init__(self, is_end: np.ndarray, window: int, chunk: int, sentence_penalty: float, hard_penalty: float, first_sequence: int):
        self.is_end, self.window, self.chunk = is_end, window, chunk
        self.penalties = (sentence_penalty, hard_penalty)
        self.sequence = first_sequence
        self.ids, self.docs, self.held = [], [], 0  # docs: (doc_id, ids before, ids here, ids of the document)

    def add(self, doc_ids: list, ids: np.ndarray, counts: np.ndarray) -> Iterator[list[tuple]]:
        self.ids.append(ids)
        self.docs += [(d, 0, n, n) for d, n in zip(doc_ids, counts.tolist(), strict=True)]
        self.held += len(ids)
        if self.held >= self.chunk:
            yield self.pack(last=False)

    def pack(self, last: bool) -> list[tuple]:
        ids = np.concatenate(self.ids) if self.ids else np.zeros(0, np.int32)
        if not len(ids):
            return []
        ends = np.cumsum([n for _, _, n, _ in self.docs])
        sentence = np.flatnonzero(self.is_end[ids]) + 1
        stop = cuts(*allowed(ends, sentence, self.window, *self.penalties), self.window)
        if not last:
            stop = stop[:-1]
        done = int(stop[-1]) if len(stop) else 0
        begin = np.concatenate([[0], ends[:-1]])
        start = np.union1d(begin, np.concatenate([[0], stop]))
        start = start[start < done]
        doc = np.searchsorted(begin, start, "right") - 1
        seq = np.searchsorted(stop, start, "right")
        seq_start = np.concatenate([[0], stop])[seq]
        end = np.append(start[1:], done)
        view, out = memoryview(ids.astype("<u4", copy=False)).cast("B"), []
        for a, z, d, s, s0 in zip(start.tolist(), end.tolist(), doc.tolist(), seq.tolist(), seq_start.tolist(), strict=True):
            key, before, _, total = self.docs[d]
            out.append((key, before + a - int(begin[d]), z - a, zlib.crc32(view[4 * a : 4 * z]), total, self.sequence + s, a - s0))
        self.sequence += len(stop)
        left = int(np.searchsorted(ends, done, "right"))
        docs = self.docs[left:]
        if docs and begin[left] < done:
            key, before, n, total = docs[0]
            gone = done - int(begin[left])
            docs[0] = (key, before + gone, n - gone, total)
        self.docs, self.ids, self.held = docs, [ids[done:].copy()], len(ids) - done
        return out


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 2048, end_id: int = 1, chunk: int = 1 << 20, sentence_penalty: float = 2.0, hard_penalty: float = 64.0, marks: tuple[str, ...] = (".", "!", "?")) -> DataFrame:
    """Pieces of all documents, packed into windows; see the module's text.

    ``chunk``: tokens packed together; it bounds a task's memory. ``marks``: a token that ends with one of these ends
    a sentence. sequence_id: the partition's number times 2^33 plus the window's number there.
    """
    run = _runner(tokenizer, id_col, text_col, window, end_id, chunk, sentence_penalty, hard_penalty, marks)
    return docs.select(id_col, text_col).mapInArrow(run, SCHEMA.replace("doc_id long", f"{id_col} long"))


def _runner(tokenizer, id_col, text_col, window, end_id, chunk, sentence_penalty, hard_penalty, marks) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = loaded(tokenizer)
        size = cache.tok.get_vocab_size()
        is_end = np.zeros(max(size, end_id + 1), bool)
        for word, i in cache.tok.get_vocab().items():
            is_end[i] = word.removesuffix("</w>").endswith(marks)
        packer = Packer(is_end, window, chunk, sentence_penalty, hard_penalty, TaskContext.get().partitionId() << 33)
        for b in common.blocks(batches, text_col, 4 * common.BLOCK_BYTES):
            ids, n = cache.encode(b.column(text_col))
            ids = np.insert(ids, np.cumsum(n), end_id)
            for rows in packer.add(b.column(id_col).to_pylist(), ids, n + 1):
                yield _batch(rows, id_col)
        if rows := packer.pack(last=True):
            yield _batch(rows, id_col)

    return run


def _batch(rows: list[tuple], id_col: str) -> pa.RecordBatch:
    names = [id_col, *CONTRACT[1:]]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 7, names)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 2048 tokens. Null text is one end token; long texts are cut over several windows; equal
    texts get equal ids; of cuts with equal cost the first is taken; repeated rows are packed each; an empty table gives
    no row; only doc_id and text are read."""
    return pack(common.table(spark, sf_dir, "documents"), common.tokenizer_path("word_bpe_49k.json"))
