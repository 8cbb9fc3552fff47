"""Token ids of texts through a bounded cache of independent pieces; the tokenizer encodes what is new, once."""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import common


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[start[0] : start[0] + count[0]], flat[start[1] : ...], ... one after another."""
    if not len(start):
        return flat[:0]
    before = np.cumsum(count) - count
    return flat[np.repeat(start - before, count) + np.arange(int(before[-1] + count[-1]))]


def encode_joined(tok, words: list[str], separator: str, separator_id: int, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words, flat, and how many each has. Many words go in as one text, with a special string between them."""
    flat, counts = [], []
    for i in range(0, len(words), at_once):
        part = words[i : i + at_once]
        if any(separator in w for w in part):
            each = [np.array(tok.encode(w, add_special_tokens=False).ids, np.int32) for w in part]
            flat += each
            counts.append(np.fromiter(map(len, each), np.int64, len(each)))
            continue
        ids = np.array(tok.encode_batch_fast([separator.join(part)], add_special_tokens=False)[0].ids, np.int32)
        mark = ids == separator_id
        counts.append(np.diff(np.concatenate([[-1], np.flatnonzero(mark), [len(ids)]])) - 1)
        flat.append(ids[~mark])
    return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.zeros(0, np.int32), np.zeros(0, np.int64))


class _Check(common.Rolling):
    """A second, independent hash of the same bytes."""

    _values = common.mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


class IdCache:
    """Pieces to ids, in arrays: a piece is known by 128 bits of hash, some forty bytes in all.

    Holds at most about ``most`` pieces; when it is full it starts anew, so memory is bounded and results stay the
    same.
    """

    def __init__(self, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = 800_000):
        self.learn, self.most = learn, most
        self.clear()

    def clear(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.start, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(1 << 18, np.int32)
        self.used = 0

    def at(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of distinct words start in ``flat``, and how many each has."""
        if len(self.key) + len(words) > self.most:
            self.clear()
        data, ends = common.raw(words)
        key, check = (r(data).of(ends[:-1], ends[1:]) for r in (common.Rolling, _Check))
        where = np.minimum(np.searchsorted(self.key, key), max(0, len(self.key) - 1))
        known = (self.key[where] == key) & (self.check[where] == check) if len(self.key) else np.zeros(len(key), bool)
        start, count = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        start[known], count[known] = self.start[where[known]], self.count[where[known]]
        new = ~known
        if new.any():
            flat, n = self.learn(words.filter(pa.array(new)).to_pylist())
            while self.used + len(flat) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(flat)] = flat
            start[new], count[new] = self.used + np.cumsum(n) - n, n
            self.used += len(flat)
            order = np.argsort(np.concatenate([self.key, key[new]]), kind="stable")
            put = lambda old, more: np.concatenate([old, more.astype(old.dtype)])[order]
            self.key, self.check, self.start, self.count = put(self.key, key[new]), put(self.check, check[new]), put(self.start, start[new]), put(self.count, count[new])
        return start, count

    def encode(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of texts given as lists of pieces, one after another, and how many each text has."""
        return self.encode_array(pa.array([w for p in parts for w in p], pa.large_string()), np.fromiter(map(len, parts), np.int64, len(parts)))

    def encode_array(self, words: pa.Array, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``encode`` for all pieces in one array and the number of pieces of each text."""
        coded = words.dictionary_encode()
        start, count = self.at(coded.dictionary)
        at = coded.indices.to_numpy()
        n = count[at]
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(sizes)])]
        return gather(self.flat, start[at], n), np.diff(ends)


class PieceIds:
    """Ids of whole texts, equal to the tokenizer's, for vocabularies whose pre-tokenizer drops white space, lower-cases
    and parts letters from the rest.

    A text is cut at spaces and line feeds; no token, normalisation or special string of such a vocabulary spans
    them. Of a word with one mark after it the word and the mark are looked up apart.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.special = next(iter(self.tok.get_added_tokens_decoder().items()))
        self.words = IdCache(lambda w: encode_joined(self.tok, w, f" {self.special[1].content} ", self.special[0]))
        self.cache = IdCache(self._learn)

    def _learn(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = []
        for w in new:
            core, tail = (w[:-1], w[-1]) if w[-1:] in (".", ",", "!", "?") else (w, "")
            # below U+0180 lower case is one letter for one, and letters are normalised already
            parts.append([core.lower(), *tail] if core.isalpha() and max(core) < "ƀ" else [w])
        return self.words.encode(parts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has; only distinct pieces become Python strings."""
        parts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts.cast(pa.large_string()), ""), "\n", " "), " ")
        return self.cache.encode_array(parts.flatten(), pc.list_value_length(parts).to_numpy())


def loaded(path: str) -> PieceIds:
    """One cache for each vocabulary and Python worker."""
    held = common.kept("pieces")
    if path not in held:
        held[path] = PieceIds(path)
    return held[path]
