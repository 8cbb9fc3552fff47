"""Token counts by prefix dynamic programming over byte-level BPE.

For a pre-token w, the encoding of w[:i] is the encoding of w[:i-len(t)] followed by the one token t that ends at i
and may stand after that encoding's last token. So one pass from left to right gives the last token, and with it the
exact count, of *every* prefix, without encoding any prefix anew. Two tokens may be neighbours when no merge across
their border comes before the merges that built the two inner edges; that is read off the merge ranks.

``PrefixCounts.counts`` stores the count at every character of a text and answers how much of a text fits a budget
and what a cut costs. The column functions count whole texts with the tables of distinct space-led chunks; the query
also tells how many characters fit its limit, from the table of the one chunk where the count passes it.

Nulls and empty texts: 0 tokens. Special strings inside texts are one token each, as the tokenizer's default has it.
Long texts are counted whole. Repeated rows: counted each. Empty table: no rows. Other columns are not read; the result
has the id and the counts only.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Unicode's White_Space, and the pre-token pattern of this public vocabulary.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"

CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the rest from 256."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounts:
    """Counts of all prefixes for one vocabulary file of kind byte-level BPE."""

    def __init__(self, path: str, most: int = 1_200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = byte_letters()
        plain = lambda s: bytes(to_byte[c] for c in s)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.ids = {plain(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        #: By the last three bytes: the length of the longest token that ends so.
        self.reach: dict[bytes, int] = {}
        for t in self.ids:
            if len(t) > 2:
                self.reach[t[-3:]] = max(len(t), self.reach.get(t[-3:], 0))
        self.rank: dict[tuple[int, int], int] = {}
        #: For each token: (merge rank, outer left part, outer right part), or None for single bytes.
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(spec["model"]["merges"]):
            a, b = (plain(x) for x in (m.split(" ") if isinstance(m, str) else m))
            x, y, z = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[x, y] = r
            self.parts.setdefault(z, (r, x, y))
        self.pairs: dict[int, bool] = {}
        self.find = regex.compile(PATTERN).findall
        self.white = regex.compile(rf"[{SPACE}]+").finditer
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        #: A space with white space or a text's edge on both sides: there a chunk isn't independent of its neighbour.
        self.odd = regex.compile(r"(?:^|\s) (?=\s|$)").search
        self.most = most
        self.chunk: dict[str, int] = {}
        self.first: dict[str, int] = {}

    def _edges(self, t: int, right: bool) -> list[tuple[int, int]]:
        """(token at the border, rank of the merge that ends it) from the single byte up to t."""
        out, until = [], 1 << 60
        while True:
            out.append((t, until))
            if t not in self.parts:
                return out[::-1]
            until, x, y = self.parts[t]
            t = y if right else x

    def neighbours(self, a: int, b: int) -> bool:
        """Whether encoding a's bytes followed by b's gives just a, b."""
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            left, right = self._edges(a, True), self._edges(b, False)
            i = j = 0
            known = True
            while True:
                (x, until_x), (y, until_y) = left[i], right[j]
                r = self.rank.get((x, y), 1 << 61)
                if r < until_x and r <= until_y:  # at equal rank the merge further left comes first
                    known = False
                    break
                if until_x == until_y == 1 << 60:
                    break
                if until_x <= until_y:
                    i += 1
                if until_y <= until_x:
                    j += 1
            if len(self.pairs) > 4_000_000:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def _extend(self, w: bytes, n: list[int], last: list[int]) -> None:
        """Complete the counts and last tokens of w's byte prefixes, of which the first len(n) - 1 are there."""
        ids, pairs, neighbours, reach = self.ids, self.pairs, self.neighbours, self.reach
        for i in range(len(n), len(w) + 1):
            for j in range(max(0, i - reach.get(w[i - 3 : i], 2)) if i > 2 else 0, i):
                t = ids.get(w[j:i])
                if t is not None:
                    if j:
                        fits = pairs.get(last[j] << 32 | t)
                        if fits is None:
                            fits = neighbours(last[j], t)
                        if not fits:
                            continue
                    last.append(t)
                    n.append(n[j] + 1)
                    break

    def table(self, w: bytes) -> list[int]:
        """Count of every byte prefix of one pre-token, 0 first."""
        n, last = [0], [-1]
        self._extend(w, n, last)
        return n

    def totals(self, words: list[bytes]) -> list[int]:
        """Counts of sorted pre-tokens; what a word shares with the one before it isn't computed again."""
        out, n, last, before = [], [0], [-1], b""
        for w in words:
            k, most = 0, min(len(w), len(before))
            while k < most and w[k] == before[k]:
                k += 1
            del n[k + 1 :], last[k + 1 :]
            self._extend(w, n, last)
            out.append(n[-1])
            before = w
        return out

    def _sum(self, text: str) -> int:
        return sum(self.table(p.encode())[-1] for p in self.find(text))

    def count(self, text: str | None) -> int:
        """Tokens of a whole text."""
        if not text:
            return 0
        if self.cut is not None and any(s in text for s in self.special):
            parts = self.cut.split(text)
            return sum(map(self.count, parts)) + len(parts) - 1
        if self.odd(text):
            return self._sum(text)
        head, *rest = text.split(" ")
        known = self.chunk
        try:
            total = sum(map(known.__getitem__, rest))
        except KeyError:
            if len(known) > self.most:
                known.clear()
            self._learn(set(rest).difference(known))
            total = sum(map(known.__getitem__, rest))
        if head not in self.first:
            if len(self.first) > self.most // 10:
                self.first.clear()
            self.first[head] = self._sum(head)
        return total + self.first[head]

    def _learn(self, new: set[str]) -> None:
        """Counts of chunks with the space that leads each; a mark after letters is a pre-token of its own."""
        known = self.chunk
        cores = {c[:-1] if c[-1:] in (",", ".") else c for c in new}
        words = sorted((f" {c}".encode(), c) for c in cores.difference(known) if c.isalpha())
        known.update(zip((c for _, c in words), self.totals([w for w, _ in words]), strict=True))
        for c in new.difference(known):
            core = c[:-1]
            known[c] = known[core] + 1 if c[-1:] in (",", ".") and core.isalpha() else self._sum(f" {c}")

    def count_all(self, texts: pa.Array, budget: int | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Tokens of whole texts, and with ``budget`` the characters of each text's longest prefix within it. Only
        distinct chunks become Python strings."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        plain = texts.to_pylist()
        alone = [i for i, t in enumerate(plain) if self.odd(t) or any(s in t for s in self.special)]
        parts = pc.split_pattern(texts, " ")
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(parts).to_numpy())])
        coded = parts.flatten().dictionary_encode()
        names, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        known = self.chunk
        if len(known) > self.most:
            known.clear()
        self._learn(set(names).difference(known))
        each = np.fromiter(map(known.__getitem__, names), np.int64, len(names))[at]
        heads = ends[:-1]
        each[heads] = 0
        for i in heads.tolist():
            if head := names[at[i]]:
                if head not in self.first:
                    if len(self.first) > self.most // 10:
                        self.first.clear()
                    self.first[head] = self._sum(head)
                each[i] = self.first[head]
        run = np.concatenate([[0], np.cumsum(each)])
        total = np.diff(run[ends])
        fit = None
        if budget is not None:
            fit = pc.utf8_length(texts).to_numpy().astype(np.int64)
            over = np.flatnonzero(total > budget)
            # counts at the ends of chunks rise, so the last prefix that fits ends in the first chunk that passes it
            chunk = np.searchsorted(run, run[heads[over]] + budget, "right") - 1
            for i, c in zip(over.tolist(), chunk.tolist(), strict=True):
                k, first = c - int(heads[i]), not c - int(heads[i])
                words = parts.values.slice(heads[i], k).to_pylist() if k else []
                piece = names[at[c]] if first else f" {names[at[c]]}"
                fit[i] = sum(map(len, words)) + max(0, k - 1) + self.fits(piece, budget - int(run[c] - run[heads[i]]))
        for i in alone:
            total[i] = self.count(plain[i])
            if fit is not None and total[i] > budget:
                fit[i] = self.fits(plain[i], budget)
            elif fit is not None:
                fit[i] = len(plain[i])
        return total, fit

    def counts(self, text: str) -> np.ndarray:
        """Exact count of text[:k] for every k; special strings count once they are complete."""
        out, base, at = np.zeros(len(text) + 1, np.int64), 0, 0
        found = list(self.cut.finditer(text)) if self.cut is not None else []
        for stop, end in [(m.start(), m.end()) for m in found] + [(len(text), len(text))]:
            # an unfinished special string is ordinary text
            self._fill(text[at:end], out[at : end + 1], base)
            if end > stop:
                base = self.count(text[at:stop]) + base + 1
                out[end] = base
            at = end
        return out

    def _fill(self, text: str, out: np.ndarray, base: int) -> None:
        """Counts of all prefixes of a text without special strings: a cut leaves all pre-tokens before it as they are,
        and what it leaves of its own is one pre-token again, or white space that joins all white space before it."""
        out[0], at = base, 0
        marks: dict[int, int] = {0: base}  # counts at the beginnings of pre-tokens
        for p in self.find(text):
            table = self.table(p.encode())
            if p in CONTRACTIONS:
                for k in range(1, len(p)):
                    out[at + k] = base + self._sum(p[:k])
                out[at + len(p)] = base + table[-1]
            else:
                out[at + 1 : at + len(p) + 1] = base + self._by_character(p, table)
            at += len(p)
            base += table[-1]
            marks[at] = base
        for m in self.white(text):
            run = m[0]
            out[m.start() + 1 : m.end() + 1] = marks[m.start()] + self._by_character(run, self.table(run.encode()))

    @staticmethod
    def _by_character(p: str, table: list[int]) -> np.ndarray:
        if p.isascii():
            return np.array(table[1:])
        return np.array(table)[np.cumsum([len(c.encode()) for c in p])]

    def fits(self, text: str, budget: int) -> int:
        """Characters of the longest prefix with at most ``budget`` tokens."""
        return int(np.flatnonzero(self.counts(text) <= budget)[-1])


def loaded(path: str) -> PrefixCounts:
    """One table for each vocabulary and Python worker."""
    held = common.kept("prefix_counts")
    if path not in held:
        held[path] = PrefixCounts(path)
    return held[path]


def n_tokens(text: F.Column, vocabulary: str, limit: int) -> F.Column:
    """Column (struct n_tokens, fit_chars): exact number of tokens of each whole text, and the characters of its longest
    prefix that has at most ``limit`` tokens."""

    @F.arrow_udf("n_tokens long, fit_chars long")
    def count(texts: pa.Array) -> pa.Array:
        f = loaded(vocabulary).count_all
        sizes = np.diff(common.raw(texts)[1])
        found = [f(texts.slice(i, j - i), limit) for i, j in common.spans(sizes, 2 * common.BLOCK_BYTES)]
        cols = [np.concatenate(c) for c in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 2
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], ["n_tokens", "fit_chars"])

    return count(text)


def longest_prefix(text: F.Column, vocabulary: str, budget: int) -> F.Column:
    """Column: characters of the longest prefix that has at most ``budget`` tokens; null texts: 0."""

    @F.arrow_udf("long")
    def fit(texts: pa.Array) -> pa.Array:
        f = loaded(vocabulary).fits
        return pa.array([f(t or "", budget) for t in texts.to_pylist()], pa.int64())

    return fit(text)


def token_counts(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bytes, tokens, whether the tokens exceed ``limit``, and the characters that fit it, for each row."""
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes")
    counted = docs.select(F.col(id_col), n_bytes, n_tokens(F.col(text_col), vocabulary, limit).alias("__n"))
    return counted.select(id_col, "n_bytes", "__n.n_tokens", (F.col("__n.n_tokens") > limit).alias("over_limit"), "__n.fit_chars")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text. Null and empty texts have none; special strings count as the library has them;
    texts of any length are counted whole; repeated rows are counted each; an empty table gives no row; only doc_id and
    text are read."""
    return token_counts(common.table(spark, sf_dir, "documents"), common.tokenizer_path("byte_bpe_50k.json"), 512)
