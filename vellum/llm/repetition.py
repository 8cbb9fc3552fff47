"""Quality rules by repeated substrings, found in a suffix array with longest common prefixes.

A text is its sequence of words. The suffixes of all texts of a block are sorted together (text first, so texts never
mix) by prefix doubling, which sorts again only what is still tied; the ranks of each doubling give the common prefixes
of neighbours. Intervals of the common-prefix array that can't be extended to either side are the maximal repeated
substrings. Those of ``least`` words or more count: their spans are united, and a text fails if the union covers more
than ``covered`` of the characters in its words, or the longest one has more than ``longest`` words.

Beside it stand plain counts: characters in words, symbols, repeated lines, words in repeated windows of three.

No shuffle. A block has 2 MB of texts, a longer text stands alone, whole: it takes some 100 bytes a word, and 4 more for
each doubling up to its longest repeat. Null and empty texts have no words and fail (too few words); equal texts get
equal values; repeated rows are judged each; an empty table gives an empty one. Other columns stay as they are, and
``rules`` is refused where the table has a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Repeats of fewer words don't count: a line of a dozen words at both ends of a page is no fault.
LEAST = 16
#: Most part of the characters in words that repeats may cover.
COVERED = 0.2
#: Most words of one repeat.
LONGEST = 100

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_repeats", "longest_repeat", "repeat_chars"]
_KIND = "struct<" + ", ".join(f"{c}: long" for c in _COUNTS) + ", spans: array<struct<start: long, end: long>>>"
_SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))


def _sums(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of each text's part of ``flags``."""
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[ends])


def _codes(data: np.ndarray, keep: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for each distinct string; strings are the kept bytes, cut by sizes."""
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    strings = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[keep]))])
    return strings.dictionary_encode().indices.to_numpy().astype(np.int64)


def suffix_array(codes: np.ndarray, text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffixes in order, texts apart, and each position's rank by its first 1, 2, 4, ... words. ``end``: where the
    position's text ends. Equal ranks by k words mean k equal words, as what ends before is a rank of its own."""
    n = len(codes)
    key = text * (int(codes.max(initial=0)) + 1) + codes
    order = np.argsort(key, kind="stable")
    rank, levels, k = np.zeros(n, np.int64), [], 1
    sorted_key = key[order]
    head = np.append(True, sorted_key[1:] != sorted_key[:-1])[:n]
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    while True:
        levels.append(rank.astype(np.int32 if n < 1 << 31 else np.int64))
        slots = np.flatnonzero(~(head & np.append(head[1:], True)))  # places in groups of two or more
        if not len(slots):
            return order, levels
        at = order[slots]
        later = np.where(at + k < end[at], rank[np.minimum(at + k, n - 1)], -1)
        again = np.lexsort((later, rank[at]))
        at, later, group = at[again], later[again], rank[at][again]
        order[slots] = at
        head[slots] = np.append(True, (group[1:] != group[:-1]) | (later[1:] != later[:-1]))
        place = np.maximum.accumulate(np.where(head[slots], slots, 0))
        rank[at] = place
        k *= 2


def common_prefixes(order: np.ndarray, levels: list[np.ndarray], end: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places r in the order whose suffix shares ``least`` words or more with the one before it, and how many."""
    first = levels[min(int(least).bit_length(), len(levels)) - 1]
    at = np.flatnonzero(first[order[1:]] == first[order[:-1]]) + 1 if len(order) else np.zeros(0, np.int64)
    a, b = order[at - 1], order[at]
    a_end, b_end, shared = end[a], end[b], np.zeros(len(at), np.int64)
    for i in range(len(levels) - 1, -1, -1):
        inside = (a < a_end) & (b < b_end)
        equal = np.zeros(len(a), bool)
        equal[inside] = levels[i][a[inside]] == levels[i][b[inside]]
        step = np.where(equal, 1 << i, 0)
        a, b, shared = a + step, b + step, shared + step
    long = shared >= least
    return at[long], shared[long]


def intervals(places: np.ndarray, shared: np.ndarray) -> list[tuple[int, int, int]]:
    """Common-prefix intervals (first and last place in the order, words) of consecutive places."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # (first place, words)
    before = -2
    for r, n in zip([*places.tolist(), -1], [*shared.tolist(), 0], strict=True):
        if r != before + 1:
            out += [(lo, before, w) for lo, w in reversed(stack)]
            stack, lo = [], r - 1
        else:
            lo = r - 1
        while stack and stack[-1][1] > n:
            lo, w = stack.pop()
            out.append((lo, before, w))
        if not stack or stack[-1][1] < n:
            stack.append((lo, n))
        before = r
    return out


def judged(texts: pa.Array, least: int = LEAST) -> pa.StructArray:
    """Counts and spans of repeats (code points) of each text of a block."""
    data, ends = common.raw(texts)
    n_texts = len(ends) - 1
    number = np.repeat(np.arange(n_texts), np.diff(ends))
    inside = ~_SPACE[data]
    points = (data & 0xC0) != 0x80
    first_byte = np.zeros(len(data) + 1, bool)
    first_byte[ends] = True
    start = np.flatnonzero(inside & (np.append(True, ~inside[:-1])[: len(data)] | first_byte[:-1]))
    stop = np.flatnonzero(inside & (np.append(~inside[1:], True)[: len(data)] | first_byte[1:])) + 1
    text = number[start]
    words = np.bincount(text, minlength=n_texts)
    codes = _codes(data, inside, stop - start)
    word_end = np.cumsum(words)[text]

    # lines: what stands between line feeds; the last one has none after it
    feed = data == 0x0A
    n_lines = _sums(feed, ends) + 1
    cut = np.sort(np.concatenate([np.flatnonzero(feed), ends[1:]]))  # a line's end; a text's own end comes after its last feed
    line_text = np.repeat(np.arange(n_texts), n_lines)
    line_start = np.append(0, cut[:-1] + 1)[: len(cut)] if len(cut) else cut
    line_start = np.where(np.append(True, line_text[1:] != line_text[:-1]), ends[line_text], line_start)
    has_word = np.append(0, np.cumsum(inside))
    said = has_word[cut] > has_word[line_start]
    line = _codes(data, ~feed, cut - line_start)
    _, seen = np.unique(line_text[said] * (len(line) + 1) + line[said], return_index=True)
    dup_lines = np.bincount(line_text[said], minlength=n_texts) - np.bincount(line_text[said][seen], minlength=n_texts)

    order, levels = suffix_array(codes, text, word_end)
    here = np.arange(len(codes))
    whole = here + 3 <= word_end
    pair = levels[min(1, len(levels) - 1)]  # ranks by two words, or by one if all words differ
    key = pair[whole].astype(np.int64) * (int(codes.max(initial=0)) + 1) + codes[np.minimum(here + 2, len(codes) - 1)][whole]
    _, which, often = np.unique(key, return_inverse=True, return_counts=True)
    window = np.zeros(len(codes) + 3, np.int64)
    np.add.at(window, here[whole][often[which] > 1], 1)
    np.add.at(window, here[whole][often[which] > 1] + 3, -1)
    repeated = np.cumsum(window)[: len(codes)] > 0

    places, shared = common_prefixes(order, levels, word_end, least)
    before = np.where((here > 0) & (text[here - 1] == text), codes[here - 1], -1) if len(codes) else here
    change = np.append(0, np.cumsum(np.append(True, (before[order[1:]] != before[order[:-1]]) | (before[order[1:]] < 0)))) if len(codes) else np.zeros(1, np.int64)
    longest, repeats, cover = np.zeros(n_texts, np.int64), np.zeros(n_texts, np.int64), np.zeros(len(codes) + 1, np.int64)
    found = np.array(intervals(places, shared), np.int64).reshape(-1, 3)
    maximal = found[change[found[:, 1] + 1] > change[found[:, 0] + 1]]  # the words before differ
    np.add.at(repeats, text[order[maximal[:, 0]]], 1)
    np.maximum.at(longest, text[order[maximal[:, 0]]], maximal[:, 2])
    for side in (places - 1, places):  # each suffix with the neighbour that shares most: the deepest interval it is in
        np.add.at(cover, order[side], 1)
        np.add.at(cover, order[side] + shared, -1)
    covered = np.cumsum(cover)[:-1] > 0
    chars = np.append(0, np.cumsum(points))
    size = chars[stop] - chars[start]
    edge = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]])) if len(codes) else np.zeros(1, np.int8)
    cut_here = np.flatnonzero(covered[1:] & covered[:-1] & (text[1:] != text[:-1])) + 1 if len(codes) else here
    opens = np.sort(np.concatenate([np.flatnonzero(edge > 0), cut_here]))
    closes = np.sort(np.concatenate([np.flatnonzero(edge < 0), cut_here])) - 1
    offset = chars[ends[text[opens]]] if len(opens) else opens
    spans = pa.StructArray.from_arrays([pa.array(chars[start[opens]] - offset, pa.int64()), pa.array(chars[stop[closes]] - offset, pa.int64())], ["start", "end"])
    span_ends = np.append(0, np.cumsum(np.bincount(text[opens], minlength=n_texts)))
    per_word = lambda x: np.bincount(text, weights=x, minlength=n_texts).astype(np.int64)
    columns = [words, per_word(size), _sums(_SYMBOL[data], ends), dup_lines, per_word(repeated), repeats, longest, per_word(size * covered)]
    return pa.StructArray.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.ListArray.from_arrays(pa.array(span_ends, pa.int32()), spans)], [*_COUNTS, "spans"])


def measured(docs: DataFrame, text: str = "text", least: int = LEAST) -> DataFrame:
    """``docs`` with a column ``rules``: counts, and the spans (code points) that maximal repeats cover."""
    if "rules" in docs.columns:
        raise ValueError("the table has a column named rules")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, text):
            yield pa.RecordBatch.from_arrays([*b.columns, judged(b.column(text), least)], [*b.schema.names, "rules"])

    kinds = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{kinds}, rules {_KIND}")


def base_failed(rules: F.Column) -> F.Column:
    """Fewer than 50 words, or more than half of them in repeated windows of three."""
    return (rules.n_words < 50) | (100 * rules.n_repeat_words > 50 * rules.n_words)


def kept(rules: F.Column, covered: float = COVERED, longest: int = LONGEST) -> F.Column:
    """Passes the base rules and both limits on repeats."""
    return ~base_failed(rules) & (rules.repeat_chars <= covered * rules.word_chars) & (rules.longest_repeat <= longest)


def op12_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on every whole document; columns beyond the contract: repeats, the longest one's words, covered characters.
    Nulls, empty and long texts, ties and the empty table: as the module says."""
    common.small_batches(spark)
    rules = F.col("rules")
    out = measured(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(rules[c].alias(c) for c in _COUNTS[:5]), base_failed(rules).alias("base_failed"), kept(rules).alias("kept"), *(rules[c].alias(c) for c in _COUNTS[5:]))
