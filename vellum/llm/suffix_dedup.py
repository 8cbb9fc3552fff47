"""Removal of repeated strings by bucket-pointer refinement.

A suffix array sorts positions by what follows; here only the first ``width`` bytes matter, so positions fall into
buckets of equal ``width``-byte strings, and a bucket of two or more positions is a repeat. Buckets are found from
coarse to fine, as in bucket-pointer refinement: initial buckets of q-grams (q = 64), then refinement by sorting on
the bucket of a later offset. What a refinement finds is what the next one points at, for all positions alike: depth 64
gives depth 128 (offset 64), and those buckets give depth 200 (offset 72). Positions alone in a bucket aren't refined.
A bucket's identifier between tasks is the hash of its content, so tasks that never meet agree on it; a string's is of
128 bits.

Not every position can travel. Each ``width``-byte string is charged to its least q-gram (the anchor), which equal
strings share; consecutive strings of one anchor form a segment, about one for 70 bytes.

1. Segments meet by their anchor's bucket. If a whole segment occurs twice, all its strings are repeats; if only its
   anchor does, it needs refinement; most drop out.
2. The segments left are taken out of the texts. Each is cut into ranges of eight strings, aligned to the anchor. What
   all strings of such a range share (its core) is their bucket now: ranges meet by it, and the question is the same as
   for segments. Most are settled: the range is a repeat, or its core is single.
3. Strings of the ranges left are refined inside each block, and met by their last bucket over all blocks.
4. Each text removes the union of its repeated strings.

Before each meeting a task sends a bucket once for about a million that it has, however often it has it, so a passage
that a third of all texts share costs a row for some 70 MB of text. What comes back to a text are facts on content ("this bucket is repeated"), true
wherever it occurs. Matches never cross texts; nothing is capped or sampled.

Null texts: empty. Texts shorter than ``width``: kept whole. Repeated rows: each is the other's repeat. Empty table:
no rows. Columns of the input are kept, but for those with a name of RESULTS, which the results replace.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import mix

U64 = np.uint64
GRAM = 64
#: Bytes of text of a block.
BLOCK = 1 << 20
#: Strings of a range.
RANGE = 8


class Segments:
    """Segments of strings over some bytes: first and last string, anchor, owner, bucket and hash of the whole."""

    def __init__(self, data: np.ndarray, width: int):
        common.kept("suffix_dedup")
        self.data, self.width = data, width
        self.grams = common.Rolling(data)
        self.gram = self.grams.width(GRAM)

    def set(self, first: np.ndarray, last: np.ndarray, anchor: np.ndarray, doc: np.ndarray) -> None:
        self.first, self.last, self.anchor, self.doc = first, last, anchor, doc
        self.key = self.gram[anchor] if len(anchor) else np.zeros(0, U64)
        self.whole = self.hashed(first, last, anchor - first)

    def hashed(self, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Odd hash of all bytes of the strings first ... last, and of where they are with regard to the anchor."""
        if not len(first):
            return np.zeros(0, U64)
        return mix(self.grams.of(first, last + self.width) + place.astype(U64) * U64(0x9E6C63D0876A9A47)) | U64(1)

    def ranges(self, chosen: np.ndarray) -> tuple[np.ndarray, ...]:
        """(first, last, owner, core, whole) of the ranges of the chosen segments."""
        first, last, anchor, doc = self.first[chosen], self.last[chosen], self.anchor[chosen], self.doc[chosen]
        low = (anchor - last) // RANGE
        n = (anchor - first) // RANGE - low + 1
        before = np.cumsum(n) - n
        r = np.repeat(low - before, n) + np.arange(int(n.sum()))
        a = np.repeat(anchor, n)
        core = a - RANGE * r  # the last string that a range can have starts here
        lo, hi = np.maximum(np.repeat(first, n), core - RANGE + 1), np.minimum(np.repeat(last, n), core)
        if not len(lo):
            return lo, hi, lo, np.zeros(0, U64), np.zeros(0, U64)
        key = mix(self.grams.of(core, core - RANGE + 1 + self.width) + r.astype(U64))
        return lo, hi, np.repeat(doc, n), key, self.hashed(lo, hi, a - lo)

    def positions(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """All of first ... last, one after another."""
        n = last - first + 1
        before = np.cumsum(n) - n
        return np.repeat(first - before, n) + np.arange(int(n.sum()))

    def depths(self) -> list[int]:
        """Bytes that each refinement's buckets have in common: doubled, and the last one as long as a string."""
        out = [GRAM]
        while out[-1] < self.width:
            out.append(min(2 * out[-1], self.width))
        return out

    def bucket(self, at: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
        """Identifier of the last bucket of each position; with ``group`` (see ``refined``) once for each group."""
        if group is not None and len(at):
            one = np.zeros(int(group.max()) + 1, np.int64)
            one[group] = at
            return self.bucket(one)[group]
        return self._identifier(at, len(self.depths()) - 1) | U64(1)

    def _identifier(self, at: np.ndarray, level: int) -> np.ndarray:
        if not level:
            return mix(self.gram[at] + U64(1))
        offset = self.depths()[level] - self.depths()[level - 1]
        return mix(self._identifier(at, level - 1) * U64(0xFF51AFD7ED558CCD) + self._identifier(at + offset, level - 1))

    def second(self, at: np.ndarray) -> np.ndarray:
        """Another hash of each position's string, of other values of bytes; odd, so never 0."""
        return common.Rolling(self.data, 0x5DEECE66D).of(at, at + self.width) | U64(1) if len(at) else np.zeros(0, U64)

    def refined(self, at: np.ndarray, level: int | None = None) -> np.ndarray:
        """Number of each position's bucket, of the last refinement if no other is asked for."""
        if level is None:
            level = len(self.depths()) - 1
        if not level or not len(at):
            return _ranks(self.gram[at])
        later = at + self.depths()[level] - self.depths()[level - 1]
        both = np.unique(np.concatenate([at, later]))
        found = self.refined(both, level - 1)
        out, pointed = found[np.searchsorted(both, at)], found[np.searchsorted(both, later)]
        alive = np.flatnonzero((np.bincount(out) > 1)[out])
        out[alive] = _ranks(out[alive].astype(U64) << U64(32) | pointed[alive].astype(U64)) + out.max() + 1
        return _ranks(out)


class Block(Segments):
    """Segments of whole texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, width: int):
        super().__init__(data, width)
        self.offsets = offsets
        size = np.diff(offsets)
        starts = np.maximum(size - width + 1, 0)
        valid = np.zeros(len(data) + 1, np.int32)
        np.add.at(valid, offsets[:-1], (starts > 0).astype(np.int32))
        np.add.at(valid, offsets[:-1] + starts, -(starts > 0).astype(np.int32))
        at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
        if not len(at):
            self.set(at, at, at, at)
            return
        # least gram of each string, the leftmost of equals: one minimum finds both
        low = (self.gram & U64(0xFFFFFFFF00000000)) | np.arange(len(self.gram), dtype=U64)
        span, have = width - GRAM + 1, 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[: len(low) - step], low[step:])
            have += step
        anchor = (low[at] & U64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)])
        i = np.flatnonzero(new)
        first = at[i]
        self.set(first, at[np.append(i[1:], len(at)) - 1], anchor[i], np.searchsorted(offsets, first, "right") - 1)


class Extract(Segments):
    """Segments that were taken out of their texts: packed rows of TAKEN."""

    def __init__(self, b: pa.RecordBatch, width: int):
        data, _ = common.raw(b.column("data"))
        super().__init__(data, width)
        size, place = (np.frombuffer(common.raw(b.column(c))[0].tobytes(), np.int32).astype(np.int64) for c in ("size", "place"))
        n = np.diff(common.raw(b.column("size"))[1]) // 4
        first = np.cumsum(size) - size
        self.set(first, first + size - width, first + place, np.repeat(np.arange(b.num_rows), n))


TAKEN = "row long, place binary, size binary, data binary"


def _ranks(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1]


def _packed(part: np.ndarray, parts: int, *columns: np.ndarray) -> pa.RecordBatch:
    """One row for each part with the columns' bytes."""
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    used = np.flatnonzero(np.diff(ends))
    cols = [c[order] for c in columns]
    return pa.RecordBatch.from_arrays(
        [pa.array(used.astype(np.int32)), pa.array(np.zeros(len(used), bool)), *(pa.array([c[ends[p] : ends[p + 1]].tobytes() for p in used], pa.binary()) for c in cols)],
        ["part", "fact", "key", "whole", "row"],
    )


SENT = "part int, fact boolean, key binary, whole binary, row binary"
FACTS = "part int, row binary, kind binary, keys binary"
#: Kinds of facts: a repeated segment, an anchor of different segments, the same for ranges and cores, a repeated string.
SEGMENT, ANCHOR, WHOLE, CORE, STRING = range(5)
KIND_NAMES = ["segments", "anchors", "wholes", "cores", "strings"]


#: Keys that a task brings together before it sends them.
SENT_AT_ONCE = 1 << 20
#: Columns of the result.
RESULTS = ["dedup_kept", "dedup_text", "dedup_bytes", "dedup_removed", "dedup_spans"]


def _groups(key: np.ndarray, whole: np.ndarray, exact: bool) -> tuple[np.ndarray, ...]:
    """Of rows sorted by key, then whole: which are the first of their key, which key's wholes differ, which keys and
    which wholes come again. ``exact``: key and whole together are the key."""
    if not len(key):
        return (np.zeros(0, bool),) * 4
    other = np.concatenate([[False], (key[1:] == key[:-1]) & (whole[1:] != whole[:-1])])
    first = np.concatenate([[True], key[1:] != key[:-1]])
    if exact:
        first, other = first | other, np.zeros(len(key), bool)
    group = np.cumsum(first) - 1
    mixed = (np.bincount(group, other) > 0)[group]
    many = (np.bincount(group) > 1)[group]
    same = ~first & ~other
    again = same | np.concatenate([same[1:], [False]])
    return first, mixed, many, again


def _sent(found: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], parts: int, kinds: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """What a task sends to the meeting, of its blocks' keys, wholes and rows: each key once, with its whole and a row to
    answer to, or with whole 0 if its wholes differ; and as facts what it knows by itself. kinds: of equal wholes, of
    keys whose wholes differ; of strings, whose wholes are second hashes, only equal pairs count."""
    held: list[tuple[np.ndarray, ...]] = []
    count = number = 0
    for block in found:
        held.append(block)
        count += len(block[0])
        if count >= SENT_AT_ONCE:
            yield from _sent_together(held, number, parts, kinds)
            held, count, number = [], 0, number + 1
    if count:
        yield from _sent_together(held, number, parts, kinds)


def _sent_together(held: list[tuple[np.ndarray, ...]], number: int, parts: int, kinds: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    key, whole, row = (np.concatenate(x) for x in zip(*held, strict=True))
    held.clear()
    order = np.lexsort((whole, key))
    key, whole, row = key[order], whole[order], row[order]
    first, mixed, _, again = _groups(key, whole, kinds[0] == STRING)
    k, w, r = key[first], np.where(mixed, U64(0), whole)[first], np.where(mixed, np.int64(0), row)[first]
    # mixed anew: anchors are least hashes, so their own high bits are all small
    yield _packed(((mix(k) >> U64(32)) * U64(parts) >> U64(32)).astype(np.int64), parts, k, w, r)
    if again.any() or mixed.any():
        fact = np.concatenate([(key if kinds[0] == STRING else whole)[again], key[mixed]])
        kind = np.repeat(np.array(kinds, np.uint8), [again.sum(), mixed.sum()])
        rows = np.concatenate([row[again], row[mixed]])
        for i in range(0, len(fact), 1 << 17):
            part = (1009 * TaskContext.get().partitionId() + 31 * number + (i >> 17)) % parts
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([True]), *(pa.array([x[i : i + (1 << 17)].tobytes()], pa.binary()) for x in (fact, kind, rows))], ["part", "fact", "key", "whole", "row"])


def _facts(fact: np.ndarray, kind: np.ndarray, row: np.ndarray, parts: int) -> pa.RecordBatch:
    """Rows of FACTS: for each part of the rows their facts' bytes."""
    part = (common.mix(row.view(U64)) >> U64(32)) * U64(parts) >> U64(32)
    order = np.lexsort((fact, kind, row, part))
    part, fact, kind, row = part[order].astype(np.int64), fact[order], kind[order], row[order]
    ends = np.searchsorted(part, np.arange(parts + 1))
    used = np.flatnonzero(np.diff(ends))
    cut = lambda x: pa.array([x[ends[p] : ends[p + 1]].tobytes() for p in used], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), cut(row), cut(kind.astype(np.uint8)), cut(fact)], ["part", "row", "kind", "keys"])


def _by_row(facts: DataFrame, parts: int, kinds: list[int]) -> DataFrame:
    """One row for each text that has facts of these kinds: row, and for each kind the keys' bytes (null: none)."""
    names = [KIND_NAMES[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, found, keys = [], [], []
        for b in batches:
            for r, k, f in zip(b.column("row"), b.column("kind"), b.column("keys"), strict=True):
                k = np.frombuffer(k.as_buffer(), np.uint8)
                use = np.isin(k, kinds)
                if use.any():
                    rows.append(np.frombuffer(r.as_buffer(), np.int64)[use])
                    found.append(k[use])
                    keys.append(np.frombuffer(f.as_buffer(), U64)[use])
        if not rows:
            return
        row, kind, key = np.concatenate(rows), np.concatenate(found), np.concatenate(keys)
        order = np.lexsort((key, kind, row))
        row, kind, key = row[order], kind[order], key[order]
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])])
        row, kind, key = row[new], kind[new], key[new]
        one = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        ids = row[one]
        each = [(row[kind == k], key[kind == k]) for k in kinds]
        for i in range(0, len(ids), 2000):
            part = ids[i : i + 2000]
            cols = [pa.array(part)]
            for rows_of, own in each:
                lo, hi = np.searchsorted(rows_of, part), np.searchsorted(rows_of, part, "right")
                cols.append(pa.array([own[x:y].tobytes() if y > x else None for x, y in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, ["row", *names])

    return facts.repartitionById(parts, F.col("part")).mapInArrow(run, "row long, " + ", ".join(f"{n} binary" for n in names))


def _meeting(sent: DataFrame, parts: int, kinds: tuple[int, int]) -> DataFrame:
    """Facts that come of all blocks' keys together, and those that blocks knew."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, wholes, rows = [], [], []
        for b in batches:
            known = b.column("fact").to_pylist()
            for is_fact, k, w, r in zip(known, b.column("key"), b.column("whole"), b.column("row"), strict=True):
                k, r = np.frombuffer(k.as_buffer(), U64), np.frombuffer(r.as_buffer(), np.int64)
                if is_fact:
                    yield _facts(k, np.frombuffer(w.as_buffer(), np.uint8), r, parts)
                else:
                    keys.append(k)
                    wholes.append(np.frombuffer(w.as_buffer(), U64))
                    rows.append(r)
        if not keys:
            return
        key, whole, row = (np.concatenate(x) for x in (keys, wholes, rows))
        keys = wholes = rows = None
        order = np.lexsort((whole, key))
        key, whole, row = key[order], whole[order], row[order]
        _, mixed, many, again = _groups(key, whole, kinds[0] == STRING)
        asks = many & (whole != 0)  # 0: a task knew already
        again, mixed = again & asks, mixed & asks
        yield _facts(np.concatenate([(key if kinds[0] == STRING else whole)[again], key[mixed]]), np.repeat(np.array(kinds, np.uint8), [again.sum(), mixed.sum()]), np.concatenate([row[again], row[mixed]]), parts)

    return sent.repartitionById(parts, F.col("part")).mapInArrow(run, FACTS)


def _known(b: pa.RecordBatch, kind: str) -> np.ndarray:
    """Distinct keys of a column of packed keys."""
    return np.unique(np.frombuffer(common.raw(b.column(kind))[0].tobytes(), U64))


def _in(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Membership in a sorted array."""
    if not len(known):
        return np.zeros(len(x), bool)
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x


def deduplicated(docs: DataFrame, width: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``, with dedup_kept (the bytes left), dedup_text (those that are whole characters),
    dedup_bytes, dedup_removed and dedup_spans (maximal removed runs)."""
    spark = docs.sparkSession
    docs = docs.drop(*RESULTS)
    given, place = docs.columns, {c: f"column_{i}" for i, c in enumerate(docs.columns)}
    docs, id_col, text_col = docs.toDF(*place.values()), place[id_col], place[text_col]  # no name can clash with those used here
    # some 24 bytes for each segment, and about as many for facts
    parts = common.parts(spark, common.size_of(docs.select(text_col)) // 2)
    # content facts come back by this key; where two rows share one, each gets true facts of the other besides its own
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    texts = docs.select(row.alias("row"), F.col(text_col).alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for b in common.blocks(batches, "text", BLOCK):
                block = Block(*common.raw(b.column("text")), width)
                yield block.key, block.whole, b.column("row").to_numpy()[block.doc]

        yield from _sent(keys(), parts, (SEGMENT, ANCHOR))

    found = common.saved(_meeting(texts.mapInArrow(anchors, SENT), parts, (SEGMENT, ANCHOR)), "repeat-segments")
    common.forget(spark)
    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, "text", BLOCK):
            block = Block(*common.raw(b.column("text")), width)
            # segments that are repeats as a whole stay in: others may share a piece of them
            chosen = np.flatnonzero(_in(block.key, _known(b, "anchors")))
            doc, size = block.doc[chosen], (block.last - block.first)[chosen] + width
            place = (block.anchor - block.first)[chosen].astype(np.int32)
            data = block.data[block.positions(block.first[chosen], block.last[chosen] + width - 1)] if len(chosen) else block.data[:0]
            ends = np.searchsorted(doc, np.arange(b.num_rows + 1))
            stop = np.concatenate([[0], np.cumsum(size)])
            cut_ = lambda x, e: pa.array([x[i:j].tobytes() for i, j in zip(e[:-1].tolist(), e[1:].tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("row"), cut_(place, ends), cut_(size.astype(np.int32), ends), cut_(data, stop[ends])], ["row", "place", "size", "data"])

    some = _by_row(found, parts, [ANCHOR])
    taken = common.saved(texts.join(some, "row").select("row", "text", "anchors").mapInArrow(take, TAKEN), "repeat-taken")
    common.forget(spark)

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for b in common.blocks(batches, "data", BLOCK):
                x = Extract(b, width)
                _, _, doc, core, whole = x.ranges(np.arange(len(x.first)))
                yield core, whole, b.column("row").to_numpy()[doc]

        yield from _sent(keys(), parts, (WHOLE, CORE))

    met = common.saved(_meeting(taken.mapInArrow(ranges, SENT), parts, (WHOLE, CORE)), "repeat-ranges")
    common.forget(spark)

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def keys() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            for b in common.blocks(batches, "data", BLOCK):
                x = Extract(b, width)
                lo, hi, doc, core, _ = x.ranges(np.arange(len(x.first)))
                left = _in(core, _known(b, "cores"))
                at = x.positions(lo[left], hi[left])
                yield x.bucket(at, x.refined(at)), x.second(at), b.column("row").to_numpy()[np.repeat(doc[left], (hi - lo + 1)[left])]

        yield from _sent(keys(), parts, (STRING, STRING))

    mixed = taken.join(_by_row(met, parts, [CORE]), "row").select("row", "place", "size", "data", "cores")
    last = common.saved(_meeting(mixed.mapInArrow(strings, SENT), parts, (STRING, STRING)), "repeat-strings")
    common.drop_saved(taken)
    del mixed, taken
    common.forget(spark)
    facts = _by_row(found.unionByName(met).unionByName(last), parts, kinds := [SEGMENT, ANCHOR, WHOLE, STRING])
    names = docs.columns
    full = docs.withColumn("dedup_row", row).join(facts.select(F.col("row").alias("dedup_row"), *(F.col(KIND_NAMES[k]).alias(f"dedup_{KIND_NAMES[k]}") for k in kinds)), "dedup_row", "left").drop("dedup_row")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, text_col, BLOCK):
            block = Block(*common.raw(b.column(text_col)), width)
            whole = _in(block.whole, _known(b, "dedup_segments"))
            start = np.zeros(len(block.data) + 1, np.int64)
            start[1:][block.positions(block.first[whole], block.last[whole])] = 1
            lo, hi, _, _, all_ = block.ranges(np.flatnonzero(_in(block.key, _known(b, "dedup_anchors")) & ~whole))
            repeated = _in(all_, _known(b, "dedup_wholes"))
            start[1:][block.positions(lo[repeated], hi[repeated])] = 1
            at = block.positions(lo[~repeated], hi[~repeated])
            if len(at):
                start[1:][at[_in(block.bucket(at), _known(b, "dedup_strings"))]] = 1
            total = np.cumsum(start)
            gone = total[1:] > np.concatenate([np.zeros(min(width, len(block.data)), np.int64), total[1 : len(block.data) - width + 1]])[: len(block.data)] if len(block.data) else np.zeros(0, bool)
            begin = gone & ~np.concatenate([[False], gone[:-1]])
            kept = [block.data[i:j][~gone[i:j]].tobytes() for i, j in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist(), strict=True)]
            heads = block.offsets[:-1][np.diff(block.offsets) > 0]
            begin[heads] = gone[heads]
            per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[block.offsets])
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in names), pa.array(kept, pa.binary()), pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()), pa.array(np.diff(block.offsets)), pa.array(per(gone)), pa.array(per(begin))],
                [*names, *RESULTS],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return full.mapInArrow(cut, f"{schema}, dedup_kept binary, dedup_text string, dedup_bytes long, dedup_removed long, dedup_spans long").toDF(*given, *RESULTS)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes removed. Null and empty texts lose nothing; texts longer than a block are read in
    whole; every occurrence goes, so ties don't arise; repeated rows are each other's copies; an empty table gives no row;
    only doc_id and text are read."""
    out = deduplicated(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("dedup_bytes").alias("n_bytes"), F.col("dedup_removed").alias("n_removed"), F.col("dedup_spans").alias("n_spans"), F.sha2("dedup_kept", 256).alias("kept_sha256"))
