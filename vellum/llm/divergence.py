"""Audit of how the sources of a language diverge, by sparse merges of pairs of groups.

A group is one (lang, source). Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased; a
language keeps those in ``documents`` of its documents or more. Smoothed shares are integers in parts of 10^9, and the
divergence of one term is floor((p - q)^2 / q), all exact.

1. A task counts terms of its texts and adds them up before anything travels: occurrences and documents by (lang,
   source, term), however often a word occurs.
2. Counts meet by (lang, block), a block being a hash class of terms, so no language, source or word is one key. A
   block numbers its kept terms and gives each group's sorted array of (term id, count).
3. Pair tasks: sources of a language form tiles of 16; a task has one block of two tiles and co-groups the two arrays of
   each unordered pair. A galloping intersection finds the overlap; overlaps, terms of one side and terms of neither are
   priced both ways. Sums over blocks give each pair's value. A group's array goes to as many tasks as there are tiles.
4. Terms of a group against its language: the first ``most`` of each block, then of all.

Totals of groups are one row a group; they are broadcast up to ``GROUPS`` rows and joined by a shuffle beyond.

Null text, lang and source count as ''. Groups without a term take part with zero counts; a language that keeps no term
gives pairs of value 0. Repeated rows are documents of their own; ties are ordered by the item's UTF-8 bytes; texts of
any length are counted whole; an empty table gives no row. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Parts that shares are given in.
PARTS = 1_000_000_000
#: Bytes of text whose terms a block has, about.
BLOCK_TEXT = 32 << 20
#: Sources in a tile.
TILE = 16
#: Most groups whose totals are broadcast: some 10 MB.
GROUPS = 100_000
#: Counts that a task holds before it sends them.
HELD = 250_000

_TERM = np.isin(np.arange(256), [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)
_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_ARRAYS = "lang string, block int, source string, kept long, total long, ids array<int>, n array<long>, all array<long>, terms array<string>"


def term_counts(batch: pa.RecordBatch) -> pa.Table:
    """Occurrences and documents of each (lang, source, term) in a batch of (lang, source, text)."""
    data, ends = common.raw(batch.column("text"))
    inside = _TERM[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    start = np.flatnonzero(inside & (np.append(True, ~inside[:-1])[: len(data)] | edge[:-1]))
    stop = np.flatnonzero(inside & (np.append(~inside[1:], True)[: len(data)] | edge[1:])) + 1
    doc = np.searchsorted(ends, start, side="right") - 1
    offsets = np.concatenate([[0], np.cumsum(stop - start)]).astype(np.int64)
    terms = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[inside]])).dictionary_encode()
    code = terms.indices.to_numpy().astype(np.int64)
    names = [pc.fill_null(batch.column(c).cast(pa.string()), "").dictionary_encode() for c in ("lang", "source")]
    lang, source = (x.indices.to_numpy().astype(np.int64) for x in names)
    group = lang * len(names[1].dictionary) + source
    k = max(1, len(terms.dictionary))
    once, often = np.unique(doc * k + code, return_counts=True)  # a term of a document
    key, back = np.unique(group[once // k] * k + once % k, return_inverse=True)
    n, docs = np.zeros(len(key), np.int64), np.bincount(back, minlength=len(key))
    np.add.at(n, back, often)
    take = lambda x, at: x.dictionary.cast(pa.string()).take(pa.array(at))
    g = key // k
    return pa.table([take(names[0], g // max(1, len(names[1].dictionary))), take(names[1], g % max(1, len(names[1].dictionary))), take(terms, key % k), pa.array(n), pa.array(docs)], schema=_COUNTS)


def _added(parts: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(parts).group_by(["lang", "source", "term"]).aggregate([("n", "sum"), ("docs", "sum")])
    return t.select(["lang", "source", "term", "n_sum", "docs_sum"]).rename_columns(_COUNTS.names).cast(_COUNTS)


def counts(docs: DataFrame) -> DataFrame:
    """Counts of all texts, added up within each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for b in common.blocks(batches, "text"):
            held.append(term_counts(b))
            size += held[-1].num_rows
            if size > 2 * HELD:
                held = [_added(held)]
                size = held[0].num_rows
                if size > HELD:
                    yield from held[0].to_batches(max_chunksize=1 << 16)
                    held, size = [], 0
        if held:
            yield from _added(held).to_batches(max_chunksize=1 << 16)

    return docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")


def _arrays(documents: int):
    def run(key: tuple, t: pa.Table) -> pa.Table:
        lang, block = (k.as_py() for k in key)
        t = _added([t.select(_COUNTS.names).cast(_COUNTS)])
        coded = t.column("term").combine_chunks().cast(pa.large_string()).dictionary_encode()
        by_name = pc.sort_indices(coded.dictionary).to_numpy()
        at, n = coded.indices.to_numpy(), t.column("n").to_numpy()
        seen, total = np.zeros((2, len(by_name)), np.int64)
        np.add.at(seen, at, t.column("docs").to_numpy())
        np.add.at(total, at, n)
        keep = seen[by_name] >= documents
        number = np.full(len(by_name), -1)
        number[by_name[keep]] = np.arange(int(keep.sum()))
        ids = number[at]
        source = t.column("source").combine_chunks().dictionary_encode()
        of = source.indices.to_numpy()
        order = np.lexsort((ids, of))
        order = order[ids[order] >= 0]
        cuts = np.flatnonzero(np.append(True, np.diff(of[order]) != 0)) if len(order) else np.zeros(0, np.int64)
        ends = pa.array(np.append(cuts, len(order)), pa.int32())
        each = lambda x, kind: pa.ListArray.from_arrays(ends, pa.array(x[order], kind))
        names = coded.dictionary.cast(pa.string()).take(pa.array(at[order]))
        m = len(cuts)
        sums = np.add.reduceat(n[order], cuts) if m else cuts
        return pa.table([pa.array([lang] * m, pa.string()), pa.array([block] * m, pa.int32()), source.dictionary.take(pa.array(of[order[cuts]])), pa.array([int(keep.sum())] * m, pa.int64()), pa.array(sums, pa.int64()),
                         each(ids, pa.int32()), each(n, pa.int64()), each(total[at], pa.int64()), pa.ListArray.from_arrays(ends, names)],
                        names=["lang", "block", "source", "kept", "total", "ids", "n", "all", "terms"])

    return run


def shares(n: np.ndarray, total: int, kept: int) -> np.ndarray:
    """1 + floor(PARTS * (n + 1) / (total + kept)); by Python's integers where 64 bits don't hold the product."""
    if len(n) and int(n.max()) >= (1 << 63) // PARTS - 1:
        return np.array([1 + PARTS * (int(x) + 1) // (total + kept) for x in n], np.int64)
    return 1 + PARTS * (n.astype(np.int64) + 1) // (total + kept)


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / q)."""
    return (p - q) * (p - q) // q


def meet(a: np.ndarray, b: np.ndarray, at_once: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Places where two sorted arrays of distinct ids meet: for each stretch of the shorter one a window of the longer
    one is doubled until it reaches far enough, then searched."""
    if len(a) > len(b):
        return meet(b, a, at_once)[::-1]
    found_a, found_b, lo = [], [], 0
    for i in range(0, len(a), at_once):
        part = a[i : i + at_once]
        step = at_once
        while lo + step < len(b) and b[lo + step] < part[-1]:
            step *= 2
        window = b[lo : lo + step + 1]
        k = np.searchsorted(window, part)
        hit = np.flatnonzero(window[np.minimum(k, len(window) - 1)] == part) if len(window) else k[:0]
        found_a.append(hit + i)
        found_b.append(k[hit] + lo)
        lo += int(k[-1])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _pair_task(key: tuple, t: pa.Table) -> pa.Table:
    """All pairs of one block of two tiles: terms of either, and their prices both ways."""
    lang, _, low, high = (k.as_py() for k in key)
    groups: dict[str, tuple] = {}
    none = np.zeros(0, np.int64)
    for source, tile, ids, n, total, kept in zip(t.column("source").to_pylist(), t.column("tile").to_pylist(), t.column("ids"), t.column("n"), t.column("group_total").to_pylist(), t.column("lang_kept").to_pylist(), strict=True):
        if kept and (ids.is_valid or source not in groups):  # a group has one row of counts at most, and one without
            ids, n = (x.values.to_numpy() if x.is_valid else none for x in (ids, n))
            groups[source] = tile, ids, shares(n, total, kept), int(shares(np.full(1, -1) + 1, total, kept)[0])
    first = [x for x in groups.items() if x[1][0] == low]
    second = [x for x in groups.items() if x[1][0] == high]
    out: list[tuple] = []
    for a, (_, ids_a, p_a, rest_a) in first:
        for b, (_, ids_b, p_b, rest_b) in second:
            if low == high and a >= b or not len(ids_a) and not len(ids_b):
                continue
            i, j = meet(ids_a, ids_b)
            alone_a, alone_b = np.delete(p_a, i), np.delete(p_b, j)
            union = len(alone_a) + len(alone_b) + len(i)
            price = lambda p, q: int(prices(p, q).sum())
            out.append((lang, a, b, union, price(p_a[i], p_b[j]) + price(alone_a, rest_b) + price(rest_a, alone_b)))
            out.append((lang, b, a, union, price(p_b[j], p_a[i]) + price(alone_b, rest_a) + price(rest_b, alone_a)))
    columns = list(zip(*out, strict=True)) if out else [[]] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "source", "item", "met", "value"])


def _best_terms(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for k in range(b.num_rows):
                row = {c: b.column(c)[k] for c in b.schema.names}
                kept = row["lang_kept"].as_py()
                p = shares(row["n"].values.to_numpy(), row["group_total"].as_py(), kept)
                q = shares(row["all"].values.to_numpy(), row["lang_total"].as_py(), kept)
                value = prices(p, q)
                at = np.flatnonzero(p > q)
                at = at[np.argsort(-value[at], kind="stable")][:most]  # terms are in order already
                out += [(row["lang"].as_py(), row["source"].as_py(), x, int(v)) for x, v in zip(row["terms"].values.take(pa.array(at)).to_pylist(), value[at], strict=True)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "source", "item", "value"])

    return run


def audit(docs: DataFrame, documents: int = 3, most: int = 200, block_text: int = BLOCK_TEXT, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): each group against the other sources of its language (part 'pair'), and
    the ``most`` terms by which it stands out from its language (part 'term')."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    size = common.size_of(docs)
    blocks, tasks_of = max(8, -(-size // block_text)), common.parts(spark, size)
    met = counts(docs).withColumn("block", F.expr(f"cast(pmod(xxhash64(term), {blocks}) as int)"))
    packed = common.saved(met.repartition(tasks_of, "lang", "block").groupBy("lang", "block").applyInArrow(_arrays(documents), _ARRAYS), "audit-arrays")

    kept = packed.groupBy("lang", "block").agg(F.max("kept").alias("kept")).groupBy("lang").agg(F.sum("kept").alias("lang_kept"))
    totals = packed.groupBy("lang", "source").agg(F.sum("total").alias("group_total"))
    langs = totals.groupBy("lang").agg(F.sum("group_total").alias("lang_total"))
    groups = docs.select("lang", "source").distinct()
    tiles = groups.groupBy("lang").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = groups.join(totals, ["lang", "source"], "left").join(tiles, "lang").join(kept, "lang", "left").join(langs, "lang", "left")
    groups = common.saved(groups.select("lang", "source", "tiles", F.expr("cast(pmod(xxhash64(source), tiles) as int)").alias("tile"), *map(zero, ("group_total", "lang_kept", "lang_total"))), "audit-groups")
    known = F.broadcast(groups) if groups.count() <= GROUPS else groups

    arrays = packed.join(known, ["lang", "source"])
    columns = ["lang", "block", "source", "tile", "tiles", "group_total", "lang_kept"]
    blank = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*columns, F.lit(None).cast("array<int>").alias("ids"), F.lit(None).cast("array<long>").alias("n"))
    tasks = arrays.select(*columns, "ids", "n").unionByName(blank).withColumn("with", F.explode(F.expr("sequence(0, tiles - 1)")))
    tasks = tasks.withColumns({"low": F.least("tile", "with"), "high": F.greatest("tile", "with")})
    merged = tasks.repartition(tasks_of, "lang", "block", "low", "high").groupBy("lang", "block", "low", "high").applyInArrow(_pair_task, "lang string, source string, item string, met long, value long")
    merged = merged.groupBy("lang", "source", "item").agg(F.sum("met").alias("met"), F.sum("value").alias("value"))
    rest = F.expr(f"1 + {PARTS} div (group_total + lang_kept)")  # the share of a term that a group doesn't have
    one = groups.select("lang", "source", "lang_kept", F.when(F.col("lang_kept") > 0, rest).alias("p"))
    two = groups.select("lang", F.col("source").alias("item"), F.when(F.col("lang_kept") > 0, rest).alias("q"))
    pairs = one.join(two, "lang").filter(F.col("source") != F.col("item")).join(merged, ["lang", "source", "item"], "left")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.expr("coalesce(value, 0) + coalesce((lang_kept - coalesce(met, 0)) * ((p - q) * (p - q) div q), 0)").alias("value"))

    terms = arrays.select("lang", "source", "n", "all", "terms", "group_total", "lang_total", "lang_kept").mapInArrow(_best_terms(most), "lang string, source string, item string, value long")
    terms = terms.select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", rank).unionByName(terms.select("*", rank).filter(F.col("rank") <= most))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of every source of every language. Nulls, ties, repeated rows, the empty table: as the module says."""
    return audit(common.table(spark, sf_dir, "documents"))
