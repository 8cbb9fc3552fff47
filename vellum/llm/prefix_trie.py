"""Trie of conversations' prefixes, by a skeleton of splitters.

A conversation is a path of turns: 20 bytes a turn, of which 16 are a hash of role and text and 4 the text's length in
code points. Paths sort as the trie's nodes do in preorder. A sample of them gives splitters (path, id) that deal all
paths to sorted shards of some 16 MB; as the id is part of the order, copies of one conversation spread over as many
shards as their number needs. A node's members stand together in this order, so a node can lie in two shards only if it
is a prefix of the splitter between them. These prefixes are the skeleton, a small trie that every task gets.

1. Each shard finishes all its other nodes: members by neighbours' common prefixes, sums over subtrees by prefix sums.
   Of a skeleton node it gives what it has of it: members, least id, children, and sums over the rest of the subtree.
2. Skeleton nodes: partial aggregates are added up; then each one's own share climbs to its ancestors and is added up
   again. Hashes of ends are taken over the shards' lists of ids, which follow one another in order.
3. Children of skeleton nodes learn their parent's id from the skeleton table.

The skeleton has at most ``SKELETON_BYTES`` of splitters: with many shards splitters are cut to fewer turns, which stays
right and only lets copies of long paths share a shard. Text never travels, only its 20 bytes; a conversation is one row,
so it can have up to 100 million turns. Turns are equal if 128 bits of SHA-256 are.

Null roles and texts count as empty, rows without id belong to no conversation, equal turn numbers are ordered by the
turns' hashes, repeated rows are repeated turns, a conversation may have no turn (in ``nodes``), an empty table has no
node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Bytes of a turn in a path.
TURN = 20
#: Bytes of paths that a shard has, about.
SHARD_BYTES = 16 << 20
#: Most bytes of all splitters' paths.
SKELETON_BYTES = 8 << 20
#: Sampled paths for each shard.
OVERSAMPLE = 12
#: Ids in one piece of a skeleton node's list of ends.
PIECE = 1 << 14

_EMPTY = hashlib.sha256(b"").hexdigest()
_OUT = [("skeleton", pa.int64()), ("piece", pa.bool_()), ("parent", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("chars", pa.int64()), ("ends", pa.string())]
_RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _ddl(fields: list[tuple[str, pa.DataType]]) -> str:
    return ", ".join(f"{n} {({'int64': 'long', 'bool': 'boolean'}).get(str(k), str(k))}" for n, k in fields)


def _hash(role: F.Column, text: F.Column) -> F.Column:
    """The 20 bytes of a turn, in hexadecimal digits."""
    said = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return F.concat(F.substring(said, 1, 32), F.lpad(F.hex(F.length(text)), 8, "0"))


def paths(rows: DataFrame) -> DataFrame:
    """(conv_id, path) of rows (conv_id, turn, role, text), ordered by turn, nulls first."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = rows.filter(F.col("conv_id").isNotNull()).select("conv_id", F.struct("turn", _hash(role, text).alias("hash")).alias("turn"))
    turns = F.transform(F.sort_array(F.collect_list("turn")), lambda t: t.hash)
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(turns, "")).alias("path"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, path): the first h turns of the conversation that heads this one's hundred, then the own turns after
    the first h; h is crc32 of the id as text, modulo 6. A head has at most 199 followers, so no key is hot."""
    lead = paths(rows.filter(F.col("conv_id") % 100 == 0)).select(F.col("conv_id").alias("head"), F.substring("path", 1, 5 * TURN).alias("lead"))
    own = paths(rows).withColumns({"head": F.expr("conv_id - conv_id % 100"), "h": F.expr(f"{TURN} * cast(crc32(cast(cast(conv_id as string) as binary)) % 6 as int)")})
    return own.join(lead, "head", "left").select("conv_id", F.expr("concat(coalesce(substring(lead, 1, h), X''), substring(path, h + 1))").alias("path"))


class Skeleton:
    """Splitters and the trie of their prefixes; node 0 is the root, parents come before children."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.parent = [-1]
        known: dict[tuple[int, bytes], int] = {}
        self.at = []  # nodes along each splitter's path
        for path, _ in splitters:
            along = [0]
            for i in range(0, len(path), TURN):
                key = along[-1], path[i : i + TURN]
                if key not in known:
                    known[key] = len(self.parent)
                    self.parent.append(along[-1])
                along.append(known[key])
            self.at.append(np.array(along, np.int64))

    def shard(self, path: bytes, conv: int) -> int:
        return bisect_right(self.splitters, (path, conv))

    def sides(self, shard: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """Path (its bytes, a row for each turn) and skeleton nodes of the splitters on both sides of a shard."""
        none = np.zeros((0, TURN), np.uint8), np.zeros(1, np.int64)
        side = lambda k: (np.frombuffer(self.splitters[k][0], np.uint8).reshape(-1, TURN), self.at[k]) if 0 <= k < len(self.splitters) else none
        return [side(shard - 1), side(shard)]


def skeleton(table: DataFrame, shard_bytes: int = SHARD_BYTES) -> Skeleton:
    """Splitters at even steps of bytes in a sample of ``table`` (conv_id, path)."""
    n, total = table.agg(F.count("*"), F.coalesce(F.sum(F.length("path") + 2 * TURN), F.lit(0))).first()
    shards = max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // shard_bytes))
    turns = max(1, SKELETON_BYTES // TURN // shards)
    sample = table.sample(min(1.0, OVERSAMPLE * shards / max(1, n)), 7).select(F.substring("path", 1, TURN * turns), "conv_id", F.length("path") + 2 * TURN)
    rows = sorted((bytes(p), c, w) for p, c, w in sample.collect())
    ends = np.cumsum([w for *_, w in rows])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, shards) / shards) if len(rows) else []
    return Skeleton(sorted({rows[i][:2] for i in at if i}))


def _common(turns: np.ndarray, start: np.ndarray, other: np.ndarray, begin: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of turns[start[i]:] and other[begin[i]:], at most most[i] turns."""
    first = np.cumsum(most) - most
    step = np.arange(int(most.sum())) - np.repeat(first, most)
    differ = np.flatnonzero((turns[np.repeat(start, most) + step] != other[np.repeat(begin, most) + step]).any(1))
    k = np.searchsorted(differ, first)
    return np.minimum(np.append(differ, len(step))[k] - first, most) if len(differ) else most


def _finish(conv: np.ndarray, turns: np.ndarray, size: np.ndarray, sides: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Nodes, shares of skeleton nodes and their pieces of ends, of one shard: paths in order, a row of ``turns`` each turn."""
    n = len(conv)
    keys = np.ascontiguousarray(turns).view(">u4").astype(np.uint32).reshape(len(turns), TURN // 4)
    begin = np.cumsum(size) - size
    shared = np.full(n, -1)
    shared[1:] = _common(keys, begin[1:], keys, begin[:-1], np.minimum(size[1:], size[:-1]))
    new = size - shared
    base = np.append(np.cumsum(new) - new, new.sum())
    row = np.repeat(np.arange(n), new)
    depth = np.arange(base[-1]) - np.repeat(base[:-1], new) + np.repeat(shared + 1, new)
    parent, end = np.arange(base[-1]) - 1, np.full(base[-1], n)
    open_: list[list[int]] = []  # runs of nodes on the path: least and greatest depth, first node
    for j, (keep, deep, first) in enumerate(zip(shared.tolist(), size.tolist(), base.tolist(), strict=False)):
        while open_ and open_[-1][1] > keep:
            low, high, node = open_[-1]
            end[node + max(0, keep + 1 - low) : node + high - low + 1] = j
            if low > keep:
                open_.pop()
            else:
                open_[-1][1] = keep
        if deep > keep:
            if open_:
                parent[first] = open_[-1][2] + keep - open_[-1][0]
            open_.append([keep + 1, deep, first])
    mark = np.full(base[-1], -1)
    for other, ids in sides:
        other = np.ascontiguousarray(other).view(">u4").astype(np.uint32).reshape(-1, TURN // 4)
        along = _common(keys, begin, other, np.zeros(n, np.int64), np.minimum(size, len(other)))[row]
        mark = np.where(depth <= along, ids[np.minimum(depth, len(ids) - 1)], mark)
    own = mark < 0
    members = end - row
    least = np.minimum.reduceat(np.append(conv, np.iinfo(np.int64).max), np.stack([row, end], 1).ravel())[::2]
    chars = np.where(depth > 0, keys[np.maximum(begin[row] + depth - 1, 0), -1] if len(keys) else 0, 0).astype(np.int64)
    children = np.bincount(parent[1:][own[1:]], minlength=len(parent))
    below = lambda x: (s := np.append(0, np.cumsum(np.where(own, x, 0))))[base[end]] - s[np.arange(len(x))]
    leaves, saved = below((children == 0).astype(np.int64)), below((members - 1) * chars)
    ends = np.full(len(parent), _EMPTY, object)
    pieces: list[tuple[int, int, str]] = []
    last = np.flatnonzero(new > 0)
    for i, j in zip(last.tolist(), np.append(last[1:], n).tolist(), strict=True):
        node = base[i + 1] - 1
        if depth[node] < size[i]:
            continue
        if own[node]:
            ends[node] = hashlib.sha256(",".join(map(str, conv[i:j].tolist())).encode()).hexdigest()
        else:
            pieces += [(int(mark[node]), int(conv[k]), ",".join(map(str, conv[k : min(k + PIECE, j)].tolist()))) for k in range(i, j, PIECE)]
    above = np.where(parent >= 0, parent, 0)
    for i in range(0, len(parent), 1 << 16):
        x = slice(i, i + (1 << 16))
        top = own[x] & own[above[x]]
        yield _batch([mark[x], np.zeros(len(mark[x]), bool), np.where(own[x] & ~top, mark[above[x]], -1), depth[x], least[x], pa.array(least[above[x]], mask=~top), members[x], children[x], leaves[x], saved[x], chars[x], ends[x].tolist()])
    if pieces:
        node, first, ids = zip(*pieces, strict=True)
        yield _batch([node, [True] * len(node), None, None, first, None, None, None, None, None, None, ids])


def _batch(columns: list) -> pa.RecordBatch:
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.nulls(n, k) if c is None else pa.array(c, k) for c, (_, k) in zip(columns, _OUT, strict=True)], [name for name, _ in _OUT])


def nodes(table: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """All nodes of the trie of ``table`` (conv_id, path), one row each: ``_RESULT``; (conv_id, depth) names a node, as
    its path is the first ``depth`` turns of its least member. ``table`` is read several times: give a written one."""
    spark = table.sparkSession
    frame = skeleton(table, shard_bytes)
    shared = spark.sparkContext.broadcast(frame)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard = [shared.value.shard(p, c) for p, c in zip(b.column("path").to_pylist(), b.column("conv_id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *b.columns], ["shard", "conv_id", "path"])

    def finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held)
            held.clear()
            data, ends = common.raw(t.column("path").combine_chunks())
            yield from _finish(t.column("conv_id").to_numpy(), data.reshape(-1, TURN), np.diff(ends) // TURN, shared.value.sides(t.column("shard")[0].as_py()))

        for b in batches:
            shard = b.column("shard").to_numpy()
            for x in np.split(np.arange(len(shard)), np.flatnonzero(np.diff(shard)) + 1):
                if len(x):
                    if held and held[-1].column("shard")[0].as_py() != shard[x[0]]:
                        yield from done()
                    held.append(b.slice(int(x[0]), len(x)))
        if held:
            yield from done()

    def climbed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = np.array(shared.value.parent)
        kids = np.bincount(up[1:], minlength=len(up))
        leaves, saved = np.zeros((2, len(up)), np.int64)
        for b in batches:
            node, members, children, chars = (b.column(c).to_numpy() for c in ("skeleton", "n_convs", "n_children", "chars"))
            own = (children + kids[node] == 0).astype(np.int64), (members - 1) * chars
            while len(node):
                np.add.at(leaves, node, own[0])
                np.add.at(saved, node, own[1])
                go = up[node] >= 0
                node, own = up[node][go], (own[0][go], own[1][go])
        at = np.flatnonzero((leaves > 0) | (saved > 0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(leaves[at]), pa.array(saved[at])], ["skeleton", "more_leaves", "more_saved"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up = np.array(shared.value.parent)
        kids = np.bincount(up[1:], minlength=len(up))
        for b in batches:
            node = b.column("skeleton").to_numpy()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(up[node]), pa.array(kids[node])], [*b.schema.names, "above", "kids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, out = None, None, []
        for b in batches:
            for node, ids in zip(b.column("skeleton").to_pylist(), b.column("ends").to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        out.append((now, state.hexdigest()))
                    now, state = node, hashlib.sha256(ids.encode())
                else:
                    state.update(f",{ids}".encode())
        if now is not None:
            out.append((now, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out])], ["skeleton", "ends_sha256"])

    shards = table.select("conv_id", "path").mapInArrow(dealt, "shard long, conv_id long, path binary")
    shards = shards.repartition(len(frame.splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    out = common.saved(shards.mapInArrow(finished, _ddl(_OUT)), "trie-nodes")

    part = out.filter((F.col("skeleton") >= 0) & ~F.col("piece"))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    part = part.groupBy("skeleton").agg(F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("chars").alias("chars"), *sums)
    more = part.select("skeleton", "n_convs", "n_children", "chars").mapInArrow(climbed, "skeleton long, more_leaves long, more_saved long")
    more = more.groupBy("skeleton").agg(F.sum("more_leaves").alias("more_leaves"), F.sum("more_saved").alias("more_saved"))
    ends = out.filter("piece").select("skeleton", "conv_id", "ends").repartition("skeleton").sortWithinPartitions("skeleton", "conv_id").mapInArrow(hashed, "skeleton long, ends_sha256 string")
    kept = part.mapInArrow(placed, f"{part.schema.simpleString()[7:-1].replace(':', ' ')}, above long, kids long")
    kept = kept.join(more, "skeleton", "left").join(ends, "skeleton", "left").select(
        "skeleton", F.col("above").alias("parent"), "depth", "conv_id", "n_convs", (F.col("n_children") + F.col("kids")).alias("n_children"),
        (F.col("n_leaves") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256"),
    )
    kept = common.saved(kept, "trie-skeleton")
    # at most SKELETON_BYTES / TURN + 1 rows of two numbers
    least = F.broadcast(kept.select(F.col("skeleton").alias("parent"), F.col("conv_id").alias("least")))
    own = out.filter(F.col("skeleton") < 0).withColumnRenamed("ends", "ends_sha256").join(least, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "least"))
    top = kept.join(least, "parent", "left").withColumn("parent_conv_id", F.col("least"))
    return own.select(_RESULT).unionByName(top.select(_RESULT))


def with_turns(trie: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes of conversations as they are in ``rows``, with role and text of each node's last turn; the root has none."""
    turns = rows.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("hash", _hash(F.col("role"), F.col("text")))
    turns = turns.withColumn("depth", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "hash")).cast("long")).select("conv_id", "depth", "role", "text")
    return trie.join(turns, ["conv_id", "depth"], "left")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of rebuilt conversations. Nulls, ties, repeated rows and the empty table: as the module says."""
    table = common.saved(rebuilt(common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")), "trie-paths")
    out = nodes(table)
    common.drop_saved(table)
    return out
