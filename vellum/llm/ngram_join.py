"""N-gram Jaccard join by parity sketches.

A text's set holds the hashes of its distinct word n-grams. Of two sets with Jaccard similarity >= t the symmetric
difference has at most D = (1 - t) / (1 + t) * (|A| + |B|) elements. A parity sketch deals tokens into bits by hash and
keeps each bit's parity, so two sketches differ in at most as many bits as the symmetric difference has elements.

1. Texts with equal sets are one node (a 128-bit hash of the set).
2. Sizes fall into bands; a band's sketch is cut into K = D + 1 + s blocks. At most D of them differ, so linked sets
   share at least 1 + s whole blocks. A block travels as one 64-bit hash of its bits. A text with at most s empty
   blocks doesn't send them, and still shares a block with each partner. A text near a band's upper end is also sent
   to the next band.
3. Nodes that share a block join the cluster of the least node of that block's bucket. So a bucket of m nodes yields
   m - 1 rows, and each linked pair meets in a cluster. A task sends the blocks of a set once, however many copies it
   has.
4. First each member is compared with its cluster's centre only, which is linear in the members. The links found so
   far make components. A cluster whose members are all in one component is done: that is what a group of near copies,
   however large, mostly comes to. In the others the members of the most frequent component needn't be compared with
   one another; the rest is compared with all. Both sides are cut into chunks of a fixed size, and each pair of chunks
   is a group of its own.
5. Groups get small parity sketches first. Pairs with fitting sizes whose sketches differ in at most D bits are
   candidates; only members of candidates send their full sets to the group, and there pairs are verified. A group
   gives a spanning forest of its links.
6. Components of all these links.

No pair is lost, no bucket capped. Null and empty texts: an empty set, linked with nothing. Fewer words than n: one
shingle of the whole sequence. Repeated rows: one node. Rows with a null id link like others; a component's id is the
least id that isn't null, if there is one. Empty table: no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import mix
from .graph import components

_lower = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_space = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])
U64 = np.uint64


def shingles(data: np.ndarray, offsets: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of each text's word n-grams, one text after another, and offsets."""
    docs = len(offsets) - 1
    text = _lower[data]
    gap = _space[text]
    edge = np.zeros(len(text) + 1, bool)
    edge[offsets] = True
    word = ~gap
    before = np.concatenate([[True], gap[:-1]]) | edge[:-1]
    after = np.concatenate([gap[1:], [True]]) | edge[1:]
    start, end = np.flatnonzero(word & before), np.flatnonzero(word & after) + 1
    if not len(start):
        return np.zeros(0, U64), np.zeros(docs + 1, np.int64)
    h = common.Rolling(text).of(start, end)
    doc = np.searchsorted(offsets, start, "right") - 1
    words = np.bincount(doc, minlength=docs)
    salt = U64((seed * 0x632BE59BD9B4E019 + 0x8CB92BA72F3D8DD7) & (1 << 64) - 1)
    factor = mix(np.arange(1, n + 1, dtype=U64) + salt) | U64(1)
    full = len(h) - n + 1
    keys, owner = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    if full > 0:
        whole = doc[n - 1 :] == doc[:full]
        x = h[:full] * factor[0]
        for k in range(1, n):
            x += h[k : k + full] * factor[k]
        keys.append(mix(x[whole]))
        owner.append(doc[:full][whole])
    few = np.flatnonzero((words > 0) & (words < n))
    if len(few):
        first = (np.cumsum(words) - words)[few]
        x = words[few].astype(U64) * U64(0xD6E8FEB86659FD93)
        for k in range(n - 1):
            there = words[few] > k
            x[there] += h[first[there] + k] * factor[k]
        keys.append(mix(x ^ salt))
        owner.append(few)
    key, owner = np.concatenate(keys), np.concatenate(owner)
    sizes = np.bincount(owner, minlength=docs)
    if len(few):
        key = key[np.argsort(owner, kind="stable")]
    out, at = [], 0
    for m in sizes.tolist():
        out.append(np.unique(key[at : at + m]) if m > 1 else key[at : at + m])
        at += m
    return np.concatenate(out) if out else key, np.concatenate([[0], np.cumsum(list(map(len, out)))]).astype(np.int64)


def set_keys(sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for empty ones."""
    out = []
    for salt in (0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(sets ^ U64(salt)))])
        out.append(mix(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(U64)) * (np.diff(offsets) > 0).astype(U64))
    return out[0], out[1]


class Bands:
    """Size bands for one threshold, num / 100."""

    RATIO = 1.4

    def __init__(self, num: int):
        self.num = num
        b = [1]
        while b[-1] < 1 << 40:
            b.append(max(b[-1] + 1, int(b[-1] * max(self.RATIO, 101 / num))))
        self.bounds = np.array(b, np.int64)
        top = self.bounds[1:] - 1
        self.diff = self.most(top, top)
        # slack for half as many empty blocks again as the band's smallest sets have on average
        least, slack = np.maximum(1, self.bounds[:-1] * num // 100), np.ones(len(top))
        for _ in range(30):
            blocks = self.diff + 1 + slack
            slack = np.clip(1.5 * blocks * np.exp(-least / blocks), 1, self.diff + 1)
        self.slack = np.where(self.diff > 0, np.ceil(slack), 0).astype(np.int64)
        self.blocks = self.diff + 1 + self.slack

    def most(self, a, b):
        """Elements of the symmetric difference that linked sets of these sizes have at most."""
        return (100 - self.num) * (a + b) // (100 + self.num)

    def signatures(self, sets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash of a block, number of the text) for all blocks that texts send."""
        n = np.diff(offsets)
        own = np.searchsorted(self.bounds, n, "right") - 1
        # equal sets are one node already; a set alone in its reach sends nothing
        reach = self.most(n, n * 100 // self.num) > 0
        up = reach & (n * 100 // self.num >= self.bounds[own + 1])
        who = np.concatenate([np.flatnonzero(reach), np.flatnonzero(up)])
        band = np.concatenate([own[reach], own[up] + 1])
        if not len(who):
            return np.zeros(0, U64), np.zeros(0, np.int64)
        size = n[who]
        h = common_gather(sets, offsets[who], size)
        unit = np.repeat(np.arange(len(who)), size)
        k = self.blocks[band]
        h = mix(h ^ U64(0x5851F42D4C957F2D))
        first = np.cumsum(k) - k
        block = ((h >> U64(32)) * k[unit].astype(U64)) >> U64(32)
        place = first[unit] + block.astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, h = place[order], mix(h[order])
        starts = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        content, place = np.bitwise_xor.reduceat(h, starts), place[starts]
        unit = np.searchsorted(first, place, "right") - 1
        empty = k - np.bincount(unit, minlength=len(who))
        many = np.flatnonzero(empty > self.slack[band])
        if len(many):
            every = np.concatenate([np.arange(first[i], first[i] + k[i]) for i in many])
            none = np.setdiff1d(every, place)
            content, place = np.concatenate([content, np.zeros(len(none), U64)]), np.concatenate([place, none])
            unit = np.searchsorted(first, place, "right") - 1
        salt = mix((band[unit].astype(U64) << U64(40)) + (place - first[unit]).astype(U64) + U64(1))
        return mix(content ^ salt), who[unit]


def common_gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    before = np.cumsum(count) - count
    return flat[np.repeat(start - before, count) + np.arange(int(count.sum()))]


def sketches(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """Parity sketches (rows of 64-bit words)."""
    out = np.zeros((len(sets), bits // 8), np.uint8)
    for i, s in enumerate(sets):
        odd = np.bincount((mix(s) >> U64(17)).astype(np.int64) % bits, minlength=bits) & 1
        out[i] = np.packbits(odd.astype(np.uint8))
    return out.view(U64)


def sketch_bits(most_apart: int) -> int:
    """Bits that tell sets with a difference of at most ``most_apart`` from unrelated ones."""
    return min(1 << 16, max(512, 1 << int(4 * most_apart).bit_length()))


def folded(sketch: np.ndarray, words: int) -> np.ndarray:
    """A sketch (last axis) of fewer words: the parities of what falls together."""
    while sketch.shape[-1] > words:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def candidates(size: np.ndarray, sketch: list[np.ndarray], side: np.ndarray, cross: bool, bands: Bands) -> np.ndarray:
    """Which members of a group have a partner that their sketches don't rule out."""
    order = np.argsort(size, kind="stable")
    size, side = size[order], side[order]
    words = np.array([len(sketch[i]) for i in order])
    hit = np.zeros(len(size), bool)
    for w in np.unique(words):
        rows = np.flatnonzero(words >= w)  # larger sets have sketches at least as long
        table = np.stack([folded(sketch[order[i]], int(w)) for i in rows])
        for k, i in enumerate(rows.tolist()):
            if words[i] != w:
                continue
            stop = int(np.searchsorted(size[rows], size[i] * 100 // bands.num, "right"))
            near = np.arange(k + 1, stop)
            if cross:
                near = near[side[rows[near]] != side[i]]
            if not len(near):
                continue
            apart = np.bitwise_count(table[near] ^ table[k]).sum(1)
            near = near[apart <= bands.most(size[rows[near]], size[i])]
            if len(near):
                hit[i] = True
                hit[rows[near]] = True
    out = np.zeros(len(size), bool)
    out[order] = hit
    return out


def links_within(ids: list[int], sets: list[np.ndarray], side: list[int], cross: bool, bands: Bands) -> list[tuple[int, int]]:
    """A spanning forest of the links of a group; ``cross``: only between members of different sides."""
    m = len(ids)
    size = np.array([len(s) for s in sets])
    if m > 2:
        order = np.argsort(size, kind="stable")
        ids, sets, size, side = [ids[i] for i in order], [sets[i] for i in order], size[order], [side[i] for i in order]
        bits = int(min(1 << 16, max(512, 1 << int(4 * size.max() - 1).bit_length())))
        sketch = sketches(sets, bits)
    root, out = np.arange(m), []
    sides = np.array(side)
    for i in range(m - 1):
        stop = int(np.searchsorted(size, size[i] * 100 // bands.num, "right")) if m > 2 else m
        if stop <= i + 1:
            continue
        near = np.arange(i + 1, stop)
        near = near[root[near] != root[i]]
        if cross:
            near = near[sides[near] != sides[i]]
        if m > 2 and len(near):
            apart = np.bitwise_count(sketch[near] ^ sketch[i]).sum(1)
            near = near[apart <= bands.most(size[near], size[i])]
        for j in near.tolist():
            if root[i] == root[j]:
                continue
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if 100 * both >= bands.num * (len(sets[i]) + len(sets[j]) - both):
                root[root == root[j]] = root[i]
                out.append((ids[i], ids[j]))
    return out


def _sets_of(b: pa.RecordBatch, text_col: str, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    common.kept("ngram_join")
    data, offsets = common.raw(b.column(text_col))
    return shingles(data, offsets, n, seed)


def nodes(docs: DataFrame, id_col: str, text_col: str, n: int, seed: int) -> DataFrame:
    """Per row: id, size and two hashes of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, text_col):
            sets, offsets = _sets_of(b, text_col, n, seed)
            a, c = set_keys(sets, offsets)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(np.diff(offsets)), pa.array(a.view(np.int64)), pa.array(c.view(np.int64))], [id_col, "n_shingles", "node", "check"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} long, n_shingles long, node long, check long")


def buckets(docs: DataFrame, id_col: str, text_col: str, n: int, seed: int, bands: Bands, parts: int) -> DataFrame:
    """(centre, node): the least node of each block's bucket with each other one."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # nodes of this task; a partition holds one split of the input
        for b in common.blocks(batches, text_col):
            sets, offsets = _sets_of(b, text_col, n, seed)
            key, _ = set_keys(sets, offsets)
            first = np.zeros(len(key), bool)
            for i, k in enumerate(key.tolist()):
                if k not in sent:
                    sent.add(k)
                    first[i] = True
            own = np.flatnonzero(first)
            size = np.diff(offsets)[own]
            sets, offsets, key = common_gather(sets, offsets[own], size), np.concatenate([[0], np.cumsum(size)]).astype(np.int64), key[own]
            sig, who = bands.signatures(sets, offsets)
            part = (((sig >> U64(32)) * U64(parts)) >> U64(32)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            sig, node, part = sig[order], key[who[order]], part[order]
            at = np.searchsorted(part, np.arange(parts + 1))
            used = np.flatnonzero(np.diff(at))
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array([sig[at[p] : at[p + 1]].tobytes() for p in used], pa.binary()), pa.array([node[at[p] : at[p + 1]].tobytes() for p in used], pa.binary())],
                ["part", "sig", "node"],
            )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sig, node = [], []
        for b in batches:
            sig.append(np.frombuffer(b"".join(b.column("sig").to_pylist()), U64))
            node.append(np.frombuffer(b"".join(b.column("node").to_pylist()), np.int64))
        if not sig:
            return
        s, x = np.concatenate(sig), np.concatenate(node)
        del sig, node
        order = np.argsort(s, kind="stable")
        s, x = s[order], x[order]
        twin = s[1:] == s[:-1]
        keep = np.concatenate([[False], twin]) | np.concatenate([twin, [False]])
        s, x = s[keep], x[keep]
        if not len(s):
            return
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        least = np.repeat(np.minimum.reduceat(x, starts), np.diff(np.append(starts, len(s))))
        pair = np.stack([least, x], 1)[least != x]
        pair = np.unique(pair, axis=0)
        for i in range(0, len(pair), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pair[i : i + 100_000, k].copy()) for k in (0, 1)], ["centre", "node"])

    sent = docs.select(id_col, text_col).mapInArrow(send, "part int, sig binary, node binary")
    return sent.repartitionById(parts, F.col("part")).mapInArrow(meet, "centre long, node long").distinct()


#: Tasks that the members of one large cluster are dealt to.
SALTS = 256


def dealt(stars: DataFrame, large: DataFrame, *also: str) -> DataFrame:
    """Members (structs of node and columns ``also``) of ``stars`` by (centre, salt), with what is known of large clusters.
    The members of a centre are dealt to SALTS keys, so no task owns a cluster, and travel as arrays; ``large`` must be
    clusters of at least SALTS members, so that their copies are no more than the stars. The copies are never broadcast:
    Spark takes them for as small as what they are copies of."""
    salts = F.array(*map(F.lit, range(SALTS)))
    salt = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(SALTS)).cast("int").alias("salt")
    packed = stars.groupBy("centre", salt).agg(F.collect_list(F.struct("node", *also)).alias("members"))
    return packed.join(large.withColumn("salt", F.explode(salts)).hint("merge"), ["centre", "salt"], "left").drop("salt")


def chunked(n: F.Column, chunk: int) -> F.Column:
    return F.ceil(n / chunk).cast("int")


def star_groups(stars: DataFrame, chunk: int) -> DataFrame:
    """(node, centre, a, b, side): each chunk of a cluster with its centre; sides are the centre and the members."""
    large = stars.groupBy("centre").agg(F.count("*").alias("m")).filter(F.col("m") > max(chunk, SALTS)).select("centre", chunked(F.col("m"), chunk).alias("chunks"))
    members = dealt(stars, large).select("centre", "chunks", F.explode("members.node").alias("node"))
    members = members.select("node", "centre", F.pmod(F.xxhash64("node", F.lit(2)), F.coalesce("chunks", F.lit(1))).cast("int").alias("a"))
    centres = members.select("centre", "a").distinct().select(F.col("centre").alias("node"), "centre", "a", F.lit(-1).alias("b"), F.lit(0).alias("side"))
    return members.select("node", "centre", "a", F.lit(-1).alias("b"), F.lit(1).alias("side")).unionByName(centres)


def rest_groups(stars: DataFrame, roots: DataFrame, chunk: int) -> DataFrame:
    """(node, centre, a, b, side): pairs of chunks of what is left to compare, given components (node, root).

    Chunks of the members outside a cluster's most frequent component come first, then those of that component; pairs
    of two of the latter are left out, and so are clusters of one component."""
    members = stars.unionByName(stars.select("centre", F.col("centre").alias("node")).distinct())
    members = members.join(roots, "node", "left").select("node", "centre", F.coalesce("root", "node").alias("root"))
    of = members.groupBy("centre", "root").agg(F.count("*").alias("m"))
    clusters = of.groupBy("centre").agg(F.sum("m").alias("all"), F.max(F.struct("m", "root")).alias("main")).filter(F.col("all") > F.col("main.m"))
    clusters = clusters.select("centre", F.col("main.root").alias("main"), chunked(F.col("all") - F.col("main.m"), chunk).alias("others"), chunked(F.col("main.m"), chunk).alias("mains"), (F.col("all") > SALTS).alias("large"))
    either = dealt(members, clusters.filter("large").drop("large"), "root")
    placed = either.filter("others is not null").unionByName(either.filter("others is null").select("centre", "members").join(clusters.filter("not large").drop("large"), "centre"))
    placed = placed.select("centre", "main", "others", "mains", F.explode("members").alias("x")).select("x.node", "x.root", "centre", "main", "others", "mains")
    is_main, h = F.col("root") == F.col("main"), F.xxhash64("node", F.lit(2))
    side = F.when(is_main, F.col("others") + F.pmod(h, F.col("mains"))).otherwise(F.pmod(h, F.col("others"))).cast("int")
    placed = placed.withColumn("side", side)
    last = F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1
    each = F.transform(F.sequence(F.lit(0), last), lambda v: F.struct(F.least(v, "side").alias("a"), F.greatest(v, "side").alias("b")))
    return placed.select("node", "centre", "side", F.explode(each).alias("g")).select("node", "centre", "g.a", "g.b", "side")


PLACED = "centre long, a int, b int, side int, node long, size int, data binary"


def _placed(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in PLACED.split(", ")])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], dict[int, tuple[int, int, bytes]]]]:
    """(centre, a, b) and the members' (side, size, data) of each group, of sorted rows."""
    held: dict[int, tuple[int, int, bytes]] = {}
    now = None
    for b in batches:
        for *key, side, node, size, data in zip(*(b.column(f.split()[0]).to_pylist() for f in PLACED.split(", ")), strict=True):
            if key != now:
                if now:
                    yield now, held
                now, held = key, {}
            held[node] = (side, size, data)
    if now:
        yield now, held


def linked(docs: DataFrame, n: int = 5, num: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk: int = 512) -> DataFrame:
    """(id, n_shingles, component_id) per row: rows whose sets reach each other by links (similarity >= num / 100)."""
    spark = docs.sparkSession
    bands = Bands(num)
    docs = docs.select(id_col, text_col)
    seed = 0
    while True:
        rows = common.saved(nodes(docs, id_col, text_col, n, seed), "shingle-sets")
        own = rows.filter("n_shingles > 0").groupBy("node").agg(F.min(id_col).alias("least"), F.min("check").alias("c1"), F.max("check").alias("c2"))
        if own.filter("c1 <> c2").isEmpty():
            break
        seed += 1  # two different sets with one node: other hashes
        common.drop_saved(rows)
    own = own.select("node", "least")
    # some 24 bytes for each block of a set, of which there are about as many as shingles
    parts = common.parts(spark, 24 * (rows.agg(F.sum("n_shingles")).first()[0] or 0))
    stars = common.saved(buckets(docs, id_col, text_col, n, seed, bands, parts), "shingle-stars")
    at = ["centre", "a", "b", "side"]
    gathered = lambda rows: rows.groupBy("node").agg(F.collect_list(F.struct(*at)).alias("groups"))
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, text_col):
            key, _ = set_keys(*_sets_of(b, text_col, n, seed))
            yield pa.RecordBatch.from_arrays([b.column(text_col), pa.array(key.view(np.int64))], [text_col, "node"])

    # sets that only rows without an id have are found by their node
    nameless = docs.filter(F.col(id_col).isNull()).select(text_col).mapInArrow(keyed, f"`{text_col}` string, node long").dropDuplicates(["node"])

    def texts(rows: DataFrame) -> DataFrame:
        """One text of each node that has company."""
        asked = own.join(gathered(rows), "node").select(F.col("least").alias(id_col), "node", "groups")
        named = docs.join(asked.filter(F.col(id_col).isNotNull()), id_col).select(text_col, "node", "groups")
        return named.unionByName(nameless.join(asked.filter(F.col(id_col).isNull()), "node").select(text_col, "node", "groups"))

    def place(whole: bool):
        """Kernel: a row for each group of a node, with its set or with its sketch."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in common.blocks(batches, text_col):
                sets, offsets = _sets_of(b, text_col, n, seed)
                key, _ = set_keys(sets, offsets)
                real = np.flatnonzero(key.view(np.int64) == b.column("node").to_numpy())  # not another text of the same id
                out: list[tuple] = []
                held = 0
                for i in real.tolist():
                    own_set, node = sets[offsets[i] : offsets[i + 1]], int(key.view(np.int64)[i])
                    data = own_set.tobytes() if whole else sketches([own_set], sketch_bits(int(bands.most(len(own_set), len(own_set)))))[0].tobytes()
                    for g in b.column("groups")[i].as_py():
                        out.append((g["centre"], g["a"], g["b"], g["side"], node, len(own_set), data))
                        held += len(data) + 64
                        if held > common.BLOCK_BYTES:
                            yield _placed(out)
                            out, held = [], 0
                if out:
                    yield _placed(out)

        return run

    def meet(rows: DataFrame, whole: bool) -> DataFrame:
        return texts(rows).mapInArrow(place(whole), PLACED).repartition("centre", "a", "b").sortWithinPartitions("centre", "a", "b")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, held in _groups(batches):
            if len(held) < 2:
                continue
            ids = list(held)
            keep = candidates(np.array([held[i][1] for i in ids]), [np.frombuffer(held[i][2], U64) for i in ids], np.array([held[i][0] for i in ids]), key[1] != key[2], bands)
            left = [i for i, k in zip(ids, keep.tolist(), strict=True) if k]
            if left:
                m = len(left)
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array([key[0]] * m, pa.int64()), *(pa.array(x, pa.int32()) for x in ([key[1]] * m, [key[2]] * m, [held[i][0] for i in left]))], ["node", *at])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for key, held in _groups(batches):
            if len(held) > 1:
                ids = list(held)
                out += links_within(ids, [np.frombuffer(held[i][2], U64) for i in ids], [held[i][0] for i in ids], key[1] != key[2], bands)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["u", "v"])

    def links(placed: DataFrame) -> DataFrame:
        left = common.saved(meet(placed, whole=False).mapInArrow(sift, "node long, centre long, a int, b int, side int"), "shingle-candidates")
        common.forget(spark)
        edges = common.saved(meet(left, whole=True).mapInArrow(compare, "u long, v long"), "shingle-links")
        common.drop_saved(left)
        common.forget(spark)
        return edges

    first = links(star_groups(stars, chunk))
    known = common.saved(components(first), "shingle-roots")
    rest = links(rest_groups(stars, known, chunk))
    common.drop_saved(stars)
    now = lambda end: known.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
    moved = rest.join(now("u"), "u", "left").join(now("v"), "v", "left").select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v"))
    later = components(moved).select(F.col("node").alias("root"), F.col("root").alias("__later"))
    # nodes that only the second round has linked stand for themselves after the first
    roots = known.unionByName(later.select(F.col("root").alias("node"), "root").join(known.select("node"), "node", "left_anti"))
    roots = roots.join(later, "root", "left").select("node", F.coalesce("__later", "root").alias("root"))
    named = own.join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    named = common.saved(named, "shingle-roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "root").select("node", "component_id")
    for t in (first, rest, known):
        common.drop_saved(t)
    out = rows.join(named, "node", "left").select(id_col, "n_shingles", F.coalesce("component_id", id_col).alias("component_id"))
    common.forget(spark)
    return out


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked documents at 85 % of four-word shingles. Null and wordless texts link with nothing; short ones are one
    shingle; texts of any length are compared whole; a component's id is its least doc_id, so ties don't arise; repeated
    rows give repeated rows; an empty table gives no row; only doc_id and text are read."""
    return linked(common.table(spark, sf_dir, "documents"), n=4, num=85)
