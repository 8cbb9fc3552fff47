"""Near-duplicate vectors by a robust-pruned flat graph.

Equal vectors of a label are one node. The nodes of a label are dealt to the shards of their nearest centroids, two at
least, so shards overlap; a shard too large for one task is cut into chunks, and each pair of chunks is a group. Each
group builds a flat graph: near neighbours, robust-pruned, so that edges also point away from a dense spot. A node's
adjacency lists of all its groups are united and go back to the groups. There a greedy search with a beam runs from
the group's medoid for every node, and once it is in range it expands all nodes in range through their neighbours
until no new one turns up. Each pair found is verified by its cosine in double precision. A pair that shares several
shards counts in the first of them. Groups return counts of links and a spanning forest, never all pairs.

``audit`` holds the counts of a bounded sample of nodes against brute force over all rows.

Vectors that are null, zero, or hold null or non-finite numbers, and rows without a label: no links. Vectors of
different lengths link with nothing of another length. Repeated rows: links of each other. Empty table: no rows.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .graph import components


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def flat_graph(x: np.ndarray, degree: int, width: int, alpha: float = 1.2) -> np.ndarray:
    """Robust-pruned neighbours (rows of ``degree`` places, -1 where there is none) among unit rows."""
    n = len(x)
    width = min(width, n - 1)
    if width <= 0:
        return np.full((n, degree), -1)
    s = (x @ x.T).astype(np.float32)
    np.fill_diagonal(s, -2)
    near = np.argpartition(-s, width - 1, axis=1)[:, :width]
    row = np.arange(n)[:, None]
    near = near[row, np.argsort(-s[row, near], axis=1, kind="stable")]
    apart = 1 - s[row, near]
    alive = np.ones(near.shape, bool)
    out = np.full((n, degree), -1)
    for r in range(degree):
        first = alive.argmax(1)
        there = alive.any(1)
        if not there.any():
            break
        chosen = near[row[:, 0], first]
        out[:, r] = np.where(there, chosen, -1)
        alive[row[:, 0], first] = False
        # what is nearer to the chosen one than to the node, by the factor alpha, is reached through it
        alive &= alpha * (1 - s[chosen[:, None], near]) > apart
    return out


def dots(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows a and b, in slices."""
    out = np.empty(len(a))
    for i in range(0, len(a), 50_000):
        out[i : i + 50_000] = np.einsum("ij,ij->i", x[a[i : i + 50_000]], x[b[i : i + 50_000]])
    return out


def range_search(x: np.ndarray, out_lists: list[list[int]], least: float, beam: int = 12, steps: int = 100, degree: int = 32) -> np.ndarray:
    """Which rows each row's search finds in range (n x n, without the diagonal). ``out_lists``: neighbours of each
    row; the greedy search follows the first ``degree`` of them, the expansion in range all, in both directions."""
    n = len(x)
    found = np.zeros((n, n), bool)
    links = np.zeros((n, n), bool)
    degree = min(degree, max(map(len, out_lists), default=0))
    if not degree:
        return found
    adj = np.full((n, degree), -1)
    for i, near in enumerate(out_lists):
        links[i, near] = True
        adj[i, : min(degree, len(near))] = near[:degree]
    links |= links.T
    np.fill_diagonal(links, False)
    medoid = int((x @ x.mean(0)).argmax())
    q = np.arange(n)
    ids = np.full((n, beam), -1)
    sim = np.full((n, beam), -9.0)
    open_ = np.zeros((n, beam), bool)
    ids[:, 0], sim[:, 0], open_[:, 0] = medoid, x @ x[medoid], True
    for _ in range(steps):
        at = np.where(open_, sim, -9).argmax(1)
        going = open_[q, at]
        if not going.any():
            break
        who = q[going]
        open_[who, at[going]] = False
        new = adj[ids[who, at[going]]]
        cos = np.where(new >= 0, np.einsum("ijk,ik->ij", x[new], x[who]), -9.0)
        cos[(new[:, :, None] == ids[who][:, None, :]).any(2)] = -9.0
        all_ids, all_sim = np.concatenate([ids[who], new], 1), np.concatenate([sim[who], cos], 1)
        all_open = np.concatenate([open_[who], cos > -9], 1)
        best = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
        pick = np.arange(len(who))[:, None]
        ids[who], sim[who], open_[who] = all_ids[pick, best], all_sim[pick, best], all_open[pick, best]
    hit = (sim >= least) & (ids >= 0)
    found[np.repeat(q, hit.sum(1)), ids[hit]] = True
    # a node is in its own range; its neighbours and those of all in range are tried
    tried = found | np.eye(n, dtype=bool)
    front = tried.copy()
    reach = links.astype(np.float32)
    while front.any():
        rows = np.flatnonzero(front.any(1))
        more = (front[rows].astype(np.float32) @ reach > 0) & ~tried[rows]
        a, b = np.nonzero(more)
        a = rows[a]
        tried[a, b] = True
        ok = dots(x, a, b) >= least
        front = np.zeros((n, n), bool)
        front[a[ok], b[ok]] = True
        found |= front
    np.fill_diagonal(found, False)
    return found | found.T


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows sorted by (kind, shard, a, b), one at a time."""
    now, held = None, []
    for b in batches:
        cols = [b.column(c) for c in ("kind", "shard", "a", "b")]
        keys = list(zip(*(c.to_pylist() for c in cols), strict=True))
        start = 0
        for i in range(len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                if i > start:
                    if now != keys[start] and held:
                        yield now, pa.Table.from_batches(held)
                        held = []
                    now = keys[start]
                    held.append(b.slice(start, i - start))
                start = i
    if held:
        yield now, pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return unit(flat.flatten().to_numpy().reshape(len(flat), -1))


def near_duplicates(rows: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", shard: int = 512, most_centroids: int = 4096, overlap: int = 2, margin: float = 0.03, degree: int = 24, width: int = 64, chunk: int = 512) -> DataFrame:
    """(id, n_links, component_id) for each row.

    ``shard``: nodes of a shard, about. ``most_centroids``: bound of the fitted sample. ``overlap``, ``margin``: a
    node belongs to its nearest centroids, and to those that are hardly further than the nearest. ``chunk``: nodes of
    a chunk of a large shard.
    """
    spark = rows.sparkSession
    values = F.col("vector")
    norm = F.aggregate(values, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    named = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"), F.col(label_col).alias("label"))
    usable = F.col("label").isNotNull() & values.isNotNull() & (F.size("vector") > 0) & ~F.exists(values, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & (norm > 0)
    good = named.filter(usable)
    node = F.xxhash64(F.col("label").cast("string"), "vector")
    members = common.saved(good.select("id", F.concat_ws("/", F.col("label").cast("string"), F.size("vector").cast("string")).alias("kind"), "vector", node.alias("node")), "vectors")
    nodes = common.saved(members.groupBy("node", "kind").agg(F.min("id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector")), "vector-nodes")

    # centroids: a hash sample, thinned so that a dense spot has one only
    sizes = {r["kind"]: r["n"] for r in nodes.groupBy("kind").agg(F.count("*").alias("n")).filter(F.col("n") > shard).orderBy(F.desc("n"), "kind").limit(most_centroids // 2).collect()}
    total = max(1, sum(sizes.values()))
    share = F.lit(0.0)
    for kind, n in sizes.items():
        share = F.when(F.col("kind") == kind, min(1.0, 3 * min(n / shard, most_centroids * n / total) / n)).otherwise(share)
    picked: dict[str, np.ndarray] = {}
    if sizes:
        found = nodes.filter(F.pmod(F.xxhash64("node", F.lit(9)), F.lit(1_000_003)) < share * 1_000_003).select("kind", "node", "vector").orderBy("kind", "node").collect()
        for kind in sizes:
            kept: list[np.ndarray] = []
            for v in (unit(np.array(r["vector"])) for r in found if r["kind"] == kind):
                if all(v @ c < 0.8 for c in kept):
                    kept.append(v)
            if kept:
                picked[kind] = np.array(kept)

    @F.arrow_udf("array<int>")
    def shards(kind: pa.Array, vector: pa.Array) -> pa.Array:
        out = []
        for i in range(0, len(kind), 4096):
            for k, v in zip(kind.slice(i, 4096).to_pylist(), vector.slice(i, 4096).to_pylist(), strict=True):
                c = picked.get(k)
                if c is None or len(c) == 1:
                    out.append([0])
                    continue
                d = np.sqrt(np.maximum(0, 2 - 2 * (c @ unit(np.array(v)))))
                near = np.argsort(d, kind="stable")
                out.append(sorted(near[: max(overlap, int((d <= d[near[0]] + margin).sum()))].tolist()))
        return pa.array(out, pa.list_(pa.int32()))

    placed = common.saved(nodes.select("node", "kind", "copies", "vector", shards("kind", "vector").alias("shards")), "vector-shards")
    count = placed.select("kind", F.explode("shards").alias("shard")).groupBy("kind", "shard").agg(F.count("*").alias("m")).select("kind", "shard", F.ceil(F.col("m") / (2 * chunk)).cast("int").alias("half"), "m")
    count = count.select("kind", "shard", F.when(F.col("half") <= 1, 1).otherwise(F.ceil(F.col("m") / chunk)).cast("int").alias("chunks"))
    where = placed.select("node", "kind", F.explode("shards").alias("shard")).join(count, ["kind", "shard"])
    side = F.pmod(F.xxhash64("node", F.lit(3)), F.col("chunks")).cast("int")
    each = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda v: F.struct(F.least(v, "side").alias("a"), F.greatest(v, "side").alias("b")))
    where = where.withColumn("side", side).select("node", "kind", "shard", "side", F.explode(each).alias("g")).select("node", "kind", "shard", "side", "g.a", "g.b")
    where = where.join(placed.select("node", "copies", "vector", "shards"), "node")
    order = ["kind", "shard", "a", "b"]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in _grouped(batches):
            id_, adj = t["node"].to_numpy(), flat_graph(_matrix(t["vector"]), degree, width)
            pairs = [id_[r[r >= 0]].tolist() for r in adj]
            yield pa.RecordBatch.from_arrays([pa.array(id_), pa.array(pairs, pa.list_(pa.int64()))], ["node", "next"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, shard_no, a, b), t in _grouped(batches):
            id_, x = t["node"].to_numpy(), _matrix(t["vector"])
            n = len(id_)
            at = {v: i for i, v in enumerate(id_.tolist())}
            found = range_search(x, [[at[v] for v in near or () if v in at] for near in t["next"].to_pylist()], least)
            mine, sides = t["shards"].to_pylist(), t["side"].to_numpy()
            if a != b:
                found &= sides[:, None] != sides[None, :]
            kinds: dict[tuple, int] = {}
            of = np.array([kinds.setdefault(tuple(m), len(kinds)) for m in mine])
            names = list(kinds)
            first = np.array([[min(set(p) & set(q), default=-1) == shard_no for q in names] for p in names])
            found &= first[of[:, None], of[None, :]]
            copies = t["copies"].to_numpy()
            n_links = found.astype(np.float64) @ copies
            root = np.arange(n)
            edges: list[tuple[int, int]] = []
            for i in range(n):
                near = np.flatnonzero(found[i])
                for j in near[root[near] != root[i]].tolist():
                    if root[j] != root[i]:
                        root[root == root[j]] = root[i]
                        edges.append((int(id_[i]), int(id_[j])))
            u, v = ([e[k] for e in edges] for k in (0, 1))
            m = len(edges)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([id_, np.array(u, np.int64)])), pa.array([None] * n + v, pa.int64()), pa.array(np.concatenate([n_links.astype(np.int64), np.zeros(m, np.int64)]))],
                ["u", "v", "n_links"],
            )

    built = where.repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(build, "node long, next array<long>")
    united = common.saved(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next")), "vector-graph")
    searched = where.join(united, "node").repartition(*order).sortWithinPartitions(*order, "node").mapInArrow(search, "u long, v long, n_links long")
    searched = common.saved(searched, "vector-links")
    roots = components(searched.filter(F.col("v").isNotNull()).select("u", "v"))
    degree_of = searched.filter(F.col("v").isNull()).groupBy("u").agg(F.sum("n_links").alias("n_links")).withColumnRenamed("u", "node")
    known = nodes.select("node", "least", "copies").join(degree_of, "node", "left").join(roots, "node", "left").select("node", "least", "copies", "n_links", F.coalesce("root", "node").alias("root"))
    known = common.saved(known, "vector-roots")
    ids = known.groupBy("root").agg(F.min("least").alias("component_id"))
    result = members.select("id", "node").join(known.join(ids, "root").select("node", "component_id", (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "node")
    # rows without a usable vector
    bad = named.filter(~F.coalesce(usable, F.lit(False)))
    out = result.select("id", "n_links", "component_id").unionByName(bad.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id")


def audit(rows: DataFrame, result: DataFrame, least: float = 0.98, queries: int = 200, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> float:
    """Recall of link counts: for at most ``queries`` rows (a hash sample), links found over links by brute force."""
    n = rows.count()
    sample = rows.filter(F.pmod(F.xxhash64(id_col, F.lit(6)), F.lit(1_000_003)) < min(1.0, queries / max(1, n)) * 1_000_003).limit(2 * queries)
    ask = [(r[id_col], r[label_col], unit(np.array(r[vector_col], float))) for r in sample.collect() if r[vector_col] and r[label_col] is not None and any(r[vector_col])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ask), np.int64)
        for b in batches:
            for i, v, label in zip(b.column(id_col).to_pylist(), b.column(vector_col).to_pylist(), b.column(label_col).to_pylist(), strict=True):
                if not v or label is None or None in v or not np.isfinite(v).all() or not any(v):
                    continue
                u = unit(np.array(v, float))
                total += np.array([i != k and label == m and len(u) == len(q) and u @ q >= least for k, m, q in ask], bool)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in ask], pa.int64()), pa.array(total)], ["id", "n"])

    truth = rows.select(id_col, vector_col, label_col).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    r = truth.join(result.select(F.col(id_col).alias("id"), "n_links"), "id").agg(F.sum(F.least("n", "n_links")).alias("hit"), F.sum("n").alias("all")).collect()[0]
    return 1.0 if not r["all"] else r["hit"] / r["all"]


def op9_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors at cosine 0.98. Vectors that are null, zero, or hold nulls or what isn't finite,
    and those without a label, link with nothing; repeated rows count as other vectors; a component's id is its least
    vec_id; an empty table gives no row; other columns are ignored."""
    out = near_duplicates(common.table(spark, sf_dir, "embeddings"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
