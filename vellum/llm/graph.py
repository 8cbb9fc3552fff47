"""Connected components of a link table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v: long); nodes of a component share a root, one of them.

    Rounds of contraction: each node goes to its least neighbour (or stays), edges follow, until none is left; then
    the rounds' maps are composed. Nodes should be hashes: their order is random then, and the edges shrink by a
    constant factor a round, whatever the graph's shape. Each round is written to the shared folder.
    """
    live = common.saved(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    maps: list[DataFrame] = []
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = common.saved(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "roots")
        maps.append(step)
        at = lambda end: step.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root"))
        moved = live.join(at("u"), "u").join(at("v"), "v").select(F.least("u_root", "v_root").alias("u"), F.greatest("u_root", "v_root").alias("v"))
        following = common.saved(moved.filter("u <> v").distinct(), "edges")
        common.drop_saved(live)
        live = following
    if not maps:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    out = maps[0]
    for step in maps[1:]:
        out = out.join(step.select(F.col("node").alias("root"), F.col("root").alias("__next")), "root", "left").select("node", F.coalesce("__next", "root").alias("root"))
    return out
