"""What the n-gram join sends to groups: copies for large clusters only, no pair left out, nothing grown broadcast."""

from itertools import combinations

import corpus_pipeline
from vellum.llm import ngram_join


def test_only_large_clusters_go_to_all_salts(spark, monkeypatch):
    sizes = {10_000: 3, 20_000: 40, 30_000: ngram_join.SALTS + 50, 40_000: 8}
    root = {c + i: c if i % 3 or c == 40_000 else c + 1 for c, m in sizes.items() for i in range(m)}
    stars = spark.createDataFrame([(c, c + i) for c, m in sizes.items() for i in range(1, m)], "centre long, node long")
    roots = spark.createDataFrame(list(root.items()), "node long, root long")
    asked, dealt = [], ngram_join.dealt
    monkeypatch.setattr(ngram_join, "dealt", lambda stars, large, *also: asked.append(large) or dealt(stars, large, *also))
    want = set()
    for c, m in sizes.items():
        own = [root[c + i] for i in range(m)]
        if len(set(own)) > 1:
            main = max(set(own), key=lambda x: (own.count(x), x))
            want |= {p for p in combinations(range(c, c + m), 2) if root[p[0]] != main or root[p[1]] != main}
    for chunk in (16, 512):
        groups: dict[tuple, dict[int, int]] = {}
        for r in ngram_join.rest_groups(stars, roots, chunk).collect():
            groups.setdefault((r.centre, r.a, r.b), {})[r.node] = r.side
        assert [r.centre for r in asked[-1].collect()] == [30_000]
        plan = dealt(stars, asked[-1])._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin [centre" not in plan
        met = {tuple(sorted(p)) for (_, a, b), held in groups.items() for p in combinations(held, 2) if a == b or held[p[0]] != held[p[1]]}
        assert met >= want and len(want) > 10_000


def test_pipeline_copies_no_small_cluster(spark, monkeypatch):
    """The near duplicate stage of the pipeline, over documents whose clusters are all small."""
    folder, asked, dealt = "/root/testdata/sf0.01", [], ngram_join.dealt
    monkeypatch.setattr(ngram_join, "dealt", lambda stars, large, *also: asked.append((stars.groupBy("centre").count().agg({"count": "max"}).first()[0] or 0, large.count())) or dealt(stars, large, *also))
    kept = corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).count()
    assert len(asked) == 2 and all(most <= ngram_join.SALTS and large == 0 for most, large in asked) and kept > 0
