"""Queries take whole tables; those without SQL are held against brute force."""

import re
from difflib import SequenceMatcher
from itertools import combinations

from pyspark.sql import functions as F

from vellum import plans
from vellum.functions import similarity
from vellum.operators import joins

FOLDER = "/root/testdata/sf0.001"

def rows(found) -> list[tuple]:
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(map(plain, r)) for r in found), key=lambda r: tuple(map(str, r)))


def test_no_part_of_a_table():
    """No registered SQL takes a part of the rows by id or length; searches ask for every twentieth row, as is fixed for them."""
    for name, sql in plans.SQL.items():
        narrow = re.findall(r"WHERE\s+(?:doc_id|vec_id|page_id|conv_id|n_chars)\s*(?:%|<(?!>))[^,)]*", sql)
        assert not narrow or name in ("tfidf_topk", "majority_vote", "embedding_topk") and all("% 20 = 0" in x for x in narrow), name


def test_near_duplicates(spark, tmp_path):
    """First lines that differ, are short, or are all that is alike; lengths of 63 and 64; two languages; two sources."""
    long = " ".join(f"word{i} of number {i * 7 % 31}" for i in range(60))
    even = "abcdefghij klmnopqrst uvwxyzabcd efghijklmn opqrstuvwx yzabcdefg"[:63]
    texts = [f"A title\n{long}", f"Another heading\n{long}", f"A title\n{long[::-1]}", even, even + "h", f"x\n{long}", "", "", f"A title\n{long}", "A title", "A titel"]
    whole = [(i, t, "de" if i == 5 else "en", "s2" if i == 8 else "s1") for i, t in enumerate(texts)]
    spark.createDataFrame(whole, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    for folder, docs in ((str(tmp_path), whole), (FOLDER, [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text", "lang", "source").collect()])):
        got = plans.QUERIES["near_duplicates"](spark, folder).collect()
        want = [(a, b, r) for (a, x, _, s), (b, y, _, t) in combinations(sorted(docs), 2) if s == t and (r := SequenceMatcher(None, x, y).ratio()) > 0.85]
        assert rows(got) == rows(want) and got


def test_greedy_align(spark, tmp_path):
    """Turns that share an opening of 200 letters and differ after it, and turns that differ only in it."""
    head, other = "An opening that many turns share. " * 6, "Quite 1 different & wholly new start? " * 6
    tails = [" ".join(f"{w}{i}" for i in range(150)) for w in ("first", "second", "third")]
    users, bots = [head + tails[0], head + tails[1], head + tails[2]], [head + tails[1], other + tails[2], "x"]
    turns = [(1, i, "user" if i % 2 == 0 else "assistant", (users, bots)[i % 2][i // 2]) for i in range(6)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for folder, all_turns in ((str(tmp_path), turns), (FOLDER, [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])):
        want, used = [], set()
        for c, p, role, t in sorted(all_turns, key=lambda r: r[:2]):
            found = [(r, -q, q) for k, q, _, u in all_turns if role == "user" and k == c and (k, q) not in used and (r := SequenceMatcher(None, t, u + ".").ratio()) >= 0.85]
            if found:
                r, _, q = max(found)
                used.add((c, q))
                want.append((c, p, q, r))
        got = plans.QUERIES["greedy_align"](spark, folder).collect()
        assert rows(got) == rows(want) and got
        found = plans.QUERIES["greedy_align"](spark, folder)
        assert found.count() == len(got) and found.select("doc").count() == len(got)


def test_best_match_meets_few_pairs(spark, monkeypatch):
    """The same matches as all pairs give, from fewer calls: only poor and long queries meet the whole block."""
    import random
    from difflib import SequenceMatcher

    r = random.Random(5)
    known = [(k % 3, f"Supplier#{k:09d}", k) for k in range(240)] + [(0, "a", 900), (0, "ab", 901), (1, "", 902), (1, None, 903), (2, "x" * 60, 904), (2, "x" * 38, 905), (2, "x" * 42, 906), (0, "Supplier#000000003", -1)]
    asked = [(g, t[:3] + t[5:]) for g, t, _ in known[:120]] + [(g, "".join(r.sample(t, len(t)))) for g, t, _ in known[120:140]] + [(0, "a"), (0, "b"), (1, ""), (1, None), (2, "x" * 59), (2, "x" * 40), (2, "Supplier#0000"), (0, "Supplier#0000000033")]
    want = []
    for g, q in asked:
        got = [(s, -p, t) for h, t, p in known if h == g and q is not None and t is not None and (s := SequenceMatcher(None, q, t).ratio()) > 0.8]
        want += [(g, q, max(got)[2], max(got)[0])] if got else []
    a, t = spark.createDataFrame(asked, "g int, name string"), spark.createDataFrame(known, "g int, name string, k int")
    assert sorted(tuple(x) for x in similarity.best_match(a, t, "g", "name", "k", 0.8).collect()) == sorted(want)
    # without the way over all pairs whatever was sure stays
    monkeypatch.setattr(similarity, "NEAR", 0)
    assert sorted(tuple(x) for x in similarity.best_match(a, t, "g", "name", "k", 0.8).collect()) == sorted(want)


def test_best_match_keeps_repeated_queries(spark):
    asked = spark.createDataFrame([(1, "alpha beta"), (1, "alpha beta"), (2, "alpha beta"), (1, None)], "g int, name string")
    known = spark.createDataFrame([(1, 7, "alpha betas"), (1, 3, "alpha betaz"), (1, 1, "nothing"), (2, 4, "zzz")], "g int, k int, name string")
    assert rows(similarity.best_match(asked, known, "g", "name", "k", 0.8).select("g", "name", "match").collect()) == [(1, "alpha beta", "alpha betaz")] * 2


def test_nearest_keeps_repeated_anchors(spark):
    anchors = spark.createDataFrame([(1, 5, "a"), (1, 5, "a"), (1, 5, "b")], "doc int, pos int, tag string")
    others = spark.createDataFrame([(1, 4, "x"), (1, 4, "x"), (1, 6, "a"), (1, 6, "b")], "doc int, pos int, tag string")
    got = joins.nearest_within(anchors, others, ["doc"], "pos", 3, F.col("tag") == F.col("c_tag"))
    assert rows(got.select("tag", "c_pos", "c_tag").collect()) == [("a", 6, "a"), ("a", 6, "a"), ("b", 6, "b")]


def test_dense_top_k_meets_rows_by_chunks(spark, monkeypatch):
    """No nested-loop join over whole vectors; ties, zero-free odd rows and several chunks come out as by plain loops."""
    import numpy as np

    from vellum.operators import corpus

    monkeypatch.setattr(corpus, "QUERIES", 4)
    monkeypatch.setattr(corpus, "VECTORS", 16)
    r = np.random.default_rng(2)
    vectors = {i: [float(x) for x in r.integers(-2, 3, 6)] for i in range(90)}
    vectors = {i: v if any(v) else [1.0] * 6 for i, v in vectors.items()} | {90: None, 91: [1.0, None, 0.0, 0.0, 0.0, 0.0]}
    df = spark.createDataFrame(list(vectors.items()), "id long, v array<float>")
    out = corpus.dense_top_k(df, "id", "v", F.col("id") % 9 == 0, 4)
    got = sorted((x.query, x["rank"], x.match) for x in out.collect() if x.sim is not None)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(y * y for y in b) ** 0.5 * sum(x * x for x in a) ** 0.5)
    want = []
    for q in range(0, 90, 9):
        near = sorted(((round(cos(vectors[q], vectors[m]), 9), m) for m in range(90) if m != q), reverse=True)[:4]
        want += [(q, k, m) for k, (_, m) in enumerate(near, 1)]
    assert got == sorted(want)
    assert "NestedLoop" not in corpus.dense_top_k(df.filter("id < 90"), "id", "v", F.col("id") % 9 == 0, 4)._jdf.queryExecution().toString()
