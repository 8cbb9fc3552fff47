"""The audit of sources against brute force: many sources (several tiles), nulls, empty groups, large counts, merges."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from vellum.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id long, text string, lang string, source string, term string, block int"


def brute(rows: list[tuple], documents: int = 3, most: int = 200) -> set[tuple]:
    langs: dict = {}
    for _, text, lang, source, *_ in rows:
        langs.setdefault(lang or "", []).append((source or "", TERM.findall((text or "").translate(LOWER))))
    out = set()
    for lang, docs in langs.items():
        seen = Counter(t for _, w in docs for t in set(w))
        kept = sorted((t for t, n in seen.items() if n >= documents), key=str.encode)
        count = {s: Counter() for s, _ in docs}
        for s, w in docs:
            count[s].update(t for t in w if seen[t] >= documents)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        p = {s: share(c) for s, c in count.items()}
        q = share(sum(count.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in count:
            pair = sorted(((-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in count if o != s))
            term = sorted((-f(p[s][t], q[t]), t.encode()) for t in kept if count[s][t] and p[s][t] > q[t])[:most]
            for part, items in (("pair", pair), ("term", term)):
                out |= {(lang, s, part, o.decode(), -v, k) for k, (v, o) in enumerate(items, 1)}
    return out


def rows() -> list[tuple]:
    r = random.Random(6)
    words = ["alpha", "Beta", "beta", "gamma", "délta", "東京", "x1y", "it's", "Ünder", "a", "Z"] + [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(120)]
    out = []
    for i in range(500):
        s = f"s{r.randint(0, 39)}" if r.random() < 0.7 else "s0"  # a hot source
        own = words[: 20 + 3 * int(s[1:])]
        out.append((i, " ".join(r.choice(own) for _ in range(r.randint(0, 40))), r.choice(["en", "en", "de", None]), r.choice([s, s, s, None]), "x", 1))
    out += [(900, None, "en", "silent", "x", 1), (901, "", "fr", "a", "x", 1), (902, "rare words", "fr", "b", "x", 1), (903, "123 ... \x00", "", "", None, None)]
    out += [(904, "same text", "it", "a", "x", 1)] * 3 + [(905, "Same TEXT text", "it", "b", "x", 1), (906, "long " * 500_000, "en", "s1", "x", 1)]
    return out


@pytest.mark.parametrize("most,tile", [(200, 16), (5, 3)])
def test_against_brute_force(spark, most, tile):
    df = spark.createDataFrame(rows(), COLUMNS).repartition(5)
    got = divergence.audit(df, most=most, tile=tile).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute(rows(), most=most)


def test_groups_not_broadcast_and_empty(spark, monkeypatch):
    monkeypatch.setattr(divergence, "GROUPS", 0)
    monkeypatch.setattr(divergence, "HELD", 50)
    df = spark.createDataFrame(rows(), COLUMNS)
    assert set(map(tuple, divergence.audit(df, documents=1).collect())) == brute(rows(), 1)
    assert divergence.audit(df.limit(0)).count() == 0


def test_merge_and_shares():
    r = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(r.integers(0, r.integers(1, 3000), r.integers(0, n))) for n in (40, 2000))
        i, j = divergence.meet(a, b, at_once=int(r.integers(1, 30)))
        assert a[i].tolist() == b[j].tolist() == np.intersect1d(a, b).tolist()
        assert [x.tolist() for x in divergence.meet(b, a)] == [x.tolist() for x in divergence.meet(a, b)[::-1]]
    big = np.array([5, 10**13])
    assert divergence.shares(big, 10**14, 7).tolist() == [1 + 10**9 * (int(x) + 1) // (10**14 + 7) for x in big]
