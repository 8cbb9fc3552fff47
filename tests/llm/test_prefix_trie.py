"""The trie of conversations' prefixes against brute force: nulls, ties, repeated rows, copies, long conversations."""

import hashlib
import random
import zlib

import pytest

from vellum.llm import common, prefix_trie

COLUMNS = "conv_id long, turn long, role string, text string, path string, shard long, skeleton long"


def rows() -> list[tuple]:
    r = random.Random(4)
    out = []
    for c in [*range(0, 40), *range(100, 130), *range(200, 330), 555, -7, -101]:
        for t in range(r.randint(0, 6)):
            out.append((c, t, r.choice(["user", "assistant"]), r.choice(["", "a", "b", "naïve 🙂"]), "x", 1, 2))
    out += [(c, t, "user", "same", "x", 1, 2) for c in range(400, 480) for t in range(8)]  # copies
    out += [(701, t, "user", str(t % 3), "x", 1, 2) for t in range(700)]  # a long one
    out += [(800, None, None, None, None, None, None), (800, 1, "user", "tie", "x", 1, 2), (800, 1, "assistant", "tie", "x", 1, 2), (801, 1, "user", "tie", "x", 1, 2), (801, 1, "user", "tie", "x", 1, 2), (None, 0, "user", "a", "x", 1, 2)]
    return out


def ordered(table: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    by: dict = {}
    for c, t, r, x, *_ in table:
        if c is not None:
            r, x = r or "", x or ""
            by.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    return {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}


def brute(told: dict[int, tuple]) -> set[tuple]:
    members: dict = {}
    for c, p in told.items():
        for k in range(len(p) + 1):
            members.setdefault(p[:k], []).append(c)
    kids = {p: 0 for p in members}
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, m in members.items():
        for k in range(len(p) + 1):
            saved[p[:k]] += (len(m) - 1) * len(p[-1][1]) if p else 0
            leaves[p[:k]] += kids[p] == 0
    ends = lambda p: ",".join(str(c) for c in sorted(told) if told[c] == p)
    return {(min(m), len(p), min(members[p[:-1]]) if p else None, len(m), kids[p], leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in members.items()}


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), COLUMNS).repartition(5)


@pytest.mark.parametrize("shard_bytes,most", [(1 << 24, 8 << 20), (3000, 8 << 20), (2000, 40 * 20)])
def test_rebuilt(table, monkeypatch, shard_bytes, most):
    """One shard and many, whole splitters and cut ones."""
    monkeypatch.setattr(prefix_trie, "SKELETON_BYTES", most)
    told = {}
    own = ordered(rows())
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        told[c] = (*own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])[:h], *turns[h:])
    got = prefix_trie.nodes(common.saved(prefix_trie.rebuilt(table), "t"), shard_bytes).collect()
    assert len(got) == len(set(got)) and set(map(tuple, got)) == brute(told)


def test_own_turns(table, spark):
    told = ordered(rows())
    trie = prefix_trie.nodes(common.saved(prefix_trie.paths(table), "t"), 3000)
    assert set(map(tuple, trie.collect())) == brute({c: tuple(v) for c, v in told.items()})
    named = prefix_trie.with_turns(trie, table).collect()
    assert len(named) == trie.count() and all((r.role, r.text) == (told[r.conv_id][r.depth - 1] if r.depth else (None, None)) for r in named)
    assert prefix_trie.nodes(common.saved(prefix_trie.rebuilt(spark.createDataFrame([], COLUMNS)), "t")).collect() == []
    one = spark.createDataFrame([(5, None, None, None)], "conv_id long, turn long, role string, text string")
    assert len(prefix_trie.nodes(common.saved(prefix_trie.rebuilt(one), "t")).collect()) == 1 + (zlib.crc32(b"5") % 6 == 0)
