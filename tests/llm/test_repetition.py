"""Quality rules by repeated substrings against brute force over all word sequences of a text."""

import random
import re
from collections import Counter

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from vellum.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text: str | None, least: int) -> dict:
    text = text or ""
    at = [m.span() for m in WORD.finditer(text)]
    w = [text[a:b] for a, b in at]
    n = len(w)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    often = Counter(tuple(w[i : i + 3]) for i in range(n - 2))
    windows = {j for i in range(n - 2) if often[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    covered, longest, repeats = set(), 0, 0
    for size in range(least, n):
        places: dict = {}
        for i in range(n - size + 1):
            places.setdefault(tuple(w[i : i + size]), []).append(i)
        again = [p for p in places.values() if len(p) > 1]
        if not again:
            break
        longest = size
        for p in again:
            covered.update(j for i in p for j in range(i, i + size))
            repeats += len({w[i - 1] if i else None for i in p}) > 1 and len({w[i + size] if i + size < n else None for i in p}) > 1
    spans = []
    for i in sorted(covered):
        if spans and spans[-1][1] == i - 1:
            spans[-1][1] = i
        else:
            spans.append([i, i])
    return {
        "n_words": n, "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(windows), "n_repeats": repeats,
        "longest_repeat": longest, "repeat_chars": sum(len(w[i]) for i in covered), "spans": [{"start": at[a][0], "end": at[b][1]} for a, b in spans],
    }


def test_small_alphabet():
    r = random.Random(2)
    for _ in range(150):
        texts = ["".join(r.choice(["a", "b", "a", "é", "🙂", "#"]) + r.choice([" ", " ", "\n", "  ", "\n\n", "\t", "\x0b"]) for _ in range(r.choice([0, 1, 2, 5, 20, 60]))) if r.random() < 0.9 else None for _ in range(r.randint(1, 6))]
        least = r.choice([1, 2, 3, 5, 8, 16])
        assert repetition.judged(pa.array(texts, pa.string()), least).to_pylist() == [brute(t, least) for t in texts]


def test_given_texts():
    texts = pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()
    texts = [t for t in texts if t is None or len(t) < 9000]
    passage = " ".join(f"p{i}" for i in range(60))
    texts += [f"{passage} between {passage} end", passage, passage + "\n" + passage + "\n" + passage]
    assert repetition.judged(pa.array(texts, pa.string()), 16).to_pylist() == [brute(t, 16) for t in texts]


def test_long_text_and_edges(spark, monkeypatch):
    passage = " ".join(f"p{i}" for i in range(120))
    long = "\n".join(f"w{i} said {i * 7} of them" for i in range(60_000)) + f" {passage} {passage}"  # over a block
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, "a " * 3000, "c", 3), (4, long, "d", 4), (5, long, "d", 4), (5, long, "d", 4), (None, "one two", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string, n_words int")
    got = repetition.measured(df).withColumn("kept", repetition.kept(repetition.F.col("rules"))).collect()
    assert [(r.doc_id, r.spans, r.n_words) for r in got] == [(r[0], r[2], r[3]) for r in rows]  # clashing columns stay
    by = {r.doc_id: r for r in got}
    assert by[1].rules.n_words == 0 and not by[1].kept and not by[3].kept and by[3].rules.longest_repeat == 2999
    assert by[4].rules.longest_repeat == 120 and not by[4].kept and by[4].rules == by[5].rules and by[4].rules.n_words == 60_000 * 5 + 240
    assert repetition.measured(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        repetition.measured(df.withColumnRenamed("spans", "rules"))
