"""Annotation looks into each text once, before its scan, and its short cuts are exact."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.operators import annotate, statescan

ODD = ["", " ", "a", " a", "a ", " a ", "\u00a0", "a\n", "a\u2003b", "\ta\u0085", "🙂 ", "\u2003🙂", "— x", "– ", "-", "“a", "1.", "12) a", "[3] a", "[x", "A ", "ABCD", "ABC d", "Table 2", "<H2> 1. a ", "<H2>", "<h2> a", "•"]


def test_stripped_is_strip(spark):
    rows = spark.createDataFrame([(x,) for x in [*ODD, None]], "text string").select("text", T.strip(F.col("text")).alias("a"), T.stripped(F.col("text")).alias("b"))
    assert all(r["a"] == r["b"] for r in rows.collect())


def test_texts_are_searched_once(spark):
    """After the scan, which reads its rows twice, no pattern is left to be looked for."""
    rules = [(r"Table\s+\d+", "T1", "Table One"), (r"[^ ]+ [^ ]+$", "H2", "H2"), (r"(.)\1", "XX", "XX")]
    rows = spark.createDataFrame([(1, i, x, i % 3 == 0) for i, x in enumerate(ODD)], "doc_id long, pos int, text string, is_list boolean")
    for its in (rules[:2], rules, []):
        out = annotate.annotated(rows, "doc_id", "pos", its, {}, F.floor(F.col("pos") / 4))
        assert "RLIKE" not in out._jdf.queryExecution().optimizedPlan().toString()
        got = {r["text"]: (r["new_tag"], r["new_style"]) for r in out.collect()}
        assert len(got) == len(ODD) and got[" "] == got["\u00a0"] == ("EMPTY", "TXT") and got["<H2> 1. a "] == ("H2", "H2")
        if its:
            assert got["Table 2"] == ("T1", "Table One")


def test_groups_begin_where_keys_change():
    batch = pa.RecordBatch.from_arrays([pa.array(["a", "a", "a", "b", "b"]), pa.array([0, 0, 1, 1, None], pa.int64())], ["d", "c"])
    ((_, keys, starts),) = statescan._groups(iter([batch, batch.slice(0, 0)]), ["d", "c"])
    assert starts == [0, 2, 3, 4] and keys == [("a", 0), ("a", 1), ("b", 1), ("b", None)]
