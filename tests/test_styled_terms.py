"""Where spans of two sides meet, against all pairs; terms of lines with odd white space, against SQL."""

import random

import duckdb

from vellum.operators import spans
from vellum.plans import catalogue_checks as c


def test_all_pairs(spark):
    rng = random.Random(7)

    def side(name):
        out = []
        for doc in range(30):
            at = rng.randint(0, 3)
            for i in range(rng.randint(0, 12)):
                size = rng.randint(0, 9)
                out.append((doc, at, at + size, f"{name}{i}"))
                at += size + rng.choice((0, 0, 1, 5))
        return out

    a, b = side("a"), side("b")
    frame = lambda rows, name: spark.createDataFrame(rows, f"doc int, s long, e long, {name} string")
    out = spans.intersected(frame(a, "x"), frame(b, "y"), ["doc"], "s", "e", "x", "y")
    want = [(d, max(s, t), min(e, f), x, y) for d, s, e, x in a for g, t, f, y in b if d == g and s < e and t < f and max(s, t) < min(e, f)]
    assert sorted(map(tuple, out.collect())) == sorted(want) and len(want) > 100
    assert out._jdf.queryExecution().analyzed().toString().count("Union") == 1  # a side is read once, not once for each end


def test_odd_lines(spark, tmp_path):
    texts = ["one.\r two, three.\r\nfour!  five?  . , six", "", " ; ", "a. b.c d.", "x\ny.", None, "end.\u0085"]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    from vellum import plans

    assert sorted(map(tuple, c.styled_terms(spark, str(tmp_path)).collect())) == sorted(con.execute(plans.SQL["styled_terms"]).fetchall())
