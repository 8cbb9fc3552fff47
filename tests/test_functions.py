"""Functions and recurrences against plain models."""

import io
import zipfile
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from vellum.functions import citations, similarity
from vellum.functions import text as T
from vellum.functions.normalize import integrity_text, without_diacritics
from vellum.operators import quality, stateful, workflow
from vellum.operators import sequence as seq
from vellum.sources import docx, tables
from vellum.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.numbers(lit("1, 3-5, 9–7"))) == [1, 3, 4, 5]
    assert one(spark, T.number_ranges(F.array(*map(lit, (1, 2, 3, 5, 6, 9))))) == "1-3, 5,6, 9"
    assert one(spark, T.full_pages(lit("123-9"))) == "123-129"
    assert one(spark, T.strip(lit("  a  "))) == "a"
    assert one(spark, T.marker_token(lit("<H1>Title"))) == "H1" and one(spark, T.marker_token(lit("x"))) is None
    assert one(spark, T.tag_parts(lit("BL-FIRST"))).asDict() == {"prefix": "BL", "position": "FIRST"}
    assert one(spark, T.list_base(lit("BL2-MID"))).asDict() == {"base": "BL", "depth": 2}
    assert one(spark, T.doi(lit("see doi 10.1000/abc.1)."))) == "10.1000/abc.1"
    assert one(spark, T.scripts(lit("aβя"))) == ["greek", "cyrillic"]
    assert one(spark, T.preview(lit("abcdef"), 3)) == "abc..."
    assert one(spark, T.sentences(lit("One. Two? three"))) == ["One.", "Two?", "three"]
    assert one(spark, T.acronym(lit("World Health Organization"))) == "WHO"
    assert one(spark, without_diacritics(lit("Éà"))) == "Ea"
    assert one(spark, integrity_text(lit("ﬁ <H1> “x”"))) == 'fi "x"'
    assert one(spark, T.needs_permission(lit("a"), lit("Reprinted from B")))
    assert [r["id"] for r in one(spark, T.json_ladder(lit('[{"id": 1}, {"id": 2}, {"i'), "struct<id: int>"))] == [1, 2]


def test_similarity(spark):
    rows = [(1, "the quick brown fox"), (2, "the quick brown fax"), (3, "unrelated words here"), (4, None)]
    df = spark.createDataFrame(rows, "id int, t string")
    got = similarity.near_pairs(df, F.lit(1), "id", "t", 0.85).collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 2)]
    assert got[0]["ratio"] == SequenceMatcher(None, rows[0][1], rows[1][1]).ratio()


def test_near_pairs_compare_few_unrelated_texts(spark):
    import random

    r = random.Random(3)
    words = ["".join(r.choices("theandionrs", k=r.randint(2, 5))) for _ in range(300)]
    texts = [" ".join(r.choices(words, k=r.choice((9, 14, 70, 80, 90)))).capitalize() + "." for _ in range(60)]
    texts += [t[:40] + "Qx" + t[44:] for t in texts[:20]] + texts[5:15] + [texts[30].replace("e", "k")] + ["", "", None]
    df = spark.createDataFrame([(i * 37 % 101, t) for i, t in enumerate(texts)], "id long, t string")
    real = {(a, b): x for a, t in ((i * 37 % 101, t) for i, t in enumerate(texts)) for b, u in ((i * 37 % 101, t) for i, t in enumerate(texts)) if a < b and t is not None and u is not None and (x := SequenceMatcher(None, t, u).ratio()) > 0.85}
    assert {(p.a, p.b): p.ratio for p in similarity.near_pairs(df, F.lit(1), "id", "t", 0.85).collect()} == real and len(real) > 30
    one = df.filter("length(t) > 300").select(F.lit(1).alias("__block"), F.col("id").alias("__x"), F.col("t").alias("__t")).dropDuplicates(["__t"])
    assert similarity.near_texts(one, 0.85).count() < one.count()


def test_citations():
    got = citations.found("As (Smith & Jones, 2019; see Brown, 2001a) and Lee et al. (2020) show (Adams, 1999, as cited in Clark, 2005).")
    assert [(k, a, y) for _, _, k, a, y in got] == [("parenthetical", "Smith & Jones", "2019"), ("parenthetical", "Brown", "2001a"), ("narrative", "Lee et al.", "2020"), ("secondary", "Adams", "1999")]
    assert citations.found(None) == []


def test_recurrences():
    assert stateful.repaired_levels([3, None, 2, 4, 1, 3]) == [1, None, 2, 3, 1, 2]
    assert stateful.nested_positions([("BL", 0), ("BL", 1), ("BL", 0), ("NL", 0), (None, 0), ("NL", 0)]) == ["FIRST", "FIRST", "LAST", "FIRST", None, "FIRST"]
    assert stateful.zones(["x", "Chapter 1", "<H1>Start", "<BX1>", "in box", "</BX1>", "References"]) == ["METADATA", "FRONT_MATTER", "BODY", "BOX_BX1", "BOX_BX1", "BOX_BX1", "BACK_MATTER"]
    assert stateful.box_segments(["OPEN", "X-TYPE", "X-TTL", "CLOSE", "OPEN", "a"]) == [(0, 3, True, True), (4, 5, False, False)]
    assert stateful.continued(["a (b", "c) d", "e"]) == ["a (b c) d", "e"]


def test_contract_and_score(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, t string")
    b = spark.createDataFrame([(1, "x"), (2, "Y"), (4, "w")], "id int, t string")
    assert sorted((r["id"], r["violation"]) for r in quality.contract(a, b, ["id"], "t").collect()) == [(2, "text changed"), (3, "lost"), (4, "added")]
    assert quality.staged(a, lambda d: d, ["id"], "t").count() == 3
    rows = [("d", i, "TXT" if i < 90 else "H1", 95) for i in range(100)]
    df = spark.createDataFrame(rows, "doc string, pos int, tag string, conf int")
    level = F.when(F.col("tag") == "H1", 1)
    got = quality.document_score(df, "doc", "pos", "tag", F.lit(True), "conf", 60, level, F.lit(False), F.lit(False)).collect()[0]
    assert (got["score"], got["action"]) == (100, "PASS")


def test_edges(spark):
    df = spark.createDataFrame([], "d int, p int, tag string")
    assert seq.run_positions(df, "d", "p", "tag").count() == 0
    one_row = spark.createDataFrame([(1, 1, None)], "d int, p int, tag string")
    r = seq.run_positions(one_row, "d", "p", "tag").collect()[0]
    assert (r["list_position"], r["singleton"]) == ("FIRST", True)
    up, old = workflow.upsert(spark.createDataFrame([(1, "a", 1)], "k int, v string, version int"), spark.createDataFrame([(1, "b"), (2, "c")], "k int, v string"), ["k"], "version")
    assert sorted(map(tuple, up.collect())) == [(1, "b", 2), (2, "c", 1)] and old.count() == 1


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    xml = f'<w:document xmlns:w="{w}"><w:body>{p("Title", "H1")}{p(" ")}<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl>{p("End")}</w:body></w:document>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "one.docx").write_bytes(buf.getvalue())
    spark.dataSource.register(docx.DocxSource)
    for df in (spark.read.format("docx").load(str(tmp_path)), docx.parsed(spark.read.format("binaryFile").load(str(tmp_path)))):
        assert [(r["id"], r["text"], r["is_table"]) for r in df.orderBy("id").collect()] == [(1, "Title", False), (2, "End", False), (3, "a", True), (4, "b", True)]


def test_sources(spark, tmp_path):
    (tmp_path / "t.csv").write_text("﻿category,term\nage,old  man\nage2,old man\n", encoding="utf-8")
    assert [tuple(r) for r in tables.terms(spark, str(tmp_path / "t.csv")).collect()] == [("old man", "age2")]
    (tmp_path / "v.json").write_text('["H1", "TXT", ""]')
    assert sorted(r[0] for r in tables.vocabulary(spark, str(tmp_path / "v.json")).collect()) == ["H1", "TXT"]
    (tmp_path / "l.jsonl").write_text('{"doc_id": "a", "para_index": 1, "text": "x", "canonical_gold_tag": "H1", "alignment_score": 0.9, "zone": "BODY"}\nnot json\n')
    assert tables.labelled(spark, str(tmp_path / "l.jsonl"), usable_only=True).count() == 1


def test_streams(spark, tmp_path):
    log = spark.createDataFrame([(1, "pending", 1), (1, "completed", 3), (1, "pending", 4), (2, "processing", 2)], "job int, status string, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s")
    log.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = jobs.job_state(jobs.events(spark, str(tmp_path / "in"), log.schema), "job", "status", "ts")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("states").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["job"], r["state"]) for r in spark.sql("select * from states").collect()) == [(1, "completed"), (2, "processing")]
    seen = []
    q = jobs.consume(jobs.events(spark, str(tmp_path / "in"), log.schema), lambda df, n: seen.append(df.count()), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert jobs.await_done(q, 60)
    assert seen == [4]
