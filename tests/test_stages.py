"""Row-rewrite stages, spans and reference lines on small rows."""

from pyspark.sql import functions as F

from vellum.functions import references as R
from vellum.operators import spans, stages


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0]["x"]


def test_references(spark):
    line = F.lit("Smith, J. K., & Jones, L. (2019). On things. Journal of X, 12(3), 45-50.")
    p = R.parsed_apa(line)
    assert one(spark, p).asDict() == {"authors": "Smith, J. K., & Jones, L.", "title": "On things", "journal": "Journal of X", "year": "2019"}
    people = one(spark, R.authors(p["authors"]))
    assert [(a["family"], a["given"]) for a in people] == [("Smith", "J. K."), ("Jones", "L")]  # the list's last full stop goes
    assert one(spark, R.ama_authors_text(R.authors(p["authors"]))) == "Smith JK, Jones L"
    assert one(spark, R.apa_authors_text(R.authors(F.lit("")))) == "Unknown authors"
    assert [a["family"] for a in one(spark, R.authors(F.lit("American Nurses Association")))] == ["American Nurses Association"]
    many = F.array(*(F.struct(F.lit(f"A{i}").alias("family"), F.lit("B").alias("given")) for i in range(7)))
    assert one(spark, R.ama_authors_text(many)) == "A0 B, A1 B, A2 B, et al."
    assert one(spark, R.style(F.lit("1. Smith J. T. J. 2019;3:4."))) == "AMA" and one(spark, R.style(F.lit("plain"))) == "Unknown"
    assert [one(spark, R.ordinal(F.lit(x))) for x in ("1", "12", "23", "112", "x")] == ["1st", "12th", "23rd", "112th", "x"]
    assert one(spark, R.number_prefix(F.lit("[12] A"))).asDict() == {"number": 12, "format": "square"} and one(spark, R.number_prefix(F.lit("A"))) is None


def test_stages(spark):
    assert one(spark, stages.list_depth(F.lit("KT-BL2-MID"))).asDict() == {"base": "KT-BL", "depth": 2} and one(spark, stages.list_depth(F.lit("TXT"))) is None
    assert one(spark, stages.marker_class(F.lit("<INSERT TAB 1>"))).asDict() == {"class": "insert", "pattern": "<INSERT TAB...>"}
    assert one(spark, stages.marker_class(F.lit("</box>"))).asDict() == {"class": "close", "pattern": "</BOX>"}
    styles = F.array(F.lit("H1"), F.lit("TXT"))
    assert one(spark, stages.split_composite(F.lit("odd/TXT"), styles)) == "TXT" and one(spark, stages.split_composite(F.lit("a,b"), styles)) is None
    assert one(spark, stages.style_aliases(F.lit("BL_1"), {"BL-1": "BL-FIRST"})) == "BL-FIRST" and one(spark, stages.style_aliases(F.lit("x"), {"a": "b"})) == "x"
    df = spark.createDataFrame([("H1", 50), ("H1", 90), ("odd", 10)], "tag string, confidence int")
    assert [r["alternatives"] for r in stages.alternatives(df).collect()] == [["H2", "CT", "SP-H1"], [], []]
    rows = spark.createDataFrame([("Summary",), ("Table 3 x",), (None,)], "text string")
    got = stages.first_matching(rows, "text", [(2, "^T", "late"), (1, "^Table", "T1")], "TXT").collect()
    assert [r["tag"] for r in got] == ["TXT", "T1", "TXT"]


def test_notes_keep_reasons(spark):
    rows = [("d", 1, "T1", "BODY", "Table 1", None), ("d", 2, "TXT", "BODY", "Source: x", "old"), ("d", 3, "TXT", "TABLE", "Source: x", None), ("d", 4, "TFN", "BODY", "* a", None)]
    df = spark.createDataFrame(rows, "doc string, pos int, tag string, zone string, text string, repair_reason string")
    got = {r["pos"]: (r["tag"], r["repaired"], r["repair_reason"]) for r in stages.table_notes(df, "doc", "pos").collect()}
    assert got == {1: ("T1", False, None), 2: ("TSN", True, "old;table-source-note"), 3: ("TXT", False, None), 4: ("TFN", False, None)}


def test_overlay_against_characters(spark):
    rows = [("a", 0, 10, "x", 1), ("a", 5, 8, "y", 2), ("a", 8, 12, "x", 0), ("b", 3, 4, "z", 1)]
    df = spark.createDataFrame(rows, "doc string, s int, e int, v string, p int")
    got = {(r["doc"], r["s"], r["e"], r["v"]) for r in spans.overlay(df, ["doc"], "s", "e", "v", "p").collect()}
    assert got == {("a", 0, 5, "x"), ("a", 5, 8, "y"), ("a", 8, 12, "x"), ("b", 3, 4, "z")}


def test_lists_and_numbers(spark):
    rows = [(1, "KT-BL-FIRST", 0, True, "BODY"), (2, "NL-LAST", 0, True, "BODY"), (3, "TXT", 1, True, "BODY"), (4, "TXT", 1, True, "TABLE"), (5, "BL2-MID", 1, True, None), (6, "TXT", None, False, "BODY")]
    df = spark.createDataFrame(rows, "i int, tag string, xml_list_level int, has_bullet boolean, zone string").withColumns({"has_numbering": F.lit(False), "has_xml_list": F.lit(False), "list_style_prefix": F.lit(None).cast("string")})
    assert [r["tag"] for r in stages.kept_lists(df).orderBy("i").collect()] == ["KT-BL-FIRST", "BL-LAST", "BL2-MID", "TXT", "BL2-MID", "TXT"]
    rows = [("d", 1, "TXT", "EXERCISE", "1. What?"), ("d", 2, "odd", "BODY", "plain"), ("d", 3, "TXT", "BACK_MATTER", "(2) Smith"), ("d", 4, "REF-U", "BACK_MATTER", "3) Jones"), ("e", 1, "QUES-TTL", "BODY", "Questions"), ("e", 2, "TXT", "BODY", "Q1. Why?"), ("f", 1, "TXT", "BODY", "1. Alone"), ("g", 1, None, None, None)]
    df = spark.createDataFrame(rows, "doc string, pos int, tag string, zone string, text string")
    got = [(r["doc"], r["pos"], r["tag"]) for r in stages.question_numbers(df, "doc", "pos", {"odd": "EVEN"}).orderBy("doc", "pos").collect()]
    assert got == [("d", 1, "QUES-NL-MID"), ("d", 2, "EVEN"), ("d", 3, "REF-N"), ("d", 4, "REF-U"), ("e", 1, "QUES-TTL"), ("e", 2, "QUES-NL-MID"), ("f", 1, "TXT"), ("g", 1, None)]
