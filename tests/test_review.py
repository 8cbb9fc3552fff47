"""Review rules and page search on cases with nulls, ties and no match."""

from pyspark.sql import functions as F

from vellum.functions import references
from vellum.functions import text as T
from vellum.operators import joins, review


def test_nulls_count_as_absent(spark):
    no = F.lit(None).cast("string")
    none = F.lit(None).cast("boolean")
    row = spark.range(1).select(
        review.keeps_list_style(none, none, no).alias("a"), review.keeps_list_style(F.lit(True), none, no).alias("b"), review.keeps_heading_style(F.lit(None).cast("int"), no, none, no).alias("c"),
        review.keeps_heading_style(F.lit(0), no, none, no).alias("d"), review.needs_review(no, no, none, F.lit(None).cast("int")).alias("e"), review.list_tag(no, F.lit("MID"), no, no, none, no).alias("f"),
        review.aligned_position(no, no, F.array(F.lit("TXT"))).alias("g"), review.heading_variant(no, no, no).alias("h"),
    ).first()
    assert tuple(row) == (False, True, False, True, False, None, None, None)


def test_features_of_nothing(spark):
    no = F.lit(None).cast("string")
    f = spark.range(1).select(T.paragraph_features(no, no, no, no).alias("f")).first().f
    assert (f.length, f.word_count, f.is_empty, f.is_short, f.looks_like_heading, f.looks_like_reference, f.zone) == (0, 0, True, True, False, False, "BODY")


def test_paragraph_features(spark):
    rows = [("Aims and Scope of the Study",), ("1. Smith J. Title. 2019;3:4.",), ("a) see note",), ("FIGURE 2: MAP",), ("Smith et al., in press.",)]
    no = F.lit(None).cast("string")
    f = [r.f for r in spark.createDataFrame(rows, "t string").coalesce(1).select(T.paragraph_features(F.col("t"), F.lit("BOX_BX1"), no, no).alias("f")).collect()]
    assert [x.looks_like_heading for x in f] == [True, False, False, True, False]
    assert [x.looks_like_reference for x in f] == [False, True, False, False, True]
    assert [x.looks_like_footnote for x in f] == [False, False, True, False, False]
    assert [x.is_all_caps for x in f] == [False, False, False, True, False] and f[3].looks_like_caption and all(x.is_in_box for x in f)


def test_display_authors(spark):
    cases = {"Smith, J., Jones, K.": "Smith & Jones", "A B": "A & B", "Smith, Jones, Brown": "Smith et al.", "J. Smith et al": "J. Smith et al.", "": "", "[x]": ""}
    got = spark.createDataFrame([(k,) for k in cases], "a string").select("a", references.display_authors(F.col("a"), F.lit(None).cast("boolean")).alias("d")).collect()
    assert {r.a: r.d for r in got} == cases


def test_first_page(spark):
    pages = spark.createDataFrame([(1, 1, "One two"), (1, 2, "THREE, four."), (1, 3, "three four"), (2, 1, None)], "doc int, page int, body string")
    said = spark.createDataFrame([(1, "Three-four"), (1, "Three-four"), (1, "five"), (1, "..."), (2, "one"), (3, "one"), (1, None)], "doc int, said string")
    got = joins.first_page(said, pages, ["doc"], "said", "page", "body")
    assert got.count() == 6
    assert {(r.doc, r.said): r.page for r in got.collect()} == {(1, "Three-four"): 2, (1, "five"): None, (1, "..."): 1, (2, "one"): None, (3, "one"): None, (1, None): None}
