"""Named queries on reference lines, made up from customers and orders, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import references as R
from ..sources.tables import table
from .catalogue import query

#: A line for each order: authors by its number, year by its date.
_NAMES = [("Smith", "J"), ("Jones", "K"), ("Ayers", "S"), ("Barrett", "L")]


def _lines(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").cast("string").alias("year"), (F.col("o_orderkey") % 4 + 1).cast("int").alias("n"))
    ama = F.array_join(F.slice(F.array(*(F.lit(f"{a} {b}") for a, b in _NAMES)), F.lit(1), F.col("n")), ", ")
    return o.select("o_orderkey", "year", "n", F.concat(F.lit("12. "), ama, F.lit(". Title k"), F.col("o_orderkey").cast("string"), F.lit(". Journal of Orders. "), "year", F.lit(";3(2):1-9.")).alias("line"))


_L = "l AS (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS year, o_orderkey % 4 + 1 AS n FROM orders)"


@query(f"""WITH {_L}, a AS (SELECT *, array_to_string(['Smith, J.', 'Jones, K.', 'Ayers, S.', 'Barrett, L.'][1:n - 1], ', ') AS head, ['Smith, J.', 'Jones, K.', 'Ayers, S.', 'Barrett, L.'][n] AS tail FROM l)
SELECT o_orderkey, CASE WHEN n = 1 THEN tail ELSE head || ', & ' || tail END || ' (' || year || '). Title k' || o_orderkey || '. Journal of Orders.' AS apa, 'AMA' AS style, 12 AS label FROM a""")
def ama_to_apa(spark, d):
    p = _lines(spark, d).withColumn("p", R.parsed_ama(F.col("line")))
    return p.select("o_orderkey", R.apa_text(R.ama_authors(F.col("p.authors")), F.col("p.year"), F.col("p.title"), F.col("p.journal")).alias("apa"), R.style(F.col("line")).alias("style"), R.number_prefix(F.col("line"))["number"].alias("label"))


@query(f"""WITH {_L} SELECT o_orderkey, array_to_string(['Smith J', 'Jones K', 'Ayers S', 'Barrett L'][1:n], ', ') || '. Title k' || o_orderkey || '. Journal of Orders. ' || year || '.' AS ama, CAST(n AS INTEGER) AS people, 'APA' AS style FROM l""")
def apa_to_ama(spark, d):
    p = ama_to_apa(spark, d).select("o_orderkey", R.parsed_apa(F.col("apa")).alias("p"), R.style(F.col("apa")).alias("style"))
    people = R.authors(F.col("p.authors"))
    return p.select("o_orderkey", R.ama_text(people, F.col("p.year"), F.col("p.title"), F.col("p.journal")).alias("ama"), F.size(people).alias("people"), "style")


@query("""SELECT o_orderkey, (o_orderkey % 130) || CASE WHEN o_orderkey % 130 % 100 BETWEEN 11 AND 13 THEN 'th' WHEN o_orderkey % 10 = 1 THEN 'st' WHEN o_orderkey % 10 = 2 THEN 'nd' WHEN o_orderkey % 10 = 3 THEN 'rd' ELSE 'th' END AS edition,
CASE o_orderkey % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'book' ELSE 'journal' END AS kind FROM orders""")
def editions(spark, d):
    o = table(spark, d, "orders").select("o_orderkey")
    line = F.element_at(F.array(F.lit("See https://a.b"), F.lit("Own Press, 2nd edition"), F.lit("Journal 3")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select("o_orderkey", R.ordinal((F.col("o_orderkey") % 130).cast("string")).alias("edition"), R.source_kind(line).alias("kind"))
