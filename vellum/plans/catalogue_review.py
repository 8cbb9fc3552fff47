"""Named queries of review rules, paragraph features, author forms and page search, each with its DuckDB counterpart."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import references
from ..functions import text as T
from ..operators import joins, review
from ..sources.tables import table
from .catalogue import events, query

_TAGS = ["BL-MID", "KT-NL-FIRST", "TXT", "H1", "H20", "TBL-MID", "T2", "REF-N", "BIB", "EOC-LL2-MID", "BX1-UL-LAST", "BUL1", "REFH1", "tfn"]
_TEXTS = ["<H1>Aims", "<h2 x>Ends", "Plain words", " <H2>Methods", "<H2> gap", "<p>none"]
_STYLES = ["Heading 2", "Heading 3", "Normal", "Title", "Heading 1"]
_ZONES = ["BODY", "TABLE", "BOX_BX2", "REFERENCE", "BOX_NBX"]
_AUTHORS = ["Smith, J., Jones, K.", "Smith & Jones", "Smith, Jones, & Brown", "Smith et al", "World Health Organization", "J. K.", "Smith [see note]", "Lee, Kim et al.", "van der Berg", "Adams, B. C.", "", "a b"]


def _pick(values: list[str], n: int, name: str) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.col("event_id") / n) % len(values) + 1).cast("int")).alias(name)


def _chosen(values: list[str], n: int, name: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST(event_id // {n} % {len(values)} + 1 AS INT)] AS {name}"


_FACTS = f"""r AS (SELECT event_id, {_chosen(_TAGS, 1, "tag")}, {_chosen(_TEXTS, 3, "text")}, {_chosen(_STYLES, 2, "style")}, {_chosen(_ZONES, 5, "zone")}, {_chosen(["bullet", "numbered", "unordered", ""], 7, "kind")}, {_chosen(["FIRST", "MID", "LAST", "last ", ""], 11, "place")} FROM events)"""


def _facts(spark, d):
    cols = (_pick(_TAGS, 1, "tag"), _pick(_TEXTS, 3, "text"), _pick(_STYLES, 2, "style"), _pick(_ZONES, 5, "zone"), _pick(["bullet", "numbered", "unordered", ""], 7, "kind"), _pick(["FIRST", "MID", "LAST", "last ", ""], 11, "place"))
    return events(spark, d).select("event_id", *cols)


_ALLOWED = ["BL-MID", "BL-FIRST", "KT-NL-MID", "EOC-LL2-MID", "EOC-LL2-LAST", "TBL-MID"]
_PREFIX = "CASE tag WHEN 'KT-NL-FIRST' THEN 'KT-NL' WHEN 'BX1-UL-LAST' THEN 'BX1-UL' ELSE CASE WHEN zone = 'TABLE' THEN CASE kind WHEN 'bullet' THEN 'TBL' WHEN 'numbered' THEN 'TNL' ELSE CASE WHEN event_id % 2 = 0 THEN 'TBL' ELSE 'TUL' END END WHEN zone LIKE 'BOX%' THEN CASE zone WHEN 'BOX_BX2' THEN 'BX2-' ELSE 'NBX-' END || CASE kind WHEN 'bullet' THEN 'BL' WHEN 'numbered' THEN 'NL' ELSE 'UL' END WHEN kind = 'bullet' OR (kind = 'unordered' AND event_id % 2 = 0) THEN 'BL' WHEN kind = 'numbered' THEN 'NL' ELSE 'UL' END END"


_WS = "\\s\\x{0B}\\x{85}\\p{Z}"
_YEAR = "regexp_matches(text, '(^|[^\\p{L}\\p{N}_])(19|20)[0-9]{2}([^\\p{L}\\p{N}_]|$)')"


@query(f"""WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '^[{_WS}]+|[{_WS}]+$', '', 'g') AS s FROM documents),
w AS (SELECT *, len(regexp_extract_all(text, '[^{_WS}]+')) AS word_count, regexp_matches(s, '^([0-9]+[.)]|\\([0-9]+\\)|\\[[0-9]+\\])\\s') AS num, regexp_matches(s, '^[•●*–—-]\\s') AS bul, CASE doc_id % 4 WHEN 0 THEN 'TABLE' WHEN 1 THEN 'BOX_BX1' WHEN 2 THEN 'BACK_MATTER' ELSE 'BODY' END AS zone FROM t)
SELECT doc_id, length(text) AS length, word_count, s = '' AS is_empty, length(s) < 50 AS is_short, length(s) > 500 AS is_long, num AS has_number_prefix, regexp_matches(s, '^([A-Za-z][.)]|\\([A-Za-z]\\))\\s') AS has_letter_prefix,
regexp_matches(s, '(?i)^([ivxlcdm]+[.)]|\\([ivxlcdm]+\\))\\s') AS has_roman_prefix, bul AS has_bullet, regexp_full_match(s, '[A-Z0-9 \\t\\n\\r\\f,.:;!?''"-]+') AS is_all_caps, regexp_matches(s, '^\\p{{Nd}}') AS starts_with_digit, suffix(s, '.') AS ends_with_period, suffix(s, ':') AS ends_with_colon,
{_YEAR} AS has_citation_year, s <> '' AND length(s) <= 200 AND right(s, 1) NOT IN ('.', '!', '?') AND len(regexp_extract_all(s, '(^|[{_WS}])\\p{{Lu}}')) >= greatest(1, floor(CAST(0.6 AS DOUBLE) * word_count)) AS looks_like_heading,
regexp_matches(lower(s), '^(figure|table|fig\\.|tab\\.)') AS looks_like_caption, s <> '' AND (num OR bul OR (({_YEAR} OR contains(lower(s), 'doi') OR contains(lower(s), 'et al')) AND len(regexp_extract_all(text, '[.;:,]')) >= 2)) AS looks_like_reference,
regexp_matches(s, '^([*†‡]|[a-z]\\))') AS looks_like_footnote, zone, zone = 'TABLE' AS is_in_table, zone = 'BOX_BX1' AS is_in_box, zone = 'BACK_MATTER' AS is_in_back_matter, lang AS list_kind, source AS list_position FROM w""")
def paragraph_features(spark, d):
    zone = F.when(F.col("doc_id") % 4 == 0, "TABLE").when(F.col("doc_id") % 4 == 1, "BOX_BX1").when(F.col("doc_id") % 4 == 2, "BACK_MATTER")
    return table(spark, d, "documents").select("doc_id", T.paragraph_features(F.col("text"), zone, F.col("lang"), F.col("source")).alias("f")).select("doc_id", "f.*")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents), p AS (SELECT doc_id, pos // 20 + 1 AS page, string_agg(line, ' ' ORDER BY pos) AS body, arg_max(line, pos) AS sentence FROM l GROUP BY ALL),
c AS (SELECT doc_id, page, lower(regexp_replace(body, '[^\\p{L}\\p{N}]+', '', 'g')) AS body FROM p), s AS (SELECT DISTINCT doc_id, sentence, left(lower(regexp_replace(sentence, '[^\\p{L}\\p{N}]+', '', 'g')), 60) AS start FROM p)
SELECT s.doc_id, sentence, min(page) AS page FROM s LEFT JOIN c ON s.doc_id = c.doc_id AND contains(body, start) GROUP BY s.doc_id, sentence""")
def page_search(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).withColumn("page", (F.floor(F.col("pos") / 20) + 1).cast("long"))
    parts = lines.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("p"))
    pages = parts.select("doc_id", "page", F.array_join(F.col("p.line"), " ").alias("body"), F.element_at("p.line", -1).alias("sentence"))
    return joins.first_page(pages, pages, ["doc_id"], "sentence", "page", "body")
