"""Named queries of document structure over the lines of ``documents`` and ``pages``: validation and repair."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import annotate, boxes, lists, repair, stages
from ..sources.tables import table
from .catalogue import SQL, query

#: A vocabulary, what zones allow, and aliases, as a publisher's set-up would give them.
VOCABULARY = (
    "H1 H2 H3 TXT TXT-FLUSH BL-FIRST BL-MID BL-LAST NL-FIRST NL-MID NL-LAST UL-MID KT-BL-FIRST KT-BL-MID T T1 T2 T4 TD TH1 TH2 TFN TSN TBL-FIRST TBL-MID TBL-LAST FIG-LEG PMI REF-N REF-U REFH1 REFH2 SR SRH1 "
    "BIB BM-TTL CT CN NBX-TYPE NBX-TTL NBX-TXT BX1-TXT H10 H20 H21"
).split()
ZONES = {
    "TABLE": "T T1 T2 T4 TD TH1 TH2 TFN TSN TBL-FIRST TBL-MID TBL-LAST PMI".split(),
    "BACK_MATTER": "REF-N REF-U REFH1 REFH2 SR SRH1 BIB BM-TTL FIG-LEG T1 TFN TSN TXT TXT-FLUSH PMI H1 H2 H3 BL-FIRST BL-MID BL-LAST NL-FIRST NL-MID NL-LAST".split(),
    "BOX_NBX": ["NBX-TXT", "NBX-TTL", "NBX-TYPE", "NBX-BL-FIRST", "NBX-BL-MID", "NBX-BL-LAST"],
}
ALIASES = {"REF_N": "REF-N", "BULLET": "BL-MID", "HEAD1": "H1"}
#: Tags of a rough classifier, by a line's length: some are right, some composite, unknown or of another zone.
GUESSES = "TXT H2 BL-MID TXT H4 REF_N SK_H1 H3 KT-BL-LAST TXT/H1 FIG-LEG TXT-FLUSH H1 T1 SRH1 NL-FIRST H5 BULLET TFN XX-BL".split()


def lines(spark, d):
    """Lines of all documents: (doc_id, pos, line, words, n characters, last: place of the last line)."""
    split = F.posexplode(F.split("text", "\n")).alias("pos", "line")
    out = table(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("of"), split)
    return out.withColumns({"words": F.size(F.filter(F.split("line", " "), lambda w: w != "")), "n": F.length("line")})


def tagged_lines(spark, d):
    """Lines with the guess of a rough classifier and the facts that repair reads, all from what stands in the line."""
    n, line, words = F.col("n"), F.col("line"), F.col("words")
    table_row = F.contains(line, F.lit(" | "))
    late = F.col("pos") * 4 >= F.col("of") * 3
    zone = F.when(table_row, "TABLE").when(late & (F.col("of") >= 4), "BACK_MATTER").when((n % 13 == 0) & (words > 3), "BOX_NBX").when(n % 29 == 1, "METADATA").otherwise("BODY")
    guess = F.element_at(F.array(*map(F.lit, GUESSES)), (n % len(GUESSES) + 1).cast("int"))
    tag = F.when(table_row, F.when(n % 3 == 0, "TBL-TXT").otherwise("TXT")).when((words <= 6) & (n % 2 == 0), F.concat(F.lit("H"), (words % 6 + 1).cast("string"))).otherwise(guess)
    text = F.when(n % 17 == 3, F.concat(F.lit("<H2>"), line)).when(n % 31 == 5, F.concat(F.lit("<REF>References"))).when(n % 19 == 7, F.concat(F.lit("• "), line)).when(n % 23 == 2, "</BL>").otherwise(line)
    return lines(spark, d).select(
        "doc_id", "pos", text.alias("text"), tag.alias("tag"), (F.lit(0.5) + n % 50 / 100).alias("confidence"), zone.alias("zone"), F.when(words % 2 == 0, "Heading 2").otherwise("Heading 3").alias("style"),
        F.when(words % 5 == 1, "bullet").when(words % 5 == 2, "numbered").when(words % 5 == 3, "other").alias("list_kind"), F.element_at(F.array(*map(F.lit, ("FIRST", "MID", "LAST"))), (n % 3 + 1).cast("int")).alias("list_position"),
        (n % 2 == 0).alias("has_bullet"), (late & (n % 4 == 1)).alias("in_reference"), (words <= 8).alias("is_header_row"), (n % 7 == 0).alias("is_stub_col"), F.when(n % 37 == 4, "figure").alias("caption_type"), (n % 41 == 6).alias("box_title"),
    )


@query()
def validate_repair(spark, d):
    """Every line of every document through all rules and passes. A plain row-by-row model is the test's counterpart."""
    return repair.validated(tagged_lines(spark, d), "doc_id", "pos", VOCABULARY, ZONES, lambda c: stages.style_aliases(c, ALIASES))


#: Pieces of pages' HTML: (page_id, pos, tag, t: text after the tag), and list rows made of them as the tags have it.
_PIECES = """SELECT page_id, i AS pos, regexp_extract(p, '^([a-z0-9]+)', 1) AS tag, substr(p, strpos(p, '>') + 1) AS t FROM (SELECT page_id, unnest(string_split(html, '<')) AS p, generate_subscripts(string_split(html, '<'), 1) - 1 AS i FROM pages)
WHERE regexp_matches(p, '^(li|a|h1|p|b|footer|div)[ >]') AND trim(substr(p, strpos(p, '>') + 1)) <> ''"""
_LIST_ROWS = """CASE WHEN tag = 'h1' THEN '<h1>' || t WHEN tag = 'a' THEN repeat(' ', length(t) % 3 * 4) || '• ' || t || CASE WHEN length(t) % 4 = 1 THEN ':' ELSE '' END
WHEN tag = 'p' AND length(t) % 5 < 3 THEN repeat(chr(9), length(t) % 3) || (length(t) % 9 + 1) || '. ' || t WHEN tag = 'b' AND length(t) % 2 = 0 THEN repeat(' ', length(t) % 9) || 'o Types : ' || t ELSE t END"""


def list_rows(spark, d):
    piece = F.posexplode(F.split("html", "<")).alias("pos", "p")
    rows = table(spark, d, "pages").select("page_id", piece).filter(F.col("p").rlike("^(li|a|h1|p|b|footer|div)[ >]"))
    rows = rows.select("page_id", "pos", F.regexp_extract("p", "^([a-z0-9]+)", 1).alias("tag"), F.expr("substring(p, instr(p, '>') + 1)").alias("t")).filter(F.trim("t") != "")
    t, n, tag = F.col("t"), F.length("t"), F.col("tag")
    text = (
        F.when(tag == "h1", F.concat(F.lit("<h1>"), t))
        .when(tag == "a", F.concat(F.expr("repeat(' ', length(t) % 3 * 4)"), F.lit("• "), t, F.when(n % 4 == 1, ":").otherwise("")))
        .when((tag == "p") & (n % 5 < 3), F.concat(F.expr("repeat(char(9), length(t) % 3)"), (n % 9 + 1).cast("string"), F.lit(". "), t))
        .when((tag == "b") & (n % 2 == 0), F.concat(F.expr("repeat(' ', length(t) % 9)"), F.lit("o Types : "), t))
        .otherwise(t)
    )
    return rows.select("page_id", "pos", "tag", text.alias("text"))


_ITEMS = f"""r AS (SELECT page_id, pos, tag, {_LIST_ROWS} AS text FROM ({_PIECES})), s AS (SELECT *, regexp_replace(text, '^\\s+', '') AS s FROM r),
i AS (SELECT *, starts_with(lower(text), '<h') AS heading, CASE WHEN regexp_matches(s, '^[•\\-–—·●]') THEN left(s, 1) WHEN regexp_matches(s, '^o[ \\t]') THEN '○' END AS bullet,
CASE WHEN regexp_matches(s, '^[0-9]+\\.\\s') THEN 'decimal' WHEN regexp_matches(s, '^[0-9]+\\)\\s') THEN 'decimal_paren' WHEN regexp_matches(s, '^\\([0-9]+\\)\\s') THEN 'decimal_both' WHEN regexp_matches(s, '^[A-Z]\\.\\s') THEN 'upper_alpha'
WHEN regexp_matches(s, '^[a-z]\\.\\s') THEN 'lower_alpha' WHEN regexp_matches(s, '^[a-z]\\)\\s') THEN 'lower_alpha_paren' WHEN regexp_matches(s, '^[IVXLCDM]+\\.\\s') THEN 'upper_roman' WHEN regexp_matches(s, '^[ivxlcdm]+\\.\\s') THEN 'lower_roman' END AS number_format,
length(regexp_extract(text, '^[\\t ]*')) AS blanks, length(replace(regexp_extract(text, '^[\\t ]*'), ' ', '')) AS tabs, regexp_replace(regexp_replace(s, '^[•\\-–—·●]\\s*', ''), '^[\\pL\\pN_]+[.)]\\s*', '') AS bare FROM s),
l AS (SELECT *, bullet IS NOT NULL OR number_format IS NOT NULL AS is_list, CASE WHEN bullet IS NOT NULL OR number_format IS NOT NULL THEN least(2, tabs + (blanks - tabs) // 4) END AS level,
regexp_matches(lower(trim(bare)), '^(grading\\b|work-?up\\b|diagnosis\\s*:|symptoms\\s*:|classification\\s*:|characteristics\\s*:|second-?line\\s+therap|third-?line|differential\\s+diagnosis|management\\s*:|treatment\\s*:|types\\s*:|categories\\s*:)')
OR (length(bare) < 60 AND regexp_matches(bare, ':\\s*$')) OR regexp_matches(bare, '\\([A-Z]+\\s*[0-9.]+\\)\\s*$') AS trigger FROM i),
e AS (SELECT *, CASE WHEN heading OR level = 0 THEN 0 WHEN level = 1 AND trigger THEN 1 END AS event FROM l),
c AS (SELECT *, CASE WHEN is_list THEN CASE WHEN level = 1 AND NOT trigger AND NOT heading AND last_value(event IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 1 THEN 2 ELSE level END END AS semantic_level FROM e)"""


@query(f"""WITH {_ITEMS} SELECT page_id, pos, is_list, bullet, number_format, level::INTEGER AS indent_level, semantic_level::INTEGER AS semantic_level,
CASE WHEN is_list THEN CASE WHEN number_format IS NOT NULL THEN 'NL' ELSE 'BL' END || CASE WHEN semantic_level = 0 THEN '' ELSE (semantic_level + 1)::VARCHAR END || '-' END AS list_style_prefix FROM c""")
def list_hierarchy(spark, d):
    """List facts of all pages' rows; levels under parent items."""
    rows = list_rows(spark, d)
    out = lists.hierarchy(rows, "page_id", "pos", F.startswith(F.lower("text"), F.lit("<h")), chunk=F.floor(F.col("pos") / 16))
    return out.select("page_id", F.col("pos").cast("long"), "is_list", "bullet", "number_format", "indent_level", "semantic_level", "list_style_prefix")


@query(f"""WITH {_ITEMS}, n AS (SELECT page_id, pos, CASE WHEN heading THEN 0 WHEN is_list THEN semantic_level + 1 ELSE 4 END AS depth FROM c)
SELECT a.page_id, a.pos, a.depth::INTEGER AS depth, max(b.pos) AS parent FROM n a LEFT JOIN n b ON b.page_id = a.page_id AND b.pos < a.pos AND b.depth < a.depth GROUP BY ALL""")
def list_parents(spark, d):
    """The nearest earlier row of a smaller level: headings, then items by level, then text. SQL: a quadratic self-join."""
    rows = lists.hierarchy(list_rows(spark, d), "page_id", "pos", F.startswith(F.lower("text"), F.lit("<h")))
    depth = F.when(F.startswith(F.lower("text"), F.lit("<h")), 0).when(F.col("is_list"), F.col("semantic_level") + 1).otherwise(4)
    out = lists.parents(rows.withColumn("depth", depth), "page_id", "pos", "depth", 4, chunk=F.floor(F.col("pos") / 16))
    return out.select("page_id", F.col("pos").cast("long"), "depth", F.col("parent").cast("long"))


_BOX_ROWS = """r AS (SELECT doc_id, i - 1 AS pos, x AS line, length(x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
b AS (SELECT doc_id, pos, n, CASE WHEN n % 11 = 3 THEN '<BX>' || line WHEN n % 13 = 4 THEN '</BX>' || line WHEN n % 7 = 5 THEN 'Source: ' || line WHEN n % 37 = 6 THEN 'Chapter 3 ' || line WHEN n % 29 = 7 THEN 'Figure 2.1 ' || line
WHEN n % 9 = 8 THEN 'Adapted from ' || line WHEN n % 17 = 1 THEN line || ' (Courtesy of ' || left(line, 20) || ')' WHEN n % 19 = 2 THEN '*' || line || '*' ELSE line END AS text, contains(line, ' | ') AS tab FROM r),
a AS (SELECT *, coalesce(lead(tab) OVER w, false) AND NOT tab AS before_table, coalesce(lag(tab) OVER w, false) AND NOT tab AS after_table FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY pos))"""
_WORD = "(?i)\\b(source|sources|courtesy|permission|reprinted|reproduced|adapted|modified|copyright|data from|information from)\\b|©"
_PAREN = "^(.*?)\\s*(\\([^()]*(?:\\([^()]*\\)[^()]*)*\\))\\.?$"


def _sql_credit(text: str) -> str:
    """SQL of ``checks.split_credit(...).credit`` without asterisks and underscores at its ends."""
    s = f"trim(regexp_replace({text}, '\\s+', ' ', 'g'))"
    forms = ["[.!?]\\s+((?i:reprinted|redrawn|reproduced|recreated|adapted|modified|used|from|courtesy)\\b.*)$", "((?i:sources?\\s*:).*)$", "\\b((?i:adapted|modified|reproduced|reprinted|based)\\s+(?i:with\\s+permission\\s+)?(?i:from|on|of)\\s+.*)$"]
    each = ", ".join(f"CASE WHEN regexp_matches({s}, '{p}') THEN {{'p': instr({s}, regexp_extract({s}, '{p}', 1)), 'c': trim(regexp_extract({s}, '{p}', 1))}} END" for p in forms)
    inline = f"(list_sort(list_filter([{each}], lambda v: v IS NOT NULL))[1]).c"
    whole = f"CASE WHEN NOT regexp_matches({s}, '{_WORD}') THEN '' WHEN regexp_matches({s}, '(?i)^(sources?|information from|data from)\\b\\s*:?') THEN {s} WHEN regexp_matches(regexp_extract({s}, '{_PAREN}', 2), '{_WORD}') THEN regexp_extract({s}, '{_PAREN}', 2) ELSE coalesce({inline}, '') END"
    return f"nullif(regexp_replace({whole}, '^[*_]+|[*_]+$', '', 'g'), '')"


def _risk(caption: str, credit: str) -> str:
    return f"regexp_matches(coalesce(nullif({credit}, ''), {caption}), '(?i)(reprinted|reproduced|adapted|courtesy|permission|copyright|©)')"


_STAR = "'^[*_]+|[*_]+$', '', 'g'"


@query(f"""WITH {_BOX_ROWS}, s AS (SELECT *, regexp_matches(text, '{boxes.START}') AS st, sum(regexp_matches(text, '{boxes.START}')::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS span FROM a),
o AS (SELECT *, bool_or(regexp_matches(text, '{boxes.END}') OR (regexp_matches(text, '{boxes.CHAPTER}') AND NOT st)) OVER (PARTITION BY doc_id, span ORDER BY pos) AS over_, trim(regexp_replace(regexp_replace(text, '{boxes.START}', '', 'g'), '{boxes.END}', '', 'g')) AS line FROM s WHERE span > 0),
l AS (SELECT *, count(*) FILTER (WHERE NOT over_ AND line <> '') OVER (PARTITION BY doc_id, span ORDER BY pos) AS k, CASE WHEN NOT over_ AND line <> '' THEN {_sql_credit("line")} END AS credit FROM o),
ta AS (SELECT doc_id, min(pos) AS pos, trim(regexp_replace(arg_min(line, pos) FILTER (WHERE NOT over_ AND line <> ''), {_STAR})) AS caption, arg_min(credit, pos) FILTER (WHERE k > 1 AND credit IS NOT NULL) AS credit FROM l GROUP BY doc_id, span),
u AS (SELECT *, trim(regexp_replace(trim(text), {_STAR})) AS bare, regexp_matches(text, '{boxes.CAPTION}') AS cap, regexp_matches(text, '{boxes.CHAPTER}') AS chap FROM a),
v AS (SELECT *, CASE WHEN bare <> '' THEN CASE WHEN regexp_matches(bare, '{boxes.CHAPTER}') OR regexp_matches(bare, '{boxes.CAPTION}') OR regexp_matches(bare, '{boxes.CREDIT_ALONE}') THEN '' WHEN length(bare) <= 200 THEN bare END END AS seen FROM u),
w AS (SELECT *, coalesce(first_value(CASE WHEN before_table OR cap OR chap THEN before_table END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 14 FOLLOWING), false) AS foot,
coalesce(bool_or(cap) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), false) AS capped, last_value(seen IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 14 PRECEDING AND 1 PRECEDING) AS caption FROM v),
un AS (SELECT doc_id, pos, caption, {_sql_credit("text")} AS credit FROM w WHERE regexp_matches(text, '{boxes.CREDIT_ALONE}') AND NOT regexp_matches(text, '{boxes.START}') AND NOT after_table AND NOT foot AND NOT capped AND caption <> '')
SELECT doc_id, pos, caption, credit, true AS tagged, {_risk("caption", "credit")} AS needs_permission FROM ta WHERE caption <> '' AND credit IS NOT NULL
UNION ALL SELECT doc_id, pos, caption, credit, false, {_risk("caption", "credit")} FROM un WHERE credit IS NOT NULL""")
def box_log(spark, d):
    """Tagged and untagged boxes with a credit in all documents' lines; tags, credits and captions follow from a line's length."""
    from pyspark.sql import Window

    n, line = F.col("n"), F.col("line")
    join = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))
    text = (
        F.when(n % 11 == 3, join("<BX>", line)).when(n % 13 == 4, join("</BX>", line)).when(n % 7 == 5, join("Source: ", line)).when(n % 37 == 6, join("Chapter 3 ", line)).when(n % 29 == 7, join("Figure 2.1 ", line))
        .when(n % 9 == 8, join("Adapted from ", line)).when(n % 17 == 1, join(line, " (Courtesy of ", F.left(line, F.lit(20)), ")")).when(n % 19 == 2, join("*", line, "*")).otherwise(line)
    )
    rows = lines(spark, d).select("doc_id", "pos", text.alias("text"), F.contains(line, F.lit(" | ")).alias("tab"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    side = lambda c: F.coalesce(c, F.lit(False)) & ~F.col("tab")
    rows = rows.withColumns({"before_table": side(F.lead("tab").over(order)), "after_table": side(F.lag("tab").over(order))})
    return boxes.boxes(rows, "doc_id", "pos").select("doc_id", F.col("pos").cast("long"), "caption", "credit", "tagged", "needs_permission")


#: Rules and block markers, as a rule file gives them.
RULES = [
    (r"Chapter\s+\d+", "CN", "CN"), (r"Table\s+\d+", "T1", "T1"), (r"[A-Z][A-Z !]{6,}$", "H1", "H1"), (r"By\s", "CAU", "CAU"), (r"[^ ]+ [^ ]+$", "H2", "H2"), (r"References$", "REFH1", "REFH1"), (r"—", "EPI-ATT", "EPI-ATT"), (r"Abstract", "ABS", "ABS"),
]
MARKERS = {"Learning Objectives": annotate.OBJECTIVES, "References": annotate.REFERENCES, "Summary": "SUMMARY_BLOCK"}
_ANNOTATED_TEXT = """CASE WHEN n % 31 = 1 THEN 'Chapter 4' WHEN n % 29 = 2 THEN 'Learning Objectives' WHEN n % 23 = 3 THEN 'References' WHEN n % 37 = 4 THEN 'Summary' WHEN n % 17 = 5 THEN '<H2>' || line WHEN n % 41 = 6 THEN '<CN>References'
WHEN n % 13 = 7 THEN '“' || line WHEN n % 11 = 8 THEN '[3] ' || line WHEN n % 43 = 9 THEN 'Table 2 ' || line WHEN n % 19 = 10 THEN '— ' || line WHEN n % 47 = 11 THEN 'Abstract' WHEN n % 53 = 12 THEN '' WHEN n % 12 = 1 THEN split_part(line, ' ', 1) || ' ' || split_part(line, ' ', 2) ELSE line END"""


@query(f"""WITH RECURSIVE l AS (SELECT doc_id, i - 1 AS pos, x AS line, length(x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
r AS (SELECT doc_id, pos, n, trim({_ANNOTATED_TEXT}) AS whole, n % 4 = 0 AS is_list, CASE WHEN n % 8 = 0 THEN 'Bullet List' ELSE '' END AS style FROM l),
x AS (SELECT *, regexp_extract(whole, '^<([A-Z0-9-]+)>', 1) AS ex, CASE WHEN regexp_matches(whole, '^<[A-Z0-9-]+>') THEN trim(regexp_replace(whole, '^<[A-Z0-9-]+>', '')) ELSE whole END AS t FROM r),
f AS (SELECT *, CASE t WHEN 'Learning Objectives' THEN 'LEARNING_OBJECTIVES_BLOCK' WHEN 'References' THEN 'REFERENCES_BLOCK' WHEN 'Summary' THEN 'SUMMARY_BLOCK' END AS mk, regexp_matches(t, '{annotate.REFERENCES_END}') AS ends,
CASE WHEN ex <> '' THEN ex WHEN is_list THEN CASE WHEN regexp_matches(t, '^\\s*[0-9]+[.)]') THEN 'NL-MID' WHEN style = 'Bullet List' OR regexp_matches(t, '^[•–-]') THEN 'BL-MID' ELSE 'NL-MID' END
{' '.join(f"WHEN regexp_matches(t, '^(?:{p})') THEN '{tag}'" for p, tag, _ in RULES)} END AS own FROM x),
s AS (SELECT doc_id, -1::BIGINT AS pos, NULL::VARCHAR AS block, false AS opening, ''::VARCHAR AS prev, ''::VARCHAR AS tag FROM (SELECT DISTINCT doc_id FROM f)
UNION ALL SELECT doc_id, pos, block, opening, CASE WHEN whole = '' THEN prev ELSE tag END, tag FROM (
 SELECT *, CASE WHEN whole = '' THEN 'EMPTY' WHEN opening AND tag2 = 'TXT' THEN CASE WHEN NOT regexp_matches(t, '^[“"]') AND regexp_matches(t, '^[—–-]') THEN 'EPI-ATT' ELSE 'EPI' END WHEN tag2 = 'TXT' AND prev IN ('H1', 'H2', 'H3') THEN 'TXT-FLUSH' ELSE tag2 END AS tag FROM (
 SELECT doc_id, pos, t, whole, prev, tag2, block3 AS block, CASE WHEN whole = '' THEN opening WHEN tag2 IN ('CN', 'CT', 'CAU') THEN true WHEN tag2 IN ('H1', 'H2', 'H3', 'OBJ1', 'ABS') THEN false ELSE opening END AS opening FROM (
 SELECT *, CASE WHEN whole = '' THEN block0 WHEN is_l THEN block1 WHEN tag1 IN ('H1', 'H2', 'H3', 'H4', 'CT', 'CN', 'OBJ1', 'REFH1') AND NOT coalesce(block1 = mk, false) THEN NULL ELSE block1 END AS block3,
 CASE WHEN whole = '' THEN '' WHEN is_l THEN CASE block1 WHEN 'LEARNING_OBJECTIVES_BLOCK' THEN 'OBJ-BL-MID' WHEN 'REFERENCES_BLOCK' THEN CASE WHEN regexp_matches(t, '^\\[[0-9]+\\]|^[0-9]+\\.') THEN 'REF' ELSE 'BODY_TEXT' END ELSE own END
 WHEN tag1 IS NOT NULL THEN tag1 WHEN block1 = 'LEARNING_OBJECTIVES_BLOCK' THEN 'OBJ-TXT' WHEN block1 = 'REFERENCES_BLOCK' THEN 'REF-TXT' WHEN block1 IS NOT NULL THEN block1 || '_TXT' ELSE 'TXT' END AS tag2 FROM (
 SELECT f.*, s.opening, s.prev, s.block AS block0, f.ex = '' AND f.is_list AS is_l, CASE WHEN f.ex = '' AND f.mk IS NOT NULL THEN f.mk WHEN s.block = 'REFERENCES_BLOCK' AND f.ends THEN NULL ELSE s.block END AS block1,
 CASE WHEN f.ex = '' AND s.prev = 'CN' THEN 'CT' ELSE f.own END AS tag1 FROM s JOIN f ON f.doc_id = s.doc_id AND f.pos = s.pos + 1)))))
SELECT doc_id, pos, tag FROM s WHERE pos >= 0""")
def annotate_lines(spark, d):
    """Tags of all documents' lines by rules, blocks and the tag before. SQL: a recursive query, row by row."""
    text = F.expr(_ANNOTATED_TEXT)
    rows = lines(spark, d).select("doc_id", "pos", "line", "n").select("doc_id", "pos", text.alias("text"), (F.col("n") % 4 == 0).alias("is_list"), F.when(F.col("n") % 8 == 0, "Bullet List").otherwise("").alias("style"))
    out = annotate.annotated(rows, "doc_id", "pos", RULES, MARKERS, F.floor(F.col("pos") / 8))
    return out.select("doc_id", F.col("pos").cast("long"), F.col("new_tag").alias("tag"))


_SYNONYMS, _MANDATORY = {"Abstract": "Summary", "Summary": "Summary"}, ["Summary", "Learning Objectives"]


@query(f"""WITH RECURSIVE a AS ({SQL["annotate_lines"]}), l AS (SELECT doc_id, i - 1 AS pos, x AS line, length(x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
b AS (SELECT a.*, trim({_ANNOTATED_TEXT}) AS whole FROM a JOIN l USING (doc_id, pos)), m AS (SELECT *, CASE WHEN whole = 'Abstract' THEN 'Summary' ELSE whole END IN {tuple(_MANDATORY)} AS must FROM b),
s AS (SELECT doc_id, pos, CASE WHEN must THEN 'H1' ELSE tag END AS tag, CASE WHEN must THEN 'H1' WHEN tag IN ('BODY_TEXT', 'EMPTY') THEN 'TXT' ELSE tag END AS style FROM m),
v AS (SELECT *, CASE style WHEN 'CT' THEN 0 WHEN 'H1' THEN 1 WHEN 'H2' THEN 2 WHEN 'H3' THEN 3 WHEN 'H4' THEN 4 END AS level FROM s),
r AS (SELECT doc_id, -1::BIGINT AS pos, ''::VARCHAR AS tag, ''::VARCHAR AS style, 0 AS last FROM (SELECT DISTINCT doc_id FROM v)
UNION ALL SELECT doc_id, pos, tag, CASE WHEN level IS NULL OR now = level THEN style ELSE 'H' || now END, CASE WHEN level IS NULL THEN last ELSE now END FROM (
 SELECT v.*, r.last, least(CASE WHEN v.level > 1 AND r.last = 0 THEN 1 ELSE v.level END, r.last + 1) AS now FROM r JOIN v ON v.doc_id = r.doc_id AND v.pos = r.pos + 1))
SELECT doc_id, pos, tag, style FROM r WHERE pos >= 0""")
def document_pass(spark, d):
    """The whole pass over a document's rows: annotation, then section titles and the hierarchy of headings."""
    text = F.expr(_ANNOTATED_TEXT)
    rows = lines(spark, d).select("doc_id", "pos", text.alias("text"), (F.col("n") % 4 == 0).alias("is_list"), F.when(F.col("n") % 8 == 0, "Bullet List").otherwise("").alias("style"))
    chunk = F.floor(F.col("pos") / 8)
    out = annotate.enforced(annotate.annotated(rows, "doc_id", "pos", RULES, MARKERS, chunk), "doc_id", "pos", _SYNONYMS, _MANDATORY, chunk=chunk)
    return out.select("doc_id", F.col("pos").cast("long"), F.col("new_tag").alias("tag"), F.col("new_style").alias("style"))
