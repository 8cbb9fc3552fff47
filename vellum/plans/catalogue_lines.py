"""Named queries of row stages, tag forms, labels, citations and review rules over all lines of ``documents``, each with the
rule written out in DuckDB's SQL. Tags, zones and marks follow from what stands in a line (its length and words)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks, references
from ..functions import text as T
from ..operators import knowledge, review, stages
from ..sources.tables import table
from .catalogue import query

TAGS = "TXT BL-MID KT-NL-FIRST H1 H20 TBL-MID T2 REF-N BIB EOC-LL2-MID BX1-UL-LAST BUL1 REFH1 tfn T1 NBX-TXT NBX1-h4 odd TFN TSN TH1 QUES-NL-MID EXER-TXT BL2-MID KT-NL3-LAST TXT/H1 BL_MID H2 NBX-H4".split()
ZONE_NAMES = "BODY TABLE BOX_BX2 REFERENCE BOX_NBX BACK_MATTER EXERCISE".split()
STYLE_NAMES = ["Heading 2", "Heading 3", "Normal", "Title", "Heading 1"]

# valid in both dialects, over line, n (its length), k (its words) and w1 to w4 (letters of its first words)
_TEXT = """CASE n % 13 WHEN 0 THEN 'Source: ' || line WHEN 1 THEN '* ' || line WHEN 2 THEN '<H' || CAST(n % 3 + 1 AS STRING) || '>' || line WHEN 3 THEN '<' || w1 || '>' WHEN 4 THEN 'Table ' || CAST(n % 5 AS STRING) || '.' || CAST(n % 3 AS STRING) || ' ' || line
WHEN 5 THEN 'a) ' || line WHEN 6 THEN 'From ' || line WHEN 7 THEN CAST(n % 9 AS STRING) || '. ' || line WHEN 8 THEN 'Q' || CAST(n % 9 AS STRING) || '. ' || line WHEN 9 THEN '<SUM> Summary ' || line WHEN 10 THEN '</' || w2 || '>' WHEN 11 THEN '<H1> References' ELSE line END"""
_ROWS = f"""p AS (SELECT doc_id, i - 1 AS pos, x AS line, length(x) AS n, list_filter(string_split(x, ' '), lambda w: w <> '') AS w FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
b AS (SELECT doc_id, pos, line, n, len(w) AS k, {", ".join(f"regexp_replace(coalesce(w[{i}], ''), '[^A-Za-z]', '', 'g') AS w{i}" for i in range(1, 5))} FROM p),
e AS (SELECT *, ({TAGS})[n % {len(TAGS)} + 1] AS tag, ({ZONE_NAMES})[n % {len(ZONE_NAMES)} + 1] AS zone, ({STYLE_NAMES})[k % {len(STYLE_NAMES)} + 1] AS style, {_TEXT} AS text FROM b)"""


def rows(spark, d):
    split = F.posexplode(F.split("text", "\n")).alias("pos", "line")
    df = table(spark, d, "documents").select("doc_id", split).withColumns({"n": F.length("line"), "__w": F.filter(F.split("line", " "), lambda w: w != "")})
    word = lambda i: F.regexp_replace(F.coalesce(F.get("__w", F.lit(i)), F.lit("")), "[^A-Za-z]", "")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    df = df.withColumns({"pos": F.col("pos").cast("long"), "k": F.size("__w"), **{f"w{i}": word(i - 1) for i in range(1, 5)}})
    return df.withColumns({"tag": pick(TAGS, F.col("n")), "zone": pick(ZONE_NAMES, F.col("n")), "style": pick(STYLE_NAMES, F.col("k")), "text": F.expr(_TEXT)}).drop("__w")


_KEY = ("doc_id", "pos")
_NEAR = "coalesce(bool_or({0}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), false) OR coalesce(bool_or({0}) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING), false)"
_SOURCE = "(" + " OR ".join(f"starts_with(lower(trim(text)), '{s}')" for s in stages.NOTE_SOURCES) + ")"


@query(f"""WITH {_ROWS}, n AS (SELECT *, {_NEAR.format("(tag IN ('T1', 'T11', 'T12', 'TSN', 'T2', 'T4') OR starts_with(tag, 'TFN') OR starts_with(tag, 'TBL') OR starts_with(tag, 'TH'))")} AS near,
CASE WHEN {_SOURCE} THEN 'TSN' WHEN regexp_matches(lower(trim(text)), '^(note:|notes:|[*†‡§#]|[a-z]\\)\\s|[a-z]\\s+\\S|[0-9]\\s+\\S)') THEN 'TFN' END AS kind FROM e),
c AS (SELECT *, near AND zone <> 'TABLE' AND NOT starts_with(tag, 'TFN') AND tag <> 'TSN' AND kind IS NOT NULL AS hit FROM n)
SELECT doc_id, pos, CASE WHEN hit THEN kind ELSE tag END AS tag, hit AS repaired FROM c""")
def table_note_stage(spark, d):
    return stages.table_notes(rows(spark, d), "doc_id", "pos").select(*_KEY, "tag", "repaired")


@query(f"""WITH {_ROWS}, t AS (SELECT *, regexp_matches(text, '^Table\\s+[0-9]+(\\.[0-9]+)?\\b') AS title FROM e)
SELECT doc_id, pos, CASE WHEN title THEN 'T1' WHEN regexp_matches(trim(text), '^<[^<>]+>$') THEN 'PMI' END AS locked_to, CASE WHEN title THEN 'TABLE' ELSE zone END AS zone FROM t""")
def lock_stages(spark, d):
    out = stages.lock_table_titles(stages.lock_markers(rows(spark, d)))
    return out.select(*_KEY, F.when(F.col("lock_style"), F.element_at("allowed_styles", 1)).alias("locked_to"), "zone")


@query(f"""WITH {_ROWS}, m AS (SELECT *, lower(nullif(regexp_extract(text, '^\\s*<(/?[A-Za-z][A-Za-z0-9 _-]*)>', 1), '')) AS token, lower(trim(regexp_replace(text, '^\\s*</?[A-Za-z][A-Za-z0-9 _-]*>', ''))) AS rest FROM e),
s AS (SELECT *, CASE WHEN token = 'h1-intro' THEN 'SP-H1' WHEN token = 'sum' AND contains(rest, 'summary') THEN 'EOC-H1' WHEN token = 'h1' AND rest = 'references' THEN 'REFH1' WHEN token = 'h1' THEN NULL WHEN token IS NOT NULL AND rest = '' THEN 'PMI' END AS own FROM m)
SELECT doc_id, pos, CASE WHEN own = 'PMI' OR (own IS NOT NULL AND zone = 'BACK_MATTER') THEN own ELSE tag END AS tag FROM s""")
def marker_override_stage(spark, d):
    return stages.marker_overrides(rows(spark, d), F.col("zone") == "BACK_MATTER").select(*_KEY, "tag")


_BOX_TAGS = ["BX1-TXT-FLUSH", "BX1-H2", "BX1-H4"]


@query(f"""WITH {_ROWS}, t AS (SELECT *, regexp_replace(tag, '(?i)^NBX1?-', '') AS suffix FROM e)
SELECT doc_id, pos, CASE WHEN NOT starts_with(zone, 'BOX_') THEN tag WHEN upper(tag) = 'NBX-TXT' THEN 'BX1-TXT-FLUSH' WHEN upper(tag) = 'NBX-H4' THEN tag
WHEN regexp_matches(upper(tag), '^NBX1?-') THEN CASE WHEN list_contains({_BOX_TAGS}, 'BX1-' || suffix) THEN 'BX1-' || suffix WHEN list_contains({_BOX_TAGS}, 'BX1-' || upper(suffix)) THEN 'BX1-' || upper(suffix) ELSE tag END ELSE tag END AS tag FROM t""")
def box_style_stage(spark, d):
    """The vocabulary lacks what NBX-H4 would become, so that tag stays."""
    return stages.box_styles(rows(spark, d), F.array(*map(F.lit, _BOX_TAGS))).select(*_KEY, "tag")


@query(f"""WITH {_ROWS}, t AS (SELECT *, tag IN ('odd', 'tfn', 'BL_MID') OR (zone = 'TABLE' AND NOT starts_with(tag, 'T')) AS bad FROM e)
SELECT doc_id, pos, CASE WHEN bad THEN CASE zone WHEN 'TABLE' THEN 'T' WHEN 'BOX_NBX' THEN 'NBX-TXT' WHEN 'BOX_BX2' THEN 'BX2-TXT' WHEN 'BACK_MATTER' THEN 'PMI' WHEN 'EXERCISE' THEN 'PMI' ELSE 'TXT' END ELSE tag END AS tag, bad AS zone_restricted FROM t""")
def zone_enforcement_stage(spark, d):
    ok = (F.col("zone") != "TABLE") | F.startswith("tag", F.lit("T"))
    return stages.zone_enforced(rows(spark, d), ~F.col("tag").isin("odd", "tfn", "BL_MID"), ok).select(*_KEY, "tag", "zone_restricted")


_LEVEL = "CASE WHEN k % 7 < 5 THEN CAST(k % 7 AS INT) END"


@query(f"""WITH {_ROWS}, f AS (SELECT *, {_LEVEL} AS level, CASE WHEN n % 4 = 0 THEN 'BL' WHEN n % 4 = 1 THEN 'NL' WHEN n % 4 = 2 THEN 'UL' ELSE 'BL' END AS family, CASE WHEN k % 3 = 0 THEN 'EOC-NL-' ELSE '' END AS prefix FROM e)
SELECT doc_id, pos, CASE WHEN zone = 'TABLE' THEN NULL WHEN level IS NOT NULL THEN family || CASE WHEN level = 0 THEN '' ELSE least(level + 1, 4)::VARCHAR END || '-MID' WHEN prefix <> '' THEN prefix || 'MID' END AS tag FROM f""")
def list_level_stage(spark, d):
    out = stages.lock_lists(_listed(spark, d))
    return out.select(*_KEY, F.when(F.col("lock_style"), F.element_at("allowed_styles", 1)).alias("tag"))


def _listed(spark, d):
    n, k = F.col("n"), F.col("k")
    return rows(spark, d).withColumns({"has_bullet": n % 4 == 0, "has_numbering": n % 4 == 1, "has_xml_list": n % 4 == 2, "xml_list_level": F.expr(_LEVEL), "list_style_prefix": F.when(k % 3 == 0, "EOC-NL-").otherwise("")})


@query(f"""WITH {_ROWS}, f AS (SELECT *, {_LEVEL} AS level, CASE WHEN n % 4 = 0 THEN 'BL' WHEN n % 4 = 1 THEN 'NL' WHEN n % 4 = 2 THEN 'UL' ELSE 'BL' END AS family, CASE WHEN k % 3 = 0 THEN 'EOC-NL-' ELSE '' END AS prefix FROM e),
w AS (SELECT *, CASE WHEN zone IN ('TABLE', 'REFERENCE') THEN NULL WHEN level IS NOT NULL THEN family || CASE WHEN level = 0 THEN '' ELSE least(level + 1, 4)::VARCHAR END || '-MID' WHEN prefix <> '' THEN prefix || 'MID' END AS want FROM f),
x AS (SELECT *, regexp_replace(want, '-MID$', '') || '-' || nullif(regexp_extract(tag, '-(FIRST|MID|LAST)$', 1), '') AS exact FROM w), n AS (SELECT *, CASE WHEN tag = want OR tag = exact OR suffix(tag, '-' || exact) THEN tag ELSE coalesce(exact, want) END AS new FROM x)
SELECT doc_id, pos, CASE WHEN want IS NOT NULL THEN new ELSE tag END AS tag, want IS NOT NULL AND new <> tag AS list_preserved, CASE WHEN want IS NOT NULL AND new <> tag THEN tag END AS original_tag FROM n""")
def kept_list_stage(spark, d):
    return stages.kept_lists(_listed(spark, d)).select(*_KEY, "tag", "list_preserved", "original_tag")


@query(f"""WITH {_ROWS}, c AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY doc_id, zone) AS m, bool_or(tag IN ('TBL-FIRST', 'TBL-MID', 'TBL-LAST')) OVER (PARTITION BY doc_id, zone) AS taken FROM e WINDOW w AS (PARTITION BY doc_id, zone ORDER BY pos))
SELECT doc_id, pos, CASE WHEN m < 2 OR taken THEN tag WHEN r = 1 THEN 'TBL-FIRST' WHEN r = m THEN 'TBL-LAST' ELSE 'TBL-MID' END AS tag FROM c""")
def cell_position_stage(spark, d):
    """Rows of one zone of a document stand for a cell's."""
    return stages.cell_positions(rows(spark, d), ["doc_id", "zone"], "pos").select(*_KEY, "tag")


_FAMILY = "regexp_replace(regexp_replace(tag, '-(FIRST|MID|LAST)$', ''), '[0-9]+$', '')"


@query(f"""WITH {_ROWS} SELECT {_FAMILY} AS family, array_to_string(list_sort(list(DISTINCT tag)), ',') AS members, array_to_string(list_sort(list(DISTINCT nullif(regexp_extract(tag, '-(FIRST|MID|LAST)$', 1), '')) FILTER (WHERE regexp_matches(tag, '-(FIRST|MID|LAST)$'))), ',') AS positions, count(*) AS total FROM e GROUP BY 1""")
def tag_families(spark, d):
    out = knowledge.tag_families(rows(spark, d), "tag")
    return out.select("family", F.array_join("members", ",").alias("members"), F.nullif(F.array_join("positions", ","), F.lit("")).alias("positions"), "total")


@query(f"""WITH {_ROWS}, m AS (SELECT tag, regexp_extract(tag, '(?i)(?:^|[-_])((?:[A-Z]+-)?(?:BL|NL|UL))([2-6])?(?:[-_](FIRST|MID|LAST|ONLY))?$', ['base', 'depth', 'place']) AS g FROM e)
SELECT upper(g.base) AS base, CASE WHEN g.depth = '' THEN 1 ELSE g.depth::INTEGER END AS depth, count(*) AS n, array_to_string(list_sort(list(DISTINCT tag))[:12], ',') AS variants FROM m WHERE g.base <> '' GROUP BY 1, 2""")
def list_depths(spark, d):
    return knowledge.list_depths(rows(spark, d), "tag").withColumn("variants", F.array_join("variants", ","))


_MARKERS = """CASE n % 4 WHEN 0 THEN '<' || left(w1, 3) || '>' WHEN 1 THEN ' </' || left(w2, 2) || '> ' WHEN 2 THEN '<INSERT ' || left(w1, 2) || ' ' || w3 || '>' ELSE '<' || line || '>' END"""


@query(f"""WITH {_ROWS}, t AS (SELECT trim({_MARKERS}) AS t FROM e), c AS (SELECT CASE WHEN regexp_matches(t, '(?i)^</?[A-Z][A-Z0-9_-]*>$') AND NOT starts_with(t, '</') THEN 'open' WHEN regexp_matches(t, '(?i)^</[A-Z][A-Z0-9_-]*>$') THEN 'close' WHEN regexp_matches(t, '(?i)^<INSERT\\s+') THEN 'insert' ELSE 'other' END AS class, t FROM t),
q AS (SELECT class, CASE class WHEN 'open' THEN upper(t) WHEN 'close' THEN upper(t) WHEN 'insert' THEN CASE WHEN regexp_matches(upper(left(t, 20)), '<INSERT\\s+[A-Z]+') THEN '<INSERT ' || regexp_extract(upper(left(t, 20)), '<INSERT\\s+([A-Z]+)', 1) || '...>' ELSE '<INSERT ...>' END ELSE '<other_pmi_pattern>' END AS pattern FROM c),
n AS (SELECT class, pattern, count(*) AS n FROM q GROUP BY ALL) SELECT * FROM (SELECT class, pattern, n, row_number() OVER (PARTITION BY class ORDER BY n DESC, pattern) AS rank FROM n) WHERE rank <= 10""")
def marker_counts(spark, d):
    return knowledge.marker_counts(rows(spark, d).select(F.expr(_MARKERS).alias("text")), "text")


@query(f"""WITH {_ROWS} SELECT doc_id, pos, CASE WHEN n % 5 = 4 AND k = 0 THEN NULL ELSE 3 END AS items, w2 AS second FROM e""")
def json_ladder(spark, d):
    """Answers about a line's words, whole or broken in one of four ways by its length; all parse to three items."""
    item = lambda c, i: F.concat(F.lit(f'{{"id": {i}, "tag": "'), F.col(c), F.lit('"}'))
    three = F.concat_ws(", ", item("w1", 1), item("w2", 2), item("w3", 3))
    n = F.col("n")
    raw = F.when(n % 4 == 0, F.concat(F.lit("["), three, F.lit("]"))).when(n % 4 == 1, F.concat(F.lit("Here it is: ["), three, F.lit("] as asked"))).when(n % 4 == 2, F.concat(F.lit("["), three, F.lit(', {"id": 4, "ta'))).otherwise(three)
    out = rows(spark, d).select(*_KEY, T.json_ladder(raw, "struct<id: int, tag: string>").alias("r"))
    return out.select(*_KEY, F.size("r").alias("items"), F.element_at("r", 2)["tag"].alias("second"))


_LABEL = """CASE n % 9 WHEN 0 THEN 'Fig. ' || CAST(n % 7 AS STRING) || '–' || CAST(k AS STRING) || left(w1, 1) WHEN 1 THEN 'TABLE ' || CAST(n % 5 AS STRING) || '.' || CAST(k AS STRING) WHEN 2 THEN 'Box ' || w1 WHEN 3 THEN 'exhibit ' || CAST(n AS STRING) || '--' || CAST(k AS STRING)
WHEN 4 THEN 'Appendix ' || w1 WHEN 5 THEN 'see Fig ' || CAST(n AS STRING) || ' and Table ' || CAST(k AS STRING) || ' ' || w2 WHEN 6 THEN '<H1>Further Reading:' WHEN 7 THEN line ELSE 'References' END"""
_HEADINGS = ", ".join(repr(h) for h in checks.REFERENCE_HEADINGS)


@query(f"""WITH {_ROWS}, a AS (SELECT *, {_LABEL} AS label FROM e), s AS (SELECT *, translate(replace(trim(label), '--', '-'), '–—[]°', '--') AS s, regexp_extract(translate(replace(trim(label), '--', '-'), '–—[]°', '--'), '([0-9]+(?:[.\\-][0-9]+)*)([A-Za-z]?)', ['a', 'b']) AS g FROM a)
SELECT doc_id, pos, CASE WHEN lower(label) LIKE 'fig%' THEN 'Figure' WHEN lower(label) LIKE 'tab%' THEN 'Table' WHEN lower(label) LIKE 'box%' THEN 'Box' WHEN lower(label) LIKE 'exhibit%' THEN 'Exhibit' WHEN lower(label) LIKE 'appendix%' THEN 'Appendix' WHEN lower(label) LIKE 'case%' THEN 'Case Study' ELSE 'Figure' END AS kind,
CASE WHEN label = '' THEN '' WHEN g.a <> '' THEN translate(g.a, '-', '.') || g.b ELSE s END AS number,
concat_ws(',', CASE WHEN regexp_matches(label, '(?i)(Figure|Fig\\.?|see Fig)\\s+[0-9]+') THEN 'figure' END, CASE WHEN regexp_matches(label, '(?i)(Table|Tbl\\.?)\\s+[0-9]+') THEN 'table' END, CASE WHEN regexp_matches(label, '(?i)Box\\s+[0-9]+') THEN 'box' END) AS refers,
lower(regexp_replace(trim(regexp_replace(label, '<[^>]+>', '', 'g')), '\\s*:?$', '')) IN ({_HEADINGS}) AS is_heading, line <> '' AND length(trim(label)) >= 12 AS usable FROM s""")
def item_labels(spark, d):
    label = F.expr(_LABEL)
    return rows(spark, d).select(
        *_KEY, checks.item_type(label).alias("kind"), checks.item_number(label).alias("number"), F.array_join(checks.cross_references(label), ",").alias("refers"),
        checks.reference_heading(label).alias("is_heading"), checks.usable_item(F.col("line"), label, checks.item_type(label), 12).alias("usable"),
    )


_KNOWN = ["TXT", "H1", "H2", "T2", "BL-MID"]
_ALIASES = {"BL-MID": "BL-FIRST", "X_Y": "H3", "T2": "T3", "REF_N": "REF-N0"}


def _aliased(tag: str) -> str:
    return f"CASE {tag} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _ALIASES.items()) + " END"


_OTHERS = "CASE tag " + " ".join(f"WHEN '{k}' THEN '{','.join(v)}'" for k, v in stages.ALTERNATIVES.items()) + " ELSE '' END"


@query(f"""WITH {_ROWS}, f AS (SELECT doc_id, pos, tag, n, CASE WHEN k % 3 = 0 THEN tag || '/' || upper(w1) WHEN k % 3 = 1 THEN upper(w1) || ', ' || tag ELSE tag END AS form FROM e)
SELECT doc_id, pos, coalesce({_aliased("tag")}, {_aliased("translate(tag, '_', '-')")}, {_aliased("translate(tag, '-', '_')")}, tag) AS canonical, list_filter(regexp_split_to_array(form, '\\s*[/,|+]\\s*'), lambda p: list_contains({_KNOWN}, p))[1] AS part,
CASE WHEN n % 100 < 85 THEN {_OTHERS} ELSE '' END AS alternatives FROM f""")
def tag_forms(spark, d):
    known, tag, k = F.array(*map(F.lit, _KNOWN)), F.col("tag"), F.col("k")
    form = F.when(k % 3 == 0, F.concat(tag, F.lit("/"), F.upper("w1"))).when(k % 3 == 1, F.concat(F.upper("w1"), F.lit(", "), tag)).otherwise(tag)
    out = stages.alternatives(rows(spark, d).withColumn("confidence", F.col("n") % 100))
    return out.select(*_KEY, stages.style_aliases(tag, _ALIASES).alias("canonical"), stages.split_composite(form, known).alias("part"), F.array_join("alternatives", ",").alias("alternatives"))


_QUESTION = "(" + " OR ".join(f"starts_with({{0}}, '{q}')" for q in stages.QUESTION_STARTS) + ")"


@query(f"""WITH {_ROWS}, o AS (SELECT *, CASE tag WHEN 'odd' THEN 'QUES-NL-FIRST' ELSE tag END AS own, {_QUESTION.format("tag")} AS q FROM e),
n AS (SELECT *, {_NEAR.format("q")} AS near, regexp_matches(text, '(?i)^\\s*(Q[0-9]+\\.\\s|[0-9]+\\.\\s|\\([0-9]+\\)\\s|[0-9]+\\)\\s)') AS numbered FROM o),
c AS (SELECT *, CASE WHEN numbered AND (zone = 'EXERCISE' OR (zone <> 'BACK_MATTER' AND (near OR {_QUESTION.format("own")}))) THEN CASE WHEN own NOT IN {stages.QUESTION_TAGS} THEN 'QUES-NL-MID' END
WHEN numbered AND zone = 'BACK_MATTER' THEN CASE WHEN own NOT IN {stages.REFERENCE_TAGS} THEN 'REF-N' END WHEN own <> tag THEN own END AS new FROM n)
SELECT doc_id, pos, coalesce(new, tag) AS tag, new IS NOT NULL AND new <> tag AS repaired FROM c""")
def question_stage(spark, d):
    return stages.question_numbers(rows(spark, d), "doc_id", "pos", {"odd": "QUES-NL-FIRST"}).select(*_KEY, "tag", "repaired")


_CITED = """CASE n % 9 WHEN 0 THEN '(' || w1 || ' et al 2001)' WHEN 1 THEN '(' || w1 || ' 1999a) ' || line WHEN 2 THEN '(' || w1 || ' & ' || w2 || ' 2004)' WHEN 3 THEN w1 || ' et al. (2010)' WHEN 4 THEN '(' || w1 || ', nd)' WHEN 5 THEN line || ' (' || w1 || ' n.d.)' WHEN 6 THEN '(' || w2 || ' In Press)' WHEN 7 THEN '(' || w1 || ' et al. 2003) and ' || line ELSE line END"""
_LOCATED = """CASE k % 7 WHEN 0 THEN 'p. ' || CAST(n AS STRING) WHEN 1 THEN 'pp. ' || CAST(n AS STRING) || '–' || CAST(n + k AS STRING) WHEN 2 THEN 'p. ' || CAST(n AS STRING) || '-' || CAST(n + k AS STRING) WHEN 3 THEN 'pp. ' || CAST(n AS STRING) WHEN 4 THEN 'p.' || CAST(n AS STRING) WHEN 5 THEN 'pp.' || CAST(k AS STRING) || '-' || CAST(n AS STRING) ELSE 'P. ' || w1 END"""
_NAMED = "[A-Z][\\w''’-]+"
_PAIR = f"({_NAMED}(?:\\s+(?:&|and)\\s+{_NAMED})?)"


@query(f"""WITH {_ROWS}, t AS (SELECT *, {_CITED} AS cited, {_LOCATED} AS loc FROM e), f AS (SELECT *, regexp_replace(cited, '\\bet\\s+al\\b\\.?', 'et al.', 'g') AS a, regexp_matches(cited, '(?i)\\bet\\s+al\\b') AS has, regexp_matches(loc, '[0-9]+[–—-][0-9]+') AS ranged FROM t),
g AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(a, '\\(({_NAMED})\\s+et al\\.\\s+((?:19|20)[0-9][0-9][a-z]?)\\)', '(\\1 et al., \\2)', 'g'), '\\({_PAIR}\\s+((?:19|20)[0-9][0-9][a-z]?)\\)', '(\\1, \\2)', 'g'), '\\({_PAIR},?\\s+(?i:n\\.?\\s?d\\.?)\\)', '(\\1, n.d.)', 'g') AS b FROM f)
SELECT doc_id, pos, regexp_replace(b, '\\({_PAIR},?\\s+(?i:in\\s+press)\\)', '(\\1, in press)', 'g') AS fixed,
concat_ws(';', CASE WHEN ranged AND lower(loc) LIKE 'p.%' THEN 'use pp. for ranges' END, CASE WHEN NOT ranged AND lower(loc) LIKE 'pp%' THEN 'use p. for a single page' END,
CASE WHEN ranged AND regexp_matches(loc, '[0-9]-[0-9]') THEN 'use an en dash for ranges' END, CASE WHEN NOT regexp_matches(loc, '(?i)^pp?\\.\\s[0-9]') THEN 'add a space after the stop' END) AS problems,
CASE WHEN k % 11 = 0 THEN CASE WHEN has THEN 'incorrect: organisation' END WHEN k % 5 >= 3 AND NOT has THEN 'required' WHEN k % 5 < 3 AND has THEN 'incorrect: few authors' WHEN has AND NOT regexp_matches(cited, '(?i)\\bet\\s+al\\.') THEN 'punctuation' END AS et_al FROM g""")
def citation_forms(spark, d):
    cited, loc, k = F.expr(_CITED), F.expr(_LOCATED), F.col("k")
    return rows(spark, d).select(*_KEY, checks.apa_fixed(cited).alias("fixed"), F.array_join(checks.locator_problems(loc), ";").alias("problems"), checks.et_al_issue(cited, k % 5, k % 11 == 0).alias("et_al"))


_MARKED = "regexp_matches(text, '(?i)^\\s*<h[1-6]\\b[^>]*>') AND regexp_matches(trim(tag), '(?i)^(H[1-6][0-9]*|SP-H1|EOC-H1|REFH1|REF-H1|APX-H[1-3]|CS-H1|REFH2|REFH2A|REF-H2)$')"
_TABLE_TAG = f"(upper(tag) IN {review.TABLE_TAGS} OR regexp_matches(upper(tag), '^(TH|TBL|TNL|TUL)'))"


@query(f"""WITH {_ROWS}, f AS (SELECT *, {_TABLE_TAG} AS tt, {_MARKED} AS marked, CASE style WHEN 'Title' THEN 0 WHEN 'Normal' THEN NULL ELSE right(style, 1)::INT END AS level,
regexp_matches(tag, '(?i)(^|-)(BL|UL|TBL|TUL|BUL|NL|LL)[0-9]*(-|$)') AS listed FROM e)
SELECT doc_id, pos, n % 2 = 0 AND n % 3 <> 0 AND NOT listed AS keep_list, level IS NOT NULL AND NOT marked AND NOT CASE WHEN level = 0 THEN zone = 'TABLE' OR tt ELSE zone = 'TABLE' AND tt END AS keep_heading,
n % 100 < CASE WHEN zone = 'TABLE' OR tt THEN 90 WHEN regexp_matches(tag, '^(REF|APX-REF)|^(BIB|SR|SRH1)$') OR zone = 'REFERENCE' OR k % 17 = 0 THEN 80 ELSE 85 END AS review FROM f""")
def kept_styles_review(spark, d):
    n, k, tag, zone = F.col("n"), F.col("k"), F.col("tag"), F.col("zone")
    level = F.when(F.col("style") == "Title", 0).when(F.col("style") != "Normal", F.right("style", F.lit(1)).cast("int"))
    return rows(spark, d).select(
        *_KEY, review.keeps_list_style(n % 2 == 0, n % 3 == 0, tag).alias("keep_list"), review.keeps_heading_style(level, tag, zone == "TABLE", F.col("text")).alias("keep_heading"), review.needs_review(tag, zone, k % 17 == 0, n % 100, 90, 80).alias("review"),
    )


_ALLOWED = ["BL-MID", "BL-FIRST", "KT-NL-MID", "EOC-LL2-MID", "EOC-LL2-LAST", "KT-NL3-FIRST"]
_FACTS = "(['bullet', 'numbered', 'unordered', ''])[k % 4 + 1] AS kind, (['FIRST', 'MID', 'LAST', 'last ', ''])[n % 5 + 1] AS place"


@query(f"""WITH {_ROWS}, f AS (SELECT *, {_FACTS}, zone = 'TABLE' AS tab, starts_with(zone, 'BOX_') AS boxed, CASE zone WHEN 'BOX_BX2' THEN 'BX2' ELSE 'NBX' END AS box FROM e),
g AS (SELECT *, CASE kind WHEN 'bullet' THEN CASE WHEN tab THEN 'TBL' ELSE 'BL' END WHEN 'numbered' THEN CASE WHEN tab THEN 'TNL' ELSE 'NL' END ELSE CASE WHEN boxed THEN 'UL' WHEN n % 2 = 0 THEN CASE WHEN tab THEN 'TBL' ELSE 'BL' END WHEN tab THEN 'TUL' ELSE 'UL' END END AS family FROM f),
q AS (SELECT *, CASE WHEN contains(tag, '-BL') THEN split_part(tag, '-BL', 1) || '-BL' WHEN contains(tag, '-NL') THEN split_part(tag, '-NL', 1) || '-NL' WHEN contains(tag, '-UL') THEN split_part(tag, '-UL', 1) || '-UL' WHEN boxed THEN box || '-' || family ELSE family END AS own,
upper(trim(place)) AS pl, CASE WHEN regexp_matches(tag, '^.*?(BL|NL|UL|LL)[0-9]*-(FIRST|MID|LAST)$') THEN regexp_replace(tag, '-(FIRST|MID|LAST)$', '') END AS stem, regexp_extract(text, '(?i)^\\s*<H([1-6])>[\\pL\\pN_]', 1) AS lv FROM g)
SELECT doc_id, pos, CASE WHEN kind <> '' AND place <> '' THEN own || '-' || place END AS list_tag,
CASE WHEN stem IS NULL OR pl = '' THEN NULL WHEN list_contains({_ALLOWED}, stem || '-' || pl) THEN stem || '-' || pl WHEN list_contains({_ALLOWED}, stem || '-MID') THEN stem || '-MID' END AS aligned,
CASE WHEN zone <> 'BODY' THEN NULL WHEN lv = '1' AND style = 'Heading 2' THEN 'H10' WHEN lv = '2' AND style = 'Heading 3' THEN 'H20' WHEN lv = '2' AND style = 'Heading 2' THEN 'H21' END AS variant,
CASE WHEN list_contains({_ALLOWED}, tag) THEN tag WHEN n % 2 = 0 THEN 'BL-MID' END AS fallback FROM q""")
def validator_helpers(spark, d):
    n, k, tag, zone = F.col("n"), F.col("k"), F.col("tag"), F.col("zone")
    pick = lambda names, by: F.element_at(F.array(*map(F.lit, names)), (by % len(names) + 1).cast("int"))
    kind, place, allowed = pick(["bullet", "numbered", "unordered", ""], k), pick(["FIRST", "MID", "LAST", "last ", ""], n), F.array(*map(F.lit, _ALLOWED))
    box = F.when(zone == "BOX_BX2", "BX2")
    return rows(spark, d).select(
        *_KEY, review.list_tag(kind, place, zone, box, n % 2 == 0, tag).alias("list_tag"), review.aligned_position(tag, place, allowed).alias("aligned"), review.heading_variant(F.col("text"), F.col("style"), zone).alias("variant"),
        review.first_allowed([tag, F.when(n % 2 == 0, "BL-MID")], allowed).alias("fallback"),
    )


_AUTHORS = """CASE n % 8 WHEN 0 THEN w1 || ', ' || upper(left(w2, 1)) || '., ' || w3 || ', K.' WHEN 1 THEN w1 || ' & ' || w2 WHEN 2 THEN w1 || ', ' || w2 || ', & ' || w3 WHEN 3 THEN w1 || ' et al.' WHEN 4 THEN w1 || ' ' || w2 || ' University' WHEN 5 THEN 'J. K.' || upper(left(w1, 1)) WHEN 6 THEN w1 || ' [' || w2 || ']' ELSE line END"""
_ORGANISATION = "(?i)\\b(" + "|".join(w.replace("'", "''") for w in checks.ORGANISATION_WORDS) + ")\\b"


@query(f"""WITH {_ROWS}, a AS (SELECT doc_id, pos, {_AUTHORS} AS authors FROM e), s AS (SELECT *, trim(regexp_replace(authors, '\\[.*?\\]', '', 'g')) AS s, regexp_matches(authors, '{_ORGANISATION}') AS org FROM a),
q AS (SELECT *, list_transform(regexp_extract_all(s, '[^,&]+'), lambda x: trim(regexp_replace(x, '(?i)\\bet\\s+al\\b', '', 'g'))) AS said, list_transform(regexp_extract_all(authors, '[^,&]+'), lambda x: trim(regexp_replace(x, '(?i)\\bet\\s+al\\b', '', 'g'))) AS all_said FROM s),
n AS (SELECT *, list_filter(said, lambda x: x <> '' AND NOT regexp_full_match(x, '[A-Z][A-Z .-]*')) AS names, len(list_filter(all_said, lambda x: x <> '' AND NOT regexp_full_match(x, '[A-Z][A-Z .-]*'))) AS c, contains(lower(s), 'et al') AS further, list_filter(regexp_split_to_array(s, '\\s+'), lambda x: regexp_matches(x, '^\\p{{Lu}}') AND NOT regexp_full_match(x, '[A-Z]\\.')) AS words FROM q),
m AS (SELECT *, CASE WHEN len(names) > 0 THEN names ELSE words END AS k FROM n), z AS (SELECT *, len(k) + CASE WHEN further THEN 2 ELSE 0 END AS m FROM m)
SELECT doc_id, pos, authors, CASE WHEN org THEN s WHEN len(k) = 0 THEN string_split(s, ' ')[1] WHEN m >= 3 THEN k[1] || ' et al.' WHEN m = 2 THEN array_to_string(k, ' & ') ELSE k[1] END AS display,
CASE WHEN org THEN 1 WHEN contains(lower(authors), 'et al') THEN greatest(c + 1, 3) ELSE greatest(c, 1) END::INTEGER AS n_authors FROM z""")
def author_display(spark, d):
    """Author lists made of a line's words: how a text cites them, and how many there are."""
    out = rows(spark, d).select(*_KEY, F.expr(_AUTHORS).alias("authors"))
    return out.select(*_KEY, "authors", references.display_authors(F.col("authors"), checks.is_organisation(F.col("authors"))).alias("display"), checks.author_count(F.col("authors")).alias("n_authors"))


_REFERENCE = """CASE n % 12 WHEN 0 THEN w1 || ', A., & ' || w2 || ', B. (2001b, May 3). ' || line WHEN 1 THEN w1 || ' ' || w2 || ' ' || w3 || ' (n.d.). ' || line WHEN 2 THEN w1 || ' ' || w2 || ' [' || upper(left(w3, 3)) || 'X] (in press). ' || line
WHEN 3 THEN w1 || ', K. (Eds.), (1999). ' || line WHEN 4 THEN w1 || ' A, ' || w2 || ' B, ' || w3 || ' C. ' || line || ' 2003;4:5-9.' WHEN 5 THEN w1 || ' A, ' || w2 || ' B. Title. ' || line || ' 1987.' WHEN 6 THEN w1 || ', John. 2020. ' || line
WHEN 7 THEN w1 || ', John, ' || w2 || ', and ' || w3 || '. 1995. ' || line WHEN 8 THEN w1 || ', C., ' || w2 || ', D., & ' || w3 || ', E., & ' || w4 || ', F. (2010). ' || line WHEN 9 THEN w1 || '. ' || w2 || '. ' || line || ' 1.2. 12345' WHEN 10 THEN '[3] ' || line || ' (ND). x' ELSE line END"""
_ADA = "'^(.+?)\\s*\\(((?:(?:19|20)[0-9]{2}[a-z]?|n\\.?d\\.?(?:-[a-z])?|in press).*?)\\)\\.?'"
_VAN = "'^([A-Z][^.]+?)\\.\\s*[^.]+?\\.\\s*.*?([0-9]{4})'"
_CHI = "'^([A-Z][^.]+?)\\.\\s*([0-9]{4})\\.\\s*'"


@query(f"""WITH {_ROWS}, r AS (SELECT doc_id, pos, {_REFERENCE} AS raw FROM e), x AS (SELECT *, regexp_extract(raw, {_ADA}, ['a', 'd']) AS m, regexp_matches(raw, {_ADA}) AS is_a, regexp_matches(raw, {_VAN}) AS is_v, regexp_matches(raw, {_CHI}) AS is_c, regexp_extract(raw, {_VAN}, ['a', 'd']) AS v, regexp_extract(raw, {_CHI}, ['a', 'd']) AS c FROM r),
f AS (SELECT *, regexp_replace(trim(regexp_replace(trim(m.a), '(?i)\\s*\\(\\s*Eds?\\.?\\s*\\)', '', 'g')), ',\\s*$', '') AS full_author, trim(m.d) AS d, string_split(trim(v.a), ',') AS vs, string_split(trim(c.a), ',') AS cs FROM x),
g AS (SELECT *, trim(regexp_replace(full_author, '\\s*[\\[(][^\\])]+[\\])]\\s*', ' ', 'g')) AS clean, regexp_extract_all(full_author, '[\\[(]([A-Z]{{2,}})[\\])]', 1) AS given FROM f),
h AS (SELECT *, list_filter(regexp_split_to_array(clean, '\\s+'), lambda w: w <> '') AS words, string_split(clean, '&') AS sides FROM g)
SELECT doc_id, pos, CASE WHEN is_a THEN CASE WHEN len(sides) = 2 THEN trim(string_split(sides[1], ',')[1]) || ' & ' || trim(string_split(sides[2], ',')[1]) ELSE trim(string_split(sides[1], ',')[1]) END END AS apa_author,
CASE WHEN is_a THEN CASE WHEN regexp_matches(d, '\\b(19|20)[0-9]{{2}}[a-z]?\\b') THEN regexp_extract(d, '\\b((?:19|20)[0-9]{{2}}[a-z]?)\\b', 1) WHEN contains(lower(d), 'n.d') THEN coalesce(nullif(regexp_extract(d, '(?i)\\bn\\.?d\\.?(-[a-z])?\\b'), ''), 'n.d.') WHEN contains(lower(d), 'in press') THEN 'in press' ELSE d END END AS apa_year,
CASE WHEN is_a THEN array_to_string(CASE WHEN len(given) > 0 THEN given WHEN NOT contains(clean, ',') AND len(words) >= 3 AND len(list_filter(words, lambda w: NOT regexp_matches(w, '^\\p{{Lu}}'))) = 0 THEN [array_to_string(list_transform(words, lambda w: left(w, 1)), '')] ELSE [] END, ',') END AS short_forms,
CASE WHEN is_v THEN CASE WHEN len(vs) >= 3 THEN trim(vs[1]) || ' et al' WHEN len(vs) = 2 THEN trim(vs[1]) || ' and ' || trim(vs[2]) ELSE trim(v.a) END END AS vancouver_author, CASE WHEN is_v THEN v.d END AS vancouver_year,
CASE WHEN is_c THEN CASE WHEN len(cs) >= 3 THEN trim(cs[1]) || ' et al.' ELSE trim(cs[1]) END END AS chicago_author, CASE WHEN is_c THEN c.d END AS chicago_year FROM h""")
def reference_fields(spark, d):
    """Reference lines made of documents' lines, read as three styles."""
    out = rows(spark, d).select(*_KEY, F.expr(_REFERENCE).alias("raw"))
    out = out.select(*_KEY, *(references.parsed_line(F.col("raw"), s).alias(s) for s in references.LINES))
    return out.select(
        *_KEY, F.col("APA.author").alias("apa_author"), F.col("APA.year").alias("apa_year"), F.array_join("APA.abbreviations", ",").alias("short_forms"), F.col("Vancouver.author").alias("vancouver_author"),
        F.col("Vancouver.year").alias("vancouver_year"), F.col("Chicago.author").alias("chicago_author"), F.col("Chicago.year").alias("chicago_year"),
    )
