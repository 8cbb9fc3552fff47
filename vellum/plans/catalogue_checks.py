"""Named queries of reference zones, text helpers, credits, zone vocabularies, review queues, rule tables, merges, retention
and retries over the given tables, each with its rule in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import checks
from ..functions import text as T
from ..operators import corpus, joins, quality, spans, stages, workflow
from ..operators import sequence as seq
from ..sources.tables import table
from ..streaming import jobs
from .catalogue import events, query
from .catalogue_lines import _KEY, _ROWS, rows
from .catalogue_structure import _sql_credit

_ZONE_TEXT = "CASE WHEN n % 61 = 5 THEN '<H1>References:' WHEN n % 7 = 3 THEN CAST(k AS STRING) || '. ' || w1 || ', ' || w2 || ' et al. 2001; doi:10.1000/x' WHEN n % 59 = 4 THEN 'Further Reading' ELSE line END"
_STARTS = ["^\\s*\\[\\s*[0-9]+\\s*\\]\\s*[A-Z]", "^\\s*[0-9]+\\.\\s+[A-Z][a-z]+,?\\s+[A-Z]", "^\\s*[A-Z][a-z]+,\\s+[A-Z]\\.\\s*\\(?[0-9]{4}\\)?", "^\\s*[A-Z][a-z]+\\s+et\\s+al\\.?\\s*\\(?[0-9]{4}\\)?"]
_SIGNS = ["\\bet\\s+al\\.?\\b", "\\b(19|20)[0-9]{2}\\b", "(?i)\\bdoi[:\\s./]", "(?i)\\b(journal|proceedings|conference|press|vol\\.|volume)\\b", "[,.;:]{2,}", "https?://"]


def _like(text: str, strict: bool) -> str:
    start = " OR ".join(f"regexp_matches(trim({text}), '{p}')" for p in _STARTS)
    signs = " + ".join(f"regexp_matches(trim({text}), '{p}')::INT" for p in _SIGNS)
    return f"(length(trim({text})) >= 20 AND (({start}) {'AND' if strict else 'OR'} ({signs}) >= {2 if strict else 3}))"


_W = "OVER (PARTITION BY doc_id ORDER BY pos)"


@query(f"""WITH {_ROWS}, z AS (SELECT doc_id, pos, {_ZONE_TEXT} AS t FROM e), h AS (SELECT *, starts_with(t, '<H1>References') AS head, t = 'Further Reading' AS later, {_like("t", False)} AS lk, row_number() {_W} AS r, count(*) OVER (PARTITION BY doc_id) AS m FROM z),
l AS (SELECT *, later AND r > 0.75 * m AND coalesce(sum(lk::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING), 0) >= 3 AS late FROM h),
s AS (SELECT *, coalesce(r > coalesce(min(CASE WHEN head THEN r END) OVER (PARTITION BY doc_id), min(CASE WHEN late THEN r END) OVER (PARTITION BY doc_id)), false) AS inside FROM l),
c AS (SELECT *, sum((inside AND lk)::INT) {_W} AS hits FROM s), q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, inside, hits ORDER BY pos) - 1 AS misses FROM c), d AS (SELECT *, bool_or(inside AND hits >= 3 AND misses >= 4) {_W} AS done FROM q)
SELECT doc_id, pos, inside AND NOT done AS in_zone, inside AND NOT done AND regexp_matches(t, '^\\s*(\\[[0-9]+\\]|\\([0-9]+\\)|[0-9]+[.)])\\s') AS locked FROM d""")
def reference_zone_lines(spark, d):
    """The list of references of each document, and its numbered rows, which are locked."""
    z = rows(spark, d).select(*_KEY, F.expr(_ZONE_TEXT).alias("text"))
    text = F.col("text")
    z = seq.reference_zone(z, "doc_id", "pos", F.startswith(text, F.lit("<H1>References")), text == "Further Reading", checks.citation_like(text, False), streak=4)
    out = stages.lock_numbered_references(z, "doc_id", "pos", "in_zone")
    return out.select(*_KEY, "in_zone", F.coalesce("lock_style", F.lit(False)).alias("locked"))


_NOISE = "CASE n % 5 WHEN 0 THEN CAST(k AS STRING) || '. ' || line WHEN 1 THEN w1 || ', A., & ' || w2 || ' see 10.1234/' || w3 || '.x_1)., end' WHEN 2 THEN '[BAD_ROW] ' || line WHEN 3 THEN '  ' || w1 || ' & ' || w2 || '/' || w3 || '?.docx ' ELSE '• ' || line END"


@query(f"""WITH {_ROWS}, t AS (SELECT doc_id, pos, tag, {_NOISE} AS t, w1 || ' ' || upper(w2) || ' ' || w3 AS name, n FROM e)
SELECT doc_id, pos, regexp_replace(t, '(?m)^[ \\t]*(?:[0-9]+[.)]|[•●–-])[ \\t]+', '', 'g') AS plain, trim(regexp_replace(regexp_extract(t, '^([^,&]+)', 1), '(?i)\\s+(et al\\.?|and\\s.*)$', '')) AS surname,
array_to_string(regexp_extract_all(name, '\\b([A-Z])[A-Za-z]*', 1), '') AS initials, regexp_replace(nullif(regexp_extract(t, '(10\\.[0-9]{{4,9}}/[-._;()/:A-Za-z0-9]+)', 1), ''), '[.;,)]+$', '') AS doi, CASE WHEN length(t) > 12 THEN left(t, 12) || '...' ELSE t END AS short,
nullif(regexp_extract(t, '^\\[([A-Z_]+)\\]\\s*', 1), '') AS code, regexp_replace(regexp_replace(trim(t), '[^A-Za-z0-9._-]+', '_', 'g'), '^_+|_+$', '', 'g') AS file_name, lower(trim(t)) || '|' || (1900 + n % 120) AS key,
regexp_replace(tag, '-(FIRST|MID|LAST)$', '') AS prefix, nullif(regexp_extract(tag, '-(FIRST|MID|LAST)$', 1), '') AS place FROM t""")
def line_helpers(spark, d):
    """Column helpers on text made of lines: list numbers, surnames, initials, DOIs, previews, codes, file names, keys."""
    t = F.col("t")
    out = rows(spark, d).select(*_KEY, "tag", "n", "w1", "w2", "w3", F.expr(_NOISE).alias("t"))
    return out.select(
        *_KEY, T.without_list_number(t).alias("plain"), T.surname(t).alias("surname"), T.acronym(F.concat_ws(" ", "w1", F.upper("w2"), "w3")).alias("initials"), T.doi(t).alias("doi"), T.preview(t, 12).alias("short"), T.error_parts(t)["code"].alias("code"),
        T.safe_name(t).alias("file_name"), T.citation_key(t, 1900 + F.col("n") % 120).alias("key"), T.tag_parts(F.col("tag"))["prefix"].alias("prefix"), T.tag_parts(F.col("tag"))["position"].alias("place"),
    )


_CREDIT = "CASE n % 6 WHEN 0 THEN 'Source: ' || line WHEN 1 THEN line || ' Adapted with permission from ' || w1 WHEN 2 THEN line || ' (Courtesy of ' || w2 || ').' WHEN 3 THEN w1 || '. Reprinted by ' || w2 WHEN 4 THEN w1 || ' sources: ' || w2 ELSE line END"


@query(f"""WITH {_ROWS}, t AS (SELECT doc_id, pos, line, {_CREDIT} AS t FROM e), c AS (SELECT *, {_sql_credit("t")} AS credit FROM t)
SELECT doc_id, pos, credit, regexp_matches(coalesce(credit, line), '(?i)(reprinted|reproduced|adapted|courtesy|permission|copyright|©)') AS permission, {_like("t", True)} AS strict, {_like("t", False)} AS relaxed FROM c""")
def credit_lines(spark, d):
    """Credits of lines, whether they need permission, and whether a line reads like a reference."""
    t = rows(spark, d).select(*_KEY, "line", F.expr(_CREDIT).alias("t"))
    credit = F.nullif(F.regexp_replace(checks.split_credit(F.col("t"))["credit"], "^[*_]+|[*_]+$", ""), F.lit(""))
    t = t.withColumn("credit", credit)
    return t.select(*_KEY, "credit", T.needs_permission(F.col("line"), F.col("credit")).alias("permission"), checks.citation_like(F.col("t")).alias("strict"), checks.citation_like(F.col("t"), False).alias("relaxed"))


@query(f"""WITH {_ROWS}, s AS (SELECT DISTINCT zone, tag FROM e WHERE n % 2 = 0 AND zone <> 'BODY'), l AS (SELECT DISTINCT zone FROM s)
SELECT doc_id, pos, l.zone IS NULL OR s.tag IS NOT NULL OR b.tag IS NOT NULL AS zone_ok FROM e LEFT JOIN l ON l.zone = e.zone LEFT JOIN s ON s.zone = e.zone AND s.tag = e.tag LEFT JOIN s b ON b.zone = e.zone AND b.tag = regexp_replace(e.tag, '[0-9]+$', '')""")
def zone_membership(spark, d):
    """Whether a tag is on its zone's list; the lists are the tags of lines of even length, BODY has none."""
    r = rows(spark, d)
    styles = r.filter((F.col("n") % 2 == 0) & (F.col("zone") != "BODY")).select("zone", F.col("tag").alias("style")).distinct()
    return quality.zone_allowed(F.col("zone"), F.col("tag"), styles, r).select(*_KEY, "zone_ok")


@query(f"""WITH {_ROWS}, c AS (SELECT doc_id, n % 101 AS c FROM e) SELECT doc_id, count(*) AS items, count(*) FILTER (WHERE c < 85) AS review, count(*) FILTER (WHERE c < 75) AS second, round(100.0 * count(*) FILTER (WHERE c < 85) / count(*), 1) AS percent, round(avg(c), 6) AS mean FROM c GROUP BY doc_id""")
def review_queue(spark, d):
    """Items of each document that need review, or a second model, with their share and the mean confidence."""
    r = quality.review_split(rows(spark, d).withColumn("confidence", F.col("n") % 101))
    low = F.count_if(F.col("needs_review"))
    return r.groupBy("doc_id").agg(F.count("*").alias("items"), low.alias("review"), F.count_if(F.col("confidence") < 75).alias("second"), F.round(100.0 * low / F.count("*"), 1).alias("percent"), F.round(F.avg("confidence"), 6).alias("mean"))


_TABLE_RULES = [(10, "^[A-Z][A-Z0-9 |.,!]+$", "T2"), (20, r"^\s*[0-9]+[.)]\s", "TNL-MID"), (30, r"^\s*[•–-]\s", "TBL-MID"), (15, r"(?i)^(note|source)", "TFN"), (5, r"^\s*$", "PMI"), (40, r"\|", "T")]


@query(f"""WITH {_ROWS} SELECT doc_id, pos, CASE {' '.join(f"WHEN regexp_matches(text, '{p}') THEN '{t}'" for _, p, t in sorted(_TABLE_RULES))} ELSE 'TD' END AS tag FROM e""")
def rule_table(spark, d):
    """Tags by a table of patterns with priorities: the least one that matches."""
    return stages.first_matching(rows(spark, d), "text", _TABLE_RULES, "TD").select(*_KEY, "tag")


@query(f"""WITH {_ROWS}, i AS (SELECT doc_id, pos, line AS t FROM e WHERE n % 3 = 0), g AS (SELECT doc_id, pos, w1 || ' ' || w2 || ' ' || line AS t FROM e WHERE n % 2 = 0 AND k % 2 = 0 UNION ALL SELECT doc_id, pos, w1 FROM e WHERE n % 2 = 0 AND k % 2 = 1)
SELECT doc_id, pos, CASE WHEN i.t IS NULL THEN g.t WHEN g.t IS NULL OR length(i.t) >= length(g.t) THEN i.t ELSE g.t END AS caption FROM i FULL JOIN g USING (doc_id, pos)""")
def legend_merge(spark, d):
    """Captions in the text and in a legend: the longer one of each place."""
    r, even = rows(spark, d), F.col("k") % 2 == 0
    legend = r.filter("n % 2 = 0").select(*_KEY, F.when(even, F.concat_ws(" ", "w1", "w2", "line")).otherwise(F.col("w1")).alias("caption"))
    return joins.outer_merge(r.filter("n % 3 = 0").select(*_KEY, F.col("line").alias("caption")), legend, list(_KEY), "caption")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10 DAY")
def retention_sweep(spark, d):
    """Events of the last ten days before the newest one. The bound is a constant of the plan, so it reaches the scan."""
    e = events(spark, d)
    return workflow.retained(e, "ts", F.lit(e.agg(F.max("ts")).first()[0]), 10).select("event_id")


@query("""WITH s AS (SELECT o_custkey, o_orderkey AS attempt, o_orderkey % 41 + 60 AS score, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r, o_orderkey % 5 AS tries FROM orders)
SELECT o_custkey, attempt, score, score < 85 AND score >= 70 AND attempt < 20000 AS again FROM s WHERE r = 1""")
def retry_queue(spark, d):
    """Orders as attempts: whether a customer's last one goes again by its score."""
    o = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("attempt"), (F.col("o_orderkey") % 41 + 60).alias("score"))
    return jobs.retry_ladder(o, "o_custkey", "attempt", "score", 20_000)


@query(f"""WITH {_ROWS}, s AS (SELECT doc_id || ':' || pos AS place, tag, n * 100 + k AS score FROM e), f AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY score DESC, place) = 1 AS f FROM s) SELECT place, tag, score FROM f ORDER BY f DESC, score DESC, place LIMIT 60""")
def example_pick(spark, d):
    """Sixty examples: the best of each tag, then the best of the rest."""
    r = rows(spark, d).select(F.concat_ws(":", "doc_id", "pos").alias("place"), "tag", (F.col("n") * 100 + F.col("k")).cast("long").alias("score"))
    return corpus.diverse_examples(r, "place", "tag", "score", 60)


@query("""SELECT o_orderkey, o_totalprice, o_orderstatus IN ('F', 'P') AS is_terminal, o_orderstatus = 'F' AND o_totalprice > 1000 AS is_verified FROM orders WHERE (o_orderstatus = 'O' AND o_totalprice < 50000) OR o_orderkey IN (1, 7, 33, 100) OR (o_orderstatus = 'F' AND o_custkey % 3 = 1)""")
def order_view(spark, d):
    """Conjunctive, disjunctive and list filters; projections with derived flags."""
    o, status = table(spark, d, "orders"), F.col("o_orderstatus")
    some = o.filter(((status == "O") & (F.col("o_totalprice") < 50_000)) | F.col("o_orderkey").isin(1, 7, 33, 100) | ((status == "F") & (F.col("o_custkey") % 3 == 1)))
    return some.select("o_orderkey", "o_totalprice", status.isin("F", "P").alias("is_terminal"), ((status == "F") & (F.col("o_totalprice") > 1000)).alias("is_verified"))


@query(f"""WITH {_ROWS}, w AS (SELECT doc_id, pos, unnest(string_split(line, ' ')) AS w, generate_subscripts(string_split(line, ' '), 1) AS i FROM e), m AS (SELECT doc_id, pos, w, (sum(length(w) + 1) OVER (PARTITION BY doc_id, pos ORDER BY i) - length(w) - 1)::BIGINT AS s FROM w),
t AS (SELECT doc_id, pos, s, s + length(w) AS e, w AS term FROM m WHERE regexp_matches(w, '[.,;:!?]$')), r AS (SELECT doc_id, pos, n, unnest(range(0, n // 9 + 1)) AS g FROM e), u AS (SELECT doc_id, pos, g * 9 AS s, least(g * 9 + 9, n) AS e, (['italic', 'bold', 'plain'])[(g + n) % 3 + 1] AS style FROM r WHERE g * 9 < n)
SELECT t.doc_id, t.pos, greatest(t.s, u.s) AS s, least(t.e, u.e) AS e, style, term FROM t JOIN u ON u.doc_id = t.doc_id AND u.pos = t.pos AND u.s < t.e AND t.s < u.e WHERE t.s < t.e""")
def styled_terms(spark, d):
    """Where words with a mark at their end meet runs of one style (nine characters each). SQL joins all pairs of a line."""
    from pyspark.sql import Window

    r = rows(spark, d)
    # pieces that end with such a word, and what is left: their lengths add up to places as words' would, and they are fewer
    pieces = r.select(*_KEY, F.posexplode(F.split("line", "(?<=[.,;:!?]) ")).alias("i", "piece"))
    so_far = Window.partitionBy(*_KEY).orderBy("i")
    pieces = pieces.withColumns({"e": F.sum(F.length("piece") + 1).over(so_far) - 1, "term": F.substring_index("piece", " ", -1)})
    terms = pieces.filter(F.col("term").rlike("[.,;:!?]\\z")).select(*_KEY, (F.col("e") - F.length("term")).alias("s"), "e", "term")
    n, g = F.col("n"), F.col("g")
    runs = r.select(*_KEY, "n", F.explode(F.sequence(F.lit(0), F.floor(n / 9).cast("int"))).alias("g")).filter(g * 9 < n)
    style = F.element_at(F.array(F.lit("italic"), F.lit("bold"), F.lit("plain")), ((g + n) % 3 + 1).cast("int"))
    runs = runs.select(*_KEY, (g * 9).cast("long").alias("s"), F.least(g * 9 + 9, n).cast("long").alias("e"), style.alias("style"))
    return spans.intersected(runs, terms, _KEY, "s", "e", "style", "term")
